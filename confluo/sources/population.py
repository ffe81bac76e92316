"""The four activity systems of a generated population, with their truth.

Rows come from hashes of their own key, as in ``fixtures``.  A weighted choice of a
customer is two steps: a class of equal weight by its share, then a uniform place in
that class.  Both are equi-joins, so choices need neither a sort of all customers in
one task nor a comparison of every row with every customer.  Every function returns
the system's columns and ``ground_truth_id``; ``operational`` splits the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.functions import text as T
from confluo.sources.fixtures import corrupted, draw, pick, typo, weighted_pick
from confluo.sources.systems import BY_SYSTEM

SNAPSHOT = "2026-01-01"

# How often segments appear and return, and what they do.
ACTIVITY = {"New": 0.80, "Occasional": 1.00, "Regular": 1.20, "VIP": 1.40}
PURCHASES = {"New": 0.60, "Occasional": 0.80, "Regular": 1.00, "VIP": 1.20}
GUEST_CHECKOUT = {"New": 0.50, "Occasional": 0.30, "Regular": 0.18, "VIP": 0.10}
PORTAL_BOOST = 1.25
QUANTITIES = (("1", 0.64), ("2", 0.24), ("3", 0.08), ("4", 0.04))
SEATED_AGE = 60
TICKET_WEIGHTS = {("Standing", False): 1.30, ("Seated", False): 0.70, ("Standing", True): 0.65, ("Seated", True): 1.60}
CARDS = (("Visa", 0.55), ("Mastercard", 0.40), ("American Express", 0.05))
SESSION_MEANS = {"New": 300.0, "Occasional": 480.0, "Regular": 720.0, "VIP": 900.0}
CONVERTED_FACTOR, SESSION_SHAPE, SESSION_LIMITS = 1.50, 2.20, (30, 3600)
PORTAL_GUEST_SESSIONS, ONLINE_SHARE, ABANDONED_BASKETS = 0.20, 0.60, 0.22
DEVICES = (("Mobile", 0.65), ("PC", 0.35))
CHANNELS = (("Email", 0.70), ("Phone", 0.30))
ISSUES = {"Refund request": 0.40, "Accessibility": 0.15, "Complaint": 0.20, "Enquiry": 0.25}
ACCESSIBILITY_FACTOR, RESOLVED = 2.00, 0.86
RESOLUTION_MEANS = {"Refund request": 18.0, "Accessibility": 12.0, "Complaint": 24.0, "Enquiry": 6.0}
RESOLUTION_LIMITS = (5, 72 * 60)
CONSENT = {"New": 0.45, "Occasional": 0.60, "Regular": 0.75, "VIP": 0.85}
OPENED = {"New": 2.5, "Occasional": 4.5, "Regular": 7.0, "VIP": 10.0}
CLICKED = {"New": 0.10, "Occasional": 0.15, "Regular": 0.25, "VIP": 0.35}
ARRIVALS = 80  # far above any Poisson count of these means


def lookup(column: Column, values: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), column)


def poisson(mean: Column, seed: int, *key: str) -> Column:
    """Arrivals of unit-rate exponential gaps before ``mean``."""
    gaps = F.transform(F.sequence(F.lit(1), F.lit(ARRIVALS)), lambda i: -F.log(1 - draw_at(seed, i, *key)))
    start = F.struct(F.lit(0.0).alias("t"), F.lit(0).alias("n"))
    step = lambda s, g: F.struct((s["t"] + g).alias("t"), (s["n"] + F.when(s["t"] + g <= mean, 1).otherwise(0)).alias("n"))
    return F.aggregate(gaps, start, step, lambda s: s["n"])


def binomial(n: Column, p: Column, seed: int, *key: str) -> Column:
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: draw_at(seed, i, *key) < p))).otherwise(0)


def gamma(shape: float, mean: Column, seed: int, *key: str) -> Column:
    """Shape 2 is a sum of two exponentials; other shapes use the cube-root normal
    approximation, within a few per cent of every quantile that matters here."""
    u, v = draw(seed, *key), draw(seed + 1, *key)
    if shape == 2:
        return -(F.log(1 - u) + F.log(1 - v)) * mean / 2
    normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(v * 6.283185307179586)
    return mean * F.pow(F.greatest(F.lit(0.0), 1 - 1 / (9 * shape) + normal / (3 * shape**0.5)), F.lit(3.0))


def draw_at(seed: int, index: Column, *key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), index, *[F.col(k) for k in key]), F.lit(1 << 40)) / float(1 << 40)


def day_between(first: Column, last: Column, u: Column) -> Column:
    """A date from ``first`` to ``last``, both included; ``last`` if they cross."""
    return F.date_add(F.least(first, last), F.floor(u * (F.greatest(F.datediff(last, first), F.lit(0)) + 1)).cast("int"))


def moment(day: Column, u: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + F.floor(u * 86_400))


def stamp(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss")


def people(population: DataFrame, crm_rows: DataFrame, share: float, seed: int) -> DataFrame:
    """The customers of one system: weighted by segment and portal, each decided by
    its own draw, with portal ids and the class of equal weight that each is in."""
    portals = crm_rows.where("portal_user_id <> ''").groupBy("ground_truth_id").agg(F.min("portal_user_id").alias("portal"))
    p = population.join(portals, "ground_truth_id", "left").withColumn("has_portal", F.col("portal").isNotNull())
    weight = lookup(F.col("customer_segment"), ACTIVITY) * F.when(F.col("has_portal"), PORTAL_BOOST).otherwise(1.0)
    p = p.where(draw(seed, "ground_truth_id") < share * weight / (max(ACTIVITY.values()) * PORTAL_BOOST))
    p = p.withColumn("old", T.age_on(F.col("date_of_birth").cast("date"), F.lit(SNAPSHOT).cast("date")) >= SEATED_AGE)
    p = p.withColumn("class", F.concat_ws("/", "customer_segment", "has_portal", "old"))
    # Places by registration: a running number inside each day, on top of earlier days.
    days = p.groupBy("class", "registration_date").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("class").orderBy("registration_date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("class", "registration_date", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("class", "registration_date").orderBy("ground_truth_id"))
    return p.withColumn("_n", inside).join(days, ["class", "registration_date"]).withColumn("place", F.col("before") + F.col("_n") - 1).drop("_n", "before")


def choose(rows: DataFrame, members: DataFrame, cells: DataFrame, scope: list[str], seed: int, *key: str) -> DataFrame:
    """Each row meets one member, with replacement.  cells: scope, class, n, weight:
    how many first places of a class are open in a scope, and what each weighs."""
    open_ = cells.where("n > 0").withColumn("share", F.col("n") * F.col("weight"))
    running = Window.partitionBy(*scope).orderBy("class")
    open_ = open_.withColumn("high", F.sum("share").over(running))
    lists = open_.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("high", "class", "n"))).alias("cells"))
    j = rows.join(lists, scope) if scope else rows.crossJoin(F.broadcast(lists))  # one row then
    aim = draw(seed, *key) * F.element_at("cells", -1)["high"]
    j = j.withColumn("_aim", aim).withColumn("_cell", F.filter("cells", lambda c: c["high"] > F.col("_aim"))[0])
    j = j.withColumn("class", F.col("_cell")["class"]).withColumn("place", F.floor(draw(seed + 1, *key) * F.col("_cell")["n"]))
    return j.drop("cells", "_aim", "_cell").join(members, ["class", "place"]).drop("class", "place")


def class_cells(members: DataFrame, weights: dict[str, float]) -> DataFrame:
    c = members.groupBy("class", "customer_segment").agg(F.count("*").alias("n"))
    return c.withColumn("weight", lookup(F.col("customer_segment"), weights))


def shop(population: DataFrame, crm_rows: DataFrame, events: DataFrame, seed: int = 101, share: float = 1.0) -> DataFrame:
    """Tickets of every event: quantities of one to four that add up to the attendance
    of each ticket type, bought by customers registered before the event."""
    members = people(population, crm_rows, share, seed)
    kinds = events.select("event_id", "event_name", "event_category", "event_date", F.explode(F.array(*[
        F.struct(F.lit(k).alias("ticket_type"), F.col(f"event_{k.lower()}_attendance").alias("seats"), F.col(f"ticket_price_{k.lower()}").alias("unit_price")) for k in ("Standing", "Seated")
    ])).alias("k")).select("event_id", "event_name", "event_category", "event_date", "k.*").where("seats > 0")
    parts = kinds.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("seats"))))
    key = ("event_id", "ticket_type", "n")
    parts = parts.withColumn("size", weighted_pick(QUANTITIES, draw(seed + 1, *key)).cast("int"))
    sold = F.coalesce(F.sum("size").over(Window.partitionBy("event_id", "ticket_type").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    orders = parts.withColumn("_sold", sold).where("_sold < seats").withColumn("ticket_quantity", F.least(F.col("size"), F.col("seats") - F.col("_sold"))).drop("_sold", "size", "seats")
    # Open places: members of a class registered before the event.  Both sides of this
    # inequality are small: one row an event, one row a class and day.
    days = members.groupBy("class", "customer_segment", "old", "registration_date").agg(F.count("*").alias("d"))
    scopes = orders.select("event_id", "event_date", "ticket_type").distinct()
    factor = F.element_at(F.create_map(*[F.lit(x) for (k, o), w in TICKET_WEIGHTS.items() for x in (f"{k}/{str(o).lower()}", w)]), F.concat_ws("/", "ticket_type", "old"))
    cells = scopes.join(days, F.col("registration_date") < F.col("event_date").cast("string")).groupBy("event_id", "ticket_type", "class", "customer_segment", "old").agg(F.sum("d").alias("n"))
    cells = cells.select("event_id", "ticket_type", "class", "n", (lookup(F.col("customer_segment"), PURCHASES) * factor).alias("weight"))
    t = choose(orders, members, cells, ["event_id", "ticket_type"], seed + 2, *key)
    u = lambda k: draw(seed + 10 + k, *key)
    guest = ~F.col("has_portal") | (u(0) < lookup(F.col("customer_segment"), GUEST_CHECKOUT))
    opened = F.greatest(F.col("registration_date").cast("date"), F.date_sub("event_date", 60))
    t = t.withColumn("_guest", guest).withColumn("_at", moment(day_between(opened, F.date_sub("event_date", 1), u(1)), u(2)))
    holder = F.concat_ws(" ", "first_name", "surname")
    t = t.select(
        "ground_truth_id", "event_id", "event_name", "event_category", F.col("event_date").cast("string").alias("event_date"), "ticket_type", "n", "registration_date",
        F.concat(F.lit("TXN-"), F.col("event_id"), F.lit("-"), F.substring("ticket_type", 1, 2), F.format_string("-%04d", "n")).alias("transaction_id"),
        stamp(F.col("_at")).alias("transaction_date_time"), F.col("_guest").cast("string").alias("guest_transaction"), F.when(F.col("_guest"), "").otherwise(F.col("portal")).alias("portal_user_id"),
        F.coalesce("portal", F.lit("")).alias("available_portal_user_id"), F.col("address").alias("billing_address"), F.col("postcode").alias("billing_postcode"),
        F.col("ticket_quantity").cast("string").alias("ticket_quantity"), F.format_string("%.2f", "unit_price").alias("unit_price"), F.format_string("%.2f", F.col("unit_price") * F.col("ticket_quantity")).alias("transaction_total"),
        weighted_pick(CARDS, u(3)).alias("card_brand"), F.when(u(4) < 0.08, F.concat_ws(" ", F.substring("first_name", 1, 1), "surname")).otherwise(holder).alias("cardholder_name"),
        F.format_string("%04d", F.floor(u(5) * 10_000)).alias("card_last_4"), "email", F.col("first_name").alias("purchaser_first_name"), F.col("surname").alias("purchaser_surname"), "telephone_number")
    # Guests type more by hand, so each of their rates is three to four times as high.
    guest_ = F.col("guest_transaction") == "true"
    rate = lambda g, r, k: u(k) < F.when(guest_, g).otherwise(r)
    other = F.concat(F.split("email", "@")[0], F.lit("@example.org"))
    return t.withColumns({
        "email": F.when(rate(0.04, 0.01, 6), "").when(rate(0.12, 0.04, 7), other).when(rate(0.03, 0.01, 8), typo(F.col("email"), u(9))).otherwise(F.col("email")),
        "telephone_number": F.when(rate(0.12, 0.04, 10), "").when(rate(0.04, 0.01, 11), wrong_digit(F.col("telephone_number"), u(12))).otherwise(F.col("telephone_number")),
        "purchaser_surname": F.when(rate(0.04, 0.01, 13), typo(F.col("purchaser_surname"), u(14))).otherwise(F.col("purchaser_surname")),
        "billing_address": F.when(u(15) < 0.06, F.concat(F.floor(u(16) * 90 + 1).cast("string"), F.lit(" Old Road"))).otherwise(F.col("billing_address")),
        "billing_postcode": F.when(u(17) < 0.10, F.lower(F.replace("billing_postcode", F.lit(" "), F.lit("")))).otherwise(F.col("billing_postcode")),
    }).drop("n", "registration_date")


def wrong_digit(c: Column, u: Column) -> Column:
    """The last digit moved by one to nine."""
    return F.concat(F.substring(c, F.lit(1), F.length(c) - 1), ((F.right(c, F.lit(1)).cast("int") + 1 + F.floor(u * 9)) % 10).cast("string"))


def _repeated(population: DataFrame, crm_rows: DataFrame, rows: int, share: float, seed: int, seen: DataFrame | None = None) -> DataFrame:
    """Every customer of the system once, unless already ``seen``, and further rows by
    weight, to ``rows``; more than that if there are more customers."""
    members = people(population, crm_rows, share, seed)
    first = (members if seen is None else members.join(seen, "ground_truth_id", "left_anti")).withColumn("copy", F.lit(0).cast("long"))
    more = members.sparkSession.range(1, max(rows - first.count(), 0) + 1).withColumnRenamed("id", "copy")
    return first.drop("class", "place").unionByName(choose(more, members, class_cells(members, ACTIVITY), [], seed + 2, "copy"))


def online(population: DataFrame, crm_rows: DataFrame, sales: DataFrame, rows: int = 40_000, seed: int = 201, share: float = 1.0) -> DataFrame:
    """Sessions: a converted one for a share of all sales, one for every other customer,
    and browsing by weight up to ``rows``."""
    portals = crm_rows.where("portal_user_id <> ''").groupBy("ground_truth_id").agg(F.min("portal_user_id").alias("portal"))
    bought = sales.where(draw(seed, "transaction_id") < ONLINE_SHARE).select("ground_truth_id", "transaction_id", F.to_timestamp("transaction_date_time").alias("_end"), (F.col("guest_transaction") == "true").alias("_guest"))
    bought = bought.join(population.select("ground_truth_id", "customer_segment"), "ground_truth_id").join(portals, "ground_truth_id", "left").withColumn("copy", F.xxhash64("transaction_id"))
    browsing = _repeated(population, crm_rows, max(rows - bought.count(), 0), share, seed + 1, bought.select("ground_truth_id")).withColumn("transaction_id", F.lit(""))
    key = ("ground_truth_id", "copy", "transaction_id")
    u = lambda k: draw(seed + 10 + k, *key)
    browsing = browsing.withColumns({"_end": moment(day_between(F.col("registration_date").cast("date"), F.lit("2025-12-30").cast("date"), u(0)), u(1)), "_guest": F.col("portal").isNull() | (u(2) < PORTAL_GUEST_SESSIONS)})
    columns = ["ground_truth_id", "copy", "transaction_id", "customer_segment", "portal", "_end", "_guest"]
    s = bought.select(*columns).unionByName(browsing.select(*columns)).withColumn("_sold", F.col("transaction_id") != "")
    mean = lookup(F.col("customer_segment"), SESSION_MEANS) * F.when(F.col("_sold"), CONVERTED_FACTOR).otherwise(1.0)
    low, high = SESSION_LIMITS
    s = s.withColumn("_seconds", F.greatest(F.lit(low), F.least(F.lit(high), F.round(gamma(SESSION_SHAPE, mean, seed + 40, *key)).cast("int"))))
    return s.select(
        "ground_truth_id", "customer_segment", F.coalesce("portal", F.lit("")).alias("available_portal_user_id"),
        F.concat(F.lit("SES-"), F.hex(F.xxhash64(*key))).alias("session_id"), F.col("_guest").cast("string").alias("guest_session"), F.when(F.col("_guest") | F.col("portal").isNull(), "").otherwise(F.col("portal")).alias("portal_user_id"),
        stamp(F.timestamp_seconds(F.unix_timestamp("_end") - F.col("_seconds"))).alias("session_date_time_start"), stamp(F.col("_end")).alias("session_date_time_end"), F.col("_seconds").cast("string").alias("session_duration_seconds"),
        weighted_pick(DEVICES, u(3)).alias("device_type"), (F.col("_sold") | (u(4) < ABANDONED_BASKETS)).cast("string").alias("basket_created"), F.col("_sold").cast("string").alias("basket_converted"), F.col("transaction_id").alias("linked_transaction_id"))


def support(population: DataFrame, crm_rows: DataFrame, rows: int = 5_000, seed: int = 301, share: float = 0.45) -> DataFrame:
    """Tickets; those of older customers ask for accessibility twice as often."""
    key = ("ground_truth_id", "copy")
    u = lambda k: draw(seed + 10 + k, *key)
    t = _repeated(population, crm_rows, rows, share, seed)
    total = F.when(F.col("old"), 1 + ISSUES["Accessibility"] * (ACCESSIBILITY_FACTOR - 1)).otherwise(1.0)
    edge, issue = F.lit(0.0), F
    for name, w in ISSUES.items():
        edge = edge + F.when(F.col("old"), w * (ACCESSIBILITY_FACTOR if name == "Accessibility" else 1.0)).otherwise(w)
        issue = issue.when(u(0) * total < edge, name)
    t = t.withColumn("intended_issue_category", issue.otherwise("Enquiry")).withColumn("contact_channel", weighted_pick(CHANNELS, u(1)))
    low, high = RESOLUTION_LIMITS
    minutes = F.greatest(F.lit(low), F.least(F.lit(high), F.round(60 * gamma(2, lookup(F.col("intended_issue_category"), RESOLUTION_MEANS), seed + 40, *key)).cast("int")))
    resolved = u(2) < RESOLVED
    by_mail = F.col("contact_channel") == "Email"
    name = F.concat_ws(" ", "first_name", "surname")
    return t.select(
        "ground_truth_id", "customer_segment", "intended_issue_category", F.concat(F.lit("SUP-"), F.hex(F.xxhash64(*key))).alias("support_ticket_id"),
        stamp(moment(day_between(F.col("registration_date").cast("date"), F.lit("2025-12-27").cast("date"), u(3)), u(4))).alias("support_ticket_created_date_time"),
        F.when(u(5) < 0.03, typo(name, u(6))).otherwise(name).alias("requester_name"),
        F.when(~by_mail, "").when(u(7) < 0.07, typo(F.col("email"), u(8))).otherwise(F.col("email")).alias("requester_email"),
        F.when(by_mail, "").when(u(9) < 0.07, wrong_digit(F.col("telephone_number"), u(10))).otherwise(F.col("telephone_number")).alias("requester_phone"),
        "contact_channel", F.when(u(11) < 0.05, pick(tuple(ISSUES), u(12))).otherwise(F.col("intended_issue_category")).alias("issue_category"),
        F.when(resolved, "Resolved").otherwise("Open").alias("ticket_status"),
        F.when(resolved, F.format_string("%02d:%02d", F.floor(minutes / 60), minutes % 60)).otherwise("").alias("resolution_time_hours_minutes"))


def marketing(population: DataFrame, crm_rows: DataFrame, rows: int = 12_000, seed: int = 401, share: float = 1.0) -> DataFrame:
    """Contacts with consent, Poisson opens and binomial clicks by segment."""
    key = ("ground_truth_id", "copy")
    u = lambda k: draw(seed + 10 + k, *key)
    m = _repeated(population, crm_rows, rows, share, seed).withColumn("_opened", poisson(lookup(F.col("customer_segment"), OPENED), seed + 40, *key))
    m = m.select(
        "ground_truth_id", "customer_segment", "copy", (F.col("copy") > 0).alias("is_repeat_contact"), F.concat(F.lit("MKT-"), F.hex(F.xxhash64(*key))).alias("marketing_contact_id"),
        F.concat_ws("_", "first_name", "surname").alias("contact_name"), F.date_format(day_between(F.col("registration_date").cast("date"), F.lit("2025-12-31").cast("date"), u(0)), "yyyy-MM-dd").alias("last_contact_date"),
        (u(1) < lookup(F.col("customer_segment"), CONSENT)).cast("string").alias("consent_status"), F.col("_opened").cast("string").alias("emails_opened_count"),
        binomial(F.col("_opened"), lookup(F.col("customer_segment"), CLICKED), seed + 41, *key).cast("string").alias("links_clicked_count"), "email", "postcode")
    local = F.split("email", "@")[0]
    return corrupted(m, {
        "contact_name": [(0.05, F.lit("")), (0.05, typo(F.col("contact_name"), u(3)))],
        "email": [(0.05, F.concat(local, F.lit("@example.org"))), (0.05, F.concat(F.lit("old."), local, F.lit("@example.net")))],
        "postcode": [(0.05, F.split("postcode", " ")[0]), (0.08, F.regexp_replace("postcode", "AB$", "XY")), (0.05, F.regexp_replace("postcode", "AB$", "ZZ"))],
    }, seed + 60, *key).drop("copy")


TRUTH_ONLY = ("ground_truth_id", "customer_segment", "available_portal_user_id", "intended_issue_category", "is_repeat_contact")


def operational(rows: DataFrame) -> DataFrame:
    """What the system itself would know."""
    return rows.drop(*TRUTH_ONLY)


def truth_map(rows: DataFrame, system: str) -> DataFrame:
    """The protected side: the record id and what only the generator knows."""
    return rows.select(BY_SYSTEM[system].id_column, *[c for c in TRUTH_ONLY if c in rows.columns])


def attendance_gaps(sales: DataFrame, events: DataFrame) -> DataFrame:
    """Events and ticket types whose tickets do not add up to the attendance."""
    kinds = events.select("event_id", F.col("event_standing_attendance").alias("Standing"), F.col("event_seated_attendance").alias("Seated")).unpivot("event_id", ["Standing", "Seated"], "ticket_type", "attendance")
    sold = sales.groupBy("event_id", "ticket_type").agg(F.sum(F.col("ticket_quantity").cast("long")).alias("sold"))
    return kinds.join(sold, ["event_id", "ticket_type"], "left").na.fill(0, ["sold"]).where("sold <> attendance")
