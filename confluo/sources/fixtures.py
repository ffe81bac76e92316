"""Synthetic populations with the distributions and defects the linker must survive.

Every draw is a hash of the row and a seed, so a population is the same on any
cluster; random streams of other generators are not reproduced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = (("New", 0.18), ("Occasional", 0.42), ("Regular", 0.30), ("VIP", 0.10))
FIRST = ("Ada", "Ben", "Chloé", "Dan", "Eve", "Finn", "Grace", "Hugh", "Isla", "Jack", "Kira", "Liam")
LAST = ("Smith", "Jones", "Müller", "Brown", "Taylor", "Evans", "Walker", "Hall", "Young", "Clarke")


def draw(seed: int, *key: str) -> Column:
    """Uniform in [0, 1) from the key."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)) / float(1 << 40)


def pick(values: tuple, u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def weighted_pick(values: tuple[tuple[str, float], ...], u: Column) -> Column:
    out, total = F, 0.0
    for v, w in values[:-1]:
        total += w
        out = out.when(u < total, v)
    return out.otherwise(values[-1][0])


def customers(spark: SparkSession, n: int = 10_000, seed: int = 42) -> DataFrame:
    d = spark.range(n).withColumn("ground_truth_id", F.format_string("GT%06d", F.col("id") + 1))
    u = lambda k: draw(seed + k, "ground_truth_id")
    first, last = pick(FIRST, u(1)), pick(LAST, u(2))
    return d.select(
        "ground_truth_id", first.alias("first_name"), last.alias("surname"),
        F.date_format(F.date_sub(F.lit("2007-01-01").cast("date"), F.floor(u(3) * 67 * 365).cast("int")), "yyyy-MM-dd").alias("date_of_birth"),
        F.concat(F.lower(F.translate(first, "é", "e")), F.lit("."), F.lower(F.translate(last, "ü", "u")), F.col("id"), F.lit("@example.com")).alias("email"),
        F.format_string("+44 7%09d", F.col("id") * 7 + 11).alias("telephone_number"),
        F.concat((F.floor(u(4) * 200) + 1).cast("string"), F.lit(" High Street")).alias("address"),
        F.concat(pick(("SO", "BN", "LS", "M"), u(5)), (F.floor(u(6) * 20) + 1).cast("string"), F.lit(" "), F.floor(u(7) * 9).cast("string"), F.lit("AB")).alias("postcode"),
        weighted_pick(SEGMENTS, u(8)).alias("customer_segment"),
        pick(("South East", "South West", "London", "Midlands", "North"), u(9)).alias("region"),
        F.date_format(F.date_sub(F.lit("2025-12-01").cast("date"), F.floor(u(10) * 1095).cast("int")), "yyyy-MM-dd").alias("registration_date"),
    )


def events(spark: SparkSession, n: int = 52, seed: int = 42) -> DataFrame:
    d = spark.sql(f"select posexplode(sequence(date'2025-01-04', date'2025-01-04' + interval {7 * (n - 1)} days, interval 7 days)) as (i, event_date)")
    d = d.withColumn("event_id", F.format_string("EVT%04d", F.col("i") + 1))
    u = lambda k: draw(seed + k, "event_id")
    standing, seated = F.floor(u(0) * 501).cast("int"), F.floor(u(1) * 201).cast("int")
    return d.select(
        "event_id", F.concat(pick(("Harbour", "Midnight", "Summer", "Northern"), u(2)), F.lit(" Night "), F.col("i") + 1).alias("event_name"), pick(("Concert", "Comedy", "Theatre", "Festival"), u(3)).alias("event_category"), "event_date",
        standing.alias("event_standing_attendance"), seated.alias("event_seated_attendance"), (standing + seated).alias("event_total_attendance"),
        F.round(15 + u(4) * 30, 2).alias("ticket_price_standing"), F.round(25 + u(5) * 50, 2).alias("ticket_price_seated"))


def weighted_sample(df: DataFrame, n: int, weight: Column, seed: int, *key: str) -> DataFrame:
    """n rows without replacement, by exponential keys (a sampling operator)."""
    return df.orderBy(-F.log(1 - draw(seed, *key)) / weight, *key).limit(n)


def corrupted(df: DataFrame, rules: dict[str, list[tuple[float, Column]]], seed: int, *key: str) -> DataFrame:
    """Per column a cascade of (probability, replacement); one draw decides."""
    out = {}
    for k, (column, cases) in enumerate(rules.items()):
        u, total = draw(seed + k, *key), 0.0
        value: Column | object = F
        for p, replacement in cases:
            total += p
            value = value.when(u < total, replacement)
        out[column] = value.otherwise(F.col(column))
    return df.withColumns(out)


def typo(c: Column, u: Column) -> Column:
    """Two neighbouring characters swapped."""
    at = (F.floor(u * F.greatest(F.length(c) - 1, F.lit(1))) + 1).cast("int")
    return F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + 1, F.lit(1)), F.substring(c, at, F.lit(1)), F.substring(c, at + 2, F.length(c)))


def crm(population: DataFrame, seed: int = 7, duplicates: float = 0.025) -> DataFrame:
    """CRM rows with their truth: clean, corrupted, and some customers twice."""
    again = population.where(draw(seed, "ground_truth_id") < duplicates).withColumn("copy", F.lit(1))
    rows = population.withColumn("copy", F.lit(0)).unionByName(again)
    key = ("ground_truth_id", "copy")
    rows = corrupted(rows, {
        "email": [(0.05, F.lit("")), (0.05, F.upper("email")), (0.03, typo(F.col("email"), draw(seed + 50, *key)))],
        "telephone_number": [(0.08, F.lit("")), (0.10, F.regexp_replace("telephone_number", r"^\+44 ", "0"))],
        "surname": [(0.04, typo(F.col("surname"), draw(seed + 51, *key))), (0.03, F.upper("surname"))],
        "postcode": [(0.05, F.lit("")), (0.05, F.split("postcode", " ")[0])],
    }, seed + 1, *key)
    portal = F.when(draw(seed + 9, "ground_truth_id") < 0.55, F.concat(F.lit("USR"), F.substring("ground_truth_id", 3, 6))).otherwise("")
    return rows.withColumn("portal_user_id", portal).withColumn("crm_customer_id", F.concat(F.lit("CRM"), F.substring("ground_truth_id", 3, 6), F.col("copy").cast("string"))).withColumns({
        "record_created_date": F.col("registration_date"),
        "preferred_contact_channel": pick(("Email", "Telephone", "Mail", "Unknown"), draw(seed + 10, *key)),
    }).drop("copy", "customer_segment", "region", "registration_date")


def gamma_minutes(u: Column, v: Column, low: float, high: float, scale: float) -> Column:
    """Gamma of shape 2 as the sum of two exponentials, clamped."""
    return F.greatest(F.lit(low), F.least(F.lit(high), -scale * (F.log(1 - u) + F.log(1 - v))))


def environment_checks(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, d in tables.items()])
