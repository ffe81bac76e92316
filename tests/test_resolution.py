import pytest
from pyspark.sql import functions as F

from confluo.operators import gold, lookup
from confluo.plans import checks, evaluation, resolution
from confluo.sources import fixtures, population
from confluo.sources.systems import BY_SYSTEM, truth


@pytest.fixture(scope="module")
def raw(spark):
    return resolution.generated(spark, 150, 2, 500, 80, 200)


@pytest.fixture(scope="module")
def run(raw):
    return resolution.resolve(resolution.silver(raw))


@pytest.fixture(scope="module")
def golden(run):
    return resolution.golden(run)


@pytest.fixture(scope="module")
def details(run):
    return resolution.interaction_details(run).cache()


@pytest.fixture(scope="module")
def interactions(run, details):
    return resolution.interaction_summary(run, details).cache()


def test_systems_hold_their_invariants(spark, raw):
    sales, sessions, tickets, contacts = (raw[s] for s in ("ECOMMERCE", "ONLINE", "SUPPORT", "MARKETING"))
    assert population.attendance_gaps(sales, fixtures.events(spark, 2)).isEmpty()
    for system, d in raw.items():
        assert d.groupBy(BY_SYSTEM[system].id_column).count().where("count > 1").isEmpty()
        assert not any(c in population.operational(d).columns for c in population.TRUTH_ONLY)
        assert "ground_truth_id" in population.truth_map(d, system).columns
    assert sales.where("transaction_date_time >= event_date or guest_transaction = 'true' and portal_user_id <> ''").isEmpty()
    low, high = population.SESSION_LIMITS
    assert sessions.where(~F.col("session_duration_seconds").cast("int").between(low, high)).isEmpty()
    assert sessions.where("linked_transaction_id <> '' and (basket_converted <> 'true' or basket_created <> 'true')").isEmpty()
    assert sessions.where("linked_transaction_id <> ''").join(sales, F.col("linked_transaction_id") == F.col("transaction_id"), "left_anti").isEmpty()
    assert tickets.where("(ticket_status = 'Open') <> (resolution_time_hours_minutes = '')").isEmpty()
    assert contacts.where("cast(links_clicked_count as int) > cast(emails_opened_count as int)").isEmpty()
    assert sessions.count() == 500


def test_choice_follows_weights(spark):
    members = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y"), ("b", 1, "z")], "class string, place long, who string")
    cells = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 1.0)], "class string, n long, weight double")
    rows = spark.range(8000).withColumnRenamed("id", "k")
    got = {r.who: r["count"] / 8000 for r in population.choose(rows, members, cells, [], 5, "k").groupBy("who").count().collect()}
    assert got["x"] == pytest.approx(0.5, abs=0.03) and got["y"] == pytest.approx(0.25, abs=0.03) and sum(got.values()) == 1


def test_counts_of_events(spark):
    d = spark.range(4000).withColumn("n", population.poisson(F.lit(4.5), 1, "id")).withColumn("c", population.binomial(F.col("n"), F.lit(0.25), 2, "id"))
    d = d.withColumn("g", population.gamma(2, F.lit(6.0), 3, "id")).withColumn("h", population.gamma(2.2, F.lit(480.0), 5, "id"))
    m = d.agg(F.avg("n"), F.variance("n"), F.avg("c"), F.avg("g"), F.avg("h"), F.max(F.col("c") - F.col("n"))).first()
    assert m[0] == pytest.approx(4.5, abs=0.15) and m[1] == pytest.approx(4.5, abs=0.4) and m[2] == pytest.approx(1.125, abs=0.08)
    assert m[3] == pytest.approx(6, abs=0.3) and m[4] == pytest.approx(480, abs=20) and m[5] <= 0


def test_checks_of_a_run(run, golden, details, interactions):
    found = {r.check: r.failures for r in checks.run_checks(run, golden, details, interactions).collect()}
    found.pop("one birth per entity")  # authoritative rules may join two births
    assert len(found) >= 20 and not any(found.values()), found


def test_checks_find_damage(run, golden, details, interactions):
    worse = {**golden, "master": golden["master"].where("ucr_id <> 'UCR000001'")}
    wrong = interactions.withColumn("ONLINE", F.col("ONLINE") + F.when(F.col("ucr_id") == "UCR000002", 1).otherwise(0))
    found = {r.check: r.failures for r in checks.run_checks(run, worse, details, wrong).collect()}
    assert found["master covers entities"] == 1 and found["interactions add up"] == 1


def test_quality_and_evaluation(raw, run):
    t = truth(raw)
    q = {r.stage: r for r in resolution.stage_quality(run, t).collect()}
    assert q["deterministic"].precision > 0.99 and q["deterministic"].recall > 0.9 and q["final"].recall >= q["deterministic"].recall
    tables = evaluation.evaluate_run(run, t)
    assert tables["calibration"].count() == 171 and tables["selected"].count() == 1
    every = {r.scope: r for r in tables["blocking"].collect()}
    assert every["all"].true_pairs == every["calibration"].true_pairs + every["evaluation"].true_pairs
    assert tables["false_negatives"].count() == every["all"].true_pairs - sum(r.right for r in tables["by_scope"].collect())
    assert all(r.right <= r.merges for r in tables["edges"].collect())


def test_report_counts_each_record_once(run, interactions):
    lines = checks.run_report(run, interactions).collect()
    number = lambda s, m=None: sum(float(r.value) for r in lines if r.section == s and m in (None, r.metric))
    assert number("SOURCES") == number("ELIGIBILITY", "consolidated_records") == run.silver.count()
    assert number("ENTITIES") == number("ENTITY SIZES", "entities")


def test_profile_views(run, golden, details):
    master = golden["master"]
    first = lookup.profile_header(master, "UCR000001").first()
    assert first.records >= 1 and first.status in ("Single record", "Deterministically linked", "Probabilistically linked")
    view = lookup.identity_view(master, "UCR000001", gold.ATTRIBUTES).collect()
    assert [r.attribute for r in view] == list(gold.ATTRIBUTES) and all(r.value for r in view)
    linked = resolution.links(run)
    assert lookup.linked_records(golden["attribute_candidates"], linked, ("name", "address")).count() == run.mapping.count()
    assert lookup.composition(linked).agg(F.sum("records")).first()[0] == run.mapping.count()
    whole = lookup.timeline(details, "UCR000001").collect()
    assert [r.interaction_date for r in whole] == sorted((r.interaction_date for r in whole), reverse=True)
    assert len(whole) == first.records


def test_golden_record_of_hand_made_sources(spark):
    crm = [("C1", "P1", "2024-01-02", "Email", "Ann", "Lee", "1990-02-01", "ann@x.org", "07123456789", "1 High Street", "")]
    shop = [("T1", "P1", "2025-03-01 10:00:00", "Ann", "Leigh", "ann@x.org", "07123456789", "9 Low Road", "SO1 4AB", "12.50")]
    sources = {
        "CRM": spark.createDataFrame(crm, "crm_customer_id string, portal_user_id string, record_created_date string, preferred_contact_channel string, first_name string, surname string, date_of_birth string, email string, telephone_number string, address string, postcode string"),
        "ECOMMERCE": spark.createDataFrame(shop, "transaction_id string, portal_user_id string, transaction_date_time string, purchaser_first_name string, purchaser_surname string, email string, telephone_number string, billing_address string, billing_postcode string, transaction_total string"),
    }
    run = resolution.resolve(resolution.silver(sources))
    g = resolution.golden(run)
    m = g["master"].first()
    # The complete address of the shop beats the incomplete one of the CRM; its name does not.
    assert (m.full_name, m.address, m.postcode, m.primary_email, m.registration_date) == ("Ann Lee", "9 Low Road", "SO1 4AB", "ann@x.org", "2024-01-02")
    assert (m.cluster_size, m.resolution_status, m.identity_attributes_populated) == (2, "deterministically_linked", 10)
    p = {r.attribute: r for r in g["provenance"].collect()}
    assert p["surname"].source_system == "CRM" and p["postcode"].source_system == "ECOMMERCE" and p["surname"].distinct_count == 2
