"""Checks of a finished run and its reports, as tables rather than exceptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.operators import gold, quality
from confluo.plans.resolution import Resolved

IDENTITY_FIELDS = ("first_name", "surname", "full_name", "email", "phone", "address", "postcode", "date_of_birth")


def failures(checks: dict[str, DataFrame]) -> DataFrame:
    """check, failures: the rows that each check returned; 0 is a pass."""
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("failures")).select(F.lit(n).alias("check"), "failures") for n, d in checks.items()])


def run_checks(run: Resolved, tables: dict[str, DataFrame], details: DataFrame, interactions: DataFrame) -> DataFrame:
    """tables: master and provenance of ``golden``."""
    m, c = run.mapping, run.clusters
    sizes = m.groupBy("ucr_id").agg(F.count("*").alias("n"))
    linked = m.select("staging_record_id", "ucr_id").join(run.silver, "staging_record_id")
    # Authoritative rules may join two births, so that check reports and never stops a run.
    uncovered = quality.uncovered(run.silver, IDENTITY_FIELDS)
    grid = tables["provenance"].groupBy("ucr_id").agg(F.count_distinct("attribute").alias("n")).where(F.col("n") != len(gold.ATTRIBUTES))
    bundle = tables["provenance"].where("attribute in ('first_name', 'surname', 'full_name') and staging_record_id <> ''").groupBy("ucr_id").agg(F.count_distinct("staging_record_id").alias("n")).where("n > 1")
    address = tables["provenance"].where("attribute in ('address', 'postcode') and staging_record_id <> ''").groupBy("ucr_id").agg(F.count_distinct("staging_record_id").alias("n")).where("n > 1")
    online = run.silver.where("linked_transaction_id <> ''")
    checks = {
        "staging ids unique": quality.duplicates(run.silver, "staging_record_id"),
        "source records unique": quality.duplicates(run.silver, "source_system", "source_record_id"),
        "each record in one entity": quality.duplicates(m, "staging_record_id"),
        "every eligible record mapped": run.silver.join(m, "staging_record_id", "left_anti").join(run.anonymous, "staging_record_id", "left_anti"),
        "no anonymous record mapped": m.join(run.anonymous, "staging_record_id", "left_semi"),
        "cluster sizes": c.join(sizes, "ucr_id", "full").where("not (cluster_size <=> n)"),
        "entities unique": quality.duplicates(c, "ucr_id"),
        "confidence between 0 and 1": quality.outside(c.where("cluster_confidence is not null"), 0.0, 1.0, "cluster_confidence"),
        "singletons have one record": c.where("(resolution_status = 'unresolved_singleton') <> (cluster_size = 1)"),
        "one portal per entity": quality.constant_within(linked, "ucr_id", "portal_user_id"),
        "one birth per entity": quality.constant_within(linked, "ucr_id", "date_of_birth_normalised"),
        "links point to sales": quality.orphans(online.select("linked_transaction_id"), "linked_transaction_id", run.silver.where("source_system = 'ECOMMERCE'"), "transaction_id"),
        "only sessions link to sales": online.where("source_system <> 'ONLINE'"),
        "normalised where raw": uncovered.where(" + ".join(IDENTITY_FIELDS) + " > 0"),
        "master covers entities": c.join(tables["master"], "ucr_id", "left_anti"),
        "provenance covers attributes": grid,
        "a name from one record": bundle,
        "an address from one record": address,
        "a detail row per record": m.join(details, "staging_record_id", "left_anti"),
        "interactions add up": interactions.join(sizes, "ucr_id").where("CRM + ECOMMERCE + SUPPORT + MARKETING + ONLINE <> n"),
    }
    if "transaction_total" in details.columns:
        total = details.where("source_system = 'ECOMMERCE'").withColumn("_total", F.expr("try_cast(transaction_total as double)"))
        wanted = interactions.where("ECOMMERCE > 0")
        checks["revenue adds up"] = quality.reconcile(total, wanted, "ucr_id", "_total", "transaction_total")
    return failures(checks)


def section(name: str, row: DataFrame, position: int = 0) -> DataFrame:
    """A one-row table as report lines: section, metric, value, ord."""
    lines = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value"), F.lit(position * 1000 + i).alias("ord")) for i, c in enumerate(row.columns)])
    return row.select(F.lit(name).alias("section"), F.explode(lines).alias("l")).select("section", "l.*")


def counted(name: str, df: DataFrame, key: str, position: int = 0) -> DataFrame:
    """Row counts by a column of few values as report lines."""
    c = df.groupBy(F.col(key).alias("metric")).agg(F.count("*").cast("string").alias("value"))
    return c.select(F.lit(name).alias("section"), "metric", "value", F.lit(position * 1000).alias("ord"))


def run_report(run: Resolved, interactions: DataFrame | None = None) -> DataFrame:
    """Summary of a run in the sections of its stages, ordered by ``ord`` and metric."""
    rows = lambda d, n: d.agg(F.count("*").alias(n))
    parts = [
        counted("SOURCES", run.silver, "source_system", 1),
        section("ELIGIBILITY", rows(run.silver, "consolidated_records").join(rows(run.mapping, "eligible_records")).join(rows(run.anonymous, "anonymous_records")), 2),
        counted("EXACT RULES", run.exact_decisions.where("accepted"), "rule", 3),
        counted("EXACT REJECTIONS", run.exact_decisions.where("not accepted"), "reason", 4),
        counted("FUZZY DECISIONS", run.scored, "decision", 5),
        section("FUZZY VOLUME", run.scored.agg(F.count("*").alias("candidate_pairs"), F.coalesce(F.sum("record_pairs_compared"), F.lit(0)).alias("record_pairs_compared")), 6),
        counted("ENTITIES", run.clusters, "resolution_status", 7),
        section("ENTITY SIZES", run.clusters.agg(F.count("*").alias("entities"), F.max("cluster_size").alias("largest"), F.round(F.avg("cluster_size"), 4).alias("mean_size")), 8),
    ]
    if interactions is not None:
        parts.append(section("INTERACTIONS", interactions.agg(F.round(F.sum("transaction_total"), 2).alias("revenue"), F.sum("session_count").alias("sessions"), F.sum("ticket_count").alias("tickets")), 9))
    return reduce(DataFrame.unionByName, parts)
