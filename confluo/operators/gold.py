"""Golden records: survivorship with provenance, and interactions per entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.functions import text as T

# Source priority and the attributes of a golden record.
PRIORITY = {"CRM": 1, "ECOMMERCE": 2, "SUPPORT": 3, "MARKETING": 4, "ONLINE": 5}
ATTRIBUTES = ("first_name", "surname", "full_name", "date_of_birth", "primary_email", "telephone_number", "address", "postcode", "preferred_contact_channel", "registration_date")


def case_of(column: str, values: dict[str, Column | int], other=None) -> Column:
    out = reduce(lambda w, kv: w.when(F.col(column) == kv[0], kv[1]), values.items(), F)
    return out.otherwise(other)


def rank_date(columns: dict[str, str]) -> Column:
    """The date a system ranks by; columns: system -> column."""
    return F.coalesce(case_of("source_system", {s: F.col(c) for s, c in columns.items()}), F.lit(""))


def long_candidates(links: DataFrame, attributes: dict[str, tuple[str, str]]) -> DataFrame:
    """Unpivot: ucr_id, attribute, value, key, one row per record with the value.
    attributes: name -> (value column, key column)."""
    entries = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(v).alias("value"), F.col(k).alias("key")) for a, (v, k) in attributes.items()]))
    base = [c for c in ("ucr_id", "staging_record_id", "source_system", "priority", "completeness", "rank_date") if c in links.columns]
    out = links.select(*base, entries.alias("e")).select(*base, "e.attribute", "e.value", "e.key")
    return out.where(T.blank_to_null(F.col("key")).isNotNull())


def survivors(candidates: DataFrame, entity: str = "ucr_id", attribute: str = "attribute", earliest: bool = False) -> DataFrame:
    """One candidate per entity and attribute.  Only the most complete compete; then
    source priority, frequency of the key among those, latest date, least record.
    Candidate and distinct counts are over all, frequency over the competitors."""
    group = [entity, attribute]
    all_ = Window.partitionBy(*group)
    c = candidates.withColumn("candidate_count", F.count("*").over(all_)).withColumn("distinct_count", F.size(F.collect_set("key").over(all_)).cast("long"))
    c = c.withColumn("_top", F.max("completeness").over(all_)).where(F.col("completeness") == F.col("_top")).drop("_top")
    c = c.withColumn("frequency", F.count("*").over(Window.partitionBy(*group, "key")))
    order = ["priority", "key", "staging_record_id"] if earliest else ["priority", F.desc("frequency"), F.desc("rank_date"), "staging_record_id"]
    return c.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_n = 1").drop("_n")


def provenance(chosen: DataFrame, entities: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """Every entity by every attribute; those without a value say so."""
    grid = entities.select("ucr_id", F.explode(F.array(*map(F.lit, attributes))).alias("attribute"))
    p = grid.join(chosen.select("ucr_id", "attribute", "value", "staging_record_id", "source_system", "candidate_count", "distinct_count"), ["ucr_id", "attribute"], "left")
    return p.withColumn("reason", F.when(F.col("value").isNull(), "No populated candidate").otherwise("Selected")).na.fill("", ["value", "staging_record_id", "source_system"]).na.fill(0, ["candidate_count", "distinct_count"])


def attribute_candidates(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """All candidates with selected / matches / alternative flags and the frequency of
    their key over all populated candidates."""
    freq = F.count("*").over(Window.partitionBy("ucr_id", "attribute", "key"))
    pick = chosen.select("ucr_id", "attribute", F.col("staging_record_id").alias("chosen_record"), F.col("key").alias("chosen_key"))
    c = candidates.withColumn("selection_key_frequency", freq).join(pick, ["ucr_id", "attribute"], "left")
    c = c.withColumn("is_selected", F.col("staging_record_id") == F.col("chosen_record")).withColumn("matches_selected", F.col("key") == F.col("chosen_key"))
    return c.withColumn("is_alternative", ~F.col("matches_selected")).drop("chosen_record", "chosen_key")


def master(chosen: DataFrame, entities: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """Wide golden record; absent attributes are ""."""
    wide = chosen.groupBy("ucr_id").pivot("attribute", list(attributes)).agg(F.first("value"))
    return entities.select("ucr_id").join(wide, "ucr_id", "left").na.fill("")


def latest(df: DataFrame, entity: str, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).where("_n = 1").drop("_n")


def shop_summary(r: DataFrame) -> DataFrame:
    total = T.parse_float(F.col("transaction_total"))
    return r.groupBy("ucr_id").agg(
        F.count("*").alias("transaction_count"), F.coalesce(F.sum(total), F.lit(0.0)).alias("transaction_total"),
        F.avg(total).alias("average_transaction"), F.count_distinct("event_id").alias("events"),
        T.safe_min(F.col("transaction_date_time")).alias("first_transaction"), T.safe_max(F.col("transaction_date_time")).alias("last_transaction"))


def session_summary(r: DataFrame) -> DataFrame:
    flag = lambda c: F.sum(F.when(T.parse_boolean(F.col(c)), 1).otherwise(0))
    s = r.groupBy("ucr_id").agg(F.count("*").alias("session_count"), flag("basket_created").alias("baskets"), flag("basket_converted").alias("conversions"), T.safe_max(F.col("session_date_time_start")).alias("last_session"))
    return s.withColumn("conversion_rate", T.safe_divide(F.col("conversions"), F.col("baskets")))


def marketing_summary(r: DataFrame) -> DataFrame:
    number = lambda c: F.coalesce(F.sum(T.parse_float(F.col(c))), F.lit(0.0)).cast("long")
    return r.groupBy("ucr_id").agg(F.count("*").alias("contact_count"), number("emails_opened_count").alias("opened"), number("links_clicked_count").alias("clicked"), T.safe_max(F.col("last_contact_date")).alias("last_contact"))


def support_summary(r: DataFrame) -> DataFrame:
    state = lambda s: F.sum(F.when(F.lower("ticket_status") == s, 1).otherwise(0))
    return r.groupBy("ucr_id").agg(F.count("*").alias("ticket_count"), state("open").alias("open_tickets"), state("resolved").alias("resolved_tickets"), F.avg(T.parse_hours(F.col("resolution_time_hours_minutes"))).alias("average_hours"))


def interactions(entities: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Star of left joins on ucr_id; counts and sums default to 0, texts to ""."""
    out = reduce(lambda a, b: a.join(b, "ucr_id", "left"), parts, entities.select("ucr_id"))
    return out.na.fill(0).na.fill("")


def by_source(links: DataFrame, systems: tuple[str, ...] = tuple(PRIORITY)) -> DataFrame:
    return links.groupBy("ucr_id").pivot("source_system", list(systems)).count().na.fill(0)
