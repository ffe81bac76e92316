"""Read-only profile lookup over the gold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions import text as T


def search_index(master: DataFrame, *columns: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", *[F.col(c) for c in columns]))
    return master.withColumn("search_text", text).withColumn("search_key", T.normalise_key(text))


def search(index: DataFrame, query: str, status: str | None = None, limit: int = 50) -> DataFrame:
    """Literal or key containment.  A query without letters or digits has an empty
    key, which every row contains, as in the profile page."""
    key = "".join(ch for ch in query.casefold() if ch.isascii() and ch.isalnum())
    hit = F.contains("search_text", F.lit(query.lower())) | F.contains("search_key", F.lit(key))
    found = index.where(hit) if status is None else index.where((F.col("resolution_status") == status) & hit)
    return found.drop("search_text", "search_key").orderBy("ucr_id").limit(limit)


def entity_slice(tables: dict[str, DataFrame], ucr_id: str) -> dict[str, DataFrame]:
    return {n: d.where(F.col("ucr_id") == ucr_id) for n, d in tables.items()}


def display(c: Column) -> Column:
    return F.when(T.strip(c) == "", "Not available").otherwise(c)


def event_history(interactions: DataFrame) -> DataFrame:
    return interactions.where("event_id <> ''").dropDuplicates(["ucr_id", "event_id"])


def overview(master: DataFrame) -> DataFrame:
    return master.groupBy("resolution_status").agg(F.count("*").alias("entities"))


def cluster_map(links: DataFrame) -> DataFrame:
    """ucr_id, dot: one Graphviz graph per entity."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\\\\\"), '"', r'\\\\"'), F.lit('"'))
    line = F.concat(quote(F.col("ucr_id")), F.lit(" -> "), quote(F.concat_ws(" ", "source_system", "source_record_id")), F.lit(";"))
    lines = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return links.groupBy("ucr_id").agg(F.concat(F.lit("digraph entity {\n"), lines, F.lit("\n}")).alias("dot"))


def composition(links: DataFrame) -> DataFrame:
    """Records and entities per source system."""
    return links.groupBy("source_system").agg(F.count("*").alias("records"), F.count_distinct("ucr_id").alias("entities"))


def profile_header(master: DataFrame, ucr_id: str) -> DataFrame:
    """Name, status and confidence of one entity; an absent confidence shows as n/a."""
    labels = {"probabilistically_linked": "Probabilistically linked", "deterministically_linked": "Deterministically linked", "unresolved_singleton": "Single record"}
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("resolution_status")), "resolution_status")
    return master.where(F.col("ucr_id") == ucr_id).select("ucr_id", display(F.col("full_name")).alias("name"), status.alias("status"), T.percent(F.col("cluster_confidence")).alias("confidence"), F.col("cluster_size").alias("records"), "source_systems")


def identity_view(master: DataFrame, ucr_id: str, attributes: tuple[str, ...]) -> DataFrame:
    """One line per attribute, in the order given."""
    lines = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("attribute"), display(F.col(a)).alias("value")) for i, a in enumerate(attributes)]))
    return master.where(F.col("ucr_id") == ucr_id).select(lines.alias("l")).select("l.*").orderBy("ord")


def linked_records(candidates: DataFrame, links: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """One row per record of an entity with the value it offers for each attribute."""
    wide = candidates.groupBy("staging_record_id").pivot("attribute", list(attributes)).agg(F.first("key"))
    return links.select("ucr_id", "staging_record_id", "source_system", "source_record_id").join(wide, "staging_record_id", "left").na.fill("").orderBy("ucr_id", "source_system", "staging_record_id")


def timeline(details: DataFrame, ucr_id: str, system: str | None = None) -> DataFrame:
    """Interactions of one entity, newest first, of one system or of all."""
    rows = details.where((F.col("ucr_id") == ucr_id) & (F.lit(system is None) | (F.col("source_system") == F.lit(system or ""))))
    return rows.select("interaction_date", "source_system", "interaction_type", "interaction_id").orderBy(F.desc("interaction_date"), "interaction_id")
