"""The whole run: raw systems to silver, linked entities, golden records, evaluation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.functions import text as T
from confluo.operators import entities, evaluate, gold, linking
from confluo.operators.standardise import consolidate, standardise
from confluo.session import cut
from confluo.sources import fixtures, population, systems

# The date each system ranks its records by.
RANK_DATES = {"CRM": "record_created_date", "ECOMMERCE": "transaction_date_time", "MARKETING": "last_contact_date", "ONLINE": "session_date_time_start", "SUPPORT": "support_ticket_created_date_time"}
DETAIL_IDS = {"CRM": "crm_customer_id", "ECOMMERCE": "transaction_id", "MARKETING": "marketing_contact_id", "ONLINE": "session_id", "SUPPORT": "support_ticket_id"}
KINDS = {"CRM": "Profile", "ECOMMERCE": "Purchase", "MARKETING": "Marketing contact", "ONLINE": "Online session", "SUPPORT": "Support ticket"}


@dataclass(frozen=True)
class Settings:
    """Thresholds of the fuzzy stage; the defaults are the frozen setting."""

    automatic: float = 0.91
    review: float = 0.70
    coverage: float = 0.55
    block_cap: int = linking.BLOCK_CAP


EXPERIMENTAL = Settings(automatic=0.85, coverage=0.50)


@dataclass
class Resolved:
    """Tables of a run; ``mapping`` has one row for every eligible record."""

    silver: DataFrame
    mapping: DataFrame
    clusters: DataFrame
    exact_decisions: DataFrame
    scored: DataFrame
    anonymous: DataFrame
    settings: Settings = field(default_factory=Settings)


def generated(spark: SparkSession, customers: int = 400, events: int = 4, sessions: int = 1_000, tickets: int = 120, contacts: int = 360) -> dict[str, DataFrame]:
    """All systems of one population, with truth columns still in them."""
    people = fixtures.customers(spark, customers)
    crm = cut(fixtures.crm(people), "crm")
    sales = cut(population.shop(people, crm, fixtures.events(spark, events)), "sales")
    rest = {
        "MARKETING": population.marketing(people, crm, contacts),
        "ONLINE": population.online(people, crm, sales, sessions),
        "SUPPORT": population.support(people, crm, tickets),
    }
    return {"CRM": crm, "ECOMMERCE": sales, **{n: cut(d, n.lower()) for n, d in rest.items()}}


def silver(raw: dict[str, DataFrame]) -> DataFrame:
    """Bronze and silver of every system, in union order, with staging ids."""
    known = [s for s in systems.SOURCES if s.system in raw]
    as_text = lambda d: d.select(*[F.col(c).cast("string").alias(c) for c in d.columns]).na.fill("")
    parts = [standardise(systems.ingest(as_text(population.operational(raw[s.system])), s), s) for s in known]
    return cut(consolidate(parts), "silver")


def resolve(all_: DataFrame, settings: Settings = Settings()) -> Resolved:
    """Exact rules, then the fuzzy stage between their clusters, then stable ids.
    Anonymous sessions take part in neither and get no entity."""
    anonymous = linking.anonymous()
    eligible = cut(all_.where(~anonymous), "eligible")
    nodes = eligible.select(F.col("staging_record_id").alias("id"), F.array(F.coalesce("portal_user_id", F.lit(""))).alias("portal"), F.array(F.coalesce("date_of_birth_normalised", F.lit(""))).alias("dob"))
    exact, decisions = linking.constrained_clusters(nodes, linking.exact_edges(eligible))
    exact, decisions = cut(exact.toDF("staging_record_id", "cluster"), "exact"), cut(decisions, "decisions")
    clustered = cut(eligible.join(exact, "staging_record_id"), "clustered")
    of = lambda side: exact.select(F.col("staging_record_id").alias(side), F.col("cluster").alias(f"{side}_cluster"))
    refused = decisions.where("not accepted").join(of("left"), "left").join(of("right"), "right")
    refused = refused.where("left_cluster <> right_cluster").select(F.col("left_cluster").alias("left"), F.col("right_cluster").alias("right")).distinct()
    s = settings
    merged, scored = linking.probabilistic(clustered, refused, s.automatic, s.review, s.coverage, s.block_cap)
    merged = cut(merged, "merged")
    parts = merged.groupBy("merged").agg(F.count("*").alias("deterministic_cluster_count"))
    found = clustered.select("staging_record_id", "source_system", "source_record_id", F.col("cluster").alias("deterministic_cluster_id")).join(merged.withColumnRenamed("cluster", "deterministic_cluster_id"), "deterministic_cluster_id")
    found = entities.stable_ids(cut(found.withColumnRenamed("merged", "cluster"), "found"))
    # The confidence of an entity joined by the fuzzy stage is the least score of a merge.
    edges = scored.where("merge_performed").join(merged.withColumnRenamed("cluster", "cluster_id_1"), "cluster_id_1").select("merged", "score")
    clusters = found.groupBy("ucr_id", "cluster").agg(
        F.count("*").alias("cluster_size"), F.count_distinct("source_system").alias("source_system_count"), T.joined_list(F.col("source_system")).alias("source_systems"), F.min("staging_record_id").alias("first_record"))
    clusters = clusters.join(parts.withColumnRenamed("merged", "cluster"), "cluster").join(entities.confidence(edges).withColumnRenamed("merged", "cluster"), "cluster", "left")
    fuzzy = F.col("deterministic_cluster_count") > 1
    clusters = clusters.select(
        "ucr_id", "cluster_size", "deterministic_cluster_count", "source_system_count", "source_systems", "first_record",
        F.when(fuzzy, "probabilistically_linked").when(F.col("cluster_size") > 1, "deterministically_linked").otherwise("unresolved_singleton").alias("resolution_status"),
        F.when(fuzzy, "probabilistic").when(F.col("cluster_size") > 1, "deterministic").otherwise("").alias("match_method"),
        F.when(fuzzy, F.col("confidence")).when(F.col("cluster_size") > 1, 1.0).alias("cluster_confidence"),
        F.when(fuzzy, "minimum accepted score").when(F.col("cluster_size") > 1, "exact rule").otherwise("").alias("cluster_confidence_type"))
    return Resolved(all_, cut(found.drop("cluster"), "mapping"), cut(clusters, "clusters"), decisions, scored, all_.where(anonymous), settings)


def links(run: Resolved) -> DataFrame:
    """Every record of an entity with its silver columns."""
    return run.mapping.select("staging_record_id", "ucr_id").join(run.silver, "staging_record_id")


# Selections of the golden record: key, completeness and the values that come from the
# winning record.  A name comes whole from one record, and so does an address.
def _selections(linked: DataFrame) -> tuple[list[Column], Column]:
    first, last = T.name_parts(F.col("full_name_raw"))
    has = lambda c: F.when(T.strip(c) != "", 1).otherwise(0)
    have = lambda c: F.col(c) if c in linked.columns else F.lit("")
    first = F.when(T.strip(F.col("first_name_raw")) != "", F.col("first_name_raw")).otherwise(first)
    last = F.when(T.strip(F.col("surname_raw")) != "", F.col("surname_raw")).otherwise(last)
    crm = lambda c: F.when(F.col("source_system") == "CRM", have(c)).otherwise("")

    def entry(name: str, key: Column, completeness: Column, **values: Column) -> Column:
        return F.struct(
            F.lit(name).alias("attribute"), F.coalesce(key, F.lit("")).alias("key"), completeness.alias("completeness"),
            F.create_map(*[x for k, v in values.items() for x in (F.lit(k), T.strip(v))]).alias("values"))

    none = F.lit(0)
    return [
        entry("name", T.normalise_key(F.concat(first, last)), has(first) + has(last), first_name=first, surname=last, full_name=T.combine_names(first, last)),
        entry("date_of_birth", F.col("date_of_birth_normalised"), none, date_of_birth=F.col("date_of_birth_normalised")),
        entry("primary_email", F.col("email_normalised"), none, primary_email=F.col("email_raw")),
        entry("telephone_number", F.col("phone_normalised"), none, telephone_number=F.col("phone_raw")),
        entry("address", F.col("address_normalised"), has(F.col("address_raw")) + has(F.col("postcode_raw")), address=F.col("address_raw"), postcode=F.col("postcode_raw")),
        entry("preferred_contact_channel", T.normalise_key(crm("preferred_contact_channel")), none, preferred_contact_channel=crm("preferred_contact_channel")),
    ], entry("registration_date", crm("record_created_date"), none, registration_date=crm("record_created_date"))


def golden(run: Resolved) -> dict[str, DataFrame]:
    """master, provenance and attribute_candidates: seven selections per entity give
    ten attributes, each with the record it came from."""
    linked = links(run)
    dates = {s: c for s, c in RANK_DATES.items() if c in linked.columns}
    linked = linked.withColumns({"priority": gold.case_of("source_system", gold.PRIORITY, 9), "rank_date": gold.rank_date(dates)})
    voted, earliest = _selections(linked)
    keep = ["ucr_id", "staging_record_id", "source_system", "priority", "rank_date"]
    long = cut(linked.select(*keep, F.explode(F.array(*voted, earliest)).alias("e")).select(*keep, "e.*").where(T.strip(F.col("key")) != ""), "candidates")
    chosen = gold.survivors(long.where("attribute <> 'registration_date'")).unionByName(gold.survivors(long.where("attribute = 'registration_date'"), earliest=True))
    chosen = cut(chosen, "chosen")
    # A blank value of a winner, such as its postcode, counts as no candidate at all.
    wide = chosen.select("ucr_id", "staging_record_id", "source_system", "candidate_count", "distinct_count", F.explode("values").alias("attribute", "value")).where("value <> ''")
    proof = gold.provenance(wide, run.clusters)
    rows = gold.master(wide, run.clusters)
    filled = sum((F.when(F.col(a) != "", 1).otherwise(0) for a in gold.ATTRIBUTES), F.lit(0))
    rows = rows.withColumn("identity_attributes_populated", filled).withColumn("identity_attribute_completeness", F.round(F.col("identity_attributes_populated") / len(gold.ATTRIBUTES), 4))
    return {"master": run.clusters.drop("first_record").join(rows, "ucr_id"), "provenance": proof, "attribute_candidates": gold.attribute_candidates(long.drop("values"), chosen)}


def interaction_details(run: Resolved) -> DataFrame:
    """One row per record: what it is, its id and date, and the system's own columns."""
    linked = links(run)
    own = [c for c in linked.columns if c not in systems.COMMON and c not in ("staging_record_id", "ucr_id")]
    ids = gold.case_of("source_system", {s: F.col(c) for s, c in DETAIL_IDS.items() if c in linked.columns})
    dates = gold.rank_date({s: c for s, c in RANK_DATES.items() if c in linked.columns})
    return linked.select(
        "ucr_id", "staging_record_id", "source_system", "source_record_id", gold.case_of("source_system", KINDS).alias("interaction_type"),
        F.coalesce(T.blank_to_null(ids), "source_record_id").alias("interaction_id"), dates.alias("interaction_date"), *own)


def interaction_summary(run: Resolved, details: DataFrame) -> DataFrame:
    """Star of the four activity systems, source counts, consent, first and last dates."""
    of = lambda s: details.where(F.col("source_system") == s)
    parts = [gold.by_source(details)]
    if "transaction_total" in details.columns:
        parts.append(gold.shop_summary(of("ECOMMERCE")))
    if "basket_created" in details.columns:
        parts.append(gold.session_summary(of("ONLINE")))
    if "consent_status" in details.columns:
        parts.append(gold.marketing_summary(of("MARKETING")))
        consent = gold.latest(of("MARKETING"), "ucr_id", F.desc("last_contact_date"), F.desc("staging_record_id"))
        parts.append(consent.select("ucr_id", F.col("consent_status").alias("latest_consent")))
    if "ticket_status" in details.columns:
        parts.append(gold.support_summary(of("SUPPORT")))
    active = details.where("source_system <> 'CRM'").groupBy("ucr_id").agg(T.safe_min(F.col("interaction_date")).alias("first_activity"), T.safe_max(F.col("interaction_date")).alias("last_activity"))
    return gold.interactions(run.clusters, [*parts, active])


def stage_quality(run: Resolved, truth: DataFrame) -> DataFrame:
    """Cluster metrics after the exact stage and after the fuzzy one, over eligible
    records with a truth entry.  truth: source_system, source_record_id, ground_truth_id."""
    m = run.mapping.join(truth, ["source_system", "source_record_id"])
    stages = {"deterministic": "deterministic_cluster_id", "final": "ucr_id"}
    out = [evaluate.cluster_metrics(m.select(F.col(c).alias("cluster"), F.col("ground_truth_id").alias("truth"))).select(F.lit(s).alias("stage"), "*") for s, c in stages.items()]
    return out[0].unionByName(out[1])
