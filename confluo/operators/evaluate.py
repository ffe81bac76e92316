"""Linkage quality against protected truth."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.functions.text import safe_divide

THRESHOLDS = tuple(round(0.80 + 0.01 * i, 2) for i in range(19))
COVERAGES = tuple(round(0.40 + 0.05 * i, 2) for i in range(9))


def harmonic(p: Column, r: Column) -> Column:
    return safe_divide(2 * p * r, p + r)


def pair_count(n: Column) -> Column:
    return n * (n - 1) / 2


def split_exact(spark: SparkSession, ids: list[str], share: float = 0.7, seed: int = 42) -> DataFrame:
    """The published split: sorted ids shuffled by Python's generator.  Driver-side, so
    for evaluation populations that fit there; ``split_hashed`` is for any size."""
    ids = sorted(ids)
    random.Random(seed).shuffle(ids)
    cut = round(share * len(ids))
    return spark.createDataFrame([(x, "calibration" if i < cut else "evaluation") for i, x in enumerate(ids)], "ground_truth_id string, split string")


def split_hashed(truth: DataFrame, share: float = 0.7, seed: int = 42) -> DataFrame:
    u = F.pmod(F.xxhash64(F.lit(seed), "ground_truth_id"), F.lit(1_000_000)) / 1_000_000
    return truth.select("ground_truth_id").distinct().withColumn("split", F.when(u < share, "calibration").otherwise("evaluation"))


def candidate_scope(splits: Column) -> Column:
    return F.when(F.array_contains(splits, "evaluation"), "evaluation").when(F.size(splits) > 0, "calibration").otherwise("anonymous_only")


def contingency(mapping: DataFrame) -> DataFrame:
    """mapping: cluster, truth -> cluster, truth, n."""
    return mapping.groupBy("cluster", "truth").agg(F.count("*").alias("n"))


def cluster_metrics(mapping: DataFrame) -> DataFrame:
    """One row: pairwise and B-cubed precision, recall and F1, purity, split
    identities and impure clusters, all from the contingency table."""
    t = contingency(mapping)
    c, g = t.groupBy("cluster").agg(F.sum("n").alias("c"), F.count("*").alias("kinds"), F.max("n").alias("top")), t.groupBy("truth").agg(F.sum("n").alias("g"), F.count("*").alias("parts"))
    cells = t.join(c, "cluster").join(g, "truth").agg(
        F.sum(pair_count(F.col("n"))).alias("tp"), F.sum("n").alias("records"),
        F.sum(F.col("n") * F.col("n") / F.col("c")).alias("bp"), F.sum(F.col("n") * F.col("n") / F.col("g")).alias("br"))
    per_c = c.agg(F.sum(pair_count(F.col("c"))).alias("predicted"), F.count("*").alias("clusters"), F.sum("top").alias("pure"), F.sum(F.when(F.col("kinds") > 1, 1).otherwise(0)).alias("impure_clusters"))
    per_g = g.agg(F.sum(pair_count(F.col("g"))).alias("actual"), F.count("*").alias("identities"), F.sum(F.when(F.col("parts") > 1, 1).otherwise(0)).alias("split_identities"))
    m = cells.join(per_c).join(per_g)  # three single rows
    p, r = safe_divide(F.col("tp"), F.col("predicted")), safe_divide(F.col("tp"), F.col("actual"))
    bp, br = F.col("bp") / F.col("records"), F.col("br") / F.col("records")
    return m.select("records", "clusters", "identities", p.alias("precision"), r.alias("recall"), harmonic(p, r).alias("f1"), bp.alias("b3_precision"), br.alias("b3_recall"), harmonic(bp, br).alias("b3_f1"), (F.col("pure") / F.col("records")).alias("purity"), "split_identities", "impure_clusters")


def true_pairs(clusters: DataFrame) -> DataFrame:
    """Pairs of clusters that share an identity.  clusters: cluster, truth."""
    t = contingency(clusters).select("cluster", "truth")
    return t.withColumnRenamed("cluster", "cluster_id_1").join(t.withColumnRenamed("cluster", "cluster_id_2"), "truth").where("cluster_id_1 < cluster_id_2").select("cluster_id_1", "cluster_id_2").distinct()


def blocking_counts(candidates: DataFrame, clusters: DataFrame) -> DataFrame:
    """True, found and candidate pairs in one row, as ``blocking_metrics`` counts them
    over ``true_pairs(clusters)``, without making the true pairs.  Clusters with the same
    identities count together; only different sets of identities that share one meet."""
    known = contingency(clusters.where("cluster is not null and truth is not null")).groupBy("cluster").agg(F.array_sort(F.collect_set("truth")).alias("truths"))
    sets = known.groupBy("truths").agg(F.count("*").alias("n"))
    parts = sets.select("truths", "n", F.explode("truths").alias("truth"))
    across = parts.join(parts.toDF("others", "m", "truth"), "truth").where("truths < others").select("truths", "others", "n", "m").distinct()
    pairs = sets.select(F.expr("n * (n - 1) div 2").alias("pairs")).unionAll(across.select(F.expr("n * m")))
    total = pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0).cast("long")).alias("true_pairs"))
    side = lambda n: known.select(F.col("cluster").alias(f"cluster_id_{n}"), F.col("truths").alias(f"t{n}"))
    checked = candidates.select("cluster_id_1", "cluster_id_2").join(side(1), "cluster_id_1", "left").join(side(2), "cluster_id_2", "left")
    made = checked.agg(F.count(F.when(F.arrays_overlap("t1", "t2"), 1)).alias("found"), F.count("*").alias("candidate_pairs"))
    return total.join(made).select("true_pairs", "found", "candidate_pairs")  # two single rows


def blocking_metrics(candidates: DataFrame, actual: DataFrame, clusters: int | Column) -> DataFrame:
    """Blocking recall and reduction ratio."""
    ids = ["cluster_id_1", "cluster_id_2"]
    found = actual.join(candidates.select(*ids), ids, "left_semi").agg(F.count("*").alias("found"))
    total = actual.agg(F.count("*").alias("true_pairs"))
    made = candidates.agg(F.count("*").alias("candidate_pairs"))
    possible = F.lit(clusters) * (F.lit(clusters) - 1) / 2 if isinstance(clusters, int) else clusters
    return found.join(total).join(made).select("true_pairs", "found", "candidate_pairs", safe_divide(F.col("found"), F.col("true_pairs")).alias("recall"), (1 - safe_divide(F.col("candidate_pairs"), possible)).alias("reduction"))


def calibration_grid(scored: DataFrame, thresholds=THRESHOLDS, coverages=COVERAGES) -> DataFrame:
    """scored: score, coverage, eligible, is_true.  One pass: each pair meets the fixed
    grid in an exploded literal, and conditional sums do the rest."""
    grid = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(c).alias("least_coverage")) for t in thresholds for c in coverages]))
    hit = F.col("eligible") & (F.col("score") >= F.col("g.threshold")) & (F.col("coverage") >= F.col("g.least_coverage"))
    g = scored.withColumn("g", grid).withColumn("hit", hit).groupBy("g.threshold", "g.least_coverage").agg(
        F.sum(F.when(F.col("hit"), 1).otherwise(0)).alias("predicted"), F.sum(F.when(F.col("hit") & F.col("is_true"), 1).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("is_true"), 1).otherwise(0)).alias("actual"))
    p, r = safe_divide(F.col("tp"), F.col("predicted")), safe_divide(F.col("tp"), F.col("actual"))
    return g.select("threshold", "least_coverage", "predicted", "tp", p.alias("precision"), r.alias("recall"), harmonic(p, r).alias("f1"))


def select_setting(grid: DataFrame, precision: float = 0.99, least: int = 10) -> DataFrame:
    """The setting of most recall that meets the precision, else the most precise."""
    ok = (F.col("precision") >= precision) & (F.col("predicted") >= least)
    order = [F.desc(ok), F.desc(F.when(ok, F.col("recall")).otherwise(F.col("precision")))]
    return grid.orderBy(*order, F.desc("precision"), F.desc("recall"), F.desc("f1"), F.desc("predicted"), F.desc("least_coverage"), F.desc("threshold")).limit(1)


def false_links(scored: DataFrame) -> DataFrame:
    return scored.where("decision = 'automatic' and not is_true")


def missed_links(actual: DataFrame, scored: DataFrame) -> DataFrame:
    """True pairs that were not linked, with the first reason that holds."""
    ids = ["cluster_id_1", "cluster_id_2"]
    j = actual.join(scored.select(*ids, "decision", "conflict", F.lit(True).alias("blocked")), ids, "left").where("decision is null or decision <> 'automatic'")
    return j.withColumn("reason", F.when(F.col("blocked").isNull(), "not blocked").when(F.col("conflict") != "", F.col("conflict")).when(F.col("decision") == "review", "left for review").otherwise("below threshold"))


def split_identities(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("truth").agg(F.count_distinct("cluster").alias("clusters")).where("clusters > 1")


def impure_clusters(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("cluster").agg(F.count_distinct("truth").alias("identities")).where("identities > 1")
