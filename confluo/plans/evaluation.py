"""Evaluation of a run against protected truth: splits, blocking, calibration, errors."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.functions import similarity as S
from confluo.functions.text import safe_divide
from confluo.operators import evaluate
from confluo.plans.resolution import Resolved, resolve
from confluo.session import cut


def labelled(run: Resolved, truth: DataFrame, share: float = 0.7, seed: int = 42) -> DataFrame:
    """Records with their truth and the split of that identity."""
    split = evaluate.split_hashed(truth, share, seed)
    return run.mapping.join(truth, ["source_system", "source_record_id"]).join(split, "ground_truth_id")


def cluster_truths(records: DataFrame) -> DataFrame:
    """Identities and splits found in each cluster of the exact stage."""
    return records.groupBy(F.col("deterministic_cluster_id").alias("cluster")).agg(F.collect_set("ground_truth_id").alias("truths"), F.collect_set("split").alias("splits"))


def scoped_pairs(pairs: DataFrame, truths: DataFrame) -> DataFrame:
    """Cluster pairs with ``is_true`` (a shared identity) and the scope they count in."""
    side = lambda n: truths.select(F.col("cluster").alias(f"cluster_id_{n}"), F.col("truths").alias(f"t{n}"), F.col("splits").alias(f"s{n}"))
    j = pairs.join(side(1), "cluster_id_1", "left").join(side(2), "cluster_id_2", "left")
    splits = F.array_distinct(F.concat(F.coalesce("s1", F.array().cast("array<string>")), F.coalesce("s2", F.array().cast("array<string>"))))
    return j.withColumns({"is_true": F.coalesce(F.arrays_overlap("t1", "t2"), F.lit(False)), "scope": evaluate.candidate_scope(splits)}).drop("t1", "t2", "s1", "s2")


def error_tables(scored: DataFrame, actual: DataFrame) -> dict[str, DataFrame]:
    return {"false_positives": evaluate.false_links(scored), "false_negatives": evaluate.missed_links(actual, scored)}


def evaluate_run(run: Resolved, truth: DataFrame, precision: float = 0.99, least: int = 10) -> dict[str, DataFrame]:
    """All evaluation tables; ``selected`` is the setting that the calibration split
    chooses, ``by_scope`` says how it does on either split."""
    records = cut(labelled(run, truth), "labelled")
    truths = cut(cluster_truths(records), "truths")
    pair_truth = evaluate.true_pairs(records.select(F.col("deterministic_cluster_id").alias("cluster"), F.col("ground_truth_id").alias("truth")))
    actual = cut(scoped_pairs(pair_truth, truths), "actual")
    enough = S.supported(F.col("strong"), F.col("corroborating"), F.col("supporting"))
    scored = cut(scoped_pairs(run.scored, truths).withColumn("eligible", (F.col("conflict") == "") & enough), "eligible")
    clusters = run.mapping.select("deterministic_cluster_id").distinct().count()
    scopes = ("all", "calibration", "evaluation")
    of = lambda d, s: d if s == "all" else d.where(F.col("scope") == s)
    grids = evaluate.calibration_grid(of(scored, "calibration"))
    selected = evaluate.select_setting(grids, precision, least)
    blocking = [evaluate.blocking_metrics(of(scored, s), of(actual, s), clusters).select(F.lit(s).alias("scope"), "*").withColumn("reduction", F.when(F.lit(s == "all"), F.col("reduction"))) for s in scopes]
    tables = {
        "blocking": blocking[0].unionByName(blocking[1]).unionByName(blocking[2]),
        "calibration": grids,
        "selected": selected,
        "by_scope": relationship_metrics(scored, actual),
        "split_identities": evaluate.split_identities(records.select(F.col("ucr_id").alias("cluster"), F.col("ground_truth_id").alias("truth"))),
        "impure_clusters": evaluate.impure_clusters(records.select(F.col("ucr_id").alias("cluster"), F.col("ground_truth_id").alias("truth"))),
        "edges": edge_precision(run, truth),
    }
    return tables | error_tables(scored, actual)


def relationship_metrics(scored: DataFrame, actual: DataFrame) -> DataFrame:
    """Links of the fuzzy stage per scope: predicted, right, precision, and recall over
    all true pairs, found by blocking or not."""
    p = scored.where("decision = 'automatic'").groupBy("scope").agg(F.count("*").alias("predicted"), F.sum(F.col("is_true").cast("long")).alias("right"))
    a = actual.groupBy("scope").agg(F.count("*").alias("true_pairs"))
    j = a.join(p, "scope", "full").na.fill(0)
    return j.withColumns({"precision": safe_divide(F.col("right"), F.col("predicted")), "recall": safe_divide(F.col("right"), F.col("true_pairs"))})


def edge_precision(run: Resolved, truth: DataFrame) -> DataFrame:
    """Per exact rule: merges made and how many joined records of one identity."""
    known = run.silver.select("staging_record_id", "source_system", "source_record_id").join(truth, ["source_system", "source_record_id"])
    side = lambda n: known.select(F.col("staging_record_id").alias(n), F.col("ground_truth_id").alias(f"{n}_truth"))
    e = run.exact_decisions.where("accepted").join(side("left"), "left").join(side("right"), "right")
    right = F.sum((F.col("left_truth") == F.col("right_truth")).cast("long"))
    return e.groupBy("rule").agg(F.count("*").alias("merges"), right.alias("right")).withColumn("precision", safe_divide(F.col("right"), F.col("merges")))


def resimulate(run: Resolved, automatic: float, coverage: float) -> Resolved:
    """The run again at another setting of the fuzzy stage."""
    return resolve(run.silver, replace(run.settings, automatic=automatic, coverage=coverage))
