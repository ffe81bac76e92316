"""Operator 1, mixing sources to target weights: Pareto order sampling.

Targets: the sources share all words by weight; a target stops at ``MAX_COPIES``
times its source, and what is cut off is shared again by weight.  Within a source a
document should be taken e = min(3, c a) times, where a is the square root of its
size (so longer documents are likelier, less than in proportion) and c makes the
expected words meet the target.  The whole part of e is certain.  Its fraction p is
an inclusion probability: documents are ranked by u/(1-u) divided by p/(1-p), u a
uniform number from a hash of the row, and the first in rank are taken until the
words come closest to the target.

The rank is a 48-bit integer.  The rank to stop at is found by four passes of
pre-aggregated histograms, each splitting one bucket of each source further, so no
task sorts or holds a source.  What the passes carry is one row per source; the
histograms have at most 4,096 rows per source.

Defined cases: null sources are one source, sorted last; a null or empty text has
size 0 and takes no words; a null id is hashed like a value; repeated rows share one
rank and are taken together; extra columns stay; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm import common

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
BITS, STEP = 48, 12
ADDED = ("size", "source_size", "target", "copies", "taken")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of a digest of the row."""
    row = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(row.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sizes (source, source_size): adds ``target``.  Sources sorted by their least
    cap per weight are capped as long as the rest, sharing by weight, exceeds them."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), place + 1)
    by_cap = Window.orderBy("reach", "source").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("reach", "source").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("reach", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(MAX_COPIES)))
    s = s.withColumn("reach", F.col("cap") / F.col("weight"))
    s = s.withColumn("rate", (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source whose reach is at least the common rate ends the capped ones
    s = s.withColumn("rate", F.min(F.when(F.col("reach") >= F.col("rate"), F.struct("reach", "source", "rate"))).over(everything)["rate"])
    return s.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("rate")).alias("target"))


def _rates(grouped: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, rate, rest): the c of each source, and the words that its certain
    copies leave to be sampled.  grouped: (source, size, n), one row per size."""
    a = F.sqrt(F.col("size").cast("double"))
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    words = (F.col("n") * F.col("size")).cast("double")
    g = grouped.where("size > 0").join(goal, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    g = g.withColumn("above", F.coalesce(F.sum(words).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) * MAX_COPIES)
    g = g.withColumn("below", F.sum(words * a).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    g = g.withColumn("c", (F.col("target") - F.col("above")) / F.col("below"))
    # the longest size that is not capped decides; if every size is, all copies are certain
    fits = F.min(F.when(F.col("c") * a <= MAX_COPIES, F.struct(-F.col("size"), "c"))).over(Window.partitionBy("source"))["c"]
    g = g.withColumn("rate", F.greatest(F.coalesce(fits, F.lit(float("inf"))), F.lit(0.0)))
    certain = F.floor(F.least(F.lit(float(MAX_COPIES)), F.col("rate") * a)).cast("double") * words
    return g.groupBy("source").agg(F.first("rate").alias("rate"), (F.first("target") - F.sum(certain)).alias("rest"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds whole (certain copies) and key (48-bit rank; null: never sampled)."""
    e = F.least(F.lit(float(MAX_COPIES)), F.col("rate") * F.sqrt(F.col("size").cast("double")))
    out = rows.withColumn("e", F.when(F.col("size") > 0, e).otherwise(0.0)).withColumn("whole", F.floor("e").cast("long"))
    out = out.withColumn("p", F.col("e") - F.col("whole"))
    odds = F.col("u") * (1 - F.col("p"))
    key = F.floor(odds / (odds + (1 - F.col("u")) * F.col("p")) * float(1 << BITS)).cast("long")
    return out.withColumn("key", F.when(F.col("p") > 0, key)).drop("e", "p")


def _cutoffs(keyed: DataFrame, rates: DataFrame) -> DataFrame:
    """(source, cut): the last rank taken, by splitting the bucket in which the words
    still wanted run out, ``STEP`` bits at a time."""
    state = common.materialise(rates.select("source", F.col("rest").alias("wanted"), F.lit(0).cast("long").alias("prefix")), "cut")
    for level in range(BITS // STEP - 1, -1, -1):
        shift = level * STEP
        s = state.withColumnRenamed("source", "s_source")
        inside = keyed.where("key is not null").join(s, F.col("source").eqNullSafe(F.col("s_source")) & (F.shiftright("key", shift + STEP) == F.col("prefix")))
        bins = inside.groupBy("source", "prefix", "wanted", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").cast("double").alias("words"))
        through = Window.partitionBy("source").orderBy("bin")
        bins = bins.withColumn("through", F.sum("words").over(through))
        last = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("bin")))
        # the first bucket that reaches what is wanted, else the last there is
        reached = bins.withColumn("last", last).where("through >= wanted or last = 1")
        found = reached.groupBy("source").agg(F.min(F.struct("bin", "through", "words", "wanted")).alias("b"))
        left = F.col("b.wanted") - (F.col("b.through") - F.col("b.words"))
        prefix = F.col("b.bin")
        if level == 0:  # take the last rank only if that comes closer
            prefix = F.when(F.col("b.words") - left <= left, prefix).otherwise(prefix - 1)
        state = common.materialise(found.select("source", left.alias("wanted"), prefix.alias("prefix")), "cut")
    return state.select("source", F.col("prefix").alias("cut"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 1) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target, copies and
    taken (copies times size), which replace columns of the same name."""
    found, own = _mixed(docs, weights, seed)
    return found.select(*[F.col(k).alias(c) for c, k in own.items() if c not in ADDED], *ADDED)


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 1) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all their columns."""
    found, own = _mixed(docs, weights, seed)
    again = found.where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return again.select(*[F.col(k).alias(c) for c, k in own.items()])


def _mixed(docs: DataFrame, weights: tuple[float, ...], seed: int) -> tuple[DataFrame, dict[str, str]]:
    """The mix, and the names that the columns of ``docs`` have in it."""
    own = {c: c if c in ("doc_id", "text", "source") else f"_own{i}" for i, c in enumerate(docs.columns)}
    docs = docs.toDF(*own.values())
    kept = docs.columns
    small = docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"))
    small = common.materialise(small, "sizes")
    grouped = common.materialise(small.groupBy("source", "size").agg(F.count("*").alias("n")), "grouped")
    goal = targets(grouped.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights)
    goal = common.materialise(goal, "targets")
    rates = common.materialise(_rates(grouped, goal.select(F.col("source").alias("g_source"), "target")), "rates")
    r = rates.select(F.col("source").alias("r_source"), "rate")
    keyed = _keyed(small.join(r, F.col("source").eqNullSafe(F.col("r_source")), "left").drop("r_source"))
    cuts = _cutoffs(keyed, rates)
    plan = goal.join(rates, goal["source"].eqNullSafe(rates["source"]), "left").join(cuts, goal["source"].eqNullSafe(cuts["source"]), "left")
    plan = common.materialise(plan.select(goal["source"].alias("p_source"), "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce("cut", F.lit(-1)).alias("cut")), "plan")
    full = docs.select(*kept).withColumn("size", word_count(F.col("text"))).withColumn("u", uniform(F.col("doc_id"), F.col("text"), seed))
    full = _keyed(full.join(plan, F.col("source").cast("string").eqNullSafe(F.col("p_source"))))
    copies = F.col("whole") + F.when(F.col("key") <= F.col("cut"), 1).otherwise(0)
    return full.withColumn("copies", copies).select(*kept, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")), own


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (CAST(CAST('0x' || substr(md5(concat_ws('|', '1', coalesce(CAST(doc_id AS VARCHAR), 'null'), md5(coalesce(text, '')))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight,
    sum(size) * 3.0::DOUBLE AS cap FROM d GROUP BY source
), r AS (
  SELECT *, ((sum(source_size::DOUBLE) OVER ()) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM s
), t AS (
  SELECT source, source_size, least(cap, weight * (SELECT rate FROM r WHERE cap / weight >= rate ORDER BY cap / weight, source LIMIT 1)) AS target FROM r
), g AS (
  SELECT d.source, d.size, count(*) AS n FROM d WHERE d.size > 0 GROUP BY ALL
), c AS (
  SELECT g.source, g.size, (any_value(t.target) - coalesce(sum((n * g.size)::DOUBLE) OVER (PARTITION BY g.source ORDER BY g.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3)
    / sum((n * g.size)::DOUBLE * sqrt(g.size::DOUBLE)) OVER (PARTITION BY g.source ORDER BY g.size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c
  FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source GROUP BY g.source, g.size, g.n
), rt AS (
  SELECT source, greatest(arg_max(c, size) FILTER (WHERE c * sqrt(size::DOUBLE) <= 3), 0) AS rate FROM c GROUP BY source
), e AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN size > 0 THEN least(3.0, coalesce(rt.rate, 'inf'::DOUBLE) * sqrt(size::DOUBLE)) ELSE 0 END AS e
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN rt ON d.source IS NOT DISTINCT FROM rt.source
), k AS (
  SELECT *, floor(e) AS whole, e - floor(e) AS p FROM e
), q AS (
  SELECT *, CASE WHEN p > 0 THEN floor(u * (1 - p) / (u * (1 - p) + (1 - u) * p) * 281474976710656.0) END AS key,
    target - sum(whole * size) OVER (PARTITION BY source) AS wanted FROM k
), x AS (
  SELECT *, sum(size) FILTER (WHERE key IS NOT NULL) OVER (PARTITION BY source ORDER BY key NULLS LAST) AS through,
    sum(size) FILTER (WHERE key IS NOT NULL) OVER (PARTITION BY source, key) AS words FROM q
), y AS (
  SELECT *, (whole + CASE WHEN key IS NULL THEN 0 WHEN through <= wanted THEN 1 WHEN through - words >= wanted THEN 0
    WHEN words - (wanted - (through - words)) <= wanted - (through - words) THEN 1 ELSE 0 END)::BIGINT AS copies FROM x
)
SELECT doc_id, source, size::BIGINT AS size, source_size::BIGINT AS source_size, target::DOUBLE AS target, copies, copies * size AS taken FROM y
"""
