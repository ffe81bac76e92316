"""Operator 6, secret scans: patterns plus two character Markov models.

Three fixed patterns give the base spans.  They are cut out of the candidate runs, and
each piece left that is long enough is scored by the log-likelihood ratio, per character, of a Markov model of random strings against
one of ordinary identifiers.  Both are trained on labelled samples: the strings that
the base patterns match are random, the words around them are ordinary.  At most
``SAMPLE`` different documents with a base match, first by hash of their id, train the
models: their ids are chosen first, and only their texts move.  The scan itself covers
every whole text.  All of it is DataFrame expressions.

Defined cases: a null or empty text has no spans; a null id stays null; repeated rows
are scanned row by row; without any base match in the table the models are equal and
add nothing; extra columns are ignored; an empty table gives no rows.  Positions are
code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm import common

# The base kinds in their order, their patterns, the group whose length
# counts and the least length of it.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: What a text must match before a pattern with a least length is worth running.
_FIRST = {"access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
IDENTIFIER = r"[A-Za-z0-9_]{4,}"
LEAST = 20
SAMPLE = 1000
#: Least log-likelihood ratio per step, in nats.
THRESHOLD = 0.3
#: Share of the uniform distribution in each model.
RANDOM_FLOOR, IDENTIFIER_FLOOR = 0.4, 0.02
_SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _found(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of the matches whose counted group is long enough, in order.  Matches
    and the stretches between them interleave, so running lengths are positions."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    lengths = F.transform(F.arrays_zip(matches.alias("m"), counted.alias("c")), lambda x: F.struct(F.length(x["m"]).alias("n"), F.length(x["c"]).alias("c")))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), _none().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.get(between, acc["i"])
        span = F.struct(at.alias("start"), F.lit(order).alias("ord"), (at + x["n"]).alias("end"), F.lit(kind).alias("kind"))
        return F.struct((acc["i"] + 1).alias("i"), (at + x["n"]).alias("at"), F.when(x["c"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(lengths, start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    parts = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        # at least, not exactly: shorter matches are dropped above, as they still consume text
        worth = text.rlike(_FIRST[kind]) if kind in _FIRST else (F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & text.rlike(pattern)
        worth = F.contains(text, F.lit("AKIA")) & worth if kind == "access" else worth
        if group == 0:
            pattern = {"access": rf"AKIA[A-Z0-9]{{{least - 4},}}", "hex": rf"[0-9a-f]{{{least},}}"}[kind]
        parts.append(F.when(worth, _found(text, order, kind, pattern, group, least)).otherwise(_none()))
    return F.array_sort(F.concat(*parts))


def _piece(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def _bigrams(strings: DataFrame) -> DataFrame:
    """strings (s): counts of neighbouring characters of the alphabet."""
    at = strings.where(F.length("s") > 1).select("s", F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i"))
    pair = at.select(F.expr("substring(s, i, 1)").alias("a"), F.expr("substring(s, i + 1, 1)").alias("b"))
    inside = lambda c: F.instr(F.lit(ALPHABET), F.col(c)) > 0
    return pair.where(inside("a") & inside("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def train(docs: DataFrame, sample: int = SAMPLE) -> list[float] | None:
    """Log-likelihood ratios of each character after each, row by row of ALPHABET;
    None without a labelled sample.  What reaches the driver is at most one row for
    each pair of characters and model."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("print", F.xxhash64("text"))
    matching = keyed.where(F.size(base_spans(F.col("text"))) > 0).select("doc_id", "print").distinct()
    ids = common.materialise(matching.orderBy(F.xxhash64("doc_id"), "doc_id", "print").limit(sample).toDF("_id", "_print"), "labelled-ids")
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print"))
    # at most ``sample`` short rows; texts are fetched where they lie, repeated rows once
    fetched = keyed.join(F.broadcast(ids), own).groupBy("doc_id", "print").agg(F.first("text").alias("text"))
    chosen = common.materialise(fetched.withColumn("base", base_spans(F.col("text"))), "labelled")
    secret = F.explode(F.transform("base", lambda x: F.regexp_extract(_piece(F.col("text"), x), r"([A-Za-z0-9+/_=-]+)[^A-Za-z0-9+/_=-]*$", 1)))
    cleaned = F.col("text")
    for _, pattern, _, least in BASE:
        cleaned = F.regexp_replace(cleaned, pattern.replace("[0-9a-f]+", f"[0-9a-f]{{{least},}}"), " ")
    ordinary = F.explode(F.regexp_extract_all(cleaned, F.lit(IDENTIFIER), F.lit(0)))
    size, models = len(ALPHABET), []
    for strings, floor in ((secret, RANDOM_FLOOR), (ordinary, IDENTIFIER_FLOOR)):
        count = {(r["a"], r["b"]): r["n"] for r in _bigrams(chosen.select(strings.alias("s"))).collect()}
        if not count:
            return None
        rows = {a: sum(count.get((a, b), 0) for b in ALPHABET) for a in ALPHABET}
        models.append([math.log((1 - floor) * (count.get((a, b), 0) + 1 / size) / (rows[a] + 1) + floor / size) for a in ALPHABET for b in ALPHABET])
    return [r - o for r, o in zip(*models)]


def markov_spans(text: Column, base: Column, ratios: list[float] | None, threshold: float = THRESHOLD) -> Column:
    """Pieces of candidate runs outside the base spans whose mean ratio reaches the
    threshold; ``base`` is sorted."""
    if ratios is None:
        return _none()
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")
    place = F.split(F.lit(",".join(str(ALPHABET.find(chr(c))) for c in range(128))), ",").cast("array<int>")
    size = len(ALPHABET)

    def mean_ratio(run: Column) -> Column:
        codes = F.transform(F.split(run, ""), lambda c: F.get(place, F.ascii(c)))
        zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
        add = lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.get(table, acc["last"] * size + c))).alias("sum"))
        return F.aggregate(codes, zero, add, lambda acc: acc["sum"]) / (F.length(run) - 1)

    def pieces(s: Column) -> Column:
        def add(out: Column, at: Column, end: Column) -> Column:
            piece = F.struct(at.alias("start"), s["ord"].alias("ord"), end.alias("end"), s["kind"].alias("kind"))
            return F.when(end - at >= LEAST, F.concat(out, F.array(piece))).otherwise(out)

        def cut(acc: Column, b: Column) -> Column:
            return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), add(acc["out"], acc["at"], F.least(b["start"], s["end"])).alias("out"))

        whole = F.struct(s["start"].alias("at"), _none().alias("out"))
        return F.aggregate(base, whole, cut, lambda acc: add(acc["out"], acc["at"], s["end"]))

    free = F.flatten(F.transform(_found(text, len(BASE), "markov", CANDIDATE, 0, LEAST), pieces))
    return F.when(text.rlike(CANDIDATE), F.filter(free, lambda s: mean_ratio(_piece(text, s)) >= threshold)).otherwise(_none())


def secret_spans(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, names: tuple[str, str] = ("base", "spans")) -> DataFrame:
    """``docs`` with two sorted arrays of (start, ord, end, kind), called ``names``."""
    base, spans = names
    ratios = train(docs, sample)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn(base, base_spans(text))
    return out.withColumn(spans, F.array_sort(F.concat(base, markov_spans(text, F.col(base), ratios, threshold))))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced; overlapping spans are one.
    The other columns stay as they are, ``n_chars`` follows the text."""
    columns = docs.columns
    text = F.col("text")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    hidden = F.aggregate("_spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    some = F.size("_spans") > 0
    out = secret_spans(docs, names=("_base", "_spans")).withColumn("text", F.when(some, hidden).otherwise(text))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns)


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda order: F.size(F.filter("base", lambda s: s["ord"] == order)).cast("long")
    counts = [of_kind(order).alias(f"n_{kind}") for order, (kind, *_) in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
