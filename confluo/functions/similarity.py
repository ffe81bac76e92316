"""Similarities and the weighted pair score.

``ratio`` and ``token_set_ratio`` need Arrow-batched Python: Spark's Levenshtein
distance counts a substitution once, these count it as a deletion and an insertion.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

from confluo.functions import text as T

# Feature weights and the limits of the evidence classes.
WEIGHTS = {"email": 0.30, "phone": 0.25, "name": 0.20, "address": 0.10, "postcode": 0.10, "date_of_birth": 0.05}
STRONG = {"email": 0.85, "phone": 0.90}
SUPPORTING, CORROBORATING = 0.75, 0.70


def common_length(a: str, b: str) -> int:
    """Longest common subsequence, one bit per character of a."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        hit = free & masks.get(ch, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 2 * common_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def set_ratio(a: str, b: str) -> float:
    """Best indel ratio among the shared words, and the shared plus each side's own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and (x <= y or y <= x):
        return 1.0
    shared = " ".join(sorted(both))
    one, two = (" ".join(filter(None, (shared, " ".join(sorted(s - both))))) for s in (x, y))
    ratios = [indel_ratio(one, two)]
    if both:
        ratios += [indel_ratio(shared, one), indel_ratio(shared, two)]
    return max(ratios)


@F.pandas_udf(types.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(types.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([set_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(types.DoubleType())
def round_as_python(x: pd.Series) -> pd.Series:
    """Four places, by the decimal value of the double, ties to even."""
    return x.map(lambda v: round(v, 4) if v == v else v)


def email_similarity(a: Column, b: Column) -> Column:
    (la, da), (lb, db) = T.email_parts(a), T.email_parts(b)
    whole = ratio(a, b)
    return F.when((da == db) & (da != ""), F.greatest(whole, ratio(la, lb))).otherwise(whole)


def phone_similarity(a: Column, b: Column, other: Column | None = None) -> Column:
    """other: the score of numbers that differ in their last seven digits."""
    other = ratio(a, b) if other is None else other
    tail = (F.length(a) >= 7) & (F.length(b) >= 7) & (F.right(a, F.lit(7)) == F.right(b, F.lit(7)))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(tail, 0.9).otherwise(other)


def postcode_similarity(a: Column, b: Column, other: Column | None = None) -> Column:
    other = ratio(a, b) if other is None else other
    same = (T.postcode_outward(a) == T.postcode_outward(b)) & (T.postcode_outward(a) != "")
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(same, F.greatest(F.lit(0.6), other)).otherwise(other)


def name_similarity(full: tuple[Column, Column], first: tuple[Column, Column], last: tuple[Column, Column]) -> tuple[Column, Column]:
    """(available, similarity): full names, else the mean of the parts both have."""
    both = lambda p: (p[0] != "") & (p[1] != "")
    parts = [F.when(both(p), ratio(*p)) for p in (first, last)]
    n = sum(F.when(both(p), 1).otherwise(0) for p in (first, last))
    mean = sum(F.coalesce(x, F.lit(0.0)) for x in parts) / F.when(n > 0, n)
    return both(full) | (n > 0), F.when(both(full), ratio(*full)).otherwise(F.coalesce(mean, F.lit(0.0)))


def weighted(features: dict[str, tuple[Column, Column]], rounder=round_as_python) -> dict[str, Column]:
    """features: name -> (available, similarity).  The score is over what both sides
    have, coverage the weight of that; both are rounded before they are compared, the
    evidence counts use the similarities as they are."""
    weight = lambda n, c: F.when(features[n][0], c * WEIGHTS[n]).otherwise(0.0)
    covered = sum(weight(n, F.lit(1.0)) for n in features)
    total = sum(weight(n, features[n][1]) for n in features)
    at_least = lambda n, x: F.when(features[n][0] & (features[n][1] >= x), 1).otherwise(0)
    strong = {n: at_least(n, x) for n, x in STRONG.items() if n in features}
    corroborating = sum(at_least(n, CORROBORATING) - (F.least(strong[n], at_least(n, CORROBORATING)) if n in strong else 0) for n in features)
    return {
        "score": rounder(F.when(covered > 0, total / covered).otherwise(0.0)),
        "coverage": rounder(covered),
        "strong": sum(strong.values()) if strong else F.lit(0),
        "supporting": sum(at_least(n, SUPPORTING) for n in features),
        "corroborating": corroborating,
    }


def supported(strong: Column, corroborating: Column, supporting: Column) -> Column:
    return ((strong >= 1) & (corroborating >= 1)) | (supporting >= 3)


def classify(conflict: Column, score: Column, coverage: Column, support: Column, automatic: float = 0.91, review: float = 0.70, least: float = 0.55) -> Column:
    return (
        F.when(conflict, "rejected")
        .when((score >= automatic) & (coverage >= least) & support, "automatic")
        .when(score >= review, "review")
        .otherwise("rejected")
    )
