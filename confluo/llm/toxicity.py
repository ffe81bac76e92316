"""Operator 4, toxicity: a linear-chain conditional random field over tokens.

Labels mark documents, so tokens are labelled first: in a toxic training document a
token is toxic if its word, or the first four letters of it, stands in significantly
more distinct left contexts in toxic documents than the share of such contexts
explains (exact binomial tail).  Distinct contexts, because copies of one document
would otherwise make every word of it look telling.  The field has two states and
features of the word, its first four and last three letters; it is fitted by
likelihood.  Forward-backward marginals give a document score through a logistic
function of the largest marginal and the expected number of likely toxic tokens, and the
offsets of the offending spans.

The fit uses at most ``sample`` training documents of each label, those first by
hash of their id; everything else covers whole texts of all documents.  ``labels``
rows for one id are merged by their maximum.

Defined cases: a null or empty text scores as a text without toxic tokens; a null id
is held out and never trains; repeated rows score alike; without training rows of
both labels every score is the share of toxic rows (0 without any); extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm import common

DIM = 1 << 18
SAMPLE = 2000
LIKELY = 0.2
CACHE_ENTRIES = 200_000
_EDGE = re.compile(r"^\W+|\W+$")
_CELLS = 500_000
_ROWS = 1000


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def bare(token: str) -> str:
    return _EDGE.sub("", token) if not token.isalnum() else token


def features(token: str) -> list[int]:
    word = bare(token)
    return [zlib.crc32(f"{kind}{part}".encode("utf-8", "replace")) % DIM for kind, part in (("w", word), ("p", word[:4]), ("s", word[-3:]))]


def chain(d: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of the toxic state.  d: log-potentials, time by
    document; trans: positive 2 x 2 potentials, a clean token going before the first.
    The marginal is fb / (1 + fb)."""
    (a00, a01), (a10, a11) = trans
    e = np.exp(np.clip(d, -30, 30))
    f, b = np.empty_like(e), np.ones_like(e)
    if len(e):
        f[0] = e[0] * a01 / a00
    for t in range(1, len(e)):
        f[t] = e[t] * (a01 + a11 * f[t - 1]) / (a00 + a10 * f[t - 1])
    for t in range(len(e) - 2, -1, -1):
        x = e[t + 1] * b[t + 1]
        b[t] = (a10 + a11 * x) / (a00 + a01 * x)
    return f, b


def padded(lengths: np.ndarray):
    """Groups of documents of similar length, each of at most ``_CELLS`` cells."""
    order, at = np.argsort(-lengths, kind="stable"), 0
    while at < len(order) and lengths[order[at]]:
        n = int(max(1, min(len(order) - at, _CELLS // lengths[order[at]], 1000)))
        group = order[at : at + n]
        yield group[lengths[group] > 0]
        at += n


class Field:
    """Weights, transitions and the document-level logistic function."""

    def __init__(self, weights, bias, trans, head):
        self.weights, self.bias, self.trans, self.head = weights, bias, trans, head

    def scorer(self):
        weights, bias, memory = self.weights, self.bias, {}

        def score(token: str) -> float:
            value = memory.get(token)
            if value is None:
                value = bias + float(sum(weights[i] for i in features(token)))
                if len(memory) < CACHE_ENTRIES:
                    memory[token] = value
            return value

        return score

    def marginals(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        lengths = np.array([len(s) for s in scores], np.int64)
        out = [np.zeros(0)] * len(scores)
        for group in padded(lengths):
            d = np.full((int(lengths[group].max()), len(group)), -30.0, np.float32)
            for k, i in enumerate(group):
                d[: lengths[i], k] = scores[i]
            f, b = _masked(d, lengths[group], self.trans)
            p = np.multiply(f, b, out=f)
            p /= 1 + p
            for k, i in enumerate(group):
                out[i] = p[: lengths[i], k]
        return out

    def score(self, marginals: list[np.ndarray]) -> np.ndarray:
        z = summary(marginals) @ self.head[1:] + self.head[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _masked(d, lengths, trans):
    """As ``chain``; a padded step hands the backward odds on unchanged.  Overwrites d."""
    (a00, a01), (a10, a11) = trans.astype(d.dtype)
    e = np.exp(np.clip(d, -30, 30, out=d), out=d)
    f, b = np.empty_like(e), np.ones_like(e)
    f[0] = e[0] * a01 / a00
    for t in range(1, len(e)):
        f[t] = e[t] * (a01 + a11 * f[t - 1]) / (a00 + a10 * f[t - 1])
    for t in range(len(e) - 2, -1, -1):
        x = e[t + 1] * b[t + 1]
        b[t] = np.where(t + 1 < lengths, (a10 + a11 * x) / (a00 + a01 * x), 1.0)
    return f, b


def summary(marginals: list[np.ndarray]) -> np.ndarray:
    """Per document: logit of the largest marginal, and log of one plus the sum of those
    of at least ``LIKELY`` (many unlikely tokens are no sign of a toxic one)."""
    out = np.zeros((len(marginals), 2))
    for i, p in enumerate(marginals):
        top = min(max(float(p.max()), 1e-6), 1 - 1e-6) if len(p) else 1e-6
        out[i] = math.log(top / (1 - top)) / 5, math.log1p(float(p[p >= LIKELY].sum()))
    return out


def _tail(a: int, n: int, share: float) -> float:
    """log P(X >= a) for X binomial(n, share), by its leading terms."""
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(a, min(n, a + 30) + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def telling(texts: list[np.ndarray], words: list[str], toxic: np.ndarray, log_p: float = math.log(1e-7)) -> set[str]:
    """Words ("w...") and openings ("p...") that mark toxic documents.  texts: numbers
    of bare words."""
    at = [np.column_stack((np.append(-1, t[:-1]), t)) for t in texts]
    seen: dict[str, list[int]] = {}
    for y in (0, 1):
        pairs = np.unique(np.concatenate([p for p, label in zip(at, toxic) if label == y]), axis=0)
        count = np.bincount(pairs[:, 1], minlength=len(words))
        for i in np.flatnonzero(count).tolist():
            if len(words[i]) >= 3:
                for key in ("w" + words[i], "p" + words[i][:4]):
                    seen.setdefault(key, [0, 0])[y] += int(count[i])
    total = [sum(s[k] for s in seen.values()) for k in (0, 1)]
    share = min(max(total[1] / max(sum(total), 1), 1e-9), 0.5)
    return {key for key, (n, t) in seen.items() if t >= 4 and t >= 4 * n and _tail(t, t + n, share) < log_p}


def fit(rows: list[tuple[str, int]], weight: tuple[float, float] = (1.0, 1.0), rounds: int = 25) -> Field:
    """Fit from (text, label) rows; ``weight`` undoes the sampling by label."""
    toxic = np.array([y for _, y in rows], np.int64)
    share = float(np.dot(toxic, np.full(len(toxic), weight[1])) / max(1e-9, sum(weight[y] for y in toxic))) if len(rows) else 0.0
    if not 0 < toxic.sum() < len(toxic):
        flat = math.log(max(share, 1e-6) / max(1 - share, 1e-6)) if rows else -30.0
        return Field(np.zeros(DIM, np.float32), -8.0, np.ones((2, 2)), np.array([flat, 0.0, 0.0]))
    index: dict[str, int] = {}
    ids = [np.array([index.setdefault(w, len(index)) for w in tokens(t)], np.int32) for t, _ in rows]
    naked: dict[str, int] = {}
    bare_of = np.array([naked.setdefault(bare(w), len(naked)) for w in index] or [0], np.int32)
    marks = telling([bare_of[i] for i in ids], list(naked), toxic)
    feats = np.array([features(w) for w in index] or [[0, 0, 0]], np.int32)
    tagged = np.array([("w" + b in marks or "p" + b[:4] in marks) for b in map(bare, index)] or [False])
    lengths = np.array([len(i) for i in ids], np.int64)
    groups = []
    for group in padded(lengths):
        at = np.zeros((int(lengths[group].max()), len(group)), np.int32)
        for k, i in enumerate(group):
            at[: lengths[i], k] = ids[i]
        inside = np.arange(len(at))[:, None] < lengths[group]
        groups.append((at, inside, tagged[at] & inside & (toxic[group] == 1), lengths[group]))
    gold = np.bincount(np.concatenate([g[0][g[1]] for g in groups]), weights=np.concatenate([g[2][g[1]] for g in groups]), minlength=len(feats))
    gold_pair = np.ones((2, 2))
    for _, inside, y, _ in groups:
        a, b, both = y[:-1].astype(float), y[1:].astype(float), inside[1:]
        gold_pair += [[((1 - a) * (1 - b) * both).sum(), ((1 - a) * b * both).sum()], [(a * (1 - b) * both).sum(), (a * b * both).sum()]]
    # transitions and bias start at the labelled frequencies; the weights are fitted
    trans = gold_pair / gold_pair.sum(axis=1, keepdims=True)
    weights, bias = np.zeros(DIM), 0.0
    square, log_trans, trans_square, bias_square = np.full(DIM, 1e-6), np.log(trans), np.full((2, 2), 1e-6), 1e-6
    n_tokens = max(1.0, float(lengths.sum()))
    for _ in range(rounds):
        score = bias + weights[feats].sum(axis=1)
        expected, pair = np.zeros(len(feats)), np.zeros((2, 2))
        trans = np.exp(log_trans)
        for at, inside, _, size in groups:
            d = np.where(inside, score[at], -30.0)
            f, b = _masked(d, size, trans)
            p = f * b / (1 + f * b)
            expected += np.bincount(at[inside], weights=p[inside], minlength=len(feats))
            x = d[1:] * b[1:]
            parts = np.array([[np.full_like(x, trans[0, 0]), trans[0, 1] * x], [f[:-1] * trans[1, 0], f[:-1] * trans[1, 1] * x]])
            pair += (parts / parts.sum(axis=(0, 1)) * inside[1:]).sum(axis=(2, 3))
        gap = gold - expected
        g = np.bincount(feats.ravel(), weights=np.repeat(gap, 3), minlength=DIM) - 1e-3 * weights
        square += g * g
        weights += 0.7 * g / np.sqrt(square)
        bias_square += gap.sum() ** 2
        bias += 0.5 * gap.sum() / math.sqrt(bias_square)
        g = (gold_pair - pair) / n_tokens
        trans_square += g * g
        log_trans += 0.1 * g / np.sqrt(trans_square)
    field = Field(weights.astype(np.float32), float(bias), np.exp(log_trans), np.zeros(3))
    score = field.bias + field.weights[feats].sum(axis=1)
    x = summary(field.marginals([score[i] for i in ids]))
    field.head = logistic(x, toxic, np.where(toxic == 1, weight[1], weight[0]))
    return field


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weighted ridge logistic regression by damped Newton steps; intercept first."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, weight = np.zeros(x.shape[1]), weight * len(y) / weight.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * beta
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, g)
        beta += step / max(1.0, np.abs(step).max())
    return beta


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on at most ``sample`` training documents of each label: ids are chosen first,
    by a hash that passes about that many, and only their texts move."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    y = y.where(~held_out("doc_id") & F.col("label").isin(0, 1))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    known = y.join(texts.select("doc_id"), "doc_id", "left_semi")
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    u, chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), []
    for label, n in sorted(total.items()):
        passing = known.where((F.col("label") == label) & (u < int((1 << 40) * min(1.0, 1.05 * sample / n))))
        chosen += [(r["doc_id"], label) for r in passing.orderBy(u, "doc_id").limit(sample).collect()]
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int")
    # at most twice ``sample`` ids; repeated rows of an id count once
    rows = [(r["text"], r["label"]) for r in texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy("doc_id").collect()]
    taken = [sum(1 for _, label in rows if label == k) for k in (0, 1)]
    return fit(rows, (total.get(0, 0) / max(1, taken[0]), total.get(1, 0) / max(1, taken[1])))


def toxic_scores(docs: DataFrame, field: Field, spans: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, score and, if asked for, the offending spans as
    arrays of (start, end) code points, tokens with a marginal of 0.5 or more."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        model = shared.value
        score = model.scorer()
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                texts = batch.column(1).to_pylist()
                marginals = model.marginals([np.fromiter(map(score, tokens(t)), np.float32) for t in texts])
                columns = [batch.column(0), pa.array(model.score(marginals), pa.float64())]
                if spans:
                    columns.append(pa.array([offending(t, p) for t, p in zip(texts, marginals)], pa.list_(pa.list_(pa.int32()))))
                yield pa.record_batch(columns, ["doc_id", "score", "spans"][: len(columns)])

    schema = "doc_id long, score double" + ", spans array<array<int>>" * spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(run), schema)


def keep_clean(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns.  No shuffle."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index("text")

    def run(batches):
        model = shared.value
        score = model.scorer()
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                marginals = model.marginals([np.fromiter(map(score, tokens(t)), np.float32) for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(model.score(marginals) < 0.5))

    return docs.mapInArrow(common.lean(run), docs.schema)


def offending(text: str | None, marginals: np.ndarray, least: float = 0.5) -> list[list[int]]:
    if not len(marginals) or marginals.max() < least:
        return []
    found = list(re.finditer(r"\S+", text))
    return [[m.start(), m.end()] for m, p in zip(found, marginals) if p >= least] if len(found) == len(marginals) else []


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    field = train(docs, common.table(spark, sf_dir, "labels"))
    scored = toxic_scores(docs, field, spans=True)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
