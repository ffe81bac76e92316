"""Exact-key and fuzzy linking under hard constraints.

A merge decision reads the state of its two clusters only, so an ordered greedy pass
decomposes by connected component of the candidate graph: components are found with
joins, and only those that could hold a conflict are replayed in order, each in one
group.  The others are their own clusters.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions import similarity as S
from confluo.functions import text as T
from confluo.operators.graph import components
from confluo.session import cut


@dataclass(frozen=True)
class Rule:
    code: str
    fields: tuple[str, ...]
    authoritative: bool = False
    system: str | None = None


# The exact rules in order of priority.
RULES = (
    Rule("D01", ("linked_transaction_id",), True),
    Rule("D02", ("portal_user_id",), True),
    Rule("D03", ("email_normalised", "full_name_normalised")),
    Rule("D04", ("email_normalised", "phone_normalised")),
    Rule("D05", ("email_normalised", "postcode_normalised")),
    Rule("D06", ("phone_normalised", "full_name_normalised")),
    Rule("D07", ("full_name_normalised", "address_normalised")),
    Rule("D08", ("full_name_normalised", "postcode_normalised")),
    Rule("D09", ("full_name_normalised", "date_of_birth_normalised"), system="CRM"),
    Rule("D10", ("surname_normalised", "postcode_normalised", "date_of_birth_normalised"), system="CRM"),
)
BLOCK_CAP = 100


def anonymous(fields: tuple[str, ...] = ("first_name", "surname", "full_name", "email", "phone", "address", "postcode", "date_of_birth")) -> Column:
    empty = [T.clean_for_matching(F.col(f"{f}_normalised")) == "" for f in fields] + [T.clean_for_matching(F.col(c)) == "" for c in ("portal_user_id", "linked_transaction_id")]
    return (F.col("source_system") == "ONLINE") & reduce(Column.__and__, empty)


def key_pairs(records: DataFrame, key: Column, record: str = "staging_record_id") -> DataFrame:
    """(left, right, key), left < right, of records that share a populated key."""
    k = records.select(F.col(record).alias("id"), key.alias("key")).where("key is not null")
    shared = k.groupBy("key").count().where("count > 1").select("key")
    k = k.join(shared, "key")
    return k.withColumnRenamed("id", "left").join(k.withColumnRenamed("id", "right"), "key").where("left < right").select("left", "right", "key")


def exact_edges(records: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Candidate edges of all rules: left, right, key, rule, priority, authoritative."""
    out = []
    for n, rule in enumerate(rules, 1):
        part = records.where(F.col("source_system") == rule.system) if rule.system else records
        values = [T.clean_for_matching(F.col(f)) for f in rule.fields]
        key = F.when(reduce(Column.__and__, [v != "" for v in values]), F.concat_ws("\x1f", *values))
        if rule.code == "D01":
            online = records.where("source_system = 'ONLINE'").select(F.col("staging_record_id").alias("a"), F.lower(key).alias("key")).where("key is not null")
            shop = records.where("source_system = 'ECOMMERCE'").select(F.col("staging_record_id").alias("b"), F.lower("transaction_id").alias("key")).where("key != ''")
            pairs = online.join(shop, "key").select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), "key")
        else:
            pairs = key_pairs(part, key)
        out.append(pairs.withColumns({"rule": F.lit(rule.code), "priority": F.lit(n), "authoritative": F.lit(rule.authoritative)}))
    return reduce(DataFrame.unionByName, out)


class _Clusters:
    """Clusters of one component with the values that their members are known by."""

    def __init__(self, members: pd.DataFrame):
        self.parent = {m: m for m in members["id"]}
        self.portal = {i: set(filter(None, p)) for i, p in zip(members["id"], members["portal"])}
        self.born = {i: set(filter(None, d)) for i, d in zip(members["id"], members["dob"])}
        self.apart: dict[str, set] = {i: set() for i in self.parent}

    def find(self, x):
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def conflict(self, a, b, authoritative: bool) -> str:
        portal, born = self.portal, self.born
        if any(self.find(x) == b for x in self.apart[a]):
            return "prohibited"
        if portal[a] and portal[b] and not portal[a] & portal[b]:
            return "portal conflict"
        if not authoritative and born[a] and born[b] and not born[a] & born[b]:
            return "date of birth conflict"
        return ""

    def merge(self, a, b):
        a, b = min(a, b), max(a, b)
        self.parent[b] = a
        self.portal[a] |= self.portal[b]
        self.born[a] |= self.born[b]
        self.apart[a] |= self.apart[b]
        return a

    def known(self, a) -> tuple[int, int]:
        return len(self.portal[a]), len(self.born[a])


def _greedy(edges: pd.DataFrame, members: pd.DataFrame, order: list[str], ascending: list[bool]):
    """Replays ordered edges; rows marked ``barred`` are pairs that may never meet.
    Returns the decisions (left, right, rule, accepted, reason) and (id, root)."""
    c = _Clusters(members)
    for e in edges[edges["barred"]].itertuples(index=False):
        c.apart[e.left].add(e.right)
        c.apart[e.right].add(e.left)
    decisions = []
    for e in edges[~edges["barred"]].sort_values(order, ascending=ascending, kind="stable").itertuples(index=False):
        a, b = c.find(e.left), c.find(e.right)
        if a == b:
            continue
        reason = c.conflict(a, b, e.authoritative)
        decisions.append((e.left, e.right, e.rule, not reason, reason))
        if not reason:
            c.merge(a, b)
    return decisions, [(m, c.find(m)) for m in members["id"]]


def _replay_key(c: _Clusters, ids: list[str], authoritative: bool) -> None:
    """What ``_greedy`` does with all pairs of the sorted ``ids`` in order.  A pair of
    clusters is asked once, and again, at its next pair of ids, only if what is known of
    one of them has changed; a record whose cluster met all others since is passed over."""
    held: dict[str, list[int]] = {}
    for i, x in enumerate(ids):
        held.setdefault(c.find(x), []).append(i)
    merges, settled = 0, {}
    for i, x in enumerate(ids):
        if len(held) == 1:
            return
        a = c.find(x)
        if settled.get(a) == merges:
            continue
        own, refused, grown = held.pop(a), [], False
        ahead = [(at[bisect_right(at, i)], b) for b, at in held.items() if at[-1] > i]
        heapify(ahead)
        while ahead:
            j, b = heappop(ahead)
            if c.conflict(a, b, authoritative):
                refused.append(b)
                continue
            before = c.known(a)
            a, merges = c.merge(a, b), merges + 1
            own += held.pop(b)
            if c.known(a) != before:
                grown = True
                for b in refused:
                    if held[b][-1] > j:
                        heappush(ahead, (held[b][bisect_right(held[b], j)], b))
                refused = [b for b in refused if held[b][-1] <= j]
        own.sort()
        held[a] = own
        if not grown:
            settled[a] = merges


def _listed(records: DataFrame) -> DataFrame:
    return records.withColumns({c: F.array(F.coalesce(c, F.lit(""))) for c in ("portal", "dob") if dict(records.dtypes)[c] == "string"})


def _several(member: DataFrame) -> DataFrame:
    """Components in which a portal or a date of birth has more than one value."""
    known = member.select("component", F.explode(F.concat(*[F.transform(c, lambda v, c=c: F.struct(F.lit(c).alias("kind"), v.alias("value"))) for c in ("portal", "dob")])).alias("e")).select("component", "e.*")
    return known.where("value <> ''").distinct().groupBy("component", "kind").count().where("count > 1").select("component")


def keyed_clusters(records: DataFrame, keyed: DataFrame) -> DataFrame:
    """(id, cluster) of ``constrained_clusters`` over all pairs of ids that share a key,
    without making the pairs.  records: as there; keyed: id, key, priority,
    authoritative (the same for all of a priority and key), a null key counts as none."""
    records = _listed(records)
    keyed = cut(keyed.select("id", "key", "priority", "authoritative").where("key is not null").distinct(), "keyed")
    shared = keyed.groupBy("priority", "key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    keyed = cut(keyed.join(shared, ["priority", "key"]).drop("n"), "shared")
    comp = cut(components(keyed.where("id <> first"), "first", "id"), "components")
    member = cut(records.join(comp, records["id"] == comp["node"]).drop("node"), "members")
    risky = cut(_several(member).distinct(), "risky")

    def replay(k: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        c = _Clusters(m)
        for _, group in k.groupby(["priority", "key"], sort=True):
            _replay_key(c, sorted(x for x in group["id"] if x in c.parent), bool(group["authoritative"].iloc[0]))
        return pd.DataFrame([(x, c.find(x)) for x in m["id"]], columns=["id", "cluster"])

    placed = keyed.join(comp.withColumnRenamed("node", "id"), "id").join(risky, "component", "left_semi")
    replayed = placed.groupBy("component").cogroup(member.join(risky, "component", "left_semi").groupBy("component")).applyInPandas(replay, "id string, cluster string")
    safe = member.join(risky, "component", "left_anti").select("id", F.col("component").alias("cluster"))
    linked = cut(safe.unionByName(replayed), "linked")
    return linked.unionByName(records.select("id").join(linked, "id", "left_anti").select("id", F.col("id").alias("cluster")))


def constrained_clusters(records: DataFrame, edges: DataFrame, order: tuple[str, ...] = ("priority", "key", "left", "right"), descending: tuple[str, ...] = (), barred: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """records: id, and portal and dob, the known value ("" if none) or an array of such
    values; sets that do not meet are a conflict.  ``barred`` (left, right): pairs of ids that may not meet, through others either.  Returns (id, cluster),
    cluster the least id in it, and the decisions (left, right, rule, accepted, reason)."""
    ascending = [c not in descending for c in order]
    records = _listed(records)
    edges = cut(edges, "edges")
    comp = cut(components(edges, "left", "right"), "components")
    member = cut(records.join(comp, records["id"] == comp["node"]).drop("node"), "members")
    placed = edges.join(comp.withColumnRenamed("node", "left"), "left").withColumn("barred", F.lit(False))
    if barred is not None:
        ends = [comp.select(F.col("node").alias(side), F.col("component").alias(c)) for side, c in (("left", "component"), ("right", "other"))]
        inside = barred.select("left", "right").join(ends[0], "left").join(ends[1], "right").where("component = other").drop("other")
        placed = cut(placed.unionByName(inside.withColumn("barred", F.lit(True)), allowMissingColumns=True), "placed")

    def replay(kind: str, schema: str):
        def run(e: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
            decisions, roots = _greedy(e, m, list(order), ascending)
            return pd.DataFrame(decisions if kind == "decisions" else roots, columns=[f.split()[0] for f in schema.split(", ")])

        return run, schema

    risky = cut(_several(member).unionAll(placed.where("barred").select("component")).distinct(), "risky")
    fn, schema = replay("roots", "id string, cluster string")
    replayed = placed.join(risky, "component", "left_semi").groupBy("component").cogroup(member.join(risky, "component", "left_semi").groupBy("component")).applyInPandas(fn, schema)
    safe = member.join(risky, "component", "left_anti").select("id", F.col("component").alias("cluster"))
    linked = cut(safe.unionByName(replayed), "linked")
    alone = records.select("id").join(linked, "id", "left_anti").select("id", F.col("id").alias("cluster"))
    fn, schema = replay("decisions", "left string, right string, rule string, accepted boolean, reason string")
    decided = placed.groupBy("component").cogroup(member.groupBy("component")).applyInPandas(fn, schema)
    return linked.unionByName(alone), decided


def block_keys(prefix: str = "") -> dict[str, Column]:
    """B01-B06 over the normalised fields of a record; null: not in that block."""
    c = lambda n: F.col(f"{prefix}{n}_normalised")
    local, domain = T.email_parts(c("email"))
    last, first, post, phone = c("surname"), c("first_name"), c("postcode"), c("phone")
    some = lambda *x: reduce(Column.__and__, [v != "" for v in x])
    join = lambda *x: F.concat_ws("|", *x)
    return {
        "B01": F.when((F.length(last) >= 3) & some(post), join(F.left(last, F.lit(3)), post)),
        "B02": F.when(some(last, post), join(F.left(last, F.lit(1)), T.postcode_outward(post))),
        "B03": F.when((F.length(phone) >= 7) & some(last), join(F.right(phone, F.lit(7)), F.left(last, F.lit(1)))),
        "B04": F.when((F.length(local) >= 4) & some(domain), join(domain, F.left(local, F.lit(4)))),
        "B05": F.when(some(first, post), join(F.left(first, F.lit(1)), post)),
        "B06": F.when((F.length(last) >= 3) & some(T.birth_year(c("date_of_birth"))), join(T.birth_year(c("date_of_birth")), F.left(last, F.lit(3)))),
    }


def blocked_pairs(records: DataFrame, keys: dict[str, Column], cluster: str = "cluster", cap: int = BLOCK_CAP) -> DataFrame:
    """Cluster pairs that share a block of 2 to ``cap`` clusters: cluster_id_1 <
    cluster_id_2, blocking_rules, blocking_hits.  The cap is part of the definition;
    ``oversized_blocks`` lists what it leaves out."""
    blocks = _blocks(records, keys, cluster)
    sizes = blocks.groupBy("rule", "key").agg(F.count("*").alias("n")).where(F.col("n").between(2, cap)).drop("n")
    kept = blocks.join(sizes, ["rule", "key"])
    a, b = kept.withColumnRenamed("cluster", "cluster_id_1"), kept.withColumnRenamed("cluster", "cluster_id_2")
    pairs = a.join(b, ["rule", "key"]).where("cluster_id_1 < cluster_id_2")
    return pairs.groupBy("cluster_id_1", "cluster_id_2").agg(F.array_join(F.array_sort(F.collect_set("rule")), " | ").alias("blocking_rules"), F.count("*").alias("blocking_hits"))


def _blocks(records: DataFrame, keys: dict[str, Column], cluster: str) -> DataFrame:
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), k.alias("key")) for n, k in keys.items()]))
    return records.select(F.col(cluster).alias("cluster"), entries.alias("e")).select("cluster", "e.rule", "e.key").where("key is not null").distinct()


def oversized_blocks(records: DataFrame, keys: dict[str, Column], cluster: str = "cluster", cap: int = BLOCK_CAP) -> DataFrame:
    return _blocks(records, keys, cluster).groupBy("rule", "key").agg(F.count("*").alias("clusters")).where(F.col("clusters") > cap)


def score_pairs(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """The best record pair of each cluster pair: by score, coverage, supporting
    count, then the record ids.  records: cluster, staging_record_id, *_normalised."""
    fields = [c for c in records.columns if c.endswith("_normalised")]
    side = lambda n: records.select(F.col("cluster").alias(f"cluster_id_{n}"), F.col("staging_record_id").alias(f"record_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in fields])
    both = pairs.join(side(1), "cluster_id_1").join(side(2), "cluster_id_2")
    p = lambda f: (F.col(f"{f}_normalised_1"), F.col(f"{f}_normalised_2"))
    has = lambda f: (p(f)[0] != "") & (p(f)[1] != "")
    features = {
        "email": (has("email"), S.email_similarity(*p("email"))),
        "phone": (has("phone"), S.phone_similarity(*p("phone"))),
        "name": S.name_similarity(p("full_name"), p("first_name"), p("surname")),
        "address": (has("address"), S.token_set_ratio(*p("address"))),
        "postcode": (has("postcode"), S.postcode_similarity(*p("postcode"))),
        "date_of_birth": (has("date_of_birth"), F.when(p("date_of_birth")[0] == p("date_of_birth")[1], 1.0).otherwise(0.0)),
    }
    scored = both.withColumns(S.weighted(features))
    rank = F.struct("score", "coverage", "supporting", -F.length("record_1"), "record_1", "record_2")
    value = F.struct("record_1", "record_2", "score", "coverage", "strong", "supporting", "corroborating")
    best = scored.groupBy("cluster_id_1", "cluster_id_2").agg(F.max_by(value, rank).alias("b"), F.count("*").alias("record_pairs_compared"))
    return pairs.join(best.select("cluster_id_1", "cluster_id_2", "record_pairs_compared", "b.*"), ["cluster_id_1", "cluster_id_2"])


def profiles(records: DataFrame) -> DataFrame:
    sets = {n: F.array_sort(F.collect_set(T.blank_to_null(F.col(c)))) for n, c in (("portals", "portal_user_id"), ("births", "date_of_birth_normalised"))}
    return records.groupBy("cluster").agg(F.count("*").alias("size"), F.min("staging_record_id").alias("first"), *[c.alias(n) for n, c in sets.items()])


def static_conflict(scores: DataFrame, profile: DataFrame, prohibited: DataFrame) -> DataFrame:
    """Adds ``conflict``: prohibited before, disjoint portal ids, disjoint births."""
    side = lambda n: profile.select(F.col("cluster").alias(f"cluster_id_{n}"), F.col("portals").alias(f"p{n}"), F.col("births").alias(f"d{n}"))
    apart = lambda x: (F.size(f"{x}1") > 0) & (F.size(f"{x}2") > 0) & ~F.arrays_overlap(f"{x}1", f"{x}2")
    bar = prohibited.select(F.least("left", "right").alias("cluster_id_1"), F.greatest("left", "right").alias("cluster_id_2")).distinct().withColumn("barred", F.lit(True))
    j = scores.join(side(1), "cluster_id_1").join(side(2), "cluster_id_2").join(bar, ["cluster_id_1", "cluster_id_2"], "left")
    why = F.when(F.col("barred"), "prohibited").when(apart("p"), "portal conflict").when(apart("d"), "date of birth conflict").otherwise("")
    return j.withColumn("conflict", why).drop("p1", "p2", "d1", "d2", "barred")


def probabilistic(records: DataFrame, prohibited: DataFrame, automatic: float = 0.91, review: float = 0.70, least: float = 0.55, cap: int = BLOCK_CAP) -> tuple[DataFrame, DataFrame]:
    """records: silver columns plus ``cluster``.  Returns (cluster, merged) and the
    scored, classified cluster pairs with merge_performed and final_reason."""
    pairs = blocked_pairs(records, block_keys(), cap=cap)
    profile = cut(profiles(records), "profiles")
    scored = static_conflict(score_pairs(pairs, records), profile, prohibited)
    decision = S.classify(F.col("conflict") != "", F.col("score"), F.col("coverage"), S.supported(F.col("strong"), F.col("corroborating"), F.col("supporting")), automatic, review, least)
    scored = cut(scored.withColumn("decision", decision), "scored")
    edges = scored.where("decision = 'automatic'").select(F.col("cluster_id_1").alias("left"), F.col("cluster_id_2").alias("right"), "score", "coverage", F.lit("FUZZY").alias("rule"), F.lit(False).alias("authoritative"))
    one = profile.select(F.col("cluster").alias("id"), F.col("portals").alias("portal"), F.col("births").alias("dob"))
    merged, decided = constrained_clusters(one, edges, ("score", "coverage", "left", "right"), ("score", "coverage"), prohibited)
    decided = decided.select(F.col("left").alias("cluster_id_1"), F.col("right").alias("cluster_id_2"), F.col("accepted").alias("merge_performed"), "reason")
    scored = scored.join(decided, ["cluster_id_1", "cluster_id_2"], "left")
    # a pair whose clusters were together already has no decision of its own
    joined = (F.col("decision") == "automatic") & F.col("merge_performed").isNull()
    reason = F.when(F.col("conflict") != "", F.col("conflict")).when(joined, "accepted_transitive_support").otherwise(F.coalesce("reason", F.lit("")))
    scored = scored.withColumns({"merge_performed": F.coalesce("merge_performed", F.lit(False)), "final_reason": reason}).drop("reason")
    return merged.toDF("cluster", "merged"), cut(scored, "decided")
