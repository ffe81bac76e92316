import math
import random
from itertools import combinations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from confluo.functions import similarity as S
from confluo.functions import text as T
from confluo.operators import evaluate, linking
from confluo.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    show = lambda v: "None" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return list(pdf.columns), sorted(tuple(map(show, r)) for r in pdf.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    assert rows(catalogue.QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.normalise_name(lit("Zoë O'Neil"))) == "zoeoneil"
    assert one(spark, T.normalise_email(lit(" A@ B.c\t"))) == "a@b.c"
    assert [one(spark, T.normalise_phone(lit(x))) for x in ("+44 7123 456789", "0044 7123456789", "07123456789", "7123456789", "")] == ["07123456789"] * 4 + [""]
    assert [one(spark, T.normalise_date(lit(x))) for x in ("1/2/1990", "31/02/1990", "1990-02-01", "")] == ["1990-02-01", "", "1990-02-01", ""]
    assert [one(spark, T.postcode_outward(lit(x))) for x in ("SO14", "BN1", "SO143AB")] == ["S", "BN1", "SO14"]
    assert one(spark, T.normalise_key(lit("Straße 1"))) == "strasse1"
    assert one(spark, T.parse_hours(lit("02:45"))) == 2.75
    assert [one(spark, x) for x in T.email_parts(lit("a@b@c.d"))] == ["a@b", "c.d"]
    assert [one(spark, x) for x in T.name_parts(lit("Ann_Lee Roy"))] == ["Ann", "Lee Roy"]


def test_ratios_by_table():
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcd", k=rng.randrange(12))) for _ in range(2))
        assert S.common_length(a, b) == lcs(a, b)
    assert S.set_ratio("1 high street", "high street 1 flat") == 1.0
    assert S.indel_ratio("", "a") == 0.0


def test_constrained_clusters_equal_plain_greedy(spark):
    rng = random.Random(3)
    for _ in range(2):
        ids = [f"STG{i:06d}" for i in range(60)]
        rec = [(i, rng.choice(["", "", "p1", "p2"]), rng.choice(["", "", "d1", "d2"])) for i in ids]
        edges = sorted({(*sorted(rng.sample(ids, 2)), str(rng.randrange(9)), "D0%d" % (p := rng.randrange(1, 9)), p, p <= 2) for _ in range(70)}, key=lambda e: (e[4], e[2], e[0], e[1]))
        group = {i: {i} for i in ids}
        portal, born = {i: {p} - {""} for i, p, _ in rec}, {i: {d} - {""} for i, _, d in rec}
        for a, b, _, _, _, authority in edges:
            x, y = group[a], group[b]
            if x is y:
                continue
            px, py, dx, dy = (set().union(*(m[i] for i in g)) for m, g in ((portal, x), (portal, y), (born, x), (born, y)))
            if (px and py and not px & py) or (not authority and dx and dy and not dx & dy):
                continue
            x |= y
            for i in y:
                group[i] = x
        records = spark.createDataFrame(rec, "id string, portal string, dob string")
        e = spark.createDataFrame(edges, "left string, right string, key string, rule string, priority int, authoritative boolean")
        found, decisions = linking.constrained_clusters(records, e)
        assert {r.id: r.cluster for r in found.collect()} == {i: min(group[i]) for i in ids}
        assert decisions.where("accepted").count() == len(ids) - len({min(g) for g in group.values()})


def test_keyed_clusters_equal_the_replay_of_all_pairs():
    rng = random.Random(8)
    values = lambda kind, most: {f"{kind}{rng.randrange(4)}" for _ in range(rng.choice((0, 0, 1, 1, most)))}
    for n in range(400):
        ids, most = [f"STG{i:03d}" for i in range(rng.choice((6, 12, 40)))], rng.choice((1, 3))
        members = pd.DataFrame({"id": ids, "portal": [values("p", most) for _ in ids], "dob": [values("d", most) for _ in ids]})
        keys = [(p, f"k{k}", p <= 2, sorted(rng.sample(ids, rng.randrange(2, len(ids))))) for p in (1, 5, 7) for k in range(3)][: 1 + n % 9]
        pairs = [(a, b, k, f"D0{p}", p, authority, False) for p, k, authority, group in keys for a, b in combinations(group, 2)]
        edges = pd.DataFrame(pairs, columns=["left", "right", "key", "rule", "priority", "authoritative", "barred"])
        want = linking._greedy(edges, members, ["priority", "key", "left", "right"], [True] * 4)[1]
        c = linking._Clusters(members)
        for _, _, authority, group in keys:
            linking._replay_key(c, group, authority)
        assert [(x, c.find(x)) for x in ids] == want


def test_keyed_clusters_make_no_pairs(spark):
    n = 40_000  # eight hundred million pairs
    r = spark.range(n).select(F.format_string("STG%06d", "id").alias("id"), F.when(F.col("id") % 3 == 0, (F.col("id") % 7).cast("string")).otherwise("").alias("portal"), F.lit("").alias("dob"))
    keyed = r.select("id", F.lit("k").alias("key"), F.lit(5).alias("priority"), F.lit(False).alias("authoritative"))
    sizes = linking.keyed_clusters(r, keyed).groupBy("cluster").count().collect()
    assert sum(s["count"] for s in sizes) == n and {s.cluster for s in sizes} == {f"STG{i:06d}" for i in (0, 3, 6, 9, 12, 15, 18)}


def test_blocking_counts_equal_the_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.choice((None, *range(30))), rng.choice((None, "x", "y", *map(str, range(9))))) for _ in range(60)]
    clusters = spark.createDataFrame(rows, "cluster int, truth string")
    pairs = sorted({tuple(sorted(rng.sample(range(32), 2))) for _ in range(90)})
    candidates = spark.createDataFrame(pairs, "cluster_id_1 int, cluster_id_2 int")
    want = evaluate.blocking_metrics(candidates, evaluate.true_pairs(clusters), 30).drop("recall", "reduction").first()
    assert want.found > 0 and evaluate.blocking_counts(candidates, clusters).first() == want


def test_blocking_counts_make_no_pairs(spark):
    clusters = spark.range(1_000_000).select(F.col("id").alias("cluster"), F.lit("same").alias("truth"))
    none = spark.createDataFrame([], "cluster_id_1 long, cluster_id_2 long")
    assert tuple(evaluate.blocking_counts(none, clusters).first()) == (499_999_500_000, 0, 0)


def test_block_cap_is_inclusive(spark):
    d = spark.range(201).select("id", F.when(F.col("id") < 100, "a").otherwise("b").alias("k"))
    pairs = linking.blocked_pairs(d, {"B": F.col("k")}, "id")
    assert pairs.count() == 100 * 99 // 2
    assert linking.oversized_blocks(d, {"B": F.col("k")}, "id").first().clusters == 101


def test_metrics_by_hand(spark):
    m = spark.createDataFrame([("c1", "t1"), ("c1", "t1"), ("c1", "t2"), ("c2", "t2")], "cluster string, truth string")
    r = evaluate.cluster_metrics(m).first()
    assert (r.records, r.clusters, r.split_identities, r.impure_clusters) == (4, 2, 1, 1)
    assert math.isclose(r.precision, 1 / 3) and math.isclose(r.recall, 1 / 2) and math.isclose(r.purity, 3 / 4)


def test_csv_round_trip(spark, tmp_path):
    from confluo.sources import systems

    df = spark.createDataFrame([('a "q"', ""), ("two\nlines", "x")], "p string, q string")
    systems.write_csv(df, str(tmp_path / "t"))
    back = systems.read_csv(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def clusters_of(spark, records, edges, barred=()):
    r = spark.createDataFrame(records, "id string, portal array<string>, dob array<string>")
    e = spark.createDataFrame(edges, "left string, right string, score double, rule string, authoritative boolean")
    b = spark.createDataFrame(list(barred), "left string, right string")
    found, decisions = linking.constrained_clusters(r, e, ("score", "left", "right"), ("score",), b)
    return dict(found.collect()), {(x.left, x.right): (x.accepted, x.reason) for x in decisions.collect()}


def test_sets_of_values_conflict_only_if_they_do_not_meet(spark):
    records = [("a", [], ["1990-01-01", "1991-02-02"]), ("b", [], ["1990-01-01"]), ("c", [], ["1999-09-09"])]
    found, decisions = clusters_of(spark, records, [("a", "b", 0.95, "FUZZY", False), ("b", "c", 0.92, "FUZZY", False)])
    assert found == {"a": "a", "b": "a", "c": "c"}
    assert decisions == {("a", "b"): (True, ""), ("b", "c"): (False, "date of birth conflict")}


def test_prohibited_pairs_do_not_meet_through_a_third(spark):
    edges = [("a", "b", 0.97, "FUZZY", False), ("b", "c", 0.95, "FUZZY", False), ("c", "d", 0.93, "FUZZY", False)]
    found, decisions = clusters_of(spark, [(i, [], []) for i in "abcd"], edges, [("c", "a")])
    assert found == {"a": "a", "b": "a", "c": "c", "d": "c"} and decisions["b", "c"] == (False, "prohibited")
