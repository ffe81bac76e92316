import duckdb
import numpy as np
import pytest

from confluo.llm import registry


def same(spark, folder, query):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        if (folder / f"{t}.parquet").exists():
            con.sql(f"create view {t} as from '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(registry.ORACLE_SQL[query]).df()
    got = registry.QUERIES[query](spark, str(folder)).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    listed = lambda d: sorted(tuple(map(str, r)) for r in d[columns].itertuples(index=False, name=None))
    assert listed(got) == listed(want)
    return want


def test_embeddings_equal_sql(spark, tmp_path):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(40, 16))
    rows = []
    for i in range(240):
        near = base[i % 40] + draw.normal(size=16) * 0.05 * (i % 5)
        rows.append((i, [float(x) for x in near], i % 2))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 1), (302, [0.0] * 16, 0), (303, None, 0), (304, [], 0), (305, rows[0][1], None), (306, [float("nan")] + [1.0] * 15, 0), (307, [None] + [1.0] * 15, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = same(spark, tmp_path, "op8_embeddings")
    assert want.n_links.sum() > 100 and want[want.vec_id >= 302].n_links.sum() == 0


@pytest.mark.parametrize("copies", [1, 2])
def test_suffix_dedup_equals_sql(spark, tmp_path, copies):
    draw = np.random.default_rng(copies)
    text = lambda n: "".join(draw.choice(list("abcdé \n"), n))
    passage, edge = text(450), "y" * 399
    texts = [text(700) + passage + text(300), passage + text(500), text(200) + passage, edge, "y" * 400, "y" * 401, "", None, text(900)] * copies
    short = passage.encode()[:390].decode(errors="ignore")  # a repeat of under 400 bytes stays
    texts += ["same start " + short, text(5_000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = same(spark, tmp_path, "op10_suffix_dedup")
    assert (want.n_removed > 0).sum() >= 4 and (want[want.doc_id >= len(texts) - 2].n_removed == 0).all()
