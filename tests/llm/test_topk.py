import random

from kinweave.llm import topk_search

INF, NAN = float("inf"), float("nan")


def slow(rows, queries, k=20):
    import math

    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if queries(i):
            asked[i] = max(v, asked.get(i, v))
    out = []
    for q, w in asked.items():
        best = sorted((-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, v in ok if i != q and len(v) == len(w))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, queries, k=20):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string").repartition(3)
    got = topk_search.search(df, df.where("vec_id % 20 = 0"), k)
    return sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect())


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, [r.choice([-1.5, 0.0, 0.25, 0.51, -0.01]) for _ in range(6)]) for i in range(400)]
    rows += [(None, [1.0] * 6), (900, None), (920, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (940, [NAN] * 6), (960, [INF] * 6), (980, [1.0, 2.0]), (981, [3.0, 4.0]), (1000, []), (1001, [])]
    rows += [(20, [0.5] * 6), (21, [0.25] * 6), (21, [0.25] * 6)]
    for shard, part, block, fan, strip in ((8192, 128, 1024, 16, 256), (50, 1, 5, 2, 3), (20, 4, 7, 2, 256)):
        monkeypatch.setattr(topk_search, "SHARD", shard)
        monkeypatch.setattr(topk_search, "PART", part)
        monkeypatch.setattr(topk_search, "STRIP", strip)
        monkeypatch.setattr(topk_search, "BLOCK", block)
        monkeypatch.setattr(topk_search, "FAN", fan)
        assert run(spark, rows, lambda i: i % 20 == 0) == slow(rows, lambda i: i % 20 == 0)


def test_large_components(spark):
    rows = [(0, [1e18, 1.0]), (1, [1e18, 1.0]), (2, [-1e18, 1.0]), (20, [1e7, 1e7]), (3, [3e7, 1.0]), (4, [1.0, 3e7])]
    import numpy as np

    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows, lambda i: i % 20 == 0) == slow(rows, lambda i: i % 20 == 0)


def test_empty(spark):
    assert run(spark, [], None) == [] and run(spark, [(0, [1.0])], None) == []


def test_repeated_queries_against_the_sql(spark, tmp_path):
    """A repeated query id is asked once, with its largest vector, here and in the SQL."""
    import duckdb
    import pandas as pd

    from kinweave.llm import queries

    r = random.Random(3)
    rows = [(i % 70, [r.choice([-1.0, 0.5, 0.25, 2.0]) for _ in range(4)]) for i in range(150)] + [(20, None), (40, [1.0, NAN, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.OP1_SQL).fetchall()
    got = queries.op1_topk_search(spark, str(tmp_path)).collect()
    assert sorted(tuple(x) for x in got) == sorted(want) and pd.Series([x[0] for x in want]).nunique() == 4
