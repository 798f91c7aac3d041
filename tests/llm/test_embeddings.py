import duckdb
import numpy as np

from loomframe.llm import embeddings
from loomframe.llm.common import roots_of

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, least=0.98):
    n, parent, ids = {}, np.arange(len(rows)), [r[0] for r in rows]
    count = np.zeros(len(rows), int)
    good = [r[2] is not None and r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                    count[i] += 1
                    count[j] += 1
                    parent = roots_of(len(rows), np.array([i]), np.array([j]), parent)
    del n
    return [(ids[i], int(count[i]), ids[i] if ids[i] is None else min(ids[k] for k in range(len(rows)) if parent[k] == parent[i])) for i in range(len(rows))]


def test_odd_vectors(spark):
    rng = np.random.default_rng(0)
    v = [float(x) for x in rng.normal(size=5)]
    near = [x + 0.01 for x in v]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, near, 0), (4, v, 1), (5, v, None), (None, v, 0), (6, None, 0), (7, [0.0] * 5, 0), (8, [None] * 5, 0), (9, [float("nan")] * 5, 0), (10, [float("inf")] * 5, 0), (11, v[:3], 0), (12, [], 0), (13, [x * 1e-30 for x in v], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.vec_id, r.n_links, r.component_id) for r in embeddings.linked(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    kept = {r.vec_id: r.kept for r in embeddings.linked(df).collect()}
    assert kept[1] and not kept[2] and not kept[3] and kept[6] and kept[None] is False
    assert embeddings.linked(df.limit(0)).collect() == []
    extra = df.selectExpr("1 AS rep", "2 AS h1", "3 AS code", "*")
    assert sorted(map(repr, embeddings.linked(extra).collect())) == sorted(map(repr, embeddings.linked(df).collect()))


def test_groups_against_brute_force(spark):
    """Copies, dense groups over several blocks, and pairs right at the bound."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 64))
    rows, k = [], 0
    for i, b in enumerate(base):
        for scale in (0.0, 0.0, 0.05, 0.1, 0.15, 0.19):
            rows.append((k, [float(x) for x in b + scale * rng.normal(size=64)], i % 3))
            k += 1
    for _ in range(120):
        rows.append((k, [float(x) for x in base[0] + 0.05 * rng.normal(size=64)], 0))
        k += 1
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.linked(df).collect())
    assert got == want
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.linked(df, block=16).collect()) == want


def test_recall_at_the_bound():
    """Pairs with a cosine of just 0.98 share a bucket nearly always."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    a, b = embeddings.buckets(x), embeddings.buckets(y)
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() > 0.999
    r = next(embeddings.rotations(x, 1))
    assert np.allclose(np.linalg.norm(r, axis=1), 1)


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    df = embeddings.op5_embeddings(spark, sf_dir)
    rel = con.sql(embeddings.ORACLE).order("vec_id")
    assert df.columns == rel.columns and sorted(map(tuple, df.collect())) == rel.fetchall()
