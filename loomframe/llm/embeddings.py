"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by pseudo-random rotations (three rounds of random signs and a
fast Hadamard transform); the axis it lies closest to, with its sign, is its cell.
Two rotations make a bucket, and each of ``tables`` tables puts a vector into its
``probes`` likeliest buckets. Pairs that share a bucket and a label are verified
by cosine in double precision, in blocks; a pair counts in the first bucket that
it shares, so sums over buckets are exact. Equal vectors are one row with a
multiplicity, and links leave a task as sums and a spanning forest, never as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_groups, arrow_map, connected_components, cut, own_columns, roots_of, table

COSINE = 0.98
TABLES, PROBES, NEAREST = 5, 4, 4
#: Rows of a block; a bucket with more is dealt out as pairs of blocks.
BLOCK = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotations(x: np.ndarray, count: int, seed: int = 7) -> Iterator[np.ndarray]:
    """``count`` pseudo-random rotations of the rows, padded to a power of two."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), d))
    padded[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(count):
        y = padded
        for _ in range(3):
            y = hadamard(y * rng.choice((-1.0, 1.0), d))
        yield y


def buckets(x: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Bucket codes, shape (rows, tables * probes), of unit rows; a code holds its table."""
    near, cells, gaps = NEAREST, [], []
    for y in rotations(x, 2 * tables):
        both = np.concatenate((y, -y), axis=1)
        top = np.argpartition(-both, near - 1, axis=1)[:, :near]
        value = np.take_along_axis(both, top, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        cells.append(np.take_along_axis(top, order, 1))
        value = np.take_along_axis(value, order, 1)
        gaps.append((value[:, :1] - value) ** 2)
    width = 2 * (1 << max(1, (x.shape[1] - 1).bit_length()))
    out = []
    for t in range(tables):
        cost = (gaps[2 * t][:, :, None] + gaps[2 * t + 1][:, None, :]).reshape(len(x), -1)
        code = (cells[2 * t][:, :, None].astype(np.int64) * width + cells[2 * t + 1][:, None, :]).reshape(len(x), -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        out.append(np.take_along_axis(code, best, 1) + t * width * width)
    return np.concatenate(out, axis=1)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def linked(vectors: DataFrame, least: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector.

    Only vectors of equal, non-null labels and equal length are compared. Vectors
    that are null, zero, or hold null or non-finite components, and rows with a
    null id, link with nothing: no links, and their own id as component. Equal
    rows link with each other; an empty table gives an empty result.
    """
    rows = own_columns(vectors, id_col, vector_col, label_col).toDF("id", "vec", "label")
    v = F.col("vec")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = v.isNotNull() & F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)
    good = F.coalesce(good, F.lit(False))
    keyed = rows.select("id", "label", "vec", F.when(good, F.xxhash64("vec")).alias("h1"), F.when(good, F.xxhash64(F.lit(1), "vec")).alias("h2"))
    reps = keyed.where("h1 is not null").groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.first("vec").alias("v"))
    reps = cut(reps.select("rep", "label", "mult", "v", "h1", "h2", F.size("v").alias("d")))
    id_kind = reps.schema["rep"].dataType.simpleString()

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = batch.column(2).to_numpy()
        codes: list = [None] * batch.num_rows
        for n in np.unique(d):
            at = np.flatnonzero(d == n)
            x = _matrix(batch.column(1).take(pa.array(at)), int(n))
            x /= np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) * np.abs(x).max(axis=1, keepdims=True)
            for i, c in zip(at, buckets(x, tables, probes)):
                codes[i] = c
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.list_(pa.int64()))], ["rep", "codes"])

    codes = cut(arrow_map(reps.select("rep", "v", "d"), hashed, f"rep {id_kind}, codes array<bigint>", 4096).join(reps.select("rep", "label", "d"), "rep"))
    slots = codes.select("rep", "label", "d", F.explode("codes").alias("code"))
    counts = slots.groupBy("label", "d", "code").agg(F.count("*").alias("n")).where("n > 1")
    shared = slots.join(counts, ["label", "d", "code"]).select("rep", "label", "d", "code", F.ceil(F.col("n") / block).cast("int").alias("nb"))
    mine = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")
    dealt = shared.select("rep", "label", "d", "code", mine.alias("mine"), other)
    dealt = dealt.select("rep", "label", "d", "code", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), "mine")
    dealt = dealt.join(codes.select("rep", "codes"), "rep").join(reps.select("rep", "mult", "v"), "rep")
    dealt = dealt.select("label", "d", "code", "b1", "b2", "mine", "rep", "mult", "codes", "v")

    def verified(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = np.column_stack([_rank(batch.column(i)) for i in range(5)])
        edges = np.flatnonzero(np.concatenate(([True], (np.diff(keys, axis=0) != 0).any(axis=1))))
        ends = np.append(edges[1:], batch.num_rows)
        d_all, code_all, b1, b2, mine_all = (batch.column(i).to_numpy() for i in (1, 2, 3, 4, 5))
        mult_all = batch.column(7).to_numpy()
        sums = np.zeros(batch.num_rows, np.int64)
        root = np.arange(batch.num_rows)
        for a, b in zip(edges, ends):
            if b - a < 2:
                continue
            d = int(d_all[a])
            x = _matrix(batch.column(9).slice(a, b - a), d)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            own = _matrix_int(batch.column(8).slice(a, b - a))
            mine, mult = mine_all[a:b], mult_all[a:b]
            first = np.flatnonzero(mine == b1[a])
            second = first if b1[a] == b2[a] else np.flatnonzero(mine == b2[a])
            parent = np.arange(b - a)
            for at in range(0, len(first), 512):
                f = first[at : at + 512]
                i, j = np.nonzero(x[f] @ x[second].T >= least)
                i, j = f[i], second[j]
                if b1[a] == b2[a]:
                    i, j = i[i < j], j[i < j]
                for s in range(0, len(i), 1 << 15):
                    p, q = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
                    ok = _first_shared(own[p], own[q]) == code_all[a]
                    p, q = p[ok], q[ok]
                    np.add.at(sums, a + p, mult[q])
                    np.add.at(sums, a + q, mult[p])
                    parent = roots_of(b - a, p, q, parent)
            root[a:b] = parent + a
        hit = np.flatnonzero(sums > 0)
        rep = batch.column(6)
        yield pa.RecordBatch.from_arrays([rep.take(pa.array(hit)), pa.array(sums[hit]), rep.take(pa.array(root[hit]))], ["rep", "n", "root"])

    found = cut(arrow_groups(dealt, ["label", "d", "code", "b1", "b2"], verified, f"rep {id_kind}, n bigint, root {id_kind}", 8192))
    sums = found.groupBy("rep").agg(F.sum("n").alias("n"))
    classes = connected_components(found.select("rep", "root").distinct(), "rep", "root").withColumnRenamed("node", "rep")
    info = reps.select("rep", F.col("label").alias("_label"), "h1", "h2", "mult").join(sums, "rep", "left").join(classes, "rep", "left")
    info = info.select("_label", F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = keyed.drop("vec").join(info, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("label") == F.col("_label")), "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _rank(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where the values are."""
    return np.unique(column.to_numpy(zero_copy_only=False), return_inverse=True)[1]


def _matrix_int(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest code that both rows of a pair hold."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for k in range(b.shape[1]):
        same = a == b[:, k : k + 1]
        out = np.where(same.any(axis=1), np.minimum(out, b[:, k]), out)
    return out


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
good AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda a: a IS NULL OR isnan(a) OR isinf(a))) = 0 AND len(list_filter(x, lambda a: a <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN low ON low.a = v.vec_id
"""
