"""Helpers that the training-data operators share.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import on_path, shared_folder

#: The white space that separates words, as a character class of Java and Python patterns.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: smaller than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` frame that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        on_path(df.sparkSession, path, lambda fs, p: fs.delete(p, True))


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of what has been cut.

    Spark removes them once the driver's garbage collector has found the plans
    that made them; without a call they may stay until the job ends.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a word up to which it is hashed in numpy, eight at a time.
_SHORT = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(raw: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches ``raw[a:b]``, each at least a byte long."""
    padded = raw + bytes(8)
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    size = b - a
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at = np.arange(len(a))
    for k in range(0, _SHORT, 8):
        if k:
            at = at[size[at] > k]
        if not len(at):
            break
        out[at] = mix((out[at] ^ eight[a[at] + k] & _MASKS[np.minimum(size[at] - k, 8)]) * np.uint64(0xD1342543DE82EF95))
    for k in np.flatnonzero(size > _SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[a[k] : b[k]])
    return out


def stretches(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; the last value is false."""
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    return edges[::2], edges[1::2]


def numbered(df: DataFrame) -> DataFrame:
    """The frame with its columns named c0, c1, ...: no name can clash with those of an operator."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns (the first of each name); whatever else the input has cannot clash then."""
    at = [df.columns.index(n) for n in names]
    return numbered(df).select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names)])


#: Bytes of texts that an operator takes at once, unless a single text has more.
BATCH_BYTES = 1 << 20


def by_size(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes of texts; a longer text is a slice of its own."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(total)
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right"))
        upto = min(max(upto, at + 1), at + rows)
        yield batch.slice(at, upto - at)
        at = upto


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 256, size: int = BATCH_BYTES) -> DataFrame:
    """``f`` over record batches of at most ``rows`` rows and about ``size`` bytes of texts.

    Batches are cut again on the Python side, so that what ``f`` holds at once
    does not depend on the session's Arrow batch size, nor on how long texts are.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, rows, size):
                if (out := f(part)) is not None:
                    yield out

    return df.mapInArrow(each, schema)


def arrow_groups(
    df: DataFrame, keys: list[str], f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, rows: int = 65536, sort: list[str] | None = None
) -> DataFrame:
    """``f`` over batches of whole key groups, several small groups to a batch.

    Rows are dealt by the keys and sorted, so a group is a run of rows; a run
    that continues in the next batch waits for it.
    """
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *(sort or []))
    index = [df.columns.index(k) for k in keys]

    def changes(t: pa.Table) -> np.ndarray:
        out = np.zeros(t.num_rows, bool)
        out[:1] = True
        for i in index:
            v = t.column(i).combine_chunks().to_numpy(zero_copy_only=False)
            out[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(out)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < rows:
                continue
            t = pa.Table.from_batches(held)
            last = int(changes(t)[-1])
            if last:
                yield from f(t.slice(0, last).combine_chunks().to_batches()[0])
            held = t.slice(last).to_batches()
            n = t.num_rows - last
            rows_left = n
            if rows_left >= rows:  # one long run: look again only when it has doubled
                n = rows - rows_left
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield from f(t.combine_chunks().to_batches()[0])

    return dealt.mapInArrow(each, schema)


def dealt(rows: DataFrame, counts: DataFrame, key: str, by: str, most: int, share: int = 1) -> tuple[DataFrame, list[str]]:
    """``rows`` and the columns to group them by, so that rows of one ``key`` meet in pairs and no group has many times ``most`` rows.

    ``counts`` holds a ``share``-th of the keys, one row each time. Keys with more
    rows are dealt out as all pairs of parts, by a hash of the column ``by``.
    """
    hot = counts.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * share > most)
    hot = cut(hot.select(key, F.ceil(F.col("n") * share * 2 / most).cast("int").alias("parts")))
    if hot.isEmpty():
        return rows, [key]
    parted = rows.join(hot, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64(by), F.col("parts")).cast("int"))
    parted = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return parted.select(*rows.columns, F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q")), [key, "p", "q"]


def runs(columns: list[np.ndarray]) -> np.ndarray:
    """Number of the run of equal rows that each row is in."""
    edge = np.zeros(len(columns[0]), bool)
    edge[:1] = True
    for v in columns:
        edge[1:] |= v[1:] != v[:-1]
    return np.cumsum(edge) - 1


def flatten(parent: np.ndarray) -> None:
    """Let every node name its root."""
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return
        parent[:] = up


def root(parent: np.ndarray, k: int) -> int:
    while (up := int(parent[k])) != k:
        k = up
    return k


#: Shares of all rows from which a key is dealt to several tasks, at most that many keys, and the number of tasks.
HOT_KEYS, HOT_PARTS = 1000, 64


def salted_join(large: DataFrame, small: DataFrame, key: str, salt: str, n: str = "n") -> DataFrame:
    """Inner join on ``key``, of which ``small`` has one row each, with the number of its rows in ``large`` as ``n``.

    Keys with over a thousandth of all rows, a thousand at most, are dealt to several tasks by the column ``salt``.
    """
    small = cut(small)
    hot = small.where(F.col(n) * HOT_KEYS > (small.agg(F.sum(n)).first()[0] or 0)).select(key, F.lit(HOT_PARTS).alias("_parts"))
    many = F.coalesce("_parts", F.lit(1))
    dealt = large.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(salt), many).cast("int")).drop("_parts")
    copies = small.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), many - 1))).drop("_parts", n)
    return dealt.join(copies, [key, "_part"]).drop("_part")


def roots_of(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Smallest index that each of ``n`` nodes reaches over the links ``a``-``b``; a given ``parent`` is updated."""
    parent = np.arange(n) if parent is None else parent
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return parent
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        flatten(parent)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component``: for each node of ``edges`` the smallest node it reaches.

    Large-star and small-star rounds, each cut with a checkpoint; a round only
    aggregates minima (combined before the shuffle) and joins them back, so a
    hub is never gathered, and deal out the links of hubs. Null ends and loops are no links. An empty input
    gives an empty result. Rounds end when the edge set no longer changes.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            )
        seen = state
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = salted_join(both, least, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
