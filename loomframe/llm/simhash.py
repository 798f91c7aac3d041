"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints that differ in at most ``budget`` bits agree in one of budget + 1
blocks of bits. For each block the fingerprints are rotated so that the block
comes first; the upper levels of the trie, the block, are then descended with
equal bits only, which is the shuffle key. Below it pairs of nodes are traversed
together: each step adds the bits in which the two differ, and a pair is pruned
as soon as the sum exceeds the budget. Links become a spanning forest in the
task that finds them, so no group of copies is written out as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_groups, arrow_map, connected_components, cut, dealt, flatten, mix, numbered, own_columns, root, roots_of, runs, salted_join, table

SEED = 42
WIDTH = 3
BUDGET = 2
#: Texts of a group of candidates, or keys of a subtree, from which they are dealt out
#: as pairs of parts, and the share of keys that such subtrees are found from.
HOT_TEXTS, HOT_KEYS, HOT_SHARE = 512, 1 << 17, 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Node pairs that are expanded at once.
PAIRS = 1 << 18
#: Two nodes with at most this product of sizes are compared key by key.
SMALL = 64


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the word shingles of ``text``, in order; of fewer words, one of them all; none without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(length) - 1
    starts = (ends - length + 1).tolist()
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, n)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64-bit SimHash of the word shingles of ``text``; 0 without words."""
    h = shingles(text, width)
    n = len(h)
    count = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        count += np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id, th, fp``: hash and fingerprint of every text as signed longs; null text counts as empty."""
    source = own_columns(docs, id_col, text_col).toDF(id_col, "text").withColumn("th", F.xxhash64("text"))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(x, width) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp)], [id_col, "th", "fp"])

    return arrow_map(source, f, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, th bigint, fp bigint", 512)


def blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, number of bits) of budget + 1 blocks of 64 bits."""
    n = budget + 1
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def trie_links(keys: np.ndarray, group: np.ndarray, top: int, budget: int, parent: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of keys of the same group that differ in at most ``budget`` bits.

    ``keys`` are distinct within a group and sorted within it; keys of a group
    agree in their ``top`` first bits; groups are runs. A node is a range of the
    sorted keys, so its children are found by counting ones.

    With ``parent``, the component of each key as far as the caller knows it, pairs
    whose keys are all in one component already are not looked at: a dense group
    then costs about as much as it has keys, not as it has pairs.
    """
    edges = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if len(group) else 0))
    lo, hi = edges, np.append(edges[1:], len(keys))
    many = hi - lo > 1
    lo, hi = lo[many].astype(np.int64), hi[many].astype(np.int64)
    ones: dict[int, np.ndarray] = {}
    stack = [(63 - top, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, diff = stack.pop()
        if not len(alo):
            continue
        if len(alo) > PAIRS:
            for at in range(0, len(alo), PAIRS):
                s = slice(at, at + PAIRS)
                stack.append((bit, alo[s], ahi[s], blo[s], bhi[s], diff[s]))
            continue
        if parent is not None and len(alo) >= 256:
            changes = np.concatenate(([0], np.cumsum(parent[1:] != parent[:-1])))
            known = (changes[alo] == changes[ahi - 1]) & (changes[blo] == changes[bhi - 1]) & (parent[alo] == parent[blo])
            alo, ahi, blo, bhi, diff = (x[~known] for x in (alo, ahi, blo, bhi, diff))
            if not len(alo):
                continue
        small = (ahi - alo) * (bhi - blo) <= SMALL
        if bit < 0:
            small[:] = True
        if small.any():
            yield from _compare(keys, alo[small], ahi[small], blo[small], bhi[small], budget)
            alo, ahi, blo, bhi, diff = (x[~small] for x in (alo, ahi, blo, bhi, diff))
            if not len(alo):
                continue
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        one = ones[bit]
        amid, bmid = ahi - (one[ahi] - one[alo]), bhi - (one[bhi] - one[blo])
        same = alo == blo
        parts = [
            (alo, amid, blo, bmid, diff, None),
            (amid, ahi, bmid, bhi, diff, None),
            (alo, amid, bmid, bhi, diff + 1, None),
            (amid, ahi, blo, bmid, diff + 1, ~same),
        ]
        out = [[] for _ in range(5)]
        for p in parts:
            keep = (p[0] < p[1]) & (p[2] < p[3]) & (p[4] <= budget)
            keep &= ~((p[0] == p[2]) & (p[1] - p[0] < 2))
            if p[5] is not None:
                keep &= p[5]
            for o, x in zip(out, p):
                o.append(x[keep])
        stack.append((bit - 1, *(np.concatenate(o) for o in out)))


def _compare(keys, alo, ahi, blo, bhi, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    cells = (ahi - alo) * (bhi - blo)
    at = 0
    while at < len(cells):
        upto = at + max(1, int(np.searchsorted(np.cumsum(cells[at:]), 1 << 20, "right")))
        n = cells[at:upto]
        node = np.repeat(np.arange(at, upto), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        w = (bhi - blo)[node]
        i, j = alo[node] + k // w, blo[node] + k % w
        ok = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
        if ok.any():
            yield i[ok], j[ok]
        at = upto


def links(prints: DataFrame, budget: int = BUDGET, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``src, dst``: a spanning forest of the links between the distinct values of ``fp``.

    Blocks that very many fingerprints share are dealt out as pairs of parts.
    """
    cuts = blocks(budget)
    rotated = []
    for first, bits in cuts:
        key = F.col("fp") if first == 0 else F.shiftleft("fp", first).bitwiseOR(F.shiftrightunsigned("fp", 64 - first))
        block = F.shiftrightunsigned(key, 64 - bits)
        rotated.append(F.struct(F.xxhash64(F.lit(first), block).alias("place"), F.lit(first).alias("first"), block.alias("block"), key.alias("key")))
    rows = prints.select("fp").distinct().select(F.inline(F.array(*rotated)))
    some = prints.where(F.pmod(F.xxhash64("fp"), F.lit(HOT_SHARE)) == 0).select("fp").distinct().select(F.inline(F.array(*rotated))).select("place")
    rows, by = dealt(rows, some, "place", "key", hot_keys, HOT_SHARE)
    bits_of = dict(cuts)

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first = batch.column(1).to_numpy()
        keys = batch.column(3).to_numpy().view(np.uint64)
        group = runs([batch.column(i).to_numpy() for i in (0, 1, 2, *range(4, batch.num_columns))])
        src, dst = [], []
        for start in np.unique(first):
            at = np.flatnonzero(first == start)
            k, b = keys[at], group[at]
            order = np.lexsort((k, b))
            k, b = k[order], b[order]
            parent = np.arange(len(k))
            for i, j in trie_links(k, b, bits_of[int(start)], budget, parent):
                roots_of(len(k), i, j, parent)
            child = np.flatnonzero(parent != np.arange(len(k)))
            s = int(start)
            back = k if s == 0 else (k >> np.uint64(s)) | (k << np.uint64(64 - s))
            src.append(back[child])
            dst.append(back[parent[child]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (src, dst)], ["src", "dst"])

    return arrow_groups(rows, by, f, "src bigint, dst bigint", sort=["first", "block"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, budget: int = BUDGET) -> DataFrame:
    """``doc_id, th, fp, root, component_id`` of every document; ``root`` names its group of fingerprints.

    ``component_id`` is the smallest id that a document reaches over links of
    fingerprints with ``budget`` or fewer differing bits (null ids are passed
    over; null if all are null). Null, empty and word-less texts have fingerprint
    0 and link like any other. Repeated rows are kept; an empty table gives none.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    least = prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n"))
    groups = connected_components(links(prints, budget))
    named = least.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("root"))
    named = cut(named)
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    named = salted_join(named, lowest, "root", "fp", "m").select("fp", "n", "root", "component_id")
    return salted_join(prints, named, "fp", "th").select(id_col, "th", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, budget: int = BUDGET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document, as in ``classes``."""
    found = classes(docs, id_col, text_col, width, budget)
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, budget: int = BUDGET) -> DataFrame:
    """One document of each group, all columns as they are: the smallest id, and of its rows one."""
    found = classes(own_columns(docs, id_col, text_col).toDF("id", "text"), "id", "text", width, budget).where(F.col("id").eqNullSafe(F.col("component_id")))
    kept = found.groupBy("root").agg(F.min(F.struct("id", "th")).alias("s")).select(F.col("s.id").alias("kept_id"), F.col("s.th").alias("kept_th"))
    return _rows_of(docs, kept, id_col, text_col)


def _rows_of(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each ``kept_id, kept_th``."""
    names = docs.columns
    i, t = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    keyed = numbered(docs).withColumn("key", F.xxhash64(t))
    rows = keyed.join(kept, (F.col("key") == F.col("kept_th")) & i.eqNullSafe(F.col("kept_id")), "left_semi")
    first = Window.partitionBy("key", i).orderBy(F.lit(0))
    return rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").select(*[f"c{k}" for k in range(len(names))]).toDF(*names)


#: Words of the shingles and least Jaccard similarity of near copies.
SIMILAR_WIDTH, SIMILAR = 5, 0.8
#: Bits of their fingerprints, two words, in which texts of that similarity differ at most (in all but one of 200 cases).
SIMILAR_BUDGET = 30
#: Share of the pairs at that similarity which may fail to meet, and keys that a subtree should hold at most.
MISSED, SUBTREE, LEAST_LEVELS = 0.02, 64, 12


def wide_fingerprint(shingle: np.ndarray) -> tuple[int, int]:
    """128-bit SimHash of different shingles, ties as in the least of them; 0 without any."""
    out = []
    for h in (shingle, mix(shingle + np.uint64(SEED))):
        if not len(h):
            return 0, 0
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 65536):
            ones += np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        tie = np.unpackbits(h[:1].astype(">u8").view(np.uint8))
        out.append(int(np.packbits(2 * ones + tie > len(h)).view(">u8")[0]))
    return out[0], out[1]


def tries(n: int, least: float = SIMILAR) -> list[tuple[int, int]]:
    """Masks of the upper levels of each trie, two words, for ``n`` fingerprints.

    A trie takes the bits in an order of its own. Its upper levels are descended with
    equal bits only and are the shuffle key, so that a subtree holds a bounded number
    of keys; there are as many tries as let all but ``MISSED`` of the pairs at a
    similarity of ``least`` share a subtree of one of them.
    """
    levels = max(LEAST_LEVELS, (n // SUBTREE).bit_length())
    same = 1 - math.acos(2 * least / (1 + least)) / math.pi  # chance that a bit is the same at equal sizes
    count = math.ceil(math.log(MISSED) / math.log1p(-(same**levels)))
    rng = np.random.default_rng(20_240_604)
    out = []
    for _ in range(count):
        bits = rng.choice(128, levels, replace=False).tolist()
        out.append(tuple(sum(1 << b % 64 for b in bits if b // 64 == w) for w in (0, 1)))
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of shingles; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def similar_links(prints: DataFrame, texts: DataFrame, width: int, least: float, hot_texts: int = HOT_TEXTS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``src, dst``: a spanning forest of the links between the distinct texts in ``prints`` (th, id, f0, f1)."""
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")
    places = [F.xxhash64(F.lit(t), F.col("f0").bitwiseAND(signed(a)), F.col("f1").bitwiseAND(signed(b))) for t, (a, b) in enumerate(tries(prints.count(), least))]
    placed = lambda rows: rows.select(F.explode(F.array(*places)).alias("place"), "th", "f0", "f1")
    some = placed(prints.where(F.pmod(F.xxhash64("th"), F.lit(HOT_SHARE)) == 0)).select("place")
    rows, by = dealt(placed(prints), some, "place", "th", hot_keys, HOT_SHARE)

    def met(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        th, f0, f1 = (batch.column(i).to_numpy().view(np.uint64) for i in (1, 2, 3))
        group = runs([batch.column(i).to_numpy() for i in (0, *range(4, batch.num_columns))])
        order = np.lexsort((f0, group))
        th, f0, f1, group = th[order], f0[order], f1[order], group[order]
        parent = np.arange(len(th))
        for i, j in trie_links(f0, group, 0, SIMILAR_BUDGET, parent):
            near = np.bitwise_count(f0[i] ^ f0[j]) + np.bitwise_count(f1[i] ^ f1[j]) <= SIMILAR_BUDGET
            roots_of(len(th), i[near], j[near], parent)
        # Texts that meet in several subtrees are one group of candidates, known by its members.
        hit = np.bincount(parent, minlength=len(th))[parent] > 1
        name = np.zeros(len(th), np.uint64)
        np.add.at(name, parent[hit], mix(th[hit]))
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (th[hit], name[parent[hit]])], ["th", "name"])

    members = cut(arrow_groups(rows, by, met, "th bigint, name bigint").distinct())
    rows, by = dealt(members, members.select("name"), "name", "th", hot_texts)
    held = rows.groupBy("th").agg(F.collect_list(F.struct(*by)).alias("in")).join(prints, "th")
    held = held.join(texts.toDF("d", "text", "k"), F.col("d").eqNullSafe(F.col("id")) & (F.col("k") == F.col("th"))).dropDuplicates(["th"])
    held = held.select("th", "f0", "f1", "text", F.inline("in"))

    def verified(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        th, f0, f1 = batch.column(0).to_numpy(), *(batch.column(i).to_numpy().view(np.uint64) for i in (1, 2))
        group = runs([batch.column(i).to_numpy() for i in range(4, batch.num_columns)])
        src, dst = [], []
        edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group)).tolist()
        for lo, hi in zip(edges, edges[1:]):
            sets = [np.unique(shingles(x, width)) for x in batch.column(3).slice(lo, hi - lo).to_pylist()]
            size = np.array([len(x) for x in sets])
            parent = np.arange(hi - lo)
            for i in range(hi - lo - 1):
                apart = i + 1 + np.flatnonzero(parent[i + 1 :] != parent[i])
                if not len(apart) and (parent == parent[0]).all():
                    break
                bits = np.bitwise_count(f0[lo + apart] ^ f0[lo + i]) + np.bitwise_count(f1[lo + apart] ^ f1[lo + i])
                for j in apart[(bits <= SIMILAR_BUDGET) & (np.minimum(size[apart], size[i]) >= least * np.maximum(size[apart], size[i]))].tolist():
                    a, b = sorted((root(parent, i), root(parent, j)))
                    if a != b and similarity(sets[i], sets[j]) >= least:
                        parent[b] = a
                        src.append(th[lo + i])
                        dst.append(th[lo + j])
                flatten(parent)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (src, dst)], ["src", "dst"])

    return arrow_groups(held, by, verified, "src bigint, dst bigint", 256)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SIMILAR_WIDTH, least: float = SIMILAR, hot_texts: int = HOT_TEXTS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """One document of each group of texts linked by a shingle similarity of ``least`` or more, all columns as they are.

    Texts meet by the trie join of 128-bit SimHashes of their different shingles,
    with as wide a budget as the similarity asks for, and are then compared exactly.
    The smallest id stays, of its rows one. Wordless and null texts are equal.
    """
    texts = own_columns(docs, id_col, text_col).toDF("id", "text").withColumn("th", F.xxhash64("text"))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = np.array([wide_fingerprint(np.unique(shingles(x, width))) for x in batch.column(1).to_pylist()], np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(both[:, 0]), pa.array(both[:, 1])], ["id", "th", "f0", "f1"])

    kind = texts.schema["id"].dataType.simpleString()
    prints = arrow_map(texts, f, f"id {kind}, th bigint, f0 bigint, f1 bigint", 512)
    # Null ids come last.
    prints = cut(prints.groupBy("th").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id")).alias("s"), F.min("f0").alias("f0"), F.min("f1").alias("f1")).select("th", "s.id", "f0", "f1"))
    groups = cut(connected_components(similar_links(prints, texts, width, least, hot_texts, hot_keys))).withColumnRenamed("node", "th")
    named = prints.select("id", "th").join(groups, "th", "left").select("id", "th", F.coalesce("component", "th").alias("root"))
    kept = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th")).alias("s")).select(F.col("s.id").alias("kept_id"), F.col("s.th").alias("kept_th"))
    return _rows_of(docs, kept, id_col, text_col)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
