"""Fuzzy line dedup.

Lines are normalised (lower case; ASCII punctuation and white space only separate
words). Equal ones are merged by a 128-bit hash; the rest get a SimHash of eight
blocks: a word belongs to the block that its hash names, and a block is the 64-bit
SimHash of its words. Words that differ touch their own blocks only, so by the
pigeonhole principle lines with few other words agree in whole blocks, which are
the join keys; blocks with few characters are taken together with those after them,
and lines of few words are joined by all of their words but one. Pairs that meet
link if the 64-bit SimHashes of the whole lines differ in at most 16 bits and the
normalised texts have an edit similarity of 0.8 or more. Of each connected group
the occurrence in the smallest document, then line, stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, arrow_groups, arrow_map, connected_components, cut, dealt, discard, flatten, mix, numbered, own_columns, release, root, roots_of, runs, salted_join, stored, stretches, table, word_hashes

SIMILARITY = 0.8
#: Bits in which the SimHashes of linked lines may differ; from 17 on, lines with other words in most places would link.
BITS = 16
#: Blocks of a SimHash, and characters that the words behind a join key have at least.
BLOCKS, KEY_CHARS = 8, 20
#: Lines of up to so many different words are joined by all of them but one, if so many are left.
HOLES, LEFT = 8, 3
#: Lines with fewer words link only if they are equal.
MIN_WORDS = 5
#: Of those, lines with fewer characters (normalised) are never removed.
EXACT_CHARS = 32
#: Lines with one join key from which they are dealt out as pairs of parts, and the share of lines that such keys are found from.
HOT_ROWS, HOT_SHARE = 1 << 17, 64
#: Bytes that make up words: ASCII letters and digits, and all of non-ASCII characters.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Candidate pairs that are looked at together.
PAIRS = 1 << 19
#: Keys of a run from which it is gone through key by key.
LONG_RUN = 512
#: Lines of a group of candidates from which they are dealt out as pairs of parts.
HOT_TEXTS = 1024
#: Lines whose words are sorted together.
LINES = 1 << 15
_BLOCK = np.random.default_rng(20_240_603).integers(1, 1 << 63, BLOCKS, np.uint64) * np.uint64(2) + np.uint64(1)


def normalise(line: str) -> bytes:
    """The words of a line in lower case, with single spaces."""
    return b" ".join(_WORDS.findall(line.lower().encode("utf-8", "surrogatepass")))


def _lanes(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Ones of each bit in the runs of hashes from ``start`` on: one word of eight one-byte counters for each bit of a byte.

    Over 255 hashes the counters of a run flow over into each other, always alike.
    """
    low = np.uint64(0x0101010101010101)
    return np.stack([np.add.reduceat((h >> np.uint64(j)) & low, start) for j in range(8)])


def _majority(lanes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """SimHashes from counters of ones (bit within a byte, row) among ``of`` hashes."""
    out = np.zeros((lanes.shape[1], 8), np.uint8)
    half = np.minimum(of // 2, 255).astype(np.uint8)[:, None]
    for j in range(8):
        out |= (lanes[j].view(np.uint8).reshape(-1, 8) > half).view(np.uint8) << np.uint8(j)
    return out.view("<u8").ravel()


def _majority_of(h: np.ndarray) -> int:
    """SimHash of any number of hashes."""
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def simhashes(word: np.ndarray, chars: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SimHash of each of the ranges of word hashes; 32-bit join keys, one line after the other, and how many each has."""
    out = [_simhashes(word, chars, lo[at : at + LINES], hi[at : at + LINES]) for at in range(0, len(lo), LINES)]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))


def _simhashes(word: np.ndarray, chars: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, lines = hi - lo, len(lo)
    line = np.repeat(np.arange(lines), n)
    at = np.arange(len(line)) + np.repeat(lo - (np.cumsum(n) - n), n)
    # Different words of each line, by block: line, hash (its first three bits name the block), length.
    words = np.sort(line.astype(np.uint64) << np.uint64(49) | word[at] >> np.uint64(21) << np.uint64(6) | np.minimum(chars[at], 63).astype(np.uint64))
    words = words[np.concatenate(([True], words[1:] != words[:-1]))]
    line = (words >> np.uint64(49)).astype(np.int64)
    cell = (words >> np.uint64(46)).astype(np.int64)
    h = mix(words & np.uint64((1 << 49) - 1))
    many = np.bincount(cell, minlength=BLOCKS * lines)
    length = np.bincount(cell, (words & np.uint64(63)).astype(np.int64), BLOCKS * lines).astype(np.int64).reshape(lines, BLOCKS)
    full = np.flatnonzero(many)
    lanes = _lanes(h, (np.cumsum(many) - many)[full])
    block = np.zeros(BLOCKS * lines, np.uint64)
    block[full] = _majority(lanes, many[full])
    lanes = np.add.reduceat(lanes, np.searchsorted(full, BLOCKS * np.arange(lines)), axis=1)
    many = many.reshape(lines, BLOCKS)
    size = many.sum(axis=1)
    ends = np.cumsum(size)
    sim = _majority(lanes, size)
    for k in np.flatnonzero(size > 255).tolist():
        sim[k] = _majority_of(h[ends[k] - size[k] : ends[k]])

    # From each block on, as many blocks as have enough characters.
    twice = lambda x: np.concatenate((np.zeros((lines, 1), x.dtype), np.cumsum(np.concatenate((x, x), axis=1), axis=1, dtype=x.dtype)), axis=1)
    upto, sums = twice(length), twice(mix(block.reshape(lines, BLOCKS) * _BLOCK) * (many > 0))
    row = np.arange(lines)
    keys = np.zeros((lines, BLOCKS), np.uint64)
    for c in range(BLOCKS):
        w = np.minimum((upto[:, c + 1 : c + BLOCKS + 1] - upto[:, c : c + 1] < KEY_CHARS).sum(axis=1), BLOCKS - 1) + 1
        keys[:, c] = (sums[row, c + w] - sums[:, c]) * ((many[:, c] > 0) & (size >= HOLES))
    keys.sort(axis=1)
    good = keys != 0
    good[:, 1:] &= keys[:, 1:] != keys[:, :-1]
    which, found = [np.nonzero(good)[0]], [mix(keys[good])]

    short = size <= HOLES
    which.append(np.flatnonzero(short))
    found.append(mix(sim[short]))
    at = np.flatnonzero((short & (size > LEFT))[line])
    own = line[at]
    which.append(own)
    less = np.stack([lanes[j, own] - ((h[at] >> np.uint64(j)) & np.uint64(0x0101010101010101)) for j in range(8)])
    found.append(mix(_majority(less, size[own] - 1)))
    which = np.concatenate(which)
    found = (np.concatenate(found)[np.argsort(which, kind="stable")] >> np.uint64(32)).astype(np.uint32)
    return sim, found, np.bincount(which, minlength=lines)


def _parts(texts: list[str | None]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text number, first line, bytes) of whole lines, about as many as an operator takes at once."""
    held, size = [], 0
    for k, x in enumerate(texts):
        raw, line = (x or "").lower().encode("utf-8", "surrogatepass"), 0
        while len(raw) > 2 * BATCH_BYTES and (end := raw.find(b"\n", BATCH_BYTES)) >= 0:
            yield [(k, line, raw[:end])]
            line += raw.count(b"\n", 0, end) + 1
            raw = raw[end + 1 :]
        held.append((k, line, raw))
        size += len(raw)
        if size > BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def scan(texts: list[str | None], min_words: int, exact_chars: int | None = None) -> tuple[np.ndarray, ...]:
    """Of each line with enough words: text number, line number, 128-bit hash (16 bytes), SimHash; its join keys and their number; characters.

    With ``exact_chars``, lines with fewer words but so many characters come without keys.
    """
    out = [_scan(parts, min_words, exact_chars) for parts in _parts(texts)]
    return tuple(np.concatenate(x) for x in zip(*out))


def _scan(parts: list[tuple[int, int, bytes]], min_words: int, exact_chars: int | None) -> tuple[np.ndarray, ...]:
    joined = b"\n".join(raw for *_, raw in parts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    part_end = np.cumsum(np.fromiter((len(raw) + 1 for *_, raw in parts), np.int64, len(parts)))
    ends = np.flatnonzero(data == 0x0A)
    inside = _IN_WORD.take(data)
    a, b = stretches(inside)
    upto = np.searchsorted(a, ends)  # words before the end of each line
    size = np.diff(upto, prepend=0)
    keyed = size >= max(1, min_words)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)))
    wide = chars[b] - chars[a]
    upto_chars = np.concatenate(([0], np.cumsum(wide)))
    length = upto_chars[upto] - upto_chars[upto - size] + size - 1
    good = np.flatnonzero(keyed if exact_chars is None else keyed | (size > 0) & (length >= exact_chars))
    keyed = keyed[good]
    part = np.searchsorted(part_end, ends[good], "right")
    first_line = np.concatenate(([0], np.searchsorted(ends, part_end)))
    numbers = np.array([(k, line) for k, line, _ in parts], np.int64).reshape(-1, 2)
    word = word_hashes(joined, a, b)
    lo, hi = upto[good] - size[good], upto[good]
    # The normalised lines: each word and one space.
    inside[b] = True
    plain = data[inside]
    place = np.concatenate(([0], np.cumsum(b - a + 1)))
    plain[place[1:] - 1] = 0x20
    plain, digest = plain.tobytes(), xxhash.xxh3_128_digest
    ids = b"".join([digest(plain[x:y]) for x, y in zip(place[lo].tolist(), (place[hi] - 1).tolist())])
    sim, many = np.zeros(len(good), np.uint64), np.zeros(len(good), np.int64)
    sim[keyed], keys, many[keyed] = simhashes(word, wide, lo[keyed], hi[keyed])
    return numbers[part, 0], good - first_line[part] + numbers[part, 1], np.frombuffer(ids, np.uint8).reshape(-1, 16), sim, keys, many, length[good]


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether the edit similarity is ``least`` or more.

    An alignment of words bounds the distance from above; only where that does not
    decide it is it computed.
    """
    most = int((1 - least) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    return _aligned(a.split(" "), b.split(" "), most) <= most or edit_similarity(a, b, least) >= least


#: Words that an alignment passes over at once.
_STEPS = [(i, s - i) for s in range(1, 9) for i in sorted(range(s + 1), key=lambda i: abs(2 * i - s))]


def _aligned(x: list[str], y: list[str], most: int) -> int:
    """Characters that a greedy alignment of the words replaces: no less than the edit distance; over ``most`` if it is larger."""
    cost, i, j, m, n = 0, 0, 0, len(x), len(y)
    size = lambda words: sum(map(len, words)) + len(words)
    while i < m and j < n:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        p, q = next(((p, q) for p, q in _STEPS if i + p < m and j + q < n and x[i + p] == y[j + q]), (m - i, n - j))
        cost += max(size(x[i : i + p]), size(y[j : j + q]))
        i, j = i + p, j + q
        if cost > most:
            return cost
    return cost + max(size(x[i:]), size(y[j:]))


def edit_similarity(a: str, b: str, least: float = SIMILARITY) -> float:
    """1 - distance / longer length; 0.0 as soon as it must be under ``least``."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return 0.0
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    d = max(len(a), len(b)) if not a or not b else _distance(a, b, most)
    return 1 - d / longer if d <= most else 0.0


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance by bit vectors (one bit for each character of ``a``); most + 1 if it is larger."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, d = full, 0, len(a)
    for k, c in enumerate(b):
        x = where.get(c, 0) | down
        same = ((((x & up) + up) ^ up) | x) & full
        plus, minus = down | ~(same | up) & full, up & same
        if plus & top:
            d += 1
        elif minus & top:
            d -= 1
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | ~(same | plus) & full, plus & same
        if d - (len(b) - 1 - k) > most:
            return most + 1
    return d


def close_pairs(keys: np.ndarray, group: np.ndarray, parent: np.ndarray | None = None, chars: np.ndarray | None = None, least: float = SIMILARITY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one group (a run) whose SimHashes differ in at most ``BITS`` bits.

    With ``chars``, the length of each line, pairs whose lengths rule out a similarity of ``least`` are left out.
    With ``parent``, the component of each key, which the caller keeps up to date,
    long runs are gone through key by key and pairs of one component left out, so
    that a dense run costs about as much as it has keys.
    """

    def close(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = np.bitwise_count(keys[i] ^ keys[j]) <= BITS
        if chars is not None:
            ok &= np.minimum(chars[i], chars[j]) >= least * np.maximum(chars[i], chars[j]) - 1e-6
        return ok

    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(edges, len(group)))
    long = (size > LONG_RUN) & (parent is not None)
    for lo, n in zip(edges[long].tolist(), size[long].tolist()):
        run = np.arange(lo, lo + n)
        for p in range(n - 1):
            own = parent[run]
            j = run[p + 1 :][own[p + 1 :] != own[p]]
            if not len(j) and (own == own[0]).all():
                break
            i = np.broadcast_to(run[p], len(j))
            if (ok := close(i, j)).any():
                yield i[ok], j[ok]
    many = (size > 1) & ~long
    lo, size = edges[many], size[many]
    # Each member of a run with those after it.
    first = np.repeat(lo, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    after = np.repeat(lo + size, size) - first - 1
    first, after = first[after > 0], after[after > 0]
    total = np.cumsum(after)
    at = 0
    while at < len(first):
        done = int(total[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        n = after[at:upto]
        i = np.repeat(first[at:upto], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        if (ok := close(i, j)).any():
            yield i[ok], j[ok]
        at = upto


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_words: int, exact_chars: int) -> DataFrame:
    """``doc_id, dkey, line, id, sim, keys, size`` of each line with enough words or characters; ``dkey`` is a hash of the text, ``keys`` are what lines are joined by."""
    source = own_columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("dkey", F.xxhash64("text"))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, line, ids, sim, keys, many, size = scan(batch.column(1).to_pylist(), min_words, exact_chars)
        at = pa.array(text)
        offsets = pa.py_buffer((16 * np.arange(len(text) + 1, dtype=np.int32)).tobytes())
        id_ = pa.Array.from_buffers(pa.binary(), len(text), [None, offsets, pa.py_buffer(ids.tobytes())])
        ends = pa.py_buffer(np.concatenate(([0], np.cumsum(many))).astype(np.int32).tobytes())
        keys = pa.ListArray.from_buffers(pa.list_(pa.int32()), len(text), [None, ends], children=[pa.array(keys.view(np.int32))])
        columns = [batch.column(0).take(at), batch.column(2).take(at), pa.array(line, pa.int32()), id_, pa.array(sim.view(np.int64)), keys, pa.array(size, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "dkey", "line", "id", "sim", "keys", "size"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return arrow_map(source, f, f"doc_id {kind}, dkey bigint, line int, id binary, sim bigint, keys array<int>, size int", 4096)


def _letters(lines: list[str]) -> np.ndarray:
    return np.array([np.bincount(np.frombuffer(x.encode("utf-32-le"), np.uint32) & 63, minlength=64) for x in lines], np.int32).reshape(-1, 64)


def fuzzy_links(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, least: float = SIMILARITY, hot_rows: int = HOT_ROWS, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """``src, dst``: a spanning forest of the links between the distinct lines in ``nodes`` (id, first, sim, keys, size)."""
    some = nodes.where(F.pmod(F.xxhash64("id"), F.lit(HOT_SHARE)) == 0).select(F.explode("keys").alias("place"))
    rows, by = dealt(nodes.select("sim", F.explode("keys").alias("place"), "size"), some, "place", "sim", hot_rows, HOT_SHARE)

    def partners(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sim, size = batch.column(0).to_numpy().view(np.uint64), batch.column(2).to_numpy()
        group = runs([batch.column(c).to_numpy() for c in (1, *range(3, batch.num_columns))])
        at = np.flatnonzero(np.bincount(group)[group] > 1)
        sim, group, size = sim[at], group[at], size[at]
        parent = np.arange(len(at))
        for i, j in close_pairs(sim, group, parent, size, least):
            roots_of(len(at), i, j, parent)
        # A component of a key is known by its members, as the same lines mostly meet by several keys.
        members = np.bincount(parent, minlength=len(at))
        hit = members[parent] > 1
        name = np.zeros(len(at), np.uint64)
        np.add.at(name, parent[hit], mix(sim[hit] + np.uint64(1)))
        yield pa.RecordBatch.from_arrays([pa.array(sim[hit].view(np.int64)), pa.array(name[parent[hit]].view(np.int64))], ["sim", "place"])

    near = cut(arrow_groups(rows, by, partners, "sim bigint, place bigint").distinct())
    near, by = dealt(near, near.select("place"), "place", "sim", hot_texts)
    wanted = near.groupBy("sim").agg(F.collect_list(F.struct(*by)).alias("places"))
    release(docs.sparkSession)
    candidates = nodes.where("size(keys) > 0").select("id", "sim", "size", "first.*").join(wanted, "sim")
    # Small results are stored step by step: shuffle files of lines, texts and candidates never lie on disk together.
    places = stored(candidates.groupBy("doc_id", "dkey").agg(F.collect_list(F.struct("line", "id", "sim", "places", "size")).alias("want")), "places")
    release(docs.sparkSession)
    source = own_columns(docs, id_col, text_col).toDF("d", "text").withColumn("k", F.xxhash64("text"))
    held = places.join(source, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("dkey"))).select("text", "want")
    # The lines themselves are cut out in the JVM; only they go to Python.
    held = held.select(F.split("text", "\n").alias("lines"), "want")
    found = held.select(F.explode(F.transform("want", lambda w: F.struct(w["id"].alias("id"), w["sim"].alias("sim"), w["places"].alias("places"), w["size"].alias("size"), F.get("lines", w["line"]).alias("words")))).alias("w")).select("w.*")
    held = stored(found, "found")
    discard(places)
    release(docs.sparkSession)
    found = held.select("sim", "id", "words", "size", F.inline("places")).dropDuplicates([*by, "id"])

    def verified(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sim, size = batch.column(0).to_numpy().view(np.uint64), batch.column(3).to_numpy()
        group = runs([batch.column(c).to_numpy() for c in range(4, batch.num_columns)])
        text = [normalise(x).decode("utf-8", "replace") for x in batch.column(2).to_pylist()]
        count, parent = _letters(text), np.arange(len(text))
        src, dst = [], []
        for i, j in close_pairs(sim, group, parent, size, least):
            for p in range(0, len(i), 4096):
                x, y = i[p : p + 4096], j[p : p + 4096]
                apart = parent[x] != parent[y]
                x, y = x[apart], y[apart]
                # Letters that only one of the two has bound the distance from below.
                d = count[x] - count[y]
                far = np.maximum(np.maximum(d, 0).sum(axis=1), np.maximum(-d, 0).sum(axis=1))
                near = far <= (1 - least) * np.maximum(size[x], size[y]) + 1e-6
                for k, m in zip(x[near].tolist(), y[near].tolist()):
                    if root(parent, k) != root(parent, m) and similar(text[k], text[m], least):
                        a, b = sorted((root(parent, k), root(parent, m)))
                        parent[b] = a
                        src.append(k)
                        dst.append(m)
                flatten(parent)
        ids = batch.column(1)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(x, pa.int64())) for x in (src, dst)], ["src", "dst"])

    links = cut(arrow_groups(found, by, verified, "src binary, dst binary", 4096))
    discard(held)
    return links


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, least: float = SIMILARITY, exact_chars: int = EXACT_CHARS, hot_rows: int = HOT_ROWS, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """``doc_id, dkey, removed``: sorted numbers of the lines to remove, for documents that lose any."""
    lines = stored(lines_of(docs, id_col, text_col, min_words, exact_chars), "lines")
    nodes = lines.groupBy("id").agg(F.min(F.struct("doc_id", "line", "dkey")).alias("first"), F.min("sim").alias("sim"), F.min("keys").alias("keys"), F.min("size").alias("size"), F.count("*").alias("n"))
    nodes = stored(nodes, "nodes")
    # From here on lines need no keys.
    lines, whole = stored(lines.select("doc_id", "dkey", "line", "id"), "lines"), lines
    discard(whole)
    release(docs.sparkSession)
    classes = connected_components(fuzzy_links(nodes, docs, id_col, text_col, least, hot_rows, hot_texts)).withColumnRenamed("node", "id")
    release(docs.sparkSession)
    several = cut(nodes.select("id", "first", "n").join(classes, "id", "left").where("n > 1 or component is not null").select("id", "first", "component"))
    linked = several.where("component is not null").select("id", "first", "component")
    kept = linked.groupBy("component").agg(F.min("first").alias("keep"), F.count("*").alias("n"))
    fate = salted_join(linked, kept, "component", "id").select("id", "keep").unionAll(several.where("component is null").select("id", F.col("first").alias("keep")))
    fate = cut(fate)
    gone = lines.join(fate, "id").where(~F.struct("doc_id", "line", "dkey").eqNullSafe(F.col("keep")))
    gone = cut(gone.groupBy("doc_id", "dkey").agg(F.sort_array(F.collect_set("line")).alias("removed")))
    discard(lines)
    discard(nodes)
    release(docs.sparkSession)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, least: float = SIMILARITY, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """The documents without repeated lines, plus ``n_lines`` and ``removed`` (line numbers from 0).

    Null text stays null and has no lines. Lines under ``min_words`` words go
    only as equals of an earlier line, and stay under ``exact_chars`` characters.
    Rows that are equal in id and text are one document and share their fate;
    rows of one id with different texts are different documents. Other columns are
    kept; columns named ``n_lines`` or ``removed`` are replaced.
    """
    fate = decisions(docs, id_col, text_col, min_words, least, exact_chars).toDF("lost_id", "lost_key", "lost")
    at = [i for i, c in enumerate(docs.columns) if c not in ("n_lines", "removed")]
    names, cols = [docs.columns[i] for i in at], [f"c{i}" for i in at]
    t = names.index(text_col)
    keyed = numbered(docs).select(*cols).withColumn("key", F.xxhash64(cols[t]))
    joined = keyed.join(fate, F.col(cols[names.index(id_col)]).eqNullSafe(F.col("lost_id")) & (F.col("key") == F.col("lost_key")), "left").select(*cols, "lost")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, count = [], []
        for text, gone in zip(batch.column(t).to_pylist(), batch.column(len(cols)).to_pylist()):
            count.append(0 if text is None else text.count("\n") + 1)
            if gone:
                lost = set(gone)
                text = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in lost)
            out.append(text)
        columns = [pa.array(out, pa.string()) if i == t else batch.column(i) for i in range(len(cols))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64()), batch.column(len(cols))], [*cols, "n_lines", "removed"])

    schema = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in cols)
    return arrow_map(joined, f, schema + ", n_lines bigint, removed array<int>", 4096).toDF(*names, "n_lines", "removed")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed"), F.sha2("text", 256).alias("text_sha256"))
