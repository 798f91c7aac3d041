"""Repetition coverage: characters inside duplicated n-grams and lines, by rolling hashes in numpy.

A batch of texts is one array of bytes, taken in pieces of a bounded size. Words and
lines are hashed one by one, n-grams by a rolling hash over word hashes; each is
taken together with the text's number, so equal hashes mean equal n-grams of the
same text. An n-gram can only repeat where its first n - 1 words do, so only those
places are looked at for longer n.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, mix, own_columns, stretches, table, word_hashes

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes that are looked at together; a piece goes on to the end of a word.
PIECE = 1 << 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

#: Words of the windows that ``n_repeat_words`` is about, and its limits: fixed values of the contract.
BASE_N, MIN_WORDS, MAX_REPEAT = 5, 10, 20
#: Highest share of a text's word characters inside repeated n-grams, by n (first
#: occurrences included, so one repeated line counts twice), and of characters in
#: repeated lines.
LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
LINE_LIMIT = 0.30


def _repeated(h: np.ndarray) -> np.ndarray:
    """Which hashes occur twice or more."""
    if len(h) < 2:
        return np.zeros(len(h), bool)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(h: np.ndarray) -> np.ndarray:
    """Which hashes occur earlier, too."""
    if len(h) < 2:
        return np.zeros(len(h), bool)
    order = np.argsort(h, kind="stable")
    out = np.zeros(len(h), bool)
    out[order[1:][h[order][1:] == h[order][:-1]]] = True
    return out


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in one of the windows of ``n`` words that begin at ``starts``."""
    d = np.zeros(words + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + n, words), -1)
    return np.cumsum(d[:-1]) > 0


def measure(texts: list[str | None], lengths: tuple[int, ...] = tuple(LIMITS)) -> dict[str, np.ndarray]:
    """Counts for each text: words, word characters, symbols, repeated lines and words, and covered characters by n."""
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    n_docs = len(raw)
    doc_end = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, n_docs)) - 1
    joined = b"".join(x + b"\n" for x in raw)
    del raw
    count = lambda which, weight=None: np.bincount(which, weight, n_docs).astype(np.int64)[:n_docs]
    found, symbols, at, n_words, n_chars = [], np.zeros(n_docs, np.int64), 0, 0, 0
    while at < len(joined):
        gap = _GAP.search(joined, min(at + PIECE, len(joined) - 1))
        piece = joined[at : gap.end()]
        data = np.frombuffer(piece, np.uint8)
        a, b = stretches(~_SPACE.take(data))
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)))
        breaks = np.flatnonzero(data == 0x0A)
        symbols += count(np.searchsorted(doc_end, at + np.flatnonzero(_SYMBOL.take(data)), "right"))
        doc = np.searchsorted(doc_end, at + a, "right").astype(np.int32)
        found.append((doc, word_hashes(piece, a, b), chars[b] - chars[a], at + breaks, n_words + np.searchsorted(a, breaks), n_chars + chars[breaks]))
        at, n_words, n_chars = gap.end(), n_words + len(a), n_chars + int(chars[-1])
    doc, word, length, breaks, words_upto, chars_upto = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 6
    del found
    salt = mix(np.arange(1, n_docs + 1, dtype=np.uint64) * np.uint64(_BASE))
    out = {"n_words": count(doc), "word_chars": count(doc, length), "n_symbols": symbols}

    # Lines with a word.
    la = np.concatenate(([0], breaks[:-1] + 1)) if len(breaks) else breaks
    wordy = np.diff(words_upto, prepend=0) > 0
    lchars = np.diff(chars_upto, prepend=-1)[wordy] - 1
    la, lb = la[wordy], breaks[wordy]
    ldoc = np.searchsorted(doc_end, la, "right")
    digest = xxhash.xxh3_64_intdigest
    again = _later(np.fromiter((digest(joined[x:y]) for x, y in zip(la.tolist(), lb.tolist())), np.uint64, len(la)) + salt[ldoc])
    out["n_dup_lines"] = count(ldoc[again])
    out["line_chars"] = count(ldoc, lchars)
    out["dup_line_chars"] = count(ldoc[again], lchars[again])

    m = len(word)
    last = np.searchsorted(doc, np.arange(n_docs), "right")  # end of each text's words
    starts, h, width = np.arange(m), word, 1
    for n in sorted({BASE_N, *lengths}):
        while width < n:
            whole = starts + width < last[doc[starts]]
            starts, h = starts[whole], h[whole]
            h = h * np.uint64(_BASE) + word[starts + width]
            width += 1
        twice = _repeated(mix(h) + salt[doc[starts]])
        starts, h = starts[twice], h[twice]
        cover = _covered(starts, n, m)
        if n == BASE_N:
            out["n_repeat_words"] = count(doc[cover])
        out[f"chars_{n}"] = count(doc[cover], length[cover])
    return out


def verdict(x: dict[str, np.ndarray], limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) from ``measure``'s counts."""
    failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT * x["n_words"])
    good = x["dup_line_chars"] <= line_limit * x["line_chars"]
    for n, most in limits.items():
        good &= x[f"chars_{n}"] <= most * x["word_chars"]
    return failed, good & ~failed


def coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``kept`` and the share of characters in repeats by n.

    Null text has no words and fails like any text under ten words. Repeated rows
    are judged alike; null ids stay; an empty table gives none. Whole texts are
    measured, a batch holds a bounded number of them.
    """
    limits = LIMITS if limits is None else limits
    source = own_columns(docs, id_col, text_col)
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    shares = [f"dup_{n}_share" for n in limits]

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = measure(batch.column(1).to_pylist(), tuple(limits))
        failed, kept = verdict(x, limits, line_limit)
        columns = [batch.column(0), *(pa.array(x[k]) for k in shown), pa.array(failed), pa.array(kept)]
        columns += [pa.array(x[f"chars_{n}"] / np.maximum(x["word_chars"], 1)) for n in limits]
        columns.append(pa.array(x["dup_line_chars"] / np.maximum(x["line_chars"], 1)))
        return pa.RecordBatch.from_arrays(columns, [id_col, *shown, "base_failed", "kept", *shares, "dup_line_share"])

    schema = f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{k} bigint" for k in shown)
    schema += ", base_failed boolean, kept boolean, " + ", ".join(f"{s} double" for s in [*shares, "dup_line_share"])
    return arrow_map(source, f, schema, 256)


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """SQL for ``op7_repetition``: windows as lists of words, one branch for each n."""
    windows = " UNION ALL ".join(f"SELECT doc_id, {n} AS n, i, ws[i : i + {n - 1}] AS g FROM w, unnest(range(1, len(ws) - {n} + 2)) t(i)" for n in LIMITS)
    share = "".join(f", coalesce(max(c.chars) FILTER (c.n = {n}), 0) AS chars_{n}, coalesce(max(c.words) FILTER (c.n = {n}), 0) AS words_{n}" for n in LIMITS)
    good = " AND ".join(f"chars_{n} <= {most} * word_chars" for n, most in LIMITS.items())
    shown = ", ".join(f"CAST(chars_{n} AS DOUBLE) / greatest(word_chars, 1) AS dup_{n}_share" for n in LIMITS)
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, coalesce(text, '') AS text FROM documents),
g AS ({windows}),
r AS (SELECT doc_id, n, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, n, g) > 1),
p AS (SELECT DISTINCT doc_id, n, i + k AS at FROM r, unnest(range(0, 10)) t(k) WHERE k < n),
c AS (SELECT p.doc_id, p.n, count(*) AS words, sum(length(w.ws[p.at])) AS chars FROM p JOIN w USING (doc_id) GROUP BY ALL),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
m AS (SELECT doc_id, line, count(*) AS k FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
n AS (SELECT doc_id, sum(k - 1) AS n_dup_lines, sum(k * length(line)) AS line_chars, sum((k - 1) * length(line)) AS dup_line_chars FROM m GROUP BY 1),
a AS (
  SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(w.text, '[#*$%&|<>]')) AS n_symbols, coalesce(any_value(n.n_dup_lines), 0) AS n_dup_lines, coalesce(any_value(n.line_chars), 0) AS line_chars, coalesce(any_value(n.dup_line_chars), 0) AS dup_line_chars{share}
  FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY w.doc_id, ws, w.text)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(words_{BASE_N} AS BIGINT) AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * words_{BASE_N} > {MAX_REPEAT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * words_{BASE_N} > {MAX_REPEAT} * n_words) AND {good} AND dup_line_chars <= {LINE_LIMIT} * line_chars AS kept,
  {shown}, CAST(dup_line_chars AS DOUBLE) / greatest(line_chars, 1) AS dup_line_share FROM a"""


ORACLE = _oracle()
