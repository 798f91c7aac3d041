"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from pieces of bad and one from
pieces of good labelled text. A text is compressed with both, in pieces of a fixed
size so that the dictionary counts alike in short and long texts; the difference
of the compressed sizes, over the text's size and over the sum of both, becomes a
probability by logistic regression on labelled rows that the dictionaries have not
seen.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, own_columns, table

#: Labelled rows of each class that the fit takes at most, and the longest text among them.
MAX_ROWS, MAX_CHARS = 4000, 65_536
#: Chosen by cross-validation within the training folds (``validate``).
DICT_BYTES, PIECE, LEVEL = 112_640, 512, 3
#: Score from which a document counts as good: fixed value of the contract.
THRESHOLD = 0.3
FOLDS = 5


@dataclass(frozen=True)
class Model:
    """Dictionaries (bad, good), calibration weights, and the score of an empty text."""

    bad: bytes
    good: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float

    def score(self, text: str | None) -> float:
        if not text or not self.weights:
            return self.prior
        x = [1.0, *((v - m) / s for v, m, s in zip(features(text, self.bad, self.good), self.mean, self.scale))]
        z = sum(a * b for a, b in zip(x, self.weights))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


@lru_cache(8)
def _compressor(raw: bytes):
    import zstandard

    kind = zstandard.DICT_TYPE_AUTO if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdCompressionDict(raw, dict_type=kind)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def pieces(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def features(text: str, bad: bytes, good: bytes) -> tuple[float, float]:
    cut = pieces(text)
    b, g = _compressor(bad).compress, _compressor(good).compress
    n = sum(map(len, cut))
    x, y = sum(len(b(p)) for p in cut), sum(len(g(p)) for p in cut)
    return (x - y) / n, (x - y) / (x + y)


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or the plain text where there is too little to train on."""
    import zstandard

    cut = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, cut).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(cut)[-DICT_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def fit(rows: list[tuple[object, str, int]]) -> Model:
    """A model from (id, text, quality); half of the rows, by a hash of the id as text, make dictionaries, half calibrate."""
    rows = sorted((str(i), t, q) for i, t, q in rows if t)
    prior = sum(q for *_, q in rows) / len(rows) if rows else 0.5
    half = {q: [t for i, t, k in rows if k == q and zlib.crc32(f"half {i}".encode()) % 2] for q in (0, 1)}
    rest = [(t, q) for i, t, q in rows if not zlib.crc32(f"half {i}".encode()) % 2]
    if not half[0] or not half[1] or len({q for _, q in rest}) < 2:
        return Model(b"", b"", (), (), (), prior)
    bad, good = _dictionary(half[0]), _dictionary(half[1])
    x = np.array([features(t, bad, good) for t, _ in rest])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = _logistic((x - mean) / scale, np.array([q for _, q in rest], float))
    return Model(bad, good, tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), prior)


def validate(rows: list[tuple[object, str, int]], threshold: float = THRESHOLD) -> tuple[float, float]:
    """Shares of good rows kept and of bad rows rejected, each fold but 0 judged by a model of the others."""
    of = lambda i: zlib.crc32(str(i).encode()) % FOLDS
    kept: dict[int, list[bool]] = {0: [], 1: []}
    for k in range(1, FOLDS):
        model = fit([r for r in rows if of(r[0]) not in (0, k)])
        for i, text, q in rows:
            if of(i) == k:
                kept[q].append(model.score(text) >= threshold)
    return sum(kept[1]) / max(len(kept[1]), 1), 1 - sum(kept[0]) / max(len(kept[0]), 1)


def fold(id_col: str) -> "F.Column":
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> list[tuple[int, str, int]]:
    """Labelled texts outside fold 0, ``max_rows`` of each class at most, chosen by a hash of the id.

    Null labels and ids are left out, as are ids whose labels disagree.
    """
    known = own_columns(labels, id_col, label_col).where(F.col(label_col).isin(0, 1) & (fold(id_col) != 0))
    known = known.groupBy(id_col).agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi")).where("lo = hi")
    order = [F.xxhash64(id_col), F.col(id_col)]
    picked = [known.where(F.col("lo") == q).orderBy(*order).limit(max_rows) for q in (0, 1)]
    ids = picked[0].unionAll(picked[1]).select(id_col, F.col("lo").alias("q"))
    texts = own_columns(docs, id_col, text_col).where(F.length(text_col) <= MAX_CHARS)
    found = texts.join(F.broadcast(ids), id_col).select(id_col, text_col, "q").orderBy(*order, text_col).limit(2 * max_rows).collect()
    return [tuple(r) for r in found]


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, score`` of every whole text (plus ``carry``); null and empty texts get the share of good labels."""
    names = list(dict.fromkeys((id_col, text_col, *carry)))
    source = own_columns(docs, *names)
    out = [id_col, *(c for c in dict.fromkeys(carry) if c != id_col)]

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [model.score(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in out), pa.array(got, pa.float64())], [*out, "score"])

    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in out) + ", score double"
    return arrow_map(source, f, schema, 512)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    The model is fitted on the labels outside fold 0. Without labels of both
    classes every score is the share of good labels (0.5 without any). Repeated
    rows get the same score; null ids count as held out; an empty table gives none.
    """
    model = fit(sample(docs, labels, id_col, text_col))
    rows = scores(docs, model, id_col, text_col, carry)
    return rows.withColumns({"held_out": F.coalesce(fold(id_col) == 0, F.lit(True)), "predicted": (F.col("score") >= threshold).cast("int")})


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
