"""Byte-level BPE encoding and decoding by tree concatenation.

A text is first split at added tokens (the library does so too). A stretch
longer than ``leaf`` bytes is halved again and again; the leaves of a batch are
encoded in parallel by as many threads as the task has cores (``spark.task.cpus``;
the library works outside the interpreter's lock), and neighbours are then joined
bottom-up. Around each join a
window is encoded again and doubled until both sides agree with it exactly.

Why agreement is enough. (1) Pre-tokens: the library's pattern scans from left
to right and looks at most one character ahead (three after an apostrophe), so
from a common boundary on, two scans over the same characters are the same;
inside a run of one character class the end of the run does not depend on where
in the run the scan began. (2) Tokens: a sequence of BPE tokens is the encoding
of its pre-token exactly if each neighbouring pair encodes to itself, since the
first merge across a boundary would also happen for that pair alone. A window
that shares one whole token with the left side and one with the right side, with
the same pre-token structure there, hence proves each pair of the joined
sequence.
"""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, own_columns, table

#: Bytes of a stretch that is encoded in one piece.
LEAF = 16_384
#: Bytes on either side of a join that the first window covers.
WINDOW = 64


class TreeCodec:
    """Encoder and decoder over one tokenizer file of the tokenizers library."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW, threads: int = 1):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf, self.window, self.threads = max(8, leaf), window, threads
        self.rounds = 0
        size = self.tok.get_vocab_size()
        added = self.tok.get_added_tokens_decoder()
        byte_of = {chr(c): b for b, c in _byte_alphabet().items()}
        self.bytes_of = [
            added[i].content.encode() if i in added else bytes(byte_of[c] for c in self.tok.id_to_token(i)) for i in range(size)
        ]
        self.name_of = [str(i) for i in range(size)]
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.added = {t.content: i for i, t in added.items()}

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text."""
        leaves: list[str] = []
        short: list[str] = []
        plans = [self._plan(x, leaves, short) for x in texts]
        encoded = self._leaves(leaves)
        # Texts of one leaf need no word numbers, which only joins look at.
        plain = self.tok.encode_batch_fast(short, add_special_tokens=False)
        return [plain[p].ids if isinstance(p, int) else self._whole(p, encoded) for p in plans]

    def _leaves(self, leaves: list[str]) -> list:
        """Encodings of the leaves, by several threads."""
        encode = lambda part: self.tok.encode_batch(part, add_special_tokens=False)
        if self.threads < 2 or len(leaves) < 2:
            return encode(leaves)
        size = -(-len(leaves) // self.threads)
        with ThreadPoolExecutor(self.threads) as pool:
            return [e for part in pool.map(encode, [leaves[at : at + size] for at in range(0, len(leaves), size)]) for e in part]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD, as in the library."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def _plan(self, text: str, leaves: list[str], short: list[str]):
        """The number of a text of one leaf, or a list of (bytes, tree) with an id for an added token."""
        if len(text) * 4 <= self.leaf or len(text) <= self.leaf and len(text.encode()) <= self.leaf:
            short.append(text)
            return len(short) - 1
        parts: list = [text]
        for content, i in self.added.items():
            parts = [y for x in parts for y in (_between(x.split(content), i) if isinstance(x, str) else [x])]
        return [x if isinstance(x, int) else self._halve(x.encode(), leaves) for x in parts if x != ""]

    def _halve(self, raw: bytes, leaves: list[str]):
        if len(raw) <= self.leaf:
            leaves.append(raw.decode())
            return (raw, len(leaves) - 1)
        mid = len(raw) // 2
        while raw[mid] & 0xC0 == 0x80:
            mid -= 1
        return (raw, self._halve(raw[:mid], leaves), self._halve(raw[mid:], leaves))

    def _whole(self, plan: list, encoded: list) -> list[int]:
        out: list[int] = []
        for x in plan:
            if isinstance(x, int):
                out.append(x)
            else:
                out += self._tree(x, encoded)[0].tolist()
        return out

    def _tree(self, node: tuple, encoded: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and for each token whether a pre-token begins with it."""
        if len(node) == 2:
            return self._flags(encoded[node[1]])
        (left, lf), (right, rf) = self._tree(node[1], encoded), self._tree(node[2], encoded)
        return self._join(node[1][0], left, lf, node[2][0], right, rf)

    @staticmethod
    def _flags(e) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(e.ids, np.int64)
        words = np.asarray(e.word_ids, np.int64)
        return ids, np.diff(words, prepend=-1) != 0

    def _join(self, lraw: bytes, left: np.ndarray, lf: np.ndarray, rraw: bytes, right: np.ndarray, rf: np.ndarray):
        lat = np.cumsum(self.length[left]) - self.length[left]
        rat = np.cumsum(self.length[right]) - self.length[right]
        k = self.window
        while k < max(len(lraw), len(rraw)):
            self.rounds += 1
            a, b = self._start(lraw, lat, lf, k), min(k, len(rraw))
            while b < len(rraw) and rraw[b] & 0xC0 == 0x80:
                b += 1
            if a is not None and (out := self._agree(lraw, left, lf, lat, a, rraw, right, rf, rat, b)) is not None:
                return out
            k *= 2
        return self._flags(self.tok.encode((lraw + rraw).decode(), add_special_tokens=False))

    @staticmethod
    def _start(lraw: bytes, lat: np.ndarray, lf: np.ndarray, k: int) -> int | None:
        """A token of the left side where a window of about ``k`` bytes may begin."""
        i = int(np.searchsorted(lat, len(lraw) - max(k, 32), "right")) - 1
        while i >= 0:
            at = int(lat[i])
            if lf[i] or lraw[at] & 0xC0 != 0x80 and lraw[at] != 0x27 and _long_run(lat, lf, i, len(lraw)):
                return i
            i -= 1
        return None

    def _agree(self, lraw, left, lf, lat, a, rraw, right, rf, rat, b):
        start = int(lat[a])
        text = (lraw[start:] + rraw[:b]).decode()
        ids, flags = self._flags(self.tok.encode(text, add_special_tokens=False))
        if not len(ids) or ids[0] != left[a]:
            return None
        at = np.cumsum(self.length[ids]) - self.length[ids] + start - len(lraw)  # places in the right side
        ends = at + self.length[ids]
        limit = b if b == len(rraw) else b - 16  # what follows may still change the last characters
        for w in np.flatnonzero((at >= 0) & (ends <= limit)):
            r = int(np.searchsorted(rat, at[w]))
            if r >= len(rat) or rat[r] != at[w] or right[r] != ids[w] or flags[w] != rf[r]:
                continue
            if not flags[w] and not (
                _long_run(at, flags, w, limit) and _long_run(rat, rf, r, len(rraw)) and rraw[int(at[w])] & 0xC0 != 0x80
            ):
                continue
            lead = flags[1 : w + 1]
            return np.concatenate((left[: a + 1], ids[1 : w + 1], right[r + 1 :])), np.concatenate((lf[: a + 1], lead, rf[r + 1 :]))
        return None


def _long_run(at: np.ndarray, flags: np.ndarray, i: int, end: int) -> bool:
    """Whether the pre-token around token ``i`` is too long for a contraction."""
    lo = i
    while lo > 0 and not flags[lo] and at[i] - at[lo] < 8:
        lo -= 1
    return at[i] - at[lo] >= 8 or i + 1 < len(at) and not flags[i + 1] and at[i + 1] - at[lo] >= 8


def _between(parts: list, x) -> list:
    out = [parts[0]]
    for p in parts[1:]:
        out += [x, p]
    return out


def _byte_alphabet() -> dict[int, int]:
    """Code point that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


@lru_cache(2)
def codec(path: str, leaf: int = LEAF, window: int = WINDOW) -> TreeCodec:
    task = TaskContext.get()
    return TreeCodec(path, leaf, window, task.cpus() if task else 1)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of every text, and the ``carry`` columns after its id.

    Null text counts as empty (no tokens); a repeated row gives a repeated row;
    a null id stays null; other columns are not looked at. ``ids=False`` leaves
    the token column out. ``path`` names the tokenizer's file on the executors.
    Rows stay in the order in which they come.
    """
    path = path or default_tokenizer()
    source = own_columns(docs, id_col, text_col, *carry)
    shown = (id_col, *carry)
    at = [source.columns.index(c) for c in shown]

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        c = codec(path)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        rows = c.encode_batch(texts)
        out = [
            *(batch.column(i) for i in at),
            pa.array([len(r) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(",".join(map(c.name_of.__getitem__, r)).encode()).hexdigest() for r in rows], pa.string()),
            pa.array([hashlib.sha256(c.decode(r).encode()).hexdigest() for r in rows], pa.string()),
        ]
        names = [*shown, "n_tokens", "ids_sha256", "decoded_sha256"]
        if ids:
            out.append(pa.array(rows, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(out, names)

    schema = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in shown)
    schema += "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return arrow_map(source, f, schema, 64)


def decode(tokens: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` back from token ids; a null list gives empty text."""
    path = path or default_tokenizer()
    source = own_columns(tokens, id_col, ids_col)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return arrow_map(source, f, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, text string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ids=False)
