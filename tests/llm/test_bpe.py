import hashlib
import random

import pytest
from tokenizers import Tokenizer

from loomframe.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


def test_joins_agree_with_the_library(library):
    """Small leaves and windows, so that nearly every token is near a join."""
    rng = random.Random(5)
    parts = ["a", "b", "the ", "ing", " ", "  ", "\n", "'", "'s", "'ll", "!", "?!", "123", "é", "日本", "\u3000", "🎉", "<|endoftext|>", "<|endof", "ab" * 20, "!" * 9, "9" * 12, "'" * 10, " " * 11, "\t"]
    c = bpe.TreeCodec(bpe.default_tokenizer())
    for _ in range(1500):
        c.leaf, c.window = rng.choice([8, 16, 33, 64, 100]), rng.choice([2, 4, 8, 40])
        some = rng.sample(parts, rng.randint(1, len(parts)))
        text = "".join(rng.choice(some) for _ in range(rng.randint(1, 60)))
        ids = c.encode_batch([text])[0]
        assert ids == library.encode(text, add_special_tokens=False).ids, (text, c.leaf, c.window)
        assert c.decode(ids) == text
    assert c.rounds > 1000


def test_unsplit_text(library):
    rng = random.Random(6)
    c = bpe.TreeCodec(bpe.default_tokenizer(), 512)
    for text in ("".join(rng.choice("abcdefgh") for _ in range(20_000)), "a" * 20_000, " " * 20_000 + "x", "!'" * 9000, "aé" * 9000, "日本語" * 5000):
        assert c.encode_batch([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_leaves_by_threads(library):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["the ", "ing", "x", "\n", "é"]) for _ in range(n)) for n in (3, 4000, 0, 9000)]
    c = bpe.TreeCodec(bpe.default_tokenizer(), 64, threads=3)
    assert c.encode_batch(texts) == [library.encode(x, add_special_tokens=False).ids for x in texts] and c.rounds > 100


def test_query_against_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bpe.op1_bpe(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_decode_of_any_ids(library):
    rng = random.Random(7)
    c = bpe.codec(bpe.default_tokenizer())
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 30))]
        assert c.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_odd_rows(odd, clash, library):
    rows = bpe.encode(odd).collect()
    assert len(rows) == 11 and sorted(map(repr, bpe.encode(clash).collect())) == sorted(map(repr, rows))
    for r, d in zip(rows, odd.collect()):
        text = d.text or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.doc_id == d.doc_id and r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert [r.text for r in bpe.decode(bpe.encode(odd)).collect()] == [d.text or "" for d in odd.collect()]
    assert bpe.encode(odd.limit(0)).collect() == []
