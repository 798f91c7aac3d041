import random
import re

import numpy as np
import xxhash

import corpus_pipeline
from loomframe.llm import simhash
from loomframe.llm.common import connected_components, roots_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64))


def components(fps, ids):
    order = np.argsort(ids, kind="stable")
    fps, ids = np.array(fps, np.uint64)[order], np.array(ids)[order]
    parent = np.arange(len(ids))
    for i in range(len(ids)):
        j = i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2)
        if len(j):
            parent = roots_of(len(ids), np.full(len(j), i), j, parent)
    return dict(zip(ids.tolist(), ids[parent].tolist()))


def test_fingerprints(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()] + [None, "", " ", "One", "one TWO", "É x\x0by z", "a\u00a0b c d"]
    assert [simhash.fingerprint(t) for t in texts] == [plain(t) for t in texts]


def test_trie_join_finds_every_pair():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 2**63, 300, np.uint64)]
    for _ in range(8):
        keys.append(keys[0] ^ (np.uint64(1) << rng.integers(0, 64, 300, np.uint64)))
        keys.append(keys[-1] ^ (np.uint64(1) << rng.integers(0, 64, 300, np.uint64)))
    keys = np.unique(np.concatenate(keys))
    for budget in (0, 1, 2, 3):
        found = set()
        for first, bits in simhash.blocks(budget):
            k = (keys << np.uint64(first)) | (keys >> np.uint64(64 - first)) if first else keys
            order = np.argsort(k)
            group = (k[order] >> np.uint64(64 - bits)).view(np.int64) if bits < 64 else k[order].view(np.int64)
            for i, j in simhash.trie_links(k[order], group, bits, budget):
                found |= {tuple(sorted((int(order[x]), int(order[y])))) for x, y in zip(i, j)}
        want = {(i, i + 1 + int(x)) for i in range(len(keys)) for x in np.flatnonzero(np.bitwise_count(keys[i + 1 :] ^ keys[i]) <= budget)}
        assert found == want


def test_dense_group():
    rng = np.random.default_rng(3)
    keys = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 40, 3000, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 40, 3000, np.uint64)))
    pairs = sum(len(i) for i, _ in simhash.trie_links(keys, np.zeros(len(keys), np.int64), 21, 2))
    assert pairs == sum(int((np.bitwise_count(keys[i + 1 :] ^ keys[i]) <= 2).sum()) for i in range(len(keys)))


def test_query_against_brute_force(spark, sf_dir):
    rows = simhash.op8_simhash(spark, sf_dir).collect()
    assert {r.doc_id: r.component_id for r in rows} == components([int(r.fingerprint, 16) for r in rows], [r.doc_id for r in rows])


def test_blocks_of_many_fingerprints_are_dealt_out(spark):
    rng = np.random.default_rng(9)
    keys = np.unique(np.uint64(7 << 60) ^ (np.uint64(1) << rng.integers(0, 40, 900, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 40, 900, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 40, 900, np.uint64)))
    prints = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp bigint")
    found = [{r.node: r.component for r in connected_components(simhash.links(prints, 2, most)).collect()} for most in (simhash.HOT_KEYS, 100)]
    assert found[0] == found[1] and len(found[0]) > 500


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)] + [(500, i) for i in range(501, 560)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    parent = roots_of(600, np.array([a for a, _ in real]), np.array([b for _, b in real]))
    nodes = {x for e in real for x in e}
    assert got == {n: int(parent[n]) for n in nodes}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_similar_texts_are_dropped_as_by_brute_force(spark, docs, sf_dir):
    rng = random.Random(6)
    rows = []
    for i in range(0, 80, 2):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(60, 200))]
        other = list(words)
        for k in rng.sample(range(len(words)), 1 + i // 20):
            other[k] = "z" * 5
        rows += [(i, " ".join(words)), (i + 1, " ".join(other))]
    sets = [set(simhash.shingles(t, 5).tolist()) for _, t in rows]
    near = [i for i in range(0, 80, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    kept = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs(rows), sf_dir).collect()}
    assert len(near) > 10 and kept == set(range(80)) - {i + 1 for i in near}
    assert len(simhash.drop_near_duplicates(docs(rows)).collect()) > len(kept)


def test_odd_rows(odd, clash):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 11 and {r.component_id for r in rows if r.fingerprint == "0" * 16} == {2}
    assert sorted(map(repr, simhash.near_duplicates(clash).collect())) == sorted(map(repr, rows)) and simhash.near_duplicates(odd.limit(0)).collect() == []
    kept = simhash.drop_near_duplicates(clash)
    assert kept.columns == clash.columns and kept.count() == len({r.component_id if r.component_id is not None else r.fingerprint for r in rows} | {r.fingerprint for r in rows if r.doc_id == 1}) - 1
    assert simhash.drop_near_duplicates(odd.limit(0)).collect() == []
