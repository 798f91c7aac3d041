import os
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from loomframe.llm import linededup
from loomframe.llm.common import mix, roots_of, word_hashes

#: Scale of the recall test; sf0.01 has 345 pairs and takes about five minutes.
RECALL_SF = os.environ.get("RECALL_SF", "sf0.001")


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows, least=0.8, min_words=5):
    """Lines to remove of (doc_id, text) rows with distinct ids."""
    places = {}
    for d, t in sorted((r for r in rows if r[1]), key=lambda r: r[0]):
        for n, line in enumerate(t.split("\n")):
            w = linededup.normalise(line).decode()
            if len(w.split()) >= min_words:
                places.setdefault(w, []).append((d, n))
    texts = list(places)
    _, _, _, sim, keys, many, _ = linededup.scan(texts, 1)
    own = [set(k.tolist()) for k in np.split(keys, np.cumsum(many)[:-1])]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in (i + 1 + np.flatnonzero(np.bitwise_count(sim[i + 1 :] ^ sim[i]) <= linededup.BITS)).tolist():
            if own[i] & own[j] and 1 - lev(texts[i], texts[j]) / max(len(texts[i]), len(texts[j])) >= least:
                parent[root(i)] = root(j)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(root(i), []).extend(places[t])
    out = {}
    for g in groups.values():
        for d, n in sorted(g)[1:]:
            out.setdefault(d, []).append(n)
    return {d: sorted(v) for d, v in out.items()}


def test_edit_similarity():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 25)))
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", " "])
        b = "".join(b)
        s = 1 - lev(a, b) / max(len(a), len(b), 1)
        assert abs(linededup.edit_similarity(a, b) - (s if s >= 0.8 else 0.0)) < 1e-9
        assert linededup.similar(a, b) == (s >= 0.8 - 1e-12)


def test_close_pairs_are_all_pairs_once():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 900, np.uint64) & np.uint64(0xFF00FF00FF00FF00)
    group = np.sort(rng.integers(0, 40, 900))
    got = [p for i, j in linededup.close_pairs(keys, group) for p in zip(i.tolist(), j.tolist())]
    want = {(i, j) for i in range(900) for j in range(i + 1, 900) if group[i] == group[j] and int(np.bitwise_count(keys[i] ^ keys[j])) <= linededup.BITS}
    assert len(got) == len(want) and set(got) == want


def test_dense_runs_give_the_same_components():
    rng = np.random.default_rng(4)
    keys = np.full(3000, np.uint64(0x1234_5678_9ABC_DEF0))
    for _ in range(12):
        keys = keys ^ (np.uint64(1) << rng.integers(0, 60, 3000, np.uint64))
    keys = np.concatenate((np.unique(keys), rng.integers(0, 2**63, 1000, np.uint64)))
    group = np.zeros(len(keys), np.int64)
    found = [np.arange(len(keys)), np.arange(len(keys))]
    pairs = [0, 0]
    for way in (0, 1):
        for i, j in linededup.close_pairs(keys, group, found[1] if way else None):
            roots_of(len(keys), i, j, found[way])
            pairs[way] += len(i)
    assert (found[0] == found[1]).all() and pairs[1] < pairs[0]


def blocks_of(words):
    """SimHash blocks of different words by plain Python."""
    h = {}
    for w in words:
        x = int(word_hashes(w, np.array([0]), np.array([len(w)]))[0])
        h[w] = (x >> 61, int(mix(np.array([x >> 21 << 6 | min(len(w), 63)], np.uint64))[0]))
    major = lambda v: sum(int(2 * sum(x >> k & 1 for x in v) > len(v)) << k for k in range(64))
    return major([x for _, x in h.values()]), [major([x for b, x in h.values() if b == k]) for k in range(8)]


def test_simhash_and_keys():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(900)]
    lines = [[rng.choice(vocabulary) for _ in range(n)] for n in (5, 8, 9, 20, 60, 400, 2000)]
    _, _, _, sim, keys, many, _ = linededup.scan([" ".join(x) for x in lines], 1)
    keys = np.split(keys, np.cumsum(many)[:-1])
    for words, s, own in zip(lines, sim.tolist(), keys):
        whole, blocks = blocks_of({w.encode() for w in words})
        assert s == whole
        if len(set(words)) >= 60:  # a key is one block
            assert set(own.tolist()) == {int(mix((mix(np.array([b], np.uint64) * f)))[0]) >> 32 for b, f in zip(blocks, linededup._BLOCK)}
    # Words in another order, and one other word, leave keys as they are.
    for words in lines:
        other = words[:]
        rng.shuffle(other)
        other[other.index(other[0])] = "entirelynew"
        _, _, _, _, k, m, _ = linededup.scan([" ".join(words), " ".join(other)], 1)
        assert set(k[: m[0]].tolist()) & set(k[m[0] :].tolist())


def test_ids_of_texts_that_polynomials_confuse(docs):
    # Sequences of this kind have equal polynomials modulo 2^64 for every odd base.
    flip = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = (" ".join(("alpha", "beta")[x ^ y] for x in flip) for y in (0, 1))
    long = ["".join("ab"[x ^ y] for x in flip) for y in (0, 1)]
    ids = linededup.scan([one, two, *long], 1)[2]
    assert len({x.tobytes() for x in ids}) == 4 and ids.shape == (4, 16)
    h = word_hashes("\n".join(long).encode(), np.array([0, 1025]), np.array([1024, 2049]))
    assert h[0] != h[1]


def test_long_texts_are_scanned_in_parts(monkeypatch):
    rng = random.Random(6)
    texts = ["\n".join(" ".join(rng.choice(["a", "bb", "ccc", "dd", "e"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 300))) for _ in range(5)] + [None, ""]
    whole = linededup.scan(texts, 5, 4)
    monkeypatch.setattr(linededup, "BATCH_BYTES", 100)
    assert all((x == y).all() for x, y in zip(whole, linededup.scan(texts, 5, 4)))


def test_hot_keys_are_dealt_out(docs):
    rng = random.Random(7)
    tail = " ".join(f"word{k}" for k in range(12))
    rows = [(i, f"{'xyz'[i % 3]}{rng.randrange(10**6)} {tail}") for i in range(200)] + [(1000, "something else with many words in a line of its own")]
    want = {(r.doc_id, tuple(r.removed)) for r in linededup.decisions(docs(rows)).collect()}
    got = {(r.doc_id, tuple(r.removed)) for r in linededup.decisions(docs(rows), hot_rows=64, hot_texts=40).collect()}
    assert got == want and len(got) == 199


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(rows)
    got = {r.doc_id: r for r in linededup.op6_line_dedup(spark, sf_dir).collect()}
    assert {d: [int(x) for x in r.removed.split(",")] for d, r in got.items() if r.n_removed} == want and len(got) == len(rows)


def test_fuzzy_lines(docs):
    line = "the quick brown fox jumps over the lazy dog and then it runs away through the wide green fields of the old farm"
    rows = [(i, f"{line} number\nshort line\nown words of document {i} " + " ".join(f"w{i}{k}" for k in range(9))) for i in range(4)]
    rows += [(9, line.upper() + "!! number"), (10, line.replace("quick", "quickk") + " number")]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs(rows)).collect()}
    assert got[0].removed is None and all(got[i].removed == [0] and got[i].text.startswith("short line\nown") for i in (1, 2, 3)) and got[9].text == ""
    assert {d: r.removed for d, r in got.items() if r.removed} == brute(rows)


def all_similar(lines):
    """Index pairs with an edit similarity of 0.8 or more among all pairs; letter counts and lengths bound the distance from below."""
    size = np.array([len(x) for x in lines])
    count = np.array([np.bincount([ord(c) % 64 for c in x], minlength=64) for x in lines], np.int16)
    first, second = [], []
    for i in range(len(lines)):
        upto = int(np.searchsorted(size, size[i] / 0.8 + 1e-9, "right"))
        d = count[i + 1 : upto] - count[i]
        far = np.maximum(np.maximum(d, 0).sum(1), np.maximum(-d, 0).sum(1))
        j = i + 1 + np.flatnonzero(far <= 0.2 * size[i + 1 : upto] + 1e-9)
        first.append(np.full(len(j), i))
        second.append(j)
    return [(i, j) for i, j in zip(np.concatenate(first).tolist(), np.concatenate(second).tolist()) if linededup.edit_similarity(lines[i], lines[j]) >= 0.8]


def test_recall_of_similar_lines(spark, sf_dir):
    """Nine in ten of all pairs of lines with an edit similarity of 0.8 end up in one group."""
    sf_dir = sf_dir.replace("sf0.001", RECALL_SF)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = sorted({w for r in docs.collect() for x in (r.text or "").split("\n") if len((w := linededup.normalise(x).decode()).split()) >= 5}, key=len)
    pairs = all_similar(lines)
    one_each = spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string")
    nodes = linededup.lines_of(one_each, "doc_id", "text", 5, 32).withColumn("first", F.struct("doc_id", "line", "dkey"))
    links = linededup.fuzzy_links(nodes.select("id", "first", "sim", "keys", "size"), one_each, "doc_id", "text")
    number = {bytes(r.id): r.doc_id for r in nodes.select("id", "doc_id").collect()}
    found = [(number[bytes(r.src)], number[bytes(r.dst)]) for r in links.collect()]
    root = roots_of(len(lines), *np.array(found).T)
    hit = sum(root[i] == root[j] for i, j in pairs)
    print(f"{hit} of {len(pairs)} pairs among {len(lines)} lines")
    assert len(pairs) > 20 and hit >= 0.95 * len(pairs) and {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in pairs}


def test_lines_with_one_changed_character_link(docs):
    rng = random.Random(8)
    rows = []
    for n in range(5, 40):
        words = ["".join(rng.choice("abcdefghijklmnopqrs") for _ in range(rng.randint(3, 9))) for _ in range(n)]
        k = rng.randrange(n)
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join([*words[:k], words[k][:-1] + "z", *words[k + 1 :]]))]
    removed = {r.doc_id for r in linededup.dedup_lines(docs(rows)).collect() if r.removed}
    assert removed <= {2 * n + 1 for n in range(5, 40)} and len(removed) >= 34


def test_equal_lines_of_few_words(spark, docs, sf_dir):
    one = "\u65e5\u672c\u8a9e\u306e\u9577\u3044\u884c" * 6
    rows = [(1, f"{one}\nand ornd"), (2, f"{one}\nAnd, ornd!"), (3, f"{one[:-1]}\nand ornb")]
    got = {r.doc_id: r.removed for r in linededup.dedup_lines(docs(rows)).collect()}
    assert got == {1: None, 2: [0], 3: None}
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs(rows), sf_dir).collect()}
    assert kept == {1: rows[0][1], 3: rows[2][1]}


def test_odd_rows(odd, clash):
    rows = linededup.dedup_lines(odd).collect()
    assert len(rows) == 11 and sum(r.n_lines for r in rows) == 1 * 8 + 3 and all(r.removed is None for r in rows)
    out = linededup.dedup_lines(clash)
    assert out.columns == [*clash.columns, "n_lines", "removed"] and sorted(map(repr, out.select(rows[0].__fields__).collect())) == sorted(map(repr, rows))
    assert linededup.dedup_lines(odd.limit(0)).collect() == []


def test_candidates_do_not_wait_for_texts(docs, monkeypatch):
    """Candidate lines are read from files: the shuffled texts that they were cut from need not stay on disk meanwhile."""
    plans, groups = [], linededup.arrow_groups
    monkeypatch.setattr(linededup, "arrow_groups", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or groups(df, *a))
    rows = docs([(1, "one two three four five six seven"), (2, "one two three four five six seven eight")])
    assert [r.removed for r in linededup.dedup_lines(rows).orderBy("doc_id").collect()] == [None, [0]]
    assert len(plans) == 2 and "Join" not in plans[1]
