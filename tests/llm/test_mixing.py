import random
import re
import struct

import xxhash

from loomframe.llm import mixing


def water(sizes, weights, repeats=3):
    """Targets by resharing the excess again and again."""
    total, capped = float(sum(sizes)), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(capped.values())
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > repeats * sizes[i] + 1e-9]
        if not over:
            return [capped.get(i, share.get(i)) for i in range(len(sizes))]
        capped |= {i: repeats * sizes[i] for i in over}


def test_targets(spark):
    rng = random.Random(3)
    for _ in range(8):
        names = sorted({rng.choice("ABabéß") + str(rng.randrange(30)) for _ in range(rng.randint(1, 12))}, key=lambda s: s.encode()) + [None]
        sizes = [rng.choice([0, 1, 50, 1000, 100_000]) for _ in names]
        df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = water(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))]) if sum(sizes) else [0.0] * len(names)
        assert all(abs(got[n] - w) < 1e-6 * max(1, w) for n, w in zip(names, want)), (names, sizes, got, want)


def test_invert(spark):
    from pyspark.sql import functions as F

    for knots in ((1.25, 1.0, 0.75), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (0.0, 1.0), (1.0, 0.0)):
        n, h = len(knots), 1 / (len(knots) - 1)

        def area(t, knots=knots, n=n, h=h):
            out = 0.0
            for i in range(n - 1):
                x = min(max(t - i * h, 0.0), h)
                out += knots[i] * x + (knots[i + 1] - knots[i]) / h * x * x / 2
            return out

        rows = spark.range(101).select((F.col("id") / 100).alias("u")).select("u", mixing.invert(F.col("u"), F.array(*map(F.lit, knots)), n).alias("t")).collect()
        assert all(abs(area(r.t) - r.u * area(1.0)) < 1e-9 for r in rows) and rows == sorted(rows)


def test_taken_words_and_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = mixing.assign(docs)
    rows = a.collect()
    assert len(rows) == docs.count() and sorted(map(repr, rows)) == sorted(map(repr, mixing.assign(docs.repartition(7)).collect()))
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2 + 1
        assert all(r.taken == r.size * len(r.positions) <= 3 * r.size and r.positions == sorted(r.positions) for r in mine)
        # By the middle of training a source has given its share of the schedule.
        early = sum(r.size for r in mine for p in r.positions if p <= 0.5)
        shape = mixing.SCHEDULES[[5.0, 2.0, 1.0].index(mixing.WEIGHTS[sorted({r.source for r in rows}).index(source) % 3])]
        share = (shape[0] + shape[1]) / (shape[0] + 2 * shape[1] + shape[2])
        assert abs(early - share * mine[0].target) <= max(r.size for r in mine) + 1
    order = [r.position for r in mixing.training_order(a).collect()]
    assert order == sorted(order) and len(order) == sum(len(r.positions) for r in rows)


def test_odd_rows(odd, clash):
    rows = mixing.assign(odd).collect()
    assert len(rows) == 11 and {r.source for r in rows} == {"a", "b", "c", None}
    assert all(r.copies == 0 for r in rows if r.size == 0) and max(r.size for r in rows) == 60_000
    assert sorted(map(repr, mixing.assign(clash).collect())) == sorted(map(repr, rows))
    assert mixing.training_order(mixing.assign(clash, carry=("text", "h", "position"))).count() == sum(r.copies for r in rows)
    assert mixing.assign(odd.limit(0)).collect() == [] and all(r.taken == 0 for r in mixing.assign(odd.where("text is null")).collect())


def test_query_against_brute_force(spark, sf_dir):
    """Sizes, targets and what is taken of each document, spelt out source by source."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    docs = [(r.doc_id, r.source, len(word.findall(r.text or ""))) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    names = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, x, n in docs if x == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), float(sum(total.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            goal |= share
            break
        for s in over:
            goal[s] = 3.0 * total[s]
            left -= goal[s]
        open_ -= over
    want = {}
    for s in names:
        before = 0
        own = [(xxhash.xxh64_intdigest(struct.pack("<q", d), 42), d, n) for d, x, n in docs if x == s]
        for _, d, n in sorted(own):
            copies = sum(before + n / 2 + p * total[s] <= goal[s] for p in range(3)) if n else 0
            want[d] = (n, total[s], copies * n)
            before += n
    got = mixing.op4_mixing(spark, sf_dir).collect()
    assert {r.doc_id: (r.size, r.source_size, r.taken) for r in got} == want
    source = {d: s for d, s, _ in docs}
    assert all(abs(r.target - goal[source[r.doc_id]]) <= 1e-9 * goal[source[r.doc_id]] for r in got)
