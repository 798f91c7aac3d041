import zlib

from loomframe.llm import quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = quality.op9_quality(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    test = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [p for q, p in test if q == 1], [p for q, p in test if q == 0]
    assert sum(good) / len(good) > 0.985 and 1 - sum(bad) / len(bad) > 0.85


def test_held_out_labels_do_not_count(spark, docs):
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(words[(i * k) % 50] for k in range(60)) if i % 2 else f"junk{i} " * 60) for i in range(200)]
    df = docs(rows)
    labels = [(i, i % 2) for i in range(200)]
    flipped = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q) for i, q in labels]
    a, b = (quality.classify(df, spark.createDataFrame(x, "doc_id bigint, quality int")).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b and sum(r.predicted == r.doc_id % 2 for r in a) > 190


def test_odd_rows(spark, odd, clash):
    labels = [(1, 1), (1, 1), (2, 0), (3, 1), (3, 0), (None, 1), (5, None), (6, 0)]
    for rows in (labels, [], [(1, 1)]):
        lab = spark.createDataFrame(rows, "doc_id bigint, quality int")
        got = quality.classify(odd, lab).collect()
        assert len(got) == 11 and all(r.held_out for r in got if r.doc_id is None)
        assert sorted(map(repr, quality.classify(clash, lab).collect())) == sorted(map(repr, got))
    assert quality.classify(odd.limit(0), lab).collect() == []
    none = quality.classify(odd, spark.createDataFrame([], "doc_id bigint, quality int")).collect()
    assert {r.score for r in none} == {0.5}
