import pyarrow as pa
import pytest

from loomframe.llm import common


def test_batches_are_cut_by_rows_and_bytes():
    texts = ["a" * 10, None, "é" * 400, "b" * 5000, "", "c" * 10, "d" * 10, "e" * 10]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["n", "x"])
    parts = [p.column(0).to_pylist() for p in common.by_size(batch, 3, 1000)]
    assert [n for p in parts for n in p] == list(range(8)) and all(len(p) <= 3 for p in parts)
    # A text beyond the size is alone, or has only what fits before it.
    assert [3] in parts and all(sum(len((texts[n] or "").encode()) for n in p) <= 1000 for p in parts if p != [3])
    assert [p.num_rows for p in common.by_size(batch.slice(4), 100, 1)] and list(common.by_size(batch.slice(0, 0), 3, 10)) == []


def test_salted_join(spark):
    large = spark.range(3000).selectExpr("id", "IF(id < 1500, 1, id) AS k")
    small = large.groupBy("k").count().selectExpr("k", "count AS n", "k * 2 AS v")
    rows = common.salted_join(large, small, "k", "id").collect()
    assert len(rows) == 3000 and all(r.v == 2 * r.k for r in rows)


def test_hot_keys_meet_in_pairs_of_parts(spark):
    rows = spark.range(400).selectExpr("id", "IF(id < 300, 1, id) AS k")
    dealt, by = common.dealt(rows, rows.select("k"), "k", "id", 100)
    assert by == ["k", "p", "q"]
    groups = {}
    for r in dealt.collect():
        groups.setdefault((r.k, r.p, r.q), set()).add(r.id)
    met = {(a, b) for g in groups.values() for a in g for b in g}
    assert {(a, b) for a in range(300) for b in range(300)} <= met and max(map(len, groups.values())) < 200
    assert common.dealt(rows, rows.select("k"), "k", "id", 1000)[1] == ["k"]


def test_stored_frames_are_discarded(spark):
    df = common.stored(spark.range(5), "five")
    path = df.inputFiles()[0]
    assert df.count() == 5
    common.discard(df)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        spark.read.parquet(path).count()
