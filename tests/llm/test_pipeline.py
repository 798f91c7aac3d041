import os

import numpy as np

import corpus_pipeline
from loomframe.llm import linededup, mixing, simhash
from loomframe.llm.common import roots_of


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        seen.append((name, docs, out))
        docs = out
    assert [n for n, *_ in seen] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "mix_sources", "bpe_encode"]
    assert all(out.columns == list(corpus_pipeline.COLUMNS) for _, _, out in seen[:-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen[0][2].collect()}
    assert sum(q == 1 and d in kept for d, q in labels.items()) > 0.97 * sum(labels.values())
    # Lines: what stays has no two equal long lines; n_chars follows the text.
    lines = [linededup.normalise(x) for r in seen[1][2].collect() for x in r.text.split("\n")]
    long = [x for x in lines if len(x.split()) >= linededup.MIN_WORDS]
    assert len(long) == len(set(long)) and all(r.n_chars == len(r.text) for r in seen[1][2].collect())
    # Near-duplicates: the first of each group of texts that share four in five of their shingles.
    rows = sorted((r.doc_id, np.unique(simhash.shingles(r.text, 5))) for r in seen[2][1].collect())
    left = {r.doc_id for r in seen[2][2].collect()}
    parent = np.arange(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if simhash.similarity(rows[i][1], rows[j][1]) >= 0.8:
                roots_of(len(rows), np.array([i]), np.array([j]), parent)
    assert left == {rows[k][0] for k in set(parent.tolist())}
    # The mix takes about as many words as there are.
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert abs(words(seen[3][2]) - words(seen[3][1])) < 0.2 * words(seen[3][1])
    assert seen[4][2].count() == seen[3][2].count()
    plain = lambda df: sorted(map(repr, df.drop("position").collect()))
    assert plain(corpus_pipeline.run(spark, sf_dir)) == plain(seen[4][2])


def test_training_order_survives_files(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    placed = mixing.training_order(mixing.assign(docs, carry=corpus_pipeline.COLUMNS)).select("position", *corpus_pipeline.COLUMNS)
    want = [r.doc_id for r in placed.orderBy("position", "doc_id").collect()]
    # Many files of different sizes, which the reader packs and splits as it likes.
    path = str(tmp_path / "mix")
    corpus_pipeline.mix_sources(spark, docs, sf_dir).write.option("maxRecordsPerFile", 20).parquet(path)
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) > 8
    before = {"spark.sql.files.maxPartitionBytes": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in list(before.items()):
        before[k] = spark.conf.get(k)
        spark.conf.set(k, v)
    try:
        out = corpus_pipeline.bpe_encode(spark, spark.read.parquet(path), sf_dir)
        out.write.parquet(f"{path}-out")
        rows = out.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len([f for f in os.listdir(f"{path}-out") if f.endswith(".parquet")]) > 1 and [r.doc_id for r in rows] == want
    at = [r.position for r in rows]
    assert at == sorted(at) and len(set(at)) == len(at)


def test_odd_rows(spark, odd, clash, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        assert out.count() <= 30 and stage(spark, odd.limit(0), sf_dir).collect() == []
        if name != "mix_sources":
            assert sorted(map(repr, stage(spark, clash, sf_dir).drop("position").collect())) == sorted(map(repr, out.drop("position").collect()))
        if name == "simhash_near_dedup":
            assert {r.doc_id for r in out.collect()} >= {None, 1, 2, 5, 6, 7}
