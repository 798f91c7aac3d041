"""Every query with SQL gives DuckDB's rows; the others run."""

from decimal import Decimal
from urllib.parse import urlparse

import duckdb
import pytest

from loomframe.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return float(v) if isinstance(v, Decimal) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(plain(v) for _, v in sorted(zip(rel.columns, r))) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_unpack_cap_at_its_edge(spark, tmp_path):
    """Texts of 1000 bytes pass, longer ones do not, whatever the end of a word."""
    texts = [None, "", "a" * 999, "a" * 1000, "é" * 500, "a" * 1001, "é" * 500 + "a", "a" * 1007, "a" * 1008, "a" * 100_000, "\0" * 1000, "\0" * 1001]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.unpack_cap_error(spark, str(tmp_path)).collect() == [(12, 6)]
    want = duckdb.sql(catalog.ORACLE_SQL["unpack_cap_error"].replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert want == [(12, 6)]


def test_stream_goes_through_files(spark, sf_dir, tmp_path):
    """What the stream sends lies in the shared folder, not on the driver; events may be a folder of files, or none at all."""
    out = catalog.stream_equals_batch_rpc(spark, sf_dir)
    files = out.inputFiles()
    folder = urlparse(spark.sparkContext.getCheckpointDir()).path
    assert files and all(urlparse(f).path.startswith(folder) for f in files)
    want = sorted(out.collect())
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/several/events.parquet")
    assert sorted(catalog.stream_equals_batch_rpc(spark, f"{tmp_path}/several").collect()) == want
    events.where("false").write.parquet(f"{tmp_path}/empty/events.parquet")
    assert catalog.stream_equals_batch_rpc(spark, f"{tmp_path}/empty").collect() == []
