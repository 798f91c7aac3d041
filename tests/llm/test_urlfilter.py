import duckdb
from pyspark.sql import functions as F

from loomframe.llm import urlfilter


def test_membership_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("host"), "id").alias("key"))
    for step in (2, 7, 1000, 30_000):
        listed = spark.range(0, 60_000, step).select(F.concat(F.lit("host"), "id").alias("key"))
        c = urlfilter.build(urlfilter.marked(universe, listed))
        wrong = universe.where(c.contains(F.col("key")) != (F.substring("key", 5, 9).cast("int") % step == 0)).count()
        assert wrong == 0 and (len(c.bits) > 1 or step > 1000)
        assert c.bits[0] < 16 * 20_000 / step * 2 + 200


def test_more_than_one_shard(spark):
    universe = spark.range(6_000).select(F.concat(F.lit("host"), "id").alias("key"))
    listed = universe.where(F.substring("key", 5, 9).cast("int") % 3 == 0)
    rows = universe.unionAll(universe.where("key in ('host0', 'host1', 'host2', 'host3', 'host4')")).unionAll(spark.createDataFrame([(None,)], "key string"))
    out = urlfilter.member(rows, "key", universe, listed, shard_bits=1000).collect()
    assert len(out) == 6_006 and all(r.listed == (r.key is not None and int(r.key[4:]) % 3 == 0) for r in out)


def test_empty_lists_and_nulls(spark):
    none = spark.createDataFrame([], "key string")
    some = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "key string")
    assert [r.listed for r in urlfilter.member(some, "key", some, none).collect()] == [False] * 4
    assert urlfilter.build(urlfilter.marked(none, some)).bits == [] and urlfilter.member(none, "key", none, some).collect() == []
    out = urlfilter.member(some, "key", some.selectExpr("1 AS u", "2 AS l", "key"), some.limit(1))
    assert [r.listed for r in out.collect()] == [True, True, False, False]


def test_poor_hosts(spark):
    rows = [("http://a/x", "### *** ##"), ("http://A/", "fine " * 30), ("http://b/", "fine " * 30), ("http://c", None), (None, "###"), ("http://b/2", "fine")]
    pages = spark.createDataFrame(rows, "url string, html string").selectExpr("1 AS key", "2 AS poor", "*")
    assert [r.key for r in urlfilter.poor_hosts(pages).collect()] == []
    assert [r.key for r in urlfilter.poor_hosts(pages.where("url is not null")).collect()] == ["a"]
    assert urlfilter.poor_hosts(pages.limit(0)).collect() == []


def test_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q", "https://example.net/EN/", "https://sub.example.com/de/1", "https://notexample.com/de/1", "ftp://x.org/fr/", "http://x.org", "http://net", "http://net/?a", "http://cheap-pills.example.com/en/#t", "http://a://b/c"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2, "page_id bigint, url string").selectExpr("1 AS host", "2 AS rule", "*")
    listed = spark.createDataFrame([("cheap-pills.example.com",), ("elsewhere",)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(rows, listed).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[4][2:] == ("net/", "block")
    assert got[5][2:] == ("example.com/de/", "block") and got[6][2] is None and got[7][2:] == ("org/fr/", "allow") and got[8] == ("x.org", "", None, "allow")
    assert got[9] == ("net", "", None, "allow") and got[10][2:] == ("net/", "block") and got[11][2:] == (None, "block") and got[12][0] == "a:"
    assert urlfilter.judge(rows.limit(0), listed).collect() == []


def test_query_against_sql_without_python(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    df = urlfilter.op10_url_filter(spark, sf_dir)
    rel = con.sql(urlfilter.ORACLE).order("page_id")
    assert df.columns == rel.columns and sorted(map(tuple, df.collect())) == rel.fetchall()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan
