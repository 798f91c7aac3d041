"""Queries over the frame operators, with the SQL that gives the same rows.

A frame is an identity on what it carries, so plain SQL on the source table is an
independent check of each path through frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import calculator, native
from ..kernel.builder import Builder
from ..kernel.wire import Limits
from ..layout import BOOL, CAP, DATA, FLOAT64, INT32, INT64, TEXT, UINT8, UINT32, Field, Struct, enum, list_of, struct_of
from ..operators import frames as fr
from ..rpc import tables as rpc
from . import schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str) -> Column:
    """An exact sum of amounts with two decimals."""
    return (F.sum(F.round(F.col(c) * 100).cast("long")) / 100.0).cast("double")


# Encoding and decoding.


def roundtrip(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        s = fr.layout_for(df)
        return fr.decode(fr.encode(df, s), s)

    return run


for _t in ("region", "nation", "supplier", "part", "customer", "orders", "lineitem", "events"):
    query(f"SELECT * FROM {_t}", f"roundtrip_{_t}")(roundtrip(_t))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to packed frames and back, then an aggregate."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    s = fr.layout_for(df)
    packed = fr.encode(df, s, pack=True)
    rows = fr.decode(packed, s, columns=["o_totalprice", "o_orderpriority"], packed=True)
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), cents("o_totalprice").alias("total"))


query("SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0 AS DOUBLE) AS total FROM orders GROUP BY 1", "flagship_orders_by_priority")(flagship)


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def decode_pruned_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    s = fr.layout_for(df)
    return fr.decode(fr.encode(df, s), s, columns=["l_orderkey", "l_quantity"])


@query("SELECT doc_id, CAST(8 * (2 + 3 + (octet_length(encode(text)) + 8) // 8 + (octet_length(encode(lang)) + 8) // 8 + (octet_length(encode(source)) + 8) // 8 + 2) AS BIGINT) AS frame_bytes FROM documents")
def frame_size_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    s = fr.layout_for(df, "default")
    return fr.encode(df, s, keep=["doc_id"]).select("doc_id", F.octet_length("frame").cast("long").alias("frame_bytes"))


@query("SELECT doc_id, text FROM documents")
def pack_roundtrip_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = fr.layout_for(df)
    frames = fr.encode(df, s).select(fr.unpack(fr.pack(F.col("frame"))).alias("frame"))
    return fr.decode(frames, s)


@query("SELECT count(*) AS n, count(*) FILTER (octet_length(encode(text)) > 1000) AS refused FROM documents")
def unpack_cap_error(spark, sf_dir):
    # Texts go as data: without the end of a text, 1000 bytes fill their words, and one byte more takes another word.
    s = Struct("t", 0, 1, (Field("text", DATA, 0, b""),))
    texts = table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("text"))
    frames = fr.encode(texts, s).select(fr.pack(F.col("frame")).alias("p"))
    # Table, root, struct and 1000 bytes: 3 + 125 words.
    out = frames.select(fr.unpack(F.col("p"), 128, "PERMISSIVE").alias("u"))
    return out.agg(F.count("*").alias("n"), F.count(F.when(F.col("u").isNull(), 1)).alias("refused"))


@query("SELECT count(*) AS n, count(*) AS smaller FROM orders")
def packed_ratio_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    out = fr.encode(df, fr.layout_for(df)).select("frame", fr.pack(F.col("frame")).alias("p"))
    return out.agg(F.count("*").alias("n"), F.count(F.when(F.octet_length("p") < F.octet_length("frame"), 1)).alias("smaller"))


@query("SELECT DISTINCT text FROM documents")
def canonical_dedup_documents(spark, sf_dir):
    s = Struct("t", 0, 1, (Field("text", TEXT, 0, ""),))
    frames = fr.encode(table(spark, sf_dir, "documents").select("text"), s)
    return fr.decode(fr.canonical_distinct(frames), s)


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM nation")
def canonical_padding_invariant(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    narrow = fr.layout_for(df, "default")
    wide = Struct("wide", narrow.dwords + 3, narrow.pwords + 2, narrow.fields)
    both = fr.encode(df, narrow, "a", ["n_nationkey"]).join(fr.encode(df, wide, "b", ["n_nationkey"]), "n_nationkey")
    both = both.select(fr.canonicalize(F.col("a")).alias("a"), fr.canonicalize(F.col("b")).alias("b"), fr.canonicalize(fr.resegment(F.col("b"), 1)).alias("c"))
    return both.agg(F.count("*").alias("n"), F.count(F.when((F.col("a") != F.col("b")) | (F.col("a") != F.col("c")), 1)).alias("mismatches"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3 UNION SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0")
def canonical_set_union(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    s = fr.layout_for(df.select("n_nationkey", "n_name"))
    canon = lambda d: fr.encode(d.select("n_nationkey", "n_name"), s).select(fr.canonicalize(F.col("frame")).alias("frame"))
    return fr.decode(canon(df.where("n_regionkey < 3")).union(canon(df.where("n_nationkey % 2 = 0"))).distinct(), s, raw=True)


@query("SELECT * FROM customer")
def multiseg_far_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    s = fr.layout_for(df)
    return fr.decode(fr.encode(df, s).select(fr.resegment(F.col("frame"), 1).alias("frame")), s)


# Lists, unions, numbers.


@query("SELECT o_orderkey, o_custkey, l_linenumber, l_partkey, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def list_composite_order_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("lines"))
    df = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_custkey", "lines")
    s = fr.layout_for(df)
    return fr.decode(fr.encode(df, s), s).select("o_orderkey", "o_custkey", F.inline("lines")).select("o_orderkey", "o_custkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT conv_id, turn, text FROM conversations")
def list_text_conversation(spark, sf_dir):
    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    df = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first"), said.alias("said"))
    s = fr.layout_for(df)
    rows = fr.decode(fr.encode(df, s), s)
    return rows.select("conv_id", "first", F.posexplode("said").alias("pos", "text")).select("conv_id", (F.col("first") + F.col("pos")).alias("turn"), "text")


@query("SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings")
def list_prim_embeddings(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    s = fr.layout_for(df)
    rows = fr.decode(fr.encode(df, s), s)
    return rows.select("vec_id", F.posexplode("embedding").alias("pos", "value")).select("vec_id", "pos", F.col("value").cast("double").alias("value"))


@query("SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def nested_list_lengths(spark, sf_dir):
    # A list of lists: the words of each turn.
    df = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.split("text", " ")).alias("words"))
    s = fr.layout_for(df)
    rows = fr.decode(fr.encode(df, s), s)
    chars = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(F.array_join(w, " ")))
    return rows.select("conv_id", F.size("words").cast("long").alias("n"), chars.alias("chars"))


_UNION = Struct("event", 3, 1, (Field("id", INT64, 8), Field("click", FLOAT64, 0, tag=0), Field("purchase", FLOAT64, 0, tag=1), Field("other", TEXT, 0, "", tag=2)), union_at=16)


@query("SELECT event_id AS id, CASE WHEN event_type IN ('click', 'purchase') THEN event_type ELSE 'other' END AS which, CASE WHEN event_type = 'click' THEN value END AS click, CASE WHEN event_type = 'purchase' THEN value END AS purchase, CASE WHEN event_type NOT IN ('click', 'purchase') THEN props END AS other FROM events")
def union_by_arm(spark, sf_dir):
    which = F.when(F.col("event_type").isin("click", "purchase"), F.col("event_type")).otherwise("other")
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), which.alias("which"), F.col("value").alias("click"), F.col("value").alias("purchase"), F.col("props").alias("other"))
    return fr.decode(fr.encode(df, _UNION), _UNION)


@query("SELECT CAST(id AS DECIMAL(20,0)) AS id, signed FROM (VALUES (CAST(0 AS DECIMAL(20,0)), CAST(0 AS BIGINT)), (1, -1), (9223372036854775807, 9223372036854775807), (9223372036854775808, -9223372036854775807), (18446744073709551615, 42)) t(id, signed)")
def u64_boundaries(spark, sf_dir):
    rows = [("0", 0), ("1", -1), ("9223372036854775807", 9223372036854775807), ("9223372036854775808", -9223372036854775807), ("18446744073709551615", 42)]
    df = spark.createDataFrame(rows, "id string, signed bigint").withColumn("id", F.col("id").cast("decimal(20,0)"))
    return fr.decode(fr.encode(df, schemas.U64_PROBE), schemas.U64_PROBE)


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'mobile' WHEN 1 THEN 'home' WHEN 2 THEN 'work' ELSE '#7' END AS type FROM nation")
def enum_unknown_ordinals(spark, sf_dir):
    wide, narrow = (Struct("e", 1, 0, (Field("n_nationkey", INT32, 0), Field("type", t, 4))) for t in (enum(*(f"v{i}" for i in range(8))), enum("mobile", "home", "work")))
    ordinal = F.when(F.col("n_nationkey") % 4 == 3, "v7").otherwise(F.concat(F.lit("v"), (F.col("n_nationkey") % 4).cast("string")))
    return fr.decode(fr.encode(table(spark, sf_dir, "nation").select("n_nationkey", ordinal.alias("type")), wide), narrow)


# Evolution.


def _list_layout(element, name: str = "xs") -> Struct:
    return Struct("row", 1, 1, (Field("k", INT64, 0), Field(name, list_of(element), 0, ())))


@query("SELECT p_partkey AS k, p_size AS id, CAST(7 AS INTEGER) AS extra, '' AS label FROM part")
def evolve_upgrade_prim(spark, sf_dir):
    old = _list_layout(UINT32)
    new = _list_layout(Struct("item", 1, 1, (Field("id", INT32, 0), Field("extra", INT32, 4, 7), Field("label", TEXT, 0, ""))))
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array(F.col("p_size").cast("long")).alias("xs"))
    return fr.decode(fr.encode(df, old), new).select("k", F.inline("xs"))


@query("SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS x FROM part")
def evolve_downgrade_struct(spark, sf_dir):
    old = _list_layout(Struct("item", 1, 1, (Field("id", UINT32, 0), Field("label", TEXT, 0, ""))))
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array(F.struct(F.col("p_size").cast("long").alias("id"), F.col("p_name").alias("label"))).alias("xs"))
    return fr.decode(fr.encode(df, old), _list_layout(UINT32)).select("k", F.explode("xs").alias("x"))


@query("SELECT p_partkey AS k, p_name AS x FROM part")
def evolve_downgrade_text(spark, sf_dir):
    old = _list_layout(Struct("item", 1, 1, (Field("id", UINT32, 0), Field("label", TEXT, 0, ""))))
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array(F.struct(F.lit(1).cast("long").alias("id"), F.col("p_name").alias("label"))).alias("xs"))
    return fr.decode(fr.encode(df, old), _list_layout(TEXT)).select("k", F.explode("xs").alias("x"))


@query("SELECT p_partkey AS k, CAST(0 AS BIGINT) AS id, p_name AS label FROM part")
def evolve_upgrade_text(spark, sf_dir):
    new = _list_layout(Struct("item", 1, 1, (Field("id", UINT32, 0), Field("label", TEXT, 0, ""))))
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array("p_name").alias("xs"))
    return fr.decode(fr.encode(df, _list_layout(TEXT)), new).select("k", F.inline("xs"))


@query("SELECT n_nationkey AS k, CAST(-7 AS INTEGER) AS n, TRUE AS ok FROM nation, range(n_nationkey % 3)")
def evolve_void(spark, sf_dir):
    items = native.lift_void(F.col("n_nationkey") % 3, n=F.lit(-7), ok=F.lit(True))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.inline(items))


@query("SELECT count(*) AS n, count(*) AS refused FROM nation")
def evolve_bool_refused(spark, sf_dir):
    new = _list_layout(Struct("item", 1, 0, (Field("id", UINT8, 0),)))
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.array(F.lit(True), F.lit(False)).alias("xs"))
    rows = fr.decode(fr.encode(df, _list_layout(BOOL)), new, mode="PERMISSIVE")
    return rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("_error.code") == "KIND", 1)).alias("refused"))


@query("SELECT c_custkey, c_name, CAST(-7 AS INTEGER) AS grade, CAST(2.5 AS DOUBLE) AS ratio, 'unnamed' AS nick, TRUE AS flag FROM customer")
def evolve_struct_defaults(spark, sf_dir):
    old = Struct("customer", 1, 1, (Field("c_custkey", INT64, 0), Field("c_name", TEXT, 0, "")))
    new = Struct("customer", 3, 2, old.fields + (Field("grade", INT32, 8, -7), Field("ratio", FLOAT64, 16, 2.5), Field("nick", TEXT, 1, "unnamed"), Field("flag", BOOL, 96, True)))
    return fr.decode(fr.encode(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), old), new)


@query("SELECT c_custkey, c_acctbal, CAST(c_nationkey AS INTEGER) AS c_nationkey, c_custkey % 2 = 0 AS flag FROM customer")
def xor_defaults_roundtrip(spark, sf_dir):
    s = Struct("customer", 3, 0, (Field("c_custkey", INT64, 0, 77), Field("c_acctbal", FLOAT64, 8, 2.5), Field("c_nationkey", INT32, 16, -7), Field("flag", BOOL, 160, True)))
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", (F.col("c_custkey") % 2 == 0).alias("flag"))
    return fr.decode(fr.encode(df, s), s)


# Sub-messages.


def _nested(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("line"))
    df = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "line", "o_orderpriority")
    return df, fr.layout_for(df)


@query("SELECT o_orderkey, min(l_linenumber) AS l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def extract_subtree(spark, sf_dir):
    df, s = _nested(spark, sf_dir)
    parts = fr.encode(df, s, keep=["o_orderkey"]).select("o_orderkey", fr.extract(F.col("frame"), ".0").alias("frame"))
    inner = next(f.type.struct for f in s.fields if f.name == "line")
    return fr.decode(parts, inner, columns=["l_linenumber"], keep=["o_orderkey"])


@query("SELECT o_orderkey, 'X-' || o_orderpriority AS o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def graft_subtree(spark, sf_dir):
    df, s = _nested(spark, sf_dir)
    text = Struct("t", 0, 1, (Field("t", TEXT, 0, ""),))
    tag = df.select("o_orderkey", F.concat(F.lit("X-"), "o_orderpriority").alias("t"))
    tags = fr.encode(tag, text, "t_frame", ["o_orderkey"]).select("o_orderkey", fr.extract(F.col("t_frame"), ".0").alias("t_frame"))
    both = fr.encode(df, s, keep=["o_orderkey"]).join(tags, "o_orderkey")
    done = both.select(fr.graft(F.col("frame"), ".1", F.col("t_frame")).alias("frame"))
    return fr.decode(done, s, columns=["o_orderkey", "o_orderpriority"])


@query("SELECT p_partkey, CAST(NULL AS VARCHAR) AS a, p_name AS b FROM part")
def orphan_move(spark, sf_dir):
    s = Struct("p", 1, 2, (Field("p_partkey", INT64, 0), Field("a", TEXT, 0, None), Field("b", TEXT, 1, None)))
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"))
    # A null pointer with a present column reads as null: the slot decides.
    moved = fr.encode(df, s).select(fr.move(F.col("frame"), ".0", ".1").alias("frame"))
    rows = fr.decode(moved, Struct("p", 1, 2, tuple(Field(f.name, f.type, f.at, "" if f.type == TEXT else 0) for f in s.fields)))
    return rows.select("p_partkey", F.nullif("a", F.lit("")).alias("a"), "b")


@query("SELECT c_custkey, 1 AS segments, CAST(1 + 5 + (octet_length(encode(c_name)) + 8) // 8 + (octet_length(encode(c_mktsegment)) + 8) // 8 AS BIGINT) AS words FROM customer")
def segment_stats(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    rows = fr.encode(df, fr.layout_for(df, "default"), keep=["c_custkey"])
    return rows.select("c_custkey", native.segment_count("frame").cast("int").alias("segments"), native.segment_words("frame")[0].alias("words"))


@query("SELECT c_custkey, 1 AS segments, 'struct' AS root, 3 AS dwords, 2 AS pwords FROM customer")
def inspect_customer(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return fr.encode(df, fr.layout_for(df, "default"), keep=["c_custkey"]).withColumn("i", fr.inspect(F.col("frame"))).select("c_custkey", "i.segments", "i.root", "i.dwords", "i.pwords")


@query("SELECT c_custkey, CAST(3 AS BIGINT) AS objects, CAST(2 AS BIGINT) AS texts FROM customer")
def object_graph(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows = fr.objects(fr.encode(df, fr.layout_for(df, "default"), keep=["c_custkey"]), keep=["c_custkey"])
    return rows.groupBy("c_custkey").agg(F.count("*").alias("objects"), F.count(F.when(F.col("kind") == "list", 1)).alias("texts"))


@query("SELECT c_custkey, c_nationkey FROM customer")
def fixed_field_customer(spark, sf_dir):
    """Fields at fixed places without leaving the JVM."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    s = fr.layout_for(df, "default")
    at = {f.name: f.at for f in s.fields}
    frames = fr.encode(df, s)
    return frames.select(native.fixed_field("frame", at["c_custkey"], "int64").alias("c_custkey"), native.fixed_field("frame", at["c_nationkey"], "int32").cast("int").alias("c_nationkey"))


@query("SELECT n_nationkey, n_name FROM nation")
def frame_segments_native(spark, sf_dir):
    """Frames taken apart and put together again in the JVM."""
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = fr.layout_for(df)
    parts = fr.encode(df, s).select(fr.resegment(F.col("frame"), 1).alias("frame")).select(native.split_segments("frame").alias("segments"))
    return fr.decode(parts.select(native.frame_segments("segments").alias("frame")), s)


@query("SELECT n_nationkey, n_name FROM nation")
def decode_attached_segments(spark, sf_dir):
    """Messages that come as arrays of segments."""
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = fr.layout_for(df)
    parts = fr.encode(df, s).select(fr.resegment(F.col("frame"), 2).alias("frame")).select(native.split_segments("frame").alias("segments"))
    return fr.decode_segments(parts, s)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS price, l_tax < 0 AS negative FROM lineitem")
def float_bits_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("bits", fr.float_bits("l_extendedprice")).withColumn("sign", fr.float_bits("l_tax"))
    return df.select("l_orderkey", "l_linenumber", fr.bits_float("bits").alias("price"), (F.col("sign") < 0).alias("negative"))


@query("SELECT n_nationkey, CAST(to_json({'n_name': n_name, 'n_regionkey': n_regionkey}) AS VARCHAR) AS dump FROM nation")
def json_dump(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    s = fr.layout_for(df)
    rows = fr.decode(fr.encode(df, s), s)
    return rows.select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("dump"))


@query("SELECT p_partkey AS k, CAST(0 AS SMALLINT) AS x FROM part")
def evolve_cross_width_is_default(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array(F.col("p_size").cast("long")).alias("xs"))
    return fr.decode(fr.encode(df, _list_layout(UINT32)), _list_layout(UINT8)).select("k", F.explode("xs").alias("x"))


# Limits and errors.


def _deep(n: int) -> Struct:
    s = Struct("leaf", 0, 1, (Field("r_name", TEXT, 0, ""),))
    for k in range(n):
        s = Struct(f"level{k}", 0, 1, (Field("x", struct_of(s), 0, None),))
    return s


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS fine_at_5, count(*) AS fine_at_6 FROM region")
def depth_limit_rows(spark, sf_dir):
    s, x = _deep(5), F.struct("r_name")
    for _ in range(4):
        x = F.struct(x.alias("x"))
    frames = fr.encode(table(spark, sf_dir, "region").select(x.alias("x")), s).select("frame")
    rows = frames.select(F.lit(0).alias("depth"))
    for d in (5, 6):
        read = fr.decode(frames, s, mode="PERMISSIVE", limits=Limits(depth=d))
        rows = rows.unionAll(read.where("_error is null").select(F.lit(d).alias("depth")))
    count = lambda d: F.count(F.when(F.col("depth") == d, 1))
    return rows.agg(count(0).alias("n"), count(5).alias("fine_at_5"), count(6).alias("fine_at_6"))


@query("SELECT count(*) AS n, count(*) FILTER (octet_length(encode(text)) < 800) AS fine FROM documents")
def traversal_limit_rows(spark, sf_dir):
    s = Struct("t", 0, 1, (Field("text", TEXT, 0, ""),))
    frames = fr.encode(table(spark, sf_dir, "documents").select("text"), s)
    # Two pointers, a struct of one word, and 100 words of text.
    rows = fr.decode(frames, s, mode="PERMISSIVE", limits=Limits(words=103))
    return rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("_error").isNull(), 1)).alias("fine"))


@query("SELECT 'BOUNDS' AS code, count(*) AS n FROM region UNION ALL SELECT 'FRAMING', count(*) FROM region UNION ALL SELECT 'none', count(*) FROM region")
def malformed_permissive(spark, sf_dir):
    df = table(spark, sf_dir, "region")
    s = fr.layout_for(df)
    frames = fr.encode(df, s)
    cut = frames.select(F.substring("frame", 1, 20).alias("frame"))
    wild = frames.select(F.concat(F.substring("frame", 1, 8), F.unhex(F.lit("0004000001000100")), F.expr("substring(frame, 17)")).alias("frame"))
    rows = fr.decode(frames.select("frame").unionAll(cut).unionAll(wild), s, mode="PERMISSIVE")
    return rows.groupBy(F.coalesce("_error.code", F.lit("none")).alias("code")).agg(F.count("*").alias("n"))


@query("SELECT * FROM region")
def malformed_dropped(spark, sf_dir):
    df = table(spark, sf_dir, "region")
    s = fr.layout_for(df)
    frames = fr.encode(df, s)
    return fr.decode(frames.unionAll(frames.select(F.substring("frame", 1, 12).alias("frame"))), s, mode="DROPMALFORMED")


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def split_stream_file(spark, sf_dir):
    """Frames of each region in one run of bytes, cut apart again."""
    df = table(spark, sf_dir, "nation")
    s = fr.layout_for(df)
    joined = F.aggregate(F.collect_list("frame"), F.lit(b""), lambda a, x: F.concat(a, x))
    runs = fr.encode(df, s, keep=["n_regionkey"]).groupBy("n_regionkey").agg(joined.alias("content"))
    return fr.decode(fr.split_frames(runs), s).select("n_regionkey", "n_nationkey", "n_name")


@query("SELECT l_orderkey, l_linenumber, (l_quantity + l_tax) * l_discount AS value FROM lineitem")
def expr_eval(spark, sf_dir):
    s = schemas.evaluate_request(2)
    lit, call = calculator.literal, calculator.expression_of
    # Both parameters of the outer call are calls: a sum and a product with one.
    inner = F.struct(F.lit("call").alias("which"), F.lit(None).cast("double").alias("literal"), call("add", lit(F.col("l_quantity")), lit(F.col("l_tax")))["call"].alias("call"))
    other = F.struct(F.lit("literal").alias("which"), F.col("l_discount").alias("literal"), F.when(F.lit(False), call("add", lit(F.col("l_quantity")), lit(F.col("l_tax")))["call"]).alias("call"))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", call("multiply", inner, other).alias("expression"))
    rows = fr.decode(fr.encode(df, s, keep=["l_orderkey", "l_linenumber"]), s, keep=["l_orderkey", "l_linenumber"])
    return rows.select("l_orderkey", "l_linenumber", calculator.eval_decoded(F.col("expression"), 2).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_totalprice / (o_custkey % 5) END AS value FROM orders")
def expr_eval_rowwise(spark, sf_dir):
    """The exact evaluation, frame by frame; division by zero is an error."""
    s = schemas.evaluate_request(1)
    df = table(spark, sf_dir, "orders").select("o_orderkey", calculator.expression_of("divide", calculator.literal(F.col("o_totalprice")), calculator.literal(F.col("o_custkey") % 5)).alias("expression"))
    return fr.encode(df, s, keep=["o_orderkey"]).select("o_orderkey", calculator.eval_expression(F.col("frame"), "PERMISSIVE").alias("value"))


# Pointer words.


@query("SELECT CAST(n AS BIGINT) AS n, CAST(n - 12 AS BIGINT) AS offset_words, CAST(n % 8 AS BIGINT) AS esize, CAST(n * 1000 AS BIGINT) AS count_elements, CASE WHEN n % 8 = 0 THEN 0 WHEN n % 8 = 7 THEN 0 ELSE CAST(floor((n * 1000 * CASE n % 8 WHEN 1 THEN 1 WHEN 2 THEN 8 WHEN 3 THEN 16 WHEN 4 THEN 32 WHEN 5 THEN 64 WHEN 6 THEN 64 END + 63) / 64) AS BIGINT) END AS words FROM (SELECT n_nationkey AS n FROM nation)")
def pointer_words(spark, sf_dir):
    n = F.col("n_nationkey").cast("long")
    w = native.make_list(n - 12, n % 8, n * 1000)
    df = table(spark, sf_dir, "nation").select(n.alias("n"), w.alias("w"))
    return df.select("n", native.pointer_offset("w").alias("offset_words"), native.list_esize("w").alias("esize"), native.list_count("w").alias("count_elements"), native.list_words(native.list_esize("w"), native.list_count("w")).cast("long").alias("words"))


@query("SELECT CAST(n AS BIGINT) AS n, CAST(12 - n AS BIGINT) AS offset_words, CAST(n AS BIGINT) AS dwords, CAST(n + 1 AS BIGINT) AS pwords, n % 2 = 0 AS two, CAST(n * 3 AS BIGINT) AS pad, CAST(n * 5 AS BIGINT) AS segment, CAST(n * 7 AS BIGINT) AS cap FROM (SELECT n_nationkey AS n FROM nation)")
def pointer_fields(spark, sf_dir):
    n = F.col("n_nationkey").cast("long")
    s, f, c = native.make_struct(12 - n, n, n + 1), native.make_far(n % 2 == 0, n * 3, n * 5), native.make_cap(n * 7)
    return table(spark, sf_dir, "nation").select(n.alias("n"), native.pointer_offset(s).alias("offset_words"), native.pointer_dwords(s).alias("dwords"), native.pointer_pwords(s).alias("pwords"), native.far_two(f).alias("two"), native.far_offset(f).alias("pad"), native.far_segment(f).alias("segment"), native.cap_index(c).alias("cap"))


# Schema catalog.


def _catalog() -> schema.Catalog:
    return schema.compile_request(schema.request_of("book.schema", [schemas.ADDRESS_BOOK], {"Adder": [("add", schemas.ADD_PARAMS, schemas.ADD_RESULTS)]}))


@query("SELECT * FROM (VALUES ('AddressBook', 'struct', 0, 1), ('Person', 'struct', 1, 4), ('PhoneNumber', 'struct', 1, 1), ('PhoneNumber_type', 'enum', NULL, NULL), ('Person_employment', 'struct', 1, 4), ('Adder', 'interface', NULL, NULL), ('add_Params', 'struct', 2, 0), ('add_Results', 'struct', 1, 0)) t(name, kind, dwords, pwords)")
def schema_catalog(spark, sf_dir):
    return _catalog().nodes_table(spark).where("kind <> 'file'").select("name", "kind", "dwords", "pwords")


@query("SELECT * FROM (VALUES ('AddressBook', 1), ('Person', 1), ('PhoneNumber', 1), ('PhoneNumber_type', 1), ('Person_employment', 2), ('Adder', 1), ('add_Params', 2), ('add_Results', 2)) t(name, level)")
def catalog_scope_closure(spark, sf_dir):
    c = _catalog()
    return c.scope_table(spark).join(c.nodes_table(spark), "id").select("name", "level")


@query("SELECT * FROM (VALUES ('AddressBook', 'people', 'list', CAST(0 AS BIGINT), NULL), ('Person', 'id', 'uint32', 0, NULL), ('Person', 'name', 'text', 0, NULL), ('Person', 'email', 'text', 1, NULL), ('Person', 'phones', 'list', 2, NULL), ('Person', 'employment', 'group', NULL, NULL), ('PhoneNumber', 'number', 'text', 0, NULL), ('PhoneNumber', 'type', 'enum', 0, NULL), ('Person_employment', 'unemployed', 'void', 0, 0), ('Person_employment', 'employer', 'text', 3, 1), ('Person_employment', 'school', 'text', 3, 2), ('Person_employment', 'selfEmployed', 'void', 0, 3)) t(struct, field, type, place, tag)")
def catalog_offsets(spark, sf_dir):
    return _catalog().fields_table(spark).where("not startswith(struct, 'add_')").select("struct", "field", "type", "place", "tag")


@query("SELECT * FROM (VALUES (0, 'mobile', 'PHONE_NUMBER_TYPE_MOBILE'), (1, 'home', 'PHONE_NUMBER_TYPE_HOME'), (2, 'work', 'PHONE_NUMBER_TYPE_WORK')) t(ordinal, name, constant)")
def catalog_enumerants(spark, sf_dir):
    return _catalog().enumerants_table(spark).select("ordinal", "name", "constant")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, n_name || '@example.com' AS email, 'school' AS which, 'S' || n_nationkey AS school FROM nation")
def compiled_layout_roundtrip(spark, sf_dir):
    """Written with built-in layouts, read with compiled ones."""
    key = F.col("n_nationkey").cast("string")
    work = F.struct(F.lit("school").alias("which"), F.concat(F.lit("S"), key).alias("school"))
    person = F.struct(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.concat("n_name", F.lit("@example.com")).alias("email"), work.alias("employment"))
    frames = fr.encode(table(spark, sf_dir, "nation").select(F.array(person).alias("people")), schemas.ADDRESS_BOOK)
    rows = fr.decode(frames, _catalog().layout("AddressBook")).select(F.inline("people"))
    return rows.select("id", "name", "email", "employment.which", "employment.school")


# RPC traffic.


def _log(df: DataFrame, conn: Column, seq: Column, **arms: Column) -> DataFrame:
    """A frame log from columns of a message: ``which`` and the arms in use."""
    rows = df.select(conn.cast("string").alias("conn_id"), seq.cast("long").alias("seq"), *[c.alias(k) for k, c in arms.items()])
    return fr.encode(rows, schemas.MESSAGE, keep=["conn_id", "seq"])


def _export(c: Column) -> Column:
    return F.struct(F.lit("importedCap").alias("which"), c.cast("long").alias("importedCap"))


def _hosted(c: Column) -> Column:
    cap = F.struct(F.lit("senderHosted").alias("which"), c.cast("long").alias("senderHosted"), F.lit(255).cast("short").alias("attachedFd"))
    return F.struct(F.array(cap).alias("capTable"))


def _conversation_log(spark, sf_dir, lost: bool = False) -> DataFrame:
    """System and user turns ask, assistant turns answer the turn before; with ``lost``, every third conversation's questions are not in the log."""
    d = table(spark, sf_dir, "conversations")
    if lost:
        d = d.where("role = 'assistant' or conv_id % 3 <> 0")
    asks = F.col("role") != "assistant"
    call = F.struct(F.col("turn").cast("long").alias("questionId"), _export(F.lit(0)).alias("target"), F.length("text").cast("long").alias("interfaceId"), (F.col("turn") % 3).cast("int").alias("methodId"))
    answer = F.struct((F.col("turn") - 1).cast("long").alias("answerId"), F.lit("results").alias("which"), _hosted(F.length("text")).alias("results"))
    return _log(d, F.col("conv_id"), F.col("turn"), which=F.when(asks, "call").otherwise("return"), call=F.when(asks, call), **{"return": F.when(~asks, answer)})


@query("SELECT CASE WHEN role = 'assistant' THEN 'return' ELSE 'call' END AS kind, count(*) AS n FROM conversations GROUP BY 1")
def rpc_message_counts(spark, sf_dir):
    return rpc.messages(_conversation_log(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT CAST(q.conv_id AS VARCHAR) AS conn_id, q.turn AS question_id, CAST(length(q.text) AS BIGINT) AS interface_id, CAST(a.turn AS BIGINT) AS return_seq, CAST(length(a.text) AS BIGINT) AS cap_id FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role <> 'assistant'")
def rpc_question_answer(spark, sf_dir):
    asked = rpc.questions(rpc.messages(_conversation_log(spark, sf_dir)))
    return asked.where("return_seq is not null").select("conn_id", "question_id", "interface_id", "return_seq", F.col("result_caps")[0]["senderHosted"].alias("cap_id"))


@query("SELECT CAST(q.conv_id AS VARCHAR) AS conn_id, q.turn AS question_id FROM conversations q WHERE q.role <> 'assistant' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant')")
def rpc_unanswered(spark, sf_dir):
    return rpc.unanswered(rpc.questions(rpc.messages(_conversation_log(spark, sf_dir)))).select("conn_id", "question_id")


@query("SELECT CAST(a.conv_id AS VARCHAR) AS conn_id, CAST(a.turn AS BIGINT) AS seq FROM conversations a WHERE a.role = 'assistant' AND (a.conv_id % 3 = 0 OR NOT EXISTS (SELECT 1 FROM conversations q WHERE q.conv_id = a.conv_id AND q.turn = a.turn - 1 AND q.role <> 'assistant')) AND a.turn > 0")
def rpc_orphan_returns(spark, sf_dir):
    return rpc.orphan_returns(rpc.messages(_conversation_log(spark, sf_dir, lost=True))).where("answer_id >= 0").select("conn_id", "seq")


@query("SELECT conn_id, export_id, seq, CAST(sum(delta) OVER (PARTITION BY conn_id, export_id ORDER BY seq) AS BIGINT) AS refcount FROM (SELECT CAST(user_id % 8 AS VARCHAR) AS conn_id, user_id AS export_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 1 ELSE -1 END AS delta FROM events WHERE event_type IN ('signup', 'error'))")
def rpc_refcounts(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('signup', 'error')")
    up = F.col("event_type") == "signup"
    answer = F.struct(F.col("event_id").alias("answerId"), F.lit("results").alias("which"), _hosted(F.col("user_id")).alias("results"))
    gone = F.struct(F.col("user_id").alias("id"), F.lit(1).cast("long").alias("referenceCount"))
    log = _log(e, F.col("user_id") % 8, F.col("event_id"), which=F.when(up, "return").otherwise("release"), **{"return": F.when(up, answer), "release": F.when(~up, gone)})
    return rpc.reference_counts(rpc.messages(log)).select("conn_id", "export_id", "seq", "refcount")


_PIPE = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS conn_id, event_id AS seq, event_id % 5 AS k, event_type FROM events WHERE event_type IN ('click', 'view', 'error', 'purchase')),
q AS (SELECT conn_id, k, seq, coalesce(lead(seq) OVER (PARTITION BY conn_id, k ORDER BY seq), 9223372036854775807) AS nxt FROM e WHERE event_type = 'click'),
a AS (SELECT q.conn_id, q.k, q.seq AS q_seq, (SELECT min(v.seq) FROM e v WHERE v.event_type = 'view' AND v.conn_id = q.conn_id AND v.k = q.k AND v.seq > q.seq AND v.seq < q.nxt) AS from_seq,
  (SELECT min(v.seq) FROM e v WHERE v.event_type = 'error' AND v.conn_id = q.conn_id AND v.k = q.k AND v.seq > q.seq AND v.seq < q.nxt) AS to_seq FROM q)
"""


#: The second capability of an answer is the first one's number and this.
_SECOND = 1_000_000_000


def _cap_tree() -> bytes:
    """A content with capability 0 in pointer 0, and capability 1 in pointer 0 of the struct in pointer 1."""
    b = Builder(64)
    root = b.init_root(0, 2)
    root.slot(0).set_cap(0)
    root.slot(1).init_struct(0, 1).slot(0).set_cap(1)
    return b.frame()


@query(_PIPE + f"SELECT p.conn_id, p.seq, a.from_seq IS NOT NULL AS resolved, CASE p.seq % 4 WHEN 1 THEN a.from_seq WHEN 2 THEN a.from_seq + {_SECOND} END AS export_id FROM (SELECT * FROM e WHERE event_type = 'purchase') p LEFT JOIN a ON a.from_seq IS NOT NULL AND a.conn_id = p.conn_id AND a.k = p.k AND p.seq >= a.from_seq AND (a.to_seq IS NULL OR p.seq < a.to_seq)")
def rpc_pipelined(spark, sf_dir):
    """Calls on answers whose content holds two capabilities; paths lead to one, the other, a struct, or nowhere."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'view', 'error', 'purchase')")
    k, t, n = F.col("event_id") % 5, F.col("event_type"), F.col("event_id")
    ops = lambda *path: F.array(*[F.struct(F.lit("getPointerField").alias("which"), F.lit(i).alias("getPointerField")) for i in path])
    path = F.when(n % 4 == 1, ops(0)).when(n % 4 == 2, ops(1, 0)).when(n % 4 == 3, ops(1)).otherwise(ops(7))
    answer_of = F.struct(k.alias("questionId"), path.alias("transform"))
    target = F.struct(F.when(t == "click", "importedCap").otherwise("promisedAnswer").alias("which"), F.when(t == "click", F.lit(0).cast("long")).alias("importedCap"), F.when(t != "click", answer_of).alias("promisedAnswer"))
    call = F.struct(F.when(t == "click", k).otherwise(1000 + n).alias("questionId"), target.alias("target"))
    caps = [F.struct(F.lit("senderHosted").alias("which"), (n + x).alias("senderHosted"), F.lit(255).cast("short").alias("attachedFd")) for x in (0, _SECOND)]
    payload = F.struct(F.lit(_cap_tree()).alias("content"), F.array(*caps).alias("capTable"))
    answer = F.struct(k.alias("answerId"), F.lit("results").alias("which"), payload.alias("results"))
    kind = F.when(t.isin("click", "purchase"), "call").when(t == "view", "return").otherwise("finish")
    log = _log(e, F.col("user_id"), n, which=kind, call=F.when(t.isin("click", "purchase"), call), finish=F.when(t == "error", F.struct(k.alias("questionId"))), **{"return": F.when(t == "view", answer)})
    msgs = rpc.messages(log)
    return rpc.pipelined(msgs, rpc.questions(msgs)).select("conn_id", "seq", "resolved", "export_id")


#: Part numbers and counts of a user's first seven events, by user number modulo 3: whole joins, a repeated part, and parts that disagree.
_PARTS = (((0, 3), (1, 3), (2, 3), (0, 3), (1, 3), (2, 3), (0, 3)), ((0, 3), (0, 3), (1, 3), (2, 3), (0, 3), (1, 3), (2, 3)), ((0, 3), (1, 3), (2, 4), (2, 3), (5, 3), (0, 3), (1, 3)))
#: The join, counted anew after each complete one, that those events belong to; -1: the part fails by itself.
_ROUNDS = ((0, 0, 0, 1, 1, 1, 2), (0, -1, 0, 0, 1, 1, 1), (0, 0, -1, 0, -1, 1, 1))


@query(
    "WITH p(c, l, part, round) AS (VALUES " + ", ".join(f"({c}, {i + 1}, {_PARTS[c][i][0]}, {_ROUNDS[c][i]})" for c in range(3) for i in range(7)) + """),
n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
j AS (SELECT user_id AS join_id, event_id AS seq, part, round, event_id % 2 AS e FROM n JOIN p ON c = user_id % 3 AND l = nth),
r AS (SELECT join_id, round, min(e) AS lo, max(e) AS hi FROM j WHERE round >= 0 GROUP BY 1, 2 HAVING count(*) = 3)
SELECT join_id, seq, part AS part_num, coalesce(lo = hi, FALSE) AS succeeded, CASE WHEN lo = hi AND part = 0 THEN lo END AS export_id
FROM j LEFT JOIN r USING (join_id, round) WHERE round = -1 OR lo IS NOT NULL"""
)
def rpc_join_complete(spark, sf_dir):
    """Joins of three parts, some with repeated parts or other counts, one after the other under the same number."""
    e = table(spark, sf_dir, "events").withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("nth <= 7")
    at = F.get(F.get(F.lit([[list(x) for x in c] for c in _PARTS]), (F.col("user_id") % 3).cast("int")), F.col("nth") - 1)
    key = F.struct(F.col("user_id").alias("joinId"), F.get(at, F.lit(1)).alias("partCount"), F.get(at, F.lit(0)).alias("partNum"))
    join = F.struct(F.col("event_id").alias("questionId"), _export(F.col("event_id") % 2).alias("target"), key.alias("keyPart"))
    log = _log(e, F.lit("c"), F.col("event_id"), which=F.lit("join"), join=join)
    parts = rpc.messages(log).select("conn_id", "join_id", "seq", "part_num", "part_count", F.col("target_export").alias("export_id"))
    return rpc.join_results(parts).select("join_id", "seq", "part_num", "succeeded", "export_id")


def _hand_off_log(spark, sf_dir) -> DataFrame:
    """Signups provide, purchases accept, under the user's number; errors lift the embargo of the provision before them."""
    e = table(spark, sf_dir, "events").where("event_type in ('signup', 'purchase', 'error')")
    kind = F.col("event_type")
    before = F.max(F.when(kind == "signup", F.col("event_id"))).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("provided", F.coalesce(before, F.lit(0)))
    offer = F.struct(F.col("event_id").alias("questionId"), _export(F.lit(0)).alias("target"), F.struct(F.col("user_id").alias("nonce")).alias("recipient"))
    take = F.struct(F.col("event_id").alias("questionId"), F.struct(F.col("user_id").alias("nonce")).alias("provision"), (F.col("event_id") % 2 == 0).alias("embargo"))
    lift = F.struct(_export(F.lit(0)).alias("target"), F.struct(F.lit("provide").alias("which"), F.col("provided").alias("provide")).alias("context"))
    which = F.when(kind == "signup", "provide").when(kind == "purchase", "accept").otherwise("disembargo")
    return _log(e, F.col("user_id") % 4, F.col("event_id"), which=which, provide=F.when(kind == "signup", offer), accept=F.when(kind == "purchase", take), disembargo=F.when(kind == "error", lift))


@query("SELECT user_id AS nonce, event_id AS accept_seq, CASE WHEN before = 'signup' THEN before_id END AS provide_seq FROM (SELECT *, lag(event_type) OVER w AS before, lag(event_id) OVER w AS before_id FROM events WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = 'purchase'")
def rpc_provision_claims(spark, sf_dir):
    msgs = rpc.messages(_hand_off_log(spark, sf_dir)).withColumn("vat_id", F.lit("v"))
    return rpc.claims(msgs.where("kind = 'provide'"), msgs.where("kind = 'accept'")).select("nonce", "accept_seq", "provide_seq")


@query("SELECT user_id AS nonce, max(event_id) AS provide_seq FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1 HAVING arg_max(event_type, event_id) = 'signup'")
def rpc_unclaimed(spark, sf_dir):
    msgs = rpc.messages(_hand_off_log(spark, sf_dir)).withColumn("vat_id", F.lit("v"))
    return rpc.unclaimed(msgs.where("kind = 'provide'"), msgs.where("kind = 'accept'")).select("nonce", "provide_seq")


@query("""
WITH e AS (
  SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before, lag(event_id) OVER w AS provided FROM events WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
lifts AS (
  SELECT user_id, event_id, event_type, max(event_id) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id) AS provided FROM events WHERE event_type IN ('signup', 'error'))
SELECT event_id AS question_id, user_id AS nonce FROM e WHERE event_type = 'purchase' AND event_id % 2 = 0 AND before = 'signup'
  AND NOT EXISTS (SELECT 1 FROM lifts l WHERE l.event_type = 'error' AND l.user_id = e.user_id AND l.provided = e.provided AND l.event_id > e.event_id)
""")
def rpc_embargoed(spark, sf_dir):
    return rpc.embargoed(rpc.messages(_hand_off_log(spark, sf_dir)).withColumn("vat_id", F.lit("v"))).select("question_id", "nonce")


def _introduction_log(spark, sf_dir) -> DataFrame:
    """Views introduce a capability, errors release its vine."""
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'error')")
    view = F.col("event_type") == "view"
    third = F.struct(F.struct(F.struct(F.concat(F.lit("host"), F.col("user_id").cast("string")).alias("host"), (F.col("event_id") % 60000).cast("int").alias("port")).alias("vat"), F.col("user_id").alias("nonce")).alias("id"), (F.col("user_id") * 3).alias("vineId"))
    cap = F.struct(F.lit("thirdPartyHosted").alias("which"), third.alias("thirdPartyHosted"), F.lit(255).cast("short").alias("attachedFd"))
    call = F.struct(F.col("event_id").alias("questionId"), _export(F.lit(0)).alias("target"), F.struct(F.array(cap).alias("capTable")).alias("params"))
    gone = F.struct((F.col("user_id") * 3).alias("id"), F.lit(1).cast("long").alias("referenceCount"))
    return _log(e, F.col("user_id") % 4, F.col("event_id"), which=F.when(view, "call").otherwise("release"), call=F.when(view, call), release=F.when(~view, gone))


@query("SELECT CAST(user_id % 4 AS VARCHAR) AS conn_id, user_id AS nonce, max(event_id) AS seq, 'host' || user_id AS host, CAST(max(event_id) % 60000 AS INTEGER) AS port, user_id * 3 AS vine_id FROM events WHERE event_type = 'view' GROUP BY user_id")
def rpc_introductions_latest(spark, sf_dir):
    return rpc.introductions(rpc.messages(_introduction_log(spark, sf_dir))).select("conn_id", "nonce", "seq", "host", "port", "vine_id")


@query("SELECT user_id AS nonce, max(event_id) FILTER (event_type = 'view') AS seq FROM events WHERE event_type IN ('view', 'error') GROUP BY 1 HAVING arg_max(event_type, event_id) = 'view'")
def rpc_pending_introductions(spark, sf_dir):
    msgs = rpc.messages(_introduction_log(spark, sf_dir))
    return rpc.pending_introductions(rpc.introductions(msgs), msgs).select("nonce", "seq")


@query("SELECT CAST(user_id AS VARCHAR) AS conn_id, event_id AS seq, event_id AS context_id FROM events WHERE event_type = 'click'")
def rpc_disembargo_echo(spark, sf_dir):
    click = F.col("event_type") == "click"
    context = F.struct(F.when(click, "senderLoopback").otherwise("receiverLoopback").alias("which"), F.col("event_id").alias("senderLoopback"), F.col("event_id").alias("receiverLoopback"))
    log = _log(table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id"), which=F.lit("disembargo"), disembargo=F.struct(_export(F.lit(0)).alias("target"), context.alias("context")))
    return rpc.echoes(rpc.messages(log))


@query("SELECT event_id AS seq, CASE WHEN lag(event_id, 16) OVER w IS NULL THEN TRUE ELSE lag(event_id + (event_id * 7) % 4000, 16) OVER w <= event_id END AS fits FROM events WINDOW w AS (PARTITION BY user_id % 64 ORDER BY event_id)")
def rpc_stream_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 64).alias("conn_id"), F.col("event_id").alias("send_seq"), (F.col("event_id") + (F.col("event_id") * 7) % 4000).alias("return_seq"))
    return rpc.stream_window(e).select(F.col("send_seq").alias("seq"), "fits")


def _outcome_log(spark, sf_dir) -> DataFrame:
    bad = F.col("event_type") == "error"
    answer = F.struct(F.col("event_id").alias("answerId"), F.when(bad, "exception").otherwise("results").alias("which"), F.when(bad, F.struct(F.col("props").alias("reason"))).alias("exception"), F.when(~bad, _hosted(F.col("event_id"))).alias("results"))
    return _log(table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id"), which=F.lit("return"), **{"return": answer})


@query("SELECT CAST(user_id AS VARCHAR) AS conn_id, event_id AS seq, props AS reason FROM events WHERE event_type = 'error'")
def rpc_exceptions(spark, sf_dir):
    return rpc.exceptions(rpc.messages(_outcome_log(spark, sf_dir))).select("conn_id", "seq", "reason")


@query("SELECT CAST(conv_id AS VARCHAR) AS conn_id, CAST(turn AS BIGINT) AS seq, CASE turn % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'read' END AS method FROM conversations WHERE role <> 'assistant'")
def method_catalog_join(spark, sf_dir):
    msgs = rpc.messages(_conversation_log(spark, sf_dir)).where("kind = 'call'").withColumn("interface_id", F.lit(9).cast("long"))
    methods = spark.createDataFrame([(9, 0, "File", "open"), (9, 1, "File", "read")], "interface_id bigint, ordinal int, interface string, method string")
    return rpc.with_methods(msgs, methods).select("conn_id", "seq", "method")


@query("SELECT CAST(user_id % 8 AS VARCHAR) AS vat_id, event_type AS said, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def rpc_replay_counts(spark, sf_dir):
    """A server replayed over a log: clicks ask for the bootstrap object, views for a loopback."""
    from ..streaming.replay import replay_batch

    return _sent_counts(replay_batch(_server_log(table(spark, sf_dir, "events"))))


def _server_log(events: DataFrame) -> DataFrame:
    e = events.where("event_type in ('click', 'view')")
    click = F.col("event_type") == "click"
    context = F.struct(F.lit("senderLoopback").alias("which"), F.col("event_id").alias("senderLoopback"))
    rows = _log(e, F.col("user_id") % 8, F.col("event_id"), which=F.when(click, "bootstrap").otherwise("disembargo"), bootstrap=F.when(click, F.struct(F.col("event_id").alias("questionId"))), disembargo=F.when(~click, F.struct(_export(F.lit(0)).alias("target"), context.alias("context"))))
    return rows.withColumn("vat_id", F.col("conn_id"))


def _sent_counts(sent: DataFrame) -> DataFrame:
    msgs = rpc.messages(sent, keep=["vat_id"])
    return msgs.groupBy("vat_id", F.when(F.col("kind") == "return", "click").otherwise("view").alias("said")).agg(F.count("*").alias("n"))


@query(ORACLE_SQL["rpc_replay_counts"])
def stream_equals_batch_rpc(spark, sf_dir):
    """The same server as a stateful stream over the same events, run until all input is read."""
    from ..streaming import replay

    replay.prepare(spark)
    shape = table(spark, sf_dir, "events").schema
    # A stream takes folders or patterns; this one fits a file and a folder of files alike.
    events = spark.readStream.schema(shape).parquet(f"{sf_dir}/events.parque[t]")
    return _sent_counts(replay.finished(replay.replay_stream(_server_log(events))))


@query("SELECT CAST(user_id AS VARCHAR) AS conn_id, event_id AS seq, 'resolve' AS kind FROM events WHERE event_type = 'error'")
def rpc_unimplemented(spark, sf_dir):
    """Errors resolve a promise, which a server of this level sends back; views disembargo, which it does not."""
    bad = F.col("event_type") == "error"
    context = F.struct(F.lit("senderLoopback").alias("which"), F.col("event_id").alias("senderLoopback"))
    loop = F.struct(_export(F.lit(0)).alias("target"), context.alias("context"))
    log = _log(table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id"), which=F.when(bad, "resolve").otherwise("disembargo"), resolve=F.when(bad, F.struct(F.col("event_id").alias("promiseId"), F.lit("exception").alias("which"), F.struct(F.col("props").alias("reason")).alias("exception"))), disembargo=F.when(~bad, loop))
    return rpc.unimplemented(rpc.messages(log))


@query("SELECT CAST(q.conv_id AS VARCHAR) AS conn_id, q.turn AS question_id, CAST(coalesce(length(a.text), -1) AS BIGINT) AS cap_id FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role <> 'assistant'")
def rpc_answer_cap(spark, sf_dir):
    return rpc.answer_cap(rpc.questions(rpc.messages(_conversation_log(spark, sf_dir))))


@query("SELECT CAST(user_id % 16 AS VARCHAR) AS conn_id, min(event_id) AS question_id FROM events WHERE event_id % 10 = 0 OR event_type = 'error' GROUP BY 1")
def rpc_first_failure(spark, sf_dir):
    """Each event is a call and, but for every tenth, its return; errors return an exception."""
    e = table(spark, sf_dir, "events").withColumn("answer", F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    bad, n = F.col("event_type") == "error", F.col("event_id")
    call = F.struct(n.alias("questionId"), _export(F.lit(0)).alias("target"))
    answer = F.struct(n.alias("answerId"), F.when(bad, "exception").otherwise("results").alias("which"), F.when(bad, F.struct(F.col("props").alias("reason"))).alias("exception"), F.when(~bad, _hosted(n)).alias("results"))
    log = _log(e, F.col("user_id") % 16, n * 2 + F.col("answer").cast("int"), which=F.when(F.col("answer"), "return").otherwise("call"), call=F.when(~F.col("answer"), call), **{"return": F.when(F.col("answer"), answer)})
    return rpc.first_failure(rpc.questions(rpc.messages(log)))


@query("SELECT user_id AS id, list(event_type = 'click' ORDER BY event_id) AS flags FROM events GROUP BY 1")
def list_bool_events(spark, sf_dir):
    """Lists of single bits."""
    s = Struct("Flags", 1, 1, (Field("id", INT64, 0), Field("flags", list_of(BOOL), 0)))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_type") == "click").alias("f")))), lambda x: x["f"])
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(in_order.alias("flags"))
    return fr.decode(fr.encode(rows, s), s)


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey * 3 AS BIGINT) AS cap FROM nation")
def capability_pointers(spark, sf_dir):
    """Capability pointers keep their number."""
    s = Struct("Holder", 1, 1, (Field("id", INT64, 0), Field("cap", CAP, 0)))
    n = F.col("n_nationkey").cast("long")
    rows = table(spark, sf_dir, "nation").select(n.alias("id"), F.struct((n * 3).alias("cap_index")).alias("cap"))
    return fr.decode(fr.encode(rows, s), s).select("id", F.col("cap.cap_index").alias("cap"))


@query("SELECT * FROM (VALUES ('nodes', 9), ('file', 1), ('struct', 6), ('enum', 1), ('interface', 1)) t(what, n)")
def catalog_summary(spark, sf_dir):
    return spark.createDataFrame([(k, v) for k, v in _catalog().summary().items() if k != "files"], "what string, n int")


@query("SELECT * FROM (VALUES ('enum', 1), ('group', 1), ('interface', 1), ('struct', 5), ('field', 15)) t(kind, n)")
def catalog_described(spark, sf_dir):
    """Lines of the catalog as text, by what they describe; fields are indented."""
    lines = spark.createDataFrame([(x,) for x in _catalog().describe().splitlines()], "line string")
    return lines.groupBy(F.when(F.col("line").startswith("  "), "field").otherwise(F.split_part("line", F.lit(" "), F.lit(1))).alias("kind")).agg(F.count("*").cast("int").alias("n"))


# What decoding opens up: any relational operator.


def _decoded(spark, sf_dir, name: str, *columns: str) -> DataFrame:
    df = table(spark, sf_dir, name)
    s = fr.layout_for(df)
    return fr.decode(fr.encode(df, s), s, columns=list(columns) or None)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) / 100.0 AS DOUBLE) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def relational_rollup(spark, sf_dir):
    return _decoded(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), cents("l_quantity").alias("quantity"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def relational_cube(spark, sf_dir):
    return _decoded(spark, sf_dir, "orders", "o_orderstatus", "o_orderpriority").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders QUALIFY nth <= 3")
def relational_window_topk(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _decoded(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice").withColumn("nth", F.row_number().over(w).cast("long")).where("nth <= 3").select("o_custkey", "o_orderkey", "nth")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def relational_sort_limit(spark, sf_dir):
    return _decoded(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def relational_semi(spark, sf_dir):
    done = _decoded(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'F'")
    return _decoded(spark, sf_dir, "customer", "c_custkey").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def relational_anti(spark, sf_dir):
    return _decoded(spark, sf_dir, "customer", "c_custkey").join(_decoded(spark, sf_dir, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT event_id, (SELECT max(v.event_id) FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.event_id < p.event_id) AS view_id FROM events p WHERE event_type = 'purchase'")
def relational_asof(spark, sf_dir):
    e = _decoded(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("view_id", F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).over(w)).where("event_type = 'purchase'").select("event_id", "view_id")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def relational_intersect(spark, sf_dir):
    return _decoded(spark, sf_dir, "customer", "c_nationkey").select(F.col("c_nationkey").alias("k")).intersect(_decoded(spark, sf_dir, "supplier", "s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def relational_except(spark, sf_dir):
    return _decoded(spark, sf_dir, "nation", "n_nationkey").select(F.col("n_nationkey").alias("k")).exceptAll(_decoded(spark, sf_dir, "supplier", "s_nationkey", "s_acctbal").where("s_acctbal > 5000").select("s_nationkey").distinct())


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def relational_join(spark, sf_dir):
    return _decoded(spark, sf_dir, "customer", "c_nationkey").join(_decoded(spark, sf_dir, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


