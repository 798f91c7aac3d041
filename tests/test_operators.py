"""Operators on DataFrames: decode options, native expressions, types, the data source."""

import datetime
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomframe import schemas
from loomframe.functions import calculator, native
from loomframe.kernel import columnar, wire
from loomframe.kernel.wire import FrameError
from loomframe.layout import TEXT, UINT32, Field, Struct
from loomframe.operators import frames as fr
from loomframe.sources.frames import FrameSource


def test_all_types_and_nulls(spark):
    day, moment = datetime.date(2024, 2, 29), datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    schema = "b boolean, i8 tinyint, i16 smallint, i32 int, i64 bigint, f float, d double, s string, x binary, dt date, ts timestamp, tn timestamp_ntz, de decimal(12,3), a array<int>, st struct<p: int, q: array<string>>, bs array<boolean>"
    rows = [
        (True, -1, -300, 1 << 30, -(1 << 62), 1.5, -2.25, "é\0x", b"\0\xff", day, moment, moment, Decimal("-12345.678"), [1, -2], (7, ["a", ""]), [True] * 70),
        (None,) * 16,
        (False, 0, 0, 0, 0, 0.0, 0.0, "", b"", day, moment, moment, Decimal("0.000"), [], (None, []), []),
    ]
    df = spark.createDataFrame(rows, schema)
    s = fr.layout_for(df)
    assert fr.decode(fr.encode(df, s), s).collect() == df.collect()
    one = fr.decode(fr.encode(df, s), s, into="r").select("r.*").collect()
    assert one == df.collect()
    plain = fr.layout_for(df, "default")
    assert fr.decode(fr.encode(df, plain), plain, columns=["i32", "s"]).collect()[1] == (0, "")
    with pytest.raises(Exception, match="ARG"):
        fr.encode(df.select("i32"), on_null="error").collect()


def test_empty_table_and_null_frames(spark):
    s = Struct("t", 1, 1, (Field("k", UINT32, 0, 5), Field("t", TEXT, 0, "none")))
    assert fr.decode(spark.createDataFrame([], "frame binary"), s).collect() == []
    assert fr.decode(spark.createDataFrame([(None,)], "frame binary"), s).collect() == [(None, None)]
    null_root = wire.frame_of([bytes(8)])
    rows = spark.createDataFrame([(1, null_root)], "id int, frame binary")
    assert fr.decode(rows, s, keep=["id"]).collect() == [(1, None, None)]
    assert fr.decode(rows, s, fill_null=True).collect() == [(5, "none")]


def test_modes_and_pruning(spark):
    # The pointer in slot 0 is no text; who does not ask for it does not see it.
    body = [wire.struct_word(0, 1, 1), 9, wire.struct_word(-1, 0, 0)]
    bad = wire.frame_of([b"".join(w.to_bytes(8, "little") for w in body)])
    s = Struct("t", 1, 1, (Field("k", UINT32, 0), Field("t", TEXT, 0, "")))
    df = spark.createDataFrame([(bad,), (b"short",)], "frame binary")
    rows = fr.decode(df, s, mode="PERMISSIVE").collect()
    assert [r["_error"]["code"] for r in rows] == ["KIND", "FRAMING"] and rows[0]["k"] is None
    assert fr.decode(df, s, columns=["k"], mode="DROPMALFORMED").collect() == [(9,)]
    with pytest.raises(Exception, match="FRAMING"):
        fr.decode(df, s, columns=["k"]).collect()


def test_native_expressions(spark):
    frame = wire.frame_of([b"\1" * 8, b"\2" * 16, b""])
    row = spark.createDataFrame([(frame,)], "f binary").select(
        native.segment_count("f").alias("n"), native.segment_words("f").alias("w"), native.header_bytes("f").alias("h"), native.frame_bytes("f").alias("b"),
        native.split_segments("f").alias("s"), native.frame_segments(native.split_segments("f")).alias("f2"), native.le_int("f", 16, 8).alias("i"), native.le_uint("f", 999, 4).alias("none"),
    ).first()
    assert (row.n, row.w, row.h, row.b, row.none) == (3, [1, 2, 0], 16, len(frame), None)
    assert [bytes(x) for x in row.s] == [b"\1" * 8, b"\2" * 16, b""] and bytes(row.f2) == frame and row.i == int.from_bytes(b"\1" * 8, "little")
    numbers = spark.createDataFrame([(v,) for v in (0, 1, -1, 255, -(1 << 31), (1 << 31) - 1)], "v bigint")
    assert all(r.v == r.u for r in numbers.select("v", native.le_int(native.le_bytes("v", 4), 0, 4).alias("u")).collect())
    lists = spark.createDataFrame([([1, 2],), (None,)], "a array<int>")
    got = lists.select(native.list_length("a").alias("n"), native.list_at("a", 1, F.lit(9)).alias("x"), native.list_at("a", 7, F.lit(9)).alias("y"), native.lift_scalars("a", x=F.lit(3)).alias("l")).collect()
    assert (got[0].n, got[0].x, got[0].y, got[1].n) == (2, 2, 9, 0) and got[0].l[1] == (2, 3)
    for bad in (native.list_at("a", -1), native.lift_bits("a")):
        with pytest.raises(Exception, match="BOUNDS|KIND"):
            lists.select(bad.alias("x")).collect()


def test_fixed_fields_fall_back_to_null(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    s = fr.layout_for(df, "default")
    at = next(f.at for f in s.fields if f.name == "n_nationkey")
    frames = fr.encode(df, s)
    assert sorted(r[0] for r in frames.select(native.fixed_field("frame", at, "int32")).collect()) == list(range(25))
    many = frames.select(fr.resegment("frame", 1).alias("frame"))
    assert {r[0] for r in many.select(native.fixed_field("frame", at, "int32")).collect()} == {None}
    beyond = frames.select(native.fixed_field("frame", 64, "int32", -7).alias("d"), native.fixed_field("frame", 700, "bool", 1).alias("b")).first()
    assert beyond == (-7, True)


def test_calculator(spark):
    lit, call = calculator.literal, calculator.expression_of
    df = spark.range(1).select(call("add", lit(F.lit(2)), lit(F.lit(3))).alias("expression"))
    frames = fr.encode(df, schemas.evaluate_request(2))
    assert len(frames.first()[0]) == 104 and frames.select(calculator.eval_expression("frame")).first()[0] == 5
    none = fr.encode(spark.range(1).select(call("divide", lit(F.lit(2)), lit(F.lit(0))).alias("expression")), schemas.evaluate_request(1))
    assert none.select(calculator.eval_expression("frame", "PERMISSIVE")).first()[0] is None
    assert fr.decode(none, schemas.evaluate_request(1)).select(calculator.eval_decoded(F.col("expression"), 1)).first()[0] is None
    with pytest.raises(Exception, match="ARG"):
        none.select(calculator.eval_expression("frame")).collect()


def test_source_round_trip(spark, sf_dir, tmp_path):
    spark.dataSource.register(FrameSource)
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    s = fr.layout_for(df)
    path = str(tmp_path / "frames")
    frames = fr.encode(df, s).repartition(3)
    for mode in ("append", "overwrite", "append"):
        frames.write.format("frames").mode(mode).save(path)
    read = spark.read.format("frames").load(path)
    assert read.count() == 2 * df.count()
    split = spark.read.format("frames").option("indexed", "true").option("splitBytes", "2000").load(path)
    assert split.rdd.getNumPartitions() > 6
    assert sorted(fr.decode(split, s).distinct().collect()) == sorted(df.collect())
    one = read.select("path").first()[0]
    want = read.where(F.col("path") == one).count()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    some = spark.read.format("frames").option("pushFilters", "true").load(path).where(F.col("path") == one)
    assert some.count() == want and some.rdd.getNumPartitions() == 1
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    whole = spark.read.format("binaryFile").load(path + "/*.frames").select("content")
    assert fr.split_frames(whole).count() == 2 * df.count()


def test_source_stream(spark, sf_dir, tmp_path):
    spark.dataSource.register(FrameSource)
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    s = fr.layout_for(df)
    inp, out = str(tmp_path / "in"), str(tmp_path / "out")
    fr.encode(df, s).coalesce(1).write.format("frames").mode("append").save(inp)
    stream = spark.readStream.format("frames").option("stream", "true").load(inp)
    stream.select("frame").writeStream.format("frames").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination()
    assert sorted(fr.decode(spark.read.format("frames").load(out), s).collect()) == sorted(df.collect())
    # A second file, half a frame at first, and the rest of it: only whole frames come, once each.
    frame = bytes(fr.encode(df, s).first()[0])
    more = tmp_path / "in" / "more.frames"
    shown = stream.writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "cp2"))
    for part in (frame + frame[:9], frame[9:] + frame):
        with open(more, "ab") as f:
            f.write(part)
        shown.trigger(once=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "rows"))
    late = rows.where(F.col("conn_id").endswith("more.frames")).orderBy("seq").collect()
    assert [(r.seq, bytes(r.frame)) for r in late] == [(0, frame), (1, frame), (2, frame)] and rows.count() == 28


def test_error_travels():
    import pickle

    e = pickle.loads(pickle.dumps(FrameError("KIND", "x")))
    assert e.code == "KIND" and e.message == "x"


def test_index_of_written_files(tmp_path, monkeypatch):
    """The writer notes frame starts, so that neither a split nor a stream walks its files; other and changed files are walked."""
    from loomframe.sources import frames as source

    monkeypatch.setattr(source, "INDEX_STEP", 500)
    path = str(tmp_path / "noted")
    shape = Struct("S", 0, 1, (Field("s", TEXT, 0),))
    data = [bytes(columnar.encode(pa.array([{"s": "x" * 7 * n}], shape.arrow()), shape)[0].as_py()) for n in range(3)] * 40
    writer = source.FrameWriter({"path": path}, True)
    writer.commit([writer.write({"frame": x} for x in data)])
    (file, size), = source._files(path).items()
    noted = source._index(file, size)
    assert noted["frames"] == 120 and len(noted["starts"]) > 5
    reader = source.FrameReader({"path": path, "indexed": "true", "splitBytes": "1000"})
    parts = reader.partitions()
    assert len(parts) > 2 and [x for p in parts for *_, x in reader.read(p)] == data
    walked = []
    monkeypatch.setattr(source, "lengths", lambda *a, real=source.lengths: walked.append(a) or real(*a))
    stream = source.FrameStreamReader({"path": f"file://{path}"})
    assert list(stream.latestOffset().values()) == [[size, 120]] and not walked
    with open(file, "ab") as f:
        f.write(data[0])
    assert list(stream.latestOffset().values()) == [[size + len(data[0]), 121]] and len(walked) == 1
    assert len(reader.partitions()) > 2 and len(walked) == 2
