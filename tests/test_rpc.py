"""The server's state machine, the client, and streams over frames."""

import pandas as pd
import pyarrow as pa
import pytest

from loomframe import schemas
from loomframe.kernel import columnar
from loomframe.kernel.wire import FrameError
from loomframe.rpc import tables, vat
from loomframe.streaming import replay

ADDER = schemas.ADDER_ID


def add(params):
    params.set(0, "int64", 20)
    params.set(8, "int64", 22)


HANDLERS = {(ADDER, 0): lambda obj, p, r: r.set(0, "int64", p.number(0, "int64") + p.number(8, "int64")), (ADDER, 1): lambda obj, p, r: "child"}


def say(v, conn, *frames):
    out = []
    for f in frames:
        sent = v.receive(conn, f, HANDLERS)
        value = columnar.decode(pa.array([x for _, x in sent], pa.binary()), schemas.MESSAGE)[0].to_pylist() if sent else []
        for (to, _), m in zip(sent, value):
            b = m[m["which"]]
            if m["which"] == "return":
                caps = [c["senderHosted"] for c in ((b["results"] or {}).get("capTable") or [])]
                out.append((to, b["answerId"], b["which"], caps))
            else:
                out.append((to, m["which"]))
    return out


def test_bootstrap_call_pipeline_finish():
    v = vat.Vat()
    assert say(v, "c", vat.bootstrap(1)) == [("c", 1, "results", [0])]
    assert say(v, "c", vat.call(2, (1, []), ADDER, 0, (2, 0), add)) == [("c", 2, "results", [])]
    assert say(v, "c", vat.call(3, 0, ADDER, 1), vat.call(4, (3, [0]), ADDER, 0, (2, 0), add)) == [("c", 3, "results", [1]), ("c", 4, "results", [])]
    assert say(v, "c", vat.finish(1), vat.call(5, (1, []), ADDER, 0)) == [("c", 5, "exception", [])]
    assert say(v, "c", vat.call(6, 0, ADDER, 9), vat.call(7, 77, ADDER, 0), vat.call(8, (2, [0]), ADDER, 0)) == [("c", 6, "exception", []), ("c", 7, "exception", []), ("c", 8, "exception", [])]
    assert v.live_exports("c") == [0, 1]
    assert say(v, "c", vat.release(0, 1), vat.release(1, 5)) == [] and v.live_exports("c") == []
    assert say(vat.Vat(root=None), "c", vat.bootstrap(1)) == [("c", 1, "exception", [])]


def test_joins():
    v = vat.Vat()
    say(v, "c", vat.bootstrap(0))
    assert say(v, "c", vat.join(50, 0, 9, 2, 0), vat.join(51, 0, 9, 2, 1)) == [("c", 50, "results", [0]), ("c", 51, "results", [])]
    assert say(v, "c", vat.join(52, 0, 8, 2, 7)) == [("c", 52, "results", [])]
    assert say(v, "c", vat.join(53, 0, 7, 2, 0), vat.join(54, 5, 7, 2, 1)) == [("c", 53, "results", []), ("c", 54, "results", [])]
    assert say(v, "c", vat.join(55, 0, 6, 2, 0)) == [] and say(v, "c", vat.join(56, 0, 6, 3, 1)) == [("c", 56, "results", [])]


def test_three_parties():
    v = vat.Vat()
    say(v, "a", vat.bootstrap(0))
    assert say(v, "a", vat.provide(42, 0, "127.0.0.1", 4000, 0xFEEDFACE)) == [("a", 42, "results", [])] and v.pending_provisions() == [0xFEEDFACE]
    assert say(v, "b", vat.accept(43, 0xFEEDFACE), vat.accept(44, 0xFEEDFACE)) == [("b", 43, "results", [0]), ("b", 44, "exception", [])]
    say(v, "a", vat.provide(70, 0, "h", 1, 5))
    assert say(v, "b", vat.accept(71, 5, True)) == [] and v.embargoed_accepts() == 1
    assert say(v, "a", vat.disembargo("provide", 999)) == [] and say(v, "b", vat.disembargo("provide", 70)) == []
    assert say(v, "a", vat.disembargo("provide", 70)) == [("b", 71, "results", [0])] and v.embargoed_accepts() == 0
    old = vat.Vat(compat=True)
    say(old, "a", vat.bootstrap(0), vat.provide(70, 0, "h", 1, 5))
    say(old, "b", vat.accept(71, 5, True))
    assert say(old, "a", vat.disembargo("provide", 70)) == [] and say(old, "b", vat.disembargo("provide", 70)) == [("b", 71, "results", [0])]
    say(v, "a", vat.call(44, 0, 0x1234, 0, third_party=("10.0.0.7", 5000, 0xABCDEF, 77)))
    assert v.pending_introductions("a") == [0xABCDEF] and v.pick_up("a", 0xABCDEF) == vat.release(77, 1) and v.pending_introductions("a") == []


def test_disembargo_and_unknown():
    v = vat.Vat()
    assert say(v, "c", vat.disembargo("senderLoopback", 12345)) == [("c", "disembargo")] and say(v, "c", vat.disembargo("receiverLoopback", 999)) == []
    resolve = columnar.encode(pa.array([{"which": "resolve", "resolve": {"promiseId": 4}}], schemas.MESSAGE.arrow()), schemas.MESSAGE)[0].as_py()
    abort = columnar.encode(pa.array([{"which": "abort", "abort": {"reason": "x"}}], schemas.MESSAGE.arrow()), schemas.MESSAGE)[0].as_py()
    assert say(v, "c", resolve) == [("c", "unimplemented")] and say(v, "c", abort) == []
    assert say(vat.Vat(compat=True), "c", abort) == [("c", "unimplemented")]


def test_client_and_stream():
    sent, server = [], vat.Vat()
    c = vat.Client(sent.append)

    def pump():
        while sent:
            for _, out in server.receive("x", sent.pop(0), HANDLERS):
                c.receive(out)

    q = c.ask(vat.bootstrap)
    assert not c.answered(q) and c.cap(q) == -1
    pump()
    assert c.answered(q) and not c.failed(q) and c.cap(q) == 0
    s = vat.Stream(c, pump, 2)
    for _ in range(3):
        assert s.send(lambda q: vat.call(q, 0, ADDER, 0, (2, 0), add)) and len(s.open) <= 2
    s.finish()
    assert c.content(q + 1).number(0, "int64") == 42
    s = vat.Stream(c, pump, 1)
    assert s.send(lambda q: vat.call(q, 0, ADDER, 99)) and not s.send(vat.bootstrap)
    with pytest.raises(FrameError):
        s.finish()
    with pytest.raises(FrameError):
        vat.Stream(c, pump, 0)


def test_message_table(spark):
    frames = [vat.bootstrap(1), vat.call(2, (1, [0]), 5, 3), vat.exception(2, "no"), vat.finish(1), b"junk"]
    log = spark.createDataFrame([("c", i, f) for i, f in enumerate(frames)], "conn_id string, seq bigint, frame binary")
    rows = tables.messages(log).orderBy("seq").collect()
    assert [r.kind for r in rows] == ["bootstrap", "call", "return", "finish", None] and rows[4]["_error"]["code"] == "FRAMING"
    assert (rows[1].target_kind, rows[1].target_question, rows[1].target_path, rows[1].method_id) == ("promisedAnswer", 1, [0], 3)
    assert rows[2].reason == "no" and rows[2].outcome == "exception"
    asked = tables.questions(tables.messages(log)).orderBy("seq").collect()
    assert [(r.question_id, r.return_seq, r.outcome, r.finish_seq) for r in asked] == [(1, None, None, 3), (2, 2, "exception", None)]


def test_split_and_replay_streams(spark, tmp_path):
    replay.prepare(spark)
    frames = [vat.bootstrap(1), vat.call(2, 0, ADDER, 0, (2, 0), add), vat.finish(1), vat.call(3, (1, []), ADDER, 0)]
    data = b"".join(frames)
    chunks = [("c", i, data[a : a + 37]) for i, a in enumerate(range(0, len(data), 37))]
    folder = str(tmp_path / "chunks")
    spark.createDataFrame(pd.DataFrame(chunks, columns=["conn_id", "chunk", "data"])).write.parquet(folder)
    stream = spark.readStream.schema("conn_id string, chunk bigint, data binary").parquet(folder)
    cut = replay.split_stream(stream)
    q = cut.writeStream.format("memory").queryName("cut").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("cut").orderBy("seq").collect()
    assert [bytes(r.frame) for r in got] == frames
    log = spark.table("cut").selectExpr("'v' AS vat_id", "conn_id", "seq", "frame")
    batch = replay.replay_batch(log, HANDLERS).orderBy("seq").collect()
    one = vat.Vat()
    want = [f for x in frames for _, f in one.receive("c", x, HANDLERS)]
    assert [bytes(r.frame) for r in batch] == want and len(want) == 3


def test_memory_pair():
    from loomframe.rpc.transport import memory_pair, serve

    here, there = memory_pair()
    buffer = bytearray(vat.bootstrap(1))
    here.send(buffer)
    buffer[:] = bytes(len(buffer))  # the sender may use its buffer again
    here.send(vat.call(2, (1, []), ADDER, 0, (2, 0), add))
    assert (there.pending, here.pending, here.receive()) == (2, 0, None)
    server = vat.Vat()
    assert serve(server, {"c": there}, HANDLERS) == 2 and here.pending == 2
    got = columnar.decode(pa.array([here.receive(), here.receive()], pa.binary()), schemas.MESSAGE)[0].to_pylist()
    assert [(m["which"], m["return"]["answerId"]) for m in got] == [("return", 1), ("return", 2)] and here.receive() is None
    there.send(vat.finish(1))
    there.close()
    assert here.closed and here.pending == 1 and here.receive() == vat.finish(1)
    with pytest.raises(FrameError):
        here.send(b"")
