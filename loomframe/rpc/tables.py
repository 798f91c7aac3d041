"""RPC traffic as tables.

A log of frames (connection, sequence number, frame) becomes one row per message;
calls and returns, references, pipelined targets, joins and three-party hand-offs
are then joins, windows and aggregates over that table. Ids that only a running
server can allocate are taken from the log; ``loomframe.streaming.replay`` derives
them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..kernel.reader import Frame
from ..kernel.wire import CAP, STRUCT, FrameError, Limits
from ..operators.frames import decode

#: Kinds of messages that ask a question, each with its own id field.
ASKING = ("call", "bootstrap", "provide", "accept", "join")


def messages(log: DataFrame, conn: str = "conn_id", seq: str = "seq", frame: str = "frame", keep: list[str] | None = None, mode: str = "PERMISSIVE", limits: Limits = Limits()) -> DataFrame:
    """One row per frame of the log.

    ``conn_id, seq, kind``; ``question_id`` of what asks or finishes, ``answer_id``
    and ``outcome`` of returns; ``target`` (export, or promised answer with its
    transform); capabilities that came along; what the other kinds carry. Bad
    frames have kind null and ``_error``.
    """
    keep = keep or []
    rows = decode(log.select(F.col(conn).alias("conn_id"), F.col(seq).alias("seq"), *keep, F.col(frame).alias("frame")), schemas.MESSAGE, keep=["conn_id", "seq", *keep], mode=mode, limits=limits, into="m")
    m, asking = F.col("m"), [F.col("m")[k]["questionId"] for k in (*ASKING, "finish")]
    target = F.coalesce(*[m[k]["target"] for k in ("call", "provide", "join", "disembargo")])
    ops = F.filter(target["promisedAnswer"]["transform"], lambda o: o["which"] == "getPointerField")
    caps = F.coalesce(m["call"]["params"]["capTable"], m["return"]["results"]["capTable"])
    context = m["disembargo"]["context"]
    errors = [F.col("_error")] if mode == "PERMISSIVE" else []
    return rows.select(
        "conn_id", "seq", *keep,
        m["which"].alias("kind"), F.coalesce(*asking).alias("question_id"), m["return"]["answerId"].alias("answer_id"), m["return"]["which"].alias("outcome"),
        F.coalesce(m["return"]["exception"]["reason"], m["abort"]["reason"]).alias("reason"),
        target["which"].alias("target_kind"), target["importedCap"].alias("target_export"), target["promisedAnswer"]["questionId"].alias("target_question"), F.transform(ops, lambda o: o["getPointerField"]).alias("target_path"),
        m["call"]["interfaceId"].alias("interface_id"), m["call"]["methodId"].alias("method_id"), F.coalesce(m["call"]["params"]["content"], m["return"]["results"]["content"]).alias("content"), caps.alias("caps"),
        m["finish"]["releaseResultCaps"].alias("release_result_caps"), m["release"]["id"].alias("release_id"), m["release"]["referenceCount"].alias("release_count"),
        F.coalesce(m["provide"]["recipient"]["nonce"], m["accept"]["provision"]["nonce"]).alias("nonce"), m["provide"]["recipient"]["vat"]["host"].alias("recipient_host"), m["provide"]["recipient"]["vat"]["port"].alias("recipient_port"), m["accept"]["embargo"].alias("embargo"),
        m["join"]["keyPart"]["joinId"].alias("join_id"), m["join"]["keyPart"]["partCount"].alias("part_count"), m["join"]["keyPart"]["partNum"].alias("part_num"),
        context["which"].alias("context"), F.coalesce(context["senderLoopback"], context["receiverLoopback"], context["provide"]).alias("context_id"), *errors,
    )


def questions(msgs: DataFrame) -> DataFrame:
    """Each question with the first return to its id before the id is asked again; unanswered ones have nulls.

    One shuffle by connection and id, no join: ``return_seq``, ``outcome``,
    ``reason`` and ``finish_seq`` come from the rows after the question.
    """
    rows = msgs.where(F.col("kind").isin(*ASKING, "return", "finish")).withColumn("id", F.coalesce("answer_id", "question_id"))
    by_id = Window.partitionBy("conn_id", "id").orderBy("seq")
    asks = F.col("kind").isin(*ASKING)
    rows = rows.withColumn("turn", F.sum(asks.cast("int")).over(by_id.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("conn_id", "id", "turn").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    answer = F.first(F.when(F.col("kind") == "return", F.struct("seq", "outcome", "reason", "content", "caps")), True).over(within)
    end = F.min(F.when(F.col("kind") == "finish", F.col("seq"))).over(within)
    rows = rows.withColumn("answer", answer).withColumn("finish_seq", end).where(asks)
    return rows.select("conn_id", F.col("id").alias("question_id"), "seq", "kind", "interface_id", "method_id", F.col("answer.seq").alias("return_seq"), F.col("answer.outcome").alias("outcome"), F.col("answer.reason").alias("reason"), "finish_seq", F.col("answer.content").alias("result"), F.col("answer.caps").alias("result_caps"))


def unanswered(asked: DataFrame) -> DataFrame:
    return asked.where(F.col("return_seq").isNull())


def failed(asked: DataFrame) -> DataFrame:
    """Questions that were answered, but not with results."""
    return asked.where(F.col("return_seq").isNotNull() & (F.col("outcome") != "results"))


def answer_cap(asked: DataFrame) -> DataFrame:
    """``conn_id, question_id, cap_id``: the first capability that the other side hosts in an answer, else -1."""
    hosted = F.filter("result_caps", lambda c: c["which"] == "senderHosted")
    return asked.select("conn_id", "question_id", F.coalesce(F.get(hosted, F.lit(0))["senderHosted"], F.lit(-1).cast("long")).alias("cap_id"))


def orphan_returns(msgs: DataFrame) -> DataFrame:
    """Returns to ids that were never asked."""
    asked = msgs.where(F.col("kind").isin(*ASKING)).select("conn_id", F.col("question_id").alias("answer_id")).distinct()
    return msgs.where("kind = 'return'").join(asked, ["conn_id", "answer_id"], "left_anti")


def answers(asked: DataFrame) -> DataFrame:
    """Intervals in which an answer can be addressed: from its return to its finish."""
    return asked.where("outcome = 'results'").select("conn_id", "question_id", F.col("return_seq").alias("from_seq"), F.col("finish_seq").alias("to_seq"), "result", "result_caps")


def cap_at(content: Column, path: Column) -> Column:
    """Number in the capability table of what the path of pointer fields leads to in a content frame; null if that is no capability."""

    def number(data, steps) -> int | None:
        try:
            at = Frame.parse(data).root()
            for k in steps or ():
                if at.kind != STRUCT:
                    return None
                at = at.pointer(k)
            return at.count if at.kind == CAP else None
        except FrameError:
            return None

    @F.arrow_udf("bigint")
    def run(frames: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([None if x is None else number(x, p) for x, p in zip(frames.to_pylist(), paths.to_pylist())], pa.int64())

    return run(content, path)


def pipelined(msgs: DataFrame, asked: DataFrame) -> DataFrame:
    """Calls on promised answers, with the export that they reach, or null.

    An interval join on connection and question id: the answer has returned and
    is not finished when the call comes. The path is followed through the answer's
    content; only a capability at its end that the answering side hosts counts.
    Whether the export has been released meanwhile is for ``replay`` to say.
    """
    calls = msgs.where("kind = 'call' and target_kind = 'promisedAnswer'").select("conn_id", "seq", F.col("question_id").alias("call_id"), F.col("target_question").alias("question_id"), "target_path")
    a = answers(asked)
    live = (F.col("c.conn_id") == F.col("a.conn_id")) & (F.col("c.question_id") == F.col("a.question_id")) & (F.col("c.seq") >= F.col("a.from_seq")) & (F.col("a.to_seq").isNull() | (F.col("c.seq") < F.col("a.to_seq")))
    joined = calls.alias("c").join(a.alias("a"), live, "left")
    joined = joined.select("c.conn_id", "c.seq", "c.call_id", "c.question_id", F.col("a.from_seq").isNotNull().alias("resolved"), "a.result_caps", cap_at(F.col("a.result"), F.col("c.target_path")).alias("at"))
    cap = F.get("result_caps", F.col("at").cast("int"))
    return joined.select("conn_id", "seq", "call_id", "question_id", "resolved", F.when(F.col("at").isNotNull() & (cap["which"] == "senderHosted"), cap["senderHosted"]).alias("export_id"))


def reference_counts(msgs: DataFrame) -> DataFrame:
    """Running count of references for each export: one more for each hosted capability sent, fewer by releases.

    A release beyond what is held ends the export; ids are not used again.
    """
    sent = msgs.where("kind = 'return'").select("conn_id", "seq", F.explode("caps").alias("c")).where("c.which = 'senderHosted'").select("conn_id", "seq", F.col("c.senderHosted").alias("export_id"), F.lit(1).cast("long").alias("delta"))
    gone = msgs.where("kind = 'release'").select("conn_id", "seq", F.col("release_id").alias("export_id"), (-F.col("release_count")).alias("delta"))
    return running(sent.unionAll(gone), ["conn_id", "export_id"])


def running(deltas: DataFrame, keys: list[str], seq: str = "seq", delta: str = "delta") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("refcount", F.sum(delta).over(w))


def live_exports(counts: DataFrame) -> DataFrame:
    """Exports that still have references at the end of the log."""
    return counts.groupBy("conn_id", "export_id").agg(F.max_by("refcount", "seq").alias("refcount")).where("refcount > 0")


def join_results(parts: DataFrame) -> DataFrame:
    """One row for each part of a capability join (``conn_id, join_id, seq, part_num, part_count, export_id``) that is answered.

    ``conn_id, join_id, seq, part_num, succeeded, export_id``. A part fails by itself
    if it is out of range, has another count than the join's first part, or repeats a
    part that has come. Once all parts have come they are answered together: with
    success if all name the same hosted export (null or negative: none), which part 0
    then gets. The next part begins the join anew; parts of incomplete joins have no row.

    Parts are gone through in order, one join at a time; only its open parts are held.
    """
    kinds = parts.schema
    shape = f"conn_id {kinds['conn_id'].dataType.simpleString()}, join_id bigint, seq bigint, part_num int, succeeded boolean, export_id bigint"
    rows = parts.select("conn_id", F.col("join_id").cast("long"), F.col("seq").cast("long"), F.col("part_num").cast("int"), F.col("part_count").cast("int"), F.coalesce("export_id", F.lit(-1)).cast("long").alias("export_id"))
    rows = rows.repartition("conn_id", "join_id").sortWithinPartitions("conn_id", "join_id", "seq")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, open_ = None, 0, {}
        for batch in batches:
            out = []
            for conn, join, seq, part, many, export in zip(*(c.to_pylist() for c in batch.columns)):
                if (conn, join) != key:
                    key, open_ = (conn, join), {}
                if part is None or many is None or not 0 <= part < many or open_ and (many != count or part in open_):
                    out.append((conn, join, seq, part, False, None))
                    continue
                count = many
                open_[part] = (seq, export)
                if len(open_) == many:
                    exports = {e for _, e in open_.values()}
                    same = len(exports) == 1 and min(exports) >= 0
                    out += [(conn, join, s, k, same, e if same and k == 0 else None) for k, (s, e) in sorted(open_.items())]
                    open_ = {}
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["conn_id", "join_id", "seq", "part_num", "succeeded", "export_id"])

    return rows.mapInArrow(fold, shape)


def claims(provides: DataFrame, accepts: DataFrame, scope: str = "vat_id") -> DataFrame:
    """Each accept with the provision that it takes, or null.

    Both have ``scope, nonce, seq``. A provision is taken once, by the first accept
    after it; a later provide under the same nonce replaces one not yet taken. One
    shuffle by scope and nonce.
    """
    rows = provides.select(scope, "nonce", "seq", F.lit("provide").alias("kind")).unionAll(accepts.select(scope, "nonce", "seq", F.lit("accept").alias("kind")))
    w = Window.partitionBy(scope, "nonce").orderBy("seq")
    before = F.lag(F.struct("kind", "seq")).over(w)
    rows = rows.withColumn("b", before).where("kind = 'accept'")
    return rows.select(scope, "nonce", F.col("seq").alias("accept_seq"), F.when(F.col("b.kind") == "provide", F.col("b.seq")).alias("provide_seq"))


def unclaimed(provides: DataFrame, accepts: DataFrame, scope: str = "vat_id") -> DataFrame:
    """Provisions that are pending at the end: the last event of their nonce is a provide."""
    rows = provides.select(scope, "nonce", "seq", F.lit("provide").alias("kind")).unionAll(accepts.select(scope, "nonce", "seq", F.lit("accept").alias("kind")))
    last = rows.groupBy(scope, "nonce").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))
    return last.where("kind = 'provide'").select(scope, "nonce", F.col("seq").alias("provide_seq"))


def introductions(msgs: DataFrame) -> DataFrame:
    """Third-party capabilities in calls and answers, by connection and nonce; the last one counts."""
    rows = msgs.select("conn_id", "seq", F.explode("caps").alias("c")).where("c.which = 'thirdPartyHosted'")
    t = F.col("c.thirdPartyHosted")
    rows = rows.select("conn_id", "seq", t["id"]["nonce"].alias("nonce"), t["id"]["vat"]["host"].alias("host"), t["id"]["vat"]["port"].alias("port"), t["vineId"].alias("vine_id"))
    return latest(rows, ["conn_id", "nonce"], ["host", "port", "vine_id"])


def latest(rows: DataFrame, keys: list[str], values: list[str], seq: str = "seq") -> DataFrame:
    """The row with the highest sequence number of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(seq)).alias("v"), F.max(seq).alias(seq)).select(*keys, seq, *[F.col(f"v.{v}").alias(v) for v in values])


def pending_introductions(intro: DataFrame, msgs: DataFrame) -> DataFrame:
    """Introductions whose vine has not been released since."""
    gone = msgs.where("kind = 'release'").select("conn_id", F.col("release_id").alias("vine_id"), F.col("seq").alias("gone_seq"))
    i, g = intro.alias("i"), gone.alias("g")
    return i.join(g, (F.col("i.conn_id") == F.col("g.conn_id")) & (F.col("i.vine_id") == F.col("g.vine_id")) & (F.col("g.gone_seq") > F.col("i.seq")), "left_anti")


def embargoed(msgs: DataFrame, scope: str = "vat_id") -> DataFrame:
    """Accepts that are held under an embargo at the end of the log.

    An accept takes the provision before it, as in ``claims``; under an embargo it is
    held by the provision's connection and question. A disembargo on that connection
    with that question lifts what is held when it comes; one that comes earlier, or
    finds nothing held, does nothing, and a later accept under the same question
    takes the place of the one held. Two shuffles: by nonce, and by what holds.
    """
    w = Window.partitionBy(scope, "nonce").orderBy("seq")
    rows = msgs.where("kind in ('provide', 'accept')").withColumn("b", F.lag(F.struct("kind", "conn_id", "question_id")).over(w))
    held = rows.where("kind = 'accept' and embargo and b.kind = 'provide'")
    held = held.select(scope, F.col("b.conn_id").alias("provider"), F.col("b.question_id").alias("provided"), "seq", F.struct("conn_id", "seq", "question_id", "nonce").alias("a"))
    lifts = msgs.where("kind = 'disembargo' and context = 'provide'").select(scope, F.col("conn_id").alias("provider"), F.col("context_id").alias("provided"), "seq", F.lit(None).cast(held.schema["a"].dataType).alias("a"))
    last = held.unionAll(lifts).groupBy(scope, "provider", "provided").agg(F.max_by("a", "seq").alias("a"))
    return last.where("a is not null").select(scope, "a.*")


def echoes(msgs: DataFrame) -> DataFrame:
    """Disembargoes that a server answers with ``receiverLoopback`` of the same id."""
    return msgs.where("kind = 'disembargo' and context = 'senderLoopback'").select("conn_id", "seq", "context_id")


def unimplemented(msgs: DataFrame) -> DataFrame:
    """Messages that a server sends back as unimplemented."""
    return msgs.where(F.col("kind").isin("resolve", "obsoleteSave", "obsoleteDelete") | F.col("kind").startswith("#")).select("conn_id", "seq", "kind")


def exceptions(msgs: DataFrame) -> DataFrame:
    return msgs.where("kind = 'return' and outcome = 'exception'").select("conn_id", "seq", "answer_id", "reason")


def stream_window(calls: DataFrame, window: int = 16, conn: str = "conn_id", sent: str = "send_seq", returned: str = "return_seq") -> DataFrame:
    """Whether each streamed call kept to the window: the call ``window`` places before had returned when it was sent."""
    if window < 1:
        raise ValueError("a window of at least one call")
    w = Window.partitionBy(conn).orderBy(sent)
    earlier = F.lag(returned, window).over(w)
    nth = F.row_number().over(w)
    return calls.withColumn("fits", F.when(nth <= window, F.lit(True)).otherwise(F.coalesce(earlier <= F.col(sent), F.lit(False))))


def first_failure(asked: DataFrame) -> DataFrame:
    """The first question of each connection that failed; unanswered ones count."""
    bad = F.col("return_seq").isNull() | (F.col("outcome") != "results")
    return asked.where(bad).groupBy("conn_id").agg(F.min("question_id").alias("question_id"))


def with_methods(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Calls with the interface's and method's names from a catalog's method table.

    A catalog has one row per method of a schema; Spark broadcasts it while its
    size is under the session's threshold and shuffles it beyond.
    """
    m = methods.select(F.col("interface_id"), F.col("ordinal").alias("method_id"), "interface", "method")
    return calls.join(m, ["interface_id", "method_id"], "left")
