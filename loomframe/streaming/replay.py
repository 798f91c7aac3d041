"""Stateful streams over frames: cutting byte chunks into frames, and replaying a server.

Both keep their state in the state store, by connection or vat, and sort what a
micro-batch brings by sequence number; across micro-batches the source has to keep
the order, as a connection does.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from ..kernel.wire import FrameError, frame_length
from ..rpc.vat import Handlers, Vat
from ..shared import on_path, shared_folder

_BLOB = StructType([StructField("state", BinaryType())])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAMES = "conn_id string, seq bigint, frame binary, error string"
#: Rows of a vat's log that are answered together.
ROWS = 8192
SENT = "vat_id string, conn_id string, seq bigint, n int, frame binary, error string"


def prepare(spark: SparkSession) -> None:
    """Stateful operators need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Splitter(StatefulProcessor):
    """Byte chunks of a connection to whole frames; a partial frame waits for the next chunk."""

    def __init__(self, max_segments: int = 64):
        self.max_segments = max_segments

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", _BLOB)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = pd.concat(list(rows)).sort_values("chunk", kind="stable")
        seq, carry, broken = pickle.loads(self.rest.get()[0]) if self.rest.exists() else (0, b"", False)
        data, out, at, error = carry + b"".join(chunks["data"]), [], 0, None
        try:
            while not broken and (size := frame_length(memoryview(data)[at:], self.max_segments)):
                out.append((key[0], seq, data[at : at + size], None))
                at, seq = at + size, seq + 1
        except FrameError as e:  # nothing after this can be found
            error, broken = e.code, True
            out.append((key[0], seq, None, error))
        self.rest.update((pickle.dumps((seq, b"" if broken else data[at:], broken)),))
        yield pd.DataFrame(out, columns=["conn_id", "seq", "frame", "error"])

    def close(self) -> None:
        pass


def split_stream(chunks: DataFrame, max_segments: int = 64) -> DataFrame:
    """``conn_id, seq, frame, error`` from chunks (``conn_id``, ``chunk``: their order, ``data``)."""
    return chunks.groupBy("conn_id").transformWithStateInPandas(Splitter(max_segments), FRAMES, "Append", "None")


def step(vat: Vat, rows: pd.DataFrame, handlers: Handlers) -> list[tuple]:
    """Frames that a server sends for the rows (``conn_id, seq, frame``), in order."""
    out = []
    for conn, seq, frame in rows.sort_values("seq", kind="stable")[["conn_id", "seq", "frame"]].itertuples(index=False):
        try:
            sent = vat.receive(conn, frame, handlers)
            out += [(to, seq, n, data, None) for n, (to, data) in enumerate(sent)]
        except FrameError as e:
            out.append((conn, seq, 0, None, e.code))
    return out


class Server(StatefulProcessor):
    """A vat that answers the frames of its connections."""

    def __init__(self, handlers: Handlers | None = None, root: str | None = "root", compat: bool = False, result_dims: dict | None = None):
        self.handlers, self.args = handlers or {}, {"root": root, "compat": compat, "result_dims": result_dims or {}}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.vat = handle.getValueState("vat", _BLOB)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        vat = pickle.loads(self.vat.get()[0]) if self.vat.exists() else Vat(**self.args)
        log = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for at in range(0, len(log), ROWS):
            sent = step(vat, log.iloc[at : at + ROWS], self.handlers)
            yield pd.DataFrame([(key[0], *r) for r in sent], columns=["vat_id", "conn_id", "seq", "n", "frame", "error"])
        self.vat.update((pickle.dumps(vat),))

    def close(self) -> None:
        pass


def replay_stream(log: DataFrame, handlers: Handlers | None = None, **args) -> DataFrame:
    """Frames that the vats send for a streamed log (``vat_id, conn_id, seq, frame``)."""
    return log.groupBy("vat_id").transformWithStateInPandas(Server(handlers, **args), SENT, "Append", "None")


def finished(stream: DataFrame) -> DataFrame:
    """What a stream gives once all input is read; it lies in files of the shared folder, never on the driver."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/finished-{uuid.uuid4().hex}"
    out, state = f"{path}/out", f"{path}/state"
    on_path(spark, out, lambda fs, p: fs.mkdirs(p))  # a stream without input writes nothing
    running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    on_path(spark, state, lambda fs, p: fs.delete(p, True))
    return spark.read.schema(stream.schema).parquet(out)


def replay_batch(log: DataFrame, handlers: Handlers | None = None, **args) -> DataFrame:
    """The same for a whole log at once.

    Frames come vat by vat in the order of their numbers; a task holds the tables of
    one vat and a batch of frames, however long the vat's log is.
    """
    handlers = handlers or {}
    ordered = log.select("vat_id", "conn_id", "seq", "frame").repartition("vat_id").sortWithinPartitions("vat_id", "seq")

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, vat = None, None
        for batch in batches:
            sent = []
            for k, rows in batch.groupby("vat_id", sort=False, dropna=False):
                if vat is None or k != key:
                    key, vat = k, Vat(**args)
                sent += [(k, *r) for r in step(vat, rows, handlers)]
            yield pd.DataFrame(sent, columns=["vat_id", "conn_id", "seq", "n", "frame", "error"])

    return ordered.mapInPandas(play, SENT)
