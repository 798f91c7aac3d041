"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from loomframe.operators import frames as fr  # noqa: E402
from loomframe.plans import catalog  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = (
    "flagship_orders_by_priority", "roundtrip_lineitem", "decode_pruned_lineitem", "list_composite_order_lines", "pack_roundtrip_documents",
    "canonical_dedup_documents", "multiseg_far_roundtrip", "expr_eval", "rpc_question_answer", "rpc_refcounts", "rpc_pipelined", "rpc_replay_counts", "relational_rollup",
)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(f) -> float:
    began = time.time()
    f()
    return round(time.time() - began, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    drain(catalog.QUERIES["roundtrip_nation"](spark, SF_DIR))
    took = {name: timed(lambda: drain(catalog.QUERIES[name](spark, SF_DIR))) for name in QUERIES}

    # Each operator alone, over frames that are ready in memory.
    rates = {}
    for name in ("lineitem", "documents"):
        df = spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(int(CPUS)).cache()
        s = fr.layout_for(df)
        rows = df.count()
        # Timed before their results are cached, or the cache would answer.
        took_encode = timed(lambda: drain(fr.encode(df, s)))
        frames = fr.encode(df, s).cache()
        mb = frames.selectExpr("sum(octet_length(frame)) / 1e6").first()[0]
        seen = {"encode": took_encode}
        steps = {"decode": lambda: fr.decode(frames, s)}
        if name == "lineitem":
            steps["decode_2"] = lambda: fr.decode(frames, s, columns=["l_orderkey", "l_quantity"])
        else:
            seen["pack"] = timed(lambda: drain(frames.select(fr.pack("frame"))))
            packed = frames.select(fr.pack("frame").alias("p")).cache()
            packed.count()
            steps |= {"unpack": lambda: packed.select(fr.unpack("p")), "canonicalize": lambda: frames.select(fr.canonicalize("frame"))}
        seen |= {step: timed(lambda: drain(f())) for step, f in steps.items()}
        for step, seconds in seen.items():
            rates[f"{step}_{name}"] = {"sec": seconds, "rows_per_s": round(rows / seconds), "mb_per_s": round(mb / seconds, 1)}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rates": rates, "sf": SF_DIR}))


if __name__ == "__main__":
    main()
