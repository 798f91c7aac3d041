"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight schedule over training time 0..1, piecewise linear in
time and scaled so that its integral is the source's target in words. Documents
of a source are laid one after the other in a fixed pseudo-random order, pass
after pass; the cumulated demand (the schedule's integral) is inverted at the
middle of each copy and gives its training position. Copies whose middle lies
beyond the target are not taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, numbered, own_columns, table

#: Weights by rank of the source, repeating: fixed values of the contract.
WEIGHTS = (5.0, 2.0, 1.0)
#: Relative weight at evenly spaced times, for each of the weight classes: heavy
#: sources fade out, light ones come in.
SCHEDULES = ((1.25, 1.0, 0.75), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: A source is not repeated more often than this.
REPEATS = 3
#: Documents that a slot, a range of hashes within a source, should hold at most if
#: one source has all; and the least number of slots as a power of two.
SLOT_ROWS, LEAST_SLOTS = 65_536, 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sums: DataFrame, source_col: str = "source", weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, target, class`` from one row per source with ``source_size``.

    Targets share the sum of all sizes by weight; a target stops at ``repeats``
    times the source's size and the excess goes to the others. In closed form:
    with sources by bound over weight, the first whose bound is not reached fixes
    the common level. Works on one row per source.
    """
    by_name = Window.orderBy(F.col(source_col).isNull(), F.col(source_col).cast("binary"))
    ranked = sums.withColumn("class", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("class") + 1)).withColumn("bound", repeats * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("bound") / F.col("w"), F.col(source_col).isNull(), F.col(source_col).cast("binary"))
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("bound"), F.col("level"))).over(all_))
    target = F.least("bound", F.coalesce(F.col("level") * F.col("w"), F.col("bound")))
    return levels.select(source_col, "source_size", target.alias("target"), "class")


def invert(u: Column, knots: Column, n: int) -> Column:
    """Time at which a schedule with ``n`` values at even times has met the share ``u`` (0..1) of its integral."""
    h = 1.0 / (n - 1)
    area = [(knots[i] + knots[i + 1]) * (h / 2) for i in range(n - 1)]
    total = sum(area[1:], area[0])
    need = u * total
    out, done = F.lit(1.0), sum(area[:-1], F.lit(0.0))
    for i in reversed(range(n - 1)):
        rest = need - done
        slope = (knots[i + 1] - knots[i]) / h
        root = F.sqrt(F.greatest(knots[i] * knots[i] + 2 * slope * rest, F.lit(0.0)))
        t = i * h + F.try_divide(2 * rest, knots[i] + root)
        out = F.coalesce(F.least(F.greatest(t, F.lit(i * h)), F.lit((i + 1) * h)), F.lit(i * h)) if i == n - 2 else F.when(rest <= area[i], F.coalesce(F.least(F.greatest(t, F.lit(i * h)), F.lit((i + 1) * h)), F.lit(i * h))).otherwise(out)
        if i:
            done = done - area[i - 1]
    return out


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (), weights=WEIGHTS, schedules=SCHEDULES, repeats: int = REPEATS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken, positions`` of every document, plus the ``carry`` columns.

    ``positions`` has the training position (0..1) of each copy that the mix
    takes. Null text has size 0; a null source is a source of its own; documents
    of size 0 are in no mix (no copies); repeated rows are documents of their own;
    with all sizes 0 nothing is taken. Each source's taken words differ from its
    target by half its longest document at most. The order within a source is that
    of a hash of the id, then id, size and hash of the text, so reruns agree.

    The prefix sums run in two steps, within hash ranges of a source and over the
    sums of those ranges, so that a source with most rows is spread over many tasks.
    Ranges are by the hash's first bits, so their number does not change the order.
    """
    names = list(dict.fromkeys((id_col, source_col, *carry)))
    cols = [f"k{i}" for i in range(len(names))]
    rows = own_columns(docs, *names, *([] if text_col in names else [text_col]))
    rows = rows.toDF(*cols, *([] if text_col in names else ["text"]))
    text, source, i = (cols[names.index(text_col)] if text_col in names else "text"), cols[1], cols[0]
    rows = rows.select(*cols, word_count(F.col(text)).alias("size"), F.xxhash64(i).alias("h"), F.xxhash64(text).alias("th"))
    # A text key without nulls, so that the join below keeps the partitioning by it.
    rows = rows.withColumn("src", F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source).cast("string"))))
    bits = max(LEAST_SLOTS, (docs.count() // slot_rows).bit_length())
    rows = rows.withColumn("slot", F.shiftrightunsigned("h", 64 - bits))
    sums = cut(rows.groupBy("src", "slot").agg(F.sum("size").alias("sum")))
    by_source = Window.partitionBy("src")
    sums = sums.withColumn("before", F.sum("sum").over(by_source.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)))
    sums = sums.withColumn("before", F.coalesce("before", F.lit(0))).withColumn("source_size", F.sum("sum").over(by_source))
    whole = sums.groupBy("src").agg(F.max("source_size").alias("source_size")).withColumn("name", F.when(F.col("src").startswith("+"), F.expr("substring(src, 2)")))
    goal = targets(whole, "name", weights, repeats).select(F.when(F.col("name").isNull(), "-").otherwise(F.concat(F.lit("+"), "name")).alias("src"), "source_size", "target", "class")
    sums = sums.drop("source_size").join(goal, "src").select("src", "slot", "before", "source_size", "target", "class")
    rows = rows.repartition(F.col("src"), F.col("slot"))
    inner = Window.partitionBy("src", "slot").orderBy("h", i, "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(sums, ["src", "slot"])
    mid = F.col("before") + F.col("inside") + F.col("size") / 2
    starts = F.array(*[mid + p * F.col("source_size") for p in range(repeats)])
    starts = F.when(F.col("size") > 0, F.filter(starts, lambda c: c <= F.col("target"))).otherwise(F.array().cast("array<double>"))
    curves = F.array(*[F.array(*map(F.lit, s)) for s in schedules])
    knots = F.element_at(curves, F.col("class") % len(schedules) + 1)
    rows = rows.withColumn("starts", starts).withColumn("knots", knots)
    positions = F.transform("starts", lambda c: invert(c / F.col("target"), F.col("knots"), len(schedules[0])))
    out = rows.select(*cols, "size", "source_size", "target", F.size("starts").alias("copies"), (F.size("starts") * F.col("size")).cast("long").alias("taken"), positions.alias("positions"))
    return out.toDF(*names, *out.columns[len(names) :])


def training_order(assigned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per taken copy with its ``position``, range-sorted by it."""
    at = assigned.columns.index("positions")
    rest = [i for i in range(len(assigned.columns)) if i != at]
    copies = numbered(assigned).select(*[f"c{i}" for i in rest], F.explode(f"c{at}").alias("position"))
    key = f"c{assigned.columns.index(id_col)}"
    out = copies.repartitionByRange("position", key).sortWithinPartitions("position", key)
    return out.toDF(*[assigned.columns[i] for i in rest], "position")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the mix, range-sorted by the position of its first copy; those not taken come last."""
    rows = assign(table(spark, sf_dir, "documents"))
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    rows = rows.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"))
    return rows.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")
