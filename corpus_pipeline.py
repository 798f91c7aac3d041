"""The corpus pipeline: from raw documents to token ids in training order.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``. Null ids,
texts and sources pass through every stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import bpe, linededup, mixing, quality, simhash
from loomframe.llm.common import discard, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Repeats of short lines go from so many characters on.
EXACT_CHARS = 8


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it learns from the stage's own input and ``labels``."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"), carry=COLUMNS)
    return judged.where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those that lose all their lines go, ``n_chars`` is counted anew."""
    rows = linededup.dedup_lines(docs.select(*COLUMNS), exact_chars=EXACT_CHARS)
    rows = rows.where(F.coalesce(F.size("removed"), F.lit(-1)) != F.col("n_lines"))
    rows = rows.withColumn("n_chars", F.when(F.col("removed").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long"))
    return rows.select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8."""
    return simhash.drop_similar(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, one row each, range-sorted by training position.

    The columns are those of documents, so the position lives in the order of the
    rows: the number of the file, then the row in the file, once they are written.
    """
    rows = mixing.assign(docs, carry=COLUMNS)
    return mixing.training_order(rows).select(*COLUMNS)


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``position``, a number that grows with the training order.

    A reader may take the files in any order and split them, but tells each row's
    file and place. What does not come from files is numbered as it comes.
    """
    try:
        rows = docs.select(*COLUMNS, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return docs.select(*COLUMNS, F.monotonically_increasing_id().alias("position"))
    part = lambda pattern: F.coalesce(F.regexp_extract("_file", pattern, 1).try_cast("long"), F.lit(0))
    # Writers number files by partition, and within it if they split one.
    position = F.shiftleft(part(r"^part-(\d+)"), 40) + F.shiftleft(part(r"-c(\d+)\."), 32) + F.col("_row")
    return rows.select(*COLUMNS, position.alias("position"))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy in training order, with its ``position`` and digests of the ids and of the text decoded from them.

    Rows are range-sorted by position; it tells the copies of a document apart.
    """
    rows = in_order(docs)
    # As many ranges as the input has splits: encoding takes longer than its bytes tell.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    return bpe.encode(rows.repartitionByRange(parts, "position").sortWithinPartitions("position"), carry=("position",))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: The classifier and the fuzzy links are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage keeps is stored before the next one reads it (several times), and deleted after that."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
