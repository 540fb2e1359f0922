"""The corpus pipeline over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns what the next one reads from Parquet.  All
but the last return the columns of ``documents``; a changed text gets its new ``n_chars``.  Every
row is a document of its own, also where ids repeat or lack.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelark.llm.language_id import fit, identify, learned_from
from ratelark.llm.line_dedup import line_dedup
from ratelark.llm.ngram_join import ngram_join
from ratelark.llm.packing import pack
from ratelark.llm.queries import BYTE_BPE
from ratelark.llm.suffix_dedup import suffix_dedup
from ratelark.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Files of a table up to which their paths are sent to every task.
MAX_FILES = 1 << 16


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a number ``row`` of its own for each row, as ids may repeat or lack: the file
    and the row's place in it, so whoever reads it finds the same numbers.  Frames that are not
    read from Parquet files, or from more than MAX_FILES, are written once."""
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("file"),
                             F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        placed = None
    files = [] if placed is None else placed.select("file").distinct().limit(MAX_FILES + 1).collect()
    if not files or len(files) > MAX_FILES:
        return stage(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    numbers = docs.sparkSession.createDataFrame(
        list(enumerate(sorted(f["file"] for f in files))), "number bigint, file string")
    return placed.join(F.broadcast(numbers), "file").select(
        *docs.columns, (F.shiftleft("number", 40) + F.col("place")).alias("row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those unlike every learned language."""
    others = [c for c in COLUMNS if c != "text"]
    found = identify(docs.select(F.struct(*others).alias("others"), "text"),
                     fit(docs.where(learned_from())), id_col="others", carry_text=True)
    return found.where(~F.col("rejected")).select("others.*", "text").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that three or more documents share, but for the one with the largest id (of
    those that share an id or have none, any one)."""
    left = line_dedup(_keyed(docs).withColumn("key", F.struct("doc_id", "row")), id_col="key",
                      carry=("lang", "source"))
    return left.select("key.doc_id", "text", "lang", "source",
                       F.length("text").cast("bigint").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of every group of near duplicates (five words, similarity 0.8) the one row with the
    smallest id; rows without an id come last."""
    docs = _keyed(docs)
    found = docs.select("row", "doc_id").join(ngram_join(docs, id_col="row"), "row")
    kept = found.groupBy("component_id").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least"))
    return docs.join(kept.select("least.row"), "row", "left_semi").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every passage of 200 bytes or more that occurs again, and what is left of
    characters cut in two."""
    docs = _keyed(docs)
    cut = suffix_dedup(docs, id_col="row", as_text=True).select("row", F.col("kept").alias("text"))
    return (docs.drop("text", "n_chars").join(cut, "row")
            .withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return pack(docs, BYTE_BPE)


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_join", near_duplicates),
          ("suffix_dedup", repeats), ("packing", packing)]

#: Stages on language models, suffixes and packing have no SQL; the tests compare each stage
#: with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
