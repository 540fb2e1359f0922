"""Exact dedup with a persistent digest index."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .common import schema_of, text_bytes


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``digest`` (SHA-256 of the text, A-Z lower-cased) and ``row``, unique per row.

    Null text counts as empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            # bytes.lower() changes ASCII letters only
            values = [hashlib.sha256(data[a:b].tobytes().lower()).digest()
                      for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.binary())], ["id", "digest"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {schema_of(docs, id_col)}, digest binary")
    return found.withColumn("row", F.monotonically_increasing_id())


class DigestIndex:
    """Digests of every text seen so far, in a table bucketed and sorted by digest.

    ``ingest`` removes from a batch the texts that the table already holds (a sort-merge
    anti-join in which only the batch is shuffled) and appends the new digests, one row
    each.  The index is never rewritten; later batches only add files to its buckets.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64,
                 id_type: str = "bigint"):
        self.spark, self.table, self.buckets = spark, table, buckets
        if not spark.catalog.tableExists(table):
            empty = spark.createDataFrame([], f"digest binary, keep_id {id_type}")
            self._write(empty, "errorifexists")

    def _write(self, df: DataFrame, mode: str) -> None:
        (df.repartition(self.buckets, "digest").write.mode(mode).format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table))

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Index a batch; one row per input row.

        Columns: the id column, ``keep_id``, ``group_size`` (rows of the batch with this
        text), ``kept`` and ``text_sha256``.  A text seen in an earlier batch keeps the row
        it kept then.  Otherwise the row with the largest id stays; a null id is smaller
        than any other, and of repeated rows exactly one stays.  Null text counts as empty.
        An empty batch gives no rows.  Other columns of ``docs`` are not read.
        """
        batch = stage(digests(docs, id_col, text_col), "digests")
        groups = stage(batch.groupBy("digest").agg(
            F.max(F.struct("id", "row")).alias("last"), F.count("*").alias("group_size")), "groups")
        known = self.read().withColumnRenamed("keep_id", "known_id")
        new = groups.join(known.hint("merge"), "digest", "left_anti")
        new = stage(new.select("digest", F.col("last.id").alias("keep_id"),
                               F.col("last.row").alias("keep_row"), "group_size"), "new-digests")
        old = groups.join(known.hint("merge"), "digest", "inner").select(
            "digest", F.col("known_id").alias("keep_id"),
            F.lit(None).cast("bigint").alias("keep_row"), "group_size")
        decided = stage(new.unionByName(old), "decided")
        self._write(new.select("digest", "keep_id"), "append")
        # rows of a frequent text meet its one decision in a join that adaptive execution splits
        return batch.join(decided, "digest").select(
            F.col("id").alias(id_col), "keep_id", "group_size",
            F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"))

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.table}")


def dedup_once(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``DigestIndex.ingest`` of one batch into an index that is dropped afterwards."""
    spark = docs.sparkSession
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}", id_type=schema_of(docs, id_col))
    try:
        return index.ingest(docs, id_col, text_col)
    finally:
        index.drop()
