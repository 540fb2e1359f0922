"""Line dedup: lines that too many documents share go, except in one of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import digest16, schema_of, slices, text_bytes

STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The hash of every line's key; None where the key is shorter than ``min_chars``."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(STRIP)
        if len(key) < min_chars or len(key.decode("utf-8")) < min_chars:
            out.append(None)
        else:
            out.append(digest16(key.lower()))
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = 20, min_docs: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the id column, ``text`` (what is left), ``n_lines``, ``n_dropped``
    and the columns named in ``carry``.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased.  Keys of
    at least ``min_chars`` code points that occur in at least ``min_docs`` documents lose all
    their lines except in the document with the largest id.  Null or empty text is one empty
    line and becomes the empty text.  Rows that share an id count as one document; a row
    without an id is neither counted nor changed.  Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                         F.struct(*carry).alias("carried") if carry else F.lit(None).alias("carried"))
    id_type = schema_of(docs, id_col)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            at, keys = [], []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                own = {k for k in line_keys(data[a:b].tobytes(), min_chars) if k}
                at += [i] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array(keys, pa.binary())],
                ["id", "key"])

    lines = stage(source.where("id is not null").select("id", "text").mapInArrow(
        explode, f"id {id_type}, key binary"), "lines")
    common = stage(lines.groupBy("key").agg(
        F.countDistinct("id").alias("docs"), F.max("id").alias("keep_id"))
        .where(F.col("docs") >= min_docs).select("key", "keep_id"), "common-lines")
    drops = (lines.join(common, "key").where("id != keep_id")
             .groupBy("id").agg(F.collect_set("key").alias("drop")))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column(1))
            texts, n_lines, n_dropped = [], [], []
            for drop, a, b in zip(batch.column(2).to_pylist(), offsets[:-1], offsets[1:]):
                text = data[a:b].tobytes()
                parts = text.split(b"\n")
                left = parts
                if drop:
                    gone = set(drop)
                    left = [p for p, k in zip(parts, line_keys(text, min_chars)) if k not in gone]
                n_lines.append(len(parts))
                n_dropped.append(len(parts) - len(left))
                texts.append(b"\n".join(left).decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()),
                 pa.array(n_dropped, pa.int64()), batch.column(3)],
                ["id", "text", "n_lines", "n_dropped", "carried"])

    rebuilt = source.join(drops, "id", "left").select("id", "text", "drop", "carried").mapInArrow(
        rebuild, f"id {id_type}, text string, n_lines bigint, n_dropped bigint, "
                 f"carried {schema_of(source, 'carried')}")
    return rebuilt.select(F.col("id").alias(id_col), "text", "n_lines", "n_dropped",
                          *(F.col("carried")[c].alias(c) for c in carry))
