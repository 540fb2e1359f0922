"""Helpers shared by the operators: text blocks, vectorised hashing, components, hot joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder

U64 = np.uint64
#: An odd multiplier; its powers modulo 2**64 are the weights of the polynomial hashes.
BASE = 0x9E3779B97F4A7C15 | 1
_WORD = (1 << 64) - 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text worked on at once (a longer document is a block of its own).
BLOCK_BYTES = 1 << 19
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, base: int = BASE) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below ``n`` at least."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, U64)
        done = 1
        while done < size:
            have[done:2 * done] = have[:done] * U64(pow(base, done, 1 << 64))
            done *= 2
        _POWERS[base] = have
    return have


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with ``H[j] - H[i]`` = sum of ``values[t] * BASE ** t`` for i <= t < j."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[:len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end): equal spans hash alike wherever they stand."""
    inverse = powers(len(prefix), BASE_INVERSE)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most ``rows`` rows, for work that copies texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def row_blocks(offsets: np.ndarray, limit: int) -> Iterator[slice]:
    """Rows with at most ``limit`` items together, or one row with more."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(n, max(low + 1, high))
        yield slice(low, high)
        low = high


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES
                ) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of a batch in blocks of at most ``limit`` bytes: (rows, bytes, offsets from 0)."""
    data, offsets = text_bytes(batch.column(column))
    for rows in row_blocks(offsets, limit):
        ends = offsets[rows.start:rows.stop + 1]
        yield rows, data[ends[0]:ends[-1]], ends - ends[0]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, offsets counted in them, and the byte at which each one starts."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.searchsorted(lead, offsets), lead


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all spans [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def digest16(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def schema_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def shuffle_partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Intermediate tables of one job in the shared folder, dropped when no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, new_folder(spark, name)
        self.tables: dict[str, int] = {}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back; the shuffle files behind it can go."""
        self.tables[name] = self.tables.get(name, -1) + 1
        path = f"{self.folder}/{name}-{self.tables[name]}"
        df.write.parquet(path)
        schema = df.schema
        del df
        self.spark.sparkContext._jvm.System.gc()      # Spark deletes files of collected shuffles
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete all tables staged under ``name``."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for number in range(self.tables.pop(name) + 1):
            path = hadoop.Path(f"{self.folder}/{name}-{number}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of an undirected graph: (node, component = smallest node).

    Alternates large-star and small-star steps over a table in the shared folder until
    nothing changes, so neither links nor components reach the driver or one task.  A
    node's smallest neighbour is a partial aggregate; the join that hands it to the
    neighbours is one that adaptive execution can split at a hot node.  Only nodes of
    ``edges`` are returned.  Null ends and loops are ignored.  Only the last table is kept.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.stage(edges.select(F.col(u).alias("u"), F.col(v).alias("v"))
                        .where("u is not null and v is not null and u != v")
                        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .distinct(), "links-0")
    mark, turn = None, 0
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or new[0] == 0:
            break
        mark, turn = new, turn + 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        large = scratch.stage(large, f"large-star-{turn}")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(down.select("u", F.col("m").alias("v")))
                 .where("u != v").distinct())
        scratch.drop(f"links-{turn - 1}")
        now = scratch.stage(small, f"links-{turn}")
        scratch.drop(f"large-star-{turn}")
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct()
    return (stars.select(F.col("u").alias("node"), "component")
            .union(roots.select("node", F.col("node").alias("component")))
            .groupBy("node").agg(F.min("component").alias("component")))


def sorted_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Groups of equal integer ``keys`` of a partition sorted by them, also across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys], 1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(values[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def binary_spans(column: pa.ChunkedArray | pa.Array, width: type = U64
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Numbers packed in a binary column, laid end to end, and their offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = memoryview(data)[offsets[0]:offsets[-1]] if data is not None else b""
    size = np.dtype(width).itemsize
    return np.frombuffer(raw, width), (offsets - offsets[0]) // size
