"""Token counts from pre-token frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import U64, code_points, schema_of, segment_sums, text_blocks
from .pretokens import piece_encoder, pretoken_starts, span_keys, special_tokens, split_specials

#: At most so many pre-tokens, the most frequent ones, are sent to every task.
COMMON_WORDS = 1 << 20
#: Distinct pre-tokens that a task gathers before it hands them on.
GATHERED = 1 << 20


class _Block:
    """Pre-tokens of some texts laid end to end; strings of special tokens are cut out."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, path: str):
        specials = special_tokens(path)
        raw = data.tobytes()
        found = {s: i for s, i in specials.items() if s.encode() in raw}
        self.n_bytes = np.diff(offsets)
        self.n_special = np.zeros(len(offsets) - 1, np.int64)
        owner = np.arange(len(offsets) - 1)
        if found:
            parts, owner = [], []
            for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                for part in split_specials(raw[a:b], found):
                    if isinstance(part, int):
                        self.n_special[row] += 1
                    else:
                        parts.append(part)
                        owner.append(row)
            data = np.frombuffer(b"".join(parts), np.uint8)
            offsets = np.append(0, np.cumsum([len(p) for p in parts], dtype=np.int64))
        points, bounds, lead = code_points(data, offsets)
        self.starts = pretoken_starts(points, bounds, path)
        self.keys = span_keys(points, self.starts) if len(self.starts) else np.zeros(0, U64)
        self.data, self.bounds = data, np.append(lead[self.starts], len(data))
        # pre-tokens of a row are consecutive: where the row's first part begins
        at = np.searchsorted(self.starts, bounds[:-1])
        rows = np.searchsorted(np.asarray(owner), np.arange(len(self.n_bytes) + 1))
        self.offsets = np.append(at, len(self.starts))[rows]

    def word(self, i: int) -> bytes:
        return self.data[self.bounds[i]:self.bounds[i + 1]].tobytes()


def _words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The distinct pre-tokens of a task: key, word, number of times."""
    known: dict[int, int] = {}
    words: list[bytes] = []
    times = np.zeros(0, np.int64)

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.fromiter(known, U64, len(known)).view(np.int64)),
             pa.array(words, pa.binary()), pa.array(times)], ["key", "word", "times"])

    for batch in batches:
        for _, data, offsets in text_blocks(batch, "text"):
            block = _Block(data, offsets, path)
            keys, first, counts = np.unique(block.keys, return_index=True, return_counts=True)
            slots = np.empty(len(keys), np.int64)
            for i, key in enumerate(keys.tolist()):
                slot = known.setdefault(key, len(known))
                if slot == len(words):
                    words.append(block.word(first[i]))
                slots[i] = slot
            times = np.concatenate([times, np.zeros(len(words) - len(times), np.int64)])
            times[slots] += counts
            if len(words) > GATHERED:
                yield flush()
                known, words, times = {}, [], np.zeros(0, np.int64)
    if words:
        yield flush()


def _count_pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = piece_encoder(path)
    for batch in batches:
        sizes = [len(encode(w)) for w in batch.column("word").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(sizes, pa.int32()), batch.column("times")],
            ["key", "n", "times"])


def vocabulary(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Every distinct pre-token of the corpus once: ``key``, ``n`` pieces, ``times`` it occurs."""
    words = docs.select(F.col(text_col).alias("text")).mapInArrow(
        lambda b: _words(b, path), "key bigint, word binary, times bigint")
    return words.groupBy("key", "word").agg(F.sum("times").alias("times")).mapInArrow(
        lambda b: _count_pieces(b, path), "key bigint, n int, times bigint")


def common_words(vocab: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and pieces of the most frequent pre-tokens, ``limit`` at most, and the least
    frequency that all of them have and no other word has."""
    level = F.floor(F.log2("times") * 4).cast("int")
    steps = {r["level"]: r["n"] for r in
             vocab.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    total, bound = 0, None
    for step in sorted(steps, reverse=True):
        total += steps[step]
        if total > limit:
            break
        bound = step
    if bound is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), 1 << 30
    table = vocab.where(level >= bound).select("key", "n").toArrow()
    key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order], bound


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text", common: int = COMMON_WORDS) -> DataFrame:
    """Tokens of every whole text: the id column, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Pieces are counted once for each distinct pre-token of the corpus and joined to the
    pre-token frequencies of the documents; ids are never built.  The ``common`` most frequent
    pre-tokens (a bound on what is broadcast, not on the result) are looked up where the
    document is read, the others through a join.  Strings of special tokens inside a text
    count as one token, as the library does by default.  Null text is empty (0 tokens); rows
    may repeat or lack an id; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    vocab = stage(vocabulary(docs, path, text_col), "vocabulary")
    keys, sizes, bound = common_words(vocab, common)
    shared = spark.sparkContext.broadcast((keys.view(U64)[np.argsort(keys.view(U64))],
                                           sizes[np.argsort(keys.view(U64))]))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pieces = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                block = _Block(data, offsets, path)
                n = len(block.n_bytes)
                value = np.zeros(len(block.keys), np.int64)
                rare = np.ones(len(block.keys), bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, block.keys), len(known) - 1)
                    rare = known[at] != block.keys
                    value = np.where(rare, 0, pieces[at])
                of = np.repeat(np.arange(n), np.diff(block.offsets))[rare]
                # one entry per document and rare pre-token, with its frequency
                order = np.lexsort((block.keys[rare], of))
                of, key = of[order], block.keys[rare][order]
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(of)))
                ends = np.searchsorted(of[first], np.arange(n + 1)).astype(np.int32)
                offs = pa.array(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), batch.column("id")[rows],
                     pa.array(block.n_bytes.astype(np.int64)),
                     pa.array(segment_sums(value, block.offsets) + block.n_special),
                     pa.ListArray.from_arrays(offs, pa.array(key[first].view(np.int64))),
                     pa.ListArray.from_arrays(offs, pa.array(times.astype(np.int32)))],
                    ["row", "id", "n_bytes", "n_common", "keys", "times"])
                row += n

    counted = stage(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                    .mapInArrow(frequencies, f"row bigint, id {schema_of(docs, id_col)}, "
                                             "n_bytes bigint, n_common bigint, "
                                             "keys array<bigint>, times array<int>"), "frequencies")
    pairs = counted.select("row", F.explode(F.arrays_zip("keys", "times")).alias("p")).select(
        "row", F.col("p.keys").alias("key"), F.col("p.times").alias("freq"))
    level = F.floor(F.log2("times") * 4).cast("int")
    rest = vocab.where(level < bound).select("key", "n")
    sums = pairs.join(rest, "key").groupBy("row").agg(
        F.sum(F.col("freq") * F.col("n")).alias("n_rare"))
    n_tokens = F.col("n_common") + F.coalesce("n_rare", F.lit(0))
    return counted.select("row", "id", "n_bytes", "n_common").join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_bytes", n_tokens.alias("n_tokens"),
        (n_tokens > limit).alias("over_limit"))
