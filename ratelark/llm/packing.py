"""Best-fit packing of token sequences after a dominance reduction."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import code_points, ragged, schema_of, text_blocks
from .pretokens import PieceTable, block_ids, special_tokens, split_specials

#: Id that ends every document.
END = 0
#: Groups in which pieces of one length are numbered; bounds what one task sorts.
RANK_GROUPS = 256


@lru_cache(maxsize=2)
def _table(path: str) -> PieceTable:
    return PieceTable()


def encode_documents(batch: pa.RecordBatch, column: str, path: str) -> Iterator[np.ndarray]:
    """The ids of every text of a batch, in row order; special strings are special tokens."""
    table, specials = _table(path), special_tokens(path)
    for _, data, offsets in text_blocks(batch, column):
        raw = data.tobytes()
        marked = {s: i for s, i in specials.items() if s.encode() in raw}
        if not marked:
            points, bounds, lead = code_points(data, offsets)
            ids, ends = block_ids(points, bounds, data, lead, table, path)
            for a, b in zip(ends[:-1], ends[1:]):
                yield ids[a:b]
            continue
        for a, b in zip(offsets[:-1], offsets[1:]):
            yield _with_specials(raw[a:b], marked, table, path)


def _with_specials(text: bytes, specials: dict[str, int], table: PieceTable, path: str
                   ) -> np.ndarray:
    """Ids of one text in which strings of special tokens occur."""
    parts = split_specials(text, specials)
    out = []
    for part in parts:
        if isinstance(part, int):
            out.append(np.array([part], np.uint32))
        else:
            data = np.frombuffer(part, np.uint8)
            points, bounds, lead = code_points(data, np.array([0, len(data)]))
            out.append(block_ids(points, bounds, data, lead, table, path)[0])
    return np.concatenate(out)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """The pieces of every document: id, ``piece``, ``start``, ``length``, ``ids_crc32``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encode_documents(batch, "text", path)):
                data = np.append(ids, np.uint32(END)).astype("<u4")
                for number, (at, size) in enumerate(cut(len(data), capacity)):
                    rows.append(row)
                    piece.append(number)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(data[at:at + size].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {schema_of(docs, id_col)}, piece int, start bigint, length bigint, "
             "ids_crc32 bigint")


def dominant_sets(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello and Toth's reduction on a table of sizes; takes what it fixes from ``count``.

    For every size, largest first, look at the sets of at most three items that hold one of
    them.  A set is fixed, as often as its sizes allow, when it provably dominates every other
    set with that item: nothing else fits; one partner fills the sequence or only one more item
    can fit; or at most two more can fit and no pair beats the largest partner (alone, or
    together with the largest item that fits beside it).
    """
    have = np.zeros(capacity + 1, np.int64)
    for size, n in count.items():
        have[size] = n
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(*items: int) -> None:
        sizes, times = np.unique(items, return_counts=True)
        n = int((have[sizes] // times).min())
        have[sizes] -= n * times
        fixed.append((tuple(items), n))

    for size in range(capacity, 0, -1):
        while have[size]:
            have[size] -= 1
            rest = capacity - size
            fitting = np.flatnonzero(have[:rest + 1])
            chosen = _dominating(size, rest, fitting, have)
            have[size] += 1
            if chosen is None:
                break
            take(size, *chosen)
    for size in count:
        count[size] = int(have[size])
    return fixed


def _dominating(size: int, rest: int, fitting: np.ndarray, have: np.ndarray):
    """The partners that make a set with ``size`` dominate all others, or None."""
    if not len(fitting):
        return ()
    largest = int(fitting[-1])
    if largest == rest:
        return (largest,)
    smallest = np.repeat(fitting[:3], np.minimum(have[fitting[:3]], 3))[:3]
    if len(smallest) < 2 or smallest[0] + smallest[1] > rest:
        return (largest,)
    if len(smallest) > 2 and smallest.sum() <= rest:
        return None
    pairs = [(int(a), int(b)) for a in fitting for b in fitting
             if a <= b and a + b <= rest and (a != b or have[a] > 1)]
    if max(a + b for a, b in pairs) <= largest:
        return (largest,)
    beside = [a for a, b in pairs if b == largest] + [b for a, b in pairs if a == largest]
    second = max(beside, default=0)
    if second and all(a + b <= largest for a, b in pairs if min(a, b) > second):
        return (largest, second)
    return None


def plan(count: dict[int, int], capacity: int) -> np.ndarray:
    """Where the items of each size go, from a table of sizes alone.

    Rows (size, rank, sequence, per, offset): items of ``size`` from ``rank`` on go ``per`` to
    a sequence, from ``sequence`` on, the first of each at ``offset``.  Fixed sets come first,
    then the rest best-fit, largest size first: whole runs of equal sequences at once, so
    neither time nor size of the plan depends on the number of items.
    """
    count = {s: n for s, n in count.items() if n}
    rank = dict.fromkeys(count, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    used = 0
    for items, n in dominant_sets(count, capacity):
        offset = 0
        for size in sorted(set(items), reverse=True):
            per = items.count(size)
            rows.append((size, rank[size], used, per, offset))
            rank[size] += n * per
            offset += per * size
        used += n
    room: dict[int, list[tuple[int, int]]] = {}

    def place(size: int, first: int, bins: int, left: int, per: int, n: int) -> None:
        rows.append((size, rank[size], first, per, capacity - left))
        rank[size] += n
        rest = left - per * size
        if rest:
            room.setdefault(rest, []).append((first, bins))

    for size in sorted((s for s, n in count.items() if n), reverse=True):
        n = count[size]
        for left in sorted(r for r in room if r >= size):
            runs, room[left] = room[left], []
            per = left // size
            for first, bins in runs:
                whole = min(bins, n // per)
                if whole:
                    place(size, first, whole, left, per, whole * per)
                    n -= whole * per
                if whole < bins and n:
                    place(size, first + whole, 1, left, n, n)
                    n = 0
                    whole += 1
                if whole < bins:
                    room[left].append((first + whole, bins - whole))
            if not room[left]:
                del room[left]
            if not n:
                break
        per = capacity // size
        if n // per:
            place(size, used, n // per, capacity, per, n // per * per)
            used += n // per
            n %= per
        if n:
            place(size, used, 1, capacity, n, n)
            used += 1
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(items: DataFrame) -> DataFrame:
    """``items`` with ``rank``: a number from 0 among those of equal ``length``.

    Numbers are given within hash groups; their offsets come from a table with one row per
    length and group, so a length that a third of all rows have is spread over many tasks.
    """
    spread = items.withColumn("group", F.pmod(F.xxhash64("id", "piece", "ids_crc32"),
                                              F.lit(RANK_GROUPS)).cast("int"))
    sizes = spread.groupBy("length", "group").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("group").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "group", F.coalesce(F.sum("n").over(ahead), F.lit(0))
                           .alias("ahead"))
    order = Window.partitionBy("length", "group").orderBy("id", "piece", "ids_crc32")
    return (spread.withColumn("at", F.row_number().over(order))
            .join(offsets, ["length", "group"])
            .withColumn("rank", F.col("ahead") + F.col("at") - 1).drop("group", "ahead", "at"))


def pack(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row per piece.

    A document is the ids of its text (null: empty) and the end id 0.  Longer documents are cut
    into pieces of ``capacity`` tokens, of which the first may be shorter.  Returns the id
    column, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``
    (gapless from 0 in each sequence).

    Only the number of pieces of each length reaches the driver: at most ``capacity`` rows.
    Repeated rows and rows without an id are documents like any other.  No documents, no rows;
    other columns are not read.
    """
    items = stage(pieces(docs, path, capacity, id_col, text_col), "pieces")
    count = {r["length"]: r["n"]
             for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = plan(count, capacity)
    key = (table[:, 0].astype(np.int64) << 48) + table[:, 1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = table[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            past = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 2] + past // row[:, 3]),
                 pa.array(row[:, 4] + past % row[:, 3] * length)],
                [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(items).select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        assign, f"`{id_col}` {schema_of(docs, id_col)}, piece int, start bigint, length bigint, "
                "ids_crc32 bigint, sequence_id bigint, offset bigint")
