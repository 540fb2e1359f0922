"""Removal of repeated passages through a hash-compared sort of sampled suffixes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (BASE_INVERSE, U64, Scratch, binary_spans, digest16, mix, powers, prefix_hash, schema_of, slices, span_hash,
                     text_blocks, text_bytes)

#: Bytes of the gram by which suffixes are sampled.
GRAM = 32
#: Suffixes that one task sorts, on average.
SORTED = 16_384
#: Follows the end of a document in a suffix; no UTF-8 text holds this byte.
END = 0xFF
_FIRST = mix(np.arange(1, 257, dtype=U64))
_SECOND = mix(np.arange(1001, 1257, dtype=U64))


def sample_suffixes(data: np.ndarray, offsets: np.ndarray, length: int
                    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled places of documents laid end to end: row, place, backs, gram, context.

    Of the grams of every ``length``-byte window that with the least hash (the leftmost of
    equals) is sampled.  Equal windows sample the same place, so a window occurs twice only if
    the gram sampled in it does.  The context is what windows around the place can reach: up to
    ``length - GRAM`` bytes before it and ``length`` from it on, within the document.  A place
    is packed with these two margins: place << 32 | before << 16 | after.  The windows that
    sample a place begin ``near`` to ``far`` bytes before it: near << 16 | far.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    window = length - GRAM + 1
    if n < length:
        return empty, empty, empty, empty.view(U64), empty.view(U64)
    prefix = prefix_hash(_FIRST[data])
    at = np.arange(n - GRAM + 1, dtype=U64)
    grams = (prefix[GRAM:] - prefix[:-GRAM]) * powers(n + 1, BASE_INVERSE)[:len(at)]
    # the least (hash, place) of every window, from running minima of blocks as long as one
    ranks = grams & U64(0xFFFFFFFF00000000) | at
    blocks = -(-len(ranks) // window)
    grid = np.full(blocks * window, np.iinfo(np.uint64).max, U64)
    grid[:len(ranks)] = ranks
    grid = grid.reshape(blocks, window)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    least = np.minimum(ahead[:n - length + 1], behind[window - 1:window + n - length])
    whole = np.ones(len(least), bool)
    for end in offsets[1:-1].tolist():                 # windows that cross a document's end
        whole[max(0, end - length + 1):end] = False
    start = np.flatnonzero(whole)
    least = least[whole]
    new = np.flatnonzero(np.append(True, least[1:] != least[:-1])[:len(least)])
    places = (least[new] & U64(0xFFFFFFFF)).astype(np.int64)
    # the windows of a place are consecutive
    far = places - start[new]
    near = places - start[np.append(new[1:], len(least)) - 1] if len(new) else empty
    row = np.searchsorted(offsets, places, "right") - 1
    low = np.maximum(offsets[row], places - (length - GRAM))
    high = np.minimum(offsets[row + 1], places + length)
    margins = (places - low) << 16 | (high - places)
    context = mix(span_hash(prefix_hash(_SECOND[data]), low, high) ^ mix(margins.astype(U64)))
    return row, (places - offsets[row]) << 32 | margins, near << 16 | far, grams[places], context


def _sampled(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, "text"):
            row, place, backs, gram, context = sample_suffixes(data, offsets, length)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id")[rows].take(take), batch.column("mark")[rows].take(take),
                 pa.array(place), pa.array(backs.astype(np.int32)),
                 pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))],
                ["id", "mark", "place", "backs", "gram", "context"])


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes around each place of a document: from it on, then backwards from before it.

    Rows that repeat stand in one partition; one of them is enough.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    reach = length - GRAM
    seen = set()
    for batch in slices(batches):
        for *key, text, places in zip(*(batch.column(c).to_pylist() for c in (
                "id", "mark", "text", "places"))):
            if tuple(key) in seen:
                continue
            seen.add(tuple(key))
            data = np.frombuffer(unpack(text), np.uint8)
            padded = np.full(len(data) + reach + length, END, np.uint8)
            padded[reach:reach + len(data)] = data
            at = np.array([p["place"] >> 32 for p in places])[:, None] + reach
            wanted = np.concatenate([at + np.arange(length), at - 1 - np.arange(reach)], 1)
            suffixes = padded[wanted]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p["gram"] for p in places], pa.int64()),
                 pa.array([p["context"] for p in places], pa.int64()),
                 pa.array([s.tobytes() for s in suffixes], pa.binary())],
                ["gram", "context", "suffix"])


class Suffixes:
    """Strings of equal length, compared through hashes of their prefixes.

    Hashes are kept of prefixes of whole blocks; inside a block the bytes decide.
    """

    BLOCK = 16

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        n, width = rows.shape
        self.blocks = -(-width // self.BLOCK)
        padded = np.full((n, self.blocks * self.BLOCK), END, np.uint8)
        padded[:, :width] = rows
        self.words = padded.view(">u8").astype(U64)
        self.prefix = np.zeros((n, self.blocks + 1), U64)
        weights = powers(padded.shape[1])[:padded.shape[1]]
        for a in range(0, n, 1024):
            sums = np.add.reduceat(_FIRST[padded[a:a + 1024]] * weights,
                                   np.arange(0, padded.shape[1], self.BLOCK), axis=1)
            np.cumsum(sums, axis=1, out=self.prefix[a:a + 1024, 1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many blocks strings a and b begin with in common: a binary search for the
        longest prefix of equal hash."""
        low = np.zeros(len(a), np.int64)
        high = np.full(len(a), self.blocks)
        for _ in range(self.blocks.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.prefix[a, middle] == self.prefix[b, middle]
            low = np.where(same, middle, low)
            high = np.where(same, high, np.maximum(middle - 1, low))
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether string a sorts before string b (or is equal, where asked for)."""
        at = self.common(a, b)
        inside = np.minimum(at, self.blocks - 1) * 2
        one, two = self.words[a, inside], self.words[b, inside]
        less = np.where(one == two, self.words[a, inside + 1] < self.words[b, inside + 1], one < two)
        return np.where(at == self.blocks, or_equal, less)

    def sort(self) -> np.ndarray:
        """Mergesort, all merges of a level at once: each string finds its place in the run it
        is merged with by binary search.  Neighbours are then compared byte by byte; should a
        hash have been wrong, the bytes themselves are sorted."""
        n = len(self.rows)
        order, place, width = np.arange(n), np.arange(n), 1
        while width < n:
            run = place // width
            first = np.minimum((run ^ 1) * width, n)
            low, high = first.copy(), np.minimum(first + width, n)
            right = (run & 1).astype(bool)
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                ahead = self.before(order[middle], order[open_], right[open_])
                low[open_] = np.where(ahead, middle + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], middle)
            merged = np.empty_like(order)
            merged[run // 2 * 2 * width + (place - run * width) + (low - first)] = order
            order, width = merged, width * 2
        if n > 1 and not self._in_order(order):
            order = np.lexsort(self.rows.T[::-1])
        return order

    def _in_order(self, order: np.ndarray) -> bool:
        one, two = self.rows[order[:-1]], self.rows[order[1:]]
        differ = one != two
        at = differ.argmax(1)
        line = np.arange(len(one))
        return bool((~differ.any(1) | (one[line, at] < two[line, at])).all())


def _extensions(rows: np.ndarray, a: np.ndarray, b: np.ndarray, length: int, by_left: bool
                ) -> tuple[np.ndarray, np.ndarray]:
    """Common bytes of neighbouring suffixes from their places on, and before them, compared
    byte by byte; nothing beyond the end of a document is common."""
    same = (rows[a] == rows[b]) & (rows[a] != END)
    reach = length - GRAM
    if by_left:
        right = np.concatenate([same[:, :GRAM], same[:, GRAM + reach:]], 1)
        left = same[:, GRAM:GRAM + reach]
    else:
        right, left = same[:, :length], same[:, length:]
    return _leading(right), _leading(left)


def _leading(same: np.ndarray) -> np.ndarray:
    return np.where(same.all(1), same.shape[1], (~same).argmax(1))


def _neighbours(batches: Iterator[pa.RecordBatch], length: int, by_left: bool
                ) -> Iterator[pa.RecordBatch]:
    """Sort a partition's suffixes and compare neighbours; the first and the last one go on."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    width = 2 * length - GRAM
    flat, _ = binary_spans(table.column("suffix"), np.uint8)
    rows = flat.reshape(-1, width)
    order = Suffixes(rows).sort()
    gram = table.column("gram").to_numpy()
    context = table.column("context").to_numpy()
    a, b = order[:-1], order[1:]
    same = gram[a] == gram[b]
    a, b = a[same], b[same]
    right, left = _extensions(rows, a, b, length, by_left)
    both = np.concatenate([a, b])
    ends = order[[0, -1]] if len(order) > 1 else order
    none = pa.nulls(len(both), pa.binary())
    yield pa.RecordBatch.from_arrays(
        [pa.array(gram[both]), pa.array(context[both]), pa.array(np.tile(right, 2).astype(np.int32)),
         pa.array(np.tile(left, 2).astype(np.int32)), none],
        ["gram", "context", "right", "left", "suffix"])
    yield pa.RecordBatch.from_arrays(
        [pa.array(gram[ends]), pa.array(context[ends]), pa.nulls(len(ends), pa.int32()),
         pa.nulls(len(ends), pa.int32()), pa.array([rows[i].tobytes() for i in ends], pa.binary())],
        ["gram", "context", "right", "left", "suffix"])


def neighbours(scratch: Scratch, suffixes: DataFrame, length: int, by_left: bool) -> DataFrame:
    """(gram, context, right, left): the common extensions of each suffix with those next to it
    in the order of all.

    Ranges of the order are sorted apart; the ends of the ranges are sorted again, among
    themselves, until they fit one task.  Suffixes are distinct, so a range can be cut anywhere
    and no gram, however frequent, fills one task.
    """
    fields = "gram bigint, context bigint, right int, left int, suffix binary"
    found, left = [], suffixes
    while True:
        tasks = math.ceil(left.count() / SORTED)
        dealt = left.repartitionByRange(tasks, "suffix") if tasks > 1 else left.coalesce(1)
        result = scratch.stage(dealt.mapInArrow(
            lambda b: _neighbours(b, length, by_left), fields), "neighbours")
        found.append(result.where("right is not null").drop("suffix"))
        if tasks <= 1:
            break
        left = result.where("right is null").select("gram", "context", "suffix")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Digests of the windows that begin ``low`` to ``high`` bytes before a place."""
    reach = length - GRAM
    for batch in slices(batches):
        out: list[tuple[int, int, int, bytes]] = []
        for gram, context, suffix, low, high in zip(*(batch.column(c).to_pylist() for c in (
                "gram", "context", "suffix", "low", "high"))):
            right, left = suffix[:length], suffix[length:][::-1]
            for back in range(max(low, 0), min(high, reach) + 1):
                text = left[reach - back:] + right[:length - back]
                if END not in text:
                    out.append((gram, context, back, digest16(text)))
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
            ["gram", "context", "back", "digest"])


def _packed(docs: DataFrame) -> DataFrame:
    """Documents with their texts compressed, for a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"), batch.column("no_id"), pa.array(
                    [pack(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])],
                    pa.binary())], ["id", "mark", "no_id", "text"])
    return docs.mapInArrow(run, "id bigint, mark bigint, no_id boolean, text binary")


def _cut(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches):
        texts, rows = [], []
        for packed, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            text = unpack(packed)
            kept, n_spans, at, done = [], 0, 0, 0
            for start, end in sorted((s["start"], s["end"]) for s in spans or []):
                if start > at or not n_spans:
                    kept.append(text[at:start])
                    n_spans += 1
                at = max(at, end)
            kept.append(text[at:])
            left = b"".join(kept)
            texts.append(left.decode("utf-8", "ignore") if as_text else left)
            rows.append((len(text), len(text) - len(left), n_spans,
                         hashlib.sha256(left).hexdigest()))
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("no_id"),
             pa.array(texts, pa.string() if as_text else pa.binary()),
             *(pa.array(c, t) for c, t in zip(columns, kinds))],
            ["id", "no_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame, length: int = 200, id_col: str = "doc_id",
                 text_col: str = "text", as_text: bool = False) -> DataFrame:
    """Removes each byte covered by a ``length``-byte string that also starts anywhere else.

    One row per input row: the id column, ``kept`` (the remaining bytes), ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept_sha256``.  Strings are judged
    on the input, occurrences in the same document and overlapping ones count, and no string
    crosses a document's end.  Null text is empty; every row is a document of its own, so texts
    of repeated rows repeat; rows may lack an id; ids are integers.  An empty table gives no
    rows; other columns are not read.  Removal may cut a character, so ``kept`` is binary; with
    ``as_text`` it is a string without such fragments.

    Suffixes are sampled (``sample_suffixes``).  Contexts that are equal as a whole are found by
    an aggregate and kept once; the others are sorted twice, by what follows the place and by
    what precedes it.  If the neighbours in both orders leave open whether some windows repeat
    (the longest match to the right and that to the left are different suffixes), the digests of
    just these windows decide.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    source = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("id"),
        F.xxhash64(F.col(text_col), F.col(id_col).isNull()).alias("mark"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).isNull().alias("no_id"))
    places = scratch.stage(source.select("id", "mark", "text").mapInArrow(
        lambda b: _sampled(b, length), "id bigint, mark bigint, place bigint, backs int, "
                                       "gram bigint, context bigint"), "places")
    several = scratch.stage(places.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
                            .select("gram"), "several")
    shared = scratch.stage(places.join(several, "gram"), "shared")
    scratch.drop("places")
    groups = scratch.stage(shared.groupBy("gram", "context").agg(
        F.count("*").alias("n"), F.first("id").alias("id"), F.first("mark").alias("mark"),
        F.first("place").alias("place"), F.first("backs").alias("backs")), "groups")
    mixed = groups.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram")
    compared = scratch.stage(groups.join(mixed, "gram"), "compared")

    packed = _packed(source.select("id", "mark", "no_id", "text"))
    wanted = compared.groupBy("id", "mark").agg(
        F.collect_list(F.struct("place", "gram", "context")).alias("places"))
    suffixes = scratch.stage(packed.join(wanted.hint("shuffle_hash"), ["id", "mark"]).select(
        "id", "mark", "text", "places").mapInArrow(
        lambda b: _contexts(b, length), "gram bigint, context bigint, suffix binary"), "suffixes")
    by_left = suffixes.withColumn("suffix", F.concat(
        F.expr(f"substring(suffix, 1, {GRAM})"), F.expr(f"substring(suffix, {length + 1})"),
        F.expr(f"substring(suffix, {GRAM + 1}, {length - GRAM})")))
    near = neighbours(scratch, suffixes, length, False).union(
        neighbours(scratch, by_left, length, True))

    # a context's own windows between the longest matches to both sides; those that neither of
    # the two decides are compared by digest with the same windows of the gram's other contexts
    best = near.groupBy("gram", "context").agg(
        F.max(F.struct("right", "left")).alias("r"), F.max(F.struct("left", "right")).alias("l"))
    reach = best.join(compared.select("gram", "context", "backs"), ["gram", "context"]).select(
        "gram", "context",
        F.greatest(F.shiftright("backs", 16), length - F.col("r.right")).alias("low"),
        F.least(F.col("backs").bitwiseAND(F.lit(0xFFFF)), F.col("l.left")).alias("high"),
        (F.col("r.left") + 1).alias("open_low"), (length - F.col("l.right") - 1).alias("open_high"))
    reach = scratch.stage(reach.where("low <= high"), "reach")
    unsure = reach.select("gram", F.greatest("low", "open_low").alias("open_low"),
                          F.least("high", "open_high").alias("open_high")).where(
        "open_low <= open_high").groupBy("gram").agg(
        F.min("open_low").alias("open_low"), F.max("open_high").alias("open_high"))
    asked = reach.drop("open_low", "open_high").join(unsure, "gram").select(
        "gram", "context", F.greatest("low", "open_low").alias("low"),
        F.least("high", "open_high").alias("high")).where("low <= high")
    windows = scratch.stage(suffixes.join(asked, ["gram", "context"]).mapInArrow(
        lambda b: _windows(b, length),
        "gram bigint, context bigint, back int, digest binary"), "windows")
    scratch.drop("suffixes")
    # a whole context that occurs twice; a match with a neighbour; windows decided one by one
    place = F.shiftright("place", 32)
    before, after = (F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF)),
                     F.col("place").bitwiseAND(F.lit(0xFFFF)))
    whole = shared.join(groups.where("n > 1").select("gram", "context"), ["gram", "context"]).select(
        "id", "mark", (place - before).alias("start"), (place + after).alias("end"))
    single = compared.where("n = 1").select("gram", "context", "id", "mark", place.alias("place"))
    partly = near.where(F.col("right") + F.col("left") >= length).join(
        single, ["gram", "context"]).select(
        "id", "mark", (F.col("place") - F.col("left")).alias("start"),
        (F.col("place") + F.col("right")).alias("end"))
    # one window may be reached from several places of its document
    located = windows.join(groups, ["gram", "context"]).select(
        "digest", "id", "mark", "n", (place - F.col("back")).alias("start"))
    twice = located.groupBy("digest").agg(
        F.countDistinct("id", "mark", "start").alias("starts"), F.max("n").alias("n")).where(
        "starts > 1 or n > 1").select("digest")
    one_by_one = located.where("n = 1").join(twice, "digest").select(
        "id", "mark", "start", (F.col("start") + length).alias("end"))
    spans = scratch.stage(whole.union(partly).union(one_by_one).groupBy("id", "mark").agg(
        F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    for name in ("several", "shared", "groups", "compared", "neighbours", "reach", "windows"):
        scratch.drop(name)

    kind = "string" if as_text else "binary"
    result = packed.join(spans.hint("shuffle_hash"), ["id", "mark"], "left").select(
        "id", "no_id", "text", "spans").mapInArrow(
        lambda b: _cut(b, as_text), f"id bigint, no_id boolean, kept {kind}, n_bytes bigint, "
                                    "n_removed bigint, n_spans bigint, kept_sha256 string")
    return result.select(F.when(~F.col("no_id"), F.col("id")).cast(schema_of(docs, id_col))
                         .alias(id_col), "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")
