"""Jaccard join on word shingles through a token-group matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (BLOCK_BYTES, U64, Scratch, components, digest16, mix, prefix_hash, ragged,
                     schema_of, segment_sums, slices, sorted_groups, span_hash, text_blocks,
                     text_bytes)

#: Documents of a group, and queries worked on at once against one, on average.
GROUP = 128
QUERIES = 512
#: Tokens that two prefixes have in common at least (less only for the smallest sets).
COMMON = 3
#: At most so many tokens, the most frequent ones, are told to every task; they come last in
#: the order of tokens.  Any order gives the same links.
FREQUENT = 1 << 18
_WINDOW = 1 << 22
_WORD_STEP = U64(0xD6E8FEB86659FD93)
_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle codes of texts laid end to end.

    A-Z are lower-cased; words are runs of anything but ASCII white space.  A text with fewer
    words is one shingle, a text without words has none.
    """
    n = len(data)
    if not n:
        return [np.zeros(0, U64)] * (len(offsets) - 1)
    low = data + (((data >= 0x41) & (data <= 0x5A)) * np.uint8(0x20))
    blank = np.ones(n + 2, bool)
    blank[1:-1] = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~blank[1:-1]
    starts = np.flatnonzero(inside & (blank[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside & (blank[2:] | edge[1:])) + 1
    codes = span_hash(prefix_hash(_BYTE_VALUES[low]), starts, ends)
    bounds = np.searchsorted(starts, offsets)
    count = max(0, len(codes) - words + 1)
    shingles = np.full(count, U64(words))
    for i in range(words):
        shingles = shingles * _WORD_STEP + codes[i:i + count]
    shingles = mix(shingles)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(shingles[a:b - words + 1]))
        elif b > a:
            code = U64(b - a)
            with np.errstate(over="ignore"):
                for i in range(a, b):
                    code = code * _WORD_STEP + codes[i]
            out.append(mix(np.array([code], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


class _Threshold:
    """Jaccard similarity of at least ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, n):
        """Tokens of a set of ``n`` that any similar set holds too, and its least size."""
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        """Two similar sets have ``need`` tokens in common within such prefixes."""
        least = self.least(n)
        return n - least + min(COMMON, least)

    def need(self, n: int) -> int:
        return min(COMMON, self.least(self.least(n)))

    def linked(self, overlap, n, m):
        return self.den * overlap >= self.num * (n + m - overlap)


def _signatures(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Per document its set's size and digest; per window of shingles, those seen repeatedly."""
    window: list[np.ndarray] = []
    held = 0

    def repeated() -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(window), return_counts=True)
        some = n > 2
        return _padded(token=tokens[some].view(np.int64), times=n[some])

    for batch in batches:
        for rows, data, offsets in text_blocks(batch, "text"):
            sets = shingle_sets(data, offsets, words)
            yield _padded(id=batch.column("id")[rows],
                          n=np.array([len(s) for s in sets], np.int64),
                          digest=pa.array([digest16(s.tobytes()) for s in sets], pa.binary()))
            window += sets
            held += sum(map(len, sets))
            if held > _WINDOW:
                yield repeated()
                window, held = [], 0
    if held:
        yield repeated()


def _padded(id=None, n=None, digest=None, token=None, times=None) -> pa.RecordBatch:
    size = len(n) if n is not None else len(token)
    columns = {"id": id, "n": n, "digest": digest, "token": token, "times": times}
    kinds = {"id": pa.int64(), "n": pa.int64(), "digest": pa.binary(), "token": pa.int64(),
             "times": pa.int64()}
    return pa.RecordBatch.from_pydict({
        c: pa.nulls(size, kinds[c]) if v is None else pa.array(v, kinds[c])
        if isinstance(v, np.ndarray) else v for c, v in columns.items()})


def _frequent(scratch: Scratch, seen: DataFrame) -> np.ndarray:
    """The most frequent tokens, FREQUENT at most, sorted."""
    totals = scratch.stage(seen.groupBy("token").agg(F.sum("times").alias("times")), "repeated")
    level = F.floor(F.log2("times") * 4).cast("int")
    steps = {r["level"]: r["n"] for r in
             totals.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    total, bound = 0, None
    for step in sorted(steps, reverse=True):
        total += steps[step]
        if total > FREQUENT:
            break
        bound = step
    if bound is None:
        return np.zeros(0, U64)
    return np.sort(totals.where(level >= bound).select("token").toArrow()
                   .column("token").to_numpy().view(U64))


def _prefixes(docs: DataFrame, words: int, limit: _Threshold, frequent: np.ndarray) -> DataFrame:
    """Per document the prefix of its tokens (frequent ones last), how many it must share, and
    a key that similar documents tend to have in common."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                sets = shingle_sets(data, offsets, words)
                tokens, need, key = [], [], []
                for own in sets:
                    n = len(own)
                    often = np.zeros(n, bool)
                    if n and len(known):
                        often = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
                    order = np.argsort(often, kind="stable")
                    tokens.append(own[order][:limit.prefix(n)] if n else own)
                    need.append(limit.need(n) if n else 0)
                    # a third of the near copies' shingles may differ, the common ones stay
                    base = own[often] if 2 * often.sum() >= n else own
                    size = int(math.log(n) / -math.log(limit.num / limit.den)) if n else 0
                    key.append(int(mix(np.array([base[0]]))[0]) ^ size if n else 0)
                sizes = np.array([len(t) for t in tokens], np.int64)
                flat = np.concatenate(tokens).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[rows], pa.array(np.array(need, np.int32)),
                     pa.array(np.array(key, U64).view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()),
                                              pa.array(flat))], ["id", "need", "key", "tokens"])

    return docs.mapInArrow(run, "id bigint, need int, key bigint, tokens array<bigint>")


def _qualifying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups whose token union holds enough of a document's prefix."""
    for batch in batches:
        at, found = [], []
        for i, (need, groups) in enumerate(zip(batch.column("need").to_pylist(),
                                               batch.column("groups"))):
            flat = groups.values.flatten().to_numpy()
            group, n = np.unique(flat, return_counts=True)
            group = group[n >= need]
            at.append(np.full(len(group), i))
            found.append(group)
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(at)),
             pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["id", "gid"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the shuffles: they are smaller than the sets made of them."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in slices(batches):
        data, offsets = text_bytes(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([pack(data[a:b].tobytes()) for a, b in
                                           zip(offsets[:-1], offsets[1:])], pa.binary())], ["id", "text"])


def _unpacked(column: pa.ChunkedArray, words: int) -> Iterator[np.ndarray]:
    """The sets of compressed texts, made from about BLOCK_BYTES of text at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    held: list[bytes] = []
    size = 0
    for packed in column:
        held.append(unpack(packed.as_buffer()))
        size += len(held[-1])
        if size > BLOCK_BYTES:
            yield from _sets_of(held, words)
            held, size = [], 0
    yield from _sets_of(held, words)


def _sets_of(texts: list[bytes], words: int) -> list[np.ndarray]:
    return shingle_sets(np.frombuffer(b"".join(texts), np.uint8),
                        np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64)), words)


def _open_groups(batches: Iterator[pa.RecordBatch], words: int, limit: _Threshold
                 ) -> Iterator[pa.RecordBatch]:
    """Compare the queries of each opened group with all its members.

    Gives every query's links (in documents) and, of the links, only those that join parts of
    the group not yet joined by others.  Rows with the same id and set count once.
    """
    for table in sorted_groups(batches, "gid", "block"):
        member = ~table.column("query").to_numpy()
        ids, weight = table.column("id").to_numpy(), table.column("weight").to_numpy()
        if not member.any():
            continue
        sets = list(_unpacked(table.column("text"), words))
        if len(np.unique(ids * 2 + member)) < len(ids):
            first = {(i, m, s.tobytes()): n for n, (i, m, s) in reversed(list(enumerate(
                zip(ids.tolist(), member.tolist(), sets))))}
            kept = np.sort(list(first.values()))
            member, ids, weight = member[kept], ids[kept], weight[kept]
            sets = [sets[n] for n in kept.tolist()]
        tokens = np.concatenate(sets)
        offsets = np.append(0, np.cumsum([len(s) for s in sets], dtype=np.int64))
        rows = np.flatnonzero(member)
        sizes = offsets[rows + 1] - offsets[rows]
        flat = tokens[ragged(offsets[rows], sizes)]
        union, place = np.unique(flat, return_inverse=True)
        ends = np.append(0, np.cumsum(sizes))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for q in np.flatnonzero(~member):
            own = tokens[offsets[q]:offsets[q + 1]]
            at = np.minimum(np.searchsorted(union, own), len(union) - 1)
            flag = np.zeros(len(union), np.int64)
            flag[at[union[at] == own]] = 1
            overlap = segment_sums(flag[place], ends)
            hit = np.flatnonzero(limit.linked(overlap, len(own), sizes) & (ids[rows] != ids[q]))
            if not len(hit):
                continue
            other = ids[rows[hit]]
            first = True
            for v in other.tolist():
                a, b = find(int(ids[q])), find(v)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(ids[q]), v, int(weight[rows[hit]].sum()) if first else 0))
                    first = False
            if first:
                out.append((int(ids[q]), None, int(weight[rows[hit]].sum())))
        columns = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                         ["u", "v", "links"])


def ngram_join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column, ``n_shingles``, ``component_id``, ``n_links``.

    Documents link when the Jaccard similarity of their sets of ``words``-word shingles is at
    least ``num / den``; ``component_id`` is the smallest id that links reach, ``n_links`` the
    number of other documents linked directly.

    1. Equal sets become one class, and its smallest id stands for it.
    2. Similar classes are put into groups of about GROUP, and the token-group matrix holds the
       union of the groups' tokens, here of the prefixes that similar sets must share.
    3. A class's prefix bounds its overlap with every group; only groups that could hold a
       similar set are opened, and compared exactly, a block of queries at a time.
    4. Links join components.

    Ids are integers.  Null or empty texts, and texts without words, have no shingles and no
    links.  A row without an id has no component and no links.  Rows that share an id are one
    document: what one links to, all do.  An empty table gives no rows; other columns are not
    read.
    """
    limit = _Threshold(num, den)
    scratch = Scratch(docs.sparkSession, "ngram-join")
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    scanned = scratch.stage(source.mapInArrow(
        lambda b: _signatures(b, words),
        "id bigint, n bigint, digest binary, token bigint, times bigint"), "signatures")
    rows = scanned.where("digest is not null").select("id", "n", "digest")
    classes = scratch.stage(rows.where("n > 0 and id is not null").groupBy("digest").agg(
        F.min("id").alias("rep"), F.count("*").alias("weight")), "classes")
    frequent = _frequent(scratch, scanned.where("token is not null").select("token", "times"))

    scratch.drop("repeated")
    reps = classes.groupBy(F.col("rep").alias("id")).agg(F.max("weight").alias("weight"))
    sets = scratch.stage(_prefixes(source.where("id is not null"), words, limit, frequent).join(
        reps, "id"), "prefixes")
    tokens = sets.select("id", F.explode("tokens").alias("token"))
    repeated = tokens.groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where(
        "lo < hi").select("token")
    matched = scratch.stage(tokens.join(repeated, "token").distinct(), "matched")
    enough = matched.groupBy("id").agg(F.count("*").alias("n")).join(
        sets.groupBy("id").agg(F.min("need").alias("need"), F.min("key").alias("key"),
                               F.max("weight").alias("weight")), "id").where("n >= need")
    enough = scratch.stage(enough.select("id", "need", "key", "weight"), "candidates")
    scratch.drop("prefixes")
    parts = enough.groupBy("key").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    grouped = scratch.stage(enough.join(parts, "key").select(
        "id", "need", "weight",
        F.xxhash64("key", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("gid")), "groups")

    cells = matched.join(grouped, "id").select("token", "id", "need", "gid")
    cells = scratch.stage(cells, "cells")
    scratch.drop("candidates")
    scratch.drop("matched")
    matrix = cells.groupBy("token").agg(F.collect_set("gid").alias("groups"))
    bounds = cells.select("token", "id", "need").join(matrix, "token").groupBy("id").agg(
        F.min("need").alias("need"), F.collect_list("groups").alias("groups"))
    opened = bounds.mapInArrow(_qualifying, "id bigint, gid bigint")
    sizes = grouped.groupBy("gid").agg(F.count("*").alias("members"))
    opened = scratch.stage(opened.join(grouped.select("id", F.col("gid").alias("own")), "id")
                   .join(sizes, "gid").where("gid != own or members > 1")
                   .select("id", "gid"), "opened")
    scratch.drop("cells")
    blocks = opened.groupBy("gid").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    blocks = scratch.stage(blocks, "blocks")

    asked = opened.join(blocks, "gid").select(
        "id", "gid", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"),
        F.lit(True).alias("query"), F.lit(0).cast("bigint").alias("weight"))
    held = grouped.join(blocks, "gid").select(
        "id", "gid", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(False).alias("query"), "weight")
    packed = source.where("id is not null").mapInArrow(_packed, "id bigint, text binary")
    work = asked.unionByName(held).join(packed, "id").select(
        "gid", "block", "query", "id", "weight", "text")
    links = scratch.stage(work.repartition("gid", "block").sortWithinPartitions("gid", "block").mapInArrow(
        lambda b: _open_groups(b, words, limit), "u bigint, v bigint, links bigint"), "links")

    for name in ("blocks", "opened", "groups"):
        scratch.drop(name)
    joined = components(links.where("v is not null"))
    counts = links.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    known = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(
        counts, "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    known = scratch.stage(known, "class-components")
    scratch.drop("links")
    scratch.drop("classes")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    return rows.join(known, "digest", "left").select(
        F.col("id").cast(schema_of(docs, id_col)).alias(id_col), F.col("n").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id"))
        .cast(schema_of(docs, id_col)).alias("component_id"),
        F.when(alone, 0).otherwise(F.col("n_links")).cast("bigint").alias("n_links"))
