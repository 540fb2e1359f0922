"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One replaced letter takes one from a count and adds one to another; one inserted letter adds one.
So the counts of two near words differ by at most two, and a k-d tree over them reaches all
candidates through the few boxes that lie within one letter gained and one lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

MIN_CHARS = 7
MIN_TIMES = 2
#: A form is this many times as frequent as its variant.
FORM_RATIO = 10
#: Words of a cell, that is of one task's tree, and of a leaf of it.
CELL = 4096
LEAF = 48
#: Words that the trees which deal words to cells are built on; they shape cells, not results.
SAMPLE = 1 << 17
#: Distinct words that a task counts before it hands them on.
GATHERED = 1 << 17
#: Characters of text whose runs are held at once.
PIECE = 1 << 20
# fixed values: the letters of a word; all of them are one byte in Latin-1
_LETTERS = "A-Za-zÀ-ÿ"
#: Letter counts are written in unary, so that their distance is a number of differing bits.
_A_TO_Z_BITS, _OTHER_BITS = 4, 2
DIMS = 26 + 64


def typo(doc_id: object, word: str, every: int) -> str:
    """``word`` without one of its letters where ``every`` divides its checksum in the document."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    return word if h % every else word[:h % len(word)] + word[h % len(word) + 1:]


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             min_chars: int = MIN_CHARS, min_times: int = MIN_TIMES, typos_every: int = 0
             ) -> DataFrame:
    """Distinct words of all texts: ``word`` (a maximal run of letters, A-Z lower-cased) and ``n``,
    how often it occurs; only those of ``min_chars`` letters and ``min_times`` occurrences.

    ``typos_every``: if not 0, :func:`typo` damages words on the way.  Null and empty texts have no
    words; a null id is written as nothing.  Each task counts its words before the shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{_LETTERS}]{{{min_chars},}}")
        any_letter = re.compile(f"[{_LETTERS}]*")
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("id"), batch.column("text")):
                # bytes.lower() changes A-Z only
                text = (text.as_py() or "").encode().lower().decode()
                own: Counter[str] = Counter()
                start = 0
                while start < len(text):
                    end = any_letter.match(text, min(start + PIECE, len(text))).end()
                    own.update(runs.findall(text, start, end))
                    start = max(end, start + 1)
                if typos_every:
                    head = f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode()
                    crc = zlib.crc32(head)
                    for word in [w for w in own if not zlib.crc32(w.encode(), crc) % typos_every]:
                        n = own.pop(word)
                        short = typo(doc_id.as_py(), word, typos_every)
                        if len(short) >= min_chars:
                            counts[short] += n
                for word, n in own.items():
                    counts[word] += n
                if len(counts) > GATHERED:
                    yield flush()
                    counts.clear()
        if counts:
            yield flush()

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return (read.mapInArrow(run, "word string, n bigint").groupBy("word")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= min_times))


class Words:
    """Words of one length: their letters, letter counts, and the counts in unary bits."""

    def __init__(self, words: list[str], length: int):
        raw = "".join(words).encode("latin-1")
        self.letters = np.frombuffer(raw, np.uint8).reshape(len(words), length)
        self.counts = letter_counts(self.letters)
        self.bits = _unary(self.counts)

    def __len__(self) -> int:
        return len(self.letters)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """Rows of counts: a to z, then U+00C0 to U+00FF."""
    n, length = letters.shape
    dims = np.where(letters < 0xC0, letters.astype(np.int64) - 0x61, letters.astype(np.int64) - 0xA6)
    flat = np.bincount((dims + np.arange(n)[:, None] * DIMS).ravel(), minlength=n * DIMS)
    return flat.reshape(n, DIMS).astype(np.int32)


def _unary(counts: np.ndarray) -> np.ndarray:
    """Counts as bits, packed into 64-bit numbers; greater counts look like the greatest one, so
    that a distance of bits never exceeds that of counts."""
    levels = [(counts[:, :26] >= k) for k in range(1, _A_TO_Z_BITS + 1)]
    levels += [(counts[:, 26:] >= k) for k in range(1, _OTHER_BITS + 1)]
    packed = np.packbits(np.concatenate(levels, 1), axis=1)
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    return np.ascontiguousarray(packed).view(np.uint64)


class LetterTree:
    """A k-d tree over letter counts.  Leaves are numbered from 0."""

    def __init__(self, counts: np.ndarray, leaf: int):
        #: per inner node: letter, greatest count on the left, left and right node (~leaf if one)
        self.nodes: list[tuple[int, int, int, int]] = []
        self.leaves: list[np.ndarray] = []
        self.root = self._build(counts, np.arange(len(counts)), leaf)

    def _build(self, counts: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        cut = self._cut(counts[rows]) if len(rows) > leaf else None
        if cut is None:
            self.leaves.append(rows)
            return ~(len(self.leaves) - 1)
        letter, most = cut
        at = len(self.nodes)
        self.nodes.append(None)
        left = counts[rows, letter] <= most
        self.nodes[at] = (letter, most, self._build(counts, rows[left], leaf),
                          self._build(counts, rows[~left], leaf))
        return at

    @staticmethod
    def _cut(own: np.ndarray) -> tuple[int, int] | None:
        """The letter and count that cut the rows closest to halves; None if all are equal."""
        best = None
        middle = np.median(own, axis=0).astype(own.dtype)
        for most in (middle - 1, middle):
            uneven = np.abs((own <= most).mean(0) - 0.5)
            letter = int(uneven.argmin())
            if uneven[letter] < 0.5 and (best is None or uneven[letter] < best[0]):
                best = (uneven[letter], letter, int(most[letter]))
        return best and best[1:]

    def reach(self, counts: np.ndarray, gained: int, lost: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows) for all rows of ``counts`` that may become a member of the leaf's box by
        adding up to ``gained`` letters and taking away up to ``lost``."""
        n = len(counts)
        stack = [(self.root, np.arange(n), np.zeros(n, np.int32), np.zeros(n, np.int32), {})]
        while stack:
            node, rows, up, down, box = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                yield ~node, rows
                continue
            letter, most, left, right = self.nodes[node]
            own = counts[rows, letter]
            low, high = box.get(letter, (0, None))
            # how far a row is from the box in this letter before and after the cut
            over = np.maximum(own - most, 0)
            was_over = np.maximum(own - high, 0) if high is not None else 0
            now_down = down + over - was_over
            ok = now_down <= lost
            stack.append((left, rows[ok], up[ok], now_down[ok], {**box, letter: (low, most)}))
            under = np.maximum(most + 1 - own, 0)
            now_up = up + under - np.maximum(low - own, 0)
            ok = now_up <= gained
            stack.append((right, rows[ok], now_up[ok], down[ok], {**box, letter: (most + 1, high)}))


def home(tree: LetterTree, counts: np.ndarray) -> np.ndarray:
    """The leaf that each row belongs to."""
    out = np.zeros(len(counts), np.int64)
    for leaf, rows in tree.reach(counts, 0, 0):
        out[rows] = leaf
    return out


def near_pairs(members: Words, guests: Words, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(guest, member) rows of words one edit apart.  ``same``: the guests are the members, each
    pair comes once.  Guests are as long as the members, or one letter shorter."""
    length = members.letters.shape[1]
    shorter = guests.letters.shape[1] < length
    tree = LetterTree(members.counts, LEAF)
    for leaf, rows in tree.reach(guests.counts, 1, 0 if shorter else 1):
        own = tree.leaves[leaf]
        step = max(1, (1 << 16) // len(own))
        for start in range(0, len(rows), step):
            asked = rows[start:start + step]
            apart = np.bitwise_count(guests.bits[asked][:, None] ^ members.bits[own][None]).sum(
                2, dtype=np.int32)
            g, m = np.nonzero(apart <= (1 if shorter else 2))
            g, m = asked[g], own[m]
            if same:
                g, m = g[g < m], m[g < m]
            ok = _one_edit(guests.letters[g], members.letters[m])
            if ok.any():
                yield g[ok], m[ok]


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced or (``a`` shorter) one inserted letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    head = np.cumprod(a == b[:, :-1], 1).sum(1)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], 1).sum(1)
    return head + tail >= a.shape[1]


def _deal(batches: Iterator[pa.RecordBatch], trees: dict[int, LetterTree]
          ) -> Iterator[pa.RecordBatch]:
    """Every word as a member of its cell (kind 0), and as a guest of the other cells of its
    length with a greater number (1) and of the next length (2) that its variants may be in."""
    for batch in batches:
        words, lengths = batch.column("word"), batch.column("length").to_numpy()
        parts = []
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            counts = Words(words.take(pa.array(at)).to_pylist(), length).counts
            tree, longer = trees.get(length), trees.get(length + 1)
            cells = home(tree, counts) if tree else np.zeros(len(at), np.int64)
            parts.append((length, cells, 0, at))
            for cell, rows in tree.reach(counts, 1, 1) if tree else ():
                rows = rows[cells[rows] < cell]
                parts.append((length, np.full(len(rows), cell), 1, at[rows]))
            for cell, rows in longer.reach(counts, 1, 0) if longer else [(0, np.arange(len(at)))]:
                parts.append((length + 1, np.full(len(rows), cell), 2, at[rows]))
        if parts:
            sizes = [len(rows) for *_, rows in parts]
            rows = pa.array(np.concatenate([rows for *_, rows in parts]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([p[0] for p in parts], sizes)),
                 pa.array(np.concatenate([p[1] for p in parts])),
                 pa.array(np.repeat([p[2] for p in parts], sizes)),
                 words.take(rows), batch.column("n").take(rows)],
                ["size", "cell", "kind", "word", "n"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the cells of a partition, in both directions.  A cell's members come first;
    its guests follow and are compared batch by batch."""
    cell, members, words, times = None, None, None, None
    held: list[pa.RecordBatch] = []

    def found(guests: Words, other: pa.Array, other_times: pa.Array, same: bool
              ) -> Iterator[pa.RecordBatch]:
        for g, m in near_pairs(members, guests, same):
            g, m = pa.array(g), pa.array(m)
            a, an, b, bn = other.take(g), other_times.take(g), words.take(m), times.take(m)
            for w, v, n in ((a, b, bn), (b, a, an)):
                yield pa.RecordBatch.from_arrays([w, v, n], ["word", "other", "other_n"])

    def gathered() -> Iterator[pa.RecordBatch]:
        nonlocal members, words, times
        if held:
            table = pa.Table.from_batches(held)
            held.clear()
            words, times = (table.column(c).combine_chunks() for c in ("word", "n"))
            members = Words(words.to_pylist(), cell[0])
            yield from found(members, words, times, True)

    for batch in slices(batches, CELL):
        keys = np.stack([batch.column(c).to_numpy() for c in ("size", "cell", "kind")], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            size, number, kind = keys[start].tolist()
            part = batch.slice(start, end - start)
            if kind:
                yield from gathered()
                if cell == (size, number):        # else no word of the table lies in the cell
                    yield from found(Words(part.column("word").to_pylist(), size - (kind == 2)),
                                     part.column("word"), part.column("n"), False)
            else:
                if cell != (size, number):
                    yield from gathered()
                    cell = (size, number)
                held.append(part)
    yield from gathered()


def near_words(words: DataFrame) -> DataFrame:
    """All pairs of ``words`` (word, n) that are one edit apart: ``word``, ``other``, ``other_n``,
    each pair in both directions.

    Words of one length are dealt to cells of about CELL words by a k-d tree on a sample of at
    most SAMPLE words; a length with fewer words is one cell.  A word meets the members of its own
    cell and goes as a guest to the cells that its variants may be in: every pair is found in
    exactly one cell.  Words with the same letters in another order are never near; the sample
    only shapes cells.
    """
    spark = words.sparkSession
    words = words.withColumn("length", F.length("word").cast("bigint"))
    sizes = {r["length"]: r["words"] for r in words.groupBy("length").agg(
        F.count("*").alias("words")).where(F.col("words") > CELL).collect()}
    trees = {}
    if sizes:
        every = -(-sum(sizes.values()) // SAMPLE)
        sample = words.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select(
            "length", "word").where(F.col("length").isin(*sizes)).toArrow()
        lengths = sample.column("length").to_numpy()
        for length, total in sizes.items():
            own = sample.column("word").take(pa.array(np.flatnonzero(lengths == length)))
            trees[length] = LetterTree(letter_counts(Words(own.to_pylist(), length).letters),
                                       max(1, CELL * len(own) // total))
            trees[length].leaves = []             # the members come from the table
    dealt = words.mapInArrow(lambda batches: _deal(batches, trees),
                             "size bigint, cell bigint, kind bigint, word string, n bigint")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (dealt.repartition(n, "size", "cell").sortWithinPartitions("size", "cell", "kind")
            .mapInArrow(_search, "word string, other string, other_n bigint"))


def spelling_variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """One row per word of ``words`` (word of letters a-z and U+00C0-U+00FF, n): ``word``, ``form``,
    ``root``, ``n``, ``n_near`` and ``form_n``.

    ``form``: the near word with the largest n (ties: the first in code-point order) if that is
    ``ratio`` times the word's own n at least, else null; ``root``: where its forms lead at last,
    the word itself if it has none; ``n_near``: the number of words one edit away.  An empty table
    gives no rows.  Forms grow in n from step to step, so chains are short; they are followed by
    doubling, with joins.
    """
    spark = words.sparkSession
    scratch = Scratch(spark, "spelling")
    words = scratch.stage(words.select("word", "n"), "words")
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    found = scratch.stage(words.join(best, "word", "left").select(
        "word", F.when(fits, F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(fits, -F.col("best.less")).alias("form_n")), "found")
    scratch.drop("words")
    roots = scratch.stage(found.where("form is not null").select("word", F.col("form").alias("root")),
                          "roots")
    moved = True
    while moved:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = scratch.stage(roots.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved")), "roots")
        moved = bool(roots.where("moved").limit(1).count())
    return found.join(roots.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
