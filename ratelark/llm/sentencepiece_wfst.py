"""SentencePiece encoding and decoding as the shortest path through a weighted transducer."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, ragged, row_blocks, schema_of, text_blocks
from .pretokens import PieceTable, span_ids

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: What an unknown character costs beyond the worst piece, in unigram models.
UNKNOWN_PENALTY = 10.0
#: Pairs of arcs whose weight, and parts of texts whose ids, a worker remembers.
REMEMBERED_PAIRS = 100_000
REMEMBERED_PARTS = 500_000
#: Ids decoded at once.
BLOCK_IDS = 1 << 16


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """Numbers and values of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else {5: 4, 1: 8}[key & 7]
        value = data[at:at + size]
        at += size
        yield key >> 3, struct.unpack("<f", value)[0] if key & 7 == 5 else value


class PieceTransducer:
    """Normaliser, pieces and byte fallback of a model, compiled for composition with inputs.

    * The normaliser rewrites blanks to the piece alphabet's space sign and puts one in front.
    * One arc per piece accepts its characters and emits its id; a character that no piece
      covers is accepted by an arc that emits its bytes (or the unknown id).
    * In a unigram model an arc weighs the negated score of its piece.
    * In a BPE model the scores are merge ranks, and adding them up along a path would not
      give the model's segmentation.  There a weight sits on each pair of neighbouring arcs
      instead: 0 if the merges of the two pieces' own characters end in exactly this pair,
      infinite if not.  Merges in disjoint regions don't see each other, so a sequence of
      pieces is what the merges give if and only if every neighbouring pair is: exactly one
      path has a finite weight, and the tropical shortest path finds it.
    """

    def __init__(self, path: str):
        with open(path, "rb") as file:
            raw = file.read()
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.dummy_prefix, self.extra_blanks, charsmap = UNIGRAM, True, True, b""
        self.byte_fallback = False
        for number, value in _fields(raw):
            if number == 1:
                own = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
                self.pieces.append((own[1].decode("utf-8"), own[2], own[3]))
            elif number == 2:
                trainer = dict(_fields(value))
                self.kind = trainer.get(3, UNIGRAM)
                self.byte_fallback = bool(trainer.get(35, 0))
            elif number == 3:
                rules = dict(_fields(value))
                charsmap = rules.get(2, b"")
                self.dummy_prefix = bool(rules.get(3, 1))
                self.extra_blanks = not rules.get(4, 1)
        if charsmap or not self.extra_blanks or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only identity normalisers and unigram or BPE models are supported")
        if any(t == USER for _, _, t in self.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        self.score = [s for _, s, _ in self.pieces]
        self.longest = max(map(len, self.ids))
        self.unknown = next(i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        worst = min((self.score[i] for i in self.ids.values()), default=0.0)
        self.unknown_cost = UNKNOWN_PENALTY - worst
        self._pairs: dict[tuple[str, str], bool] = {}     # a memory of finite()
        self._compile_glue()
        self._compile_outputs()

    def _compile_glue(self) -> None:
        """Which characters can stand next to each other inside a piece: elsewhere texts may
        be cut before the search, since no arc passes over the place."""
        letters = sorted({c for p in self.ids if len(p) > 1 for c in p})
        code = {c: i + 1 for i, c in enumerate(letters)}
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.glue = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for piece in self.ids:
            for a, b in zip(piece, piece[1:]):
                self.glue[code[a], code[b]] = True

    def _compile_outputs(self) -> None:
        values = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL
                  else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode()
                  for p, _, t in self.pieces]
        self.out_size = np.array([len(v) for v in values], np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.out_bytes = np.frombuffer(b"".join(values), np.uint8)

    def cuts(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places where no piece can pass, and all text starts."""
        start = np.zeros(len(points) + 1, bool)
        start[offsets] = True
        letters = self.letter[points]
        start[1:-1] |= ~self.glue[letters[:-1], letters[1:]]
        return np.flatnonzero(start[:-1])

    def merged(self, text: str) -> list[str]:
        """Symbols after all merges: the best score first, the leftmost of equals."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                found = self.ids.get(symbols[i] + symbols[i + 1])
                if found is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], i
            if best is None:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def finite(self, left: str, right: str) -> bool:
        """Whether the weight between two neighbouring arcs is finite; '' is the start."""
        return self.merged(left + right) == ([left, right] if left else [right])

    def _fallback(self, char: str) -> list[int]:
        if self.byte_fallback:
            return [self.byte_ids[b] for b in char.encode("utf-8")]
        return [self.unknown]

    def shortest_path(self, text: str) -> list[int]:
        """Ids on the tropical shortest path of the composition with ``text`` (normalised)."""
        last = self._finite_path(text) if self.kind == BPE else self._lightest_path(text)
        out: list[list[int]] = []
        at = len(text)
        while at:
            found = self.ids.get(last[at])
            out.append([found] if found is not None else self._fallback(last[at]))
            at -= len(last[at])
        return [i for part in reversed(out) for i in part]

    def _finite_path(self, text: str) -> list[str]:
        """By state (place in the text), the arc on its one path of finite weight (BPE)."""
        last, ids, pairs, longest = [""], self.ids, self._pairs, self.longest
        for end in range(1, len(text) + 1):
            for start in range(end - longest if end > longest else 0, end):
                piece = text[start:end]
                if piece in ids:
                    pair = last[start], piece
                    finite = pairs.get(pair)
                    if finite is None:
                        if len(pairs) > REMEMBERED_PAIRS:
                            pairs.clear()
                        finite = pairs[pair] = self.finite(*pair)
                    if finite:
                        break
            last.append(piece)          # if no arc fits, the character falls back to its bytes
        return last

    def _lightest_path(self, text: str) -> list[str]:
        """By state, the last arc of its lightest path (unigram)."""
        cost, last = [0.0], [""]
        for end in range(1, len(text) + 1):
            best, arc = cost[end - 1] + self.unknown_cost, text[end - 1]
            if arc in self.ids:
                best = np.inf
            for start in range(max(0, end - self.longest), end):
                found = self.ids.get(text[start:end])
                if found is not None and cost[start] - self.score[found] < best:
                    best, arc = cost[start] - self.score[found], text[start:end]
            cost.append(best)
            last.append(arc)
        return last

    def encode_block(self, data: np.ndarray, offsets: np.ndarray, table: PieceTable
                     ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts laid end to end, and the offsets of each text's ids."""
        points, bounds, _ = code_points(data, offsets)
        points = np.where(points == 0x20, np.uint32(ord(SPACE)), points)
        if self.dummy_prefix:
            filled = np.flatnonzero(np.diff(bounds))
            points = np.insert(points, bounds[filled], np.uint32(ord(SPACE)))
            bounds = bounds + np.append(0, np.cumsum(np.diff(bounds) > 0))

        def encode(start: int, end: int) -> list[int]:
            return self.shortest_path(points[start:end].tobytes().decode("utf-32-le"))
        return span_ids(points, bounds, self.cuts(points, bounds), table, encode)

    def decode_block(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id sequences laid end to end; unknown byte sequences become U+FFFD."""
        ends = np.append(0, np.cumsum(self.out_size[ids]))[offsets]
        data = np.concatenate([np.zeros(0, np.uint8), *(
            self.out_bytes[ragged(self.out_start[part], self.out_size[part])]
            for part in (ids[a:a + BLOCK_IDS] for a in range(0, len(ids), BLOCK_IDS)))])
        out = []
        for a, b in zip(ends[:-1], ends[1:]):
            text = data[a:b].tobytes().decode("utf-8", "replace")
            out.append(text[1:] if self.dummy_prefix and text.startswith(" ") else text)
        return out


@lru_cache(maxsize=2)
def load(path: str) -> PieceTransducer:
    return PieceTransducer(path)


@lru_cache(maxsize=2)
def _table(path: str) -> PieceTable:
    return PieceTable(REMEMBERED_PARTS)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ids`` (array<int>) of every whole text, beside the id column.

    Null text is empty and has no ids.  Rows may repeat or lack an id; an empty table gives no
    rows; other columns are not read.  A text is cut where no piece can pass, and each distinct
    part is searched once while a bounded table of the task's worker remembers it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = load(path), _table(path)
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                ids, ends = model.encode_block(data, offsets, table)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[rows], pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))],
                    [id_col, "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {schema_of(docs, id_col)}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``text`` of every id sequence, with ``n_pieces`` and ``ids_crc32`` (little-endian
    unsigned 32-bit ids); null ids are an empty sequence."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            column = batch.column("ids")
            sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)
                               .to_numpy(zero_copy_only=False), np.int64)
            offsets = np.append(0, np.cumsum(sizes))
            flat = column.flatten().to_numpy()
            for rows in row_blocks(offsets, BLOCK_IDS):
                ends = offsets[rows.start:rows.stop + 1]
                ids, ends = flat[ends[0]:ends[-1]].astype("<u4"), ends - ends[0]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[rows], pa.array(model.decode_block(ids, ends), pa.string()),
                     pa.array(sizes[rows]), pa.array(crc, pa.int64())],
                    [id_col, "text", "n_pieces", "ids_crc32"])

    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(
        run, f"`{id_col}` {schema_of(encoded, id_col)}, text string, n_pieces bigint, "
             "ids_crc32 bigint")
