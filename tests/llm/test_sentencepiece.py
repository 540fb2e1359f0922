import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ratelark.llm.common import text_blocks
from ratelark.llm.queries import PIECES
from ratelark.llm.sentencepiece_wfst import PieceTable, decode, encode, load

ODD = ["", "  hello  world\n\tx ", "日本 é 😀", "a▁b", "<s> </s> <unk>", " ", "      x", "\x00",
       "Release " * 5000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abstrevinThgo  \n\t1é²½.,!日▁😀"), max_size=40), max_size=20))
def test_any_text(texts):
    import pyarrow as pa
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model, table, got, back = load(PIECES), PieceTable(), [], []
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for _, data, offsets in text_blocks(batch, "text"):
        ids, ends = model.encode_block(data, offsets, table)
        got += [list(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        back += model.decode_block(ids, ends)
    want = [library.encode(t) for t in texts]
    assert got == want
    assert back == [library.decode(w) for w in want]


def test_table(docs, texts, library):
    pairs = texts + [(10**6 + i, t) for i, t in enumerate(ODD)] + [(None, None), (5, "a"), (5, "a")]
    rows = decode(encode(docs(pairs), PIECES), PIECES).collect()
    got = Counter((r["doc_id"], r["text"], r["n_pieces"], r["ids_crc32"]) for r in rows)
    want = Counter()
    for i, t in pairs:
        ids = library.encode(t or "")
        want[(i, (t or "").replace("▁", " "), len(ids),
              zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert got == want
    assert decode(encode(docs([]), PIECES), PIECES).collect() == []


def test_table_of_pieces_starts_anew_when_full():
    model, small = load(PIECES), PieceTable(limit=3)
    data = np.frombuffer(b"one two three four five six seven", np.uint8)
    for _ in range(2):
        ids, _ = model.encode_block(data, np.array([0, len(data)]), small)
        whole, _ = model.encode_block(data, np.array([0, len(data)]), PieceTable())
        assert list(ids) == list(whole)


def test_unigram_model_takes_the_lightest_path(tmp_path):
    """A unigram model, written by hand: the sum of scores decides, not the first fit."""
    import struct

    def piece(text, score, kind=1):
        raw = text.encode()
        body = b"\x0a" + bytes([len(raw)]) + raw + b"\x15" + struct.pack("<f", score) + bytes(
            [0x18, kind])
        return b"\x0a" + bytes([len(body)]) + body
    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0), ("b", -2.0), ("▁", -3.0), ("ab", -1.5), ("a", -4.0)]
    model = b"".join(piece(*p) for p in pieces)
    model += b"\x12\x02\x18\x01" + b"\x1a\x04\x18\x01\x20\x00"
    path = tmp_path / "unigram.model"
    path.write_bytes(model)
    loaded = load(str(path))
    assert loaded.shortest_path("▁ab") == [1, 2]          # -3 beats ▁ + ab at -4.5
    assert loaded.shortest_path("ab") == [4]
    assert loaded.shortest_path("az") == [5, 0]


def test_decoding_goes_block_by_block(library, monkeypatch):
    """Rows longer than a block of ids, shorter ones, and several blocks in one row."""
    from ratelark.llm import sentencepiece_wfst
    monkeypatch.setattr(sentencepiece_wfst, "BLOCK_IDS", 3)
    model = load(PIECES)
    texts = ["Release 日本 é 😀 of the day", "", "a", "b", "one two three four five six"]
    ids = [library.encode(t) for t in texts]
    offsets = np.append(0, np.cumsum([len(i) for i in ids]))
    flat = np.array([x for i in ids for x in i], np.uint32)
    assert model.decode_block(flat, offsets) == texts
    assert list(sentencepiece_wfst.row_blocks(np.array([0, 2, 2, 3, 9, 10]), 3)) == [
        slice(0, 3), slice(3, 4), slice(4, 5)]
