import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ratelark.llm.packing import cut, dominant_sets, encode_documents, pack, plan
from ratelark.llm.queries import BYTE_BPE
from ratelark.llm.token_counts import count_tokens

ODD = ["", "it's we'll  I've\n\n's 'tis x''s a!'s  \n don't 'S 'll 'l 're12 ½ ² ١٢ 日本 é \u0085x",
       "  a", "a  ", "\n\n\n", "'s's's", " 's", "<|endoftext|>a<|endoftext|>", "😀😀 ab1c", "a'",
       "  　x", "\x1c\x1d x\x00y", "Ᲊa 1ᲊ", "word " * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def arrow(texts):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abst'rvelmd  \n\t1é²½.,!日 \u0085"), max_size=30), max_size=20))
def test_ids_of_any_text(texts):
    library = Tokenizer.from_file(BYTE_BPE)
    assert [list(x) for x in encode_documents(arrow(texts), "text", BYTE_BPE)] == [
        ids(library, t) for t in texts]


def test_ids_of_odd_texts(library):
    assert [list(x) for x in encode_documents(arrow(ODD), "text", BYTE_BPE)] == [
        ids(library, t) for t in ODD]


def test_counts(docs, texts, library):
    pairs = texts + [(10**6 + i, t) for i, t in enumerate(ODD)] + [(None, None), (5, "a b"), (5, "a b")]
    for common in (1 << 20, 50):      # nearly all looked up, nearly all joined
        rows = count_tokens(docs(pairs), BYTE_BPE, common=common).collect()
        got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows)
        want = Counter()
        for i, t in pairs:
            n = len(ids(library, t))
            want[(i, len((t or "").encode()), n, n > 512)] += 1
        assert got == want


def test_counts_of_nothing(docs):
    assert count_tokens(docs([]), BYTE_BPE).collect() == []


def check_packing(rows, pairs, library, capacity):
    want = Counter()
    for i, t in pairs:
        data = np.array(ids(library, t) + [0], "<u4")
        for number, (start, length) in enumerate(cut(len(data), capacity)):
            want[(i, number, start, length, zlib.crc32(data[start:start + length].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
                   for r in rows) == want
    placed = defaultdict(list)
    for r in rows:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed), -(-sum(r["length"] for r in rows) // capacity)


def test_packing(docs, texts, library):
    pairs = texts + [(10**6 + i, t) for i, t in enumerate(ODD)] + [(None, None), (5, "a b"), (5, "a b")]
    used, least = check_packing(pack(docs(pairs), BYTE_BPE).collect(), pairs, library, 2048)
    assert used <= least + 1
    assert pack(docs([]), BYTE_BPE).collect() == []


def test_cut():
    assert cut(1, 4) == [(0, 1)]
    assert cut(4, 4) == [(0, 4)]
    assert cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def best(sizes, capacity):
    """The least number of sequences, by trying."""
    sizes = sorted(sizes, reverse=True)
    found = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= found[0]:
            return
        if i == len(sizes):
            found[0] = len(rooms)
            return
        for j in sorted(set(rooms)):
            if j >= sizes[i]:
                rest = list(rooms)
                rest.remove(j)
                go(i + 1, rest + [j - sizes[i]])
        go(i + 1, rooms + [capacity - sizes[i]])
    go(0, [])
    return found[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_the_optimum(sizes):
    """What the reduction fixes, plus the best packing of the rest, is a best packing."""
    count = dict(Counter(sizes))
    fixed = dominant_sets(count, 20)
    rest = [s for s, n in count.items() for _ in range(n)]
    taken = [s for items, n in fixed for _ in range(n) for s in items]
    assert sorted(rest + taken) == sorted(sizes)
    assert all(sum(items) <= 20 for items, _ in fixed)
    assert sum(n for _, n in fixed) + best(rest, 20) == best(sizes, 20)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 300), max_size=20))
def test_plan_places_everything_once(count):
    rows = plan(dict(count), 50)
    placed = defaultdict(list)
    for size, n in count.items():
        own = rows[rows[:, 0] == size]
        for rank in range(n):
            _, first, sequence, per, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            past = rank - first
            placed[sequence + past // per].append((offset + past % per * size, size))
    for spans in placed.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= 50
