import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import ratelark.llm.suffix_dedup as module
from ratelark.llm.suffix_dedup import Suffixes, sample_suffixes, suffix_dedup


def brute(pairs, length):
    """Rows expected, by a table of all windows."""
    starts = Counter()
    data = [(t or "").encode() for _, t in pairs]
    for d in data:
        for s in range(len(d) - length + 1):
            starts[hash(d[s:s + length])] += 1
    out = []
    for (i, _), d in zip(pairs, data):
        gone = bytearray(len(d) + 1)
        for s in range(len(d) - length + 1):
            if starts[hash(d[s:s + length])] > 1:
                gone[s:s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for x in range(len(d)) if gone[x] and not (x and gone[x - 1]))
        out.append((i, len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs, pairs, length=200):
    df = suffix_dedup(docs(pairs), length)
    rows = df.collect()
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in rows)
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
                   for r in rows), key=str)


def test_whole_table(docs, texts):
    assert run(docs, texts) == brute(texts, 200)


def made(seed, n, alphabet="abcdé "):
    """Texts put together from shared phrases, so that matches begin and end everywhere."""
    rng = random.Random(seed)

    def noise(size):
        return "".join(rng.choice(alphabet) for _ in range(size))
    phrases = [noise(rng.randint(20, 150)) for _ in range(12)]
    out = []
    for i in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.6 else noise(rng.randint(1, 60))
                 for _ in range(rng.randint(0, 8))]
        out.append((i, "".join(parts)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_shared_phrases(docs, monkeypatch, seed):
    """Short windows, few suffixes to a task, so that ranges are cut and sorted again."""
    monkeypatch.setattr(module, "SORTED", 40)
    pairs = made(seed, 40)
    assert run(docs, pairs, 64) == brute(pairs, 64)


def test_windows_that_neighbours_leave_open(docs):
    """The longest matches to the left and to the right are with different documents."""
    rng = random.Random(5)

    def noise(n):
        return "".join(rng.choice("qrstuvw") for _ in range(n))
    core, left, right = noise(50), noise(30), noise(30)
    a = left + core + right
    pairs = [(1, noise(9) + a + noise(9)), (2, noise(9) + left + core + noise(40)),
             (3, noise(40) + core + right + noise(9)),
             (4, noise(5) + left[-8:] + core + right[:8] + noise(5)),
             (5, noise(7) + left[-20:] + core + noise(30))]
    assert run(docs, pairs, 64) == brute(pairs, 64)


def test_edges(docs):
    long = "".join(random.Random(9).choice("abcdefgh ") for _ in range(60_000))
    pairs = [(1, None), (2, ""), (3, "x" * 199), (4, "y" * 200), (5, "z" * 201), (6, "0" * 5000),
             (7, "é" * 150), (8, "ab" * 300), (9, long), (10, "start " + long[500:3000]),
             (11, "same text, repeated as a row. " * 3), (11, "same text, repeated as a row. " * 3),
             (12, "unlike rows " + long[:250]), (12, "with one id"), (None, long[40_000:40_400]),
             (None, None), (13, "q" * 199), (14, "\x00" * 300)]
    assert run(docs, pairs) == brute(pairs, 200)
    assert run(docs, []) == []


def test_text_output_has_no_broken_characters(docs):
    shared = "é" * 40
    rows = suffix_dedup(docs([(1, "aéx" + shared), (2, "b¨" + shared)]), 64, as_text=True).collect()
    assert {r["doc_id"]: r["kept"] for r in rows} == {1: "aéx", 2: "b¨"}


@pytest.mark.parametrize("width", [12, 40])
def test_sort(width):
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 99, (500, width)).astype(np.uint8)
    rows[100:300, :width - 3] = rows[0, :width - 3]
    found = Suffixes(rows)
    order = found.sort()
    assert [bytes(r) for r in rows[order]] == sorted(bytes(r) for r in rows)
    a, b = order[:-1], order[1:]
    for x, y, n in zip(a, b, found.common(a, b)):
        assert (rows[x][:16 * n] == rows[y][:16 * n]).all()
        assert n == found.blocks or (rows[x][16 * n:16 * n + 16] != rows[y][16 * n:16 * n + 16]).any()


def test_wrong_hashes_do_not_change_the_order():
    rows = np.random.default_rng(3).integers(97, 100, (200, 40)).astype(np.uint8)
    found = Suffixes(rows)
    found.prefix[:, 2:] = 7                            # as if all these prefixes collided
    assert [bytes(r) for r in rows[found.sort()]] == sorted(bytes(r) for r in rows)


def test_equal_windows_sample_equal_places():
    text = bytes(random.Random(2).choice(b"abcdef") for _ in range(600))
    other = b"zz" + text[100:400] + b"yy"
    data = np.frombuffer(text + other, np.uint8)
    row, place, backs, gram, _ = sample_suffixes(data, np.array([0, 600, 904]), 200)
    at = place >> 32
    one = {(p, g) for r, p, g in zip(row, at, gram) if r == 0 and 168 + 100 <= p <= 400 - 200}
    two = {(p + 98, g) for r, p, g in zip(row, at, gram) if r == 1}
    assert one <= two
    # every window belongs to one place, and no place has windows out of its reach
    near, far = backs >> 16, backs & 0xFFFF
    assert (near <= far).all() and (far <= 168).all()
    starts = sorted((r, p - b) for r, p, n, f in zip(row, at, near, far) for b in range(n, f + 1))
    assert starts == [(0, s) for s in range(401)] + [(1, s) for s in range(105)]
