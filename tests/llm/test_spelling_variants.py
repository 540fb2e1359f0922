"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ratelark.llm import spelling_variants as module
from ratelark.llm.queries import QUERIES
from ratelark.llm.spelling_variants import LetterTree, Words, home, near_pairs, spelling_variants, words_of


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out


def counted(docs, every):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def got(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, counts):
    return spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()],
                                 "word string, n bigint, other string, cell int")


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abcé", min_size=5, max_size=5), min_size=1, max_size=80),
       st.sets(st.text("abcé", min_size=4, max_size=4), min_size=1, max_size=80))
def test_pairs_of_lengths(longer, shorter):
    longer, shorter = sorted(longer), sorted(shorter)
    module.LEAF, leaf = 4, module.LEAF
    try:
        members, guests = Words(longer, 5), Words(shorter, 4)
        same = [(longer[i], longer[j]) for g, m in near_pairs(members, members, True) for i, j in zip(g, m)]
        cross = [(shorter[i], longer[j]) for g, m in near_pairs(members, guests, False)
                 for i, j in zip(g, m)]
    finally:
        module.LEAF = leaf
    assert sorted(same) == [(a, b) for i, a in enumerate(longer) for b in longer[i + 1:] if one_edit(a, b)]
    assert sorted(cross) == sorted((a, b) for a in shorter for b in longer if one_edit(a, b))


def test_tree_prunes_boxes():
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choices("etaoinshrdlu", k=9)) for _ in range(8000)})
    tree = LetterTree(Words(words, 9).counts, 48)
    asked = Words(words[::20], 9).counts
    visited = sum(len(rows) * len(tree.leaves[leaf]) for leaf, rows in tree.reach(asked, 1, 1))
    assert visited < 0.35 * len(asked) * len(words)
    own = home(tree, asked)
    assert all(i * 20 in tree.leaves[leaf] for i, leaf in enumerate(own))


@pytest.mark.parametrize("cell", [8, 4096])
def test_random_words(spark, monkeypatch, cell):
    """Also with many small cells, so that most pairs lie in two of them."""
    monkeypatch.setattr(module, "CELL", cell)
    rnd = random.Random(2)
    counts = {}
    for _ in range(300):
        word = "".join(rnd.choices("abcdeèß", k=rnd.randrange(5, 9)))
        for n in (rnd.choice([2, 30, 400, 5000]), 2, 3):
            counts[word] = n
            at = rnd.randrange(len(word))
            word = rnd.choice([word[:at] + word[at + 1:], word[:at] + "a" + word[at:],
                               word[:at] + "é" + word[at + 1:]])
    assert got(spelling_variants(frame(spark, counts))) == variants(counts)


def test_chains_and_ties(spark):
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20000,
              "zzzzzzz": 20, "zzzzzza": 2, "azzzzzz": 2, "bzzzzzz": 20, "×÷×÷×÷×": 3, "×÷×÷×÷": 30,
              "ÀÀÀÀÀÀÀ": 2, "àÀÀÀÀÀÀ": 20, "a" * 3000: 2, "a" * 3001: 20, "listenx": 5, "silentx": 50}
    assert got(spelling_variants(frame(spark, counts))) == variants(counts)
    assert got(spelling_variants(frame(spark, {}))) == {}


def test_words_of_texts(spark, docs, monkeypatch):
    monkeypatch.setattr(module, "PIECE", 64)
    monkeypatch.setattr(module, "GATHERED", 50)
    rnd = random.Random(4)
    texts = [(i, " ".join(rnd.choices(["Straßenbahn", "ÉTUDIANTE", "étudiante", "kurz", "naïveté-naïveté",
                                       "longword" * 30, "x" * 9, "über_über", "İstanbulİ"], k=40)))
             for i in range(60)]
    texts += [(None, "Straßenbahn Straßenbahn"), (7, None), (7, ""), (8, "abcdefgh" * 1000),
              (9, "abcdefgh" * 1000), (9, "\U0001d4d0bcdefgh bcdefgh")]
    for every in (0, 31, 2):
        found = words_of(docs(texts), typos_every=every)
        assert {r["word"]: r["n"] for r in found.where("length(word) >= 7").collect()} == counted(texts, every)
    assert words_of(docs([])).collect() == []


def test_query(spark, sf, texts):
    assert got(QUERIES["op12_spelling_variants"](spark, sf)) == variants(counted(texts, 31))


def test_bits_bound_the_distance():
    words = Words(["aaaaaaaaé", "aaaaaaaéé", "bbbbbbbbb"], 9)
    apart = np.bitwise_count(words.bits[:, None] ^ words.bits[None]).sum(2)
    exact = np.abs(words.counts[:, None] - words.counts[None]).sum(2)
    assert (apart <= exact).all() and apart[0, 1] <= 2 and apart[0, 2] >= 4
