import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ratelark.llm.language_id import (BLANK, ORDER, Identifier, KneserNey, fit, grams_of, identify,
                                      learned_from)
from ratelark.llm.queries import QUERIES


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))


def plain_grams(text):
    letters = "".join(c.lower() if c.isalpha() else " " for c in text)
    padded = "   " + " ".join(letters.split()) + (" " if letters.split() else "")
    if text and not letters[0].isalpha():
        pass
    return [padded[i:i + ORDER] for i in range(len(padded) - ORDER + 1)]


def test_grams():
    texts = ["Ab, c!", "", "ÉÈ x", "a"]
    found = grams_of(*block(texts))
    for i, text in enumerate(texts):
        own = found.inverse[found.offsets[i]:found.offsets[i + 1]]
        got = ["".join(map(chr, found.grams[g])) for g in own]
        assert got == plain_grams(text)
    assert list(found.n_letters) == [3, 0, 3, 1]


def slow_model(counts, n_chars):
    """Interpolated Kneser-Ney by its definition."""
    tables = {ORDER: counts}
    for size in range(ORDER - 1, 0, -1):
        tables[size] = Counter(g[1:] for g in tables[size + 1])

    def p(gram):
        size = len(gram)
        if size == 0:
            return 1.0 / n_chars
        table = tables[size]
        values = Counter(table.values())
        d = values[1] / (values[1] + 2 * values[2]) if values[1] and values[2] else 0.5
        total = sum(n for g, n in table.items() if g[:-1] == gram[:-1])
        if not total:
            return p(gram[1:])
        kinds = sum(1 for g in table if g[:-1] == gram[:-1])
        return max(table[gram] - d, 0) / total + d * kinds / total * p(gram[1:])
    return p


def test_model_follows_its_definition():
    texts = ["the cat sat on the mat", "the rat sat", "a cat ate that hat"]
    counts = Counter(g for t in texts for g in plain_grams(t))
    rows = np.array([[ord(c) for c in g] for g in counts], np.uint32)
    model = KneserNey(rows, np.array(list(counts.values())), 30)
    slow = slow_model(counts, 30)
    for gram in [*counts, "zcat", "cath", "zzzz", "  qt", "hatz", "atat"]:
        got = model.log_probability(np.array([[ord(c) for c in gram]], np.uint32))[0]
        assert math.isclose(got, math.log(slow(gram)), rel_tol=1e-9), gram


def test_probabilities_sum_to_one():
    counts = Counter(g for t in ["abcab cabba", "bac abc"] for g in plain_grams(t))
    rows = np.array([[ord(c) for c in g] for g in counts], np.uint32)
    chars = sorted({c for g in counts for c in g})
    model = KneserNey(rows, np.array(list(counts.values())), len(chars))
    for context in ("  a", "abc", "zzz"):
        grams = np.array([[*map(ord, context), ord(c)] for c in chars], np.uint32)
        assert math.isclose(np.exp(model.log_probability(grams)).sum(), 1.0, rel_tol=1e-9)


def test_held_out_accuracy(spark, sf, duck):
    rows = QUERIES["op5_language_id"](spark, sf).collect()
    labels = dict(duck.execute("select doc_id, lang from documents").fetchall())
    assert sorted(r["doc_id"] for r in rows) == sorted(labels)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in {*labels.values(), "und"}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert sum(r["rejected"] for r in rows) <= 0.02 * len(rows)


@pytest.fixture(scope="module")
def fitted(spark, sf):
    return fit(spark.read.parquet(f"{sf}/documents.parquet").where(learned_from()))


def test_edges(docs, fitted, texts):
    some = dict(texts)[1]
    pairs = [(1, None), (2, ""), (3, "123 !?"), (None, some), (5, some), (5, some),
             (6, "日本語の文章がここにあります" * 20), (7, some * 300)]
    got = {}
    for r in identify(docs(pairs), fitted).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i in (1, 2, 3):
        assert (got[i][0]["lang_pred"], got[i][0]["score"], got[i][0]["rejected"]) == ("und", 0, True)
    assert got[None][0]["lang_pred"] == got[5][0]["lang_pred"] == got[7][0]["lang_pred"]
    assert len(got[5]) == 2 and not got[5][0]["rejected"]
    assert got[6][0]["rejected"]
    assert identify(docs([]), fitted).collect() == []


def test_nothing_to_learn_from(spark, docs):
    labelled = docs([(1, None), (None, "a")]).selectExpr("doc_id", "text", "'en' as lang")
    nothing = fit(labelled)
    rows = identify(docs([(1, "some text")]), nothing).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)]
