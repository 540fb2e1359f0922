import random
import re

import ratelark.llm.ngram_join as module
from ratelark.llm.ngram_join import ngram_join


def brute(pairs, words, num, den):
    """(id, shingles, component, links) of every row with an id, by comparing all pairs."""
    sets = {}
    for i, t in pairs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = ({tuple(w[j:j + words]) for j in range(len(w) - words + 1)}
                   if len(w) >= words else {tuple(w)} if w else set())
    ids = sorted(i for i in sets if i is not None)
    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    root, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in ids:
        near = {j for s in sets[i] for j in holders[s] if j > i}
        for j in near:
            both = len(sets[i] & sets[j])
            if den * both >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i), links[i]) for i in ids)


def run(docs, pairs, *args):
    rows = ngram_join(docs(pairs), *args).select("doc_id", "n_shingles", "component_id", "n_links")
    return sorted(tuple(r) for r in rows.collect())


def test_whole_table(docs, texts):
    for args in ((4, 85, 100), (5, 80, 100)):
        assert run(docs, texts, *args) == brute(texts, *args)


def test_small_groups_and_blocks(docs, texts, monkeypatch):
    """Groups cut into many parts, queries into many blocks, no token known as frequent."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    pairs = list(texts[:60])
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        pairs.append((10_000 + i, " ".join(words)))
    want = brute(pairs, 4, 85, 100)
    assert len({c for _, _, c, _ in want}) < len(want)
    assert run(docs, pairs, 4, 85, 100) == want
    monkeypatch.setattr(module, "GROUP", 3)
    monkeypatch.setattr(module, "QUERIES", 2)
    monkeypatch.setattr(module, "FREQUENT", 0)
    assert run(docs, pairs, 4, 85, 100) == want


def test_edges(docs):
    long = " ".join(f"t{i}" for i in range(30_000))
    pairs = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two\n"), (6, "one"),
             (7, "a b c d"), (8, "A B C D"), (9, "é x y z"), (10, "É x y z"), (11, long),
             (12, long + " end"), (13, "a b c d e"), (20, "a b c d a b c d a b c d")]
    assert run(docs, pairs, 4, 85, 100) == brute(pairs, 4, 85, 100)
    rows = ngram_join(docs([(None, "a b c d"), (1, "a b c d"), (2, "a b c d"), (2, "a b c d")]), 4)
    got = sorted(((r["doc_id"], r["component_id"]) for r in rows.collect()), key=str)
    assert got == [(1, 1), (2, 1), (2, 1), (None, None)]
    assert run(docs, [], 4, 85, 100) == []
