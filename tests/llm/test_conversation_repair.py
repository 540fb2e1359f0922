"""Repairs against every script of edits, and against a search that keeps whole strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from ratelark.llm.conversation_repair import Survivors, repair, report
from ratelark.llm.queries import QUERIES, damage

BLANK = " \t\n\x0b\x0c\r"


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = text.strip(BLANK)
        fault = ("blank" if not body else "duplicate" if (role, text) in seen
                 else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
        out.append(fault)
    return out


def plain_search(initials, found):
    """(cost, audit) of the cheapest edits, over all prefixes with their strings."""
    def role_after(s):
        return "a" if s == "u" else "u"

    def with_inserts(best):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                t = role_after(s)
                best[t] = min(best.get(t, (1e9, "")), (c + 5, a + "I"))
        return best

    best = with_inserts({"": (0, "")})
    for initial, fault in zip(initials, found):
        new = {}

        def offer(s, c, a):
            new[s] = min(new.get(s, (1e9, "")), (c, a))
        for s, (c, a) in best.items():
            offer(s, c + 2, a + "D")
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if (initial == "s" and s == "") or (initial in ("u", "a") and role_after(s) == initial):
                offer(initial, c + more, a + "K")
            offer(role_after(s), c + more + 1, a + "R")
        best = with_inserts(new)
    return min(best[s] for s in ("", "a") if s in best)


def every_script(initials, found):
    """The same from the definition: all edits of all rows, with up to two inserts in each place."""
    best = None
    n = len(initials)
    for edits in itertools.product("KRD", repeat=n):
        if any(f in ("blank", "duplicate") and e != "D" for e, f in zip(edits, found)):
            continue
        for places in itertools.product(range(3), repeat=n + 1):
            audit = "".join("I" * p + e for p, e in zip(places, (*edits, "")))
            cost = sum({"K": 0, "R": 1, "D": 2, "I": 5}[e] for e in audit) + sum(
                5 for e, f in zip(edits, found) if f == "truncated" and e != "D")
            if best is not None and (cost, audit) >= best:
                continue
            choices = []
            for p, e, i in itertools.zip_longest(places, edits, initials):
                choices += ["ua"] * p
                choices += [i] if e == "K" else ["ua"] if e == "R" else []
            if any(re.fullmatch("(s?(ua)+)?", "".join(c)) for c in itertools.product(*choices)
                   if "" not in choices):
                best = (cost, audit)
    return best


KINDS = st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from(
    [None, None, None, "blank", "duplicate", "truncated"])), max_size=40)


def through_survivors(rows):
    survivors, out = Survivors(), []
    for initial, fault in rows:
        out += survivors.step(initial, fault in ("blank", "duplicate"), 5 if fault == "truncated" else 0)
    return "".join(out + survivors.finish())


@settings(max_examples=600, deadline=None)
@given(KINDS)
def test_survivors(rows):
    assert through_survivors(rows) == plain_search(*zip(*rows))[1] if rows else True


def test_plain_search_finds_the_best_of_every_script():
    rnd = random.Random(5)
    for _ in range(60):
        n = rnd.randrange(4)
        rows = [(rnd.choice("suat"), rnd.choice([None, None, "blank", "truncated"])) for _ in range(n)]
        initials, found = zip(*rows) if rows else ((), ())
        assert plain_search(initials, found) == every_script(initials, found)


def test_agreed_edits_leave_the_tree():
    """Once all survivors agree nothing is held, and a stretch they never agree on costs no time."""
    survivors, settled = Survivors(), 0
    for i in range(4000):
        settled += len(survivors.step("ua"[i % 2], False, 0))
        assert sum(len(n.letters) for n in tree(survivors.root)) < 40
    assert settled > 3900
    unresolved = Survivors()
    for _ in range(60_000):
        unresolved.step("u", False, 0)
        assert len(tree(unresolved.root)) <= 8
    assert len(unresolved.finish()) >= 60_000


def tree(node):
    return [node] + [n for b in node.below for n in tree(b)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    """Figures from (conv, turn, role, text, live) rows by the definition."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x)
               for c, t, r, x, live in rows if c == conv and live]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        found = faults(own)
        initials = [r[:1] for _, r, _ in own]
        cost, audit = plain_search(initials, found)
        turns = [t for t, _, _ in own if t is not None]
        lines, state, left = [], "", iter(own)
        for letter in audit:
            if letter == "I":
                state = "a" if state == "u" else "u"
                lines.append({"u": "user", "a": "assistant"}[state] + ":")
                continue
            _, role, text = next(left)
            if letter == "D":
                continue
            state = role[:1] if letter == "K" else ("a" if state == "u" else "u")
            lines.append((role if letter == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + text)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            found.count("blank"), found.count("duplicate"), found.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, sha("\n".join(lines)))
    return out


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in FIGURES) for r in rows}


@pytest.fixture
def table(spark):
    schema = T.StructType([
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("live", T.BooleanType()), T.StructField("id", T.StringType()),
        T.StructField("fault", T.IntegerType()), T.StructField("edit", T.StringType())])
    return lambda rows: spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema)


EDGES = [
    (1, 0, "user", None, True), (1, 1, "assistant", "Yes.", True), (1, 5, "assistant", "Yes.", True),
    (2, None, None, "hm.", True), (2, None, "user", "ok!", True), (2, 3, "user", "ok!", True),
    (2, 3, "user", "ok!", True), (2, 3, "assistant", "é no end", True),
    (None, 0, "system", "Be good. \n\t", True), (None, 1, "tool", "x.", True),
    (3, 0, "user", "gone.", False), (4, 0, "", "", True), (4, 1, "user", "\t \n", True),
    (5, 0, "system", "a.", True), (5, 1, "system", "b.", True), (5, 2, "user", "long " * 60_000 + ".", True),
    (5, 3, "assistant", "same.", True), (5, 3, "assistant", "same.", True),
    (6, -2, "user", "q?", True), (6, 9, "assistant", "a ", True), (6, 9, "assistant", "a! ", True),
] + [(7, i, ("user", "user", "assistant")[i % 3], f"t{i % 50}.", i % 7 != 0) for i in range(500)]


def test_edges(table):
    edits = repair(table(EDGES), live_col="live")
    assert got(report(edits)) == expected(EDGES)
    shuffled = edits.orderBy("text")
    assert got(report(shuffled, ordered=False)) == expected(EDGES)
    assert got(report(repair(table([]), live_col="live"))) == {}


def test_edits_are_real_rows(table):
    rows = repair(table(EDGES), live_col="live").where("conv_id = 2").orderBy("seq").collect()
    kept = [r["role"] for r in rows if r["edit"] != "Delete"]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r in kept))
    assert [r["seq"] for r in rows] == list(range(len(rows)))
    assert sum(r["edit"] != "Insert" for r in rows) == 5


def test_random_conversations(table):
    rnd = random.Random(3)
    rows = [(c, t if rnd.random() < 0.9 else None, rnd.choice(["system", "user", "user", "assistant",
             "assistant", "tool", None]), rnd.choice(["a.", "b", "c!", " ", None, "d?", f"e{t}."]),
             rnd.random() < 0.95) for c in range(150) for t in range(rnd.randrange(12))]
    assert got(report(repair(table(rows), live_col="live"))) == expected(rows)


def test_query(spark, sf, duck):
    raw = duck.execute("select conv_id, turn, role, text from conversations").fetchall()
    rows = []
    for conv, turn, role, text in raw:
        fault = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        row = (conv, turn, "user" if fault == 4 else role, text, fault != 0)
        rows += [row] * (2 if fault == 3 else 1)
    assert got(QUERIES["op11_conversation_repair"](spark, sf)) == expected(rows)


def test_damage_takes_nulls_as_a_space(table):
    rows = damage(table([(None, None, None, None, True)]).select("conv_id", "turn", "role", "text"))
    fault = zlib.crc32(b" : ") % 20
    assert [tuple(r) for r in rows.collect()] == [(None, None, None, " ", True)] and fault > 4
