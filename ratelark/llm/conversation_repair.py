"""Repair of the turn structure of conversations by a Viterbi search over edits.

A repaired conversation is empty or an optional system turn followed by pairs of a user and an
assistant turn.  What remains is found row by row: for every state of that grammar the cheapest
edits so far survive (of equally cheap ones those whose initials come first in ASCII order).  The
survivors form a tree of back pointers with reference counts; edits that all survivors share are
settled and leave the tree at once.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_of, slices

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: A state is of no more use once another one costs less by so much: from there its whole future
#: can be had by deleting a system turn, or inserting an assistant turn, at this price.
HOPELESS = ((START, ASSISTANT, DELETE), (START, USER, INSERT + DELETE),
            (SYSTEM, ASSISTANT, 0), (SYSTEM, USER, INSERT))
#: What a turn with this initial leads to, and from which states it may come.
KEEP = {"s": (SYSTEM, (START,)), "u": (USER, (START, SYSTEM, ASSISTANT)), "a": (ASSISTANT, (USER,))}
INITIALS = {"Keep": "K", "Rerole": "R", "Delete": "D", "Insert": "I"}
NAMES = {v: k for k, v in INITIALS.items()}
#: Rows and characters of text that a batch of edits holds at most (or one longer row).
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 19


def after(state: int) -> int:
    """The state that a rewritten or inserted turn leads to: the grammar leaves no choice."""
    return ASSISTANT if state == USER else USER


class _Node:
    """A stretch of edits on the way from the root to some survivors."""

    __slots__ = ("parent", "letters", "below", "refs")

    def __init__(self, parent: _Node | None, letters: list[str]):
        self.parent, self.letters = parent, letters
        self.below: list[_Node] = []
        self.refs = 0                      # nodes below, and survivors that end here

    def grow(self, letter: str) -> _Node:
        node = _Node(self, [letter])
        self.below.append(node)
        self.refs += 1
        return node


class Survivors:
    """The cheapest edits per state as one tree.

    A state and an edit's initial determine the next state, so edits of one node differ in their
    first initials, and two paths compare as the initials where they part: the complete
    unresolved suffixes are compared without being walked.  A node with a single reference joins
    the one below it; each letter moves at most as often as there are states.
    """

    def __init__(self) -> None:
        self.root = _Node(None, [])
        self.root.refs = 1
        self.at = {START: (0, self.root)}
        self._inserts()

    def step(self, initial: str, must_go: bool, extra: int) -> list[str]:
        """Take one more row; returns the initials of the edits that are now settled.

        ``must_go``: the row can only be deleted; ``extra``: what it costs to leave it in.
        """
        best: dict[int, tuple[int, _Node, str]] = {}

        def offer(state: int, cost: int, node: _Node, letter: str) -> None:
            have = best.get(state)
            if have is None or cost < have[0] or (
                    cost == have[0] and _before(node, letter, have[1], have[2])):
                best[state] = (cost, node, letter)

        target, sources = KEEP.get(initial, (None, ()))
        for state, (cost, node) in self.at.items():
            offer(state, cost + DELETE, node, "D")
            if not must_go:
                if state in sources:
                    offer(target, cost + extra, node, "K")
                offer(after(state), cost + extra + REROLE, node, "R")
        old = [node for _, node in self.at.values()]
        self.at = {}
        for state, (cost, node, letter) in best.items():
            leaf = node.grow(letter)
            leaf.refs = 1
            self.at[state] = (cost, leaf)
        for node in old:
            self._release(node)
        self._inserts()
        for state, other, price in HOPELESS:
            if state in self.at and other in self.at and self.at[other][0] + price < self.at[state][0]:
                self._release(self.at.pop(state)[1])
        return self._settled()

    def finish(self) -> list[str]:
        """The initials of all edits not yet settled, of the best path that the grammar accepts."""
        chosen = None
        for state in ACCEPTED:
            if state in self.at:
                cost, node = self.at[state]
                if chosen is None or cost < chosen[0] or (
                        cost == chosen[0] and _before(node, "", chosen[1], "")):
                    chosen = (cost, node)
        parts, node = [], chosen[1]
        while node is not None:
            parts.append(node.letters)
            node = node.parent
        return [letter for part in reversed(parts) for letter in part]

    def _inserts(self) -> None:
        """Replace survivors by another state's with an inserted turn where that is better."""
        for target, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            have = self.at.get(target)
            cost, node, letter = (have[0], have[1], "") if have else (None, None, "")
            for state in sources:
                if state in self.at:
                    c, n = self.at[state]
                    c += INSERT
                    if cost is None or c < cost or (c == cost and _before(n, "I", node, letter)):
                        cost, node, letter = c, n, "I"
            if letter:
                leaf = node.grow("I")
                leaf.refs = 1
                self.at[target] = (cost, leaf)
                if have:
                    self._release(have[1])

    def _release(self, node: _Node) -> None:
        node.refs -= 1
        while node.refs == 0:
            parent = node.parent
            parent.below.remove(node)
            parent.refs -= 1
            node = parent
        if node.refs == 1 and len(node.below) == 1:
            child = node.below[0]
            node.letters.extend(child.letters)
            child.letters, child.parent = node.letters, node.parent
            if node.parent is None:
                self.root = child
            else:
                node.parent.below[node.parent.below.index(node)] = child

    def _settled(self) -> list[str]:
        settled, self.root.letters = self.root.letters, []
        return settled


def _before(a: _Node, x: str, b: _Node, y: str) -> bool:
    """Whether the path to ``a`` and then ``x`` comes before the path to ``b`` and then ``y``."""
    following = {}
    node, letter = a, x
    while node is not None:
        following[id(node)] = letter
        letter = node.letters[0] if node.letters else ""
        node = node.parent
    node, letter = b, y
    while id(node) not in following:
        letter = node.letters[0]
        node = node.parent
    return following[id(node)] < letter


class _Conversation:
    """One conversation on its way through the search; yields its edits as rows."""

    def __init__(self, conv: object):
        self.conv, self.survivors = conv, Survivors()
        self.rows: deque[tuple] = deque()            # rows whose edit is not settled yet
        self.state, self.seq, self.last = START, 0, None

    def add(self, turn: object, role: str, text: str, fault: str | None, later: bool
            ) -> Iterator[tuple]:
        if fault != "blank" and (later or self.last == (turn, role, text)):
            fault = "duplicate"
        self.last = (turn, role, text)
        self.rows.append((turn, role, text, fault))
        yield from self._rows(self.survivors.step(
            role[:1], fault in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0))

    def end(self) -> Iterator[tuple]:
        if self.last is None:
            yield (self.conv, None, None, None, None, None, None, None)
        else:
            yield from self._rows(self.survivors.finish())

    def _rows(self, letters: list[str]) -> Iterator[tuple]:
        for letter in letters:
            turn, role, text, fault = (None, None, "", None) if letter == "I" else self.rows.popleft()
            new = role
            if letter in "RI":
                self.state = after(self.state)
                new = ROLES[self.state]
            elif letter == "K":
                self.state = KEEP[role[:1]][0]
            yield (self.conv, self.seq, NAMES[letter], turn, role, new, text, fault)
            self.seq += 1


_FIELDS = ("seq", "edit", "turn", "old_role", "role", "text", "fault")


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text", live_col: str | None = None
           ) -> DataFrame:
    """The cheapest edits that repair every conversation, one row per edit: the id column, ``seq``
    (from 0), ``edit`` (Keep, Rerole, Delete or Insert), ``turn`` and ``old_role`` of the row
    (null for an insert), ``role`` and ``text`` after the edit (a deleted row's own) and ``fault``
    (blank, duplicate, truncated or null).  The repaired conversation is the rows by ``seq``
    whose edit is not Delete.

    Rows go by turn (null first), then role and text.  A null role or text is one space; so a
    null text is blank, and a null role can only be rewritten or deleted.  Rows without an id form
    one conversation.  Rows whose ``live_col`` is not true only name their conversation; one
    without other rows gives a single row of nulls.  An empty table gives none; other columns are
    not read.

    Whether role and text occurred before is found by an aggregate of digests.  One shuffle by
    conversation then orders the rows, and each conversation streams through one task, which
    holds its unsettled rows only.  Partitions of the result hold whole conversations in order.
    """
    rows = conversations.select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        F.coalesce(F.col(live_col), F.lit(False)).alias("live") if live_col
        else F.lit(True).alias("live"))
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.withColumn("digest", F.when(F.col("live"), digest)).withColumn("place", place)
    repeated = (rows.where("live").groupBy(F.col("id").alias("of"), F.col("digest").alias("same"))
                .agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    marked = rows.join(
        repeated, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left"
    ).select("id", "turn", "role", "text", "live",
             F.when(blank, "blank").when(~ended, "truncated").alias("fault"),
             F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("later"))
    ordered = marked.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    turn_type = schema_of(conversations, turn_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        out: list[tuple] = []
        size, current = 0, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], [id_col, *_FIELDS])

        def edits() -> Iterator[tuple]:
            nonlocal types, current
            for batch in slices(batches):
                fields = batch.schema
                types = [fields.field("id").type, pa.int64(), pa.string(), fields.field("turn").type,
                         *[pa.string()] * 4]
                for conv, turn, role, text, live, fault, later in zip(
                        *(c.to_pylist() for c in batch.columns)):
                    if current is None or current.conv != conv:
                        if current is not None:
                            yield from current.end()
                        current = _Conversation(conv)
                    if live:
                        yield from current.add(turn, role, text, fault, later)
            if current is not None:
                yield from current.end()

        for row in edits():
            out.append(row)
            size += len(row[6] or "")
            if len(out) >= BATCH_ROWS or size >= BATCH_CHARS:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    return ordered.mapInArrow(
        run, f"`{id_col}` {schema_of(conversations, id_col)}, seq bigint, edit string, "
             f"turn {turn_type}, old_role string, role string, text string, fault string")


class _Report:
    """Running figures of one conversation."""

    def __init__(self, conv: object):
        self.conv = conv
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.cost = self.distinct = 0
        self.low = self.high = self.before = None
        self.audit: list[str] = []
        self.digest, self.kept = hashlib.sha256(), 0

    def add(self, edit: str, turn: int | None, old_role: str | None, role: str, text: str,
            fault: str | None) -> None:
        self.audit.append(INITIALS[edit])
        self.cost += {"Keep": 0, "Rerole": REROLE, "Delete": DELETE, "Insert": INSERT}[edit]
        if edit != "Delete":
            self.cost += TRUNCATED if fault == "truncated" else 0
            self.digest.update((("\n" if self.kept else "") + f"{role}:{text}").encode())
            self.kept += 1
        if edit == "Insert":
            return
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + old_role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = old_role[:1]
        if turn is not None:
            self.distinct += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost,
                "".join(self.audit), self.digest.hexdigest())


_FIGURES = (("gaps", "bigint"), ("blank", "bigint"), ("duplicate", "bigint"),
            ("truncated", "bigint"), ("illegal", "bigint"), ("cost", "bigint"),
            ("audit", "string"), ("repaired_sha256", "string"))


def report(edits: DataFrame, id_col: str = "conv_id", ordered: bool = True) -> DataFrame:
    """One row per conversation of ``edits``: ``gaps`` (turn numbers missing between the least and
    the greatest), the numbers of rows that are ``blank``, ``duplicate`` or ``truncated``,
    ``illegal`` (neighbouring rows whose roles do not follow each other), ``cost``, ``audit`` (the
    edits' initials in order) and ``repaired_sha256`` (of the lines ``role:text``).

    ``ordered``: the frame comes straight from :func:`repair`; a stored one is sorted first.
    """
    if not ordered:
        edits = edits.repartition(id_col).sortWithinPartitions(id_col, "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            done = []
            columns = (c.to_pylist() for c in batch.columns)
            for conv, edit, turn, old_role, role, text, fault in zip(*columns):
                if current is None or current.conv != conv:
                    if current is not None:
                        done.append(current.row())
                    current = _Report(conv)
                if edit is not None:
                    current.add(edit, turn, old_role, role, text, fault)
            if done:
                yield _reported(done, batch.schema.field("id").type, id_col)
            kind = batch.schema.field("id").type
        if current is not None:
            yield _reported([current.row()], kind, id_col)

    read = edits.select(F.col(id_col).alias("id"), *(c for c in _FIELDS if c != "seq"))
    return read.mapInArrow(run, f"`{id_col}` {schema_of(edits, id_col)}, "
                           + ", ".join(f"{n} {t}" for n, t in _FIGURES))


def _reported(rows: list[tuple], kind: pa.DataType, id_col: str) -> pa.RecordBatch:
    types = [kind, *(pa.int64() if t == "bigint" else pa.string() for _, t in _FIGURES)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      [id_col, *(n for n, _ in _FIGURES)])
