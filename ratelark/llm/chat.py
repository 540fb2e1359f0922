"""Chat formatting with a template that is only called, never looked into."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_of

Turn = tuple[str, str]
#: A text that no template holds, to find where a turn's text stands.
PROBE = "\ue000"


@dataclass(frozen=True)
class Template:
    """``render`` turns (role, text) into one string; ``escape`` is what it does to a text,
    ``unescape`` undoes it, ``parse`` reads the turns back."""

    render: Callable[[Sequence[Turn]], str]
    unescape: Callable[[str], str]
    parse: Callable[[str], list[Turn]]


def _escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def _unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def _render_marked(turns: Sequence[Turn]) -> str:
    return "".join("<|im_start|>" + _escape(role).replace("\n", "\\n") + "\n" + _escape(text)
                   + "<|im_end|>\n" for role, text in turns)


def _parse_marked(formatted: str) -> list[Turn]:
    out = []
    for part in formatted.split("<|im_start|>")[1:]:
        role, _, rest = part.partition("\n")
        out.append((_unescape(role), _unescape(rest[:rest.rindex("<|im_end|>")])))
    return out


#: Turns between ``<|im_start|>`` and ``<|im_end|>``.  A backslash doubles and ``<|`` becomes
#: ``<\|`` inside texts and roles, so no text can hold a marker, and both can be undone.
MARKED = Template(_render_marked, _unescape, _parse_marked)


@dataclass(frozen=True)
class Rendered:
    """``spans``: where each turn's text stands in ``formatted``; None if the template changes
    earlier output when a turn is added, so that no turn has a place of its own."""

    formatted: str
    spans: list[tuple[int, int]] | None


def render_incrementally(turns: Sequence[Turn], template: Template) -> Rendered:
    """Render growing prefixes of a conversation and compare each output with the one before.

    A turn's span is what its prefix adds.  The same prefix with a probe in place of the last
    text shows how long the part before the text is, and with the empty text how long both
    parts around it are.
    """
    before, spans = template.render([]), []
    for i, (role, text) in enumerate(turns):
        now = template.render(turns[:i + 1])
        probed = template.render([*turns[:i], (role, PROBE)])
        bare = template.render([*turns[:i], (role, "")])
        lead = probed.find(PROBE, len(before))
        tail = len(bare) - lead
        if not now.startswith(before) or lead < 0 or now[:lead] != bare[:lead] or (
                now[len(now) - tail:] != bare[lead:]):
            return Rendered(template.render(turns), None)
        spans.append((lead, len(now) - tail))
        before = now
    return Rendered(before, spans)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Turn]]]:
    """Conversations of a partition sorted by id and turn, also across batches."""
    current, turns = None, []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("id", "role", "text"))
        for conv, role, text in zip(*columns):
            if turns and conv != current:
                yield current, turns
                turns = []
            current = conv
            turns.append((role or "", text or ""))
    if turns:
        yield current, turns


def format_conversations(conversations: DataFrame, template: Template = MARKED,
                         trained_roles: tuple[str, ...] = ("assistant",), id_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
                         ) -> DataFrame:
    """One row per conversation: the id column, ``formatted``, ``loss`` (spans of the texts of
    ``trained_roles`` in it) and ``rewrites`` (the template rewrites history; ``loss`` is null).

    Rows go by turn, then role and text; equal rows stay as turns of their own, and a null turn
    comes first.  Null role or text is empty.  Rows without an id form one conversation.  An
    empty table gives no rows; other columns are not read.  A conversation is read in order by
    one task, which holds its text; no more than the shuffle by id is needed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, turns in _conversations(batches):
            done = render_incrementally(turns, template)
            loss = None if done.spans is None else [
                {"start": a, "end": b} for (a, b), (role, _) in zip(done.spans, turns)
                if role in trained_roles]
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], id_arrow), pa.array([done.formatted], pa.string()),
                 pa.array([loss], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array([done.spans is None])], [id_col, "formatted", "loss", "rewrites"])

    id_type = schema_of(conversations, id_col)
    id_arrow = conversations.sparkSession.createDataFrame([], f"id {id_type}").toArrow().schema[0].type
    rows = conversations.select(*(F.col(c).alias(n) for c, n in (
        (id_col, "id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))))
    ordered = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    return ordered.mapInArrow(
        run, f"`{id_col}` {id_type}, formatted string, "
             "loss array<struct<start:bigint,end:bigint>>, rewrites boolean")


def read_back(formatted: DataFrame, template: Template = MARKED, id_col: str = "conv_id"
              ) -> DataFrame:
    """Digests of formatted conversations, taken from the output alone: ``n_turns``,
    ``turns_sha256`` (role, line feed, text, line feed for each turn), ``loss_chars`` and
    ``loss_sha256`` (the text under the loss mask) and ``formatted_chars``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column("formatted").to_pylist(),
                                  batch.column("loss").to_pylist()):
                turns = template.parse(text)
                all_turns = "".join(f"{r}\n{t}\n" for r, t in turns)
                masked = [template.unescape(text[s["start"]:s["end"]]) for s in loss or []]
                rows.append((len(turns), _sha(all_turns), sum(map(len, masked)),
                             _sha("".join(masked)), len(text)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, (
                    pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))],
                [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(F.col(id_col).alias("id"), "formatted", "loss").mapInArrow(
        run, f"`{id_col}` {schema_of(formatted, id_col)}, n_turns bigint, turns_sha256 string, "
             "loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
