"""Secrets in texts: patterns, and strings that a tokenizer's vocabulary cannot shorten.

A vocabulary learned from prose and code writes known words in few tokens and random characters in
many.  A run of key-like characters with few characters per token is random, unless it is a
digest or an identifier.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_of, slices

# fixed values: the patterns, and the least length of a group or match
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ASSIGNED = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "dense")

#: Runs that may be keys: of at least this many characters, with fewer characters per token.
MIN_CHARS = 20
MAX_RATIO = 1.8
_RUN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"
#: Characters that are split into tokens at once; longer runs go piece by piece.
PIECE = 512
#: Lengths of hexadecimal digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
_HEX_RUN = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_NAMED_DIGEST = re.compile(r"(?:md5|sha(?:1|224|256|384|512))-[A-Za-z0-9+/]+={0,2}\Z", re.ASCII)
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: A part of a name, a path or a number: one word in one case and up to three digits, or digits.
_PLAIN_PART = re.compile(r"(?:(?:[A-Z]?[a-z]*|[A-Z]+)[0-9]{0,3}|[0-9]+)\Z")
_BETWEEN_PARTS = re.compile(r"[+/_=-]")
ROWS = 256


@lru_cache(maxsize=4)
def token_counter(path: str, pattern: str) -> Callable[[str], int]:
    """The number of tokens of a text under the ranks in a tiktoken file."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: sum(len(encoding.encode_ordinary(text[i:i + PIECE]))
                            for i in range(0, len(text), PIECE))


def known(run: str) -> bool:
    """Digests (hexadecimal of a usual length, or named), UUIDs and identifiers: words in one case
    (and up to three digits) and numbers, alone or joined by ``_``, ``-``, ``/``, ``+`` or ``=``."""
    if len(run) in DIGEST_CHARS and _HEX_RUN.match(run):
        return True
    if _UUID.match(run) or _NAMED_DIGEST.match(run):
        return True
    return all(map(_PLAIN_PART.match, _BETWEEN_PARTS.split(run)))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, by start, then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text)
             if m.end(2) - m.start(2) >= ASSIGNED]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def dense_spans(text: str, taken: list[tuple[int, int, str]], tokens: Callable[[str], int],
                runs: re.Pattern, max_ratio: float) -> list[tuple[int, int, str]]:
    """Runs of key-like characters with few characters per token, outside known forms and spans
    already ``taken`` (in order of their starts)."""
    out, at, reach = [], 0, 0
    for m in runs.finditer(text):
        while at < len(taken) and taken[at][0] <= m.start():
            reach = max(reach, taken[at][1])
            at += 1
        run = m.group()
        if reach < m.end() and not known(run) and len(run) < max_ratio * tokens(run):
            out.append((*m.span(), "dense"))
    return out


def scan_secrets(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text", min_chars: int = MIN_CHARS, max_ratio: float = MAX_RATIO
                 ) -> DataFrame:
    """One row per document: the id column and ``spans``, an array of (kind, start, end, value) by
    start, then kind (assign, access, hex, dense); places count code points, ends are exclusive.

    ``path`` names a file of tiktoken ranks and ``pattern`` how its library cuts texts.  The
    patterns' spans always stay; a run inside one is not listed again.  Null and empty texts have
    no spans.  Every row is a document of its own, also where ids repeat or lack; an empty table
    gives no rows; other columns are not read.  Texts are scanned whole, a few hundred rows at a
    time, without a shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_counter(path, pattern)
        runs = re.compile(_RUN % min_chars)
        for batch in slices(batches, ROWS):
            spans = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                found = sorted(base + dense_spans(text, base, tokens, runs, max_ratio),
                               key=lambda s: (s[0], KINDS.index(s[2])))
                spans.append([{"kind": k, "start": a, "end": b, "value": text[a:b]}
                              for a, b, k in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(spans, pa.list_(pa.struct([
                    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                    ("value", pa.string())])))], [id_col, "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {schema_of(docs, id_col)}, "
             "spans array<struct<kind:string,start:bigint,end:bigint,value:string>>")


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Numbers of spans per pattern (``n_assign``, ``n_access``, ``n_hex``), ``base_sha256`` of the
    patterns' spans and ``spans``, all of them, both written ``kind:start:end`` with commas."""
    def written(spans):
        return F.array_join(F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                         s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return scanned.select(id_col, *(number(k).alias(f"n_{k}") for k in BASE_KINDS),
                          F.sha2(written(base), 256).alias("base_sha256"),
                          written(F.col("spans")).alias("spans"))
