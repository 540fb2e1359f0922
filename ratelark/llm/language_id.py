"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, code_points, mix, schema_of, segment_sums, text_blocks

ORDER = 4
BLANK = 0x20
_STEP = U64(0x9FB21C651E98DF25)
#: Labelled documents per language that the models are fitted on: a bound on what the driver
#: holds, drawn by a hash of the id.
SAMPLE = 3000
#: Every fifth of them is held back to calibrate rejection.
CALIBRATION_FOLDS = 5
#: Characters after which more text adds no more to the confidence.
FULL_LENGTH = 400
UNDETERMINED = "und"
_GRAIN = 1_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case letter of each code point; a blank for all that is no letter."""
    table = np.full(sys.maxunicode + 1, BLANK, np.uint32)
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if unicodedata.category(char)[0] in "LM":
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


@dataclass
class Grams:
    """All grams of some texts: ``grams`` distinct ones (ORDER code points each), ``inverse``
    which one stands at each place, ``offsets`` of the texts' places, ``n_letters`` of texts."""

    grams: np.ndarray
    inverse: np.ndarray
    offsets: np.ndarray
    n_letters: np.ndarray


def gram_codes(grams: np.ndarray) -> np.ndarray:
    """64-bit codes of rows of code points."""
    code = np.zeros(len(grams), U64)
    for column in grams.T:
        code = code * _STEP + column.astype(U64) + U64(1)
    return mix(code)


def grams_of(data: np.ndarray, offsets: np.ndarray) -> Grams:
    """Letters in lower case, everything between them one blank, blanks around the text."""
    points, bounds, _ = code_points(data, offsets)
    values = _letters()[points]
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    pad = ORDER - 1
    padded = np.full(len(values) + n * ORDER, BLANK, np.uint32)
    padded[np.arange(len(values)) + ORDER * owner + pad] = values
    begins = bounds[:-1] + ORDER * np.arange(n)
    blank = padded == BLANK
    keep = np.ones(len(padded), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    for i in range(pad):
        keep[begins + i] = True
    # letters follow the leading blanks directly
    kept = np.append(0, np.cumsum(keep))
    text = padded[keep]
    at = np.append(kept[begins], len(text))
    columns = [text[i:len(text) - pad + i] for i in range(ORDER)]
    inner = np.ones(max(0, len(text) - pad), bool)          # grams that lie in one text
    for i in range(1, pad + 1):
        ends = at[1:] - i
        inner[ends[(ends >= 0) & (ends < len(inner))]] = False
    places = np.flatnonzero(inner)
    code = np.zeros(len(inner), U64)
    for column in columns:
        code = code * _STEP + column.astype(U64) + U64(1)
    _, first, inverse = np.unique(code[places], return_index=True, return_inverse=True)
    grams = np.stack([c[places[first]] for c in columns], 1) if len(places) else np.zeros(
        (0, ORDER), np.uint32)
    return Grams(grams, inverse, np.searchsorted(places, at),
                 segment_sums((values != BLANK).astype(np.int64), bounds))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, fold, c0 .. c3, n): how often each gram occurs in the texts of a language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                found = grams_of(data, offsets)
                langs = np.array(batch.column("lang")[rows].to_pylist(), object)
                sizes = np.diff(found.offsets)
                for lang in sorted(set(langs)):
                    mine = np.repeat(langs == lang, sizes)
                    n = np.bincount(found.inverse[mine], minlength=len(found.grams))
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some), pa.string()),
                         *(pa.array(found.grams[some, i].astype(np.int32)) for i in range(ORDER)),
                         pa.array(n[some].astype(np.int64))],
                        ["lang", *(f"c{i}" for i in range(ORDER)), "n"])

    fields = ", ".join(f"c{i} int" for i in range(ORDER))
    return labelled.mapInArrow(run, f"lang string, {fields}, n bigint").groupBy(
        "lang", *(f"c{i}" for i in range(ORDER))).agg(F.sum("n").alias("n"))


class KneserNey:
    """Interpolated Kneser-Ney model of one language's characters.

    For every order the log probabilities of seen grams, and for every context length the log
    weights of the shorter context, in arrays sorted by gram code.  An unseen character gets a
    uniform share of what the lowest order leaves over.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, n_chars: int):
        self.keys: list[np.ndarray] = []
        self.logs: list[np.ndarray] = []
        self.context_keys: list[np.ndarray] = []
        self.context_logs: list[np.ndarray] = []
        tables = [(grams, counts.astype(np.float64))]
        while tables[0][0].shape[1] > 1:
            # lower orders count in how many contexts a gram was seen, not how often
            shorter, n = np.unique(tables[0][0][:, 1:], axis=0, return_counts=True)
            tables.insert(0, (shorter, n.astype(np.float64)))
        lower = None
        for rows, n in tables:
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            code = gram_codes(rows)
            context = gram_codes(rows[:, :-1])
            known, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, n)
            left = discount * np.bincount(inverse) / total
            if lower is None:
                backoff = np.full(len(rows), 1.0 / n_chars)
                self.unseen = float(np.log(left[0] / n_chars))
            else:
                backoff = np.exp(lower(rows[:, 1:]))
            p = (n - discount) / total[inverse] + left[inverse] * backoff
            order = np.argsort(code)
            self.keys.append(code[order])
            self.logs.append(np.log(p)[order])
            if lower is not None:
                self.context_keys.append(known)
                self.context_logs.append(np.log(left))
            lower = self.log_probability

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Of the last character of each row, given those before it (up to the orders built)."""
        width = min(grams.shape[1], len(self.keys))
        out = np.full(len(grams), self.unseen)
        for size in range(1, width + 1):
            if size > 1:
                at, hit = _find(self.context_keys[size - 2],
                                gram_codes(grams[:, grams.shape[1] - size:-1]))
                out[hit] += self.context_logs[size - 2][at[hit]]
            at, hit = _find(self.keys[size - 1], gram_codes(grams[:, grams.shape[1] - size:]))
            out[hit] = self.logs[size - 1][at[hit]]
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Identifier:
    """Models by language, and what calibration found: the usual cross-entropy of each
    language and how far above it a text may lie."""

    languages: list[str]
    models: list[KneserNey]
    usual: np.ndarray
    slack: np.ndarray

    def entropies(self, found: Grams) -> np.ndarray:
        """Nats per character of each text (rows) under each language (columns)."""
        out = np.empty((len(found.offsets) - 1, len(self.models)))
        places = np.maximum(np.diff(found.offsets), 1)
        for i, model in enumerate(self.models):
            each = -model.log_probability(found.grams)
            out[:, i] = segment_sums(each[found.inverse], found.offsets) / places
        return out

    def identify(self, found: Grams) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is unlike its language, for each text."""
        n = len(found.offsets) - 1
        if not self.models:
            return [UNDETERMINED] * n, np.zeros(n), np.ones(n, bool)
        entropy = self.entropies(found)
        best = entropy.argmin(1)
        length = np.minimum(np.diff(found.offsets), FULL_LENGTH)
        least = entropy[np.arange(n), best]
        odds = np.exp(-np.minimum((entropy - least[:, None]) * length[:, None], 700))
        score = 1.0 / odds.sum(1)
        excess = (least - self.usual[best]) * np.sqrt(length)
        blank = found.n_letters == 0
        score[blank] = 0.0
        names = [UNDETERMINED if b else self.languages[i] for i, b in zip(best, blank)]
        return names, score, blank | (excess > self.slack[best])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample: int = SAMPLE, slack: float = 4.0) -> Identifier:
    """Fit the models on about ``sample`` labelled documents of each language (all, if fewer).

    Documents are drawn by a hash of the id; a fifth of them only calibrates: a text is unlike
    its language if its cross-entropy exceeds the usual one by more than ``slack`` times what
    199 of 200 calibration texts exceed it by, the square root of the length considered.
    Rows without text, label or id aren't learned from.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.col(lang_col).alias("lang")).where(
        "id is not null and text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Identifier([], [], np.zeros(0), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items()
                           for x in (lang, min(_GRAIN, int(_GRAIN * sample / n) + 1))])
    draw = F.xxhash64("id")
    drawn = rows.where(F.pmod(draw, F.lit(_GRAIN)) < share[F.col("lang")]).select(
        "text", "lang", F.pmod(F.shiftright(draw, 32), F.lit(CALIBRATION_FOLDS)).alias("fold"))
    counted = gram_counts(drawn.where("fold != 0")).toArrow()
    lang = np.array(counted.column("lang").to_pylist(), object)
    grams = np.stack([counted.column(f"c{i}").to_numpy() for i in range(ORDER)], 1).astype(np.uint32)
    counts = counted.column("n").to_numpy()
    languages = sorted(set(lang))
    n_chars = len(np.unique(grams)) + 1
    models = [KneserNey(grams[lang == x], counts[lang == x], n_chars) for x in languages]
    fitted = Identifier(languages, models, np.zeros(len(languages)), np.full(len(languages), np.inf))
    if not models:
        return fitted
    usual, most = _calibrate(drawn.where("fold = 0"), fitted)
    fitted.usual, fitted.slack = usual, np.maximum(slack * most, 1.0)
    return fitted


def _calibrate(held: DataFrame, fitted: Identifier) -> tuple[np.ndarray, np.ndarray]:
    """Usual cross-entropy, and the excess over it that one of 200 texts surpasses, by language."""
    shared = held.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                found = grams_of(data, offsets)
                entropy = known.entropies(found)
                langs = batch.column("lang")[rows].to_pylist()
                own = [known.languages.index(x) if x in known.languages else -1 for x in langs]
                ok = (np.array(own) >= 0) & (found.n_letters > 0)
                at = np.flatnonzero(ok)
                mine = np.array(own)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine.astype(np.int32)), pa.array(entropy[at, mine]),
                     pa.array(np.diff(found.offsets)[at].astype(np.int64))],
                    ["language", "entropy", "length"])

    table = held.mapInArrow(run, "language int, entropy double, length bigint").toArrow()
    language = table.column("language").to_numpy()
    entropy, length = table.column("entropy").to_numpy(), table.column("length").to_numpy()
    usual = np.zeros(len(fitted.languages))
    most = np.full(len(fitted.languages), np.inf)
    for i in range(len(usual)):
        mine = language == i
        if mine.any():
            usual[i] = np.average(entropy[mine], weights=length[mine])
            excess = (entropy[mine] - usual[i]) * np.sqrt(np.minimum(length[mine], FULL_LENGTH))
            most[i] = np.quantile(excess, 0.995)
    return usual, most


def identify(docs: DataFrame, fitted: Identifier, id_col: str = "doc_id", text_col: str = "text",
             carry_text: bool = False) -> DataFrame:
    """One row per input row: the id column, ``lang_pred``, ``score`` (0 to 1) and ``rejected``;
    with ``carry_text`` the text column too.

    The language whose model has the lowest cross-entropy per character of the whole text;
    ``und`` with score 0, and rejected, if the text is null or has no letters, or if no language
    was learned.  ``rejected`` also marks texts unlike their language.  The score is the
    posterior of the language with equal priors; of equal entropies the first name wins.  Rows
    may repeat or lack an id; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                names, score, rejected = known.identify(grams_of(data, offsets))
                text = [batch.column("text")[rows]] if carry_text else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[rows], pa.array(names, pa.string()), pa.array(score),
                     pa.array(rejected), *text], [*names_out])

    names_out = [id_col, "lang_pred", "score", "rejected", *([text_col] if carry_text else [])]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {schema_of(docs, id_col)}, lang_pred string, score double, "
             "rejected boolean" + (f", `{text_col}` string" if carry_text else ""))


def learned_from(id_col: str = "doc_id"):
    """Documents that models may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2
