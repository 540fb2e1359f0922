"""Spans against a scan written out by hand, and the token test on made-up keys."""

import base64
import hashlib
import random
import string
import uuid

import public_tokenizers
import pytest
import tiktoken

from ratelark.llm.queries import QUERIES, RANKS
from ratelark.llm.secret_scan import digests, known, scan_secrets

KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ALNUM = string.ascii_letters + string.digits
UPPER, LOWER_HEX = string.ascii_uppercase + string.digits, "0123456789abcdef"
ORDER = ("assign", "access", "hex", "dense")


def ascii_lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def run_end(text, at, letters):
    while at < len(text) and text[at] in letters:
        at += 1
    return at


def assign_at(text, low, at):
    for key in KEYS:
        if low.startswith(key, at):
            end = at + len(key)
            end += text[end:end + 1] in ('"', "'") and end < len(text)
            end = run_end(text, end, " ")
            if text[end:end + 1] not in (":", "=") or end >= len(text):
                continue
            end = run_end(text, end + 1, " ")
            end += text[end:end + 1] in ('"', "'") and end < len(text)
            last = run_end(text, end, ALNUM + "+/_.=-")
            if last > end:
                return last, last - end
    return None


def base(text):
    low, out, at = ascii_lower(text), [], 0
    while at < len(text):
        found = assign_at(text, low, at)
        if found:
            out += [(at, found[0], "assign")] if found[1] >= 6 else []
            at = found[0]
        else:
            at += 1
    at = text.find("AKIA")
    while at >= 0:
        end = run_end(text, at + 4, UPPER)
        out += [(at, end, "access")] if end > at + 4 and end - at >= 20 else []
        at = text.find("AKIA", end if end > at + 4 else at + 1)
    at = 0
    while at < len(text):
        end = run_end(text, at, LOWER_HEX)
        out += [(at, end, "hex")] if end - at >= 24 else []
        at = max(end, at + 1)
    return sorted(out, key=lambda s: (s[0], ORDER.index(s[2])))


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def all_spans(text, encoding):
    first = base(text)
    out, at, letters = list(first), 0, ALNUM + "+/_=-"
    while at < len(text):
        end = run_end(text, at, letters)
        run = text[at:end]
        inside = any(a <= at and end <= b for a, b, _ in first)
        if len(run) >= 20 and not inside and not known(run):
            n = sum(len(encoding.encode_ordinary(run[i:i + 512])) for i in range(0, len(run), 512))
            out += [(at, end, "dense")] if len(run) / n < 1.8 else []
        at = max(end, at + 1)
    return sorted(out, key=lambda s: (s[0], ORDER.index(s[2])))


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def expected(rows, encoding):
    out = []
    for doc_id, text in rows:
        first = base(text or "")
        out.append((doc_id, *(sum(k == kind for *_, k in first) for kind in ORDER[:3]),
                    hashlib.sha256(written(first).encode()).hexdigest(),
                    written(all_spans(text or "", encoding))))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()), key=repr)


def scan(df):
    return scan_secrets(df, RANKS, public_tokenizers.PATTERN)


EDGES = [
    (1, None), (2, ""), (2, ""), (None, 'x PassWord" : "abcdef.g" y'), (3, "token=token: abcdefg"),
    (4, "token=abcde token=abcdef"), (5, "api_key='k/+=_.-1' APIKEY:zzzzzz apiXkey=aaaaaa"),
    (6, "toKen=abcdef ſecret=abcdef secret=é12345"), (7, "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " AKIAé"),
    (8, "AKIAKIAKIA" + "Z9" * 8), (9, "f" * 23 + " " + "0a" * 12 + "G" + "d" * 24),
    (10, "ééé\U0001f600 token = \"" + "ab12" * 10 + "\" end"), (11, "secret" + " " * 3000 + "x secret ="),
    (12, "aZ3kP9xQ7vL2mN8bT5cR1wY6 and customer_account_identifier_number"),
    (13, "Qx7" * 20_000), (14, "deadbeef" * 20_000), (15, "password" * 5000 + ":=secret"),
    (16, "AAAAAAAAAAAAAAAAAAAAAAAAA /usr/share/doc/python/html/index =====================")]


def test_edges(docs, encoding):
    assert got(digests(scan(docs(EDGES)))) == expected(EDGES, encoding)
    assert digests(scan(docs([]))).collect() == []


def test_spans_hold_the_text(docs):
    for row in scan(docs(EDGES[:11])).collect():
        texts = [t or "" for i, t in EDGES[:11] if i == row["doc_id"]]
        for s in row["spans"]:
            assert any(t[s["start"]:s["end"]] == s["value"] for t in texts)


def test_query(spark, sf, texts, encoding):
    assert got(QUERIES["op13_secret_scan"](spark, sf)) == expected(texts, encoding)


def test_random_strings_are_found_and_names_left_alone(docs):
    rnd = random.Random(6)
    keys = ["".join(rnd.choices(letters, k=k)) for k in (24, 32, 40, 64) for _ in range(100)
            for letters in (ALNUM, ALNUM + "+/")]
    names = ["getUserAccountByIdentifierName", "MAXIMUM_RETRY_COUNT_BEFORE_FAILURE", "2024-01-02_2024-03-04_v2",
             "application/x-www-form-urlencoded", "internationalization", "----------------------------",
             str(uuid.UUID(int=rnd.getrandbits(128))), hashlib.md5(b"x").hexdigest().upper(),
             hashlib.sha256(b"x").hexdigest().upper(), "sha256-" + base64.b64encode(b"k" * 32).decode(),
             "Donaudampfschifffahrtsgesellschaft", "12345678901234567890123456"]
    rows = scan(docs(list(enumerate(keys + names)))).collect()
    dense = {r["doc_id"] for r in rows if any(s["kind"] == "dense" for s in r["spans"])}
    assert sum(i in dense for i in range(len(keys))) >= 0.98 * len(keys)
    assert not [names[i - len(keys)] for i in dense if i >= len(keys)]
