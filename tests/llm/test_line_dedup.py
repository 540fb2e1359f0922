from ratelark.llm.line_dedup import line_dedup


def brute(pairs, min_chars=20, min_docs=3):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c
                       for c in line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    held = {}
    for i, t in pairs:
        if i is not None:
            for line in (t or "").split("\n"):
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        left = [x for x in lines if i is None or len(key(x)) < min_chars
                or len(held[key(x)]) < min_docs or max(held[key(x)]) == i]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def run(docs, pairs):
    df = line_dedup(docs(pairs)).select("doc_id", "text", "n_lines", "n_dropped")
    return order(tuple(r) for r in df.collect())


def test_edges(docs):
    line = "This line is shared by many"
    pairs = [(1, f"{line}\nown one\n{line}"), (2, f" \t{line.upper()}\x0b\r\nother"), (3, line),
             (4, f"x\n{line}\n\ny"), (5, None), (6, ""), (None, line), (7, "é" * 19), (8, "é" * 19),
             (9, "é" * 19), (10, "é" * 20), (11, "é" * 20), (12, "É" * 20), (13, "é" * 20),
             (14, "z" * 100_000 + "\n" + line), (14, "z" * 100_000 + "\n" + line), (15, "\n\n")]
    assert run(docs, pairs) == order(brute(pairs))


def test_empty(docs):
    assert run(docs, []) == []


def test_whole_table(docs, texts):
    assert run(docs, texts) == order(brute(texts))
