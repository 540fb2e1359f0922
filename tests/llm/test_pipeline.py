"""Each stage against a brute-force version of it, on the stage before's output."""

import corpus_pipeline as pipeline
from ratelark.session import stage

from .test_line_dedup import brute as brute_lines
from .test_ngram_join import brute as brute_join


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r.asDict() for r in docs.collect()}
    first = before
    for number, (name, function) in enumerate(pipeline.STAGES):
        docs = stage(function(spark, docs, sf), name)
        rows = docs.collect()
        if number < len(pipeline.STAGES) - 1:
            assert docs.columns == pipeline.COLUMNS
            after = {r["doc_id"]: r.asDict() for r in rows}
            assert len(after) == len(rows)
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
            assert all(after[i][c] == first[i][c] for i in after for c in ("lang", "source"))
        pairs = [(i, r["text"]) for i, r in sorted(before.items())]
        if name == "language_id":
            assert all(before[i] == r for i, r in after.items())
            assert len(after) >= 0.97 * len(before)
            gone = [before[i]["text"] for i in before if i not in after]
            assert all(i in after for i, r in before.items()
                       if r["text"] and r["text"].isascii() and r["lang"] == "en"
                       and len(r["text"]) > 400 and r["text"].replace(" ", "").isalpha())
            assert len(gone) <= 0.03 * len(before)
        elif name == "line_dedup":
            assert {i: r["text"] for i, r in after.items()} == {
                i: t for i, t, _, _ in brute_lines(pairs)}
        elif name == "ngram_join":
            assert set(after) == {i for i, _, c, _ in brute_join(pairs, 5, 80, 100) if i == c}
        elif name == "suffix_dedup":
            assert {i: r["text"] for i, r in after.items()} == cut_repeats(pairs)
        else:
            sizes = {}
            for r in rows:
                sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
            assert {r["doc_id"] for r in rows} == set(before)
            assert max(sizes.values()) <= 2048
            assert len(sizes) <= -(-sum(sizes.values()) // 2048) + 1
        if number < len(pipeline.STAGES) - 1:
            before = after


def cut_repeats(pairs, length=200):
    starts = {}
    data = {i: (t or "").encode() for i, t in pairs}
    for d in data.values():
        for s in range(len(d) - length + 1):
            key = d[s:s + length]
            starts[key] = starts.get(key, 0) + 1
    out = {}
    for i, d in data.items():
        kept = bytearray(b"\1") * len(d)
        for s in range(len(d) - length + 1):
            if starts[d[s:s + length]] > 1:
                kept[s:s + length] = bytes(length)
        out[i] = bytes(b for b, k in zip(d, kept) if k).decode("utf-8", "ignore")
    return out


def test_run_is_all_stages(spark, sf):
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"] is pipeline.run
    assert [f.__name__ for _, f in pipeline.STAGES] == [
        "language", "lines", "near_duplicates", "repeats", "packing"]


def test_nothing_left(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_null_and_repeated_ids(spark):
    """Every row is a document of its own in each stage, whatever its id."""
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema

    def written(rows):
        return stage(spark.createDataFrame([(i, t, "en", s, len(t)) for i, s, t in rows], schema)
                     .select(*pipeline.COLUMNS), "documents")

    def texts(df):
        assert df.columns == pipeline.COLUMNS
        rows = df.collect()
        assert all(r["n_chars"] == len(r["text"]) and r["lang"] == "en" for r in rows)
        return sorted(((r["doc_id"], r["source"], r["text"]) for r in rows), key=str)

    def ordered(rows):
        return sorted(rows, key=str)

    def words(seed, n=60):
        return " ".join(f"{seed}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))

    own = {c: words(c) for c in "klmnopq"}
    mixed = [(None, "a", own["k"]), (None, "b", own["l"]), (3, "c", own["m"]), (3, "d", own["n"]),
             (4, "e", own["o"]), (4, "e", own["o"])]

    # language: clean rows stay as they are, those without letters go
    docs = written(mixed + [(None, "x", "12 34"), (3, "x", "56")])
    assert texts(pipeline.language(spark, docs, "")) == ordered(mixed)

    # lines: the shared line stays once, at the largest id; rows without an id count too
    line = "a line that several of the documents share"
    rows = [(i, s, f"{t}\n{line}") for i, s, t in mixed[:4]] + [(9, "z", f"{own['p']}\n{line}")]
    assert texts(pipeline.lines(spark, written(rows), "")) == ordered(mixed[:4] + rows[4:])
    same = [(i, "s", f"{own['q']} {i}\n{line}") for i in (None, None, None)]
    got = texts(pipeline.lines(spark, written(
        [(i, s, t.replace("None", c)) for (i, s, t), c in zip(same, "abc")]), ""))
    assert len(got) == 3 and sum(line in t for _, _, t in got) == 1

    # near duplicates: one row of each group, the smallest id first, also among equal rows
    rows = mixed + [(None, "f", own["p"]), (7, "g", own["p"]), (8, "h", own["p"] + " more"),
                    (None, "i", own["q"]), (None, "i", own["q"])]
    assert texts(pipeline.near_duplicates(spark, written(rows), "")) == ordered(
        mixed[:5] + [(7, "g", own["p"]), (None, "i", own["q"])])

    # repeats: passages that occur again go, and no row is lost or multiplied
    passage = words("x", 80)
    rows = mixed[:4] + [(3, "y", f"1{passage}2"), (None, "z", f"3{passage}4")]
    assert texts(pipeline.repeats(spark, written(rows), "")) == ordered(
        mixed[:4] + [(3, "y", "12"), (None, "z", "34")])

    # packing: one document per row
    packed = pipeline.packing(spark, written(mixed), "").collect()
    assert len(packed) == len(mixed)
