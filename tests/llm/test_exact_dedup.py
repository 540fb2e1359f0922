import hashlib
import uuid

from ratelark.llm.exact_dedup import DigestIndex, dedup_once


def test_ties_nulls_and_repeats(docs):
    pairs = [(1, "A b"), (2, "a B"), (3, "Éa"), (4, "éa"), (5, None), (6, ""), (None, "a b"),
             (7, "x"), (7, "x"), (8, "y" * 200_000)]
    rows = dedup_once(docs(pairs)).collect()
    assert len(rows) == len(pairs)
    by = {r["doc_id"]: r for r in rows}
    assert (by[1]["keep_id"], by[1]["group_size"], by[1]["kept"]) == (2, 3, False)
    assert by[2]["kept"] and not by[None]["kept"]
    assert by[3]["group_size"] == by[4]["group_size"] == 1      # only A-Z are lower-cased
    assert by[5]["keep_id"] == 6 and by[6]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert sorted(r["kept"] for r in rows if r["doc_id"] == 7) == [False, True]
    assert by[8]["text_sha256"] == hashlib.sha256(b"y" * 200_000).hexdigest()


def test_empty(docs):
    assert dedup_once(docs([])).collect() == []


def test_batches_against_a_lasting_index(spark, docs):
    index = DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=4)
    try:
        first = index.ingest(docs([(1, "a"), (2, "b"), (3, "a")]))
        assert {r["doc_id"]: r["kept"] for r in first.collect()} == {1: False, 2: True, 3: True}
        again = DigestIndex(spark, index.table, buckets=4)
        second = {r["doc_id"]: r for r in again.ingest(docs([(9, "A"), (8, "c"), (7, "c")])).collect()}
        assert (second[9]["keep_id"], second[9]["kept"]) == (3, False)
        assert second[8]["kept"] and not second[7]["kept"]
        assert again.read().count() == 3
        plan = second_plan(spark, index)
        assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
    finally:
        index.drop()


def second_plan(spark, index):
    from pyspark.sql import functions as F
    new = spark.range(10).select(F.col("id").cast("string").cast("binary").alias("digest"))
    joined = new.join(index.read().hint("merge"), "digest", "left_anti")
    return joined._jdf.queryExecution().executedPlan().toString()
