"""The digest index over several batches, reopened and repeated."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from txnsift.llm.digestindex import DigestIndex
from txnsift.session import scratch_path

DOCS = "doc_id bigint, text string, digest string, kept_digest string, row int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normal(text):
    return (text or "").translate(UPPER)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], DOCS)


def decisions(found):
    rows = found.withColumn("digest", F.lower(F.hex("digest"))).collect()
    return sorted(((r.id, r.keep_id, r.group_size, r.kept, r.digest) for r in rows), key=str)


def first_batch(seed=0):
    rng = random.Random(seed)
    texts = [f"Text {i}" for i in range(20)] + ["É a", "é a", "", None, "long " * 50_000]
    return [(i, rng.choice([str.upper, str.lower, str])(rng.choice(texts) or "") if i % 9 else None) for i in range(300)] + [
        (i, "hot text") for i in range(1000, 1400)
    ]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    keep = {t: max(ids) for t, ids in groups.items()}
    return sorted(
        ((i, keep[normal(t)], len(groups[normal(t)]), i == keep[normal(t)], hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows),
        key=str,
    )


def test_batches_and_repetition(spark):
    path = scratch_path(spark, "digests")
    rows = first_batch()
    index = DigestIndex(spark, path, buckets=4)
    assert decisions(index.add(table(spark, rows), "a")) == expected(rows)
    n_texts = len({normal(t) for _, t in rows})
    assert index.rows().count() == n_texts

    later = [(5000, "HOT text"), (5001, "new one"), (5002, "New one"), (5003, None)]
    again = DigestIndex(spark, path)  # as another application would open it
    assert again.buckets == 4
    kept = {r.id: (r.keep_id, r.group_size, r.kept) for r in again.add(table(spark, later), "b").collect()}
    empty = max(i for i, t in rows if not t)
    assert kept == {5000: (1399, 1, False), 5001: (5002, 2, False), 5002: (5002, 2, True), 5003: (empty, 1, False)}

    again.compact()
    assert again.rows().count() == n_texts + 1
    assert decisions(again.add(table(spark, rows), "a")) == expected(rows)  # a batch added again is decided as before
    assert [r.doc_id for r in again.add_new(table(spark, later), "b").collect()] == [5002]
    assert again.rows().count() == n_texts + 1


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (1, "A"), (None, "a"), (None, "b"), (None, "b"), (7, "c")]
    index = DigestIndex(spark, scratch_path(spark, "digests"), buckets=3)
    found = index.add(table(spark, rows), "x").collect()
    assert sorted((str(r.id), str(r.keep_id), r.group_size, r.kept) for r in found) == sorted(
        [("1", "1", 4, True), ("1", "1", 4, False), ("1", "1", 4, False), ("None", "1", 4, False)]
        + [("None", "None", 2, True), ("None", "None", 2, False), ("7", "7", 1, True)]
    )
    kept = index.add_new(table(spark, rows), "x")
    assert kept.columns == table(spark, rows).columns
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept.collect()) == [("1", "a"), ("7", "c"), ("None", "b")]


def test_empty_table(spark):
    index = DigestIndex(spark, scratch_path(spark, "digests"), buckets=2)
    assert index.add(table(spark, []), "none").collect() == []
    assert index.rows().count() == 0


def test_the_index_is_joined_by_bucket(spark):
    index = DigestIndex(spark, scratch_path(spark, "digests"), buckets=5)
    index.add(table(spark, first_batch()), "a").count()
    groups = table(spark, first_batch(1)).select(F.unhex(F.sha2("text", 256)).alias("digest")).repartition(5, "digest")
    found = groups.join(index.rows().select("digest").hint("merge"), "digest", "left_anti")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1, plan


@pytest.mark.parametrize("odd", [None, "", "\U00030000", "ÀÉ ßſK"])
def test_only_ascii_is_lowered(spark, odd):
    index = DigestIndex(spark, scratch_path(spark, "digests"), buckets=2)
    assert decisions(index.add(table(spark, [(1, odd), (2, "àé ßſk")]), "a")) == expected([(1, odd), (2, "àé ßſk")])
