"""Neighbours where rows repeat id and vector in a group of equal vectors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from txnsift.llm import ann


@pytest.mark.parametrize("times", [1, 2, 7])
def test_own_copies_take_no_places(spark, times):
    rows = [(i, [1.0, 0.0]) for i in range(50, 60)] + [(i, [1.0, 0.1 * i]) for i in range(1, 9)]
    table = spark.createDataFrame(rows * times, "vec_id bigint, embedding array<float>")
    found = ann.nearest(table, F.col("vec_id") == 50).orderBy("rank").collect()
    expected = sorted([i for i in range(51, 60)] * times)[:5]
    assert [(r.rank, r.vec_id, r.score) for r in found] == [(n, i, 1.0) for n, i in enumerate(expected, 1)]


def test_very_large_and_very_small_vectors(spark):
    rows = [(50, [3.0, 4.0, 0.0]), (100, [3e-200, 4e-200, 0.0]), (200, [3e200, 4e200, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [5e-324, 0.0, 0.0])]
    rows += [(i, [1.0, 0.0, float(i)]) for i in range(3, 40)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = ann.nearest(table, F.col("vec_id") % 50 == 0, k=2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == [
        (50, 1, 100), (50, 2, 200), (100, 1, 50), (100, 2, 200), (200, 1, 50), (200, 2, 100),
    ]
    assert all(abs(r.score - 1) < 1e-15 for r in found)


def test_blocks_of_queries_are_not_broadcast(spark):
    """They are repeated for each block of the index, which estimates of size do not see."""
    table = spark.createDataFrame([(i, [1.0, 0.1 * i]) for i in range(1, 101)], "vec_id bigint, embedding array<double>")
    plan = ann.nearest(table, F.col("vec_id") % 50 == 0, block=10)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
