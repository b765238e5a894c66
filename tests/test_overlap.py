"""Overlaps of pairs: a sample's shares stay one row, also where some are unknown."""

import re

from kinspark.operators import similarity


def test_a_pair_is_one_row_all_the_way(spark):
    """Shares used to meet by sample and population, so a pair's sums went through a shuffle in parts (F37)."""
    shares = spark.createDataFrame([(1, "x", 50.0), (1, "y", 30.0), (1, "z", None), (1, None, 20.0), (2, "x", 10.0), (2, "y", 60.0), (2, "z", 5.0), (2, None, 25.0), (3, "w", 100.0), (4, "z", None)], "sample_id long, population string, pct double")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 4), (2, 5), (2, 1), (2, 1)], "a long, b long")
    out = similarity.population_overlap(shares, pairs)
    assert not re.search(r"hashpartitioning\([^)]*population", out._jdf.queryExecution().executedPlan().toString())
    assert {(r["a"], r["b"]): r["overlap"] for r in out.collect()} == {(1, 2): 45.0, (1, 4): None, (2, 4): 5.0, (2, 1): 90.0}
