"""Distributions as arrays: no plan that broadcasts bins, and sums that stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.operators import ages
from kinspark.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pdf_poisson", "pdf_gaussian", "pdf_stats", "pdf_truncate", "pdf_multiply", "pdf_convolve", "pdf_convolve_sub"])
def test_no_bins_are_broadcast(spark, name):
    assert "BroadcastExchange" not in plan(registry.QUERIES[name](spark, SF))


def test_arrays_are_summed_by_key_whatever_their_order(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") % 13).alias("k"), F.array(F.lit(1.0), F.col("id").cast("double"), F.lit(float("-inf"))).alias("x"))
    got = {r["k"]: r["x"] for r in ages.summed(rows, "k", "x").collect()}
    assert len(got) == 13 and all(got[k] == [len(range(k, 5000, 13)), sum(range(k, 5000, 13)), -np.inf] for k in got)


def test_both_forms_tell_the_same(spark):
    rows = spark.createDataFrame([(1, 3, 0.004), (2, 0, 0.004), (3, 9, 0.002)], "id long, m int, rate double")
    arrays, long = ages.poisson_arrays(rows, 50.0, 80).select("id", "mass", F.lit(0).alias("g")), ages.pdf_poisson(rows, "id", 50.0, 80).withColumn("g", F.lit(0))
    pairs = [(ages.pdf_stats(x, "id", 50.0), ages.pdf_truncate(x, "id", 9), ages.pdf_multiply(x, "g", "id"), ages.pdf_convolve(x, x, "id", 80)) for x in (arrays, long)]
    for one, two in zip(*pairs):
        a, b = (np.array(sorted(map(tuple, x.select(*one.columns).collect())), dtype=float) for x in (one, two))
        assert a.shape == b.shape and np.allclose(a, b, rtol=1e-9, atol=1e-12)
