"""What samples share, by tiles and by joins; pairs of one key in tiles."""

import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from kinspark.operators import similarity


def shared(rows):
    held = {}
    for block, sample, variant in rows:
        held.setdefault((block, sample), set()).add(variant)
    out = {(b, x, y): len(v & w) for (b, x), v in held.items() for (c, y), w in held.items() if b == c and x < y}
    return {k: n for k, n in out.items() if n}


@pytest.mark.parametrize("tile", [7, 1024])
def test_dense_and_sparse_blocks(spark, monkeypatch, tile):
    monkeypatch.setattr(similarity, "TILE", tile)
    pick = random.Random(5)
    rows = {("dense", s, v) for s in range(40) for v in range(9) if pick.random() < 0.8}
    rows |= {("sparse", s, pick.randrange(4000)) for s in range(60) for _ in range(20)} | {(None, 1, 1), (None, 2, 1), ("dense", 99, 77)}
    df = spark.createDataFrame(sorted(rows, key=str), "terminal string, sample_id long, variant_id long")
    got = similarity.shared_counts(df, ["terminal"]).collect()
    assert {(r["terminal"], r["a"], r["b"]): r["shared"] for r in got} == shared([r for r in rows if r[0]])
    assert len(got) == len(shared([r for r in rows if r[0]]))


def test_common_variants_are_not_met_one_by_one(spark):
    """No pair of a dense block is grouped after a join: its samples pass the shuffle once for each tile."""
    df = spark.range(300 * 20).selectExpr("1L AS terminal", "id % 300 AS sample_id", "id div 300 AS variant_id")
    out = similarity.jaccard_pairs(df, ["terminal"])
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("shared = 20 AND jaccard = 1").count() == out.count() == 300 * 299 // 2


def test_identifiers_meet_in_tiles_and_pairs_are_not_grouped(spark, monkeypatch):
    from kinspark.operators import curation, reports

    monkeypatch.setattr(similarity, "TILE", 5)
    pick = random.Random(3)
    rows = {(s % 3, s) for s in range(60)} | {(pick.randrange(3, 30), s) for s in range(60) for _ in range(s % 4)} | {(None, 1), (None, 2)}
    df = spark.createDataFrame(sorted(rows, key=str) * 2, "identifier long, sample_id long")
    got = {(r["a"], r["b"]): r["shared"] for r in reports.identifier_collisions(df).collect()}
    assert got == {(x, y): n for (_, x, y), n in shared([(0, s, k) for k, s in rows if k is not None]).items()}
    samples = spark.range(50).selectExpr("id % 2 AS identifier", "id AS sample_id", "nullif(id % 9, 8) AS terminal")
    edges = spark.createDataFrame([(k, k // 3) for k in range(3, 9)], "child_id long, parent_id long")
    out = curation.identifier_adjudicate(curation.identifier_pairs(samples, edges))
    last = next(line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line)
    assert "_tile" in last  # pairs meet nothing afterwards
    tells = Counter(r["relation"] for r in out.collect())
    assert sum(tells.values()) == 2 * 25 * 24 // 2 and tells["NO_PLACEMENT"] > 0 and tells["SAME"] > 0


@pytest.mark.parametrize("side", [9, 4096])
def test_duplicates_are_told_where_they_meet(spark, monkeypatch, side):
    """Every pair of a terminal, whatever the tiles, against plain sets; none is joined or grouped after it is made."""
    monkeypatch.setattr(similarity, "SIDE", side, raising=False)
    pick = random.Random(6)
    held = {s: {v for v in range(12) if pick.random() < 0.6} for s in range(60)}
    at = {s: (s % 2, pick.choice([1, 2, 3, None])) for s in held}
    sets = spark.createDataFrame([(s, v) for s, vs in held.items() for v in vs] + [(3, None), (None, 3)], "sample_id long, variant_id long")
    samples = spark.createDataFrame([(s, t, m) for s, (t, m) in at.items()], "sample_id long, terminal long, mt long")
    want = {}
    for a in held:
        for b in held:
            n, union = len(held[a] & held[b]), max(1, len(held[a] | held[b]))
            match = at[a][1] is not None and at[a][1] == at[b][1]
            if a < b and at[a][0] == at[b][0] and (match or (n >= 3 and n / union >= 0.5)):
                want[a, b] = (n, n / union, match, min(1.0, 0.4 * match + 0.6 * (n / union)))
    out = similarity.duplicate_candidates(sets, samples)
    assert {(r["a"], r["b"]): tuple(r)[2:] for r in out.collect()} == want and len(want) > 300
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan[: plan.index("FlatMapGroupsInArrow")]


def test_a_sample_passes_the_shuffle_a_few_times(spark):
    """3000 samples are one side; before, each was sent to three tiles."""
    df = spark.range(3000 * 8).selectExpr("1L AS terminal", "id % 3000 AS sample_id", "id div 3000 AS variant_id").where("(sample_id + variant_id) % 5 > 0")
    rows = similarity.meetings(df.withColumn("size", F.lit(8).cast("long")), ["terminal"])
    dealt = []
    monkey = similarity.in_parts
    try:
        similarity.in_parts = lambda x, *keys: dealt.append(x.count()) or monkey(x, *keys)
        similarity.meetings(df.withColumn("size", F.lit(8).cast("long")), ["terminal"])
    finally:
        similarity.in_parts = monkey
    assert dealt == [5] and rows.count() == 3000 * 2999 // 2
