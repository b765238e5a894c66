"""Branches, merges and repeat ages against plain expectations."""

import numpy as np
import pytest

from kinspark.operators import ages, branches, strages


def test_consensus_needs_reliable_samples(spark):
    sets = spark.createDataFrame([(9, s, v) for s in (1, 2, 3, 4) for v in (10, 11)], "terminal int, sample_id long, variant_id long")
    dids = spark.createDataFrame([(s, f"d{s}") for s in (1, 2, 3, 4)], "sample_id long, did string")

    def run(*rows):
        rel = spark.createDataFrame(list(rows), "sample_id long, confidence double, compatibility string")
        return [(r["evidence"], round(r["confidence"], 3), r["status"]) for r in branches.branch_consensus(sets, rel, dids).collect()]

    assert run((4, 0.2, "COMPATIBLE")) == [(3, 1.0, "READY_FOR_REVIEW")]
    assert run((4, 0.9, "INCOMPATIBLE"), *((s, 0.6, "COMPATIBLE") for s in (1, 2, 3))) == [(3, 0.92, "PROPOSED")]
    assert run((1, 0.1, None), (2, 0.1, None)) == []


def test_private_nodes_hand_their_samples_up(spark):
    nodes = spark.createDataFrame([(1, "R"), (2, "R:n1"), (3, "R:n2"), (4, "Q"), (5, None)], "node_id int, name string")
    closure = spark.createDataFrame([(a, d, n) for a, d, n in [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (1, 2, 1), (2, 3, 1), (1, 3, 2), (3, 4, 1), (2, 4, 2), (1, 4, 3)]], "ancestor_id int, descendant_id int, distance int")
    samples = spark.createDataFrame([(1, 3), (2, 2), (3, 4)], "sample_id long, terminal int")
    assert sorted(map(tuple, branches.private_placeholder_filter(nodes, closure, samples).collect())) == [(1, None, 2), (4, 1, 1), (5, None, 0)]


def test_labels_that_are_bare_uuids_are_private(spark):
    a, b = "00192078-fecd-4194-8a0d-09ce47c9c138", "00192078-FECD-4194-8a0d-09ce47c9c13"
    nodes = spark.createDataFrame([(1, "R"), (2, a), (3, b), (4, "x" + a), (5, "foo:notes"), (6, "R:n1\n")], "node_id int, name string")
    closure = spark.createDataFrame([(i, i, 0) for i in range(1, 7)] + [(1, i, 1) for i in (2, 4, 5, 6)] + [(2, 3, 1), (1, 3, 2)], "ancestor_id int, descendant_id int, distance int")
    samples = spark.createDataFrame([(1, 2, "HG01890"), (2, 3, a), (3, 3, None), (4, 1, a.upper())], "sample_id long, terminal int, label string")
    assert sorted(map(tuple, branches.private_placeholder_filter(nodes, closure, samples).collect())) == [(1, None, 1), (3, 1, 1), (4, 1, 0), (5, 1, 0), (6, 1, 0)]


def test_step_table_sums_to_one(spark):
    sums = {r["m"]: r["s"] for r in strages.str_step_table(spark).groupBy("m").agg({"p": "sum"}).withColumnRenamed("sum(p)", "s").collect()}
    assert len(sums) == strages.MOST_MUTATIONS + 1 and all(abs(v - 1) < 0.02 for v in sums.values())
    table = strages.folded(strages.step_shares(0.05), 0.5, 10, 100)
    assert np.allclose(table.sum(axis=1), 1) and np.abs(strages.folded(strages.step_shares(), 0.5, 10, 10) - np.array(strages.PUBLISHED).T).max() < 0.12


def test_star_age_is_the_product_of_marker_ages(spark):
    res, bins = 50.0, 100
    testers = spark.createDataFrame([(1, s, m, 10 + d) for s, m, d in ((1, 1, 0), (2, 1, 1), (1, 2, 2), (2, 2, 0))], "node_id int, sample_id long, marker int, repeats int")
    modal = spark.createDataFrame([(1, 1, 10), (1, 2, 10)], "node_id int, marker int, modal int")
    g = spark.createDataFrame([(m, d, 0.003) for m in (1, 2) for d in (0, 1, 2)], "marker int, g int, rate double")
    r = strages.str_star_age(testers, modal, strages.str_marker_age(g, strages.str_step_table(spark), ["marker"], res, bins), res).first()
    p = strages.folded(strages.step_shares(), 0.5, strages.MOST_MUTATIONS, 10)
    p[:11, :11] = np.array(strages.PUBLISHED).T
    mass = {d: sum(p[m, d] * (ages.poisson_mass(m, 0.003 / 33, res, bins) if m else np.exp(-np.arange(bins) * res * 0.003 / 33) / np.exp(-np.arange(bins) * res * 0.003 / 33).sum()) for m in range(strages.MOST + 1) if p[m, d] > 1e-9) for d in (0, 1, 2)}
    want = mass[0] * mass[1] * mass[2] * mass[0]
    want /= want.sum()
    assert r["mean"] == pytest.approx((want * np.arange(bins)).sum() * res, rel=1e-6)
    assert (r["testers"], r["markers"], r["distance"]) == (2, 2, 3)


def test_combined_ages_are_causal(spark):
    res, bins = 50.0, 200
    terms = [(1, "snp", 1000.0, 50.0), (2, "snp", 3000.0, 50.0), (3, "snp", 500.0, 50.0), (3, "anchor", 8000.0, 50.0), (5, "snp", 4000.0, 50.0), (6, "snp", 100.0, 60.0)]
    rows = spark.createDataFrame([(f"{n}|{t}", n, t, m, s) for n, t, m, s in terms], "k string, node_id int, term string, mean double, sigma double")
    masses = ages.pdf_gaussian(rows, "k", res, bins).join(rows.select("k", "node_id", "term"), "k").select("node_id", "term", "bin", "mass").where("mass > 1e-30")
    edges = spark.createDataFrame([(2, 1, None), (3, 2, None), (4, 1, None), (5, 4, None), (6, 1, None)], "child_id int, parent_id int, valid_until timestamp")
    years = spark.createDataFrame([(2, 200.0)], "node_id int, years double")
    fixed = spark.createDataFrame([(6, 77.0, 88.0)], "node_id int, tmrca double, formed double")
    got = {r["node_id"]: r for r in strages.combined_age(masses, edges, years, fixed, res, bins).collect()}
    assert set(got) == {1, 2, 3, 5, 6}
    assert got[3]["terms"] == 2 and 4000 < got[3]["tmrca"] < 4500
    # node 4 has no age, so node 5's does not reach node 1
    assert got[1]["tmrca"] == got[2]["tmrca"] == got[3]["tmrca"] and got[2]["formed"] == got[2]["tmrca"] + 200
    assert (got[6]["tmrca"], got[6]["formed"]) == (77.0, 88.0) and all(r["lo"] < r["hi"] for r in got.values())


def test_age_and_name_queries_take_all_ids(spark):
    """The same small tree under low and high ids gives the same rows."""
    from types import SimpleNamespace

    from kinspark.plans import curation_queries as q

    def fx(at):
        return SimpleNamespace(
            edge=spark.createDataFrame([(at + 1, at), (at + 2, at), (at + 3, at + 1)], "child_id long, parent_id long"),
            sample=spark.createDataFrame([(at + 3, 5), (at + 2, 2), (at + 3, 4)], "terminal long, mt long"),
            node_variant=spark.createDataFrame([(at + 1, 7), (at + 1, 8), (at + 2, 7), (at + 3, 8), (at + 3, 11)], "node_id long, variant_id long"))

    low, high = ({(r["node_id"] - at, *r[1:]) for r in q.snp_age_propagate(fx(at)).collect()} for at in (10, 1000))
    assert low == high and {r[0] for r in high} == {0, 1, 2, 3}
    for at in (10, 1000):
        assert {(r["node_id"] - at, r["name"]) for r in q.natural_sort_pick(fx(at)).collect()} == {(1, "M7"), (3, "M8")}
