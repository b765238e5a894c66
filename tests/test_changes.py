"""Change sets, tree documents and STR propagation on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.operators import ages, changes, denovo, strages, tree


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    got = {r["k"]: r["n"] for r in tree.numbered(rows, "n", 5000, "k").collect()}
    assert got == {k: 5001 + k for k in range(1000)}


def test_many_children_of_one_parent_get_ids_of_their_own(spark):
    nodes = spark.createDataFrame([(1, "A", "Y"), (2, "B", "Y"), (9000, "C", "MT")], "node_id long, name string, dna_type string")
    rows = [(i, f"P{i}", 1, "ACCEPTED", ["v1", "v2"]) for i in range(1200)] + [(2000, "A", 2, "ACCEPTED", []), (2001, "A", 9000, "ACCEPTED", None), (2002, "P3", 2, "ACCEPTED", ["v9"]), (2003, None, 1, "ACCEPTED", []), (2004, "Q", 77, "ACCEPTED", []), (2005, "R", 1, "PENDING", [])]
    proposals = spark.createDataFrame(rows, "proposal_id long, name string, parent_id long, status string, evidence array<string>")
    variants = spark.createDataFrame([(10, "v1"), (12, "v1"), (40, None)], "id long, name string")
    out = changes.promote_branches(proposals, nodes, variants, spark.createDataFrame([(3, 100), (2005, 101)], "proposal_id long, sample_id long"))
    node = out["node"].collect()
    ids = [r["node_id"] for r in node]
    assert len(set(ids)) == 1201 and min(ids) == 9001 and {r["proposal_id"] for r in node} == {*range(1200), 2001}
    assert out["edge"].count() == 1201 and out["link"].count() == 2400 and [tuple(r) for r in out["variant"].collect()] == [(41, "v2")]
    assert [tuple(r) for r in out["contributor"].select("proposal_id", "sample_id", "status").collect()] == [(3, 100, "PROMOTED")]


def test_merge_plan_chain_and_contraction(spark):
    none = []
    ops = [(1, "CREATE", None, "X1", 5, None, ["a", "new"], none), (2, "CREATE", None, "X2", None, "X1", none, none), (3, "EDIT", 7, None, None, None, ["b"], ["a", "gone"]), (4, "REPARENT", 8, None, None, "X2", none, none), (5, "MATCH", 9, None, None, None, none, none)]
    plan = spark.createDataFrame(ops, "op_id long, op string, node_id long, name string, parent_id long, parent_placeholder string, add array<string>, remove array<string>")
    out = changes.merge_plan_to_changes(plan, spark.createDataFrame([(3, "a"), (4, "b")], "id long, name string"))
    assert sorted(tuple(r) for r in out["change"].collect()) == [
        (1, "CREATE", None, "X1", 5, None, [3, 5], []), (2, "CREATE", None, "X2", None, "X1", [], []), (3, "VARIANT_EDIT", 7, None, None, None, [4], [3]), (4, "REPARENT", 8, None, None, "X2", [], [])]
    assert [tuple(r) for r in out["variant"].collect()] == [("new", 5)]


def test_diff_summary(spark):
    rows = [(1, "CREATE", None, "n", "PENDING"), (2, "DELETE", 5, None, "APPLIED"), (3, "UPDATE", 6, None, "PENDING"), (4, "REPARENT", 5, None, "REJECTED"), (5, "CREATE", None, None, "PENDING")]
    diff = changes.change_set_diff(spark.createDataFrame(rows, "change_id long, change_type string, node_id long, new_name string, status string"), spark.createDataFrame([(5, "five")], "node_id long, name string"))
    assert sorted(tuple(r) for r in diff.collect()) == [(1, "ADDED", "n"), (2, "REMOVED", "five"), (3, "MODIFIED", "(unnamed)"), (5, "ADDED", "(unnamed)")]
    assert tuple(changes.diff_summary(diff).first()) == (2, 1, 0, 1)


def test_covering_twin_and_orphans(spark):
    sites = [(1, None, 10, "A", "G"), (2, "M1", 10, "A", "G"), (3, "chrY:20A>G", 20, "A", "G"), (4, "M2", 20, "A", "G"), (5, None, 30, "A", "G")]
    variants = spark.createDataFrame([(i, n, "chrY", p, a, d, None) for i, n, p, a, d in sites], "id long, name string, contig string, position long, anc string, der string, branch_id long")
    links = spark.createDataFrame([(7, 1), (7, 2), (8, 3), (9, 3), (9, 4), (9, 5)], "node_id long, variant_id long").withColumn("valid_until", F.lit(None).cast("timestamp"))
    assert sorted(tuple(r) for r in changes.branch_covering_twin(variants, links).collect()) == [(1, 2, "M1", True), (3, 4, "M2", False)]


def test_load_tree_collapses_private_leaves(spark):
    document = {
        "node": spark.createDataFrame([("r", "Root", 0.9), ("a", None, 0.5), ("b", None, None), ("c", "S3", 0.1), ("d", "Root", 0.1)], "id string, label string, support double"),
        "edge": spark.createDataFrame([("r", "a"), ("a", "b"), ("a", "c"), ("r", "d")], "parent_id string, child_id string"),
        "link": spark.createDataFrame([("a", "chrY", 5, "A", "G"), ("a", "chrY", 4, "A", "G"), ("b", "chrY", 9, "C", "T"), ("d", "chrY", 5, "A", "G")], "id string, contig string, position long, anc string, der string"),
        "tip": spark.createDataFrame([("b", "S2"), ("c", "S3"), ("d", "S4"), ("d", "S5")], "id string, tip string"),
    }
    catalog = spark.createDataFrame([(50, "M5", "chrY", 5, "A", "G"), (60, "chrY:4A>G", "chrY", 4, "A", "G")], "id long, name string, contig string, position long, anc string, der string")
    out = denovo.load_tree(document, catalog, first_node=10)
    assert sorted((r["node_id"], r["id"], r["name"]) for r in out["node"].collect()) == [(11, "a", "M5"), (12, "d", "Root"), (13, "r", "Root [r]")]
    assert sorted(map(tuple, out["edge"].select("child_id", "parent_id").collect())) == [(11, 13), (12, 13)]
    assert sorted(map(tuple, out["tip"].select("tip", "node_id", "private").collect())) == [("S2", 11, True), ("S3", 11, True), ("S4", 12, False), ("S5", 12, False)]
    assert [tuple(r) for r in out["private"].select("tip", "variant_id", "node_id").collect()] == [("S2", 61, 11)] and out["variant"].count() == 1
    assert denovo.load_tree(document, catalog, keep_private=True)["node"].count() == 5
    with pytest.raises(ValueError):
        denovo.load_tree(document, catalog.union(spark.createDataFrame([(70, "M7", None, None, None, None)], catalog.schema)))


def test_str_propagate_matches_a_plain_walk(spark):
    res, bins = 50.0, 120
    edges = [(2, 1), (3, 1), (4, 2), (5, 2)]
    motif = {1: {1: 12, 2: 13}, 2: {1: 12, 2: 14}, 3: {1: 13}, 4: {1: 12, 2: 14}, 5: {3: 9}}
    testers = [(4, 100, 1, 13), (4, 100, 2, 14), (4, 101, 1, 12), (3, 102, 1, 13), (5, 103, 3, 10), (1, 104, 2, 13)]
    numbers = spark.createDataFrame([(m, g, 0.003 + 0.001 * m) for m in (1, 2, 3) for g in range(4)], "marker int, g int, rate double")
    marker_ages = strages.str_marker_age(numbers, strages.str_step_table(spark), ["marker"], res, bins)
    pdf = {}
    for r in marker_ages.collect():
        pdf.setdefault((r["marker"], r["g"]), np.zeros(bins))[r["bin"]] = r["mass"]

    def product(parts):
        out = np.prod(parts, axis=0)
        return out / out.sum()

    def between(a, b):
        shared = [pdf[m, abs(a[m] - b[m])] for m in a if m in b]
        return product(shared) if shared else None

    def age(node):
        parts = []
        for child, parent in edges:
            if parent == node and (below := age(child)) is not None:
                time = between(motif[child], motif[node])
                parts.append(below if time is None else ages.convolved(below, time, bins))
        people = {}
        for n, s, m, v in testers:
            if n == node:
                people.setdefault(s, {})[m] = v
        parts += [t for p in people.values() if (t := between(p, motif[node])) is not None]
        return product(parts) if parts else None

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = strages.str_propagate(
        frame([(n, m, v) for n, x in motif.items() for m, v in x.items()], "node_id long, marker int, value int"), frame([(c, p, None) for c, p in edges], "child_id long, parent_id long, valid_until timestamp"),
        frame(testers, "node_id long, sample_id long, marker int, repeats int"), marker_ages, res, bins)
    found = {}
    for r in got.collect():
        found.setdefault(r["node_id"], np.zeros(bins))[r["bin"]] = r["mass"]
    assert set(found) == {1, 2, 3, 4, 5}
    for node in found:
        assert np.allclose(found[node], age(node), atol=1e-9)


def test_signatures_and_profiles(spark):
    modal = spark.createDataFrame([(1, 1, 12, 0.5, 2), (1, 2, 13, 1.0, 2)], "node_id long, marker int, modal int, confidence double, n long")
    manual = spark.createDataFrame([(1, 2, 15), (9, 1, 11)], "node_id long, marker int, value int")
    assert sorted((r["node_id"], r["marker"], r["value"], r["method"]) for r in strages.str_signatures(modal, manual).collect()) == [(1, 1, 12, "MODAL"), (1, 2, 15, "MANUAL"), (9, 1, 11, "MANUAL")]
    old = spark.createDataFrame([(1, 1, 9), (1, 2, 9), (2, 1, 9)], "sample_id long, marker int, repeats int")
    new = spark.createDataFrame([(1, 1, 8), (2, 1, 8), (3, 1, 8)], "sample_id long, marker int, repeats int")
    assert sorted(map(tuple, changes.keep_most_complete(old, new).collect())) == [(1, 1, 9, "STORED"), (1, 2, 9, "STORED"), (2, 1, 8, "IMPORTED"), (3, 1, 8, "IMPORTED")]


def test_str_distance_of_several_copies(spark):
    from kinspark.operators import similarity

    profiles = spark.createDataFrame([(1, 1, [15, 12]), (1, 2, [9]), (2, 1, [12, 15]), (2, 2, [9]), (3, 1, [1, 2, 3])], "sample_id long, marker int, repeats array<int>")
    motifs = spark.createDataFrame([(7, 1, [12, 14]), (7, 2, [11]), (8, 3, [1])], "node_id long, marker int, modal array<int>")
    assert sorted(map(tuple, similarity.str_distance(profiles, motifs).collect())) == [(1, 7, 3, 2), (2, 7, 3, 2)]


def test_equal_motif_distances_are_worked_once(spark, monkeypatch):
    """Of 60 keys with three kinds of distances, three arrays are summed, and none of their bins is a row."""
    bins, summed, given = 20, ages.summed, []

    def counted(rows, key, column):
        given.append(rows.count())
        return summed(rows, key, column)

    monkeypatch.setattr(ages, "summed", counted)
    rng = np.random.default_rng(1)
    held = {(m, g): rng.random(bins) * (np.arange(bins) >= 3 * m) for m in (1, 2) for g in (0, 1)}
    marker_ages = spark.createDataFrame([(m, g, b, float(x)) for (m, g), w in held.items() for b, x in enumerate(w) if x > 0], "marker int, g int, bin int, mass double")
    pairs = {k: [(1, 0), (2, 1), (2, 1)][: k % 3 + 1] + [(9, 0)] for k in range(60)}
    got = strages.motif_pair_ages(spark.createDataFrame([(k, m, g) for k, rows in pairs.items() for m, g in rows], "child_id long, marker int, g int"), marker_ages, "child_id", bins)
    found = {r["child_id"]: np.array(r["mass"]) for r in got.collect()}
    assert set(found) == set(pairs) and given == [1 + 2 + 2]
    for k, rows in pairs.items():
        want = np.prod([held[row] for row in rows if row in held], axis=0)
        assert np.allclose(found[k], want / want.sum(), atol=1e-12)
