"""The closure: shortest distances, and each pair made and written once."""

from kinspark.operators import tree


def walked(edges):
    """(ancestor, descendant) to distance, node by node."""
    below, found = {}, {}
    for child, parent in edges:
        below.setdefault(parent, []).append(child)
    for start in {x for e in edges for x in e}:
        level, distance = [start], 0
        while level:
            for node in level:
                found.setdefault((start, node), distance)
            level, distance = [c for node in level for c in below.get(node, []) if (start, c) not in found], distance + 1
    return found


def closed(spark, edges):
    rows = spark.createDataFrame([(c, p, None) for c, p in edges], "child_id long, parent_id long, valid_until timestamp")
    got = tree.tree_closure(rows).collect()
    out = {(r["ancestor_id"], r["descendant_id"]): r["distance"] for r in got}
    assert len(out) == len(got)
    return out


def test_pairs_of_a_chain_are_written_once(spark, monkeypatch):
    cut, written = tree.cut_lineage, []

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(tree, "cut_lineage", counted)
    edges = [(k + 1, k) for k in range(20)]
    assert closed(spark, edges) == walked(edges)
    assert sum(written) == 20 * 21 // 2


def test_shortcuts_and_cycles(spark):
    edges = [(k + 1, k) for k in range(11)] + [(7, 1), (9, 2), (3, 9), (20, 4), (21, 20), (20, 21), (11, 21)]
    assert closed(spark, edges) == walked(edges)


def test_links_of_merged_nodes_are_not_sorted(spark):
    edges = spark.createDataFrame([(k, k // 3, None) for k in range(3, 200)], "child_id long, parent_id long, valid_until timestamp")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = spark.createDataFrame([(k,) for k in range(200) if k % 4 == 0], "node_id long")
        links = spark.createDataFrame([(k, k % 7) for k in range(1, 200)], "node_id long, variant_id long")
        link = tree.merge_into_parent(merged, edges, tree.tree_closure(edges), links)["link"]
        plan = link._jdf.queryExecution().executedPlan().toString()
        got = sorted(tuple(r) for r in link.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

    def home(k):
        return home(k // 3) if k >= 3 and k % 4 == 0 else k

    assert got == sorted({(home(k), k % 7) for k in range(1, 200)})
    assert [x for x in plan.split("\n") if "ShuffledHashJoin" in x and "LeftOuter" in x]
    assert not [x for x in plan.split("\n") if "SortMergeJoin" in x and "LeftOuter" in x]
