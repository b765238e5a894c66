"""Tree numbers against a plain walk; small lists make the jumping rounds run."""

import random

import pytest

from kinspark.operators import numbering


def walk(edges, nodes):
    """(node, root, enter, exit, depth) by a plain stack; what hangs on a cycle is left out."""
    parent = {}
    for c, p in edges:
        if c != p:
            parent[c] = min(p, parent.get(c, p))
    kids = {}
    for c, p in parent.items():
        kids.setdefault(p, []).append(c)
    out = {}
    for root in sorted((set(nodes) | set(kids)) - set(parent)):
        clock, stack, order = 0, [(root, 0)], []
        while stack:
            n, depth = stack.pop()
            order.append(n)
            out[n] = [root, clock, clock, depth]
            clock += 1
            stack += [(k, depth + 1) for k in sorted(kids.get(n, []), reverse=True)]
        for n in reversed(order):
            out[n][2] = max([out[n][1]] + [out[k][2] for k in kids.get(n, [])])
    return sorted((n, *v) for n, v in out.items())


def forests():
    rng = random.Random(3)
    yield "random", [(c, rng.randrange(c)) for c in range(1, 400) if c % 61], range(420)
    yield "chain", [(c, c - 1) for c in range(1, 600)], range(600)
    yield "star", [(c, 0) for c in range(1, 500)], range(500)
    yield "cycles", [(1, 2), (2, 3), (3, 1), (4, 3), (5, 6), (7, 7), (8, 5), (8, 6)], range(9)
    yield "negative", [(-5, 10), (-6, 10), (3, -5)], [10]
    yield "none", [], [4, 2]


@pytest.mark.parametrize("name, edges, nodes, small", [(*f, 1 << 20) for f in forests()] + [(*f, 200) for f in forests() if f[0] in ("random", "chain")] + [(*f, 4) for f in forests() if f[0] == "cycles"])
def test_numbers(spark, name, edges, nodes, small):
    e = spark.createDataFrame([(c, p, None) for c, p in edges], "child_id long, parent_id long, valid_until timestamp").repartition(3)
    n = spark.createDataFrame([(i,) for i in nodes], "node_id long")
    got = sorted(tuple(r) for r in numbering.tree_numbers(e, n, small, 6).select("node_id", "root_id", "enter", "exit", "depth").collect())
    assert got == walk(edges, nodes)


def test_sums_and_windows(spark):
    rng = random.Random(9)
    edges = [(c, rng.randrange(c)) for c in range(1, 200)] + [(301, 300)]
    e = spark.createDataFrame([(c, p, None) for c, p in edges], "child_id long, parent_id long, valid_until timestamp")
    numbers = numbering.tree_numbers(e)
    parent = dict(edges)

    def above(n):
        while n is not None:
            yield n
            n = parent.get(n)

    direct = [(rng.randrange(200), rng.randrange(5)) for _ in range(80)] + [(301, 2), (999, 7)]
    want = {}
    for n, x in direct:
        for a in above(n) if n != 999 else ():
            want[a] = want.get(a, 0) + x
    counts = spark.createDataFrame(direct, "node_id long, n long")
    assert {r["node_id"]: r["n"] for r in numbering.cumulative_counts(numbers, counts).collect()} == {k: v for k, v in want.items() if v}
    inside = {n: list(above(n)).index(3) for n in range(200) if 3 in above(n)}
    assert {r["node_id"]: r["distance"] for r in numbering.below(numbers, 3).collect()} == inside
    assert numbering.below(numbers, 12345).collect() == []
    links = spark.createDataFrame([(3, 1), (3, 1), (3, 2)], "node_id long, variant_id long")
    window = {r["node_id"]: r for r in numbering.subtree_window(numbers, 3, 1, links, spark.createDataFrame([(3,)], "node_id long")).collect()}
    assert set(window) == {n for n, d in inside.items() if d <= 1} and (window[3]["variants"], window[3]["is_backbone"], window[3]["has_hidden"]) == (2, True, False)
    assert all(r["has_hidden"] == (n in parent.values()) for n, r in window.items() if n != 3)
    samples = spark.createDataFrame([(1, 3, "R-X"), (2, 0, "R-X"), (3, min(k for k, d in inside.items() if d), "r-x "), (4, 3, None)], "donor_id long, terminal long, call_text string")
    out = spark.createDataFrame([(4,)], "donor_id long")
    assert {r[0] for r in numbering.recruit_cohort(samples, numbers, 3, out).collect()} == {1, 3}
    assert {r[0] for r in numbering.recruit_cohort(samples, numbers, None, out, "R-x").collect()} == {1, 2, 3}
