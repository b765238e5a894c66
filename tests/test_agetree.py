"""Ages through subtrees of bounded size against a plain walk, whatever the size."""

import random

import numpy as np
import pytest

from kinspark.operators import ages, agetree

RES, BINS, BP = 50.0, 120, 15e6
RATE = BP * ages.SNP_RATE


def walk(edges, testers):
    """Ages by recursion over one node after the other: {node: mass}."""
    kids = {}
    for c, (p, _) in edges.items():
        kids.setdefault(p, []).append(c)
    age = {}

    def branch(c):
        return ages.poisson_mass(edges[c][1], RATE, RES, BINS)

    order, stack = [], [n for n in {*kids, *(n for n, _ in testers)} if n not in edges]
    while stack:
        order.append(stack.pop())
        stack += kids.get(order[-1], [])
    for n in reversed(order):
        terms = [ages.convolved(age[c], branch(c), BINS) for c in kids.get(n, []) if age[c] is not None] + [ages.tester_mass(m, RATE, RES, BINS) for i, m in testers if i == n]
        age[n] = ages.product(terms, BINS) if terms else None
    for n in order:
        dated = [c for c in kids.get(n, []) if age[c] is not None]
        if age[n] is not None and len(dated) > 1:
            for c in dated:
                age[c] = ages.refined(age[c], age[n], branch(c), BINS)
    return {n: m for n, m in age.items() if m is not None}


def bushy():
    rng = random.Random(7)
    edges = {c: (rng.randrange(max(0, c - 12), c), rng.randrange(0, 5)) for c in range(1, 60)}
    return edges, [(rng.randrange(60), rng.randrange(0, 12)) for _ in range(50)] + [(99, 4), (5, 3), (5, 3), (5, 3)]


def chain():
    return {c: (c - 1, c % 3) for c in range(1, 40)}, [(39, 2), (20, 30), (39, 2), (7, 1)]


def star():
    return {c: (0, c % 4) for c in range(1, 40)}, [(c, c % 7) for c in range(1, 40, 2)]


@pytest.mark.parametrize("tree, size", [(bushy, 2048), (bushy, 6), (chain, 14), (star, 5)])
def test_equal_to_a_plain_walk(spark, tree, size):
    edges, testers = tree()
    want = walk(edges, testers)
    b = spark.createDataFrame([(c, p, m, BP) for c, (p, m) in edges.items()], "child_id long, parent_id long, snps int, bp double")
    t = spark.createDataFrame([(n, m, BP) for n, m in testers], "node_id long, snps int, bp double")
    got = {r["node_id"]: r for r in ages.snp_age_propagate(b, t, RES, BINS, size).collect()}
    assert set(got) == set(want)
    for n, r in got.items():
        assert abs(r["mean"] - (want[n] * np.arange(BINS)).sum() * RES) < 1e-6


def test_nothing(spark):
    b = spark.createDataFrame([(1, 0, 2, BP)], "child_id long, parent_id long, snps int, bp double")
    t = spark.createDataFrame([], "node_id long, snps int, bp double")
    assert ages.snp_age_propagate(b, t, RES, BINS).collect() == []
    assert ages.snp_age_propagate(b.limit(0), t, RES, BINS).collect() == []


def test_evidence_that_excludes_itself():
    assert agetree.from_logs(agetree.to_logs(np.eye(1, 5, 1)[0]) + agetree.to_logs(np.eye(1, 5, 3)[0])) is None
    assert np.allclose(agetree.from_logs(agetree.to_logs(np.array([0.0, 0.25, 0.75]))), [0, 0.25, 0.75])


def test_no_arrays_are_broadcast(spark, monkeypatch):
    """Equal arrays make small files, but are large in the driver's memory."""
    plans, cut = [], agetree.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(agetree, "cut_lineage", seen)
    tree = spark.createDataFrame([(1, None, 1, 0, 5, 0), (2, 1, 1, 1, 2, 1), (3, 1, 1, 3, 4, 1)], "node_id long, parent_id long, root_id long, enter long, exit long, depth int")
    one = [0.5, 0.5, 0.0]
    logs = spark.createDataFrame([(2, [0.0, -1.0, -2.0]), (3, [-1.0, 0.0, -2.0])], "node_id long, logs array<double>")
    branch = spark.createDataFrame([(2, one), (3, one)], "node_id long, branch array<double>")
    got = agetree.propagate(tree, logs, branch, lambda x, y: ages.convolved(x, y, 3))
    assert got.count() == 3
    lines = [line for p in plans for line in p.splitlines()]
    sent = [lines[i + 1] for i, line in enumerate(lines) if "BroadcastExchange" in line]  # what is broadcast
    assert not [x for x in sent if any(name in x.split("Batched")[0] for name in ("branch#", "logs#", "told#"))]
