"""Suggestions, overlaps, ages and restructuring against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from kinspark.operators import ages, curation, similarity, tree


def test_overlap_pairs_are_those_of_all_pairs(spark):
    random.seed(5)
    shares, block = {}, {}
    for s in range(60):
        w = Counter(random.choice("aaabbbccdefgh") for _ in range(random.randint(1, 6)))
        shares[s] = {p: n / sum(w.values()) for p, n in w.items()}
        block[s] = s % 3
    want = {(a, b): sum(min(shares[a].get(p, 0), shares[b][p]) for p in shares[b]) for a in shares for b in shares if a < b and block[a] == block[b]}
    want = {k: v for k, v in want.items() if v >= 0.6 - 1e-12}
    rows = spark.createDataFrame([(s, p, v) for s, x in shares.items() for p, v in x.items()], "sample_id long, population string, pct double")
    got = {(r["a"], r["b"]): r["overlap"] for r in similarity.overlap_pairs(rows, spark.createDataFrame(list(block.items()), "sample_id long, block long"), 0.6 - 1e-12).collect()}
    assert got.keys() == want.keys() and len(want) > 30 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_suggestions_without_all_pairs_of_a_terminal(spark):
    """A terminal that a third of all samples have, ties everywhere, dismissed pairs."""
    random.seed(8)
    terminal = {s: 1 if s % 3 == 0 else 2 + s % 7 for s in range(90)}
    terminal[89] = 77
    pairs = sorted({tuple(sorted(random.sample(range(90), 2))) for _ in range(260)})
    overlaps = [(a, b, random.choice([0.6, 0.75, 1.0])) for a, b in pairs[:200]]
    shared = [(a, b, float(random.randint(2, 4))) for a, b in pairs[120:]]
    dismissed = {(a, b) for a, b in pairs[::7]} | {(0, 3), (3, 0), (0, 6)}
    depth = {1: 2, 2: 5, 3: 0, 4: 30}
    n = Counter(terminal.values())
    score = {t: max(0.01, (1 - n[t] / 90) * depth.get(t, 3) / (depth.get(t, 3) + 8)) for t in n if n[t] > 1}
    part = defaultdict(lambda: [0.0, 0.0, 0.0])
    for k, rows, w in ((0, overlaps, 0.4), (2, shared, 0.3)):
        for a, b, x in rows:
            part[a, b][k] += w * x
            part[b, a][k] += w * x
    for a in range(90):
        for b in range(90):
            if a != b and terminal[a] == terminal[b]:
                part[a, b][1] = 0.3 * score[terminal[a]]
    names = ("POPULATION_OVERLAP", "HAPLOGROUP", "SHARED_MATCH")
    want = set()
    for a in range(90):
        best = sorted(((-round(sum(p), 9), y) for (x, y), p in part.items() if x == a))[:10]
        want |= {(a, y, names[part[a, y].index(max(part[a, y]))], k + 1) for k, (_, y) in enumerate(best) if (a, y) not in dismissed}
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long, score double")
    scores = curation.terminal_scores(spark.createDataFrame(list(terminal.items()), "sample_id long, terminal long"), spark.createDataFrame(list(depth.items()), "node_id long, depth int"))
    assert {r["terminal"]: round(r["score"], 9) for r in scores.collect()} == {t: round(x, 9) for t, x in score.items()}
    got = curation.relative_suggestions(frame(overlaps), scores, frame(shared), spark.createDataFrame(list(dismissed), "a long, b long"), 10).collect()
    assert {(r["a"], r["b"], r["primary"], r["rank"]) for r in got} == want
    nothing = curation.relative_suggestions(frame([]), scores.where("false"), frame([]), spark.createDataFrame([], "a long, b long"), 10)
    assert nothing.count() == 0


def test_rounding_alone_decides_no_suggestion(spark):
    """An overlap of .6 less one unit in the last place counts as .6, and .4 x .69 ties with .3 x .92."""
    shares = spark.createDataFrame([(s, "p", np.nextafter(0.6, 0).item()) for s in (1, 2)], "sample_id long, population string, pct double")
    assert similarity.overlap_pairs(shares, spark.createDataFrame([(1, 0), (2, 0)], "sample_id long, block long"), 0.6).count() == 1
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long, score double")
    at = spark.createDataFrame([(1, 7, 0.92), (2, 7, 0.92)], "sample_id long, terminal long, score double")
    got = curation.relative_suggestions(frame([(1, 2, 0.69)]), at, frame([]), spark.createDataFrame([], "a long, b long"), 10).collect()
    assert [r["primary"] for r in got] == ["POPULATION_OVERLAP"] * 2


def test_ages_up_and_down_against_a_plain_walk(spark):
    res, bins = 50.0, 400
    edges = {2: (1, 3), 3: (1, 12), 4: (2, 2), 5: (2, 9), 6: (5, 0), 7: (3, 1)}
    testers = [(4, 6), (6, 4), (7, 30), (5, 1), (9, 2)]
    bp = 15e6
    rate = bp * ages.SNP_RATE
    kids = defaultdict(list)
    for c, (p, _) in edges.items():
        kids[p].append(c)

    def branch(c):
        return ages.poisson_mass(edges[c][1], rate, res, bins) if c in edges else np.eye(1, bins)[0]

    age = {}

    def up(i):
        terms = [ages.convolved(age[c], branch(c), bins) for c in kids[i] if up(c) is not None] + [ages.tester_mass(m, rate, res, bins) for n, m in testers if n == i]
        mass = np.ones(bins)
        for t in terms:
            mass = mass * t / (mass * t).sum()
        age[i] = mass if terms else None
        return age[i]

    def down(i):
        dated = [c for c in kids[i] if age[c] is not None]
        for c in dated:
            if len(dated) > 1:
                implied = np.array([sum(age[i][t + d] * branch(c)[d] for d in range(bins - t)) for t in range(bins)])
                both = age[c] * implied
                age[c] = both / both.sum() if both.sum() > 0 else implied / implied.sum()
            down(c)

    up(1), up(9), down(1)
    b = spark.createDataFrame([(c, p, m, bp) for c, (p, m) in edges.items()], "child_id long, parent_id long, snps int, bp double")
    t = spark.createDataFrame([(n, m, bp) for n, m in testers], "node_id long, snps int, bp double")
    got = {r["node_id"]: r for r in ages.snp_age_propagate(b, t, res, bins).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 9}
    for i, r in got.items():
        assert abs(r["mean"] - (age[i] * np.arange(bins)).sum() * res) < 1e-6
        assert r["formed"] >= r["median"] - 1e-6
    assert got[6]["formed"] == got[6]["median"] and got[3]["formed"] > got[3]["median"]


def test_every_sample_dates_its_terminal(spark, monkeypatch):
    from types import SimpleNamespace

    from kinspark.plans import curation_queries

    given = []

    def told(branches, testers):
        given.extend(map(tuple, testers.select("node_id", "snps", "bp").collect()))
        return spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0, 1.0)], "node_id long, mean double, median double, lo double, hi double, formed double")

    monkeypatch.setattr(ages, "snp_age_propagate", told)
    fx = SimpleNamespace(
        node_variant=spark.createDataFrame([(2, 7)], "node_id long, variant_id long"), edge=spark.createDataFrame([(2, 1)], "child_id long, parent_id long"),
        sample=spark.createDataFrame([(1, 5, 3), (2, 5, 3), (3, 5, 16), (4, 6, 0)], "sample_id long, terminal long, mt long"))
    curation_queries.snp_age_propagate(fx)
    assert sorted(given) == [(5, 3, 12e6), (5, 3, 12e6), (5, 4, 12e6), (6, 0, 12e6)]


def test_a_disjoint_child_takes_what_its_parent_implies():
    child, parent, branch = (np.eye(1, 20, k)[0] for k in (15, 9, 2))
    assert ages.refined(child, parent, branch, 20).argmax() == 7
    assert (ages.refined(child, parent, np.eye(1, 20, 12)[0], 20) == child).all()


def test_anchor_terms(spark):
    rows = [(1, 1000, 1500, 50.0), (1, None, 850, None), (2, None, None, 5.0), (3, None, 2000, 5.0), (4, 0, None, -1.0), (5, None, 1950, None)]
    got = {r["node_id"]: r for r in ages.anchor_term(spark.createDataFrame(rows, "node_id long, carbon_bp int, date_ce int, uncertainty double")).collect()}
    assert set(got) == {1, 4, 5}
    w = (1 / 50**2, 1 / 110**2)
    assert abs(got[1]["mean"] - (1000 * w[0] + 1100 * w[1]) / sum(w)) < 1e-9 and got[1]["anchors"] == 2
    assert (got[4]["mean"], got[4]["sigma"], got[4]["lo"]) == (0.0, 25.0, 0.0)


def test_merge_and_split(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 3)], "child_id long, parent_id long").withColumn("valid_until", F.lit(None).cast("timestamp"))
    links = spark.createDataFrame([(1, 10), (2, 10), (2, 20), (3, 30), (4, 20), (4, 40)], "node_id long, variant_id long")
    merged = spark.createDataFrame([(1,), (2,), (3,)], "node_id long")
    out = tree.merge_into_parent(merged, edges, tree.tree_closure(edges), links)
    assert {tuple(r) for r in out["edge"].collect()} == {(4, 1), (5, 1)} and {r[0] for r in out["closed"].collect()} == {2, 3}
    assert sorted(tuple(r) for r in out["link"].collect()) == [(1, 10), (1, 20), (1, 30), (4, 20), (4, 40)]
    nodes = spark.createDataFrame([(1, "A", "Y"), (4, "B", "Y"), (9, "C", "MT")], "node_id long, name string, dna_type string").withColumn("valid_until", F.lit(None).cast("timestamp"))
    splits = spark.createDataFrame([(1, 4, " new "), (2, 4, "A"), (3, 4, ""), (4, 4, "new"), (5, 4, "C"), (6, 77, "x"), (7, 4, None)], "split_id long, node_id long, name string")
    moves = spark.createDataFrame([(1, 20), (5, 20), (5, 40), (1, 99), (2, 40)], "split_id long, variant_id long")
    out = tree.split_node(splits, moves, nodes, links)
    assert sorted(tuple(r) for r in out["node"].collect()) == [(1, 10, "new", 4), (5, 11, "C", 4)]
    assert sorted(tuple(r) for r in out["link"].where("node_id >= 4").collect()) == [(10, 20), (11, 40)]


def test_the_best_overlaps_suggest_what_all_do(spark):
    """Ties, equal terminals and shared matches included; of 60 samples in two blocks only the best pairs are returned."""
    rng = random.Random(8)
    shares = [(s, p, w / 10) for s in range(60) for p, w in zip("xyz", rng.choice([(5, 3, 2), (6, 4, 0), (4, 4, 2), (1, 1, 8)]), strict=True) if w]
    shares = [(s, p, None if (s, p) == (7, "x") else w) for s, p, w in shares]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    h, blocks = frame(shares, "sample_id long, population string, pct double"), frame([(s, s % 2) for s in range(60)], "sample_id long, block long")
    terminals = frame([(s, s % 7, 0.1 + s % 7 / 10) for s in range(55)], "sample_id long, terminal long, score double")
    shared = frame([(a, b, 2.0) for a, b in sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(40)})], "a long, b long, score double")
    none = frame([], "a long, b long")
    every = similarity.overlap_pairs(h, blocks, 0.6).select("a", "b", F.col("overlap").alias("score"))
    want = curation.relative_suggestions(every, terminals, shared, none, 4).collect()
    best = curation.suggested_overlaps(h, blocks, terminals, shared, 0.6, 4)
    assert sorted(curation.relative_suggestions(best, terminals, shared, none, 4).collect()) == sorted(want) and len(want) == 240
    for side, across in ((7, 11), (1024, 13)):
        told = {tuple(r) for r in similarity.best_overlap_pairs(h, blocks, terminals, 0.6, 4, 0.4, 0.3, side, across).collect()}
        assert {tuple(r) for r in similarity.best_overlap_pairs(h, blocks, terminals, 0.6, 4, 0.4, 0.3).collect()} <= told < {(r["a"], r["b"]) for r in every.collect()}
