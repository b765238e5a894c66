"""Literal vectors and idempotency."""

import pytest
from pyspark.sql import functions as F

from kinspark.functions import dna, scalars
from kinspark.operators import ages, intervals, reports, similarity, tree
from kinspark.sources import formats
from kinspark.streaming import mirror


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_alleles(spark):
    canon = lambda a, d: dna.allele_canon(F.lit(a), F.lit(d))
    r = one(spark, a=canon("T", "C"), b=canon("A", "G"), c=canon("TA", "TCA"), d=canon("T", "TC"), e=canon("GC", "AA"), f=canon("3T", "T"), g=canon("ins", "del"))
    assert r["a"] == r["b"] == "A>G" and r["c"] == r["d"] == "T>TC" and r["e"] == "GC>AA" and r["f"] == "TTT>T" and r["g"] == "INS>DEL"
    m = lambda a, d: dna.mutation_type(F.lit(a), F.lit(d))
    assert list(one(spark, a=m("a", "g"), b=m("GC", "AA"), c=m("T", "TC"), d=m("ins", "del"))) == ["SNP", "MNP", "INDEL", "INDEL"]


def test_names(spark):
    r = one(spark, m=dna.name_rank(F.lit("M269")), y=dna.name_rank(F.lit("YFS12")), x=dna.name_rank(F.lit("XX1")), k=dna.established_name(F.array(F.lit("DU00001"), F.lit("chrY:1A>G"), F.lit("L21"))))
    assert list(r) == [1, 90, 50, "L21"]
    order = [r[0] for r in spark.createDataFrame([("MF677040",), ("C114528",), ("C106099",), ("C99",)], "n string").orderBy(dna.natural_key(F.col("n"))).collect()]
    assert order == ["C99", "C106099", "C114528", "MF677040"]


def test_contigs(spark):
    got = [r[0] for r in spark.createDataFrame([("chr1",), ("1",), ("Y",), ("chrY_hs1",), ("MT",), ("chrm",), ("alt_1",)], "c string").select(dna.canonical_contig(F.col("c"))).collect()]
    assert got == ["chr1", "chr1", "chrY", "chrY", "chrM", "chrM", "alt_1"]


def test_scalars(spark):
    tokens = lambda s: scalars.call_tokens(F.lit(s))
    r = one(spark, a=tokens("R-M269 > R-L21/R-S145"), b=tokens("n/a"), c=scalars.cm_agree(F.lit(300.0), F.lit(310.0)), d=scalars.recency_factor(F.lit(None).cast("double")), e=scalars.recency_factor(F.lit(86400.0 * 365)))
    assert r["a"] == ["L21", "R-S145", "M269"] and r["b"] == []  # a label goes from the front of a step and r["c"] is True and (r["d"], r["e"]) == (0.5, 0.0)
    assert one(spark, j=scalars.jaccard(F.lit(2), F.lit(3), F.lit(3)), z=scalars.jaccard(F.lit(0), F.lit(0), F.lit(0))) == (0.5, 0.0)


def test_str_tokens(spark):
    got = [r[0] for r in spark.createDataFrame([("13",), ('"11-15"',), ("-",), (" ",), ("10.2t",)], "t string").select(formats.parse_str_token(F.col("t"))).collect()]
    assert (got[0]["kind"], got[0]["repeats"]) == ("simple", 13) and got[1]["copies"] == [11, 15] and got[2] is None and got[3] is None and got[4]["raw"] == "10.2t"


def test_last_writer_wins_batch_and_stream(spark, tmp_path):
    rows = [("cov", 1, 1, 1, "update", 100, 30.0), ("cov", 2, 1, 2, "update", 100, 10.0), ("cov", 1, 1, 3, "update", 200, 40.0), ("cov", 1, 1, 4, "update", 150, 1.0), ("cov", 3, 1, 5, "delete", 300, 0.0), ("cov", 3, 1, 6, "update", 250, 9.0)]
    schema = "collection string, did long, rkey long, arrival long, operation string, time_us long, value double"
    df = spark.createDataFrame(rows, schema)
    latest = {r["did"]: r["value"] for r in reports.lww_latest(df).collect()}
    assert latest == {1: 40.0, 2: 10.0}
    source = str(tmp_path / "in")
    for k in range(0, 6, 2):
        spark.createDataFrame(rows[k : k + 2], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = mirror.mirror_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["cov", "none"]).trigger(availableNow=True).start()
    q.awaitTermination(120)
    for rows_ in (mirror.mirror_rows(spark, str(tmp_path / "out"), schema), mirror.compact_mirror(spark, str(tmp_path / "out"), str(tmp_path / "one"), schema)):
        assert {r["did"]: r["value"] for r in rows_.collect()} == latest
    assert {r["did"] for r in mirror.mirror_rows(spark, str(tmp_path / "one"), schema, deleted=True).collect()} == {1, 2, 3}
    q = mirror.lww_state(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck2")).format("memory").queryName("wins").trigger(availableNow=True).start()
    q.awaitTermination(120)
    newest = {}
    for r in spark.table("wins").collect():
        newest[r["did"]] = max(newest.get(r["did"], (0, "", 0)), (r["time_us"], r["operation"], r["value"]))
    assert {d: v for d, (_, op, v) in newest.items() if op != "delete"} == latest


def test_assign_and_prune_is_idempotent(spark):
    desired = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k int, v string")
    existing = spark.createDataFrame([(2, "x", True), (3, "c", True), (4, "d", True), (5, "curated", False)], "k int, v string, owned boolean")
    first = similarity.assign_and_prune(desired, existing, ["k"], ["v"], F.col("owned"))
    assert {r["k"]: r["change"] for r in first.collect()} == {1: "I", 2: "U", 3: "D", 4: "K", 5: "K"}
    after = first.where("change <> 'D'").select("k", "v").withColumn("owned", F.col("k") != 5)
    assert {r["change"] for r in similarity.assign_and_prune(desired, after, ["k"], ["v"], F.col("owned")).collect()} == {"K"}


def test_closure_of_a_deep_chain_and_a_cycle(spark):
    edges = spark.range(300).select((F.col("id") + 1).alias("child_id"), F.col("id").alias("parent_id"), F.lit(None).cast("timestamp").alias("valid_until"))
    c = tree.tree_closure(edges)
    assert c.count() == 301 * 302 // 2 and c.agg(F.max("distance")).first()[0] == 300
    ring = spark.createDataFrame([(1, 2, None), (2, 3, None), (3, 1, None)], "child_id long, parent_id long, valid_until timestamp")
    assert tree.tree_closure(ring).count() == 9


def test_intervals(spark):
    a = spark.createDataFrame([(1, 0, 10), (1, 5, 20), (1, 30, 40), (2, 0, 3)], "k int, s long, e long")
    b = spark.createDataFrame([(1, 8, 12), (1, 35, 50)], "k int, s long, e long")
    assert sorted(map(tuple, intervals.interval_merge(a).collect())) == [(1, 0, 20), (1, 30, 40), (2, 0, 3)]
    assert sorted(map(tuple, intervals.interval_subtract(a, b).collect())) == [(1, 0, 8), (1, 12, 20), (1, 30, 35), (2, 0, 3)]
    assert intervals.interval_intersect_bp(a, b).collect() == [(1, 9)]


def test_pdfs(spark):
    rows = spark.createDataFrame([(1, 3, 0.01)], "id int, m int, rate double")
    r = ages.pdf_stats(ages.pdf_poisson(rows, "id", 10.0, 2001), "id", 10.0).first()
    assert r["mode"] == 300 and r["mean"] == pytest.approx(400, rel=1e-3)
    g = spark.createDataFrame([(1, "a", 3000.0, 300.0), (1, "b", 3200.0, 173.2)], "id int, part string, mean double, sigma double")
    both = ages.pdf_gaussian(g.withColumn("kp", F.concat_ws("-", "id", "part")), "kp", 10.0, 1001).withColumn("id", F.lit(1))
    assert ages.pdf_stats(ages.pdf_multiply(both, "id", "kp"), "id", 10.0).first()["mean"] == pytest.approx(3150, abs=2)
    apart = spark.createDataFrame([(1, "a", 5, 1.0), (1, "b", 9, 1.0)], "id int, part string, bin int, mass double")
    assert ages.pdf_multiply(apart, "id", "part").count() == 0


def test_str_reconstruct_fills_up_and_down(spark):
    from kinspark.operators import curation

    edges = spark.createDataFrame([(2, 1, None), (3, 1, None), (4, 2, None)], "child_id long, parent_id long, valid_until timestamp")
    motifs = spark.createDataFrame([(2, 7, 13), (3, 7, 14), (4, 8, 20), (9, 7, 15)], "node_id long, marker int, modal int")
    got = {(r["node_id"], r["marker"]): r["value"] for r in curation.str_reconstruct(motifs, edges).collect()}
    assert got == {(1, 7): 13, (2, 7): 13, (3, 7): 14, (4, 7): 13, (4, 8): 20, (2, 8): 20, (1, 8): 20, (3, 8): 20, (9, 7): 15}


def test_natural_sort_pick_settles_on_the_lowest_nodes(spark):
    from kinspark.operators import curation

    wishes = spark.createDataFrame([(1, "C500"), (1, "C99"), (2, "C99"), (2, "C500"), (2, "MF1"), (3, "C99")], "node_id long, name string")
    assert sorted(map(tuple, curation.natural_sort_pick(wishes).collect())) == [(1, "C99"), (2, "C500")]


def test_natural_sort_pick_equals_the_walk(spark):
    """Crowded and lonely names, nodes that go without, a null, and blocks far smaller than the table."""
    import random

    from kinspark.operators import curation

    rng = random.Random(5)
    wishes = {n: {f"M{rng.choice((rng.randrange(12), rng.randrange(300)))}" for _ in range(rng.randint(1, 6))} for n in range(80)} | {90: {"M1"}, 91: {"M1"}}
    taken, want = set(), []
    for n in sorted(wishes):
        free = sorted(wishes[n] - taken, key=lambda x: int(x[1:]))
        if free:
            want.append((n, free[0]))
            taken.add(free[0])
    rows = [(n, x) for n, names in wishes.items() for x in names]
    df = spark.createDataFrame(rows + rows[:9] + [(95, None)], "node_id long, name string")
    assert len(want) < len(wishes)
    for block in (7, 512):
        assert sorted(map(tuple, curation.natural_sort_pick(df, block).collect())) == want


def test_clusters_flag_splits(spark):
    from kinspark.operators import clusters

    rows = [(9, s, v) for s, vs in ((1, (1, 2, 3, 4, 5)), (2, (1, 2, 3, 4, 5)), (3, (1, 2, 3, 6)), (4, (8, 9))) for v in vs]
    got = {r["seed"]: (r["members"], r["variants"], r["split"]) for r in clusters.cluster_variant_sets(spark.createDataFrame(rows, "terminal int, sample_id long, variant_id long")).summary.collect()}
    assert got[1] == (2, 5, True) and got[4] == (1, 2, False)


def greedy(held, match=0.8, split=0.5):
    """The rule walked set by set: {seed: (members, union, split)}."""
    def near(a, b):
        return len(a & b) / len(a | b)

    order = sorted(held, key=lambda s: (-len(held[s]), min(held[s]), s))
    left, out = list(order), {}
    while left:
        seed = left[0]
        inside = [s for s in left if near(held[seed], held[s]) >= match]
        left = [s for s in left if s not in inside]
        union = frozenset().union(*(held[s] for s in inside))
        out[seed] = (sorted(inside), sorted(union), any(split <= near(union, held[s]) < match for s in order if s not in inside))
    return out


def test_clusters_equal_the_greedy_walk(spark):
    """Chains of sets that each differ a little from the last, equal sets, and one terminal that holds most samples."""
    import random

    from kinspark.operators import clusters

    rng, tables = random.Random(3), {}
    for terminal, many in ((1, 150), (2, 12), (3, 1)):
        base, held = set(range(12)), {}
        for k in range(many):
            if rng.random() < 0.1:
                base = set(rng.sample(range(30), rng.randint(1, 14)))
            if rng.random() < 0.6:
                base = base ^ {rng.randrange(30)} or {1}
            held[terminal * 1000 + rng.randrange(1000) if many > 1 else 3000] = frozenset(base)
        tables[terminal] = held
    rows = [(t, s, v) for t, held in tables.items() for s, vs in held.items() for v in vs]
    found = clusters.cluster_variant_sets(spark.createDataFrame(rows, "terminal int, sample_id long, variant_id long"))
    members = {}
    for r in found.members.collect():
        members.setdefault((r["terminal"], r["seed"]), []).append(r["sample_id"])
    got = {(r["terminal"], r["seed"]): (sorted(members[r["terminal"], r["seed"]]), r["variant_ids"], r["split"]) for r in found.summary.collect()}
    want = {(t, seed): row for t, held in tables.items() for seed, row in greedy(held).items()}
    assert got == want and any(r[2] for r in want.values()) and len(want) > 10


@pytest.mark.parametrize("block", [7, 4096])
def test_near_sets_are_no_rows(spark, monkeypatch, block):
    """Of 200 sets nearly all are near to each other; what is written between the steps grows with the sets, not with their pairs."""
    import random

    from kinspark.operators import clusters

    rng, written, cut = random.Random(4), [], clusters.cut_lineage
    held = {(t, 100 * t + s): frozenset(rng.sample(range(14), 14 - rng.randrange(4))) for t in (1, 2) for s in range(100)}

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(clusters, "BLOCK", block, raising=False)
    monkeypatch.setattr(clusters, "cut_lineage", counted)
    found = clusters.cluster_variant_sets(spark.createDataFrame([(t, s, v) for (t, s), vs in held.items() for v in vs], "terminal int, sample_id long, variant_id long"))
    got = {r["seed"]: (r["variant_ids"], r["split"]) for r in found.summary.collect()}
    want = {seed: row[1:] for t in (1, 2) for seed, row in greedy({s: vs for (u, s), vs in held.items() if u == t}).items()}
    assert got == want and len(want) > 4
    near = sum(len(a & b) / len(a | b) >= 0.8 for (t, x), a in held.items() for (u, y), b in held.items() if t == u and x < y)
    assert max(written) <= 200 * 14 < near


def test_no_sets_no_clusters(spark):
    from kinspark.operators import clusters

    found = clusters.cluster_variant_sets(spark.createDataFrame([], "terminal int, sample_id long, variant_id long"))
    assert found.summary.count() == 0 and found.members.count() == 0


def test_snp_ages_grow_towards_the_root(spark):
    branches = spark.createDataFrame([(2, 1, 3, 15e6), (3, 2, 2, 15e6)], "child_id long, parent_id long, snps int, bp double")
    testers = spark.createDataFrame([(3, 5, 12.5e6), (1, 12, 12.5e6)], "node_id long, snps int, bp double")
    got = {r["node_id"]: r for r in ages.snp_age_propagate(branches, testers).collect()}
    assert set(got) == {1, 2, 3} and got[1]["median"] > got[2]["median"] > got[3]["median"] > 300
    assert all(r["lo"] < r["median"] < r["hi"] for r in got.values())
