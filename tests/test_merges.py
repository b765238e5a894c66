"""Sample merges over several tables, donors, call resolution, claim views, blocks and the interval sweep."""

import datetime
import random

import pytest

from kinspark.functions import scalars
from kinspark.operators import curation, intervals, merges, placement, reports, similarity
from pyspark.sql import functions as F

SAMPLE = "sample_id long, accession string, alias string, calls array<string>, is_public boolean, deleted boolean, merged_ids array<long>, merged_accessions array<string>, merged_into long"


def people(spark, *rows):
    return spark.createDataFrame([(i, f"A{i}", alias, [f"c{i}"] if calls else None, public, deleted, None, None, None) for i, alias, calls, public, deleted in rows], SAMPLE)


def merged(spark, pairs, **more):
    samples = people(spark, (1, None, True, None, False), (2, "two", True, True, False), (3, "three", False, None, None), (4, None, True, False, False), (9, None, True, None, True))
    table = spark.createDataFrame([(1, "x", 1), (2, "x", 2), (2, "y", 3), (3, "y", 4), (3, "y", 5), (4, "z", 6), (None, "z", 7)], "sample_id long, what string, n long")
    pairs_ = spark.createDataFrame([(1, 2), (4, 1), (4, 5), (None, 4)], "a long, b long")
    candidates = spark.createDataFrame([(7, 1, 2, "CANDIDATE"), (8, 2, 4, "CANDIDATE"), (9, 1, 4, "CANDIDATE"), (10, 2, 4, "DISMISSED"), (11, 3, 1, "CONFIRMED")], "candidate_id long, a long, b long, status string")
    plan = {"t": merges.Rule(("sample_id",), merges.KEEP_SURVIVOR, ("what",)), "all": merges.Rule(("sample_id",)), "p": merges.Rule(("a", "b"), merges.DROP)} | more.pop("plan", {})
    references = {"t": ("sample_id",), "all": ("sample_id",), "p": ("a", "b")} | more.pop("references", {})
    asked = spark.createDataFrame(pairs, "merged long, survivor long, candidate_id long")
    return merges.merge_samples(samples, {"t": table, "all": table, "p": pairs_}, references, plan, asked, "me", candidates)


def test_chain_of_merges(spark):
    """3 into 2 into 1: what 2 holds comes before what 3 holds; all of 3's equal rows of a kept key stay together."""
    out = merged(spark, [(3, 2, None), (2, 1, 7)])
    rows = {r["sample_id"]: r for r in out["sample"].collect()}
    assert (rows[1]["alias"], rows[1]["calls"], rows[1]["is_public"], rows[1]["merged_ids"], rows[1]["merged_accessions"]) == ("two", ["c1", "c2"], True, [2, 3], ["A2", "A3"])
    assert (rows[2]["deleted"], rows[2]["merged_into"], rows[3]["merged_into"], rows[1]["deleted"], rows[4]["merged_into"], rows[9]["deleted"]) == (True, 1, 2, False, None, True)
    assert sorted((tuple(r) for r in out["t"].collect()), key=str) == sorted([(1, "x", 1), (1, "y", 3), (4, "z", 6), (None, "z", 7)], key=str)
    assert sorted((tuple(r) for r in out["all"].collect()), key=str) == sorted([(1, "x", 1), (1, "x", 2), (1, "y", 3), (1, "y", 4), (1, "y", 5), (4, "z", 6), (None, "z", 7)], key=str)
    assert {tuple(r) for r in out["p"].collect()} == {(4, 1), (4, 5), (None, 4)}
    assert {(r["merged"], r["repointed"], r["dropped"], r["merged_by"]) for r in out["audit"].collect()} == {(2, 3, 2, "me"), (3, 2, 2, "me")}
    assert {r["candidate_id"]: r["status"] for r in out["candidate"].collect()} == {7: "MERGED", 8: "DISMISSED", 9: "CANDIDATE", 10: "DISMISSED", 11: "CONFIRMED"}


@pytest.mark.parametrize("pairs, reason", [([(1, 1, None)], "itself"), ([(2, 1, None), (2, 4, None)], "twice"), ([(77, 1, None)], "unknown"), ([(2, 9, None)], "deleted"), ([(1, 2, None), (2, 1, None)], "cycle")])
def test_refused_merges(spark, pairs, reason):
    with pytest.raises(ValueError, match=reason):
        merged(spark, pairs)


def test_uncovered_column_is_refused(spark):
    with pytest.raises(ValueError, match="no rule covers p.c, q.sample_id"):
        merged(spark, [(2, 1, None)], references={"q": ("sample_id",), "p": ("a", "b", "c")})
    assert merged(spark, [])["audit"].collect() == []


def test_donors_of_one_individual(spark):
    samples = spark.createDataFrame([(1, 10, "HG1", None, True, False), (2, 11, None, "hg1", False, False), (3, 12, None, "Hg1", None, False), (4, None, None, "HG1", False, False), (5, 10, None, "hg1", False, True), (6, 12, "HG2", None, True, False), (7, 13, None, "x", False, None)], "sample_id long, donor_id long, accession string, alias string, denovo boolean, deleted boolean")
    donors = spark.createDataFrame([(10, None, "at 10", None, "d10"), (11, "M", "at 11", None, "d11"), (12, "F", None, "bank", "d12"), (13, None, None, None, "d13")], "donor_id long, sex string, geocoord string, biobank string, donor_identifier string")
    out = merges.consolidate_donors(samples, donors)
    # 11 and 12 know most, 11 is the lesser; the deleted sample keeps 10, which so stays, and 12 has another sample
    assert {r["sample_id"]: r["donor_id"] for r in out["sample"].collect()} == {1: 11, 2: 11, 3: 11, 4: 11, 5: 10, 6: 12, 7: 13}
    assert {tuple(r) for r in out["donor"].collect()} == {(10, None, "at 10", None, "d10"), (11, "M", "at 11", "bank", "hg1"), (12, "F", None, "bank", "d12"), (13, None, None, None, "d13")}
    gone = merges.consolidate_donors(samples.where("sample_id <> 5"), donors)["donor"]
    assert {r["donor_id"] for r in gone.collect()} == {11, 12, 13}


def test_call_tokens(spark):
    told = {"R-M269": ["M269"], "R-DF27 > Z195 > Z198": ["Z198", "Z195", "DF27"], "L151/PF6542": ["L151", "PF6542"], "E1b1b-M35*": ["M35"], "M269": [], "n/a (x)": [], " NA ": [], "?": [], "unknown": [], "": [], "r-x": []}
    rows = spark.createDataFrame([(k,) for k in told], "c string").select("c", scalars.call_tokens(F.col("c")).alias("t")).collect()
    assert {r["c"]: r["t"] for r in rows} == told


def test_resolution_and_placement(spark):
    old, new = datetime.datetime(2020, 1, 1), datetime.datetime(2021, 1, 1)
    nodes = spark.createDataFrame([(1, "R-A", None, old, None), (2, "R-B", ["was"], old, None), (3, "R-C", ["was"], new, None), (4, "R-D", ["gone"], new, new), (5, "S1", None, new, None), (6, "R-F", None, new, None)], "node_id long, name string, aliases array<string>, valid_from timestamp, valid_until timestamp")
    links = spark.createDataFrame([(1, 10), (3, 10), (4, 10), (6, 11), (2, 12)], "node_id long, variant_id long")
    variants = spark.createDataFrame([(10, "s1"), (11, "Z9"), (12, "Q2"), (13, None)], "id long, name string")
    calls = {"R-A": 1, "was": 3, "gone": None, "S1": 5, "s1": 3, "R-z9": 6, "X > Q2": 2, "R-C > R-nothing": None, "X-Z9/Q2": 6, "n/a": None, "R-D": 4}
    samples = spark.createDataFrame([(k, "STANDARD", c, False, False) for k, c in enumerate(calls)] + [(50, "CITIZEN", "R-A", False, False), (51, "STANDARD", "R-A", True, False), (52, "STANDARD", None, False, False), (53, "STANDARD", " ", False, False), (54, "STANDARD", "R-A", False, True), (55, "STANDARD", "R-A", False, None), (56, "STANDARD", "R-A", True, True)], "sample_id long, source string, call_text string, deleted boolean, denovo boolean")
    found = {r["call_text"]: r["node_id"] for r in placement.resolve_calls(samples, nodes, links, variants).collect()}
    assert {c: found.get(c) for c in calls} == calls
    before = spark.createDataFrame([(i, 9, "old", s) for i, s in [(50, "PLACED"), (51, "PLACED"), (52, "PLACED"), (54, "PLACED"), (55, "CURATED"), (56, "PLACED"), (0, "PLACED"), (99, "PLACED")]], "sample_id long, node_id long, call_text string, status string")
    rows = {r["sample_id"]: (r["node_id"], r["status"]) for r in placement.place_samples(samples, before, nodes, links, variants).collect()}
    assert rows == {k: (n, "UNPLACED" if n is None else "PLACED") for k, n in enumerate(calls.values())} | {54: (9, "PLACED"), 55: (9, "CURATED")}


def test_claims_by_view(spark):
    rows = [(1, "s", "PUBLIC", "one", "a|b", 1, None, False), (2, "s", "PROJECT:1", "one", "a|b", 2, None, False), (3, "s", "PROJECT:2", "one", "c", 3, None, False), (4, "s", "PROJECT:2", "many", "x", 4, None, False), (5, "s", "PROJECT:2", "many", "y", 5, None, None),
            (6, "s", "PUBLIC", "one", "z", 6, None, True), (7, "s", "PROJECT:1", "one", "d", 7, 2, True), (8, "t", "PROJECT:1", "many", "q", 8, 9, False), (9, "t", "PUBLIC", "many", "r", 9, None, False), (10, "s", "PROJECT:3", "many", "v", 10, None, True)]
    claims = spark.createDataFrame([(i, s, scope, p, v, 0, at, x, gone) for i, s, scope, p, v, at, x, gone in rows], "claim_id long, subject string, scope string, predicate string, val string, author long, created_at long, supersedes long, retracted boolean")
    got = {(r["subject"], r["scope"], r["predicate"]): (r["state"], [v["val"] for v in r["view"]]) for r in reports.claim_fold(claims, ["one"]).collect()}
    assert got == {("s", "PUBLIC", "one"): ("SETTLED", ["a|b"]), ("s", "PROJECT:1", "one"): ("SETTLED", ["a|b", "a|b"]), ("s", "PROJECT:2", "one"): ("DISPUTED", ["a|b", "c"]), ("s", "PROJECT:3", "one"): ("SETTLED", ["a|b"]),
                   ("s", "PROJECT:2", "many"): ("SETTLED", ["x", "y"]), ("t", "PROJECT:1", "many"): ("SETTLED", ["q"])}


def test_duplicates_by_mt(spark):
    sets = spark.createDataFrame([(1, v) for v in (1, 2, 3)] + [(2, v) for v in (1, 2, 3)] + [(3, 9)] + [(5, v) for v in (1, 2, 3, 4)] + [(6, 9)], "sample_id long, variant_id long")
    samples = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 1), (4, 7, 1), (5, 7, None), (6, 8, 1), (7, 8, None), (8, 8, None)], "sample_id long, terminal long, mt long")
    got = {(r["a"], r["b"]): (r["shared"], round(r["jaccard"], 3), r["mt_match"], round(r["score"], 3)) for r in similarity.duplicate_candidates(sets, samples).collect()}
    assert got == {(1, 2): (3, 1.0, False, 0.6), (1, 3): (0, 0.0, True, 0.4), (1, 4): (0, 0.0, True, 0.4), (3, 4): (0, 0.0, True, 0.4), (1, 5): (3, 0.75, False, 0.45), (2, 5): (3, 0.75, False, 0.45)}
    assert {tuple(r) for r in similarity.duplicate_blocks(sets, samples).blocks.collect()} == {(7, 1, 3), (7, 2, 1), (8, 1, 1)}


def test_blocks_without_spread_or_coordinates(spark):
    rows = spark.createDataFrame([(1, "A", 1.0, 5.0), (2, "A", 3.0, 5.0), (3, None, None, 5.0)], "sample_id long, dominant string, x double, y double")
    assert {r["sample_id"]: r["block"] for r in similarity.ancestry_blocks(rows).collect()} == {1: "A:-2:0", 2: "A:2:0", 3: "?:nopca"}


def test_private_nodes(spark):
    nodes = spark.createDataFrame([(1, "Y_DNA", "Q-Z1:n0", None), (2, "Y_DNA", "Q-Z2:n1", None), (3, "Y_DNA", "Q-M1", None), (4, "Y_DNA", "Q-Z4:n1", datetime.datetime(2020, 1, 1)), (5, "Y_DNA", "Z5:n0", None), (6, "Y_DNA", "Q-Z6", None)], "node_id long, dna_type string, name string, valid_until timestamp")
    sites = [(1, "M10", 100), (2, "M1", 101), (3, "M2", 102), (4, "M3", 103)]
    variants = spark.createDataFrame([(i, n, "chrY", p, "A", "G", b) for i, n, p, b in [(*s, None) for s in sites] + [(9, "M0", 100, 4)]], "id long, name string, contig string, position long, anc string, der string, branch_id long")
    links = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 3), (2, 4), (4, 1), (5, 1), (6, 1)], "node_id long, variant_id long")
    regions = spark.createDataFrame([("azf", "a", 100, 110), ("heterochromatin", "h", 103, 103)], "region_type string, label string, start_pos long, end_pos long")
    got = {r["node_id"]: (r["name"], r["was"]) for r in curation.name_private_nodes(nodes, links, variants, regions).collect()}
    # M1 is taken, M3 lies in a recurrent region, M0 belongs to a branch
    assert got == {1: ("Q-M2", "Q-Z1:n0"), 2: ("Q-Z2:n1", None), 3: ("Q-M1", None), 4: ("Q-Z4:n1", None), 5: ("M10", "Z5:n0"), 6: ("Q-Z6", None)}


def test_one_key_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [("k", s, s + rng.randint(1, 30)) for s in (rng.randrange(20000) for _ in range(1500))] + [("k", 5000, 9000), ("k", 5, 5), ("j", 1, 3), ("j", 3, 4), (None, 1, 2), ("j", None, 9)]
    want = []
    for k, s, e in sorted(r for r in rows if None not in r and r[2] > r[1]):
        if want and want[-1][0] == k and want[-1][2] >= s:
            want[-1][2] = max(want[-1][2], e)
        else:
            want.append([k, s, e])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        table = spark.createDataFrame(rows, "k string, s long, e long").repartition(5)
        assert sorted(list(r) for r in intervals.interval_merge(table).select("k", "s", "e").collect()) == want
        holes = spark.createDataFrame([("k", 0, 6000), ("k", 8000, 30000)], "k string, s long, e long")
        left = intervals.interval_subtract(table, holes).where("k = 'k'").collect()
        assert sum(r["e"] - r["s"] for r in left) == sum(max(0, min(e, 8000) - max(s, 6000)) for k, s, e in want if k == "k")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_what_automation_may_write(spark):
    stored = spark.createDataFrame([(1, "CONFIRMED", 5), (2, "CANDIDATE", 5), (3, None, 5), (4, "CANDIDATE", 5)], "k long, status string, score int")
    computed = spark.createDataFrame([(1, "CANDIDATE", 9), (2, "CANDIDATE", 9), (3, "CANDIDATE", 9), (7, "CANDIDATE", 9)], "k long, status string, score int")
    assert {tuple(r) for r in curation.uncurated_only(stored, computed, ["k"], ["CANDIDATE"]).collect()} == {(1, "CONFIRMED", 5), (2, "CANDIDATE", 9), (3, "CANDIDATE", 9), (4, "CANDIDATE", 5), (7, "CANDIDATE", 9)}
    have = spark.createDataFrame([("a", 1), (None, 2)], "sample string, file long")
    more = spark.createDataFrame([("a", 3), ("b", 4), ("b", 5), (None, 6)], "sample string, file long")
    assert {(r["sample"], r["file"], r["origin"]) for r in curation.ingest_if_absent(have, more, "sample").collect()} == {("a", 1, "STORED"), (None, 2, "STORED"), ("b", 4, "INGESTED"), ("b", 5, "INGESTED")}
    people_ = spark.createDataFrame([("x",), ("y",), (None,)], "subject string")
    assert {r[0] for r in curation.unlinked_subjects(people_, spark.createDataFrame([("x",), (None,)], "subject string")).collect()} == {"y", None}


def test_gap_fill_keeps_values_unique(spark):
    old = spark.createDataFrame([(1, "d1"), (2, None), (3, None), (4, None), (5, "d5")], "k long, doi string")
    new = spark.createDataFrame([(1, "zz"), (2, "d1"), (3, "d9"), (4, "d9"), (6, "d5"), (7, None)], "k long, doi string")
    assert {tuple(r) for r in similarity.merge_gap_fill(old, new, ["k"], "doi").collect()} == {(1, "d1"), (2, None), (3, "d9"), (4, None), (5, "d5"), (6, None), (7, None)}


def test_inbox_of_both_sides(spark):
    threads = spark.createDataFrame([(1, False, False, 5, 5), (2, None, None, None, None), (3, True, False, 1, 9), (4, False, True, 1, 1), (5, False, False, None, None), (6, False, False, 7, 7)], "conv_id long, closed boolean, deleted boolean, user_read long, team_read long")
    messages = spark.createDataFrame([(1, False, 3), (1, True, 6), (2, True, 1), (2, False, 2), (3, True, 2), (4, True, 2), (6, False, 7), (6, True, 7), (9, True, 1)], "conv_id long, from_team boolean, at long")
    got = {r["conv_id"]: tuple(r)[1:] for r in reports.thread_inbox(threads, messages).collect()}
    assert got == {1: ("replied", 2, 6, True, False), 2: ("open", 2, 2, True, True), 3: ("closed", 1, 2, True, False), 5: ("open", 0, None, False, False), 6: ("replied", 2, 7, False, False)}
