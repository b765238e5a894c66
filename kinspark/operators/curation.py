"""Curation: picks, re-pointing, folds of edits and nested reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from .tree import numbered

# Claim predicates that may be stored.
STORABLE = ["HAPLOGROUP_IS", "SAME_PERSON", "NOTE"]


def publish_linked_samples(samples: DataFrame, links: DataFrame) -> DataFrame:
    """is_public is set where any publication links a sample."""
    return samples.join(links.select("sample_id").distinct().withColumn("_l", F.lit(True)), "sample_id", "left").withColumn("is_public", F.coalesce("_l", F.lit(False)) | F.col("is_public")).drop("_l")


def storable_predicate(predicate: Column, cleared: Column, storable: list[str] | None = None) -> Column:
    """A known predicate; a NOTE only if it was cleared."""
    return predicate.isin(storable or STORABLE) & ((predicate != "NOTE") | F.coalesce(cleared, F.lit(False)))


def latest_publication(samples: DataFrame, publications: DataFrame) -> DataFrame:
    """Each sample's newest publication; those without a date come last."""
    best = publications.groupBy("sample_id").agg(F.max_by("publication", F.struct(F.col("published").isNotNull(), "published", "publication")).alias("publication"))
    return samples.select("sample_id").join(best, "sample_id", "left")


def tester_private_counts(private: DataFrame, callable_bp: DataFrame, floor: int) -> DataFrame:
    """Private SNPs and callable bases per (node, sample); samples below the floor drop out."""
    return private.groupBy("node_id", "sample_id").agg(F.countDistinct("variant_id").alias("snps")).join(callable_bp, "sample_id").where(F.col("bp") >= floor)


def sample_files(files: DataFrame) -> DataFrame:
    """Runs of each sample with their files in order, and the MD5 of the first that has one."""
    return files.groupBy("sample", "run").agg(F.array_sort(F.collect_list(F.struct("file", "kind", "checksum"))).alias("f")).select(
        "sample", "run", F.array_join(F.transform("f", lambda x: x["file"]), ",").alias("files"), F.get(F.filter("f", lambda x: x["kind"] == "MD5"), 0)["checksum"].alias("md5"))


def legacy_site_fold(rows: DataFrame) -> DataFrame:
    """(name, site, fold_id, rows, builds, owns_name, aliases) of rows (id, name, build, position).

    Positions of a name and build are its sites, in order; the same site of every build folds
    into one row with the least id.  The first site owns the name, later ones keep it as alias.
    """
    places = rows.select("name", "build", "position").distinct()
    site = places.withColumn("site", F.row_number().over(Window.partitionBy("name", "build").orderBy("position")))
    folded = rows.join(site, ["name", "build", "position"]).groupBy("name", "site").agg(
        F.min("id").alias("fold_id"), F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "build", "position"))), ",").alias("builds"))
    owns = F.col("site") == 1
    return folded.select("*", owns.alias("owns_name"), F.when(~owns, F.col("name")).alias("alias"))


def next_name(wanted: DataFrame, taken: int, key: str, prefix: str = "DU") -> DataFrame:
    """Names after the greatest taken number, in key order."""
    found = numbered(wanted, "_number", taken, key)
    return found.withColumn("new_name", F.concat(F.lit(prefix), F.lpad(F.col("_number").cast("string"), 5, "0"))).drop("_number")


def study_source(accession: Column) -> Column:
    up = F.upper(F.trim(accession))
    return F.when(up.rlike("^(PRJEB|ERP)"), "ENA").when(up.rlike("^(PRJNA|SRP)"), "NCBI").when(up.rlike("^(PRJDB|DRP)"), "DDBJ").when(up.startswith("EGA"), "EGA").otherwise("OTHER")


def normalize_external_ids(ids: Column) -> Column:
    """Trimmed, upper-cased (namespace, value) structs, empties out."""
    clean = F.transform(ids, lambda x: F.struct(F.upper(F.trim(x["namespace"])).alias("namespace"), F.upper(F.trim(x["value"])).alias("value")))
    return F.filter(clean, lambda x: (x["namespace"] != "") & (x["value"] != ""))


def merge_maps(base: Column, over: Column) -> Column:
    """Keys of both; `over` wins; null values go."""
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(over), k))
    return F.map_filter(F.map_concat(kept, over), lambda k, v: v.isNotNull())


def upsert_mirror(mirror: DataFrame, rows: DataFrame, key: str = "name") -> DataFrame:
    """The mirror after a file (column line): the last line of a name wins, names not in it stay."""
    both = mirror.withColumn("line", F.lit(-1).cast("long")).unionByName(rows)
    rest = [c for c in mirror.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), "line").alias("r")).select(key, "r.*")


def promote_candidates(candidates: DataFrame, publications: DataFrame) -> DataFrame:
    """Candidates reuse a publication of their work id, else of their DOI; others are inserted."""
    by_work = publications.where("work_id is not null").groupBy("work_id").agg(F.min("publication").alias("by_work"))
    by_doi = publications.where("doi is not null").groupBy("doi").agg(F.min("publication").alias("by_doi"))
    out = candidates.join(by_work, "work_id", "left").join(by_doi, "doi", "left").withColumn("publication", F.coalesce("by_work", "by_doi"))
    return out.select("candidate", "publication", F.when(F.col("publication").isNull(), "INSERT").otherwise("REUSE").alias("how"))


def points_under(closure: DataFrame, points: DataFrame) -> DataFrame:
    """Every clade's points (column terminal), without those at 0, 0."""
    real = points.where("not (lat = 0 and lon = 0)").withColumnRenamed("terminal", "descendant_id")
    return closure.join(real, "descendant_id").select(F.col("ancestor_id").alias("node_id"), "sample_id", "lat", "lon")


def replace_children(latest: DataFrame) -> DataFrame:
    """Identifiers of the latest parents only: (parent, identifier)."""
    return latest.select("parent", F.explode("identifiers").alias("identifier"))


def estimates_listing(estimates: DataFrame) -> DataFrame:
    """Estimates per node: COMBINED, SNP, GENEALOGICAL, then the rest by name."""
    rank = F.when(F.col("method") == "COMBINED", 0).when(F.col("method") == "SNP", 1).when(F.col("method") == "GENEALOGICAL", 2).otherwise(3)
    return estimates.withColumn("place", F.row_number().over(Window.partitionBy("node_id").orderBy(rank, "method")))


def identifier_pairs(samples: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, ta, tb, pa, pb) of samples (identifier, sample_id, terminal) that share an id, their terminals and the parents of those; a pair for each id and parent."""
    from .similarity import meet_in_tiles

    placed = samples.join(edges.select(F.col("child_id").alias("terminal"), "parent_id"), "terminal", "left")
    a, b = (placed.select("identifier", F.col("sample_id").alias(s), F.col("terminal").alias(f"t{s}"), F.col("parent_id").alias(f"p{s}")) for s in "ab")
    return meet_in_tiles(a, b, ["identifier"]).where("a < b").drop("identifier")


def identifier_adjudicate(p: DataFrame) -> DataFrame:
    """Pairs that share an id (`identifier_pairs`), by how their terminals (ta, tb) relate."""
    relation = (
        F.when(F.col("ta").isNull() | F.col("tb").isNull(), "NO_PLACEMENT").when(F.col("ta") == F.col("tb"), "SAME").when((F.col("pa") == F.col("tb")) | (F.col("pb") == F.col("ta")), "PARENT_CHILD").when(F.col("pa") == F.col("pb"), "SIBLING").otherwise("DISTANT")
    )
    out = p.withColumn("relation", relation)
    return out.select("a", "b", "relation", F.when(F.col("relation") == "NO_PLACEMENT", "UNPLACED").when(F.col("relation") == "DISTANT", "DISPUTED").otherwise("CONFIRMED").alias("disposition"), F.when(F.col("relation") == "NO_PLACEMENT", 0.60).when(F.col("relation") == "DISTANT", 0.50).otherwise(0.98).alias("score"))


def terminal_scores(samples: DataFrame, depth: DataFrame, half: float = 8.0) -> DataFrame:
    """(sample_id, terminal, score): (1 - n/N) d / (d + half), .01 at least, for terminals of two samples or more.

    n of all N samples have the terminal, d is its depth; one that the tree lacks counts as 3 deep.
    """
    n = samples.groupBy("terminal").agg(F.count("*").alias("_n")).where("_n > 1 and terminal is not null")
    total = samples.agg(F.count("*").alias("_total"))
    d = F.coalesce(F.col("depth"), F.lit(3)).cast("double")
    score = F.greatest((1 - F.col("_n") / F.col("_total")) * d / (d + half), F.lit(0.01))
    scored = n.join(depth.select(F.col("node_id").alias("terminal"), "depth"), "terminal", "left").crossJoin(F.broadcast(total)).select("terminal", score.alias("score"))
    return samples.select("sample_id", "terminal").join(scored, "terminal").select("sample_id", "terminal", "score")


def suggested_overlaps(shares: DataFrame, blocks: DataFrame, terminals: DataFrame, shared: DataFrame, least: float, most: int) -> DataFrame:
    """(a, b, score) of overlaps for `relative_suggestions`: those of `similarity.overlap_pairs` that can tell in the best `most` of any sample.

    A pair without a shared match is only among a sample's best if it is so by overlap and
    terminal alone, as other signals only add; pairs with one are all there.
    """
    from .similarity import best_overlap_pairs, population_overlap, rare_shares
    from .tree import cut_lineage

    shares = cut_lineage(shares)
    at = cut_lineage(rare_shares(shares, least).where("rare").join(blocks.select("sample_id", "block").dropna().distinct(), "sample_id").select("sample_id", "block", "population"))
    near = shared.select("a", "b").join(at.withColumnRenamed("sample_id", "a").hint("merge"), "a").join(at.withColumnRenamed("sample_id", "b").hint("merge"), ["b", "block", "population"]).select("a", "b")
    pairs = cut_lineage(best_overlap_pairs(shares, blocks, terminals, least, most, 0.4, 0.3).unionByName(near).distinct())
    return population_overlap(shares, pairs).where(F.round("overlap", 9) >= least).select("a", "b", F.col("overlap").alias("score"))


def relative_suggestions(overlaps: DataFrame, terminals: DataFrame, shared: DataFrame, dismissed: DataFrame, most: int = 50) -> DataFrame:
    """(a, b, score, primary, rank): the best `most` relatives b of each sample a; dismissed ones (a, b) are taken out after the cut.

    overlaps and shared: (a, b, score) once for a pair, weighted .4 and .3; terminals: (sample_id,
    terminal, score), one for a sample, weighted .3 for samples of one terminal.  primary is the
    strongest signal, ties in the order overlap, terminal, shared.

    Pairs that share nothing but a terminal all score alike, so ties decide by the lesser b: of
    those a sample needs its terminal's first `most` members, and one more for itself and for each
    relative that it has by another signal.  Only these are made, never all pairs of a terminal.
    """
    from .tree import cut_lineage

    signals = None
    for k, (df, weight) in enumerate(((overlaps, 0.4), (shared, 0.3))):
        one = df.select("a", "b", *[(F.col("score") * weight if k == at else F.lit(0.0)).alias(name) for at, name in enumerate(("p0", "p2"))])
        one = one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "p0", "p2"))
        signals = one if signals is None else signals.union(one)
    other = cut_lineage(signals.groupBy("a", "b").agg(F.sum("p0").alias("p0"), F.sum("p2").alias("p2")))
    partners = other.groupBy("a").agg(F.count("*").alias("m"))
    reach = most + 1 + (partners.agg(F.max("m")).first()[0] or 0)
    place = F.row_number().over(Window.partitionBy("terminal").orderBy("sample_id"))
    heads = terminals.select("terminal", F.col("sample_id").alias("b"), place.alias("place")).where(F.col("place") <= reach)
    seekers = terminals.select("terminal", "score", F.col("sample_id").alias("a")).join(partners, "a", "left").withColumn("need", most + 1 + F.coalesce("m", F.lit(0)))
    alone = seekers.join(heads, "terminal").where("place <= need and a <> b").select("a", "b").join(other, ["a", "b"], "left_anti").select("a", "b", F.lit(0.0).alias("p0"), F.lit(0.0).alias("p2"))
    at = terminals.select("sample_id", "terminal", "score")
    both = other.unionByName(alone).join(at.select(F.col("sample_id").alias("a"), F.col("terminal").alias("ta"), "score"), "a", "left").join(at.select(F.col("sample_id").alias("b"), F.col("terminal").alias("tb")), "b", "left")
    both = both.select("a", "b", "p0", F.when(F.col("ta") == F.col("tb"), F.col("score") * 0.3).otherwise(0.0).alias("p1"), "p2")
    p0, p1, p2 = (F.round(p, 9) for p in ("p0", "p1", "p2"))  # signals that differ in rounding alone are ties too
    primary = F.when(p0 >= F.greatest(p1, p2), "POPULATION_OVERLAP").when(p1 >= p2, "HAPLOGROUP").otherwise("SHARED_MATCH")
    w = Window.partitionBy("a").orderBy(F.desc(F.round("score", 9)), "b")  # sums that differ in rounding alone are ties
    ranked = both.select("a", "b", (F.col("p0") + F.col("p1") + F.col("p2")).alias("score"), primary.alias("primary")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.join(dismissed.select("a", "b"), ["a", "b"], "left_anti")


#: Nodes that one task settles at a time, and how many names of each it needs for that.
NAMING_BLOCK = 512


def natural_sort_pick(wishes: DataFrame, block: int = NAMING_BLOCK) -> DataFrame:
    """Each node's lowest name in natural order that no node of lower id takes: (node_id, name).

    A node whose first free name no lower open node wishes has it for certain; a round settles all
    of these at once.  Of the rest, the `block` lowest are walked in one task: each needs its
    first `block` free names only, as fewer lower ones can be before it.  So there are at most
    nodes / block rounds, and few where names are seldom shared.  Null names are left out; a node
    whose names are all taken has no row.
    """
    from .tree import cut_lineage

    w = Window.partitionBy("node_id").orderBy(dna.natural_key(F.col("name")), "name")
    left = cut_lineage(wishes.select("node_id", "name").where("name is not null").distinct().withColumn("k", F.row_number().over(w)))
    node, name = left.schema["node_id"].dataType.simpleString(), left.schema["name"].dataType.simpleString()

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        taken, got = set(), {}
        for n, x in rows.sort_values(["node_id", "k"])[["node_id", "name"]].itertuples(index=False):
            if n not in got and x not in taken:
                got[n] = x
                taken.add(x)
        return pd.DataFrame({"node_id": list(got), "name": list(got.values())})

    def without(settled: DataFrame) -> DataFrame:
        return cut_lineage(left.join(settled.select("node_id"), "node_id", "left_anti").join(settled.select("name"), "name", "left_anti"))

    settled = []
    while not left.isEmpty():
        first = left.groupBy("node_id").agg(F.min_by("name", "k").alias("name"))
        lowest = left.groupBy("name").agg(F.min("node_id").alias("node_id"))
        settled.append(cut_lineage(first.join(lowest, ["node_id", "name"])))
        left = without(settled[-1])
        lower = left.join(left.select("node_id").distinct().orderBy("node_id").limit(block), "node_id", "left_semi")
        near = lower.withColumn("k", F.row_number().over(Window.partitionBy("node_id").orderBy("k"))).where(F.col("k") <= block)
        settled.append(cut_lineage(near.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(walk, f"node_id {node}, name {name}")))
        left = without(settled[-1])
    out = left.select("node_id", "name")
    for one in settled:
        out = out.unionByName(one)
    return out


def str_reconstruct(motifs: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, marker, value): upwards the mode of a node's own and its children's values (the smaller of equals), then gaps from the parent.

    A round per level of the tree, each an equi-join on the edge and a grouped count, so no
    marker and no tree has to fit in one task.  A node without any edge keeps its own values.
    """
    from .tree import cut_lineage, node_depth, tree_closure

    parent = cut_lineage(edges.select("child_id", "parent_id").distinct())
    depth = cut_lineage(node_depth(tree_closure(edges)))
    deepest = depth.agg(F.max("depth")).first()[0] or 0
    own = cut_lineage(motifs.select("node_id", "marker", F.col("modal").alias("value")))  # each level reads it, and none makes it again
    up = None
    below = None
    for d in range(deepest, -1, -1):
        here = depth.where(F.col("depth") == d).select("node_id")
        votes = own.join(here, "node_id", "left_semi")
        if below is not None:
            votes = votes.union(below.withColumnRenamed("node_id", "child_id").join(parent, "child_id").select(F.col("parent_id").alias("node_id"), "marker", "value"))
        n = votes.groupBy("node_id", "marker", "value").agg(F.count("*").alias("n"))
        below = cut_lineage(n.groupBy("node_id", "marker").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value")))
        up = below if up is None else up.union(below)
    above, out = below, below
    for d in range(1, deepest + 1):
        here = depth.where(F.col("depth") == d).select("node_id")
        from_parent = here.join(parent, here["node_id"] == parent["child_id"]).select("node_id", "parent_id").join(above.select(F.col("node_id").alias("parent_id"), "marker", F.col("value").alias("given")), "parent_id").select("node_id", "marker", "given")
        mine = up.join(here, "node_id", "left_semi")
        above = cut_lineage(mine.join(from_parent, ["node_id", "marker"], "full_outer").select("node_id", "marker", F.coalesce("value", "given").alias("value")))
        out = out.union(above)
    return out.union(own.join(depth, "node_id", "left_anti"))


def sample_report(samples: DataFrame, coverage: DataFrame, placements: DataFrame) -> DataFrame:
    """One row per sample: identity, its call (placement before the original), runs and mean depth."""
    runs = coverage.groupBy("sample_id").agg(F.count("*").alias("runs"), F.avg("depth").alias("avg_depth"))
    return samples.join(placements.select("sample_id", "node_id"), "sample_id", "left").join(runs, "sample_id", "left").select(
        "sample_id", "source", F.coalesce(F.concat(F.lit("N"), "node_id"), "call_text").alias("call"), F.coalesce("runs", F.lit(0)).alias("runs"), "avg_depth")


def name_private_nodes(nodes: DataFrame, links: DataFrame, variants: DataFrame, regions: DataFrame) -> DataFrame:
    """Nodes (node_id, dna_type, name, valid_until) with new names, (..., was): current placeholders, which end in `:n` and a number.

    A placeholder takes the lowest candidate of `private_node_names`, in natural order, that no
    current node of its kind of DNA has and no placeholder of lower id takes, behind the letters
    before the first dash of its own name, if there is one (`Q-Z1:n0` becomes `Q-M5`).  was: its
    name before, to be kept as an alias; null for all that keep theirs.
    """
    from .catalog import private_node_names

    waiting = nodes.where("valid_until IS NULL").where(F.col("name").rlike(":n[0-9]+$")).select("node_id", "dna_type", "name")
    base = F.substring_index("name", ":", 1)
    clade = F.when(base.contains("-"), F.concat(F.substring_index(base, "-", 1), F.lit("-"))).otherwise("")
    kind = F.concat("dna_type", F.lit("/"))
    wishes = private_node_names(waiting.select("node_id"), links, variants, regions).join(waiting, "node_id").select("node_id", F.concat(kind, clade, "candidate").alias("name"))
    taken = nodes.where("valid_until IS NULL").select(F.concat(kind, "name").alias("name")).distinct()
    picked = natural_sort_pick(wishes.join(taken, "name", "left_anti")).select("node_id", F.col("name").alias("_new"))
    both = nodes.join(picked, "node_id", "left")
    new = F.expr("substring(_new, length(dna_type) + 2)")
    return both.select("node_id", "dna_type", F.coalesce(new, "name").alias("name"), "valid_until", F.when(F.col("_new").isNotNull(), F.col("name")).alias("was"))


def ingest_if_absent(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(..., origin): stored rows, and those new rows whose key nothing is stored for; all rows of such a key come in.  Null keys are not taken in."""
    fresh = rows.where(F.col(key).isNotNull()).join(stored.select(key).distinct(), key, "left_anti")
    return stored.withColumn("origin", F.lit("STORED")).unionByName(fresh.select(*stored.columns).withColumn("origin", F.lit("INGESTED")))


def uncurated_only(stored: DataFrame, computed: DataFrame, keys: list[str], owned: list[str]) -> DataFrame:
    """Stored rows (keys, status, ...) after the engine's: it writes new keys, and those whose status is one of its own.

    A row with any other status is a curator's decision and stays, whatever was computed; a null
    status is nobody's decision.  Stored rows that nothing was computed for stay too.
    """
    engine = F.coalesce(F.col("status").isin(owned), F.lit(True))
    decided = stored.where(~engine)
    written = computed.join(decided.select(*keys), keys, "left_anti").select(*stored.columns)
    untouched = stored.where(engine).join(computed.select(*keys), keys, "left_anti")
    return decided.unionByName(untouched).unionByName(written)


def unlinked_subjects(subjects: DataFrame, anchors: DataFrame) -> DataFrame:
    """Subjects (subject, ...) that no anchor (subject) names; a null subject has none."""
    return subjects.join(anchors.select("subject").distinct(), "subject", "left_anti")
