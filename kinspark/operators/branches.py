"""Branches: private nodes, display names, published private variants, proposals and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from .clusters import cluster_variant_sets
from .curation import next_name
from .similarity import SLACK, repoint


def is_private_name(name: Column) -> Column:
    """Placeholder names end in `:n` and digits; labels that are a bare UUID name a private subject."""
    return F.coalesce(name.rlike(r":n[0-9]+\z") | is_uuid_label(name), F.lit(False))


def is_uuid_label(label: Column) -> Column:
    """36 letters: hexadecimal digits in groups of 8, 4, 4, 4 and 12 between dashes."""
    return label.rlike(r"\A[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\z")


def private_placeholder_filter(nodes: DataFrame, closure: DataFrame, samples: DataFrame) -> DataFrame:
    """(node_id, parent_id, samples): kept nodes under their nearest kept ancestor, with the samples re-homed there.

    A private node without a kept ancestor takes its samples with it; a null name is kept.
    Samples whose label (column `label`, where there is one) is a bare UUID are hidden: they count nowhere.
    """
    if "label" in samples.columns:
        samples = samples.where(~F.coalesce(is_uuid_label(F.col("label")), F.lit(False)))
    kept = nodes.where(~is_private_name(F.col("name"))).select("node_id")
    above = closure.join(kept.withColumnRenamed("node_id", "ancestor_id"), "ancestor_id")
    parent = above.where("distance > 0").groupBy(F.col("descendant_id").alias("node_id")).agg(F.min_by("ancestor_id", "distance").alias("parent_id"))
    home = above.groupBy(F.col("descendant_id").alias("terminal")).agg(F.min_by("ancestor_id", "distance").alias("node_id"))
    held = samples.groupBy("terminal").agg(F.count("*").alias("n")).join(home, "terminal").groupBy("node_id").agg(F.sum("n").alias("samples"))
    return kept.join(parent, "node_id", "left").join(held, "node_id", "left").select("node_id", "parent_id", F.coalesce("samples", F.lit(0)).alias("samples"))


def allele_set(anc: Column, der: Column) -> Column:
    """Key of two alleles in any order, on either strand."""
    a, d = dna.expand_repeat(anc), dna.expand_repeat(der)
    one, other = F.array_sort(F.array(a, d)), F.array_sort(F.array(dna.revcomp(a), dna.revcomp(d)))
    return F.least(F.array_join(one, "/"), F.array_join(other, "/"))


def node_display_snps(links: DataFrame, variants: DataFrame) -> DataFrame:
    """(node_id, variant_id, name, recurrent): a placeholder name is replaced by the best real name at its site with the same alleles."""
    keyed = variants.select("id", "name", "position", dna.canonical_contig(F.col("contig")).alias("contig"), allele_set(F.col("anc"), F.col("der")).alias("alleles"))
    real = keyed.where(~dna.is_placeholder_name(F.col("name")))
    best = real.groupBy("contig", "position", "alleles").agg(F.min_by("name", F.struct(dna.name_rank(F.col("name")), "name")).alias("twin"))
    named = keyed.join(best, ["contig", "position", "alleles"], "left").select(F.col("id").alias("variant_id"), F.when(dna.is_placeholder_name(F.col("name")), F.col("twin")).otherwise(F.col("name")).alias("name"))
    nodes = links.groupBy("variant_id").agg((F.countDistinct("node_id") > 1).alias("recurrent"))
    return links.select("node_id", "variant_id").distinct().join(named, "variant_id").join(nodes, "variant_id").select("node_id", "variant_id", "name", "recurrent")


def campaign_stats(cohort: DataFrame) -> DataFrame:
    """Cohort size and acceptances of each campaign, from (campaign, donor_id, accepted)."""
    return cohort.groupBy("campaign").agg(F.countDistinct("donor_id").alias("cohort"), F.countDistinct(F.when(F.col("accepted"), F.col("donor_id"))).alias("accepted"))


def seed_anchors(anchors: DataFrame, seeds: DataFrame, nodes: DataFrame, source: str) -> DataFrame:
    """(node_id, source, ybp, sigma): a source's anchors replaced by its seeds (name, lo, hi) that name a current node."""
    found = seeds.join(nodes.where("valid_until is null").select("node_id", "name"), "name")
    fresh = found.select("node_id", F.lit(source).alias("source"), ((F.col("lo") + F.col("hi")) / 2).cast("double").alias("ybp"), ((F.col("hi") - F.col("lo")) / (2 * 1.96)).alias("sigma"))
    return anchors.where(F.col("source") != source).select("node_id", "source", "ybp", "sigma").union(fresh)


def merge_variants(variants: DataFrame, links: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, aliases, links): survivors with the names of what was merged into them (mapping old, new) and the links of both, each once."""
    names = repoint(variants.select("id", "name"), "id", mapping).groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("aliases"))  # nulls are not collected
    moved = repoint(links, "variant_id", mapping, ["node_id", "variant_id"]).groupBy(F.col("variant_id").alias("id")).agg(F.count("*").alias("links"))
    return names.join(moved, "id", "left").select("id", "aliases", F.coalesce("links", F.lit(0)).alias("links"))


def merge_subjects(subjects: DataFrame, memberships: DataFrame, mapping: DataFrame, key: str = "sample_id") -> DataFrame:
    """Every subject, ACTIVE or MERGED with its survivor, and how many memberships it has afterwards; colliding ones count once."""
    rest = [c for c in memberships.columns if c != key]
    held = repoint(memberships, key, mapping, [key, *rest]).groupBy(key).agg(F.count("*").alias("memberships"))
    out = subjects.select(key).join(mapping.select(F.col("old").alias(key), F.col("new").alias("merged_into")), key, "left").join(held, key, "left")
    return out.select(key, F.when(F.col("merged_into").isNull(), "ACTIVE").otherwise("MERGED").alias("status"), "merged_into", F.coalesce("memberships", F.lit(0)).alias("memberships"))


def anchor_subjects(subjects: DataFrame, linked: DataFrame, owners: DataFrame, taken: int = 0) -> DataFrame:
    """(did, identifier, donor, how, owner): a new donor per unlinked did; identifiers that someone owns make a duplicate pair."""
    fresh = subjects.join(linked.select("did").distinct(), "did", "left_anti")
    donors = next_name(fresh.select("did").distinct(), taken, "did", "S").withColumnRenamed("new_name", "donor")
    held = owners.groupBy("identifier").agg(F.min("owner").alias("owner"))
    out = fresh.select("did", "identifier").distinct().join(donors, "did").join(held, "identifier", "left")
    return out.select("did", "identifier", "donor", F.when(F.col("owner").isNull(), "REGISTERED").otherwise("DUPLICATE").alias("how"), "owner")


def materialize_private(published: DataFrame, variants: DataFrame, nodes: DataFrame, existing: DataFrame) -> DataFrame:
    """(sample_id, variant, node_id, status) from published (sample_id, terminal, name, contig, position, anc, der).

    A variant is found by name, else by site and alleles, else it is new (its key is then its
    site).  Decided rows (INVALIDATED, PROMOTED) keep their status, and stay when nothing
    publishes them; ACTIVE rows of the mirror that nothing publishes go.
    """
    site = [dna.canonical_contig(F.col("contig")).alias("contig"), "position", dna.allele_canon(F.col("anc"), F.col("der")).alias("canon")]
    named = variants.where("name is not null").groupBy("name").agg(F.min("id").alias("by_name"))
    placed = variants.select("id", *site).groupBy("contig", "position", "canon").agg(F.min("id").alias("by_site"))
    rows = published.select("sample_id", "terminal", "name", *site).join(named, "name", "left").join(placed, ["contig", "position", "canon"], "left")
    minted = F.concat_ws(":", "contig", F.col("position").cast("string"), "canon")
    found = rows.select("sample_id", "terminal", F.coalesce(F.col("by_name").cast("string"), F.col("by_site").cast("string"), minted).alias("variant"))
    parts = int(published.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number, since rows that compress well would be put into few tasks
    at = found.join(nodes.select("node_id", F.col("name").alias("terminal")), "terminal", "left").select("sample_id", "variant", "node_id")
    wanted = at.repartition(parts, "sample_id", "variant").groupBy("sample_id", "variant").agg(F.min("node_id").alias("node_id"))
    kept = existing.select("sample_id", "variant", F.col("node_id").alias("old_node"), F.col("status").alias("old"), "origin")
    both = wanted.withColumn("published", F.lit(True)).join(kept, ["sample_id", "variant"], "full_outer")
    decided = F.col("old").isin("INVALIDATED", "PROMOTED")
    stays = F.col("published").isNotNull() | decided | (F.col("origin") != "mirror")
    return both.where(stays).select("sample_id", "variant", F.coalesce("node_id", "old_node").alias("node_id"), F.when(decided, F.col("old")).otherwise("ACTIVE").alias("status"))


def branch_consensus(sets: DataFrame, reliability: DataFrame, submitters: DataFrame, least: int = 3, ready: float = 0.95, floor: float = 0.5, accept: int | None = None) -> DataFrame:
    """Proposals of branches below a terminal: clusters of at least `least` reliable samples, scored.

    sets: (terminal, sample_id, variant_id); reliability: (sample_id, confidence, compatibility),
    at most one row a sample; submitters: (sample_id, did).  A sample without reliability counts
    in full.  Clusters of `accept` samples or more, all alike, are accepted at once.
    """
    bad = reliability.where((F.col("compatibility") == "INCOMPATIBLE") | (F.col("confidence") < floor)).select("sample_id")
    found = cluster_variant_sets(sets.join(bad, "sample_id", "left_anti"))
    clusters = found.summary.where(F.col("members") >= least)
    members = found.members.join(clusters.select("terminal", "seed"), ["terminal", "seed"], "left_semi").join(reliability, "sample_id", "left").join(submitters, "sample_id", "left")
    score = members.groupBy("terminal", "seed").agg(F.avg(F.coalesce("confidence", F.lit(1.0))).alias("reliable"), F.countDistinct("did").alias("dids"))
    out = clusters.join(score, ["terminal", "seed"]).withColumn("submitters", F.greatest("dids", F.col("members").cast("long")))
    count, sent = F.least(F.col("members") / least, F.lit(1.0)), F.least(F.col("submitters") / least, F.lit(1.0))
    out = out.withColumn("confidence", F.least(0.35 * count + 0.2 * sent + 0.25 * F.col("consistency") + 0.2 * F.col("reliable"), F.lit(1.0)))
    sure = F.col("confidence") >= ready - SLACK  # the order of a sum decides nothing
    accepted = F.lit(False) if accept is None else (F.col("members") >= accept) & sure & (F.col("consistency") >= 0.999)
    status = F.when(accepted, "ACCEPTED").when(F.col("split"), "SPLIT_CANDIDATE").when(sure, "READY_FOR_REVIEW").otherwise("PROPOSED")
    key = F.md5(F.array_join(F.transform("variant_ids", lambda v: v.cast("string")), ","))
    return out.select("terminal", key.alias("cluster_key"), F.col("members").alias("evidence"), "submitters", "confidence", status.alias("status"))


def suggestions_for_owner(suggestions: DataFrame, owners: DataFrame, decided: DataFrame) -> DataFrame:
    """(owner, sample_id, other_id, score, purpose, rank): undecided suggestions (a, b, score, signal) of each owner's samples, best first."""
    both = suggestions.join(decided.select("a", "b").distinct(), ["a", "b"], "left_anti")
    mine = both.select(F.col("a").alias("sample_id"), F.col("b").alias("other_id"), "score", "signal").union(both.select("b", "a", "score", "signal"))
    purpose = F.when(F.col("signal") == "HAPLOGROUP", "LINEAGE").when(F.col("signal") == "SHARED_MATCH", "TRIANGULATION").otherwise("ANCESTRY")
    w = Window.partitionBy("owner").orderBy(F.desc("score"), "sample_id", "other_id")
    return mine.join(owners.select("sample_id", "owner"), "sample_id").select("owner", "sample_id", "other_id", "score", purpose.alias("purpose"), F.row_number().over(w).alias("rank"))
