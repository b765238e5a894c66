"""Variant catalog: matching, naming, folding and reconciling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from .intervals import recurrent_mask
from .tree import numbered


def with_site(variants: DataFrame) -> DataFrame:
    """Canonical contig and alleles as columns c and canon: with position they name a site."""
    return variants.withColumns({"c": dna.canonical_contig(F.col("contig")), "canon": dna.allele_canon(F.col("anc"), F.col("der"))})


def name_alias_match(mirror: DataFrame, variants: DataFrame) -> DataFrame:
    """(name, variant_id): upstream names equal to a variant's name or one of its aliases."""
    by_name = variants.select("name", F.col("id").alias("variant_id"))
    by_alias = variants.select(F.explode("aliases").alias("name"), F.col("id").alias("variant_id"))
    return mirror.select("name").distinct().join(by_name.union(by_alias).where("name is not null").distinct(), "name")


def coord_match(mirror: DataFrame, variants: DataFrame) -> DataFrame:
    """(name, variant_id) by contig, position and canonical alleles."""
    v = with_site(variants).select("c", "position", "canon", F.col("id").alias("variant_id"))
    return with_site(mirror).select("name", "c", "position", "canon").join(v, ["c", "position", "canon"]).select("name", "variant_id").distinct()


def site_twin(variants: DataFrame, most: int = 10) -> DataFrame:
    """Other named variants at each variant's site, by authority rank and name, up to `most`."""
    s = with_site(variants)
    other = s.where(~dna.is_placeholder_name(F.col("name"))).select("c", "position", "canon", F.col("id").alias("twin_id"), F.col("name").alias("twin_name"))
    pairs = s.select("id", "c", "position", "canon").join(other, ["c", "position", "canon"]).where("id <> twin_id")
    w = Window.partitionBy("id").orderBy(dna.name_rank(F.col("twin_name")), "twin_name", "twin_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("id", "twin_id", "twin_name", "rank")


def catalog_representatives(variants: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id, representative) of named rows: never beaten at a token (unscoped first, then authority rank, then id).

    tokens: (id, token), one for each build that places a row; rows without one stand alone.
    """
    named = variants.where("name is not null").select("id", F.struct(F.col("branch_id").isNotNull().alias("scoped"), dna.name_rank(F.col("name")).alias("rank"), F.col("id").alias("k")).alias("order"))
    placed = tokens.join(named, "id")
    best = placed.groupBy("token").agg(F.min("order").alias("best")).select("token", F.col("best.k").alias("first"))
    beaten = placed.join(best, "token").where("id <> first").select("id").distinct()
    return named.join(beaten.withColumn("_b", F.lit(True)), "id", "left").select("id", F.col("_b").isNull().alias("representative"))


def catalog_resolve(wanted: DataFrame, variants: DataFrame) -> DataFrame:
    """Each wanted site's variant, either polarity, named first then least id; without one a minted coordinate name."""
    key = F.array_sort(F.split("canon", ">"))
    best = with_site(variants).withColumn("alleles", key)
    w = Window.partitionBy("c", "position", "alleles").orderBy(dna.is_placeholder_name(F.col("name")), "id")
    best = best.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("c", "position", "alleles", F.col("id").alias("variant_id"), F.col("name").alias("known"))
    asked = with_site(wanted).withColumn("alleles", key)
    minted = F.concat("c", F.lit(":"), "position", F.lit(":"), "canon")
    return asked.join(best, ["c", "position", "alleles"], "left").select("id", "variant_id", F.coalesce("known", minted).alias("resolved"), F.when(F.col("variant_id").isNull(), "MINTED").otherwise("FOUND").alias("how"))


def catalog_reconcile(mirror: DataFrame, variants: DataFrame) -> DataFrame:
    """Clusters of mirror rows at a site: names by rank; create, enrich or flag by how many variants they match."""
    named = with_site(mirror).where("name is not null and position > 1")
    found = named.select("name", "c", "position", "canon").join(coord_match(mirror, variants).union(name_alias_match(mirror, variants)).distinct(), "name", "left")
    ranked = found.groupBy("c", "position", "canon").agg(
        F.array_sort(F.collect_set(F.struct(dna.name_rank(F.col("name")).alias("r"), "name"))).alias("names"), F.count_distinct("variant_id").alias("matches"))
    return ranked.select(
        "c", "position", "canon", F.array_join(F.transform("names", lambda x: x["name"]), ",").alias("names"), "matches",
        F.when(F.col("matches") > 1, "FLAG").when(F.col("matches") == 1, "ENRICH").when(F.element_at("names", 1)["r"] >= 90, "MINT").otherwise("CREATE").alias("action"))


def naming_queue(variants: DataFrame, mode: str = "needs_name", kind: str | None = None) -> DataFrame:
    """Variants that wait for a name: NAMED, PENDING_REVIEW, UNNAMED, all, or those that define a branch without a real name."""
    status = dna.naming_status(F.col("name"), F.col("naming_status"))
    rows = variants.withColumns({"status": status, "mutation": dna.mutation_type(F.col("anc"), F.col("der"))})
    if mode == "needs_name":
        rows = rows.where(F.col("branch_id").isNotNull() & (dna.is_placeholder_name(F.col("name")) | (F.col("status") == "PENDING_REVIEW")))
    elif mode != "all":
        rows = rows.where(F.col("status") == mode)
    return rows.where(F.col("mutation") == kind) if kind else rows


def adopt_names(variants: DataFrame) -> DataFrame:
    """Placeholders that take the best twin's name, unless (name, branch) is taken; one of each in a batch."""
    twin = site_twin(variants).where("rank = 1").select("id", F.col("twin_name").alias("new_name"))
    waiting = variants.where(dna.is_placeholder_name(F.col("name"))).join(twin, "id").withColumn("b", F.coalesce("branch_id", F.lit(-1)))
    taken = variants.where("name is not null").select(F.col("name").alias("new_name"), F.coalesce("branch_id", F.lit(-1)).alias("b"))
    free = waiting.join(taken, ["new_name", "b"], "left_anti")
    return free.groupBy("new_name", "b").agg(F.min("id").alias("id")).select("id", "new_name")


def mint_names(variants: DataFrame, prefix: str = "DU", first: int = 1) -> DataFrame:
    """A new name per site that has placeholders only and no branch twice, in site order."""
    sites = with_site(variants).groupBy("c", "position", "canon").agg(
        F.max((~dna.is_placeholder_name(F.col("name"))).cast("int")).alias("named"), F.count("branch_id").alias("scoped"), F.count_distinct("branch_id").alias("branches"), F.count("*").alias("rows"))
    novel = sites.where("named = 0 and scoped = branches").select("c", "position", "canon", "rows")
    found = numbered(novel, "_number", first - 1, "c", "position", "canon")
    return found.select("c", "position", "canon", "rows", F.concat(F.lit(prefix), F.lpad(F.col("_number").cast("string"), 5, "0")).alias("new_name"))


def alias_union(keep: DataFrame, drop: DataFrame) -> DataFrame:
    """(id, name, aliases): both alias lists without the canonical name, sorted."""
    both = keep.join(drop.select("id", F.col("aliases").alias("more"), F.col("name").alias("old")), "id")
    return both.select("id", "name", F.array_sort(F.array_except(F.array_union("aliases", F.array_union("more", F.array("old"))), F.array("name"))).alias("aliases"))


def private_node_names(nodes: DataFrame, links: DataFrame, variants: DataFrame, regions: DataFrame) -> DataFrame:
    """Candidate names of unnamed nodes: named catalog variants of no branch, outside recurrent regions, that sit on their defining sites, in natural order."""
    s = with_site(variants)
    named = recurrent_mask(s.where("branch_id IS NULL"), regions).where(~dna.is_placeholder_name(F.col("name")) & ~F.col("name").rlike("[ :]")).select("c", "position", "canon", F.col("name").alias("candidate"))
    sites = links.join(s.select(F.col("id").alias("variant_id"), "c", "position", "canon"), "variant_id").join(nodes, "node_id")
    return sites.join(named, ["c", "position", "canon"]).select("node_id", "candidate").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("node_id").orderBy(dna.natural_key(F.col("candidate")))))


def variant_branches(links: DataFrame, variants: DataFrame) -> DataFrame:
    """(variant id, branch) directly or through any row of the same site."""
    s = with_site(variants).select("id", "c", "position", "canon")
    on_site = s.select(F.col("id").alias("variant_id"), "c", "position", "canon").join(links.select("variant_id", "node_id").distinct(), "variant_id").drop("variant_id").distinct()
    return s.join(on_site, ["c", "position", "canon"]).select("id", "node_id").distinct()


def tree_full_links(nodes: DataFrame, links: DataFrame, variants: DataFrame) -> DataFrame:
    named = variants.where("name is not null").select(F.col("id").alias("variant_id"), F.col("name").alias("variant"), "anc", "der")
    return nodes.select("node_id").join(links, "node_id").join(named, "variant_id").select("node_id", "variant", "anc", "der").distinct()


def site_name_backfill(links: DataFrame) -> DataFrame:
    """Variants that define one branch get it; recurrent ones split into a row for each, with ids of their own."""
    n = Window.partitionBy("variant_id")
    rows = links.select("variant_id", "node_id").distinct().withColumns({"branches": F.count("*").over(n), "k": F.row_number().over(n.orderBy("node_id"))})
    return rows.select("variant_id", "node_id", F.when(F.col("branches") == 1, "SINGLE").otherwise("SPLIT").alias("how"), "k")


def mutation_counts(variants: DataFrame) -> DataFrame:
    return variants.groupBy(dna.mutation_type(F.col("anc"), F.col("der")).alias("mutation")).agg(F.count("*").alias("n"))
