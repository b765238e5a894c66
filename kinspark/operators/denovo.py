"""Trees that come as documents: nodes, edges, links and tips of a lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna, scalars
from .tree import cut_lineage, numbered

SITE = ["contig", "position", "anc", "der"]


def refuse_unlifted(catalog: DataFrame) -> None:
    """An error while named variants of the catalog lack a position: their names would be minted anew."""
    n = catalog.where(~dna.is_placeholder_name(F.col("name")) & F.col("position").isNull()).count()
    if n:
        raise ValueError(f"{n} named variants have no position: lift them before a tree is loaded")


def load_tree(document: dict[str, DataFrame], catalog: DataFrame, first_node: int = 0, keep_private: bool = False) -> dict[str, DataFrame]:
    """A tree document as tables node, edge, link, tip, private and variant.

    document: node (id, label, support), edge (parent_id, child_id), link (id, contig, position,
    anc, der), tip (id, tip); catalog: (id, name, contig, position, anc, der).

    A leaf with a single tip and no public name (no label, or the tip's own) is private: it is
    no node, its tip hangs on its parent and its variants are the sample's own.  Variants are the
    catalog's of that site (the least id), or minted after its greatest.  A node is called by
    its label, else by the named variant of its first position, else by its id; of equal names
    the first keeps it, labelled nodes before others and then by id, and the rest have their id
    put behind.  Nodes are numbered after `first_node` by id.
    """
    refuse_unlifted(catalog)
    nodes, edges, tips = (cut_lineage(document[k]) for k in ("node", "edge", "tip"))
    sites = catalog.where("position is not null").groupBy(*SITE).agg(F.min_by(F.struct("id", "name"), "id").alias("v")).select(*SITE, "v.*")
    asked = cut_lineage(document["link"].select(F.col("id").alias("node"), *SITE).distinct())
    fresh = numbered(asked.select(*SITE).distinct().join(sites, SITE, "left_anti"), "id", catalog.agg(F.max("id")).first()[0] or 0, *SITE)
    fresh = fresh.select(*SITE, "id", F.lit(None).cast("string").alias("name"))
    links = cut_lineage(asked.join(sites.unionByName(fresh), SITE).select("node", "position", F.col("id").alias("variant_id"), "name"))

    held = tips.groupBy("id").agg(F.count("*").alias("tips"), F.min("tip").alias("one"))
    inner = edges.select(F.col("parent_id").alias("id")).distinct().withColumn("inner", F.lit(True))
    about = nodes.join(held, "id", "left").join(inner, "id", "left")
    hidden = F.col("inner").isNull() & (F.col("tips") == 1) & (F.col("label").isNull() | (F.col("label") == F.col("one")))
    snp = links.where(~dna.is_placeholder_name(F.col("name"))).groupBy(F.col("node").alias("id")).agg(F.min_by("name", F.struct("position", "name")).alias("snp"))
    about = about.join(snp, "id", "left").select("id", "label", "support", F.coalesce("label", "snp", "id").alias("base"), (F.lit(not keep_private) & F.coalesce(hidden, F.lit(False))).alias("private"))
    about = cut_lineage(about)
    first = about.groupBy("base").agg(F.min(F.struct(F.col("label").isNull().alias("bare"), "id")).alias("f")).select("base", F.col("f.id").alias("keeper"))
    named = about.join(first, "base").withColumn("name", F.when(F.col("id") == F.col("keeper"), F.col("base")).otherwise(F.concat("base", F.lit(" ["), "id", F.lit("]"))))
    public = numbered(named.where("not private"), "node_id", first_node, "id")
    ids = public.select("id", "node_id")
    parent = edges.select(F.col("child_id").alias("id"), F.col("parent_id").alias("above"))
    # a tip of a private leaf hangs on the parent, of which it is then a direct sample
    seat = about.select("id", "private").join(parent, "id", "left").select("id", F.when(F.col("private"), F.col("above")).otherwise(F.col("id")).alias("at"), "private")
    seated = tips.join(seat, "id")
    own = links.withColumnRenamed("node", "id").join(seated.where("private").select("id", "tip", "at"), "id")
    return {
        "node": public.select("node_id", "id", "name", scalars.support_bucket(F.col("support")).alias("support")),
        "edge": parent.join(ids, "id").join(ids.select(F.col("id").alias("above"), F.col("node_id").alias("parent_id")), "above").select(F.col("node_id").alias("child_id"), "parent_id"),
        "link": links.withColumnRenamed("node", "id").join(ids, "id").select("node_id", "variant_id"),
        "tip": seated.join(ids.select(F.col("id").alias("at"), "node_id"), "at", "left").select("tip", "node_id", "private"),
        "private": own.join(ids.select(F.col("id").alias("at"), "node_id"), "at", "left").select("tip", "variant_id", "node_id"),
        "variant": fresh.select("id", *SITE),
    }
