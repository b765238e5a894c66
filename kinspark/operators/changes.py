"""Proposed and reviewed changes of the tree: pooled proposals, promoted branches, merge plans, change sets, work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from .catalog import site_twin
from .tree import current_rows, numbered

#: Each piece of evidence adds this much confidence, up to the most.
STEP, MOST = 0.1, 0.99


def pool_proposals(events: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """(name, parent_id, evidence, confidence, samples) after submissions (name, parent_id, sample_id).

    Submissions of one name under one parent (null is a parent of its own) pool, also into open
    proposals (the same columns); each counts as evidence, and a sample is listed once.  Closed
    proposals are not given here, so their names open new ones.
    """
    one = events.select("name", "parent_id", F.lit(1).cast("long").alias("evidence"), F.array_compact(F.array("sample_id")).alias("samples"))
    if proposals is not None:
        one = one.unionByName(proposals.select("name", "parent_id", F.col("evidence").cast("long").alias("evidence"), "samples"))
    pooled = one.groupBy("name", "parent_id").agg(F.sum("evidence").alias("evidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("samples")))).alias("samples"))
    return pooled.select("name", "parent_id", "evidence", F.least(F.lit(MOST), STEP * F.col("evidence")).alias("confidence"), "samples")


def promote_branches(proposals: DataFrame, nodes: DataFrame, variants: DataFrame, contributors: DataFrame) -> dict[str, DataFrame]:
    """Accepted proposals as branches: tables node, edge, link, variant and contributor.

    proposals: (proposal_id, name, parent_id, status, evidence array of variant names); nodes:
    (node_id, name, dna_type); variants: (id, name); contributors: (proposal_id, sample_id).  A
    proposal needs a name, a parent and a name that its lineage doesn't have; of several with
    one name the first goes.  New nodes and variants are numbered after the greatest id, by
    proposal and by name.  Evidence names reuse a variant, the least id of equals.
    """
    parents = nodes.select(F.col("node_id").alias("parent_id"), "dna_type")
    able = proposals.where("status = 'ACCEPTED' and name <> ''").join(parents, "parent_id").join(nodes.select("name", "dna_type"), ["name", "dna_type"], "left_anti")
    first = able.groupBy("name", "dna_type").agg(F.min_by(F.struct("proposal_id", "parent_id", "evidence"), "proposal_id").alias("p")).select("name", "dna_type", "p.*")
    node = numbered(first, "node_id", nodes.agg(F.max("node_id")).first()[0] or 0, "proposal_id")
    named = node.select("node_id", F.explode(F.array_distinct("evidence")).alias("name")).where("name is not null")
    known = variants.where("name is not null").groupBy("name").agg(F.min("id").alias("id"))
    fresh = numbered(named.select("name").distinct().join(known, "name", "left_anti"), "id", variants.agg(F.max("id")).first()[0] or 0, "name")
    return {
        "node": node.select("node_id", "name", "dna_type", "proposal_id"),
        "edge": node.select(F.col("node_id").alias("child_id"), "parent_id"),
        "variant": fresh.select("id", "name"),
        "link": named.join(known.unionByName(fresh.select("name", "id")), "name").select("node_id", F.col("id").alias("variant_id")),
        "contributor": contributors.join(node.select("proposal_id", "node_id"), "proposal_id").select("proposal_id", "sample_id", "node_id", F.lit("PROMOTED").alias("status")),
    }


def merge_plan_to_changes(ops: DataFrame, variants: DataFrame) -> dict[str, DataFrame]:
    """A merge plan as a change set: tables change and variant (the variants that it mints).

    ops: (op_id, op, node_id, name, parent_id, parent_placeholder, add, remove), add and remove
    arrays of variant names.  CREATE takes a name, its variants and a parent (an id, or the
    placeholder of a node made by the same plan); REPARENT a parent; EDIT variants to add and
    remove; MATCH tells of an equal node and changes nothing.  Added names that the catalog
    lacks are minted after its greatest id; removed ones that it lacks are passed over.
    """
    real = ops.where(F.col("op").isin("CREATE", "REPARENT", "EDIT"))
    known = variants.where("name is not null").groupBy("name").agg(F.min("id").alias("id"))
    wanted = real.where("op <> 'REPARENT'").select("op_id", F.posexplode("add").alias("at", "name"))
    fresh = numbered(wanted.select("name").where("name is not null").distinct().join(known, "name", "left_anti"), "id", variants.agg(F.max("id")).first()[0] or 0, "name").select("name", "id")

    def ids(rows: DataFrame, catalog: DataFrame, name: str) -> DataFrame:
        placed = rows.join(catalog, "name").groupBy("op_id").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("x"))  # one op's variants
        return placed.select("op_id", F.transform("x", lambda v: v["id"]).alias(name))

    gone = real.where("op = 'EDIT'").select("op_id", F.posexplode("remove").alias("at", "name"))
    out = real.join(ids(wanted, known.unionByName(fresh), "add_ids"), "op_id", "left").join(ids(gone, known, "remove_ids"), "op_id", "left")
    kind = F.when(F.col("op") == "EDIT", "VARIANT_EDIT").otherwise(F.col("op"))
    none = F.array().cast("array<bigint>")
    change = out.select(
        "op_id", kind.alias("change_type"), F.when(F.col("op") != "CREATE", F.col("node_id")).alias("node_id"), F.when(F.col("op") == "CREATE", F.col("name")).alias("name"),
        F.when(F.col("op") != "EDIT", F.col("parent_id")).alias("parent_id"), F.when((F.col("op") != "EDIT") & F.col("parent_id").isNull(), F.col("parent_placeholder")).alias("parent_placeholder"),
        F.coalesce("add_ids", none).alias("add_ids"), F.coalesce("remove_ids", none).alias("remove_ids"))
    return {"change": change, "variant": fresh}


def change_set_diff(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(change_id, diff_type, name) of changes (change_id, change_type, node_id, new_name, status) that were not rejected."""
    kind = F.when(F.col("change_type") == "CREATE", "ADDED").when(F.col("change_type") == "DELETE", "REMOVED").when(F.col("change_type") == "REPARENT", "REPARENTED").otherwise("MODIFIED")
    rows = changes.where("status <> 'REJECTED'").join(nodes.select("node_id", "name"), "node_id", "left")
    return rows.select("change_id", kind.alias("diff_type"), F.coalesce("name", "new_name", F.lit("(unnamed)")).alias("name"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row of how many are added, removed, reparented and modified."""
    return diff.agg(*[F.count_if(F.col("diff_type") == k).alias(k.lower()) for k in ("ADDED", "REMOVED", "REPARENTED", "MODIFIED")])


def branch_covering_twin(variants: DataFrame, links: DataFrame) -> DataFrame:
    """(id, twin_id, twin_name, safe) of placeholders whose adoptable name is in use on a branch of theirs.

    variants: as for site_twin, with `aliases` (array) where known; links: (node_id,
    variant_id, valid_until).  The adoptable name is the first established alias, else the best
    site twin's.  Of several twins the least id is told.  safe: no branch has the placeholder as
    its only variant, so that it could be deleted.
    """
    live = current_rows(links).select("node_id", "variant_id").distinct()
    waiting = variants.where(dna.is_placeholder_name(F.col("name")))
    own = dna.established_name(F.col("aliases")) if "aliases" in variants.columns else F.lit(None).cast("string")
    twin = site_twin(variants).where("rank = 1").select("id", F.col("twin_name"))
    adoptable = waiting.select("id", own.alias("own")).join(twin, "id", "left").select("id", F.coalesce("own", "twin_name").alias("name")).where("name is not null")
    named = variants.where(~dna.is_placeholder_name(F.col("name"))).select(F.col("id").alias("twin_id"), "name")
    pairs = adoptable.join(named, "name").where("id <> twin_id")
    shared = pairs.join(live.select("node_id", F.col("variant_id").alias("id")), "id").join(live.select("node_id", F.col("variant_id").alias("twin_id")), ["node_id", "twin_id"])
    best = shared.groupBy("id", "name").agg(F.min("twin_id").alias("twin_id"))
    alone = live.groupBy("node_id").agg(F.count("*").alias("n"), F.min("variant_id").alias("id")).where("n = 1").select("id").distinct()
    return best.join(alone.withColumn("_last", F.lit(True)), "id", "left").select("id", "twin_id", F.col("name").alias("twin_name"), F.col("_last").isNull().alias("safe"))


def triage_queues(queues: dict[str, tuple[DataFrame, Column, list[Column]]], most: int = 100) -> DataFrame:
    """(queue, place, item) of the first `most` of each queue: its rows, what names an item, and its order."""
    out = None
    for name, (rows, item, order) in queues.items():
        top = rows.withColumn("_item", item.cast("string")).orderBy(*order, "_item").limit(most)  # so few rows have one place each in one task
        one = top.withColumn("place", F.row_number().over(Window.orderBy(*order, "_item"))).select(F.lit(name).alias("queue"), "place", F.col("_item").alias("item"))
        out = one if out is None else out.union(one)
    return out


def keep_most_complete(stored: DataFrame, imported: DataFrame) -> DataFrame:
    """Profiles (sample_id, marker, repeats) after an import, which replaces a sample's if it has as many markers at least."""
    both = stored.withColumn("_new", F.lit(False)).unionByName(imported.withColumn("_new", F.lit(True)))
    n = both.groupBy("sample_id").agg(F.count_if(F.col("_new")).alias("_in"), F.count_if(~F.col("_new")).alias("_had"))
    use = n.select("sample_id", ((F.col("_in") > 0) & (F.col("_in") >= F.col("_had"))).alias("_new"))
    return both.join(use, ["sample_id", "_new"]).select("sample_id", "marker", "repeats", F.when(F.col("_new"), "IMPORTED").otherwise("STORED").alias("origin"))
