"""A change set folded onto the tree's history: nodes, edges and links with valid_from and valid_until.

Changes take effect in the order of their ids, yet all at once: each table is folded by the last
events that touch a row, so that no change waits for another.  New nodes get their numbers by the
order of their changes; a placeholder stands for the last CREATE before the change that names it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tree import cut_lineage, numbered

VALUES = (
    "name string, haplogroup_type string, lineage string, source string, formed_ybp int, tmrca_ybp int, is_backbone boolean, placeholder long, parent_haplogroup_id long, parent_placeholder long, "
    "new_parent_haplogroup_id long, new_parent_placeholder long, variant_ids array<long>, `add` array<long>, `remove` array<long>"
)
FIELDS = ["name", "lineage", "source", "formed_ybp", "tmrca_ybp"]
TYPES = ["CREATE", "UPDATE", "DELETE", "REPARENT", "VARIANT_EDIT"]


def approved(changes: DataFrame) -> DataFrame:
    """Approved changes (change_id, change_type, node_id, v: the fields of new_values; null or broken JSON has none)."""
    return changes.where("status = 'APPROVED'").select("change_id", "change_type", F.col("node_id").cast("long").alias("node_id"), F.from_json(F.coalesce("new_values", F.lit("{}")), VALUES).alias("v"))


def _created(nodes: DataFrame, live: DataFrame, dna_type: str | None) -> DataFrame:
    """A row for each CREATE, numbered after the greatest node id."""
    rows = live.where("change_type = 'CREATE'").select("change_id", "v.*").withColumn("dna_type", F.coalesce("haplogroup_type", F.lit(dna_type)))
    return numbered(rows, "node_id", nodes.agg(F.max("node_id")).first()[0] or 0, "change_id")


def _settled(references: DataFrame, created: DataFrame) -> DataFrame:
    """References (change_id, placeholder) with the node that the placeholder's last CREATE before them made; null where there was none.

    CREATEs and references of a placeholder are walked together by change id in one window, so a
    placeholder that many changes name is not joined with all of its CREATEs.
    """
    made = created.where("placeholder IS NOT NULL").select("change_id", "placeholder", F.col("node_id").alias("made"), F.lit(1).alias("turn"))
    # a CREATE is there for later changes only: its own reference comes first
    both = made.unionByName(references.select("change_id", "placeholder", F.lit(None).cast("long").alias("made"), F.lit(0).alias("turn")))
    before = Window.partitionBy("placeholder").orderBy("change_id", "turn").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("settled", F.last("made", ignorenulls=True).over(before)).where("turn = 0").select("change_id", "settled")


def problems(nodes: DataFrame, changes: DataFrame, dna_type: str | None = None) -> DataFrame:
    """(change_id, problem) of approved changes that can't be applied.

    no_name, no_dna_type: a CREATE lacks it; no_node: another change lacks its node;
    unresolved_placeholder: no applied CREATE before it has that placeholder; unknown_parent: a
    parent id that no node has; name_taken: after all changes another node of the same kind of DNA has the name.
    """
    live = cut_lineage(approved(changes))
    return _problems(nodes, live, cut_lineage(_created(nodes, live, dna_type)))


def _problems(nodes: DataFrame, live: DataFrame, created: DataFrame) -> DataFrame:
    lacking = live.where(F.col("change_type").isin(TYPES)).select("change_id", F.when((F.col("change_type") == "CREATE") & F.col("v.name").isNull(), "no_name").when((F.col("change_type") != "CREATE") & F.col("node_id").isNull(), "no_node").alias("problem"))
    untyped = created.where("dna_type IS NULL").select("change_id", F.lit("no_dna_type").alias("problem"))
    wanted = _references(live)
    unresolved = _settled(wanted.where("placeholder IS NOT NULL"), created).where("settled IS NULL").select("change_id", F.lit("unresolved_placeholder").alias("problem"))
    known = nodes.select("node_id").union(created.select("node_id"))
    lost = wanted.where("placeholder IS NULL AND parent_id IS NOT NULL").select("change_id", F.col("parent_id").alias("node_id")).join(known, "node_id", "left_anti").select("change_id", F.lit("unknown_parent").alias("problem"))
    after = _folded_nodes(nodes, live, created, None)
    same = Window.partitionBy("name", "dna_type")
    touched = after.withColumn("others", F.count("*").over(same)).where("others > 1 AND last_change IS NOT NULL").select(F.col("last_change").alias("change_id"), F.lit("name_taken").alias("problem"))
    return lacking.where("problem IS NOT NULL").unionByName(untyped).unionByName(unresolved).unionByName(lost).unionByName(touched)


def _references(live: DataFrame) -> DataFrame:
    """(change_id, child_id, placeholder, parent_id) of every change that opens an edge; child_id is null for a CREATE."""
    create = live.where("change_type = 'CREATE'").select("change_id", F.lit(None).cast("long").alias("child_id"), F.col("v.parent_placeholder").alias("placeholder"), F.col("v.parent_haplogroup_id").alias("parent_id"))
    move = live.where("change_type = 'REPARENT'").select("change_id", F.col("node_id").alias("child_id"), F.col("v.new_parent_placeholder").alias("placeholder"), F.coalesce("v.new_parent_haplogroup_id", "v.parent_haplogroup_id").alias("parent_id"))
    return create.unionByName(move)


def _folded_nodes(nodes: DataFrame, live: DataFrame, created: DataFrame, at: str | None) -> DataFrame:
    """All nodes, old and new, after UPDATEs and DELETEs; last_change: what made or renamed it, if anything did."""
    when = F.lit(at).cast("timestamp")
    old = nodes.select("node_id", "dna_type", *FIELDS, "is_backbone", "valid_from", "valid_until", F.lit(None).cast("long").alias("made_by"))
    new = created.select("node_id", "dna_type", *FIELDS, F.coalesce("is_backbone", F.lit(False)).alias("is_backbone"), when.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"), F.col("change_id").cast("long").alias("made_by"))
    told = live.where("change_type IN ('UPDATE', 'DELETE')")
    last = [F.max_by(F.col(f"v.{f}"), F.when((F.col("change_type") == "UPDATE") & F.col(f"v.{f}").isNotNull(), F.col("change_id"))).alias(f"new_{f}") for f in FIELDS]
    renamed = F.max(F.when((F.col("change_type") == "UPDATE") & F.col("v.name").isNotNull(), F.col("change_id"))).alias("renamed")
    # a change that comes before the CREATE of its node finds no such node
    seen = told.join(created.select("node_id", F.col("change_id").alias("made_by")), "node_id", "left").where("made_by IS NULL OR change_id > made_by")
    fold = seen.groupBy("node_id").agg(*last, renamed, F.max(F.col("change_type") == "DELETE").alias("gone"))
    both = old.unionByName(new).join(fold, "node_id", "left")
    return both.select(
        "node_id", "dna_type", *[F.coalesce(f"new_{f}", f).alias(f) for f in FIELDS], "is_backbone", "valid_from",
        F.when(F.col("gone"), F.coalesce("valid_until", when)).otherwise(F.col("valid_until")).alias("valid_until"), F.coalesce("renamed", "made_by").alias("last_change"))


def _folded_edges(edges: DataFrame, live: DataFrame, created: DataFrame, at: str) -> DataFrame:
    when = F.lit(at).cast("timestamp")
    wanted = _references(live)
    settled = _settled(wanted.where("placeholder IS NOT NULL"), created)
    opened = wanted.join(settled, "change_id", "left").join(created.select("change_id", F.col("node_id").alias("new_child")), "change_id", "left")
    opened = opened.select("change_id", F.coalesce("child_id", "new_child").alias("child_id"), F.when(F.col("placeholder").isNotNull(), F.col("settled")).otherwise(F.col("parent_id")).alias("parent_id"), F.col("new_child").isNotNull().alias("creates"))
    opened = opened.where("NOT creates OR parent_id IS NOT NULL")  # a new root has no edge, one that is moved to the top has
    sources = live.select("change_id", F.col("v.source").alias("source"))
    new = opened.join(sources, "change_id").select("child_id", "parent_id", "source", when.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"), F.col("change_id").cast("long").alias("opened_by"))
    old = edges.select("child_id", "parent_id", "source", "valid_from", "valid_until", F.lit(None).cast("long").alias("opened_by"))
    # an edge ends with the first later change that moves or deletes its child or deletes its parent; all end at once, so the last one tells whether there is any
    ends = live.where("change_type IN ('DELETE', 'REPARENT')").groupBy("node_id").agg(F.max("change_id").alias("any"), F.max(F.when(F.col("change_type") == "DELETE", F.col("change_id"))).alias("deleted"))
    rows = old.unionByName(new).join(ends.select(F.col("node_id").alias("child_id"), F.col("any").alias("child_ends")), "child_id", "left").join(ends.select(F.col("node_id").alias("parent_id"), F.col("deleted").alias("parent_ends")), "parent_id", "left")
    last = F.greatest("child_ends", "parent_ends")  # of the two, nulls apart
    over = last.isNotNull() & (F.col("opened_by").isNull() | (last > F.col("opened_by")))
    return rows.select("child_id", "parent_id", "source", "valid_from", F.when(F.col("valid_until").isNull() & over, when).otherwise(F.col("valid_until")).alias("valid_until"))


def _folded_links(links: DataFrame, live: DataFrame, created: DataFrame, at: str) -> DataFrame:
    when = F.lit(at).cast("timestamp")
    none = F.lit(None).cast("timestamp")
    by_create = live.where("change_type = 'CREATE'").join(created.select("change_id", F.col("node_id").alias("made")), "change_id").select("change_id", F.col("made").alias("node_id"), F.explode("v.variant_ids").alias("variant_id"), F.lit(0).alias("turn"))
    edits = live.where("change_type = 'VARIANT_EDIT'")
    added = by_create.unionByName(edits.select("change_id", "node_id", F.explode("v.add").alias("variant_id"), F.lit(0).alias("turn"))).where("variant_id IS NOT NULL")
    removed = edits.select("change_id", "node_id", F.explode("v.remove").alias("variant_id"), F.lit(1).alias("turn")).where("variant_id IS NOT NULL")
    base = links.where("valid_until IS NULL").select("node_id", "variant_id", F.lit(-1).alias("turn"), F.lit(None).cast("long").alias("change_id"), "valid_from")
    pairs = base.select("node_id", "variant_id").union(added.select("node_id", "variant_id")).distinct()
    # a deleted node drops its links; one row for each DELETE of a node and each of its variants
    deleted = pairs.join(live.where("change_type = 'DELETE'").select("node_id", "change_id"), "node_id").select("change_id", "node_id", "variant_id", F.lit(1).alias("turn"))
    events = added.unionByName(removed).unionByName(deleted).withColumn("valid_from", none).unionByName(base)
    # nulls first: what was there before all changes; within a change, what it adds comes before what it removes
    order = Window.partitionBy("node_id", "variant_id").orderBy(F.asc_nulls_first("change_id"), "turn")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    walked = events.withColumns({"before": F.lag("turn").over(order), "ends": F.max(F.col("turn") == 1).over(after)})
    starts = walked.where("turn = -1 OR (turn = 0 AND (before IS NULL OR before = 1))")  # adding what is there does nothing
    now = starts.select("node_id", "variant_id", F.when(F.col("turn") == -1, F.col("valid_from")).otherwise(when).alias("valid_from"), F.when(F.col("ends"), when).alias("valid_until"))
    return links.where("valid_until IS NOT NULL").select("node_id", "variant_id", "valid_from", "valid_until").unionByName(now)


def apply_change_set(nodes: DataFrame, edges: DataFrame, links: DataFrame, changes: DataFrame, at: str, dna_type: str | None = None, status: str = "UNDER_REVIEW") -> dict[str, DataFrame]:
    """The tree's tables after the approved changes of a set.

    nodes: (node_id, dna_type, name, lineage, source, formed_ybp, tmrca_ybp, is_backbone,
    valid_from, valid_until); edges: (child_id, parent_id, source, valid_from, valid_until); links:
    (node_id, variant_id, valid_from, valid_until); changes: (change_id, change_type, node_id,
    status, new_values as JSON text).  CREATE adds a node, its edge unless it is a root, and its
    variants; UPDATE sets the fields that it names; DELETE ends the node, its edges and its links;
    REPARENT ends the edge to the parent and opens another; VARIANT_EDIT adds, then removes.  What
    opens and ends in one set keeps a row that ends when it begins.  Approved changes of other
    types are skipped; those not approved stay as they are.

    Returns node, edge, link, change (change_id, status) and result (created, updated, deleted,
    reparented, variant_edits, skipped).  Raises ValueError, and changes nothing, if the set is not
    in review or `problems` finds one.
    """
    if status not in ("UNDER_REVIEW", "READY_FOR_REVIEW"):
        raise ValueError(f"a change set that is {status} can't be applied")
    live = cut_lineage(approved(changes))
    created = cut_lineage(_created(nodes, live, dna_type))
    wrong = _problems(nodes, live, created).orderBy("change_id").limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"change {r['change_id']}: {r['problem']}" for r in wrong))
    count = {"created": "CREATE", "updated": "UPDATE", "deleted": "DELETE", "reparented": "REPARENT", "variant_edits": "VARIANT_EDIT"}
    return {
        "node": _folded_nodes(nodes, live, created, at).drop("last_change"),
        "edge": _folded_edges(edges, live, created, at),
        "link": _folded_links(links, live, created, at),
        "change": changes.select("change_id", F.when(F.col("status") == "APPROVED", "APPLIED").otherwise(F.col("status")).alias("status")),
        "result": live.agg(*[F.count_if(F.col("change_type") == t).alias(k) for k, t in count.items()], F.count_if(~F.coalesce(F.col("change_type").isin(TYPES), F.lit(False))).alias("skipped")),
    }
