"""Trees by enter and exit numbers: an Euler tour ranked by jumping, and what range prefix sums then answer.

A tour goes down and up every edge once.  Each of its arcs knows the arc before it; how many arcs
down lie before an arc is its rank.  Rulers, a share of the arcs drawn by hash, cut the tour into
short pieces: pointers jump only until they meet a ruler, the rulers alone make a shorter list,
and so on, until a list fits one task.  A node's subtree is then the nodes of its tree that enter
between its enter and exit, so nothing holds a row for each node and ancestor.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tree import current_rows, cut_lineage, numbered

#: Arcs that one task ranks by itself (some 100 bytes each), and one ruler among how many arcs.
SMALL, SPACING = 1 << 20, 64

LIST = "arc long, before long, root long, down long, level long"


def _jump(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranks of a list that is whole: sums of the weights from each chain's head on; arcs of cycles go."""
    rows = pd.concat([*frames, pd.DataFrame({n: pd.Series(dtype="float64" if n in ("before", "root") else "int64") for n in ("arc", "before", "root", "down", "level")})])
    if not len(rows):
        return
    arc = rows["arc"].to_numpy(dtype=np.int64)
    order = np.argsort(arc)
    arc, rows = arc[order], rows.iloc[order]
    head = rows["before"].isna().to_numpy()
    at = np.searchsorted(arc, rows["before"].fillna(0).to_numpy(dtype=np.int64)).clip(0, len(arc) - 1)
    at[head] = np.flatnonzero(head)
    down, level = rows["down"].to_numpy(dtype=np.int64).copy(), rows["level"].to_numpy(dtype=np.int64).copy()
    first = np.where(head, rows["root"].fillna(0).to_numpy(dtype=np.int64), 0)
    own_down, own_level = down.copy(), level.copy()
    own_down[head] = own_level[head] = 0  # a head points at itself and must count once
    for _ in range(int(len(arc)).bit_length() + 1):
        own_down, own_level = own_down + np.where(at == at[at], 0, own_down[at]), own_level + np.where(at == at[at], 0, own_level[at])
        at = at[at]
    ends = head[at]
    top = at[ends]
    yield pd.DataFrame({"arc": arc[ends], "root": first[top], "down": own_down[ends] + down[top], "level": own_level[ends] + level[top]})


def ranked(arcs: DataFrame, small: int = SMALL, spacing: int = SPACING, turn: int = 0) -> DataFrame:
    """(arc, root, down, level) of a list (arc, before, root, down, level): sums from the head, whose before is null and whose root names the list.

    Arcs on a cycle have no head and get no row.  Heads are done at once, so many short lists
    don't keep the rest from shrinking; each turn draws its rulers anew.
    """
    heads = arcs.where("before IS NULL").select("arc", "root", "down", "level")
    rest = arcs.where("before IS NOT NULL")
    size = rest.count()
    if size <= small:
        return cut_lineage(heads.unionByName(_after_heads(rest, heads).coalesce(1).mapInPandas(_jump, "arc long, root long, down long, level long")))
    marked = cut_lineage(rest.withColumn("ruler", F.pmod(F.xxhash64("arc", F.lit(turn)), F.lit(spacing)) == 0))
    stops = cut_lineage(marked.where("ruler").select(F.col("arc").alias("at"), F.lit(True).alias("met")).union(heads.select("arc", F.lit(True))))
    # of other arcs: where they point to, and the weights from there (not counted) up to themselves
    todo = marked.where("NOT ruler").select("arc", F.col("before").alias("at"), "down", "level")
    settled = marked.where("FALSE").select("arc", F.col("before").alias("at"), "down", "level")
    for _ in range(size.bit_length() + 1):
        both = cut_lineage(todo.join(stops, "at", "left").select("arc", "at", "down", "level", F.coalesce("met", F.lit(False)).alias("met")))
        settled, open_ = settled.unionByName(both.where("met").drop("met")), both.where("NOT met").drop("met")
        if open_.isEmpty():
            break
        # whoever points at an arc goes on to where that one points
        step = settled.unionByName(open_).select(F.col("arc").alias("at"), F.col("at").alias("next"), F.col("down").alias("d"), F.col("level").alias("l"))
        todo = open_.join(step, "at").select("arc", F.col("next").alias("at"), (F.col("down") + F.col("d")).alias("down"), (F.col("level") + F.col("l")).alias("level"))
    settled = cut_lineage(settled)
    # a ruler's own piece reaches back to the stop before it
    back = marked.where("ruler").drop("ruler").join(settled.select(F.col("arc").alias("before"), F.col("at").alias("_at"), F.col("down").alias("_d"), F.col("level").alias("_l")), "before", "left")
    short = back.select("arc", F.coalesce("_at", "before").alias("before"), "root", (F.col("down") + F.coalesce("_d", F.lit(0))).alias("down"), (F.col("level") + F.coalesce("_l", F.lit(0))).alias("level"))
    top = heads.unionByName(ranked(cut_lineage(_after_heads(short, heads)), small, spacing, turn + 1))
    others = settled.join(top.select(F.col("arc").alias("at"), "root", F.col("down").alias("_d"), F.col("level").alias("_l")), "at")
    return cut_lineage(top.unionByName(others.select("arc", "root", (F.col("down") + F.col("_d")).alias("down"), (F.col("level") + F.col("_l")).alias("level"))))


def _after_heads(rest: DataFrame, heads: DataFrame) -> DataFrame:
    """The list without its heads: arcs right after one are heads now, and hold its weights."""
    known = heads.select(F.col("arc").alias("before"), F.col("root").alias("_root"), F.col("down").alias("_d"), F.col("level").alias("_l"))
    met = F.col("_root").isNotNull()
    return rest.join(known, "before", "left").select("arc", F.when(~met, F.col("before")).alias("before"), F.coalesce("_root", "root").alias("root"), (F.col("down") + F.coalesce("_d", F.lit(0))).alias("down"), (F.col("level") + F.coalesce("_l", F.lit(0))).alias("level"))


def tree_numbers(edges: DataFrame, nodes: DataFrame | None = None, small: int = SMALL, spacing: int = SPACING) -> DataFrame:
    """(node_id, root_id, enter, exit, depth) of every node, children in the order of their ids.

    enter counts from 0 at the root of each tree; the nodes of a subtree are those of its root_id
    that enter from its root's enter up to its exit.  Of several current parents the least counts,
    an edge of a node to itself doesn't.  Nodes on a cycle or below one have no row.  Without
    `nodes` those of the edges are numbered; nodes without an edge are trees of their own.
    """
    current = current_rows(edges).where("child_id IS NOT NULL AND parent_id IS NOT NULL AND child_id <> parent_id")
    one = current.groupBy(F.col("child_id").cast("long").alias("child_id")).agg(F.min("parent_id").cast("long").alias("parent_id"))
    rows = cut_lineage(numbered(one, "k", -1, "parent_id", "child_id"))  # an edge's arcs are 2k down and 2k+1 up
    ends = rows.groupBy("parent_id").agg(F.max("k").alias("last"))
    mine = rows.select(F.col("child_id").alias("parent_id"), F.col("k").alias("up_k"))
    earlier = rows.select((F.col("k") + 1).alias("k"), F.col("parent_id").alias("left_parent"))
    linked = rows.join(mine, "parent_id", "left").join(earlier, "k", "left").join(ends.select(F.col("parent_id").alias("child_id"), "last"), "child_id", "left")
    linked = cut_lineage(linked.withColumn("elder", F.col("left_parent") == F.col("parent_id")))
    before_down = F.when(F.col("elder"), 2 * (F.col("k") - 1) + 1).otherwise(2 * F.col("up_k"))  # null at a tree's first arc
    down = linked.select((2 * F.col("k")).alias("arc"), before_down.alias("before"), F.when(before_down.isNull(), F.col("parent_id")).alias("root"), F.lit(1).cast("long").alias("down"), F.lit(1).cast("long").alias("level"))
    up = linked.select((2 * F.col("k") + 1).alias("arc"), F.coalesce(2 * F.col("last") + 1, 2 * F.col("k")).alias("before"), F.lit(None).cast("long").alias("root"), F.lit(0).cast("long").alias("down"), F.lit(-1).cast("long").alias("level"))
    rank = ranked(cut_lineage(down.unionByName(up)), small, spacing)
    k = F.shiftright("arc", 1)
    both = rank.groupBy(k.alias("k")).agg(F.max("root").alias("root_id"), F.max(F.when(F.col("arc") % 2 == 0, F.col("down"))).alias("enter"), F.max(F.when(F.col("arc") % 2 == 1, F.col("down"))).alias("exit"), F.max(F.when(F.col("arc") % 2 == 0, F.col("level"))).alias("depth"))
    inner = rows.select("k", F.col("child_id").alias("node_id")).join(both, "k").select("node_id", "root_id", "enter", "exit", "depth")
    zero = F.lit(0).cast("long")
    roots = inner.groupBy(F.col("root_id").alias("node_id")).agg(F.max("exit").alias("exit")).select("node_id", F.col("node_id").alias("root_id"), zero.alias("enter"), "exit", zero.alias("depth"))
    out = inner.unionByName(roots)
    if nodes is not None:
        alone = nodes.select(F.col("node_id").cast("long").alias("node_id")).distinct().join(one.select(F.col("child_id").alias("node_id")).union(one.select("parent_id")), "node_id", "left_anti")
        out = out.unionByName(alone.select("node_id", F.col("node_id").alias("root_id"), zero.alias("enter"), zero.alias("exit"), zero.alias("depth")))
    return cut_lineage(out)


def running_sum(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """rows with `running`, the sum of a column up to each row in an order without ties.

    Ranges of the order are written once and summed each by itself, so no task holds all rows.
    """
    ranges = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.sum(value).alias("_part"))  # a row for each shuffle partition
    before = sizes.select("_range", F.coalesce(F.sum("_part").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    here = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranges.join(F.broadcast(before), "_range").withColumn("running", here + F.col("_before")).drop("_range", "_before")


def subtree_sums(numbers: DataFrame, values: DataFrame) -> DataFrame:
    """(node_id, n): sums of (node_id, n) over each node's subtree, for every numbered node; 0 where there is nothing.

    A prefix sum in the order of entering, taken at a subtree's end and before its start.
    """
    own = values.groupBy("node_id").agg(F.sum("n").alias("n"))
    filled = numbers.join(own, "node_id", "left").select("node_id", "root_id", "enter", "exit", F.coalesce("n", F.lit(0)).alias("n"))
    sums = cut_lineage(running_sum(filled, "n", "root_id", "enter"))
    last = sums.select("root_id", F.col("enter").alias("exit"), F.col("running").alias("upto"))
    return sums.join(last, ["root_id", "exit"]).select("node_id", (F.col("upto") - F.col("running") + F.col("n")).alias("n"))


def cumulative_counts(numbers: DataFrame, counts: DataFrame) -> DataFrame:
    """Samples at or below each node that has some, from direct counts (node_id, n)."""
    return subtree_sums(numbers, counts.where("n <> 0")).where("n > 0")


def _of(numbers: DataFrame, root: int) -> DataFrame:
    """The one row of a node, to be sent to every task."""
    return F.broadcast(numbers.where(F.col("node_id") == root).select(F.col("root_id"), F.col("enter").alias("_from"), F.col("exit").alias("_to"), F.col("depth").alias("_depth")))


def below(numbers: DataFrame, root: int) -> DataFrame:
    """(node_id, distance) of a node's subtree, itself at 0; none where the node is not known."""
    return numbers.join(_of(numbers, root), "root_id").where("enter BETWEEN _from AND _to").select("node_id", (F.col("depth") - F.col("_depth")).alias("distance"))


def subtree_window(numbers: DataFrame, root: int, depth: int, links: DataFrame | None = None, backbone: DataFrame | None = None) -> DataFrame:
    """(node_id, distance, has_hidden, variants, is_backbone) of a subtree's first levels.

    has_hidden: children are cut off; variants: of links (node_id, variant_id), each once;
    is_backbone: among `backbone` (node_id).  Without these tables 0 and false.
    """
    rows = below(numbers, root).join(numbers.select("node_id", "enter", "exit"), "node_id").where(F.col("distance") <= depth)
    out = rows.select("node_id", "distance", ((F.col("distance") == depth) & (F.col("exit") > F.col("enter"))).alias("has_hidden"))
    held = links.select("node_id", "variant_id").distinct().groupBy("node_id").agg(F.count("*").alias("variants")) if links is not None else None
    out = out.join(held, "node_id", "left").withColumn("variants", F.coalesce("variants", F.lit(0).cast("long"))) if held is not None else out.withColumn("variants", F.lit(0).cast("long"))
    if backbone is None:
        return out.withColumn("is_backbone", F.lit(False))
    marked = backbone.select("node_id").distinct().withColumn("is_backbone", F.lit(True))
    return out.join(marked, "node_id", "left").withColumn("is_backbone", F.coalesce("is_backbone", F.lit(False)))


def recompute_backbone(numbers: DataFrame, seeds: DataFrame, curated: DataFrame) -> DataFrame:
    """Nodes that are seeds or above one, or curated (each node_id)."""
    above = subtree_sums(numbers, seeds.select("node_id", F.lit(1).alias("n"))).where("n > 0").select("node_id")
    return above.union(seeds.select("node_id").join(numbers, "node_id", "left_anti")).union(curated.select("node_id")).distinct()


def recruit_cohort(samples: DataFrame, numbers: DataFrame, target: int | None, excluded: DataFrame, literal: str | None = None) -> DataFrame:
    """Donors whose terminal is the target or below it, without the excluded; where the target is no node, those whose call is literally `literal`."""
    if target is not None and not numbers.where(F.col("node_id") == target).isEmpty():
        found = samples.join(below(numbers, target).select(F.col("node_id").alias("terminal")), "terminal", "left_semi")
    else:
        found = samples.where(F.lower(F.trim("call_text")) == F.lower(F.trim(F.lit(literal))))
    return found.select("donor_id").distinct().join(excluded, "donor_id", "left_anti")
