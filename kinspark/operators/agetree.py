"""Ages through a tree by subtrees of bounded size, each in one kernel.

Nodes whose remaining subtree is small form whole subtrees; many of them share a task, which works
from their leaves up and hands what their roots tell to the nodes above.  Then these nodes are
gone and the tree above is smaller.  Rounds are as many as subtrees hang above each other: about
log(nodes) / log(size) in a bushy tree, nodes / size in a bare chain, and not one for each level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import running_sum, subtree_sums, tree_numbers
from .tree import cut_lineage

#: Nodes of a subtree (a task holds up to twice as many, with three arrays of bins each).
SIZE = 2048

Convolve = Callable[[np.ndarray, np.ndarray], np.ndarray]


def from_logs(logs: np.ndarray) -> np.ndarray | None:
    """The normalised masses of summed logarithms; None where nothing is possible."""
    top = logs.max()
    if not np.isfinite(top):
        return None
    w = np.exp(logs - top)
    return w / w.sum()


def to_logs(mass: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(mass)


def pooled(evidence: DataFrame) -> DataFrame:
    """(node_id, logs): evidence (node_id, logs) summed bin by bin, as it streams by."""
    from .ages import summed

    return summed(evidence, "node_id", "logs")


def tree_rows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, parent_id, root_id, enter, exit, depth) of the edges' nodes and of `nodes` (node_id)."""
    plain = edges.select("child_id", "parent_id", F.lit(None).cast("timestamp").alias("valid_until"))
    numbers = tree_numbers(plain, nodes.select("node_id").union(plain.select("parent_id")).union(plain.select("child_id")))
    up = plain.where("child_id <> parent_id").groupBy(F.col("child_id").cast("long").alias("node_id")).agg(F.min("parent_id").cast("long").alias("parent_id"))
    return cut_lineage(numbers.join(up, "node_id", "left").select("node_id", "parent_id", "root_id", "enter", "exit", "depth"))


def _cut(tree: DataFrame, left: DataFrame, size: int) -> DataFrame:
    """The remaining nodes whose remaining subtree is small, with the group that each is worked in."""
    weight = cut_lineage(left.select("node_id").join(subtree_sums(tree, left.select("node_id", F.lit(1).alias("n"))), "node_id"))
    small = weight.where(F.col("n") <= size).select("node_id")
    inner = left.join(small, "node_id", "left_semi").join(small.select(F.col("node_id").alias("parent_id"), F.lit(0).alias("_top")), "parent_id", "left")
    inner = inner.withColumns({"_top": F.coalesce("_top", F.lit(1)), "_one": F.lit(1)})
    # in the order of entering, a subtree's root comes first: counting roots numbers the subtrees
    placed = running_sum(inner, "_top", "root_id", "enter").withColumnRenamed("running", "_chunk")
    placed = cut_lineage(running_sum(placed, "_one", "root_id", "enter").withColumnRenamed("running", "_at"))
    first = placed.where("_top = 1").select("_chunk", F.floor(F.col("_at") / size).alias("group"))
    return cut_lineage(placed.join(first, "_chunk").select("node_id", "parent_id", "depth", "group"))


def propagate(tree: DataFrame, evidence: DataFrame, branch: DataFrame, convolve: Convolve, size: int = SIZE, refine: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(node_id, mass, formed) of every node that is dated: arrays over one grid.

    tree: of `tree_rows`; evidence: (node_id, logs), what dates a node itself; branch: (node_id,
    branch), the time between a node and its parent (no row adds none).  Upwards, a node's age is
    the product of its evidence and of its children's ages, each with its branch added by
    `convolve`; what excludes itself dates nothing.  With `refine` (age, parent's age, branch),
    children of a dated node with two dated children or more are then refined from the roots down.
    formed is the age with the own branch added.
    """

    def up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["depth", "node_id"], ascending=False)
        held = {n: None if x is None else np.asarray(x, dtype=np.float64).copy() for n, x in zip(rows["node_id"], rows["logs"], strict=True)}
        out = []
        for r in rows.itertuples(index=False):
            logs = held[r.node_id]
            mass = None if logs is None else from_logs(logs)
            told = None
            if mass is not None and not pd.isna(r.parent_id):
                told = to_logs(mass if r.branch is None else convolve(mass, np.asarray(r.branch)))
                if r.parent_id in held:
                    held[r.parent_id] = told.copy() if held[r.parent_id] is None else held[r.parent_id] + told
                    told = None
            out.append((r.node_id, None if mass is None else mass.tolist(), None if told is None else told.tolist()))
        return pd.DataFrame(out, columns=["node_id", "mass", "told"])

    def down(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["depth", "node_id"])
        age: dict[int, np.ndarray] = {}
        out = []
        for r in rows.itertuples(index=False):
            mass = np.asarray(r.mass)
            above = age.get(r.parent_id) if r.above is None else np.asarray(r.above)
            if refine is not None and r.several and above is not None and r.branch is not None:
                mass = refine(mass, above, np.asarray(r.branch))
            age[r.node_id] = mass
            out.append((r.node_id, mass.tolist(), (mass if r.branch is None else convolve(mass, np.asarray(r.branch))).tolist()))
        return pd.DataFrame(out, columns=["node_id", "mass", "formed"])

    branch = cut_lineage(branch.select("node_id", "branch"))
    logs = cut_lineage(pooled(evidence))
    left, rounds = tree, []
    while True:
        n = left.count()
        if not n:
            break
        # what fits one group need not be cut
        here = cut_lineage(left.select("node_id", "parent_id", "depth", F.lit(0).cast("long").alias("group"))) if n <= size else _cut(tree, left, size)
        # arrays that are often equal make small files and are large in memory: never broadcast
        rows = here.hint("merge").join(logs.hint("merge"), "node_id", "left").join(branch.hint("merge"), "node_id", "left")
        worked = cut_lineage(rows.groupBy("group").applyInPandas(up, "node_id long, mass array<double>, told array<double>"))
        rounds.append((here, worked.where("mass IS NOT NULL").select("node_id", "mass")))
        if n <= size:
            break
        left = cut_lineage(left.join(here.select("node_id"), "node_id", "left_anti"))
        sent = worked.where("told IS NOT NULL").hint("merge").join(here, "node_id").select(F.col("parent_id").alias("node_id"), F.col("told").alias("logs"))
        logs = cut_lineage(pooled(logs.hint("merge").join(left.select("node_id"), "node_id", "left_semi").unionByName(sent)))
    if not rounds:
        return tree.sparkSession.createDataFrame([], "node_id long, mass array<double>, formed array<double>")
    dated = rounds[0][1].select("node_id")
    for _, masses in rounds[1:]:
        dated = dated.union(masses.select("node_id"))
    several = cut_lineage(dated.join(tree, "node_id").where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count("*").alias("_n")).where("_n > 1").select("parent_id", F.lit(True).alias("several")))
    done: DataFrame | None = None
    for here, masses in reversed(rounds):
        rows = masses.hint("merge").join(here, "node_id").join(branch.hint("merge"), "node_id", "left").join(several, "parent_id", "left").withColumn("several", F.coalesce("several", F.lit(False)))
        # ages from rounds above reach the roots of this one's subtrees; inside, the kernel knows them
        above = done.select(F.col("node_id").alias("parent_id"), F.col("mass").alias("above")) if done is not None else None
        rows = rows.join(above.hint("merge"), "parent_id", "left") if above is not None else rows.withColumn("above", F.lit(None).cast("array<double>"))
        one = cut_lineage(rows.groupBy("group").applyInPandas(down, "node_id long, mass array<double>, formed array<double>"))
        done = one if done is None else done.unionByName(one)
    return done


def masses(rows: DataFrame, column: str, key: str = "node_id") -> DataFrame:
    """(key, bin, mass) of arrays, bins without mass left out."""
    return rows.select(key, F.posexplode(column).alias("bin", "mass")).where("mass > 0")


def arrays(rows: DataFrame, key: str, bins: int, name: str) -> DataFrame:
    """(key, name) of rows (key, bin, mass): one array over the whole grid."""
    held = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "mass"))).alias("_m"))
    return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("_m", b), F.lit(0.0))).alias(name))
