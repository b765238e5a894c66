"""Tree operators over nodes, edges (child_id, parent_id, valid_until) and a derived closure."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .placement import resolve_calls


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share (spark.checkpoint.dir); without one, local sessions get a folder of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/closure-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, column: str, after: int, *order: str) -> DataFrame:
    """rows with `column`, numbers from after + 1 on in the order of some columns.

    Ranges of the order are written once with their number; each is then counted and numbered by
    itself, so no task orders all rows and numbers don't depend on how an exchange is used again.
    """
    ranges = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size"))  # a row for each shuffle partition
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.join(F.broadcast(before), "_range").withColumn(column, (place + F.col("_before") + after).cast("long")).drop("_range", "_before")


def current_rows(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """Rows that are valid now, or were at a time: begun by then (column valid_from, where there is one; null is always) and not over."""
    if as_of is None:
        return df.where(F.col("valid_until").isNull())
    at = F.lit(as_of).cast("timestamp")
    begun = F.col("valid_from").isNull() | (F.col("valid_from") <= at) if "valid_from" in df.columns else F.lit(True)
    return df.where(begun & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))


def tree_closure(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(ancestor_id, descendant_id, distance) of all pairs, each node with itself at 0.

    Doubles the paths each round, so a tree of depth n takes log2(n)+1 rounds, each an equi-join;
    cycles end when no pair is new.  A shortest path of more than `size` steps ends in one of
    exactly `size` steps, so only those are put behind others: in a tree each pair is made once,
    and a root's far descendants meet nothing at the root.
    """
    current = current_rows(edges).where("child_id <> parent_id").select(F.col("parent_id").alias("a"), F.col("child_id").alias("d")).distinct()
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number, since rows that compress well would be put into few tasks
    last, size = cut_lineage(current.withColumn("n", F.lit(1))), 1
    paths = last
    while True:
        # paths hold every pair up to size apart, with its distance; new ones are size + 1 to 2 size apart
        left, right = paths.select("a", F.col("d").alias("m"), F.col("n").alias("n1")), last.where(F.col("n") == size).select(F.col("a").alias("m"), "d")
        longer = left.hint("merge").join(right, "m").where("a <> d").select("a", "d", (F.col("n1") + size).alias("n"))
        longer = longer.repartition(parts, "a", "d").groupBy("a", "d").agg(F.min("n").alias("n"))
        last = cut_lineage(longer.hint("merge").join(paths.select("a", "d").repartition(parts, "a", "d"), ["a", "d"], "left_anti"))
        if last.isEmpty():
            break
        paths, size = paths.union(last), size * 2
    ids = (nodes.select(F.col("node_id").alias("a")) if nodes is not None else current.select("a").union(current.select("d"))).distinct()
    return paths.union(ids.select("a", F.col("a").alias("d"), F.lit(0).alias("n"))).select(F.col("a").alias("ancestor_id"), F.col("d").alias("descendant_id"), F.col("n").alias("distance"))


def tree_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(current_rows(edges).select(F.col("child_id").alias("node_id")), "node_id", "left_anti")


def tree_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(current_rows(edges).select(F.col("parent_id").alias("node_id")), "node_id", "left_anti")


def children(edges: DataFrame) -> DataFrame:
    return current_rows(edges).groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))


def node_depth(closure: DataFrame) -> DataFrame:
    return closure.groupBy(F.col("descendant_id").alias("node_id")).agg(F.max("distance").alias("depth"))


def ancestor_path(closure: DataFrame) -> DataFrame:
    """Each node's chain from the root to its parent."""
    above = closure.where("distance > 0").groupBy(F.col("descendant_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor_id"))).alias("p"))
    return above.select("node_id", F.array_join(F.transform("p", lambda x: x["ancestor_id"].cast("string")), ">").alias("path"))


def samples_under(closure: DataFrame, samples: DataFrame) -> DataFrame:
    """Every clade's samples: (node_id, sample_id, distance)."""
    return closure.join(samples.select("sample_id", F.col("terminal").alias("descendant_id")), "descendant_id").select(F.col("ancestor_id").alias("node_id"), "sample_id", "distance")



def pathway(samples: DataFrame, nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """Each sample's steps from the root to its node; empty if its call names none."""
    at = samples.select("sample_id", "call_text").join(resolve_calls(samples, nodes), "call_text", "left")
    steps = at.join(closure, at["node_id"] == closure["descendant_id"], "left").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor_id"))).alias("p"))
    return steps.select("sample_id", F.array_join(F.transform(F.filter("p", lambda x: x["ancestor_id"].isNotNull()), lambda x: x["ancestor_id"].cast("string")), ">").alias("steps"))


def restructure_check(moves: DataFrame, closure: DataFrame) -> DataFrame:
    """Moves (node_id, new_parent) and whether each is refused: onto itself or into its own subtree."""
    inside = closure.select(F.col("ancestor_id").alias("node_id"), F.col("descendant_id").alias("new_parent"), F.lit(True).alias("cycle"))
    return moves.join(inside, ["node_id", "new_parent"], "left").select("node_id", "new_parent", F.when(F.col("cycle"), "REFUSED").otherwise("MOVED").alias("how"))


def merge_into_parent(merged: DataFrame, edges: DataFrame, closure: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """The tree after some nodes (node_id) went into their parents.

    edge: (child_id, parent_id) of the nodes that stay; link: (node_id, variant_id), each once;
    closed: nodes that are over.  Where a parent goes too, children and variants move on to the
    nearest ancestor that stays.  A node without a parent stays.
    """
    closed = merged.select("node_id").distinct().join(current_rows(edges).select(F.col("child_id").alias("node_id")), "node_id", "left_semi")
    above = closure.where("distance > 0").join(closed.select(F.col("node_id").alias("ancestor_id")), "ancestor_id", "left_anti")
    home = cut_lineage(above.groupBy(F.col("descendant_id").alias("node_id")).agg(F.min_by("ancestor_id", "distance").alias("home")))
    edge = current_rows(edges).select(F.col("child_id").alias("node_id")).distinct().join(closed, "node_id", "left_anti").join(home, "node_id").select(F.col("node_id").alias("child_id"), F.col("home").alias("parent_id"))
    moved = links.join(closed.join(home, "node_id").hint("shuffle_hash"), "node_id", "left")  # a hash of the closed nodes, so that no task sorts the links of a few nodes
    return {"edge": edge, "link": moved.select(F.coalesce("home", "node_id").alias("node_id"), "variant_id").distinct(), "closed": closed}


def split_node(splits: DataFrame, moves: DataFrame, nodes: DataFrame, links: DataFrame, by: str = "variant_id") -> dict[str, DataFrame]:
    """New children that take some of a node's variants.

    splits: (split_id, node_id, name); moves: (split_id, variant_id).  A name that is empty, that a
    current node of the same kind of DNA has, or that an earlier split takes, is refused.
    Variants that the node doesn't hold are left out; one asked for twice goes to the first.
    `by`: a column of links and of moves (split_id, by) that names shares of a node's variants, where
    splits ask for whole shares; which split gets a share is told before its variants are met.
    Returns node (split_id, node_id, name, parent_id), numbered after the greatest id, and link.
    """
    now = current_rows(nodes).select("node_id", "name", "dna_type")
    asked = splits.withColumn("name", F.trim("name")).where("name <> ''").join(now.select("node_id", "dna_type"), "node_id")
    free = asked.join(now.select("name", "dna_type").distinct(), ["name", "dna_type"], "left_anti")
    first = free.groupBy("name", "dna_type").agg(F.min_by(F.struct("split_id", F.col("node_id").alias("parent_id")), "split_id").alias("s")).select("name", "s.*")
    after = nodes.agg(F.max("node_id")).first()[0] or 0
    node = cut_lineage(numbered(first, "node_id", after, "split_id").select("split_id", "node_id", "name", "parent_id"))
    held = links.select("node_id", "variant_id", *{by} - {"variant_id"}).distinct()
    goes = moves.join(node.select("split_id", F.col("node_id").alias("child"), F.col("parent_id").alias("node_id")), "split_id")
    goes = goes.groupBy("node_id", by).agg(F.min_by("child", "split_id").alias("child"))
    return {"node": node, "link": held.join(goes, ["node_id", by], "left").select(F.coalesce("child", "node_id").alias("node_id"), "variant_id")}


def tree_revision(*tables: DataFrame) -> DataFrame:
    """A fingerprint of tables' rows, whatever their order."""
    out = None
    for k, t in enumerate(tables):
        one = t.agg(F.bit_xor(F.xxhash64(F.lit(k), *t.columns)).alias("x"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.bit_xor("x").alias("revision"), F.sum("n").alias("rows"))


def subtree_tester_count(closure: DataFrame, samples: DataFrame) -> DataFrame:
    return samples_under(closure, samples.select(F.col("donor_id").alias("sample_id"), "terminal")).groupBy("node_id").agg(F.countDistinct("sample_id").alias("testers"))
