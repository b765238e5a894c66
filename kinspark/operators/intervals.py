"""Interval operators over half-open [s, e) rows per key k, and range joins by binning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tree import cut_lineage


def interval_merge(rows: DataFrame) -> DataFrame:
    """Overlapping or touching intervals of a key as one; empty ones and null ends or keys go.

    A sweep over ranges of (k, s): each range is walked by itself, and is told how far the ranges
    before it reach in its key and how many islands began there.  So one key, as one contig of a
    whole population, is spread over all partitions; what is carried is a row for each key and range.
    """
    valid = rows.where("k IS NOT NULL AND e > s").select("k", "s", "e")
    ranges = cut_lineage(valid.repartitionByRange("k", "s", "e").withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    reach = ranges.groupBy("k", "_range").agg(F.max("e").alias("_e")).select("k", "_range", F.max("_e").over(before).alias("_carried"))
    here = Window.partitionBy("_range", "k").orderBy("s", "e")
    upto = F.greatest(F.max("e").over(here.rowsBetween(Window.unboundedPreceding, -1)), "_carried")  # nulls apart
    swept = ranges.join(reach, ["k", "_range"]).withColumn("_new", F.when(upto >= F.col("s"), 0).otherwise(1))
    marked = cut_lineage(swept.withColumn("_i", F.sum("_new").over(here.rowsBetween(Window.unboundedPreceding, 0))).select("k", "s", "e", "_range", "_new", "_i"))
    begun = marked.groupBy("k", "_range").agg(F.sum("_new").alias("_n")).select("k", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return marked.join(begun, ["k", "_range"]).groupBy("k", (F.col("_i") + F.col("_base")).alias("_island")).agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def interval_total_bp(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k").agg(F.sum(F.col("e") - F.col("s")).alias("bp"))


def bins(start: Column, end: Column, width: int) -> Column:
    """The bins that [start, end] touches."""
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def range_join(points: DataFrame, position: str, ranges: DataFrame, start: str, end: str, how: str = "inner", width: int = 1024, keys: list[str] | None = None) -> DataFrame:
    """Points with the ranges that hold them (both ends included), as an equi-join on position bins.

    Each range is copied to the bins that it touches, each point has one bin, so a pair meets
    once; nothing is compared outside its bin.
    """
    p = points.withColumn("_bin", F.floor(F.col(position) / width))
    r = ranges.withColumn("_bin", bins(F.col(start), F.col(end), width))
    on = [p["_bin"] == r["_bin"], p[position] >= r[start], p[position] <= r[end]] + [p[k] == r[k] for k in keys or []]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    out = p.join(r, condition, how)
    return out.drop("_bin")


def interval_overlaps(a: DataFrame, b: DataFrame, width: int = 1024) -> DataFrame:
    """(k, s, e, s2, e2) of overlapping intervals of a key; a pair meets in the bin of its overlap's start."""
    x = a.withColumn("_bin", bins(F.col("s"), F.col("e") - 1, width))
    y = b.select("k", F.col("s").alias("s2"), F.col("e").alias("e2")).withColumn("_bin", bins(F.col("s2"), F.col("e2") - 1, width))
    return x.join(y, ["k", "_bin"]).where((F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e")) & (F.col("_bin") == F.floor(F.greatest("s", "s2") / width))).drop("_bin")


def interval_intersect_bp(a: DataFrame, b: DataFrame) -> DataFrame:
    return interval_overlaps(interval_merge(a), interval_merge(b)).groupBy("k").agg(F.sum(F.least("e", "e2") - F.greatest("s", "s2")).alias("bp"))


def interval_subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Parts of a that no interval of b covers."""
    merged, holes = interval_merge(a), interval_merge(b)
    cuts = interval_overlaps(merged, holes).select("k", "s", "e", F.greatest("s", "s2").alias("from_"), F.least("e", "e2").alias("to_"))
    w = Window.partitionBy("k", "s", "e").orderBy("from_")
    left = cuts.select("k", F.coalesce(F.lag("to_").over(w), "s").alias("a"), F.col("from_").alias("b"))
    tail = cuts.groupBy("k", "s", "e").agg(F.max("to_").alias("a")).select("k", "a", F.col("e").alias("b"))
    whole = merged.join(cuts.select("k", "s", "e").distinct(), ["k", "s", "e"], "left_anti").select("k", F.col("s").alias("a"), F.col("e").alias("b"))
    return left.union(tail).union(whole).where("a < b").select("k", F.col("a").alias("s"), F.col("b").alias("e"))


def region_overlap_flags(variants: DataFrame, regions: DataFrame) -> DataFrame:
    """(id, flags): sorted `type:label` of the regions that hold each variant, empty without any."""
    hits = range_join(variants.select("id", "position"), "position", regions, "start_pos", "end_pos")
    flags = hits.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.concat("region_type", F.lit(":"), "label"))), ",").alias("flags"))
    return variants.select("id").join(flags, "id", "left").select("id", F.coalesce("flags", F.lit("")).alias("flags"))


def recurrent_mask(variants: DataFrame, regions: DataFrame) -> DataFrame:
    """Variants outside heterochromatin and inverted repeats."""
    bad = regions.where(F.col("region_type").isin("heterochromatin", "inverted_repeat"))
    return variants.join(range_join(variants.select("id", "position"), "position", bad, "start_pos", "end_pos").select("id").distinct(), "id", "left_anti")


def callable_mask_semi(variants: DataFrame, mask: DataFrame) -> DataFrame:
    """Variants inside a half-open mask interval; an empty mask keeps all."""
    inside = range_join(variants.select("id", "position"), "position", mask.select("s", (F.col("e") - 1).alias("e")), "s", "e").select("id").distinct()
    some = mask.select(F.lit(1).alias("one")).limit(1).agg(F.count("*").alias("n"))
    return variants.join(inside.withColumn("_in", F.lit(True)), "id", "left").crossJoin(F.broadcast(some)).where("_in or n = 0").drop("_in", "n")


def liftover_join(variants: DataFrame, chain: DataFrame) -> DataFrame:
    """Positions through chain blocks; reverse blocks complement the alleles; gaps stay null."""
    from ..functions import dna

    hits = range_join(variants.select("id", "position"), "position", chain.withColumn("last", F.col("t_end") - 1), "t_start", "last")
    lifted = hits.select("id", F.when(F.col("strand") == "-", F.col("q_start") + (F.col("t_end") - 1 - F.col("position"))).otherwise(F.col("q_start") + F.col("position") - F.col("t_start")).alias("lifted"), "strand")
    flip = F.col("strand") == "-"
    return variants.join(lifted, "id", "left").select("id", "lifted", F.when(flip, dna.revcomp(F.col("anc"))).otherwise(F.col("anc")).alias("anc"), F.when(flip, dna.revcomp(F.col("der"))).otherwise(F.col("der")).alias("der"), F.when(F.col("lifted").isNull(), "UNMAPPED").otherwise("LIFTED").alias("how"))


def mt_rotation_lift(variants: DataFrame, rotation: DataFrame) -> DataFrame:
    """(id, anc, der, rotated, how): positions through a rotation map (position, rotated), alleles as they are.

    A position that the map lacks, or has without a target, is UNMAPPED.
    """
    at = rotation.where("rotated is not null").groupBy("position").agg(F.min("rotated").alias("rotated"))
    return variants.join(at, "position", "left").select("id", "anc", "der", "rotated", F.when(F.col("rotated").isNull(), "UNMAPPED").otherwise("LIFTED").alias("how"))
