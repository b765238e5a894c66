"""Merging samples over everything that refers to them, and donors of the same individual."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tree import cut_lineage

MOVE, KEEP_SURVIVOR, DROP = "move", "keep_survivor", "drop"


@dataclass(frozen=True)
class Rule:
    """What a merge does to a table: its columns that hold samples, and how.

    move: rows follow their sample; keep_survivor: of rows that agree on `unique` only those of
    the survivor stay, or where it has none those of the merged sample next in order; drop: rows
    of merged samples go.
    """

    columns: tuple[str, ...]
    action: str = MOVE
    unique: tuple[str, ...] = field(default=())


def settled(merges: DataFrame) -> DataFrame:
    """(merged, survivor, into, steps) of merges (merged, survivor): the last survivor of each chain, and how far it is.

    Paths double each round, so a chain of n merges takes log2(n) joins.  Merges on a cycle, or
    that lead to one, have no last survivor and get no row.
    """
    step = cut_lineage(merges.select("merged", "survivor", F.col("survivor").alias("into"), F.lit(1).alias("steps")))
    limit = step.count() + 1
    reach = 1
    while reach <= limit:
        further = step.select(F.col("merged").alias("into"), F.col("into").alias("next"), F.col("steps").alias("more"))
        step = cut_lineage(step.join(further, "into", "left").select("merged", "survivor", F.coalesce("next", "into").alias("into"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
        if step.join(step.select(F.col("merged").alias("into")), "into", "left_semi").isEmpty():
            break
        reach *= 2
    return step.join(step.select(F.col("merged").alias("into")), "into", "left_anti")


def refused(samples: DataFrame, merges: DataFrame, chains: DataFrame) -> DataFrame:
    """(merged, survivor, reason) of merges that can't be: itself, twice, unknown, deleted or cycle."""
    known = samples.select("sample_id", F.coalesce("deleted", F.lit(False)).alias("gone"))
    both = merges.join(known.select(F.col("sample_id").alias("merged"), F.col("gone").alias("m")), "merged", "left").join(known.select(F.col("sample_id").alias("survivor"), F.col("gone").alias("s")), "survivor", "left")
    both = both.join(chains.select("merged", F.lit(True).alias("ends")).distinct(), "merged", "left").join(merges.groupBy("merged").agg(F.count("*").alias("n")), "merged")
    reason = F.when(F.col("merged") == F.col("survivor"), "itself").when(F.col("n") > 1, "twice").when(F.col("m").isNull() | F.col("s").isNull(), "unknown").when(F.col("m") | F.col("s"), "deleted").when(F.col("ends").isNull(), "cycle")
    return both.select("merged", "survivor", reason.alias("reason")).where("reason IS NOT NULL")


def merge_samples(samples: DataFrame, tables: Mapping[str, DataFrame], references: Mapping[str, tuple[str, ...]], plan: Mapping[str, Rule], merges: DataFrame, merged_by: str, candidates: DataFrame | None = None) -> dict[str, DataFrame]:
    """Samples and their tables after merges (merged, survivor, candidate_id).

    samples: (sample_id, accession, alias, calls, is_public, deleted, merged_ids, merged_accessions,
    merged_into); references: every column of every table that holds samples; plan: the rule of
    each.  A column that no rule covers is an error before anything is read, so that a new table
    can't be left with samples that are gone.  Chains of merges end at their last survivor; members
    of one survivor come in order of their steps to it, then by id: nearer ones fill gaps and keep
    rows first.  Survivors take over the calls and names of all their members; merged rows stay as
    tombstones that point at the survivor that was named.

    Returns the tables by name, with `sample`, `audit` (a row for each merge, with rows repointed
    and dropped) and, if given, `candidate` (candidate_id, a, b, status).  Raises ValueError on an
    uncovered column or a merge that is refused.
    """
    uncovered = sorted(f"{t}.{c}" for t, columns in references.items() for c in columns if t not in plan or c not in plan[t].columns)
    if uncovered:
        raise ValueError(f"no rule covers {', '.join(uncovered)}")
    asked = cut_lineage(merges.select("merged", "survivor", "candidate_id"))
    chains = settled(asked)
    bad = refused(samples, asked, chains).orderBy("merged").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['merged']} into {r['survivor']}: {r['reason']}" for r in bad))
    order = F.row_number().over(Window.partitionBy("into").orderBy("steps", "merged"))  # the members of one survivor
    chains = cut_lineage(chains.withColumn("place", order))
    to = chains.select("merged", "into", "place")
    out: dict[str, DataFrame] = {}
    told = None
    for name, rule in plan.items():
        rows = tables[name]
        if rule.action == DROP:
            hits = [rows.join(to.select(F.col("merged").alias(c)), c, "left_semi").select(F.col(c).alias("merged")) for c in rule.columns]
            for c in rule.columns:
                rows = rows.join(to.select(F.col("merged").alias(c)), c, "left_anti")
            out[name] = rows.select(*tables[name].columns)
            dropped = hits[0]
            for more in hits[1:]:
                dropped = dropped.unionByName(more)
            one = dropped.groupBy("merged").agg(F.lit(0).cast("long").alias("repointed"), F.count("*").alias("dropped"))
        else:
            (c,) = rule.columns
            named = to.select(F.col("merged").alias(c), "into", "place")
            rows = rows.join(named, c, "left").withColumns({"_was": F.col(c), c: F.coalesce("into", c), "_place": F.coalesce("place", F.lit(0)), "_moved": F.col("into").isNotNull()})
            if rule.action == KEEP_SURVIVOR:
                first = F.min("_place").over(Window.partitionBy(c, *rule.unique))
                rows = rows.withColumn("_stays", F.col("_place") == first)
            else:
                rows = rows.withColumn("_stays", F.lit(True))
            rows = cut_lineage(rows)
            out[name] = rows.where("_stays").select(*tables[name].columns)
            one = rows.where("_moved").groupBy(F.col("_was").alias("merged")).agg(F.count_if("_stays").alias("repointed"), F.count_if(~F.col("_stays")).alias("dropped"))
        told = one if told is None else told.unionByName(one)
    folded = chains.join(samples.withColumnRenamed("sample_id", "merged").select("merged", "accession", "alias", "calls", "is_public"), "merged")
    fold = folded.groupBy(F.col("into").alias("sample_id")).agg(
        F.min_by("alias", F.when(F.col("alias").isNotNull(), F.col("place"))).alias("m_alias"), F.max(F.coalesce("is_public", F.lit(False))).alias("m_public"),
        F.array_sort(F.collect_list(F.struct("place", "merged", "accession", "calls"))).alias("m"))
    none = {c: F.array().cast(samples.schema[c].dataType) for c in ("calls", "merged_ids", "merged_accessions")}

    def grown(column: str, more) -> F.Column:
        return F.concat(F.coalesce(column, none[column]), F.coalesce(more, none[column])).alias(column)

    gone = asked.select(F.col("merged").alias("sample_id"), F.col("survivor").alias("_into"))
    both = samples.join(fold, "sample_id", "left").join(gone, "sample_id", "left")
    # a survivor in the middle of a chain is gone itself: what it took over is told by the last one
    out["sample"] = both.select(
        "sample_id", "accession", F.coalesce("alias", "m_alias").alias("alias"), grown("calls", F.flatten(F.transform("m", lambda x: F.coalesce(x["calls"], none["calls"])))),
        F.when(F.col("m").isNotNull(), F.coalesce("is_public", F.lit(False)) | F.col("m_public")).otherwise(F.col("is_public")).alias("is_public"), (F.coalesce("deleted", F.lit(False)) | F.col("_into").isNotNull()).alias("deleted"),
        grown("merged_ids", F.transform("m", lambda x: x["merged"])), grown("merged_accessions", F.filter(F.transform("m", lambda x: x["accession"]), lambda a: a.isNotNull())), F.coalesce("_into", "merged_into").alias("merged_into"))
    counts = told.groupBy("merged").agg(F.sum("repointed").alias("repointed"), F.sum("dropped").alias("dropped")) if told is not None else asked.select("merged", F.lit(0).alias("repointed"), F.lit(0).alias("dropped"))
    zero = F.lit(0).cast("long")
    out["audit"] = asked.join(counts, "merged", "left").select("survivor", "merged", "candidate_id", F.coalesce("repointed", zero).alias("repointed"), F.coalesce("dropped", zero).alias("dropped"), F.lit(merged_by).alias("merged_by"))
    if candidates is not None:
        ids = asked.where("candidate_id IS NOT NULL").select("candidate_id", F.lit(True).alias("_done")).distinct()
        merged = asked.select("merged", F.lit(True).alias("_hit")).distinct()
        seen = candidates.join(ids, "candidate_id", "left").join(merged.select(F.col("merged").alias("a"), F.col("_hit").alias("_a")), "a", "left").join(merged.select(F.col("merged").alias("b"), F.col("_hit").alias("_b")), "b", "left")
        stale = (F.col("status") == "CANDIDATE") & F.coalesce("_a", "_b", F.lit(False))
        out["candidate"] = seen.select("candidate_id", "a", "b", F.when(F.col("_done"), "MERGED").when(stale, "DISMISSED").otherwise(F.col("status")).alias("status"))
    return out


def consolidate_donors(samples: DataFrame, donors: DataFrame) -> dict[str, DataFrame]:
    """Samples of one individual under one donor.

    samples: (sample_id, donor_id, accession, alias, denovo, deleted); donors: (donor_id, sex,
    geocoord, biobank, donor_identifier).  A group is the live samples whose key (a de-novo
    sample's accession, another's alias, in lower case) both a de-novo and another sample have.
    Its survivor is the donor with most of coordinates, biobank and sex, then the least id; gaps
    are filled from the group's donors by id, and its identifier becomes the greatest key as
    written.  Returns sample (with donor_id repointed), donor (without those that a group left
    empty) and member (sample_id, key, survivor).
    """
    denovo = F.coalesce("denovo", F.lit(False))
    live = samples.where(~F.coalesce("deleted", F.lit(False))).withColumn("orig", F.when(denovo, F.col("accession")).otherwise(F.col("alias"))).withColumn("key", F.lower("orig"))
    shared = live.where("key IS NOT NULL").groupBy("key").agg(F.max(denovo).alias("one"), F.max(~denovo).alias("other")).where("one AND other").select("key")
    members = cut_lineage(live.join(shared, "key").select("sample_id", "donor_id", "key", "orig"))
    score = sum((F.col(c).isNotNull().cast("int") for c in ("geocoord", "biobank", "sex")), F.lit(0))
    of_group = members.where("donor_id IS NOT NULL").select("key", "donor_id").distinct().join(donors, "donor_id")
    survivor = of_group.groupBy("key").agg(F.min_by("donor_id", F.struct(-score, "donor_id")).alias("survivor"))
    told = cut_lineage(members.join(survivor, "key"))
    held = told.select("survivor", "donor_id", "orig").join(donors, "donor_id", "left")

    def first(c: str) -> F.Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("donor_id"))).alias(f"m_{c}")

    fills = held.groupBy(F.col("survivor").alias("donor_id")).agg(first("sex"), first("geocoord"), first("biobank"), F.max("orig").alias("m_ident"))
    moved = samples.join(told.select("sample_id", "survivor"), "sample_id", "left").withColumn("donor_id", F.coalesce("survivor", "donor_id")).select(*samples.columns)
    empty = told.where("donor_id IS NOT NULL").select("donor_id").distinct().join(moved.select("donor_id").distinct(), "donor_id", "left_anti")
    filled = donors.join(fills, "donor_id", "left").select("donor_id", *[F.coalesce(c, f"m_{c}").alias(c) for c in ("sex", "geocoord", "biobank")], F.coalesce("m_ident", "donor_identifier").alias("donor_identifier"))
    return {"sample": moved, "donor": filled.join(empty, "donor_id", "left_anti"), "member": told.select("sample_id", "key", "survivor")}
