"""Where samples sit in the tree by their published calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import call_tokens


def resolve_calls(samples: DataFrame, nodes: DataFrame, links: DataFrame | None = None, variants: DataFrame | None = None) -> DataFrame:
    """(call_text, node_id) of each distinct call that resolves.

    The call as it is, then each of its tokens in order, is looked for as a node's name, then as an
    alias of a current node, then as a current node's defining SNP, whatever its case; the first
    that hits counts.  Among aliases and SNPs the node that began last wins, then the least id.
    nodes: (node_id, name) and, where there are any, aliases (array), valid_from and valid_until;
    links: (node_id, variant_id) that are current; variants: (id, name).  All steps are one union
    of equi-joins, ranked once.
    """
    raw = F.trim("call_text")
    tokens = F.concat(F.filter(F.array(raw), lambda t: t != ""), F.coalesce(call_tokens(F.col("call_text")), F.array().cast("array<string>")))
    asked = samples.where("call_text IS NOT NULL").select("call_text").distinct().select("call_text", F.posexplode(tokens).alias("at", "token"))
    none = F.lit(None)
    began = F.col("valid_from").cast("timestamp") if "valid_from" in nodes.columns else none.cast("timestamp")
    live = nodes.where("valid_until IS NULL") if "valid_until" in nodes.columns else nodes
    known = nodes.select(F.col("name").alias("token"), "node_id", F.lit(0).alias("step"), none.cast("timestamp").alias("began"))
    if "aliases" in nodes.columns:
        known = known.unionByName(live.select(F.explode("aliases").alias("token"), "node_id", F.lit(1).alias("step"), began.alias("began")))
    hits = asked.join(known, "token").select("call_text", "at", "step", "began", "node_id")
    if links is not None and variants is not None:
        snps = links.select("node_id", "variant_id").join(variants.select(F.col("id").alias("variant_id"), F.lower("name").alias("low")).where("low IS NOT NULL"), "variant_id")
        snps = snps.join(live.select("node_id", began.alias("began")), "node_id").select("low", "node_id", F.lit(2).alias("step"), "began")
        hits = hits.unionByName(asked.withColumn("low", F.lower("token")).join(snps, "low").select("call_text", "at", "step", "began", "node_id"))
    # nulls of began last: what has no beginning loses to what has one
    order = F.struct("at", "step", (-F.coalesce(F.unix_micros("began"), F.lit(-(2**62)))).alias("newest"), "node_id")
    return hits.groupBy("call_text").agg(F.min_by("node_id", order).alias("node_id"))


def place_samples(samples: DataFrame, placements: DataFrame, nodes: DataFrame, links: DataFrame | None = None, variants: DataFrame | None = None) -> DataFrame:
    """(sample_id, node_id, call_text, status) of all placements after they are computed anew.

    samples: (sample_id, source, call_text, deleted, denovo); placements: what stood before.
    Placements that a curator made (CURATED) or the tree's topology (denovo samples) stay as they
    are, unless their sample is deleted or a citizen's now.  Of the other samples, each with a call
    that is neither deleted nor a citizen's is PLACED or UNPLACED; all other placements go.
    """
    eligible = samples.where((F.col("source") != "CITIZEN") & ~F.coalesce("deleted", F.lit(False)))
    kept = placements.where("status = 'CURATED'").select("sample_id").union(samples.where("denovo").select("sample_id")).distinct()
    old = placements.join(kept, "sample_id", "left_semi").join(eligible.select("sample_id").distinct(), "sample_id", "left_semi").select("sample_id", "node_id", "call_text", "status")
    calls = eligible.join(kept, "sample_id", "left_anti").where("trim(call_text) <> ''")
    found = calls.select("sample_id", "call_text").join(resolve_calls(calls, nodes, links, variants), "call_text", "left")
    new = found.select("sample_id", "node_id", "call_text", F.when(F.col("node_id").isNull(), "UNPLACED").otherwise("PLACED").alias("status"))
    return old.unionByName(new)


