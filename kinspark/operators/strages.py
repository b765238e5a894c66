"""Ages from short tandem repeats, and ages combined from several terms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ages, agetree
from .similarity import combine_inverse_variance, meet_in_tiles
from .tree import current_rows, cut_lineage, tree_closure

GENERATION = 33.0
MOST_MUTATIONS = 40
#: Years by which the SNP rate is uncertain at 95 %, as a share of the age.
RATE_ERROR = 0.096
# The published P(g | m), rows g and columns m, both 0 to 10.
PUBLISHED = [
    [1.000, 0.000, 0.479, 0.024, 0.364, 0.003, 0.302, 0.006, 0.261, 0.009, 0.230],
    [0.000, 0.962, 0.032, 0.725, 0.020, 0.607, 0.009, 0.526, 0.014, 0.465, 0.020],
    [0.000, 0.032, 0.483, 0.005, 0.485, 0.017, 0.454, 0.012, 0.418, 0.017, 0.384],
    [0.000, 0.004, 0.004, 0.242, 0.006, 0.303, 0.015, 0.316, 0.013, 0.311, 0.018],
    [0.000, 0.001, 0.001, 0.003, 0.122, 0.006, 0.182, 0.013, 0.210, 0.013, 0.221],
    [0.000, 0.000, 0.000, 0.001, 0.003, 0.061, 0.005, 0.106, 0.011, 0.135, 0.012],
    [0.000, 0.000, 0.000, 0.000, 0.000, 0.002, 0.031, 0.005, 0.061, 0.008, 0.084],
    [0.000, 0.000, 0.000, 0.000, 0.000, 0.000, 0.001, 0.016, 0.003, 0.034, 0.007],
    [0.000, 0.000, 0.000, 0.000, 0.000, 0.000, 0.000, 0.001, 0.008, 0.003, 0.019],
    [0.000, 0.000, 0.000, 0.000, 0.000, 0.000, 0.000, 0.000, 0.001, 0.004, 0.002],
    [0.000, 0.000, 0.000, 0.000, 0.000, 0.000, 0.000, 0.000, 0.000, 0.000, 0.002],
]
# Shares of steps of one, two and three repeats; each further repeat is rarer by the root of ten.
STEPS = [0.96217, 0.032, 0.004]


def step_shares(multi: float | None = None) -> np.ndarray:
    """Shares of steps of 1 to 10 repeats; `multi` is a marker's own share of steps over one."""
    w = np.array(STEPS + [STEPS[-1] * 10 ** (-k / 2) for k in range(1, 8)])
    w /= w.sum()
    return w if multi is None else np.concatenate([[1 - multi], multi * w[1:] / w[1:].sum()])


def folded(shares: np.ndarray, up: float, mutations: int, most: int) -> np.ndarray:
    """P(|sum of m steps| = g) as [m, g], for steps up with probability `up`."""
    step = np.concatenate([(1 - up) * shares[::-1], [0.0], up * shares])
    dist, out = np.ones(1), np.zeros((mutations + 1, most + 1))
    for m in range(mutations + 1):
        mid = len(dist) // 2
        sides = dist[mid:].copy()
        sides[1:] += dist[:mid][::-1]
        n = min(len(sides), most + 1)
        out[m, :n] = sides[:n]
        dist = np.convolve(dist, step)
    return out


def str_step_table(spark: SparkSession, multi: float | None = None, up: float = 0.5, mutations: int = MOST_MUTATIONS, most: int = 40) -> DataFrame:
    """(m, g, p): probability of a distance of g repeats after m mutations, of the published table in its range unless a marker has its own steps."""
    table = folded(step_shares(multi), up, mutations, most)
    if multi is None and up == 0.5:
        n = min(mutations, 10) + 1
        table[:n, :11] = np.array(PUBLISHED).T[:n]
    return spark.createDataFrame([(m, g, float(p)) for (m, g), p in np.ndenumerate(table) if p > 1e-9], "m int, g int, p double")


#: Fixed value: the table has up to 40 mutations, an age mixes those up to 30.
MOST = 30


def str_marker_age(distances: DataFrame, steps: DataFrame, key: list[str], resolution: float, bins: int) -> DataFrame:
    """(*key, g, bin, mass) of distinct distances (key, g, rate per generation): Poisson ages of m mutations, mixed by P(g | m)."""
    rows = distances.select(*key, "g", "rate").distinct().where("rate > 0")
    named = rows.withColumn("_id", F.concat_ws("|", *[F.col(k).cast("string") for k in key], "g"))
    comps = named.join(F.broadcast(steps.where(F.col("m") <= MOST)), "g").select("_id", "m", "p", (F.col("rate") / GENERATION).alias("rate"))  # steps: 41 x 41 rows at most
    part = ages.pdf_poisson(comps.withColumn("_c", F.concat_ws("#", "_id", "m")), "_c", resolution, bins)
    weighed = part.join(comps.select(F.concat_ws("#", "_id", "m").alias("_c"), "_id", "p"), "_c")
    return ages.pdf_mixture(weighed, "_id", "p").join(named.select("_id", *key, "g"), "_id").select(*key, "g", "bin", "mass")


def str_star_age(testers: DataFrame, modal: DataFrame, marker_ages: DataFrame, resolution: float) -> DataFrame:
    """Ages of nodes from testers (node_id, sample_id, marker, repeats) as a star around the modal motif (node_id, marker, modal).

    Equal distances are counted first, so a node costs a row per (marker, distance, bin),
    however many testers it has.
    """
    marker_ages = cut_lineage(marker_ages)  # three joins read it
    d = testers.join(modal, ["node_id", "marker"]).withColumn("g", F.abs(F.col("repeats") - F.col("modal")).cast("int"))
    counts = d.groupBy("node_id", "marker", "g").agg(F.count("*").alias("n"))
    terms = counts.join(marker_ages.where("mass > 0"), ["marker", "g"])
    used = d.join(marker_ages.select("marker", "g").distinct(), ["marker", "g"], "left_semi")
    facts = used.groupBy("node_id").agg(F.countDistinct("sample_id").alias("testers"), F.countDistinct("marker").alias("markers"), F.sum("g").alias("distance"), F.count("*").alias("_n"))
    logs = terms.groupBy("node_id", "bin").agg(F.sum(F.col("n") * F.log("mass")).alias("lw"), F.sum("n").alias("_c")).join(facts.select("node_id", "_n"), "node_id").where("_c = _n")
    return ages.pdf_stats(ages.normalised(logs, "node_id", "lw"), "node_id", resolution).join(facts.drop("_n"), "node_id")


def motif_pair_ages(pairs: DataFrame, marker_ages: DataFrame, key: str, bins: int) -> DataFrame:
    """(key, mass), arrays: the time between two motifs, the product over rows (key, marker, g) of their markers' ages.

    Rows whose marker and distance have no age are left out; equal rows are counted first.  Keys
    that tell the same are worked once, so a bin is no row and few arrays are multiplied.
    """
    counts = pairs.groupBy(key, "marker", "g").agg(F.count("*").alias("n")).join(marker_ages.select("marker", "g").distinct(), ["marker", "g"], "left_semi")
    told = cut_lineage(counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("marker", "g", "n"))).alias("told")))  # one key's markers
    kinds = cut_lineage(told.groupBy("told").agg(F.min(key).alias("kind")))
    by = agetree.arrays(marker_ages.withColumn("_key", F.struct("marker", "g")), "_key", bins, "age").select("_key.marker", "_key.g", "age")
    rows = kinds.select("kind", F.explode("told").alias("t")).select("kind", "t.*").hint("merge").join(by, ["marker", "g"])
    logs = rows.select("kind", F.transform("age", lambda x: F.when(x > 0, F.log(x) * F.col("n")).otherwise(F.lit(float("-inf")))).alias("logs"))
    found = ages.with_masses(ages.summed(logs, "kind", "logs"), lambda frame: ages.shares_of(ages.stacked(frame["logs"]))).select("kind", "mass")
    return meet_in_tiles(kinds.hint("merge").join(found, "kind").select("told", "mass"), told, ["told"]).select(key, "mass")


def str_propagate(motifs: DataFrame, edges: DataFrame, testers: DataFrame, marker_ages: DataFrame, resolution: float, bins: int, size: int = agetree.SIZE) -> DataFrame:
    """(node_id, bin, mass) of `str_age_arrays`, bins without mass left out."""
    return agetree.masses(str_age_arrays(motifs, edges, testers, marker_ages, resolution, bins, size), "mass")


def str_age_arrays(motifs: DataFrame, edges: DataFrame, testers: DataFrame, marker_ages: DataFrame, resolution: float, bins: int, size: int = agetree.SIZE) -> DataFrame:
    """(node_id, mass), arrays: the age of each node that testers below it date, from its children up.

    motifs: reconstructed (node_id, marker, value); testers: (node_id, sample_id, marker,
    repeats); marker_ages: (marker, g, bin, mass).  A node's age is the product of its children's
    ages, each with the time between the child's and its own motif added, and of its testers'
    times to its motif.  A child that shares no marker adds no time.  All branch and tester times
    are made at once; then subtrees of up to `size` nodes are worked whole (`agetree`).  Evidence
    that excludes itself dates nothing; of several parents the least counts.
    """
    marker_ages = cut_lineage(marker_ages)
    motifs = cut_lineage(motifs.select("node_id", "marker", "value"))
    links = cut_lineage(current_rows(edges).where("child_id <> parent_id").groupBy(F.col("child_id").cast("long").alias("child_id")).agg(F.min("parent_id").cast("long").alias("parent_id")))
    child = motifs.select(F.col("node_id").alias("child_id"), "marker", F.col("value").alias("a"))
    above = motifs.select(F.col("node_id").alias("parent_id"), "marker", F.col("value").alias("b"))
    pairs = child.join(links, "child_id").join(above, ["parent_id", "marker"]).select("child_id", "marker", F.abs(F.col("a") - F.col("b")).cast("int").alias("g"))
    branch = motif_pair_ages(pairs, marker_ages, "child_id", bins).select(F.col("child_id").alias("node_id"), F.col("mass").alias("branch"))
    tips = testers.join(motifs, ["node_id", "marker"]).select(F.col("node_id").cast("long").alias("node_id"), "marker", F.abs(F.col("repeats") - F.col("value")).cast("int").alias("g"))
    own = cut_lineage(motif_pair_ages(tips, marker_ages, "node_id", bins))
    impossible = F.lit(float("-inf"))
    logs = own.select("node_id", F.transform("mass", lambda x: F.when(x > 0, F.log(x)).otherwise(impossible)).alias("logs"))
    out = agetree.propagate(agetree.tree_rows(links, own), logs, branch, lambda x, y: ages.convolved(x, y, bins), size)
    return cut_lineage(out.select("node_id", "mass"))


def str_signatures(modal: DataFrame, manual: DataFrame) -> DataFrame:
    """(node_id, marker, value, confidence, n, method): modal rows but where a curator set a value."""
    by_hand = manual.select("node_id", "marker", "value", F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("long").alias("n"), F.lit("MANUAL").alias("method"))
    free = modal.join(manual.select("node_id", "marker"), ["node_id", "marker"], "left_anti")
    return free.select("node_id", "marker", F.col("modal").alias("value"), "confidence", "n", F.lit("MODAL").alias("method")).unionByName(by_hand)


def nrr_prior(t, nrr: float):
    """Weight of an age of t years before a population that multiplies by nrr each generation."""
    return F.exp(t / GENERATION * F.log(F.lit(nrr)))


def combined_age(masses: DataFrame, edges: DataFrame, offsets: DataFrame, curated: DataFrame, resolution: float, bins: int) -> DataFrame:
    """(node_id, tmrca, lo, hi, formed, terms) from masses (node_id, term, bin, mass) of SNP, anchor and STR ages, or (node_id, term, mass) in arrays.

    The product of a node's terms, or their inverse-variance Gaussian where they have no bin in
    common.  A parent is as old as its oldest child at least, along nodes that have an age; the
    interval moves along and is widened by the rate's error.  formed adds the branch's years
    (node_id, years).  Curated nodes (node_id, tmrca, formed) keep their years.
    """
    kept = masses.select("node_id", "term", "mass") if ages.in_arrays(masses) else agetree.arrays(masses.withColumn("_k", F.struct("node_id", "term")), "_k", bins, "mass").select("_k.node_id", "_k.term", "mass")
    kept = cut_lineage(kept)
    product = cut_lineage(ages.product_arrays(kept, "node_id"))
    apart = kept.join(product.select("node_id"), "node_id", "left_anti")
    each = ages.pdf_stats(apart.withColumn("_k", F.struct("node_id", "term")), "_k", resolution).select("_k.node_id", "median", "lo", "hi")
    means = combine_inverse_variance(each.select("node_id", F.col("median").alias("ybp"), F.greatest((F.col("hi") - F.col("lo")) / (2 * 1.96), F.lit(1.0)).alias("sigma")))
    gauss = ages.gaussian_arrays(means.select("node_id", F.col("ybp").alias("mean"), "sigma"), resolution, bins).select("node_id", "mass")
    n = kept.groupBy("node_id").agg(F.countDistinct("term").alias("terms"))
    est = ages.pdf_stats(product.union(gauss), "node_id", resolution).select("node_id", F.rint("median").alias("med"), F.rint("lo").alias("lo"), F.rint("hi").alias("hi")).join(n, "node_id")
    est = cut_lineage(est)
    ids = est.select("node_id")
    dated = current_rows(edges).join(ids.withColumnRenamed("node_id", "child_id"), "child_id", "left_semi").join(ids.withColumnRenamed("node_id", "parent_id"), "parent_id", "left_semi")
    below = tree_closure(dated, ids).join(est.select(F.col("node_id").alias("descendant_id"), "med"), "descendant_id").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.max("med").alias("tmrca"))
    r = RATE_ERROR * F.col("tmrca")
    low, high = F.greatest(F.col("med") - F.col("lo"), F.lit(0.0)), F.greatest(F.col("hi") - F.col("med"), F.lit(0.0))
    out = est.join(below, "node_id").join(offsets.select("node_id", "years"), "node_id", "left").join(curated.select("node_id", F.col("tmrca").alias("_t"), F.col("formed").alias("_f")), "node_id", "left")
    return out.select(
        "node_id", F.coalesce("_t", "tmrca").alias("tmrca"), F.rint(F.greatest(F.col("tmrca") - F.sqrt(low * low + r * r), F.lit(0.0))).alias("lo"), F.rint(F.col("tmrca") + F.sqrt(high * high + r * r)).alias("hi"),
        F.when(F.col("_t").isNotNull(), F.col("_f")).otherwise(F.col("tmrca") + F.coalesce("years", F.lit(0.0))).alias("formed"), "terms")
