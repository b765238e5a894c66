"""Report aggregations, ranked picks and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna, scalars


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def lww_latest(commits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Last writer wins: the row of the greatest time_us of a key, the later arrival of equals; deleted keys go."""
    keys = keys or ["collection", "did", "rkey"]
    rest = [c for c in commits.columns if c not in keys]
    last = commits.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("time_us", "arrival")).alias("r"))
    return last.select(*keys, "r.*").where("operation <> 'delete'")


def coverage_by_build(coverage: DataFrame) -> DataFrame:
    """Libraries and mean depth of each reference build, most sampled first."""
    return coverage.groupBy("build").agg(F.count("*").alias("n"), F.avg("depth").alias("avg_depth"), F.avg("pct_30x").alias("avg_30x")).orderBy(F.desc("n"), "build")


def coverage_by_lab_test(coverage: DataFrame) -> DataFrame:
    """Libraries, mean depth and mean share at 10x of each lab, test type and expected depth (null is one of its own)."""
    return coverage.groupBy(F.coalesce("lab", "facility").alias("lab"), "test_type", "expected_depth").agg(F.countDistinct("run_id").alias("libraries"), F.avg("depth").alias("avg_depth"), F.avg("pct_10x").alias("avg_10x"))


SNP_RATE = 8.33e-10


def contig_benchmarks(coverage: DataFrame) -> DataFrame:
    """Per vendor, test, build and canonical contig: n, means and variation; years per SNP on chrY."""

    def cv(x: str) -> Column:
        return F.when((F.count(x) >= 2) & (F.avg(x) != 0), F.stddev_samp(x) / F.avg(x))

    rows = coverage.select("*", (F.col("length") - F.col("ref_n")).alias("usable")).withColumns({"contig": dna.canonical_contig(F.col("contig")), "vendor": F.coalesce("lab", "facility")})
    out = rows.groupBy("vendor", "test_type", "build", "contig").agg(
        F.count("*").alias("n"), *[e for x in ("callable", "depth", "poor_mq", "usable") for e in (F.avg(x).alias(f"avg_{x}"), cv(x).alias(f"cv_{x}"))],
    )
    return out.withColumn("years_per_snp", F.when((F.col("contig") == "chrY") & (F.col("avg_callable") > 0), 1 / (F.col("avg_callable") * SNP_RATE)))


def contig_benchmark_options(coverage: DataFrame) -> DataFrame:
    """Distinct values of each filter of the benchmarks."""
    rows = coverage.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in (
        ("vendor", F.coalesce("lab", "facility")), ("test_type", F.col("test_type")), ("build", F.col("build")), ("contig", dna.canonical_contig(F.col("contig"))))])).alias("x"))
    return rows.select("x.*").where("value is not null").distinct()


def coverage_norms(coverage: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """Per test type: n, quartiles of depth, median shares at 10x, 20x and 30x, and, in full, median marker counts.

    markers: (test_type, y_markers, mt_markers) of genotypes; test types that only one side has stay.
    """
    norms = coverage.groupBy("test_type").agg(
        F.count("*").alias("n"), *[F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY depth)").alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75)],
        *[F.expr(f"percentile_cont(0.5) WITHIN GROUP (ORDER BY {c})").alias(f"median_{c[4:]}") for c in ("pct_10x", "pct_20x", "pct_30x") if c in coverage.columns],
    )
    if markers is None:
        return norms
    counts = markers.groupBy("test_type").agg(*[F.expr(f"percentile_cont(0.5) WITHIN GROUP (ORDER BY {c})").alias(f"median_{c}") for c in ("y_markers", "mt_markers")])
    return norms.join(counts, "test_type", "full_outer")


def test_type_catalog(tests: DataFrame, norms: DataFrame) -> DataFrame:
    return tests.join(norms, "test_type", "left")


def haplogroup_distribution(samples: DataFrame) -> DataFrame:
    """Counts of each call of each type, from call columns y and mt."""
    return samples.select(F.explode(F.array(F.struct(F.lit("Y").alias("kind"), F.col("y").alias("call")), F.struct(F.lit("MT").alias("kind"), F.col("mt").alias("call")))).alias("x")).select("x.*").where("call is not null").groupBy("kind", "call").agg(F.count("*").alias("n"))


def shares(quantities: DataFrame) -> DataFrame:
    """Percentages of each sample's quantities by population."""
    total = F.sum("quantity").over(Window.partitionBy("sample_id"))
    return quantities.select("sample_id", "population", (100 * F.col("quantity") / total).alias("pct"))


def ancestry_distribution(quantities: DataFrame) -> DataFrame:
    return shares(quantities).groupBy("population").agg(F.count("*").alias("n"), F.avg("pct").alias("avg_pct"))


def placed_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy(F.col("terminal").alias("node_id")).agg(F.count("*").alias("n"))


def modal_haplotype(profiles: DataFrame) -> DataFrame:
    """Commonest value per node and marker, the smaller of equals, with its share."""
    counts = profiles.groupBy("node_id", "marker", "repeats").agg(F.count("*").alias("n"))
    w = Window.partitionBy("node_id", "marker")
    ranked = counts.select("*", F.sum("n").over(w).alias("total"), F.row_number().over(w.orderBy(F.desc("n"), "repeats")).alias("rn"))
    return ranked.where("rn = 1").select("node_id", "marker", F.col("repeats").alias("modal"), (F.col("n") / F.col("total")).alias("confidence"), F.col("total").alias("n"))


# Names that tell no laboratory.
GENERIC_CENTERS = ["self", "unknown", "n/a", "other", ""]


def real_observations(observations: DataFrame) -> DataFrame:
    return observations.where(~F.lower(F.trim("lab")).isin(GENERIC_CENTERS) & F.col("lab").isNotNull())


def instrument_totals(observations: DataFrame, as_of: str) -> DataFrame:
    """Per instrument: observations, distinct citizens, mean confidence weight, best recency factor."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", "observed_at"))
    return real_observations(observations).groupBy("instrument").agg(
        F.count("*").alias("observations"), F.countDistinct("citizen").alias("citizens"), F.avg(scalars.confidence_weight(F.col("confidence"))).alias("weight"),
        F.max(scalars.recency_factor(age.cast("double"))).alias("recency"))


def instrument_claims(observations: DataFrame) -> DataFrame:
    return real_observations(observations).groupBy("instrument", "lab").agg(F.count("*").alias("observations"), F.countDistinct("citizen").alias("citizens"))


def dominant_value(claims: DataFrame) -> DataFrame:
    """The lab with most citizens, then most observations, then by name."""
    return latest_per_key(claims, ["instrument"], [F.desc("citizens"), F.desc("observations"), F.asc("lab")])


def instrument_consensus(observations: DataFrame, as_of: str, agreement: float = 0.9, least: int = 2) -> DataFrame:
    """A proposal per instrument: dominant lab, agreement, confidence, READY from `agreement` and `least` citizens on."""
    totals, top = instrument_totals(observations, as_of), dominant_value(instrument_claims(observations))
    both = totals.join(top.select("instrument", "lab", F.col("observations").alias("lab_obs"), F.col("citizens").alias("lab_citizens")), "instrument")
    share = F.col("lab_obs") / F.col("observations")
    confidence = 0.4 * share + 0.3 * F.least(F.col("lab_citizens") / 5.0, F.lit(1.0)) + 0.2 * F.col("weight") + 0.1 * F.col("recency")
    return both.select("instrument", "lab", "observations", "citizens", share.alias("agreement"), confidence.alias("confidence"), F.when((share >= agreement) & (F.col("citizens") >= least), "READY").otherwise("PENDING").alias("status"))


def studies_with_samples(studies: DataFrame, samples: DataFrame) -> DataFrame:
    """Each study with its samples as a sorted array, empty without any."""
    held = samples.groupBy("study").agg(F.array_sort(F.collect_set("sample_id")).alias("samples"))
    return studies.join(held, "study", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<bigint>")))


def identifier_collisions(identifiers: DataFrame) -> DataFrame:
    """(a, b, shared): pairs of samples that share an external id.

    Samples with the same ids are one kind; kinds meet on an id, and their members then meet in
    tiles, so no pair of samples is shuffled and no id is one task.
    """
    from .similarity import meet_in_tiles
    from .tree import cut_lineage

    held = identifiers.dropna(subset=["identifier", "sample_id"]).groupBy("sample_id").agg(F.array_sort(F.collect_set("identifier")).alias("v"))  # one sample's ids
    named = held.groupBy("v").agg(F.min("sample_id").alias("kind"))
    members = cut_lineage(held.join(named, "v").select("kind", "sample_id", "v"))
    kinds = members.where("kind = sample_id").select("kind", "v")
    ids = cut_lineage(kinds.select("kind", F.explode("v").alias("identifier")))
    x, y = ids.withColumnRenamed("kind", "x"), ids.withColumnRenamed("kind", "y")
    other = x.join(y, "identifier").where("x < y").groupBy("x", "y").agg(F.count("*").alias("shared"))
    pairs = kinds.select(F.col("kind").alias("x"), F.col("kind").alias("y"), F.size("v").cast("long").alias("shared")).unionByName(other)
    one = pairs.join(members.select(F.col("kind").alias("x"), F.col("sample_id").alias("p")), "x")
    both = meet_in_tiles(one, members.select(F.col("kind").alias("y"), F.col("sample_id").alias("q")), ["y"]).where("x <> y OR p < q")
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "shared")


def reputation_scores(ledger: DataFrame, once: list[str]) -> DataFrame:
    """Sum of events by user; kinds in `once` count one time."""
    single = ledger.where(F.col("kind").isin(once)).groupBy("user_id", "kind").agg(F.min_by("points", "event_id").alias("points"))
    return ledger.where(~F.col("kind").isin(once)).select("user_id", "kind", "points").unionByName(single).groupBy("user_id").agg(F.sum("points").alias("score"))


def post_scores(votes: DataFrame) -> DataFrame:
    """Net score per post: repeating a vote takes it back, another replaces it; votes for oneself don't count."""
    log = votes.where("voter <> author").groupBy("post_id", "author", "voter").agg(F.array_sort(F.collect_list(F.struct("vote_id", "vote"))).alias("log"))
    last = F.aggregate("log", F.lit(0), lambda acc, x: F.when(acc == x["vote"], 0).otherwise(x["vote"]))
    return log.select("post_id", "author", last.alias("v")).groupBy("post_id", "author").agg(F.sum("v").alias("score"))


def feed_listing(posts: DataFrame, replies: DataFrame, scores: DataFrame) -> DataFrame:
    """Posts with reply counts and scores, pinned first, then newest."""
    n = replies.groupBy("post_id").agg(F.count("*").alias("replies"))
    return posts.join(n, "post_id", "left").join(scores, "post_id", "left").fillna(0, ["replies", "score"]).orderBy(F.desc("pinned"), F.desc("posted"), "post_id")


def thread_inbox(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv_id, status, messages, last_at, unread_user, unread_team) of every thread that isn't deleted.

    threads: (conv_id, closed, deleted, user_read, team_read), the times of last reading, null for
    never; messages: (conv_id, from_team, at).  A thread is closed, else replied if its last message
    is the team's (of two at one time the team's counts as last), else open.  A side has something
    unread where the other one wrote after it last read.
    """
    team = F.col("from_team")
    told = messages.groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.max("at").alias("last_at"), F.max_by("from_team", F.struct("at", "from_team")).alias("_team"), F.max(F.when(team, F.col("at"))).alias("_by_team"), F.max(F.when(~team, F.col("at"))).alias("_by_user"))
    rows = threads.where(~F.coalesce("deleted", F.lit(False))).join(told, "conv_id", "left")

    def unread(written: str, read: str) -> Column:
        return F.col(written).isNotNull() & (F.col(read).isNull() | (F.col(written) > F.col(read)))

    status = F.when(F.coalesce("closed", F.lit(False)), "closed").when(F.col("_team"), "replied").otherwise("open")
    return rows.select("conv_id", status.alias("status"), F.coalesce("messages", F.lit(0)).alias("messages"), "last_at", unread("_by_team", "user_read").alias("unread_user"), unread("_by_user", "team_read").alias("unread_team"))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of the ordered rows with the total; sizes from 1 to 200."""
    size = min(200, max(1, size))
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size).crossJoin(F.broadcast(total))


def topk_per_target(candidates: DataFrame, dismissed: DataFrame, k: int = 50) -> DataFrame:
    """The k best of each target; dismissed pairs are taken out after the cut."""
    w = Window.partitionBy("target").orderBy(F.desc("score"), "other")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).join(dismissed, ["target", "other"], "left_anti")


def count_checks(counts: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """ok or MISMATCH for each pair of tables."""
    out = None
    for name, legacy, target in counts:
        row = legacy.agg(F.count("*").alias("legacy")).crossJoin(target.agg(F.count("*").alias("target"))).select(F.lit(name).alias("name"), "legacy", "target", F.when(F.col("legacy") == F.col("target"), "ok").otherwise("MISMATCH").alias("status"))
        out = row if out is None else out.unionByName(row)
    return out


def claim_fold(claims: DataFrame, single: list[str], public: str = "PUBLIC", project: str = "PROJECT:") -> DataFrame:
    """(subject, scope, predicate, state, view) of every view: what a scope sees of a subject.

    claims: (claim_id, subject, scope, predicate, val, author, created_at, supersedes, retracted).
    Live are claims that are neither retracted nor superseded by a live one's row.  A project's
    view holds its own and the public claims of each subject that it has any claim about, live or
    not; the public view holds public ones.  A predicate in `single` with several values is
    DISPUTED, all else SETTLED.  view: an array of the live claims in the order they were made.
    """
    valid = claims.where(~F.coalesce("retracted", F.lit(False)))
    replaced = valid.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("claim_id")).distinct()
    heads = valid.join(replaced, "claim_id", "left_anti")
    projects = claims.where(F.col("scope").startswith(project)).select("subject", F.col("scope").alias("to")).distinct()
    shown = heads.where(F.col("scope") == public).join(projects, "subject").withColumn("scope", F.col("to")).drop("to")
    entry = F.struct("created_at", "claim_id", "val", "author")
    folded = heads.unionByName(shown).groupBy("subject", "scope", "predicate").agg(F.array_sort(F.collect_list(entry)).alias("view"), F.count_distinct("val").alias("_values"), F.count_if(F.col("val").isNull()).alias("_nulls"))
    several = F.col("_values") + (F.col("_nulls") > 0).cast("int") > 1
    return folded.select("subject", "scope", "predicate", F.when(F.col("predicate").isin(single) & several, "DISPUTED").otherwise("SETTLED").alias("state"), "view")


def ttl_expire(df: DataFrame, expires: str, as_of: str) -> DataFrame:
    return df.where(F.col(expires) > F.lit(as_of).cast("timestamp"))
