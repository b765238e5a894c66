"""Queries of the report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna, scalars
from ..operators import ages, reports, similarity

AS_OF = "2024-01-31 00:00:00"
REGISTERED: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(build):
        REGISTERED[build.__name__] = (build, sql)
        return build

    return add


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


CANON = """CASE WHEN upper(regexp_replace(regexp_replace({0}, '^(chr|CHR)', ''), '_hs1$', '')) IN ('1','2','3','4','5','6','7','8','9','10','11','12','13','14','15','16','17','18','19','20','21','22','X','Y')
    THEN 'chr' || upper(regexp_replace(regexp_replace({0}, '^(chr|CHR)', ''), '_hs1$', '')) WHEN upper(regexp_replace(regexp_replace({0}, '^(chr|CHR)', ''), '_hs1$', '')) IN ('M', 'MT') THEN 'chrM' ELSE {0} END"""


@query("""SELECT collection, did, rkey, time_us, arrival, value FROM (SELECT *, row_number() OVER (PARTITION BY collection, did, rkey ORDER BY time_us DESC, arrival DESC) AS rn FROM fx_commit) WHERE rn = 1 AND operation <> 'delete'""")
def lww_latest(fx):
    return reports.lww_latest(fx.commit).select("collection", "did", "rkey", "time_us", "arrival", "value")


@query("""SELECT collection, did, rkey, time_us, operation FROM (SELECT *, row_number() OVER (PARTITION BY collection, did, rkey ORDER BY time_us DESC, arrival DESC) AS rn FROM fx_commit) WHERE rn = 1 AND operation = 'delete'""")
def tombstones(fx):
    """Keys whose last event by time is a delete."""
    keys = ["collection", "did", "rkey"]
    return reports.latest_per_key(fx.commit, keys, [F.desc("time_us"), F.desc("arrival")]).where("operation = 'delete'").select(*keys, "time_us", "operation")


@query("""SELECT build, count(*) AS n, round(avg(depth), 6) AS avg_depth, round(avg(pct_30x), 6) AS avg_30x FROM fx_coverage GROUP BY build""")
def coverage_by_build(fx):
    return rounded(reports.coverage_by_build(fx.coverage), "avg_depth", "avg_30x")



@query(f"""WITH x AS (SELECT coalesce(lab, facility) AS vendor, test_type, build, {CANON.format('contig')} AS contig, callable, depth, poor_mq, length - ref_n AS usable FROM fx_coverage),
    g AS (SELECT vendor, test_type, build, contig, count(*) AS n, avg(callable) AS a1, stddev_samp(callable) AS s1, avg(depth) AS a2, stddev_samp(depth) AS s2, avg(poor_mq) AS a3, stddev_samp(poor_mq) AS s3, avg(usable) AS a4, stddev_samp(usable) AS s4 FROM x GROUP BY 1, 2, 3, 4)
    SELECT vendor, test_type, build, contig, n, round(a1, 6) AS avg_callable, round(CASE WHEN n >= 2 AND a1 <> 0 THEN s1 / a1 END, 6) AS cv_callable, round(a2, 6) AS avg_depth, round(CASE WHEN n >= 2 AND a2 <> 0 THEN s2 / a2 END, 6) AS cv_depth,
    round(a3, 6) AS avg_poor_mq, round(CASE WHEN n >= 2 AND a3 <> 0 THEN s3 / a3 END, 6) AS cv_poor_mq, round(a4, 6) AS avg_usable, round(CASE WHEN n >= 2 AND a4 <> 0 THEN s4 / a4 END, 6) AS cv_usable,
    round(CASE WHEN contig = 'chrY' AND a1 > 0 THEN 1 / (a1 * 8.33e-10) END, 6) AS years_per_snp FROM g""")
def contig_benchmarks(fx):
    names = [f"{k}_{x}" for x in ("callable", "depth", "poor_mq", "usable") for k in ("avg", "cv")] + ["years_per_snp"]
    return rounded(reports.contig_benchmarks(fx.coverage), *names)


@query(f"""SELECT DISTINCT kind, value FROM (SELECT 'vendor' AS kind, coalesce(lab, facility) AS value FROM fx_coverage UNION ALL SELECT 'test_type', test_type FROM fx_coverage UNION ALL SELECT 'build', build FROM fx_coverage UNION ALL SELECT 'contig', {CANON.format('contig')} FROM fx_coverage) WHERE value IS NOT NULL""")
def contig_benchmark_options(fx):
    return reports.contig_benchmark_options(fx.coverage)


NORMS = """SELECT test_type, count(*) AS n, quantile_cont(depth, 0.25) AS p25, quantile_cont(depth, 0.5) AS p50, quantile_cont(depth, 0.75) AS p75, quantile_cont(pct_30x, 0.5) AS median_30x FROM fx_coverage GROUP BY test_type"""



@query(f"""WITH n AS ({NORMS}) SELECT t.test_type, n.n, n.p50 FROM (SELECT DISTINCT test_type FROM fx_coverage UNION ALL SELECT 'PANEL') t LEFT JOIN n ON t.test_type = n.test_type""")
def test_type_catalog(fx):
    tests = fx.coverage.select("test_type").distinct().union(fx.spark.sql("SELECT 'PANEL'"))
    return reports.test_type_catalog(tests, reports.coverage_norms(fx.coverage)).select("test_type", "n", "p50")


@query(f"""SELECT contig, {CANON.format('contig')} AS canonical, count(*) AS n FROM fx_coverage GROUP BY 1, 2""")
def canonical_contig(fx):
    return fx.coverage.groupBy("contig", dna.canonical_contig(F.col("contig")).alias("canonical")).agg(F.count("*").alias("n"))


@query(f"""SELECT c AS contig, CASE WHEN c = 'chr1' THEN 1 WHEN c = 'chrX' THEN 23 WHEN c = 'chrY' THEN 24 WHEN c = 'chrM' THEN 25 ELSE 26 END AS rank FROM (SELECT DISTINCT {CANON.format('contig')} AS c FROM fx_coverage)""")
def karyotype_order(fx):
    rows = fx.coverage.select(dna.canonical_contig(F.col("contig")).alias("contig")).distinct()
    return rows.select("contig", dna.karyotype_order(F.col("contig"))["rank"].alias("rank"))


@query("""SELECT kind, call, count(*) AS n FROM (SELECT 'Y' AS kind, terminal AS call FROM fx_sample UNION ALL SELECT 'MT', mt FROM fx_sample) WHERE call IS NOT NULL GROUP BY 1, 2""")
def haplogroup_distribution(fx):
    return reports.haplogroup_distribution(fx.sample.withColumnRenamed("terminal", "y"))


@query("""SELECT population, count(*) AS n, round(avg(100 * quantity / total), 6) AS avg_pct FROM (SELECT *, sum(quantity) OVER (PARTITION BY sample_id) AS total FROM fx_share) GROUP BY population""")
def ancestry_distribution(fx):
    return rounded(reports.ancestry_distribution(fx.share), "avg_pct")


@query("""SELECT terminal AS node_id, count(*) AS n FROM fx_sample GROUP BY terminal""")
def placed_counts(fx):
    return reports.placed_counts(fx.sample)


MODAL = """SELECT node_id, marker, repeats AS modal, n * 1.0 / total AS confidence, total AS n FROM (SELECT *, sum(n) OVER (PARTITION BY node_id, marker) AS total, row_number() OVER (PARTITION BY node_id, marker ORDER BY n DESC, repeats) AS rn FROM (SELECT node_id, marker, repeats, count(*) AS n FROM fx_str GROUP BY 1, 2, 3)) WHERE rn = 1"""


@query(f"SELECT node_id, marker, modal, round(confidence, 6) AS confidence, n FROM ({MODAL})")
def modal_haplotype(fx):
    return rounded(reports.modal_haplotype(fx.str), "confidence")


@query(f"""SELECT s.sample_id, m.node_id, sum(abs(s.repeats - m.modal)) AS distance, count(*) AS compared FROM fx_str s JOIN ({MODAL}) m ON s.marker = m.marker GROUP BY 1, 2""")
def str_distance(fx):
    return similarity.str_distance(fx.str, reports.modal_haplotype(fx.str))


@query(f"""SELECT sample_id, node_id, distance, compared, rank FROM (SELECT d.*, row_number() OVER (PARTITION BY d.sample_id ORDER BY distance, compared DESC, node_id) AS rank FROM
    (SELECT s.sample_id, m.node_id, sum(abs(s.repeats - m.modal)) AS distance, count(*) AS compared FROM fx_str s JOIN ({MODAL}) m ON s.marker = m.marker GROUP BY 1, 2) d
    JOIN (SELECT sample_id, least(count(*), 8) AS needed FROM fx_str GROUP BY 1) z ON d.sample_id = z.sample_id WHERE compared >= needed) WHERE rank <= 3""")
def str_predict(fx):
    return similarity.str_predict(fx.str, reports.modal_haplotype(fx.str))


@query("""SELECT sample_id, node_id, distance, compared, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY distance, compared DESC, node_id) AS rank FROM
    (SELECT s.sample_id, m.node_id, sum(abs(s.repeats - m.modal)) AS distance, count(*) AS compared FROM fx_str s JOIN (""" + MODAL + """) m ON s.marker = m.marker GROUP BY 1, 2)) WHERE rank <= 1""")
def ranked_prediction(fx):
    near = similarity.str_distance(fx.str, reports.modal_haplotype(fx.str))
    w_order = [F.asc("distance"), F.desc("compared"), F.asc("node_id")]
    return reports.latest_per_key(near, ["sample_id"], w_order).withColumn("rank", F.lit(1))


WEIGHT = "CASE confidence WHEN 'KNOWN' THEN 1.0 WHEN 'INFERRED' THEN 0.7 ELSE 0.3 END"
REAL = "FROM fx_instrument WHERE lower(trim(lab)) NOT IN ('self', 'unknown', 'n/a', 'other', '') AND lab IS NOT NULL"
TOTALS = f"""SELECT instrument, count(*) AS observations, count(DISTINCT citizen) AS citizens, avg({WEIGHT}) AS weight,
    max(CASE WHEN d <= 30 THEN 1.0 WHEN d >= 365 THEN 0.0 ELSE 1 - (d - 30) / 335 END) AS recency FROM (SELECT *, (epoch(TIMESTAMP '{AS_OF}') - epoch(date_trunc('second', observed_at))) / 86400.0 AS d {REAL}) GROUP BY instrument"""


@query(f"SELECT instrument, observations, citizens, round(weight, 6) AS weight, round(recency, 6) AS recency FROM ({TOTALS})")
def instrument_totals(fx):
    return rounded(reports.instrument_totals(fx.instrument, AS_OF), "weight", "recency")


@query(f"SELECT instrument, lab, count(*) AS observations, count(DISTINCT citizen) AS citizens {REAL} GROUP BY 1, 2")
def instrument_claims(fx):
    return reports.instrument_claims(fx.instrument)


DOMINANT = f"SELECT instrument, lab, observations, citizens FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY citizens DESC, observations DESC, lab) AS rn FROM (SELECT instrument, lab, count(*) AS observations, count(DISTINCT citizen) AS citizens {REAL} GROUP BY 1, 2)) WHERE rn = 1"


@query(DOMINANT)
def dominant_value(fx):
    return reports.dominant_value(reports.instrument_claims(fx.instrument))


@query(f"""SELECT t.instrument, d.lab, t.observations, t.citizens, round(d.observations * 1.0 / t.observations, 6) AS agreement,
    round(0.4 * d.observations / t.observations + 0.3 * least(d.citizens / 5.0, 1.0) + 0.2 * t.weight + 0.1 * t.recency, 6) AS confidence,
    CASE WHEN d.observations * 1.0 / t.observations >= 0.9 AND t.citizens >= 2 THEN 'READY' ELSE 'PENDING' END AS status FROM ({TOTALS}) t JOIN ({DOMINANT}) d ON t.instrument = d.instrument""")
def instrument_consensus(fx):
    return rounded(reports.instrument_consensus(fx.instrument, AS_OF), "agreement", "confidence")


@query("""SELECT n_nationkey AS study, coalesce(s.samples, '') AS samples FROM nation LEFT JOIN (SELECT c_nationkey, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS samples FROM customer GROUP BY 1) s ON n_nationkey = c_nationkey""")
def studies_with_samples(fx):
    held = reports.studies_with_samples(fx.table("nation").select(F.col("n_nationkey").alias("study")), fx.table("customer").select(F.col("c_nationkey").alias("study"), F.col("c_custkey").alias("sample_id")))
    return held.select("study", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


@query("""SELECT a.sample_id AS a, b.sample_id AS b, count(DISTINCT a.donor_id) AS shared FROM fx_sample a JOIN fx_sample b ON a.donor_id = b.donor_id AND a.sample_id < b.sample_id GROUP BY 1, 2""")
def identifier_collisions(fx):
    return reports.identifier_collisions(fx.sample.select(F.col("donor_id").alias("identifier"), "sample_id"))


@query("""WITH l AS (SELECT event_id, user_id, event_type AS kind, event_id % 5 + 1 AS points FROM events)
    SELECT user_id, sum(points) AS score FROM (SELECT user_id, points FROM l WHERE kind <> 'error' UNION ALL SELECT user_id, points FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM l WHERE kind = 'error') WHERE rn = 1) GROUP BY user_id""")
def reputation_scores(fx):
    ledger = fx.table("events").select("event_id", "user_id", F.col("event_type").alias("kind"), (F.col("event_id") % 5 + 1).alias("points"))
    return reports.reputation_scores(ledger, ["error"])


@query("""SELECT post_id, author, CAST(sum(v) AS BIGINT) AS score FROM (SELECT post_id, author, voter, list_reduce(list_prepend(0, list(vote ORDER BY vote_id)), lambda x, y: CASE WHEN x = y THEN 0 ELSE y END) AS v FROM fx_vote WHERE voter <> author GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def post_scores(fx):
    return reports.post_scores(fx.vote)


@query("""WITH p AS (SELECT o_orderkey AS post_id, o_orderkey % 50 = 0 AS pinned, o_orderdate AS posted FROM orders), r AS (SELECT l_orderkey AS post_id, count(*) AS replies FROM lineitem GROUP BY 1)
    SELECT p.post_id, pinned, coalesce(replies, 0) AS replies FROM p LEFT JOIN r ON p.post_id = r.post_id""")
def feed_listing(fx):
    posts = fx.table("orders").select(F.col("o_orderkey").alias("post_id"), (F.col("o_orderkey") % 50 == 0).alias("pinned"), F.col("o_orderdate").alias("posted"))
    scores = fx.table("orders").select(F.col("o_orderkey").alias("post_id"), F.lit(0).alias("score"))
    return reports.feed_listing(posts, fx.table("lineitem").select(F.col("l_orderkey").alias("post_id")), scores).select("post_id", "pinned", "replies")


@query("""WITH t AS (SELECT conv_id, max(length(text)) % 5 = 0 AS closed, max(length(text)) % 11 = 0 AS deleted, CASE WHEN max(length(text)) % 3 > 0 THEN max(turn) - max(length(text)) % 3 END AS user_read, CASE WHEN max(length(text)) % 4 > 0 THEN max(turn) - max(length(text)) % 4 + 1 END AS team_read,
        count(*) AS messages, max(turn) AS last_at, max(CASE WHEN role <> 'user' THEN turn END) AS bt, max(CASE WHEN role = 'user' THEN turn END) AS bu FROM conversations GROUP BY 1)
    SELECT conv_id, CASE WHEN closed THEN 'closed' WHEN bt >= coalesce(bu, bt) THEN 'replied' ELSE 'open' END AS status, messages, last_at, bt IS NOT NULL AND (user_read IS NULL OR bt > user_read) AS unread_user, bu IS NOT NULL AND (team_read IS NULL OR bu > team_read) AS unread_team FROM t WHERE NOT coalesce(deleted, FALSE)""")
def thread_inbox(fx):
    """Every conversation, with what either side has not read; times of reading are made from the longest text."""
    c = fx.table("conversations")
    long, last = F.max(F.length("text")), F.max("turn")
    threads = c.groupBy("conv_id").agg((long % 5 == 0).alias("closed"), (long % 11 == 0).alias("deleted"), F.when(long % 3 > 0, last - long % 3).alias("user_read"), F.when(long % 4 > 0, last - long % 4 + 1).alias("team_read"))
    return reports.thread_inbox(threads, c.select("conv_id", (F.col("role") != "user").alias("from_team"), F.col("turn").alias("at")))


@query("""SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS total FROM part ORDER BY p_name, p_partkey LIMIT 200 OFFSET 200""")
def page(fx):
    return reports.page(fx.table("part").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 2, 500)


@query("""WITH c AS (SELECT a AS target, b AS other, cm AS score FROM fx_pair), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, other) AS rank FROM c)
    SELECT target, other, score, rank FROM r WHERE rank <= 10 AND NOT (target + other) % 5 = 0""")
def topk_per_target(fx):
    c = fx.pair.select(F.col("a").alias("target"), F.col("b").alias("other"), F.col("cm").alias("score"))
    return reports.topk_per_target(c, c.where((F.col("target") + F.col("other")) % 5 == 0).select("target", "other"), 10)


@query("""SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS legacy, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS target, CASE WHEN (SELECT count(*) FROM orders) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) THEN 'ok' ELSE 'MISMATCH' END AS status
    UNION ALL SELECT 'parts', (SELECT count(*) FROM part), (SELECT count(*) FROM part WHERE p_size > 0), CASE WHEN (SELECT count(*) FROM part) = (SELECT count(*) FROM part WHERE p_size > 0) THEN 'ok' ELSE 'MISMATCH' END""")
def count_checks(fx):
    return reports.count_checks([("orders", fx.table("orders"), fx.table("lineitem").select("l_orderkey").distinct()), ("parts", fx.table("part"), fx.table("part").where("p_size > 0"))])


@query("""SELECT event_id, user_id FROM events WHERE ts + INTERVAL 20 DAY > TIMESTAMP '2024-01-31 00:00:00'""")
def ttl_expire(fx):
    rows = fx.table("events").select("event_id", "user_id", (F.col("ts") + F.expr("INTERVAL 20 DAYS")).alias("expires_at"))
    return reports.ttl_expire(rows, "expires_at", AS_OF).select("event_id", "user_id")


@query("""SELECT instrument, round(max(CASE WHEN d <= 30 THEN 1.0 WHEN d >= 365 THEN 0.0 ELSE 1 - (d - 30) / 335 END), 6) AS factor FROM (SELECT instrument, (epoch(TIMESTAMP '2024-06-30 00:00:00') - epoch(date_trunc('second', observed_at))) / 86400.0 AS d FROM fx_instrument) GROUP BY 1""")
def recency_factor(fx):
    age = F.unix_timestamp(F.lit("2024-06-30 00:00:00").cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", "observed_at"))
    return rounded(fx.instrument.groupBy("instrument").agg(F.max(scalars.recency_factor(age.cast("double"))).alias("factor")), "factor")


@query("""SELECT node_id, support, CASE WHEN support IS NULL THEN 'UNKNOWN' WHEN support >= 95 THEN 'HIGH' WHEN support >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS bucket FROM (SELECT node_id, support * 2 AS support FROM fx_node)""")
def support_bucket(fx):
    rows = fx.node.select("node_id", (F.col("support") * 2).alias("support"))
    return rows.withColumn("bucket", scalars.support_bucket(F.col("support")))


@query("""SELECT node_id, variant_id, (NOT joint_confirmed) OR (NOT reverse_polarity AND NOT monophyletic) AS low FROM fx_node_variant""")
def low_confidence_call(fx):
    return fx.node_variant.select("node_id", "variant_id", scalars.low_confidence_call(F.col("joint_confirmed"), F.col("monophyletic"), F.col("reverse_polarity")).alias("low"))


@query(f"""SELECT run_id, depth, c.test_type, CASE WHEN depth < p50 * 0.95 THEN 'BELOW' WHEN depth > p50 * 1.05 THEN 'ABOVE' ELSE 'AT' END AS conformance, count(*) AS n FROM fx_coverage c JOIN ({NORMS}) x ON c.test_type = x.test_type GROUP BY 1, 2, 3, 4""")
def conformance(fx):
    norms = reports.coverage_norms(fx.coverage).select("test_type", "p50")
    rows = fx.coverage.join(F.broadcast(norms), "test_type")  # a row per test type
    return rows.groupBy("run_id", "depth", "test_type", scalars.conformance(F.col("depth"), F.col("p50"), F.lit(30.0)).alias("conformance")).agg(F.count("*").alias("n"))


@query("""SELECT a, b, cm, segments * 20.0 AS other, abs(cm - segments * 20.0) <= greatest(10.0, 0.2 * greatest(cm, segments * 20.0)) AS agree FROM fx_pair""")
def cm_agree(fx):
    rows = fx.pair.select("a", "b", "cm", (F.col("segments") * 20.0).alias("other"))
    return rows.withColumn("agree", scalars.cm_agree(F.col("cm"), F.col("other")))


@query("""SELECT node_id, ybp_raw AS ybp, round(coalesce(sigma, greatest(abs(ybp_raw) * 0.1, 25.0)), 6) AS sigma, count(*) AS n FROM fx_anchor GROUP BY 1, 2, 3""")
def anchor_ybp(fx):
    rows = fx.anchor.select("node_id", F.col("ybp_raw").alias("ybp"), F.round(scalars.anchor_sigma(F.col("ybp_raw"), F.col("sigma")), 6).alias("sigma"))
    return rows.groupBy("node_id", "ybp", "sigma").agg(F.count("*").alias("n"))


@query("""SELECT node_id, round(sum(ybp / (s * s)) / sum(1 / (s * s)), 6) AS ybp, round(1 / sqrt(sum(1 / (s * s))), 6) AS sigma, count(*) AS n
    FROM (SELECT node_id, ybp_raw AS ybp, CASE WHEN sigma > 0 THEN sigma ELSE greatest(abs(ybp_raw) * 0.25, 1.0) END AS s FROM fx_anchor) GROUP BY node_id""")
def combine_inverse_variance(fx):
    return rounded(similarity.combine_inverse_variance(fx.anchor.withColumnRenamed("ybp_raw", "ybp")), "ybp", "sigma")


@query("""SELECT node_id, round(mean, 4) AS mean, round(sigma, 4) AS sigma, round(greatest(mean - 1.96 * sigma, 0.0), 4) AS lo, round(mean + 1.96 * sigma, 4) AS hi, anchors FROM (
    SELECT node_id, sum(y / (s * s)) / sum(1 / (s * s)) AS mean, sqrt(1 / sum(1 / (s * s))) AS sigma, count(*) AS anchors FROM (
    SELECT node_id, y, CASE WHEN sigma > 0 THEN sigma ELSE greatest(y / 10, 25.0) END AS s FROM (SELECT node_id, sigma, CASE WHEN CAST(ybp_raw AS BIGINT) % 3 = 0 THEN ybp_raw ELSE 1950 - ybp_raw END AS y FROM fx_anchor) WHERE y >= 0) GROUP BY node_id)""")
def anchor_term(fx):
    """Carbon dates and calendar years of each node as one Gaussian."""
    carbon = F.col("ybp_raw").cast("long") % 3 == 0
    anchors = fx.anchor.select("node_id", F.when(carbon, F.col("ybp_raw")).alias("carbon_bp"), F.when(~carbon, F.col("ybp_raw")).alias("date_ce"), F.col("sigma").alias("uncertainty"))
    return ages.anchor_term(anchors).select("node_id", *[F.round(c, 4).alias(c) for c in ("mean", "sigma", "lo", "hi")], "anchors")


@query("""SELECT id, coalesce(body LIKE '%@%' OR length(body) > 200, false) AS pii FROM fx_text""")
def pii_scan(fx):
    return fx.text.select("id", scalars.has_pii(F.col("body")).alias("pii"))


@query("""SELECT id, array_to_string(regexp_split_to_array(body, '\\s+'), ' ') AS abstract FROM fx_text""")
def rebuild_abstract(fx):
    """An abstract from its inverted index: word and positions back to text."""
    # texts are dealt out by id once, before they become words; the groups below then stay where they are
    texts = fx.text.select("id", "body")
    words = similarity.in_parts(texts, "id").select("id", F.posexplode(F.split("body", r"\s+")).alias("at", "word"))
    index = words.groupBy("id", "word").agg(F.collect_list("at").alias("places"))
    back = index.select("id", "word", F.explode("places").alias("at")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("x"))
    return back.select("id", F.array_join(F.transform("x", lambda r: r["word"]), " ").alias("abstract"))


@query("""SELECT user_id, try_cast(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS x, event_id FROM events""")
def wire_float(fx):
    raw = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("event_id").cast("string"))
    return fx.table("events").select("user_id", scalars.wire_float(raw).alias("x"), "event_id")


@query("""SELECT a.run_id, a.contig, coalesce(a.lab, a.facility) AS vendor, a.test_type, n.n_name AS site FROM fx_coverage a LEFT JOIN nation n ON a.run_id % 30 = n.n_nationkey""")
def coverage_run_lab_join(fx):
    """Coverage rows with their vendor and the site of the run."""
    sites = fx.table("nation").select(F.col("n_nationkey").cast("long").alias("site_id"), F.col("n_name").alias("site"))
    rows = fx.coverage.withColumn("site_id", (F.col("run_id") % 30).cast("long")).join(sites, "site_id", "left")
    return rows.select("run_id", "contig", F.coalesce("lab", "facility").alias("vendor"), "test_type", "site")


@query("""SELECT sample_id, population, pct FROM (SELECT sample_id, population, round(100 * quantity / sum(quantity) OVER (PARTITION BY sample_id), 6) AS pct, row_number() OVER (PARTITION BY sample_id ORDER BY quantity DESC, population) AS rn FROM fx_share) WHERE rn = 1""")
def latest_per_key(fx):
    """The dominant population of each sample."""
    top = reports.latest_per_key(reports.shares(fx.share), ["sample_id"], [F.desc("pct"), F.asc("population")])
    return rounded(top, "pct")


@query("""SELECT * FROM (SELECT sample_id, marker, repeats, 'fed' AS source FROM fx_str WHERE sample_id % 2 = 0 UNION ALL SELECT sample_id, marker, repeats, 'import' FROM fx_str WHERE sample_id % 2 <> 0 OR sample_id % 3 = 0)""")
def union_profiles(fx):
    s = fx.str.select("sample_id", "marker", "repeats")
    return s.where("sample_id % 2 = 0").withColumn("source", F.lit("fed")).unionByName(s.where("sample_id % 2 <> 0 or sample_id % 3 = 0").withColumn("source", F.lit("import")))


@query("""SELECT coalesce(max(CAST(o_orderdate AS DATE)) - 30, DATE '2024-01-31' - 365) AS from_date, greatest(DATE '1995-01-01', max(CAST(o_orderdate AS DATE))) AS watermark FROM orders""")
def incremental_watermark(fx):
    seen = F.max(F.col("o_orderdate").cast("date"))
    return fx.table("orders").agg(F.coalesce(F.date_sub(seen, 30), F.date_sub(F.lit("2024-01-31").cast("date"), 365)).alias("from_date"), F.greatest(F.lit("1995-01-01").cast("date"), seen).alias("watermark"))
