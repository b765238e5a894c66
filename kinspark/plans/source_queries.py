"""Queries of sources, sinks, ages and clusters; text inputs are written by Spark from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import ages, clusters
from ..sources import formats
from .report_queries import rounded

REGISTERED: dict = {}


def query(sql: str | None = None):
    def add(build):
        REGISTERED[build.__name__] = (build, sql)
        return build

    return add


@query("""SELECT 'M' || id::VARCHAR AS name, 'chrY' AS contig, position + 1 AS position, anc, CASE WHEN id % 5 = 0 THEN NULL ELSE der END AS der, CASE WHEN id % 2 = 0 THEN 'R' || (id % 7)::VARCHAR END AS isogg FROM fx_variant WHERE id % 10 <> 3""")
def scan_gff_snps(fx):
    text = F.concat_ws("\t", F.lit("chrY"), F.lit("src"), F.lit("snp"), (F.col("position") + 1).cast("string"), F.lit("1"), F.lit("."), F.lit("+"), F.lit("."),
                       F.concat(F.when(F.col("id") % 10 == 3, "x=1").otherwise(F.concat(F.lit("ID=M"), F.col("id"))), F.lit(";allele_anc="), F.col("anc"), F.lit(";allele_der="), F.when(F.col("id") % 5 == 0, ".").otherwise(F.col("der")),
                                F.lit(";isogg_haplogroup="), F.when(F.col("id") % 2 == 0, F.concat(F.lit("R"), F.col("id") % 7)).otherwise("not listed")))
    lines = fx.variant.select(text.alias("value")).union(fx.spark.sql("SELECT '# comment'"))
    return formats.scan_gff_snps(lines).select("name", "contig", "position", "anc", "der", F.try_element_at("evidence", F.lit("isogg_haplogroup")).alias("isogg"))


@query("""SELECT CASE WHEN region_type = 'azf' THEN 'heterochromatin' ELSE 'sequence_class' END AS region_type, start_pos + 1 AS start_pos, end_pos, CASE WHEN region_type <> 'azf' THEN 'xdegen' END AS class FROM fx_region WHERE region_type <> 'palindromic'""")
def scan_bed_regions(fx):
    kind = F.col("region_type")
    text = F.concat_ws("\t", F.when(kind == "palindromic", "chrX").otherwise("chrY"), F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), F.when(kind == "azf", "DYZ1").otherwise("X-DEG"))
    lines = fx.region.select(text.alias("value"), F.when(kind == "azf", "azf_dyz").otherwise("classes").alias("layer"))
    return formats.scan_bed_regions(lines).select("region_type", "start_pos", "end_pos", "class")


@query("""SELECT k, s, e FROM fx_interval WHERE s % 4 <> 1 AND e > s""")
def scan_callable_bed(fx):
    text = F.concat_ws("\t", F.lit("chrY"), F.col("s").cast("string"), F.col("e").cast("string"), F.when(F.col("s") % 4 == 1, "NO_COVERAGE").when(F.col("s") % 4 == 2, "CALLABLE"))
    return formats.scan_callable_bed(fx.interval.select(F.col("k").alias("sample_id"), text.alias("value")))


@query("""SELECT o_custkey AS kit, 'M' || m::VARCHAR AS marker, CASE WHEN m = 1 THEN 'simple' WHEN m = 2 THEN 'multiCopy' ELSE 'complex' END AS kind, CASE WHEN m = 1 THEN (o_custkey % 40)::INT END AS repeats FROM (SELECT DISTINCT o_custkey FROM orders), (SELECT unnest([1, 2, 4]) AS m) WHERE o_custkey % 9 <> 0
    UNION ALL SELECT DISTINCT o_custkey, NULL, NULL, NULL FROM orders WHERE o_custkey % 9 = 0""")
def scan_wide_str(fx):
    n = (F.col("o_custkey") % 40).cast("string")
    text = F.when(F.col("o_custkey") % 9 == 0, "<html>").otherwise(F.concat(F.lit('M1, "M2",M3,M4\n"'), n, F.lit('", 11-'), n, F.lit(",-,"), n, F.lit(".2t\n")))
    return formats.scan_wide_str(fx.table("orders").select(F.col("o_custkey").alias("kit"), text.alias("content")).distinct()).select("kit", "marker", "kind", "repeats")


@query("""SELECT c_custkey AS subject, CASE WHEN c_custkey % 3 = 0 THEN 'PGP' WHEN kit LIKE 'B%' THEN 'FTDNA' ELSE 'VENDORKIT' END AS namespace, kit AS value, c_custkey % 3 = 0 AS is_public FROM (SELECT c_custkey, unnest(['B' || c_custkey::VARCHAR, c_custkey::VARCHAR]) AS kit FROM customer)""")
def scan_manifest_identifiers(fx):
    k = F.col("c_custkey").cast("string")
    rows = fx.table("customer").select(F.col("c_custkey").alias("subject"), F.when(F.col("c_custkey") % 3 == 0, "pgp").otherwise("ftdna, dante").alias("lab"), F.concat(F.lit("b"), k, F.lit(", "), k, F.lit(",")).alias("kit"))
    return formats.scan_manifest_identifiers(rows)


@query("""SELECT sample, run, file, CASE WHEN file LIKE '%.bam' THEN 'BAM' ELSE 'FASTQ' END AS format, md5, bytes FROM (SELECT o_custkey AS sample, o_orderkey AS run, o_orderkey::VARCHAR || CASE WHEN o_orderkey % 4 = 0 THEN '.bam' ELSE '_1.fastq.gz' END AS file, 'm' || o_orderkey::VARCHAR AS md5, o_orderkey AS bytes,
    max(o_orderkey % 4 = 0) OVER (PARTITION BY o_custkey) AS aligned FROM orders) WHERE aligned = (file LIKE '%.bam')""")
def scan_run_report(fx):
    k = F.col("o_orderkey").cast("string")
    rows = fx.table("orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("run"), F.concat(k, F.when(F.col("o_orderkey") % 4 == 0, ".bam;").otherwise("_1.fastq.gz;"), F.lit("x.txt")).alias("urls"), F.concat(F.lit("m"), k, F.lit(";n")).alias("md5s"), F.concat(k, F.lit(";1")).alias("sizes"))
    return formats.scan_run_report(rows)


@query("""SELECT name, 'GRCh38;hs1' AS builds, anc, der FROM fx_variant WHERE name IS NOT NULL""")
def export_variants_csv(fx):
    return formats.export_variants_csv(fx.variant.withColumn("builds", F.array(F.lit("hs1"), F.lit("GRCh38"))))


@query("""SELECT contig || chr(9) || 'kinspark' || chr(9) || 'snp' || chr(9) || position::VARCHAR || chr(9) || position::VARCHAR || chr(9) || '.' || chr(9) || '.' || chr(9) || '.' || chr(9) || 'Name=' || name || ';allele_anc=' || anc || ';allele_der=' || der AS value FROM fx_variant WHERE name IS NOT NULL""")
def export_variants_gff(fx):
    return formats.export_variants_gff(fx.variant)


@query("""SELECT c_custkey AS id, c_name AS alias, NULL::VARCHAR AS did, 'STANDARD' AS source FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, NULL, 'did:' || c_custkey::VARCHAR, 'CITIZEN' FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT c_custkey, c_name, NULL, 'EXTERNAL' FROM customer WHERE c_custkey % 3 = 2""")
def unify_samples(fx):
    c = fx.table("customer")
    named = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("alias"))
    citizen = c.where("c_custkey % 3 = 1").select(F.col("c_custkey").alias("id"), F.concat(F.lit("did:"), "c_custkey").alias("did"))
    return formats.unify_samples(named.where("id % 3 = 0"), citizen, named.where("id % 3 = 2")).select("id", "alias", "did", "source")


@query("""SELECT p_partkey AS id, topic, CASE WHEN topic IS NULL THEN 'NO_TOPIC' WHEN topic IN ('T1', 'T3') THEN 'ON_TOPIC' ELSE 'OFF_TOPIC' END AS status FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN 'T' || (p_partkey % 5)::VARCHAR END AS topic FROM part)""")
def topic_whitelist(fx):
    rows = fx.table("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("T"), F.col("p_partkey") % 5)).alias("topic"))
    filters = fx.table("part").where("p_partkey = 1").select(F.lit("type:article,primary_topic.id:T1|T3").alias("filter"))
    return formats.topic_whitelist(rows, filters).select("id", "topic", "status")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'CRAM' WHEN 1 THEN 'FASTQ' WHEN 2 THEN 'BAM' ELSE 'OTHER' END AS format FROM orders""")
def fmt_file(fx):
    k = F.col("o_orderkey") % 4
    return fx.table("orders").select("o_orderkey", scalars.fmt_file(F.concat(F.lit("a"), F.when(k == 0, ".CRAM").when(k == 1, ".fq.gz").when(k == 2, ".bam").otherwise(".bam.txt"))).alias("format"))


@query("""SELECT o_orderkey, '10.1/' || o_orderkey::VARCHAR AS doi FROM orders""")
def normalize_doi(fx):
    k = F.col("o_orderkey")
    lead = F.when(k % 3 == 0, "https://doi.org/").when(k % 3 == 1, "DOI: ").otherwise(" http://dx.doi.org/")
    return fx.table("orders").select("o_orderkey", scalars.normalize_doi(F.concat(lead, F.lit("10.1/"), k)).alias("doi"))


BINS, RES = 200, 50.0
POISSON = """WITH g AS (SELECT id, bin, CASE WHEN bin = 0 AND m > 0 THEN NULL WHEN bin = 0 THEN 0.0 ELSE m * ln(bin * 50.0 * rate) - bin * 50.0 * rate END AS lw FROM (SELECT p_partkey AS id, p_size % 20 AS m, 0.005 AS rate FROM part), (SELECT unnest(range(0, 200)) AS bin)),
    w AS (SELECT id, bin, coalesce(exp(lw - max(lw) OVER (PARTITION BY id)), 0.0) AS w FROM g), p AS (SELECT id, bin, w / sum(w) OVER (PARTITION BY id) AS mass FROM w) """


def mutations(fx):
    return fx.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 20).alias("m"), F.lit(0.005).alias("rate"))


def poisson(fx):
    """(id, mass): an array over the grid for each part."""
    return ages.poisson_arrays(mutations(fx), RES, BINS).select("id", "mass")


@query(POISSON + "SELECT id, bin, round(mass, 6) AS mass FROM p")
def pdf_poisson(fx):
    return rounded(ages.pdf_poisson(mutations(fx), "id", RES, BINS), "mass")


@query("""WITH g AS (SELECT id, bin, -0.5 * pow((bin * 50.0 - mean) / greatest(sigma, 25.0), 2) AS lw FROM (SELECT p_partkey AS id, p_size * 100.0 AS mean, p_partkey % 300 * 1.0 AS sigma FROM part), (SELECT unnest(range(0, 200)) AS bin)), w AS (SELECT id, bin, exp(lw - max(lw) OVER (PARTITION BY id)) AS w FROM g)
    SELECT id, bin, round(w / sum(w) OVER (PARTITION BY id), 6) AS mass FROM w""")
def pdf_gaussian(fx):
    rows = fx.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 100.0).alias("mean"), (F.col("p_partkey") % 300).cast("double").alias("sigma"))
    return rounded(ages.pdf_gaussian(rows, "id", RES, BINS), "mass")


@query(POISSON + """, c AS (SELECT id, bin, mass, sum(mass) OVER (PARTITION BY id ORDER BY bin) AS cum FROM p), q AS (SELECT id, bin, mass, cum, row_number() OVER (PARTITION BY id ORDER BY bin) AS rn FROM c WHERE cum >= 0.5)
    SELECT s.id, round(s.mean, 4) AS mean, s.mode, round(greatest(q.bin - 0.5 + (0.5 - (q.cum - q.mass)) / q.mass, 0.0) * 50.0, 4) AS median FROM (SELECT id, sum(bin * mass) * 50.0 AS mean, arg_max(bin, mass) * 50.0 AS mode FROM p GROUP BY id) s JOIN q ON s.id = q.id AND rn = 1""")
def pdf_stats(fx):
    return ages.pdf_stats(poisson(fx), "id", RES).select("id", F.round("mean", 4).alias("mean"), "mode", F.round("median", 4).alias("median"))


@query(POISSON + "SELECT id, bin, round(mass / sum(mass) OVER (PARTITION BY id), 6) AS mass FROM p WHERE bin >= 20")
def pdf_truncate(fx):
    return rounded(ages.pdf_truncate(poisson(fx), "id", 20), "mass")


@query(POISSON + ", s AS (SELECT id - id % 100 AS grp, bin, sum((id % 100 + 1) * mass) AS w FROM p GROUP BY 1, 2) SELECT grp, bin, round(w / sum(w) OVER (PARTITION BY grp), 6) AS mass FROM s")
def pdf_mixture(fx):
    rows = ages.pdf_poisson(mutations(fx), "id", RES, BINS).withColumns({"grp": F.col("id") - F.col("id") % 100, "wt": F.col("id") % 100 + 1})
    return rounded(ages.pdf_mixture(rows, "grp", "wt"), "mass")


@query(POISSON + ", s AS (SELECT id - id % 100 AS grp, bin, sum(ln(CASE WHEN mass > 0 THEN mass END)) AS lw FROM p GROUP BY 1, 2 HAVING min(mass) > 0), z AS (SELECT grp, bin, exp(lw - max(lw) OVER (PARTITION BY grp)) AS w FROM s) SELECT grp, bin, round(w / sum(w) OVER (PARTITION BY grp), 6) AS mass FROM z")
def pdf_multiply(fx):
    rows = poisson(fx).withColumn("grp", F.col("id") - F.col("id") % 100)
    return rounded(ages.pdf_multiply(rows, "grp", "id"), "mass")


@query(POISSON + ", s AS (SELECT a.id, least(a.bin + b.bin, 199) AS bin, sum(a.mass * b.mass) AS w FROM p a JOIN p b ON a.id = b.id GROUP BY 1, 2) SELECT id, bin, round(w / sum(w) OVER (PARTITION BY id), 6) AS mass FROM s WHERE w > 1e-9")
def pdf_convolve(fx):
    out = ages.pdf_convolve(poisson(fx), poisson(fx), "id", BINS)
    return rounded(out.where("mass > 1e-9"), "mass").where("bin >= 0")


#: The greedy order walked set by set, over sets (terminal, sample_id, variant_id) named {sets}: o(terminal, k, sample_id, v) in order, m(terminal, ks, k) members of the seed ks.
WALK = """WITH RECURSIVE h AS (SELECT terminal, sample_id, list_sort(list(variant_id)) AS v FROM {sets} GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY terminal ORDER BY len(v) DESC, v[1], sample_id) AS k FROM h),
    j AS (SELECT a.terminal, a.k AS ka, b.k AS kb FROM o a JOIN o b ON a.terminal = b.terminal AND a.k < b.k WHERE len(list_intersect(a.v, b.v)) / len(list_distinct(list_concat(a.v, b.v))) >= 0.8),
    n AS (SELECT o.terminal, o.k, list(j.ka) FILTER (j.ka IS NOT NULL) AS before FROM o LEFT JOIN j ON o.terminal = j.terminal AND o.k = j.kb GROUP BY 1, 2),
    w AS (SELECT DISTINCT terminal, 0::BIGINT AS k, []::BIGINT[] AS seeds FROM o
        UNION ALL SELECT w.terminal, n.k, CASE WHEN list_has_any(w.seeds, coalesce(n.before, [])) THEN w.seeds ELSE list_append(w.seeds, n.k) END FROM w JOIN n ON n.terminal = w.terminal AND n.k = w.k + 1),
    z AS (SELECT terminal, unnest(arg_max(seeds, k)) AS ks FROM w GROUP BY 1),
    m AS (SELECT o.terminal, coalesce(min(z.ks), o.k) AS ks, o.k FROM o LEFT JOIN j ON o.terminal = j.terminal AND o.k = j.kb LEFT JOIN z ON z.terminal = j.terminal AND z.ks = j.ka GROUP BY o.terminal, o.k),
    u AS (SELECT m.terminal, m.ks, list_sort(list_distinct(flatten(list(o.v)))) AS v, count(*) AS members, sum(len(o.v)) AS held FROM m JOIN o ON o.terminal = m.terminal AND o.k = m.k GROUP BY 1, 2),
    x AS (SELECT DISTINCT u.terminal, u.ks FROM u JOIN m ON m.terminal = u.terminal AND m.ks <> u.ks JOIN o ON o.terminal = m.terminal AND o.k = m.k
        WHERE len(list_intersect(u.v, o.v)) / len(list_distinct(list_concat(u.v, o.v))) BETWEEN 0.5 AND 0.7999999999),
    c AS (SELECT u.terminal, o.sample_id AS seed, u.ks, u.members, len(u.v) AS variants, held / len(u.v) / members AS consistency, x.ks IS NOT NULL AS split, u.v FROM u JOIN o ON o.terminal = u.terminal AND o.k = u.ks LEFT JOIN x ON x.terminal = u.terminal AND x.ks = u.ks)
"""


@query(WALK.format(sets="fx_sample_variant") + "SELECT terminal, seed, members, variants, round(consistency, 6) AS consistency, split, array_to_string(v, ',') AS variant_ids FROM c")
def cluster_variant_sets(fx):
    found = clusters.cluster_variant_sets(fx.sample_variant).summary
    return rounded(found.withColumn("variant_ids", F.array_join("variant_ids", ",")), "consistency")


@query(WALK.format(sets="fx_sample_variant") + "SELECT m.terminal, c.seed, o.sample_id FROM m JOIN c ON c.terminal = m.terminal AND c.ks = m.ks JOIN o ON o.terminal = m.terminal AND o.k = m.k")
def cluster_members(fx):
    return clusters.cluster_variant_sets(fx.sample_variant).members
