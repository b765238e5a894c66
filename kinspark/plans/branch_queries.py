"""Queries of branches, merges, JSON sources and repeat ages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna, scalars
from ..operators import ages, branches, curation, strages
from ..sources import formats
from .catalog_queries import EXP, PLACE, RANK, SITE
from .curation_queries import CLAIM
from .report_queries import rounded
from .source_queries import BINS, POISSON, RES, WALK, poisson
from .tree_queries import CLOSURE, closure

REGISTERED: dict = {}


def query(sql: str | None = None):
    def add(build):
        REGISTERED[build.__name__] = (build, sql)
        return build

    return add


@query("SELECT id, reverse(translate(upper(anc), 'ACGT', 'TGCA')) AS anc, reverse(translate(upper(der), 'ACGT', 'TGCA')) AS der FROM fx_variant")
def revcomp(fx):
    return fx.variant.select("id", dna.revcomp(F.col("anc")).alias("anc"), dna.revcomp(F.col("der")).alias("der"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'chrY:' || position::VARCHAR || 'A>G' ELSE name END AS name FROM fx_variant")
def normalize_placeholder_contig(fx):
    old = F.when(F.col("id") % 3 == 0, F.concat(F.lit("NC_24.10:"), F.col("position"), F.lit("A>G"))).otherwise(F.col("name"))
    return fx.variant.select("id", scalars.normalize_placeholder_contig(old, dna.canonical_contig(F.col("contig"))).alias("name"))


@query("SELECT sample_id, CASE sample_id % 3 WHEN 0 THEN call_text WHEN 1 THEN 'F' || sample_id::VARCHAR END AS call FROM fx_sample")
def pick_original_call(fx):
    k, none = F.col("sample_id") % 3, F.lit(None).cast("string")
    entry = F.create_map(F.lit("y"), F.when(k == 0, F.concat(F.lit(" "), "call_text")).otherwise("  "), F.lit("y_result"), F.when(k == 1, F.concat(F.lit("F"), "sample_id")).otherwise(none))
    return fx.sample.select("sample_id", scalars.pick_original_call(F.array(F.create_map(F.lit("mt"), F.lit("H")), entry), "y", "y_result").alias("call"))


@query("SELECT sample_id, marker, CASE WHEN marker % 3 = 0 THEN 'simple' WHEN marker % 3 = 1 THEN 'multiCopy' ELSE 'complex' END AS kind, CASE WHEN marker % 3 = 0 THEN repeats END AS repeats, CASE WHEN marker % 3 = 1 THEN 2 END AS copies FROM fx_str WHERE marker <> 7")
def parse_markers(fx):
    m, r = F.col("marker") % 3, F.col("repeats").cast("string")
    text = F.when(F.col("marker") == 7, "-").when(m == 0, r).when(m == 1, F.concat_ws("-", r, r)).otherwise(F.concat(r, F.lit(".2")))
    rows = fx.str.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("marker", text.alias("t")))).alias("values"))
    parsed = rows.select("sample_id", F.explode(scalars.parse_markers(F.col("values"))).alias("marker", "x"))
    return parsed.select("sample_id", "marker", "x.kind", "x.repeats", F.when(F.col("x.copies").isNotNull(), F.size("x.copies")).alias("copies"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'WGS150' ELSE 'HiFi' END || CASE o_orderkey % 3 WHEN 0 THEN ' 45Gbases' WHEN 1 THEN ' 90Gbases' ELSE ' 30Gbases' END AS label FROM orders")
def test_profile_label(fx):
    k = F.col("o_orderkey")
    bases = F.when(k % 5 != 0, F.when(k % 3 == 0, F.lit(43_600_000_000)).when(k % 3 == 1, F.lit(90_000_000_000)).otherwise(F.lit(31_000_000_000)))
    return fx.table("orders").select("o_orderkey", scalars.test_profile_label(F.when(k % 2 == 0, "SHORT").otherwise("HIFI"), F.when(k % 2 == 0, 150), bases).alias("label"))


@query("SELECT p_partkey AS id, round(pow(1.02, p_size * 100.0 / 33.0), 6) AS weight FROM part")
def nrr_prior(fx):
    return rounded(fx.table("part").select(F.col("p_partkey").alias("id"), strages.nrr_prior(F.col("p_size") * 100.0, 1.02).alias("weight")), "weight")


@query("SELECT nation AS campaign, count(DISTINCT donor_id) AS cohort, count(DISTINCT CASE WHEN balance > 5000 THEN donor_id END) AS accepted FROM fx_sample GROUP BY 1")
def campaign_stats(fx):
    return branches.campaign_stats(fx.sample.select(F.col("nation").alias("campaign"), "donor_id", (F.col("balance") > 5000).alias("accepted")))


@query(CLOSURE + """, k AS (SELECT node_id FROM fx_node WHERE node_id % 4 <> 1), up AS (SELECT descendant_id, arg_min(ancestor_id, distance) AS parent_id FROM c JOIN k ON ancestor_id = k.node_id WHERE distance > 0 GROUP BY 1),
    home AS (SELECT descendant_id, arg_min(ancestor_id, distance) AS home FROM c JOIN k ON ancestor_id = k.node_id GROUP BY 1), held AS (SELECT home, count(*) AS n FROM fx_sample JOIN home ON terminal = descendant_id GROUP BY 1)
    SELECT k.node_id, parent_id, coalesce(n, 0) AS samples FROM k LEFT JOIN up ON k.node_id = up.descendant_id LEFT JOIN held ON k.node_id = held.home""")
def private_placeholder_filter(fx):
    nodes = fx.node.withColumn("name", F.when(F.col("node_id") % 4 == 1, F.concat("name", F.lit(":n7"))).otherwise(F.col("name")))
    return branches.private_placeholder_filter(nodes, closure(fx), fx.sample)


@query(f"""WITH v AS (SELECT id, name, position, {PLACE} AS ph, least(array_to_string(list_sort([a, d]), '/'), array_to_string(list_sort([reverse(translate(a, 'ACGT', 'TGCA')), reverse(translate(d, 'ACGT', 'TGCA'))]), '/')) AS k FROM (SELECT *, {EXP.format('anc')} AS a, {EXP.format('der')} AS d FROM fx_variant)),
    best AS (SELECT position, k, substr(min(lpad(({RANK.format('name')})::VARCHAR, 2, '0') || name), 3) AS twin FROM v WHERE NOT ph GROUP BY 1, 2)
    SELECT n.node_id, n.variant_id, CASE WHEN v.ph THEN twin ELSE v.name END AS name, count(*) OVER (PARTITION BY n.variant_id) > 1 AS recurrent FROM (SELECT DISTINCT node_id, variant_id FROM fx_node_variant) n JOIN v ON v.id = n.variant_id LEFT JOIN best b ON b.position = v.position AND b.k = v.k""")
def node_display_snps(fx):
    return branches.node_display_snps(fx.node_variant, fx.variant)


@query("""SELECT node_id, source, ybp, round(sigma, 6) AS sigma FROM (SELECT node_id, 'LIST' AS source, ybp_raw AS ybp, sigma FROM fx_anchor WHERE node_id % 3 <> 0
    UNION ALL SELECT p_partkey, 'PAPER', (p_size * 10.0 + p_size * 10.0 + p_partkey % 100) / 2, (p_partkey % 100) / (2 * 1.96) FROM part WHERE p_partkey % 97 <> 0)""")
def seed_anchors(fx):
    old = fx.anchor.select("node_id", F.when(F.col("node_id") % 3 == 0, "PAPER").otherwise("LIST").alias("source"), F.col("ybp_raw").alias("ybp"), "sigma")
    p = fx.table("part")
    seeds = p.select(F.concat(F.lit("N"), "p_partkey").alias("name"), (F.col("p_size") * 10.0).alias("lo"), (F.col("p_size") * 10.0 + F.col("p_partkey") % 100).alias("hi"))
    return rounded(branches.seed_anchors(old, seeds, fx.node, "PAPER"), "sigma")


SITE_MERGE = f"(SELECT id, name, min(id) OVER (PARTITION BY position, canon) AS new FROM ({SITE}))"


@query(f"""SELECT k.id, array_to_string(k.aliases, ',') AS aliases, coalesce(l.links, 0) AS links FROM (SELECT new AS id, list_sort(list(DISTINCT name) FILTER (name IS NOT NULL)) AS aliases FROM {SITE_MERGE} GROUP BY 1) k
    LEFT JOIN (SELECT coalesce(m.new, n.variant_id) AS id, count(DISTINCT n.node_id) AS links FROM fx_node_variant n LEFT JOIN {SITE_MERGE} m ON n.variant_id = m.id GROUP BY 1) l ON k.id = l.id""")
def merge_variants(fx):
    from pyspark.sql import Window

    v = fx.variant.withColumns({"canon": dna.allele_canon(F.col("anc"), F.col("der")), "c": dna.canonical_contig(F.col("contig"))})
    mapping = v.select(F.col("id").alias("old"), F.min("id").over(Window.partitionBy("c", "position", "canon")).alias("new")).where("old <> new")
    out = branches.merge_variants(fx.variant, fx.node_variant.select("node_id", "variant_id"), mapping)
    return out.withColumn("aliases", F.when(F.size("aliases") > 0, F.array_join("aliases", ",")))


DONOR = "(SELECT sample_id, min(sample_id) OVER (PARTITION BY donor_id) AS new FROM fx_sample)"


@query(f"""SELECT s.sample_id, CASE WHEN s.new = s.sample_id THEN 'ACTIVE' ELSE 'MERGED' END AS status, CASE WHEN s.new <> s.sample_id THEN s.new END AS merged_into, coalesce(m.n, 0) AS memberships FROM {DONOR} s
    LEFT JOIN (SELECT d.new, count(DISTINCT variant_id) AS n FROM fx_sample_variant v JOIN {DONOR} d ON v.sample_id = d.sample_id GROUP BY 1) m ON m.new = s.sample_id""")
def merge_subjects(fx):
    from pyspark.sql import Window

    mapping = fx.sample.select(F.col("sample_id").alias("old"), F.min("sample_id").over(Window.partitionBy("donor_id")).alias("new")).where("old <> new")
    return branches.merge_subjects(fx.sample, fx.sample_variant.select("sample_id", "variant_id"), mapping)


@query("""WITH s AS (SELECT DISTINCT did, did * 7 + rkey AS identifier FROM fx_commit WHERE did % 3 <> 0), d AS (SELECT did, 'S' || lpad((row_number() OVER (ORDER BY did))::VARCHAR, 5, '0') AS donor FROM (SELECT DISTINCT did FROM s))
    SELECT s.did, s.identifier, donor, CASE WHEN o.owner IS NULL THEN 'REGISTERED' ELSE 'DUPLICATE' END AS how, owner FROM s JOIN d ON s.did = d.did LEFT JOIN (SELECT sample_id AS identifier, min(donor_id) AS owner FROM fx_sample GROUP BY 1) o ON o.identifier = s.identifier""")
def anchor_subjects(fx):
    subjects = fx.commit.select("did", (F.col("did") * 7 + F.col("rkey")).alias("identifier"))
    owners = fx.sample.select(F.col("sample_id").alias("identifier"), F.col("donor_id").alias("owner"))
    return branches.anchor_subjects(subjects, subjects.where("did % 3 = 0").select("did"), owners)


@query(f"""WITH v AS ({SITE}), n AS (SELECT name, min(id) AS id FROM v WHERE name IS NOT NULL GROUP BY 1), g AS (SELECT position, canon, min(id) AS id FROM v GROUP BY 1, 2),
    p AS (SELECT sample_id, 'N' || terminal::VARCHAR AS terminal, name, v.position + CASE WHEN variant_id = 7 THEN 1000000 ELSE 0 END AS position, canon, variant_id FROM fx_sample_variant s JOIN v ON v.id = s.variant_id + 10),
    w AS (SELECT sample_id, coalesce(n.id::VARCHAR, g.id::VARCHAR, 'chrY:' || p.position::VARCHAR || ':' || p.canon) AS variant, min(node_id) AS node_id FROM p LEFT JOIN n ON n.name = p.name AND p.variant_id % 3 <> 1 LEFT JOIN g ON g.position = p.position AND g.canon = p.canon LEFT JOIN fx_node f ON f.name = p.terminal GROUP BY 1, 2),
    e AS (SELECT sample_id, '11' AS variant, terminal AS node_id, CASE sample_id % 4 WHEN 0 THEN 'INVALIDATED' ELSE 'ACTIVE' END AS status, CASE sample_id % 3 WHEN 0 THEN 'mirror' ELSE 'curator' END AS origin FROM fx_sample)
    SELECT coalesce(w.sample_id, e.sample_id) AS sample_id, coalesce(w.variant, e.variant) AS variant, coalesce(w.node_id, e.node_id) AS node_id, CASE WHEN e.status = 'INVALIDATED' THEN e.status ELSE 'ACTIVE' END AS status
    FROM w FULL JOIN e ON w.sample_id = e.sample_id AND w.variant = e.variant WHERE w.sample_id IS NOT NULL OR e.status = 'INVALIDATED' OR e.origin <> 'mirror'""")
def materialize_private(fx):
    k = F.col("variant_id")
    rows = fx.sample_variant.select("sample_id", F.concat(F.lit("N"), "terminal").alias("terminal"), k, (k + 10).alias("id")).join(fx.variant, "id")
    published = rows.select("sample_id", "terminal", F.when(k % 3 != 1, F.col("name")).alias("name"), "contig", (F.col("position") + F.when(k == 7, 1000000).otherwise(0)).alias("position"), "anc", "der")
    existing = fx.sample.select("sample_id", F.lit("11").alias("variant"), F.col("terminal").alias("node_id"), F.when(F.col("sample_id") % 4 == 0, "INVALIDATED").otherwise("ACTIVE").alias("status"), F.when(F.col("sample_id") % 3 == 0, "mirror").otherwise("curator").alias("origin"))
    return branches.materialize_private(published, fx.variant, fx.node, existing)


RELIABLE = "(SELECT v.* FROM fx_sample_variant v WHERE NOT EXISTS (SELECT 1 FROM fx_sample s WHERE s.sample_id = v.sample_id AND (s.sample_id % 13 = 0 OR s.sample_id % 10 / 10.0::DOUBLE + 0.1::DOUBLE < 0.5)))"


@query(WALK.format(sets=RELIABLE) + """, r AS (SELECT m.terminal, m.ks, avg(coalesce(s.sample_id % 10 / 10.0::DOUBLE + 0.1::DOUBLE, 1)) AS reliable, count(DISTINCT s.donor_id) AS dids FROM m JOIN o ON o.terminal = m.terminal AND o.k = m.k LEFT JOIN fx_sample s ON s.sample_id = o.sample_id GROUP BY 1, 2),
    f AS (SELECT c.terminal, md5(array_to_string(c.v, ',')) AS cluster_key, members AS evidence, greatest(dids, members) AS submitters, consistency, reliable, split FROM c JOIN r ON r.terminal = c.terminal AND r.ks = c.ks WHERE members >= 3),
    g AS (SELECT *, least(0.35::DOUBLE * least(evidence / 3, 1) + 0.2::DOUBLE * least(submitters / 3, 1) + 0.25::DOUBLE * consistency + 0.2::DOUBLE * reliable, 1) AS confidence FROM f)
    SELECT terminal, cluster_key, evidence, submitters, round(confidence, 6) AS confidence, CASE WHEN split THEN 'SPLIT_CANDIDATE' WHEN confidence >= 0.949999999 THEN 'READY_FOR_REVIEW' ELSE 'PROPOSED' END AS status FROM g""")
def branch_consensus(fx):
    reliability = fx.sample.select("sample_id", (F.col("sample_id") % 10 / 10 + 0.1).alias("confidence"), F.when(F.col("sample_id") % 13 == 0, "INCOMPATIBLE").otherwise("COMPATIBLE").alias("compatibility"))
    return rounded(branches.branch_consensus(fx.sample_variant, reliability, fx.sample.select("sample_id", F.col("donor_id").alias("did"))), "confidence")


@query("""WITH s AS (SELECT a, b, cm AS score, CASE segments % 3 WHEN 0 THEN 'HAPLOGROUP' WHEN 1 THEN 'SHARED_MATCH' ELSE 'POPULATION_OVERLAP' END AS signal FROM fx_pair WHERE (a + b) % 5 <> 0), m AS (SELECT a AS sample_id, b AS other_id, score, signal FROM s UNION ALL SELECT b, a, score, signal FROM s)
    SELECT donor_id AS owner, m.sample_id, other_id, score, CASE signal WHEN 'HAPLOGROUP' THEN 'LINEAGE' WHEN 'SHARED_MATCH' THEN 'TRIANGULATION' ELSE 'ANCESTRY' END AS purpose, row_number() OVER (PARTITION BY donor_id ORDER BY score DESC, m.sample_id, other_id) AS rank FROM m JOIN fx_sample f ON f.sample_id = m.sample_id""")
def suggestions_for_owner(fx):
    k = F.col("segments") % 3
    found = fx.pair.select("a", "b", F.col("cm").alias("score"), F.when(k == 0, "HAPLOGROUP").when(k == 1, "SHARED_MATCH").otherwise("POPULATION_OVERLAP").alias("signal"))
    return branches.suggestions_for_owner(found, fx.sample.select("sample_id", F.col("donor_id").alias("owner")), fx.pair.where("(a + b) % 5 = 0"))


@query("""SELECT 'W' || p_partkey::VARCHAR AS work_id, p_name AS title, CASE WHEN p_partkey % 3 > 0 THEN DATE '2020-01-05' END AS published, p_size::BIGINT AS cited_by_count, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS journal, 'z' || p_partkey::VARCHAR || ' of a z' || p_partkey::VARCHAR AS abstract FROM part""")
def scan_works(fx):
    k = F.col("p_partkey").cast("string")
    index = F.create_map(F.lit("of"), F.array(F.lit(1)), F.concat(F.lit("z"), k), F.array(F.lit(3), F.lit(0)), F.lit("a"), F.array(F.lit(2)))
    place = F.struct(F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("display_name")).alias("source"))
    date = F.when(F.col("p_partkey") % 3 == 0, "not known").otherwise("2020-01-05")
    work = F.struct(F.concat(F.lit("https://works.example/W"), k).alias("id"), F.col("p_name").alias("title"), date.alias("publication_date"), F.col("p_size").alias("cited_by_count"), index.alias("abstract_inverted_index"), place.alias("primary_location"))
    lines = fx.table("part").select(F.to_json(work).alias("value")).union(fx.spark.sql("SELECT '{\"title\": \"no id\"}'"))
    return formats.scan_works(lines).select("work_id", "title", "published", "cited_by_count", "journal", "abstract")


def commit_lines(fx):
    c = F.struct("operation", "collection", F.col("rkey").cast("string").alias("rkey"), F.create_map(F.lit("value"), F.col("value").cast("string")).alias("record"))
    kind = F.when(F.col("arrival") % 10 == 0, "identity").otherwise("commit")
    return fx.commit.select(F.when(F.col("arrival") % 17 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("did").cast("string").alias("did"), "time_us", kind.alias("kind"), c.alias("commit")))).alias("value"))


@query("SELECT did::VARCHAR AS did, collection, rkey::VARCHAR AS rkey, operation, time_us, value FROM fx_commit WHERE arrival % 10 <> 0 AND arrival % 17 <> 0")
def scan_commit_stream(fx):
    return formats.scan_commit_stream(commit_lines(fx)).select("did", "collection", "rkey", "operation", "time_us", F.try_element_at("record", F.lit("value")).cast("double").alias("value"))


@query("""SELECT kind, count(*) AS n FROM (SELECT unnest(['node'] || CASE WHEN p_partkey >= 3 THEN ['edge'] ELSE [] END || CASE WHEN p_partkey % 2 = 0 THEN ['link', 'link'] ELSE ['link'] END || CASE WHEN p_partkey % 3 = 0 THEN ['tip'] ELSE [] END || CASE WHEN p_partkey % 7 = 0 THEN ['conflict'] ELSE [] END) AS kind FROM part) GROUP BY 1""")
def scan_tree_document(fx):
    k = F.col("p_partkey")
    v = F.struct(F.concat(F.lit("M"), k).alias("name"), k.alias("position"), F.lit("A").alias("ancestral"), F.lit("G").alias("derived"))
    none = F.array().cast("array<string>")
    node = F.struct(k.cast("string").alias("id"), F.when(k >= 3, F.floor(k / 3).cast("string")).alias("parent"), F.col("p_name").alias("label"), F.when(k % 2 == 0, F.array(v, v)).otherwise(F.array(v)).alias("definingVariants"),
                    F.when(k % 3 == 0, F.array(F.lit("S"))).otherwise(none).alias("tips"), F.when(k % 7 == 0, F.array(F.lit("C"))).otherwise(none).alias("conflicts"))
    documents = fx.table("part").groupBy((k % 50).alias("tree")).agg(F.to_json(F.struct(F.collect_list(node).alias("nodes"))).alias("value"))
    found = formats.scan_tree_document(documents)
    out = None
    for kind, df in found.items():
        one = df.select(F.lit(kind).alias("kind"))
        out = one if out is None else out.union(one)
    return out.groupBy("kind").agg(F.count("*").alias("n"))


@query(POISSON + ", s AS (SELECT a.id, a.bin - b.bin AS bin, sum(a.mass * b.mass) AS w FROM p a JOIN p b ON a.id = b.id AND a.bin >= b.bin GROUP BY 1, 2), z AS (SELECT id, bin, w / sum(w) OVER (PARTITION BY id) AS mass FROM s) SELECT id, bin, round(mass, 6) AS mass FROM z WHERE mass > 1e-9")
def pdf_convolve_sub(fx):
    out = ages.pdf_convolve(poisson(fx), poisson(fx), "id", BINS, subtract=True)
    return rounded(out.where("mass > 1e-9"), "mass")


MODAL_SET = "node_id", "marker"


def star_inputs(fx):
    testers = fx.str.select("node_id", "sample_id", "marker", "repeats")
    n = testers.groupBy("node_id", "marker", "repeats").agg(F.count("*").alias("n"))
    modal = n.groupBy(*MODAL_SET).agg(F.min_by("repeats", F.struct(-F.col("n"), "repeats")).alias("modal"))
    g = testers.join(modal, [*MODAL_SET]).select("marker", F.abs(F.col("repeats") - F.col("modal")).cast("int").alias("g"), (0.002 + F.col("marker") * 0.0005).alias("rate")).distinct()
    return testers, modal, strages.str_marker_age(g, strages.str_step_table(fx.spark), ["marker"], RES, BINS)


@query()
def str_step_table(fx):
    """Distances of the table that the testers' markers reach, with how often they do."""
    testers, modal, _ = star_inputs(fx)
    g = testers.join(modal, [*MODAL_SET]).groupBy(F.abs(F.col("repeats") - F.col("modal")).cast("int").alias("g")).agg(F.count("*").alias("n"))
    return rounded(strages.str_step_table(fx.spark).join(g, "g").select("m", "g", "p", "n"), "p")


@query()
def str_marker_age(fx):
    return rounded(star_inputs(fx)[2], "mass")


@query()
def str_star_age(fx):
    return strages.str_star_age(*star_inputs(fx), RES)


@query()
def combined_age(fx):
    n = fx.node.select("node_id", "support", "curated")
    terms = n.select("node_id", F.lit("snp").alias("term"), (F.col("support") * 100.0).alias("mean"), F.lit(250.0).alias("sigma"))
    terms = terms.union(n.where("node_id % 3 = 0").select("node_id", F.lit("anchor"), F.col("node_id") % 9000 + 0.0, F.lit(80.0)))
    masses = ages.gaussian_arrays(terms, RES, BINS)
    years = n.select("node_id", (F.col("support") * 10.0).alias("years"))
    fixed = n.where("curated").select("node_id", F.lit(4000.0).alias("tmrca"), F.lit(4500.0).alias("formed"))
    return strages.combined_age(masses.select("node_id", "term", "mass"), fx.edge, years, fixed, RES, BINS)
