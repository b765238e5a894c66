"""Queries of the curation operators."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import catalog, curation, intervals, reports, similarity, tree
from ..sources import formats
from .catalog_queries import PAIRS, SITE
from .report_queries import MODAL, rounded
from .tree_queries import CALLS, CLOSURE, placed

REGISTERED: dict = {}


def query(sql: str | None = None):
    def add(build):
        REGISTERED[build.__name__] = (build, sql)
        return build

    return add


@query("SELECT sample_id, sample_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR sample_id % 10 = 0 AS is_public FROM fx_sample")
def publish_linked_samples(fx):
    links = fx.table("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("sample_id"))
    return curation.publish_linked_samples(fx.sample.select("sample_id", (F.col("sample_id") % 10 == 0).alias("is_public")), links)


@query("SELECT claim_id, predicate IN ('click', 'error') AND (predicate <> 'error' OR author % 2 = 0) AS storable FROM fx_claim")
def storable_predicate(fx):
    return fx.claim.select("claim_id", curation.storable_predicate(F.when(F.col("predicate") == "error", "NOTE").otherwise(F.col("predicate")), F.col("author") % 2 == 0, ["click", "NOTE"]).alias("storable"))


@query("SELECT c_custkey AS sample_id, p.publication FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS publication FROM orders GROUP BY 1) p ON c_custkey = o_custkey")
def latest_publication(fx):
    pubs = fx.table("orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("publication"), F.col("o_orderkey").alias("published"))
    return curation.latest_publication(fx.sample, pubs)


@query("SELECT v.terminal AS node_id, v.sample_id, count(DISTINCT v.variant_id) AS snps, b.bp FROM fx_sample_variant v JOIN (SELECT o_custkey AS sample_id, count(*) * 1000 AS bp FROM orders GROUP BY 1) b ON v.sample_id = b.sample_id WHERE b.bp >= 12000 GROUP BY 1, 2, 4")
def tester_private_counts(fx):
    bp = fx.table("orders").groupBy(F.col("o_custkey").alias("sample_id")).agg((F.count("*") * 1000).alias("bp"))
    return curation.tester_private_counts(fx.sample_variant.withColumnRenamed("terminal", "node_id"), bp, 12000)


@query("SELECT l_suppkey AS sample, l_orderkey AS run, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR, l_linenumber) AS files, arg_min(l_linenumber, l_partkey::VARCHAR || '/' || l_linenumber::VARCHAR) FILTER (WHERE l_returnflag = 'R')::VARCHAR AS md5 FROM lineitem GROUP BY 1, 2")
def sample_files(fx):
    rows = fx.table("lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("run"), F.col("l_partkey").cast("string").alias("file"), F.when(F.col("l_returnflag") == "R", "MD5").otherwise("SHA").alias("kind"), F.col("l_linenumber").cast("string").alias("checksum"))
    return curation.sample_files(rows)




@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'ENA' WHEN 1 THEN 'NCBI' WHEN 2 THEN 'DDBJ' WHEN 3 THEN 'EGA' ELSE 'OTHER' END AS source FROM orders")
def study_source(fx):
    k = F.col("o_orderkey") % 5
    return fx.table("orders").select("o_orderkey", curation.study_source(F.concat(F.when(k == 0, " prjeb").when(k == 1, "PRJNA").when(k == 2, "DRP").when(k == 3, "EGAS").otherwise("X"), "o_orderkey")).alias("source"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE upper(c_mktsegment) || ':' || c_custkey::VARCHAR END AS ids FROM customer")
def normalize_external_ids(fx):
    ids = F.array(F.struct(F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("namespace"), F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_custkey").cast("string")).alias("value")))
    out = F.transform(curation.normalize_external_ids(ids), lambda x: F.concat(x["namespace"], F.lit(":"), x["value"]))
    return fx.table("customer").select("c_custkey", F.array_join(out, ",").alias("ids"))


@query("SELECT p_partkey AS id, p_brand AS a, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS b FROM part")
def jsonb_merge(fx):
    base = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("p_type"))
    over = F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")))
    return fx.table("part").withColumn("m", curation.merge_maps(base, over)).select(F.col("p_partkey").alias("id"), F.try_element_at("m", F.lit("a")).alias("a"), F.try_element_at("m", F.lit("b")).alias("b"))


@query("SELECT name, position FROM (SELECT p_brand AS name, p_partkey AS position, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE -1 END DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def upsert_mirror(fx):
    rows = fx.table("part").where("p_partkey % 2 = 0").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("position"), F.col("p_partkey").alias("line"))
    mirror = fx.table("part").where("p_partkey % 2 = 1").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("position"))
    return curation.upsert_mirror(mirror, rows)


@query("SELECT p_partkey AS candidate, CASE WHEN p_partkey % 4 = 0 THEN p_partkey WHEN p_partkey % 6 = 0 THEN p_partkey + 1 END AS publication, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 6 = 0 THEN 'REUSE' ELSE 'INSERT' END AS how FROM part")
def promote_candidates(fx):
    p = fx.table("part")
    candidates = p.select(F.col("p_partkey").alias("candidate"), F.col("p_partkey").alias("work_id"), F.concat(F.lit("d"), "p_partkey").alias("doi"))
    pubs = p.where("p_partkey % 4 = 0 or p_partkey % 6 = 0").select(F.when(F.col("p_partkey") % 4 == 0, F.col("p_partkey")).alias("work_id"), F.concat(F.lit("d"), "p_partkey").alias("doi"), (F.col("p_partkey") + F.when(F.col("p_partkey") % 4 == 0, 0).otherwise(1)).alias("publication"))
    return curation.promote_candidates(candidates, pubs)



@query(CLOSURE + "SELECT ancestor_id AS node_id, sample_id, lat, lon FROM c JOIN (SELECT sample_id, terminal, nation AS lat, nation * 2 AS lon FROM fx_sample) s ON c.descendant_id = s.terminal WHERE lat <> 0")
def geo_under(fx):
    points = fx.sample.select("sample_id", "terminal", F.col("nation").alias("lat"), (F.col("nation") * 2).alias("lon"))
    return curation.points_under(tree.tree_closure(fx.edge, fx.node), points)


@query(CLOSURE + "SELECT ancestor_id AS node_id, count(*) AS anchors, min(ybp_raw) AS youngest FROM c JOIN fx_anchor a ON c.descendant_id = a.node_id WHERE ybp_raw > 1000 GROUP BY 1")
def ancient_under(fx):
    """Dated anchors at or below each clade."""
    old = fx.anchor.where("ybp_raw > 1000").withColumnRenamed("node_id", "descendant_id")
    return tree.tree_closure(fx.edge, fx.node).join(old, "descendant_id").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("anchors"), F.min("ybp_raw").alias("youngest"))


@query("SELECT collection || '/' || did::VARCHAR || '/' || rkey::VARCHAR AS parent, 'x' || arrival::VARCHAR AS identifier FROM (SELECT *, row_number() OVER (PARTITION BY collection, did, rkey ORDER BY time_us DESC, arrival DESC) AS rn FROM fx_commit) WHERE rn = 1 AND operation <> 'delete'")
def replace_children(fx):
    latest = reports.lww_latest(fx.commit).select(F.concat_ws("/", "collection", F.col("did").cast("string"), F.col("rkey").cast("string")).alias("parent"), F.array(F.concat(F.lit("x"), "arrival")).alias("identifiers"))
    return curation.replace_children(latest)


@query("SELECT node_id, method, row_number() OVER (PARTITION BY node_id ORDER BY CASE method WHEN 'COMBINED' THEN 0 WHEN 'SNP' THEN 1 WHEN 'GENEALOGICAL' THEN 2 ELSE 3 END, method) AS place FROM (SELECT DISTINCT node_id, CASE node_id * 7 % 5 WHEN 0 THEN 'COMBINED' ELSE 'STR' END AS method FROM fx_anchor UNION SELECT DISTINCT node_id, 'SNP' FROM fx_anchor WHERE node_id % 2 = 0)")
def estimates_listing(fx):
    a = fx.anchor.select("node_id").distinct()
    rows = a.select("node_id", F.when(F.col("node_id") * 7 % 5 == 0, "COMBINED").otherwise("STR").alias("method")).union(a.where("node_id % 2 = 0").select("node_id", F.lit("SNP")))
    return curation.estimates_listing(rows)


@query("""SELECT p.sample_id AS a, q.sample_id AS b, CASE WHEN p.terminal = q.terminal THEN 'SAME' WHEN x.parent_id = q.terminal OR y.parent_id = p.terminal THEN 'PARENT_CHILD' WHEN x.parent_id = y.parent_id THEN 'SIBLING' ELSE 'DISTANT' END AS relation,
    CASE WHEN p.terminal = q.terminal OR x.parent_id = q.terminal OR y.parent_id = p.terminal OR x.parent_id = y.parent_id THEN 'CONFIRMED' ELSE 'DISPUTED' END AS disposition, CASE WHEN p.terminal = q.terminal OR x.parent_id = q.terminal OR y.parent_id = p.terminal OR x.parent_id = y.parent_id THEN 0.98 ELSE 0.5 END AS score
    FROM fx_sample p JOIN fx_sample q ON p.donor_id = q.donor_id AND p.sample_id < q.sample_id LEFT JOIN fx_edge x ON x.child_id = p.terminal LEFT JOIN fx_edge y ON y.child_id = q.terminal""")
def identifier_adjudicate(fx):
    samples = fx.sample.select(F.col("donor_id").alias("identifier"), "sample_id", "terminal")
    return curation.identifier_adjudicate(curation.identifier_pairs(samples, fx.edge))


@query(CLOSURE + """, h AS (SELECT sample_id, population, sum(pct) AS pct FROM (SELECT sample_id, split_part(population, ' ', 1) AS population, CAST(quantity AS DOUBLE) / sum(quantity) OVER (PARTITION BY sample_id) AS pct FROM fx_share) GROUP BY 1, 2),
    k AS (SELECT c_custkey AS sample_id, c_mktsegment || ':' || c_nationkey::VARCHAR AS block FROM customer),
    ov AS (SELECT x.sample_id AS a, y.sample_id AS b, sum(least(x.pct, y.pct)) AS score FROM h x JOIN h y ON x.population = y.population AND x.sample_id < y.sample_id JOIN k kx ON kx.sample_id = x.sample_id JOIN k ky ON ky.sample_id = y.sample_id AND kx.block = ky.block GROUP BY 1, 2 HAVING round(sum(least(x.pct, y.pct)), 9) >= 0.6),
    dp AS (SELECT descendant_id AS terminal, max(distance) AS depth FROM c GROUP BY 1), n AS (SELECT terminal, count(*) AS n FROM fx_sample GROUP BY 1),
    hg AS (SELECT x.sample_id AS a, y.sample_id AS b, greatest((1 - n.n::DOUBLE / (SELECT count(*) FROM fx_sample)) * coalesce(dp.depth, 3)::DOUBLE / (coalesce(dp.depth, 3) + 8), 0.01::DOUBLE) AS score FROM fx_sample x JOIN fx_sample y ON x.terminal = y.terminal AND x.sample_id < y.sample_id JOIN n ON n.terminal = x.terminal LEFT JOIN dp ON dp.terminal = x.terminal),
    e AS (SELECT a AS x, b AS y FROM fx_pair WHERE segments > 1 UNION SELECT b, a FROM fx_pair WHERE segments > 1), sh AS (SELECT p.x AS a, q.x AS b, count(*) AS score FROM e p JOIN e q ON p.y = q.y AND p.x < q.x GROUP BY 1, 2 HAVING count(*) >= 2),
    s AS (SELECT a, b, 0.4::DOUBLE * score AS p0, 0.0::DOUBLE AS p1, 0.0::DOUBLE AS p2 FROM ov UNION ALL SELECT a, b, 0, 0.3::DOUBLE * score, 0 FROM hg UNION ALL SELECT a, b, 0, 0, 0.3::DOUBLE * score FROM sh),
    p AS (SELECT a, b, sum(p0) AS p0, sum(p1) AS p1, sum(p2) AS p2 FROM s GROUP BY 1, 2), d AS (SELECT * FROM p UNION ALL SELECT b, a, p0, p1, p2 FROM p)
    SELECT a, b, round(score, 6) AS score, CASE WHEN round(p0, 9) >= greatest(round(p1, 9), round(p2, 9)) THEN 'POPULATION_OVERLAP' WHEN round(p1, 9) >= round(p2, 9) THEN 'HAPLOGROUP' ELSE 'SHARED_MATCH' END AS "primary", rank
    FROM (SELECT *, p0 + p1 + p2 AS score, row_number() OVER (PARTITION BY a ORDER BY round(p0 + p1 + p2, 9) DESC, b) AS rank FROM d) q WHERE rank <= 50 AND NOT EXISTS (SELECT 1 FROM fx_pair f WHERE f.a = least(q.a, q.b) AND f.b = greatest(q.a, q.b) AND f.segments % 5 = 0)""")
def relative_suggestions(fx):
    """Overlap inside a block, shared terminals weighed by depth and rarity, and shared matches."""
    h = reports.shares(fx.share).select("sample_id", F.split("population", " ")[0].alias("population"), (F.col("pct") / 100).alias("pct")).groupBy("sample_id", "population").agg(F.sum("pct").alias("pct"))
    blocks = fx.table("customer").select(F.col("c_custkey").alias("sample_id"), F.concat_ws(":", "c_mktsegment", "c_nationkey").alias("block"))
    terminals = tree.cut_lineage(curation.terminal_scores(fx.sample, tree.node_depth(tree.tree_closure(fx.edge, fx.node))))
    shared = tree.cut_lineage(similarity.two_hop_join(fx.pair.where("segments > 1"), 2).select("a", "b", F.col("shared").cast("double").alias("score")))
    overlaps = curation.suggested_overlaps(h, blocks, terminals, shared, 0.6, 50)
    dismissed = similarity.symmetric_edges(fx.pair.where("segments % 5 = 0")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return rounded(curation.relative_suggestions(overlaps, terminals, shared, dismissed, 50), "score")


#: Names given node by node, from x(node_id, name, place): each takes the first in place that is not taken.
CLAIM = """, l AS (SELECT node_id, list(name ORDER BY place) AS names FROM x GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY node_id) AS k FROM l),
    w AS (SELECT 0::BIGINT AS k, 0::BIGINT AS node_id, NULL::VARCHAR AS name, []::VARCHAR[] AS taken
        UNION ALL SELECT k, node_id, name, CASE WHEN name IS NULL THEN taken ELSE list_append(taken, name) END FROM (SELECT o.k, o.node_id, w.taken, list_filter(o.names, lambda x: NOT list_contains(w.taken, x))[1] AS name FROM w JOIN o ON o.k = w.k + 1))
    SELECT node_id, name FROM w WHERE name IS NOT NULL"""


@query("WITH RECURSIVE x AS (SELECT DISTINCT node_id, 'M' || variant_id::VARCHAR AS name, variant_id AS place FROM fx_node_variant)" + CLAIM)
def natural_sort_pick(fx):
    return curation.natural_sort_pick(fx.node_variant.select("node_id", F.concat(F.lit("M"), "variant_id").alias("name")))


def votes(depth: int) -> str:
    """SQL of u<depth>: the mode of the nodes' own values at a depth and of their children's, which u<depth + 1> holds."""
    below = f" UNION ALL SELECT e.parent_id, marker, value FROM u{depth + 1} JOIN fx_edge e ON e.child_id = u{depth + 1}.node_id" if depth < 5 else ""
    both = f"SELECT node_id, marker, value, row_number() OVER (PARTITION BY node_id, marker ORDER BY count(*) DESC, value) AS rn FROM (SELECT own.node_id, marker, value FROM own JOIN d ON d.node_id = own.node_id WHERE depth = {depth}{below}) GROUP BY 1, 2, 3"
    return f", u{depth} AS (SELECT node_id, marker, value FROM ({both}) WHERE rn = 1)"


#: Motifs are of nodes below 50 (fx_str), which lie at a depth of 3 at most, so that six levels of votes hold all.
@query(CLOSURE + ", d AS (SELECT descendant_id AS node_id, max(distance) AS depth FROM c GROUP BY 1), own AS (SELECT node_id, marker, modal AS value FROM (" + MODAL + "))" + "".join(map(votes, range(5, -1, -1)))
       + ", up AS (" + " UNION ALL ".join(f"SELECT * FROM u{k}" for k in range(6)) + ") SELECT descendant_id AS node_id, marker, arg_min(value, distance) AS value FROM c JOIN up ON c.ancestor_id = up.node_id GROUP BY 1, 2")
def str_reconstruct(fx):
    return curation.str_reconstruct(reports.modal_haplotype(fx.str), fx.edge)


@query(f"""SELECT s.sample_id, s.source, coalesce('N' || n.node_id::VARCHAR, s.call_text) AS call, coalesce(r.runs, 0) AS runs, round(r.d, 6) AS avg_depth FROM {CALLS} s LEFT JOIN fx_node n ON n.name = s.token AND s.source <> 'CITIZEN' LEFT JOIN (SELECT o_custkey, count(*) AS runs, avg(l_quantity) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) r ON r.o_custkey = s.sample_id""")
def sample_report(fx):
    runs = fx.table("orders").join(fx.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("sample_id"), F.col("l_quantity").alias("depth"))
    return rounded(curation.sample_report(fx.sample, runs, placed(fx).select("sample_id", "node_id", "status")), "avg_depth")


@query(f"""WITH s AS ({SITE}), k AS (SELECT DISTINCT s.position, s.canon, n.node_id FROM (SELECT DISTINCT node_id, variant_id FROM fx_node_variant) n JOIN s ON s.id = n.variant_id)
    SELECT DISTINCT k.node_id, t.name AS candidate FROM k JOIN s t ON t.position = k.position AND t.canon = k.canon WHERE t.name IS NOT NULL AND t.name NOT LIKE '%:%' AND t.branch_id IS NULL
    AND NOT EXISTS (SELECT 1 FROM fx_region r WHERE region_type IN ('heterochromatin', 'inverted_repeat') AND t.position BETWEEN r.start_pos AND r.end_pos)""")
def private_node_names(fx):
    return catalog.private_node_names(fx.node.select("node_id"), fx.node_variant.select("node_id", "variant_id"), fx.variant, fx.region).select("node_id", "candidate")


@query("SELECT k.p_partkey AS id, k.p_name AS name, array_to_string(list_sort(list_filter(list_distinct([k.p_brand, d.p_type, d.p_name]), lambda x: x <> k.p_name)), ',') AS aliases FROM part k JOIN part d ON d.p_partkey = k.p_partkey + 1 WHERE k.p_partkey % 2 = 0")
def alias_union(fx):
    p = fx.table("part")
    keep = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"))
    drop = p.select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("name"), F.array("p_type").alias("aliases"))
    return catalog.alias_union(keep, drop).select("id", "name", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN 'simple' WHEN 1 THEN 'multiCopy' WHEN 2 THEN 'complex' END AS kind, CASE l_linenumber % 4 WHEN 0 THEN l_partkey::INT END AS repeats FROM lineitem")
def parse_str_token(fx):
    k, n = F.col("l_linenumber") % 4, F.col("l_partkey").cast("string")
    t = formats.parse_str_token(F.when(k == 0, F.concat(F.lit(' "'), n, F.lit('"'))).when(k == 1, F.concat(n, F.lit("-"), n)).when(k == 2, F.concat(n, F.lit("*"))).otherwise("-"))
    return fx.table("lineitem").withColumn("t", t).select("l_orderkey", "l_linenumber", "l_partkey", "t.kind", "t.repeats")





@query("SELECT id, anc, der, CASE WHEN position % 4 <> 0 THEN position + 3 END AS rotated, CASE WHEN position % 4 <> 0 THEN 'LIFTED' ELSE 'UNMAPPED' END AS how FROM fx_variant")
def mt_rotation_lift(fx):
    """Positions through a rotation map, alleles as they are; those that it does not hold are told."""
    turned = fx.variant.select("position", F.when(F.col("position") % 4 != 0, F.col("position") + 3).alias("rotated")).distinct()
    return intervals.mt_rotation_lift(fx.variant, turned)


@query()
def snp_age_propagate(fx):
    """Branch ages over the tree of parts, from link counts; every sample is a tester of its terminal."""
    from ..operators import ages

    snps = fx.node_variant.groupBy(F.col("node_id").alias("child_id")).agg((F.count("*") % 8).alias("snps"))
    branches = fx.edge.join(snps, "child_id", "left").select("child_id", "parent_id", F.coalesce("snps", F.lit(0)).cast("int").alias("snps"), F.lit(15e6).alias("bp"))
    testers = fx.sample.select("sample_id", "terminal", "mt").distinct().select(F.col("terminal").alias("node_id"), (F.col("mt") % 12).cast("int").alias("snps"), F.lit(12e6).alias("bp"))
    return rounded(ages.snp_age_propagate(branches, testers), "mean", "median", "lo", "hi", "formed")
