"""Queries of the catalog, interval and similarity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna, scalars
from ..operators import catalog, intervals, reports, similarity
from .report_queries import MODAL, rounded

REGISTERED: dict = {}


def query(sql: str | None = None):
    def add(build):
        REGISTERED[build.__name__] = (build, sql)
        return build

    return add


# allele expansion, canonical alleles and contigs of fx_variant in SQL, over the values that the adapter holds
EXP = "CASE WHEN {0} = '3GC' THEN 'GCGCGC' ELSE {0} END"
CANON = """CASE WHEN length(a) = 1 AND length(d) = 1 THEN least(a || '>' || d, translate(a, 'ACGT', 'TGCA') || '>' || translate(d, 'ACGT', 'TGCA'))
    WHEN length(a) = length(d) THEN a || '>' || d WHEN a = 'T' AND d = 'TC' THEN 'T>TC' WHEN a = 'TA' AND d = 'TCA' THEN 'T>TC' ELSE a || '>' || d END"""
MUT = "CASE WHEN length(a) = 1 AND length(d) = 1 THEN 'SNP' WHEN length(a) = length(d) THEN 'MNP' ELSE 'INDEL' END"
PLACE = "(name IS NULL OR name LIKE 'chr%:%')"
RANK = "CASE upper(regexp_extract({0}, '^[A-Za-z]+')) WHEN 'M' THEN 1 WHEN 'P' THEN 2 WHEN 'CTS' THEN 7 WHEN 'FGC' THEN 11 WHEN 'YFS' THEN 90 ELSE 50 END"
SITE = f"SELECT *, 'chrY' AS c, {CANON} AS canon, {MUT} AS mutation FROM (SELECT *, {EXP.format('anc')} AS a, {EXP.format('der')} AS d FROM fx_variant)"


@query(f"SELECT id, canon FROM ({SITE})")
def allele_canon(fx):
    return fx.variant.select("id", dna.allele_canon(F.col("anc"), F.col("der")).alias("canon"))


@query(f"SELECT mutation, count(*) AS n FROM ({SITE}) GROUP BY 1")
def mutation_type(fx):
    return catalog.mutation_counts(fx.variant)


@query(f"SELECT id, {EXP.format('anc')} AS anc, {EXP.format('der')} AS der FROM fx_variant")
def expand_repeat(fx):
    return fx.variant.select("id", dna.expand_repeat(F.col("anc")).alias("anc"), dna.expand_repeat(F.col("der")).alias("der"))


@query("SELECT id, translate(anc, 'ACGT', 'TGCA') AS complement, reverse(translate(der, 'ACGT', 'TGCA')) AS reversed FROM fx_variant")
def dna_complement(fx):
    return fx.variant.select("id", dna.dna_complement(F.col("anc")).alias("complement"), dna.revcomp(F.col("der")).alias("reversed"))


@query(f"SELECT id, name, {RANK.format('name')} AS rank FROM fx_variant WHERE name IS NOT NULL AND name NOT LIKE 'chr%'")
def name_rank(fx):
    rows = fx.variant.where("name is not null and name not like 'chr%'")
    return rows.select("id", "name", dna.name_rank(F.col("name")).alias("rank"))


@query(f"SELECT id, {PLACE} AS placeholder FROM fx_variant")
def is_placeholder_name(fx):
    return fx.variant.select("id", dna.is_placeholder_name(F.col("name")).alias("placeholder"))


@query(f"SELECT id, CASE WHEN naming_status = 'PENDING_REVIEW' THEN naming_status WHEN {PLACE} THEN 'UNNAMED' ELSE 'NAMED' END AS status FROM fx_variant")
def naming_status_normalize(fx):
    return fx.variant.select("id", dna.naming_status(F.col("name"), F.col("naming_status")).alias("status"))


@query(f"SELECT id, mutation FROM ({SITE}) WHERE branch_id IS NOT NULL AND ({PLACE} OR naming_status = 'PENDING_REVIEW')")
def naming_queue(fx):
    return catalog.naming_queue(fx.variant).select("id", "mutation")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'X' || id::VARCHAR WHEN id % 3 = 1 THEN name END AS name FROM fx_variant")
def established_name(fx):
    """First alias that is neither minted nor a placeholder."""
    aliases = F.when(F.col("id") % 3 == 0, F.array(F.concat(F.lit("DU"), F.col("id").cast("string")), F.lit("chrY:1:A>G"), F.concat(F.lit("X"), F.col("id").cast("string"))))
    aliases = aliases.when((F.col("id") % 3 == 1) & ~dna.is_placeholder_name(F.col("name")), F.array("name")).otherwise(F.array().cast("array<string>"))
    out = dna.established_name(aliases)
    return fx.variant.select("id", F.when((F.col("id") % 3 == 1) & F.col("name").like("chr%:%"), F.col("name")).otherwise(out).alias("name"))


@query("SELECT id, CASE WHEN name IS NULL THEN 'Z' || id::VARCHAR ELSE least(name, 'Z' || id::VARCHAR) || ' ' || greatest(name, 'Z' || id::VARCHAR) END AS t FROM fx_variant")
def alias_search_text(fx):
    """Aliases in order, joined by blanks."""
    aliases = F.array_compact(F.array(F.col("name"), F.concat(F.lit("Z"), F.col("id").cast("string"))))
    return fx.variant.select("id", F.concat_ws(" ", F.array_sort(aliases)).alias("t"))


MIRROR = "SELECT id, name, contig, position, anc, der FROM fx_variant WHERE id % 2 = 0"
KNOWN = "SELECT * FROM fx_variant WHERE id % 2 <> 0"


def mirror_and_known(fx):
    """Every variant on one side: even ids from a mirror, odd ones known."""
    v = fx.variant
    mirror = v.where("id % 2 = 0")
    known = v.where("id % 2 <> 0").withColumn("aliases", F.array(F.concat(F.lit("M"), (F.col("id") + 1).cast("string"))))
    return mirror, known


@query(f"""SELECT DISTINCT m.name, k.variant_id FROM ({MIRROR}) m JOIN (SELECT name, id AS variant_id FROM ({KNOWN}) UNION SELECT 'M' || (id + 1)::VARCHAR, id FROM ({KNOWN})) k ON m.name = k.name""")
def name_alias_match(fx):
    return catalog.name_alias_match(*mirror_and_known(fx))


@query(f"""SELECT DISTINCT m.name, k.id AS variant_id FROM (SELECT * FROM ({SITE}) WHERE id % 2 = 0) m JOIN (SELECT * FROM ({SITE}) WHERE id % 2 <> 0) k ON m.position = k.position AND m.canon = k.canon""")
def coord_match(fx):
    return catalog.coord_match(*mirror_and_known(fx))


@query(f"""WITH m AS (SELECT * FROM ({SITE}) WHERE id % 2 = 0 AND name IS NOT NULL AND position > 1), k AS (SELECT * FROM ({SITE}) WHERE id % 2 <> 0),
    f AS (SELECT DISTINCT name, variant_id FROM (SELECT m.name, k.id AS variant_id FROM (SELECT * FROM ({SITE}) WHERE id % 2 = 0) m JOIN k ON m.position = k.position AND m.canon = k.canon UNION ALL
        SELECT m.name, k.variant_id FROM m JOIN (SELECT name, id AS variant_id FROM k UNION SELECT 'M' || (id + 1)::VARCHAR, id FROM k) k ON m.name = k.name)),
    x AS (SELECT m.c, m.position, m.canon, m.name, {RANK.format('m.name')} AS r, f.variant_id FROM m LEFT JOIN f ON m.name = f.name)
    SELECT c, position, canon, array_to_string(list_transform(list_sort(list_distinct(list({{'r': r, 'n': name}}))), lambda q: q.n), ',') AS names, count(DISTINCT variant_id) AS matches,
        CASE WHEN count(DISTINCT variant_id) > 1 THEN 'FLAG' WHEN count(DISTINCT variant_id) = 1 THEN 'ENRICH' WHEN min(r) >= 90 THEN 'MINT' ELSE 'CREATE' END AS action FROM x GROUP BY 1, 2, 3""")
def catalog_reconcile(fx):
    return catalog.catalog_reconcile(*mirror_and_known(fx))


@query(f"""WITH s AS ({SITE}) SELECT id, twin_id, twin_name, rank FROM (SELECT x.id, y.id AS twin_id, y.name AS twin_name, row_number() OVER (PARTITION BY x.id ORDER BY {RANK.format('y.name')}, y.name, y.id) AS rank
    FROM s x JOIN s y ON x.position = y.position AND x.canon = y.canon AND x.id <> y.id WHERE y.name IS NOT NULL AND y.name NOT LIKE 'chr%:%') WHERE rank <= 10""")
def site_twin(fx):
    return catalog.site_twin(fx.variant)



@query(f"""WITH s AS (SELECT *, list_sort(string_split(canon, '>')) AS al FROM ({SITE})), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY position, al ORDER BY {PLACE}, id) AS rn FROM s WHERE id % 2 <> 0) WHERE rn = 1)
    SELECT s.id, b.id AS variant_id, coalesce(b.name, s.c || ':' || s.position::VARCHAR || ':' || s.canon) AS resolved, CASE WHEN b.id IS NULL THEN 'MINTED' ELSE 'FOUND' END AS how FROM s LEFT JOIN b ON s.position = b.position AND s.al = b.al WHERE s.id % 2 = 0""")
def catalog_resolve(fx):
    mirror, known = mirror_and_known(fx)
    return catalog.catalog_resolve(mirror, known)


TWIN1 = f"""SELECT id, twin_name FROM (SELECT x.id, y.name AS twin_name, row_number() OVER (PARTITION BY x.id ORDER BY {RANK.format('y.name')}, y.name, y.id) AS rank
    FROM ({SITE}) x JOIN ({SITE}) y ON x.position = y.position AND x.canon = y.canon AND x.id <> y.id WHERE y.name IS NOT NULL AND y.name NOT LIKE 'chr%:%') WHERE rank = 1"""


@query(f"""SELECT min(id) AS id, twin_name AS new_name FROM (SELECT v.id, t.twin_name, coalesce(v.branch_id, -1) AS b FROM fx_variant v JOIN ({TWIN1}) t ON v.id = t.id WHERE {PLACE.replace('name', 'v.name')}) q
    WHERE NOT EXISTS (SELECT 1 FROM fx_variant k WHERE k.name = q.twin_name AND coalesce(k.branch_id, -1) = q.b) GROUP BY twin_name, b""")
def adopt_names(fx):
    return catalog.adopt_names(fx.variant)


@query(f"""SELECT c, position, canon, rows, 'DU' || lpad(row_number() OVER (ORDER BY c, position, canon)::VARCHAR, 5, '0') AS new_name FROM (SELECT c, position, canon, count(*) AS rows FROM ({SITE}) GROUP BY 1, 2, 3 HAVING max(CASE WHEN {PLACE} THEN 0 ELSE 1 END) = 0 AND count(branch_id) = count(DISTINCT branch_id))""")
def mint_names(fx):
    return catalog.mint_names(fx.variant)


@query(f"""WITH s AS ({SITE}) SELECT DISTINCT x.id, n.node_id FROM s x JOIN s y ON x.position = y.position AND x.canon = y.canon JOIN fx_node_variant n ON n.variant_id = y.id""")
def variant_branches(fx):
    return catalog.variant_branches(fx.node_variant, fx.variant)


@query("""SELECT DISTINCT n.node_id, v.name AS variant, v.anc, v.der FROM fx_node_variant n JOIN fx_variant v ON n.variant_id = v.id JOIN fx_node k ON k.node_id = n.node_id WHERE v.name IS NOT NULL""")
def tree_full_links(fx):
    return catalog.tree_full_links(fx.node, fx.node_variant.select("node_id", "variant_id"), fx.variant)


@query("""SELECT variant_id, node_id, CASE WHEN count(*) OVER (PARTITION BY variant_id) = 1 THEN 'SINGLE' ELSE 'SPLIT' END AS how, row_number() OVER (PARTITION BY variant_id ORDER BY node_id) AS k FROM (SELECT DISTINCT variant_id, node_id FROM fx_node_variant)""")
def site_name_backfill(fx):
    return catalog.site_name_backfill(fx.node_variant)


@query("""SELECT id, coalesce(f.flags, '') AS flags FROM fx_variant v LEFT JOIN (SELECT v.id AS vid, string_agg(DISTINCT region_type || ':' || label, ',' ORDER BY region_type || ':' || label) AS flags FROM fx_variant v JOIN fx_region r ON v.position BETWEEN r.start_pos AND r.end_pos GROUP BY 1) f ON v.id = f.vid""")
def region_overlap_flags(fx):
    return intervals.region_overlap_flags(fx.variant, fx.region)


@query("""SELECT id FROM fx_variant v WHERE NOT EXISTS (SELECT 1 FROM fx_region r WHERE region_type IN ('heterochromatin', 'inverted_repeat') AND v.position BETWEEN r.start_pos AND r.end_pos)""")
def recurrent_mask(fx):
    return intervals.recurrent_mask(fx.variant, fx.region).select("id")


@query("""SELECT id FROM fx_variant v WHERE EXISTS (SELECT 1 FROM fx_region r WHERE v.position >= r.start_pos AND v.position < r.end_pos)""")
def callable_mask_semi(fx):
    mask = fx.region.select(F.col("start_pos").alias("s"), F.col("end_pos").alias("e")).where("e > s")
    return intervals.callable_mask_semi(fx.variant, mask).select("id")


@query("""SELECT v.id, CASE WHEN strand = '-' THEN q_start + (t_end - 1 - position) ELSE q_start + position - t_start END AS lifted, CASE WHEN strand = '-' THEN reverse(translate(anc, 'ACGT', 'TGCA')) ELSE anc END AS anc,
    CASE WHEN strand = '-' THEN reverse(translate(der, 'ACGT', 'TGCA')) ELSE der END AS der, CASE WHEN c.block_id IS NULL THEN 'UNMAPPED' ELSE 'LIFTED' END AS how FROM fx_variant v LEFT JOIN fx_chain c ON v.position >= t_start AND v.position < t_end""")
def liftover_join(fx):
    return intervals.liftover_join(fx.variant, fx.chain)


@query("""SELECT v.id, CASE WHEN r.base IS NULL THEN 'unchecked' WHEN r.base IN (v.anc, v.der) THEN 'validated' ELSE 'mismatch' END AS status FROM fx_variant v LEFT JOIN (SELECT position AS p, min(CASE WHEN position % 3 <> 0 THEN anc END) AS base FROM fx_variant GROUP BY 1) r ON v.position = r.p""")
def ref_base_check(fx):
    """Does the reference base at a position match either allele?"""
    base = fx.variant.groupBy("position").agg(F.min(F.when(F.col("position") % 3 != 0, F.col("anc"))).alias("base"))
    rows = fx.variant.join(base, "position", "left")
    return rows.select("id", F.when(F.col("base").isNull(), "unchecked").when((F.col("base") == F.col("anc")) | (F.col("base") == F.col("der")), "validated").otherwise("mismatch").alias("status"))


MERGED = """SELECT k, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS new FROM ({0}) WHERE e > s)) GROUP BY k, i"""
IV_A, IV_B = MERGED.format("SELECT * FROM fx_interval WHERE s % 2 = 0"), MERGED.format("SELECT * FROM fx_interval WHERE s % 2 = 1")


@query(MERGED.format("SELECT * FROM fx_interval"))
def interval_merge(fx):
    return intervals.interval_merge(fx.interval)


@query(f"SELECT k, CAST(sum(e - s) AS BIGINT) AS bp FROM ({MERGED.format('SELECT * FROM fx_interval')}) GROUP BY k")
def interval_total_bp(fx):
    return intervals.interval_total_bp(intervals.interval_merge(fx.interval))


@query(f"SELECT a.k, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS bp FROM ({IV_A}) a JOIN ({IV_B}) b ON a.k = b.k AND a.s < b.e AND b.s < a.e GROUP BY a.k")
def interval_intersect_bp(fx):
    return intervals.interval_intersect_bp(fx.interval.where("s % 2 = 0"), fx.interval.where("s % 2 = 1"))


@query(f"""WITH a AS ({IV_A}), b AS ({IV_B}), p AS (SELECT DISTINCT k, unnest(range(s, e)) AS x FROM a), q AS (SELECT DISTINCT k, unnest(range(s, e)) AS x FROM b), r AS (SELECT k, x FROM p EXCEPT SELECT k, x FROM q)
    SELECT k, min(x) AS s, max(x) + 1 AS e FROM (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS g FROM r) GROUP BY k, g""")
def interval_subtract(fx):
    """Adjoining pieces are merged again, as the oracle counts positions."""
    return intervals.interval_merge(intervals.interval_subtract(fx.interval.where("s % 2 = 0"), fx.interval.where("s % 2 = 1")))


@query(f"""WITH a AS ({IV_A}), b AS ({IV_B}), i AS (SELECT a.k, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS bp FROM a JOIN b ON a.k = b.k AND a.s < b.e AND b.s < a.e GROUP BY a.k)
    SELECT t.k, CAST(t.bp AS BIGINT) AS total, CAST(coalesce(i.bp, 0) AS BIGINT) AS inside, CAST(t.bp - coalesce(i.bp, 0) AS BIGINT) AS outside FROM (SELECT k, sum(e - s) AS bp FROM a GROUP BY k) t LEFT JOIN i ON t.k = i.k""")
def callable_partition(fx):
    """Callable bases per sample, inside and outside a region set."""
    a, b = fx.interval.where("s % 2 = 0"), fx.interval.where("s % 2 = 1")
    total = intervals.interval_total_bp(intervals.interval_merge(a)).withColumnRenamed("bp", "total")
    inside = intervals.interval_intersect_bp(a, b).withColumnRenamed("bp", "inside")
    return total.join(inside, "k", "left").select("k", "total", F.coalesce("inside", F.lit(0)).alias("inside"), (F.col("total") - F.coalesce("inside", F.lit(0))).alias("outside"))


SETS = "SELECT sample_id, count(*) AS size FROM fx_sample_variant GROUP BY 1"
PAIRS = f"""SELECT terminal, a, b, shared, shared * 1.0 / (x.size + y.size - shared) AS jaccard FROM (SELECT p.terminal, p.sample_id AS a, q.sample_id AS b, count(*) AS shared FROM fx_sample_variant p JOIN fx_sample_variant q
    ON p.terminal = q.terminal AND p.variant_id = q.variant_id AND p.sample_id < q.sample_id GROUP BY 1, 2, 3) JOIN ({SETS}) x ON a = x.sample_id JOIN ({SETS}) y ON b = y.sample_id"""


@query("""SELECT p.terminal, p.sample_id AS a, q.sample_id AS b, count(*) AS shared FROM fx_sample_variant p JOIN fx_sample_variant q ON p.terminal = q.terminal AND p.variant_id = q.variant_id AND p.sample_id < q.sample_id GROUP BY 1, 2, 3""")
def unordered_pair_join(fx):
    return similarity.shared_counts(fx.sample_variant, ["terminal"])


@query(f"SELECT terminal, a, b, shared, round(jaccard, 6) AS jaccard FROM ({PAIRS})")
def jaccard(fx):
    return rounded(similarity.jaccard_pairs(fx.sample_variant, ["terminal"]), "jaccard")


@query(f"""WITH m AS (SELECT sample_id, sample_id % 50 AS terminal, CASE WHEN mt <> 7 THEN mt END AS mt FROM fx_sample), k AS (SELECT a, b, shared, jaccard FROM ({PAIRS})),
    e AS (SELECT p.sample_id AS a, q.sample_id AS b, coalesce(p.mt = q.mt, FALSE) AS mt_match FROM m p JOIN m q ON p.terminal = q.terminal AND p.sample_id < q.sample_id)
    SELECT a, b, coalesce(shared, 0) AS shared, round(coalesce(jaccard, 0.0), 6) AS jaccard, mt_match, round(least(1.0, 0.4 * mt_match::INT + 0.6 * coalesce(jaccard, 0.0)), 6) AS score FROM e LEFT JOIN k USING (a, b) WHERE mt_match OR (shared >= 3 AND jaccard >= 0.5)""")
def duplicate_candidates(fx):
    """Every sample of a terminal, those without variants too; one mt in forty is not known."""
    samples = fx.sample.select("sample_id", (F.col("sample_id") % 50).alias("terminal"), F.when(F.col("mt") != 7, F.col("mt")).alias("mt"))
    return rounded(similarity.duplicate_candidates(fx.sample_variant.select("sample_id", "variant_id"), samples), "jaccard", "score")


@query("""WITH m AS (SELECT sample_id, sample_id % 50 AS terminal, CASE WHEN mt <> 7 THEN mt END AS mt FROM fx_sample), s AS (SELECT m.sample_id, list_sort(list(v.variant_id) FILTER (v.variant_id IS NOT NULL)) AS v FROM m LEFT JOIN fx_sample_variant v ON m.sample_id = v.sample_id GROUP BY 1)
    SELECT terminal, mt, min(sample_id) OVER (PARTITION BY terminal, mt, coalesce(v, [])) AS kind, sample_id FROM m JOIN s USING (sample_id)""")
def duplicate_blocks(fx):
    """The kinds that samples of one terminal and mt fall into."""
    samples = fx.sample.select("sample_id", (F.col("sample_id") % 50).alias("terminal"), F.when(F.col("mt") != 7, F.col("mt")).alias("mt"))
    return similarity.duplicate_blocks(fx.sample_variant.select("sample_id", "variant_id"), samples).members


@query("""WITH s AS (SELECT sample_id, population, 100 * quantity / sum(quantity) OVER (PARTITION BY sample_id) AS pct FROM fx_share), p AS (SELECT a, b FROM fx_pair)
    SELECT p.a, p.b, round(sum(least(x.pct, y.pct)), 6) AS overlap FROM p JOIN s x ON p.a = x.sample_id JOIN s y ON p.b = y.sample_id AND x.population = y.population GROUP BY 1, 2""")
def population_overlap(fx):
    return rounded(similarity.population_overlap(reports.shares(fx.share), fx.pair.select("a", "b")), "overlap")


@query("SELECT a AS x, b AS y FROM fx_pair UNION ALL SELECT b, a FROM fx_pair")
def symmetric_edges(fx):
    return similarity.symmetric_edges(fx.pair)


@query("""WITH e AS (SELECT a AS x, b AS y FROM fx_pair WHERE segments > 1 UNION SELECT b, a FROM fx_pair WHERE segments > 1) SELECT p.x AS a, q.x AS b, count(*) AS shared FROM e p JOIN e q ON p.y = q.y AND p.x < q.x GROUP BY 1, 2 HAVING count(*) >= 2""")
def two_hop_join(fx):
    return similarity.two_hop_join(fx.pair.where("segments > 1"), 2)


@query("""WITH c AS (SELECT a, b, cm, 1 AS party, false AS disputed FROM fx_pair UNION ALL SELECT a, b, cm + segments * 7, 2, (a + b) % 9 = 0 FROM fx_pair WHERE (a + b) % 4 <> 0),
    g AS (SELECT a, b, count(DISTINCT party) AS parties, min(cm) AS lo, max(cm) AS hi, avg(cm) AS cm, max(disputed) AS disputed FROM c GROUP BY 1, 2),
    s AS (SELECT *, CASE WHEN disputed THEN 'DISPUTED' WHEN parties < 2 THEN 'PENDING' WHEN hi - lo <= greatest(10.0, 0.2 * hi) THEN 'CONFIRMED' ELSE 'DISPUTED' END AS status FROM g)
    SELECT a, b, parties, round(CASE WHEN status = 'CONFIRMED' THEN cm END, 6) AS cm, status FROM s""")
def attestation_consensus(fx):
    p = fx.pair
    one = p.select("a", "b", "cm", F.lit(1).alias("party"), F.lit(False).alias("disputed"))
    two = p.where("(a + b) % 4 <> 0").select("a", "b", (F.col("cm") + F.col("segments") * 7).alias("cm"), F.lit(2).alias("party"), ((F.col("a") + F.col("b")) % 9 == 0).alias("disputed"))
    return rounded(similarity.attestation_consensus(one.union(two)), "cm")


@query("""WITH d AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 3 <> 0), e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS v, p_partkey % 7 <> 0 AS owned FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0)
    SELECT coalesce(d.k, e.k) AS k, CASE WHEN e.k IS NULL THEN d.v WHEN NOT e.owned OR d.v IS NOT DISTINCT FROM e.v THEN e.v WHEN d.k IS NULL THEN e.v ELSE d.v END AS v,
    CASE WHEN e.k IS NULL THEN 'I' WHEN NOT e.owned OR (d.k IS NOT NULL AND d.v IS NOT DISTINCT FROM e.v) THEN 'K' WHEN d.k IS NULL THEN 'D' ELSE 'U' END AS change FROM d FULL JOIN e ON d.k = e.k""")
def assign_and_prune(fx):
    part = fx.table("part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    existing = part.where("k % 2 = 0 or k % 3 = 0").withColumn("v", F.when(F.col("k") % 4 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return similarity.assign_and_prune(part.where("k % 3 <> 0"), existing, ["k"], ["v"], F.col("k") % 7 != 0)


OLD = "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS title, p_size AS pages FROM part WHERE p_partkey % 2 = 0"
NEW = "SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS title, p_size + 1 AS pages FROM part WHERE p_partkey % 2 <> 0 OR p_partkey % 3 = 0"


def old_new(fx):
    p = fx.table("part")
    old = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("title"), F.col("p_size").alias("pages"))
    new = p.where("p_partkey % 2 <> 0 or p_partkey % 3 = 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("title"), (F.col("p_size") + 1).alias("pages"))
    return old, new


@query(f"SELECT coalesce(o.k, n.k) AS k, coalesce(n.title, o.title) AS title, coalesce(n.pages, o.pages) AS pages FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.k = n.k")
def merge_overwrite(fx):
    return similarity.merge_overwrite(*old_new(fx), ["k"])


@query(f"SELECT coalesce(o.k, n.k) AS k, coalesce(o.title, n.title) AS title, coalesce(o.pages, n.pages) AS pages FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.k = n.k")
def merge_gap_fill(fx):
    return similarity.merge_gap_fill(*old_new(fx), ["k"])


@query(f"SELECT coalesce(o.k, n.k) AS k, coalesce(n.title, o.title) AS title, o.k IS NULL AS inserted FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.k = n.k")
def candidate_upsert(fx):
    """Refreshed metadata, and whether a candidate is new."""
    old, new = old_new(fx)
    merged = similarity.merge_overwrite(old, new, ["k"])
    return merged.join(old.select("k", F.lit(False).alias("inserted")), "k", "left").select("k", "title", F.coalesce("inserted", F.lit(True)).alias("inserted"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 6 <> 0")
def snapshot_delta(fx):
    today = fx.table("orders").select("o_orderkey", "o_custkey")
    return similarity.snapshot_delta(today, today.where("o_orderkey % 4 <> 0 and o_orderkey % 6 = 0"))


@query("""SELECT marker, rate, source, priority FROM (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY priority, source) AS rn FROM (SELECT p_size AS marker, max(p_retailprice) AS rate, 'A' AS source, 1 AS priority FROM part WHERE p_size % 2 = 0 GROUP BY 1 UNION ALL SELECT p_size, min(p_retailprice), 'B', 2 FROM part GROUP BY 1)) WHERE rn = 1""")
def prefer_primary_source(fx):
    p = fx.table("part")
    one = p.where("p_size % 2 = 0").groupBy(F.col("p_size").alias("marker")).agg(F.max("p_retailprice").alias("rate")).withColumns({"source": F.lit("A"), "priority": F.lit(1)})
    two = p.groupBy(F.col("p_size").alias("marker")).agg(F.min("p_retailprice").alias("rate")).withColumns({"source": F.lit("B"), "priority": F.lit(2)})
    return similarity.prefer_primary_source(one.union(two))


@query(f"""SELECT c.node_id, c.marker, c.modal AS value, p.modal AS parent_value, c.modal <> p.modal AS changed FROM ({MODAL}) c JOIN fx_edge e ON c.node_id = e.child_id JOIN ({MODAL}) p ON p.node_id = e.parent_id AND p.marker = c.marker""")
def str_branch_mutations(fx):
    return similarity.str_branch_mutations(reports.modal_haplotype(fx.str), fx.edge)
