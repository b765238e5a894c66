"""Queries of placements, sample and donor merges, claim views, ancestry blocks, node names and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation, merges, placement, reports, search, similarity
from .catalog_queries import SITE
from .curation_queries import CLAIM
from .fixtures import VIEWS

REGISTERED: dict = {}


def query(sql: str | None = None):
    def add(build):
        REGISTERED[build.__name__] = (build, sql)
        return build

    return add


def s(expression: str) -> str:
    return f"CAST({expression} AS VARCHAR(20))"


# ------------------------------------------------------------------ placements

#: Calls by name, alias, defining SNP (behind a label, in lower case, as a synonym) and none.
VIEWS["fx_call"] = f"""SELECT sample_id, source, CASE sample_id % 6 WHEN 0 THEN call_text WHEN 1 THEN ' OLD' || {s('sample_id % 400')} || ' ' WHEN 2 THEN 'R-P' || {s('sample_id % 100 * 7')} || '*/ZZ1' WHEN 3 THEN 'X > p' || {s('sample_id % 100 * 7')} WHEN 4 THEN 'n/a (none)' END AS call_text,
    sample_id % 31 = 0 AS deleted, sample_id % 17 = 0 AS denovo FROM fx_sample"""
VIEWS["fx_called_node"] = f"""SELECT node_id, name, valid_until, CASE WHEN node_id % 2 = 0 THEN TIMESTAMP '2020-01-01 00:00:00' ELSE TIMESTAMP '2021-01-01 00:00:00' END AS valid_from, 'OLD' || {s('node_id % 300')} AS alias FROM fx_node"""
VIEWS["fx_placement"] = """SELECT sample_id, sample_id % 90 AS node_id, 'before' AS call_text, CASE WHEN sample_id % 13 = 0 THEN 'CURATED' ELSE 'PLACED' END AS status FROM fx_sample WHERE sample_id % 2 = 0"""

FOUND = """t AS (SELECT DISTINCT call_text, 0 AS pos, trim(call_text) AS token FROM fx_call WHERE trim(call_text) <> ''
        UNION SELECT call_text, 1, regexp_extract(call_text, '^R-(P[0-9]+)', 1) FROM fx_call WHERE call_text LIKE 'R-P%' UNION SELECT call_text, 2, 'ZZ1' FROM fx_call WHERE call_text LIKE 'R-P%'
        UNION SELECT call_text, 1, regexp_extract(call_text, '> (.*)$', 1) FROM fx_call WHERE call_text LIKE '% > %' UNION SELECT call_text, 2, regexp_extract(call_text, '^([A-Z]) >', 1) FROM fx_call WHERE call_text LIKE '% > %'),
    h AS (SELECT call_text, pos, 0 AS step, NULL AS began, node_id FROM t JOIN fx_called_node ON name = token UNION ALL SELECT call_text, pos, 1, valid_from, node_id FROM t JOIN fx_called_node ON alias = token WHERE valid_until IS NULL
        UNION ALL SELECT call_text, pos, 2, n.valid_from, n.node_id FROM t JOIN fx_variant v ON lower(v.name) = lower(token) JOIN fx_node_variant l ON l.variant_id = v.id JOIN fx_called_node n ON n.node_id = l.node_id WHERE n.valid_until IS NULL),
    f AS (SELECT call_text, node_id FROM h QUALIFY row_number() OVER (PARTITION BY call_text ORDER BY pos, step, began DESC NULLS LAST, node_id) = 1)"""


def tree_of(fx):
    nodes = fx.called_node.withColumn("aliases", F.array("alias"))
    return nodes, fx.node_variant.select("node_id", "variant_id"), fx.variant.select("id", "name")


@query(f"WITH {FOUND} SELECT * FROM f")
def resolve_calls(fx):
    """Each distinct call's node, by name, alias or defining SNP."""
    return placement.resolve_calls(fx.call, *tree_of(fx))


@query(f"""WITH {FOUND} SELECT p.sample_id, p.node_id, p.call_text, p.status FROM fx_placement p JOIN fx_call c ON c.sample_id = p.sample_id WHERE (p.status = 'CURATED' OR c.denovo) AND c.source <> 'CITIZEN' AND NOT c.deleted
    UNION ALL SELECT c.sample_id, f.node_id, c.call_text, CASE WHEN f.node_id IS NULL THEN 'UNPLACED' ELSE 'PLACED' END FROM fx_call c LEFT JOIN f ON f.call_text = c.call_text
    WHERE c.source <> 'CITIZEN' AND NOT c.deleted AND trim(c.call_text) <> '' AND NOT c.denovo AND c.sample_id NOT IN (SELECT sample_id FROM fx_placement WHERE status = 'CURATED')""")
def place_samples(fx):
    """All placements computed anew; curated and topological ones stay."""
    return placement.place_samples(fx.call, fx.placement, *tree_of(fx))


# ------------------------------------------------------------------ merges

#: Of each ten samples 1, 2 and 3 go into 0: 2 by way of 1.
MERGED = "SELECT sample_id AS merged, CASE sample_id % 10 WHEN 3 THEN sample_id - 3 ELSE sample_id - 1 END AS survivor, CASE WHEN sample_id % 4 = 1 THEN sample_id END AS candidate_id FROM fx_sample WHERE sample_id % 10 IN (1, 2, 3)"
VIEWS["fx_merge"] = MERGED
VIEWS["fx_person"] = f"""SELECT sample_id, 'A' || {s('sample_id')} AS accession, CASE WHEN sample_id % 3 = 0 THEN 'alias' || {s('sample_id')} END AS alias, call_text, CASE WHEN sample_id % 7 = 0 THEN TRUE WHEN sample_id % 7 = 1 THEN FALSE END AS is_public FROM fx_sample"""
VIEWS["fx_membership"] = "SELECT DISTINCT o_custkey AS sample_id, o_orderstatus AS status, CASE o_custkey % 10 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS was FROM orders"
VIEWS["fx_profile"] = "SELECT sample_id, balance FROM fx_sample WHERE sample_id % 20 <> 10"
INTO = "CASE WHEN {0} % 10 IN (1, 2, 3) THEN {0} - {0} % 10 ELSE {0} END"
PLACE = "CASE {0} % 10 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 2 THEN 3 ELSE 0 END"


def merged(fx):
    none = {"deleted": F.lit(False), "merged_ids": F.array().cast("array<bigint>"), "merged_accessions": F.array().cast("array<string>"), "merged_into": F.lit(None).cast("long"), "calls": F.array("call_text")}
    orders = fx.table("orders").select("o_orderkey", F.col("o_custkey").alias("sample_id"))
    pairs = fx.pair.select("a", "b", "segments")
    tables = {"order": orders, "membership": fx.membership.select("sample_id", "status"), "profile": fx.profile, "suggestion": pairs}
    references = {"order": ("sample_id",), "membership": ("sample_id",), "profile": ("sample_id",), "suggestion": ("a", "b")}
    plan = {"order": merges.Rule(("sample_id",)), "membership": merges.Rule(("sample_id",), merges.KEEP_SURVIVOR, ("status",)), "profile": merges.Rule(("sample_id",), merges.KEEP_SURVIVOR), "suggestion": merges.Rule(("a", "b"), merges.DROP)}
    candidates = fx.sample.select(F.col("sample_id").alias("candidate_id"), F.col("sample_id").alias("a"), (F.col("sample_id") + 5).alias("b"), F.when(F.col("sample_id") % 9 == 0, "CONFIRMED").otherwise("CANDIDATE").alias("status"))
    return merges.merge_samples(fx.person.withColumns(none), tables, references, plan, fx.merge, "curator", candidates)


@query(f"""WITH m AS (SELECT *, {INTO.format('sample_id')} AS home, {PLACE.format('sample_id')} AS place FROM fx_person), g AS (SELECT home, first(alias ORDER BY place) FILTER (alias IS NOT NULL AND place > 0) AS a, list(call_text ORDER BY place) FILTER (place > 0) AS calls, bool_or(coalesce(is_public, FALSE)) FILTER (place > 0) AS p, list(sample_id ORDER BY place) FILTER (place > 0) AS ids, count(*) FILTER (place > 0) AS n FROM m GROUP BY 1)
    SELECT sample_id, coalesce(alias, CASE WHEN place = 0 THEN a END) AS alias, array_to_string(list_concat([call_text], CASE WHEN place = 0 AND n > 0 THEN calls ELSE [] END), ';') AS calls, CASE WHEN place = 0 AND n > 0 THEN coalesce(is_public, FALSE) OR p ELSE is_public END AS is_public,
    place > 0 AS deleted, coalesce(array_to_string(CASE WHEN place = 0 THEN ids END, ','), '') AS merged_ids, CASE sample_id % 10 WHEN 1 THEN sample_id - 1 WHEN 2 THEN sample_id - 1 WHEN 3 THEN sample_id - 3 END AS merged_into FROM m JOIN g USING (home)""")
def merge_samples(fx):
    """The samples after all merges."""
    rows = merged(fx)["sample"]
    return rows.select("sample_id", "alias", F.array_join("calls", ";").alias("calls"), "is_public", "deleted", F.array_join(F.col("merged_ids").cast("array<string>"), ",").alias("merged_ids"), "merged_into")


@query(f"""SELECT 'order' AS kind, {INTO.format('o_custkey')} AS sample_id, o_orderkey::VARCHAR AS item FROM orders UNION ALL SELECT DISTINCT 'membership', {INTO.format('sample_id')}, status FROM fx_membership
    UNION ALL SELECT 'profile', home, balance::VARCHAR FROM (SELECT {INTO.format('sample_id')} AS home, balance, row_number() OVER (PARTITION BY {INTO.format('sample_id')} ORDER BY {PLACE.format('sample_id')}) AS n FROM fx_profile) WHERE n = 1
    UNION ALL SELECT 'suggestion', a, b::VARCHAR FROM fx_pair WHERE NOT ((a % 10 IN (1, 2, 3) AND a IN (SELECT sample_id FROM fx_sample)) OR (b % 10 IN (1, 2, 3) AND b IN (SELECT sample_id FROM fx_sample)))""")
def merge_samples_rows(fx):
    """The rows of four tables after all merges: moved, kept once, kept one a sample, dropped."""
    out = merged(fx)
    kinds = {"order": ("sample_id", "o_orderkey"), "membership": ("sample_id", "status"), "profile": ("sample_id", "balance"), "suggestion": ("a", "b")}
    rows = None
    for name, (key, item) in kinds.items():
        one = out[name].select(F.lit(name).alias("kind"), F.col(key).cast("long").alias("sample_id"), F.col(item).cast("string").alias("item"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(f"""WITH o AS (SELECT o_custkey AS m, count(*) AS r, 0 AS d FROM orders GROUP BY 1), k AS (SELECT sample_id AS m, was = min(was) OVER (PARTITION BY {INTO.format('sample_id')}, status) AS stays FROM fx_membership),
    p AS (SELECT sample_id AS m, {PLACE.format('sample_id')} = min({PLACE.format('sample_id')}) OVER (PARTITION BY {INTO.format('sample_id')}) AS stays FROM fx_profile),
    x AS (SELECT m, r, d FROM o UNION ALL SELECT m, stays::INT, 1 - stays::INT FROM k UNION ALL SELECT m, stays::INT, 1 - stays::INT FROM p UNION ALL SELECT a, 0, 1 FROM fx_pair UNION ALL SELECT b, 0, 1 FROM fx_pair)
    SELECT survivor, merged, candidate_id, CAST(coalesce(sum(r), 0) AS BIGINT) AS repointed, CAST(coalesce(sum(d), 0) AS BIGINT) AS dropped FROM fx_merge LEFT JOIN x ON m = merged GROUP BY 1, 2, 3""")
def merge_samples_audit(fx):
    """What each merge moved and dropped; a pair of two merged samples counts for both."""
    return merged(fx)["audit"].select("survivor", "merged", "candidate_id", "repointed", "dropped")


@query("""SELECT sample_id AS candidate_id, CASE WHEN sample_id % 10 IN (1, 2, 3) AND sample_id % 4 = 1 THEN 'MERGED' WHEN sample_id % 9 <> 0 AND (sample_id % 10 IN (1, 2, 3) OR ((sample_id + 5) % 10 IN (1, 2, 3) AND sample_id + 5 IN (SELECT sample_id FROM fx_sample))) THEN 'DISMISSED'
    WHEN sample_id % 9 = 0 THEN 'CONFIRMED' ELSE 'CANDIDATE' END AS status FROM fx_sample""")
def merge_samples_candidates(fx):
    """Candidates that merges settle or make stale."""
    return merged(fx)["candidate"].select("candidate_id", "status")


THIRD = s("CAST(floor(sample_id / 3) AS BIGINT)")
VIEWS["fx_individual"] = f"""SELECT sample_id, CASE WHEN sample_id % 23 <> 0 THEN CAST(donor_id AS BIGINT) END AS donor_id, CASE WHEN sample_id % 3 = 0 THEN 'HG' || {THIRD} END AS accession, CASE WHEN sample_id % 3 = 1 THEN 'hg' || {THIRD} WHEN sample_id % 3 = 2 THEN 'x' || {s('sample_id')} END AS alias,
    sample_id % 3 = 0 AS denovo, sample_id % 29 = 0 AS deleted FROM fx_sample"""
VIEWS["fx_donor"] = f"""SELECT DISTINCT donor_id, CASE WHEN donor_id % 2 = 0 THEN 'M' END AS sex, CASE WHEN donor_id % 3 = 0 THEN 'at ' || {s('donor_id')} END AS geocoord, CASE WHEN donor_id % 5 = 0 THEN 'bank' || {s('donor_id')} END AS biobank, 'D' || {s('donor_id')} AS donor_identifier FROM (SELECT CAST(donor_id AS BIGINT) AS donor_id FROM fx_sample)"""
GROUPS = """l AS (SELECT *, CASE WHEN denovo THEN accession ELSE alias END AS orig FROM fx_individual WHERE NOT deleted), k AS (SELECT lower(orig) AS key FROM l GROUP BY 1 HAVING bool_or(denovo) AND NOT bool_and(denovo)), m AS (SELECT l.*, lower(orig) AS key FROM l JOIN k ON lower(orig) = k.key),
    v AS (SELECT key, first(d.donor_id ORDER BY (sex IS NOT NULL)::INT + (geocoord IS NOT NULL)::INT + (biobank IS NOT NULL)::INT DESC, d.donor_id) AS survivor FROM m JOIN fx_donor d USING (donor_id) GROUP BY 1), g AS (SELECT m.*, survivor FROM m JOIN v USING (key))"""


def consolidated(fx):
    return merges.consolidate_donors(fx.individual, fx.donor)


@query(f"WITH {GROUPS} SELECT s.sample_id, coalesce(g.survivor, s.donor_id) AS donor_id FROM fx_individual s LEFT JOIN g USING (sample_id)")
def consolidate_donors(fx):
    """Every sample's donor after those of one individual became one."""
    return consolidated(fx)["sample"].select("sample_id", "donor_id")


@query(f"""WITH {GROUPS}, a AS (SELECT survivor, first(sex ORDER BY d.donor_id) FILTER (sex IS NOT NULL) AS sex, first(geocoord ORDER BY d.donor_id) FILTER (geocoord IS NOT NULL) AS geocoord, first(biobank ORDER BY d.donor_id) FILTER (biobank IS NOT NULL) AS biobank, max(orig) AS ident FROM g LEFT JOIN fx_donor d USING (donor_id) GROUP BY 1),
    n AS (SELECT coalesce(g.survivor, s.donor_id) AS donor_id FROM fx_individual s LEFT JOIN g USING (sample_id))
    SELECT d.donor_id, coalesce(d.sex, a.sex) AS sex, coalesce(d.geocoord, a.geocoord) AS geocoord, coalesce(d.biobank, a.biobank) AS biobank, coalesce(a.ident, d.donor_identifier) AS donor_identifier FROM fx_donor d LEFT JOIN a ON a.survivor = d.donor_id
    WHERE d.donor_id NOT IN (SELECT donor_id FROM g WHERE donor_id IS NOT NULL) OR d.donor_id IN (SELECT donor_id FROM n WHERE donor_id IS NOT NULL)""")
def consolidate_donors_donors(fx):
    """The donors after that: gaps filled, emptied ones gone."""
    return consolidated(fx)["donor"]


# ------------------------------------------------------------------ claims, blocks, names

VIEWS["fx_view_claim"] = f"""SELECT claim_id, subject, predicate, CASE WHEN claim_id % 6 = 0 THEN 'a|b' ELSE val END AS val, author, CASE WHEN scope = 0 THEN 'PUBLIC' ELSE 'PROJECT:' || {s('claim_id % 3')} END AS scope, supersedes, retracted FROM (SELECT claim_id, user_id % 400 AS subject, predicate, val, author, scope, supersedes, retracted FROM (SELECT *, author AS user_id FROM fx_claim))"""


@query("""WITH v AS (SELECT * FROM fx_view_claim WHERE NOT retracted), h AS (SELECT * FROM v WHERE claim_id NOT IN (SELECT supersedes FROM v WHERE supersedes IS NOT NULL)),
    w AS (SELECT DISTINCT subject, scope AS seen FROM fx_view_claim UNION SELECT DISTINCT subject, 'PUBLIC' FROM fx_view_claim),
    f AS (SELECT w.subject, w.seen AS scope, predicate, list(val ORDER BY claim_id) AS vals FROM w JOIN h ON h.subject = w.subject AND (h.scope = 'PUBLIC' OR h.scope = w.seen) GROUP BY 1, 2, 3)
    SELECT subject, scope, predicate, CASE WHEN predicate IN ('click', 'view') AND len(list_distinct(vals)) > 1 THEN 'DISPUTED' ELSE 'SETTLED' END AS state, array_to_string(vals, ';') AS vals FROM f""")
def claim_fold(fx):
    """Every view of every subject; two predicates have one value."""
    folded = reports.claim_fold(fx.view_claim.withColumn("created_at", F.col("claim_id")), ["click", "view"])
    return folded.select("subject", "scope", "predicate", "state", F.array_join(F.transform("view", lambda x: x["val"]), ";").alias("vals"))


@query("""WITH c AS (SELECT c_custkey AS id, c_mktsegment AS pop, CASE WHEN c_custkey % 8 <> 0 THEN c_custkey::DOUBLE END AS x, CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey::DOUBLE END AS y FROM customer), t AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM c WHERE x IS NOT NULL AND y IS NOT NULL)
    SELECT id AS sample_id, CASE WHEN id % 11 <> 0 THEN pop END AS dominant, CASE WHEN id % 11 <> 0 THEN pop ELSE '?' END || ':' || CASE WHEN x IS NULL OR y IS NULL THEN 'nopca' ELSE round((x - mx) / sx / 0.5)::BIGINT::VARCHAR || ':' || round((y - my) / sy / 0.5)::BIGINT::VARCHAR END AS block FROM c, t""")
def ancestry_blocks(fx):
    """Blocks of all customers, some without a coordinate or a dominant value."""
    k = F.col("c_custkey")
    return similarity.ancestry_blocks(fx.table("customer").select(k.alias("sample_id"), F.when(k % 11 != 0, F.col("c_mktsegment")).alias("dominant"), F.when(k % 8 != 0, k.cast("double")).alias("x"), F.when(k % 9 != 0, F.col("c_nationkey").cast("double")).alias("y")))


VIEWS["fx_private_node"] = f"""SELECT node_id, dna_type, CASE WHEN valid_until IS NOT NULL THEN 'gone' ELSE '' END || CASE node_id % 3 WHEN 0 THEN 'Q-Z' || {s('node_id')} || ':n' || {s('node_id % 4')} WHEN 1 THEN 'B' || {s('node_id')} || ':n1' ELSE 'Q-M' || {s('node_id * 3')} END AS name, valid_until FROM fx_node"""


@query(f"""WITH RECURSIVE i AS ({SITE}), p AS (SELECT DISTINCT n.node_id, n.dna_type, n.name AS was, CASE WHEN n.node_id % 3 = 0 THEN 'Q-' ELSE '' END || w.name AS name, {{'a': regexp_extract(w.name, '^[A-Z]+'), 'b': regexp_extract(w.name, '[0-9]+$')::BIGINT}} AS place
        FROM fx_private_node n JOIN fx_node_variant l ON l.node_id = n.node_id JOIN i ON i.id = l.variant_id JOIN i w ON w.position = i.position AND w.canon = i.canon
        WHERE n.valid_until IS NULL AND n.node_id % 3 < 2 AND w.branch_id IS NULL AND w.name IS NOT NULL AND w.name NOT LIKE '%:%' AND w.name NOT LIKE '% %' AND NOT EXISTS (SELECT 1 FROM fx_region r WHERE region_type IN ('heterochromatin', 'inverted_repeat') AND w.position BETWEEN r.start_pos AND r.end_pos)),
    x AS (SELECT node_id, dna_type || '/' || name AS name, place FROM p WHERE dna_type || '/' || name NOT IN (SELECT dna_type || '/' || name FROM fx_private_node WHERE valid_until IS NULL))""" + CLAIM)
def name_private_nodes(fx):
    """Placeholder nodes renamed to their clade's letter and the lowest free name of a catalog SNP on their sites."""
    out = curation.name_private_nodes(fx.private_node, fx.node_variant.select("node_id", "variant_id").distinct(), fx.variant, fx.region)
    return out.where("was IS NOT NULL").select("node_id", F.concat("dna_type", F.lit("/"), "name").alias("name"))


# ------------------------------------------------------------------ searches

VIEWS["fx_listed"] = f"""SELECT id, name, 'rs' || {s('id * 7')} AS alias, id % 5 <> 0 AND name IS NOT NULL AS representative FROM fx_variant"""
VIEWS["fx_term"] = f"""SELECT id AS query_id, CASE id % 5 WHEN 0 THEN ' ' || lower(name) || ' ' WHEN 1 THEN substr(name, 2, 3) WHEN 2 THEN substr(name, 1, 1) WHEN 3 THEN 'S' || {s('id')} ELSE lower(substr(name, 1, 2)) END AS term FROM fx_variant WHERE id % 20 < 2 AND name IS NOT NULL"""
VIEWS["fx_phrase"] = """SELECT p_partkey AS query_id, CASE p_partkey % 4 WHEN 0 THEN 'LICENSE' WHEN 1 THEN 'copyright ' WHEN 2 THEN 'src' || CAST(p_partkey % 20 AS VARCHAR(20)) ELSE 'zqx' END AS term FROM part WHERE p_partkey % 50 < 4"""


@query("""WITH t AS (SELECT query_id, lower(trim(term)) AS term FROM fx_term), h AS (SELECT t.query_id, v.id, v.name FROM t JOIN fx_listed v ON v.representative AND CASE WHEN length(term) >= 3 THEN contains(lower(v.name), term) OR contains(lower(v.alias), term) WHEN term <> '' THEN starts_with(lower(v.name), term) END)
    SELECT query_id, count(*) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY name, id)::INT AS rank, id, name FROM h QUALIFY rank BETWEEN 11 AND 20""")
def search_variants(fx):
    """The second ten hits of each of many searches over names and aliases."""
    return search.search_variants(fx.listed.withColumn("aliases", F.array("alias")), fx.term, 2, 10)


@query("""WITH t AS (SELECT query_id, lower(trim(term)) AS term FROM fx_phrase), d AS (SELECT id, lower(title) AS a, lower(coalesce(body, '')) AS b FROM fx_text) SELECT query_id, id FROM t JOIN d ON contains(a, term) OR contains(b, term)""")
def search_publications(fx):
    """Every hit of many searches over titles and whole texts."""
    return search.search_publications(fx.text.select("id", "title", "body"), fx.phrase)


# ------------------------------------------------------------------ what automation may write


@query("""WITH s AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'), n AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O')
    SELECT o_orderkey, o_custkey, 'STORED' AS origin FROM s UNION ALL SELECT o_orderkey, o_custkey, 'INGESTED' FROM n WHERE o_custkey NOT IN (SELECT o_custkey FROM s)""")
def ingest_if_absent(fx):
    """Libraries of samples that have none yet; both sides together are all orders."""
    o = fx.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return curation.ingest_if_absent(o.where("o_orderstatus <> 'O'").drop("o_orderstatus"), o.where("o_orderstatus = 'O'").drop("o_orderstatus"), "o_custkey")


STORED = "SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'DISMISSED' WHEN 2 THEN 'CANDIDATE' WHEN 3 THEN 'PENDING' END AS status, 0 AS score FROM orders"
COMPUTED = "SELECT l_orderkey + l_linenumber % 2 * 1000000 AS k, 'CANDIDATE' AS status, CAST(count(*) AS INT) AS score FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1"
VIEWS["fx_stored"], VIEWS["fx_computed"] = STORED, COMPUTED


@query("""SELECT coalesce(c.k, s.k) AS k, CASE WHEN s.status IN ('CONFIRMED', 'DISMISSED') OR c.k IS NULL THEN s.status ELSE c.status END AS status, CASE WHEN s.status IN ('CONFIRMED', 'DISMISSED') OR c.k IS NULL THEN s.score ELSE c.score END AS score FROM fx_stored s FULL JOIN fx_computed c ON s.k = c.k""")
def uncurated_only(fx):
    """Candidates computed anew; what a curator decided stays."""
    return curation.uncurated_only(fx.stored, fx.computed, ["k"], ["CANDIDATE", "PENDING"])


@query("SELECT c_custkey AS subject FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def unlinked_subjects(fx):
    """Customers that no event names."""
    return curation.unlinked_subjects(fx.table("customer").select(F.col("c_custkey").alias("subject")), fx.table("events").select(F.col("user_id").alias("subject")))


VIEWS["fx_work"] = f"""SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '10.1/' || {s('p_partkey')} END AS doi, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS title FROM part"""
VIEWS["fx_work_found"] = f"""SELECT p_partkey AS k, '10.1/' || {s('p_partkey - p_partkey % 6')} AS doi, 'found ' || p_name AS title FROM part"""


@query("""WITH b AS (SELECT k, o.doi AS own, coalesce(o.doi, n.doi) AS doi, coalesce(o.title, n.title) AS title FROM fx_work o FULL JOIN fx_work_found n USING (k))
    SELECT k, CASE WHEN own IS NOT NULL OR row_number() OVER (PARTITION BY doi ORDER BY own IS NULL, k) = 1 THEN doi END AS doi, title FROM b""")
def merge_gap_fill_unique(fx):
    """Gaps filled from what was found, but for a DOI that another work has."""
    return similarity.merge_gap_fill(fx.work, fx.work_found, ["k"], "doi")
