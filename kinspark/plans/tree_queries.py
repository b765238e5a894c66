"""Queries of the tree operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import numbering, placement, tree

REGISTERED: dict = {}


def query(sql: str | None = None):
    def add(build):
        REGISTERED[build.__name__] = (build, sql)
        return build

    return add


CLOSURE = "WITH RECURSIVE c AS (SELECT node_id AS ancestor_id, node_id AS descendant_id, 0 AS distance FROM fx_node UNION ALL SELECT c.ancestor_id, e.child_id, c.distance + 1 FROM c JOIN fx_edge e ON e.parent_id = c.descendant_id) "
TOKENS = scalars.call_tokens
CALLS = """(SELECT sample_id, source, call_text, CASE WHEN call_text LIKE 'R > %' THEN substr(call_text, 5) ELSE call_text END AS token FROM fx_sample)"""


def closure(fx):
    return tree.tree_closure(fx.edge, fx.node)


def placed(fx):
    """Placements by the nodes' names alone, where none stood before."""
    samples = fx.sample.withColumns({"deleted": F.lit(False), "denovo": F.lit(False)})
    return placement.place_samples(samples, fx.spark.createDataFrame([], "sample_id long, node_id long, call_text string, status string"), fx.node.select("node_id", "name"))


def numbers(fx):
    return numbering.tree_numbers(fx.edge, fx.node)


@query("""WITH RECURSIVE p AS (SELECT node_id, node_id AS root_id, [node_id] AS path FROM fx_node WHERE node_id NOT IN (SELECT child_id FROM fx_edge) UNION ALL SELECT e.child_id, p.root_id, list_append(p.path, e.child_id) FROM p JOIN fx_edge e ON e.parent_id = p.node_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY path) - 1 AS enter, unnest(path) AS above FROM p), s AS (SELECT above, count(*) AS size FROM n GROUP BY 1)
    SELECT DISTINCT node_id, root_id, enter, enter + size - 1 AS exit, len(path) - 1 AS depth FROM (SELECT DISTINCT node_id, root_id, path, dense_rank() OVER (PARTITION BY root_id ORDER BY path) - 1 AS enter FROM p) q JOIN s ON s.above = q.node_id""")
def tree_numbers(fx):
    """Enter and exit numbers of every node."""
    return numbers(fx)


@query(CLOSURE + "SELECT * FROM c")
def tree_closure(fx):
    return closure(fx)


@query("SELECT node_id FROM fx_node WHERE valid_until IS NULL")
def current_rows(fx):
    return tree.current_rows(fx.node).select("node_id")


@query("SELECT node_id FROM fx_node WHERE node_id NOT IN (SELECT child_id FROM fx_edge)")
def tree_roots(fx):
    return tree.tree_roots(fx.node, fx.edge).select("node_id")


@query("SELECT node_id FROM fx_node WHERE node_id NOT IN (SELECT parent_id FROM fx_edge)")
def tree_leaves(fx):
    return tree.tree_leaves(fx.node, fx.edge).select("node_id")


@query("SELECT parent_id AS node_id, count(*) AS children FROM fx_edge GROUP BY 1")
def children(fx):
    return tree.children(fx.edge)


@query(CLOSURE + "SELECT descendant_id AS node_id, max(distance) AS depth FROM c GROUP BY 1")
def node_depth(fx):
    return tree.node_depth(closure(fx))


@query(CLOSURE + "SELECT descendant_id AS node_id, string_agg(ancestor_id::VARCHAR, '>' ORDER BY distance DESC) AS path FROM c WHERE distance > 0 GROUP BY 1")
def ancestor_path(fx):
    return tree.ancestor_path(closure(fx))


@query(CLOSURE + "SELECT ancestor_id AS node_id, CAST(sum(n) AS BIGINT) AS n FROM c JOIN (SELECT terminal, count(*) AS n FROM fx_sample GROUP BY 1) s ON c.descendant_id = s.terminal GROUP BY 1")
def cumulative_counts(fx):
    direct = fx.sample.groupBy(F.col("terminal").alias("node_id")).agg(F.count("*").alias("n"))
    return numbering.cumulative_counts(numbers(fx), direct)


@query(CLOSURE + """SELECT descendant_id AS node_id, distance, distance = 3 AND descendant_id IN (SELECT parent_id FROM fx_edge) AS has_hidden,
    (SELECT count(DISTINCT variant_id) FROM fx_node_variant v WHERE v.node_id = descendant_id) AS variants, descendant_id IN (SELECT node_id FROM fx_node WHERE curated) AS is_backbone FROM c WHERE ancestor_id = 1 AND distance <= 3""")
def subtree_window(fx):
    return numbering.subtree_window(numbers(fx), 1, 3, fx.node_variant, fx.node.where("curated"))


@query(CLOSURE + "SELECT ancestor_id AS node_id, sample_id, distance FROM c JOIN fx_sample s ON c.descendant_id = s.terminal")
def samples_under(fx):
    return tree.samples_under(closure(fx), fx.sample)


@query(CLOSURE + "SELECT ancestor_id AS node_id, count(DISTINCT donor_id) AS testers FROM c JOIN fx_sample s ON c.descendant_id = s.terminal GROUP BY 1")
def subtree_tester_count(fx):
    return tree.subtree_tester_count(closure(fx), fx.sample)


@query(CLOSURE + "SELECT DISTINCT ancestor_id AS node_id FROM c WHERE descendant_id % 50 = 3 UNION SELECT node_id FROM fx_node WHERE curated")
def recompute_backbone(fx):
    return numbering.recompute_backbone(numbers(fx), fx.node.where("node_id % 50 = 3"), fx.node.where("curated"))


@query(f"SELECT DISTINCT call_text, array_to_string(CASE WHEN call_text LIKE 'R > %' THEN [token, 'R'] ELSE [] END, ',') AS tokens FROM {CALLS}")
def normalize_haplogroup_call(fx):
    return fx.sample.select("call_text", F.array_join(TOKENS(F.col("call_text")), ",").alias("tokens")).distinct()


@query(CLOSURE + f"SELECT s.sample_id, coalesce(string_agg(c.ancestor_id::VARCHAR, '>' ORDER BY c.distance DESC), '') AS steps FROM {CALLS} s LEFT JOIN fx_node n ON n.name = s.token LEFT JOIN c ON c.descendant_id = n.node_id GROUP BY 1")
def pathway(fx):
    return tree.pathway(fx.sample, fx.node, closure(fx))



@query()
def tree_revision(fx):
    return tree.tree_revision(fx.node, fx.edge, fx.node_variant)


@query(CLOSURE + "SELECT DISTINCT donor_id FROM fx_sample s JOIN c ON c.descendant_id = s.terminal AND c.ancestor_id = 5 WHERE donor_id % 4 <> 0")
def recruit_cohort(fx):
    return numbering.recruit_cohort(fx.sample, numbers(fx), 5, fx.sample.where("donor_id % 4 = 0").select("donor_id").distinct())




@query("SELECT node_id, count(DISTINCT variant_id) AS snps FROM fx_node_variant n JOIN fx_variant v ON n.variant_id = v.id WHERE length(anc) = 1 AND length(der) = 1 AND joint_confirmed AND (reverse_polarity OR monophyletic) AND NOT EXISTS (SELECT 1 FROM fx_region r WHERE region_type IN ('heterochromatin', 'inverted_repeat') AND v.position BETWEEN r.start_pos AND r.end_pos) GROUP BY 1")
def branch_snp_counts(fx):
    """Defining SNPs of a branch that count for ages: confident, outside recurrent regions."""
    from ..functions import dna
    from ..operators import intervals

    links = fx.node_variant.where(~scalars.low_confidence_call(F.col("joint_confirmed"), F.col("monophyletic"), F.col("reverse_polarity")))
    snps = intervals.recurrent_mask(fx.variant.where(dna.mutation_type(F.col("anc"), F.col("der")) == "SNP"), fx.region)
    return links.join(snps.select(F.col("id").alias("variant_id")), "variant_id").groupBy("node_id").agg(F.countDistinct("variant_id").alias("snps"))
