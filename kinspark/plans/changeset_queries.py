"""Queries of a change set over the whole tree; its changes come from one SQL text that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changesets
from .fixtures import VIEWS

REGISTERED: dict = {}


def query(sql: str | None = None):
    def add(build):
        REGISTERED[build.__name__] = (build, sql)
        return build

    return add


AT = "2024-02-01 00:00:00"
LATER = 10_000_000
P = "CAST(p_partkey AS VARCHAR(20))"
#: By p % 11: 1 and 2 make a chain of two new nodes, 5 moves under the second, 8 moves twice, 10 adds a variant and goes later.
VIEWS["fx_change"] = f"""SELECT p_partkey AS change_id, CASE WHEN m IN (1, 2) THEN 'CREATE' WHEN m IN (0, 3) THEN 'UPDATE' WHEN m IN (4, 7) THEN 'DELETE' WHEN m IN (5, 8) THEN 'REPARENT' WHEN m = 9 THEN 'MERGE' ELSE 'VARIANT_EDIT' END AS change_type,
    CASE WHEN m NOT IN (1, 2) THEN p_partkey END AS node_id, CASE WHEN m = 7 THEN 'REJECTED' ELSE 'APPROVED' END AS status,
    CASE m WHEN 0 THEN '{{"lineage":"L"}}' WHEN 1 THEN '{{"name":"C' || {P} || '","placeholder":-' || {P} || ',"parent_haplogroup_id":' || {P} || ',"variant_ids":[' || {P} || ',' || {P} || ']}}'
        WHEN 2 THEN '{{"name":"C' || {P} || '","placeholder":-' || {P} || ',"parent_placeholder":-' || CAST(p_partkey - 1 AS VARCHAR(20)) || '}}' WHEN 3 THEN '{{"name":"U' || {P} || '","formed_ybp":' || {P} || '}}'
        WHEN 5 THEN '{{"new_parent_placeholder":-' || CAST(p_partkey - 3 AS VARCHAR(20)) || '}}' WHEN 6 THEN '{{"add":[1,2],"remove":[2,7]}}' WHEN 8 THEN '{{"new_parent_haplogroup_id":1}}' WHEN 10 THEN '{{"add":[3]}}' END AS new_values FROM (SELECT p_partkey, p_partkey % 11 AS m FROM part)
    UNION ALL SELECT p_partkey + {LATER}, CASE WHEN p_partkey % 11 = 8 THEN 'REPARENT' ELSE 'DELETE' END, p_partkey, 'APPROVED', CASE WHEN p_partkey % 11 = 8 THEN '{{"parent_haplogroup_id":2}}' END FROM part WHERE p_partkey % 11 IN (8, 10)"""


def applied(fx) -> dict:
    none = F.lit(None)
    began = F.lit("2020-01-01 00:00:00").cast("timestamp").alias("valid_from")
    nodes = fx.node.select("node_id", "dna_type", "name", none.cast("string").alias("lineage"), none.cast("string").alias("source"), none.cast("int").alias("formed_ybp"), none.cast("int").alias("tmrca_ybp"), F.lit(False).alias("is_backbone"), began, "valid_until")
    edges = fx.edge.select("child_id", "parent_id", none.cast("string").alias("source"), began, "valid_until")
    links = fx.node_variant.select("node_id", "variant_id", began, none.cast("timestamp").alias("valid_until")).distinct()
    return changesets.apply_change_set(nodes, edges, links, fx.change, AT, "Y_DNA")


NEW = "c AS (SELECT p_partkey AS p, p_partkey % 11 AS m, (SELECT max(node_id) FROM fx_node) + row_number() OVER (ORDER BY p_partkey) AS id FROM part WHERE p_partkey % 11 IN (1, 2))"
THEN, OLD = f"TIMESTAMP '{AT}'", "TIMESTAMP '2020-01-01 00:00:00'"


@query(f"""WITH {NEW} SELECT node_id, dna_type, CASE WHEN node_id % 11 = 3 THEN 'U' || node_id::VARCHAR ELSE name END AS name, CASE WHEN node_id % 11 = 0 THEN 'L' END AS lineage, CASE WHEN node_id % 11 = 3 THEN node_id END AS formed_ybp,
    {OLD} AS valid_from, CASE WHEN node_id % 11 IN (4, 10) THEN coalesce(valid_until, {THEN}) ELSE valid_until END AS valid_until FROM fx_node
    UNION ALL SELECT id, 'Y_DNA', 'C' || p::VARCHAR, NULL, NULL, {THEN}, NULL FROM c""")
def change_set_apply(fx):
    """The nodes after a change set."""
    return applied(fx)["node"].select("node_id", "dna_type", "name", "lineage", "formed_ybp", "valid_from", "valid_until")


@query(f"""WITH {NEW} SELECT child_id, parent_id, {OLD} AS valid_from, CASE WHEN child_id % 11 IN (4, 5, 8, 10) OR parent_id % 11 IN (4, 10) THEN {THEN} END AS valid_until FROM fx_edge
    UNION ALL SELECT id, p, {THEN}, NULL FROM c WHERE m = 1 UNION ALL SELECT c.id, d.id, {THEN}, NULL FROM c JOIN c d ON d.p = c.p - 1 WHERE c.m = 2
    UNION ALL SELECT p_partkey, c.id, {THEN}, NULL FROM part JOIN c ON c.p = p_partkey - 3 WHERE p_partkey % 11 = 5
    UNION ALL SELECT p_partkey, n, {THEN}, CASE WHEN n = 1 THEN {THEN} END FROM part, (SELECT unnest([1, 2]) AS n) WHERE p_partkey % 11 = 8""")
def change_set_apply_edges(fx):
    """The edges' history after a change set."""
    return applied(fx)["edge"].select("child_id", "parent_id", "valid_from", "valid_until")


@query(f"""WITH {NEW}, b AS (SELECT DISTINCT node_id, variant_id FROM fx_node_variant), a AS (SELECT p_partkey AS node_id, v AS variant_id FROM part, (SELECT unnest([1, 2, 3]) AS v) WHERE (p_partkey % 11 = 6 AND v < 3) OR (p_partkey % 11 = 10 AND v = 3))
    SELECT node_id, variant_id, {OLD} AS valid_from, CASE WHEN (node_id % 11 IN (4, 10) AND node_id IN (SELECT p_partkey FROM part)) OR (node_id % 11 = 6 AND variant_id IN (2, 7) AND node_id IN (SELECT p_partkey FROM part)) THEN {THEN} END AS valid_until FROM b
    UNION ALL SELECT node_id, variant_id, {THEN}, CASE WHEN variant_id <> 1 THEN {THEN} END FROM a ANTI JOIN b USING (node_id, variant_id)
    UNION ALL SELECT id, p, {THEN}, NULL FROM c WHERE m = 1""")
def change_set_apply_links(fx):
    """The links' history after a change set."""
    return applied(fx)["link"].select("node_id", "variant_id", "valid_from", "valid_until")


@query("""SELECT count(*) FILTER (change_type = 'CREATE') AS created, count(*) FILTER (change_type = 'UPDATE') AS updated, count(*) FILTER (change_type = 'DELETE') AS deleted, count(*) FILTER (change_type = 'REPARENT') AS reparented,
    count(*) FILTER (change_type = 'VARIANT_EDIT') AS variant_edits, count(*) FILTER (change_type = 'MERGE') AS skipped FROM fx_change WHERE status = 'APPROVED'""")
def change_set_result(fx):
    """How many changes of each type took effect."""
    return applied(fx)["result"]
