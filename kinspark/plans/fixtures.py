"""Adapter views: the library's inputs, derived from the driver's tables.

Each adapter is one SQL text that Spark and DuckDB both read, so that a query and its oracle
start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_node": """SELECT p_partkey AS node_id, 'N' || CAST(p_partkey AS VARCHAR(20)) AS name, CASE WHEN p_partkey % 5 = 0 THEN 'MT_DNA' ELSE 'Y_DNA' END AS dna_type,
        CASE WHEN p_partkey % 97 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS valid_until, p_size AS support, p_partkey % 101 = 0 AS curated FROM part""",
    "fx_edge": """SELECT p_partkey AS child_id, CAST(floor(p_partkey / 3) AS BIGINT) AS parent_id, CAST(NULL AS TIMESTAMP) AS valid_until FROM part WHERE p_partkey >= 3""",
    "fx_sample": """SELECT c_custkey AS sample_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'CITIZEN' WHEN 'MACHINERY' THEN 'EXTERNAL' ELSE 'STANDARD' END AS source,
        c_custkey % 700 AS donor_id, CASE WHEN c_custkey % 11 = 0 THEN 'junk' WHEN c_custkey % 7 = 0 THEN 'R > N' || CAST(c_custkey % 2000 AS VARCHAR(20)) ELSE 'N' || CAST(c_custkey % 2000 AS VARCHAR(20)) END AS call_text,
        c_custkey % 2000 AS terminal, c_custkey % 40 AS mt, c_nationkey AS nation, c_acctbal AS balance FROM customer""",
    "fx_sample_variant": """SELECT DISTINCT o_custkey AS sample_id, l_partkey % 20 AS variant_id, o_custkey % 50 AS terminal FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "fx_variant": """SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 'chrY:' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS VARCHAR(20)) || 'A>G'
            ELSE CASE p_partkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'P' WHEN 2 THEN 'CTS' WHEN 3 THEN 'FGC' WHEN 4 THEN 'YFS' ELSE 'Q' END || CAST(p_partkey AS VARCHAR(20)) END AS name,
        CASE p_partkey % 4 WHEN 0 THEN 'chrY' WHEN 1 THEN 'Y' WHEN 2 THEN 'chrY_hs1' ELSE 'CHRY' END AS contig, CAST(floor(p_partkey / 3) AS BIGINT) AS position,
        CASE WHEN p_partkey % 3 = 0 THEN 'A' WHEN p_partkey % 3 = 1 THEN 'T' ELSE CASE p_partkey % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'T' WHEN 2 THEN 'TA' ELSE '3GC' END END AS anc,
        CASE WHEN p_partkey % 3 = 0 THEN 'G' WHEN p_partkey % 3 = 1 THEN 'C' ELSE CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'TC' WHEN 2 THEN 'TCA' ELSE 'AAAAAA' END END AS der,
        CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 50 END AS branch_id, CASE WHEN p_partkey % 19 = 0 THEN 'PENDING_REVIEW' ELSE 'UNNAMED' END AS naming_status FROM part""",
    "fx_node_variant": """SELECT DISTINCT l_partkey % 300 AS node_id, l_suppkey * 7 AS variant_id, l_suppkey % 3 <> 0 AS joint_confirmed, l_suppkey % 4 <> 0 AS monophyletic, l_suppkey % 5 = 0 AS reverse_polarity FROM lineitem""",
    "fx_region": """SELECT CASE s_suppkey % 4 WHEN 0 THEN 'heterochromatin' WHEN 1 THEN 'palindromic' WHEN 2 THEN 'azf' ELSE 'inverted_repeat' END AS region_type,
        'L' || CAST(s_suppkey AS VARCHAR(20)) AS label, s_suppkey * 7 AS start_pos, s_suppkey * 7 + s_nationkey AS end_pos FROM supplier""",
    "fx_interval": """SELECT l_suppkey AS k, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem""",
    "fx_chain": """SELECT s_suppkey AS block_id, s_suppkey * 20 AS t_start, s_suppkey * 20 + 15 AS t_end, s_suppkey * 23 + 1000 AS q_start, CASE WHEN s_nationkey % 3 = 0 THEN '-' ELSE '+' END AS strand FROM supplier""",
    "fx_commit": """SELECT user_id AS did, event_type AS collection, user_id % 7 AS rkey, event_id AS arrival, CASE WHEN event_id % 11 = 0 THEN 'delete' ELSE 'update' END AS operation,
        event_id - (event_id % 13) * 400 AS time_us, value FROM events""",
    "fx_coverage": """SELECT l_orderkey AS run_id, CASE l_orderkey % 3 WHEN 0 THEN 'GRCh38' WHEN 1 THEN 'hs1' ELSE 'GRCh37' END AS build, CASE l_suppkey % 4 WHEN 0 THEN NULL ELSE 'LAB' || CAST(l_suppkey % 4 AS VARCHAR(20)) END AS lab,
        'F' || CAST(l_suppkey % 3 AS VARCHAR(20)) AS facility, CASE l_partkey % 3 WHEN 0 THEN 'WGS' WHEN 1 THEN 'BIG_Y' ELSE 'HIFI' END AS test_type,
        CASE l_linenumber WHEN 1 THEN 'chr1' WHEN 2 THEN '1' WHEN 3 THEN 'Y' WHEN 4 THEN 'chrY' WHEN 5 THEN 'MT' WHEN 6 THEN 'chrX_hs1' ELSE 'chrUn_1' END AS contig,
        l_quantity AS depth, CAST(l_partkey * 1000 AS DOUBLE) AS callable, CAST(l_suppkey AS DOUBLE) AS poor_mq, CAST(l_partkey * 3 AS DOUBLE) AS length, CAST(l_suppkey * 2 AS DOUBLE) AS ref_n, l_discount AS pct_30x, l_tax AS pct_10x, l_tax / 2 AS pct_20x, CASE l_partkey % 4 WHEN 0 THEN 30 WHEN 1 THEN 15 END AS expected_depth FROM lineitem""",
    "fx_instrument": """SELECT user_id % 20 AS instrument, CASE WHEN event_id % 17 = 0 THEN 'Self' WHEN user_id % 20 < 10 THEN 'LabA' ELSE 'Lab' || CAST(CAST(floor(user_id / 20) AS BIGINT) % 3 AS VARCHAR(20)) END AS lab,
        user_id AS citizen, CASE event_id % 3 WHEN 0 THEN 'KNOWN' WHEN 1 THEN 'INFERRED' ELSE 'GUESSED' END AS confidence, ts AS observed_at FROM events""",
    "fx_str": """SELECT o_custkey AS sample_id, l_linenumber AS marker, CAST(min(l_quantity) AS INT) AS repeats, o_custkey % 50 AS node_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_linenumber""",
    "fx_share": """SELECT o_custkey AS sample_id, p_type AS population, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, p_type""",
    "fx_claim": """SELECT event_id AS claim_id, user_id % 50 AS subject, event_type AS predicate, CAST(CAST(floor(value) AS BIGINT) % 4 AS VARCHAR(20)) AS val, user_id AS author, user_id % 3 AS scope,
        CASE WHEN event_id % 9 = 0 THEN event_id - 9 END AS supersedes, event_id % 8 = 0 AS retracted FROM events""",
    "fx_vote": """SELECT event_id AS vote_id, user_id % 60 AS post_id, user_id AS voter, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS vote, user_id % 60 + 1 AS author FROM events""",
    "fx_anchor": """SELECT o_custkey % 2000 AS node_id, CAST(1950 - CAST(floor(o_totalprice) AS BIGINT) % 3000 AS DOUBLE) AS ybp_raw, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 90 AS DOUBLE) END AS sigma FROM orders""",
    "fx_pair": """SELECT least(o_custkey, l_suppkey) AS a, greatest(o_custkey, l_suppkey) AS b, sum(l_quantity) AS cm, count(*) AS segments FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey <> l_suppkey GROUP BY 1, 2""",
    "fx_text": """SELECT doc_id AS id, source AS title, text AS body, n_chars, lang FROM documents""",
}

def _needs(sql: str) -> list[str]:
    """Views that a text names, and before each those that it names itself."""
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            found += [*_needs(VIEWS[name]), name]
    return list(dict.fromkeys(found))


def oracle(sql: str) -> str:
    """DuckDB SQL over adapter views: their definitions put before it."""
    with_ = ", ".join(f"{name} AS ({VIEWS[name]})" for name in _needs(sql))
    sql = sql.strip()
    if not with_:
        return sql
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {with_}, {sql[14:]}"
    return f"WITH {with_}, {sql[4:]}" if sql.upper().startswith("WITH") else f"WITH {with_} {sql}"


class Fixtures:
    """Adapter views and driver tables of one folder as DataFrames: fx.node, fx.variant, fx.table('orders')."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if f"fx_{name}" not in VIEWS:
            raise AttributeError(name)
        sql = oracle(VIEWS[f"fx_{name}"])
        tables = [t for t in ("part", "customer", "orders", "lineitem", "supplier", "events", "documents") if re.search(rf"(?:FROM|JOIN) {t}\b", sql)]
        text = sql.replace("{", "{{").replace("}", "}}")
        for t in tables:
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        # the texts name columns without a table, so the braces stand for DataFrames
        return self.spark.sql(text, **{t: self.table(t) for t in tables})
