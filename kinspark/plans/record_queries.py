"""Queries of the typed record mirror: commits as JSON text, made from events by one SQL text that both engines read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.tree import shared_folder
from ..streaming import records
from .fixtures import VIEWS
from .stream_queries import finished

REGISTERED: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(build):
        REGISTERED[name or build.__name__] = (build, sql)
        return build

    return add


def s(expression: str) -> str:
    return f"CAST({expression} AS VARCHAR(20))"


K, U = s("event_id"), s("user_id")
#: Records by kind, their keys in order; every seventh of a kind lacks what its builder needs or holds other types.
RECORD = {
    "alignment": f"""'{{"aligner":"bwa","biosampleRef":"b' || {U} || '","metrics":{{"meanCoverage":"' || {K} || '.5","medianCoverage":' || {K} || ',"pct10x":' || CASE WHEN event_id % 2 = 0 THEN '"99.5"' ELSE 'true' END || '}},"referenceBuild":' || CASE WHEN event_id % 5 = 0 THEN '38' ELSE '"GRCh38"' END || '}}'""",
    "biosample": f"""'{{"donorIdentifier":"SECRET","externalIds":[{{"namespace":"pgp","value":" hu' || {K} || ' "}},{{"namespace":"","value":"x"}},{{"value":"y"}}],"haplogroups":{{"yDna":{{"haplogroupName":"R' || {U} || '"}}}},"sequenceRunRefs":["a","b"],"sex":"Male"}}'""",
    "sequencerun": f"""'{{"meanInsertSize":"35' || {s('event_id % 10')} || '.25","readLength":150,"readType":"' || CASE WHEN event_id % 2 = 0 THEN 'SHORT' ELSE 'HIFI' END || '","totalBases":' || CASE WHEN event_id % 5 = 0 THEN '"many"' ELSE {s('event_id % 13 * 10000000000')} END || ',"totalReads":3000000000}}'""",
    "project": f"""'{{"administrator":"did:' || {U} || '","memberRefs":' || CASE WHEN event_id % 5 = 0 THEN '"none"' ELSE '[1,2,3]' END || ',"projectName":"P' || {U} || '"}}'""",
    "workspace": """'{"sampleRefs":["a"]}'""",
    "genotype": f"""'{{"derivedHaplogroups":{{"mtDna":{{"haplogroupName":"H' || {U} || '"}}}},"files":[{{"location":"/home/x"}}],"noCallRate":0.02,"provider":"lab","totalMarkersCalled":' || CASE WHEN event_id % 5 = 0 THEN '1.5' ELSE {K} END || '}}'""",
    "populationBreakdown": f"""'{{"components":[{{"percentage":"49.5","population":"Steppe"}},{{"percentage":' || {s('event_id % 50')} || ',"populationCode":"EEF"}}],"confidenceLevel":"0.97","pcaCoordinates":["0.012",-0.5],"snpsAnalyzed":' || {K} || '}}'""",
    "strProfile": f"""'{{"markers":' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE '[{{"marker":"M' || {U} || '"}}]' END || ',"source":"WGS","totalMarkers":2}}'""",
    "instrumentObservation": f"""'{{"confidence":"KNOWN","instrumentId":"A' || {U} || '","observedAt":"' || CASE WHEN event_id % 5 = 0 THEN 'yesterday' ELSE '2026-01-15T12:00:00+02:00' END || '","runDate":"' || CASE WHEN event_id % 2 = 0 THEN '2025-11-02' ELSE '2025-11-02T00:30:00+01:00' END || '"}}'""",
    "privateVariant": f"""'{{"dnaType":"Y_DNA","terminalHaplogroup":"R' || {U} || '"' || CASE WHEN event_id % 5 = 0 THEN '' ELSE ',"variants":[{{"position":' || {K} || '}}]' END || '}}'""",
    "haplogroupReconciliation": f"""'{{"dnaType":"MT_DNA","status":{{"confidence":0.5,"consensusHaplogroup":"H' || {U} || '","runCount":' || {s('event_id % 5')} || '}}}}'""",
    "deviceKey": f"""'{{' || CASE WHEN event_id % 5 = 0 THEN '' ELSE '"publicKey":"k' || {K} || '"' END || '}}'""",
    "feed.post": f"""'{{"createdAt":"2026-06-19T12:00:0' || {s('event_id % 10')} || 'Z","reply":{{"root":{{"uri":"at://' || {U} || '"}}}},"text":"' || CASE WHEN event_id % 5 = 0 THEN '  ' ELSE 'hello ' || {U} END || '"}}'""",
}
KINDS = [*RECORD, "unwanted"]
#: (value, arrival): a line for each event; some are no JSON, some no commits, some deletes, some without a record.
VIEW = f"""SELECT event_id AS arrival, CASE WHEN event_id % 101 = 0 THEN 'no json' WHEN event_id % 103 = 0 THEN '{{"did":"d","kind":"identity","time_us":1}}' ELSE
    '{{"commit":{{"collection":"' || kind || '","operation":"' || CASE WHEN event_id % 11 = 0 THEN 'delete' ELSE 'update' END || '"' || CASE WHEN event_id % 11 = 0 OR event_id % 107 = 0 THEN '' ELSE ',"record":' || CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in RECORD.items())} ELSE '{{}}' END END
    || ',"rkey":"r' || {s('user_id % 7')} || '"}},"did":"d' || {U} || '","kind":"commit","time_us":' || {s('event_id - (event_id % 13) * 400')} || '}}' END AS value
    FROM (SELECT event_id, user_id, CASE CAST(floor(event_id / 3) AS BIGINT) % {len(KINDS)} {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))} END AS kind FROM events)"""
VIEWS["fx_record"] = VIEW

NEWEST = """WITH e AS (SELECT arrival, value AS raw, try_cast(value AS JSON) AS j FROM fx_record),
    c AS (SELECT arrival, raw, j, j->>'$.commit.collection' AS collection, j->>'$.commit.operation' AS op, j->>'$.did' AS did, j->>'$.commit.rkey' AS rkey, (j->>'$.time_us')::BIGINT AS time_us, j->'$.commit.record' AS r FROM e WHERE j->>'$.kind' = 'commit'),
    w AS (SELECT * FROM c WHERE collection = '{collection}' AND (op = 'delete' OR (r IS NOT NULL AND {usable}))),
    n AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY did, rkey ORDER BY time_us DESC, arrival DESC) = 1)
    SELECT did, rkey, time_us, {columns} FROM n WHERE op <> 'delete'"""


def t(path: str) -> str:
    return f"CASE WHEN json_type(r, '$.{path}') = 'VARCHAR' THEN json_extract_string(r, '$.{path}') END"


def n(path: str) -> str:
    return f"CASE WHEN json_type(r, '$.{path}') IN ('VARCHAR', 'DOUBLE', 'UBIGINT', 'BIGINT') THEN try_cast(json_extract_string(r, '$.{path}') AS DOUBLE) END"


def i(path: str, of: str = "INTEGER") -> str:
    return f"CASE WHEN json_type(r, '$.{path}') IN ('UBIGINT', 'BIGINT') THEN try_cast(json_extract_string(r, '$.{path}') AS {of}) END"


def a(path: str) -> str:
    return f"CASE WHEN json_type(r, '$.{path}') = 'ARRAY' THEN json_array_length(r, '$.{path}') ELSE 0 END::INTEGER"


def j(path: str, missing: str) -> str:
    return f"CASE WHEN json_exists(r, '$.{path}') THEN CAST(json_extract(r, '$.{path}') AS VARCHAR) ELSE '{missing}' END"


TIER = "[15, 30, 45, 60, 90, 120]"
BASES, READ = i("totalBases", "BIGINT"), t("readType")
LABEL = f"""CASE WHEN {BASES} IS NOT NULL THEN CASE WHEN {READ} = 'HIFI' THEN 'HiFi' WHEN {READ} = 'SHORT' THEN 'WGS' || ({i('readLength')})::VARCHAR END
    || ' ' || (SELECT arg_min(tier, {{d: abs({BASES} / 1e9 - tier), t: tier}}) FROM (SELECT unnest({TIER}) AS tier))::VARCHAR || 'Gbases' END"""
#: Of each typed table: its collection, the columns that are compared as SQL over the JSON text, and what a record needs.
TABLES = {
    "coverage": ("alignment", {"biosample_ref": t("biosampleRef"), "reference_build": t("referenceBuild"), "aligner": t("aligner"), "mean_coverage": n("metrics.meanCoverage"), "median_coverage": n("metrics.medianCoverage"), "pct_10x": n("metrics.pct10x"), "pct_30x": n("metrics.pct30x"), "metrics": j("metrics", "{}")}, "TRUE"),
    "biosample": ("biosample", {"sex": t("sex"), "y_haplogroup": t("haplogroups.yDna.haplogroupName"), "mt_haplogroup": t("haplogroups.mtDna.haplogroupName"), "center_name": t("centerName"), "sequence_run_count": a("sequenceRunRefs"), "genotype_count": a("genotypeRefs"), "external_ids": "'PGP:' || upper(trim(json_extract_string(r, '$.externalIds[0].value')))"}, "TRUE"),
    "sequence_run": ("sequencerun", {"total_reads": i("totalReads", "BIGINT"), "read_length": i("readLength"), "total_bases": BASES, "read_type": READ, "test_profile_label": LABEL, "mean_insert_size": n("meanInsertSize"), "platform_name": t("platformName")}, "TRUE"),
    "project": ("project", {"project_name": t("projectName"), "administrator_did": t("administrator"), "member_count": a("memberRefs")}, "TRUE"),
    "workspace": ("workspace", {"sample_count": a("sampleRefs"), "project_count": a("projectRefs")}, "TRUE"),
    "genotype": ("genotype", {"provider": t("provider"), "total_markers_called": i("totalMarkersCalled"), "no_call_rate": n("noCallRate"), "y_haplogroup": t("derivedHaplogroups.yDna.haplogroupName"), "mt_haplogroup": t("derivedHaplogroups.mtDna.haplogroupName"), "record_json": """CAST(json_merge_patch(r, '{"files":null}') AS VARCHAR)"""}, "TRUE"),
    "population_breakdown": ("populationBreakdown", {"snps_analyzed": i("snpsAnalyzed"), "confidence_level": n("confidenceLevel"), "components": "'Steppe:49.5;EEF:' || json_extract_string(r, '$.components[1].percentage')::DOUBLE::VARCHAR", "pca_coordinates": "json_extract_string(r, '$.pcaCoordinates[0]')::DOUBLE::VARCHAR || ';' || json_extract_string(r, '$.pcaCoordinates[1]')::DOUBLE::VARCHAR"}, "TRUE"),
    "str_profile": ("strProfile", {"source": t("source"), "total_markers": i("totalMarkers"), "markers": j("markers", "[]"), "imported_from": t("importedFrom")}, "TRUE"),
    "instrument_observation": ("instrumentObservation", {"instrument_id": t("instrumentId"), "confidence": t("confidence"), "run_date": "CASE WHEN json_extract_string(r, '$.runDate') LIKE '%T%' THEN DATE '2025-11-01' ELSE DATE '2025-11-02' END", "observed_at": "CASE WHEN json_extract_string(r, '$.observedAt') LIKE '2%' THEN TIMESTAMP '2026-01-15 10:00:00' END", "lab_name": t("labName")}, "TRUE"),
    "private_variant": ("privateVariant", {"dna_type": t("dnaType"), "terminal_haplogroup": t("terminalHaplogroup"), "variants": j("variants", "[]")}, "TRUE"),
    "reconciliation": ("haplogroupReconciliation", {"dna_type": t("dnaType"), "consensus_haplogroup": t("status.consensusHaplogroup"), "confidence": n("status.confidence"), "run_count": i("status.runCount"), "record_json": "CAST(r AS VARCHAR)"}, "TRUE"),
    "device_key": ("deviceKey", {"public_key": t("publicKey")}, "json_type(r, '$.publicKey') = 'VARCHAR'"),
    "feed_post": ("feed.post", {"text": t("text"), "root_uri": t("reply.root.uri"), "parent_uri": t("reply.parent.uri"), "record_created_at": "strptime(json_extract_string(r, '$.createdAt'), '%Y-%m-%dT%H:%M:%SZ')"}, "trim(json_extract_string(r, '$.text')) <> ''"),
}


def flat(df):
    """Arrays of structs as text, so that both engines' rows compare."""
    if "external_ids" in df.columns:
        df = df.withColumn("external_ids", F.array_join(F.transform("external_ids", lambda x: F.concat_ws(":", x["namespace"], x["value"])), ";"))
    if "components" in df.columns:
        df = df.withColumn("components", F.array_join(F.transform("components", lambda x: F.concat_ws(":", x["population"], x["percentage"].cast("string"))), ";")).withColumn("pca_coordinates", F.array_join(F.col("pca_coordinates").cast("array<string>"), ";"))
    return df


def _of_kind(kind: str, columns: list[str]):
    def run(fx):
        rows = records.sorted_out(fx.record)
        return flat(records.newest(records.build(rows, kind))).select("did", "rkey", "time_us", *columns)

    run.__doc__ = f"The newest {kind} records of all commits, as typed rows."
    return run


for _kind, (_collection, _columns, _usable) in TABLES.items():
    _sql = NEWEST.format(collection=_collection, usable=_usable, columns=", ".join(f"{v} AS {k}" for k, v in _columns.items()))
    query(_sql, f"build_{_kind}")(_of_kind(_kind, list(_columns)))


@query("""WITH e AS (SELECT value AS raw, try_cast(value AS JSON) AS j FROM fx_record), c AS (SELECT raw, j, j->>'$.kind' AS kind, j->>'$.commit.collection' AS collection, j->>'$.commit.operation' = 'delete' AS gone, j->'$.commit.record' AS r FROM e)
    SELECT reason, count(*) AS lines FROM (SELECT CASE WHEN j IS NULL THEN 'unparsable' WHEN kind <> 'commit' THEN 'not_a_commit' WHEN collection = 'unwanted' THEN 'unknown_collection' WHEN NOT gone AND r IS NULL THEN 'no_record'
        WHEN NOT gone AND collection = 'deviceKey' AND json_type(r, '$.publicKey') IS NULL THEN 'no_public_key' WHEN NOT gone AND collection = 'feed.post' AND trim(json_extract_string(r, '$.text')) = '' THEN 'no_text' END AS reason FROM c) WHERE reason IS NOT NULL GROUP BY 1""")
def record_rejects(fx):
    """How many lines no typed table took, by reason."""
    return records.sorted_out(fx.record).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("lines"))


@query(" UNION ALL ".join(f"SELECT '{kind}' AS kind, count(*) AS records, CAST(sum(time_us) AS BIGINT) AS times FROM ({NEWEST.format(collection=c, usable=u, columns='1')})" for kind, (c, _, u) in TABLES.items()))
def typed_mirror(fx):
    """Live records of each typed table after the whole stream went through `mirror_records`."""
    at = f"{shared_folder(fx.spark)}/typed-{uuid.uuid4().hex}"
    fx.record.write.parquet(f"{at}/lines")
    lines = fx.spark.readStream.schema("arrival long, value string").option("maxFilesPerTrigger", 4).parquet(f"{at}/lines")
    finished(records.mirror_records(lines, f"{at}/tables", f"{at}/checkpoint"))
    out = None
    for kind in TABLES:
        one = records.typed_rows(fx.spark, f"{at}/tables", kind, columns=["time_us"]).agg(F.lit(kind).alias("kind"), F.count("*").alias("records"), F.sum("time_us").alias("times"))
        out = one if out is None else out.unionByName(one)
    return out
