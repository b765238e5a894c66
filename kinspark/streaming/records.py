"""Typed tables of mirrored records: one stream of JSON commits, split by collection.

Each collection has a builder that reads its own fields from the record and nothing else, so a
personal field has no column to reach.  Floats may be numbers or numeric strings.  A record that
its builder can't use, and a line that is no event, goes to the rejects with the reason.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import test_profile_label
from ..operators.curation import normalize_external_ids

KEYS = ["did", "rkey"]
EVENT = "did string, time_us long, kind string, commit struct<operation:string,collection:string,rkey:string,cid:string>"
#: RFC 3339: an instant needs its offset.
INSTANT = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"


def at(path: str, record: str | Column = "record") -> Column:
    """What is at a path of a record; null where the path leads nowhere."""
    return F.try_variant_get(record, f"$.{path}", "variant")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def text(path: str, record: str | Column = "record") -> Column:
    """A string; anything else is null."""
    return F.when(_kind(at(path, record)) == "STRING", F.try_variant_get(record, f"$.{path}", "string"))


def number(path: str, record: str | Column = "record") -> Column:
    """A number, or a string that holds one."""
    return F.when(_kind(at(path, record)).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|STRING)"), F.try_variant_get(record, f"$.{path}", "double"))


def whole(path: str, of: str = "int") -> Column:
    """An integer that fits; fractions and strings are null."""
    return F.when(_kind(at(path)) == "BIGINT", F.try_variant_get("record", f"$.{path}", of))


def elements(path: str) -> Column:
    """An array's elements; anything else is null."""
    return F.when(_kind(at(path)).startswith("ARRAY"), F.try_variant_get("record", f"$.{path}", "array<variant>"))


def length(path: str) -> Column:
    return F.coalesce(F.size(elements(path)), F.lit(0))


def json(path: str, missing: str | None) -> Column:
    """The part of a record as JSON text, or what stands for a missing one; a null that is told stays null."""
    return F.when(at(path).isNull(), F.lit(missing)).otherwise(F.to_json(at(path)))


def instant(value: Column) -> Column:
    return F.when(value.rlike(INSTANT), F.try_to_timestamp(value))


def day(value: Column) -> Column:
    """The UTC day of an instant, or a plain date at the text's start."""
    utc = F.to_date(F.to_utc_timestamp(instant(value), F.current_timezone()))
    return F.coalesce(utc, F.to_date(F.try_to_timestamp(F.substring(value, 1, 10), F.lit("yyyy-MM-dd"))))


def without(key: str) -> Column:
    """The record as JSON text without a key."""
    return F.to_json(F.map_filter(F.try_variant_get("record", "$", "map<string,variant>"), lambda k, v: k != key))


def call(container: str, arm: str) -> Column:
    return text(f"{container}.{arm}.haplogroupName")


def _coverage() -> dict[str, Column]:
    share = {f"pct_{x}x": number(f"metrics.pct{x}x") for x in (10, 20, 30)}
    return {
        "biosample_ref": text("biosampleRef"), "sequence_run_ref": text("sequenceRunRef"), "reference_build": text("referenceBuild"), "aligner": text("aligner"),
        "mean_coverage": number("metrics.meanCoverage"), "median_coverage": number("metrics.medianCoverage"), **share, "metrics": json("metrics", "{}"),
    }


def _biosample() -> dict[str, Column]:
    ids = F.transform(elements("externalIds"), lambda e: F.struct(text("namespace", e).alias("namespace"), text("value", e).alias("value")))
    return {
        "sex": text("sex"), "y_haplogroup": call("haplogroups", "yDna"), "mt_haplogroup": call("haplogroups", "mtDna"), "center_name": text("centerName"),
        "population_breakdown_ref": text("populationBreakdownRef"), "str_profile_ref": text("strProfileRef"),
        "sequence_run_count": length("sequenceRunRefs"), "genotype_count": length("genotypeRefs"),
        "external_ids": F.coalesce(normalize_external_ids(ids), F.array().cast("array<struct<namespace:string,value:string>>")),
    }


def _sequence_run() -> dict[str, Column]:
    return {
        "biosample_ref": text("biosampleRef"), "platform_name": text("platformName"), "instrument_model": text("instrumentModel"), "instrument_id": text("instrumentId"),
        "sequencing_facility": text("sequencingFacility"), "test_type": text("testType"), "library_layout": text("libraryLayout"),
        "total_reads": whole("totalReads", "long"), "read_length": whole("readLength"), "total_bases": whole("totalBases", "long"), "read_type": text("readType"),
        "test_profile_label": test_profile_label(text("readType"), whole("readLength"), whole("totalBases", "long")), "mean_insert_size": number("meanInsertSize"),
    }


def _project() -> dict[str, Column]:
    return {"project_name": text("projectName"), "administrator_did": text("administrator"), "member_count": length("memberRefs")}


def _workspace() -> dict[str, Column]:
    return {"sample_count": length("sampleRefs"), "project_count": length("projectRefs")}


def _genotype() -> dict[str, Column]:
    markers = {f"{k}_markers_called": whole(f"{k}MarkersCalled") for k in ("y", "mt", "autosomal")}
    return {
        "biosample_ref": text("biosampleRef"), "provider": text("provider"), "test_type_code": text("testTypeCode"), "chip_version": text("chipVersion"),
        "total_markers_called": whole("totalMarkersCalled"), "total_markers_possible": whole("totalMarkersPossible"), "no_call_rate": number("noCallRate"), **markers,
        "het_rate": number("hetRate"), "build_version": text("buildVersion"), "y_haplogroup": call("derivedHaplogroups", "yDna"), "mt_haplogroup": call("derivedHaplogroups", "mtDna"),
        "population_breakdown_ref": text("populationBreakdownRef"), "record_json": without("files"),
    }


def _population_breakdown() -> dict[str, Column]:
    """Shares and coordinates as numbers, whether they came as numbers or as strings."""
    component = F.transform(elements("components"), lambda e: F.struct(F.coalesce(text("population", e), text("populationCode", e)).alias("population"), text("populationName", e).alias("population_name"), number("percentage", e).alias("percentage")))
    summary = F.transform(elements("superPopulationSummary"), lambda e: F.struct(text("superPopulation", e).alias("super_population"), number("percentage", e).alias("percentage"), F.try_variant_get(e, "$.populations", "array<string>").alias("populations")))
    return {
        "biosample_ref": text("biosampleRef"), "analysis_method": text("analysisMethod"), "panel_type": text("panelType"), "reference_populations": text("referencePopulations"),
        "snps_analyzed": whole("snpsAnalyzed"), "snps_with_genotype": whole("snpsWithGenotype"), "snps_missing": whole("snpsMissing"), "confidence_level": number("confidenceLevel"),
        "components": F.coalesce(component, F.array().cast("array<struct<population:string,population_name:string,percentage:double>>")),
        "super_population_summary": F.coalesce(summary, F.array().cast("array<struct<super_population:string,percentage:double,populations:array<string>>>")),
        "pca_coordinates": F.transform(elements("pcaCoordinates"), lambda e: F.try_variant_get(e, "$", "double")),
    }


def _str_profile() -> dict[str, Column]:
    return {
        "biosample_ref": text("biosampleRef"), "sequence_run_ref": text("sequenceRunRef"), "source": text("source"), "imported_from": text("importedFrom"),
        "derivation_method": text("derivationMethod"), "total_markers": whole("totalMarkers"), "markers": json("markers", "[]"),
    }


def _instrument_observation() -> dict[str, Column]:
    return {
        "instrument_id": text("instrumentId"), "lab_name": text("labName"), "biosample_ref": text("biosampleRef"), "platform": text("platform"), "instrument_model": text("instrumentModel"),
        "flowcell_id": text("flowcellId"), "run_date": day(text("runDate")), "confidence": text("confidence"), "observed_at": instant(text("observedAt")),
    }


def _private_variant() -> dict[str, Column]:
    return {"biosample_ref": text("biosampleRef"), "sequence_run_ref": text("sequenceRunRef"), "dna_type": text("dnaType"), "terminal_haplogroup": text("terminalHaplogroup"), "variants": json("variants", "[]")}


def _reconciliation() -> dict[str, Column]:
    return {
        "specimen_donor_ref": text("specimenDonorRef"), "dna_type": text("dnaType"), "compatibility_level": text("status.compatibilityLevel"), "consensus_haplogroup": text("status.consensusHaplogroup"),
        "confidence": number("status.confidence"), "branch_compatibility_score": number("status.branchCompatibilityScore"), "snp_concordance": number("status.snpConcordance"),
        "run_count": whole("status.runCount"), "record_json": F.to_json("record"),
    }


def _device_key() -> dict[str, Column]:
    return {"public_key": text("publicKey")}


def _feed_post() -> dict[str, Column]:
    """Its time is the record's own createdAt; only without one that of meta."""
    return {
        "text": text("text"), "topic": text("topic"), "parent_uri": text("reply.parent.uri"), "root_uri": text("reply.root.uri"),
        "record_created_at": F.coalesce(instant(text("createdAt")), instant(text("meta.createdAt"))),
    }


#: A typed table for each kind of record.
BUILDERS = {
    "coverage": _coverage, "biosample": _biosample, "sequence_run": _sequence_run, "project": _project, "workspace": _workspace, "genotype": _genotype,
    "population_breakdown": _population_breakdown, "str_profile": _str_profile, "instrument_observation": _instrument_observation, "private_variant": _private_variant,
    "reconciliation": _reconciliation, "device_key": _device_key, "feed_post": _feed_post,
}

#: The collection of each kind where a caller names none.
COLLECTIONS = {
    "alignment": "coverage", "biosample": "biosample", "sequencerun": "sequence_run", "project": "project", "workspace": "workspace", "genotype": "genotype", "populationBreakdown": "population_breakdown",
    "strProfile": "str_profile", "instrumentObservation": "instrument_observation", "privateVariant": "private_variant", "haplogroupReconciliation": "reconciliation", "deviceKey": "device_key", "feed.post": "feed_post",
}


def sorted_out(lines: DataFrame, collections: Mapping[str, str] = COLLECTIONS) -> DataFrame:
    """Every line (JSON in column value; with an `arrival` number, if there is one) with its kind or the reason why it has none.

    kind is the typed table that takes it; reason is one of unparsable, not_a_commit,
    unknown_collection, no_key, no_record, no_public_key and no_text.  Null and empty lines are
    unparsable.  A delete needs no record.
    """
    arrival = F.col("arrival").cast("long") if "arrival" in lines.columns else F.lit(0).cast("long")
    event = F.try_parse_json("value")
    parsed = F.struct("value", arrival.alias("arrival"), F.from_json("value", EVENT).alias("e"), event.isNotNull().alias("whole"), F.try_variant_get(event, "$.commit.record", "variant").alias("record"))
    raw = lines.select(F.inline(F.array(parsed)))  # a generator: filters above it don't parse each line once more
    names = F.create_map(*[F.lit(x) for pair in collections.items() for x in pair])
    kind, delete = F.try_element_at(names, F.coalesce("e.commit.collection", F.lit(""))), F.col("e.commit.operation") == "delete"
    bare = ~F.coalesce(delete, F.lit(False)) & ~F.coalesce(_kind(F.col("record")).startswith("OBJECT"), F.lit(False))
    has_text = F.coalesce(text("text").rlike(r"(?U)\S"), F.lit(False))
    reason = (
        F.when(~F.col("whole") | F.col("e").isNull(), "unparsable")
        .when((F.coalesce("e.kind", F.lit("")) != "commit") | ~F.coalesce(F.col("e.commit.operation").isin("create", "update", "delete"), F.lit(False)), "not_a_commit")
        .when(kind.isNull(), "unknown_collection").when(F.col("e.did").isNull() | F.col("e.commit.rkey").isNull() | F.col("e.time_us").isNull(), "no_key").when(bare, "no_record")
        .when(~delete & (kind == "device_key") & text("publicKey").isNull(), "no_public_key").when(~delete & (kind == "feed_post") & ~has_text, "no_text")
    )
    rows = raw.withColumn("reason", reason).withColumn("kind", F.when(F.col("reason").isNull(), kind))
    return rows.select("kind", "reason", "value", "arrival", "e.did", "e.commit.rkey", "e.commit.collection", "e.commit.cid", "e.commit.operation", "e.time_us", "record")


def build(rows: DataFrame, kind: str) -> DataFrame:
    """One kind's typed rows of `sorted_out`: did, rkey, at_uri, cid, operation, time_us, arrival, record_created_at and the kind's own columns (null for deletes)."""
    uri = F.concat(F.lit("at://"), "did", F.lit("/"), "collection", F.lit("/"), "rkey")
    fields = {"record_created_at": instant(text("meta.createdAt"))} | BUILDERS[kind]()
    live = F.col("operation") != "delete"
    return rows.where(F.col("kind") == kind).select("did", "rkey", uri.alias("at_uri"), "cid", "operation", "time_us", "arrival", *[F.when(live, column).alias(name) for name, column in fields.items()])


def newest(rows: DataFrame, deleted: bool = False) -> DataFrame:
    """The newest typed row of each key, by time, then arrival; deletes only if asked for."""
    rest = [c for c in rows.columns if c not in KEYS]
    out = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), F.struct("time_us", "arrival", "at_uri")).alias("r")).select(*KEYS, "r.*")
    return out if deleted else out.where("operation <> 'delete'")


def external_identifiers(biosamples: DataFrame, public: tuple[str, ...] = ("PGP", "IGSR")) -> DataFrame:
    """(did, rkey, namespace, value, is_public) of the newest biosamples: a record's identifiers replace those of its former ones."""
    ids = biosamples.select("did", "rkey", F.explode("external_ids").alias("i")).select("did", "rkey", "i.*").distinct()
    return ids.withColumn("is_public", F.col("namespace").isin(*public))


def mirror_records(lines: DataFrame, path: str, checkpoint: str, collections: Mapping[str, str] = COLLECTIONS):
    """A stream of JSON lines into typed tables under `path`, one folder a kind, and `rejects`.

    A batch writes a folder of its own number in each table that it has rows for; a batch that is
    run again writes the same folders again, so nothing is counted twice.
    """

    def split(batch: DataFrame, number: int) -> None:
        # lines are dealt out evenly, whatever files they came in; texts are kept for rejects alone, and a kind's rows lie together, so that its builder reads no others
        rows = sorted_out(batch.repartition(batch.sparkSession.sparkContext.defaultParallelism), collections)
        rows = rows.withColumn("value", F.when(F.col("kind").isNull(), F.col("value"))).sortWithinPartitions("kind").persist()
        try:
            # a row for each kind and reason: which tables this batch touches
            for found in rows.select("kind").distinct().collect():
                kind = found["kind"]
                if kind is None:
                    rows.where("kind IS NULL").select("reason", "value", "arrival").write.mode("overwrite").parquet(f"{path}/rejects/batch={number}")
                else:
                    build(rows, kind).write.mode("overwrite").parquet(f"{path}/{kind}/batch={number}")
        finally:
            rows.unpersist()

    return lines.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).outputMode("append")


def typed_schema(spark: SparkSession, kind: str):
    """The schema of a kind's table, whether or not anything was written to it."""
    return build(sorted_out(spark.createDataFrame([], "value string")), kind).schema


def typed_rows(spark: SparkSession, path: str, kind: str, deleted: bool = False, columns: list[str] | None = None) -> DataFrame:
    """A kind's newest rows over all batches of a mirror; of other columns than keys only those named, which then are all that is read and shuffled."""
    rows = _batches(spark, f"{path}/{kind}", typed_schema(spark, kind))
    if columns is None:
        return newest(rows, deleted)
    needed = [*KEYS, *dict.fromkeys(["operation", "time_us", "arrival", "at_uri", *columns])]
    return newest(rows.select(*needed), deleted).select(*KEYS, *columns)


def rejected_rows(spark: SparkSession, path: str) -> DataFrame:
    """(reason, value, arrival) of every line that no table took."""
    return _batches(spark, f"{path}/rejects", "reason string, value string, arrival long")


def _batches(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of a table's batches; a table that no batch wrote to is empty."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("basePath", folder).parquet(folder)
    return found.drop("batch")
