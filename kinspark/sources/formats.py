"""Text formats to rows, and rows to text. Readers take a path; parsers take DataFrames of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Attribute values that say nothing, and attributes kept as evidence.
GFF_PLACEHOLDERS = ["", ".", "TBD", "not", "not listed", "none", "n/a", "NA"]
GFF_EVIDENCE = ["isogg_haplogroup", "ycc_haplogroup", "yfull_node", "ref", "primer_f", "primer_r", "comment", "mutation", "count_tested", "count_derived"]
# Namespaces whose ids may be shown.
PUBLIC_NAMESPACES = ["PGP", "IGSR", "1000G", "ENA", "SRA", "BIOSAMPLE", "HGDP", "SGDP"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def scan_gff_snps(rows: DataFrame) -> DataFrame:
    """(name, contig, position, anc, der, evidence) of GFF3 lines in column value; comments and nameless lines go."""
    part = F.split("value", "\t")
    pairs = F.transform(F.split(F.get(part, 8), ";"), lambda kv: F.struct(F.trim(F.substring_index(kv, "=", 1)).alias("k"), F.trim(F.substring(kv, F.instr(kv, F.lit("=")) + 1, F.length(kv))).alias("v"), kv.contains("=").alias("ok")))
    data = rows.where(~F.col("value").startswith("#") & (F.trim("value") != "") & (F.size(part) >= 9)).withColumns({"_p": F.filter(pairs, lambda x: x["ok"]), "_part": part})

    def first(keys: list[str], placeholders: bool) -> Column:
        ok = F.filter("_p", lambda x: x["k"].isin(keys) & (F.lit(placeholders) | ~x["v"].isin(GFF_PLACEHOLDERS)))
        return F.get(ok, 0)["v"]

    kept = F.filter("_p", lambda x: x["k"].isin(GFF_EVIDENCE) & ~x["v"].isin(GFF_PLACEHOLDERS))
    latest = F.aggregate(kept, F.create_map().cast("map<string,string>"), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, v: k != x["k"]), F.create_map(x["k"], x["v"])))
    out = data.select(
        first(["Name", "ID"], True).alias("name"), F.get("_part", 0).alias("contig"), F.get("_part", 3).try_cast("long").alias("position"),
        first(["allele_anc"], False).alias("anc"), first(["allele_der"], False).alias("der"), F.map_concat(F.create_map(F.lit("source"), F.lit("YBrowse")), latest).alias("evidence"))
    return out.where("name is not null and trim(name) <> '' and position is not null")


def scan_bed_regions(rows: DataFrame, contig: str = "chrY") -> DataFrame:
    """1-based inclusive regions of BED lines (columns value and layer: azf_dyz, amplicons, inverted, classes)."""
    part = F.split(F.rtrim("value"), "\t")
    label = F.get(part, 3)
    kind = (
        F.when(F.col("layer") == "azf_dyz", F.when(label.startswith("DYZ"), "heterochromatin").otherwise("azf"))
        .when(F.col("layer") == "amplicons", "ampliconic").when(F.col("layer") == "inverted", F.when(label.startswith("IR"), "inverted_repeat").otherwise("palindromic")).otherwise("sequence_class")
    )
    classes = (
        F.when(label == "X-DEG", "xdegen").when(label.isin("XTR", "XTR1", "XTR2"), "x_transposed").when(label == "AMPL", "ampliconic").when(label.isin("PAR1", "PAR2"), "par")
        .when(label.isin("SAT", "HET", "DYZ17", "DYZ19"), "heterochromatin").when(label == "CEN", "centromere").otherwise("other")
    )
    data = rows.where(~F.col("value").rlike("^(#|track|browser)") & (F.trim("value") != "")).where(F.get(part, 0) == contig)
    start = F.get(part, 1).try_cast("long") + 1
    return data.select(kind.alias("region_type"), F.concat_ws(":", label, F.get(part, 0), start.cast("string")).alias("name"), label.alias("label"), F.when(kind == "sequence_class", classes).alias("class"), F.get(part, 0).alias("contig"), start.alias("start_pos"), F.get(part, 2).try_cast("long").alias("end_pos"))


def scan_callable_bed(rows: DataFrame) -> DataFrame:
    """(k, s, e) of per-sample BED lines (columns sample_id, value); a fourth column must say CALLABLE."""
    part = F.split("value", "\t")
    return rows.where((F.size(part) < 4) | (F.get(part, 3) == "CALLABLE")).select(F.col("sample_id").alias("k"), F.get(part, 1).try_cast("long").alias("s"), F.get(part, 2).try_cast("long").alias("e")).where("s is not null and e > s")


def parse_str_token(raw: Column) -> Column:
    """struct(kind, repeats, copies, raw) of a marker value; null when missing."""
    text = F.trim(F.regexp_replace(F.trim(raw), '^"+|"+$', ""))
    numbers = F.filter(F.transform(F.split(text, "-"), lambda p: F.trim(p)), lambda p: p != "")
    ints = F.transform(numbers, lambda p: p.try_cast("int"))
    whole = F.forall(ints, lambda x: x.isNotNull()) & (F.size(ints) > 0)
    kind = F.when(whole & (F.size(ints) == 1), "simple").when(whole, "multiCopy").otherwise("complex")
    return F.when(text.isNull() | text.isin("", "-"), None).otherwise(F.struct(kind.alias("kind"), F.when(kind == "simple", F.get(ints, 0)).alias("repeats"), F.when(kind == "multiCopy", ints).alias("copies"), F.when(kind == "complex", text).alias("raw")))


def scan_wide_str(files: DataFrame) -> DataFrame:
    """(kit, marker, kind, repeats, copies, raw) of wide exports (columns kit, content), and the reason of those skipped.

    Skipped files give one row with their reason: Html, Empty, LongFormat or AllMissing.
    """
    clean = lambda x: F.trim(F.regexp_replace(F.trim(x), '^"+|"+$', ""))
    rows = F.filter(F.split("content", "\r?\n"), lambda x: F.trim(x) != "")
    data = files.withColumn("_l", rows)
    header, values = F.transform(F.split(F.get("_l", 0), ","), clean), F.transform(F.split(F.get("_l", 1), ","), clean)
    pairs = F.filter(F.arrays_zip(header.alias("m"), values.alias("v")), lambda x: (x["m"] != "") & x["m"].isNotNull() & x["v"].isNotNull() & ~x["v"].isin("", "-"))
    reason = (
        F.when(F.lower("content").rlike("<!doctype|<html"), "Html").when(F.size("_l") < 2, "Empty").when(F.get("_l", 0).contains(";") & ~F.get("_l", 0).contains(","), "LongFormat").when(F.size(pairs) == 0, "AllMissing")
    )
    out = data.withColumn("skipped", reason).withColumn("_x", F.explode_outer(F.when(F.col("skipped").isNull(), pairs)))
    return out.withColumn("_t", parse_str_token(F.col("_x.v"))).select("kit", "skipped", F.col("_x.m").alias("marker"), "_t.kind", "_t.repeats", "_t.copies", "_t.raw")


def scan_manifest_identifiers(rows: DataFrame) -> DataFrame:
    """(subject, namespace, value, is_public) of manifest rows with comma lists `lab` and `kit`."""
    split = lambda c: F.filter(F.transform(F.split(F.upper(F.coalesce(c, F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x != "")
    kit = F.col("value")
    guess = F.when(kit.startswith("GF"), "FGC").when(kit.rlike("^[A-Z].*[0-9]"), "FTDNA").when(kit.rlike("^[0-9]{12,}$"), "DANTE")
    data = rows.select("subject", split(F.col("lab")).alias("labs"), F.explode(split(F.col("kit"))).alias("value"))
    space = F.when(F.size("labs") == 1, F.get("labs", 0)).when(F.array_contains("labs", guess), guess).otherwise("VENDORKIT")
    return data.select("subject", space.alias("namespace"), "value", space.isin(PUBLIC_NAMESPACES).alias("is_public"))


def scan_run_report(rows: DataFrame) -> DataFrame:
    """(sample, run, file, format, md5, bytes) of run rows with parallel `;` lists; aligned files of a sample push out the others."""
    from pyspark.sql import Window

    from ..functions.scalars import fmt_file

    split = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), ";")
    data = rows.select("sample", "run", F.explode(F.arrays_zip(split("urls").alias("file"), split("md5s").alias("md5"), split("sizes").alias("bytes"))).alias("f")).where("f.file <> ''")
    files = data.select("sample", "run", "f.file", fmt_file(F.col("f.file")).alias("format"), "f.md5", F.col("f.bytes").try_cast("long").alias("bytes"))
    aligned = F.max(F.col("format").isin("CRAM", "BAM")).over(Window.partitionBy("sample"))
    return files.withColumn("_a", aligned).where((F.col("_a") & F.col("format").isin("CRAM", "BAM")) | (~F.col("_a") & (F.col("format") == "FASTQ"))).drop("_a")


def export_variants_csv(variants: DataFrame) -> DataFrame:
    """(name, builds, anc, der) of named variants, by name; builds sorted and joined by `;`."""
    return variants.where("name is not null").select("name", F.array_join(F.array_sort("builds"), ";").alias("builds"), "anc", "der").orderBy("name")


def export_variants_gff(variants: DataFrame) -> DataFrame:
    """GFF3 lines of named variants."""
    text = F.format_string("%s\tkinspark\tsnp\t%d\t%d\t.\t.\t.\tName=%s;allele_anc=%s;allele_der=%s", "contig", "position", "position", "name", "anc", "der")
    return variants.where("name is not null").select(text.alias("value"))


def unify_samples(standard: DataFrame, citizen: DataFrame, consented: DataFrame) -> DataFrame:
    """Three sample tables as one, with their source; missing columns are null."""
    named = [df.withColumn("source", F.lit(s)) for df, s in ((standard, "STANDARD"), (citizen, "CITIZEN"), (consented, "EXTERNAL"))]
    return named[0].unionByName(named[1], allowMissingColumns=True).unionByName(named[2], allowMissingColumns=True)


def topic_whitelist(candidates: DataFrame, filters: DataFrame) -> DataFrame:
    """Candidates as ON_TOPIC, OFF_TOPIC or NO_TOPIC against filters `primary_topic.id:A|B` (column filter)."""
    ids = filters.select(F.explode(F.split(F.regexp_extract("filter", r"primary_topic\.id:([^,]+)", 1), r"\|")).alias("topic")).where("topic <> ''").distinct().withColumn("on", F.lit(True))
    return candidates.join(ids, "topic", "left").withColumn("status", F.when(F.col("topic").isNull(), "NO_TOPIC").when(F.col("on"), "ON_TOPIC").otherwise("OFF_TOPIC")).drop("on")


WORK = "id string, doi string, title string, publication_date string, cited_by_count long, abstract_inverted_index map<string,array<long>>, primary_location struct<source:struct<display_name:string>>, open_access struct<oa_status:string>"


def scan_works(rows: DataFrame) -> DataFrame:
    """Candidates from JSON works in column value: bare ids, dates, the abstract rebuilt from its word positions; works without an id go."""
    w = rows.select(F.from_json("value", WORK).alias("w")).where("w.id is not null")
    places = F.flatten(F.transform(F.map_entries("w.abstract_inverted_index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("word")))))
    text = F.array_join(F.transform(F.array_sort(places), lambda x: x["word"]), " ")
    return w.select(
        F.substring_index("w.id", "/", -1).alias("work_id"), "w.doi", "w.title", F.to_date(F.try_to_timestamp("w.publication_date", F.lit("yyyy-MM-dd"))).alias("published"),
        "w.cited_by_count", F.col("w.primary_location.source.display_name").alias("journal"), F.when(text != "", text).alias("abstract"))


COMMIT = "did string, time_us long, kind string, commit struct<operation:string,collection:string,rkey:string,record:map<string,string>>"
OPERATIONS = ["create", "update", "delete"]


def scan_commit_stream(rows: DataFrame, collections: list[str] | None = None) -> DataFrame:
    """(did, collection, rkey, operation, time_us, record) of JSON commits in column value, of a batch or a stream; what is no commit, or not of the collections, goes."""
    e = rows.select(F.from_json("value", COMMIT).alias("e")).where((F.col("e.kind") == "commit") & F.col("e.commit.operation").isin(OPERATIONS) & F.col("e.did").isNotNull() & F.col("e.commit.rkey").isNotNull())
    out = e.select("e.did", "e.commit.collection", "e.commit.rkey", "e.commit.operation", "e.time_us", "e.commit.record")
    return out.where(F.col("collection").isin(collections)) if collections is not None else out.where("collection is not null")


NODES = "nodes array<struct<id:string,parent:string,label:string,support:double,definingVariants:array<struct<name:string,position:long,ancestral:string,derived:string>>,tips:array<string>,conflicts:array<string>>>"


def scan_tree_document(documents: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of tree documents (columns tree, value: JSON with nodes[]): node, edge, link, tip and conflict."""
    n = documents.select("tree", F.explode(F.from_json("value", NODES)["nodes"]).alias("n")).where("n.id is not null")
    return {
        "node": n.select("tree", "n.id", "n.label", "n.support"),
        "edge": n.where("n.parent is not null").select("tree", F.col("n.parent").alias("parent_id"), F.col("n.id").alias("child_id")),
        "link": n.select("tree", "n.id", F.explode("n.definingVariants").alias("v")).select("tree", "id", "v.*"),
        "tip": n.select("tree", "n.id", F.explode("n.tips").alias("tip")),
        "conflict": n.select("tree", "n.id", F.explode("n.conflicts").alias("conflict")),
    }
