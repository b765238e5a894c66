"""The typed record mirror: builders on single records, and streams of several batches."""

import json

import pytest

from kinspark.streaming import records


def line(collection, record, did="did:a", rkey="r", time_us=10, operation="create", **more):
    commit = {"operation": operation, "collection": collection, "rkey": rkey, "cid": "c"} | ({} if record is None else {"record": record})
    return json.dumps({"did": did, "time_us": time_us, "kind": "commit", "commit": commit} | more)


def built(spark, kind, *lines):
    return records.build(records.sorted_out(spark.createDataFrame([(x,) for x in lines], "value string")), kind).collect()


def test_coverage(spark):
    (row,) = built(spark, "coverage", line("alignment", {"biosampleRef": "at://x/1", "referenceBuild": "GRCh38", "aligner": 5, "metrics": {"meanCoverage": "31.5", "pct30x": 88.0, "pct10x": "many", "contigs": [1]}, "meta": {"createdAt": "2026-01-01T00:00:00Z"}}))
    assert (row["biosample_ref"], row["reference_build"], row["aligner"], row["mean_coverage"], row["pct_30x"], row["pct_10x"]) == ("at://x/1", "GRCh38", None, 31.5, 88.0, None)
    assert json.loads(row["metrics"])["contigs"] == [1] and row["at_uri"] == "at://did:a/alignment/r" and str(row["record_created_at"]) == "2026-01-01 00:00:00"


def test_biosample_never_reads_personal_fields(spark):
    record = {"donorIdentifier": "SECRET", "sampleAccession": "SECRET", "description": "SECRET", "sex": "Male", "haplogroups": {"yDna": {"haplogroupName": "R1"}, "mtDna": {"haplogroupName": 5}}, "sequenceRunRefs": ["a", "b"],
              "externalIds": [{"namespace": "pgp", "value": "huF9"}, {"namespace": "LAB", "value": " b51 "}, {"namespace": "X", "value": ""}, {"namespace": "", "value": "x"}, {"value": "y"}]}
    (row,) = built(spark, "biosample", line("biosample", record))
    assert (row["sex"], row["y_haplogroup"], row["mt_haplogroup"], row["sequence_run_count"], row["genotype_count"]) == ("Male", "R1", None, 2, 0)
    assert [tuple(x) for x in row["external_ids"]] == [("PGP", "HUF9"), ("LAB", "B51")] and "SECRET" not in str(row)
    ids = records.external_identifiers(records.build(records.sorted_out(spark.createDataFrame([(line("biosample", record),)], "value string")), "biosample")).collect()
    assert {(r["value"], r["is_public"]) for r in ids} == {("HUF9", True), ("B51", False)}


@pytest.mark.parametrize("record, label", [({"readType": "SHORT", "readLength": 150, "totalBases": 43_600_000_000}, "WGS150 45Gbases"), ({"readType": "HIFI", "totalBases": 90_000_000_000}, "HiFi 90Gbases"), ({"testType": "ARRAY"}, None)])
def test_sequence_run_label(spark, record, label):
    (row,) = built(spark, "sequence_run", line("sequencerun", record))
    assert row["test_profile_label"] == label and row["total_bases"] == record.get("totalBases")


def test_genotype_drops_files(spark):
    (row,) = built(spark, "genotype", line("genotype", {"provider": "lab", "noCallRate": 0.02, "totalMarkersCalled": 600000, "files": [{"location": "/Users/x"}]}))
    assert json.loads(row["record_json"]) == {"provider": "lab", "noCallRate": 0.02, "totalMarkersCalled": 600000} and row["total_markers_called"] == 600000


def test_population_breakdown_decodes_strings(spark):
    record = {"confidenceLevel": "0.97", "snpsAnalyzed": 600000, "components": [{"population": "Steppe", "percentage": "49"}, {"populationCode": "EEF", "populationName": "Farmer", "percentage": 31}],
              "superPopulationSummary": [{"superPopulation": "EUR", "percentage": "100", "populations": ["Steppe"]}], "pcaCoordinates": ["0.012", -0.044]}
    (row,) = built(spark, "population_breakdown", line("populationBreakdown", record))
    assert row["confidence_level"] == 0.97 and [tuple(c) for c in row["components"]] == [("Steppe", None, 49.0), ("EEF", "Farmer", 31.0)]
    assert row["pca_coordinates"] == [0.012, -0.044] and row["super_population_summary"][0]["percentage"] == 100.0
    (bare,) = built(spark, "population_breakdown", line("populationBreakdown", {"components": "none"}))
    assert bare["components"] == [] and bare["pca_coordinates"] is None


def test_dates(spark):
    for told, day in [("2025-11-02T00:30:00+01:00", "2025-11-01"), ("2025-11-02", "2025-11-02"), ("2025-11-02 some time", "2025-11-02"), ("soon", "None")]:
        (row,) = built(spark, "instrument_observation", line("instrumentObservation", {"runDate": told, "observedAt": told}))
        assert str(row["run_date"]) == day and (row["observed_at"] is not None) == ("T" in told)


def test_feed_post_takes_its_own_time(spark):
    record = {"text": "hi", "createdAt": "2026-06-19T12:00:00Z", "meta": {"createdAt": "2020-01-01T00:00:00Z"}, "reply": {"root": {"uri": "at://r"}, "parent": {"uri": "at://p"}}}
    (row,) = built(spark, "feed_post", line("feed.post", record))
    assert (row["text"], row["root_uri"], row["parent_uri"], str(row["record_created_at"])) == ("hi", "at://r", "at://p", "2026-06-19 12:00:00")


def test_rejects_have_reasons(spark):
    lines = ["no json", None, "", json.dumps({"kind": "identity", "did": "d"}), line("other", {}), line("project", None), line("project", [1]), line("deviceKey", {"publicKey": 5}), line("feed.post", {"text": " \t "}), line("project", {}, did=None), line("project", None, operation="delete"), line("project", {}, operation="move")]
    rows = records.sorted_out(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["reason"] for r in rows] == ["unparsable"] * 3 + ["not_a_commit", "unknown_collection", "no_record", "no_record", "no_public_key", "no_text", "no_key", None, "not_a_commit"]
    assert [r["kind"] for r in rows if r["reason"] is None] == ["project"]


def test_stream_of_batches(spark, tmp_path):
    """Three batches, a restart between them, an old update after a newer one, a delete, and a batch that runs again."""
    source, tables = tmp_path / "in", str(tmp_path / "tables")
    source.mkdir()

    def run(*lines):
        (source / f"{len(list(source.iterdir()))}.json").write_text("\n".join(lines))
        stream = spark.readStream.text(str(source))
        records.mirror_records(stream, tables, str(tmp_path / "checkpoint"), {"x.project": "project", "x.deviceKey": "device_key"}).trigger(availableNow=True).start().awaitTermination()

    run(line("x.project", {"projectName": "new"}, time_us=20), line("x.project", {"projectName": "two"}, rkey="s"), "junk")
    run(line("x.project", {"projectName": "old"}, time_us=5), line("x.deviceKey", {"publicKey": "k"}))
    run(line("x.project", None, rkey="s", time_us=30, operation="delete"), line("x.deviceKey", {}, time_us=40), line("project", {}))
    assert [r["project_name"] for r in records.typed_rows(spark, tables, "project").collect()] == ["new"]
    assert records.typed_rows(spark, tables, "project", deleted=True).count() == 2
    assert [r["public_key"] for r in records.typed_rows(spark, tables, "device_key").collect()] == ["k"]
    assert sorted(r["reason"] for r in records.rejected_rows(spark, tables).collect()) == ["no_public_key", "unknown_collection", "unparsable"]
    assert records.typed_rows(spark, tables, "genotype").collect() == []
    # the second batch once more, as after a crash before its commit
    (tmp_path / "checkpoint" / "commits" / "2").unlink()
    (tmp_path / "checkpoint" / "commits" / ".2.crc").unlink(missing_ok=True)
    run(line("x.project", {"projectName": "third"}, rkey="t", time_us=50))
    assert sorted(r["project_name"] for r in records.typed_rows(spark, tables, "project").collect()) == ["new", "third"]
    assert records.rejected_rows(spark, tables).count() == 3
