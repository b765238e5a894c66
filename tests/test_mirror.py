"""The mirrors: the stateful one tells each batch's changes without a Python call for each key; the typed one deals lines out evenly."""

import json

from kinspark.streaming import mirror, records

SCHEMA = "collection string, did long, rkey long, time_us long, arrival long, operation string, value double"


def told(spark, tmp_path, *batches):
    """What each batch told, the query started again before each."""
    out = []

    def keep(batch, number):
        out.append({(r["did"], r["rkey"]): (r["time_us"], r["arrival"], r["operation"], r["value"]) for r in batch.collect()})

    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = mirror.lww_state(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return [b for b in out if b]


def test_only_changes_are_told(spark, tmp_path):
    one = [("c", 1, 1, 10, 1, "update", 1.0), ("c", 1, 1, 30, 2, "update", 3.0), ("c", 2, 1, 10, 3, "delete", None), ("c", 3, 1, 5, 4, "update", float("nan"))]
    two = [("c", 1, 1, 20, 5, "update", 2.0), ("c", 2, 1, 10, 6, "update", 4.0), ("c", 3, 1, 4, 9, "delete", 0.0)]
    three = [("c", 2, 1, 10, 6, "delete", 0.5), ("c", 1, 1, 30, 1, "update", 9.0), ("c", 4, 1, 1, 1, "update", None)]
    first, second, third = told(spark, tmp_path, one, two, three)
    assert first.pop((3, 1))[:3] == (5, 4, "update")
    assert first == {(1, 1): (30, 2, "update", 3.0), (2, 1): (10, 3, "delete", None)}
    assert second == {(2, 1): (10, 6, "update", 4.0)}
    assert third == {(2, 1): (10, 6, "delete", 0.5), (4, 1): (1, 1, "update", None)}


def test_no_python_for_each_key(spark, tmp_path):
    """Calls for each key made the time grow with the keys (F34)."""
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = mirror.lww_state(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    assert "Python" not in stream._jdf.queryExecution().analyzed().toString() and "Pandas" not in stream._jdf.queryExecution().analyzed().toString()


def test_lines_of_one_file_go_to_many_tasks(spark, tmp_path):
    """One long file was one task for every table (F35); only the columns asked for are read again."""
    (tmp_path / "in").mkdir()
    made = [json.dumps({"did": f"d{k % 50}", "time_us": k, "kind": "commit", "commit": {"operation": "update", "collection": "project", "rkey": "r", "record": {"projectName": f"P{k}"}}}) for k in range(400)]
    (tmp_path / "in" / "0.json").write_text("\n".join([*made, "no json"]))
    records.mirror_records(spark.readStream.text(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), {"project": "project"}).trigger(availableNow=True).start().awaitTermination()
    assert len(list((tmp_path / "out" / "project" / "batch=0").glob("*.parquet"))) > 1
    rows = records.typed_rows(spark, str(tmp_path / "out"), "project", columns=["project_name"])
    assert rows.columns == ["did", "rkey", "project_name"] and {r["project_name"] for r in rows.collect()} == {f"P{k}" for k in range(350, 400)}
    assert [tuple(r) for r in records.rejected_rows(spark, str(tmp_path / "out")).collect()] == [("unparsable", "no json", 0)]
