"""Published private variants: rows go to a given number of tasks before they are counted once."""

from kinspark.operators import branches


def test_rows_are_dealt_out_before_they_are_merged(spark):
    """They were merged in the few tasks that well compressed shuffles leave (F38)."""
    published = spark.createDataFrame([(1, "N1", "M1", "chrY", 5, "A", "G"), (1, "N2", None, "Y", 5, "A", "G"), (2, "N9", None, "chrY", 7, "C", "T")], "sample_id long, terminal string, name string, contig string, position long, anc string, der string")
    variants = spark.createDataFrame([(11, "M1", "chrY", 5, "A", "G")], "id long, name string, contig string, position long, anc string, der string")
    nodes = spark.createDataFrame([(21, "N1"), (20, "N2")], "node_id long, name string")
    existing = spark.createDataFrame([(2, "11", 20, "ACTIVE", "mirror"), (3, "11", 20, "INVALIDATED", "mirror")], "sample_id long, variant string, node_id long, status string, origin string")
    out = branches.materialize_private(published, variants, nodes, existing)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    rows = {(r["sample_id"], r["variant"]): (r["node_id"], r["status"]) for r in out.collect()}
    assert len(rows) == 3 and rows[1, "11"] == (20, "ACTIVE") and rows[3, "11"] == (20, "INVALIDATED")
    assert [v for k, v in rows.items() if k[0] == 2] == [(None, "ACTIVE")]
