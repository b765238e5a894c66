"""Work that grows with its input: splits by shares, levels that read what was made once, texts dealt out once."""

from kinspark.operators import curation, tree
from kinspark.plans import report_queries


def test_shares_tell_what_moves_of_each_variant_tell(spark):
    nodes = spark.createDataFrame([(1, "A", "Y", None), (2, "B", "Y", None)], "node_id long, name string, dna_type string, valid_until timestamp")
    splits = spark.createDataFrame([(k, 1 + k % 2, f"S{k // 2}" if k % 5 else "A") for k in range(12)], "split_id long, node_id long, name string")
    links = spark.createDataFrame([(n, v) for n in (1, 2) for v in range(10)] * 2, "node_id long, variant_id long").selectExpr("*", "variant_id % 3 AS share")
    moves = splits.join(links.select("node_id", "variant_id").distinct(), "node_id").where("variant_id % 3 = split_id % 3").select("split_id", "variant_id")
    one, two = tree.split_node(splits, moves, nodes, links)["link"], tree.split_node(splits, splits.selectExpr("split_id", "split_id % 3 AS share"), nodes, links, "share")["link"]
    assert sorted(one.collect()) == sorted(two.collect()) and two.count() == 20 and two.where("node_id > 2").count() > 0


def test_motifs_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def tell(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    motifs = spark.createDataFrame([(5, 1, 12), (4, 1, 13)], "node_id long, marker long, modal long").mapInPandas(tell, "node_id long, marker long, modal long")
    edges = spark.createDataFrame([(k + 1, k) for k in range(5)], "child_id long, parent_id long").selectExpr("*", "cast(null AS timestamp) AS valid_until")
    assert {r["node_id"] for r in curation.str_reconstruct(motifs, edges).collect()} == set(range(6))
    assert made.value == 2


def test_words_pass_no_shuffle(spark):
    class Texts:
        text = spark.createDataFrame([(1, "a b  a"), (2, "c")], "id long, body string")

    out = report_queries.rebuild_abstract(Texts)
    assert {r["id"]: r["abstract"] for r in out.collect()} == {1: "a b a", 2: "c"}
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
