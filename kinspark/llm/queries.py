"""Thin queries over the operators of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontam, hardneg, langid, multiindex, packing, periods, pii, prefixfree, quality, recompression, simhash, toxicity
from .common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pii_key(spark: SparkSession) -> str:
    """The session's key; the registered query, whose synthetic tables hold nobody's data, has a published one without."""
    return spark.conf.get(pii.KEY_SETTING, "synthetic tables only")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=pii_key(spark))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ctw.score(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op4_prefixfree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefixfree.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))


def op6_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)).select("doc_id", "toxic"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out("doc_id", 4, 2)).select("doc_id", "text", "lang"))
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def tokenizer() -> str:
    """The vocabulary file; WORD_BPE names another."""
    if "WORD_BPE" in os.environ:
        return os.environ["WORD_BPE"]
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)).select("doc_id", "quality"))
    found = quality.score(docs, model)
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, shifted)


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents whose crc32 is divisible by 10 repeat a stretch from some word on; texts of the others stay."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"))).alias("w"))
    rows = rows.withColumn("n", F.when(F.size("w") > 0, F.size("w").cast("long"))).withColumn("a", F.col("g") % F.col("n"))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(with_periods(table(spark, sf_dir, "documents")), digest=True)
    top = F.col("top")
    longest = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], y["length"] - x["length"]).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]).cast("int"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.get(longest, F.lit(0)).alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.lower(F.hex("collapsed")).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"), F.floor(1000 * top["length"] / top["period"]).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_decontamination": op2_decontamination,
    "op3_ctw": op3_ctw,
    "op4_prefixfree": op4_prefixfree,
    "op5_recompression": op5_recompression,
    "op6_multiindex": op6_multiindex,
    "op7_toxicity": op7_toxicity,
    "op8_langid": op8_langid,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_quality": op11_quality,
    "op12_hardneg": op12_hardneg,
    "op13_periods": op13_periods,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": r"""
        WITH lowered AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), words AS (
            SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered
        ), items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark WHERE item_id IS NOT NULL
        ), windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
        ), sizes AS (SELECT DISTINCT n FROM windows
        ), starts AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)
        ), hits AS (
            SELECT s.doc_id, s.n, s.i, x.item_id FROM starts s JOIN windows x ON s.g = x.g AND s.n = x.n
        ), covered AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
        ), found AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
            FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
        )
        SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(f.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
        FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id LEFT JOIN found f ON w.doc_id = f.doc_id
    """,
    "op5_recompression": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
        ), firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g
        ), hit AS (
            SELECT DISTINCT v.doc_id, unnest(range(v.i, v.i + 13)) AS p FROM windows v JOIN firsts f ON v.g = f.g WHERE f.first < v.doc_id
        ), spread AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words
        ), kept AS (
            SELECT s.doc_id, string_agg(s.x, ' ' ORDER BY s.p) AS t, count(*) AS n
            FROM spread s LEFT JOIN hit h ON s.doc_id = h.doc_id AND s.p = h.p WHERE h.p IS NULL GROUP BY s.doc_id
        )
        SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
        FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
    """,
    "op12_hardneg": r"""
        WITH vectors AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM (SELECT DISTINCT * FROM vectors WHERE vec_id % 50 = 0) a JOIN vectors b ON a.vec_id <> b.vec_id
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, p.positive_id, row_number() OVER w::INTEGER AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
        FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
        QUALIFY row_number() OVER w <= 3
    """,
    "op13_periods": r"""
        WITH crc AS (
            SELECT list(list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY x) AS t
            FROM (SELECT unnest(range(256))::BIGINT AS x)
        ), hashed AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h
            FROM documents, crc
        ), places AS (
            SELECT row_number() OVER () AS r, doc_id, w, h, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM hashed
        ), periodic AS (
            SELECT *, 1 + (len(w) - a) // (3 + g % 8) AS p FROM places
        ), words AS (
            SELECT r, doc_id, i, w[CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END + 1] AS x, len(w) AS n FROM (SELECT *, unnest(range(len(w))) AS i FROM periodic)
        ), numbered AS (SELECT r, i, n, dense_rank() OVER (ORDER BY x) AS x FROM words
        ), equal AS (
            SELECT u.r, u.i, v.i - u.i AS q, u.i - row_number() OVER (PARTITION BY u.r, v.i - u.i ORDER BY u.i) AS island
            FROM numbered u JOIN numbered v ON u.r = v.r AND u.x = v.x AND v.i > u.i AND 4 * (v.i - u.i) <= u.n
        ), islands AS (
            SELECT r, min(i) AS s, count(*) + q AS length, q FROM equal GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)
        ), runs AS (SELECT r, s, length, min(q) AS q FROM islands GROUP BY r, s, length
        ), told AS (
            SELECT r, count(*) AS n_runs, string_agg(s::VARCHAR || ',' || length::VARCHAR || ',' || q::VARCHAR || chr(10), '' ORDER BY s, q) AS lines,
                   first({'s': s, 'l': length, 'q': q} ORDER BY length DESC, s, q) AS top
            FROM runs GROUP BY r
        ), dropped AS (SELECT DISTINCT r, unnest(range(s + q, s + length)) AS i FROM runs
        ), kept AS (
            SELECT w.r, string_agg(w.x, ' ' ORDER BY w.i) AS t FROM words w LEFT JOIN dropped d ON w.r = d.r AND w.i = d.i WHERE d.i IS NULL GROUP BY w.r
        )
        SELECT p.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.l::BIGINT AS length, top.q::BIGINT AS period, (1000 * top.l // top.q)::BIGINT AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
        FROM places p LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
    """,
}
