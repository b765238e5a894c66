"""The training-data pipeline: five stages over documents, each one operator of kinspark.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; run() writes
each stage's rows as Parquet in the shared folder and reads them as the next one's docs.  All
but the last return the columns of docs, whatever those are beside doc_id and text: a stage
works on a struct of them, so no name clashes with its own.  A `lang` is filled and an `n_chars`
kept true where docs have them.  Repeated rows are near duplicates of each other; null ids and
repeated ids don't make unlike rows one; an empty table stays empty.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.llm import decontam, langid, packing, pii, simhash
from kinspark.llm.common import write_table
from kinspark.llm.queries import tokenizer

#: No SQL can express the trained, hashed and searched stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; the told language becomes `lang` where there was none.

    Learns from all docs that have a lang.  Null texts and texts without a letter go.
    """
    known = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    model = langid.train(docs.select("doc_id", "text", known))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    told = langid.predict(rows, model, keep=[F.col("row")]).where(~F.col("rejected"))
    if "lang" in docs.columns:
        told = told.withColumn("row", F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred")))
    return told.select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: the one with the smallest doc_id.  Unlike rows stay, whatever their ids."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark spans cut out; documents that consist of them go."""
    return decontam.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates, addresses and secrets replaced by pseudonyms of the same format.

    The key is the session's.  Where it has none, one is drawn that is kept nowhere: pseudonyms
    are then linked within this call alone, and nobody can undo them.
    """
    key = spark.conf.get(pii.KEY_SETTING, None) or secrets.token_hex(32)
    changed = pii.pseudonymise(docs.select(F.struct(*docs.columns).alias("row"), "text"), key=key)
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_pii") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", n_chars)
    return changed.select(row.alias("row")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pseudonyms),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = write_table(docs, name)
    return docs
