"""The record mirror as Structured Streaming: last writer wins by time_us, deletes are events like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["collection", "did", "rkey"]


def lww_state(commits: DataFrame) -> DataFrame:
    """A stream of the records that win, each batch's changes; state is the newest record of each key, tombstones too.

    A record carries the time of the batch that brought it, so a key whose record stands is not
    told again; of records with one time and arrival the later batch's wins.
    """
    rows = commits.withColumn("brought", F.current_timestamp())
    best = rows.groupBy(*KEYS).agg(F.max(F.struct("time_us", "arrival", "brought", "operation", "value")).alias("r"))
    return best.where(F.col("r.brought") == F.current_timestamp()).select(*KEYS, "r.time_us", "r.arrival", "r.operation", "r.value")


def apply_batch(mirror: DataFrame | None, changes: DataFrame) -> DataFrame:
    """The mirror after a batch of changes: newest of each key, tombstones held as rows so that late updates lose."""
    both = changes if mirror is None else mirror.unionByName(changes)
    rest = [c for c in both.columns if c not in KEYS]
    return both.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), F.struct("time_us", "arrival")).alias("r")).select(*KEYS, "r.*")


def mirror_stream(commits: DataFrame, path: str, checkpoint: str, collections: list[str]):
    """Starts the mirror: every batch adds its newest record of each key, by collection; others are skipped.

    A batch writes one folder, named by its number and split by collection, and reads no other, so
    its work grows with the batch alone and a replayed one writes the same folder again.
    `mirror_rows` folds the batches when it reads, `compact_mirror` for good.
    """

    def fold(batch: DataFrame, number: int) -> None:
        apply_batch(None, batch.where(F.col("collection").isin(collections))).write.mode("overwrite").partitionBy("collection").parquet(f"{path}/batch={number}")

    return commits.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).outputMode("append")


def mirror_rows(spark: SparkSession, path: str, schema: str, deleted: bool = False) -> DataFrame:
    """The newest record of each key over the batches of a mirror; tombstones only if asked for.

    schema: that of the commits.  Batches that held nothing, or a mirror without any, have no rows.
    """
    found = spark.read.schema(schema).option("basePath", path).parquet(path)
    rows = apply_batch(None, found.select(*[f.name for f in spark.createDataFrame([], schema).schema]))
    return rows if deleted else rows.where("operation <> 'delete'")


def compact_mirror(spark: SparkSession, path: str, into: str, schema: str) -> DataFrame:
    """The mirror as one batch of a new folder, tombstones kept; a stream may go on there under higher numbers."""
    mirror_rows(spark, path, schema, deleted=True).write.partitionBy("collection").parquet(f"{into}/batch=-1")
    return mirror_rows(spark, into, schema)
