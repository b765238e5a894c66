"""Helpers shared by the training-data operators.

Texts travel to Python as UTF-8 bytes, so that splitting and lower-casing of ASCII run at
C speed and offsets are byte offsets.  Where an operator needs the same rows twice it
works on *chunks*: a chunk row holds many documents (ids, lengths, compressed bytes), is
bounded by `chunk_bytes` plus one document, and is written once to the shared folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20

#: ASCII letters and digits and every byte of a non-ASCII character; A-Z become a-z, the rest blanks.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session (one machine, as in tests) gets a folder of its own; a
    cluster is an error, since its machines would each write into their own.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        told = spark.sparkContext.getCheckpointDir()
    return told.rstrip("/")


def free_name(columns: Iterable[str], name: str) -> str:
    """A column name like `name` that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write df to a new table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves the remainder; a null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))
    return F.crc32(text) % modulus == remainder


def body(text: str = "text") -> Column:
    """The text as bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def byte_rows(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The values of a binary column as bytes, without making a list of them all."""
    for value in batch.column(name):
        yield value.as_py() or b""


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_numbers(values: np.ndarray) -> bytes:
    """A sorted or small integer array, delta-coded and compressed."""
    values = np.ascontiguousarray(values, dtype=np.int64)
    delta = np.diff(values, prepend=np.int64(0)) if len(values) else values
    return squeeze(delta.view(np.uint8).reshape(-1, 8).T.tobytes() if len(values) else b"")


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(unsqueeze(data), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.int64)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel())


CHUNK_SCHEMA = "chunk long, ids binary, known binary, marks binary, lengths binary, blob binary"


def chunked(docs: DataFrame, mark: Column | None = None, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Documents as written chunk rows.

    ids: int64 of doc_id; known: 1 where doc_id is not null; marks: `mark` as 0 or 1; lengths:
    bytes of each text; blob: the texts, concatenated and compressed.  No shuffle: every task
    cuts the rows it reads.  The table is written, so chunk numbers hold for later passes.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (mark if mark is not None else F.lit(False)).alias("mark"),
        body(text).alias("body"),
    )

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        marks: list[bool] = []
        texts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            out = pa.RecordBatch.from_pydict(
                {
                    "chunk": [(part << 24) | number],
                    "ids": [np.array([0 if x is None else x for x in ids], dtype=np.int64).tobytes()],
                    "known": [bytes(x is not None for x in ids)],
                    "marks": [bytes(bool(x) for x in marks)],
                    "lengths": [np.array([len(x) for x in texts], dtype=np.int64).tobytes()],
                    "blob": [squeeze(b"".join(texts))],
                },
                schema=pa.schema(
                    [("chunk", pa.int64())]
                    + [(name, pa.binary()) for name in ("ids", "known", "marks", "lengths", "blob")]
                ),
            )
            number += 1
            size = 0
            ids.clear(), marks.clear(), texts.clear()
            return out

        for batch in batches:
            for doc_id, mark_, text_ in zip(batch.column("doc_id"), batch.column("mark"), byte_rows(batch, "body"), strict=True):
                ids.append(doc_id.as_py())
                marks.append(mark_.as_py())
                texts.append(text_)
                size += len(text_) + 16
                if size >= chunk_bytes:
                    yield flush()
        if ids:
            yield flush()

    return write_table(rows.mapInArrow(cut, CHUNK_SCHEMA), "chunks")


class Chunk:
    """One chunk row, unpacked."""

    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.known = np.frombuffer(row["known"], dtype=np.uint8).astype(bool)
        self.marks = np.frombuffer(row["marks"], dtype=np.uint8).astype(bool)
        self.lengths = np.frombuffer(row["lengths"], dtype=np.int64)
        self.blob = unsqueeze(row["blob"])
        self.ends = np.cumsum(self.lengths)

    def __len__(self) -> int:
        return len(self.ids)

    def texts(self) -> Iterator[bytes]:
        start = 0
        for end in self.ends:
            yield self.blob[start:end]
            start = end

    def doc_ids(self) -> list[int | None]:
        return [int(x) if k else None for x, k in zip(self.ids, self.known, strict=True)]


def chunk_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of chunk tables one at a time, so that one chunk is unpacked at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def union_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component, for n indices and links a-b."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        a, b = a[apart], b[apart]
        if not len(a):
            break
        np.minimum.at(root, high[apart], low[apart])
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
    return root


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): rows (node, component), component the smallest node.

    Alternates large-star and small-star steps, each a grouped minimum and an equi-join, and
    writes every round, so no step holds a component in one task and lineage stays short.
    """
    edges = write_table(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    seen = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct()
        edges = write_table(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.groupBy("hi").agg(F.min("lo").alias("lo")).select(F.col("hi").alias("node"), F.col("lo").alias("component"))
