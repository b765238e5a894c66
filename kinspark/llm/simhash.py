"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints that differ in at most `radius` bits share the masked value of at least one of
2**(radius+1)-1 structured masks, so no pair within the radius is missed: give bit i the
vector m(i) of F_2^(radius+1); mask v keeps the bits with <m(i), v> = 1.  At most `radius`
differing bits span a proper subspace, so some v is orthogonal to all of them, and that mask
keeps none of the differing bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, byte_rows, components, free_name, union_roots, write_table

BITS = 64
FULL = (1 << BITS) - 1
#: Buckets with more distinct fingerprints than this are masked again on their free bits.
BUCKET_LIMIT = 512


def fingerprint_of(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterable[bytes] = [b" ".join(words)]
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        block = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42, extra: Iterable[str] = ()) -> DataFrame:
    """(doc_id, the columns of `extra`, fp): the fingerprint of every whole text as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, body(text).alias("body"))
    names = ["doc_id", *extra]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_of(x, shingle, seed) for x in byte_rows(batch, "body")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(found.view(np.int64))], names=[*names, "fp"])

    return rows.mapInArrow(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names) + ", fp long")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """The masks over the given bit positions: each pair that differs in up to `radius` of them agrees under some mask."""
    vectors = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, vectors + 1):
        masks.append(sum(1 << p for k, p in enumerate(positions) if bin((1 + k % vectors) & v).count("1") & 1))
    return list(dict.fromkeys(masks))


def bucket_links(radius: int):
    """Links among the fingerprints of each bucket: a spanning forest of the pairs within the radius."""

    def spread(fps: np.ndarray) -> list[tuple[int, int]]:
        a, b = [], []
        step = max(1, (1 << 22) // len(fps))
        for at in range(0, len(fps), step):
            near = np.bitwise_count(fps[at : at + step, None] ^ fps[None, :]) <= radius
            x, y = np.nonzero(near)
            keep = x + at < y
            a.append(x[keep] + at)
            b.append(y[keep])
        root = union_roots(len(fps), np.concatenate(a), np.concatenate(b))
        other = np.nonzero(root != np.arange(len(fps)))[0]
        return [(int(fps[root[i]]), int(fps[i])) for i in other]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("fps")
            links: list[tuple[int, int]] = []
            for row in lists:
                fps = row.values.to_numpy(zero_copy_only=False)
                if len(fps) == 2:
                    if ((int(fps[0]) ^ int(fps[1])) & FULL).bit_count() <= radius:
                        links.append((int(fps[0]), int(fps[1])))
                else:
                    links.extend(spread(fps))
            yield pa.RecordBatch.from_pydict({"a": [x for x, _ in links], "b": [x for _, x in links]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def near_links(fps: DataFrame, radius: int = 3, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect exactly the pairs within the radius.

    Every bucket yields a spanning forest, so rows stay linear in its size.  A bucket above
    `limit` is split again by covering masks on the bits its key leaves free.  Each level
    halves the free bits, so a bucket at the last level has at most 2**free members: no cap
    ever drops a candidate.
    """
    # level: (rows with key columns, the mask path of each branch)
    found = None
    level = fps.select("fp", F.lit("").alias("path"), F.lit(0).cast("long").alias("key"))
    paths: list[tuple[str, int]] = [("", 0)]
    while True:
        options = []
        following: list[tuple[str, int]] = []
        for path, covered in paths:
            free = [i for i in range(BITS) if not covered >> i & 1]
            masks = covering_masks(free, radius)
            options.append((path, [(f"{path}{chr(97 + k)}", covered | m) for k, m in enumerate(masks)]))
            following += options[-1][1]
        last = min(BITS - c.bit_count() for _, c in following) <= 9 or len(following) > 4000
        if len(options) == 1:
            children = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(signed(c)).alias("mask")) for p, c in options[0][1]])
            level = level.select("fp", F.explode(children).alias("c")).select("fp", "c.path", F.col("fp").bitwiseAND(F.col("c.mask")).alias("key"))
        else:
            table = fps.sparkSession.createDataFrame([(p, q, signed(c)) for p, kids in options for q, c in kids], "path string, child string, mask long")
            level = level.join(F.broadcast(table), "path").select("fp", F.col("child").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        sizes = level.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        sizes = write_table(sizes, "buckets")
        top = sizes.agg(F.max("n")).first()[0] or 0
        small = level.join(sizes if last else sizes.where(F.col("n") <= limit), ["path", "key"])
        part = small.groupBy("path", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(bucket_links(radius), "a long, b long")
        found = part if found is None else found.union(part)
        if last or top <= limit:
            return found
        level = write_table(level.join(sizes.where(F.col("n") > limit).drop("n"), ["path", "key"], "left_semi"), "large-buckets")
        paths = following


def labelled(distinct: DataFrame, radius: int = 3, limit: int = BUCKET_LIMIT) -> DataFrame:
    """distinct (one row for each fp) with `component`, the fingerprint that names the class of its fp."""
    classes = components(near_links(distinct.select("fp"), radius, limit))
    return distinct.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, text: str = "text", radius: int = 3, shingle: int = 3, seed: int = 42, limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    Null and word-free texts have fingerprint 0 and link like any other; repeated rows give
    repeated results; a null doc_id is never a component's name unless its class holds nothing
    else (then component_id is null).
    """
    found = write_table(fingerprints(docs, text, shingle, seed), "fingerprints")
    distinct = write_table(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = labelled(distinct, radius, limit)
    least = labels.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = labels.join(least, "component").select("fp", "component_id")
    return found.join(labels, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", radius: int = 3, shingle: int = 3, seed: int = 42, limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row of each component: that with the smallest doc_id (null last), then fingerprint, then row number.

    Row numbers are written with the rows, so neither null nor repeated ids join unlike rows, and
    a task that runs again keeps the same rows.
    """
    number = free_name(docs.columns, "_row")
    rows = write_table(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    found = write_table(fingerprints(rows.select("doc_id", text, F.col(number).alias("_row")), text, shingle, seed, ["_row"]), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "fp", "_row")
    distinct = write_table(found.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    stay = labelled(distinct, radius, limit).groupBy("component").agg(F.min("first").alias("first")).select("first._row")
    return rows.join(stay.withColumnRenamed("_row", number), number, "left_semi").drop(number)
