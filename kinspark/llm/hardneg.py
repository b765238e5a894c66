"""Hard negatives: Strassen products of anchor-candidate tiles, then mergeable bounded heaps.

Vectors become integers; a block of anchors times a block of candidates is one tile, whose
inner products are made by Strassen's seven products in int64 with zeros up to even sides.
Each tile gives every anchor a heap of its best rows of the same label; heaps of tiles merge
into the positives.  The tiles are then multiplied again and give each anchor and positive a
heap of the best rows of another label inside the positive's window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_table

NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Settings:
    """low, high: a negative's score is at least low and at most high, in hundredths of the positive's."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    #: candidates and anchors of a tile, about
    block: int = 8192
    #: anchors of a product inside a tile
    strip: int = 256
    #: sides up to which a product is made directly
    leaf: int = 128
    #: heaps that are merged in one group
    merge: int = 64


def strassen(a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """a @ b.T for int64 a (m x k) and b (n x k), by seven half-sized products while all sides exceed `leaf`.

    Odd sides get a row or column of zeros.  Sums and products wrap modulo 2^64, where they
    form a ring, so the result is exact whenever it fits into 64 bits, whatever happens between.
    """
    m, k, n = len(a), a.shape[1], len(b)
    if min(m, n) <= leaf or k < 16:
        return a @ b.T
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if n % 2 or k % 2:
        b = np.pad(b, ((0, n % 2), (0, k % 2)))
    i, j, h = len(a) // 2, len(b) // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b21, b12, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]  # of b.T
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), dtype=np.int64)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def best(score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of `score`: its k greatest allowed entries as (scores, ids), ties to the smaller id.

    All entries that tie with the k-th are looked at before the k are chosen.
    """
    held = np.where(allowed, score, NONE)
    bar = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k] if held.shape[1] > k else np.full(len(held), NONE)
    rows, cols = np.nonzero((held >= bar[:, None]) & allowed)
    order = np.lexsort((ids[cols], -held[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(len(held) + 1))
    return [(held[i, c], ids[c]) for i, c in ((i, cols[starts[i] : min(starts[i] + k, starts[i + 1])]) for i in range(len(held)))]


def bounds(positive: int, low: int, high: int) -> tuple[int, int]:
    """The integers n with low * positive <= 100 * n <= high * positive, as (least, greatest); exact at any size."""
    return -(-low * positive // 100), high * positive // 100


HEAP = "array<struct<score: long, vec_id: long>>"


def merged(heaps: DataFrame, keys: list[str], k: int, at_once: int, blocks: int) -> DataFrame:
    """Heaps (keys, part, heap) of one key merged into one of the k first, at most about `at_once` in a group."""
    first = F.array_sort(F.flatten(F.collect_list("heap")), lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).when(x["vec_id"] < y["vec_id"], -1).when(x["vec_id"] > y["vec_id"], 1).otherwise(0))
    while blocks > at_once:
        blocks = -(-blocks // at_once)
        heaps = heaps.groupBy(*keys, F.pmod("part", F.lit(blocks)).alias("part")).agg(F.slice(first, 1, k).alias("heap"))
    return heaps.groupBy(*keys).agg(F.slice(first, 1, k).alias("heap"))


def integers(vectors: DataFrame, is_anchor: Column, label: Column, settings: Settings, vector: str) -> DataFrame:
    """Written rows (vec_id, label, is_anchor, v): v holds the vector's integers as int64 bytes, filled up to the longest with zeros.

    Rows with a null id, label or vector, a null or non-finite component, or whose own inner
    product exceeds 2^62 are left out.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).where(finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.col(vector).cast("array<double>").alias("v")).where("label IS NOT NULL")
    length = rows.agg(F.max(F.size("v"))).first()[0] or 0

    def floors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.floor(batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64) * settings.scale)
            sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            whole = np.zeros((batch.num_rows, length))
            whole[np.repeat(np.arange(batch.num_rows), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            fits = (whole * whole).sum(axis=1) < 2.0**62
            packed = [row.tobytes() for row in whole[fits].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).filter(pa.array(fits)) for n in ("vec_id", "label", "is_anchor")), pa.array(packed, pa.binary())], names=["vec_id", "label", "is_anchor", "v"])

    return write_table(rows.mapInArrow(floors, "vec_id long, label long, is_anchor boolean, v binary"), "integers")


def matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.int64).reshape(len(column), -1)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | str = "label", settings: Settings | None = None, vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): each anchor's hard negatives by positive.

    A row's score is its integer inner product with the anchor; greater ones come first, then
    smaller ids.  Positives are the anchor's first rows of its label other than itself, and a
    positive's negatives the first rows of other labels in its window.  Rows with a null id,
    label, vector or component, or a non-finite one, take no part, nor do vectors whose inner
    product with themselves exceeds 2^62, since their scores would not fit a long.  Shorter
    vectors count as filled up with zeros.  Repeated ids count as candidates of their own;
    equal rows with an anchor's id are one anchor, and no row with its id is its candidate.  An
    empty table gives no rows; columns besides the named ones are not looked at.
    """
    s = settings or Settings()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = integers(vectors, is_anchor, F.col(label) if isinstance(label, str) else label, s, vector)
    n, asked = rows.agg(F.count("*"), F.count_if("is_anchor")).first()
    if not asked:
        return vectors.sparkSession.createDataFrame([], out)
    blocks, parties = -(-n // s.block), -(-asked // s.block)
    # numbers are given once and written: a task that runs again reads the same blocks
    dealt = write_table(rows.select("vec_id", "label", "v", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("part")), "candidates")
    anchors = rows.where("is_anchor").select(F.col("vec_id").alias("anchor_id"), "label", "v").distinct()
    anchors = write_table(anchors.withColumn("anchor", F.monotonically_increasing_id()).withColumn("party", F.pmod(F.xxhash64("anchor"), F.lit(parties))), "anchors")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("part")
    met = dealt.withColumn("party", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parties - 1).cast("long")))).groupBy("party", "part")

    def strips(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray]]:
        a, b = matrix(left["v"]), matrix(right["v"])
        for at in range(0, len(a), s.strip):
            yield slice(at, at + s.strip), strassen(a[at : at + s.strip], b, s.leaf)

    def nearest(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            ids, kinds = right["vec_id"].to_numpy(), right["label"].to_numpy()
            own, mine_, names = left["anchor_id"].to_numpy(), left["label"].to_numpy(), left["anchor"].to_numpy()
            for some, score in strips(left, right):
                allowed = (kinds == mine_[some, None]) & (ids != own[some, None])
                for name, (top, who) in zip(names[some], best(score, allowed, ids, s.positives), strict=True):
                    if len(who):
                        found.append((int(name), key[1], [{"score": x, "vec_id": y} for x, y in zip(top.tolist(), who.tolist(), strict=True)]))
        return pd.DataFrame(found, columns=["anchor", "part", "heap"])

    heaps = anchors.select("*", everywhere).groupBy("party", "part").cogroup(met).applyInPandas(nearest, f"anchor long, part long, heap {HEAP}")
    positives = merged(heaps, ["anchor"], s.positives, s.merge, blocks)
    asking = write_table(anchors.join(positives.select("anchor", F.col("heap").alias("positives")), "anchor"), "positives")

    def windows(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            ids, kinds = right["vec_id"].to_numpy(), right["label"].to_numpy()
            mine_, names = left["label"].to_numpy(), left["anchor"].to_numpy()
            told = [[bounds(int(p["score"]), s.low, s.high) for p in ps] for ps in left["positives"]]
            for some, score in strips(left, right):
                other = kinds != mine_[some, None]
                limits = told[some]
                for at in range(max(map(len, limits))):
                    low, high = (np.array([x[at][side] if at < len(x) else (1, 0)[side] for x in limits])[:, None] for side in (0, 1))
                    for name, (top, who) in zip(names[some], best(score, other & (score >= low) & (score <= high), ids, s.negatives), strict=True):
                        if len(who):
                            found.append((int(name), at, key[1], [{"score": x, "vec_id": y} for x, y in zip(top.tolist(), who.tolist(), strict=True)]))
        return pd.DataFrame(found, columns=["anchor", "at", "part", "heap"])

    heaps = asking.select("*", everywhere).groupBy("party", "part").cogroup(met).applyInPandas(windows, f"anchor long, at int, part long, heap {HEAP}")
    negatives = merged(heaps, ["anchor", "at"], s.negatives, s.merge, blocks)
    pairs = asking.select("anchor", "anchor_id", F.posexplode("positives").alias("at", "positive")).join(negatives, ["anchor", "at"])
    return pairs.select("anchor_id", "positive", F.posexplode("heap").alias("rank", "negative")).select(
        "anchor_id", F.col("positive.vec_id").alias("positive_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("negative.vec_id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("negative.score").alias("negative_score")
    )
