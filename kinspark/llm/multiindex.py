"""Approximate nearest neighbours with an inverted multi-index.

Unit vectors are halved; each half has its own codebook, and a vector's cell is the pair of
nearest centroids.  A query walks the pairs by the sum of its two half distances with a heap
(multi-sequence order) until its cells hold the share of vectors that calibration asks for,
and the entries of those cells are reranked by the exact cosine in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_table


@dataclass(frozen=True)
class Settings:
    """sample: vectors that codebooks and visited share are fitted on; every row is indexed."""

    k: int = 5
    sample: int = 8000
    probes: int = 200
    centroids: int = 48
    rounds: int = 10
    recall: float = 0.95
    block: int = 4096
    #: queries of a group; more meet each block of entries in several groups
    queries: int = 16384
    seed: int = 11


@dataclass
class Index:
    books: tuple[np.ndarray, np.ndarray]
    share: float

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = x.shape[1] // 2
        return x[:, :cut], x[:, cut:]

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [(h**2).sum(1)[:, None] - 2 * h @ b.T + (b**2).sum(1) for h, b in zip(self.halves(x), self.books, strict=True)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = self.distances(x)
        return one.argmin(1) * len(self.books[1]) + two.argmin(1)


def walk(one: np.ndarray, two: np.ndarray) -> Iterator[int]:
    """Cells by the sum of the two half distances, nearest first."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    heap = [(float(one[a[0]] + two[b[0]]), 0, 0)]
    width = len(two)
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]) * width + int(b[j])
        if j + 1 < width:
            heapq.heappush(heap, (float(one[a[i]] + two[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(one):
            heapq.heappush(heap, (float(one[a[i + 1]] + two[b[0]]), i + 1, 0))


def codebook(x: np.ndarray, size: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of x by Lloyd's rounds from distinct rows."""
    start = np.unique(x, axis=0)
    centroids = start[rng.permutation(len(start))[:size]].copy()
    for _ in range(rounds):
        near = ((x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)).argmin(1)
        n = np.bincount(near, minlength=len(centroids))
        for d in range(x.shape[1]):
            total = np.bincount(near, weights=x[:, d], minlength=len(centroids))
            centroids[n > 0, d] = total[n > 0] / n[n > 0]
    return centroids


def fit(sample: np.ndarray, settings: Settings) -> Index:
    """Codebooks, and the share of vectors to visit so that the sample's recall reaches its mark."""
    rng = np.random.default_rng(settings.seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    cut = unit.shape[1] // 2
    index = Index(tuple(codebook(h, settings.centroids, settings.rounds, rng) for h in (unit[:, :cut], unit[:, cut:])), 1.0)
    probes = unit[rng.permutation(len(unit))[: settings.probes]]
    truth = np.argsort(-(probes @ unit.T), axis=1, kind="stable")[:, 1 : settings.k + 1]
    cell, (one, two) = index.cells(unit), index.distances(probes)
    size = np.bincount(cell, minlength=len(index.books[0]) * len(index.books[1]))
    needed = []
    for i in range(len(probes)):
        seen, at = 0, {}
        for c in walk(one[i], two[i]):
            at[c] = seen  # visited while so many were seen before
            seen += size[c]
        needed += [at[c] / len(unit) for c in cell[truth[i]]]
    index.share = float(np.quantile(needed, settings.recall)) if needed else 1.0
    return index


def usable(vector: str) -> Column:
    """Vectors that are not null, have a finite number everywhere and are not zero."""
    ok = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return ok & F.exists(vector, lambda x: x != 0) & (F.size(vector) > 0)


def search(vectors: DataFrame, is_query: Column, settings: Settings | None = None, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other rows by cosine, ties to the smaller id.

    Vectors that are null, zero, or hold a null or a non-finite number take no part, nor do
    those whose length is not the commonest (then the greater).  Equal vectors share an entry
    that keeps their k+1 smallest ids, which is all a ranking can use.  Repeated ids count as
    rows of their own; rows with a null id take no part.
    """
    settings = settings or Settings()
    context = vectors.sparkSession.sparkContext
    k = settings.k
    rows = vectors.where(usable(vector) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("count"), F.count_if("is_query").alias("asked")).orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not common:
        return vectors.sparkSession.createDataFrame([], schema)
    total = common[0]["count"]
    parties = max(1, -(-common[0]["asked"] // settings.queries))
    rows = rows.where(F.size("v") == common[0]["d"])
    spread = F.pmod(F.xxhash64("vec_id", F.lit(settings.seed)), F.lit(1 << 30))
    some = rows.where(spread <= int(min(1.0, settings.sample / total) * (1 << 30))).select("v").collect()
    if not some:
        some = rows.select("v").limit(settings.sample).collect()
    index = fit(np.array([r["v"] for r in some]), settings)
    held = context.broadcast(index)

    # every row, by value: one entry per distinct vector
    ranked = rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    entries = ranked.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))

    def in_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.array(v.as_py()) for v in batch.column("v")])
                cell = held.value.cells(x / np.linalg.norm(x, axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), batch.column("v"), batch.column("ids")], names=["cell", "v", "ids"])

    placed = write_table(entries.mapInArrow(in_cells, "cell long, v array<double>, ids array<long>"), "cells")
    width = len(index.books[1])
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most centroids squared
    rows_of = np.bincount([c // width for c in sizes], weights=list(sizes.values()), minlength=len(index.books[0]))
    blocks = np.maximum(1, -(-rows_of.astype(np.int64) // settings.block))  # of entries that share their first centroid
    told = context.broadcast((sizes, blocks, index.share * sum(sizes.values())))

    def visits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, blocks, reach = told.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.array(v.as_py()) for v in batch.column("v")])
            one, two = held.value.distances(x / np.linalg.norm(x, axis=1, keepdims=True))
            at, firsts, parts, marks = [], [], [], []
            for i in range(len(x)):
                seen = 0
                wanted: dict[int, np.ndarray] = {}
                for c in walk(one[i], two[i]):
                    if c in sizes:
                        wanted.setdefault(c // width, np.zeros(width, dtype=np.uint8))[c % width] = 1
                        seen += sizes[c]
                        if seen > max(reach, k + 1):
                            break
                for first, mark in wanted.items():
                    for b in range(int(blocks[first])):
                        at.append(i), firsts.append(first), parts.append(b), marks.append(mark.tobytes())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(parts, pa.int64()), batch.column("vec_id").take(take), batch.column("v").take(take), pa.array(marks, pa.binary())], names=["first", "block", "query_id", "v", "visited"])

    queries = rows.where("is_query").select("vec_id", "v")
    wanted = queries.mapInArrow(visits, "first long, block long, query_id long, v array<double>, visited binary").withColumn("party", F.pmod(F.xxhash64("query_id", F.lit(settings.seed)), F.lit(parties)))
    n_blocks = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), (F.col("cell") / width).cast("int") + 1)
    salted = placed.select(F.floor(F.col("cell") / width).alias("first"), F.pmod(F.xxhash64("v"), n_blocks).cast("long").alias("block"), (F.col("cell") % width).alias("second"), "v", "ids")
    salted = salted.withColumn("party", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parties - 1).cast("long"))))

    def rerank(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        top: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            x, y = np.stack(left["v"].to_list()), np.stack(right["v"].to_list())
            seen = np.stack([np.frombuffer(m, dtype=np.uint8) for m in left["visited"]]).astype(bool)[:, right["second"].to_numpy()]
            names, ids = left["query_id"].tolist(), right["ids"].tolist()
            keep = min(len(y), k + 1)
            norm = np.linalg.norm(y, axis=1)
            for at in range(0, len(x), 512):
                q = x[at : at + 512]
                cosine = np.where(seen[at : at + 512], (q @ y.T) / (np.linalg.norm(q, axis=1)[:, None] * norm), -np.inf)
                bar = np.partition(cosine, len(y) - keep, axis=1)[:, len(y) - keep]
                for i, j in zip(*np.nonzero((cosine >= bar[:, None] - 1e-12) & (cosine > -np.inf)), strict=True):
                    # the entry's score again, component by component in their own order
                    score = float(np.dot(q[i], y[j]) / (np.sqrt(np.dot(q[i], q[i])) * np.sqrt(np.dot(y[j], y[j]))))
                    top += [(names[at + i], int(v), score) for v in ids[j] if v != names[at + i]]
        found = pd.DataFrame(top, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)

    near = wanted.groupBy("first", "block", "party").cogroup(salted.groupBy("first", "block", "party")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)  # k rows for each block visited
    return near.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
