"""Blocked pair joins, consensus and upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..functions import scalars
from .tree import cut_lineage, numbered


#: About so many rows of a key are one side of a task's group.
TILE = 1024
#: About so many samples of a block are one side of a task's group; a sample passes the shuffle once for each such side of its block.
SIDE = 4096


def in_parts(rows: DataFrame, *keys: str) -> DataFrame:
    """rows over all shuffle partitions by some columns; a given number, since few rows that make many would be put into few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def meet_in_tiles(left: DataFrame, right: DataFrame, key: list[str], size: int | None = None) -> DataFrame:
    """left joined with right on `key`; a key's rows of `right` are split in tiles, with each of which all its left rows meet, so that no key is one task."""
    n = right.groupBy(*key).agg(F.ceil(F.count("*") / (size or TILE)).alias("_tiles"))
    x = left.join(n, key).withColumn("_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1))).drop("_tiles")
    y = right.join(n, key).withColumn("_tile", F.pmod(F.xxhash64(*right.columns), F.col("_tiles"))).drop("_tiles")
    return in_parts(x, *key, "_tile").hint("merge").join(in_parts(y, *key, "_tile"), [*key, "_tile"]).drop("_tile")


def shared_counts(sets: DataFrame, block: list[str]) -> DataFrame:
    """(block..., a, b, shared) of samples that share a variant inside a block."""
    return meetings(sets.select(*block, "sample_id", "variant_id", F.lit(0).cast("long").alias("size")), block).drop("na", "nb")


def meetings(sets: DataFrame, block: list[str]) -> DataFrame:
    """(block..., a, b, shared, na, nb) of samples a < b that share a variant inside a block, from sets (block..., sample_id, variant_id, size).

    Where so many variants are common that pairs meet again and again, a block's samples are split
    in tiles and each two tiles are one group: the product of their tables of variants counts what
    every pair shares, and no pair is shuffled.  A tile lists equal sets once, with their samples.
    Other blocks join on the variant.
    """
    from .tree import cut_lineage

    rows = cut_lineage(sets.dropna(subset=[*block, "sample_id", "variant_id"]))
    seen = rows.groupBy(*block, "variant_id").agg(F.count("*").cast("double").alias("n")).groupBy(*block).agg(F.count("*").alias("_variants"), F.sum(F.col("n") * F.col("n")).alias("_meet"))
    held = rows.groupBy(*block).agg(F.countDistinct("sample_id").alias("_samples"))
    # a meeting that is shuffled costs about twenty times a pair of a product, and a hundred columns of that as much as the pair itself
    cost = F.col("_samples").cast("double") * F.col("_samples") * (1 + F.col("_variants") / 100)
    known = cut_lineage(held.join(seen, block).select(*block, F.when(cost < 20 * F.col("_meet"), F.ceil(F.col("_samples") / SIDE)).otherwise(0).alias("_tiles")))
    sparse = rows.join(known.where("_tiles = 0"), block, "left_semi")
    a, b = (sparse.select(*block, "variant_id", F.col("sample_id").alias(s), F.col("size").alias(f"n{s}")) for s in "ab")
    joined = a.join(b, [*block, "variant_id"]).where("a < b").groupBy(*block, "a", "b").agg(F.count("*").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))

    dense = rows.join(known.where("_tiles > 0"), block).groupBy(*block, "_tiles", "sample_id").agg(F.array_sort(F.collect_list("variant_id")).alias("v"), F.first("size").alias("size"))  # one sample's variants
    schema = StructType([*[sets.schema[c] for c in block], *[StructField(c, sets.schema["sample_id"].dataType) for c in "ab"], *[StructField(c, LongType()) for c in ("shared", "na", "nb")]])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        sizes = table["size"].to_numpy()
        for ids, kinds, a, b, (n,) in _tile_pairs(key, table, lambda shared, x, y: (shared > 0, (shared,))):
            columns = [*[pa.repeat(k, len(n)) for k in key[:-2]], ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(n.astype(np.int64)), pa.array(sizes[kinds[a]]), pa.array(sizes[kinds[b]])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    counted = tiled(dense, block, "size").applyInArrow(run, schema)
    return joined.select(*schema.names).unionByName(counted)


def tiled(samples: DataFrame, block: list[str], *rest: str) -> GroupedData:
    """Samples (block..., sample_id, v, _tiles, rest...) dealt out in tiles, a group for each two tiles of a block; samples of a tile that are alike in all else are one row, with their ids."""
    placed = samples.withColumn("_t", F.pmod(F.xxhash64("sample_id"), F.col("_tiles")))
    kinds = placed.groupBy(*block, "_tiles", "_t", "v", *rest).agg(F.collect_list("sample_id").alias("ids"))  # a tile's samples at most
    met = kinds.withColumn("_u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)))
    rows = met.select(*block, F.least("_t", "_u").alias("_i"), F.greatest("_t", "_u").alias("_j"), "_t", "v", "ids", *rest)
    return in_parts(rows, *block, "_i", "_j").groupBy(*block, "_i", "_j")


Told = tuple[np.ndarray, tuple[np.ndarray, ...]]


def _tile_pairs(key: tuple[pa.Scalar, ...], table: pa.Table, tell: Callable[[np.ndarray, np.ndarray, np.ndarray], Told], chunk: int = 1024, width: int = 1024, most: int = 1 << 16) -> Iterator[tuple]:
    """(ids, kinds, a, b, values): pairs of the samples of two tiles, about `most` at a time; of one tile, each pair once.

    tell(shared, x, y) gets what some rows x of the table share with the rows y, and returns which
    of these kinds make pairs, and tables of what is told of them.  ids are in order, a and b point
    to them (a the lesser id), kinds has the table's row of each id, and values are of each pair.
    """
    i, j = (k.as_py() for k in key[-2:])
    at, lists, held = table["_t"].to_numpy(), table["v"].combine_chunks(), table["ids"].combine_chunks()
    order = pc.sort_indices(held.flatten())
    ids, kinds = held.flatten().take(order), np.repeat(np.arange(len(at)), held.value_lengths().to_numpy())[order.to_numpy()]
    rank = ids.dictionary_encode().indices.to_numpy()
    variant = lists.flatten().dictionary_encode().indices.to_numpy()
    owner, total = np.repeat(np.arange(len(at)), lists.value_lengths().to_numpy()), int(variant.max(initial=-1)) + 1

    def part(rows: np.ndarray, start: int) -> np.ndarray:
        place = np.full(len(at), -1)
        place[rows] = np.arange(len(rows))
        m = (place[owner] >= 0) & (variant >= start) & (variant < start + width)
        out = np.zeros((len(rows), min(width, total - start)), dtype=np.float32)
        np.add.at(out, (place[owner[m]], variant[m] - start), 1)
        return out

    y = np.flatnonzero(at == j)
    column = np.empty(len(at), dtype=np.int64)
    column[y] = np.arange(len(y))
    two = np.flatnonzero(at[kinds] == j)
    across = column[kinds[two]]
    whole = np.flatnonzero(at == i)
    for low in range(0, len(whole) if len(two) else 0, chunk):
        x = whole[low : low + chunk]
        shared = np.zeros((len(x), len(y)), dtype=np.float32)
        for start in range(0, total, width):
            shared += part(x, start) @ part(y, start).T
        wanted, values = tell(shared, x, y)
        row = np.full(len(at), -1)
        row[x] = np.arange(len(x))
        one = np.flatnonzero(row[kinds] >= 0)
        for first in range(0, len(one), max(1, most // len(two))):
            p = one[first : first + max(1, most // len(two))]
            down = row[kinds[p]]
            good = wanted[np.ix_(down, across)]
            if i == j:
                good &= rank[p][:, None] < rank[two][None, :]
            u, w = np.nonzero(good)
            if len(u):
                of = down[u], across[w]
                a, b = p[u], two[w]
                yield ids, kinds, np.minimum(a, b), np.maximum(a, b), [v[of] for v in values]


def set_sizes(sets: DataFrame) -> DataFrame:
    return sets.groupBy("sample_id").agg(F.count("*").alias("size"))


def jaccard_pairs(sets: DataFrame, block: list[str], least: float = 0.0) -> DataFrame:
    """Jaccard of all pairs in a block that share a variant."""
    sets = cut_lineage(sets.select(*block, "sample_id", "variant_id"))
    both = meetings(sets.join(set_sizes(sets), "sample_id"), block)
    out = both.select(*block, "a", "b", "shared", scalars.jaccard(F.col("shared"), F.col("na"), F.col("nb")).alias("jaccard"))
    return out.where(F.col("jaccard") >= least) if least else out


#: What rounding may take from a product of a size and a share.
SLACK = 1e-9


def rare_first(rows: DataFrame, seen: DataFrame, block: str, key: str) -> DataFrame:
    """(block, key, v): each key's distinct variants, those first that few of the block hold, from rows (block, key, variant_id) and seen (block, variant_id, _n)."""
    held = rows.join(seen, [block, "variant_id"]).groupBy(block, key).agg(F.array_sort(F.collect_set(F.struct("_n", "variant_id"))).alias("v"))  # one set's variants
    return held.select(block, key, F.transform("v", lambda x: x["variant_id"]).alias("v"))


def meeting(x: DataFrame, y: DataFrame, block: str, shared: int, least: float, apart: Column) -> DataFrame:
    """(block, x, y, shared, nx, ny, jaccard) of sets (block, x, v) and (block, y, v) that share `shared` variants at least, at a Jaccard of `least` or more.

    Both sides list variants in the same order, rare first.  Sets that similar agree on a variant
    of their prefixes, so only those meet: a variant that everyone has, as a branch's founding
    one, is in no prefix but of sets that hold little else.
    """

    def prefix(side: DataFrame, key: str) -> DataFrame:
        n = F.size("v")
        need = F.greatest(F.lit(shared), F.ceil(n * least - SLACK).cast("int"))
        return side.where(n >= shared).select(block, key, n.alias(f"n{key}"), F.explode(F.slice("v", F.lit(1), n - need + 1)).alias("token"))

    fits = apart & (F.col("nx") >= least * F.col("ny") - SLACK) & (F.col("ny") >= least * F.col("nx") - SLACK)
    # sets that are often alike make small files and are large in memory: never broadcast
    x, y = x.hint("merge"), y.hint("merge")
    near = prefix(x, "x").join(prefix(y, "y"), [block, "token"]).where(fits).select(block, "x", "y").distinct()
    near = near.join(x.withColumnRenamed("v", "vx"), [block, "x"]).join(y.withColumnRenamed("v", "vy"), [block, "y"])
    near = near.select(block, "x", "y", F.size(F.array_intersect("vx", "vy")).cast("long").alias("shared"), F.size("vx").alias("nx"), F.size("vy").alias("ny"))
    return near.withColumn("jaccard", scalars.jaccard(F.col("shared"), F.col("nx"), F.col("ny"))).where((F.col("shared") >= shared) & (F.col("jaccard") >= least))


def set_kinds(sets: DataFrame, block: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kinds, members, seen): equal sets of a block go by their least sample.

    kinds: (block, kind, v, members); members: (block, kind, sample_id); seen: (block, variant_id, _n).
    """
    seen = cut_lineage(sets.groupBy(block, "variant_id").agg(F.count("*").alias("_n")))
    held = cut_lineage(rare_first(sets, seen, block, "sample_id"))
    kinds = cut_lineage(held.groupBy(block, "v").agg(F.min("sample_id").alias("kind"), F.count("*").alias("members")))
    return kinds, held.join(kinds.select(block, "v", "kind"), [block, "v"]).select(block, "kind", "sample_id"), seen


def similar_pairs(sets: DataFrame, block: str, shared: int, least: float) -> DataFrame:
    """(a, b, shared, jaccard) of samples of one block that share `shared` variants at least, at a Jaccard of `least` or more.

    sets: (block, sample_id, variant_id), distinct.  Equal sets are compared once, by their least
    sample; of the others only those meet that agree on one of their rarest variants.
    """
    kinds, members, _ = set_kinds(sets, block)
    near = meeting(kinds.select(block, F.col("kind").alias("x"), "v"), kinds.select(block, F.col("kind").alias("y"), "v"), block, shared, least, F.col("x") < F.col("y")).select(block, "x", "y", "shared", "jaccard")
    n = F.size("v")
    same = kinds.where((F.col("members") > 1) & (n >= shared)).select(block, F.col("kind").alias("x"), F.col("kind").alias("y"), n.cast("long").alias("shared"), scalars.jaccard(n, n, n).alias("jaccard"))
    pairs = near.unionByName(same).join(members.select(block, F.col("kind").alias("x"), F.col("sample_id").alias("p")), [block, "x"]).join(members.select(block, F.col("kind").alias("y"), F.col("sample_id").alias("q")), [block, "y"])
    return pairs.where("x <> y or p < q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "shared", "jaccard")


class Duplicates(NamedTuple):
    """blocks: (terminal, mt, members), any two of whose members are candidates; members: (terminal, mt, kind, sample_id); pairs: (terminal, x, y, shared, jaccard, mt_match) of kinds."""

    blocks: DataFrame
    members: DataFrame
    pairs: DataFrame


def duplicate_blocks(sets: DataFrame, samples: DataFrame, shared: int = 3, least: float = 0.5) -> Duplicates:
    """Duplicate candidates without a row for each two samples.

    sets: (sample_id, variant_id); samples: (sample_id, terminal, mt), each once.  Samples of one
    terminal and mt with equal sets are one kind, named by its least sample.  Two samples are
    candidates if their mt is equal (null equals nothing), or if they share `shared` variants at a
    Jaccard of `least`.  pairs holds what kinds have in common wherever that is something; two
    members of a block whose kinds have no row there are candidates that share nothing.  Kinds
    with themselves are there where they have several members.
    """
    held = sets.select("sample_id", "variant_id").distinct().join(samples.select("sample_id", "terminal"), "sample_id")
    seen = cut_lineage(held.groupBy("terminal", "variant_id").agg(F.count("*").alias("_n")))
    # a sample without variants has the empty set, as in its block
    filled = samples.select("sample_id", "terminal", "mt").join(rare_first(held, seen, "terminal", "sample_id"), ["terminal", "sample_id"], "left")
    filled = cut_lineage(filled.withColumn("v", F.coalesce("v", F.array().cast(f"array<{sets.schema['variant_id'].dataType.simpleString()}>"))))
    kinds = cut_lineage(filled.groupBy("terminal", "mt", "v").agg(F.min("sample_id").alias("kind"), F.count("*").alias("members")))
    members = filled.join(kinds.select(F.col("terminal").alias("t"), F.col("mt").alias("m"), F.col("v").alias("w"), "kind"), (F.col("terminal") == F.col("t")) & F.col("mt").eqNullSafe(F.col("m")) & (F.col("v") == F.col("w"))).select("terminal", "mt", "kind", "sample_id")
    x, y = (kinds.select("terminal", F.col("kind").alias(side), "v") for side in ("x", "y"))
    mts = kinds.select("kind", "mt")
    alike = meeting(x, y, "terminal", shared, least, F.col("x") < F.col("y")).join(mts.select(F.col("kind").alias("x"), F.col("mt").alias("mx")), "x").join(mts.select(F.col("kind").alias("y"), F.col("mt").alias("my")), "y")
    alike = alike.where("mx IS NULL OR my IS NULL OR mx <> my").select("terminal", "x", "y", "shared", "jaccard", F.lit(False).alias("mt_match"))
    token = kinds.where("mt IS NOT NULL").select("terminal", "mt", "kind", "v", F.explode("v").alias("variant_id"))
    left, right = token.select("terminal", "mt", "variant_id", F.col("kind").alias("x")), token.select("terminal", "mt", "variant_id", F.col("kind").alias("y"))
    common = left.join(right, ["terminal", "mt", "variant_id"]).where("x < y").groupBy("terminal", "x", "y").agg(F.count("*").alias("shared"))
    sizes = kinds.select("kind", F.size("v").alias("n"))
    common = common.join(sizes.select(F.col("kind").alias("x"), F.col("n").alias("nx")), "x").join(sizes.select(F.col("kind").alias("y"), F.col("n").alias("ny")), "y")
    common = common.select("terminal", "x", "y", "shared", scalars.jaccard(F.col("shared"), F.col("nx"), F.col("ny")).alias("jaccard"), F.lit(True).alias("mt_match"))
    n = F.size("v")
    own = kinds.where((F.col("members") > 1) & (n > 0) & (F.col("mt").isNotNull() | (n >= shared)))
    own = own.select("terminal", F.col("kind").alias("x"), F.col("kind").alias("y"), n.cast("long").alias("shared"), F.lit(1.0).alias("jaccard"), F.col("mt").isNotNull().alias("mt_match"))
    blocks = kinds.where("mt IS NOT NULL").groupBy("terminal", "mt").agg(F.sum("members").alias("members"))
    return Duplicates(blocks, members, alike.unionByName(common).unionByName(own))


def duplicate_candidates(sets: DataFrame, samples: DataFrame, shared: int = 3, least: float = 0.5) -> DataFrame:
    """(a, b, shared, jaccard, mt_match, score) of every two samples that `duplicate_blocks` tells: 0.6 J + 0.4 for equal mt.

    This is the long form, with a row for each pair of a block; where blocks are large, take the other.
    Samples of a terminal meet in tiles: pairs are told by the task that makes them, and none is shuffled.
    """
    held = sets.where("variant_id IS NOT NULL").groupBy("sample_id").agg(F.array_sort(F.collect_set("variant_id")).alias("v"))  # one sample's variants
    filled = samples.select("sample_id", "terminal", "mt").dropna(subset=["sample_id", "terminal"]).join(held.hint("merge"), "sample_id", "left")
    filled = cut_lineage(filled.withColumn("v", F.coalesce("v", F.array().cast(f"array<{sets.schema['variant_id'].dataType.simpleString()}>"))))
    placed = filled.join(filled.groupBy("terminal").agg(F.ceil(F.count("*") / SIDE).alias("_tiles")), "terminal")
    schema = StructType([*[StructField(c, samples.schema["sample_id"].dataType) for c in "ab"], StructField("shared", LongType()), StructField("jaccard", DoubleType()), StructField("mt_match", BooleanType())])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        size = table["v"].combine_chunks().value_lengths().to_numpy()
        mt = pc.fill_null(table["mt"].combine_chunks().dictionary_encode().indices, -1).to_numpy()

        def tell(both: np.ndarray, x: np.ndarray, y: np.ndarray) -> Told:
            alike = both / np.maximum(size[x][:, None].astype(np.float64) + size[y][None, :] - both, 1)
            match = (mt[x][:, None] == mt[y][None, :]) & (mt[x][:, None] >= 0)
            return match | ((both >= shared) & (alike >= least)), (both, alike, match)

        for ids, _, a, b, (n, alike, match) in _tile_pairs(key, table, tell):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(n.astype(np.int64)), pa.array(alike), pa.array(match)], names=schema.names)

    pairs = tiled(placed, ["terminal"], "mt").applyInArrow(run, schema)
    return pairs.withColumn("score", F.least(F.lit(1.0), 0.4 * F.col("mt_match").cast("double") + 0.6 * F.col("jaccard")))


def population_overlap(shares: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sum of the lesser shares of each pair (a, b); a sample has one row for each population.

    A sample's shares are one row of numbered populations, so a pair is one row all the way and its
    sum needs no shuffle.  Pairs leave the first join in the order of a: equal shares lie together
    and compress; the second join hashes the samples, so that these wide rows are never sorted.
    """
    shares = cut_lineage(shares.where("population IS NOT NULL").select("sample_id", "population", F.coalesce("pct", F.lit(float("inf"))).alias("pct")))
    codes = numbered(shares.select("population").distinct(), "code", 0, "population")
    held = shares.join(codes, "population").groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("code").cast("int"), "pct"))).alias("m"))
    rows = pairs.groupBy("a", "b").agg(F.count("*").alias("times"))
    x, y = held.select(F.col("sample_id").alias("a"), F.col("m").alias("ma")), held.select(F.col("sample_id").alias("b"), F.col("m").alias("mb"))
    met = rows.hint("merge").join(x, "a").join(y.hint("shuffle_hash"), "b")
    # an unknown share (infinite) leaves the other; where both are, nothing is added
    lesser = F.map_values(F.map_zip_with("ma", "mb", lambda k, p, q: F.when(p.isNotNull() & q.isNotNull(), F.least(p, q))))
    met = met.select("a", "b", "times", F.filter(lesser, lambda v: v.isNotNull()).alias("v")).where(F.size("v") > 0)
    known = F.filter("v", lambda v: v != float("inf"))
    return met.select("a", "b", F.when(F.size(known) > 0, F.col("times") * F.aggregate(known, F.lit(0.0), lambda total, v: total + v)).alias("overlap"))


def rare_shares(shares: DataFrame, least: float) -> DataFrame:
    """shares and whether each is `rare`: a sample holds `least` or more from it on, in the order of `overlap_pairs`."""
    seen = shares.groupBy("population").agg(F.count("*").alias("_n"))
    rest = F.sum("pct").over(Window.partitionBy("sample_id").orderBy(F.desc("_n"), F.desc("population")))
    # sums that miss the bound by rounding alone still meet; the overlap itself decides
    return shares.join(seen, "population").withColumn("rare", F.coalesce(rest >= least - 1e-9, F.lit(False))).select("sample_id", "population", "pct", "rare")


def overlap_pairs(shares: DataFrame, blocks: DataFrame, least: float) -> DataFrame:
    """(a, b, overlap) of samples of one block whose common shares come to `least` or more.

    shares: (sample_id, population, pct); blocks: (sample_id, block).  With populations in one
    order, rare first, the first that two samples have in common bounds their overlap by what
    each holds from there on.  So only samples meet that agree on a population from which on both
    hold `least`; the last ones, which everyone has a little of, bring nobody together.
    """
    prefix = rare_shares(shares, least).where("rare").join(blocks, "sample_id").select("block", "population", "sample_id")
    x, y = prefix.withColumnRenamed("sample_id", "a"), prefix.withColumnRenamed("sample_id", "b")
    near = x.join(y, ["block", "population"]).where("a < b").select("a", "b").distinct()
    return population_overlap(shares, near).where(F.round("overlap", 9) >= least)  # the order of a sum decides nothing


def best_overlap_pairs(shares: DataFrame, blocks: DataFrame, terminals: DataFrame, least: float, most: int, weight: float, same: float, side: int = 1024, across: int = 1 << 16) -> DataFrame:
    """(a, b), a < b, of samples of one block: all that are among the `most` best of either by weight x overlap, and same x score for an equal terminal.

    shares: (sample_id, population, pct); blocks: (sample_id, block); terminals: (sample_id,
    terminal, score).  Only overlaps of `least` or more count; ties go to the lesser id.  Every
    two samples of a block are looked at, `side` of them against `across` others in one task,
    which tells each sample's best: pairs are no rows but for these.  More may be returned.
    """
    known = rare_shares(shares.where("population IS NOT NULL"), least)
    held = known.groupBy("sample_id").agg(F.collect_list(F.struct("population", F.coalesce("pct", F.lit(float("inf"))).alias("pct"), "rare")).alias("v"))  # one sample's shares
    placed = blocks.select("sample_id", "block").dropna().distinct().join(held, "sample_id").join(terminals.select("sample_id", "terminal", "score"), "sample_id", "left")
    placed = cut_lineage(placed)
    n = placed.groupBy("block").agg(F.ceil(F.count("*") / side).alias("_is"), F.ceil(F.count("*") / across).alias("_js"))
    rows = placed.join(n, "block")
    at, every = (lambda c: F.pmod(F.xxhash64("sample_id"), F.col(c))), (lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)))
    columns = ["block", "sample_id", "v", "terminal", "score"]
    x = rows.select(*columns, F.lit(True).alias("seeks"), at("_is").alias("_i"), every("_js").alias("_j"))
    y = rows.select(*columns, F.lit(False).alias("seeks"), every("_is").alias("_i"), at("_js").alias("_j"))
    schema = StructType([StructField(c, placed.schema["sample_id"].dataType) for c in "ab"])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("sample_id")
        seeks, ids = table["seeks"].to_numpy(), table["sample_id"].combine_chunks()
        one, two = np.flatnonzero(seeks), np.flatnonzero(~seeks)
        rank = ids.dictionary_encode().indices.to_numpy()
        home = pc.fill_null(table["terminal"].combine_chunks().dictionary_encode().indices, -1).to_numpy()
        bonus = same * pc.fill_null(table["score"].combine_chunks(), 0.0).to_numpy(zero_copy_only=False)
        lists = table["v"].combine_chunks()
        entries, owner = lists.flatten(), np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        population, pct = entries.field("population").dictionary_encode().indices.to_numpy(), entries.field("pct").to_numpy(zero_copy_only=False)
        rare, unknown = entries.field("rare").to_numpy(zero_copy_only=False), bool(np.isinf(pct).any())
        order = np.argsort(population, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(population[order])) + 1)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, (1 << 20) // max(1, len(two)))
        for low in range(0, len(one) if len(two) else 0, step):
            p = one[low : low + step]
            total, met = np.zeros((len(p), len(two))), np.full((len(p), len(two)), not unknown)
            for g in groups:
                share = np.zeros(len(ids))
                share[owner[g]] = pct[g]
                if share[p].any():
                    lesser = np.minimum(share[p][:, None], share[two][None, :])
                    if unknown:  # an unknown share leaves the other, but brings nobody together
                        lesser[np.isinf(lesser)] = 0.0
                        known = np.zeros(len(ids), dtype=bool)
                        known[owner[g]] = rare[g]
                        met |= known[p][:, None] & known[two][None, :]
                    total += lesser
            fits = met & (total >= least - 1e-8) & (rank[p][:, None] != rank[two][None, :])
            total = np.round(weight * total + np.where((home[p][:, None] == home[two][None, :]) & (home[p][:, None] >= 0), bonus[p][:, None], 0.0), 9)
            total[~fits] = -np.inf
            if len(two) > most:
                bound = np.partition(total, len(two) - most, axis=1)[:, len(two) - most][:, None]
                above, tied = total > bound, total == bound
                fits &= above | (tied & (tied.cumsum(axis=1) <= most - above.sum(axis=1, keepdims=True)))
            u, w = np.nonzero(fits)
            found.append((np.minimum(p[u], two[w]), np.maximum(p[u], two[w])))
        a, b = (np.concatenate([f[k] for f in found] or [np.empty(0, dtype=np.int64)]) for k in (0, 1))
        return pa.table([ids.take(pa.array(a)), ids.take(pa.array(b))], names=schema.names)

    return in_parts(x.unionByName(y), "block", "_i", "_j").groupBy("block", "_i", "_j").applyInArrow(run, schema).distinct()


def symmetric_edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))


def two_hop_join(pairs: DataFrame, least: int = 1) -> DataFrame:
    """Pairs with at least so many third parties in common."""
    e = symmetric_edges(pairs).distinct()
    return e.select(F.col("x").alias("a"), "y").join(e.select(F.col("x").alias("b"), "y"), "y").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def attestation_consensus(claims: DataFrame) -> DataFrame:
    """Per pair: one party PENDING; disputes or claims apart DISPUTED; else CONFIRMED at the mean."""
    g = claims.groupBy("a", "b").agg(F.countDistinct("party").alias("parties"), F.min("cm").alias("lo"), F.max("cm").alias("hi"), F.avg("cm").alias("cm"), F.max("disputed").alias("disputed"))
    status = F.when(F.col("disputed"), "DISPUTED").when(F.col("parties") < 2, "PENDING").when(scalars.cm_agree(F.col("lo"), F.col("hi")), "CONFIRMED").otherwise("DISPUTED")
    return g.select("a", "b", "parties", F.when(status == "CONFIRMED", F.col("cm")).alias("cm"), status.alias("status"))


def assign_and_prune(desired: DataFrame, existing: DataFrame, keys: list[str], values: list[str], owned: Column) -> DataFrame:
    """Changes that make `existing` hold `desired`: I, U, D or K (kept) per key; rows that `owned` denies are never touched."""
    d = desired.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("_want"))
    e = existing.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], owned.alias("_owned"), F.lit(True).alias("_have"))
    both = d.join(e, keys, "full_outer")
    same = F.lit(True)
    for v in values:
        same &= F.col(f"new_{v}").eqNullSafe(F.col(f"old_{v}"))
    change = (
        F.when(F.col("_have").isNull(), "I").when(~F.col("_owned") | same & F.col("_want").isNotNull(), "K").when(F.col("_want").isNull(), "D").otherwise("U")
    )
    final = [F.when(change.isin("I", "U"), F.col(f"new_{v}")).otherwise(F.col(f"old_{v}")).alias(v) for v in values]
    return both.select(*keys, *final, change.alias("change"))


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str], overwrite: bool) -> DataFrame:
    """Full join by key: new values over old ones, or old ones filled from new."""
    values = [c for c in old.columns if c not in keys]
    o, n = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in values]), new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in values])
    first, second = ("n", "o") if overwrite else ("o", "n")
    return o.join(n, keys, "full_outer").select(*keys, *[F.coalesce(f"{first}_{c}", f"{second}_{c}").alias(c) for c in values])


def merge_overwrite(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return merge_rows(old, new, keys, True)


def merge_gap_fill(old: DataFrame, new: DataFrame, keys: list[str], unique: str | None = None) -> DataFrame:
    """Old rows with their gaps filled from new ones, and new rows.

    `unique`: a column in which no value may come twice, as a DOI.  A value that an old row has is
    not given to another, and one that several rows would get goes to the first of them by key;
    the others are left without.
    """
    out = merge_rows(old, new, keys, False)
    if unique is None:
        return out
    held = old.where(F.col(unique).isNotNull()).select(*keys, F.lit(True).alias("_own"))
    marked = out.join(held, keys, "left").withColumn("_own", F.coalesce("_own", F.lit(False)))
    first = F.row_number().over(Window.partitionBy(unique).orderBy(F.desc("_own"), *keys))
    ranked = marked.where(F.col(unique).isNotNull()).withColumn("_n", first)
    fine = ranked.withColumn(unique, F.when(F.col("_own") | (F.col("_n") == 1), F.col(unique))).drop("_n")
    return fine.unionByName(marked.where(F.col(unique).isNull())).drop("_own").select(*out.columns)


def snapshot_delta(today: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of today that the snapshot before didn't hold."""
    key = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in today.columns]), 256)
    return today.withColumn("_h", key).join(before.select(key.alias("_h")), "_h", "left_anti").drop("_h")


def prefer_primary_source(rates: DataFrame) -> DataFrame:
    """One row per marker: the source of least priority number."""
    w = Window.partitionBy("marker").orderBy("priority", "source")
    return rates.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def repoint(df: DataFrame, key: str, mapping: DataFrame, unique: list[str] | None = None) -> DataFrame:
    """Rows whose key was merged (mapping old, new) point to the survivor; with `unique` colliding ones drop out."""
    out = df.join(mapping.select(F.col("old").alias(key), "new"), key, "left").withColumn(key, F.coalesce("new", key)).drop("new")
    return out.dropDuplicates(unique) if unique else out


def combine_inverse_variance(terms: DataFrame) -> DataFrame:
    """Weighted mean and sigma per node; a sigma of 0 or less is a quarter of the age, 1 at least."""
    s = F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.greatest(F.abs("ybp") * 0.25, F.lit(1.0)))
    weight = 1 / (s * s)
    return terms.groupBy("node_id").agg((F.sum(weight * F.col("ybp")) / F.sum(weight)).alias("ybp"), (1 / F.sqrt(F.sum(weight))).alias("sigma"), F.count("*").alias("n"))


def str_distance(profiles: DataFrame, motifs: DataFrame) -> DataFrame:
    """(sample_id, node_id, distance, compared) over shared markers, for every sample and node that share one.

    Values (repeats, modal) are numbers, or arrays where markers have several copies: then copies
    are compared in order of size, and markers whose copies differ in number are left out.
    Samples with equal profiles are compared once.
    """
    own, their = profiles.select("sample_id", "marker", F.col("repeats").alias("r")), motifs.select("node_id", "marker", "modal")
    several = own.schema["r"].dataType.simpleString().startswith("array")
    alike = own.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("marker", "r"))).alias("profile"))  # one sample's markers
    kinds = alike.groupBy("profile").agg(F.min("sample_id").alias("kind"))
    markers = kinds.select("kind", F.explode("profile").alias("m")).select("kind", "m.marker", "m.r")
    both = markers.join(their, "marker")
    if several:
        both = both.where(F.size("r") == F.size("modal")).withColumn("_d", F.aggregate(F.zip_with(F.array_sort("r"), F.array_sort("modal"), lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda x, y: x + y))
    else:
        both = both.withColumn("_d", F.abs(F.col("r") - F.col("modal")))
    near = both.groupBy("kind", "node_id").agg(F.sum("_d").alias("distance"), F.count("*").alias("compared"))
    return alike.join(kinds, "profile").select("sample_id", "kind").join(near, "kind").select("sample_id", "node_id", "distance", "compared")


def str_predict(profiles: DataFrame, motifs: DataFrame, most: int = 3) -> DataFrame:
    """Nearest branches with at least min(profile size, 8) markers compared."""
    size = profiles.groupBy("sample_id").agg(F.least(F.greatest(F.count("*"), F.lit(1)), F.lit(8)).alias("needed"))
    near = str_distance(profiles, motifs).join(size, "sample_id").where("compared >= needed")
    w = Window.partitionBy("sample_id").orderBy("distance", F.desc("compared"), "node_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("sample_id", "node_id", "distance", "compared", "rank")


def str_branch_mutations(motifs: DataFrame, edges: DataFrame) -> DataFrame:
    """Motif values of a node beside its parent's, and whether they differ."""
    child = motifs.select(F.col("node_id").alias("child_id"), "marker", F.col("modal").alias("value"))
    parent = motifs.select(F.col("node_id").alias("parent_id"), "marker", F.col("modal").alias("parent_value"))
    return child.join(edges.select("child_id", "parent_id"), "child_id").join(parent, ["parent_id", "marker"]).select(F.col("child_id").alias("node_id"), "marker", "value", "parent_value", (F.col("value") != F.col("parent_value")).alias("changed"))


def ancestry_blocks(samples: DataFrame, cell: float = 0.5) -> DataFrame:
    """(sample_id, dominant, block): the dominant value and the cells, half a sigma wide, of two standardised coordinates.

    Rows without both coordinates are in the block `nopca` of their dominant value (`?` for none)
    and don't count for mean and sigma; a column without spread has all of its rows in cell 0.
    """
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    stats = samples.where(placed).agg(*[f(c).alias(name + c) for c in ("x", "y") for f, name in ((F.avg, "m"), (F.stddev_pop, "s"))])
    z = samples.crossJoin(F.broadcast(stats))  # one row

    def at(c: str) -> Column:
        return F.round((F.col(c) - F.col(f"m{c}")) / F.greatest(F.col(f"s{c}"), F.lit(1e-9)) / cell).cast("long").cast("string")

    return z.select("sample_id", "dominant", F.concat_ws(":", F.coalesce("dominant", F.lit("?")), F.when(placed, F.concat_ws(":", at("x"), at("y"))).otherwise("nopca")).alias("block"))
