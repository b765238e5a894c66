"""Best-fit packing of tokenised documents with a grouping genetic algorithm.

Documents become token ids and one end id; only longer ones are cut, into full sequences.
The remaining pieces are packed by a grouping genetic algorithm: a genome is a set of bins,
crossover injects whole well-filled bins of one parent into the other, bins that then hold a
piece twice are opened, and their pieces go to the best-fitting bins.  Shards of pieces evolve
on several islands each; after a round an island sends its elite to the next.  Bins that are
full enough stay; the pieces of the others are dealt anew to as many shards as they fill, round
after round, until one shard is left.  A shard's size never grows with the corpus: a round that
leaves over half of its pieces widens the slack of the next ones.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, byte_rows, write_table


@dataclass(frozen=True)
class Settings:
    capacity: int = 2048
    end_id: int = 0
    #: pieces of a shard; shards are dealt by hash, so this is their mean
    shard: int = 1500
    islands: int = 2
    migrations: int = 1
    population: int = 4
    generations: int = 4
    #: bins with at most so much room stay after a round, at first
    slack: int = 0
    word_cache: int = 300_000
    seed: int = 5


def byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write each byte as a printable letter: itself where it prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + k for k, b in enumerate(rest)}


class Ids(dict):
    """Word -> little-endian 32-bit ids, filled as words are asked for.

    The table has two generations: a full one becomes the old one, and what is still used moves
    to the new one, so frequent words stay and memory is bounded.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        self[word] = ids
        return ids


def splits_words(tokenizer) -> bool:
    """Does this tokenizer work word by word, as WordEncoder does?  Tried on its own normaliser, split and model."""
    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None:
        return False
    normal, split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
    try:
        lowered = normal("Abc \u00c9t\u00e9 X.") == "abc \u00e9t\u00e9 x."
        parts = [x for x, _ in split(normal("Abc, \u00c9t\u00e9\t(x)"))]
        letters = byte_letters()
        apart = parts == ["abc", ",", "\u00e9t\u00e9".encode().decode("latin-1").translate(letters), "(", "x", ")"]
        words = "Hello, World \u00fcber 42nd x-ray\n don't"
        whole = tokenizer.encode(words, add_special_tokens=False).ids
        return lowered and apart and whole == [i for w in words.split() for i in tokenizer.encode(w, add_special_tokens=False).ids]
    except Exception:  # a tokenizer of another kind may refuse such probes
        return False


class WordEncoder:
    """Ids of whole texts, word by word.

    The tokenizer drops white space and no token spans it, so the ids of a text are those of
    its blank-separated words in a row.  A word that is a run of letters and a run of signs is
    these two tokens of the tokenizer's first split; others go through the whole tokenizer.
    A tokenizer that doesn't work so (`splits_words`) gets whole texts.
    """

    #: A run of letters that lower() maps one to one, and a run of signs.
    PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-}]*)")

    def __init__(self, path: str, cache: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.apart = splits_words(self.tokenizer)
        self.letters = byte_letters()
        self.words, self.cores, self.signs = Ids(self.word, cache), Ids(self.merge, 2 * cache), Ids(self.whole, cache)

    def whole(self, word: str) -> bytes:
        """By the whole tokenizer."""
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def merge(self, core: str) -> bytes:
        """Ids of one lower-case run of letters: the tokenizer's merges alone, on its letters for bytes."""
        if not core.isascii():
            core = core.encode().decode("latin-1").translate(self.letters)
        return b"".join([x.id.to_bytes(4, "little") for x in self.model.tokenize(core)])

    def word(self, word: bytes) -> bytes:
        if word.isalpha():
            return self.cores[word.lower().decode()]
        text = word.decode()
        m = self.PLAIN.fullmatch(text)
        if m is None:
            return self.whole(text)
        core, signs = m.groups()
        return self.cores[core.lower()] + self.signs[signs] if signs else self.cores[core.lower()]

    def ids(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not self.apart:
            return self.whole(text.decode())
        return b"".join(map(self.words.__getitem__, text.split()))


PIECE = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, settings: Settings, text: str = "text") -> DataFrame:
    """A row per piece: its document, place, length and the checksum of its ids."""
    capacity, end_id, cache = settings.capacity, settings.end_id, settings.word_cache
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), body(text).alias("body"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer, cache)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "copy", "piece", "start", "length", "ids_crc32")}
            for doc_id, copy, text in zip(batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist(), byte_rows(batch, "body"), strict=True):
                ids = encoder.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for name, value in zip(out, (doc_id, copy, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    return rows.mapInArrow(run, PIECE)


class Packer:
    """Packings of one shard. Sizes descend; a packing is a list of bins, a bin a list of indices."""

    def __init__(self, sizes: np.ndarray, settings: Settings, rng: np.random.Generator):
        self.sizes = sizes.tolist()
        self.settings = settings
        self.rng = rng

    def room(self, bin_: list[int]) -> int:
        return self.settings.capacity - sum(self.sizes[i] for i in bin_)

    def best_fit(self, bins: list[list[int]], loose: list[int]) -> list[list[int]]:
        """Each loose piece, in the order given, into the fullest bin that takes it."""
        bins = [b.copy() for b in bins]
        rooms = sorted((r, k) for k, r in enumerate(map(self.room, bins)) if r)
        for i in loose:
            size = self.sizes[i]
            at = bisect_left(rooms, (size, -1))
            if at < len(rooms):
                room, k = rooms.pop(at)
                bins[k].append(i)
            else:
                room, k = self.settings.capacity, len(bins)
                bins.append([i])
            if room > size:
                insort(rooms, (room - size, k))
        return bins

    def fitness(self, bins: list[list[int]]) -> tuple[float, float]:
        """Fewer bins first, then the fuller ones unevenly full (which leaves one open remainder)."""
        fill = [1 - self.room(b) / self.settings.capacity for b in bins]
        return -len(bins), sum(f * f for f in fill)

    def crossover(self, one: list[list[int]], other: list[list[int]]) -> list[list[int]]:
        """Well-filled bins of `other` injected into `one`; bins they break are opened and their rest best-fitted."""
        full = sorted((self.room(b), k) for k, b in enumerate(other))
        n = max(1, len(full) // 4)
        at = int(self.rng.integers(0, max(1, n)))
        chosen = [other[k] for _, k in full[at : at + n]]
        taken = {i for b in chosen for i in b}
        kept, loose = [], []
        for b in one:
            if taken.isdisjoint(b):
                kept.append(b)
            else:
                loose.extend(i for i in b if i not in taken)
        loose.sort()
        return self.best_fit(chosen + kept, loose)

    def mutated(self, bins: list[list[int]]) -> list[list[int]]:
        """A few of the emptiest bins and some others opened and packed again."""
        order = sorted(range(len(bins)), key=lambda k: -self.room(bins[k]))
        n = max(1, len(bins) // 50)
        opened = set(order[:n]) | set(self.rng.choice(len(bins), n).tolist())
        loose = sorted(i for k in opened for i in bins[k])
        return self.best_fit([b for k, b in enumerate(bins) if k not in opened], loose)

    def evolve(self, guests: list[list[list[int]]]) -> list[list[int]]:
        """The elite after the settings' generations."""
        n = len(self.sizes)
        population = guests + [self.best_fit([], list(range(n)))]
        floor = -(-sum(self.sizes) // self.settings.capacity)
        while len(population) < self.settings.population:
            # nearly descending orders: descending sizes with noise
            noise = np.array(self.sizes) * self.rng.uniform(0.9, 1.0, n)
            population.append(self.best_fit([], np.argsort(-noise, kind="stable").tolist()))
        scored = sorted(((self.fitness(p), k) for k, p in enumerate(population)), reverse=True)
        ranked = [population[k] for _, k in scored]
        for _ in range(self.settings.generations):
            if len(ranked[0]) <= floor:
                break
            parents = ranked[: max(2, len(ranked) // 2)]
            children = [self.mutated(self.crossover(parents[int(self.rng.integers(len(parents)))], parents[int(self.rng.integers(len(parents)))])) for _ in range(len(ranked) // 2)]
            pool = parents + children
            scored = sorted(((self.fitness(p), k) for k, p in enumerate(pool)), reverse=True)
            ranked = [pool[k] for _, k in scored][: self.settings.population]
        return ranked[0]


ISLAND = "shard int, island int, unit long, copy long, piece int, length long, guest int, own int"


def island_round(settings: Settings, round_: int):
    """One stay on an island: start from the guests that came, evolve, and give the elite's bins."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        group = group.sort_values(["length", "copy", "piece"], ascending=[False, True, True], kind="stable")
        rng = np.random.default_rng([settings.seed, round_, shard, island])
        packer = Packer(group["length"].to_numpy(), settings, rng)
        guests = []
        for column in ("guest", "own"):
            if (group[column] >= 0).all():
                bins: dict[int, list[int]] = {}
                for i, k in enumerate(group[column].tolist()):
                    bins.setdefault(k, []).append(i)
                guests.append(list(bins.values()))
        best = packer.evolve(guests)
        own = np.empty(len(group), dtype=np.int64)
        room = np.empty(len(group), dtype=np.int64)
        for k, b in enumerate(best):
            own[b] = k
            room[b] = packer.room(b)
        return group.assign(own=own, room=room, bins=len(best))[["shard", "island", "copy", "piece", "length", "own", "room", "bins"]]

    return run


ELITE = "shard int, island int, copy long, piece int, length long, own int, room long, bins int"


def evolve_shards(small: DataFrame, shards: int, level: int, settings: Settings) -> DataFrame:
    """Bins of every shard's best island: (copy, piece, length, shard, own, room)."""
    dealt = small.select("copy", "piece", "length", F.pmod(F.xxhash64("copy", "piece", F.lit(level)), F.lit(shards)).cast("int").alias("shard"))
    state = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(settings.islands - 1))).alias("island")).withColumns({"guest": F.lit(-1), "own": F.lit(-1)})
    elite = None
    for round_ in range(settings.migrations + 1):
        elite = write_table(state.groupBy("shard", "island").applyInPandas(island_round(settings, 100 * level + round_), ELITE), "islands")
        if round_ < settings.migrations:
            moved = elite.select("shard", ((F.col("island") + 1) % settings.islands).cast("int").alias("island"), "copy", "piece", F.col("own").alias("guest"))
            state = elite.select("shard", "island", "copy", "piece", "length", "own").join(moved, ["shard", "island", "copy", "piece"])
    best = elite.groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("best")).select("shard", "best.island")
    return elite.join(best, ["shard", "island"]).select("copy", "piece", "length", "shard", "own", "room")


def pack(docs: DataFrame, tokenizer: str, settings: Settings | None = None, text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    A null or empty text is its end id alone.  Repeated rows are packed each for itself; a null
    doc_id stays null.  An empty table gives no rows.  Bins that are full but for `slack` tokens
    are done; the others' pieces meet again in fewer shards.  Where a round leaves more than half
    of its pieces the slack widens eightfold, so that rounds end: a bin closed in such a round
    can waste that slack, the price of never holding all pieces in one task.
    """
    settings = settings or Settings()
    cut = write_table(pieces(docs, tokenizer, settings, text), "pieces")
    small = cut.where(F.col("length") < settings.capacity).select("copy", "piece", "length")
    done = cut.where(F.col("length") >= settings.capacity).select("copy", "piece", "length", F.lit(-1).alias("level"), F.lit(0).alias("shard"), F.xxhash64("copy", "piece").alias("own"))
    done = done.select("copy", "piece", "length", F.concat_ws("-", F.lit("f"), "copy", "piece").alias("bin"))
    n, level, slack = small.count(), 0, settings.slack
    while n:
        shards = -(-n // settings.shard)
        bins = write_table(evolve_shards(small, shards, level, settings), "bins")
        named = bins.withColumn("bin", F.concat_ws("-", F.lit(str(level)), "shard", "own"))
        if shards == 1:
            done = done.union(named.select("copy", "piece", "length", "bin"))
            break
        done = done.union(named.where(F.col("room") <= slack).select("copy", "piece", "length", "bin"))
        small = bins.where(F.col("room") > slack).select("copy", "piece", "length")
        before, n = n, small.count()
        level += 1
        # a shard never grows; rounds end because each one halves what is left or widens the slack, up to a whole bin
        if 2 * n > before:
            slack = max(8, 8 * slack)
    placed = done.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct(-F.col("length"), "copy", "piece", "length"))).alias("held"))  # at most a sequence's tokens
    # numbers are written with their bins, so each bin keeps its own however often a task runs
    placed = write_table(placed.select(F.monotonically_increasing_id().alias("sequence_id"), "held"), "sequences")
    placed = placed.select("sequence_id", "held", F.posexplode("held").alias("at", "x"))
    offset = F.aggregate(F.slice("held", 1, F.col("at")), F.lit(0).cast("long"), lambda acc, x: acc + x["length"])
    placed = placed.select("sequence_id", "x.copy", "x.piece", offset.alias("offset"))
    return cut.join(placed, ["copy", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
