"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision (a node of the byte's binary tree) has a
context tree over the preceding bytes.  Every context keeps a Krichevsky-Trofimov estimate,
and weighting mixes the estimates of all depths with the posterior odds that the training
counts give them.  A context that training never saw says nothing: the depth above decides.

The probability of a byte depends only on the byte and the `depth` bytes before it, so Spark
works on distinct grams of depth+1 bytes.

1. A count of contexts finds the frequent ones: those with more than a bucket's share of all
   bytes.  They are split at the next byte, so the trees are cut into subtrees none of which
   is large; what lies above the cuts is bounded by the share, at any scale.
2. Each chunk of documents sends its distinct grams (with training counts) to the buckets of
   their subtrees.  A bucket's chunks come in parts of bounded size; each part merges equal
   grams before the bucket sees them.
3. A bucket holds whole subtrees: it sums counts, weights them and answers its parts, and they
   answer each chunk for just the grams that it asked for.

Words for the unigram base travel the same way.  No table of grams or words is ever broadcast.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Chunk, chunk_rows, chunked, pack_numbers, squeeze, unpack_numbers, unsqueeze, write_table

END = b"\n"


@dataclass(frozen=True)
class Settings:
    depth: int = 6
    chunk_bytes: int = 16 << 20
    #: bytes of a chunk that are taken apart at once, but for a single text that has more
    piece_bytes: int = 4 << 20
    #: bytes of text for each part of a bucket
    bucket_bytes: int = 8 << 20
    #: contexts above the cuts, at most, for each depth; more buckets than that come in parts
    most_cut: int = 4096
    #: grams that a bucket weights at once, but for a single subtree that has more
    block: int = 1 << 18


def lowered(text: bytes) -> list[bytes]:
    return text.lower().split()


@dataclass
class Stream:
    """Texts in a row: each its words, joined by one blank, and an end byte; ends stand before it as context."""

    data: bytes
    #: bytes that count, text by text
    sizes: np.ndarray
    depth: int

    def keys(self) -> np.ndarray:
        """Gram numbers, the nearest context byte highest and the byte itself lowest."""
        depth, data = self.depth, np.frombuffer(self.data, dtype=np.uint8)
        ends = np.cumsum(self.sizes + depth)
        real = np.ones(len(data), dtype=bool)
        real[((ends - self.sizes - depth)[:, None] + np.arange(depth)).ravel()] = False
        key = np.zeros(len(data), dtype=np.uint64)
        for k in range(1, depth + 1):
            key[k:] |= data[: len(data) - k].astype(np.uint64) << np.uint64(8 * (depth + 1 - k))
        key |= data
        return key[real]


def stream(texts: Iterable[bytes], depth: int) -> tuple[Stream, list[list[bytes]]]:
    words = [lowered(t) for t in texts]
    pad = END * depth
    parts = [pad + b" ".join(w) + END for w in words]
    return Stream(b"".join(parts), np.array([len(p) - depth for p in parts], dtype=np.int64), depth), words


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending without repeats, and how often each stands there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def pieces(chunk: Chunk, size: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """A chunk's texts in runs of about `size` bytes: (first row, row after the last, texts)."""
    at = 0
    while at < len(chunk):
        begun = int(chunk.ends[at] - chunk.lengths[at])
        stop = max(at + 1, int(np.searchsorted(chunk.ends, begun + size, side="right")))
        cuts = [begun, *chunk.ends[at:stop].tolist()]
        yield at, stop, [chunk.blob[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        at = stop


def tally(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, ascending, and how often each stands in training."""
    seen, n = distinct(keys[training])
    other = distinct(keys[~training])[0]
    other = other[~contains(seen, other)]
    both = np.concatenate([seen, other])
    order = np.argsort(both, kind="stable")
    return both[order], np.concatenate([n, np.zeros(len(other), dtype=n.dtype)])[order]


def contains(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys


def context_of(keys: np.ndarray, depth: int, length: int) -> np.ndarray:
    """The `length` nearest context bytes of each gram, the nearest highest."""
    return keys >> np.uint64(8 * (depth + 1 - length))


def frequent(settings: Settings, share: float):
    """For each piece of text its contexts of 2 to depth-1 bytes that precede at least `share` of its bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chunk_rows(batches):
            lengths: list[int] = []
            contexts: list[int] = []
            counts: list[int] = []
            for _, _, texts in pieces(Chunk(row), settings.piece_bytes):
                keys = stream(texts, settings.depth)[0].keys()
                least = max(1, share * len(keys))
                pair = context_of(keys, settings.depth, 1).astype(np.int32)
                above = np.arange(256, dtype=np.uint64)
                for length in range(2, settings.depth):
                    step = pair * 256 + (context_of(keys, settings.depth, length) & np.uint64(0xFF)).astype(np.int32)
                    n = np.bincount(step, minlength=256 * len(above))
                    some = np.flatnonzero(n >= least)
                    if not len(some):
                        break
                    above = (above[some >> 8] << np.uint64(8)) | (some & 255).astype(np.uint64)
                    lengths += [length] * len(some)
                    contexts += above.astype(np.int64).tolist()
                    counts += n[some].tolist()
                    number = np.full(len(n), -1, dtype=np.int32)
                    number[some] = np.arange(len(some))
                    held = number[step]
                    keys, pair = keys[held >= 0], held[held >= 0]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), pa.array(contexts, pa.int64()), pa.array(counts, pa.int64())], names=["length", "context", "n"])

    return run


@dataclass(frozen=True)
class Cuts:
    """Contexts that are split, by length from 1 on, each ascending and with all their shorter ones."""

    split: tuple[np.ndarray, ...]

    def length(self, keys: np.ndarray, depth: int) -> np.ndarray:
        """Length of the context at which each gram's subtree is cut off."""
        out = np.ones(len(keys), dtype=np.int8)
        at = np.arange(len(keys))
        for length, contexts in enumerate(self.split, 1):
            at = at[contains(contexts, context_of(keys[at], depth, length))]
            out[at] = length + 1
        return out

    def bucket(self, keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
        length = self.length(keys, depth).astype(np.uint64)
        root = (keys >> (np.uint64(8) * (np.uint64(depth + 1) - length))) * np.uint64(8) + length
        root = (root ^ (root >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return ((root >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)


def cuts_of(rows: list, depth: int, least: float) -> Cuts:
    found: dict[int, list[int]] = {}
    for r in rows:
        if r["n"] >= least:
            found.setdefault(r["length"], []).append(r["context"])
    split = [np.arange(256, dtype=np.uint64)]
    split += [np.array(sorted(found.get(length, [])), dtype=np.uint64) for length in range(2, depth)]
    return Cuts(tuple(split))


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ascending grams with counts as one; they join pair by pair."""
    while len(parts) > 1:
        joined = []
        for k in range(0, len(parts) - 1, 2):
            keys = np.concatenate([parts[k][0], parts[k + 1][0]])
            counts = np.concatenate([parts[k][1], parts[k + 1][1]])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            joined.append((keys[first], np.add.reduceat(counts, first)))
        parts = joined + parts[len(parts) - len(parts) % 2 :]
    return parts[0]


ASK = "kind string, bucket int, chunk long, names binary, counts binary"
ASK_SCHEMA = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("names", pa.binary()), ("counts", pa.binary())])


def by_bucket(names: np.ndarray, settings: Settings, cuts: Cuts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of a chunk's grams by bucket, ascending in each; and the buckets in that order."""
    where = cuts.bucket(names, settings.depth, buckets)
    order = np.argsort(where, kind="stable")
    return order, where[order]


def asks(settings: Settings, cuts: Cuts, buckets: int):
    """For each chunk: its distinct grams and words, bucket by bucket, with training counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chunk_rows(batches):
            chunk = Chunk(row)
            lists = []
            learned: Counter[bytes] = Counter()
            others: set[bytes] = set()
            for at, stop, texts in pieces(chunk, settings.piece_bytes):
                text, words = stream(texts, settings.depth)
                lists.append(tally(text.keys(), np.repeat(~chunk.marks[at:stop], text.sizes)))
                for w, held in zip(words, chunk.marks[at:stop], strict=True):
                    if held:
                        others.update(w)
                    else:
                        learned.update(w)
                del text, words
            names, counts = summed(lists)
            order, where = by_bucket(names, settings, cuts, buckets)
            names, counts = names[order], counts[order]
            out: dict[str, list] = {name: [] for name in ASK_SCHEMA.names}

            def add(kind: str, bucket: int, names: bytes, counts: np.ndarray, out=out, chunk=chunk) -> None:
                for name, value in zip(out, (kind, bucket, chunk.number, names, squeeze(counts.astype(np.int64).tobytes())), strict=True):
                    out[name].append(value)

            for part in np.split(np.arange(len(where)), np.flatnonzero(np.diff(where)) + 1) if len(where) else []:
                add("gram", int(where[part[0]]), pack_numbers(names[part].view(np.int64)), counts[part])
            shares: dict[int, list[bytes]] = {}
            for w in sorted(learned.keys() | others):
                shares.setdefault(zlib.crc32(w) % buckets, []).append(w)
            for bucket, some in shares.items():
                add("word", bucket, squeeze(b"\n".join(some)), np.array([learned[w] for w in some]))
            yield pa.RecordBatch.from_pydict(out, schema=ASK_SCHEMA)

    return run


def words_of(data: bytes) -> list[bytes]:
    return unsqueeze(data).split(b"\n")


def merged_words(asked: list[dict]) -> Counter[bytes]:
    total: Counter[bytes] = Counter()
    for x in asked:
        for w, n in zip(words_of(x["names"]), counts_of(x["counts"]).tolist(), strict=True):
            total[w] += n
    return total


def merged_grams(asked: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return summed([(unpack_numbers(x["names"]).view(np.uint64), counts_of(x["counts"])) for x in asked])


PART = "kind string, bucket int, part int, names binary, counts binary"


def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One list of distinct grams or words for each part of a bucket."""
    for row in chunk_rows(batches):
        if row["kind"] == "word":
            total = merged_words(row["asked"])
            some = sorted(total)
            names, counts = squeeze(b"\n".join(some)), np.array([total[w] for w in some], dtype=np.int64)
        else:
            keys, counts = merged_grams(row["asked"])
            names = pack_numbers(keys.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["kind"]]), pa.array([row["bucket"]], pa.int32()), pa.array([row["part"]], pa.int32()), pa.array([names], pa.binary()), pa.array([squeeze(counts.astype(np.int64).tobytes())], pa.binary())],
            names=["kind", "bucket", "part", "names", "counts"],
        )


def counts_of(data: bytes) -> np.ndarray:
    return np.frombuffer(unsqueeze(data), dtype=np.int64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.where(x < 8, np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5) + np.log(x + 6) + np.log(x + 7), 0)
    y = np.where(x < 8, x + 8, x)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1.0)


class Level:
    """Contexts of one length over some grams: the grams' (context, byte) in ascending order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, length: int):
        pairs = (context_of(keys, depth, length) << np.uint64(8)) | (keys & np.uint64(0xFF))
        self.order = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.order]
        self.counts = counts[self.order].astype(np.float64)

    def nodes(self, bit: int) -> Nodes:
        byte = self.pairs & np.uint64(0xFF)
        names = (self.pairs & ~np.uint64(0xFF)) | np.uint64(1 << bit) | (byte >> np.uint64(8 - bit))
        one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        new = np.append(True, names[1:] != names[:-1])
        first = np.flatnonzero(new)
        at = np.empty(len(names), dtype=np.int64)
        at[self.order] = np.cumsum(new) - 1
        n1 = np.add.reduceat(np.where(one, self.counts, 0), first)
        n0 = np.add.reduceat(self.counts, first) - n1
        return Nodes(n0, n1, log_kt(n0, n1), None, names[first], at, self.order[first])


@dataclass
class Nodes:
    """Nodes of one length for one bit: counts, ln of the KT block probability, ln of the weighted children; and each gram's node, and a gram of each."""

    n0: np.ndarray
    n1: np.ndarray
    own: np.ndarray
    children: np.ndarray | None
    names: np.ndarray
    at: np.ndarray
    gram: np.ndarray

    def weighted(self) -> np.ndarray:
        return self.own if self.children is None else np.logaddexp(self.own, self.children) - np.log(2)


def walk(found: list[Level], bit: int) -> Iterator[Nodes]:
    """Nodes of one bit, from the longest contexts up, with the weights of what lies below."""
    last = None
    for level in found:
        nodes = level.nodes(bit)
        if last is not None:
            nodes.children = np.bincount(nodes.at[last.gram], weights=last.weighted(), minlength=len(nodes.names))
        yield nodes
        last = nodes


def subtrees(keys: np.ndarray, cuts: Cuts, settings: Settings) -> Iterator[tuple[int, np.ndarray]]:
    """(length of the cut, grams) for blocks of whole subtrees of a bucket's ascending grams."""
    lengths = cuts.length(keys, settings.depth)
    for length in range(2, settings.depth + 1):
        some = np.flatnonzero(lengths == length)
        roots_ = context_of(keys[some], settings.depth, length)
        starts = np.flatnonzero(np.append(True, roots_[1:] != roots_[:-1])) if len(some) else some
        at = 0
        while at < len(some):
            further = int(np.searchsorted(starts, at + settings.block, side="right")) - 1
            stop = int(starts[further]) if starts[further] > at else int(starts[further + 1]) if further + 1 < len(starts) else len(some)
            if at + settings.block >= len(some):
                stop = len(some)
            yield length, some[at:stop]
            at = stop


UPPER = "length int, context long, node long, n0 double, n1 double, children double"


def upper_nodes(settings: Settings, cuts: Cuts):
    """What a bucket's subtrees add to the nodes that they are cut from; and for words their number and sum."""
    fields = ["length", "context", "node", "n0", "n1", "children"]

    def rows(kind: str, asked: list[dict]) -> Iterator[pd.DataFrame]:
        if kind == "word":
            total = merged_words(asked)
            yield pd.DataFrame([[-1, 0, 0, float(sum(n > 0 for n in total.values())), float(sum(total.values())), 0.0]], columns=fields)
            return
        keys, counts = merged_grams(asked)
        for length, some in subtrees(keys, cuts, settings):
            found = [Level(keys[some], counts[some], settings.depth, k) for k in range(settings.depth, length - 2, -1)]
            for bit in range(8):
                for nodes in walk(found, bit):
                    pass
                yield pd.DataFrame(dict(zip(fields, (length - 1, (nodes.names >> np.uint64(8)).astype(np.int64), (nodes.names & np.uint64(0xFF)).astype(np.int64), nodes.n0, nodes.n1, nodes.children), strict=True)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chunk_rows(batches):
            for frame in rows(row["kind"], row["asked"]):
                yield pa.RecordBatch.from_pandas(frame.astype({"length": "int32"}), preserve_index=False)

    return run


@dataclass
class Roots:
    """What lies above the cuts, and the unigram totals: bounded by the cuts' share at any scale."""

    #: by context length: contexts x 256 nodes
    n0: list[np.ndarray]
    n1: list[np.ndarray]
    odds: list[np.ndarray]
    distinct: int
    total: int
    texts: int


def roots(rows: pd.DataFrame, cuts: Cuts, texts: int) -> Roots:
    words = rows[rows["length"] < 0]
    contexts = [np.zeros(1, dtype=np.uint64), *cuts.split]
    tables = [{k: np.zeros((len(c), 256)) for k in ("n0", "n1", "children")} for c in contexts]
    for length in range(len(contexts) - 1, -1, -1):
        some = rows[rows["length"] == length]
        at = np.searchsorted(contexts[length], some["context"].to_numpy().astype(np.uint64)), some["node"].to_numpy()
        table = tables[length]
        for name, values in table.items():
            np.add.at(values, at, some[name].to_numpy())
        own = log_kt(table["n0"], table["n1"])
        table["odds"] = own - table["children"]
        if length:
            up = np.searchsorted(contexts[length - 1], contexts[length] >> np.uint64(8))
            for name, values in (("n0", table["n0"]), ("n1", table["n1"]), ("children", np.logaddexp(own, table["children"]) - np.log(2))):
                np.add.at(tables[length - 1][name], up, values)
    distinct, total = int(words["n0"].sum()), int(words["n1"].sum())
    # the end is a token of every training text
    return Roots([t["n0"] for t in tables], [t["n1"] for t in tables], [t["odds"] for t in tables], distinct + bool(texts), total + texts, texts)


def kt(n0: np.ndarray, n1: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (np.where(one, n1, n0) + 0.5) / (n0 + n1 + 1)


def mixed(estimate: np.ndarray, odds: np.ndarray, below: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The estimate here and the mixture below, by the odds of stopping here; unseen contexts below don't count."""
    here = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
    return np.where(seen, here * estimate + (1 - here) * below, estimate)


def gram_log10(keys: np.ndarray, counts: np.ndarray, length: int, settings: Settings, cuts: Cuts, root: Roots) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context, for whole subtrees cut at `length`."""
    depth = settings.depth
    out = np.zeros(len(keys))
    byte = keys & np.uint64(0xFF)
    found = [Level(keys, counts, depth, k) for k in range(depth, length - 1, -1)]
    above = [(k, np.searchsorted(cuts.split[k - 1], context_of(keys, depth, k))) for k in range(length - 1, 0, -1)] + [(0, np.zeros(len(keys), dtype=np.int64))]
    for bit in range(8):
        one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        p = seen = None
        for nodes in walk(found, bit):
            at = nodes.at
            estimate = kt(nodes.n0[at], nodes.n1[at], one)
            p = estimate if p is None else mixed(estimate, (nodes.own - nodes.children)[at], p, seen)
            seen = (nodes.n0 + nodes.n1)[at] > 0
        node = ((1 << bit) | (byte >> np.uint64(8 - bit))).astype(np.int64)
        for k, row in above:
            n0, n1 = root.n0[k][row, node], root.n1[k][row, node]
            p = mixed(kt(n0, n1, one), root.odds[k][row, node], p, seen)
            seen = n0 + n1 > 0
        out += np.log10(p)
    return out


def bucket_values(settings: Settings, cuts: Cuts, held):
    """For each part of a bucket the log10 probabilities of its grams, or the corpus counts of its words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chunk_rows(batches):
            out = []
            if row["kind"] == "word":
                total = merged_words(row["asked"])
                out = [(x["part"], np.array([total[w] for w in words_of(x["names"])], dtype=np.int64)) for x in row["asked"]]
            else:
                keys, counts = merged_grams(row["asked"])
                logs = np.empty(len(keys), dtype=np.float32)
                for length, some in subtrees(keys, cuts, settings):
                    logs[some] = gram_log10(keys[some], counts[some], length, settings, cuts, held.value)
                out = [(x["part"], logs[np.searchsorted(keys, unpack_numbers(x["names"]).view(np.uint64))]) for x in row["asked"]]
            for part, values in out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["kind"]]), pa.array([row["bucket"]], pa.int32()), pa.array([part], pa.int32()), pa.array([values.tobytes()], pa.binary())],
                    names=["kind", "bucket", "part", "told"],
                )

    return run


TOLD = "kind string, bucket int, part int, told binary"


def part_answers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk of a part what it asked for: log probabilities in its own order, or words with counts."""
    for row in chunk_rows(batches):
        names: list[bytes | None] = []
        values: list[bytes] = []
        if row["kind"] == "word":
            lists = [words_of(x["names"]) for x in row["asked"]]
            count = dict(zip(sorted({w for some in lists for w in some}), np.frombuffer(row["told"], dtype=np.int64).tolist(), strict=True))
            names = [x["names"] for x in row["asked"]]
            values = [squeeze(np.array([count[w] for w in some], dtype=np.int64).tobytes()) for some in lists]
        else:
            lists = [unpack_numbers(x["names"]).view(np.uint64) for x in row["asked"]]
            keys = distinct(np.concatenate(lists))[0]
            logs = np.frombuffer(row["told"], dtype=np.float32)
            for some in lists:
                names.append(None)
                values.append(logs[np.searchsorted(keys, some)].tobytes())
        n = len(lists)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x["chunk"] for x in row["asked"]], pa.int64()), pa.array([row["kind"]] * n), pa.array([row["bucket"]] * n, pa.int32()), pa.array(names, pa.binary()), pa.array(values, pa.binary())],
            names=["chunk", "kind", "bucket", "names", "values"],
        )


ANSWER = "chunk long, kind string, bucket int, names binary, values binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double"


class Lookup:
    """Sparse hash table of gram numbers, probed for whole arrays."""

    FREE = np.uint64(2**64 - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, self.FREE)
        self.values = np.zeros(1 << bits, dtype=np.float32)
        at, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == self.FREE
            self.keys[at[free]] = keys[left[free]]
            mine = self.keys[at] == keys[left]
            self.values[at[mine]] = values[left[mine]]
            left, at = left[~mine], (at[~mine] + np.uint64(1)) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys that the table holds."""
        at = self.slot(keys)
        out = self.values[at]
        wrong = np.flatnonzero(self.keys[at] != keys)
        at = at[wrong]
        while len(wrong):
            at = (at + np.uint64(1)) & self.mask
            hit = self.keys[at] == keys[wrong]
            out[wrong[hit]] = self.values[at[hit]]
            wrong, at = wrong[~hit], at[~hit]
        return out


def scores(settings: Settings, cuts: Cuts, buckets: int, held):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = held.value
        for row in chunk_rows(batches):
            chunk = Chunk(row)
            logs, count = [], {}
            for x in sorted(row["answers"], key=lambda x: x["bucket"]):
                if x["kind"] == "gram":
                    logs.append(np.frombuffer(x["values"], dtype=np.float32))
                else:
                    count.update(zip(words_of(x["names"]), counts_of(x["values"]).tolist(), strict=True))
            found, names, n_tokens, n_known, base = [], [], [], [], []
            for _, _, texts in pieces(chunk, settings.piece_bytes):
                text, words = stream(texts, settings.depth)
                names.append(distinct(text.keys())[0])
                found.append(text)
                long = np.array([len(w) for w in words])
                c = np.fromiter(map(count.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(long.sum()))
                c = np.insert(c, np.cumsum(long), root.texts)
                at = np.cumsum(long + 1) - long - 1
                n_tokens.append(long + 1)
                n_known.append(np.add.reduceat((c > 0).astype(np.int64), at))
                base.append(np.add.reduceat(np.log10((c + 1) / (root.total + root.distinct + 1)), at))
                del words, c
            names = distinct(np.concatenate(names))[0]
            value = np.empty(len(names), dtype=np.float32)
            value[by_bucket(names, settings, cuts, buckets)[0]] = np.concatenate(logs)
            table = Lookup(names, value)
            del logs, names, value
            score = [np.add.reduceat(table.get(text.keys()).astype(np.float64), np.cumsum(text.sizes) - text.sizes) for text in found]
            sizes = [text.sizes for text in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk.doc_ids(), pa.int64()), pa.array(chunk.marks), *[pa.array(np.concatenate(x)) for x in (n_tokens, n_known, sizes, base, score)]],
                names=["doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "base_score", "score"],
            )

    return run


def score(docs: DataFrame, held_out: Column, text: str = "text", settings: Settings | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, n_bytes, base_score, score, bits_per_byte) for every row.

    Learns from the rows where held_out is false.  score: log10 probability of the text, as
    words joined by one blank and an end byte.  Null and empty texts are an end alone; a null
    id keeps its row; repeated rows count as often as they stand there; without training rows
    every bit has probability one half.
    """
    settings = settings or Settings()
    context = docs.sparkSession.sparkContext
    size = docs.agg(F.sum(F.octet_length(text)).alias("n"), F.sum((~F.coalesce(held_out, F.lit(False))).cast("long")).alias("texts"), F.count("*").alias("rows")).first()
    bytes_ = (size["n"] or 0) + size["rows"]  # no stream is longer: words, blanks and ends
    # chunks are filled across small files, as long as every core has some
    full = docs.coalesce(int(max(context.defaultParallelism, -(-bytes_ // settings.chunk_bytes))))
    chunks = chunked(full, F.coalesce(held_out, F.lit(False)), text, settings.chunk_bytes)
    buckets = int(min(1 << 16, max(16, -(-bytes_ // settings.bucket_bytes))))
    share = 1 / min(buckets, settings.most_cut)
    # a context reported by the chunks where it is frequent; so at most 1 / share of each length pass
    often = chunks.mapInArrow(frequent(settings, share), "length int, context long, n long").groupBy("length", "context").agg(F.sum("n").alias("n"))
    cuts = cuts_of(often.where(F.col("n") >= share * bytes_).collect(), settings.depth, share * bytes_)
    # a subtree has at most `share` of the bytes, its bucket one bucket's share more
    parts = int(max(1, -(-bytes_ * (share + 1 / buckets) // (2 * settings.bucket_bytes))))
    part = F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int").alias("part")
    asked = chunks.mapInArrow(asks(settings, cuts, buckets), ASK).groupBy("kind", "bucket", part)
    asked = write_table(asked.agg(F.collect_list(F.struct("chunk", "names", "counts")).alias("asked")), "asked")
    merged = asked.mapInArrow(merge, PART).groupBy("kind", "bucket")
    merged = write_table(merged.agg(F.collect_list(F.struct("part", "names", "counts")).alias("asked")), "merged")
    upper = merged.mapInArrow(upper_nodes(settings, cuts), UPPER).groupBy("length", "context", "node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "children")])
    root = roots(upper.toPandas(), cuts, size["texts"] or 0)  # 256 nodes for each context above a cut
    held = context.broadcast(root)
    told = merged.mapInArrow(bucket_values(settings, cuts, held), TOLD)
    names = asked.select("kind", "bucket", "part", F.transform("asked", lambda x: F.struct(x["chunk"].alias("chunk"), x["names"].alias("names"))).alias("asked"))
    answers = names.join(told, ["kind", "bucket", "part"]).mapInArrow(part_answers, ANSWER)
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "names", "values")).alias("answers"))  # at most a chunk's own grams
    found = chunks.join(answers, "chunk").mapInArrow(scores(settings, cuts, buckets, held), SCORED)
    return found.withColumns({"train_tokens": F.lit(root.total).cast("long"), "bits_per_byte": -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")})
