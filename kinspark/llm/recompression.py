"""Repeated word windows by recompression.

Every text is a string of word names.  Rounds replace maximal runs of one symbol by a symbol
for (symbol, length), then pairs whose first symbol falls in the left class and whose second
falls in the right class by a symbol for the pair.  Names and classes are hashes of what they
name, so all tasks name alike and equal substrings get equal interior symbols.  Each symbol
carries its support: the words that decide it.  A window is attached to the symbol of least
hash among those of the highest round whose support it holds, which equal windows share.

Spark then (1) groups attached symbols over the corpus: windows whose symbol occurs in one
document only have no repeat; (2) names the windows of shared symbols by their whole word
sequence and finds the smallest document of each name; (3) cuts the words of later ones.

A window's last name is a 64-bit hash of its words' 64-bit hashes, which is not compared word by
word: among 10**8 windows the odds that any two unequal ones agree are about 3 in 10**4, among
10**10 about three pairs do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Chunk, chunk_rows, chunked, pack_numbers, squeeze, unpack_numbers, unsqueeze, write_table

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The inverse of _ODD modulo 2**64.
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass(frozen=True)
class Settings:
    window: int = 13
    rounds: int = 2
    chunk_bytes: int = CHUNK_BYTES
    #: bytes of text for each bucket of symbols
    bucket_bytes: int = 16 << 20
    #: bits of a symbol's name that are sent; names that clash only cost a verification
    name_bits: int = 44


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0xD6E8FEB86659FD93 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def names_of(words: list[bytes]) -> np.ndarray:
    table = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    return np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=len(words))


def sequence_names(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums and inverse powers for `sequence_name`."""
    n = len(names)
    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(max(0, n - 1), _ODD)))[:n]
    back = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, _BACK)))
    return np.append(np.uint64(0), np.add.accumulate(names * power)), back


def sequence_name(sums: np.ndarray, back: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A name for each word sequence [start, stop), the same wherever it stands."""
    return mixed((sums[stop] - sums[start]) * back[start], 5)


@dataclass
class Symbols:
    """Symbols of a round in text order; positions are words of the chunk, [start, stop) and [low, high)."""

    name: np.ndarray
    low: np.ndarray
    high: np.ndarray
    text: np.ndarray


def neighbours(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Does the symbol before, and the one after, stand in the same text?"""
    same = s.text[1:] == s.text[:-1]
    return np.append(False, same), np.append(same, False)


def run_round(s: Symbols, round_: int) -> Symbols:
    """Maximal runs of a symbol as one. Its neighbours, which end the run, are part of its support."""
    before, after = neighbours(s)
    first = np.append(True, (s.name[1:] != s.name[:-1]) | ~before[1:])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(s.name)) - 1
    size = last - at + 1
    name = np.where(size > 1, mixed(s.name[at] + size.astype(np.uint64) * _ODD, 11 + round_), s.name[at])
    low = np.where(before[at], s.low[at - 1], s.low[at] - 1)
    high = np.where(after[last], s.high[np.minimum(last + 1, len(s.high) - 1)], s.high[last] + 1)
    return Symbols(name, low, high, s.text[at])


def pair_round(s: Symbols, round_: int) -> Symbols:
    """Left-class symbols with the right-class symbol after them as one."""
    before, after = neighbours(s)
    right = (mixed(s.name, 101 + round_) & np.uint64(1)).astype(bool)
    starts = np.append(~right[:-1] & right[1:] & after[:-1], False)
    taken = np.append(False, starts[:-1])
    nxt = np.minimum(np.arange(len(right)) + 1, len(right) - 1)
    # a symbol that stays was decided by the neighbour it could have joined
    low = np.where(right, np.where(before, s.low[np.arange(len(right)) - 1], s.low - 1), s.low)
    high = np.where(right, s.high, np.where(after, s.high[nxt], s.high + 1))
    name = np.where(starts, mixed(s.name * np.uint64(3) + mixed(s.name[nxt], 7), 13 + round_), s.name)
    low, high = np.where(starts, s.low, low), np.where(starts, s.high[nxt], high)
    keep = ~taken
    return Symbols(name[keep], low[keep], high[keep], s.text[keep])


def attached(names: np.ndarray, lengths: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, the sent name of the symbol each is attached to)."""
    size = settings.window
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(names))
    starts = at[at + size <= ends[text]] if len(at) else at
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64)
    level = Symbols(names, at, at + 1, text)
    stack = [level]
    for k in range(settings.rounds):
        level = pair_round(run_round(level, k), k)
        stack.append(level)
    sums, back = sequence_names(names)
    out = np.zeros(len(starts), dtype=np.uint64)
    left = np.arange(len(starts))
    for k in range(settings.rounds, -1, -1):
        s = stack[k]
        low, high = np.maximum.accumulate(s.low), np.minimum.accumulate(s.high[::-1])[::-1]
        first = np.searchsorted(low, starts[left])
        last = np.searchsorted(high, starts[left] + size, side="right") - 1
        hit = first <= last
        who, first, last = left[hit], first[hit], last[hit]
        rank = mixed(s.name, 29)
        best, chosen = rank[first], first.copy()
        for step in range(1, int((last - first).max(initial=0)) + 1):
            more = np.flatnonzero(first + step <= last)
            value = rank[first[more] + step]
            better = value < best[more]
            best[more[better]], chosen[more[better]] = value[better], first[more[better]] + step
        inside = (s.low[chosen] >= starts[who]) & (s.high[chosen] <= starts[who] + size)
        a, b = np.where(inside, s.low[chosen], starts[who]), np.where(inside, s.high[chosen], starts[who] + 1)
        out[who] = mixed(sequence_name(sums, back, a, b), 31 + k)
        left = left[~hit]
        if not len(left):
            break
    return starts, out >> np.uint64(64 - settings.name_bits)


FAR = np.iinfo(np.int64).max


class Texts:
    """A chunk as words."""

    def __init__(self, chunk: Chunk):
        lists = [t.split() for t in chunk.texts()]
        self.lengths = np.array([len(x) for x in lists], dtype=np.int64)
        self.words = [w for x in lists for w in x]
        self.names = names_of(self.words)
        # documents without an id come last and are never before another
        self.owners = np.repeat(np.where(chunk.known, chunk.ids, FAR), self.lengths)


def least_owner(names: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names, the least owner of each, and the greatest."""
    order = np.lexsort((owners, names))
    n, o = names[order], owners[order]
    new = np.flatnonzero(np.append(True, n[1:] != n[:-1])) if len(n) else np.empty(0, dtype=np.int64)
    last = np.append(new[1:], len(n)) - 1 if len(n) else new
    return n[new], o[new], o[last]


ASK = "bucket int, chunk long, names binary, owners binary, several binary"


def ask_rows(chunk: int, names: np.ndarray, bits: int, least: np.ndarray, most: np.ndarray, buckets: int) -> dict[str, list]:
    """Rows of ASK, a bucket for each range of names."""
    top = (names >> np.uint64(bits - 24)).astype(np.uint64) if bits < 64 else names >> np.uint64(40)
    bucket = (top * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
    out: dict[str, list] = {k: [] for k in ("bucket", "chunk", "names", "owners", "several")}
    for part in np.split(np.arange(len(names)), np.flatnonzero(np.diff(bucket)) + 1) if len(names) else []:
        out["bucket"].append(int(bucket[part[0]])), out["chunk"].append(chunk)
        out["names"].append(pack_numbers(names[part].view(np.int64))), out["owners"].append(pack_numbers(least[part]))
        out["several"].append(squeeze(np.packbits(least[part] != most[part]).tobytes()))
    return out


ASK_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("names", pa.binary()), ("owners", pa.binary()), ("several", pa.binary())])


def ask_symbols(settings: Settings, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chunk_rows(batches):
            chunk = Chunk(row)
            texts = Texts(chunk)
            starts, symbols = attached(texts.names, texts.lengths, settings)
            names, least, most = least_owner(symbols, texts.owners[starts])
            yield pa.RecordBatch.from_pydict(ask_rows(chunk.number, names, settings.name_bits, least, most, buckets), schema=ASK_SCHEMA)

    return run


def grouped(group: pd.DataFrame) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Names of a bucket: sizes by row, each entry's distinct name, its owner, and whether its chunk has several owners."""
    names = [unpack_numbers(x) for x in group["names"]]
    sizes = [len(x) for x in names]
    _, back = np.unique(np.concatenate(names), return_inverse=True)
    owners = np.concatenate([unpack_numbers(x) for x in group["owners"]])
    several = np.concatenate([np.unpackbits(np.frombuffer(unsqueeze(x), dtype=np.uint8), count=n) for x, n in zip(group["several"], sizes, strict=True)])
    return sizes, back, owners, several


def shared_symbols(group: pd.DataFrame) -> pd.DataFrame:
    """For each chunk a bit per symbol: does it stand in more than one document?"""
    sizes, back, _, several = grouped(group)
    shared = (np.bincount(back) > 1) | (np.bincount(back, weights=several) > 0)
    parts = np.split(shared[back], np.cumsum(sizes)[:-1])
    return pd.DataFrame({"bucket": group["bucket"], "chunk": group["chunk"], "told": [squeeze(np.packbits(p).tobytes()) for p in parts], "size": sizes})


def first_owners(group: pd.DataFrame) -> pd.DataFrame:
    """For each chunk the least document of each window."""
    sizes, back, owners, _ = grouped(group)
    least = np.full(int(back.max(initial=-1)) + 1, FAR)
    np.minimum.at(least, back, owners)
    parts = np.split(least[back], np.cumsum(sizes)[:-1])
    return pd.DataFrame({"bucket": group["bucket"], "chunk": group["chunk"], "told": [pack_numbers(p) for p in parts], "size": sizes})


TOLD = "bucket int, chunk long, told binary, size int"


def told_bits(parts: list[dict] | None) -> np.ndarray:
    some = sorted(parts or [], key=lambda x: x["bucket"])
    return np.concatenate([np.unpackbits(np.frombuffer(unsqueeze(x["told"]), dtype=np.uint8), count=x["size"]) for x in some]).astype(bool) if some else np.empty(0, dtype=bool)


def ask_windows(settings: Settings, buckets: int):
    """The windows of shared symbols, and for the chunk which those are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chunk_rows(batches):
            chunk = Chunk(row)
            texts = Texts(chunk)
            starts, symbols = attached(texts.names, texts.lengths, settings)
            distinct, back = np.unique(symbols, return_inverse=True)
            starts = starts[told_bits(row["told"])[back]] if len(distinct) else starts
            sums, inverse = sequence_names(texts.names)
            names, least, most = least_owner(sequence_name(sums, inverse, starts, starts + settings.window), texts.owners[starts])
            out = ask_rows(chunk.number, names, 64, least, most, buckets)
            mark = np.zeros(len(texts.names), dtype=bool)
            mark[starts] = True
            out["bucket"].append(-1), out["chunk"].append(chunk.number), out["several"].append(None), out["owners"].append(None)
            out["names"].append(squeeze(np.packbits(mark).tobytes()))
            yield pa.RecordBatch.from_pydict(out, schema=ASK_SCHEMA)

    return run


SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary"


def cut_out(settings: Settings, digest: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chunk_rows(batches):
            chunk = Chunk(row)
            texts = Texts(chunk)
            n = len(texts.words)
            gone = np.zeros(n, dtype=bool)
            parts = sorted(row["told"] or [], key=lambda x: x["bucket"])
            if parts:
                starts = np.flatnonzero(np.unpackbits(np.frombuffer(unsqueeze(row["mark"]), dtype=np.uint8), count=n))
                sums, inverse = sequence_names(texts.names)
                _, back = np.unique(sequence_name(sums, inverse, starts, starts + settings.window), return_inverse=True)
                first = np.concatenate([unpack_numbers(x["told"]) for x in parts])
                late = starts[first[back] < texts.owners[starts]]
                change = np.zeros(n + 1, dtype=np.int32)
                np.add.at(change, late, 1)
                np.add.at(change, late + settings.window, -1)
                gone = np.cumsum(change[:-1]) > 0
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_removed", "spans", "kept")}
            start = 0
            for doc_id, size in zip(chunk.doc_ids(), texts.lengths.tolist(), strict=True):
                mask, words = gone[start : start + size], texts.words[start : start + size]
                start += size
                removed = int(mask.sum())
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))) if removed else np.empty(0, dtype=np.int64)
                kept = b" ".join([w for w, g in zip(words, mask.tolist(), strict=True) if not g] if removed else words)
                for name, value in zip(out, (doc_id, size, removed, [{"start": int(a), "stop": int(b)} for a, b in edge.reshape(-1, 2)], hashlib.sha256(kept).digest() if digest else kept), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in ("doc_id", "n_words", "n_removed")] + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())]))

    return run


def remove_repeats(docs: DataFrame, text: str = "text", settings: Settings | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) for every row.

    Each word covered by a window whose words also start in a row with a smaller doc_id is
    removed.  Null, empty and short texts keep all; a null id is greater than any other and
    smaller than none; rows that repeat an id are not before one another.  kept: the words left,
    joined by one blank, or their sha256 with `digest`.
    """
    settings = settings or Settings()
    chunks = chunked(docs, None, text, settings.chunk_bytes)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = int(min(1 << 20, max(24, -(-size // settings.bucket_bytes))))

    def by_chunk(told: DataFrame) -> DataFrame:
        # an entry for each name that the chunk itself asked for
        return told.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "told", "size")).alias("told"))

    symbols = chunks.mapInArrow(ask_symbols(settings, buckets), ASK)
    shared = write_table(by_chunk(symbols.groupBy("bucket").applyInPandas(shared_symbols, TOLD)), "shared")
    windows = write_table(chunks.join(shared, "chunk", "left").mapInArrow(ask_windows(settings, buckets), ASK), "windows")
    first = by_chunk(windows.where("bucket >= 0").groupBy("bucket").applyInPandas(first_owners, TOLD))
    marks = windows.where("bucket < 0").select("chunk", F.col("names").alias("mark"))
    first = write_table(marks.join(first, "chunk", "left"), "first")
    return chunks.join(first, "chunk").mapInArrow(cut_out(settings, digest), SCHEMA)
