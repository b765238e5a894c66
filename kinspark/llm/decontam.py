"""Benchmark decontamination with a generalised suffix automaton.

All test items, as sequences of normalised words, go into one automaton.  Training texts are
streamed through it word by word; the state gives the longest suffix read so far that occurs
in an item.  A word is hit when it lies in a match of `window` words, or in a whole item that
is shorter than that.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import WORD_TABLE, body, byte_rows, free_name, write_table

#: Bytes of item text in one automaton; more items make more automata, streamed one after another.
AUTOMATON_BYTES = 1 << 20

_WORD = re.compile(rb"[^ ]+")


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences, with the items of each match of `window` words."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        holders: list[set[int]] = [set()]
        for item, words in items:
            last = 0
            for word in words:
                last = self._extend(last, self.ids.setdefault(word, len(self.ids) + 1), holders)
                holders[last].add(item)
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for v in by_length:
            if self.length[self.link[v]] >= min(window, self.length[v]) and self.link[v] > 0:
                holders[self.link[v]] |= holders[v]
        #: the suffix state whose lengths include `window`
        self.anchor = [0] * len(self.length)
        #: short items: state -> [(words, item)], and the nearest suffix state that ends one
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, words in items:
            if 0 < len(words) < window:
                v = 0
                for word in words:
                    v = self.next[v][self.ids[word]]
                self.short.setdefault(v, []).append((len(words), item))
        self.ending = [0] * len(self.length)
        for v in reversed(by_length):
            up = self.link[v]
            if self.length[v] >= window:
                self.anchor[v] = v if self.length[up] < window else self.anchor[up]
            self.ending[v] = v if v in self.short else self.ending[up]
        self.items = {v: tuple(sorted(holders[v])) for v in set(self.anchor) if v}
        self.shortest = min((min(len(w), window) for _, w in items if w), default=0)

    def _extend(self, last: int, word: int, holders: list[set[int]]) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q, holders)
        cur = self._state(self.length[last] + 1, {}, holders)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][word]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q, holders)
        return cur

    def _state(self, length: int, arcs: dict[int, int], holders: list[set[int]]) -> int:
        self.next.append(arcs)
        self.link.append(0)
        self.length.append(length)
        holders.append(set())
        return len(self.length) - 1

    def _clone(self, p: int, word: int, q: int, holders: list[set[int]]) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), holders)
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit word spans [start, end), the items found, and the longest match in words.

        A word that no item holds resets the automaton, so only runs of known words that can
        hold a window are streamed.
        """
        known = np.fromiter(map(self.ids.get, words, _ZEROS), dtype=np.int64, count=len(words)) if self.shortest else np.empty(0, dtype=np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (known > 0).view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.shortest
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        longest = 0
        for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            v = size = 0
            for i, word in enumerate(known[start:end].tolist(), start + 1):
                while v and word not in self.next[v]:
                    v = self.link[v]
                    size = self.length[v]
                if word in self.next[v]:
                    v, size = self.next[v][word], size + 1
                longest = max(longest, size)
                if size >= self.window:
                    spans.append((i - self.window, i))
                    items.update(self.items[self.anchor[v]])
                u = self.ending[v]
                while u:
                    for n, item in self.short[u]:
                        if n <= size:
                            spans.append((i - n, i))
                            items.add(item)
                    u = self.ending[self.link[u]]
        return merged(spans), items, longest


class _Zeros:
    """Endless zeros, as defaults for map."""

    def __iter__(self):
        return self

    def __next__(self):
        return 0


_ZEROS = _Zeros()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def item_blocks(items: DataFrame, block_bytes: int = AUTOMATON_BYTES) -> Iterator[tuple[list[tuple[int, list[bytes]]], bool]]:
    """Items as word lists, in blocks of bounded size, each with whether it is the last.

    The benchmark is read to the driver a block at a time, when the one before is done with; a
    block is about `block_bytes` of text (one item can be longer), which bounds what the driver
    holds and what is broadcast.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), body().alias("body")).where("item_id is not null")
    size = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k) if count > 1 else rows
        yield [(r["item_id"], bytes(r["body"]).translate(WORD_TABLE).split()) for r in part.collect()], k == count - 1


@dataclass(frozen=True)
class Limits:
    """What is removed: spans of at least `span_words`; whole documents from `coverage` on."""

    window: int = 10
    span_words: int = 1
    coverage: float = 0.8


SCHEMA = "doc_id long, n_words long, n_hit long, items array<long>, longest int, spans array<struct<start:int,stop:int>>, body binary"


def decontaminate(docs: DataFrame, items: DataFrame, limits: Limits | None = None, text: str = "text", block_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, longest, spans, body) for every row of docs.

    Words are ASCII letters and digits and non-ASCII characters, A-Z lowered.  spans are hit
    word ranges; body the text's bytes.  Null or word-free texts have no words; items with a
    null id or no words never match; an empty benchmark leaves all clean; repeated rows give
    repeated results.  Where items fill several blocks, texts go through one automaton at a time,
    from one written table to the next.
    """
    limits = limits or Limits()
    window = limits.window
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<long>").alias("items"), F.lit(0).alias("longest"),
        F.array().cast("array<struct<start:int,stop:int>>").alias("spans"), body(text).alias("body"),
    )
    context = docs.sparkSession.sparkContext

    def stream(held):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = SuffixAutomaton(held.value, window)
            for batch in batches:
                n_words, n_hit, found, longest, spans = [], [], [], [], []
                old_items, old_spans, old_longest = batch.column("items"), batch.column("spans"), batch.column("longest")
                for i, text_ in enumerate(byte_rows(batch, "body")):
                    words = text_.translate(WORD_TABLE).split()
                    hit, items_, long_ = automaton.matches(words)
                    before = [(s["start"], s["stop"]) for s in old_spans[i].as_py()]
                    hit = merged(before + hit) if before else hit
                    n_words.append(len(words))
                    n_hit.append(sum(b - a for a, b in hit))
                    found.append(sorted(items_ | set(old_items[i].as_py())))
                    longest.append(max(long_, old_longest[i].as_py()))
                    spans.append([{"start": a, "stop": b} for a, b in hit])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(longest, pa.int32()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), batch.column("body")],
                    names=["doc_id", "n_words", "n_hit", "items", "longest", "spans", "body"],
                )

        return run

    for block, last in item_blocks(items, block_bytes):
        held = context.broadcast(block)
        rows = rows.mapInArrow(stream(held), SCHEMA)
        if not last:
            rows = write_table(rows, "spans")
            held.destroy()
    return rows


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from each span's first word to its last."""
    words = [m.span() for m in _WORD.finditer(text.translate(WORD_TABLE))]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : words[start][0]])
        at = words[end - 1][1]
    kept.append(text[at:])
    return b"".join(kept)


def cleaned(docs: DataFrame, items: DataFrame, limits: Limits | None = None, text: str = "text", block_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """docs with contaminated spans cut out; documents hit to the coverage limit go.

    All columns stay; n_chars, where present, is the new length of a changed text.  Spans of
    all blocks of items are gathered before any is cut, one automaton at a time.
    """
    limits = limits or Limits()
    context = docs.sparkSession.sparkContext
    names = docs.columns
    window, least, coverage = limits.window, limits.span_words, limits.coverage
    held_spans = free_name(names, "spans")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def cut(batch: pa.RecordBatch, words_of: list[tuple[bytes, int]], found: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        texts, keep, changed = [], [], []
        for value, (raw, n_words), spans in zip(batch.column(text), words_of, found, strict=True):
            spans = [s for s in spans if s[1] - s[0] >= least]
            hit = sum(b - a for a, b in spans)
            keep.append(not hit or hit < coverage * n_words)
            texts.append(without_spans(raw, spans).decode() if hit and keep[-1] else value.as_py())
            changed.append(bool(hit))
        columns = []
        for name in names:
            column = batch.column(name)
            if name == text:
                column = pa.array(texts, pa.string())
            elif name == "n_chars":
                column = pa.array([len(t) if c and t is not None else x.as_py() for t, c, x in zip(texts, changed, column, strict=True)], column.type)
            columns.append(column)
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    def stream(held, first: bool, last: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = None
            for batch in batches:
                automaton = automaton or SuffixAutomaton(held.value, window)
                words_of, found = [], []
                for i, value in enumerate(batch.column(text)):
                    raw = (value.as_py() or "").encode()
                    words = raw.translate(WORD_TABLE).split()
                    before = [] if first else [(s["start"], s["stop"]) for s in batch.column(held_spans)[i].as_py()]
                    words_of.append((raw, len(words)))
                    found.append(merged(before + automaton.matches(words)[0]))
                if last:
                    yield cut(batch, words_of, found)
                else:
                    spans = pa.array([[{"start": a, "stop": b} for a, b in x] for x in found], kind)
                    yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [spans], names=[*names, held_spans])

        return run

    between = StructType([*docs.schema.fields, StructField(held_spans, ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())])))])
    rows, first = docs, True
    for block, last in item_blocks(items, block_bytes):
        held = context.broadcast(block)
        rows = rows.mapInArrow(stream(held, first, last), docs.schema if last else between)
        if not last:
            rows, first = write_table(rows, "spans"), False
            held.destroy()
    return rows
