"""Periodic runs of words with a dictionary of basic factors.

For each power of two L, the words' factors of length L are named so that equal ones share a
name (two names of half the length make one).  Where a factor occurs again within 2L, the step
to its next occurrence is noted; places where two equal steps follow each other form an
arithmetic progression, and that step is proposed as a period.  Neighbouring places with one
step make one stretch, which is extended word by word as far as the period holds.

A run of period q and length 4q or more is found at the L with q <= L < 2q: inside it the next
occurrence of a factor at least as long as its primitive period is exactly q away.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, byte_rows

#: A run has at least LEAST words and at least TIMES periods.
LEAST, TIMES = 6, 4


def stretches(next_at: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, step) of neighbouring places whose next occurrence is one step away, where steps repeat.

    places: ascending; next_at: each one's next occurrence, -1 where there is none within twice the length.
    """
    step = np.where(next_at >= 0, next_at - places, 0)
    cuts = np.flatnonzero((np.diff(places, prepend=-2) != 1) | (np.diff(step, prepend=-1) != 0))
    ends = np.append(cuts[1:], len(places)) - 1
    first, last, step = places[cuts], places[ends], step[cuts]
    # the progression i, i+step, i+2*step: both steps are in the stretch
    fine = (step > 0) & (last - first >= step) & (last + length + step - first >= np.maximum(LEAST, TIMES * step))
    return first[fine], last[fine], step[fine]


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of a sequence of word numbers, by start, then period."""
    n = len(words)
    found: dict[tuple[int, int], int] = {}
    key, places, length = words, np.arange(n), 1
    while len(places):
        order = np.argsort(key, kind="stable")  # equal factors together, each by place
        sorted_key, sorted_place = key[order], places[order]
        same = sorted_key[1:] == sorted_key[:-1]
        if not same.any():
            break
        near = np.flatnonzero(same & (sorted_place[1:] - sorted_place[:-1] <= 2 * length))
        if len(near):
            following = np.full(len(places), -1)
            following[order[near]] = sorted_place[near + 1]
            for first, last, step in zip(*(x.tolist() for x in stretches(following, places, length)), strict=True):
                start, end = first, last + length + step
                while start > 0 and words[start - 1] == words[start - 1 + step]:
                    start -= 1
                while end < n and words[end] == words[end - step]:
                    end += 1
                found[start, end] = min(step, found.get((start, end), step))
        if 4 * length >= n:
            break
        # factors that occur once end here: no longer one with them occurs twice
        again = np.append(same, False)
        again[1:] |= same
        name = np.full(n, -1)
        name[sorted_place[again]] = np.cumsum(np.append(True, ~same))[again]
        places = np.flatnonzero((name[: n - length] >= 0) & (name[length:] >= 0))
        key, length = name[places] * (n + 1) + name[places + length], 2 * length
    return sorted((start, end - start, q) for (start, end), q in found.items())


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words that no run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row: its periodic runs, and its text without their repeats.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0.  A run is a stretch with smallest period
    q, at least 6 words and 4 periods long, that no neighbouring word extends; runs are ordered
    by start, then period.  collapsed: the words outside of repeats, joined by a space (bytes;
    with `digest`, their SHA-256).  Every text is one task's own; no other row matters, so equal
    texts and rows give equal results and no key is grouped.  Null and empty texts have no
    words; an empty table gives no rows; other columns are not looked at.
    """

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, told, left = [], [], []
            for raw in byte_rows(batch, "body"):
                words = raw.split()  # bytes: splits at exactly these six
                index: dict[bytes, int] = {}
                numbers = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
                got = runs(numbers)
                if got:
                    words = [w for w, k in zip(words, kept(len(words), got).tolist(), strict=True) if k]
                rest = b" ".join(words)
                sizes.append(len(numbers))
                told.append([{"start": a, "length": b, "period": q} for a, b, q in got])
                left.append(hashlib.sha256(rest).digest() if digest else rest)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(told, pa.list_(_RUN)), pa.array(left, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body(text).alias("body"))
    return rows.mapInArrow(find, f"doc_id long, n_words long, runs {RUNS}, collapsed binary")
