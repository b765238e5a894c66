"""Long repeated byte strings by prefix-free parsing.

Rolling-hash triggers cut every text into phrases: the trigger of a window is the smallest
hash of `gram` bytes among its first `reach` positions, so equal windows have their trigger at
the same place, and no phrase is longer than `reach`.  A window starts in one phrase and ends
`window` bytes later in the parse that follows, so two windows are equal when the suffixes of
their phrases are equal and what follows the trigger agrees long enough.

Spark works on triggers, not on windows:

1. each trigger sends a hash of what every one of its windows holds (right) and of all that
   they cover (whole); a trigger whose right is alone has no repeat, and one whose whole
   occurs twice has nothing but repeats;
2. only the others, at the edges of repeated passages, send their bytes.  Those that share a
   right meet in one bucket, where the dictionary's suffixes (phrases read backwards) and the
   parse (what follows) are sorted, and their common-prefix arrays are combined: window x of a
   trigger is repeated where both orders put it beside another at depths x and window - x;
3. a right that very many different triggers share (a passage between ever new surroundings)
   would fill one bucket: the windows of those are named by their content and counted, distinct
   in each chunk first, over all buckets.

Only the edges build both orders; most triggers are settled by equality.  Equality in 1 is that
of two 64-bit hashes (right and whole, of different bytes), in 3 that of a 128-bit hash: among
10**12 triggers the odds that any two unequal ones agree are about 10**-14.  2 compares bytes.
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


@dataclass(frozen=True)
class Settings:
    window: int = 400
    reach: int = 256
    chunk_bytes: int = CHUNK_BYTES
    #: bytes of text for each bucket of triggers
    bucket_bytes: int = 16 << 20
    #: distinct triggers of one right, beyond which their windows are counted one by one
    hot: int = 2048

    @property
    def gram(self) -> int:
        return 16

    @property
    def right(self) -> int:
        """Bytes from the trigger on that all its windows hold."""
        return self.window - self.reach + 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 16 bytes from each position on."""
    h = data.astype(np.uint64)
    base, size = np.uint64(0x9E3779B97F4A7C15), 1
    while size < 16:
        h = h[:-size] * base + h[size:] if len(h) > size else h[:0]
        base, size = base * base, size * 2
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def smallest(hashes: np.ndarray, reach: int) -> np.ndarray:
    """For each position the place of the smallest hash among the next `reach`, the leftmost of equals."""
    n = len(hashes) - reach + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    out = np.empty(n, dtype=np.int64)
    block = 1 << 21
    for at in range(0, n, block):
        part = hashes[at : min(at + block + reach - 1, len(hashes))]
        size = len(part)
        rows = -(-size // reach)
        key = np.full(rows * reach, np.uint64(2**64 - 1))
        key[:size] = (part & ~np.uint64(0x3FFFFF)) | np.arange(size, dtype=np.uint64)
        grid = key.reshape(rows, reach)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        m = size - reach + 1
        out[at : at + m] = (np.minimum(after[:m], before[reach - 1 : reach - 1 + m]) & np.uint64(0x3FFFFF)).astype(np.int64) + at
    return out


def triggers(blob: bytes, lengths: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first window, last window) for all texts of a blob; windows never cross texts."""
    data = np.frombuffer(blob, dtype=np.uint8)
    place = smallest(gram_hashes(data), settings.reach)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    long = np.flatnonzero(lengths >= settings.window)
    mark = np.zeros(len(data) + 2, dtype=np.int64)
    np.add.at(mark, starts[long], long + 1)
    np.add.at(mark, ends[long] - settings.window + 1, -(long + 1))
    text = np.cumsum(mark)[: len(place)]
    whole = text > 0
    at = np.flatnonzero(whole)
    if not len(at):
        return (np.empty(0, dtype=np.int64),) * 3
    new = np.ones(len(at), dtype=bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    return place[first], first, last


ASK = "bucket int, chunk long, rights binary, wholes binary, twice binary, places binary"


def split_by(bucket: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    return np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)


def ordered(rights: np.ndarray, wholes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a chunk sends its triggers, by bucket, right and whole hash; and how many are equal in a row."""
    order = np.lexsort((wholes, rights, bucket_of(rights, buckets)))
    r, w = rights[order], wholes[order]
    first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (w[1:] != w[:-1]))) if len(r) else np.empty(0, dtype=np.int64)
    return order, np.diff(np.append(first, len(r)))


def found(chunk: Chunk, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    place, first, last = triggers(chunk.blob, chunk.lengths, settings)
    blob, right, window = chunk.blob, settings.right, settings.window
    digest = xxhash.xxh3_64_intdigest
    rights = np.fromiter((digest(blob[p : p + right]) for p in place.tolist()), dtype=np.uint64, count=len(place))
    wholes = np.fromiter((digest(blob[a : b + window]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), dtype=np.uint64, count=len(place))
    return place, first, last, rights, wholes


def asks(settings: Settings, buckets: int):
    """A chunk's distinct triggers by bucket, with a bit for those that it has twice; and, in bucket -1, where they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chunk_rows(batches):
            chunk = Chunk(row)
            place, first, last, rights, wholes = found(chunk, settings)
            order, runs = ordered(rights, wholes, buckets)
            out: dict[str, list] = {k: [] for k in ("bucket", "chunk", "rights", "wholes", "twice", "places")}
            places = pack_numbers(np.concatenate([place[order] - first[order], last[order] - first[order], first[order]]))
            for name, value in zip(out, (-1, chunk.number, None, None, squeeze(runs.astype(np.int32).tobytes()), places), strict=True):
                out[name].append(value)
            at = order[np.cumsum(runs) - runs]
            rights, wholes = rights[at], wholes[at]
            for part in split_by(bucket_of(rights, buckets), np.arange(len(rights))):
                bucket = int(bucket_of(rights[part[:1]], buckets)[0])
                for name, value in zip(out, (bucket, chunk.number, pack_numbers(rights[part].view(np.int64)), wholes[part].tobytes(), np.packbits(runs[part] > 1).tobytes(), None), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int64())] + [(k, pa.binary()) for k in ("rights", "wholes", "twice", "places")]))

    return run


NONE, ALL, EDGE, SHOWN, HOT, HOT_SHOWN = range(6)


def judged(hot: int):
    """For each chunk a code per distinct trigger.

    NONE no repeat, ALL all repeats, EDGE at an edge of repeats, SHOWN all repeats and shown to
    the edges.  Where more than `hot` distinct triggers share a right, the last two are HOT and
    HOT_SHOWN: their windows are counted by content, spread over all buckets.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rights = [unpack_numbers(x).view(np.uint64) for x in group["rights"]]
        sizes = [len(r) for r in rights]
        right = np.concatenate(rights)
        whole = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in group["wholes"]])
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n) for x, n in zip(group["twice"], sizes, strict=True)])
        order = np.lexsort((whole, right))
        r, w = right[order], whole[order]
        new_right = np.append(True, r[1:] != r[:-1])
        new_whole = new_right | np.append(True, w[1:] != w[:-1])
        right_at, whole_at = np.cumsum(new_right) - 1, np.cumsum(new_whole) - 1
        n_whole = np.bincount(whole_at, weights=1 + twice[order])
        kinds = np.bincount(right_at, weights=new_whole)[right_at]  # distinct wholes of a right
        alone = n_whole[whole_at] == 1
        edges = np.bincount(right_at, weights=alone & (kinds > 1))[right_at] > 0
        code = np.where(~alone, ALL, np.where(kinds > 1, EDGE, NONE)).astype(np.uint8)
        code[(code == ALL) & new_whole & edges] = SHOWN  # the first of each whole stands for it
        code[(code >= EDGE) & (kinds > hot)] += HOT - EDGE
        back = np.empty(len(code), dtype=np.uint8)
        back[order] = code
        return pd.DataFrame({"bucket": group["bucket"], "chunk": group["chunk"], "codes": [squeeze(x.tobytes()) for x in np.split(back, np.cumsum(sizes)[:-1])]})

    return run


def contexts(settings: Settings, buckets: int):
    """The bytes of edge triggers and of those shown to them, by bucket; of groups that are not hot."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chunk_rows(batches):
            code = codes_of(row)
            at = np.flatnonzero((code == EDGE) | (code == SHOWN))
            if not len(at):
                continue
            left, span, first = places_of(row)
            blob = unsqueeze(row["blob"])
            digest, right, window = xxhash.xxh3_64_intdigest, settings.right, settings.window
            rights = np.fromiter((digest(blob[p : p + right]) for p in (first[at] + left[at]).tolist()), dtype=np.uint64, count=len(at))
            bucket = bucket_of(rights, buckets)
            order = np.argsort(bucket, kind="stable")
            out: dict[str, list] = {k: [] for k in ("bucket", "chunk", "numbers", "lefts", "spans", "edges", "held")}
            for part in split_by(bucket, order):
                some = at[part]
                out["bucket"].append(int(bucket[part[0]])), out["chunk"].append(row["chunk"])
                out["numbers"].append(some.astype(np.int64).tobytes()), out["lefts"].append(left[some].astype(np.int32).tobytes())
                out["spans"].append(span[some].astype(np.int32).tobytes()), out["edges"].append((code[some] == EDGE).tobytes())
                out["held"].append(squeeze(b"".join(blob[a : a + b + window] for a, b in zip(first[some].tolist(), span[some].tolist(), strict=True))))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int64())] + [(k, pa.binary()) for k in ("numbers", "lefts", "spans", "edges", "held")]))

    return run


CONTEXT = "bucket int, chunk long, numbers binary, lefts binary, spans binary, edges binary, held binary"


def codes_of(row: dict) -> np.ndarray:
    """Codes of a chunk's triggers, in the order sent; of equal triggers the first alone is shown."""
    parts = sorted(((x["bucket"], x["codes"]) for x in row["codes"] or []), key=lambda x: x[0])
    if not parts:
        return np.empty(0, dtype=np.uint8)
    code = np.concatenate([np.frombuffer(unsqueeze(c), dtype=np.uint8) for _, c in parts])
    runs = np.frombuffer(unsqueeze(row["runs"]), dtype=np.int32)
    out = np.repeat(code, runs)
    again = np.ones(len(out), dtype=bool)
    again[np.cumsum(runs) - runs] = False
    out[again & ((out == SHOWN) | (out == HOT_SHOWN))] = ALL
    return out


def hot_windows(row: dict, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a chunk's hot triggers: (start, 128-bit content name as two numbers, is it an edge's?)."""
    code = codes_of(row)
    at = np.flatnonzero(code >= HOT)
    _, span, first = places_of(row)
    blob, window, digest = unsqueeze(row["blob"]), settings.window, xxhash.xxh3_128_digest
    size = span[at] + 1
    start = np.repeat(first[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    names = np.frombuffer(b"".join([digest(blob[a : a + window]) for a in start.tolist()]), dtype="<u8").reshape(-1, 2)
    return start, names, np.repeat(code[at] == HOT, size)


HOT_ASK = "bucket int, chunk long, names binary, twice binary"


def ask_hot(settings: Settings, buckets: int):
    """Distinct windows of hot triggers by content, with a bit for those that the chunk has twice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chunk_rows(batches):
            if not (codes_of(row) >= HOT).any():
                continue
            names, _, counts = distinct_names(hot_windows(row, settings)[1])
            where = bucket_of(names[:, 0], buckets)
            out: dict[str, list] = {k: [] for k in ("bucket", "chunk", "names", "twice")}
            for part in split_by(where, np.arange(len(where))):
                for name, value in zip(out, (int(where[part[0]]), row["chunk"], names[part].tobytes(), np.packbits(counts[part] > 1).tobytes()), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("names", pa.binary()), ("twice", pa.binary())]))

    return run


def distinct_names(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, ascending; each row's place among them; and how often each stands there."""
    order = np.lexsort((names[:, 1], names[:, 0]))
    x = names[order]
    new = np.append(True, (x[1:] != x[:-1]).any(axis=1))[: len(x)]
    back = np.empty(len(x), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return x[new], back, np.bincount(back, minlength=int(new.sum()))


def judge_hot(group: pd.DataFrame) -> pd.DataFrame:
    """For each chunk a bit per window: does it start elsewhere too?"""
    names = [np.frombuffer(x, dtype="<u8").reshape(-1, 2) for x in group["names"]]
    sizes = [len(x) for x in names]
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n) for x, n in zip(group["twice"], sizes, strict=True)])
    _, back, _ = distinct_names(np.concatenate(names))
    more = np.bincount(back, weights=1 + twice)[back] > 1
    return pd.DataFrame({"bucket": group["bucket"], "chunk": group["chunk"], "told": [np.packbits(x).tobytes() for x in np.split(more, np.cumsum(sizes)[:-1])], "size": sizes})


def places_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger - first window, last - first window, first window), in the order sent."""
    return tuple(np.split(unpack_numbers(row["places"]), 3))


def order_and_depth(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rank order of strings, and how many bytes each shares with the one before it."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    width = max(map(len, strings), default=0)
    depth = np.zeros(len(strings), dtype=np.int32)
    step = max(2, (1 << 24) // max(1, width))
    for at in range(1, len(strings), step):
        some = [strings[k] for k in order[at - 1 : at + step]]
        size = np.array([len(s) for s in some])
        grid = np.zeros((len(some), width + 1), dtype=np.uint8)
        for k, s in enumerate(some):
            grid[k, : len(s)] = np.frombuffer(s, dtype=np.uint8)
        differs = grid[1:] != grid[:-1]
        differs[:, -1] = True
        common = np.minimum(differs.argmax(axis=1), np.minimum(size[1:], size[:-1]))
        depth[at : at + len(common)] = common
    return np.array(order, dtype=np.int64), depth


def combined(lefts: list[bytes], rights: list[bytes], low: np.ndarray, high: np.ndarray, window: int) -> np.ndarray:
    """For each trigger and x in [low, high]: do another's last x bytes before and first window-x bytes after agree?

    lefts are read backwards.  Rows are triggers, columns x from 0 to the largest high.
    """
    n = len(lefts)
    by_left, left_depth = order_and_depth(lefts)
    by_right, right_depth = order_and_depth(rights)
    repeated = np.zeros((n, int(high.max(initial=0)) + 1), dtype=bool)
    left_class, right_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for x in range(int(low.min(initial=0)), repeated.shape[1]):
        here = np.flatnonzero((low <= x) & (x <= high))
        if len(here) < 2:
            continue
        left_class[by_left] = np.cumsum(left_depth < x)
        right_class[by_right] = np.cumsum(right_depth < window - x)
        key = left_class[here] * (n + 1) + right_class[here]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.append(False, same) | np.append(same, False)
        repeated[here[order[twice]], x] = True
    return repeated


def resolve(settings: Settings):
    """For each chunk the repeated windows of its edge triggers: (chunk, numbers, counts, starts)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        window = settings.window
        lefts, rights, low, high, owner, number, edge = [], [], [], [], [], [], []
        for k, row in enumerate(group.itertuples(index=False)):
            left, span = np.frombuffer(row.lefts, dtype=np.int32), np.frombuffer(row.spans, dtype=np.int32)
            held, at = unsqueeze(row.held), 0
            for a, b in zip(left.tolist(), span.tolist(), strict=True):
                piece = held[at : at + b + window]
                at += b + window
                lefts.append(piece[:a][::-1])
                rights.append(piece[a:])
            low.append(left - span), high.append(left)
            owner.append(np.full(len(left), k)), number.append(np.frombuffer(row.numbers, dtype=np.int64)), edge.append(np.frombuffer(row.edges, dtype=bool))
        low, high, owner, number, edge = map(np.concatenate, (low, high, owner, number, edge))
        repeated = combined(lefts, rights, low, high, window)
        at, x = np.nonzero(repeated & edge[:, None])
        out = []
        for k, chunk in enumerate(group["chunk"]):
            mine = owner[at] == k
            if mine.any():
                # a window's start, counted from its trigger's first window
                out.append((chunk, number[at[mine]].tobytes(), (high[at[mine]] - x[mine]).astype(np.int64).tobytes()))
        return pd.DataFrame(out, columns=["chunk", "numbers", "offsets"])

    return run


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept binary"


def cut_out(settings: Settings, digest: bool):
    """Each text's removed spans and what is left (or its sha256)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = settings.window
        for row in chunk_rows(batches):
            chunk = Chunk(row)
            code = codes_of(row)
            _, span, first = places_of(row)
            change = np.zeros(len(chunk.blob) + 1, dtype=np.int32)
            whole = (code == ALL) | (code == SHOWN) | (code == HOT_SHOWN)
            np.add.at(change, first[whole], 1)
            np.add.at(change, first[whole] + span[whole] + window, -1)
            for x in row["edges"] or []:
                starts = first[np.frombuffer(x["numbers"], dtype=np.int64)] + np.frombuffer(x["offsets"], dtype=np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + window, -1)
            if row["hot"]:
                starts, names, edge = hot_windows(row, settings)
                _, back, _ = distinct_names(names)
                parts = sorted(row["hot"], key=lambda x: x["bucket"])
                more = np.concatenate([np.unpackbits(np.frombuffer(x["told"], dtype=np.uint8), count=x["size"]) for x in parts]).astype(bool)[back] & edge
                np.add.at(change, starts[more], 1)
                np.add.at(change, starts[more] + window, -1)
            gone = np.cumsum(change[:-1]) > 0
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept")}
            data = np.frombuffer(chunk.blob, dtype=np.uint8)
            for doc_id, size, end in zip(chunk.doc_ids(), chunk.lengths.tolist(), chunk.ends.tolist(), strict=True):
                mask = gone[end - size : end]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                removed = int(mask.sum())
                kept = data[end - size : end][~mask].tobytes() if removed else chunk.blob[end - size : end]
                for name, value in zip(out, (doc_id, size, removed, len(edge) // 2, [{"start": int(a), "stop": int(b)} for a, b in edge.reshape(-1, 2)], hashlib.sha256(kept).digest() if digest else kept), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())]))

    return run


def remove_repeats(docs: DataFrame, text: str = "text", settings: Settings | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) for every row.

    Every byte covered by a `window`-byte string that also starts elsewhere, in any row or the
    same one, is removed.  Null and empty texts and those shorter than the window keep all; a
    null id stays; repeated rows are repeats of each other.  kept: the remaining bytes, or
    their sha256 with `digest`.
    """
    settings = settings or Settings()
    chunks = chunked(docs, None, text, settings.chunk_bytes)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = int(min(1 << 20, max(24, -(-size // settings.bucket_bytes))))
    asked = write_table(chunks.mapInArrow(asks(settings, buckets), ASK), "asked")
    places = asked.where("bucket < 0").select("chunk", "places", F.col("twice").alias("runs"))
    codes = asked.where("bucket >= 0").drop("places").groupBy("bucket").applyInPandas(judged(settings.hot), "bucket int, chunk long, codes binary")
    codes = codes.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "codes")).alias("codes"))  # a byte for each trigger of the chunk
    known = write_table(places.join(codes, "chunk", "left"), "codes")
    coded = chunks.select("chunk", "blob").join(known, "chunk")
    sent = coded.mapInArrow(contexts(settings, buckets), CONTEXT)
    edges = sent.groupBy("bucket").applyInPandas(resolve(settings), "chunk long, numbers binary, offsets binary")
    edges = edges.groupBy("chunk").agg(F.collect_list(F.struct("numbers", "offsets")).alias("edges"))  # windows of the chunk's own triggers
    told = coded.mapInArrow(ask_hot(settings, buckets), HOT_ASK).groupBy("bucket").applyInPandas(judge_hot, "bucket int, chunk long, told binary, size int")
    told = told.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "told", "size")).alias("hot"))  # a bit for each window of the chunk's own
    edges = write_table(known.join(edges, "chunk", "left").join(told, "chunk", "left"), "edges")
    return chunks.join(edges, "chunk").mapInArrow(cut_out(settings, digest), SCHEMA)
