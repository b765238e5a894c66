"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into overlapping chunks that together cover all of it.  Learned
filters over byte embeddings slide through every chunk; each filter's greatest answer in a chunk
is kept (max-pooling).  The greatest and the mean of these over the text's chunks go through one
logistic unit, whose output is calibrated on rows that the filters were not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, byte_rows


@dataclass(frozen=True)
class Settings:
    """per_class: labelled rows of each class to learn from, about; text_bytes: longer texts are not among them (scoring has no bound)."""

    per_class: int = 1500
    text_bytes: int = 65536
    chunk: int = 256
    width: int = 16
    stride: int = 4
    dims: int = 8
    filters: int = 32
    epochs: int = 10
    batch: int = 32
    rate: float = 0.01
    decay: float = 1e-4
    #: share of the sample that calibrates instead of teaching
    spare: float = 0.2
    seed: int = 5

    @property
    def step(self) -> int:
        return self.chunk - self.width


@dataclass
class Model:
    settings: Settings
    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0


def chunks(data: bytes, settings: Settings) -> np.ndarray:
    """The text's overlapping chunks, one a row, the last one filled up with zeros; an empty text is one chunk of zeros."""
    n = max(1, -(-(len(data) - settings.width) // settings.step))
    padded = np.zeros((n - 1) * settings.step + settings.chunk, dtype=np.uint8)
    padded[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, settings.chunk)[:: settings.step]


def windows(x: np.ndarray, embedding: np.ndarray, s: Settings) -> np.ndarray:
    """(chunks, places, width x dims): what each filter sees at each place."""
    held = embedding[x]
    seen = np.lib.stride_tricks.sliding_window_view(held, s.width, axis=1)[:, :: s.stride]
    return seen.transpose(0, 1, 3, 2).reshape(len(x), -1, s.width * s.dims)


def pooled(x: np.ndarray, w: dict[str, np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each chunk's greatest answer of each filter, where it is, and the windows."""
    seen = windows(x, w["embedding"], s)
    answer = seen @ w["filters"]
    at = answer.argmax(axis=1)
    top = np.take_along_axis(answer, at[:, None, :], axis=1)[:, 0] + w["bias"]
    return np.maximum(top, 0), at, seen


def combined(top: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' features from their chunks' answers, and the number of chunks of each."""
    n = np.diff(np.append(starts, len(top)))
    return np.hstack([np.maximum.reduceat(top, starts, axis=0), np.add.reduceat(top, starts, axis=0) / n[:, None]]), n


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logits(parts: list[np.ndarray], model: Model, block: int = 1024) -> np.ndarray:
    """The network's answer for each text, a block of chunks at a time; one text may span many blocks."""
    s, w = model.settings, model.weights
    best = np.full((len(parts), s.filters), -np.inf, dtype=np.float32)
    total = np.zeros((len(parts), s.filters), dtype=np.float64)
    n = np.array([len(p) for p in parts])
    whole, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), n)
    for at in range(0, len(whole), block):
        seen = windows(whole[at : at + block], w["embedding"], s)
        top = np.maximum((seen @ w["filters"]).max(axis=1) + w["bias"], 0)
        who = owner[at : at + block]
        starts = np.flatnonzero(np.diff(who, prepend=-1))
        best[who[starts]] = np.maximum(best[who[starts]], np.maximum.reduceat(top, starts, axis=0))
        total[who[starts]] += np.add.reduceat(top, starts, axis=0, dtype=np.float64)
    return np.hstack([best, total / n[:, None]]) @ w["out"] + w["out_bias"][0]


def fit(texts: list[bytes], y: np.ndarray, settings: Settings) -> Model:
    """The network by Adam on cross-entropy; only the place of a filter's greatest answer learns."""
    s, rng = settings, np.random.default_rng(settings.seed)
    w = {
        "embedding": rng.normal(0, 0.5, (256, s.dims)).astype(np.float32),
        "filters": rng.normal(0, (s.width * s.dims) ** -0.5, (s.width * s.dims, s.filters)).astype(np.float32),
        "bias": np.zeros(s.filters, dtype=np.float32),
        "out": rng.normal(0, 0.1, 2 * s.filters).astype(np.float32),
        "out_bias": np.zeros(1, dtype=np.float32),
    }
    model = Model(s, w)
    parts = [chunks(t, s) for t in texts]
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    rounds = 0
    for epoch in range(s.epochs):
        order = rng.permutation(len(parts))
        for at in range(0, len(order), s.batch):
            some = order[at : at + s.batch]
            x = np.concatenate([parts[i] for i in some])
            starts = np.concatenate([[0], np.cumsum([len(parts[i]) for i in some])[:-1]])
            top, place, seen = pooled(x, w, s)
            features, n = combined(top, starts)
            wrong = ((sigmoid(features @ w["out"] + w["out_bias"][0]) - y[some]) / len(some)).astype(np.float32)
            back = np.outer(wrong, w["out"])
            owner = np.repeat(np.arange(len(some)), n)
            to_top = (back[:, s.filters :] / n[:, None])[owner]
            to_top += back[:, : s.filters][owner] * (top == features[:, : s.filters][owner])
            to_top *= top > 0
            taken = np.take_along_axis(seen, place[:, :, None], axis=1)  # chunks x filters x (width x dims)
            grad = {
                "out": features.T @ wrong,
                "out_bias": wrong.sum(keepdims=True),
                "filters": np.einsum("ckf,ck->fk", taken, to_top),
                "bias": to_top.sum(axis=0),
            }
            into = (to_top[:, :, None] * w["filters"].T).reshape(-1, s.dims)
            letters = np.take_along_axis(x[:, None, :], place[:, :, None] * s.stride + np.arange(s.width), axis=2).ravel()
            grad["embedding"] = np.stack([np.bincount(letters, weights=into[:, d], minlength=256) for d in range(s.dims)], axis=1)
            rounds += 1
            rate = s.rate * (1 - epoch / s.epochs)
            for k in w:
                g = grad[k].astype(np.float32) + s.decay * w[k]
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                w[k] -= (rate * (mean[k] / (1 - 0.9**rounds)) / (np.sqrt(square[k] / (1 - 0.999**rounds)) + 1e-8)).astype(np.float32)
    return model


def calibrated(model: Model, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Scale and shift of the network's answers on spare rows, which weigh as often as their class occurs."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        slope = np.array([(weight * (p - y) * z).sum() + 1e-2 * (a - 1), (weight * (p - y)).sum() + 1e-3 * b])
        h = weight * p * (1 - p)
        bend = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        move = np.clip(np.linalg.solve(bend, slope), -1, 1)
        a, b = max(0.05, a - move[0]), b - move[1]
    return Model(model.settings, model.weights, a, b)


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Learn from `labels` (doc_id, quality): 1 is good, 0 is not; other values and rows without a text to them teach nothing.

    A label that is repeated counts once, contradicting ones each; of repeated documents the
    smallest text is taken.  Labels of one kind alone, or none, give a model that tells that
    kind (or one half) for every text.
    """
    s = settings or Settings()
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    count = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(count) < 2:
        return constant(s, *count)
    share = F.when(F.col("quality") == 1, s.per_class / count[1]).otherwise(s.per_class / count[0])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(s.seed)), F.lit(1 << 30)) / float(1 << 30)
    some = known.where(draw < share)  # about 2 x per_class rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("body")).where(F.octet_length("body") <= s.text_bytes)
    rows = rows.join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min("body").alias("body"))
    got = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["quality"]))
    y = np.array([r["quality"] for r in got], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        return constant(s, *set(y.astype(int).tolist()))
    texts = [bytes(r["body"]) for r in got]
    spare = np.random.default_rng(s.seed).random(len(texts)) < s.spare
    for kind in (0, 1):  # each kind on both sides, where it has two rows
        mine = np.flatnonzero(y == kind)
        if len(mine) > 1:
            spare[mine[0]], spare[mine[1]] = False, True
        else:
            spare[mine] = False
    model = fit([t for t, out in zip(texts, spare, strict=True) if not out], y[~spare], s)
    if len(set(y[spare].tolist())) < 2:
        return model
    z = logits([chunks(t, s) for t, out in zip(texts, spare, strict=True) if out], model)
    here = np.bincount(y[spare].astype(int), minlength=2)
    weight = np.where(y[spare] == 1, count[1] / here[1], count[0] / here[0]) * spare.sum() / sum(count.values())
    return calibrated(model, z, y[spare], weight)


def constant(settings: Settings, *kinds: int) -> Model:
    """A model that was shown one kind of label, or none."""
    s = settings
    w = {"embedding": np.zeros((256, s.dims), np.float32), "filters": np.zeros((s.width * s.dims, s.filters), np.float32), "bias": np.zeros(s.filters, np.float32), "out": np.zeros(2 * s.filters, np.float32), "out_bias": np.zeros(1, np.float32)}
    return Model(s, w, 1.0, {(0,): -4.0, (1,): 4.0}.get(kinds, 0.0))


def score(docs: DataFrame, model: Model, text: str = "text", block_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, score) for every row: the probability that its label is 1, from the whole text.

    Null texts count as empty; an empty text gets the score of its one empty chunk.  Repeated
    rows repeat it, an empty table gives none, other columns are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            out: list[float] = []
            parts: list[np.ndarray] = []
            size = 0
            for raw in byte_rows(batch, "body"):
                parts.append(chunks(raw, m.settings))
                size += len(raw)
                if size >= block_bytes:
                    out += sigmoid(m.scale * logits(parts, m) + m.shift).tolist()
                    parts, size = [], 0
            if parts:
                out += sigmoid(m.scale * logits(parts, m) + m.shift).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body(text).alias("body"))
    return rows.mapInArrow(run, "doc_id long, score double")
