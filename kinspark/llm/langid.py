"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams; a linear layer and a softmax
give language probabilities.  Both are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows.  A temperature and a rejection threshold are calibrated on a
part of the sample that training did not see, and on decoys: its texts with their letters
shuffled, which are no language.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_rows

#: ASCII that is no letter becomes a blank.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    """sample: at most about so many labelled rows are fitted, dealt evenly to the languages.

    languages: the commonest labels, so many at most, are learned; rarer ones are never told.
    """

    sample: int = 2400
    languages: int = 400
    buckets: int = 1 << 14
    dim: int = 16
    orders: tuple[int, ...] = (2, 3, 4)
    epochs: int = 12
    batch: int = 64
    rate: float = 0.4
    #: how many texts that are no language, or told wrong, are let through rather than reject a right one
    price: float = 10.0
    seed: int = 7


def normalised(text: bytes) -> bytes:
    """Lower case, everything in ASCII but letters blank, words joined by one blank, blanks around; empty without a letter."""
    lowered = text.decode("utf-8", "replace").lower().encode()
    words = lowered.translate(_LETTERS).split()
    out = b" ".join(words)
    if not any(c.isalpha() for c in out.decode("utf-8", "replace")):
        return b""
    return b" " + out + b" "


def grams(data: np.ndarray, orders: tuple[int, ...], buckets: int) -> Iterator[np.ndarray]:
    """Hashed n-gram numbers, order by order; position i has the n-gram that starts there."""
    wide = data.astype(np.uint32)
    for n in orders:
        h = np.full(max(0, len(wide) - n + 1), 0x811C9DC5 ^ n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ wide[k : len(wide) - n + 1 + k]) * np.uint32(0x01000193)
        yield ((h ^ (h >> np.uint32(15))) & np.uint32(buckets - 1)).astype(np.int64)


def features(text: bytes, settings: Settings) -> tuple[np.ndarray, np.ndarray] | None:
    """Bucket numbers and their share of the text's n-grams."""
    data = np.frombuffer(text, dtype=np.uint8)
    counts = np.zeros(settings.buckets)
    for h in grams(data, settings.orders, settings.buckets):
        counts += np.bincount(h, minlength=settings.buckets)
    at = np.flatnonzero(counts)
    return (at, counts[at] / counts.sum()) if len(at) else None


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embedding times linear layer
    bias: np.ndarray
    temperature: float
    threshold: float
    settings: Settings

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """A row per normalised text; empty texts get even odds."""
        logits = np.zeros((len(texts), len(self.languages)))
        for i, text in enumerate(texts):
            total = 0
            data = np.frombuffer(text, dtype=np.uint8)
            for at in range(0, len(data), 1 << 16):  # long texts block by block, n-grams may cross
                for n, h in zip(self.settings.orders, grams(data[at : at + (1 << 16) + max(self.settings.orders) - 1], self.settings.orders, self.settings.buckets), strict=True):
                    h = h[: (1 << 16)]
                    total += len(h)
                    logits[i] += self.table[h].sum(axis=0, dtype=np.float64)
            if total:
                logits[i] = (logits[i] / total + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True, initial=0) if logits.size else 0
        e = np.exp(logits)
        return e / e.sum(axis=1, keepdims=True)


def labelled_sample(rows: DataFrame, settings: Settings):
    """Feature rows of a bounded sample, chosen by a hash of the id, evenly over the languages.

    rows: doc_id, text, lang.  Each text gives its whole n-gram profile and two short windows
    of it, so that short texts are known too.  The windows are training material only.
    """
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(settings.languages).collect()}
    if not counts:
        return [], []
    quota = max(20, settings.sample // len(counts))
    spin = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(settings.seed)), F.lit(1_000_000))
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted |= (F.col("lang") == lang) & (spin < int(min(1, quota / n) * 1_000_000 + 1))
    chosen = rows.where(wanted).select("lang", F.col("text").cast("binary").alias("body"), spin.alias("spin"))
    def profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"lang": [], "spin": [], "at": [], "share": []}
            for lang, spin_, text in zip(batch.column("lang"), batch.column("spin"), byte_rows(batch, "body"), strict=True):
                text = normalised(text)
                if not text:
                    continue
                k = spin_.as_py()
                words = text.split()
                first, second = k % len(words), (k * 7919 + 13) % len(words)
                pieces = [(lang.as_py(), x) for x in (text, b" " + b" ".join(words[first : first + 2]) + b" ", b" " + b" ".join(words[second : second + 6]) + b" ")]
                if k % 5 == 0:
                    pieces.append((None, shuffled(text[:4096], k)))
                for told, piece in pieces:
                    if found := features(piece, settings):
                        out["lang"].append(told), out["spin"].append(k)
                        out["at"].append(found[0].astype(np.int32).tobytes())
                        out["share"].append(found[1].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("spin", pa.int64()), ("at", pa.binary()), ("share", pa.binary())]))

    got = chosen.mapInArrow(profile, "lang string, spin long, at binary, share binary").collect()
    return sorted(got, key=lambda r: (r["spin"], r["lang"] or "", bytes(r["at"]))), sorted(counts)


def shuffled(text: bytes, seed: int) -> bytes:
    """A text's characters in any order: its letters, but no language."""
    letters = np.array(list(text.decode("utf-8", "ignore")))
    return b" " + b" ".join("".join(np.random.default_rng(seed).permutation(letters)).encode().split()) + b" "


def train(rows: DataFrame, settings: Settings | None = None) -> Model:
    """Fit on labelled rows (doc_id, text, lang; null langs are left out)."""
    settings = settings or Settings()
    found, languages = labelled_sample(rows.where("lang is not null and text is not null"), settings)
    decoys, found = [r for r in found if r["lang"] is None], [r for r in found if r["lang"] is not None]
    size = len(languages)
    if not found:
        return Model(languages or ["und"], np.zeros((settings.buckets, max(1, size)), dtype=np.float32), np.zeros(max(1, size)), 1.0, 0.0, settings)
    rng = np.random.default_rng(settings.seed)
    y = np.array([languages.index(r["lang"]) for r in found])
    held = np.array([r["spin"] % 5 == 0 for r in found])
    if held.all() or not held.any():
        held = np.zeros(len(found), dtype=bool)
    sparse = [(np.frombuffer(r["at"], dtype=np.int32), np.frombuffer(r["share"], dtype=np.float32)) for r in found]
    embedding = rng.normal(0, 0.1, (settings.buckets, settings.dim)).astype(np.float32)
    layer = np.zeros((settings.dim, size), dtype=np.float32)
    bias = np.zeros(size, dtype=np.float32)
    weight = np.bincount(y, minlength=size).astype(np.float64)
    weight = np.where(weight > 0, weight.sum() / np.maximum(weight, 1) / size, 0)
    fit = np.flatnonzero(~held)

    def dense(which: np.ndarray) -> np.ndarray:
        x = np.zeros((len(which), settings.buckets), dtype=np.float32)
        for k, i in enumerate(which):
            x[k, sparse[i][0]] = sparse[i][1]
        return x

    layer += rng.normal(0, 0.1, layer.shape).astype(np.float32)
    steps = 0
    total = settings.epochs * -(-len(fit) // settings.batch)
    for _ in range(settings.epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), settings.batch):
            which = fit[at : at + settings.batch]
            x = dense(which)
            hidden = x @ embedding
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(which)), y[which]] -= 1
            p *= (weight[y[which]] / len(which))[:, None]
            rate = settings.rate * (1 - steps / total) * 50
            # shares are small (a text's n-grams sum to one), so the embedding takes longer steps
            back = p @ layer.T
            used = np.unique(np.concatenate([sparse[i][0] for i in which]))
            layer -= rate / 50 * (hidden.T @ p)
            bias -= rate / 50 * p.sum(axis=0)
            embedding[used] -= rate * (x[:, used].T @ back)
            steps += 1
    table = embedding @ layer
    model = Model(languages, table.astype(np.float32), bias.astype(np.float64), 1.0, 0.0, settings)
    which = np.flatnonzero(held) if held.any() else np.arange(len(found))

    def logits_of(sparse: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([share @ table[at] + bias for at, share in sparse], dtype=np.float64).reshape(-1, size)

    none = [(np.frombuffer(r["at"], dtype=np.int32), np.frombuffer(r["share"], dtype=np.float32)) for r in decoys]
    model.temperature, model.threshold = calibrate(logits_of([sparse[i] for i in which]), y[which], logits_of(none), settings.price)
    return model


def calibrate(logits: np.ndarray, y: np.ndarray, none: np.ndarray, price: float) -> tuple[float, float]:
    """The temperature of least log loss, and the confidence below which rejection costs least.

    A wrong answer or an answer to a decoy costs 1, a right answer that is rejected costs `price`.
    """

    def probabilities(t: float, logits: np.ndarray = logits) -> np.ndarray:
        z = logits / t
        e = np.exp(z - z.max(axis=1, keepdims=True, initial=-np.inf))
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.02, 20, 60)
    loss = [-np.log(np.maximum(probabilities(t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    best = float(grid[int(np.argmin(loss))])
    p = probabilities(best)
    right = p.argmax(axis=1) == y
    sure = np.concatenate([p.max(axis=1), probabilities(best, none).max(axis=1)])
    cost = np.concatenate([np.where(right, price, -1.0), np.full(len(none), -1.0)])
    order = np.argsort(sure, kind="stable")
    # what rejecting all below the k-th confidence costs; the lowest of equal ones
    total = np.append(0.0, np.cumsum(cost[order]))
    k = int(np.argmin(total))
    return best, float(sure[order[k]]) if k < len(sure) else float(np.nextafter(sure[order[-1]], 2))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """docs' doc_id (or the columns of `keep`) with lang_pred, score and rejected.

    Whole texts are read.  Null and empty texts and texts without a letter are `und` with score
    0 and rejected; others get a learned language, rejected below the calibrated confidence.
    Repeated rows are told alike.  Other columns of docs play no part; `keep` must not name the
    three that are added (a struct can hold any columns).
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = keep or [F.col("doc_id").cast("long").alias("doc_id")]
    rows = docs.select(*columns, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_body"))
    kept = [c for c in rows.columns if c != "_body"]
    schema = rows.drop("_body").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = [normalised(x) for x in byte_rows(batch, "_body")]
            p = m.probabilities(texts)
            best = p.argmax(axis=1)
            score = np.array([float(p[i, k]) if t else 0.0 for i, (k, t) in enumerate(zip(best, texts, strict=True))])
            lang = [m.languages[k] if t else "und" for k, t in zip(best, texts, strict=True)]
            out = [batch.column(c) for c in kept] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([not t or s < m.threshold for t, s in zip(texts, score, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, schema)
