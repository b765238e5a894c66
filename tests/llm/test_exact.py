"""Operators with exact results, against brute force."""

import hashlib
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from kinspark.llm import decontam, prefixfree, recompression, simhash


def removed_bytes(texts, window):
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).digest()))
    return out


@pytest.mark.parametrize("settings", [prefixfree.Settings(), prefixfree.Settings(window=60, reach=30, chunk_bytes=4000), prefixfree.Settings(window=60, reach=30, chunk_bytes=4000, hot=1)])
def test_prefixfree(docs, rows, settings):
    found = prefixfree.remove_repeats(docs, settings=settings, digest=True).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found), key=str)
    want = removed_bytes([(t or "").encode() for _, t in rows], settings.window)
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=str)


def test_prefixfree_hot_passage(spark):
    """One passage between ever new surroundings, some of which agree for a while."""
    import random

    def invented(seed, n):
        rng = random.Random(seed)
        return ["".join(rng.choices("the ing on er ti re an".split(), k=rng.randint(1, 3))) for _ in range(n)]

    passage = " ".join(invented(1, 80))
    rows = [(i, f"{' '.join(invented(100 + i, 9))} {' '.join(invented(50 + i % 5, 6))} {passage} {' '.join(invented(70 + i % 7, 7))} {' '.join(invented(300 + i, 9))}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    settings = prefixfree.Settings(window=120, reach=60, chunk_bytes=3000, hot=5)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in prefixfree.remove_repeats(docs, settings=settings, digest=True).collect())
    assert got == [(i, *w) for (i, _), w in zip(rows, removed_bytes([t.encode() for _, t in rows], 120))]


def late_words(rows, window):
    far = float("inf")
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, far), far if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (far if i is None else i):
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).digest()))
    return out


@pytest.mark.parametrize("settings", [recompression.Settings(), recompression.Settings(window=5, chunk_bytes=3000)])
def test_recompression(docs, rows, settings):
    found = recompression.remove_repeats(docs, settings=settings, digest=True).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in found), key=str)
    assert got == sorted(late_words(rows, settings.window), key=str)


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("limit", [512, 2])
def test_simhash(docs, rows, limit):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = Counter((i, simhash.signed(prints[k]), least.get(find(k))) for k, (i, _) in enumerate(rows))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs, limit=limit).collect()) == want


def test_near_links_split_large_buckets(spark):
    """Dense fingerprints: every pair within the radius stays connected, at every bucket limit."""
    values = sorted({(a << 1 | b << 20 | c << 41) for a in range(6) for b in range(6) for c in range(6)})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    for limit in (4, 64):
        links = simhash.near_links(fps, 3, limit).collect()
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in links:
            assert (r["a"] ^ r["b"]).bit_count() <= 3 * len(values)
            root[find(r["a"])] = find(r["b"])
        assert all(find(a) == find(b) for a in values for b in values if (a ^ b).bit_count() <= 3)


def test_covering_masks():
    masks = simhash.covering_masks(list(range(64)), 3)
    assert len(masks) == 15
    for i in range(64):
        for j in range(i):
            for k in range(0, j, 5):
                bits = 1 << i | 1 << j | 1 << k
                assert any(not m & bits for m in masks)


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short, item Here!"), (3, None), (4, ""), (None, "alpha beta"), (11, "beta gamma delta epsilon zeta eta theta iota kappa lambda")]


def hits(text, items, window=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    gone, found = [False] * len(words), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        if item is None or not w:
            continue
        n = min(window, len(w))
        for g in {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) == g:
                    gone[k : k + n] = [True] * n
                    found.add(item)
    return len(words), sum(gone), sorted(found)


def test_decontamination(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = [None, "", "x " + ITEMS[0][1] + " y", "beta gamma delta epsilon zeta eta theta iota kappa lambda", "SHORT item -- here; short item", "alpha beta gamma", "item here short item here", "beta gamma delta epsilon zeta eta theta iota kappa alpha " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (1 << 20, 40):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in decontam.decontaminate(docs, items, block_bytes=block).collect()}
        assert got == {i: hits(t, ITEMS) for i, t in enumerate(texts)}
    kept = {r["doc_id"]: r["text"] for r in decontam.cleaned(docs, items).collect()}
    more = docs.withColumn("spans", F.lit("mine")).withColumn("n_chars", F.length("text"))
    for block in (1 << 20, 40):
        out = decontam.cleaned(more, items, block_bytes=block).collect()
        assert {r["doc_id"]: r["text"] for r in out} == kept and all(r["spans"] == "mine" and (r["text"] is None or r["n_chars"] == len(r["text"])) for r in out)
    assert kept[2] == "x  y" if 2 in kept else hits(texts[2], ITEMS)[1] >= 0.8 * 14
    assert kept[5] == "alpha beta gamma" and kept[0] is None and 3 not in kept
    assert decontam.decontaminate(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.cleaned(docs, items.limit(0)).count() == docs.count() and decontam.cleaned(docs.limit(0), items).count() == 0


def test_empty_tables(empty):
    assert prefixfree.remove_repeats(empty).count() == 0
    assert recompression.remove_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_extra_columns_do_not_clash(docs):
    assert prefixfree.remove_repeats(docs.withColumn("kept", F.lit(1))).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
