"""Quality network, hard negatives and periodic runs, against brute force, SQL and held-out rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.llm import hardneg, periods, quality, queries

# ---------------------------------------------------------------- periodic runs


def all_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def told(doc_id, words):
    found = all_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    rest = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())


def periodic_rows(docs):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        words = [rng.choice("ab" if i % 3 else "abcdefgh") + ("é" if i % 5 == 0 else "") for _ in range(rng.randint(0, 90))]
        rows.append((i, rng.choice([" ", "\t", " \n"]).join(words)))
    return rows + [(1000 + k, "x y " * (1 << k)) for k in range(5)] + [(2000, None), (2001, ""), (2002, " \x0b "), (None, "z " * 9), (3, rows[3][1]), (2003, " ".join(map(str, range(30000))) + " q" * 30000)]


def test_periods_query(spark, tmp_path, docs):
    """The registered query against brute force: nulls, empties, repeated rows and a text of 60 000 words."""
    rows = periodic_rows(docs)
    short = [r for r in rows if r[0] != 2003]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit("x"), "n": F.lit(1), "w": F.lit(2), "body": F.lit(3)}).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.op13_periods(spark, str(tmp_path)).collect()}
    assert {tuple(told(i, planted(i, t))) for i, t in short} <= got
    assert len(got) == len({r for r in rows}) and any(r[0] == 2003 and r[1] >= 1 for r in got)


def test_periods_names_agree_with_brute_force():
    rng = random.Random(2)
    for _ in range(800):
        n, k = rng.randint(0, 50), rng.choice([1, 2, 3])
        words = [rng.randrange(k) for _ in range(n)]
        if n > 8 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 4))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert periods.runs(np.array(words, dtype=np.int64)) == all_runs(words)


def test_periods_own_interface(docs, rows, empty):
    found = periods.periodic_runs(docs).collect()
    assert sorted((r["doc_id"], r["n_words"]) for r in found if r["doc_id"] is not None) == sorted((i, len((t or "").split())) for i, t in rows if i is not None)
    (run,) = [r for r in found if r["doc_id"] is not None and dict((i, t) for i, t in rows)[r["doc_id"]] == "a " * 500]
    assert [tuple(x) for x in run["runs"]] == [(0, 500, 1)] and bytes(run["collapsed"]) == b"a"
    assert periods.periodic_runs(empty).collect() == []


# ---------------------------------------------------------------- hard negatives


def brute_negatives(rows):
    usable = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        usable.append((i, np.array([int(np.floor(256 * float(np.float32(x)))) for x in v], dtype=object), (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for anchor, v, label in {(i, tuple(v), k) for i, v, k in usable if i % 50 == 0}:
        scored = sorted((-int(sum(x * y for x, y in zip(v, w))), i, k) for i, w, k in usable if i != anchor)
        for s, i, _ in [x for x in scored if x[2] == label][:5]:
            good = [(t, j) for t, j, k in scored if k != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(anchor, i, rank, j, -s, -t) for rank, (t, j) in enumerate(good, 1)]
    return sorted(out)


def vectors(n, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0.2, 0.3, 8).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n + k, [0.25] * 8, k % 2) for k in range(30)]  # ties
    rows += [(n + 40, None, 1), (n + 41, [None] * 8, 1), (n + 42, [float("nan")] * 8, 1), (n + 43, [float("inf")] * 8, 1), (n + 44, [0.5] * 8, None), (n + 45, [0.0] * 8, 1), (None, [0.5] * 8, 1), (50, rows[50][1], rows[50][2]), (51, rows[51][1], rows[51][2])]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, v int, part string, anchor int"


@pytest.mark.parametrize("settings", [hardneg.Settings(), hardneg.Settings(block=40, strip=7, leaf=4, merge=3)])
def test_hard_negatives(spark, settings):
    rows = vectors(310)
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = sorted(tuple(r) for r in hardneg.mine(table, F.col("vec_id") % 50 == 0, label, settings).collect())
    assert got == brute_negatives(rows) and len(got) > 60
    assert hardneg.mine(table.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert hardneg.mine(table, F.lit(False)).collect() == []


def test_hard_negatives_of_unequal_length(spark):
    """A shorter vector counts as filled up with zeros; one too great for a long takes no part."""
    rows = [(0, [1.0, 1.0], 1), (1, [1.0], 1), (2, [0.5, 0.25], 2), (3, [], 2), (4, [3e30], 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hardneg.mine(table, F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 49152)]


def test_strassen():
    rng = np.random.default_rng(1)
    for m, k, n in [(1, 1, 1), (0, 3, 2), (130, 64, 257), (65, 33, 300), (7, 100, 9)]:
        a, b = rng.integers(-(2**27), 2**27, (m, k)), rng.integers(-(2**27), 2**27, (n, k))
        assert (hardneg.strassen(a, b, 8) == a @ b.T).all()


def test_bounds():
    for p in [*range(-50, 50), 2**61 + 7]:
        low, high = hardneg.bounds(p, 50, 95)
        assert 100 * low >= 50 * p > 100 * (low - 1) and 100 * high <= 95 * p < 100 * (high + 1)


def test_sql_of_both(spark, tmp_path):
    """The registered queries against their SQL on a small fixture."""
    rows = [r for r in vectors(310) if r[0] is not None]
    spark.createDataFrame(rows[:-2], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([r for r in periodic_rows(None) if r[0] != 2003], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name, query in (("embeddings", "op12_hardneg"), ("documents", "op13_periods")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        want = con.execute(queries.ORACLE_SQL[query])
        names = [d[0] for d in want.description]
        got = queries.QUERIES[query](spark, str(tmp_path)).select(*names).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


# ---------------------------------------------------------------- quality


def quality_rows(n):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(["the", "ing", "on", "er", "ti", "é"], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 200))]
        good = i % 4 != 0
        rows.append((i, " ".join(words) if good else " | ".join(words).upper(), int(good)))
    return rows


def test_quality_on_held_out_rows(spark, tmp_path):
    rows = quality_rows(400)
    extra = [(900, None, 1), (901, "", 1), (902, "the ing " * 60000, None), (903, "", None), (1, rows[1][1], None), (None, "x", 0)]
    table = spark.createDataFrame([(i, t, "a", 0.5, b"z") for i, t, _ in rows + extra], "doc_id long, text string, lang string, score double, body binary")
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, y, 0) for i, _, y in rows + extra if y is not None] + [(5, None, 1), (6, 7, 1), (7, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op11_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = {r["doc_id"]: r["predicted"] for r in got if r["held_out"]}
    truth = {i: y for i, _, y in rows if i in held}
    assert len(truth) > 50 and sum(held[i] == y for i, y in truth.items()) >= 0.95 * len(truth)
    assert len({round(r["score"], 6) for r in got if r["doc_id"] in (900, 901, 903)}) == 1


def test_quality_reads_the_whole_text(spark):
    """Junk at the end of a long text changes its score; blocks of chunks give what one block gives."""
    rows = quality_rows(300)
    model = quality.train(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    clean = b"the ing on er ti " * 300
    plain, mixed = [quality.chunks(clean, model.settings)], [quality.chunks(clean + b"THE | ING | ON | " * 300, model.settings)]
    assert quality.logits(mixed, model)[0] < quality.logits(plain, model)[0]
    both = plain + mixed + [quality.chunks(b"", model.settings)]
    assert np.allclose(quality.logits(both, model, block=7), quality.logits(both, model), atol=1e-3)


@pytest.mark.parametrize("kinds, low, high", [([], 0.4, 0.6), ([1], 0.9, 1), ([0], 0, 0.1), ([0, 1], 0, 1)])
def test_quality_with_few_labels(spark, kinds, low, high):
    docs = spark.createDataFrame([(0, "a"), (1, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k) for k in kinds], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == 2 and all(low <= r["score"] <= high for r in got)
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).collect() == []


def test_every_byte_is_in_a_chunk():
    for n in (0, 1, 15, 16, 17, 255, 256, 257, 300, 1000, 100001):
        data = bytes(random.Random(n).choices(range(1, 256), k=n))
        s = quality.Settings()
        got = quality.chunks(data, s)
        assert b"".join(bytes(c[: s.step]) for c in got[:-1]) + bytes(got[-1]).rstrip(b"\0") == data and got.shape[1] == s.chunk
