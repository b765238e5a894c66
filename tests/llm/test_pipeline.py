"""The pipeline against a plain version of its stages on a small table."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from kinspark.llm import pii, simhash

EN = "the house of this man stood with that garden and some clear water near an old town road "
DE = "und das haus mit dem garten ist nicht ein wasser oder der weg von einer stadt am fluss "


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for i in range(60):
        words = (EN if i % 2 else DE).split()
        text = " ".join(rng.permutation(words * 3)) + f" number{i} word{i * 7}"
        out.append((i, text, "en" if i % 2 else "de", "s", len(text)))
    out.append((60, out[5][1], "en", "s", None))  # an exact copy
    out.append((5, *out[5][1:]))  # a repeated row
    out.append((61, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda", "en", "s", 3))
    out.append((62, EN * 4 + "alpha beta gamma delta epsilon zeta eta theta iota kappa. " + EN, None, "s", 3))
    out.append((63, EN * 3 + "call 4041894974608795 or mail x.y@mail.example.com", "en", "s", 3))
    out += [(64, None, "en", "s", 0), (65, "", None, None, 0), (66, "12 34", "de", "s", 5), (None, DE * 5 + "etwas anderes", "de", "s", 1)]
    return out


def test_stages(spark, tmp_path, rows):
    sf_dir = table(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == names
        kept[name] = [r.asDict() for r in docs.collect()]
    told = [r["doc_id"] for r in kept["language"]]
    assert not {64, 65, 66} & set(told) and set(range(60)) <= set(told) and told.count(5) == 2 and None in told
    # one document of each class, the smallest id
    prints = {r["doc_id"]: simhash.fingerprint_of(r["text"].encode()) for r in kept["language"]}
    ids = sorted((i for i in prints if i is not None))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {i for i in ids if find(i) == i}
    got = [r["doc_id"] for r in kept["near_duplicates"]]
    assert sorted(i for i in got if i is not None) == sorted(want) and 60 not in got
    clean = {r["doc_id"]: r for r in kept["decontamination"]}
    assert 61 not in clean and "kappa" not in clean[62]["text"] and clean[62]["n_chars"] == len(clean[62]["text"])
    before = {r["doc_id"]: r for r in kept["near_duplicates"]}
    assert all(clean[i] == before[i] for i in clean if i != 62)
    masked = {r["doc_id"]: r for r in kept["pii"]}
    assert "4041894974608795" not in masked[63]["text"] and "x.y@" not in masked[63]["text"] and re.search(r"call 4\d{15} or mail \w\.\w@\w{4}\.\w{7}\.com$", masked[63]["text"])
    assert all(masked[i] == clean[i] for i in masked if i != 63) and len(masked) == len(clean)


def test_run_packs_what_is_left(spark, tmp_path, rows):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    from kinspark.llm.queries import tokenizer

    sf_dir = table(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.conf.set(pii.KEY_SETTING, "k")  # without one each run draws its own
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    t = tokenizers.Tokenizer.from_file(tokenizer())
    want = []
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((r["doc_id"], 0, 0, len(ids), zlib.crc32(ids.tobytes())))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    spark.conf.unset(pii.KEY_SETTING)
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert len({r["sequence_id"] for r in got}) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_near_duplicates_keep_unlike_rows_whatever_their_ids(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.permutation(EN.split() * 3)) + f" number{i}" for i in range(6)]
    rows = [(None, texts[0], "a"), (None, texts[1], "b"), (None, texts[1], "c"), (None, texts[2], "d"), (None, texts[3], "e"),
            (7, texts[3], "f"), (7, texts[4], "g"), (7, texts[4], "h"), (9, texts[4], "i"), (9, texts[5], "j"), (None, None, "k"), (None, "", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    got = got.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got if r["text"]), key=str) == sorted([(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[5])], key=str)
    assert len(got) == 7


def test_stages_with_clashing_and_missing_columns(spark, tmp_path, rows):
    """Columns named as the operators' own stay as they are; lang and n_chars may be absent."""
    sf_dir = table(spark, tmp_path, rows)
    clash = ["score", "rejected", "lang_pred", "n_pii", "pii_kinds", "_found", "_made", "_row", "row", "fp", "chunk", "component", "body", "_body"]
    data = [(r[0], r[1], r[2], *[f"{c}{i}" for c in clash]) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(data, ", ".join(["doc_id long", "text string", "lang string", *[f"{c} string" for c in clash]])).repartition(3)
    left = {c: {r[3 + k] for r in data} for k, c in enumerate(clash)}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == before
        got = docs.collect()
        assert len(got) > 40 and all(r[c] in left[c] for r in got for c in clash)
        docs = spark.createDataFrame(got, docs.schema)
    assert corpus_pipeline.packed(spark, docs, sf_dir).count() == len(got)
    bare = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        bare = stage(spark, bare, sf_dir)
        assert bare.columns == ["doc_id", "text"] and bare.count() > 40, name
    assert corpus_pipeline.language(spark, bare, sf_dir).columns == ["doc_id", "text"]


def test_stages_keep_empty_tables_empty(spark, tmp_path, rows):
    sf_dir = table(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
