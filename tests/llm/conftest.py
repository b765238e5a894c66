import random

import pytest


def invented(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    syllables = "the ing on er ti re an th nd at ou es en".split()
    return ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): prose with copies, shared passages, a run, nulls, empties, ties, repeated rows and a null id."""
    passage = " ".join(invented(1, 130))
    texts = [" ".join(invented(10 + k, 60 + 17 * k)) for k in range(12)]
    texts += [texts[3], texts[4].replace("the", "these", 1), f"{texts[5]} {passage}", f"{passage}\n{texts[6]}", "É à " + passage[:600]]
    texts += [None, "", "   ", "a " * 500, "one", "ab" * 600]
    out = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    random.Random(5).shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "y", 7, b"z") for i, t in rows], "doc_id long, text string, score string, chunk string, bucket int, body binary").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
