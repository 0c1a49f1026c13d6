import random

import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField(n, t) for n, t in [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("tid", T.StringType()), ("score", T.DoubleType()), ("sequence_id", T.StringType()), ("root", T.StringType()), ("row", T.StringType())]])
SYLLABLES = {"en": "the and ing er th on re sh ly".split(), "fr": "é eau ou è oi qu ai ê ment".split()}


def prose(rng: random.Random, words: int, lang: str = "en") -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def texts() -> list[str | None]:
    """Nulls, empty and blank texts, repeats, near copies, shared passages, a long text, odd characters."""
    rng = random.Random(3)
    base = [prose(rng, n, lang) for n, lang in [(400, "en"), (300, "fr"), (250, "en"), (120, "fr"), (90, "en"), (7, "en"), (5, "fr"), (3, "en"), (1, "en")]]
    passage = prose(rng, 120)
    near = base[0].split()
    near[17], near[200] = "changed", "words"
    odd = ["", None, " ", "\n\n", "12 34 !!", "a\x1cb  c\td ", "Σας ΣΑΣ İ é é ﬁ", "x<|endoftext|>y <|startoftext|>", "😀 中文 \x00 z", "aaaa" * 300, "ab" * 700, "line one\n" * 120]
    return [*base, base[0], base[0], base[5], " ".join(near), passage + " " + base[3], base[2] + " " + passage, prose(rng, 60) + passage + prose(rng, 60), prose(rng, 30_000), *odd]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, [None, "en", "fr"][i % 3], "s", len(t or ""), "x", 0.5, "y", "z", "w") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[4], None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
