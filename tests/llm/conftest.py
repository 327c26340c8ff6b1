import random
from pathlib import Path

import pytest

SMALL = Path("/root/testdata/sf0.001")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, fp string, _t int, word string"


def rows():
    """Texts with copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = make(70)
    texts = [make(rng.randint(1, 150)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[4] + " Ab", "X" + texts[5], make(40) + " " + passage + "\n" + make(20), passage + make(9), make(5) + passage]
    texts += [None, "", " \t\n", "one", "One two", make(4000), "ab " * 300, "a" * 900, "line\nline\nline\nother words here and more of them now"]
    texts += ["🙂é " * 120, "<|endoftext|> a  b   c <|endoftext|>", " lead  and trail \r\n"]
    sources = ["a", "b", "é", "B", None]
    out = [(i, t, "en", sources[i % 5 if i % 3 else 0], None if t is None else len(t), i, "x", 1, None) for i, t in enumerate(texts)]
    return out + [out[10], out[10], (None, texts[7], None, None, 1, 1, None, None, None), (3, make(30), "en", "a", 5, 0, "", 0, "")]


@pytest.fixture(scope="session")
def data():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.createDataFrame(data, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
