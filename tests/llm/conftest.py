import os
import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    return SF


@pytest.fixture(scope="session")
def docs():
    """(doc_id, text, lang, source, n_chars): nulls, empty, long, repeated and near-equal texts."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdeio") for _ in range(r.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [text(n) for n in (3, 2, 1, 60, 60, 200, 400)]
    near = [base[5].replace(" ", "  ").upper(), base[5] + " tail", " ".join(base[6].split()[:-4]), " ".join(base[6].split()[8:])]
    odd = [None, "", " \n\t ", "é", "🙂 🙂 🙂 🙂", "a b", "a b c", "12345 678", "word " * 3000, "x" * 50_000, "1 " * 9_000, "a." * 4_000 + "@b.c", "\x00\x1c\x85  nul", "<|endoftext|> a <|endoftext|>"]
    texts = base + near + odd + base[3:5] + [None]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s0", "s0", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [(None, base[3], "en", "s0", 1), (None, None, None, None, None), rows[3], rows[0]]


@pytest.fixture(scope="session")
def table(spark, docs):
    """The documents with extra columns of names that operators use themselves."""
    extra = "row id t w p s l words counts lang_pred score ids decoded n s1 s2 keys key features value start spans base seen block deal pos media samples frames kept path clean".split()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *[f"'{c}' AS `{c}`" for c in extra]).repartition(3).cache()
