"""Rows that every operator of the subpackage has to stand."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(words):
    long_word, long_text = "a" * 30_000, " ".join(f"{words[i % len(words)]}{i % 97}" for i in range(20_000))
    texts = [
        None, "", " \t\n\x0b\f\r ", "one", "x\x1cy\x85z w", "Ünïcödé ßtraße İstanbul ﬁ e\u0301", long_word, long_text,
        "it's don't 'S we'LL <|endoftext|> a<|startoftext|>b 12345 ...!?", "a  b   c\n\n\n d \u3000\u2028 e", "日本語のテキスト 🙂🙂",
        " ".join(words) * 3, " ".join(words) * 3, "\n".join(["same line here"] * 40),
    ]
    rows = [(i, t, "en", "s0", 0) for i, t in enumerate(texts)]
    rows += [(None, "no id at all " * 30, None, None, None), (3, "one", "en", "s0", 0), (3, "other", "en", None, 0)]
    return rows


@pytest.fixture(scope="session")
def awkward_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    rows = awkward([f"word{i}" for i in range(60)])
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("host", "kept", "label", "ids", "row", "vid", "score", "words", "n")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
