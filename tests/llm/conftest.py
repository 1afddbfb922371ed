from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or nt", "fr": "ou en eau é è ai re ment tion que aux la", "de": "sch ung en er ß ö ä ein keit lich zu"}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 3))) + ("," if rng.random() < 0.1 else "") for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(5)
    out = []
    for i in range(60):
        lang = ("en", "fr", "de")[i % 3]
        out.append((i, "\n".join(sentence(rng, lang, 25).capitalize() + "." for _ in range(rng.randint(1, 4))), lang, f"s{i % 4}"))
    base = out[0][1]
    words = base.split(" ")
    for k in range(4):  # near copies: one word of many differs
        w = list(words)
        w[3 + 2 * k] = "changed"
        out.append((100 + k, " ".join(w), "en", "s0"))
    out += [(110 + k, out[1][1], "fr", "s1") for k in range(5)]  # exact copies
    out += [
        (200, None, "en", "s0"),
        (201, "", None, None),
        (202, "  \n\t ", "en", "s0"),
        (203, "x", "en", None),
        (204, "12 34 !!", None, "s0"),
        (205, "same line\nsame line\n\nsame line", "en", "s0"),
        (206, "a b c d e a b c d e a b c d e", "en", "s0"),
        (207, "Write to ann.lee@mail.example.com or +1 (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.255 300.1.1.1", "en", "s0"),
        (208, "Licensed under CC BY-NC 4.0.\nAll rights reserved. GENERAL  public, License", "en", "s0"),
        (209, "a" * 20_000 + "@", "en", "s0"),
        (210, "don't  stop  x é, “q” 日本語 \U0001f600\x1c's 'll", "en", "s0"),
        (None, "no id at all here", "en", "s0"),
        (203, "x", "en", None),
    ]
    return [(a, b, c, d, len(b) if b is not None else None) for a, b, c, d in out]


@pytest.fixture(scope="session")
def fixture_rows():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """docs with further columns whose names clash with those that operators use, but for case."""
    from pyspark.sql import functions as F

    more = ("TEXT", "score", "_id", "pivot", "text_key", "Lang_Pred", "h")
    return docs.select("*", *(F.lit(7).alias(n) for n in more))
