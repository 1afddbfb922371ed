"""Texts that a weaker hash takes for one another, added tokens, and rows that recur thousands of times."""

from __future__ import annotations

import time

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers as P
from arborist.llm import bpe, class_lm, license_scan, near_dedup, packing, quality_rules
from arborist.llm.words import chunks

from .conftest import SCHEMA
from .test_words import thue_morse

HARD = [w for n in (1024, 4096) for w in thue_morse(n)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(2)


def test_bpe(spark):
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = [*HARD, " ".join(HARD)]
    for sample in (bpe.SAMPLE_DOCS, 1):
        got = {r.doc_id: list(r.ids) for r in bpe.encode(frame(spark, texts), sample_docs=sample).collect()}
        assert got == {i: lib.encode_ordinary(t) for i, t in enumerate(texts)}


def test_packing_and_added_tokens():
    import pyarrow as pa

    token = "<|endoftext|>"
    texts = [*HARD, f"a{token}b", token, f"x {token}{token} y", "<|endo", "ftext|>", None, "", f" {token} ", f"don't{token}'s", "<|endoftext", f"{token}|>", f"tail \n{token}"]
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    units = packing.encoder(P.path("byte_bpe_50k.json"))
    for chunk in chunks(iter([batch])):
        ids, at = units.ids(chunk)
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_lines_and_phrases(spark):
    a, b = thue_morse(1024)
    rows = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, [f"{a}\n{b}\n{a}", " ".join([a, b] * 6), " ".join([a] * 6)])).collect()}
    assert [rows[i].n_dup_lines for i in range(3)] == [1, 0, 0]
    assert [rows[i].n_repeat_words for i in range(3)] == [0, 12, 6]
    model = class_lm.fit(frame(spark, [a, a, b]))
    scored = {r.doc_id: r for r in class_lm.score(frame(spark, [a, b, thue_morse(2048)[0]]), *model).collect()}
    assert [scored[i].n_known for i in range(3)] == [2, 2, 1] and scored[0].base_score > scored[1].base_score
    bags = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, [a, b, a])).collect()}
    assert bags == {0: 0, 1: 1, 2: 0}
    found = license_scan.digest(license_scan.scan(frame(spark, ["x All Rights RESERVED y cc by", "cc bY.", "ccby"]))).collect()
    assert sorted((r.doc_id, r.n_base) for r in found) == [(0, 2), (1, 1), (2, 0)]


N = 20_000


def rows_of(spark, doc_id, text):
    rows = spark.range(N).select(doc_id.cast("bigint").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).cast("bigint").alias("n_chars"))
    return rows.select(*[f.name for f in spark.createDataFrame([], SCHEMA).schema]).repartition(4)


def timed(spark, rows):
    import corpus_pipeline

    began = time.time()
    return corpus_pipeline.by_nearness(spark, rows, "").count(), time.time() - began


@pytest.fixture(scope="module")
def distinct(spark):
    """Texts in groups of seven copies with ids of their own: the rows kept, and the seconds of a second run."""
    text = F.concat(F.lit("w"), (F.col("id") % 400).cast("string"), F.lit(" a b c d e f g h i "), F.floor(F.col("id") / 7).cast("string"))
    rows = rows_of(spark, F.col("id"), text)
    timed(spark, rows)
    return text, *timed(spark, rows)


def test_null_ids_cost_no_square(spark, distinct):
    text, kept, took = distinct
    got, seconds = timed(spark, rows_of(spark, F.lit(None), text))
    assert got == kept and seconds < 2 * took + 10


def test_repeated_rows_cost_no_square(spark, distinct):
    got, seconds = timed(spark, rows_of(spark, F.lit(5), F.lit("one row that is here again and again")))
    assert got == 1 and seconds < 2 * distinct[2] + 10


def test_span_hash_is_the_same_in_every_version():
    assert np.array_equal(near_dedup.span_hashes(np.frombuffer(b"Spark", np.uint8), np.array([0]), np.array([5]), True), near_dedup.span_hashes(np.frombuffer(b"sPARK", np.uint8), np.array([0]), np.array([5]), True))
