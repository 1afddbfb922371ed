"""The corpus pipeline: language ID, quality rules, near-duplicates, personal data, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet
and read again as the next one's docs.  All but the last keep the columns of documents.

Cases: further columns, also such as are named alike but for case, are left out.  Verdicts are by row, so null and repeated
ids and repeated rows are judged by their content; null and empty texts go with the first stage, as they have no language.  Of
a near-duplicate class one row stays: of the least doc_id, or a null one if there is no other; ties, by a hash of the row.  An
empty table gives an empty one at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborist.llm import language_id, near_dedup, packing, pii, quality_rules
from arborist.llm.spark_io import held_out, pick, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents alone."""
    return pick(docs, doc_id="bigint", text="string", lang="string", source="string", n_chars="bigint")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row's whole content, as ids may be null or recur; rows of one key are alike in all columns."""
    nulls = F.concat(*(F.col(c).isNull().cast("string") for c in COLUMNS))
    return docs.select(*COLUMNS, F.xxhash64(nulls, *COLUMNS).alias("_row"))


def _by_row(rows: DataFrame) -> DataFrame:
    """The rows with their keys as ids."""
    return rows.drop("doc_id").withColumnRenamed("_row", "doc_id")


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language (null or letterless texts); others stay as they are."""
    docs = _documents(docs)
    references = language_id.fit(docs.where(~held_out(3, 1)))
    rows = _keyed(docs)
    kept = language_id.predict(_by_row(rows), references).where(F.col("lang_pred") != "und").select(F.col("doc_id").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rule or whose perplexity lies outside their language's band."""
    rows = _keyed(_documents(docs))
    kept = quality_rules.quality_rules(_by_row(rows)).where("kept").select(F.col("doc_id").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def by_nearness(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate class: of the least doc_id, or a null one if there is no other.

    Classes are of texts, so rows meet theirs by the digest of their text, a row a text on that side; rows without words stay.
    """
    rows = near_dedup.digested(_keyed(_documents(docs)).withColumn("_more", F.xxhash64(F.lit(1), "_row", *COLUMNS)))
    classes = near_dedup.text_classes(_documents(docs))
    of = [F.coalesce("label", "_row").alias("class"), F.when(F.col("label").isNull(), F.col("_more")).alias("alone")]
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row", "_more")
    named = rows.select("doc_id", "_row", "_more", "digest").join(classes, "digest", "left")
    kept = named.groupBy(*of).agg(F.min(order).alias("first")).select("first._row", "first._more")
    return rows.join(kept, ["_row", "_more"], "left_semi").dropDuplicates(["_row", "_more"]).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and disclosing terms in texts; n_chars follows."""
    return pii.sanitise(_documents(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents by sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", by_language),
    ("quality_rules", by_quality),
    ("near_dedup", by_nearness),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Suffix automata, language models and signatures have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
