"""Corpus, lexical retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..operators.lexical import Bm25, positive_first, ranked
from ..operators.postings import shared_terms
from ..sources import corpus as C
from . import sql as S
from .query import Query

TOP = 100


def _bm25(spark, sf, k=10):
    return Bm25().top(C.index(spark, sf), C.queries(spark, sf), k)


def _metrics(spark, sf, binary=False):
    return E.per_query(_bm25(spark, sf, TOP).select("query_id", "doc_id", "score"), C.judgements(spark, sf), binary=binary)


def _overlap(spark, sf, k):
    rows = shared_terms(C.index(spark, sf), C.queries(spark, sf), k)
    return positive_first(rows, "query_id", "score", "doc_id", k)


def _overlap_metrics(spark, sf):
    return E.per_query(_overlap(spark, sf, TOP).select("query_id", "doc_id", "score"), C.judgements(spark, sf))


def _mean(metric):
    def run(spark, sf):
        return E.means(_metrics(spark, sf)).select("k", "queries", F.round(metric, 6).alias(metric))

    return run


def _deltas(spark, sf):
    at10 = [m.where("k = 10") for m in (_metrics(spark, sf), _overlap_metrics(spark, sf))]
    return E.deltas(*at10)


_RUN = f"SELECT query_id, doc_id, score FROM {S.top('SELECT * FROM bm', TOP)}"
_METRICS = f"WITH {S.BM25}, {S.JUDGED}, m AS ({S.metrics(_RUN)})"
_SHARED = f"""ot AS (SELECT query_id, list_distinct({S.tokens("text")}) AS t FROM q), ow AS (SELECT DISTINCT doc_id, unnest({S.tokens("text")}) AS term FROM documents),
o AS (SELECT query_id, doc_id, count(*)::DOUBLE / any_value(n) AS score FROM (SELECT query_id, len(t) AS n, unnest(t) AS term FROM ot) JOIN ow USING (term) GROUP BY query_id, doc_id)"""
_OVERLAP = f"{S.QUERIES}, {_SHARED}"
_OVERLAP_RUN = f"SELECT query_id, doc_id, score FROM {S.top('SELECT * FROM o', TOP)}"
_BOTH = f"""WITH {S.BM25}, {S.JUDGED}, {_SHARED}, m AS ({S.metrics(_RUN)}), m2 AS ({S.metrics(_OVERLAP_RUN)}),
x AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.ndcg, 0) AS a, coalesce(b.ndcg, 0) AS b, coalesce(a.ndcg, 0) - coalesce(b.ndcg, 0) AS delta
  FROM (SELECT * FROM m WHERE k = 10) a FULL JOIN (SELECT * FROM m2 WHERE k = 10) b ON a.query_id = b.query_id)"""


def _win_loss(spark, sf):
    d = _deltas(spark, sf)
    return d.agg(
        F.count("*").alias("queries"),
        F.round(F.avg((F.col("delta") > 0).cast("double")), 6).alias("wins"),
        F.round(F.avg((F.col("delta") < 0).cast("double")), 6).alias("losses"),
        F.round(F.avg("delta"), 6).alias("mean_delta"),
        F.round(F.percentile("delta", 0.5), 6).alias("median_delta"),
    )


def _composite(spark, sf):
    m = _metrics(spark, sf, binary=True)
    both = m.where("k = 10").select("query_id", "ndcg").join(m.where("k = 100").select("query_id", F.col("recall").alias("recall_100")), "query_id")
    return both.select("query_id", F.round(0.7 * F.col("ndcg") + 0.3 * F.col("recall_100"), 6).alias("composite"))


QUERIES = {
    "corpus_scan": Query(
        lambda s, d: C.documents(s, d).select(F.col("doc_id").cast("string").alias("id"), F.lit("").alias("title"), "text"),
        "SELECT doc_id::VARCHAR AS id, '' AS title, text FROM documents",
    ),
    "qrels_positive": Query(lambda s, d: C.judgements(s, d).where("rel > 0"), f"WITH {S.JUDGED} SELECT * FROM j WHERE rel > 0"),
    "evaluable_queries": Query(
        lambda s, d: C.evaluable(C.queries(s, d), C.judgements(s, d)), f"WITH {S.QUERIES}, {S.JUDGED} SELECT q.query_id, q.text, count(*) AS n_relevant FROM q JOIN j ON j.query_id = q.query_id GROUP BY ALL"
    ),
    "qrels_count": Query(lambda s, d: C.judgements(s, d).agg(F.count("*").alias("n_judgements")), f"WITH {S.JUDGED} SELECT count(*) AS n_judgements FROM j"),
    "tokenize_counts": Query(
        lambda s, d: C.documents(s, d).select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct")),
        f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)",
    ),
    "term_stats": Query(
        lambda s, d: Bm25().term_stats(C.index(s, d)).select("term", "df", F.round("idf", 6).alias("idf")),
        f"WITH {S.BM25} SELECT term, df, round(idf, 6) AS idf FROM i",
    ),
    "doc_length_stats": Query(
        lambda s, d: C.documents(s, d).select(F.size(T.tokens(F.col("text"))).alias("n")).agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").cast("bigint").alias("longest")),
        f"SELECT count(*) AS docs, sum(n)::BIGINT AS tokens, round(avg(n), 6) AS mean, max(n) AS longest FROM (SELECT len({S.tokens('text')}) AS n FROM documents)",
    ),
    "keyword_top8": Query(
        lambda s, d: ranked(
            C.documents(s, d).select("lang", F.explode(T.keywords(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "lang", "n", "word", 8
        ).select("lang", "word", "n", F.col("rank").cast("bigint").alias("rank")),
        f"""SELECT lang, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank
            FROM (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({S.keywords("text")}) AS word FROM documents) GROUP BY ALL)) WHERE rank <= 8""",
    ),
    "bm25_topk": Query(
        lambda s, d: _bm25(s, d).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")),
        f"WITH {S.BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {S.top('SELECT * FROM bm', 10)}",
    ),
    "overlap_topk": Query(
        lambda s, d: _overlap(s, d, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")),
        f"WITH {_OVERLAP} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {S.top('SELECT * FROM o', 10)}",
    ),
    "ndcg_at_k": Query(_mean("ndcg"), f"{_METRICS} SELECT k, count(*) AS queries, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY k"),
    "map_at_k": Query(_mean("ap"), f"{_METRICS} SELECT k, count(*) AS queries, round(avg(ap), 6) AS ap FROM m GROUP BY k"),
    "recall_at_k": Query(_mean("recall"), f"{_METRICS} SELECT k, count(*) AS queries, round(avg(recall), 6) AS recall FROM m GROUP BY k"),
    "precision_at_k": Query(_mean("precision"), f"{_METRICS} SELECT k, count(*) AS queries, round(avg(precision), 6) AS precision FROM m GROUP BY k"),
    "mrr": Query(
        lambda s, d: _metrics(s, d).where("k = 1").agg(F.count("*").alias("queries"), F.round(F.avg("rr"), 6).alias("mrr")),
        f"{_METRICS} SELECT count(*) AS queries, round(avg(rr), 6) AS mrr FROM m WHERE k = 1",
    ),
    "per_query_ndcg": Query(
        lambda s, d: C.judgements(s, d).select("query_id").distinct().join(_metrics(s, d).where("k = 10"), "query_id", "left").select("query_id", F.round(F.coalesce("ndcg", F.lit(0.0)), 6).alias("ndcg")),
        f"{_METRICS} SELECT j.query_id, round(coalesce(any_value(m.ndcg), 0), 6) AS ndcg FROM j LEFT JOIN (SELECT * FROM m WHERE k = 10) m ON m.query_id = j.query_id GROUP BY j.query_id",
    ),
    "composite_score": Query(
        _composite,
        f"""WITH {S.BM25}, {S.JUDGED}, m AS ({S.metrics(_RUN, True)}) SELECT a.query_id, round(0.7::DOUBLE * a.ndcg + 0.3::DOUBLE * b.recall, 6) AS composite
            FROM (SELECT * FROM m WHERE k = 10) a JOIN (SELECT * FROM m WHERE k = 100) b ON a.query_id = b.query_id""",
    ),
    "run_deltas": Query(lambda s, d: _deltas(s, d).select("query_id", *(F.round(c, 6).alias(c) for c in ("a", "b", "delta"))), f"{_BOTH} SELECT query_id, round(a, 6) AS a, round(b, 6) AS b, round(delta, 6) AS delta FROM x"),
    "delta_histogram": Query(
        lambda s, d: E.histogram(_deltas(s, d).select(F.round("delta", 9).alias("delta")), "delta"),
        f"""{_BOTH}, y AS (SELECT round(delta, 9) AS v FROM x)
            SELECT CASE WHEN v >= 0.5 THEN 7 WHEN v >= 0.2 THEN 6 WHEN v >= 0.05 THEN 5 WHEN v >= 0 THEN 4 WHEN v >= -0.05 THEN 3 WHEN v >= -0.2 THEN 2 WHEN v >= -0.5 THEN 1 ELSE 0 END::BIGINT AS bin, count(*) AS n
            FROM y GROUP BY 1""",
    ),
    "win_loss": Query(
        _win_loss,
        f"""{_BOTH} SELECT count(*) AS queries, round(avg((delta > 0)::INT::DOUBLE), 6) AS wins, round(avg((delta < 0)::INT::DOUBLE), 6) AS losses, round(avg(delta), 6) AS mean_delta, round(quantile_cont(delta, 0.5), 6) AS median_delta FROM x""",
    ),
    "snippet_peek": Query(
        lambda s, d: C.documents(s, d).select("doc_id", T.snippet(F.col("text")).alias("snippet")),
        "SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END AS snippet FROM documents",
    ),
    "fixed_chunks": Query(
        lambda s, d: _chunks(s, d),
        """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start_idx) - 1) AS pos, chunk, start_idx, end_idx FROM (
            SELECT doc_id, substr(text, (a + 1)::BIGINT, 1000) AS chunk, a::BIGINT AS start_idx, (a + 1000)::BIGINT AS end_idx
            FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS a FROM documents)) WHERE regexp_matches(chunk, '\\S')""",
    ),
    "hash_embed": Query(
        lambda s, d: C.queries(s, d).select("query_id", F.posexplode(T.hash_embedding(F.col("text"), 64)).alias("place", "x")).where("x <> 0").select("query_id", F.col("place").cast("bigint").alias("place"), F.round("x", 6).alias("x")),
        f"""WITH {S.QUERIES}, t AS (SELECT query_id, unnest({S.tokens("text")}) AS term FROM q),
            c AS (SELECT query_id, (('0x' || right(md5(term), 2))::INTEGER % 64)::BIGINT AS place, count(*)::DOUBLE AS n FROM t GROUP BY ALL)
            SELECT query_id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY query_id)), 6) AS x FROM c""",
    ),
}


def _chunks(spark, sf):
    from ..operators.chunk import fixed_chunks

    return fixed_chunks(C.documents(spark, sf), 1000, 200).select("doc_id", "pos", "chunk", "start_idx", "end_idx")
