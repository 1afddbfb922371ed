"""Dense retrieval, fusion and trees over the embeddings table and the documents' languages and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vector import mean_vector
from ..operators import dense as D
from ..operators import tree as T
from ..operators.lexical import Bm25, ranked
from ..sources import corpus as C
from ..sources.layout import stored
from . import sql as S
from .query import Query

TOP = 50


def _vectors(spark, sf):
    return C.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _asked(spark, sf):
    return C.table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _dense(spark, sf, k=TOP):
    asked = _asked(spark, sf)
    return D.top(asked, _vectors(spark, sf), k, exclude=asked.select("query_id", F.col("query_id").alias("doc_id")))


def _leaf(label):
    return F.concat(F.lit("c"), F.floor(label / 4), F.lit(".c"), label)


def _vector_members(spark, sf):
    return _vectors(spark, sf).select("doc_id", "embedding", _leaf(F.col("label")).alias("node_id"))


def _centroids(spark, sf):
    rows = _vector_members(spark, sf).select(F.explode(T.path_nodes(F.col("node_id"))).alias("node_id"), "embedding")
    return mean_vector(rows, ["node_id"], "embedding")


def _doc_members(spark, sf):
    return C.documents(spark, sf).select("doc_id", F.concat_ws(".", "lang", "source").alias("node_id"))


def _doc_nodes(spark, sf):
    return T.nodes_of(_doc_members(spark, sf))


def _leaf_pairs(spark, sf):
    """The leaves of each two documents whose ids follow one another."""
    one = _doc_members(spark, sf).select("doc_id", F.col("node_id").alias("x"))
    return one.join(_doc_members(spark, sf).select((F.col("doc_id") - 1).alias("doc_id"), F.col("node_id").alias("y")), "doc_id")


def _six(rows, *names):
    return rows.select(*names, F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _walk(spark, sf, asked=None):
    return T.greedy_walk(_asked(spark, sf) if asked is None else asked, T.nodes_of(_vector_members(spark, sf)), _centroids(spark, sf))


def _in_leaf(spark, sf):
    asked = stored(_asked(spark, sf).join(_walk(spark, sf), "query_id"))
    rows = D.top_within(asked, _vector_members(spark, sf), 11, ["node_id"]).where("query_id <> doc_id")  # itself may be one of them
    return ranked(rows.drop("rank"), "query_id", "score", "doc_id", 10)


def _lexical(spark, sf):
    """A second run for the same ids: BM25 of the benchmark's items whose id is divisible by 20, over documents."""
    return Bm25().top(C.index(spark, sf), C.queries(spark, sf).where("query_id % 20 = 0"), TOP)


def _rrf(spark, sf):
    return ranked(D.reciprocal_ranks(_lexical(spark, sf), _dense(spark, sf)), "query_id", "score", "doc_id", 20)


def _augmented(spark, sf):
    return D.augmented(_lexical(spark, sf).select("query_id", "doc_id", "score"), _dense(spark, sf))


def _blend(spark, sf):
    run = stored(_augmented(spark, sf))
    rows = D.blended(run, D.pair_scores(run, _asked(spark, sf), _vectors(spark, sf)), 0.9)
    return ranked(rows, "query_id", "score", "doc_id", 20)


def _targets(spark, sf):
    members = _doc_members(spark, sf)
    return T.target_nodes(C.judgements(spark, sf), members, T.subtree_counts(members), 250)


_V = f"""v AS (SELECT vec_id AS doc_id, {S.unit("embedding")} AS e, embedding, label, 'c' || (label // 4) || '.c' || label AS node_id FROM embeddings),
s AS (SELECT a.doc_id AS query_id, b.doc_id, {S.dot("a.e", "b.e")} AS score FROM (SELECT * FROM v WHERE doc_id % 20 = 0) a, v b)"""
_DENSE = f"""{_V}, dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE query_id <> doc_id) WHERE rank <= {TOP})"""
_PATHS = "mp AS (SELECT doc_id, embedding, unnest(['root', split_part(node_id, '.', 1), node_id]) AS node_id FROM v)"
_CENTROIDS = f"""{_PATHS}, ce AS (SELECT node_id, list(m ORDER BY place) AS centroid FROM (SELECT node_id, place, avg(x) AS m FROM
  (SELECT node_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS place FROM mp) GROUP BY ALL) GROUP BY node_id), cu AS (SELECT node_id, {S.unit("centroid")} AS c FROM ce)"""
_WALK = f"""{_V}, {_CENTROIDS},
w1 AS (SELECT doc_id AS query_id, e, node_id FROM (SELECT v.doc_id, v.e, cu.node_id, row_number() OVER (PARTITION BY v.doc_id ORDER BY round({S.dot("v.e", "cu.c")}, 9) DESC, cu.node_id) AS r
  FROM v, cu WHERE v.doc_id % 20 = 0 AND cu.node_id <> 'root' AND NOT contains(cu.node_id, '.')) WHERE r = 1),
w2 AS (SELECT query_id, node_id, e FROM (SELECT w1.query_id, w1.e, cu.node_id, row_number() OVER (PARTITION BY w1.query_id ORDER BY round({S.dot("w1.e", "cu.c")}, 9) DESC, cu.node_id) AS r
  FROM w1, cu WHERE starts_with(cu.node_id, w1.node_id || '.')) WHERE r = 1)"""
_LEXICAL = f"{S.BM25}, lx AS (SELECT query_id, doc_id, score, rank FROM {S.top('SELECT * FROM bm WHERE query_id % 20 = 0', TOP)})"
_AUGMENTED = f"{_LEXICAL}, {_DENSE}, au AS (SELECT query_id, doc_id, score FROM lx UNION ALL SELECT query_id, doc_id, 0.0 FROM dn WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM lx))"
_TREE = """m AS (SELECT doc_id, lang || '.' || source AS node_id FROM documents),
t AS (SELECT DISTINCT unnest([{'node_id': 'root', 'parent_id': NULL, 'depth': 0::BIGINT}, {'node_id': split_part(node_id, '.', 1), 'parent_id': 'root', 'depth': 1::BIGINT},
  {'node_id': node_id, 'parent_id': split_part(node_id, '.', 1), 'depth': 2::BIGINT}], recursive := true) FROM m),
su AS (SELECT node_id, count(*) AS n_docs FROM (SELECT unnest(['root', split_part(node_id, '.', 1), node_id]) AS node_id FROM m) GROUP BY 1),
cl AS (SELECT node_id, node_id AS ancestor_id, 0::BIGINT AS distance FROM t UNION ALL SELECT node_id, parent_id, 1 FROM t WHERE parent_id IS NOT NULL UNION ALL SELECT node_id, 'root', 2 FROM t WHERE depth = 2)"""


def _ranked(run, *names):
    return lambda s, d: _six(run(s, d), *names)


QUERIES = {
    "dense_topk": Query(_ranked(lambda s, d: _dense(s, d, 10), "query_id", "doc_id"), f"WITH {_DENSE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM dn WHERE rank <= 10"),
    "best_per_doc": Query(
        lambda s, d: D.best_per_item(C.table(s, d, "events").select(F.col("event_type").alias("query_id"), F.col("user_id").alias("doc_id"), F.col("value").alias("score"))).select("query_id", "doc_id", F.round("score", 6).alias("score")),
        "SELECT event_type AS query_id, user_id AS doc_id, round(max(value), 6) AS score FROM events GROUP BY ALL",
    ),
    "node_centroids": Query(
        lambda s, d: _centroids(s, d).select("node_id", F.posexplode("centroid").alias("place", "x")).select("node_id", F.col("place").cast("bigint").alias("place"), F.round("x", 6).alias("x")),
        f"WITH {_V}, {_CENTROIDS} SELECT node_id, unnest(range(64)) AS place, round(unnest(centroid), 6) AS x FROM ce",
    ),
    "centroid_topk": Query(
        lambda s, d: _six(D.top(_asked(s, d), _centroids(s, d).withColumnRenamed("centroid", "embedding"), 5, "node_id"), "query_id", "node_id"),
        f"""WITH {_V}, {_CENTROIDS} SELECT query_id, node_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS rank
            FROM (SELECT v.doc_id AS query_id, cu.node_id, {S.dot("v.e", "cu.c")} AS score FROM v, cu WHERE v.doc_id % 20 = 0)) WHERE rank <= 5""",
    ),
    "centroid_greedy_walk": Query(_walk, f"WITH {_WALK} SELECT query_id, node_id FROM w2"),
    "dense_in_leaf": Query(
        _ranked(_in_leaf, "query_id", "doc_id"),
        f"""WITH {_WALK} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
            FROM (SELECT w2.query_id, v.doc_id, {S.dot("w2.e", "v.e")} AS score FROM w2 JOIN v ON v.node_id = w2.node_id AND v.doc_id <> w2.query_id)) WHERE rank <= 10""",
    ),
    "rrf_fusion": Query(
        _ranked(_rrf, "query_id", "doc_id"),
        f"""WITH {_LEXICAL}, {_DENSE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
            FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score
            FROM lx a FULL JOIN dn b ON a.query_id = b.query_id AND a.doc_id = b.doc_id)) WHERE rank <= 20""",
    ),
    "dense_augment": Query(lambda s, d: _augmented(s, d).select("query_id", "doc_id", F.round("score", 6).alias("score")), f"WITH {_AUGMENTED} SELECT query_id, doc_id, round(score, 6) AS score FROM au"),
    "zscore_blend": Query(
        _ranked(_blend, "query_id", "doc_id"),
        f"""WITH {_AUGMENTED}, z AS (SELECT *, CASE WHEN sd > 1e-9 THEN (score - mu) / sd ELSE 0 END AS z FROM (SELECT *, avg(score) OVER (PARTITION BY query_id) AS mu, stddev_pop(score) OVER (PARTITION BY query_id) AS sd FROM au))
            SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
            FROM (SELECT z.query_id, z.doc_id, 0.9::DOUBLE * coalesce(s.score, 0) + (1 - 0.9::DOUBLE) * z.z AS score FROM z LEFT JOIN s ON s.query_id = z.query_id AND s.doc_id = z.doc_id)) WHERE rank <= 20""",
    ),
    "tree_nodes": Query(_doc_nodes, f"WITH {_TREE} SELECT * FROM t"),
    "tree_ancestors": Query(lambda s, d: T.closure(_doc_nodes(s, d)), f"WITH {_TREE} SELECT * FROM cl"),
    "tree_children": Query(lambda s, d: T.children(_doc_nodes(s, d), "root", 1), f"WITH {_TREE} SELECT node_id, distance FROM cl WHERE ancestor_id = 'root' AND distance = 1"),
    "tree_leaves": Query(lambda s, d: T.leaves(_doc_nodes(s, d)).select("node_id"), f"WITH {_TREE} SELECT node_id FROM t WHERE depth = 2"),
    "tree_lca": Query(
        lambda s, d: _leaf_pairs(s, d).select("doc_id", "x", "y", T.lowest_common_ancestor(F.col("x"), F.col("y")).alias("lca")),
        f"""WITH {_TREE} SELECT a.doc_id, a.node_id AS x, b.node_id AS y, CASE WHEN a.node_id = b.node_id THEN a.node_id WHEN split_part(a.node_id, '.', 1) = split_part(b.node_id, '.', 1) THEN split_part(a.node_id, '.', 1) ELSE 'root' END AS lca
            FROM m a JOIN m b ON b.doc_id = a.doc_id + 1""",
    ),
    "tree_descent": Query(
        lambda s, d: _doc_members(s, d).select("doc_id", F.array_join(T.descent(F.lit("en"), F.col("node_id")), ">").alias("path")).where("path is not null"),
        f"WITH {_TREE} SELECT doc_id, 'en>' || node_id AS path FROM m WHERE starts_with(node_id, 'en.')",
    ),
    "doc_leaf": Query(_doc_members, f"WITH {_TREE} SELECT doc_id, node_id FROM m"),
    "subtree_counts": Query(lambda s, d: T.subtree_counts(_doc_members(s, d)), f"WITH {_TREE} SELECT * FROM su"),
    "leaf_size_summary": Query(
        lambda s, d: _doc_members(s, d).groupBy("node_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("leaves"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.percentile("n", 0.5), 6).alias("p50"), F.round(F.percentile("n", 0.95), 6).alias("p95")),
        f"WITH {_TREE} SELECT count(*) AS leaves, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95 FROM (SELECT count(*) AS n FROM m GROUP BY node_id)",
    ),
    "hierarchy_text": Query(
        lambda s, d: T.text(_doc_nodes(s, d).join(T.subtree_counts(_doc_members(s, d)), "node_id").withColumn("name", F.concat(F.col("n_docs").cast("string"), F.lit(" documents"))), "name"),
        f"WITH {_TREE} SELECT string_agg(repeat('  ', depth) || node_id || ': ' || n_docs || ' documents', chr(10) ORDER BY CASE WHEN node_id = 'root' THEN [] ELSE string_split(node_id, '.') END) AS hierarchy FROM t JOIN su USING (node_id)",
    ),
    "target_nodes": Query(
        _targets,
        f"""WITH {_TREE}, {S.JUDGED}, f AS (SELECT DISTINCT query_id, node_id FROM j JOIN m USING (doc_id)), g AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM f)
            SELECT DISTINCT query_id, arg_min(x.ancestor_id, a.depth) AS node_id FROM g JOIN cl x ON x.node_id = g.node_id JOIN su ON su.node_id = x.ancestor_id JOIN t a ON a.node_id = x.ancestor_id
            WHERE x.distance = 0 OR (g.n > 1 AND su.n_docs <= 250) GROUP BY query_id, g.node_id""",
    ),
}
