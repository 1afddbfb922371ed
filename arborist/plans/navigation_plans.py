"""Navigation, the built tree, and supervision over the documents' tree of languages and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dense as D
from ..operators import hierarchy as H
from ..operators import navigate as G
from ..operators import policy as P
from ..operators import tree as R
from ..operators.lexical import Bm25, ranked
from ..sources import corpus as C
from . import sql as S
from .dense_plans import _CENTROIDS, _DENSE, _asked, _doc_members, _vector_members, _vectors
from .query import Query


def _visited(s, d):
    docs, members = C.documents(s, d), _doc_members(s, d)
    return G.heuristic(C.queries(s, d), R.nodes_of(members), G.cards(docs, members))


def _navigated(s, d):
    rows = G.retrieve(C.queries(s, d), C.index(s, d), _doc_members(s, d), _visited(s, d), 10)
    return rows.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _in_subtree(s, d):
    below = _doc_members(s, d).where(F.col("node_id").startswith("en."))
    rows = Bm25().first(C.index(s, d), C.queries(s, d), 10, below.select("doc_id"))
    rows = ranked(rows, "query_id", "score", "doc_id", 10)
    return rows.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _kmeans(s, d):
    members = H.build(_vectors(s, d), H.BuildConfig(branching=4, max_depth=3, min_leaf=2, max_leaf=60, iterations=5))
    nodes, counts = R.nodes_of(members), R.subtree_counts(members)
    return nodes.join(counts, "node_id").select("node_id", "parent_id", "depth", "n_docs")


def _jump_candidates(s, d):
    """From each query's own leaf, reached from the root: the nearest centroids, then children, parent and siblings, none of them on
    the path."""
    asked, members = _asked(s, d), _vector_members(s, d).select("doc_id", "node_id")
    features = P.node_features(members, _vectors(s, d).select("doc_id", "embedding"), R.nodes_of(members))
    states = asked.select("query_id").join(members.select(F.col("doc_id").alias("query_id"), "node_id"), "query_id").withColumn("path", R.path_nodes(F.col("node_id")))
    near = D.top(asked, features.select("node_id", F.col("centroid").alias("embedding")), 4, "node_id").select("query_id", "node_id", "rank")
    rows = P.jump_candidates(states, features, near, 6)
    return rows.select("query_id", F.explode("candidates").alias("x")).select("query_id", F.col("x.place").cast("bigint").alias("place"), F.col("x.id").alias("node_id"))


def _done(s, d):
    """Done labels: whether the top results hold all relevant documents."""
    run = Bm25().top(C.index(s, d), C.queries(s, d), 10).groupBy("query_id").agg(F.collect_set("doc_id").alias("evidence"))
    judged = C.judgements(s, d).groupBy("query_id").agg(F.collect_set("doc_id").alias("relevant"))
    share = F.size(F.array_intersect("evidence", "relevant")) / F.size("relevant")
    return judged.join(run, "query_id").select("query_id", F.round(share, 6).alias("recall"), (share + 1e-9 >= 1.0).alias("done"))


_KW = f"""m0 AS (SELECT doc_id, text, lang || '.' || source AS leaf, lang FROM documents),
nw AS (SELECT node_id, word, row_number() OVER (PARTITION BY node_id ORDER BY count(*) DESC, word) AS r
  FROM (SELECT unnest([lang, leaf]) AS node_id, kw FROM (SELECT lang, leaf, {S.keywords("text")} AS kw FROM m0)), unnest(kw) u(word) GROUP BY node_id, word),
cards AS (SELECT node_id, list(word ORDER BY r) AS kw FROM nw WHERE r <= 8 GROUP BY node_id),
ct AS (SELECT node_id, {S.tokens("array_to_string(kw[1:3], ' / ') || ' Documents about ' || array_to_string(kw, ', ') || '. ' || array_to_string(kw, ' ')")} AS card FROM cards),
qt AS (SELECT query_id, list_distinct({S.tokens("text")}) AS q FROM q),
ch AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY node_id) AS nth FROM (SELECT DISTINCT node_id, CASE WHEN contains(node_id, '.') THEN split_part(node_id, '.', 1) ELSE 'root' END AS parent FROM nw)),
sc AS (SELECT query_id, parent, ch.node_id, nth, round(len(list_intersect(q, card))::DOUBLE / greatest(len(q), 1), 9) AS s FROM qt, ch JOIN ct ON ct.node_id = ch.node_id WHERE nth <= 8),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY s DESC, nth) AS r FROM sc),
vis AS (SELECT b.query_id, b.node_id, row_number() OVER (PARTITION BY b.query_id ORDER BY a.r, b.r) AS place FROM rk a JOIN rk b ON a.query_id = b.query_id AND b.parent = a.node_id WHERE a.parent = 'root' AND a.r <= 2 AND b.r <= 2)"""

QUERIES = {
    "node_cards": Query(
        lambda s, d: G.cards(C.documents(s, d), _doc_members(s, d)).select("node_id", "label", F.array_join("keywords", " ").alias("keywords")),
        f"WITH {S.QUERIES}, {_KW} SELECT node_id, array_to_string(kw[1:3], ' / ') AS label, array_to_string(kw, ' ') AS keywords FROM cards",
    ),
    "navigated_nodes": Query(_visited, f"WITH {S.QUERIES}, {_KW} SELECT query_id, node_id, place FROM vis"),
    "heuristic_navigate": Query(
        _navigated,
        f"""WITH {S.BM25}, {_KW}, ca AS (SELECT vis.query_id, m0.doc_id FROM vis JOIN m0 ON m0.leaf = vis.node_id),
            cs AS (SELECT ca.query_id, ca.doc_id, coalesce(bm.score, 0) AS score FROM ca LEFT JOIN bm ON bm.query_id = ca.query_id AND bm.doc_id = ca.doc_id)
            SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {S.top("SELECT * FROM cs", 10)}""",
    ),
    "bm25_in_subtree": Query(
        _in_subtree,
        f"WITH {S.BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) WHERE rank <= 10",
    ),
    "done_labels": Query(
        _done,
        f"""WITH {S.BM25}, {S.JUDGED}, t AS (SELECT query_id, doc_id FROM {S.top("SELECT * FROM bm", 10)}), g AS (SELECT j.query_id, count(DISTINCT j.doc_id) AS n, count(DISTINCT t.doc_id) AS h FROM j LEFT JOIN t ON t.query_id = j.query_id AND t.doc_id = j.doc_id GROUP BY 1)
            SELECT query_id, round(h::DOUBLE / n, 6) AS recall, h::DOUBLE / n + 1e-9 >= 1 AS done FROM g""",
    ),
    "jump_candidates": Query(
        _jump_candidates,
        f"""WITH {_DENSE}, {_CENTROIDS}, an AS (SELECT * FROM (SELECT v.doc_id AS query_id, v.node_id AS leaf, cu.node_id AS c, row_number() OVER (PARTITION BY v.doc_id ORDER BY round({S.dot("v.e", "cu.c")}, 9) DESC, cu.node_id) AS r FROM v, cu WHERE v.doc_id % 20 = 0) WHERE r <= 4),
            a AS (SELECT query_id, c, [1, r] AS o FROM an WHERE c NOT IN ('root', split_part(leaf, '.', 1), leaf)
              UNION ALL SELECT v.doc_id, x.node_id, [4, 0] FROM v JOIN (SELECT DISTINCT node_id FROM v) x ON split_part(x.node_id, '.', 1) = split_part(v.node_id, '.', 1) AND x.node_id <> v.node_id WHERE v.doc_id % 20 = 0)
            SELECT query_id, place, c AS node_id FROM (SELECT query_id, c, row_number() OVER (PARTITION BY query_id ORDER BY min(o), c) AS place FROM a GROUP BY query_id, c) WHERE place <= 6""",
    ),
    "kmeans_hierarchy": Query(_kmeans),
}
