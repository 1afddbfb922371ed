"""The navigator's questions, supervision steps and reports over the documents' tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dense as D
from ..operators import evaluate as E
from ..operators import navigate as G
from ..operators import navigator as N
from ..operators import supervision as V
from ..operators import tree as R
from ..operators.lexical import Bm25, ranked
from ..sources import corpus as C
from ..sources.layout import stored
from . import sql as S
from .dense_plans import _CENTROIDS, _DENSE, _TREE, _WALK, _asked, _centroids, _dense, _doc_members, _doc_nodes, _vector_members, _vectors, _walk
from .lexical_plans import _BOTH, _METRICS, _deltas, _metrics
from .navigation_plans import _KW
from .query import Query
from .supervision_plans import _LEGS, _actions

_SHOWN = "'Untitled' AS title, CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END AS snippet"


def _cards(s, d):
    return G.cards(C.documents(s, d), _doc_members(s, d))


def _search(s, d, node, limit):
    rows = N.search(C.queries(s, d), C.documents(s, d).select("doc_id", "text"), _doc_members(s, d), node, limit, C.index(s, d))
    return rows.select("query_id", "doc_id", "title", "snippet", F.round("score", 6).alias("score"), F.col("metadata")["doc_id"].alias("beir_id"), "cluster_id", F.col("rank").cast("bigint").alias("rank"))


def _searched(where: str, limit: int) -> str:
    return f"""WITH {S.BM25}, al AS (SELECT q.query_id, x.doc_id, coalesce(bm.score, 0) AS score FROM q CROSS JOIN (SELECT doc_id FROM documents WHERE {where}) x LEFT JOIN bm ON bm.query_id = q.query_id AND bm.doc_id = x.doc_id)
        SELECT query_id, t.doc_id, {_SHOWN}, round(score, 6) AS score, t.doc_id::VARCHAR AS beir_id, lang || '.' || source AS cluster_id, rank FROM {S.top("SELECT * FROM al", limit)} t JOIN documents d ON d.doc_id = t.doc_id"""


def _child_cards(s, d):
    nodes = _doc_nodes(s, d).where("parent_id = 'root'").join(R.subtree_counts(_doc_members(s, d)), "node_id")
    return nodes.join(_cards(s, d), "node_id").select(F.col("node_id").alias("id"), "label", "summary", "keywords", "n_docs")


def _replies(s, d):
    """Replies as a model may give them: fenced, bare, talkative, without targets, and none."""
    n = F.col("query_id") % 5
    target = F.concat(F.lit("n"), F.col("query_id").cast("string"))
    reply = (
        F.when(n == 0, F.concat(F.lit('```json\n{"action": "jump", "targets": ["'), target, F.lit('", "x"]}\n```')))
        .when(n == 1, F.lit('I would say {"action": "retrieve"} here.'))
        .when(n == 2, F.lit('{"action": "JUMP", "targets": []}'))
        .when(n == 3, F.lit("no object at all"))
    )
    fallback = F.array(target, F.lit("b"), F.lit("c"))
    return C.queries(s, d).select("query_id", N.decision(reply, fallback).alias("x")).select("query_id", "x.action", F.array_join("x.targets", ",").alias("targets"))


def _targets(s, d):
    near = _dense(s, d, 10).select("query_id", "doc_id").join(_vector_members(s, d).select("doc_id", "node_id"), "doc_id")
    return N.targets_in_order(near.select("query_id", "node_id").distinct(), _asked(s, d), _centroids(s, d))


def _greedy_bm25(s, d):
    """BM25 among the documents of the leaf that the walk ends in; queries and documents by their numbers.

    Vectors without a question of their number have no score, so only those with one walk and meet their leaf's documents.
    """
    asked = C.queries(s, d).where("query_id % 20 = 0")
    starts = _asked(s, d).join(asked.select("query_id"), "query_id", "left_semi")
    inside = stored(_walk(s, d, starts)).join(_vector_members(s, d).select("doc_id", "node_id"), "node_id").select("query_id", "doc_id")
    rows = Bm25().first(C.index(s, d), asked, 10, inside)
    return ranked(rows, "query_id", "score", "doc_id", 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _extremes(s, d):
    return E.extremes(_deltas(s, d).select("query_id", F.round("delta", 9).alias("delta")), "delta", "query_id", 5).select("kind", F.col("place").cast("bigint").alias("place"), "query_id", F.round("delta", 6).alias("delta"))


QUERIES = {
    "rag_documents": Query(
        lambda s, d: N.rag_documents(C.documents(s, d).withColumn("metadata", F.create_map(F.when(F.col("doc_id") % 2 == 0, "doc_id").otherwise("lang"), F.col("lang"))), _doc_members(s, d)).select(
            "doc_id", "text", "title", F.col("metadata")["doc_id"].alias("meta_doc_id"), F.size("metadata").cast("bigint").alias("n_meta"), "cluster_id", "score"
        ),
        "SELECT doc_id, text, '' AS title, CASE WHEN doc_id % 2 = 0 THEN lang ELSE doc_id::VARCHAR END AS meta_doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS n_meta, lang || '.' || source AS cluster_id, 1.0::DOUBLE AS score FROM documents",
    ),
    "cluster_info": Query(
        lambda s, d: N.cluster_info("en", _cards(s, d), _doc_nodes(s, d)).withColumn("keywords", F.array_join("keywords", " ")),
        f"WITH {S.QUERIES}, {_KW} SELECT node_id AS id, array_to_string(kw[1:3], ' / ') AS label, 'Documents about ' || array_to_string(kw, ', ') || '.' AS summary, array_to_string(kw, ' ') AS keywords, 1::BIGINT AS depth FROM cards WHERE node_id = 'en'",
    ),
    "search_in_cluster": Query(lambda s, d: _search(s, d, "en", 20), _searched("lang = 'en'", 20)),
    "ground_query": Query(lambda s, d: _search(s, d, None, 40), _searched("true", 40)),
    "peek_cluster_documents": Query(
        lambda s, d: N.peek(C.documents(s, d).select("doc_id", "text"), _doc_members(s, d)).select("node_id", "doc_id", "title", "snippet", F.col("rank").cast("bigint").alias("rank")),
        f"SELECT lang || '.' || source AS node_id, doc_id, {_SHOWN}, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 10",
    ),
    "representatives": Query(
        lambda s, d: N.representatives(_vector_members(s, d).select("doc_id", "node_id"), _vectors(s, d), _centroids(s, d)).withColumn("place", F.col("place").cast("bigint")),
        f"""WITH {_DENSE.split(", dn AS")[0]}, {_CENTROIDS}, x AS (SELECT mp.node_id, v.doc_id, CASE WHEN count(*) OVER (PARTITION BY mp.node_id) <= 5 THEN 0 ELSE {S.dot("v.e", "cu.c")} END AS score FROM mp JOIN v ON v.doc_id = mp.doc_id JOIN cu ON cu.node_id = mp.node_id)
            SELECT node_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM x) WHERE place <= 5""",
    ),
    "target_order": Query(
        lambda s, d: _targets(s, d).withColumn("place", F.col("place").cast("bigint")),
        f"""WITH {_DENSE}, {_CENTROIDS}, y AS (SELECT DISTINCT dn.query_id, v.node_id FROM dn JOIN v ON v.doc_id = dn.doc_id WHERE rank <= 10)
            SELECT y.query_id, y.node_id, row_number() OVER (PARTITION BY y.query_id ORDER BY round({S.dot("a.e", "cu.c")}, 9) DESC, y.node_id) AS place FROM y JOIN v a ON a.doc_id = y.query_id JOIN cu ON cu.node_id = y.node_id""",
    ),
    "bm25_in_greedy_leaf": Query(
        _greedy_bm25,
        f"""WITH {_WALK}, {S.BM25}, x AS (SELECT bm.* FROM bm JOIN w2 ON w2.query_id = bm.query_id JOIN v ON v.node_id = w2.node_id AND v.doc_id = bm.doc_id)
            SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM x) WHERE rank <= 10""",
    ),
    "rank_scores": Query(
        lambda s, d: E.rank_scores(Bm25().top(C.index(s, d), C.queries(s, d), 10)).select("query_id", "doc_id", F.round("score", 6).alias("score")),
        f"WITH {S.BM25} SELECT query_id, doc_id, round(1::DOUBLE / rank, 6) AS score FROM {S.top('SELECT * FROM bm', 10)}",
    ),
    "top_wins_losses": Query(
        _extremes,
        f"""{_BOTH}, y AS (SELECT query_id, round(delta, 9) AS delta FROM x) SELECT 'win' AS kind, place, query_id, round(delta, 6) AS delta FROM (SELECT *, row_number() OVER (ORDER BY delta DESC, query_id) AS place FROM y) WHERE place <= 5
            UNION ALL SELECT 'loss', place, query_id, round(delta, 6) FROM (SELECT *, row_number() OVER (ORDER BY delta, query_id DESC) AS place FROM y) WHERE place <= 5""",
    ),
    "query_page": Query(lambda s, d: N.page(C.queries(s, d), "query_id", 10, 15), f"WITH {S.QUERIES} SELECT * FROM q ORDER BY query_id LIMIT 15 OFFSET 10"),
    "metrics_table": Query(
        lambda s, d: E.table(_metrics(s, d)),
        f"""{_METRICS}, mt AS (SELECT k, avg(ndcg) AS ndcg, avg(ap) AS map, avg(recall) AS recall, avg(precision) AS p FROM m GROUP BY k)
            SELECT name || '@' || k AS metric, printf('%.4f', value) AS value FROM (UNPIVOT (SELECT k, ndcg AS NDCG, map AS MAP, recall AS Recall, p AS P FROM mt) ON NDCG, MAP, Recall, P INTO NAME name VALUE value)""",
    ),
    "prompt_messages": Query(
        lambda s, d: N.prompts(C.queries(s, d), _child_cards(s, d), "root", 0, 4),
        f"""WITH {S.QUERIES}, {_KW}, x AS (SELECT lang AS id, count(*) AS n FROM documents GROUP BY 1), y AS (SELECT id, '  ID: ' || id || chr(10) || '  Label: ' || array_to_string(kw[1:3], ' / ') || chr(10) || '  Summary: ' || left('Documents about ' || array_to_string(kw, ', ') || '.', 200)
            || chr(10) || '  Keywords: ' || array_to_string(kw[1:6], ', ') || chr(10) || '  Docs: ' || n || chr(10) AS line FROM x JOIN cards ON cards.node_id = x.id)
            SELECT query_id, 'Query: ' || text || chr(10) || 'Current cluster: ROOT' || chr(10) || 'Depth: 0 / 4' || chr(10) || 'Clusters collected so far: exploring...' || chr(10) || chr(10) || 'Child clusters to choose from:' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY id) FROM y) AS message FROM q""",
    ),
    "parsed_replies": Query(
        _replies,
        """SELECT item_id AS query_id, CASE WHEN item_id % 5 = 1 THEN 'RETRIEVE' ELSE 'JUMP' END AS action, CASE item_id % 5 WHEN 0 THEN 'n' || item_id || ',x' WHEN 1 THEN '' ELSE 'n' || item_id || ',b' END AS targets FROM benchmark""",
    ),
    "retrieve_steps": Query(
        lambda s, d: V.repeated_retrievals(_actions(s, d), _doc_members(s, d), C.judgements(s, d), 4).select("query_id", "step", "node_id", F.col("repeat").cast("bigint").alias("repeat"), "n_evidence"),
        f"""WITH {_LEGS}, r AS (SELECT * FROM ac WHERE action = 'RETRIEVE'), e AS (SELECT r.query_id, r.step, count(DISTINCT j.doc_id) AS n FROM r JOIN r o ON o.query_id = r.query_id AND o.step <= r.step JOIN j ON j.query_id = r.query_id JOIN m ON m.doc_id = j.doc_id AND m.node_id = o.node_id GROUP BY ALL)
            SELECT r.query_id, r.step, r.node_id, unnest(range(4)) AS repeat, e.n AS n_evidence FROM r JOIN e USING (query_id, step)""",
    ),
    "jump_positives": Query(
        lambda s, d: V.jump_positives(_actions(s, d)).select("query_id", "step", "node_id", "positive"),
        f"""WITH {_LEGS}, jp AS (SELECT query_id, step, node_id AS taken, (SELECT min_by(o.node_id, o.step) FROM ac o WHERE o.query_id = ac.query_id AND o.action = 'RETRIEVE' AND o.step > ac.step) AS target FROM ac WHERE action = 'JUMP'),
            p AS (SELECT query_id, step, taken, target, unnest(list_distinct([taken, target])) AS positive FROM jp)
            SELECT query_id, step, CASE WHEN contains(taken, '.') THEN split_part(taken, '.', 1) ELSE 'root' END AS node_id, positive FROM p""",
    ),
}
