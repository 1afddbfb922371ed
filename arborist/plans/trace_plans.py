"""Traces made of the events table, their distillation, and two-phase retrieval with hashed vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dense as D
from ..operators import navigate as G
from ..operators import traces as R
from ..operators import tree as N
from ..operators import two_phase as P
from ..sources import corpus as C
from ..sources.layout import stored
from . import sql as S
from .dense_plans import _TREE, _doc_members, _doc_nodes
from .navigation_plans import _KW
from .query import Query

_NODES = ("root", "en", "fr", "de", "es", "nowhere")
_EVENTS = ("enter", "recurse", "search_in_cluster", "return")
_KINDS = ("generated_code", "search_in_cluster", "ground_query", "sandbox_result", "return", "rank_clusters_llm")


def _traces(s, d):
    """A user's events as a trajectory: kinds, nodes and documents by their numbers; rewards by user."""
    pick = lambda names, by: F.get(F.array(*(F.lit(n) for n in names)), by)
    e = C.table(s, d, "events")
    n = F.col("event_id")
    return e.select(
        F.col("user_id").alias("trajectory_id"), n.alias("seq"), pick(_EVENTS, (n % 4).cast("int")).alias("event"), pick(_NODES, (F.expr("event_id div 4") % 6).cast("int")).alias("cluster_id"),
        F.when(n % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(n % 7, n % 11)).alias("docs"), F.when(F.col("user_id") % 3 > 0, 0.6).otherwise(0.4).alias("reward"),
    )


def _typed(s, d):
    pick = lambda names, by: F.get(F.array(*(F.lit(n) for n in names)), by)
    e = C.table(s, d, "events")
    n = F.col("event_id")
    return e.select(
        F.col("user_id").alias("trajectory_id"), n.alias("seq"), pick(_KINDS, (n % 6).cast("int")).alias("event"), F.concat(F.lit("q"), n % 9).alias("query"), F.when(n % 4 > 0, F.concat(F.lit("c"), n % 5)).alias("cluster_id"),
        F.when(n % 8 != 0, F.concat(F.lit(" code "), n % 13)).alias("code"), F.when(n % 9 < 5, F.concat(F.lit("error "), n % 3)).alias("error"), F.when(n % 12 < 6, F.array(n % 17, n % 5)).otherwise(F.array().cast("array<bigint>")).alias("docs"),
    )


def _distilled(s, d):
    retrieved = _typed(s, d).select("trajectory_id").distinct().withColumn("docs", F.array(F.col("trajectory_id"), F.col("trajectory_id")))
    rows = R.distill(_typed(s, d), retrieved)
    return rows.select("trajectory_id", *(F.array_join(k, "|").alias(k) for k in ("queries", "clusters", "docs", "snippets", "errors")))


def _converted(s, d):
    nodes = _doc_nodes(s, d)
    rows = R.convert(R.known(_traces(s, d), nodes, 0.5))
    wide = lambda c: F.col(c).cast("bigint").alias(c)
    return rows.select("trajectory_id", wide("step"), "node_id", "action", "target", F.array_join("evidence", ",").alias("evidence"), wide("retrieves"), wide("jumps"), "done")


def _found(s, d, alpha):
    docs, members, asked = C.documents(s, d), _doc_members(s, d), C.queries(s, d)
    visited = P.walk(asked, N.nodes_of(members), G.cards(docs, members))
    embed = lambda rows, key: rows.select(key, T.hash_embedding(F.col("text"), 64).alias("embedding"))
    vectors, q = stored(embed(docs, "doc_id")), stored(embed(asked, "query_id"))
    near = D.top(q, vectors, 20)
    pooled = stored(P.pool(asked, visited, members, near))
    rows = P.rank(pooled, asked, C.index(s, d), 10, alpha, q, vectors)
    return rows.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _pooled(s, d):
    docs, members, asked = C.documents(s, d), _doc_members(s, d), C.queries(s, d)
    visited = P.walk(asked, N.nodes_of(members), G.cards(docs, members))
    near = C.judgements(s, d)
    rows = P.pool(asked, visited, members, near)
    return rows.groupBy("query_id", "from_tree", "from_dense").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))


_TRACE_SQL = f"""{_TREE}, e AS (SELECT user_id::VARCHAR AS trajectory_id, event_id AS seq, ['enter', 'recurse', 'search_in_cluster', 'return'][event_id % 4 + 1] AS event, ['root', 'en', 'fr', 'de', 'es', 'nowhere'][(event_id // 4) % 6 + 1] AS cluster_id,
  CASE WHEN event_id % 5 = 0 THEN []::BIGINT[] ELSE [event_id % 7, event_id % 11] END AS docs FROM events WHERE user_id % 3 > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY seq) AS i FROM e WHERE event = 'return' OR (cluster_id IN (SELECT node_id FROM t) AND (event <> 'search_in_cluster' OR len(docs) > 0))),
x AS (SELECT *, CASE WHEN event <> 'return' THEN cluster_id END AS named, CASE WHEN event IN ('search_in_cluster', 'return') THEN docs ELSE [] END AS gave FROM k),
y AS (SELECT *, coalesce(last_value(named IGNORE NULLS) OVER w, 'root') AS here, coalesce(flatten(list(gave) OVER w), []) AS ev,
  count(*) FILTER (WHERE event = 'search_in_cluster') OVER w AS retrieves, count(*) FILTER (WHERE event = 'recurse') OVER w AS jumps FROM x WINDOW w AS (PARTITION BY trajectory_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT trajectory_id, row_number() OVER (PARTITION BY trajectory_id ORDER BY i) - 1 AS step, CASE WHEN event = 'recurse' THEN here ELSE cluster_id END AS node_id, CASE WHEN event = 'recurse' THEN 'JUMP' ELSE 'RETRIEVE' END AS action, cluster_id AS target, ev, retrieves, jumps, false AS done
  FROM y WHERE event IN ('recurse', 'search_in_cluster')),
z AS (SELECT trajectory_id, count(*) FILTER (WHERE event IN ('recurse', 'search_in_cluster')) AS step, coalesce(arg_max(coalesce(named, here), i), 'root') AS node_id, arg_max(ev || gave, i) AS ev, count(*) FILTER (WHERE event = 'search_in_cluster') AS retrieves, count(*) FILTER (WHERE event = 'recurse') AS jumps FROM y GROUP BY trajectory_id),
al AS (SELECT * FROM a UNION ALL SELECT trajectory_id, step, node_id, 'RETRIEVE', node_id, ev, retrieves, jumps, true FROM z WHERE step > 0)"""


def _hashed(name: str, key: str, rows: str) -> str:
    """Hashed vectors as rows (key, place, x)."""
    return f"""{name} AS (SELECT {key}, place, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM (SELECT {key}, ('0x' || right(md5(term), 2))::INTEGER % 64 AS place, count(*)::DOUBLE AS n FROM (SELECT {key}, unnest({S.tokens("text")}) AS term FROM {rows}) GROUP BY ALL))"""


_POOL = f"""{S.BM25}, {_KW}, {_hashed("hq", "query_id", "q")}, {_hashed("hd", "doc_id", "documents")}, si AS (SELECT query_id, doc_id, sum(hq.x * hd.x) AS s FROM hq JOIN hd USING (place) GROUP BY ALL),
nr AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS r FROM si) WHERE r <= 20),
pl AS (SELECT vis.query_id, m0.doc_id FROM vis JOIN m0 ON m0.leaf = vis.node_id UNION SELECT query_id, doc_id FROM nr),
rn AS (SELECT pl.query_id, pl.doc_id, coalesce(bm.score, 0) AS lex, coalesce(si.s, 0) AS cos FROM pl LEFT JOIN bm ON bm.query_id = pl.query_id AND bm.doc_id = pl.doc_id LEFT JOIN si ON si.query_id = pl.query_id AND si.doc_id = pl.doc_id),
zs AS (SELECT *, CASE WHEN sd > 1e-9 THEN (lex - mu) / sd ELSE 0 END AS z FROM (SELECT *, avg(lex) OVER (PARTITION BY query_id) AS mu, stddev_pop(lex) OVER (PARTITION BY query_id) AS sd FROM rn))"""
_RANKED = "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({})) WHERE rank <= 10"

QUERIES = {
    "trace_rows": Query(
        _converted,
        f"""WITH {_TRACE_SQL} SELECT trajectory_id, step, node_id, action, target, coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(ev), lambda v: [list_position(ev, v), v])), lambda p: p[2]), ','), '') AS evidence, retrieves, jumps, done FROM al""",
    ),
    "distilled_traces": Query(
        _distilled,
        """WITH e AS (SELECT user_id AS trajectory_id, event_id AS seq, ['generated_code', 'search_in_cluster', 'ground_query', 'sandbox_result', 'return', 'rank_clusters_llm'][event_id % 6 + 1] AS event, 'q' || event_id % 9 AS query, CASE WHEN event_id % 4 > 0 THEN 'c' || event_id % 5 END AS cluster_id,
              CASE WHEN event_id % 8 <> 0 THEN 'code ' || event_id % 13 END AS code, CASE WHEN event_id % 9 < 5 THEN 'error ' || event_id % 3 END AS error, CASE WHEN event_id % 12 < 6 THEN [event_id % 17, event_id % 5] ELSE [] END AS docs FROM events),
            v AS (SELECT trajectory_id, 'queries' AS kind, query AS value, [seq, 0] AS o FROM e WHERE event IN ('search_in_cluster', 'rank_clusters_llm', 'ground_query') UNION ALL SELECT trajectory_id, 'clusters', cluster_id, [seq, 0] FROM e WHERE cluster_id IS NOT NULL
              UNION ALL SELECT trajectory_id, 'docs', docs[i]::VARCHAR, [seq, i] FROM e, (SELECT unnest([1, 2]) AS i) WHERE event = 'return' AND len(docs) > 0),
            f AS (SELECT trajectory_id, kind, value, min(o) AS o FROM v GROUP BY ALL),
            l AS (SELECT trajectory_id, string_agg(value, '|' ORDER BY o) FILTER (WHERE kind = 'queries') AS queries, string_agg(value, '|' ORDER BY o) FILTER (WHERE kind = 'clusters') AS clusters, string_agg(value, '|' ORDER BY o) FILTER (WHERE kind = 'docs') AS docs FROM f GROUP BY 1),
            c AS (SELECT trajectory_id, string_agg(code, '|' ORDER BY seq) AS snippets FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY seq) AS n FROM e WHERE event = 'generated_code' AND code IS NOT NULL) WHERE n <= 3 GROUP BY 1),
            r AS (SELECT trajectory_id, string_agg(error, '|' ORDER BY seq) AS errors FROM e WHERE event = 'sandbox_result' AND error IS NOT NULL GROUP BY 1)
            SELECT u.trajectory_id, coalesce(queries, '') AS queries, coalesce(clusters, '') AS clusters, coalesce(docs, u.trajectory_id::VARCHAR) AS docs, coalesce(snippets, '') AS snippets, coalesce(errors, '') AS errors
            FROM (SELECT DISTINCT trajectory_id FROM e) u LEFT JOIN l USING (trajectory_id) LEFT JOIN c USING (trajectory_id) LEFT JOIN r USING (trajectory_id)""",
    ),
    "two_phase": Query(lambda s, d: _found(s, d, 0.0), f"WITH {_POOL} {_RANKED.format('SELECT query_id, doc_id, lex AS score FROM rn')}"),
    "two_phase_blend": Query(lambda s, d: _found(s, d, 0.5), f"WITH {_POOL} {_RANKED.format('SELECT query_id, doc_id, 0.5::DOUBLE * cos + 0.5::DOUBLE * z AS score FROM zs')}"),
    "candidate_pool": Query(  # judged documents in place of near ones
        _pooled,
        f"""WITH {S.QUERIES}, {S.JUDGED}, {_KW}, p AS (SELECT query_id, doc_id, bool_or(tree) AS from_tree, bool_or(NOT tree) AS from_dense FROM (SELECT vis.query_id, m0.doc_id, true AS tree FROM vis JOIN m0 ON m0.leaf = vis.node_id UNION ALL SELECT query_id, doc_id, false FROM j) GROUP BY ALL)
            SELECT query_id, from_tree, from_dense, count(*) AS n, min(doc_id) AS least, max(doc_id) AS most FROM p GROUP BY ALL""",
    ),
}
