"""Oracle trajectories and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dense as D
from ..operators import supervision as V
from ..sources import corpus as C
from ..sources.layout import stored
from ..streaming.promotion import reward_windows
from . import sql as S
from .dense_plans import _DENSE, _TREE, _asked, _dense, _doc_members, _doc_nodes, _vector_members, _vectors
from .query import Query


def _leaves(s, d):
    return C.judgements(s, d).join(_doc_members(s, d), "doc_id").select("query_id", "node_id").distinct()


def _actions(s, d):
    return V.oracle_actions(_leaves(s, d), ["node_id"])


def _spoilt(s, d):
    """Oracle actions with unknown actions and nodes, and without some second steps."""
    n = F.col("query_id") + F.col("step")
    rows = _actions(s, d).where("not (query_id % 3 = 0 and step = 1)")
    return rows.select("query_id", "step", F.when(n % 5 == 0, "FLY").otherwise(F.col("action")).alias("action"), F.when(n % 7 == 0, "nowhere").otherwise(F.col("node_id")).alias("node_id"))


def _block(s, d):
    """Leaves of each query's five nearest vectors, with these and then the most similar of their documents."""
    members, relevant = _vector_members(s, d).select("doc_id", "node_id"), stored(_dense(s, d, 5).select("query_id", "doc_id"))
    targets = stored(relevant.join(members, "doc_id").select("query_id", "node_id").distinct())
    rows = V.nearest_block(targets, _vector_members(s, d), relevant, _asked(s, d), 8)
    return rows.withColumn("place", F.col("place").cast("bigint"))


_LEGS = f"""{_TREE}, {S.JUDGED}, tg AS (SELECT DISTINCT query_id, node_id FROM j JOIN m USING (doc_id)),
lg AS (SELECT *, row_number() OVER w AS leg, lag(node_id) OVER w AS prev FROM tg WINDOW w AS (PARTITION BY query_id ORDER BY node_id)),
st AS (SELECT query_id, leg, 1 AS o, 'AGGREGATE' AS action, split_part(prev, '.', 1) AS node_id FROM lg WHERE prev IS NOT NULL
  UNION ALL SELECT query_id, leg, 2, 'AGGREGATE', 'root' FROM lg WHERE prev IS NOT NULL AND split_part(prev, '.', 1) <> split_part(node_id, '.', 1)
  UNION ALL SELECT query_id, leg, 3, 'JUMP', split_part(node_id, '.', 1) FROM lg WHERE prev IS NULL OR split_part(prev, '.', 1) <> split_part(node_id, '.', 1)
  UNION ALL SELECT query_id, leg, 4, 'JUMP', node_id FROM lg UNION ALL SELECT query_id, leg, 5, 'RETRIEVE', node_id FROM lg),
ac AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY leg, o) - 1 AS step, action, node_id FROM st)"""

QUERIES = {
    "oracle_actions": Query(_actions, f"WITH {_LEGS} SELECT query_id, step, action, node_id FROM ac"),
    "oracle_action_mix": Query(lambda s, d: _actions(s, d).groupBy("action").agg(F.count("*").alias("n")), f"WITH {_LEGS} SELECT action, count(*) AS n FROM ac GROUP BY 1"),
    "invariant_violations": Query(  # of rows of which some have been spoilt
        lambda s, d: V.violations(_spoilt(s, d), _doc_nodes(s, d)).select("query_id", "step", "action", "node_id"),
        f"""WITH {_LEGS}, sp AS (SELECT query_id, step, CASE WHEN (query_id + step) % 5 = 0 THEN 'FLY' ELSE action END AS action, CASE WHEN (query_id + step) % 7 = 0 THEN 'nowhere' ELSE node_id END AS node_id FROM ac WHERE NOT (query_id % 3 = 0 AND step = 1))
            SELECT query_id, step, action, node_id FROM sp WHERE (query_id + step) % 5 = 0 OR (query_id + step) % 7 = 0 OR (query_id % 3 = 0 AND step = 2)""",
    ),
    "retrieve_block": Query(
        _block,
        f"""WITH {_DENSE}, re AS (SELECT query_id, doc_id FROM dn WHERE rank <= 5), tg AS (SELECT DISTINCT query_id, node_id FROM re JOIN v USING (doc_id))
            SELECT query_id, node_id, doc_id, positive, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY positive DESC, round(score, 9) DESC, doc_id) AS place
            FROM (SELECT tg.query_id, tg.node_id, v.doc_id, (tg.query_id, v.doc_id) IN (SELECT (query_id, doc_id) FROM re) AS positive, s.score FROM tg JOIN v ON v.node_id = tg.node_id JOIN s ON s.query_id = tg.query_id AND s.doc_id = v.doc_id)) WHERE place <= 8""",
    ),
    "reward_windows": Query(
        lambda s, d: reward_windows(C.table(s, d, "events"), "ts", "value", "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.round("mean", 6).alias("mean")),
        "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    ),
}

