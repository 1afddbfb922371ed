"""Rollouts of a policy with seeded weights over the embeddings' tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policy as P
from ..operators import tree as R
from .dense_plans import _asked, _vector_members, _vectors
from .query import Query


def _rollout(s, d):
    members = _vector_members(s, d).select("doc_id", "node_id")
    weights = P.init_weights(P.PolicyConfig(dim=64, hidden=32, scorer=16))
    return P.rollout(_asked(s, d), members, _vectors(s, d).select("doc_id", "embedding"), R.nodes_of(members), weights, P.RolloutConfig(max_steps=6))


QUERIES = {
    "policy_rollout": Query(lambda s, d: _rollout(s, d).select("query_id", "reason", "step", F.size("evidence").alias("n_evidence"), F.array_join("actions", ">").alias("actions"))),
    "node_features": Query(
        lambda s, d: P.node_features(_vector_members(s, d).select("doc_id", "node_id"), _vectors(s, d).select("doc_id", "embedding"), R.nodes_of(_vector_members(s, d))).select("node_id", "parent_id", "depth", "n_docs", "is_leaf"),
        """WITH m AS (SELECT 'c' || (label // 4) AS a, 'c' || (label // 4) || '.c' || label AS b FROM embeddings)
           SELECT 'root' AS node_id, NULL AS parent_id, 0::BIGINT AS depth, count(*) AS n_docs, false AS is_leaf FROM m UNION ALL SELECT a, 'root', 1, count(*), false FROM m GROUP BY a UNION ALL SELECT b, any_value(a), 2, count(*), true FROM m GROUP BY b""",
    ),
}
