"""Supervision records over the embeddings' tree, and a policy trained on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vector import dot, normalised
from ..operators import dense as D
from ..operators import policy as P
from ..operators import trainer as N
from ..operators import training as T_
from ..operators import navigator as G
from ..operators import records as R
from ..operators import tree as T
from ..sources.layout import stored
from . import sql as S
from .dense_plans import _CENTROIDS, _DENSE, _asked, _centroids, _dense, _vector_members, _vectors
from .query import Query

CONFIG = R.RecordConfig(nearest=5, k_max=12, random=0)


def _setting(s, d, centroids=None):
    """Targets in order, members, relevant documents (a query's five nearest), nodes and nearest nodes; by stored centroids, if there are any."""
    members = _vector_members(s, d).select("doc_id", "node_id")
    relevant = stored(_dense(s, d, 5).select("query_id", "doc_id"))
    centroids = centroids or stored(_centroids(s, d))
    targets = relevant.join(members, "doc_id").select("query_id", "node_id").distinct()
    placed = G.targets_in_order(targets, _asked(s, d), centroids)
    nearest = D.top(_asked(s, d), centroids.withColumnRenamed("centroid", "embedding"), CONFIG.nearest, "node_id").select("query_id", "node_id", "rank")
    return placed, members, relevant, T.nodes_of(members), stored(nearest)


def _records(s, d, config=CONFIG):
    return R.records(*_setting(s, d), config)


def _shown(rows):
    joined = lambda c: F.array_join(c, ">")
    return rows.select(
        "trajectory_id", F.col("step").cast("bigint").alias("step"), "node_id", joined("path").alias("path"), "action", F.size("evidence").cast("bigint").alias("n_evidence"), "done",
        F.coalesce(joined(F.filter("candidates", lambda c: c != "")), F.lit("")).alias("candidates"), F.coalesce(joined(F.transform("positives", lambda i: i.cast("string"))), F.lit("")).alias("positives"),
    )


def _spoilt(s, d):
    """The broken ones of records that are spoilt in one of seven ways, by their step."""
    way = lambda k: F.col("step") % 7 == k
    texts = lambda *values: F.array(*(F.lit(v) for v in values)).cast("array<string>")
    spoilt = {
        "path": F.when(way(0), texts("nowhere")).when(way(1), F.concat("path", texts("nowhere"))).when(way(2), texts(T.ROOT)),
        "action": F.when(way(2), R.AGGREGATE),
        "node_id": F.when(way(2), T.ROOT),
        "positives": F.when(way(3), F.array().cast("array<int>")).when(way(4) & (F.col("action") == R.JUMP), F.array(F.lit(99))),
        "targets": F.when(way(5), texts()),
        "evidence": F.when(way(6), F.array().cast("array<bigint>")),
        "done": F.when(way(6), True),
    }
    rows = _records(s, d).where("not is_off_path")
    return R.violations(rows.withColumns({c: F.coalesce(v, F.col(c)) for c, v in spoilt.items()}))


def _rows(s, d):
    """Training rows of all records, and a tenth of the queries' rows for validation."""
    members = _vector_members(s, d).select("doc_id", "node_id")
    vectors = _vectors(s, d).select("doc_id", "embedding")
    features = P.node_features(members, vectors, T.nodes_of(members))
    records = stored(_records(s, d))  # read several times
    held = T_.group_split(records.select("query_id"), "query_id", 0.1)
    rows = records.join(held, "query_id")
    made = lambda part: N.training_rows(part, features, _asked(s, d), vectors, members, CONFIG, 2)
    return made(rows.where("not validation")), made(rows.where("validation"))


def _trained(s, d):
    """Two epochs of a small network (the state of 64-wide vectors) over all records; a row an epoch."""
    rows, held = _rows(s, d)
    config = N.TrainConfig(epochs=2, batch_rows=max(256, rows.count() // 8), base_rate=3e-3, warm_rate=3e-3, encoder_rate=3e-3)
    _, history = N.train(rows, P.init_weights(P.PolicyConfig(dim=64, hidden=32, scorer=16)), config, held)
    shown = ("loss", *(f"loss_{k}" for k in N.LOSSES), "action_acc", "jump_top_1", "jump_mrr", "done_f1", "retrieve_top_5")
    return s.createDataFrame([(h["epoch"], h["steps"], *(float(h[k]) for k in shown)) for h in history], "epoch int, steps int, " + ", ".join(f"{k} double" for k in shown))


def _scored(s, d):
    """The jumps' candidates as lists: score (the query's cosine with the node), mask, positive, would loop."""
    centroids = stored(_centroids(s, d))
    jumps = R.records(*_setting(s, d, centroids), CONFIG).where(F.col("action") == R.JUMP)
    rows = jumps.select("query_id", "trajectory_id", "step", "node_id", "path", "positives", F.posexplode("candidates").alias("place", "c")).where("c <> ''")
    rows = rows.join(centroids.select(F.col("node_id").alias("c"), normalised(F.col("centroid")).alias("v")), "c").join(_asked(s, d).select("query_id", normalised(F.col("embedding")).alias("q")), "query_id")
    positive = F.array_contains("positives", F.col("place"))
    loop = ~positive & ((F.col("c") == F.col("node_id")) | F.array_contains("path", F.col("c")))
    item = F.struct("place", dot(F.col("q"), F.col("v")).alias("s"), F.lit(1).alias("m"), positive.cast("int").alias("p"), loop.cast("int").alias("l"))
    lists = rows.groupBy("trajectory_id", "step").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return lists.select("trajectory_id", F.col("step").cast("bigint").alias("step"), *(F.col(f"x.{k}").alias(k) for k in "smpl"))


def _losses(s, d):
    rows = _scored(s, d)
    return rows.select("trajectory_id", "step", T_.listwise_loss(F.col("s"), F.col("m"), F.col("p")).alias("loss"), T_.loop_penalty(F.col("s"), F.col("m"), F.col("l")).alias("loop"), T_.first_positive_rank(F.col("s"), F.col("m"), F.col("p")).alias("r"))


def _heads(s, d):
    """Losses of the heads for logits made of a record's state: its evidence and its path's length."""
    rows = _records(s, d).withColumn("n", F.size("evidence").cast("double")).withColumn("m", F.size("path").cast("double"))
    label = F.when(F.col("action") == R.RETRIEVE, 0).when(F.col("action") == R.AGGREGATE, 1).otherwise(2)
    action = T_.action_loss([F.col("n") * 0.5, F.col("m") * 0.25 + 0.1, F.col("n") - F.col("m")], label, [1.5, 0.5, 1.0])
    done = T_.done_loss(F.col("n") - 0.5 * F.col("m"), F.col("done").cast("double"), 3.0)
    return rows.select("trajectory_id", F.col("step").cast("bigint").alias("step"), F.round(done, 6).alias("done_loss"), F.round(action, 6).alias("action_loss"))


_SETTING = f"""{_DENSE}, {_CENTROIDS},
re AS (SELECT query_id, doc_id FROM dn WHERE rank <= 5),
nd AS (SELECT DISTINCT unnest([{{'n': 'root', 'p': NULL}}, {{'n': split_part(node_id, '.', 1), 'p': 'root'}}, {{'n': node_id, 'p': split_part(node_id, '.', 1)}}], recursive := true) FROM v),
an AS (SELECT * FROM (SELECT v.doc_id AS query_id, cu.node_id AS n, row_number() OVER (PARTITION BY v.doc_id ORDER BY round({S.dot("v.e", "cu.c")}, 9) DESC, cu.node_id) AS r FROM v, cu WHERE v.doc_id % 20 = 0) WHERE r <= 5),
tg AS (SELECT query_id, v.node_id, count(*) AS held FROM re JOIN v USING (doc_id) GROUP BY ALL),
lg AS (SELECT *, lag(node_id) OVER w AS prev, lead(node_id) OVER w IS NULL AS last FROM
  (SELECT tg.query_id, tg.node_id, held, row_number() OVER (PARTITION BY tg.query_id ORDER BY round({S.dot("v.e", "cu.c")}, 9) DESC, tg.node_id) AS leg FROM tg JOIN v ON v.doc_id = tg.query_id JOIN cu ON cu.node_id = tg.node_id) WINDOW w AS (PARTITION BY query_id ORDER BY leg)),
st AS (SELECT query_id, leg, held, node_id AS target, unnest(CASE WHEN prev IS NULL THEN [] ELSE [{{'o': 1, 'm': 'AGGREGATE', 'x': split_part(prev, '.', 1)}}] END ||
    CASE WHEN prev IS NOT NULL AND split_part(prev, '.', 1) <> split_part(node_id, '.', 1) THEN [{{'o': 2, 'm': 'AGGREGATE', 'x': 'root'}}] ELSE [] END ||
    CASE WHEN prev IS NULL OR split_part(prev, '.', 1) <> split_part(node_id, '.', 1) THEN [{{'o': 3, 'm': 'JUMP', 'x': split_part(node_id, '.', 1)}}] ELSE [] END ||
    [{{'o': 4, 'm': 'JUMP', 'x': node_id}}, {{'o': 5, 'm': 'RETRIEVE', 'x': node_id}}] || CASE WHEN last THEN [{{'o': 6, 'm': 'END', 'x': node_id}}] ELSE [] END) AS s FROM lg),
sp AS (SELECT query_id, leg, CASE WHEN s.m <> 'END' THEN target END AS target, s.m AS m, s.x AS x, row_number() OVER w - 1 AS step, coalesce(lag(s.x) OVER w, 'root') AS node_id,
    ['root'] || coalesce(list(s.x) FILTER (WHERE s.m IN ('JUMP', 'AGGREGATE')) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS path,
    coalesce(sum(CASE WHEN s.m = 'RETRIEVE' THEN held END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_evidence FROM st WINDOW w AS (PARTITION BY query_id ORDER BY leg, s.o)),
ev AS (SELECT *, query_id || ':0' AS trajectory_id, CASE WHEN m <> 'END' THEN m WHEN node_id = 'root' THEN 'JUMP' ELSE 'AGGREGATE' END AS action, CASE WHEN m = 'JUMP' THEN x END AS gold,
    n_evidence >= (SELECT count(*) FROM re WHERE re.query_id = sp.query_id) AS done FROM sp),
po AS (SELECT query_id, step, c, min({{'s': s, 'r': r}}) AS o FROM (
    SELECT ev.query_id, step, n AS c, 1 AS s, 0 AS r FROM ev JOIN nd ON nd.p = (CASE WHEN contains(gold, '.') THEN split_part(gold, '.', 1) ELSE 'root' END)
    UNION ALL SELECT ev.query_id, step, n, 2, r FROM ev JOIN an ON an.query_id = ev.query_id WHERE gold IS NOT NULL) JOIN ev USING (query_id, step)
  WHERE c <> node_id AND c <> gold AND c NOT IN ('root', split_part(target, '.', 1), target) GROUP BY ALL),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, step ORDER BY o, c) - 1 AS i FROM po) WHERE i < 2),
ob AS (SELECT ev.query_id, ev.leg, ev.trajectory_id || '.off' || ev.step || '_' || i AS trajectory_id, ev.step + 1 AS step, c AS node_id, ev.path || [c] AS path, n_evidence, done, target,
    contains(c, '.') AND split_part(c, '.', 1) <> split_part(target, '.', 1) AS far FROM pk JOIN ev USING (query_id, step)),
ro AS (SELECT query_id, leg, trajectory_id, step, node_id, path, action, n_evidence, done, gold, CASE WHEN m = 'END' THEN [] ELSE (SELECT list_distinct(flatten(list(['root', split_part(l.node_id, '.', 1), l.node_id]))) FROM lg l WHERE l.query_id = ev.query_id AND l.leg >= ev.leg) END AS ahead, false AS off FROM ev
  UNION ALL SELECT query_id, leg, trajectory_id, step, node_id, path, CASE WHEN far THEN 'JUMP' ELSE 'AGGREGATE' END, n_evidence, done, CASE WHEN far THEN split_part(target, '.', 1) END, ['root', split_part(target, '.', 1), target], true FROM ob),
ca AS (SELECT trajectory_id, step, c, min({{'s': s, 'r': r}}) AS o FROM (
    SELECT trajectory_id, step, gold AS c, 0 AS s, 0 AS r FROM ro WHERE gold IS NOT NULL
    UNION ALL SELECT trajectory_id, step, n, 1, r FROM ro JOIN an USING (query_id) WHERE action = 'JUMP'
    UNION ALL SELECT trajectory_id, step, n, 2, 0 FROM ro JOIN nd ON nd.p = ro.node_id WHERE action = 'JUMP'
    UNION ALL SELECT trajectory_id, step, p, 3, 0 FROM ro JOIN nd ON nd.n = ro.node_id WHERE action = 'JUMP' AND p IS NOT NULL
    UNION ALL SELECT trajectory_id, step, b.n, 4, 0 FROM ro JOIN nd a ON a.n = ro.node_id JOIN nd b ON b.p = a.p WHERE action = 'JUMP' AND b.n <> ro.node_id) GROUP BY ALL),
cb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id, step ORDER BY o, c) - 1 AS place FROM ca) WHERE place < 12),
cc AS (SELECT trajectory_id, step, string_agg(c, '>' ORDER BY place) AS candidates, coalesce(string_agg(place::VARCHAR, '>' ORDER BY place) FILTER (WHERE c = gold OR (list_contains(ahead, c) AND c <> node_id AND (node_id = 'root' OR starts_with(c, node_id || '.')))), '') AS positives
  FROM cb JOIN ro USING (trajectory_id, step) GROUP BY ALL),
rr AS (SELECT trajectory_id, step, node_id, array_to_string(path, '>') AS path, action, n_evidence, done, coalesce(candidates, '') AS candidates, coalesce(positives, '') AS positives, off FROM ro LEFT JOIN cc USING (trajectory_id, step))"""
_COLUMNS = "trajectory_id, step, node_id, path, action, n_evidence, done, candidates, positives"

_SCORED = f"""{_SETTING}, sc AS (SELECT cb.trajectory_id, cb.step, place, {S.dot("v.e", "cu.c")} AS s, (cb.c = gold OR (list_contains(ahead, cb.c) AND cb.c <> ro.node_id AND (ro.node_id = 'root' OR starts_with(cb.c, ro.node_id || '.')))) IS TRUE AS p0,
    cb.c = ro.node_id OR list_contains(path, cb.c) AS seen, gold IS NULL AND cb.o.s = 1 AS may FROM cb JOIN ro USING (trajectory_id, step) JOIN v ON v.doc_id = ro.query_id JOIN cu ON cu.node_id = cb.c),
sd AS (SELECT *, p0 OR (may AND NOT bool_or(p0) OVER w AND place = min(CASE WHEN may THEN place END) OVER w) AS p FROM sc WINDOW w AS (PARTITION BY trajectory_id, step)),
sl AS (SELECT trajectory_id, step, CASE WHEN bool_or(p) THEN ln(sum(exp(s))) - ln(sum(exp(s)) FILTER (WHERE p)) END AS loss, -ln(1 - sum(exp(s)) FILTER (WHERE seen AND NOT p) / sum(exp(s))) AS loop FROM sd GROUP BY ALL),
sr AS (SELECT trajectory_id, step, min(r) FILTER (WHERE p) AS r FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id, step ORDER BY s DESC, place) AS r FROM sd) GROUP BY ALL)"""

QUERIES = {
    "listwise_ce": Query(lambda s, d: _losses(s, d).select("trajectory_id", "step", F.round("loss", 6).alias("loss")).where("loss is not null"), f"WITH {_SCORED} SELECT trajectory_id, step, round(loss, 6) AS loss FROM sl WHERE loss IS NOT NULL"),
    "loop_penalty": Query(lambda s, d: _losses(s, d).select("trajectory_id", "step", F.round("loop", 6).alias("loss")).where("loss is not null"), f"WITH {_SCORED} SELECT trajectory_id, step, round(loop, 6) AS loss FROM sl WHERE loop IS NOT NULL"),
    "head_losses": Query(
        _heads,
        f"""WITH {_SETTING}, h AS (SELECT *, n_evidence::DOUBLE AS n, len(path)::DOUBLE AS k FROM ro), g AS (SELECT *, n - 0.5::DOUBLE * k AS x, ln(exp(n * 0.5::DOUBLE) + exp(k * 0.25::DOUBLE + 0.1::DOUBLE) + exp(n - k)) AS z FROM h)
            SELECT trajectory_id, step, round(CASE WHEN done THEN 3 * ln(1 + exp(-x)) ELSE ln(1 + exp(x)) END, 6) AS done_loss,
              round(CASE action WHEN 'RETRIEVE' THEN 1.5::DOUBLE * (z - n * 0.5::DOUBLE) WHEN 'AGGREGATE' THEN 0.5::DOUBLE * (z - k * 0.25::DOUBLE - 0.1::DOUBLE) ELSE z - n + k END, 6) AS action_loss FROM g""",
    ),
    "jump_topk_acc": Query(
        lambda s, d: _losses(s, d).where("r is not null").agg(F.round(F.avg((F.col("r") <= 1).cast("double")), 6).alias("top1"), F.round(F.avg((F.col("r") <= 3).cast("double")), 6).alias("top3")),
        f"WITH {_SCORED} SELECT round(avg((r <= 1)::INT::DOUBLE), 6) AS top1, round(avg((r <= 3)::INT::DOUBLE), 6) AS top3 FROM sr WHERE r IS NOT NULL",
    ),
    "jump_mrr": Query(lambda s, d: _losses(s, d).where("r is not null").agg(F.round(F.avg(1.0 / F.col("r")), 6).alias("mrr")), f"WITH {_SCORED} SELECT round(avg(1::DOUBLE / r), 6) AS mrr FROM sr WHERE r IS NOT NULL"),
    "terminal_rows": Query(
        lambda s, d: _records(s, d).where("terminal").select("query_id", F.col("step").cast("bigint").alias("step"), "node_id", "action", "done"),
        f"WITH {_SETTING} SELECT query_id, step, node_id, action, done FROM ev WHERE m = 'END'",
    ),
    "policy_training": Query(_trained),
    "supervision_rows": Query(lambda s, d: _shown(_records(s, d).where("not is_off_path")), f"WITH {_SETTING} SELECT {_COLUMNS} FROM rr WHERE NOT off"),
    "off_path_rows": Query(lambda s, d: _shown(_records(s, d).where("is_off_path")), f"WITH {_SETTING} SELECT {_COLUMNS} FROM rr WHERE off"),
    "record_summary": Query(lambda s, d: R.summary(_records(s, d)), f"WITH {_SETTING} SELECT action, count(*) AS n, count(*) FILTER (WHERE off) AS off_path, count(*) FILTER (WHERE done) AS done FROM rr GROUP BY 1"),
    "broken_invariants": Query(
        lambda s, d: _spoilt(s, d).select("trajectory_id", F.col("step").cast("bigint").alias("step"), F.array_join("broken", "; ").alias("broken")),
        f"""WITH {_SETTING} SELECT trajectory_id, step, broken FROM (SELECT trajectory_id, step, CASE step % 7 WHEN 0 THEN 'path starts at the root; path ends at the node' WHEN 1 THEN 'path ends at the node' WHEN 2 THEN 'no aggregation at the root'
              WHEN 3 THEN CASE WHEN action = 'JUMP' THEN 'a jump has positives' END WHEN 4 THEN CASE WHEN action = 'JUMP' THEN 'positives are real candidates' END WHEN 5 THEN CASE WHEN action = 'RETRIEVE' THEN 'retrieval at a target' END ELSE 'done has the evidence' END AS broken
            FROM rr WHERE NOT off) WHERE broken IS NOT NULL""",
    ),
}
