"""Replay, registries, training weights, losses and traces over the events and conversations tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk as K
from ..operators import navigator as G
from ..operators import replay as R
from ..operators import training as N
from ..operators.lexical import card_score, within_budget
from ..sources import corpus as C
from . import sql as S
from .dense_plans import _doc_members
from .query import Query


def _events(s, d):
    return C.table(s, d, "events")


def _turns(s, d):
    return C.table(s, d, "conversations")


def _rates(s, d):
    steps = _events(s, d).select(F.expr("event_id div 100").alias("step")).distinct()
    return steps.select("step", F.round(N.learning_rate(F.col("step"), steps.count()), 6).alias("rate"))


def _registry(s, d):
    return _events(s, d).select(F.col("event_id").alias("version"), F.col("ts").alias("created_at"), (F.col("value") > 50).alias("promoted"), "event_type", "value")


def _cards(s, d):
    """A card for each source: label, keywords and summary from its documents."""
    rows = C.documents(s, d).select("source", F.explode(T.keywords(F.col("text"))).alias("word")).groupBy("source", "word").agg(F.count("*").alias("n"))
    top = rows.withColumn("r", F.expr("row_number() OVER (PARTITION BY source ORDER BY n DESC, word)")).where("r <= 8")
    words = top.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias("keywords"))
    summary = F.concat(F.lit("Documents about "), F.array_join("keywords", ", "), F.lit("."))
    return words.select("source", "keywords", T.label(F.col("keywords"), F.col("source")).alias("label"), summary.alias("summary"))


_CARDS = f"""w AS (SELECT source, word, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, word) AS r FROM (SELECT source, unnest({S.keywords("text")}) AS word FROM documents) GROUP BY source, word),
c AS (SELECT source, list(word ORDER BY r) AS keywords FROM w WHERE r <= 8 GROUP BY source),
cards AS (SELECT source, keywords, array_to_string(keywords[1:3], ' / ') AS label, 'Documents about ' || array_to_string(keywords, ', ') || '.' AS summary FROM c)"""


def _card_scores(s, d):
    """Each query with each source's card, of which there are few; what shares no token has 0."""
    score = card_score(F.col("text"), F.col("label"), F.col("summary"), F.array_join("keywords", " "))
    return C.queries(s, d).crossJoin(F.broadcast(_cards(s, d))).select("query_id", "source", F.round(score, 6).alias("score"))


QUERIES = {
    "class_weights": Query(lambda s, d: N.class_weights(_events(s, d), "event_type").select("event_type", "n", F.round("weight", 6).alias("weight")), "SELECT event_type, n, round(sum(n) OVER () / (3::DOUBLE * (n + 1)), 6) AS weight FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)"),
    "done_pos_weight": Query(
        lambda s, d: N.done_weight(_events(s, d), F.col("event_type") == "purchase").select(F.round("weight", 6).alias("weight")),
        "SELECT round(CASE WHEN p > 0 THEN (n - p)::DOUBLE / p ELSE 10 END, 6) AS weight FROM (SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS p FROM events)",
    ),
    "sampler_weights": Query(lambda s, d: N.sampler_weights(_events(s, d), "event_id", "event_type").select("event_id", F.round("weight", 9).alias("weight")), "SELECT event_id, round(1::DOUBLE / count(*) OVER (PARTITION BY event_type), 9) AS weight FROM events"),
    "group_split": Query(
        lambda s, d: N.group_split(_events(s, d), "user_id", 0.1),
        "WITH g AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || user_id), user_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)) SELECT user_id, r <= round_even(0.1 * n, 0) AS validation FROM g",
    ),
    "loop_window": Query(
        lambda s, d: N.looping(_events(s, d), "user_id", ["ts", "event_id"], "event_type").select("event_id", "repeats", "loop"),
        """SELECT event_id, len(list_filter(l, lambda x: x = event_type)) AS repeats, len(list_filter(l, lambda x: x = event_type)) >= 3 AS loop
           FROM (SELECT *, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS l FROM events)""",
    ),
    "state_meta": Query(
        lambda s, d: _events(s, d).groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("k")).select("user_id", *(F.round(c, 6).alias(a) for c, a in zip(N.state_features(F.col("k"), F.col("n"), F.col("k"), F.col("n"), F.col("n")), ("depth", "evidence", "children", "step", "log_size")))),
        "SELECT user_id, round(least(k / 16.0::DOUBLE, 1), 6) AS depth, round(least(n / 100.0::DOUBLE, 1), 6) AS evidence, round(least(k / 8.0::DOUBLE, 1), 6) AS children, round(least(n / 16.0::DOUBLE, 1), 6) AS step, round(ln(1 + n), 6) AS log_size FROM (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS k FROM events GROUP BY 1)",
    ),
    "learning_rates": Query(  # a step for each hundred events
        lambda s, d: _rates(s, d),
        """WITH x AS (SELECT DISTINCT event_id // 100 AS step FROM events), n AS (SELECT count(*) AS n, greatest(1, floor(0.05::DOUBLE * count(*))) AS f FROM x)
            SELECT step, round(CASE WHEN step < f THEN greatest(step / f::DOUBLE, 1e-8::DOUBLE) ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5 * (1 + cos(pi() * least((step - f) / greatest(1, n - f)::DOUBLE, 1))) END, 6) AS rate FROM x, n""",
    ),
    "latency_percentiles": Query(
        lambda s, d: _events(s, d).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95")),
        "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
    ),
    "replay_successful": Query(
        lambda s, d: R.successful(_events(s, d), 50.0, 100, "value", "ts", "event_id").select("event_id", "user_id", F.round("value", 6).alias("value")),
        "SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE value >= 50 ORDER BY events.value DESC, ts DESC, event_id LIMIT 100",
    ),
    "distill_trajectory": Query(
        lambda s, d: R.ordered_distinct(_events(s, d), "user_id", "event_type", ["ts", "event_id"], "l").select("user_id", F.array_join("l", ",").alias("clusters")),
        "SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS clusters FROM (SELECT user_id, event_type, min({'ts': ts, 'e': event_id}) AS f FROM events GROUP BY ALL) GROUP BY user_id",
    ),
    "compact_trace": Query(lambda s, d: R.compact(_turns(s, d), "conv_id", "turn", "text"), "SELECT conv_id, turn, role, left(coalesce(text, ''), 800) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 12"),
    "registry_current": Query(lambda s, d: R.current(_registry(s, d), "event_type"), "SELECT event_type, arg_max(event_id, {'t': ts, 'e': event_id}) AS version FROM events WHERE value > 50 GROUP BY 1"),
    "should_promote": Query(
        lambda s, d: _events(s, d).groupBy("event_type").agg(F.avg(F.when(F.col("user_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("user_id") % 2 == 1, F.col("value"))).alias("b")).select("event_type", R.should_promote(F.col("a"), F.col("b"), 0.5).alias("promote")),
        "SELECT event_type, coalesce(a >= b + 0.5, a IS NOT NULL AND b IS NULL) AS promote FROM (SELECT event_type, avg(value) FILTER (WHERE user_id % 2 = 0) AS a, avg(value) FILTER (WHERE user_id % 2 = 1) AS b FROM events GROUP BY 1)",
    ),
    "action_counts": Query(lambda s, d: _events(s, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("value") > 50).cast("bigint")).alias("high")), "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY 1"),
    "cluster_cards": Query(lambda s, d: _cards(s, d).select("source", "label", "summary"), f"WITH {_CARDS} SELECT source, label, summary FROM cards"),
    "card_lexical_score": Query(  # every card for every query
        _card_scores,
        f"""WITH {_CARDS} SELECT query_id, source, round(len(list_intersect(q, {S.tokens("label || ' ' || summary || ' ' || array_to_string(keywords, ' ')")}))::DOUBLE / greatest(len(q), 1), 6) AS score
            FROM cards, (SELECT item_id AS query_id, list_distinct({S.tokens("text")}) AS q FROM benchmark)""",
    ),
    "budgeted_cards": Query(
        lambda s, d: within_budget(_cards(s, d).withColumn("g", F.lit(1)), ["g"], ["source"], "summary", 150).select("source", F.substring("summary", 1, 1000).alias("summary")),
        f"WITH {_CARDS} SELECT source, left(summary, 1000) AS summary FROM (SELECT *, sum(length(summary)) OVER (ORDER BY source) AS used FROM cards) WHERE used <= 750",
    ),
    "sentence_chunks": Query(
        lambda s, d: K.sentence_chunks(C.documents(s, d)),
        """WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
            w AS (SELECT doc_id, text, s, unnest(range(1, len(s) + 1, 4)) AS a FROM p)
            SELECT doc_id, ((a - 1) // 4)::BIGINT AS pos, array_to_string(s[a:a + 4], ' ') AS chunk, (strpos(text, s[a]) - 1)::BIGINT AS start_idx, (strpos(text, s[a]) - 1 + length(array_to_string(s[a:a + 4], ' ')))::BIGINT AS end_idx FROM w""",
    ),
    "recursive_chunks": Query(lambda s, d: K.recursive_chunks(C.documents(s, d))),
    "fetch_documents": Query(  # an event's user as the number of a document
        lambda s, d: G.fetch(_events(s, d).select(F.col("event_id").alias("pos"), F.col("user_id").alias("doc_id")), C.documents(s, d), _doc_members(s, d)).select("pos", "doc_id", "title", "cluster_id", "score", T.snippet(F.col("text")).alias("snippet")),
        "SELECT event_id AS pos, doc_id, '' AS title, lang || '.' || d.source AS cluster_id, 1.0::DOUBLE AS score, CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END AS snippet FROM events e JOIN documents d ON d.doc_id = e.user_id",
    ),
}
