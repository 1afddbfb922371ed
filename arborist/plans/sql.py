"""Pieces of DuckDB SQL that several queries share."""

from ..functions.text import PUNCTUATION, STOPWORDS

_PUNCTUATION = PUNCTUATION.replace("'", "''")


def tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower(coalesce({text}, '')), '{_PUNCTUATION}', ''), '\\s+'), lambda x: x <> '')"


def keywords(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '([a-z][a-z0-9-]{{2,}})', 1), lambda w: w NOT IN ({stop}))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def unit(a: str) -> str:
    return f"list_transform({a}, lambda x: x::DOUBLE / greatest(sqrt({dot(a, a)}), 1e-12))"


QUERIES = "q AS (SELECT item_id AS query_id, text FROM benchmark)"

JUDGED = """j AS (SELECT item_id AS query_id, d.doc_id, CAST(1 + coalesce(l.quality, 0) AS INTEGER) AS rel
  FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)"""

BM25 = f"""{QUERIES},
d AS (SELECT doc_id, {tokens("text")} AS tokens FROM documents),
n AS (SELECT count(*)::DOUBLE AS n, sum(len(tokens))::DOUBLE / count(*) AS mean FROM d),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM d) GROUP BY term),
r AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, n),
i AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
p AS (SELECT doc_id, term, size, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(tokens) AS size, unnest(tokens) AS term FROM d) GROUP BY ALL),
a AS (SELECT query_id, term, count(*)::DOUBLE AS times FROM (SELECT query_id, unnest({tokens("text")}) AS term FROM q) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))) AS score
  FROM a JOIN i USING (term) JOIN p USING (term), n GROUP BY ALL)"""


def top(rows: str, k: int, by: str = "query_id", score: str = "score", tie: str = "doc_id") -> str:
    """Rows (with a positive score if any is) ranked, as a subquery."""
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round({score}, 9) DESC, {tie}) AS rank
  FROM (SELECT *, max({score}) OVER (PARTITION BY {by}) AS most FROM ({rows})) WHERE most <= 0 OR {score} > 0) WHERE rank <= {k})"""


def metrics(run: str, binary: bool = False) -> str:
    """Per query and cut, from CTE j (query_id, doc_id, rel) and the subquery run (query_id, doc_id, score)."""
    value = (lambda r: f"(CASE WHEN {r} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)") if binary else (lambda r: f"(pow(2.0::DOUBLE, {r}) - 1)")
    return f"""
  SELECT g.query_id, g.k::BIGINT AS k, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg, precisions / relevant AS ap, found::DOUBLE / relevant AS recall,
    CASE WHEN shown > 0 THEN found::DOUBLE / shown ELSE 0.0 END AS precision, coalesce(1.0::DOUBLE / first, 0.0) AS rr
  FROM (SELECT query_id, k,
      sum(CASE WHEN rank <= k THEN {value("rel")} / log2(rank + 1.0::DOUBLE) ELSE 0.0::DOUBLE END) AS dcg,
      sum(CASE WHEN rank <= k AND hit = 1 THEN hits::DOUBLE / rank ELSE 0.0::DOUBLE END) AS precisions,
      sum(CASE WHEN rank <= k THEN hit ELSE 0 END) AS found, sum(CASE WHEN rank <= k THEN 1 ELSE 0 END) AS shown, min(CASE WHEN hit = 1 THEN rank END) AS first
    FROM (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM
      (SELECT r.query_id, r.rank, coalesce(j.rel, 0) AS rel, CASE WHEN coalesce(j.rel, 0) > 0 THEN 1 ELSE 0 END AS hit
       FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({run}) WHERE query_id IN (SELECT query_id FROM j)) r
       LEFT JOIN j ON j.query_id = r.query_id AND j.doc_id = r.doc_id)), (SELECT unnest([1, 3, 5, 10, 100, 1000]) AS k) GROUP BY query_id, k) g
  JOIN (SELECT query_id, k, sum(CASE WHEN place <= k THEN {value("rel")} / log2(place + 1.0::DOUBLE) ELSE 0.0::DOUBLE END) AS idcg, count(*) AS relevant
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS place FROM j), (SELECT unnest([1, 3, 5, 10, 100, 1000]) AS k) GROUP BY query_id, k) b
  ON g.query_id = b.query_id AND g.k = b.k"""
