"""Personal data: patterns for entities, and information-theoretic sanitisation of terms that disclose them.

Patterns find e-mail and IP addresses, card and phone numbers.  An entity (kind and exact text) that LEAST or more
distinct texts hold is protected.  The corpus's co-occurrences estimate what a term t tells of a protected entity e:
PMI(t; e) = log p(t, e) / (p(t) p(e)), as a share of what there is to know, IC(e) = -log p(e).  A term that occurs with e
in LEAST distinct texts or more, and whose share reaches `threshold` for some e, is disclosing in every text: below a
share of 1 it is generalised to its letters' shape, at 1 (it never occurs without e) it is removed.

An identifier (IDENTIFIER, such as a key or token) is a term that stands for its holder.  What it tells of whose text it
is, is IC(t) = -log p(t), as a share of the most there is to know, log N of N distinct texts; so 1 - log n / log N if n
texts have it.  From `threshold` on it is disclosing like a term: removed at 1 (one text alone has it), else generalised.

All counts are over distinct texts (by their words), so copies don't count as evidence.  Terms are words
`[^\\x20\\x09-\\x0D]+`, A-Z folded, that don't touch a pattern's span and have no digit.  Bloom filters of fixed size
(FILTER bits) thin the terms that tasks emit; joins on the whole tables then decide, so nothing unbounded is broadcast.

Cases: null and empty texts have no spans; repeated rows get the same result each; null ids are rows like others; an
empty table gives an empty result; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import documents_only, plain, stored
from .words import SMALL_CHUNK, SPACES, U, chunks, let_go, mix, span_hashes

KINDS = ("email", "ip", "card", "phone")
LEAST = 3
THRESHOLD = 0.9
FILTER = 1 << 23
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins at the first of a run of digits: from a later one it would go on alike, so trying those is of no use.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: 12 or more ASCII letters, digits, - and _ with two letters and two digits at least; matched within words.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_-])(?=[0-9_-]*[A-Za-z][0-9_-]*[A-Za-z])(?=[A-Za-z_-]*[0-9][A-Za-z_-]*[0-9])[A-Za-z0-9_-]{12,}")
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_CLUES = _DIGITS.copy()
_CLUES[64] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


def _emails(text: str):
    """Matches of local@domain.domain in linear time: from each @, the local part is walked back."""
    done = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        while m and start > done and text[start - 1] in _LOCAL:
            start -= 1
        if m and start < at:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in code points, by start and kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def identifiers(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Start and end of the identifiers that don't touch a pattern's span."""
    return [m.span() for m in IDENTIFIER.finditer(text) if all(b <= m.start() or m.end() <= a for a, _, b in spans)]


def _spans(chunk) -> list[list[tuple[int, int, int]]]:
    """base_spans of each row; texts without a digit or @ have none."""
    clue = chunk.sums(_CLUES) > 0
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(chunk.n)]
    at = np.flatnonzero(clue)
    for i, text in zip(at, chunk.rows.column("text").take(pa.array(at)).to_pylist()):
        found[i] = base_spans(text)
    return found


def _identifiers(chunk, spans) -> list[list[dict]]:
    """hash, start and end of the identifiers of each row."""
    found: list[list[dict]] = [[] for _ in range(chunk.n)]
    at = np.flatnonzero(chunk.sums(_DIGITS) > 1)
    for i, text in zip(at.tolist(), chunk.rows.column("text").take(pa.array(at)).to_pylist()):
        found[i] = [{"term": entity_hash(len(KINDS), text[a:b]), "start": a, "end": b} for a, b in identifiers(text, spans[i])]
    return found


class Terms:
    """The words of a chunk that may be terms: row, hash, and start and end in code points of their text."""

    def __init__(self, chunk, spans: list[list[tuple[int, int, int]]], pick=None):
        starts, ends = chunk.words(~SPACES)
        points = np.concatenate([[0], np.cumsum(~_CONTINUES[chunk.data])])
        row, h = chunk.row_of(starts), span_hashes(chunk.data, starts, ends, True)
        digits = np.concatenate([[0], np.cumsum(_DIGITS[chunk.data])])
        # all words make up a text's identity, terms are chosen from them
        n = chunk.n
        self.text = np.zeros(n, U)
        nth = np.arange(len(h)) - np.searchsorted(row, np.arange(n))[row] if len(h) else np.zeros(0, int)
        np.add.at(self.text, row, mix(h + nth.astype(U)))
        keep = digits[starts] == digits[ends]
        if pick is not None:
            keep &= pick(h)
        self.row, self.hash = row[keep], h[keep]
        base = points[chunk.offsets[self.row]]
        self.start, self.end = points[starts[keep]] - base, points[ends[keep]] - base
        cut = np.searchsorted(self.row, np.arange(n + 1))
        free = np.ones(len(self.row), bool)
        for i, own in enumerate(spans):
            if own:
                s = slice(cut[i], cut[i + 1])
                a, b = (np.array(x) for x in zip(*((a, b) for a, _, b in own)))
                free[s] = ((self.start[s, None] >= b) | (self.end[s, None] <= a)).all(1)
        self.row, self.hash, self.start, self.end = (x[free] for x in (self.row, self.hash, self.start, self.end))

    def distinct(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) without repeats, of the flagged rows."""
        keep = rows[self.row]
        order = np.lexsort((self.hash[keep], self.row[keep]))
        row, h = self.row[keep][order], self.hash[keep][order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        return row[new], h[new]


def entity_hash(kind: int, text: str) -> int:
    b = np.frombuffer(f"{kind}:{text}".encode(), np.uint8)
    return int(span_hashes(b, np.array([0]), np.array([len(b)])).view(np.int64)[0])


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.searchsorted(row, np.arange(n + 1)).astype(np.int32), pa.array(values.view(np.int64)))


def _first(batches):
    let_go()
    for chunk in chunks(batches, SMALL_CHUNK):
        spans = _spans(chunk)
        terms = Terms(chunk, spans)
        some = np.array([bool(s) for s in spans], bool)
        row, h = terms.distinct(some)
        texts = chunk.rows.column("text")
        entities = []
        for i, own in enumerate(spans):
            text = texts[i].as_py() if own else ""
            entities.append(sorted({entity_hash(k, text[a:b]) for a, k, b in own}))
        counts = [pa.array([sum(k == j for _, k, _ in own) for own in spans], pa.int64()) for j in range(len(KINDS))]
        ids = pa.array(_identifiers(chunk, spans), pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])))
        base = pa.array([",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in own) for own in spans], pa.string())
        yield pa.RecordBatch.from_arrays(
            [chunk.rows.column("doc_id"), chunk.rows.column("text_key"), pa.array(terms.text.view(np.int64)), *counts, base, pa.array(entities, pa.list_(pa.int64())), _lists(row, h, chunk.n), ids],
            ["doc_id", "text_key", "words", *(f"n_{k}" for k in KINDS), "base", "entities", "terms", "identifiers"],
        )


def _bits(hashes: np.ndarray) -> np.ndarray:
    h = hashes.astype(U)
    return np.stack([h & U(FILTER - 1), (h >> U(23)) & U(FILTER - 1), (h >> U(41)) & U(FILTER - 1)])


def bloom(df: DataFrame, column: str) -> np.ndarray:
    """FILTER bits (packed) of a bigint column; each task sends its own filter, and they are merged two by two."""

    def run(batches):
        flags = np.zeros(FILTER, bool)
        for b in batches:
            flags[_bits(b.column(0).to_numpy().view(U)).ravel()] = True
        if flags.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(flags).tobytes()], pa.binary())], ["bits"])

    bits = np.zeros(FILTER // 8, np.uint8)
    for r in df.select(column).coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        bits |= np.frombuffer(r["bits"], np.uint8)
    return bits


def _picker(packed) -> object:
    flags = np.unpackbits(packed).astype(bool)
    return lambda h: flags[_bits(h)].all(0)


def _frequencies(bits):
    """(words, term) of the filtered terms, each once a text."""

    def run(batches):
        let_go()
        pick = _picker(bits.value)
        for chunk in chunks(batches, SMALL_CHUNK):
            terms = Terms(chunk, _spans(chunk), pick)
            row, h = terms.distinct(np.ones(chunk.n, bool))
            yield pa.RecordBatch.from_arrays([pa.array(terms.text[row].view(np.int64)), pa.array(h.view(np.int64))], ["words", "term"])

    return run


def _places(bits):
    def run(batches):
        let_go()
        pick = _picker(bits.value)
        for chunk in chunks(batches, SMALL_CHUNK):
            t = Terms(chunk, _spans(chunk), pick)
            ids, keys = (chunk.rows.column(c).take(pa.array(t.row)) for c in ("doc_id", "text_key"))
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array(t.hash.view(np.int64)), pa.array(t.start), pa.array(t.end)], ["doc_id", "text_key", "term", "start", "end"])

    return run


def _narrow(docs: DataFrame) -> DataFrame:
    return documents_only(docs).withColumn("text_key", F.xxhash64("text"))


def _disclosing(docs: DataFrame, first: DataFrame, n: int, least: int, threshold: float) -> DataFrame:
    """(term, share): disclosing terms, and the largest share of some entity's information that they give."""
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "term bigint, share double")
    evidence = stored(first.where(F.size("entities") > 0).select("words", "entities", "terms").dropDuplicates(["words"]), "evidence")
    entities = stored(evidence.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= least), "entities")
    if entities.isEmpty():
        return empty
    held = evidence.select("words", F.explode("entities").alias("entity")).join(entities.select("entity"), "entity")
    pairs = held.join(evidence.select("words", "terms"), "words").select("entity", F.explode("terms").alias("term"))
    known = F.log(F.lit(float(max(n, 2))) / F.least("n_entity", F.lit(max(n, 2) - 1)))
    # a term's share is at most what the texts with entities alone would give, so that rules out common words first
    among = evidence.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_among"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= least).join(entities, "entity").join(among, "term")
    pairs = stored(pairs.where(1 + F.log(F.col("n_both") / F.col("n_among")) / known >= threshold).select("entity", "n_entity", "term", "n_both"), "pairs")
    if pairs.isEmpty():
        return empty
    bits = spark.sparkContext.broadcast(bloom(pairs, "term"))
    seen = docs.mapInArrow(_frequencies(bits), "words bigint, term bigint").distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    share = 1 + F.log(F.col("n_both") / F.col("n_term")) / known
    told = pairs.join(seen, "term").select("term", share.alias("share"))
    return stored(told.groupBy("term").agg(F.max("share").alias("share")).where(F.col("share") >= threshold), "disclosing")


def telling(first: DataFrame, n: int, threshold: float) -> DataFrame:
    """(doc_id, text_key, term, start, end, share): the places of disclosing identifiers, in n distinct texts."""
    places = first.select("doc_id", "text_key", "words", F.explode("identifiers").alias("at")).select("doc_id", "text_key", "words", "at.*")
    texts = places.select("words", "term").distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    shares = texts.select("term", (1 - F.log("n_term") / F.log(F.lit(float(n)))).alias("share")).where(F.col("share") >= threshold)
    return places.drop("words").join(shares, "term").select("doc_id", "text_key", "term", "start", "end", "share")


def find(docs: DataFrame, least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, n_email, n_ip, n_card, n_phone, base (spans of the patterns) and terms (array of start, end, share)."""
    docs = _narrow(docs)
    first = stored(docs.mapInArrow(_first, "doc_id bigint, text_key bigint, words bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base string, entities array<bigint>, terms array<bigint>, identifiers array<struct<term:bigint,start:bigint,end:bigint>>"), "entities-first")
    n = max(2, first.select("words").distinct().count())
    terms = _disclosing(docs, first, n, least, threshold)
    out = first.drop("entities", "terms", "words", "identifiers")
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,share:double>>)")
    places = telling(first, n, threshold)
    if not terms.isEmpty():
        bits = docs.sparkSession.sparkContext.broadcast(bloom(terms, "term"))
        places = places.unionByName(docs.mapInArrow(_places(bits), "doc_id bigint, text_key bigint, term bigint, start bigint, end bigint").join(terms, "term"))
    places = places.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.array_sort(F.collect_set(F.struct("start", "end", "share"))).alias("terms"))
    out = out.join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    return out.select("doc_id", "text_key", *(f"n_{k}" for k in KINDS), "base", F.coalesce("terms", none).alias("terms"))


def digest(found: DataFrame) -> DataFrame:
    """find()'s rows with base_sha256 and spans (all of them by start, as kind:start:end) in place of base and terms."""
    base = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("bigint").alias("start"), s.alias("span")))
    more = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.concat_ws(":", F.lit("term"), t["start"], t["end"]).alias("span")))
    # patterns' spans keep their order, in which kinds at one start stand as listed; terms don't touch them
    spans = F.array_join(F.transform(F.array_sort(F.concat(base, more), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)), lambda s: s["span"]), ",")
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), spans.alias("spans"))


def replaced(text: str, base: str, terms: list[tuple[int, int, float]]) -> str:
    """text with <KIND> for the patterns' spans, removed terms gone, and generalised ones as shapes."""
    spans = [(int(a), int(b), f"<{k.upper()}>") for k, a, b in (s.split(":") for s in base.split(",") if s)]
    for a, b, share in terms:
        shape = re.sub(r"[^\W\d_]+", "*", text[a:b])
        spans.append((a, b, "" if share >= 1 else shape))
    out, at = [], 0
    for a, b, new in sorted(spans):
        if b <= at:
            continue
        out += [text[at:max(a, at)], new]
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """docs with sanitised text, and n_chars (if there) of that; other columns and the number of rows stay."""
    found = find(docs, least, threshold).where((F.col("base") != "") | (F.size("terms") > 0))
    found = found.select(F.struct("doc_id", "text_key").alias("_key"), F.col("base").alias("_base"), F.col("terms").alias("_terms")).dropDuplicates(["_key"])
    found = found.select("_base", "_terms", F.col("_key.doc_id").alias("_id"), F.col("_key.text_key").alias("_text_key"))

    @F.pandas_udf("string")
    def clean(text: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([t if b is None else replaced(t, b, [(x["start"], x["end"], x["share"]) for x in s]) for t, b, s in zip(text, base, terms)], dtype=object)

    names = docs.columns
    at = {n: f"c{names.index(n)}" for n in ("doc_id", "text", "n_chars") if n in names}
    joined = plain(docs).join(found, F.col(at["doc_id"]).cast("bigint").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(at["text"]).cast("string")) == F.col("_text_key")), "left")
    same = F.col("_base").isNull()
    joined = joined.withColumn("_text", F.when(same, F.col(at["text"])).otherwise(clean(at["text"], "_base", "_terms")))
    new = {at["text"]: F.col("_text")}
    if "n_chars" in at:
        new[at["n_chars"]] = F.when(same, F.col(at["n_chars"])).otherwise(F.length("_text").cast(docs.schema[names.index("n_chars")].dataType))
    return joined.select(*(new.get(f"c{i}", F.col(f"c{i}")).alias(f"c{i}") for i in range(len(names)))).toDF(*names)


__all__ = ["base_spans", "bloom", "digest", "find", "luhn", "replaced", "sanitise"]
