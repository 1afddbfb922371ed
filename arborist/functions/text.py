"""Column functions over texts; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 32 ASCII punctuation characters that the retrieval tokenizer deletes (fixed values).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Words that keyword extraction leaves out (fixed values).
STOPWORDS = (
    "the", "and", "for", "with", "that", "this", "from", "are", "was", "were",
    "has", "have", "into", "using", "used", "use", "its", "their", "our", "can",
    "will", "not", "but", "all", "also", "such", "these", "those", "between",
)


def tokens(text: Column) -> Column:
    """Lower-cased, without punctuation, split at white space; a null text has none."""
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.array_remove(F.split(bare, r"\s+"), "")


def keywords(text: Column) -> Column:
    """All words of a letter and two or more letters, digits or hyphens (lower-cased) that aren't stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z][a-z0-9-]{2,})"))
    return F.filter(found, lambda w: ~w.isin(*STOPWORDS))


def snippet(text: Column, size: int = 300) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def sentences(text: Column) -> Column:
    """Split after . ! ? before white space; trimmed, without empty ones."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def label(words: Column, node_id: Column) -> Column:
    """The first three keywords, or a name made from the node."""
    first = F.array_join(F.slice(words, 1, 3), " / ")
    return F.when(first != "", first).otherwise(F.concat(F.lit("Cluster "), node_id))


def overlap(query: Column, words: Column) -> Column:
    """The share of the query's distinct tokens that words has."""
    distinct = F.array_distinct(query)
    return F.size(F.array_intersect(distinct, words)) / F.greatest(F.size(distinct), F.lit(1))


def hash_bucket(token: Column, size: int) -> Column:
    """The token's MD5, read as a number, modulo size (0-based)."""
    digest = F.md5(F.encode(token, "UTF-8"))
    if size & (size - 1) == 0 and size <= 1 << 60:  # the last hexadecimal digits decide
        return F.conv(F.substring(digest, -15, 15), 16, 10).cast("bigint") % size
    digits = F.split(digest, "")
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, c: F.when(c == "", a).otherwise((a * 16 + F.conv(c, 16, 10).cast("bigint")) % size))


def hash_embedding(text: Column, size: int) -> Column:
    """Token counts by hash bucket, of length 1; zeros without tokens."""
    from .vector import let, normalised

    places = F.sequence(F.lit(0), F.lit(size - 1))
    buckets = F.transform(tokens(text), lambda t: hash_bucket(t, size))
    return normalised(let(buckets, lambda held: F.transform(places, lambda i: F.size(F.filter(held, lambda b: b == i)).cast("double"))))
