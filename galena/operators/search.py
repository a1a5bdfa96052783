"""Text and vector search: terms, weighted keyword scores, BM25, cosine neighbours, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words that a search leaves out, and BM25's parameters.
STOP = ("and", "or", "not")
K1, B = 1.2, 0.75
TERM = r"[\p{L}\p{N}_]+"


def terms(text: Column) -> Column:
    """The distinct search terms of a text."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP)))


def keyword_score(columns: dict[str, float], words: list[str]) -> Column:
    """For each column with its weight: weight x (terms + 1) if it has the phrase, weight for each term that it has."""
    total, phrase = F.lit(0.0), " ".join(words)
    for name, weight in columns.items():
        low = F.lower(F.coalesce(F.col(name), F.lit("")))
        total = total + F.when(low.contains(phrase), weight * (len(words) + 1)).otherwise(0.0)
        for word in words:
            total = total + F.when(low.contains(word), weight).otherwise(0.0)
    return total


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of an inverted index."""
    words = docs.select(key, F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))).alias("term"))
    return words.groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """(key, score) of the rows that have one of ``words``; statistics over all rows, postings of the words only.

    Each text is cut into words once; what is left of it is a row of its size and its hits.
    """
    from galena.operators.traverse import cut

    tokens = docs.select(key, F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)).alias("t"))
    sized = cut(tokens.select(key, F.size("t").alias("size"), F.filter("t", lambda t: t.isin(*words)).alias("hits")))
    whole = sized.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    tf = sized.select(key, "size", F.explode("hits").alias("term")).groupBy(key, "size", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(whole))  # a row for each word, and one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return tf.join(F.broadcast(df), "term").groupBy(key).agg(F.sum(idf * gain).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def nearest(vectors: DataFrame, query: list[float], k: int, most: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows within the cosine distance ``most``: (key, distance)."""
    distance = F.round(1 - cosine(F.col(vector), F.array(*map(F.lit, query))), 6)
    return vectors.select(key, distance.alias("distance")).filter(F.col("distance") < most).orderBy("distance", key).limit(k)


def chunks(docs: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 120) -> DataFrame:
    """(key, chunk, start, content): pieces of ``size`` characters, each ``overlap`` back into the last."""
    n, step = F.length(text), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    rows = docs.filter(n > 0).select(key, text, F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return rows.select(key, "chunk", (F.col("chunk") * step).alias("start"), F.substring(F.col(text), F.col("chunk") * step + 1, F.lit(size)).alias("content"))
