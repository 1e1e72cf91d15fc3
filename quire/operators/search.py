"""Full-text, TF-IDF and vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): how often each term stands in each document, and the document's number of terms."""
    words = docs.select(F.col(key), tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    return words.select(key, F.explode("w").alias("term"), F.size("w").alias("length")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def _count(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The `k` best documents that hold every term of `query`, with their BM25 score; ties go to the smaller key.

    Only the query's terms are counted: one pass over the texts, and no shuffle of postings.
    """
    terms = sorted({t.lower() for t in query})
    words = docs.select(F.col(key), tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    found = words.select(key, F.size("w").alias("length"), *(_count("w", t).alias(f"tf{i}") for i, t in enumerate(terms)))
    stats = found.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    hits = found.filter(" AND ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return hits.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def tfidf_search(docs: DataFrame, key: str, text: str, query: list[str], k: int) -> DataFrame:
    """The `k` documents nearest to the query by the cosine of TF-IDF vectors (idf smoothed, tokens of two characters or more)."""
    post = postings(docs, key, text).filter(F.length("term") >= 2)
    n = docs.count()
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.col("tf") * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)
    weighted = post.join(df, "term").withColumn("w", weight)
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    terms = sorted({t.lower() for t in query})
    idf = df.filter(F.col("term").isin(terms)).select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("q"))
    length = idf.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("length"))
    dots = weighted.filter(F.col("term").isin(terms)).join(F.broadcast(idf), "term").groupBy(key).agg(F.sum(F.col("w") * F.col("q")).alias("dot"))  # a row for each query term
    scored = dots.join(norms, key).crossJoin(F.broadcast(length))  # one row
    return scored.select(key, F.round(F.col("dot") / (F.col("norm") * F.col("length")), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def best_segments(segments: DataFrame, document: str, key: str, text: str, query: list[str], k: int) -> DataFrame:
    """The `k` documents with the best segment, by the query terms it holds and their number, and the beginning of that segment."""
    w = tokens(F.coalesce(F.col(text), F.lit("")))
    terms = sorted({t.lower() for t in query})
    rows = segments.select(document, key, text, w.alias("w"))
    counts = [_count("w", t) for t in terms]
    held = sum(((c > 0).cast("int") for c in counts[1:]), (counts[0] > 0).cast("int"))
    total = sum(counts[1:], counts[0])
    scored = rows.select(document, key, text, held.alias("held"), total.alias("total")).filter("held > 0")
    best = scored.groupBy(document).agg(F.max_by(F.struct(key, "held", "total", F.substring(text, 1, 300).alias("snippet")), F.struct("held", "total", -F.col(key))).alias("b"))
    return best.select(document, "b.*").orderBy(F.desc("held"), F.desc("total"), document).limit(k)


def fused(rankings: list[DataFrame], key: str, constant: int = 60) -> DataFrame:
    """(key, score): reciprocal rank fusion of rankings with the columns `key` and `rank`."""
    every = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        every = every.union(r.select(key, "rank"))
    return every.groupBy(key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))
