"""Keywords, subjects and languages derived from what a collection holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# English names of languages and their codes.
LANGUAGE_CODES = {"english": "en", "german": "de", "french": "fr", "spanish": "es", "italian": "it", "dutch": "nl", "portuguese": "pt"}


def language_code(name: Column) -> Column:
    """The code of a language given by code, region code or English name; otherwise its first two letters."""
    plain = F.lower(F.trim(name))
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair))
    return F.nullif(F.coalesce(table[plain], F.substring(plain, 1, 2)), F.lit(""))


def tfidf_keywords(docs: DataFrame, key: str, text: str, k: int = 8, least: int = 2, letters: int = 4) -> DataFrame:
    """(key, term, score, rank): the `k` words of each text with the largest tf * (ln((n + 1) / (df + 1)) + 1).

    Words have `letters` letters at least and stand `least` times in the text; df leaves the text itself out; ties go by the word.
    """
    words = docs.select(key, F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"\p{L}{%d,}" % letters), F.lit(0))).alias("term"))
    tf = words.groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.count()
    scored = tf.filter(F.col("tf") >= least).join(df, "term").withColumn("score", F.round(F.col("tf") * (F.log((F.lit(n) + 1) / F.col("df")) + 1), 6))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "term"))), 1, k)
    rows = scored.groupBy(key).agg(best.alias("b")).select(key, F.posexplode("b").alias("rank", "e"))
    return rows.select(key, F.col("e.term").alias("term"), (-F.col("e.s")).alias("score"), (F.col("rank") + 1).alias("rank"))


def clean_keywords(words: Column, letters: int = 4, single: int = 6, stem: int = 10, most: int = 20) -> Column:
    """Keywords in lower case: of `letters` letters at least, single words of `single`; one for each beginning of `stem` letters; those of several words first."""
    plain = F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")))
    good = F.array_distinct(F.filter(plain, lambda x: (F.length(x) >= letters) & (x.contains(" ") | (F.length(x) >= single))))
    ordered = F.concat(F.filter(good, lambda x: x.contains(" ")), F.filter(good, lambda x: ~x.contains(" ")))
    heads = F.transform(ordered, lambda x: F.substring(x, 1, stem))
    kept = F.filter(ordered, lambda x, i: F.array_position(heads, F.substring(x, 1, stem)) == i + 1)
    return F.slice(kept, 1, most)


def voted_subject(docs: DataFrame, key: str, keywords: str, subjects: str) -> DataFrame:
    """(key, subject, votes): for each record the subject that its keywords stand with most often in other records."""
    rows = docs.select(key, F.array_distinct(keywords).alias("k"), F.array_distinct(subjects).alias("s"))
    together = rows.select(F.explode("k").alias("keyword"), "s").select("keyword", F.explode("s").alias("subject")).groupBy("keyword", "subject").agg(F.count("*").alias("n"))
    best = together.groupBy("keyword").agg(F.max(F.struct("n", "subject")).alias("b")).select("keyword", "b.subject", "b.n")
    votes = rows.select(key, F.explode("k").alias("keyword")).join(best, "keyword").groupBy(key, "subject").agg(F.count("*").alias("votes"), F.sum("n").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("votes"), F.desc("n"), "subject")  # a record's own few subjects
    return votes.withColumn("r", F.row_number().over(order)).filter("r = 1").select(key, "subject", "votes")


def first_known(df: DataFrame, key: str, steps: list[tuple[str, Column]]) -> DataFrame:
    """(key, method, value): the first of several ways that gives a value."""
    value = F.coalesce(*(c for _, c in steps))
    method = F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in steps))
    return df.select(key, method.alias("method"), value.alias("value"))


def candidate_scores(items: Column) -> Column:
    """1 for a single candidate, else 1 less the candidate's place over their number."""
    n = F.size(items)
    return F.transform(items, lambda x, i: F.when(n == 1, 1.0).otherwise(1 - i / n))
