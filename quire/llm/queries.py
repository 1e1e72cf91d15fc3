"""The queries of this subpackage by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import written
from quire.sources.tables import table

from .cooccurrence import cooccurrence
from .frequency import term_frequency
from .language import label_errors, languages, train
from .leaks import leaks
from .lookalike import canonical, look_classes, lookalikes
from .matching import CONFIDENT, links
from .names import variant_pairs, variants
from .packing import pack
from .pages import page_kinds
from .scans import Scans, sources
from .terms import normal_terms


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Every reference with the record it most likely cites, and the confidence."""
    return links(table(spark, d, "reference_entries"), table(spark, d, "works"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_links(spark, d).filter(F.col("confidence") >= CONFIDENT).select("work_id", "ref_id")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "keywords")
    return cooccurrence(docs, "doc_id", normal_terms(docs.keywords), min_count=5, min_lift=6.0)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(F.col("a").alias("keyword_a"), F.col("b").alias("keyword_b"))


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of keywords with its counts."""
    docs = table(spark, d, "documents", "doc_id", "keywords")
    return cooccurrence(docs, "doc_id", normal_terms(docs.keywords)).select(
        F.col("a").alias("keyword_a"), F.col("b").alias("keyword_b"), "n_a", "n_b", "n_ab", "n_records", F.round("lift", 6).alias("lift")
    )


def _looks(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "blocks").select(F.lit("blocks.text").alias("field"), F.col("block_id").alias("id"), "text")
    titles = table(spark, d, "extracted_metadata").select(F.lit("extracted_metadata.title").alias("field"), F.col("meta_id").alias("id"), F.col("title").alias("text"))
    return blocks.union(titles)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes(_looks(spark, d), "field", "id", "text")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every row that looks like a different string, with its class."""
    return look_classes(_looks(spark, d), "field", "id", "text")


def p3_titles(spark: SparkSession, d: str) -> DataFrame:
    """Every title in its one form."""
    return canonical(table(spark, d, "extracted_metadata", "meta_id", "title"), "title")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "language")
    model = train(docs, "doc_id", "text", "language")
    found = written(languages(docs, "doc_id", "text", model), "languages")
    return label_errors(found, docs, table(spark, d, "language_results"))


def p4_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document and segment with its language and confidence."""
    docs = table(spark, d, "documents", "doc_id", "text", "language")
    return languages(docs, "doc_id", "text", train(docs, "doc_id", "text", "language"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "keywords", "subjects")
    return term_frequency(docs, {"keywords": normal_terms(docs.keywords), "subjects": normal_terms(docs.subjects)})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).filter(F.col("mark").isNotNull()).select("field", "term", "mark")


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct term with its counts."""
    return _terms(spark, d)


def _scans(spark: SparkSession, d: str) -> Scans:
    form = F.trim(F.regexp_replace(F.lower("form"), r"[^\p{L}\p{M}]+", " ")).alias("form")
    meta = table(spark, d, "extracted_metadata", "document_id", "title", "authors")
    titles = meta.select("document_id", F.col("title").alias("form")).union(meta.select("document_id", F.explode("authors")))
    texts = sources(table(spark, d, "blocks"), table(spark, d, "text_segments"))
    return Scans(texts, titles.select("document_id", form).filter("form is not null").distinct())


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).noise()


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every text as a readable paragraph."""
    return _scans(spark, d).repaired()


def _entities(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "extracted_metadata", "authors").union(table(spark, d, "reference_entries", "authors"))
    return written(variants(lists.select(F.explode("authors").alias("name")), "name"), "entities")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return variant_pairs(_entities(spark, d))


def p7_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every name with the entity it names."""
    return _entities(spark, d)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), "doc_id", "text", "source")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("item_id", "doc_id").distinct()


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every leak with the words found in a row and the words that differ."""
    return _leaks(spark, d)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return page_kinds(table(spark, d, "documents"), "doc_id", "text").filter("spam").select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_links, p2_found, p2_pairs, p3_found, p3_classes, p3_titles, p4_found, p4_languages, p5_found, p5_terms, p6_found, p6_repaired, p7_found, p7_entities, p8_packed, p9_found, p9_leaks, p10_found)}


_TERM = "trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))"

_BASKETS = f"""with baskets as (select doc_id, unnest(list_distinct(list_filter(list_transform(keywords, lambda x: {_TERM}), lambda x: x <> ''))) as t from documents),
    size as (select t, count(*) as n from baskets group by t), total as (select count(distinct doc_id) as n from baskets),
    pairs as (select a.t as keyword_a, b.t as keyword_b, count(*) as n_ab from baskets a join baskets b on a.doc_id = b.doc_id and a.t < b.t group by all)"""

_COUNTS = f"""with e as (select 'keywords' as field, doc_id, unnest(list_transform(keywords, lambda x: {_TERM})) as term from documents
        union all select 'subjects', doc_id, unnest(list_transform(subjects, lambda x: {_TERM})) from documents),
    size as (select field, count(distinct doc_id) as field_records from e where term <> '' group by field),
    counts as (select field, term, count(*) as occurrences, count(distinct doc_id) as records from e where term <> '' group by all),
    marked as (select field, term, occurrences, records, field_records, case when records <= 2 then 'rare' when records > 0.1 * field_records then 'common' end as mark from counts join size using (field))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _BASKETS + """ select keyword_a, keyword_b from pairs join size x on x.t = keyword_a join size y on y.t = keyword_b, total
            where n_ab >= 5 and n_ab * total.n >= 6 * x.n * y.n""",
        "p2_pairs": _BASKETS + """ select keyword_a, keyword_b, x.n as n_a, y.n as n_b, n_ab, total.n as n_records, round(n_ab * total.n / (x.n * y.n), 6) as lift
            from pairs join size x on x.t = keyword_a join size y on y.t = keyword_b, total""",
        "p5_found": _COUNTS + " select field, term, mark from marked where mark is not null",
        "p5_terms": _COUNTS + " select * from marked",
    }
