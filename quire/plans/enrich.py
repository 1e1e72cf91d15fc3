"""Queries of enrichment and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import enrich as N
from quire.operators.evaluate import scores, top_accuracy
from quire.sources.tables import table


def tfidf_keywords(spark: SparkSession, d: str) -> DataFrame:
    return N.tfidf_keywords(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def clean_keywords(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "keywords").select("doc_id", N.clean_keywords(F.col("keywords")).alias("k"))
    return rows.select("doc_id", F.posexplode("k").alias("position", "keyword"))


def voted_subjects(spark: SparkSession, d: str) -> DataFrame:
    return N.voted_subject(table(spark, d, "documents", "doc_id", "keywords", "subjects"), "doc_id", "keywords", "subjects")


def topics(spark: SparkSession, d: str) -> DataFrame:
    """Each document's topic: its first subject, else its first keyword, else its title."""
    meta = table(spark, d, "extracted_metadata", "document_id", "title").distinct()
    docs = table(spark, d, "documents", "doc_id", "keywords", "subjects").join(meta, F.col("doc_id") == F.col("document_id"), "left")
    first = lambda c: F.get(F.filter(F.col(c), lambda x: F.length(F.trim(x)) > 0), F.lit(0))
    return N.first_known(docs, "doc_id", [("subject", first("subjects")), ("keyword", first("keywords")), ("title", F.nullif(F.trim("title"), F.lit("")))])


def author_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Authors of each extraction with the score of a candidate at their place."""
    meta = table(spark, d, "extracted_metadata", "meta_id", "authors").distinct()
    rows = meta.select("meta_id", F.posexplode(F.arrays_zip("authors", N.candidate_scores(F.col("authors")).alias("score"))).alias("position", "e"))
    return rows.select("meta_id", "position", F.col("e.authors").alias("author"), F.round("e.score", 6).alias("score"), (F.col("e.score") >= 0.85).alias("accepted"))


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """The JSON properties of events by type, unreadable ones as empty."""
    events = table(spark, d, "events", "event_type", "props", "value")
    keys = F.map_keys(F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>")))
    rows = events.select("event_type", "value", F.explode_outer(keys).alias("property"))
    return rows.groupBy("event_type", "property").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def language_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "language").groupBy(F.col("language"), N.language_code(F.col("language")).alias("code")).agg(F.count("*").alias("n"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "language", "lang")
    runs = table(spark, d, "language_results").distinct()
    return runs.join(docs, runs.document_id == docs.doc_id).select("result_id", N.language_code(F.col("language")).alias("truth"), F.col("primary_lang").alias("first"), F.col("secondary_lang").alias("second"), "confidence")


def language_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores(_runs(spark, d), "truth", "first")


def language_top_two(spark: SparkSession, d: str) -> DataFrame:
    return top_accuracy(_runs(spark, d), F.col("truth"), F.col("first"), F.col("second"))


def close_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the detector by how far its confidence lies above one half."""
    near = F.col("confidence") - 0.5 < 0.15
    return _runs(spark, d).groupBy("first").agg(F.count("*").alias("n"), F.count_if(near).alias("close"), F.round(F.median("confidence"), 6).alias("median"), F.round(F.percentile("confidence", F.lit(0.85)), 6).alias("p85"))


QUERIES = {f.__name__: f for f in (tfidf_keywords, clean_keywords, voted_subjects, topics, author_candidates, event_properties, language_codes, language_scores, language_top_two, close_decisions)}

_CODE = "nullif(coalesce(case lower(trim(language)) " + " ".join(f"when '{n}' then '{c}'" for n, c in N.LANGUAGE_CODES.items()) + " end, substring(lower(trim(language)), 1, 2)), '')"
_RUNS = f"with r as (select distinct * from language_results), runs as (select result_id, {_CODE} as truth, primary_lang as first, secondary_lang as second, confidence from r join documents on document_id = doc_id)"

ORACLE = {
    "tfidf_keywords": """with w as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}{4,}')) as term from documents), tf as (select doc_id, term, count(*) as tf from w group by all),
        df as (select term, count(*) as df from tf group by term), n as (select count(*) as n from documents), s as (select doc_id, term, round(tf * (ln((n + 1) / df) + 1), 6) as score from tf join df using (term), n where tf >= 2)
        select doc_id, term, score, row_number() over (partition by doc_id order by score desc, term) as rank from s qualify rank <= 8""",
    "clean_keywords": """with k as (select doc_id, list_transform(coalesce(keywords, []), lambda x: trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))) as v from documents),
        g as (select doc_id, list_filter(v, lambda x, i: length(x) >= 4 and (contains(x, ' ') or length(x) >= 6) and list_position(v, x) = i) as v from k),
        o as (select doc_id, list_concat(list_filter(v, lambda x: contains(x, ' ')), list_filter(v, lambda x: not contains(x, ' '))) as v from g), h as (select doc_id, v, list_transform(v, lambda x: substring(x, 1, 10)) as h from o),
        f as (select doc_id, list_filter(v, lambda x, i: list_position(h, substring(x, 1, 10)) = i)[1:20] as v from h)
        select doc_id, unnest(range(len(v)))::int as position, unnest(v) as keyword from f""",
    "voted_subjects": """with r as (select doc_id, unnest(list_distinct(keywords)) as keyword from documents), s as (select doc_id, unnest(list_distinct(subjects)) as subject from documents),
        t as (select keyword, subject, count(*) as n from r join s using (doc_id) group by all), b as (select keyword, subject, n from t qualify row_number() over (partition by keyword order by n desc, subject desc) = 1),
        v as (select doc_id, subject, count(*) as votes, sum(n) as n from r join b using (keyword) group by all)
        select doc_id, subject, votes from v qualify row_number() over (partition by doc_id order by votes desc, n desc, subject) = 1""",
    "topics": """with m as (select distinct document_id, title from extracted_metadata), t as (select doc_id, list_filter(subjects, lambda x: length(trim(x)) > 0)[1] as s, list_filter(keywords, lambda x: length(trim(x)) > 0)[1] as k, nullif(trim(title), '') as t from documents left join m on doc_id = document_id)
        select doc_id, case when s is not null then 'subject' when k is not null then 'keyword' when t is not null then 'title' end as method, coalesce(s, k, t) as value from t""",
    "author_candidates": """with m as (select distinct meta_id, authors from extracted_metadata), a as (select meta_id, len(authors) as n, unnest(range(len(authors)))::int as position, unnest(authors) as author from m),
        s as (select meta_id, position, author, case when n = 1 then 1.0 else 1 - position / n end as score from a) select meta_id, position, author, round(score, 6) as score, score >= 0.85 as accepted from s""",
    "event_properties": """with k as (select event_type, value, case when json_valid(props) then json_keys(props) end as k from events), e as (select event_type, value, unnest(case when len(k) > 0 then k else [null] end) as property from k)
        select event_type, property, count(*) as n, round(sum(value), 4) as value from e group by all""",
    "language_codes": f"select language, {_CODE} as code, count(*) as n from documents group by all",
    "language_scores": _RUNS + """, b as (select * from runs where truth is not null), l as (select truth as label from b union select first from b where first is not null),
        c as (select label, (select count(*) from b where truth = label and first = label) as tp, (select count(*) from b where truth <> label and first = label) as fp, (select count(*) from b where truth = label and first is distinct from label) as fn from l)
        select label, tp, fp, fn, case when tp + fp > 0 then round(tp / (tp + fp), 6) else 0 end as precision, case when tp + fn > 0 then round(tp / (tp + fn), 6) else 0 end as recall, case when 2 * tp + fp + fn > 0 then round(2 * tp / (2 * tp + fp + fn), 6) else 0 end as f1 from c""",
    "language_top_two": _RUNS + " select count(*) as n, round(avg(coalesce(truth = first, false)::int), 6) as top1, round(avg((coalesce(truth = first, false) or coalesce(truth = second, false))::int), 6) as top2 from runs where truth is not null",
    "close_decisions": _RUNS + " select first, count(*) as n, count(*) filter (where confidence - 0.5 < 0.15) as close, round(median(confidence), 6) as median, round(quantile_cont(confidence, 0.85), 6) as p85 from runs group by first",
}
