"""Queries of titles, sections and repeated furniture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import similarity, text
from quire.operators import layout as L
from quire.sources.tables import table

from .layout import _B, _CANDIDATES, _HEADS
from .text import _FIRST


def _titles(spark: SparkSession, d: str) -> DataFrame:
    """Extracted titles beside the first lines of their documents."""
    meta = table(spark, d, "extracted_metadata", "meta_id", "document_id", "title", "title_confidence").distinct()
    lines = table(spark, d, "documents", "doc_id", "text").select("doc_id", text.first_line(F.col("text")).alias("line"))
    return meta.join(lines, meta.document_id == lines.doc_id, "left")


def title_similarity(spark: SparkSession, d: str) -> DataFrame:
    both = _titles(spark, d).filter("title is not null")
    score = similarity.title_similarity(F.col("title"), F.col("line"))
    return both.select("meta_id", similarity.osa_distance(F.lower("title"), F.col("line")).alias("edits"), F.round(score, 6).alias("similarity"), (score >= 0.7).alias("same"))


def title_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    n = text.word_count(F.col("line"))
    line = F.col("line")
    sure = F.when(n <= 3, 0.45).when(n <= 6, 0.55).otherwise(0.65)
    title, confidence = similarity.reconciled(F.nullif(F.trim("title"), F.lit("")), F.coalesce("title_confidence", F.lit(0.5)), line, sure)
    return _titles(spark, d).select("meta_id", title.alias("title"), F.round(confidence, 6).alias("confidence"))


def section_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The six most frequent words of each numbered section.

    A section is laid on the pages it spans, so that a block meets the sections of its own page only.
    """
    blocks = L.text_blocks(table(spark, d, "blocks"))
    at = blocks.select("block_id", F.struct("page_index", "block_index", "block_id").alias("at"))
    heads = L.sections(blocks).select("document_id", F.col("block_id").alias("head"), "next")
    starts = heads.join(at.withColumnRenamed("block_id", "head").withColumnRenamed("at", "start"), "head")
    both = starts.join(at.withColumnRenamed("block_id", "next").withColumnRenamed("at", "end"), "next", "left")
    last = blocks.groupBy("document_id").agg(F.max("page_index").alias("last"))
    spans = both.join(last, "document_id").withColumn("page_index", F.explode(F.sequence(F.col("start.page_index"), F.coalesce(F.col("end.page_index"), F.col("last")))))
    inside = blocks.withColumn("at", F.struct("page_index", "block_index", "block_id")).join(spans, L.PAGE).filter((F.col("at") > F.col("start")) & (F.col("end").isNull() | (F.col("at") < F.col("end"))))
    words = inside.select("head", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{6,}"), F.lit(0))).alias("term")).groupBy("head", "term").agg(F.count("*").alias("n"))
    best = words.groupBy("head").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "term"))), 1, 6).alias("b"))
    return best.select(F.col("head").alias("block_id"), F.posexplode("b").alias("rank", "e")).select("block_id", "rank", F.col("e.term").alias("term"), (-F.col("e.m")).alias("n"))


def furniture_clusters(spark: SparkSession, d: str) -> DataFrame:
    return L.band_clusters(L.furniture_candidates(L.bands(L.text_blocks(table(spark, d, "blocks")))), rounds=3)


def weighted_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The eight weightiest words of each document: three for a word of the title, two of a heading, one of the first segments."""
    titles = table(spark, d, "extracted_metadata", "document_id", "title").distinct().select("document_id", F.col("title").alias("t"), F.lit(3).alias("w"))
    segments = table(spark, d, "text_segments", "document_id", "segment_id", "segment_index", "kind", "text").distinct()
    heads = segments.filter("kind = 'heading'").select("document_id", F.col("text").alias("t"), F.lit(2).alias("w"))
    intro = segments.filter("kind <> 'heading' and segment_index < 15").select("document_id", F.col("text").alias("t"), F.lit(1).alias("w"))
    terms = titles.union(heads).union(intro).select("document_id", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}{6,}"), F.lit(0))).alias("term"), "w")
    sums = terms.groupBy("document_id", "term").agg(F.sum("w").alias("weight"))
    best = sums.groupBy("document_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("m"), "term"))), 1, 8).alias("b"))
    return best.select("document_id", F.posexplode("b").alias("rank", "e")).select("document_id", "rank", F.col("e.term").alias("term"), (-F.col("e.m")).alias("weight"))


QUERIES = {f.__name__: f for f in (title_similarity, title_reconciliation, section_keywords, furniture_clusters, weighted_keywords)}

_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'))"
_SQ = "trim(regexp_replace(line, '[\\s\\x{00a0}]+', ' ', 'g'))"


def _clusters(rounds: int) -> str:
    sql, rest, out = _CANDIDATES + ", r0 as (select *, unnest(['all', case when (page_index + 1) % 2 = 1 then 'odd' else 'even' end]) as parity from c)", "r0", []
    for i in range(1, rounds + 1):
        sql += f""", m{i} as (select document_id, side, parity, median(y0) as m0, median(y1) as m1 from {rest} group by all), o{i} as (select {rest}.*, abs(y0 - m0) as d0, abs(y1 - m1) as d1 from {rest} join m{i} using (document_id, side, parity)),
            s{i} as (select document_id, side, parity, median(d0) as a0, median(d1) as a1 from o{i} group by all), k{i} as (select o{i}.*, d0 <= greatest(2 * a0, 4.0) and d1 <= greatest(2 * a1, 4.0) as near from o{i} join s{i} using (document_id, side, parity)),
            r{i} as (select * exclude (near, d0, d1) from k{i} where not near)"""
        out.append(f"select document_id, side, parity, {i} as cluster, round(median(y0), 4) as y0, round(median(y1), 4) as y1, count(*) as pages from k{i} where near group by all")
        rest = f"r{i}"
    return sql + " " + " union all ".join(out)


ORACLE = {
    "title_reconciliation": f"""with m as (select distinct meta_id, document_id, title, title_confidence from extracted_metadata), l as (select doc_id, {_FIRST} as line from documents),
        a as (select meta_id, nullif(trim(title), '') as t, coalesce(title_confidence, 0.5) as ts, line as u, len(string_split({_SQ}, ' ')) as n from m left join l on doc_id = document_id),
        b as (select *, case when n <= 3 then 0.45 when n <= 6 then 0.55 else 0.65 end as us, {_TOKENS.format('t')} as x, {_TOKENS.format('u')} as y from a),
        c as (select *, case when len(list_distinct(list_concat(x, y))) > 0 then len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) else 0.0 end as j, greatest(ts, us) as best from b)
        select meta_id, case when t is null then u when u is null or ts >= us then t else u end as title, round(case when t is null then us when u is null then ts when j >= 0.8 then least(0.97, best + 0.20) when j >= 0.4 then least(0.80, best + 0.10) else greatest(0.30, best - 0.05) end, 6)::double as confidence from c""",
    "section_keywords": f"""with {_B}, {_HEADS}, h as (select *, lead(position) over (partition by document_id order by position) as n from heads),
        p as (select b.document_id, b.page_index as pi, b.block_index as bi, b.block_id as id, b.text from b),
        j as (select h.block_id as head, p.text from p join h on p.document_id = h.document_id and (p.pi, p.bi, p.id) > (h.page_index, h.block_index, h.block_id)
            where not exists (select 1 from heads g where g.document_id = h.document_id and g.position = h.position + 1 and (p.pi, p.bi, p.id) >= (g.page_index, g.block_index, g.block_id))),
        w as (select head, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{6,}}')) as term from j), t as (select head, term, count(*) as n from w group by all)
        select head as block_id, (row_number() over (partition by head order by n desc, term) - 1)::int as rank, term, n from t qualify rank < 6""",
    "furniture_clusters": _clusters(3),
    "weighted_keywords": """with s as (select distinct document_id, segment_id, segment_index, kind, text from text_segments), a as (select document_id, title as t, 3 as w from (select distinct document_id, title from extracted_metadata)
            union all select document_id, text, 2 from s where kind = 'heading' union all select document_id, text, 1 from s where kind <> 'heading' and segment_index < 15),
        e as (select document_id, unnest(regexp_extract_all(lower(t), '\\p{L}{6,}')) as term, w from a), g as (select document_id, term, sum(w)::bigint as weight from e group by all)
        select document_id, (row_number() over (partition by document_id order by weight desc, term) - 1)::int as rank, term, weight from g qualify rank < 8""",
}
