"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import graph as G
from quire.sources.tables import table


def _quads(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "du_document_type", "language", "year", "keywords")
    meta = table(spark, d, "extracted_metadata", "document_id", "title", "authors").distinct()
    refs = table(spark, d, "reference_entries", "document_id", "ref_index", "raw", "title").distinct()
    return G.document_quads(docs, meta, refs)


def graph_quads(spark: SparkSession, d: str) -> DataFrame:
    return _quads(spark, d)


def graph_citing(spark: SparkSession, d: str) -> DataFrame:
    return G.citing(_quads(spark, d))


def graph_references(spark: SparkSession, d: str) -> DataFrame:
    """Documents reached over citations of one and two steps."""
    edges = G.citing(_quads(spark, d)).select(F.col("document").alias("s"), F.col("cited").alias("o"))
    return G.reached(edges, edges.select(F.col("s").alias("start")).distinct(), 2)


def graph_shared_references(spark: SparkSession, d: str) -> DataFrame:
    """How many documents cite each title that at least two cite."""
    cites = G.having(_quads(spark, d), "cites", "document", "slug").filter("not startswith(slug, 'ref_')")
    return cites.groupBy("slug").agg(F.countDistinct("document").alias("documents")).filter("documents > 1")


def graph_coauthors(spark: SparkSession, d: str) -> DataFrame:
    return G.coauthors(_quads(spark, d))


def graph_by_author(spark: SparkSession, d: str) -> DataFrame:
    """Each author's documents with title and year, latest first."""
    q = _quads(spark, d)
    authors = G.having(q, "author", "document", "author")
    titles = G.having(q, "title", "document", "title").groupBy("g", "document").agg(F.min("title").alias("title"))
    years = G.having(q, "year", "document", "year").groupBy("g", "document").agg(F.max(F.expr("try_cast(year as int)")).alias("year"))
    return authors.join(titles, ["g", "document"], "left").join(years, ["g", "document"], "left").select("author", "document", "title", "year")


def graph_concept(spark: SparkSession, d: str) -> DataFrame:
    return G.about(_quads(spark, d), "timber")


def graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    return G.statistics(_quads(spark, d))


def graph_without_failed(spark: SparkSession, d: str) -> DataFrame:
    """The graph's size by predicate without the documents whose processing failed."""
    gone = table(spark, d, "documents", "doc_id", "pipeline_status").filter("pipeline_status = 'failed'").select(F.col("doc_id").cast("string").alias("g"))
    return _quads(spark, d).join(gone, "g", "left_anti").groupBy("p").agg(F.count("*").alias("n"))


def _ruled(spark: SparkSession, d: str) -> DataFrame:
    """Quads that follow from the documents' ids by a rule, so that citations lead somewhere: papers, what they cite and are, concepts, methods, identifiers."""
    x = F.col("doc_id")
    docs = table(spark, d, "documents", "doc_id")
    slugs = lambda n: F.concat(F.lit("work_"), n.cast("string"))
    third = F.floor(x / 3)
    rules = [
        ("same_as", slugs(third)), ("cites", slugs(third - x % 5 - 1)), ("cites", slugs(third + x % 3 + 1)), ("title", F.concat(F.lit("Paper "), x.cast("string"))), ("author", F.concat(F.lit("Author "), (x % 50).cast("string"))),
        ("author", F.concat(F.lit("Author "), (7 * x % 50).cast("string"))), ("about", F.concat(F.lit("theme_"), (x % 20).cast("string"))), ("introduces", F.when(x % 3 == 0, F.concat(F.lit("theme_"), (x % 7).cast("string")))),
        ("uses_method", F.concat(F.lit("method_"), (x % 5).cast("string"))), ("qid", F.when(x % 4 == 0, F.concat(F.lit("Q"), x.cast("string")))), ("orcid", F.format_string("0000-0000-0000-%04d", x % 50)),
    ]
    all_ = F.array(*(F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in rules))
    return docs.select(x.cast("string").alias("g"), F.explode(all_).alias("e")).select("g", F.col("g").alias("s"), "e.p", "e.o").filter("o is not null").distinct()


def graph_citing_works(spark: SparkSession, d: str) -> DataFrame:
    return G.citing(_ruled(spark, d))


def graph_reached_works(spark: SparkSession, d: str) -> DataFrame:
    """What each paper reaches over one and two citations."""
    edges = G.citing(_ruled(spark, d)).select(F.col("document").alias("s"), F.col("cited").alias("o"))
    return G.reached(edges, edges.select(F.col("s").alias("start")).distinct(), 2)


def graph_concepts(spark: SparkSession, d: str) -> DataFrame:
    return G.about_any(_ruled(spark, d), ["about", "introduces", "uses_method"], "_1")


def graph_identifiers(spark: SparkSession, d: str) -> DataFrame:
    q = _ruled(spark, d)
    return G.identified(q, "qid").withColumn("kind", F.lit("qid")).union(G.identified(q, "orcid").withColumn("kind", F.lit("orcid")))


def concept_or_keyword(spark: SparkSession, d: str) -> DataFrame:
    """Documents on a theme by the graph, and those that have it in their keywords only."""
    hits = G.about_any(_ruled(spark, d), ["about"], "theme_1").select(F.col("document").cast("long").alias("doc_id"))
    listed = table(spark, d, "documents", "doc_id", "keywords").filter(F.exists("keywords", lambda k: F.lower(k).contains("timber")))
    return G.or_listed(hits, listed, "doc_id")


def graph_dot(spark: SparkSession, d: str) -> DataFrame:
    return G.dot_lines(_ruled(spark, d))


QUERIES = {f.__name__: f for f in (graph_citing_works, graph_reached_works, graph_concepts, graph_identifiers, concept_or_keyword, graph_dot, graph_quads, graph_citing, graph_references, graph_shared_references, graph_coauthors, graph_by_author, graph_concept, graph_statistics, graph_without_failed)}

_SLUG = "substring(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80)"
_QUADS = f"""with meta as (select distinct document_id, title, authors from extracted_metadata), refs as (select distinct document_id, ref_index, raw, title from reference_entries where length(raw) >= 10),
    raw as (select doc_id::varchar as g, doc_id::varchar as s, 'type' as p, case when du_document_type in ('article', 'thesis', 'report') then du_document_type else 'document' end as o from documents
        union all select doc_id, doc_id, 'language', language from documents union all select doc_id, doc_id, 'year', year::varchar from documents
        union all select doc_id, doc_id, 'about', {_SLUG.format('k')} from (select doc_id, unnest(keywords) as k from documents)
        union all select document_id, document_id, 'title', title from meta union all select document_id, document_id, 'same_as', {_SLUG.format('title')} from meta
        union all select document_id, document_id, 'author', a from (select document_id, unnest(authors) as a from meta)
        union all select document_id, document_id, 'cites', coalesce(nullif({_SLUG.format('title')}, ''), format('ref_{{:04d}}', ref_index)) from refs),
    quads as (select distinct * from raw where o is not null and o <> '')"""
_CITING = _QUADS + """, citing as (select distinct c.s as document, m.s as cited from quads c join quads m on c.p = 'cites' and m.p = 'same_as' and c.o = m.o and c.s <> m.s)"""

_RULED = """with x as (select doc_id::varchar as g, doc_id as i, doc_id // 3 as t from documents),
    r as (select g, 'same_as' as p, 'work_' || t as o from x union select g, 'cites', 'work_' || (t - i % 5 - 1) from x union select g, 'cites', 'work_' || (t + i % 3 + 1) from x union select g, 'title', 'Paper ' || g from x
        union select g, 'author', 'Author ' || (i % 50) from x union select g, 'author', 'Author ' || (7 * i % 50) from x union select g, 'about', 'theme_' || (i % 20) from x union select g, 'introduces', 'theme_' || (i % 7) from x where i % 3 = 0
        union select g, 'uses_method', 'method_' || (i % 5) from x union select g, 'qid', 'Q' || i from x where i % 4 = 0 union select g, 'orcid', format('0000-0000-0000-{:04d}', i % 50) from x),
    citing as (select distinct a.g as document, b.g as cited from r a join r b on a.p = 'cites' and b.p = 'same_as' and a.o = b.o and a.g <> b.g)"""

ORACLE = {
    "graph_citing_works": _RULED + " select document, cited, 'Paper ' || cited as title from citing",
    "graph_reached_works": _RULED + """, one as (select document as start, cited as node, 1 as depth from citing),
        two as (select distinct o.start, c.cited as node, 2 as depth from one o join citing c on o.node = c.document where c.cited <> o.start and not exists (select 1 from one x where x.start = o.start and x.node = c.cited))
        select * from one union all select * from two""",
    "graph_concepts": _RULED + " select g as document, p as predicate, o as concept, 'Paper ' || g as title from r where p in ('about', 'introduces', 'uses_method') and contains(o, '_1')",
    "graph_identifiers": _RULED + " select o as id, count(distinct g) as documents, p as kind from r where p in ('qid', 'orcid') group by all",
    "concept_or_keyword": _RULED + """, h as (select distinct g::bigint as doc_id from r where p = 'about' and contains(o, 'theme_1'))
        select doc_id, 'graph' as source from h union all select distinct doc_id, 'keyword' from documents where len(list_filter(keywords, lambda k: contains(lower(k), 'timber'))) > 0 and doc_id not in (select doc_id from h)""",
    "graph_dot": _RULED + """ select distinct format('"{}" -> "{}" [label="{}"];', g, o, p) as line from r""",
    "graph_quads": _QUADS + " select * from quads",
    "graph_citing": _CITING + " select document, cited, (select min(o) from quads t where t.p = 'title' and t.s = cited) as title from citing",
    "graph_references": _CITING + """, one as (select document as start, cited as node, 1 as depth from citing),
        two as (select distinct o.start, c.cited as node, 2 as depth from one o join citing c on o.node = c.document where c.cited <> o.start and not exists (select 1 from one x where x.start = o.start and x.node = c.cited))
        select * from one union all select * from two""",
    "graph_shared_references": _QUADS + " select o as slug, count(distinct s) as documents from quads where p = 'cites' and not starts_with(o, 'ref_') group by o having count(distinct s) > 1",
    "graph_coauthors": _QUADS + " select a.o as author, b.o as other, count(distinct a.s) as shared from quads a join quads b on a.p = 'author' and b.p = 'author' and a.g = b.g and a.s = b.s and a.o <> b.o group by all",
    "graph_by_author": _QUADS + """, t as (select g, s, min(o) as title from quads where p = 'title' group by all), y as (select g, s, max(try_cast(o as int)) as year from quads where p = 'year' group by all)
        select a.o as author, a.s as document, title, year from quads a left join t using (g, s) left join y using (g, s) where a.p = 'author'""",
    "graph_concept": _QUADS + """, h as (select distinct g, s from quads where p = 'about' and contains(o, 'timber')), t as (select g, s, min(o) as title from quads where p = 'title' group by all)
        select s as document, title from h left join t using (g, s)""",
    "graph_statistics": _QUADS + " select count(*) as quads, count(distinct g) as graphs, count(distinct case when p = 'author' then o end) as authors, count_if(p = 'cites') as citations, count_if(p = 'about') as concepts from quads",
    "graph_without_failed": _QUADS + " select p, count(*) as n from quads where g not in (select doc_id::varchar from documents where pipeline_status = 'failed') group by p",
}
