"""Queries of the search operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import word_count
from quire.operators.search import best_segments, bm25, fused, tfidf_search
from quire.operators.vectors import centroids, nearest
from quire.sources.tables import table

TERMS = ["timber", "frame", "record"]


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return bm25(table(spark, d, "documents"), "doc_id", "text", TERMS, 20)


def tfidf_documents(spark: SparkSession, d: str) -> DataFrame:
    return tfidf_search(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", TERMS, 20)


def segment_search(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "text_segments", "document_id", "segment_id", "text").distinct()
    return best_segments(segments, "document_id", "segment_id", "text", TERMS, 20)


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Segments to embed: headings with what follows them, and bodies of 40 words or more; at most 1,500 characters."""
    segments = table(spark, d, "text_segments", "document_id", "segment_id", "segment_index", "kind", "text").distinct().filter("text is not null")
    order = Window.partitionBy("document_id").orderBy("segment_index", "segment_id")
    placed = segments.withColumn("after", F.lead("text").over(order)).withColumn("heads", F.lag("kind").over(order))
    heads = placed.filter("kind = 'heading'").select("document_id", "segment_id", F.lit("heading").alias("chunk"), F.concat_ws("\n", "text", "after").alias("text"))
    bodies = placed.filter((F.col("kind") != "heading") & (F.coalesce("heads", F.lit("")) != "heading") & (word_count(F.col("text")) >= 40)).select("document_id", "segment_id", F.lit("body").alias("chunk"), "text")
    return heads.union(bodies).select(F.format_string("%d_%06d", "document_id", "segment_id").alias("chunk_id"), "chunk", F.substring("text", 1, 1500).alias("text"))


def vector_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings", "vec_id", "embedding")
    return nearest(rows, rows.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10)


def similar_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of vectors by the cosine of their centroids."""
    rows = table(spark, d, "embeddings", "label", "embedding")
    c = centroids(rows, "label", "embedding")
    pairs = c.alias("a").join(c.alias("b"), F.col("a.label") < F.col("b.label"))  # a row for each of the few labels
    dot = F.aggregate(F.zip_with("a.centroid", "b.centroid", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.select(F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"), F.round(F.greatest(F.lit(0.0), dot), 5).alias("score"))


def similar_documents(spark: SparkSession, d: str) -> DataFrame:
    """The five documents most like each queried one: the cosine of its centroid with their best chunk. Five vectors in a row are taken for a document's chunks."""
    chunks = table(spark, d, "embeddings", "vec_id", "embedding").withColumn("doc", F.floor(F.col("vec_id") / 5))
    asked = centroids(chunks.filter("doc % 20 = 0"), "doc", "embedding").select("doc", F.col("centroid").alias("embedding"))
    found = nearest(chunks, asked, "vec_id", "embedding", 5, "doc")
    return found.select("query", F.col("group").alias("doc"), F.col("id").alias("chunk"), F.round(F.greatest(F.lit(0.0), "cosine"), 5).alias("score"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    ranked = lambda df, key: df.select(F.col(key).alias("doc_id"), F.row_number().over(Window.orderBy(*[F.desc(c) for c in ("score", "held", "total") if c in df.columns], key)).alias("rank"))  # noqa: E731  top-k rows only
    return fused([ranked(bm25_search(spark, d), "doc_id"), ranked(segment_search(spark, d), "document_id")], "doc_id")


QUERIES = {f.__name__: f for f in (bm25_search, tfidf_documents, segment_search, semantic_chunks, vector_search, similar_groups, similar_documents, hybrid_search)}

_BM25 = """w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as w from documents),
    f as (select doc_id, len(w) as length, len(list_filter(w, lambda x: x = 'frame')) as a, len(list_filter(w, lambda x: x = 'record')) as b, len(list_filter(w, lambda x: x = 'timber')) as c from w),
    s as (select count(*) as n, avg(length) as mean, count_if(a > 0) as da, count_if(b > 0) as db, count_if(c > 0) as dc from f),
    bm as (select doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / mean)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * length / mean))
        + ln(1 + (n - dc + 0.5) / (dc + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * length / mean)), 6) as score from f, s where a > 0 and b > 0 and c > 0 order by score desc, doc_id limit 20)"""
_SEGMENTS = """sw as (select distinct document_id, segment_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as w from text_segments),
    sc as (select document_id, segment_id, text, len(list_filter(w, lambda x: x = 'frame')) as a, len(list_filter(w, lambda x: x = 'record')) as b, len(list_filter(w, lambda x: x = 'timber')) as c from sw),
    sr as (select document_id, segment_id, (a > 0)::int + (b > 0)::int + (c > 0)::int as held, (a + b + c)::int as total, substring(text, 1, 300) as snippet from sc),
    sb as (select * from sr where held > 0 qualify row_number() over (partition by document_id order by held desc, total desc, segment_id) = 1 order by held desc, total desc, document_id limit 20)"""

ORACLE = {
    "bm25_search": "with " + _BM25 + " select * from bm",
    "tfidf_documents": """with t as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) as term from documents), p as (select doc_id, term, count(*) as tf from t where length(term) >= 2 group by all),
        df as (select term, count(*) as df from p group by term), n as (select count(*) as n from documents), w as (select doc_id, term, tf * (ln((1.0 + n) / (1 + df)) + 1) as w from p join df using (term), n),
        norm as (select doc_id, sqrt(sum(w * w)) as norm from w group by doc_id), q as (select term, ln((1.0 + n) / (1 + df)) + 1 as q from df, n where term in ('timber', 'frame', 'record')), l as (select sqrt(sum(q * q)) as l from q)
        select doc_id, round(sum(w * q) / (any_value(norm) * any_value(l)), 6) as score from w join q using (term) join norm using (doc_id), l group by doc_id order by score desc, doc_id limit 20""",
    "segment_search": "with " + _SEGMENTS + " select * from sb",
    "semantic_chunks": """with s as (select distinct document_id, segment_id, segment_index, kind, text from text_segments where text is not null),
        p as (select *, lead(text) over o as after, lag(kind) over o as heads from s window o as (partition by document_id order by segment_index, segment_id)),
        c as (select document_id, segment_id, 'heading' as chunk, concat_ws(chr(10), text, after) as text from p where kind = 'heading' union all
            select document_id, segment_id, 'body', text from p where kind <> 'heading' and coalesce(heads, '') <> 'heading' and len(string_split(trim(regexp_replace(text, '[\\s\\x{00a0}]+', ' ', 'g')), ' ')) >= 40)
        select format('{:d}_{:06d}', document_id, segment_id) as chunk_id, chunk, substring(text, 1, 1500) as text from c""",
    "vector_search": """with p as (select q.vec_id as query, r.vec_id as id, round(list_cosine_similarity(q.embedding::double[], r.embedding::double[]), 6) as cosine from embeddings q, embeddings r where q.vec_id % 20 = 0 and q.vec_id <> r.vec_id)
        select query, id, cosine from p qualify row_number() over (partition by query order by cosine desc, id) <= 10""",
    "similar_groups": """with e as (select label, unnest(range(len(embedding))) as at_, unnest(embedding)::double as x from embeddings), m as (select label, at_, avg(x) as x from e group by all), n as (select label, sqrt(sum(x * x)) as norm from m group by label)
        select a.label as label_a, b.label as label_b, round(greatest(0, sum(a.x * b.x) / (any_value(na.norm) * any_value(nb.norm))), 5) as score from m a join m b on a.at_ = b.at_ and a.label < b.label
        join n na on na.label = a.label join n nb on nb.label = b.label group by all""",
    "similar_documents": """with c as (select vec_id, vec_id // 5 as doc, embedding::double[] as v from embeddings), u as (select doc, unnest(range(len(v))) as at_, unnest(v) as x from c where doc % 20 = 0),
        m as (select doc, at_, avg(x) as x from u group by all), q as (select doc, list(x order by at_) as v from m group by doc),
        p as (select q.doc as query, c.doc, vec_id, round(list_cosine_similarity(q.v, c.v), 6) as s from q join c on q.doc <> c.doc), b as (select query, doc, arg_min(vec_id, (-s, vec_id)) as chunk, max(s) as s from p group by all)
        select query, doc, chunk, round(greatest(0.0, s), 5) as score from b qualify row_number() over (partition by query order by s desc, chunk) <= 5""",
    "hybrid_search": "with " + _BM25 + ", " + _SEGMENTS + """, r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from bm union all select document_id, row_number() over (order by held desc, total desc, document_id) from sb)
        select doc_id, round(sum(1.0 / (60 + rank)), 9) as score from r group by doc_id""",
}
