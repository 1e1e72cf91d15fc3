"""Queries of the catalogue: finding, merging, removing, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators.catalog import filled, find, first_rows, gap_filled, inserted, last_rows, upserted, without
from quire.sources.tables import table


def _meta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_metadata").distinct()


def find_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "du_document_type", "year").withColumnRenamed("year", "doc_year")
    both = docs.join(_meta(spark, d).select("document_id", "authors", "doi", "year"), F.col("doc_id") == F.col("document_id"))
    return find(both, author="anna", kind="article", years="1900-1990").select("doc_id", "year")


def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "file_name").withColumn("prefix", F.substring("file_name", 1, 3))
    return first_rows(docs, "prefix", F.col("file_name"), F.col("doc_id")).select("prefix", "doc_id")


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "pipeline_status", "du_document_type", "source")
    return docs.groupBy("pipeline_status", "du_document_type").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


def doctor(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "text", "file_name", "pipeline_status", "n_chars")
    return docs.agg(
        F.count_if(F.coalesce(F.col("file_name"), F.lit("")) == "").alias("missing_files"),
        F.count_if(F.col("pipeline_status") == "failed").alias("failed"),
        F.count_if(~F.coalesce(F.col("pipeline_status"), F.lit("")).isin("indexed", "failed")).alias("unfinished"),
        F.count_if(F.length("text") != F.col("n_chars")).alias("wrong_length"),
    )


def latest_result(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "language_results").distinct()
    return last_rows(runs, "document_id", F.col("detected_at"), F.col("result_id")).select("document_id", "result_id", "primary_lang", "confidence")


def first_block(spark: SparkSession, d: str) -> DataFrame:
    """Each document with its first text block, or without one."""
    blocks = table(spark, d, "blocks", "document_id", "page_index", "block_index", "block_id", "block_type", "text").distinct().filter((F.col("block_type") == 0) & (F.length(F.trim("text")) > 0))
    firsts = first_rows(blocks, "document_id", F.col("page_index"), F.col("block_index"), F.col("block_id"))
    return table(spark, d, "documents", "doc_id").join(firsts.select(F.col("document_id").alias("doc_id"), "block_id", "page_index"), "doc_id", "left")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "language", "year", "du_document_type", "pipeline_status")


def _change(spark: SparkSession, d: str) -> DataFrame:
    """What a later run found: rows of known documents, some fields empty, and of new ones."""
    meta = _meta(spark, d).select("document_id", "year").filter("document_id % 3 = 0")
    kind = F.when(F.col("document_id") % 2 == 0, "report")
    return meta.select(F.when(F.col("document_id") % 9 == 0, -F.col("document_id")).otherwise(F.col("document_id")).alias("doc_id"), F.lit("la").alias("language"), "year", kind.alias("du_document_type"), F.lit("indexed").alias("pipeline_status"))


def merge_results(spark: SparkSession, d: str) -> DataFrame:
    return filled(_documents(spark, d), _change(spark, d), "doc_id", ["year", "pipeline_status"], ["du_document_type"])


def upsert_results(spark: SparkSession, d: str) -> DataFrame:
    return upserted(_documents(spark, d), _change(spark, d), ["doc_id"])


def insert_results(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of document and language, with nulls in the key."""
    pairs = _documents(spark, d).select("doc_id", "language")
    runs = table(spark, d, "language_results").select(F.col("document_id").alias("doc_id"), F.col("primary_lang").alias("language"))
    return inserted(pairs, runs, ["doc_id", "language"])


def fill_gaps(spark: SparkSession, d: str) -> DataFrame:
    meta = _meta(spark, d)
    target = meta.select("meta_id", "title", "year", "doi", "issn")
    refs = table(spark, d, "reference_entries", "document_id", "ref_id", "doi").distinct().filter("doi is not null")
    known = first_rows(refs, "document_id", F.col("ref_id"))
    source = meta.select("meta_id", "document_id").join(known, "document_id").select("meta_id", F.lit("untitled").alias("title"), F.lit(1900).alias("year"), "doi")
    return gap_filled(target, source, "meta_id", ["title", "year", "doi"])


def remove_documents(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each table without the documents of one status."""
    gone = table(spark, d, "documents", "doc_id", "pipeline_status").filter("pipeline_status = 'failed'")
    out = None
    for name in ("blocks", "text_segments", "extracted_metadata", "reference_entries"):
        n = without(table(spark, d, name, "document_id").distinct(), gone, "document_id", "doc_id").agg(F.count("*").alias("documents")).select(F.lit(name).alias("name"), "documents")
        out = n if out is None else out.union(n)
    return out


def incremental_update(spark: SparkSession, d: str) -> DataFrame:
    """Files seen again, by the hash of their text: new ones, and those known already."""
    docs = table(spark, d, "documents", "doc_id", "text", "added_at")
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("hash"), "added_at")
    cut = docs.agg(F.percentile_approx(F.unix_micros(F.col("added_at").cast("timestamp")), 0.5, 1_000_000).alias("cut"))
    seen = hashed.crossJoin(F.broadcast(cut)).withColumn("known", F.unix_micros(F.col("added_at").cast("timestamp")) <= F.col("cut"))  # one row
    known = seen.filter("known").select("hash").distinct().withColumn("there", F.lit(True))
    later = seen.filter("not known").join(known, "hash", "left")
    return later.select(F.when(F.col("there"), "skipped").otherwise("new").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def report_overview(spark: SparkSession, d: str) -> DataFrame:
    meta = _meta(spark, d).select(F.col("document_id").alias("doc_id"), "title", F.size(F.coalesce("authors", F.array().cast("array<string>"))).alias("authors"))
    docs = table(spark, d, "documents", "doc_id", "n_chars", "du_document_type", "has_native_text")
    return docs.join(meta, "doc_id", "left").select("doc_id", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("(untitled)")).alias("title"), F.coalesce("authors", F.lit(0)).alias("authors"), "n_chars", F.coalesce("du_document_type", F.lit("unknown")).alias("kind"))


def report_ocr(spark: SparkSession, d: str) -> DataFrame:
    """How each document got its text."""
    docs = table(spark, d, "documents", "doc_id", "text", "has_native_text")
    state = F.when(F.length(F.coalesce("text", F.lit(""))) == 0, "ocr_candidate").when(F.col("has_native_text") == 1, "text_pdf").otherwise("fallback_text_pdf")
    return docs.select("doc_id", state.alias("state"), text.quality(F.col("text")).alias("quality")).groupBy("state", "quality").agg(F.count("*").alias("n"))


def report_problems(spark: SparkSession, d: str) -> DataFrame:
    """Documents with poor text, with their latest language run."""
    docs = table(spark, d, "documents", "doc_id", "text").select("doc_id", text.quality(F.col("text")).alias("quality")).filter(F.col("quality").isin("poor", "very_poor", "empty"))
    return docs.join(latest_result(spark, d).select(F.col("document_id").alias("doc_id"), "primary_lang"), "doc_id", "left")


def report_authors(spark: SparkSession, d: str) -> DataFrame:
    """Authors with their documents, and whether these have references and a first text block."""
    refs = table(spark, d, "reference_entries", "document_id").distinct().withColumn("has_references", F.lit(True))
    rows = _meta(spark, d).select("document_id", F.explode("authors").alias("author")).distinct()
    joined = rows.join(refs, "document_id", "left").select("author", "document_id", F.coalesce("has_references", F.lit(False)).alias("has_references"))
    return joined.groupBy("author").agg(F.count("*").alias("documents"), F.count_if("has_references").alias("with_references"))


QUERIES = {f.__name__: f for f in (find_documents, prefix_lookup, status_counts, doctor, latest_result, first_block, merge_results, upsert_results, insert_results, fill_gaps, remove_documents, incremental_update, report_overview, report_ocr, report_problems, report_authors)}

_QUALITY = """case when length(coalesce(text, '')) = 0 then 'empty' when length(text) < 200 then 'very_poor' when length(text) < 1000 then 'poor'
    when length(regexp_replace(text, '[\\p{L}\\p{N}_\\s.,;:!?()\\[\\]''"/-]', '', 'g')) / length(text) > 0.20 then 'poor'
    when length(regexp_replace(text, '[\\p{L}\\p{N}_\\s.,;:!?()\\[\\]''"/-]', '', 'g')) / length(text) > 0.10 then 'mixed' else 'good' end"""
_CHANGE = """change as (select case when document_id % 9 = 0 then -document_id else document_id end as doc_id, 'la' as language, year, case when document_id % 2 = 0 then 'report' end as du_document_type, 'indexed' as pipeline_status
    from (select distinct * from extracted_metadata) where document_id % 3 = 0)"""
_LATEST = "latest as (select document_id, arg_max(result_id, (detected_at, result_id)) as result_id from (select distinct * from language_results) group by document_id), runs as (select distinct * from language_results)"

ORACLE = {
    "find_documents": """select doc_id, m.year from documents join (select distinct * from extracted_metadata) m on doc_id = document_id
        where du_document_type = 'article' and m.year between 1900 and 1990 and len(list_filter(m.authors, lambda a: contains(lower(a), 'anna'))) > 0""",
    "prefix_lookup": "select substring(file_name, 1, 3) as prefix, arg_min(doc_id, (file_name, doc_id)) as doc_id from documents group by 1",
    "status_counts": "select pipeline_status, du_document_type, count(*) as n, count(distinct source) as sources from documents group by all",
    "doctor": """select count_if(coalesce(file_name, '') = '') as missing_files, count_if(pipeline_status = 'failed') as failed,
        count_if(coalesce(pipeline_status, '') not in ('indexed', 'failed')) as unfinished, count_if(length(text) <> n_chars) as wrong_length from documents""",
    "latest_result": "with " + _LATEST + " select document_id, result_id, primary_lang, confidence from latest join runs using (document_id, result_id)",
    "first_block": """with b as (select distinct document_id, page_index, block_index, block_id from blocks where block_type = 0 and length(trim(text)) > 0),
        f as (select *, row_number() over (partition by document_id order by page_index, block_index, block_id) as n from b)
        select doc_id, block_id, page_index from documents left join f on doc_id = document_id and n = 1""",
    "merge_results": "with " + _CHANGE + """ select d.doc_id, d.language, coalesce(c.year, d.year) as year, case when c.doc_id is not null then c.du_document_type else d.du_document_type end as du_document_type,
        coalesce(c.pipeline_status, d.pipeline_status) as pipeline_status from documents d left join change c on d.doc_id = c.doc_id""",
    "upsert_results": "with " + _CHANGE + " select doc_id, language, year, du_document_type, pipeline_status from documents where doc_id not in (select doc_id from change) union all select * from change",
    "insert_results": """select doc_id, language from documents union all (select distinct document_id, primary_lang from language_results r
        where not exists (select 1 from documents d where d.doc_id = r.document_id and d.language is not distinct from r.primary_lang))""",
    "fill_gaps": """with m as (select distinct * from extracted_metadata), r as (select document_id, arg_min(doi, ref_id) as doi from (select distinct document_id, ref_id, doi from reference_entries where doi is not null) group by 1)
        select meta_id, case when r.document_id is not null then coalesce(nullif(title, ''), 'untitled') else nullif(title, '') end as title, case when r.document_id is not null then coalesce(year, 1900) else year end as year,
            coalesce(nullif(m.doi, ''), r.doi) as doi, issn from m left join r using (document_id)""",
    "remove_documents": " union all ".join(f"select '{t}' as name, count(distinct document_id) as documents from {t} where document_id not in (select doc_id from documents where pipeline_status = 'failed')" for t in ("blocks", "text_segments", "extracted_metadata", "reference_entries")),
    "incremental_update": """with h as (select doc_id, sha256(text) as hash, epoch_us(added_at) as t from documents), c as (select quantile_disc(t, 0.5) as cut from h), k as (select distinct hash from h, c where t <= cut)
        select case when k.hash is not null then 'skipped' else 'new' end as outcome, count(*) as n from (select h.* from h, c where t > cut) l left join k using (hash) group by all""",
    "report_overview": """select doc_id, coalesce(nullif(m.title, ''), '(untitled)') as title, coalesce(len(m.authors), 0)::int as authors, n_chars, coalesce(du_document_type, 'unknown') as kind
        from documents left join (select distinct * from extracted_metadata) m on doc_id = document_id""",
    "report_ocr": f"""select case when length(coalesce(text, '')) = 0 then 'ocr_candidate' when has_native_text = 1 then 'text_pdf' else 'fallback_text_pdf' end as state, {_QUALITY} as quality, count(*) as n from documents group by all""",
    "report_problems": "with " + _LATEST + f""", q as (select doc_id, {_QUALITY} as quality from documents) select doc_id, quality, primary_lang from q left join (select document_id, primary_lang from latest join runs using (document_id, result_id)) on doc_id = document_id
        where quality in ('poor', 'very_poor', 'empty')""",
    "report_authors": """with a as (select distinct document_id, unnest(authors) as author from extracted_metadata), r as (select distinct document_id from reference_entries)
        select author, count(*) as documents, count(r.document_id) as with_references from a left join r using (document_id) group by author""",
}
