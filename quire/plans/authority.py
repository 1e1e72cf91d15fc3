"""Queries of the authority operators and of the remaining layout measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import slug
from quire.operators import authority as A
from quire.operators import layout as L
from quire.operators.evaluate import scores
from quire.sources.tables import table

from .graph import _SLUG
from .layout import _B, _COLUMNS, _PAGE_COLUMNS, columns_of_pages

GROUPS = ["ZH", "LH", "NW", "AN", "LK"]


def notations(spark: SparkSession, d: str) -> DataFrame:
    """Notations in the documents' texts, every eleventh of which gets one by rule."""
    x = F.col("doc_id")
    docs = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(x % 11 == 0, F.concat(F.lit(" ZH "), (x % 3000).cast("string"))).otherwise("")).alias("text"))
    return A.notations(docs, "doc_id", "text", GROUPS)


def name_parts(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "works", "authors").select(F.explode("authors").alias("name")).filter(F.length(F.trim("name")) > 0).distinct()
    given, family = A.name_parts(F.col("name"))
    return names.select("name", given.alias("given"), family.alias("family"))


def canonical_values(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "extracted_metadata", "meta_id", "doi", "isbn", "extracted_at").distinct()
    uri = F.concat(F.lit("http://www.wikidata.org/entity/Q"), F.col("meta_id").cast("string"))
    return meta.select("meta_id", A.canonical_doi(F.concat(F.lit("https://doi.org/"), F.upper("doi"))).alias("doi"), A.canonical_isbn(F.col("isbn")).alias("isbn"), A.entity_id(uri).alias("entity"), A.year_of(F.col("extracted_at").cast("string")).alias("year"))


def bibliographic_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of the works as JSON, read back: in print for every third, online for every second."""
    w = table(spark, d, "works", "work_id", "title", "year", "authors").distinct()
    date = lambda y: F.struct(F.array(F.array(y)).alias("date-parts"))
    x, y = F.col("work_id"), F.col("year")
    people = F.transform("authors", lambda a: F.struct(F.lit(None).cast("string").alias("given"), a.alias("family")))
    record = F.struct(F.array("title").alias("title"), people.alias("author"), F.when(x % 3 == 0, date(y + 1)).alias("published-print"), F.when(x % 2 == 0, date(y + 2)).alias("published-online"), date(y).alias("issued"))
    return A.bibliographic(w.select("work_id", F.to_json(record).alias("json")), "work_id", "json")


def resolved_entities(spark: SparkSession, d: str) -> DataFrame:
    """The work that answers for each document: by DOI, else by ISBN, else by title; the works have DOIs and ISBNs by rule."""
    meta = table(spark, d, "extracted_metadata", "meta_id", "title", "doi", "isbn").distinct().withColumn("slug", F.nullif(slug(F.col("title")), F.lit("")))
    own = table(spark, d, "works", "work_id", "title").distinct().select(F.concat(F.lit("Q"), F.col("work_id").cast("string")).alias("entity"), F.nullif(slug(F.col("title")), F.lit("")).alias("slug"))
    known = meta.select("doi", "isbn", F.concat(F.lit("Q"), F.col("meta_id").cast("string")).alias("entity"), "meta_id")
    return A.resolved(meta, "meta_id", [("doi", known.filter("meta_id % 2 = 0")), ("isbn", known.filter("meta_id % 3 = 0")), ("slug", own)])


def status_updates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "pipeline_status")
    return A.status_rows(docs.select("doc_id", F.when(F.col("pipeline_status") == "failed", F.col("text")).alias("error")), "doc_id", "error")


def size_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The rank of each block's height among those of its document, from 0 to 1, by way of the counts of distinct heights."""
    blocks = L.text_blocks(table(spark, d, "blocks")).select("document_id", "block_id", F.round(F.col("y1") - F.col("y0"), 3).alias("height"))
    counts = blocks.groupBy("document_id", "height").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("document_id").orderBy("height").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy("document_id"))
    ranks = counts.select("document_id", "height", F.when(total > 1, F.round(below / (total - 1), 6)).otherwise(0.0).alias("percentile"))
    return blocks.join(ranks, ["document_id", "height"]).select("block_id", "percentile")


def gap_norms(spark: SparkSession, d: str) -> DataFrame:
    """The space above each block over the document's median positive one, with its 75th and 90th percentile as bounds of loose and wide."""
    order = Window.partitionBy(*L.PAGE).orderBy("y0", "block_id")
    gaps = L.text_blocks(table(spark, d, "blocks")).withColumn("gap", F.col("y0") - F.lag("y1").over(order)).filter("gap is not null").select("document_id", "block_id", "gap")
    middle = gaps.filter("gap > 0").groupBy("document_id").agg(F.median("gap").alias("m"))
    norms = gaps.join(middle, "document_id").withColumn("gap_norm", F.round(F.col("gap") / F.col("m"), 6))
    bounds = norms.groupBy("document_id").agg(F.percentile("gap_norm", F.lit(0.75)).alias("p75"), F.percentile("gap_norm", F.lit(0.9)).alias("p90"))
    label = F.when(F.col("gap_norm") > F.col("p90"), "wide").when(F.col("gap_norm") > F.col("p75"), "loose").otherwise("normal")
    return norms.join(bounds, "document_id").select("block_id", "gap_norm", label.alias("label"))


def column_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of the columns found on each page, against a truth by rule; pages not found count as errors."""
    found = columns_of_pages(spark, d).select("document_id", "page_index", F.col("columns").cast("string").alias("found"))
    pages = table(spark, d, "blocks", "document_id", "page_index").distinct().withColumn("truth", (F.col("document_id") % 2 + 1).cast("string"))
    return scores(pages.join(found, L.PAGE, "left"), "truth", "found")


def files_of_truth(spark: SparkSession, d: str) -> DataFrame:
    """For each file name in lower case the document that was added first."""
    docs = table(spark, d, "documents", "doc_id", "file_name", "added_at").filter("file_name is not null")
    return docs.groupBy(F.lower("file_name").alias("file")).agg(F.min_by("doc_id", F.struct("added_at", "doc_id")).alias("doc_id"), F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (notations, name_parts, canonical_values, bibliographic_records, resolved_entities, status_updates, size_percentiles, gap_norms, column_evaluation, files_of_truth)}

ORACLE = {
    "notations": f"""with t as (select doc_id, coalesce(text, '') || case when doc_id % 11 = 0 then ' ZH ' || (doc_id % 3000) else '' end as text from documents), n as (select distinct doc_id, unnest(regexp_extract_all(text, '{A.NOTATION}')) as n from t),
        p as (select doc_id, regexp_extract(n, '{A.NOTATION}', 1) as a, regexp_extract(n, '{A.NOTATION}', 2)::int as b from n) select distinct doc_id, a || ' ' || b as notation from p where b between 100 and 99999 and a in ({", ".join(f"'{g}'" for g in GROUPS)})""",
    "name_parts": """with n as (select distinct a as name, trim(regexp_replace(a, '\\s+', ' ', 'g')) as t from (select unnest(authors) as a from works) where length(trim(a)) > 0)
        select name, case when contains(t, ',') then trim(regexp_replace(t, '^[^,]*,', '')) else regexp_replace(t, ' ?[^ ]+$', '') end as given, case when contains(t, ',') then trim(string_split(t, ',')[1]) else string_split(t, ' ')[-1] end as family from n""",
    "canonical_values": """with m as (select distinct meta_id, regexp_replace(lower(trim(doi)), '\\.+$', '') as doi, regexp_replace(upper(isbn), '[^0-9X]', '', 'g') as isbn, extracted_at from extracted_metadata)
        select meta_id, case when regexp_matches(doi, '^10\\.\\d{4,9}/\\S+$') then doi end as doi, case when length(isbn) in (10, 13) then isbn end as isbn, 'Q' || meta_id as entity, year(extracted_at)::int as year from m""",
    "bibliographic_records": """select distinct work_id, title, coalesce(array_to_string(list_filter(list_transform(authors, lambda a: trim(a)), lambda x: x <> ''), '; '), null) as authors,
        coalesce(case when work_id % 3 = 0 then year + 1 end, case when work_id % 2 = 0 then year + 2 end, year)::int as year from works""",
    "resolved_entities": f"""with m as (select distinct meta_id, title, doi, isbn, nullif({_SLUG.format('title')}, '') as slug from extracted_metadata), w as (select nullif({_SLUG.format('title')}, '') as slug, min('Q' || work_id) as e from works group by 1),
        a as (select doi, min('Q' || meta_id) as e from m where meta_id % 2 = 0 group by doi), b as (select isbn, min('Q' || meta_id) as e from m where meta_id % 3 = 0 group by isbn)
        select meta_id, coalesce(a.e, b.e, w.e) as entity, case when a.e is not null then 'doi' when b.e is not null then 'isbn' else 'slug' end as by from m left join a on a.doi = m.doi left join b on b.isbn = m.isbn left join w on w.slug = m.slug where coalesce(a.e, b.e, w.e) is not null""",
    "status_updates": """with e as (select doc_id, case when pipeline_status = 'failed' then text end as error from documents) select doc_id, case when length(coalesce(error, '')) > 0 then 'failed' else 'done' end as status, case when length(coalesce(error, '')) > 0 then right(error, 800) end as message from e""",
    "size_percentiles": f"with {_B} select block_id, round(percent_rank() over (partition by document_id order by round(y1 - y0, 3)), 6) as percentile from b",
    "gap_norms": f"""with {_B}, g as (select document_id, block_id, y0 - lag(y1) over (partition by document_id, page_index order by y0, block_id) as gap from b), m as (select document_id, median(gap) as m from g where gap > 0 group by document_id),
        n as (select document_id, block_id, round(gap / m, 6) as gap_norm from g join m using (document_id) where gap is not null), q as (select document_id, quantile_cont(gap_norm, 0.75) as p75, quantile_cont(gap_norm, 0.9) as p90 from n group by document_id)
        select block_id, gap_norm, case when gap_norm > p90 then 'wide' when gap_norm > p75 then 'loose' else 'normal' end as label from n join q using (document_id)""",
    "column_evaluation": f"""with {_B}, {_COLUMNS}, {_PAGE_COLUMNS}, x as (select document_id, page_index, (document_id % 2 + 1)::varchar as truth, columns::varchar as found from (select distinct document_id, page_index from blocks) left join pc using (document_id, page_index)),
        labels as (select truth as label from x union select found from x where found is not null),
        c as (select label, count_if(truth = label and found = label)::bigint as tp, count_if(truth <> label and found = label)::bigint as fp, count_if(truth = label and found is distinct from label)::bigint as fn from labels, x group by label)
        select label, tp, fp, fn, case when tp + fp > 0 then round(tp / (tp + fp), 6) else 0.0 end as precision, case when tp + fn > 0 then round(tp / (tp + fn), 6) else 0.0 end as recall, case when 2 * tp + fp + fn > 0 then round(2 * tp / (2 * tp + fp + fn), 6) else 0.0 end as f1 from c""",
    "files_of_truth": "select lower(file_name) as file, arg_min(doc_id, (added_at, doc_id)) as doc_id, count(*) as documents from documents where file_name is not null group by 1",
}
