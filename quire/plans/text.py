"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import fuzzy, text
from quire.functions.identifiers import PATTERNS, identifier_rows, promoted
from quire.sources.tables import table


def text_quality_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "lang", "text")
    return docs.groupBy("lang", text.quality(F.col("text")).alias("quality")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


def first_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.first_line(F.col("text")).alias("first_line"), text.slug(F.col("text")).alias("slug"))


def _identifiers(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "reference_entries", "document_id", "raw", "doi").distinct()
    texts = table(spark, d, "documents", F.col("doc_id").alias("document_id"), "text", "file_name")
    meta = table(spark, d, "extracted_metadata").select("document_id", F.concat_ws(" ", "doi", "isbn", "issn").alias("ids")).distinct()
    return identifier_rows(texts, "document_id", "text", "text").union(identifier_rows(meta, "document_id", "ids", "metadata")).union(identifier_rows(texts, "document_id", "file_name", "file")).union(identifier_rows(refs, "document_id", "doi", "reference")).distinct()


def identifier_scan(spark: SparkSession, d: str) -> DataFrame:
    return _identifiers(spark, d)


def identifier_summary(spark: SparkSession, d: str) -> DataFrame:
    return _identifiers(spark, d).groupBy("source", "kind").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))


def promoted_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return promoted(_identifiers(spark, d), "document_id")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.length(F.trim("line")) > 0)


def heading_labels(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).withColumn("kind", text.heading_kind(F.col("line"))).filter("kind is not null").select("doc_id", "line_no", "kind")


def chapter_levels(spark: SparkSession, d: str) -> DataFrame:
    numbered = table(spark, d, "blocks", "block_id", "text").distinct().select("block_id", F.explode(F.split("text", "\n")).alias("line"))
    found = numbered.select("block_id", "line", text.chapter_number(F.col("line")).alias("number")).filter("number is not null")
    return found.select("block_id", "line", "number", text.chapter_level(F.col("number")).alias("level"))


def surface_features(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "text_segments", "segment_id", "text").distinct().filter("text is not null")
    return segments.select("segment_id", *(c.alias(n) for n, c in text.surface(F.col("text")).items()))


def corrupt_texts(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "blocks", "document_id", "block_id", "text").distinct()
    return blocks.groupBy("document_id").agg(F.count("*").alias("blocks"), F.count_if(text.is_corrupt(F.col("text"))).alias("corrupt"), F.count_if(text.unspaced(F.col("text")) != F.col("text")).alias("letter_spaced"), F.count_if(text.is_caps(F.col("text"))).alias("capitals"))


def keyword_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.regexp_extract("line", r"^(?:Keywords|Key words|Index terms)\s*:\s*(.*)$", 1)
    return _lines(spark, d).withColumn("line", line).filter("line <> ''").select("doc_id", "line_no", F.posexplode(text.keyword_list(F.col("line"))).alias("position", "keyword"))


def font_families(spark: SparkSession, d: str) -> DataFrame:
    """Font names made of the parts' brands, so that there is something to normalise."""
    name = F.concat(F.lit("ABCDEF+"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.element_at(F.array(*map(F.lit, ("-Bold", "-Italic", "-BoldItalic", ""))), (F.col("p_size") % 4 + 1).cast("int")))
    return table(spark, d, "part").select(name.alias("font"), text.font_family(name).alias("family")).groupBy("family").agg(F.count("*").alias("n"), F.countDistinct("font").alias("fonts"))


def fuzzy_algebra(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_discount") * 10, F.col("l_tax") * 12.5
    terms = {"both": fuzzy.both(a, b), "either": fuzzy.either(a, b), "negated": fuzzy.negated(a), "implies": fuzzy.implies(a, b), "boosted": fuzzy.boosted(a, b), "dampened": fuzzy.dampened(a, b), "ramp": fuzzy.ramp(F.col("l_quantity"), 10, 40)}
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*(F.round(F.avg(c), 6).alias(n) for n, c in terms.items()))


def title_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """The words that an extracted title shares with the first line of its document."""
    meta = table(spark, d, "extracted_metadata", "meta_id", "document_id", "title").distinct().filter("title is not null")
    docs = table(spark, d, "documents", "doc_id", "text").select("doc_id", text.token_set(text.first_line(F.col("text"))).alias("line"))
    both = meta.join(docs, meta.document_id == docs.doc_id)
    return both.select("meta_id", F.round(text.jaccard(text.token_set(F.col("title")), F.col("line")), 6).alias("jaccard"))


def text_evidence(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").filter("text is not null")
    return docs.select("doc_id", *(c.alias(n) for n, c in text.evidence(F.col("text")).items()))


QUERIES = {f.__name__: f for f in (text_quality_by_lang, first_lines, identifier_scan, identifier_summary, promoted_identifiers, heading_labels, chapter_levels, surface_features, corrupt_texts, keyword_lines, font_families, fuzzy_algebra, title_jaccard, text_evidence)}

_SQUEEZED = "trim(regexp_replace({0}, '[\\s\\x{{00a0}}]+', ' ', 'g'))"
_FIRST = "lower(" + _SQUEEZED.format("coalesce(list_filter(string_split(text, chr(10)), lambda x: length(" + _SQUEEZED.format("x") + ") > 0)[1], substring(text, 1, 80))") + ")"


def _words(column: str) -> str:
    s = _SQUEEZED.format(column)
    return f"case when length({s}) > 0 then len(string_split({s}, ' ')) else 0 end"


def _ids(source: str, key: str, column: str, frm: str) -> str:
    parts = []
    for kind, pattern in PATTERNS.items():
        matches = f"regexp_extract_all({column}, '{pattern}', 1)"
        if kind == "doi":
            matches = f"list_transform({matches}, lambda x: regexp_replace(x, '\\.+$', ''))"
        parts.append(f"select {key} as document_id, '{source}' as source, '{kind}' as kind, {matches} as v from {frm}")
    return " union all ".join(parts)


_IDS = f"""with raw as ({_ids('text', 'doc_id', 'text', 'documents')} union all {_ids('metadata', 'document_id', "concat_ws(' ', doi, isbn, issn)", '(select distinct document_id, doi, isbn, issn from extracted_metadata)')}
        union all {_ids('file', 'doc_id', 'file_name', 'documents')} union all {_ids('reference', 'document_id', 'doi', '(select distinct document_id, raw, doi from reference_entries)')}),
    kept as (select document_id, source, kind, list_filter(v, lambda x, i: list_position(v, x) = i) as v from raw),
    ids as (select distinct document_id, source, kind, unnest(range(len(v)))::int as position, unnest(v) as value from kept)"""

_LINES = "with lines as (select doc_id, unnest(range(len(string_split(text, chr(10)))))::int as line_no, unnest(string_split(text, chr(10))) as line from documents), kept as (select * from lines where length(trim(line)) > 0)"
_BARE = "lower(trim(regexp_replace(line, '^\\s*(?:\\d+(?:\\.\\d+)*\\.?\\s+)?|\\s*[:.]?\\s*$', '', 'g')))"
_REST = f"regexp_extract(line, '{text.CHAPTER}', 2)"
_CHAPTER_OK = f"""regexp_matches(line, '{text.CHAPTER}') and ({_words(_REST)}) <= 10 and not regexp_matches({_REST}, '[.;:,]\\s*$') and not regexp_matches({_REST}, '\\s\\d+\\s*$')
    and not regexp_matches({_REST}, '^(?:Figure|Fig|Table|Tab|Abb|Tabelle|Figura|Tabla)\\b') and not contains({_REST}, '→')"""
_CAPS = "length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g')) >= 3 and regexp_replace({0}, '[^\\p{{L}}]', '', 'g') = upper(regexp_replace({0}, '[^\\p{{L}}]', '', 'g'))".format("text")
_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'))"

ORACLE = {
    "text_quality_by_lang": """with q as (select lang, text, length(coalesce(text, '')) as size, length(regexp_replace(text, '[\\p{L}\\p{N}_\\s.,;:!?()\\[\\]''"/-]', '', 'g')) as odd from documents)
        select lang, case when size = 0 then 'empty' when size < 200 then 'very_poor' when size < 1000 then 'poor' when odd / size > 0.20 then 'poor' when odd / size > 0.10 then 'mixed' else 'good' end as quality,
            count(*) as n, round(avg(size), 6) as mean_chars from q group by all""",
    "first_lines": f"select doc_id, {_FIRST} as first_line, substring(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) as slug from documents",
    "identifier_scan": _IDS + " select document_id, source, kind, position, value from ids",
    "identifier_summary": _IDS + " select source, kind, count(*) as n, count(distinct document_id) as documents from ids group by all",
    "promoted_identifiers": _IDS + " select document_id, " + ", ".join(f"arg_min(value, (source, position, value)) filter (kind = '{k}') as {k}" for k in PATTERNS) + " from ids group by document_id",
    "heading_labels": _LINES + ", k as (select doc_id, line_no, case " + " ".join(f"when {_BARE} in ({', '.join(repr(w) for w in words.split())}) then '{kind}'" for kind, words in text.HEADINGS.items()) + " end as kind from kept) select * from k where kind is not null",
    "chapter_levels": f"""with lines as (select block_id, unnest(string_split(text, chr(10))) as line from (select distinct block_id, text from blocks)),
        n as (select block_id, line, regexp_replace(regexp_extract(line, '{text.CHAPTER}', 1), '\\.0$', '') as number from lines where {_CHAPTER_OK})
        select block_id, line, number, len(string_split(number, '.'))::int as level from n""",
    "surface_features": f"""with s as (select distinct segment_id, text, greatest(length(text), 1) as size from text_segments where text is not null)
        select segment_id, length(text) as chars, {_words('text')} as words, len(string_split(text, chr(10))) as lines, len(regexp_extract_all(text, '[.!?](?:\\s|$)')) as sentences,
            round(length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) / size, 6) as capital_ratio, round(length(regexp_replace(text, '[^0-9]', '', 'g')) / size, 6) as digit_ratio,
            round(length(regexp_replace(text, '[^.,;:!?]', '', 'g')) / size, 6) as punctuation_ratio, ends_with(rtrim(text, ' '), '.') as ends_with_period, regexp_matches(text, '^\\s*\\d') as starts_with_number,
            regexp_matches(text, '\\[[^\\]]*\\]') as has_brackets, regexp_matches(text, '\\([^)]*\\)') as has_parentheses, regexp_matches(text, '\\b(?:1[4-9]\\d\\d|20\\d\\d)\\b') as has_year,
            regexp_matches(text, 'https?://') as has_url, {_CAPS} as is_caps from s""",
    "corrupt_texts": f"""with b as (select distinct document_id, block_id, text, array_to_string(list_transform(string_split(text, chr(10)), lambda x: case when regexp_matches(x, '^\\s*(?:\\p{{L}} ){{4,}}\\p{{L}}\\s*$') then replace(x, ' ', '') else x end), chr(10)) as tight from blocks)
        select document_id, count(*) as blocks, count_if(length(text) > 0 and (length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\p{{P}}\\p{{S}} ]', '', 'g')) < 0.7 * length(text) or contains(text, '(cid:') or contains(text, chr(65533)))) as corrupt,
            count_if(tight <> text) as letter_spaced, count_if({_CAPS}) as capitals from b group by document_id""",
    "keyword_lines": _LINES + """, k as (select doc_id, line_no, regexp_extract(line, '^(?:Keywords|Key words|Index terms)\\s*:\\s*(.*)$', 1) as line from kept),
        p as (select doc_id, line_no, list_filter(list_transform(case when contains(line, ';') then string_split(line, ';') when length(regexp_replace(line, '[^,]', '', 'g')) >= 2 then string_split(line, ',') else [line] end, lambda x: trim(regexp_replace(x, '[•*·]', '', 'g'))), lambda x: length(x) > 0) as v from k where line <> '')
        select doc_id, line_no, unnest(range(len(v)))::int as position, unnest(v) as keyword from p""",
    "font_families": """with f as (select 'ABCDEF+' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || (['-Bold', '-Italic', '-BoldItalic', ''])[p_size % 4 + 1] as font from part),
        n as (select font, regexp_replace(regexp_replace(font, '^[A-Z]{6}\\+', ''), '-(?:BoldItalic|Bold|Italic|Regular|Medium|Light|Roman|Oblique)$', '') as family from f)
        select family, count(*) as n, count(distinct font) as fonts from n group by family""",
    "fuzzy_algebra": """with v as (select l_returnflag, l_quantity as q, l_discount * 10 as a, l_tax * 12.5 as b from lineitem)
        select l_returnflag, round(avg(least(a, b)), 6) as both, round(avg(a + b - a * b), 6) as either, round(avg(1 - a), 6) as negated, round(avg(greatest(1 - a, b)), 6) as implies,
            round(avg(a + b * (1 - a)), 6) as boosted, round(avg(a * (1 - b)), 6) as dampened, round(avg(greatest(0.0, least(1.0, (q - 10) / 30))), 6) as ramp from v group by l_returnflag""",
    "title_jaccard": f"""with m as (select distinct meta_id, document_id, title from extracted_metadata where title is not null), l as (select doc_id, {_FIRST} as line from documents),
        t as (select meta_id, {_TOKENS.format('title')} as a, {_TOKENS.format('line')} as b from m join l on document_id = doc_id)
        select meta_id, case when len(list_distinct(list_concat(a, b))) > 0 then round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) else 0.0 end as jaccard from t""",
    "text_evidence": """with l as (select doc_id, text, list_filter(string_split(text, chr(10)), lambda x: length(trim(regexp_replace(x, '[\\s\\x{00a0}]+', ' ', 'g'))) > 0) as v from documents where text is not null),
        r as (select doc_id, text, round(len(list_filter(v, lambda x: regexp_matches(x, '\\.{3,}'))) / greatest(len(v), 1), 6) as leader_dots, round(len(list_filter(v, lambda x: regexp_matches(x, '\\d\\s*$'))) / greatest(len(v), 1), 6) as line_end_numbers,
            round(len(list_filter(v, lambda x: regexp_matches(x, '^\\p{Lu}[\\p{L}''-]+, \\p{Lu}\\..*\\d{4}'))) / greatest(len(v), 1), 6) as entries from l)
        select doc_id, leader_dots, line_end_numbers, entries, round(0.6 * leader_dots + 0.4 * line_end_numbers, 6) as contents_like,
            len(regexp_extract_all(text, '\\(\\p{Lu}[\\p{L}''-]+ \\d{4}\\)')) as citations, len(regexp_extract_all(text, '\\[\\d{1,3}\\]')) as numbered_citations from r""",
}
