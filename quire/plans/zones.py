"""Queries of the operators on a document's parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import layout as L
from quire.operators import zones as Z
from quire.sources.tables import table

from .text import _CAPS, _SQUEEZED, _TOKENS, _words


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return L.text_blocks(table(spark, d, "blocks"))


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the documents parted at empty lines."""
    return table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", r"\n\s*\n")).alias("position", "text"))


def body_starts(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("block_id", Z.body_start(F.col("text")).alias("score")).filter("score > 0")


def document_zones(spark: SparkSession, d: str) -> DataFrame:
    return Z.document_zones(_blocks(spark, d))


def zone_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Blocks and characters of each zone of each document."""
    blocks = _blocks(spark, d)
    return Z.zones_of_blocks(blocks, Z.document_zones(blocks)).groupBy("document_id", "zone").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


def abstracts(spark: SparkSession, d: str) -> DataFrame:
    return Z.abstracts(_paragraphs(spark, d), ["position"])


def explicit_keywords(spark: SparkSession, d: str) -> DataFrame:
    found = Z.explicit_keywords(_paragraphs(spark, d), ["position"])
    return found.select("document_id", F.posexplode("keywords").alias("position", "keyword"))


def region_assembly(spark: SparkSession, d: str) -> DataFrame:
    return Z.regions(_paragraphs(spark, d), ["position"])


def person_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The names on the first pages of each document."""
    short = _blocks(spark, d).filter("page_index < 2").filter(X.word_count(F.col("text")) <= 20).filter(Z.is_person_block(F.col("text")))
    return short.select("block_id", F.posexplode(Z.persons(F.col("text"))).alias("position", "name"))


def author_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """The extracted authors of each document against those that its own first lines name."""
    meta = table(spark, d, "extracted_metadata", "meta_id", "document_id", "authors").distinct()
    lines = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.slice(F.filter(F.split("text", "\n"), lambda x: F.length(X.squeezed(x)) > 0), 1, 3).alias("lines"))
    named = lines.select("doc_id", F.flatten(F.transform(F.filter("lines", lambda x: (X.word_count(x) <= 20) & Z.is_person_block(x)), Z.persons)).alias("second"))
    both = meta.join(named, meta.document_id == named.doc_id, "left").select("meta_id", F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda x: F.length(F.trim(x)) > 0).alias("first"), F.coalesce("second", F.array().cast("array<string>")).alias("second"))
    alike = lambda a: F.size(F.filter("second", lambda b: X.jaccard(X.token_set(a), X.token_set(b)) >= 0.6))
    matches = F.aggregate("first", F.lit(0), lambda n, a: n + alike(a))
    authors, sure = Z.reconciled_authors(F.col("first"), F.col("second"), matches)
    return both.select("meta_id", F.array_join(authors, "; ").alias("authors"), sure.alias("confidence"))


QUERIES = {f.__name__: f for f in (body_starts, document_zones, zone_sizes, abstracts, explicit_keywords, region_assembly, person_blocks, author_reconciliation)}

_Q = Z.NUMBERED.replace("'", "''"), Z.NOTE.replace("'", "''")


def _kind(line: str) -> str:
    bare = f"lower(trim(regexp_replace({line}, '^\\s*(?:\\d+(?:\\.\\d+)*\\.?\\s+)?|\\s*[:.]?\\s*$', '', 'g')))"
    return "case " + " ".join(f"when {bare} in ({', '.join(repr(w) for w in words.split())}) then '{kind}'" for kind, words in X.HEADINGS.items()) + " end"


def _in(kinds: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{k}'" for k in kinds) + ")"


_BLOCKS = f"""with b as (select distinct document_id, page_index, block_index, block_id, text from blocks where block_type = 0 and length({_SQUEEZED.format('text')}) > 0),
    l0 as (select *, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_SQUEEZED.format('x')}), lambda x: length(x) > 0) as v from b),
    l1 as (select *, v[1] as first, {_kind('v[1]')} as kind from l0),
    l as (select *, case when regexp_matches(first, '{_Q[0]}') then case when (len(v) > 1 and len(list_filter(v, lambda x: regexp_matches(x, '^\\d'))) >= 0.5 * len(v)) or (len(v) <= 3 and regexp_matches(coalesce(array_to_string(v[2:], ' '), ''), '{_Q[1]}')) then 0.0 else 1.0 end
        when kind in {_in(Z.BODY)} then 0.9 else 0.0 end::double as start from l1)"""
_ZONES = f"""{_BLOCKS}, p0 as (select document_id, page_index, bool_or(coalesce(kind in {_in(Z.FRONT)}, false)) and page_index < 30 as front, bool_or(coalesce(kind in {_in(Z.BACK)}, false)) as back, max(start) as start from l group by document_id, page_index),
    f as (select document_id, (max(page_index) + 1)::int as pages, min(page_index) filter (page_index < 30 and not front and start >= 0.85) as fp, arg_min(start, page_index) filter (page_index < 30 and not front and start >= 0.85) as fs from p0 group by document_id),
    lf as (select document_id, max(page_index) as lastf from p0 join f using (document_id) where front and (fp is null or page_index < fp) group by document_id),
    z0 as (select document_id, pages, fp, fs, lastf, fp is not null and lastf is not null and fp > lastf + 4 as late from f left join lf using (document_id)),
    z1 as (select document_id, pages, case when late then lastf + 1 when fp is not null then fp else coalesce(lastf + 1, 0) end::int as body_start, case when late then 'after_front' when fs = 1.0 then 'numbered' when fp is not null then 'heading' else 'fallback' end as signal,
        case when late then 0.6 when fp is not null then fs when lastf is not null then 0.5 else 0.3 end::double as confidence from z0),
    bk as (select z1.document_id, max(page_index) as back_start from z1 join p0 using (document_id) where back and page_index >= body_start + greatest(3, floor(pages * 0.10)) group by z1.document_id),
    zones as (select z1.*, back_start from z1 left join bk using (document_id))"""
_SEG = "with s as (select doc_id as document_id, unnest(range(len(regexp_split_to_array(text, '\\n\\s*\\n'))))::int as position, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) as text from documents)"
_KW = "list_filter(list_transform(case when contains({0}, ';') then string_split({0}, ';') when length(regexp_replace({0}, '[^,]', '', 'g')) >= 2 then string_split({0}, ',') else [{0}] end, lambda x: trim(regexp_replace(x, '[•*·]', '', 'g'))), lambda x: length(x) > 0)"


def _caps(column: str) -> str:
    return _CAPS.replace("text", column)


def _person(x: str) -> str:
    s = _SQUEEZED.format(x)
    q = {k: v.replace("'", "''") for k, v in {"no": Z.NO_NAME, "by": Z.BY, "inst": Z.INSTITUTION, "name": Z.NAME, "deg": Z.DEGREE}.items()}
    m = lambda pattern: f"regexp_matches({x}, '{pattern}')"
    w = f"({_words(x)})"
    never = f"length({x}) < 3 or {m(q['no'])} or {m('[\\p{L}\\p{N}_]+' + chr(39) * 2 + 's\\s+[\\p{L}\\p{N}_]+')} or {m('\\s[–—-]\\s')} or {m('(?i)\\band/or\\b')} or ({w} > 1 and regexp_matches(string_split({s}, ' ')[-1], '^\\p{{Ll}}'))"
    unlike = f"{m(q['inst'])} or ({m('\\.\\s*$')} and not {m('\\b\\p{Lu}\\.(?:\\p{Lu}\\.?)?\\s*$')}) or {m('^\\s*\\d')}"
    named = f"{m(q['name'])} and {w} <= 8 and ({m('(?i)\\b(?:and|und)\\b')} or ({w} <= 4 and not ({w} = 1 and length(trim({x})) > 12)))"
    return f"case when {never} then false when {m(q['by'])} then true when {m(q['deg'])} and not {m(q['inst'])} then true when {unlike} then false else {named} end"


def _persons(x: str) -> str:
    parts = f"regexp_split_to_array(regexp_replace({x}, '{Z.BY}', ''), '(?i)\\s+(?:and|und|&)\\s+|;\\s*')"
    clean = f"list_transform({parts}, lambda y: regexp_replace({_SQUEEZED.format('y')}, '^[.,;:—–\\s-]+|[.,;:—–\\s-]+$', '', 'g'))"
    return f"list_filter({clean}, lambda y: length(y) >= 3 and not regexp_matches(y, '\\d') and regexp_matches(y, '[A-Za-z\\x{{00c0}}-\\x{{024f}}]') and len(string_split(y, ' ')) <= 6)"


ORACLE = {
    "body_starts": _BLOCKS + " select block_id, start as score from l where start > 0",
    "document_zones": _ZONES + " select * from zones",
    "zone_sizes": _ZONES + " select document_id, case when page_index < body_start then 'front' when page_index >= back_start then 'back' else 'body' end as zone, count(*) as blocks, sum(length(text))::bigint as chars from b join zones using (document_id) group by all",
    "abstracts": f"""{_SEG}, n as (select *, lead(text) over (partition by document_id order by position) as following from s),
        m as (select *, {_SQUEEZED.format(f"regexp_replace(text, '{Z.ABSTRACT}', '')")} as rest from n where regexp_matches(text, '{Z.ABSTRACT}')),
        a as (select document_id, arg_min(case when length(rest) > 50 then rest else {_SQUEEZED.format('following')} end, position) as abstract from m group by document_id)
        select * from a where abstract is not null and abstract <> ''""",
    "explicit_keywords": f"""{_SEG}, n as (select *, {", ".join(f"lead(text, {k}) over (partition by document_id order by position) as n{k}" for k in (1, 2, 3))} from s),
        m as (select *, row_number() over (partition by document_id order by position) as k, {_SQUEEZED.format(f"regexp_replace(text, '{Z.KEYWORDS}', '')")} as own from n where regexp_matches(text, '{Z.KEYWORDS}')),
        c as (select *, coalesce({_caps('n1')}, false) as c1, coalesce({_caps('n2')}, false) as c2, coalesce({_caps('n3')}, false) as c3 from m where k = 1),
        o as (select document_id, coalesce(case when length(own) > 0 then own end, case when not c1 and length({_SQUEEZED.format('n1')}) > 0 then {_SQUEEZED.format('n1')} end, case when not (c1 or c2) and length({_SQUEEZED.format('n2')}) > 0 then {_SQUEEZED.format('n2')} end,
            case when not (c1 or c2 or c3) and length({_SQUEEZED.format('n3')}) > 0 then {_SQUEEZED.format('n3')} end) as line from c),
        w as (select document_id, {_KW.format('line')} as v from o where line is not null) select document_id, unnest(range(len(v)))::int as position, unnest(v) as keyword from w""",
    "region_assembly": f"""{_SEG}, f as (select document_id, position, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_SQUEEZED.format('x')}), lambda x: length(x) > 0)[1] as first from s),
        k as (select *, {_kind('first')} as kind from f), g as (select *, case when kind = 'toc' then 'contents' when kind in ('abstract', 'references', 'appendix') then kind when kind is not null or (regexp_matches(first, '{_Q[0]}') and ({_words('first')}) <= 12) then 'body' end as begins from k),
        n as (select document_id, position, coalesce(last_value(begins ignore nulls) over (partition by document_id order by position rows between unbounded preceding and current row), 'title_page') as kind from g),
        p as (select *, case when lag(kind) over (partition by document_id order by position) is not distinct from kind then 0 else 1 end as fresh from n),
        q as (select document_id, kind, (sum(fresh) over (partition by document_id order by position rows between unbounded preceding and current row))::int - 1 as part from p)
        select document_id, part as position, kind, count(*) as texts from q group by document_id, part, kind""",
    "person_blocks": f"""with b as (select distinct block_id, text from blocks where block_type = 0 and page_index < 2 and length({_SQUEEZED.format('text')}) > 0), w as (select block_id, {_persons('text')} as v from b where ({_words('text')}) <= 20 and {_person('text')})
        select block_id, unnest(range(len(v)))::int as position, unnest(v) as name from w""",
    "author_reconciliation": f"""with m as (select distinct meta_id, document_id, list_filter(coalesce(authors, []), lambda x: length(trim(x)) > 0) as first from extracted_metadata),
        d0 as (select doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: length({_SQUEEZED.format('x')}) > 0)[1:3]) as line, unnest(range(least(3, len(list_filter(string_split(text, chr(10)), lambda x: length({_SQUEEZED.format('x')}) > 0))))) as k from documents),
        d as (select doc_id, flatten(list({_persons('line')} order by k)) as second from d0 where ({_words('line')}) <= 20 and {_person('line')} group by doc_id),
        j as (select meta_id, first, coalesce(second, []) as second from m left join d on document_id = doc_id),
        p as (select meta_id, unnest(first) as a, second from j), q as (select meta_id, a, unnest(second) as b, 1 as one from p),
        t as (select meta_id, {_TOKENS.format('a')} as x, {_TOKENS.format('b')} as y from q),
        n as (select meta_id, count_if(len(list_distinct(list_concat(x, y))) > 0 and len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.6) as matches from t group by meta_id)
        select meta_id, array_to_string(case when len(first) = 0 then second else first end, '; ') as authors,
            round(case when len(first) = 0 and len(second) = 0 then 0.0 when len(second) = 0 then 0.7 when len(first) = 0 then 0.55 when coalesce(matches, 0) > 0 then least(0.92, 0.70 + 0.08 * matches) else 0.65 end, 6)::double as confidence from j left join n using (meta_id)""",
}
