"""Queries of the layout operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.text import CHAPTER, heading_kind
from quire.operators import layout as L
from quire.operators import zones as Z
from quire.sources.tables import table

from .text import _BARE, _CHAPTER_OK
from .zones import _ZONES


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return L.text_blocks(table(spark, d, "blocks"))


def image_free_blocks(spark: SparkSession, d: str) -> DataFrame:
    return L.image_free(table(spark, d, "blocks")).groupBy("document_id").agg(F.count("*").alias("n"))


def page_regions(spark: SparkSession, d: str) -> DataFrame:
    return L.region(_blocks(spark, d), L.PAGE)


def document_regions(spark: SparkSession, d: str) -> DataFrame:
    return L.region(L.region(_blocks(spark, d), L.PAGE, digits=9).filter("x0 is not null").drop("n"), ["document_id"], digits=6)


def margins(spark: SparkSession, d: str) -> DataFrame:
    return L.margin_zones(_blocks(spark, d), document_regions(spark, d))


def page_bands(spark: SparkSession, d: str) -> DataFrame:
    return L.bands(_blocks(spark, d))


def furniture_candidates(spark: SparkSession, d: str) -> DataFrame:
    return L.furniture_candidates(L.bands(_blocks(spark, d)))


def furniture_profile(spark: SparkSession, d: str) -> DataFrame:
    return L.furniture_bands(furniture_candidates(spark, d))


def furniture_pages(spark: SparkSession, d: str) -> DataFrame:
    found = furniture_candidates(spark, d)
    return L.furniture_match(found, L.furniture_bands(found))


def repeated_texts(spark: SparkSession, d: str) -> DataFrame:
    return L.repeated_texts(_blocks(spark, d))


def left_edge_peaks(spark: SparkSession, d: str) -> DataFrame:
    return L.histogram_peaks(_blocks(spark, d), "x0")


def document_columns(spark: SparkSession, d: str) -> DataFrame:
    return L.columns(_blocks(spark, d))


def columns_of_pages(spark: SparkSession, d: str) -> DataFrame:
    blocks = _blocks(spark, d)
    return L.page_columns(blocks, L.columns(blocks))


def page_matches(spark: SparkSession, d: str) -> DataFrame:
    return L.page_match(furniture_pages(spark, d), columns_of_pages(spark, d))


def block_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return L.neighbours(_blocks(spark, d))


def covered_widths(spark: SparkSession, d: str) -> DataFrame:
    return L.merged_ranges(_blocks(spark, d))


def section_tree(spark: SparkSession, d: str) -> DataFrame:
    return L.sections(_blocks(spark, d))


def page_selection(spark: SparkSession, d: str) -> DataFrame:
    """Pages with at least four blocks, those of the middle third among them, and odd ones."""
    pages = _blocks(spark, d).groupBy(*L.PAGE).agg(F.count("*").alias("blocks"))
    sizes = pages.groupBy("document_id").agg((F.max("page_index") + 1).alias("pages"))
    middle = (F.col("pages") <= 6) | ((F.col("page_index") >= F.floor(F.col("pages") / 3)) & (F.col("page_index") < F.floor(2 * F.col("pages") / 3)))
    joined = pages.join(sizes, "document_id")
    return joined.groupBy("document_id").agg(F.count("*").alias("pages"), F.count_if(F.col("blocks") >= 4).alias("dense"), F.count_if(middle).alias("middle"), F.count_if((F.col("page_index") + 1) % 2 == 1).alias("odd"))


def document_classes(spark: SparkSession, d: str) -> DataFrame:
    blocks = _blocks(spark, d)
    line = F.get(F.split("text", "\n"), F.lit(0))
    kinds = blocks.select("document_id", heading_kind(line).alias("kind")).filter("kind is not null")
    marks = kinds.groupBy("document_id").agg(F.bool_or(F.col("kind") == "toc").alias("contents"), F.countDistinct(F.when(F.col("kind").isin("references", "appendix"), F.col("kind"))).alias("backmatter"))
    depth = L.sections(blocks).groupBy("document_id").agg(F.max("level").alias("depth"))
    lanes = L.columns(blocks).groupBy("document_id").agg(F.count("*").alias("lanes"))
    pages = blocks.groupBy("document_id").agg((F.max("page_index") + 1).alias("pages"))
    front = Z.document_zones(blocks).select("document_id", F.col("body_start").alias("front"))
    all_ = pages.join(front, "document_id").join(marks, "document_id", "left").join(depth, "document_id", "left").join(lanes, "document_id", "left").fillna({"backmatter": 0, "depth": 0, "lanes": 0, "contents": False})
    kind, confidence = L.document_class(F.col("pages"), F.col("lanes"), F.col("depth"), F.col("contents"), F.col("backmatter"), F.col("front"))
    return all_.select("document_id", kind.alias("kind"), confidence.alias("confidence"))


QUERIES = {f.__name__: f for f in (image_free_blocks, page_regions, document_regions, margins, page_bands, furniture_candidates, furniture_profile, furniture_pages, repeated_texts, left_edge_peaks, document_columns, columns_of_pages, page_matches, block_neighbours, covered_widths, section_tree, page_selection, document_classes)}

_SQ = "trim(regexp_replace({0}, '[\\s\\x{{00a0}}]+', ' ', 'g'))"
_B = "b as (select distinct * from blocks where block_type = 0 and length(" + _SQ.format("text") + ") > 0)"
_BOX = "case when {p}x1 > {p}x0 and {p}y1 > {p}y0 then {p}{c} end as {c}"


def _region(name: str, frm: str, keys: str, digits: int = 4) -> str:
    q = ", ".join(f"round(quantile_cont({c}, {p}), {digits}) as {c}" for c, p in (("x0", 0.15), ("y0", 0.15), ("x1", 0.85), ("y1", 0.85)))
    box = ", ".join(_BOX.format(p="", c=c) for c in ("x0", "y0", "x1", "y1"))
    return f"{name}_raw as (select {keys}, {q}, count(*) as n from {frm} group by {keys}), {name} as (select {keys}, {box}, n from {name}_raw)"


_REGIONS = f"with {_B}, {_region('pages', 'b', 'document_id, page_index')}, {_region('fine', 'b', 'document_id, page_index', 9)}, usable as (select document_id, x0, y0, x1, y1 from fine where x0 is not null), {_region('docs', 'usable', 'document_id', 6)}"


def _islands(name: str, frm: str, keys: str, start: str, end: str, gap: str) -> str:
    return f"""{name}_r as (select *, max({end}) over (partition by {keys} order by {start}, {end} rows between unbounded preceding and 1 preceding) as reach from {frm}),
        {name} as (select * exclude (reach), sum(case when {start} > reach + {gap} then 1 else 0 end) over (partition by {keys} order by {start}, {end} rows between unbounded preceding and current row)::int as island from {name}_r)"""


_BANDS = f"""with {_B}, {_islands('runs', '(select document_id, page_index, y0, y1 from b)', 'document_id, page_index', 'y0', 'y1', '6.4')},
    bands as (select document_id, page_index, island as band, min(y0) as y0, max(y1) as y1, count(*) as blocks from runs group by all)"""
_CANDIDATES = _BANDS + """, m as (select *, count(*) over (partition by document_id, page_index) as n from bands),
    c as (select document_id, page_index, case when band = 0 then 'top' when band = n - 1 and n >= 2 then 'bottom' end as side, y0, y1 from m where band = 0 or (band = n - 1 and n >= 2))"""
_PROFILE = _CANDIDATES + """, r as (select *, unnest(['all', case when (page_index + 1) % 2 = 1 then 'odd' else 'even' end]) as parity from c),
    mid as (select document_id, side, parity, median(y0) as m0, median(y1) as m1, count(*) as eligible from r group by all),
    o as (select *, abs(y0 - m0) as d0, abs(y1 - m1) as d1 from r join mid using (document_id, side, parity)),
    s as (select document_id, side, parity, median(d0) as mad0, median(d1) as mad1 from o group by all),
    near as (select * from o join s using (document_id, side, parity) where d0 <= greatest(2 * mad0, 4.0) and d1 <= greatest(2 * mad1, 4.0)),
    p0 as (select document_id, side, parity, round(quantile_cont(y0, 0.2), 4) as y0, round(quantile_cont(y1, 0.8), 4) as y1, count(*) as pages_present, max(eligible) as eligible from near group by all),
    p as (select *, round(pages_present / eligible, 6) as coverage from p0 where (eligible < 4 or pages_present >= 2) and y1 - y0 <= 48)"""
_FURNITURE = _PROFILE + """, q as (select c.*, case when (page_index + 1) % 2 = 1 then 'odd' else 'even' end as ap from c),
    j as (select q.*, coalesce(a.y0, w.y0) as e0, coalesce(a.y1, w.y1) as e1, coalesce(a.coverage, w.coverage) as cov from q
        left join p w on w.document_id = q.document_id and w.side = q.side and w.parity = 'all' left join p a on a.document_id = q.document_id and a.side = q.side and a.parity = q.ap),
    k as (select *, coalesce(abs(y0 - e0) <= 9.6 and abs(y1 - e1) <= 9.6, false) as near, coalesce(cov >= 0.5, false) as expected from j),
    f as (select document_id, page_index, bool_or(near and side = 'top') as header, bool_or(near and side = 'bottom') as footer, sum(case when expected and not near then 0.5 else 0.0 end)::double as deviation from k group by all)"""


def _peaks(frm: str) -> str:
    return f"""bins as (select document_id, floor(x0 / 10)::bigint as bin, count(*) as n from {frm} group by all), tops as (select document_id, max(n) as top from bins group by all),
        act as (select * from bins join tops using (document_id) where n >= 0.15 * top), {_islands('pk', 'act', 'document_id', 'bin', 'bin', '1')},
        peaks as (select document_id, island as peak, min(bin) * 10.0 as low, (max(bin) + 1) * 10.0 as high, sum(n)::bigint as n from pk group by all)"""


_COLUMNS = f"""u as (select * from b where x1 - x0 >= 120 and x1 - x0 <= 510), {_peaks('u')}, np as (select document_id, count(distinct page_index) as pages from u group by all),
    lanes as (select document_id, peak, round(median(x0), 4) as x0, round(median(x1), 4) as x1, count(*) as blocks, count(distinct page_index) as on_pages, max(pages) as pages
        from (select u.*, peak, pages from u join peaks using (document_id) join np using (document_id) where x0 >= low and x0 < high) group by document_id, peak having count(distinct page_index) >= 0.15 * max(pages))"""
_PAGE_COLUMNS = """m as (select b.document_id, b.page_index, b.block_id, l.peak from b left join lanes l on l.document_id = b.document_id and abs(l.x0 - b.x0) <= 24
        and least(b.x1 - b.x0, l.x1 - l.x0) > 0 and greatest(0.0, least(b.x1, l.x1) - greatest(b.x0, l.x0)) / least(b.x1 - b.x0, l.x1 - l.x0) >= 0.5 where b.document_id in (select document_id from lanes)),
    pc as (select document_id, page_index, count(distinct peak)::int as columns, round(count(distinct case when peak is not null then block_id end) / count(distinct block_id), 6) as in_columns from m group by all)"""
_LINE = "string_split(text, chr(10))[1]"
_HEADS = f"""hl as (select *, {_LINE} as line from b), hn as (select document_id, page_index, block_index, block_id, regexp_replace(regexp_extract(line, '{CHAPTER}', 1), '\\.0$', '') as number from hl where {_CHAPTER_OK}),
    hv as (select *, len(string_split(number, '.'))::int as level from hn), heads as (select *, row_number() over (partition by document_id order by page_index, block_index, block_id) as position from hv where level <= 4)"""
_KIND = "case " + " ".join(f"when {_BARE} in ({', '.join(repr(w) for w in words.split())}) then '{kind}'" for kind, words in T.HEADINGS.items()) + " end"

ORACLE = {
    "image_free_blocks": f"""with {_B}, i as (select distinct * from blocks where block_type = 1), hit as (select distinct b.block_id from b join i using (document_id, page_index)
        where greatest(0.0, least(b.x1, i.x1) - greatest(b.x0, i.x0)) * greatest(0.0, least(b.y1, i.y1) - greatest(b.y0, i.y0)) >= 0.5 * (b.x1 - b.x0) * (b.y1 - b.y0))
        select document_id, count(*) as n from b where block_id not in (select block_id from hit) group by document_id""",
    "page_regions": _REGIONS + " select document_id, page_index, x0, y0, x1, y1, n from pages",
    "document_regions": _REGIONS + " select document_id, x0, y0, x1, y1, n from docs",
    "margins": _REGIONS + """, np as (select document_id, count(distinct page_index) as pages from b group by all),
        s as (select b.*, case when b.x1 <= d.x0 then 'left' when b.x0 >= d.x1 then 'right' end as side from b join docs d using (document_id) where b.x1 - b.x0 <= 132)
        select document_id, side, round(quantile_cont(x0, 0.1), 4) as x0, round(quantile_cont(x1, 0.9), 4) as x1, count(distinct page_index) as on_pages, max(pages) as pages
        from s join np using (document_id) where side is not null group by document_id, side having count(distinct page_index) >= 0.1 * max(pages)""",
    "page_bands": _BANDS + " select * from bands",
    "furniture_candidates": _CANDIDATES + " select * from c",
    "furniture_profile": _PROFILE + " select * from p",
    "furniture_pages": _FURNITURE + " select * from f",
    "repeated_texts": f"""with {_B}, n as (select document_id, count(distinct page_index) as pages from b group by all), t as (select document_id, page_index, lower({_SQ.format('text')}) as t from b),
        o as (select document_id, t, count(distinct page_index) as on_pages from t where length(t) >= 3 and len(string_split(t, ' ')) <= 8 group by all)
        select document_id, t as text, on_pages, pages from o join n using (document_id) where on_pages >= greatest(3, floor(0.12 * least(60, pages)))""",
    "left_edge_peaks": f"with {_B}, {_peaks('b')} select * from peaks",
    "document_columns": f"with {_B}, {_COLUMNS} select document_id, peak, x0, x1, blocks, on_pages, pages from lanes",
    "columns_of_pages": f"with {_B}, {_COLUMNS}, {_PAGE_COLUMNS} select * from pc",
    "page_matches": _FURNITURE + f", {_COLUMNS}, {_PAGE_COLUMNS.replace('m as (select b.', 'mm as (select b.').replace('from m group', 'from mm group')} select document_id, page_index, round(least(1.0, 0.3 * (1 - coalesce(deviation, 0)) + 0.7 * in_columns), 6) as match from pc left join f using (document_id, page_index)",
    "block_neighbours": f"""with {_B} select block_id, document_id, page_index, round(y0 - lag(y1) over o, 4) as before, round(lead(y0) over o - y1, 4) as after, (y1 - y0) = max(y1 - y0) over p as tallest,
        round(percent_rank() over (partition by document_id, page_index order by y1 - y0), 6) as height_rank from b window o as (partition by document_id, page_index order by block_index, block_id), p as (partition by document_id, page_index)""",
    "covered_widths": f"""with {_B}, {_islands('runs', '(select document_id, page_index, x0, x1 from b)', 'document_id, page_index', 'x0', 'x1', '0.0')}, g as (select document_id, page_index, island, min(x0) as x0, max(x1) as x1 from runs group by all)
        select document_id, page_index, count(*) as ranges, round(sum(x1 - x0) / 600, 6) as coverage from g group by all""",
    "section_tree": f"""with {_B}, {_HEADS} select document_id, block_id, number, level, position::int as position,
        (select arg_max(p.block_id, p.position) from heads p where p.document_id = h.document_id and p.position < h.position and p.level < h.level) as parent, lead(block_id) over (partition by document_id order by position) as next from heads h""",
    "page_selection": f"""with {_B}, g as (select document_id, page_index, count(*) as blocks from b group by all), s as (select document_id, max(page_index) + 1 as n from g group by all)
        select document_id, count(*) as pages, count_if(blocks >= 4) as dense, count_if(n <= 6 or (page_index >= floor(n / 3) and page_index < floor(2 * n / 3))) as middle, count_if((page_index + 1) % 2 = 1) as odd from g join s using (document_id) group by document_id""",
    "document_classes": f"""with {_B}, {_HEADS}, {_COLUMNS}, hk as (select document_id, {_KIND} as kind from hl), mk as (select document_id, bool_or(kind = 'toc') as contents, count(distinct case when kind in ('references', 'appendix') then kind end) as backmatter from hk where kind is not null group by all),
        dp as (select document_id, max(level) as depth from heads group by all), ln as (select document_id, count(*) as lanes from lanes group by all), pg as (select document_id, max(page_index) + 1 as pages from b group by all),
        zn as (select document_id as zd, body_start as f from ({_ZONES} select * from zones)), a as (select document_id, pages, f, coalesce(contents, false) as t, coalesce(backmatter, 0) as k, coalesce(depth, 0) as e, coalesce(lanes, 0) as c from pg left join mk using (document_id) left join dp using (document_id) left join ln using (document_id) join zn on zd = document_id),
        v as (select document_id,
            (case when pages <= 25 then 3.0 when pages <= 50 then 1.5 else 0 end) + (case when c = 2 then 1 else 0 end) + (case e when 0 then 1.0 when 1 then 0.5 else 0 end) + (case when f = 0 then 1.5 when f <= 3 then 0.5 else 0 end) as article,
            (case when pages > 120 then 3.0 else 0 end) + (case when e > 2 then 2.0 else 0 end) + (case when t then 1.5 else 0 end) + (case when k >= 2 then 1.5 else 0 end) + (case when f > 8 then 2.0 else 0 end) as book,
            (case when pages <= 25 then 0 when pages <= 50 then 1.0 when pages <= 120 then 2.0 else 0 end) + (case e when 0 then 0 when 1 then 0.5 when 2 then 1.0 else 0 end) + (case when t then 0.5 else 0 end) + (case when k = 1 then 0.5 else 0 end) + (case when f = 0 then 0 when f <= 3 then 0.5 when f <= 8 then 1.5 else 0 end) as report,
            (case when pages <= 50 then 0 when pages <= 120 then 1.5 else 1.0 end) + (case when e < 2 then 0 when e = 2 then 0.5 else 1.0 end) + (case when t then 1.0 else 0 end) + (case when f <= 3 then 0 when f <= 8 then 1.0 else 1.5 end) as collection from a),
        w as (select *, greatest(article, book, report, collection) as top, article + book + report + collection as total from v)
        select document_id, case when article = top then 'article' when book = top then 'book' when report = top then 'report' else 'collection' end as kind, greatest(0.4, least(0.95, round(top / total, 2)))::double as confidence from w""",
}
