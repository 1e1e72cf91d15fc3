"""Queries of the typographic operators, over spans made of the blocks' words by a rule, since the tables have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import squeezed
from quire.operators import layout as L
from quire.operators import typography as T
from quire.sources.tables import table

from .layout import document_regions
from .text import _CAPS, _SQUEEZED, _words

FONTS = ("ABCDEF+TimesNewRoman", "Helvetica-Bold", "TimesNewRoman-Italic")


def spans(spark: SparkSession, d: str) -> DataFrame:
    """A span for each word of each text block; size, font, flags and colour follow from the block's number and the word's place."""
    words = L.text_blocks(table(spark, d, "blocks")).withColumn("block_text", squeezed(F.col("text"))).select("document_id", "page_index", "block_index", "block_id", "y0", "block_text", F.posexplode(F.split("block_text", " ")).alias("pos", "text"))
    which = (F.col("block_index") + F.floor(F.col("pos") / 7)) % 3
    return words.select(
        "document_id", "page_index", "block_index", "block_id", "block_text", "pos", "text", F.when(F.col("block_index") % 5 == 0, 14.25).otherwise(10.25 + 0.5 * (F.col("pos") % 2)).alias("size"),
        F.element_at(F.array(*map(F.lit, FONTS)), (which + 1).cast("int")).alias("font"), F.when(which == 1, T.BOLD).when(which == 2, T.ITALIC).otherwise(0).alias("flags"),
        F.when(F.col("block_index") % 4 == 0, 3368652).otherwise(0).alias("color"), F.floor(F.col("pos") / 4).alias("line_no"), (F.col("y0") + 12 * F.floor(F.col("pos") / 4)).alias("line_y0"),
    )


def span_styles(spark: SparkSession, d: str) -> DataFrame:
    s = T.read_spans(spans(spark, d))
    return s.groupBy("document_id", "size", "family").agg(F.count("*").alias("n"), F.count_if("bold").alias("bold"), F.count_if("italic").alias("italic"), F.count_if(T.is_colored(F.col("color"))).alias("colored"), F.sum("chars").alias("chars"))


def body_profiles(spark: SparkSession, d: str) -> DataFrame:
    p = T.body_profile(spans(spark, d))
    return p.select("document_id", "spans", "size", "size_mad", *(F.round(c, 6).alias(c) for c in ("size_p10", "size_p90")), "font", "family", "second_family", "color", "colored", "bold_ratio", "italic_ratio", "height", "height_mad")


def block_styles(spark: SparkSession, d: str) -> DataFrame:
    return T.block_styles(spans(spark, d)).drop("text")


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = spans(spark, d)
    profiles = T.body_profile(s)
    return T.scored_blocks(T.block_styles(s), profiles), profiles


def heading_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[0].filter("score > 0").select("document_id", "block_id", "score")


def style_levels(spark: SparkSession, d: str) -> DataFrame:
    return T.style_levels(_scored(spark, d)[0])


def title_candidates(spark: SparkSession, d: str) -> DataFrame:
    return T.best_title(T.title_score(*_scored(spark, d)))


def body_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = T.body_candidates(L.text_blocks(table(spark, d, "blocks")), document_regions(spark, d))
    return found.groupBy("document_id").agg(F.count("*").alias("n"), F.min("block_id").alias("first"))


def color_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Each colour of a document with its rank by frequency, from 0."""
    counts = spans(spark, d).groupBy("document_id", "color").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.dense_rank().over(Window.partitionBy("document_id").orderBy(F.desc("n"))) - 1)


QUERIES = {f.__name__: f for f in (span_styles, body_profiles, block_styles, heading_scores, style_levels, title_candidates, body_candidates, color_ranks)}

_B = f"""b as (select distinct document_id, page_index, block_index, block_id, x0, y0, x1, text as raw, {_SQUEEZED.format('text')} as block_text from blocks where block_type = 0 and length({_SQUEEZED.format('text')}) > 0)"""
_SPANS = f"""with {_B}, w as (select *, unnest(string_split(block_text, ' ')) as text, unnest(range(len(string_split(block_text, ' '))))::int as pos from b),
    every as (select document_id, page_index, block_index, block_id, block_text, pos, text, case when block_index % 5 = 0 then 14.25 else 10.25 + 0.5 * (pos % 2) end::double as rawsize, ((block_index + pos // 7) % 3)::int as which,
        case when block_index % 4 = 0 then 3368652 else 0 end as color, pos // 4 as line_no, y0 + 12 * (pos // 4) as line_y0 from w),
    named as (select *, (['{FONTS[0]}', '{FONTS[1]}', '{FONTS[2]}'])[which + 1] as font from every),
    s as (select document_id, page_index, block_index, block_id, block_text, pos, round_even(rawsize * 2, 0) / 2 as size, font, which = 1 as bold, which = 2 as italic, color, length(text) as chars,
        (color >> 16) & 255 >= 80 or (color >> 8) & 255 >= 80 or color & 255 >= 80 as colored, regexp_replace(regexp_replace(font, '^[A-Z]{{6}}\\+', ''), '-(?:BoldItalic|Bold|Italic|Regular|Medium|Light|Roman|Oblique)$', '') as family from named where length(text) >= 2)"""


def _common(keys: str, value: str, weight: str = "1") -> str:
    return f"(select {keys}, arg_min({value}, (-n, first)) as {value} from (select {keys}, {value}, sum({weight}) as n, min((page_index, block_index, block_id, pos)) as first from s group by all) group by {keys})"


_PROFILE = f"""{_SPANS}, base as (select document_id, count(*) as spans, quantile_cont(size, 0.1) as size_p10, quantile_cont(size, 0.9) as size_p90, round(avg(bold::int), 3) as bold_ratio, round(avg(italic::int), 3) as italic_ratio, median(size) as size from s group by document_id having count(*) >= 20),
    mads as (select document_id, median(abs(s.size - base.size)) as size_mad from s join base using (document_id) group by document_id),
    fonts as {_common('document_id', 'font')}, families as {_common('document_id', 'family')}, colors as {_common('document_id', 'color')},
    fam as (select document_id, family, count(*) as n, min((page_index, block_index, block_id, pos)) as first from s group by all),
    second as (select fam.document_id, arg_min(fam.family, (-fam.n, fam.first)) as second_family from fam join families f on fam.document_id = f.document_id join base on base.document_id = fam.document_id where fam.family <> f.family and fam.n >= 0.10 * spans group by fam.document_id),
    lines as (select distinct document_id, block_id, line_no, line_y0 from named),
    h as (select document_id, height from (select document_id, line_y0 - lag(line_y0) over (partition by document_id, block_id order by line_no) as height from lines) where height > 4 and height < 50),
    hm as (select document_id, median(height) as height from h group by document_id), hd as (select document_id, median(abs(h.height - hm.height)) as height_mad from h join hm using (document_id) group by document_id),
    profile as (select base.*, size_mad, font, family, second_family, color, (color >> 16) & 255 >= 80 or (color >> 8) & 255 >= 80 or color & 255 >= 80 as colored, round(coalesce(height, 1.2 * size), 2) as height, round(coalesce(height_mad, 0.0), 2) as height_mad
        from base join mads using (document_id) left join fonts using (document_id) left join families using (document_id) left join colors using (document_id) left join second using (document_id) left join hm using (document_id) left join hd using (document_id))"""
_KEYS = "document_id, page_index, block_index, block_id"
_STYLES = f"""sb as (select {_KEYS}, first(block_text) as text, median(size) as size, round(sum(case when bold then chars else 0 end) / sum(chars), 6) as bold_ratio, round(sum(case when italic then chars else 0 end) / sum(chars), 6) as italic_ratio, sum(chars)::bigint as chars from s group by all),
    bf as {_common(_KEYS, 'family', 'chars')}, bc as {_common(_KEYS, 'color', 'chars')},
    styles as (select sb.*, bf.family, bc.color, {_CAPS} as caps from sb join bf using ({_KEYS}) join bc using ({_KEYS}))"""
_SCORED = f"""{_PROFILE}, {_STYLES}, r as (select styles.*, profile.size as body_size, profile.family as body_family, profile.color as body_color, styles.size / profile.size as ratio, {_words('text')} as words,
        (styles.color >> 16) & 255 >= 80 or (styles.color >> 8) & 255 >= 80 or styles.color & 255 >= 80 as is_col from styles join profile using (document_id)),
    t as (select *, greatest(least(1.0, greatest(0.0, (ratio - 1.0) / 0.5)) * 0.9, case when bold_ratio > 0.5 then case when ratio >= 1.05 then 0.7 * 0.8 else 0.7 * 0.3 end else 0.0 end, case when family <> body_family then 0.5 else 0.0 end, case when caps then 0.6 * 0.7 else 0.0 end)::double as typo,
        case when regexp_matches(text, '[.!?]\\s*$') and words > 5 then 0.0 when words <= 12 then 1.0 else greatest(0.0, (20 - words) / 8) end as form, (ratio > 15 or (ratio > 10 and words <= 6)) as picture from r),
    scored as (select *, case when picture or typo < 0.15 then 0.0 else round(greatest(0.0, least(1.0, typo * form + case when color <> body_color and is_col then 0.5 else 0.0 end + case when italic_ratio > 0.5 and not bold_ratio > 0.5 then -0.2 else 0.0 end)), 6) end as score from t)"""
_REGION = f"""p as (select document_id, page_index, round(quantile_cont(x0, 0.15), 9) as px0, round(quantile_cont(x1, 0.85), 9) as px1, round(quantile_cont(y0, 0.15), 9) as py0, round(quantile_cont(y1, 0.85), 9) as py1 from (select distinct * from blocks where block_type = 0 and length({_SQUEEZED.format('text')}) > 0) group by all),
    pr as (select document_id, px0, px1, py0, py1 from p where px1 > px0 and py1 > py0),
    rg as (select document_id, round(quantile_cont(px0, 0.15), 6) as bx0, round(quantile_cont(px1, 0.85), 6) as bx1, round(quantile_cont(py0, 0.15), 6) as by0, round(quantile_cont(py1, 0.85), 6) as by1 from pr group by document_id)"""

ORACLE = {
    "span_styles": _SPANS + " select document_id, size, family, count(*) as n, count_if(bold)::bigint as bold, count_if(italic)::bigint as italic, count_if(colored)::bigint as colored, sum(chars)::bigint as chars from s group by all",
    "body_profiles": _PROFILE + " select document_id, spans, size, size_mad, round(size_p10, 6) as size_p10, round(size_p90, 6) as size_p90, font, family, second_family, color, colored, bold_ratio, italic_ratio, height, height_mad from profile",
    "block_styles": f"{_SPANS}, {_STYLES} select * exclude (text) from styles",
    "heading_scores": _SCORED + " select document_id, block_id, score from scored where score > 0",
    "style_levels": _SCORED + """, k as (select document_id, round_even(size * 2, 0) / 2 as size, bold_ratio > 0.5 as bold, italic_ratio > 0.5 as italic, caps, count(*) as n, min((page_index, block_index, block_id)) as first from scored where score >= 0.35 group by all)
        select document_id, size, bold, italic, caps, n, row_number() over (partition by document_id order by size desc, bold desc, italic, first)::int as level from k""",
    "title_candidates": _SCORED + f""", pm as (select document_id, page_index, max(ratio) as page_ratio from scored where not picture group by all),
        c0 as (select *, least(1.0, ratio / greatest(1.0, page_ratio)) as s0 from scored join pm using (document_id, page_index) where length(text) >= 4 and words <= 30 and not picture and ratio >= 0.5 * page_ratio and not regexp_matches(text, '{T.NO_TITLE}') and not regexp_matches(text, '{T.CONTENTS_LINE}')),
        c1 as (select *, case when bold_ratio > 0.5 then least(1.0, s0 + 0.08) else s0 end as s1 from c0), c2 as (select *, case when family <> body_family then least(1.0, s1 + 0.05) else s1 end as s2 from c1),
        c3 as (select *, case when color <> body_color and is_col then least(1.0, s2 + 0.04) else s2 end as s3 from c2), c4 as (select *, round(case when italic_ratio > 0.5 then greatest(0.0, s3 - 0.05) else s3 end, 6) as title_score from c3)
        select document_id, arg_min(text, (-title_score, page_index, block_index, block_id)) as title, arg_min(page_index, (-title_score, page_index, block_index, block_id)) as page_index, max(title_score) as title_score from c4 where page_index < 3 and title_score > 0 group by document_id""",
    "body_candidates": f"""with {_B}, {_REGION} select b.document_id, count(*) as n, min(block_id) as first from b join rg using (document_id) where bx1 > bx0 and by1 > by0
        and len(list_filter(string_split(raw, chr(10)), lambda x: length({_SQUEEZED.format('x')}) > 0)) >= 3 and x1 - x0 >= 0.55 * (bx1 - bx0) and x0 >= bx0 - 5 and x1 <= bx1 + 5 group by b.document_id""",
    "color_ranks": _SPANS + ", c as (select document_id, color, count(*) as n from named group by all) select document_id, color, n, dense_rank() over (partition by document_id order by n desc)::int - 1 as rank from c",
}
