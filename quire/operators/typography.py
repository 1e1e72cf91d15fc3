"""Typography from spans: styles of blocks, the profile of a document's running text, headings, levels of style, titles.

A span is a word with its size, font, flags and colour, and its place in the block. All groups are a block's or aggregates of a
document; ties between equally frequent values go to the one that comes first in reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import font_family, is_caps, squeezed, word_count

PLACE = ["page_index", "block_index", "block_id", "pos"]
# Flags of a span.
ITALIC, BOLD = 2, 16
#: Spans that a profile needs; line heights that count; share of spans that makes a second family; darkness below which a colour is black.
LEAST_SPANS, LINE_HEIGHT, SECOND_SHARE, DARK = 20, (4.0, 50.0), 0.10, 80


def half_points(size: Column) -> Column:
    """A size to the half point, ties to the even half."""
    return F.bround(size * 2) / 2


def is_colored(color: Column) -> Column:
    """Whether one of the three channels is not dark."""
    return (F.shiftright(color, 16).bitwiseAND(255) >= DARK) | (F.shiftright(color, 8).bitwiseAND(255) >= DARK) | (color.bitwiseAND(255) >= DARK)


def read_spans(spans: DataFrame) -> DataFrame:
    """Spans of at least two characters and a size, with the size to the half point, `bold`, `italic`, `family` and `chars`."""
    kept = spans.filter((F.length(F.trim("text")) >= 2) & (F.col("size") > 0))
    return kept.withColumns({"size": half_points(F.col("size")), "bold": F.col("flags").bitwiseAND(BOLD) > 0, "italic": F.col("flags").bitwiseAND(ITALIC) > 0, "family": font_family(F.col("font")), "chars": F.length(F.trim("text"))})


def commonest(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """The value that weighs most in each group, the first of equals."""
    counts = df.groupBy(*keys, value).agg(F.sum(weight if weight is not None else F.lit(1)).alias("_n"), F.min(F.struct(*PLACE)).alias("_first"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(value))


def line_heights(spans: DataFrame) -> DataFrame:
    """The distances between the lines of each block, where they are plausible."""
    lines = spans.select("document_id", "block_id", "line_no", "line_y0").distinct()
    height = F.col("line_y0") - F.lag("line_y0").over(Window.partitionBy("document_id", "block_id").orderBy("line_no"))
    return lines.select("document_id", height.alias("height")).filter((F.col("height") > LINE_HEIGHT[0]) & (F.col("height") < LINE_HEIGHT[1]))


def _spread(df: DataFrame, value: str) -> DataFrame:
    """Median and median deviation of a value by document."""
    middle = df.groupBy("document_id").agg(F.median(value).alias("m"))
    return df.join(middle, "document_id").groupBy("document_id").agg(F.first("m").alias(value), F.median(F.abs(F.col(value) - F.col("m"))).alias(f"{value}_mad"))


def body_profile(spans: DataFrame) -> DataFrame:
    """The profile of a document's text: dominant size, font, family, colour and line height with their spreads, the second
    family with at least a tenth of the spans, and the shares of bold and italic spans. Documents with fewer than LEAST_SPANS spans have none."""
    s = read_spans(spans)
    base = s.groupBy("document_id").agg(
        F.count("*").alias("spans"), F.percentile("size", F.lit(0.1)).alias("size_p10"), F.percentile("size", F.lit(0.9)).alias("size_p90"),
        F.round(F.avg(F.col("bold").cast("int")), 3).alias("bold_ratio"), F.round(F.avg(F.col("italic").cast("int")), 3).alias("italic_ratio"),
    ).filter(F.col("spans") >= LEAST_SPANS)
    families = s.groupBy("document_id", "family").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first"))
    dominant = commonest(s, ["document_id"], "family")
    second = families.join(dominant.withColumnRenamed("family", "_top"), "document_id").join(base.select("document_id", "spans"), "document_id")
    second = second.filter((F.col("family") != F.col("_top")) & (F.col("n") >= SECOND_SHARE * F.col("spans"))).groupBy("document_id").agg(F.min_by("family", F.struct(-F.col("n"), F.col("first"))).alias("second_family"))
    out = base
    for part in (_spread(s, "size"), commonest(s, ["document_id"], "font"), dominant, commonest(s, ["document_id"], "color"), second, _spread(line_heights(spans), "height")):
        out = out.join(part, "document_id", "left")
    height = F.coalesce("height", 1.2 * F.col("size"))
    return out.withColumns({"colored": is_colored(F.col("color")), "height": F.round(height, 2), "height_mad": F.round(F.coalesce("height_mad", F.lit(0.0)), 2)})


def block_styles(spans: DataFrame) -> DataFrame:
    """Each block's text with its median size, and, weighted by characters, its font family, colour and shares of bold and italic."""
    s = read_spans(spans)
    keys = ["document_id", "page_index", "block_index", "block_id"]
    share = lambda c: F.round(F.sum(F.when(F.col(c), F.col("chars")).otherwise(0)) / F.sum("chars"), 6)
    base = s.groupBy(*keys).agg(F.first("block_text").alias("text"), F.median("size").alias("size"), share("bold").alias("bold_ratio"), share("italic").alias("italic_ratio"), F.sum("chars").alias("chars"))
    chars = F.col("chars")
    styles = base.join(commonest(s, keys, "family", chars), keys).join(commonest(s, keys, "color", chars), keys)
    return styles.withColumn("caps", is_caps(F.col("text")))


def heading_score(size: Column, bold: Column, italic: Column, caps: Column, family: Column, color: Column, text: Column, body_size: Column, body_family: Column, body_color: Column) -> Column:
    """How much a block looks like a heading, from 0 to 1: it stands out by size, weight, family or capitals, is short and no
    sentence, perhaps coloured, not merely italic. Huge letters are pictures."""
    # Weights of the signals.
    ratio, words = size / body_size, word_count(text)
    big = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ratio - 1.0) / 0.5)) * 0.9
    heavy = F.when(bold, F.when(ratio >= 1.05, 0.7 * 0.8).otherwise(0.7 * 0.3)).otherwise(0.0)
    other = F.when(family != body_family, 0.5).otherwise(0.0)
    shout = F.when(caps, 0.6 * 0.7).otherwise(0.0)
    stands_out = F.greatest(big, heavy, other, shout)
    short = F.when(words <= 12, 1.0).otherwise(F.greatest(F.lit(0.0), (20 - words) / 8))
    form = F.when(text.rlike(r"[.!?]\s*$") & (words > 5), 0.0).otherwise(short)
    colored = F.when((color != body_color) & is_colored(color), 0.5).otherwise(0.0)
    slanted = F.when(italic & ~bold, -0.2).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), stands_out * form + colored + slanted))
    picture = (ratio > 15.0) | ((ratio > 10.0) & (words <= 6))
    return F.when(picture | (stands_out < 0.15), 0.0).otherwise(score)


def scored_blocks(styles: DataFrame, profiles: DataFrame) -> DataFrame:
    """`styles` with `ratio` to the document's size and the heading `score`; blocks of documents without a profile are left out."""
    body = profiles.select("document_id", F.col("size").alias("body_size"), F.col("family").alias("body_family"), F.col("color").alias("body_color"))
    c = F.col
    score = heading_score(c("size"), c("bold_ratio") > 0.5, c("italic_ratio") > 0.5, c("caps"), c("family"), c("color"), c("text"), c("body_size"), c("body_family"), c("body_color"))
    return styles.join(body, "document_id").withColumns({"ratio": c("size") / c("body_size"), "score": F.round(score, 6)})


def style_levels(scored: DataFrame, least: float = 0.35) -> DataFrame:
    """The levels of the distinct styles (size, bold, italic, capitals) of a document's headings: larger ones first, bold before
    plain, upright before italic, then as they come."""
    heads = scored.filter(F.col("score") >= least).withColumns({"size": half_points(F.col("size")), "bold": F.col("bold_ratio") > 0.5, "italic": F.col("italic_ratio") > 0.5})
    styles = heads.groupBy("document_id", "size", "bold", "italic", "caps").agg(F.count("*").alias("n"), F.min(F.struct("page_index", "block_index", "block_id")).alias("first"))
    order = Window.partitionBy("document_id").orderBy(F.desc("size"), F.desc("bold"), "italic", "first")
    return styles.withColumn("level", F.row_number().over(order)).drop("first")


#: A line of a contents list; a line that is no title.
CONTENTS_LINE, NO_TITLE = r"\.{3,}\s*\d+\s*$", r"(?i)^\s*(?:\d+|\p{L}+\s+\d+|(?:fig|abb|table|tabelle)\.?\s*\d.*|isbn.*|issn.*|doi.*)\s*$"


def title_score(scored: DataFrame, profiles: DataFrame) -> DataFrame:
    """Blocks that may be the title, with `title_score`: the size against the page's largest, a little more for bold, another
    family or colour, a little less for italic."""
    c = F.col
    words = word_count(c("text"))
    picture = (c("ratio") > 15.0) | ((c("ratio") > 10.0) & (words <= 6))
    page = scored.filter(~picture).groupBy("document_id", "page_index").agg(F.max("ratio").alias("page_ratio"))
    rows = scored.join(page, ["document_id", "page_index"])
    fit = (F.length("text") >= 4) & (words <= 30) & ~picture & (c("ratio") >= 0.5 * c("page_ratio")) & ~c("text").rlike(NO_TITLE) & ~c("text").rlike(CONTENTS_LINE)
    # The boosts.
    score = F.least(F.lit(1.0), c("ratio") / F.greatest(F.lit(1.0), c("page_ratio")))
    for when, more in ((c("bold_ratio") > 0.5, 0.08), (c("family") != c("body_family"), 0.05), ((c("color") != c("body_color")) & is_colored(c("color")), 0.04)):
        score = F.when(when, F.least(F.lit(1.0), score + more)).otherwise(score)
    score = F.when(c("italic_ratio") > 0.5, F.greatest(F.lit(0.0), score - 0.05)).otherwise(score)
    return rows.filter(fit).withColumn("title_score", F.round(score, 6))


def best_title(scored: DataFrame, pages: int = 3) -> DataFrame:
    """The likeliest title of each document on its first pages; the earlier block of equals."""
    near = scored.filter((F.col("page_index") < pages) & (F.col("title_score") > 0))
    best = near.groupBy("document_id").agg(F.min_by(F.struct("text", "page_index", "title_score"), F.struct(-F.col("title_score"), "page_index", "block_index", "block_id")).alias("b"))
    return best.select("document_id", F.col("b.text").alias("title"), F.col("b.page_index").alias("page_index"), F.col("b.title_score").alias("title_score"))


def body_candidates(blocks: DataFrame, body: DataFrame, least_lines: int = 3, least_width: float = 0.55, slack: float = 5.0) -> DataFrame:
    """Text blocks of several lines, wide enough, inside the document's body region."""
    b = body.select("document_id", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"))
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.length(squeezed(x)) > 0))
    inside = (F.col("x0") >= F.col("bx0") - slack) & (F.col("x1") <= F.col("bx1") + slack)
    return blocks.join(b, "document_id").filter((lines >= least_lines) & (F.col("x1") - F.col("x0") >= least_width * (F.col("bx1") - F.col("bx0"))) & inside)
