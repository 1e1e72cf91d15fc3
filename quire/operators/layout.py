"""Page layout from positioned blocks: regions, bands, columns, furniture and sections.

All windows are over the blocks of one page or the headings of one document; per document only aggregates are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import common_area, overlap_ratio
from quire.session import dropped, written
from quire.functions.text import chapter_level, chapter_number, squeezed, word_count

#: Size of a page where the blocks don't tell it.
WIDTH, HEIGHT = 600.0, 800.0
#: Gap that parts bands, largest height of a furniture band, tolerance of a furniture match: shares of the page's height.
BAND_GAP, BAND_MOST, BAND_NEAR = 0.008, 0.06, 0.012
PAGE = ["document_id", "page_index"]


def text_blocks(blocks: DataFrame) -> DataFrame:
    """The distinct blocks of text that isn't blank."""
    return blocks.distinct().filter((F.col("block_type") == 0) & (F.length(squeezed(F.col("text"))) > 0))


def image_free(blocks: DataFrame, most: float = 0.5) -> DataFrame:
    """The text blocks of which less than `most` lies under an image of the same page."""
    rows = blocks.distinct()
    box = F.struct("x0", "y0", "x1", "y1")
    images = rows.filter("block_type = 1").groupBy(*PAGE).agg(F.collect_list(box).alias("images"))
    joined = text_blocks(blocks).join(images, PAGE, "left")
    own = {c: F.col(c) for c in ("x0", "y0", "x1", "y1")}
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    covered = F.exists("images", lambda r: common_area(own, {c: r[c] for c in ("x0", "y0", "x1", "y1")}) >= most * area)
    return joined.filter(~F.coalesce(covered, F.lit(False))).drop("images")


def region(df: DataFrame, keys: list[str], low: float = 0.15, high: float = 0.85, digits: int = 4) -> DataFrame:
    """The box between the percentiles of the edges in each group; null where it is empty."""
    box = df.groupBy(*keys).agg(*(F.round(F.percentile(c, F.lit(q)), digits).alias(c) for c, q in (("x0", low), ("y0", low), ("x1", high), ("y1", high))), F.count("*").alias("n"))
    valid = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    return box.select(*keys, *(F.when(valid, F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")), "n")


def margin_zones(blocks: DataFrame, body: DataFrame, narrow: float = 0.22, least: float = 0.10) -> DataFrame:
    """The side zones of narrow blocks outside the document's body on at least `least` of its pages."""
    pages = blocks.groupBy("document_id").agg(F.countDistinct("page_index").alias("pages"))
    b = body.select("document_id", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"))
    side = F.when(F.col("x1") <= F.col("bx0"), "left").when(F.col("x0") >= F.col("bx1"), "right")
    out = blocks.join(b, "document_id").filter(F.col("x1") - F.col("x0") <= narrow * WIDTH).withColumn("side", side).filter("side is not null")
    zones = out.groupBy("document_id", "side").agg(F.round(F.percentile("x0", F.lit(0.1)), 4).alias("x0"), F.round(F.percentile("x1", F.lit(0.9)), 4).alias("x1"), F.countDistinct("page_index").alias("on_pages"))
    return zones.join(pages, "document_id").filter(F.col("on_pages") >= least * F.col("pages"))


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: float) -> DataFrame:
    """`df` with `island`: the number, from 0, of the run of ranges that overlap or lie at most `gap` apart, in each group."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(start) > reach + gap, 1).otherwise(0)
    return df.withColumn("_fresh", F.coalesce(fresh, F.lit(0))).withColumn("island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_fresh")


def bands(blocks: DataFrame) -> DataFrame:
    """The horizontal bands of each page, from top to bottom."""
    runs = islands(blocks.select(*PAGE, "y0", "y1"), PAGE, "y0", "y1", BAND_GAP * HEIGHT)
    return runs.groupBy(*PAGE, F.col("island").alias("band")).agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count("*").alias("blocks"))


def furniture_candidates(found: DataFrame) -> DataFrame:
    """The first band of each page as a header's candidate; the last one, of two at least, as a footer's."""
    page = Window.partitionBy(*PAGE)
    marked = found.withColumn("n", F.count("*").over(page))
    side = F.when(F.col("band") == 0, "top").when((F.col("band") == F.col("n") - 1) & (F.col("n") >= 2), "bottom")
    return marked.withColumn("side", side).filter("side is not null").select(*PAGE, "side", "y0", "y1")


def furniture_bands(candidates: DataFrame) -> DataFrame:
    """For each document, side and parity of pages (all, odd, even): the band that its candidates near their median form.

    Kept are candidates within twice the median deviation (0.5 % of the page at least) of the medians; the band lies between
    their 20th and 80th percentile, on two pages at least, and is no higher than BAND_MOST.
    """
    labels = F.array(F.lit("all"), F.when((F.col("page_index") + 1) % 2 == 1, "odd").otherwise("even"))
    rows = candidates.withColumn("parity", F.explode(labels))
    keys = ["document_id", "side", "parity"]
    middle = rows.groupBy(*keys).agg(F.median("y0").alias("m0"), F.median("y1").alias("m1"), F.count("*").alias("eligible"))
    off = rows.join(middle, keys).withColumn("d0", F.abs(F.col("y0") - F.col("m0"))).withColumn("d1", F.abs(F.col("y1") - F.col("m1")))
    spread = off.groupBy(*keys).agg(F.median("d0").alias("mad0"), F.median("d1").alias("mad1"))
    tolerance = lambda m: F.greatest(2 * F.col(m), F.lit(0.005 * HEIGHT))
    near = off.join(spread, keys).filter((F.col("d0") <= tolerance("mad0")) & (F.col("d1") <= tolerance("mad1")))
    out = near.groupBy(*keys).agg(F.round(F.percentile("y0", F.lit(0.2)), 4).alias("y0"), F.round(F.percentile("y1", F.lit(0.8)), 4).alias("y1"), F.count("*").alias("pages_present"), F.max("eligible").alias("eligible"))
    kept = out.filter(((F.col("eligible") < 4) | (F.col("pages_present") >= 2)) & (F.col("y1") - F.col("y0") <= BAND_MOST * HEIGHT))
    return kept.withColumn("coverage", F.round(F.col("pages_present") / F.col("eligible"), 6))


def furniture_match(candidates: DataFrame, profile: DataFrame) -> DataFrame:
    """For each page with candidates: whether its header and footer lie where the document's do, and the page's deviation."""
    own = F.when((F.col("page_index") + 1) % 2 == 1, "odd").otherwise("even")
    p = lambda parity, tag: profile.filter(F.col("parity").isin(*parity)).select("document_id", "side", F.col("parity").alias(f"{tag}p"), F.col("y0").alias(f"{tag}0"), F.col("y1").alias(f"{tag}1"), F.col("coverage").alias(f"{tag}c"))
    rows = candidates.withColumn("ap", own)
    joined = rows.join(p(["all"], "w"), ["document_id", "side"], "left").join(p(["odd", "even"], "a"), ["document_id", "side", "ap"], "left")
    y0, y1, coverage = F.coalesce("a0", "w0"), F.coalesce("a1", "w1"), F.coalesce("ac", "wc")
    near = (F.abs(F.col("y0") - y0) <= BAND_NEAR * HEIGHT) & (F.abs(F.col("y1") - y1) <= BAND_NEAR * HEIGHT)
    sides = joined.withColumn("near", F.coalesce(near, F.lit(False))).withColumn("expected", F.coalesce(coverage >= 0.5, F.lit(False)))
    deviates = F.when(F.col("expected") & ~F.col("near"), 0.5).otherwise(0.0)
    return sides.groupBy(*PAGE).agg(F.bool_or(F.col("near") & (F.col("side") == "top")).alias("header"), F.bool_or(F.col("near") & (F.col("side") == "bottom")).alias("footer"), F.sum(deviates).alias("deviation"))


def repeated_texts(blocks: DataFrame, words: int = 8, share: float = 0.12, pages: int = 60) -> DataFrame:
    """Short texts that stand on many pages of their document."""
    total = blocks.groupBy("document_id").agg(F.countDistinct("page_index").alias("pages"))
    short = blocks.withColumn("t", F.lower(squeezed(F.col("text")))).filter((F.length("t") >= 3) & (word_count(F.col("t")) <= words))
    on = short.groupBy("document_id", "t").agg(F.countDistinct("page_index").alias("on_pages"))
    least = F.greatest(F.lit(3), F.floor(F.lit(share) * F.least(F.lit(pages), F.col("pages"))))
    return on.join(total, "document_id").filter(F.col("on_pages") >= least).select("document_id", F.col("t").alias("text"), "on_pages", "pages")


def histogram_peaks(blocks: DataFrame, column: str, size: float = 10.0, active: float = 0.15) -> DataFrame:
    """The peaks of a column's histogram in each document: runs of neighbouring bins with at least `active` of the largest bin."""
    bins = blocks.groupBy("document_id", F.floor(F.col(column) / size).alias("bin")).agg(F.count("*").alias("n"))
    top = bins.groupBy("document_id").agg(F.max("n").alias("top"))
    kept = bins.join(top, "document_id").filter(F.col("n") >= active * F.col("top"))
    runs = islands(kept, ["document_id"], "bin", "bin", 1)
    return runs.groupBy("document_id", F.col("island").alias("peak")).agg((F.min("bin") * size).alias("low"), ((F.max("bin") + 1) * size).alias("high"), F.sum("n").alias("n"))


def columns(blocks: DataFrame, narrow: float = 0.2, wide: float = 0.85, share: float = 0.15) -> DataFrame:
    """The columns of each document: peaks of the left edges of blocks that are no wider than a column, that stand on enough of its pages."""
    width = F.col("x1") - F.col("x0")
    usable = blocks.filter((width >= narrow * WIDTH) & (width <= wide * WIDTH))
    pages = usable.groupBy("document_id").agg(F.countDistinct("page_index").alias("pages"))
    peaks = histogram_peaks(usable, "x0").withColumnRenamed("n", "peak_n")
    member = usable.join(peaks, "document_id").filter((F.col("x0") >= F.col("low")) & (F.col("x0") < F.col("high")))
    found = member.groupBy("document_id", "peak").agg(F.round(F.median("x0"), 4).alias("x0"), F.round(F.median("x1"), 4).alias("x1"), F.count("*").alias("blocks"), F.countDistinct("page_index").alias("on_pages"))
    return found.join(pages, "document_id").filter(F.col("on_pages") >= share * F.col("pages")).select("document_id", "peak", "x0", "x1", "blocks", "on_pages", "pages")


def page_columns(blocks: DataFrame, lanes: DataFrame, near: float = 0.04) -> DataFrame:
    """How many of its document's columns each page has, and the share of its blocks that lie in one."""
    lane = lanes.groupBy("document_id").agg(F.collect_list(F.struct("peak", "x0", "x1")).alias("lanes"))
    joined = blocks.join(lane, "document_id")
    fits = F.filter("lanes", lambda c: (F.abs(c["x0"] - F.col("x0")) <= near * WIDTH) & (overlap_ratio(F.col("x0"), F.col("x1"), c["x0"], c["x1"]) >= 0.5))
    marked = joined.withColumn("fits", fits)
    return marked.groupBy(*PAGE).agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.transform("fits", lambda c: c["peak"]))))).alias("columns"), F.round(F.avg((F.size("fits") > 0).cast("double")), 6).alias("in_columns"))


def page_match(furniture: DataFrame, vertical: DataFrame) -> DataFrame:
    """0.3 of the furniture's agreement and 0.7 of the columns'."""
    joined = vertical.join(furniture, PAGE, "left")
    return joined.select(*PAGE, F.round(F.least(F.lit(1.0), 0.3 * (1 - F.coalesce("deviation", F.lit(0.0))) + 0.7 * F.col("in_columns")), 6).alias("match"))


def neighbours(blocks: DataFrame) -> DataFrame:
    """Each block's gap to the one before and after on its page, and its height among the page's blocks."""
    order = Window.partitionBy(*PAGE).orderBy("block_index", "block_id")
    page = Window.partitionBy(*PAGE)
    height = F.col("y1") - F.col("y0")
    return blocks.select(
        "block_id", *PAGE,
        F.round(F.col("y0") - F.lag("y1").over(order), 4).alias("before"),
        F.round(F.lead("y0").over(order) - F.col("y1"), 4).alias("after"),
        (height == F.max(height).over(page)).alias("tallest"),
        F.round(F.percent_rank().over(page.orderBy(height)), 6).alias("height_rank"),
    )


def merged_ranges(blocks: DataFrame) -> DataFrame:
    """The horizontal ranges that a page's blocks cover together, and their share of the page's width."""
    runs = islands(blocks.select(*PAGE, "x0", "x1"), PAGE, "x0", "x1", 0.0)
    ranges = runs.groupBy(*PAGE, "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return ranges.groupBy(*PAGE).agg(F.count("*").alias("ranges"), F.round(F.sum(F.col("x1") - F.col("x0")) / WIDTH, 6).alias("coverage"))


def sections(blocks: DataFrame, most_level: int = 4) -> DataFrame:
    """The numbered headings of each document with level, parent (the last heading before of a smaller level) and end (the next heading)."""
    line = F.get(F.split("text", "\n"), F.lit(0))
    number = chapter_number(line)
    heads = blocks.withColumn("number", number).filter("number is not null").select("document_id", "page_index", "block_index", "block_id", "number", chapter_level(F.col("number")).alias("level")).filter(F.col("level") <= most_level)
    order = Window.partitionBy("document_id").orderBy("page_index", "block_index", "block_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = heads.withColumn("position", F.row_number().over(order))
    lasts = {n: F.max(F.when(F.col("level") == n, F.struct("position", "block_id"))).over(before) for n in range(1, most_level)}
    placed = placed.select("*", *(c.alias(f"last{n}") for n, c in lasts.items()), F.lead("block_id").over(order).alias("next"))
    parent = F.greatest(*(F.when(F.col("level") > n, F.col(f"last{n}")) for n in lasts))
    return placed.select("document_id", "block_id", "number", "level", "position", parent["block_id"].alias("parent"), "next")


def document_class(pages: Column, columns_: Column, depth: Column, contents: Column, backmatter: Column, front: Column) -> tuple[Column, Column]:
    """article, book, report or collection, with a confidence, from points for what the document has; `front` are the pages before the body. Ties go to the earlier kind."""

    def points(*cases: tuple[Column, dict[str, float]], default: dict[str, float] | None = None) -> dict[str, Column]:
        out = {}
        for kind in ("article", "book", "report", "collection"):
            c = F.lit((default or {}).get(kind, 0.0))
            for when, gives in reversed(cases):
                c = F.when(when, gives.get(kind, 0.0)).otherwise(c)
            out[kind] = c
        return out

    # The points.
    rules = [
        points((front == 0, {"article": 1.5}), (front <= 3, {"article": 0.5, "report": 0.5}), (front <= 8, {"report": 1.5, "collection": 1.0}), default={"book": 2.0, "collection": 1.5}),
        points((pages <= 25, {"article": 3.0}), (pages <= 50, {"article": 1.5, "report": 1.0}), (pages <= 120, {"report": 2.0, "collection": 1.5}), default={"book": 3.0, "collection": 1.0}),
        points((columns_ == 2, {"article": 1.0})),
        points((depth == 0, {"article": 1.0}), (depth == 1, {"article": 0.5, "report": 0.5}), (depth == 2, {"report": 1.0, "collection": 0.5}), default={"book": 2.0, "collection": 1.0}),
        points((contents, {"book": 1.5, "collection": 1.0, "report": 0.5})),
        points((backmatter >= 2, {"book": 1.5}), (backmatter == 1, {"report": 0.5})),
    ]
    total = {k: sum((r[k] for r in rules[1:]), rules[0][k]) for k in rules[0]}
    order = list(total)
    best = F.array_max(F.array(*(F.struct(total[k].alias("score"), F.lit(-i).alias("rank")) for i, k in enumerate(order))))
    kind = F.element_at(F.array(*map(F.lit, order)), (1 - best["rank"]).cast("int"))
    everything = total[order[0]] + total[order[1]] + total[order[2]] + total[order[3]]
    return kind, F.greatest(F.lit(0.4), F.least(F.lit(0.95), F.round(best["score"] / everything, 2)))


def band_clusters(candidates: DataFrame, rounds: int | None = None) -> DataFrame:
    """The clusters of furniture candidates of each document, side and parity: those near the medians form the first, those near
    the medians of what is left the next, and so on until none is left, or for `rounds` rounds.

    Each round is written, since the next one reads it four times: unwritten, n rounds would read the candidates 4 + ... + 4 ** n times.
    """
    labels = F.array(F.lit("all"), F.when((F.col("page_index") + 1) % 2 == 1, "odd").otherwise("even"))
    keys = ["document_id", "side", "parity"]
    start = written(candidates.withColumn("parity", F.explode(labels)).select(*keys, "y0", "y1"), "bands")
    rest, out, n = start, None, 0
    while n != rounds:
        n += 1
        if rounds is None and rest.isEmpty():
            break
        middle = rest.groupBy(*keys).agg(F.median("y0").alias("m0"), F.median("y1").alias("m1"))
        off = rest.join(middle, keys).withColumn("d0", F.abs(F.col("y0") - F.col("m0"))).withColumn("d1", F.abs(F.col("y1") - F.col("m1"))).drop("m0", "m1")
        spread = off.groupBy(*keys).agg(F.median("d0").alias("a0"), F.median("d1").alias("a1"))
        near = (F.col("d0") <= F.greatest(2 * F.col("a0"), F.lit(0.005 * HEIGHT))) & (F.col("d1") <= F.greatest(2 * F.col("a1"), F.lit(0.005 * HEIGHT)))
        marked = written(off.join(spread, keys).select(*keys, "y0", "y1", near.alias("near")), "bands")
        found = marked.filter("near").groupBy(*keys).agg(F.round(F.median("y0"), 4).alias("y0"), F.round(F.median("y1"), 4).alias("y1"), F.count("*").alias("pages")).withColumn("cluster", F.lit(n))
        out = found if out is None else out.unionByName(found)
        rest = marked.filter("not near").drop("near")
    if out is None:
        return start.select(*keys, F.lit(0).alias("cluster"), "y0", "y1", F.lit(0).cast("long").alias("pages"))
    dropped(start)
    return out.select(*keys, "cluster", "y0", "y1", "pages")
