"""Parts of a document: where its body begins and ends, abstracts and keywords after their markers, and names of persons on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import first_line, heading_kind, is_caps, keyword_list, squeezed, word_count

PAGE = ["document_id", "page_index"]
#: A heading with the number of a chapter; what a note on literature has.
NUMBERED = r"^\s*(?:(?i:chapter|kapitel|chapitre|capitolo|capítulo|hoofdstuk)\s+\d|[IVX]{1,4}\.\s+[\p{L}\p{N}_]{3,}|\d+\.\s+[\p{L}\p{N}_]{3,}|\d+ +[\x{00c0}-\x{024f}A-Z][\p{L}\p{N}_]{4,})"
NOTE = r"(?i)\b(?:1[0-9]{3}|20[0-9]{2})\b|\b(?:pp|vol|arch)\."
# Kinds of headings by the zone they belong to.
FRONT, BODY, BACK = ("toc", "abstract"), ("introduction",), ("references", "appendix")
#: Pages searched for the beginning; distance from the last front matter beyond which a beginning is not believed; pages of a body, at least, and as a share.
SEARCH, LATE, LEAST_BODY, BODY_SHARE = 30, 4, 3, 0.10


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), squeezed), lambda x: F.length(x) > 0)


def body_start(text: Column) -> Column:
    """How surely a block begins the body: 1 for a numbered heading that is no list or note, 0.9 for a heading of the body, else 0."""
    lines = _lines(text)
    n = F.size(lines)
    first = F.get(lines, F.lit(0))
    listed = (n > 1) & (F.size(F.filter(lines, lambda x: x.rlike(r"^\d"))) >= 0.5 * n)
    note = (n <= 3) & F.array_join(F.slice(lines, 2, 1000), " ").rlike(NOTE)
    marked = F.coalesce(heading_kind(first).isin(*BODY), F.lit(False))
    return F.when(first.rlike(NUMBERED), F.when(listed | note, 0.0).otherwise(1.0)).when(marked, 0.9).otherwise(0.0)


def document_zones(blocks: DataFrame) -> DataFrame:
    """(document_id, pages, body_start, signal, confidence, back_start): where the body of each document begins and its back matter.

    The body begins on the first of the leading pages, without a heading of the front matter, that has a block beginning it;
    where that is far behind the last front matter, or there is none, right after the front matter. The back matter begins on the
    last page with its heading, if the body has pages enough before it.
    """
    kind = heading_kind(F.get(_lines(F.col("text")), F.lit(0)))
    looked = blocks.select(*PAGE, F.coalesce(kind.isin(*FRONT), F.lit(False)).alias("front"), F.coalesce(kind.isin(*BACK), F.lit(False)).alias("back"), body_start(F.col("text")).alias("start"))
    pages = looked.groupBy(*PAGE).agg(F.max("front").alias("front"), F.max("back").alias("back"), F.max("start").alias("start"))
    pages = pages.withColumn("front", F.col("front") & (F.col("page_index") < SEARCH))
    begins = (F.col("page_index") < SEARCH) & ~F.col("front") & (F.col("start") >= 0.85)
    found = pages.groupBy("document_id").agg((F.max("page_index") + 1).alias("pages"), F.min(F.when(begins, F.struct("page_index", "start"))).alias("found"))
    # Front matter counts up to where the search stopped.
    fronts = pages.filter("front").select("document_id", F.col("page_index").alias("front_page")).join(found.select("document_id", "found"), "document_id").filter("found is null or front_page < found.page_index")
    out = found.join(fronts.groupBy("document_id").agg(F.max("front_page").alias("last_front")), "document_id", "left")
    c = F.col
    late = c("found").isNotNull() & c("last_front").isNotNull() & (c("found.page_index") > c("last_front") + LATE)
    start = F.when(late, c("last_front") + 1).when(c("found").isNotNull(), c("found.page_index")).otherwise(F.coalesce(c("last_front") + 1, F.lit(0)))
    signal = F.when(late, "after_front").when(c("found.start") == 1.0, "numbered").when(c("found").isNotNull(), "heading").otherwise("fallback")
    sure = F.when(late, 0.6).when(c("found").isNotNull(), c("found.start")).when(c("last_front").isNotNull(), 0.5).otherwise(0.3)
    out = out.select("document_id", "pages", start.cast("int").alias("body_start"), signal.alias("signal"), sure.alias("confidence"))
    least = F.greatest(F.lit(LEAST_BODY), F.floor(c("pages") * BODY_SHARE))
    backs = pages.filter("back").join(out, "document_id").filter(c("page_index") >= c("body_start") + least).groupBy("document_id").agg(F.max("page_index").alias("back_start"))
    return out.join(backs, "document_id", "left")


def zones_of_blocks(blocks: DataFrame, zones: DataFrame) -> DataFrame:
    """`blocks` with `zone`: front, body or back."""
    z = zones.select("document_id", "body_start", "back_start")
    zone = F.when(F.col("page_index") < F.col("body_start"), "front").when(F.col("page_index") >= F.col("back_start"), "back").otherwise("body")
    return blocks.join(z, "document_id").withColumn("zone", zone).drop("body_start", "back_start")


#: Markers of an abstract and of keywords at the beginning of a text.
ABSTRACT = r"(?i)^\s*(?:abstract|zusammenfassung|résumé|resumen|riassunto|samenvatting|resumo)\s*[:.]?\s*"
KEYWORDS = r"(?i)^\s*(?:keywords|key words|index terms|schlagwörter|schlüsselwörter|mots-clés|palabras clave|parole chiave|trefwoorden|palavras-chave)\s*[:.]?\s*"


def abstracts(texts: DataFrame, order: list[str], least: int = 50) -> DataFrame:
    """(document_id, abstract): what follows the first marker of an abstract, in its own text if that is longer than `least` characters, else the next text."""
    rest = F.regexp_replace("text", ABSTRACT, "")
    following = F.lead("text").over(Window.partitionBy("document_id").orderBy(*order))
    marked = texts.withColumn("_next", following).filter(F.col("text").rlike(ABSTRACT)).withColumn("abstract", F.when(F.length(squeezed(rest)) > least, squeezed(rest)).otherwise(squeezed(F.col("_next"))))
    return marked.groupBy("document_id").agg(F.min_by("abstract", F.struct(*order)).alias("abstract")).filter("abstract is not null and abstract <> ''")


def explicit_keywords(texts: DataFrame, order: list[str], ahead: int = 3) -> DataFrame:
    """(document_id, keywords): the list after the first marker of keywords: in the marker's own text, or in the first of the
    `ahead` texts after it that has any, as long as none of them is a heading in capitals."""
    w = Window.partitionBy("document_id").orderBy(*order)
    own = squeezed(F.regexp_replace("text", KEYWORDS, ""))
    nexts = [F.lead("text", k).over(w) for k in range(1, ahead + 1)]
    marked = texts.withColumns({"_own": own, **{f"_n{k}": c for k, c in enumerate(nexts)}}).filter(F.col("text").rlike(KEYWORDS))
    first = marked.groupBy("document_id").agg(F.min_by(F.struct("_own", *(f"_n{k}" for k in range(ahead))), F.struct(*order)).alias("m")).select("document_id", "m.*")
    line, stopped = F.when(F.length("_own") > 0, F.col("_own")), F.lit(False)
    for k in range(ahead):
        stopped = stopped | F.coalesce(is_caps(F.col(f"_n{k}")), F.lit(False))
        some = squeezed(F.col(f"_n{k}"))
        line = F.coalesce(line, F.when(~stopped & (F.length(some) > 0), some))
    return first.select("document_id", keyword_list(line).alias("keywords")).filter(F.size("keywords") > 0)


# Words before names, words of institutions, and words that are no names.
BY = r"(?i)^\s*(?:by|von|par|di|door|por|autor(?:en)?|edited\s+by|herausgegeben\s+von)\s+"
INSTITUTION = r"(?i)\b(?:university|universität|institute?|verlag|publisher|press|society|association|club|committee|foundation|trust|council|authority|agency|edition|auflage|volume|band|series|reihe|museum|archives?|archiv)\b"
NO_NAME = r"(?i)^\s*(?:summary|abstract|contents|introduction|collection|overview|conclusion|discussion|results|methods|background|zusammenfassung|einleitung|inhaltsverzeichnis|inhalt|résumé|sommaire|foreword|preface|vorwort|this|these|the|a|an|in|on|at|by|of|to|for)\s*$"
NAME = r"(?:\p{Lu}\.\s*){1,3}\p{Lu}\p{Ll}+|\p{Lu}\p{Ll}{2,}"
DEGREE = r"(?i)\b(?:dr|prof|dipl)\b"


def is_person_block(text: Column) -> Column:
    """Whether a short text names persons: it has a name, is no sentence, and is not about an institution."""
    words = word_count(text)
    last = F.element_at(F.split(squeezed(text), " "), -1)
    never = (
        (F.length(text) < 3) | text.rlike(NO_NAME) | text.rlike(r"[\p{L}\p{N}_]+'s\s+[\p{L}\p{N}_]+") | text.rlike(r"\s[–—-]\s") | text.rlike(r"(?i)\band/or\b") | ((words > 1) & last.rlike(r"^\p{Ll}"))
    )
    unlike = text.rlike(INSTITUTION) | (text.rlike(r"\.\s*$") & ~text.rlike(r"\b\p{Lu}\.(?:\p{Lu}\.?)?\s*$")) | text.rlike(r"^\s*\d")
    joined = text.rlike(r"(?i)\b(?:and|und)\b")
    named = text.rlike(NAME) & (words <= 8) & (joined | ((words <= 4) & ~((words == 1) & (F.length(F.trim(text)) > 12))))
    return F.when(never, False).when(text.rlike(BY), True).when(text.rlike(DEGREE) & ~text.rlike(INSTITUTION), True).when(unlike, False).otherwise(named)


def persons(text: Column) -> Column:
    """The names in a text of persons, parted at and, und, & and semicolons; without what has digits, over six words or under three letters."""
    parts = F.split(F.regexp_replace(text, BY, ""), r"(?i)\s+(?:and|und|&)\s+|;\s*")
    clean = F.transform(parts, lambda x: F.regexp_replace(squeezed(x), r"^[.,;:—–\s-]+|[.,;:—–\s-]+$", ""))
    return F.filter(clean, lambda x: (F.length(x) >= 3) & ~x.rlike(r"\d") & x.rlike(r"[A-Za-z\x{00c0}-\x{024f}]") & (F.size(F.split(x, " ")) <= 6))


def reconciled_authors(first: Column, second: Column, matches: Column) -> tuple[Column, Column]:
    """Of two lists of authors the first, or the second where that is empty, with a confidence that grows with the names they share."""
    # The confidences.
    none_first, none_second = F.size(first) == 0, F.size(second) == 0
    sure = F.when(none_first & none_second, 0.0).when(none_second, 0.7).when(none_first, 0.55).when(matches > 0, F.least(F.lit(0.92), 0.70 + 0.08 * matches)).otherwise(0.65)
    return F.when(none_first, second).otherwise(first), F.round(sure, 6)


def regions(texts: DataFrame, order: list[str]) -> DataFrame:
    """(document_id, position, kind, texts): the parts of each document in their order, by the headings that begin them: title
    page before any heading, then front matter, contents, abstract, body, references or appendix; neighbours of one kind are one part."""
    first = F.get(_lines(F.col("text")), F.lit(0))
    kind = heading_kind(first)
    begins = F.when(kind == "toc", "contents").when(kind.isin("abstract", "references", "appendix"), kind).when(kind.isNotNull() | (first.rlike(NUMBERED) & (word_count(first) <= 12)), "body")
    w = Window.partitionBy("document_id").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    named = texts.select("document_id", *order, F.coalesce(F.last(begins, ignorenulls=True).over(upto), F.lit("title_page")).alias("kind"))
    fresh = F.when(F.lag("kind").over(w).eqNullSafe(F.col("kind")), 0).otherwise(1)
    parts = named.withColumn("_fresh", fresh).withColumn("_part", F.sum("_fresh").over(upto).cast("int") - 1)
    return parts.groupBy("document_id", F.col("_part").alias("position"), "kind").agg(F.count("*").alias("texts"))
