"""Text as Columns: normal forms, predicates and scores. All are built-in expressions, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore of any script.
WORD = r"[\p{L}\p{N}_]"


def squeezed(text: Column) -> Column:
    """Runs of white space made one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x{00a0}]+", " "))


def first_line(text: Column) -> Column:
    """The first line that isn't blank, in lower case; of a text without one, its first 80 characters."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(squeezed(x)) > 0)
    return F.lower(squeezed(F.coalesce(F.get(lines, F.lit(0)), F.substring(text, 1, 80))))


def slug(text: Column) -> Column:
    """Lower case, other characters than a-z and 0-9 as single underscores, at most 80 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 80)


def word_count(text: Column) -> Column:
    """Words parted by white space; 0 of a blank text."""
    return F.when(F.length(squeezed(text)) > 0, F.size(F.split(squeezed(text), " "))).otherwise(0)


def is_caps(text: Column) -> Column:
    """At least three letters, all of them capitals."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    return (F.length(letters) >= 3) & (letters == F.upper(letters))


def quality(text: Column) -> Column:
    """empty, very_poor, poor, mixed or good, by length and the share of unusual characters."""
    size = F.length(F.coalesce(text, F.lit("")))
    odd = F.length(F.regexp_replace(text, r"[\p{L}\p{N}_\s.,;:!?()\[\]'\"/-]", "")) / size
    return (
        F.when(size == 0, "empty").when(size < 200, "very_poor").when(size < 1000, "poor")
        .when(odd > 0.20, "poor").when(odd > 0.10, "mixed").otherwise("good")
    )


def unspaced(text: Column) -> Column:
    """Each line set with spaces between its letters (five letters at least) written without them."""
    line = lambda x: F.when(x.rlike(r"^\s*(?:\p{L} ){4,}\p{L}\s*$"), F.regexp_replace(x, " ", "")).otherwise(x)
    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def keyword_list(text: Column) -> Column:
    """A line of keywords parted at semicolons, or at commas where it has two at least, or as a whole; without bullets."""
    parts = F.when(text.contains(";"), F.split(text, ";")).when(F.length(F.regexp_replace(text, "[^,]", "")) >= 2, F.split(text, ",")).otherwise(F.array(text))
    clean = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, "[•*·]", "")))
    return F.filter(clean, lambda x: F.length(x) > 0)


def font_family(name: Column) -> Column:
    """A font's name without the prefix of a subset and one suffix of style."""
    return F.regexp_replace(F.regexp_replace(name, r"^[A-Z]{6}\+", ""), r"-(?:BoldItalic|Bold|Italic|Regular|Medium|Light|Roman|Oblique)$", "")


def token_set(text: Column) -> Column:
    """The distinct lower-case words without punctuation."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD + "+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Common elements of two arrays over all; 0 of two empty ones."""
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ > 0, F.size(F.array_intersect(a, b)) / all_).otherwise(0.0)


#: Number of the chapter at the beginning of a line, and the number's level.
CHAPTER = r"^\s*(\d{1,2}(?:\.\d{1,2}){0,4})\.?\s+(\p{Lu}.*)$"


def chapter_number(line: Column) -> Column:
    """The chapter number a heading begins with, without a trailing `.0`; null where the line is no numbered heading.

    Rejected are lines of more than ten words, lines that end as a sentence or in a page number, and captions and quantities.
    """
    number = F.regexp_replace(F.regexp_extract(line, CHAPTER, 1), r"\.0$", "")
    rest = F.regexp_extract(line, CHAPTER, 2)
    ok = (
        line.rlike(CHAPTER) & (word_count(rest) <= 10) & ~rest.rlike(r"[.;:,]\s*$") & ~rest.rlike(r"\s\d+\s*$")
        & ~rest.rlike(r"^(?:Figure|Fig|Table|Tab|Abb|Tabelle|Figura|Tabla)\b") & ~rest.contains("→")
    )
    return F.when(ok, number)


def chapter_level(number: Column) -> Column:
    return F.size(F.split(number, r"\."))


# Headings of the parts of a scholarly text, by kind.
HEADINGS = {
    "abstract": "abstract zusammenfassung résumé resumen riassunto samenvatting resumo summary sommario",
    "references": "references bibliography literatur literaturverzeichnis références bibliographie bibliografía referencias bibliografia riferimenti literatuur literatuurlijst referências",
    "introduction": "introduction einleitung introducción introduzione inleiding introdução",
    "methods": "methods methoden méthodes métodos metodi vorgehen methode",
    "results": "results ergebnisse résultats resultados risultati resultaten",
    "discussion": "discussion diskussion discusión discussione bespreking discussão",
    "conclusion": "conclusion conclusions schluss fazit conclusión conclusiones conclusione conclusioni conclusie conclusão",
    "appendix": "appendix anhang annexe apéndice appendice bijlage apêndice",
    "toc": "contents inhalt inhaltsverzeichnis sommaire índice indice inhoud inhoudsopgave",
}


def heading_kind(line: Column) -> Column:
    """The kind of part that a line, perhaps after a number, is the heading of; null if none."""
    bare = F.lower(F.trim(F.regexp_replace(line, r"^\s*(?:\d+(?:\.\d+)*\.?\s+)?|\s*[:.]?\s*$", "")))
    out = F.lit(None).cast("string")
    for kind, words in reversed(HEADINGS.items()):
        out = F.when(bare.isin(*words.split()), kind).otherwise(out)
    return out


def is_corrupt(text: Column) -> Column:
    """Under 70 % printable characters, or with marks of a failed decoding."""
    good = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\p{P}\p{S} ]", ""))
    return (F.length(text) > 0) & ((good < 0.7 * F.length(text)) | text.contains("(cid:") | text.contains("�"))


def surface(text: Column) -> dict[str, Column]:
    """Counts and flags that a text's characters alone determine."""
    size = F.greatest(F.length(text), F.lit(1))
    return {
        "chars": F.length(text),
        "words": word_count(text),
        "lines": F.size(F.split(text, "\n")),
        "sentences": F.regexp_count(text, F.lit(r"[.!?](?:\s|$)")),
        "capital_ratio": F.round(F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / size, 6),
        "digit_ratio": F.round(F.length(F.regexp_replace(text, r"[^0-9]", "")) / size, 6),
        "punctuation_ratio": F.round(F.length(F.regexp_replace(text, r"[^.,;:!?]", "")) / size, 6),
        "ends_with_period": F.rtrim(text).endswith("."),
        "starts_with_number": text.rlike(r"^\s*\d"),
        "has_brackets": text.rlike(r"\[[^\]]*\]"),
        "has_parentheses": text.rlike(r"\([^)]*\)"),
        "has_year": text.rlike(r"\b(?:1[4-9]\d\d|20\d\d)\b"),
        "has_url": text.rlike(r"https?://"),
        "is_caps": is_caps(text),
    }


def evidence(text: Column) -> dict[str, Column]:
    """What kind of text it may be: shares of lines with leader dots, with a number at the end, with a year after a name, and counts of citations."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(squeezed(x)) > 0)
    n = F.greatest(F.size(lines), F.lit(1))
    share = lambda pattern: F.round(F.size(F.filter(lines, lambda x: x.rlike(pattern))) / n, 6)
    leaders, numbers, entries = share(r"\.{3,}"), share(r"\d\s*$"), share(r"^\p{Lu}[\p{L}'-]+, \p{Lu}\..*\d{4}")
    return {
        "leader_dots": leaders,
        "line_end_numbers": numbers,
        "entries": entries,
        "contents_like": F.round(0.6 * leaders + 0.4 * numbers, 6),
        "citations": F.regexp_count(text, F.lit(r"\(\p{Lu}[\p{L}'-]+ \d{4}\)")),
        "numbered_citations": F.regexp_count(text, F.lit(r"\[\d{1,3}\]")),
    }
