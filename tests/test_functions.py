from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions import fuzzy, geometry, similarity, text
from quire.functions.identifiers import found


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("line", "number", "level"),
    [("1 Introduction", "1", 1), ("2.3 The nave", "2.3", 2), ("3.0 Methods", "3", 1), ("12 kg of oak.", None, None), ("4 Figure 2 shows", None, None), ("5 Survey 17", None, None), ("Introduction", None, None)],
)
def test_chapter_numbers(spark, line, number, level):
    assert value(spark, text.chapter_number(F.lit(line))) == number
    if number:
        assert value(spark, text.chapter_level(F.lit(number))) == level


@pytest.mark.parametrize(("line", "kind"), [("References", "references"), ("2 Conclusion", "conclusion"), ("ZUSAMMENFASSUNG:", "abstract"), ("The nave", None)])
def test_heading_kinds(spark, line, kind):
    assert value(spark, text.heading_kind(F.lit(line))) == kind


@pytest.mark.parametrize(("name", "family"), [("ABCDEF+TimesNewRoman", "TimesNewRoman"), ("Helvetica-Bold", "Helvetica"), ("TimesNewRoman-BoldItalic", "TimesNewRoman"), ("Arial", "Arial")])
def test_font_families(spark, name, family):
    assert value(spark, text.font_family(F.lit(name))) == family


def test_text_helpers(spark):
    assert value(spark, text.slug(F.lit("Äh! The Nave, 2nd "))) == "h_the_nave_2nd"
    assert value(spark, text.first_line(F.lit("\n  \n The  Nave\nx"))) == "the nave"
    assert value(spark, text.word_count(F.lit("  "))) == 0
    assert value(spark, text.unspaced(F.lit("T I T L E\na b"))) == "TITLE\na b"
    assert value(spark, text.keyword_list(F.lit("• a b; c ;"))) == ["a b", "c"]
    assert value(spark, text.keyword_list(F.lit("a, b"))) == ["a, b"]
    assert value(spark, text.is_caps(F.lit("AB"))) is False
    assert value(spark, text.is_corrupt(F.lit("(cid:3) x"))) is True


def test_identifiers(spark):
    s = F.lit("see 10.1234/abc.5. and ISSN 1234-567X, arXiv: 2101.12345 PMID: 1234567")
    assert value(spark, found(s, "doi")) == ["10.1234/abc.5"]
    assert value(spark, found(s, "issn")) == ["1234-567X"]
    assert value(spark, found(s, "arxiv")) == ["2101.12345"]
    assert value(spark, found(s, "pmid")) == ["1234567"]


def test_fuzzy(spark):
    a, b = F.lit(0.5), F.lit(0.25)
    assert [value(spark, c) for c in (fuzzy.both(a, b), fuzzy.either(a, b), fuzzy.implies(a, b), fuzzy.boosted(a, b), fuzzy.dampened(a, b), fuzzy.ramp(F.lit(15), 10, 20), fuzzy.ramp(F.lit(3), 5, 5))] == [0.25, 0.625, 0.5, 0.625, 0.375, 0.5, 0.0]


def test_overlap(spark):
    assert value(spark, geometry.overlap_ratio(F.lit(0.0), F.lit(10.0), F.lit(5.0), F.lit(9.0))) == 1.0
    assert value(spark, geometry.overlap_ratio(F.lit(0.0), F.lit(10.0), F.lit(12.0), F.lit(13.0))) == 0.0


@pytest.mark.parametrize(("a", "b", "n"), [("teh", "the", 1), ("ca", "abc", 3), ("", "ab", 2), ("nave", "nave", 0)])
def test_edits_with_swaps(spark, a, b, n):
    assert value(spark, similarity.osa_distance(F.lit(a), F.lit(b))) == n


def test_title_similarity(spark):
    assert value(spark, similarity.title_similarity(F.lit("2.1 The nave"), F.lit("the nave"))) == 1.0
    assert value(spark, similarity.word_overlap(F.lit("..."), F.lit(""))) == 1.0
    assert value(spark, similarity.title_similarity(F.lit("timber frames of the north"), F.lit("carpets"))) < 0.2
