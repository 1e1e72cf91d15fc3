"""References to works, and variants of names."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import names
from quire.llm.matching import CONFIDENT, TITLE_WORDS, _common, bits, close_pairs, links, marks, title_candidates


def test_close_pairs_are_exact(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-(2**62), 2**62, (30, 4))
    b = a.copy()
    for row in b:
        for _ in range(rng.integers(0, 8)):
            row[rng.integers(4)] ^= np.int64(1) << np.int64(rng.integers(62))
    want = {(i, j) for i in range(30) for j in range(30) if int(np.bitwise_count(a[i] ^ b[j]).sum()) < 4}
    left, right = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, v array<long>") for x in (a, b))
    assert {tuple(r) for r in close_pairs(left, right, 4).collect()} == want


def test_bits_count_pairs():
    v = bits(["nave", "nave", "", "naves"], TITLE_WORDS, 0)
    assert (v[0] == v[1]).all() and not v[2].any() and int(np.bitwise_count(v[0] ^ v[3]).sum()) <= 3


@pytest.mark.parametrize(("text", "want"), [("a nave parte ii", "p2"), ("a nave second edition", "e2"), ("a nave teil 3 2 auflage", "e2 p3"), ("a nave", ""), ("deuxieme edition", "e2"), ("parf of it", ""), ("parte ll", "p2")])
def test_marks(text, want):
    assert marks(text, text) == want


def test_a_journals_volume_is_no_part():
    assert marks("a nave archiv bd 12", "a nave") == "" and marks("a nave band 2", "a nave band 2") == "v2"


@pytest.mark.parametrize(
    "raw",
    [
        "6. JOHN SMITH. On the nave of Rome. 1999;41:213.", "[11] John Smith et al.: On the nave of Rome. In: Rev. Typ. 37 (1933), S. 285.", "John Smith; Anna Berg, On the nave of Rome, Rome 1961",
        "On the nave of Rome / John Smith. – 2020", "John Smith (1931). On the nave of Rome. Quaderni, 15, 173.", 'John Smith, "On the nave of Rome," Archiv, vol. 35, 1964.',
    ],
)
def test_titles_of_all_styles(raw):
    assert "On the nave of Rome" in title_candidates(raw, None)


@pytest.mark.parametrize(
    "raw",
    [
        "M. Rarohborn, G. T. Tertanthal, Andre Mankenstein, On the nave of Rome, Fympepoya 1944", "A. B. Berg, C. Berg, D. Berg, E. Berg, F. Berg, G. Berg, H. Berg, I. Berg, J. Berg, On the nave of Rome, Rome 1961",
        '"Alpha text one" and "Beta text two", see "On the nave of Rome", 1961',
        "St. Anne. Friends of. Old records here. More of the records. Yet more of records. Still more of records. On the nave of Rome. 1961", 'John "the younger one" Smith: On the nave of Rome. In: Rev. Typ. 37 (1933), S. 285.',
    ],
)
def test_titles_where_styles_look_alike(raw):
    assert "On the nave of Rome" in title_candidates(raw, None)


def test_comma_style_with_initials_is_linked(spark):
    w = spark.createDataFrame([(1, "Beitraege ueber die Dachwerke der Scheunen", 1944, ["M. Rarohborn"])], "work_id long, title string, year int, authors array<string>")
    r = spark.createDataFrame([(1, "M. Rarohborn, G. T. Tertanthal, Andre Mankenstein, Beitraege ueber die Dachwerke der Scheunen, Fympepoya 1944", None, None, None)], "ref_id long, raw string, title string, year string, authors array<string>")
    assert [(x.ref_id, x.work_id) for x in links(r, w).collect() if x.confidence >= CONFIDENT] == [(1, 1)]


def test_three_wrong_letters_and_another_part_are_no_bar(spark):
    works = [(1, "Zur Frage Gliederung von Memisosa", 1961, ["John Smith"]), (2, "Vom Dach zu Tynkig", 1961, ["John Smith"]), (3, "Pur Frage Gliederupg von Kemisosa, Teil I", 1970, ["Anna Berg"]), (4, "Zur Frage Gliederung von Memisosa, Teil II", 1970, ["Anna Berg"])]
    refs = [(1, "", "Pur Frage Gliederupg von Kemisosa", "1961", ["John Smith"]), (2, "Anna Berg, Pur Frage Gliederupg von Kemisosa, Teil II, Rolvik 1970", "Pur Frage Gliederupg von Kemisosa, Teil II", "1970", ["Anna Berg"])]
    w = spark.createDataFrame(works, "work_id long, title string, year int, authors array<string>")
    r = spark.createDataFrame(refs, "ref_id long, raw string, title string, year string, authors array<string>")
    assert {x.ref_id: x.work_id for x in links(r, w).collect() if x.confidence >= CONFIDENT} == {1: 1, 2: 4}


def test_common_bits_of_negative_words():
    a, b = (np.array([[-1, x, 5]], np.int64) for x in (-(2**63) + 1, -2))
    want = [int(np.unpackbits(np.ascontiguousarray(x).view(np.uint8)).sum()) for x in (a & b, a, b)]
    assert [int(x[0]) for x in _common(a, b)] == want


def test_links(spark):
    works = [(1, "On the nave of Rome", 1961, ["John Smith"]), (2, "On the nave of Rome, Part II", 1963, ["John Smith"]), (3, "Timber frames in the north of Wales", None, None), (4, None, 1900, ["X Y"]), (1, "On the nave of Rome", 1961, ["John Smith"])]
    refs = [
        (10, "Smith, J., On the nawe of Rome, Rome 1961", "On the nawe of Rome", "1961", ["Smith, J."]),
        (11, "On the nave of Rome, Part II / John Smith. – 1963", None, None, None),
        (12, "Timber frames in the north of Wales / A. Jones. – ", None, None, []),
        (13, "Carpets of the far east / B. Brown. – 1961", "Carpets of the far east", "1961", ["B. Brown"]),
        (14, None, None, None, None), (15, "", "", "", []), (16, "x" * 20_000, None, None, None),
        (10, "Smith, J., On the nawe of Rome, Rome 1961", "On the nawe of Rome", "1961", ["Smith, J."]),
    ]
    w = spark.createDataFrame(works, "work_id long, title string, year int, authors array<string>").withColumn("id", F.lit("clash"))
    r = spark.createDataFrame(refs, "ref_id long, raw string, title string, year string, authors array<string>").withColumn("work_id", F.lit("clash"))
    found = {x.ref_id: x.work_id for x in links(r, w).collect() if x.confidence >= CONFIDENT}
    assert found == {10: 1, 11: 2, 12: 3}
    assert links(r.limit(0), w).count() == 0 and links(r, w.limit(0)).count() == 0


def _entities(spark, given):
    df = spark.createDataFrame([(n,) for n in given], "name string")
    groups: dict[int, set[str]] = {}
    for r in names.variants(df, "name").collect():
        groups.setdefault(r.entity, set()).add(r.name)
    return {frozenset(g) for g in groups.values()}


def test_variants(spark):
    smith = {"Anna Zimulstra", "ZIMULSTRA, Anna", "Zimulstra, A.", "Anna Zimulstar"}
    other = {"Robert Krampelbaum", "Bob Krampelbaum", "Krampelbaum Robert*"}
    relative = {"Wilhelm Krampelbaum"}
    place = {"Institute of Naves Rolvik", "Rolvik: Institute of Naves", "Inst. of Naves, Rolvik"}
    place2 = {"Institute of Naves Tosgard"}
    found = _entities(spark, [*smith, *other, *relative, *place, *place2, "et al.", "", None, "N. N.", "et al.", "Anna Zimulstra"])
    assert found == {frozenset(x) for x in (smith, other, relative, place, place2)}


def test_initials_that_fit_two_persons_join_neither(spark):
    many = [f"{g} Person{c}o" for g in ("Anna", "Alexander") for c in "bcdfg"]
    found = _entities(spark, ["Anna Zimulstra", "Alexander Zimulstra", "A. Zimulstra", *many])
    assert frozenset({"A. Zimulstra"}) in found and frozenset({"Anna Zimulstra"}) in found


def test_initials_fit_by_a_slip_only_where_no_other_name_fits(spark):
    many = [f"{g} Person{c}o" for g in ("Anna", "Alexander") for c in "bcdfg"]
    found = _entities(spark, ["Anna Zimulstra", "A. Zimulstra", "Zimulstra Anna", "Alexander Zimolstra", "Zimolstra, Alexander*", *many])
    assert frozenset({"Anna Zimulstra", "A. Zimulstra", "Zimulstra Anna"}) in found


def test_initials_fit_a_given_name_and_its_slips(spark):
    many = [f"Alexander Person{c}{d}o" for c in "bcdfg" for d in "aeiou"] + [f"Aexander {x}" for x in ("Hulbort", "Grevandis", "Toskemin")]
    zimulstra = {"Alexander Zimulstra", "A. Zimulstra", "Aexander Zimulstra"}
    assert frozenset(zimulstra) in _entities(spark, [*zimulstra, *many])


def test_misspelt(spark):
    counts = spark.createDataFrame([("alexander", 40), ("aexander", 4), ("alexandre", 9), ("alexanber", 2), ("anna", 30), ("anne", 5), ("ann", 4), ("hanna", 7)], "w string, n long")
    assert {tuple(r) for r in names.misspelt(counts).collect()} == {("aexander", "alexander"), ("anne", "anna")}


def test_e_and_y_are_initials_unless_they_join_words():
    given = ["Banikeiner E", "É.Banikeiner", "BANIKEINER, E.", "Silva e Costa", "SILVA E COSTA", "Ortega y Gasset", "Y. Ortega"]
    assert [sorted(w) for w in names.words_of(given)] == [["banikeiner", "e"]] * 3 + [["costa", "silva"]] * 2 + [["gasset", "ortega"], ["ortega", "y"]]


def test_no_names(spark):
    assert names.variant_pairs(names.variants(spark.createDataFrame([], "name string"), "name")).count() == 0


def test_average_linkage_against_brute_force(spark):
    rng = random.Random(8)
    for _ in range(3):
        n = 9
        s = {(a, b): round(rng.random(), 6) for a, b in combinations(range(n), 2) if rng.random() < 0.6}
        groups = [{i} for i in range(n)]
        mean = lambda x, y: sum(s.get((min(a, b), max(a, b)), 0.0) for a in x for b in y) / (len(x) * len(y))
        while len(groups) > 1:
            x, y = max(combinations(groups, 2), key=lambda p: mean(*p))
            if mean(x, y) < 0.4:
                break
            groups = [g for g in groups if g not in (x, y)] + [x | y]
        edges = spark.createDataFrame([(a, b, v) for (a, b), v in s.items()], "a long, b long, s double")
        got: dict[int, set[int]] = {}
        for r in names.average_linkage(edges, 0.4).collect():
            got.setdefault(r.cluster, set()).add(r.node)
        assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in groups if len(g) > 1}
