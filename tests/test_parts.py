"""Typography, zones, names and vectors on small cases."""

from __future__ import annotations

import random

import compare
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions.similarity import osa
from quire.operators import authority, layout, typography, zones
from quire.operators.vectors import nearest
from quire.plans import titles


def one(spark, column, *values):
    """A column's value on a row of values named a, b, c ..."""
    return spark.createDataFrame([values], [chr(97 + i) for i in range(len(values))]).select(column.alias("x")).first().x


def test_zones(spark):
    pages = ["Contents\nA 1\nB 2", "More", "1. Introduction\nThe survey begins here\nand goes on.", "Text", "Text", "Text", "Text", "References\nSmith 1990"]
    rows = [(1, i, 0, i, t) for i, t in enumerate(pages)] + [(2, 0, 0, 100, "Only text"), (3, 0, 0, 200, "1. Smith, Naves,\npp. 3, 1999"), (3, 1, 0, 201, "Introduction\nIt begins.")]
    rows += [(4, i, 0, 300 + i, "Contents" if i == 0 else "1. Naves of wood" if i == 9 else "Text") for i in range(12)]
    df = spark.createDataFrame(rows, "document_id long, page_index int, block_index int, block_id long, text string")
    got = {r.document_id: (r.pages, r.body_start, r.signal, r.confidence, r.back_start) for r in zones.document_zones(df).collect()}
    assert got == {1: (8, 2, "numbered", 1.0, 7), 2: (1, 0, "fallback", 0.3, None), 3: (2, 1, "heading", 0.9, None), 4: (12, 1, "after_front", 0.6, None)}
    assert zones.document_zones(df.limit(0)).count() == 0


def test_regions(spark):
    texts = ["On Naves", "Contents\nA 1", "Abstract\nShort.", "1. Introduction", "Prose.", "2. Methods", "References", "Smith 1990"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "document_id long, position int, text string")
    assert [(r.kind, r.texts) for r in zones.regions(df, ["position"]).orderBy("position").collect()] == [("title_page", 1), ("contents", 1), ("abstract", 1), ("body", 3), ("references", 2)]


@pytest.mark.parametrize(("text", "names"), [("John Smith and Anna Berg", ["John Smith", "Anna Berg"]), ("by J. R. Miller", ["J. R. Miller"]), ("University of Rome Press", []), ("The oak was felled", []), ("Summary", []), ("2 Smith", []), ("England's advice", [])])
def test_persons(spark, text, names):
    found = F.when(zones.is_person_block(F.col("a")), zones.persons(F.col("a"))).otherwise(F.array().cast("array<string>"))
    assert one(spark, found, text) == names


def test_heading_scores(spark):
    def score(size, bold, italic, caps, text):
        c = typography.heading_score(F.lit(size), F.lit(bold), F.lit(italic), F.lit(caps), F.lit("A"), F.lit(0), F.col("a"), F.lit(10.0), F.lit("A"), F.lit(0))
        return round(one(spark, c, text), 6)

    assert score(15.0, False, False, False, "On Naves") == 0.9 and score(10.0, False, False, False, "On Naves") == 0.0
    assert score(10.0, True, False, False, "On Naves") == 0.21 and score(10.5, True, False, False, "On Naves") == 0.56
    assert score(15.0, False, False, False, "This is a whole sentence with a stop.") == 0.0 and score(200.0, False, False, False, "X") == 0.0
    assert score(10.0, False, False, True, "NAVES") == 0.42 and score(15.0, False, True, False, "On Naves") == 0.7


def test_half_points_go_to_even(spark):
    assert [one(spark, typography.half_points(F.col("a")), x) for x in (10.25, 10.75, 10.3)] == [10.0, 11.0, 10.5]


def test_profiles_need_spans(spark):
    row = lambda d, pos, size: (d, 0, 0, d, "some text", pos, "word", size, "ABCDEF+Serif-Bold", 16, 0, pos // 4, 10.0 + 12 * (pos // 4))
    schema = "document_id long, page_index int, block_index int, block_id long, block_text string, pos int, text string, size double, font string, flags int, color int, line_no int, line_y0 double"
    got = typography.body_profile(spark.createDataFrame([row(1, i, 10.0) for i in range(19)] + [row(2, i, 12.0 if i > 20 else 10.0) for i in range(24)], schema)).collect()
    assert [(r.document_id, r.spans, r.size, r.family, r.bold_ratio, r.height) for r in got] == [(2, 24, 10.0, "Serif", 1.0, 12.0)]


def test_clusters_run_to_the_end(spark):
    rows = [(1, p, "top", 20.0 + 100 * (p % 5), 40.0 + 100 * (p % 5)) for p in range(30)]
    df = spark.createDataFrame(rows, "document_id long, page_index int, side string, y0 double, y1 double")
    whole = layout.band_clusters(df).filter("parity = 'all'")
    assert whole.agg(F.sum("pages")).first()[0] == 30
    assert layout.band_clusters(df.limit(0)).count() == 0


def test_clusters_read_each_round_once(spark):
    rng = random.Random(4)
    rows = [(d, p, side, (y := rng.choice([20.0, 24.0, 28.5, 60.0, 300.0]) + rng.random()), y + rng.choice([10.0, 18.0, 90.0])) for d in range(6) for p in range(5 * d) for side in ("top", "bottom")]
    rows += [(1, 90, "top", None, 40.0), (2, 91, "top", 20.0, float("nan")), (2, None, "top", 21.0, 30.0), (None, 0, "top", 20.0, 30.0)]
    df = spark.createDataFrame(rows, "document_id long, page_index int, side string, y0 double, y1 double")
    got = layout.band_clusters(df, rounds=3)
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 3
    con = duckdb.connect()
    con.register("found", df.toArrow())
    sql = titles._clusters(3).replace(titles._CANDIDATES, "with c as (select * from found)")
    assert compare.rows(got.toPandas()) == compare.rows(con.sql(sql).df())


def test_nearest_keeps_ties_over_batches(spark):
    rng = np.random.default_rng(2)
    same = rng.normal(size=4)
    rows = [(i, (same if i % 3 else rng.normal(size=4)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = sorted((r.query, r.id) for r in nearest(df, df.filter("id in (1, 3)"), "id", "v", 5).collect())
        grouped = nearest(df.withColumn("g", F.floor(F.col("id") / 10)), df.filter("id = 3").withColumn("g", F.lit(-1).cast("long")), "id", "v", 3, "g").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    want = sorted((q, i) for q in (1, 3) for i in sorted((k for k in unit if k != q), key=lambda k: (-round(float(unit[q] @ unit[k]), 6), k))[:5])
    assert got == want
    best = {}
    for i in unit:
        best[i // 10] = min(best.get(i // 10, (9.0, 0)), (-round(float(unit[3] @ unit[i]), 6), i))
    assert sorted((r.group, r.id) for r in grouped) == sorted((g, e[1]) for g, e in sorted(best.items(), key=lambda x: x[1])[:3])


def test_edits_against_a_table():
    def plain(a, b):
        t = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = min(t[i - 1][j - 1] + (a[i - 1] != b[j - 1]), t[i - 1][j] + 1, t[i][j - 1] + 1)
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    t[i][j] = min(t[i][j], t[i - 2][j - 2] + 1)
        return t[-1][-1]

    rng = random.Random(4)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(2))
        assert osa(a, b) == plain(a, b)


def test_authority_forms(spark):
    assert one(spark, authority.canonical_doi(F.col("a")), "https://doi.org/10.1000/AB.") == "10.1000/ab" and one(spark, authority.canonical_isbn(F.col("a")), "978-3-16-148410-0") == "9783161484100"
    given, family = authority.name_parts(F.col("a"))
    assert one(spark, F.concat_ws("|", given, family), "van Berg, Anna") == "Anna|van Berg" and one(spark, F.concat_ws("|", given, family), "Anna van Berg") == "Anna van|Berg"
    df = spark.createDataFrame([(1, "LK 99 and ZH 3400, ZH 3400 and QQ 500")], "k long, t string")
    assert [r.notation for r in authority.notations(df, "k", "t", ["ZH", "LK"]).collect()] == ["ZH 3400"]
