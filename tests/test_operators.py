from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import catalog, graph, layout
from quire.operators.vectors import nearest
from quire.plans.search import semantic_chunks
from quire.sources.files import csv_table, document_files
from quire.streaming.incremental import arrivals, fresh, ingest


def test_islands(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0), (1, 5.0, 6.0), (1, 10.0, 12.0), (1, 13.0, 20.0)], "k long, a double, b double")
    assert [r.island for r in layout.islands(df, ["k"], "a", "b", 0.0).orderBy("a").collect()] == [0, 0, 0, 1]
    assert [r.island for r in layout.islands(df, ["k"], "a", "b", 1.0).orderBy("a").collect()] == [0, 0, 0, 0]


def test_reached_leaves_no_node_twice(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d")], "s string, o string")
    out = graph.reached(edges, spark.createDataFrame([("a",)], "start string"), 3)
    assert sorted((r.node, r.depth) for r in out.collect()) == [("b", 1), ("c", 1), ("d", 2)]


def test_citing_leads_from_document_to_document(spark):
    quads = spark.createDataFrame([("1", "1", "cites", "the_nave"), ("2", "2", "same_as", "the_nave"), ("2", "2", "title", "The nave"), ("2", "2", "cites", "the_nave")], "g string, s string, p string, o string")
    assert [tuple(r) for r in graph.citing(quads).collect()] == [("1", "2", "The nave")]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "", None)], "id int, v string, w string")
    new = spark.createDataFrame([(2, None, None), (3, "c", "z"), (4, "d", "y")], "id int, v string, w string")
    get = lambda df: sorted(tuple(r) for r in df.collect())
    assert get(catalog.filled(old, new, "id", ["v"], ["w"])) == [(1, "a", None), (2, "b", None), (3, "c", "z")]
    assert get(catalog.gap_filled(old, new, "id", ["v", "w"])) == [(1, "a", None), (2, "b", "x"), (3, "c", "z")]
    assert get(catalog.upserted(old, new, ["id"]).select("id")) == [(1,), (2,), (3,), (4,)]
    nulls = spark.createDataFrame([(None,), (1,)], "k int")
    assert get(catalog.inserted(nulls, spark.createDataFrame([(None,), (2,), (2,)], "k int"), ["k"]).fillna(-1)) == [(-1,), (1,), (2,)]


def test_chunks_over_gaps_and_null_texts(spark, tmp_path):
    rows = [(1, 1, 0, "heading", "The nave"), (1, 2, 1, "paragraph", None), (1, 3, 4, "paragraph", "word " * 50), (2, 4, 0, "heading", "The roof"), (2, 5, 2, "paragraph", "Short.")]
    spark.createDataFrame(rows, "document_id long, segment_id long, segment_index int, kind string, text string").write.parquet(str(tmp_path / "text_segments.parquet"))
    got = {r.chunk_id: (r.chunk, r.text) for r in semantic_chunks(spark, str(tmp_path)).collect()}
    assert got == {"1_000001": ("heading", "The nave\n" + "word " * 50), "2_000004": ("heading", "The roof\nShort.")}


def test_nearest_of_many_equal_vectors_takes_the_smaller_ids(spark):
    ids = random.Random(3).sample(range(1, 400), 399)
    df = spark.createDataFrame([(0, [1.0, 0.5])] + [(i, [1.0, 0.5] if i % 3 == 0 else [0.5, 1.0 + i / 400]) for i in ids], "id long, v array<double>").coalesce(1)
    got = sorted(r.id for r in nearest(df, df.filter("id = 0"), "id", "v", 5).collect())
    assert got == [3, 6, 9, 12, 15]


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8)).round(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, v array<double>")
    got = {(r.query, r.id) for r in nearest(df, df.filter("id % 20 = 0"), "id", "v", 5).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 20, 40):
        c = np.round(u @ u[q], 6)
        c[q] = -2
        assert {i for a, i in got if a == q} == set(sorted(range(60), key=lambda i: (-c[i], i))[:5])


def test_csv_needs_its_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿a,b\n1,2\n", encoding="utf-8")
    assert [tuple(r) for r in csv_table(spark, str(tmp_path / "t.csv"), ["a"], ["c"]).collect()] == [("1", None)]
    with pytest.raises(ValueError, match="z"):
        csv_table(spark, str(tmp_path / "t.csv"), ["z"])


def test_document_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.pdf").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"no")
    assert [r.length for r in document_files(spark, str(tmp_path)).collect()] == [3]


def test_stream_keeps_one_of_each_content(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "id long, text string").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = fresh(arrivals(spark, str(tmp_path / "in"), rows.schema), "at", "text")
    ingest(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["text 0", "text 1", "text 2"]


def test_furniture_of_shifted_pages(spark):
    random.seed(2)
    rows = []
    for page in range(9):
        rows.append((1, page, 1, 0, 60.0, 120.0, 500.0, 700.0, "body"))
        if 2 < page < 6:
            rows.append((1, page, 0, 0, 60.0, 20.0 + random.random(), 300.0, 40.0, "head"))
            rows.append((1, page, 2, 0, 280.0, 760.0, 320.0, 780.0, str(page)))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "block_id long, document_id long, page_index int, block_index int, block_type int, x0 double, y0 double, x1 double, y1 double, text string")
    bands = layout.furniture_bands(layout.furniture_candidates(layout.bands(layout.text_blocks(df))))
    sides = {(r.side, r.parity): (r.y0, r.y1) for r in bands.collect()}
    assert sides["bottom", "all"] == (760.0, 780.0)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from quire.session import shared_dir

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(session("yarn", "hdfs://x/shared/")) == "hdfs://x/shared"
    assert shared_dir(session("local[4]", None)).startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError):
            shared_dir(session(master, None))
