"""Co-occurrence, term frequency, packing."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import cooccurrence as co
from quire.llm.frequency import leaves, term_frequency
from quire.llm.packing import best_fit, pack, sizes, tokenizer_path
from quire.llm.terms import normal_terms


def test_normal_terms(spark):
    df = spark.createDataFrame([(["  A  b ", "", None, "a b", "C d"],), (None,), ([],)], "k array<string>")
    assert [r.t for r in df.select(normal_terms(F.col("k")).alias("t")).collect()] == [["a b", "a b", "c d"], [], []]


@pytest.mark.parametrize("dense", [2, 256])
def test_gram_is_exact(monkeypatch, dense):
    monkeypatch.setattr(co, "DENSE", dense)
    monkeypatch.setattr(co, "ENTRIES", 7)
    rng = random.Random(dense)
    baskets = [sorted(rng.sample(range(12), rng.randint(0, 8))) for _ in range(50)]
    want = Counter(p for b in baskets for p in combinations(b, 2))
    rec = np.array([i for i, b in enumerate(baskets) for _ in b])
    items = np.array([x for b in baskets for x in b])
    got = Counter()
    for a, b, n in zip(*co.gram(rec, items, 12), strict=True):
        got[int(a), int(b)] += int(n)
    assert got == want


def test_cooccurrence_against_brute_force(spark):
    rng = random.Random(4)
    baskets = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))] + ["hot"] * (i % 3 == 0) for i in range(80)] + [None, [], [None, "a"]]
    df = spark.createDataFrame(list(enumerate(baskets)), "k long, a array<string>").withColumn("n", F.lit("clash")).withColumn("ids", F.lit(1))
    sets = [{x for x in b or [] if x} for b in baskets]
    n = sum(map(bool, sets))
    single = Counter(x for s in sets for x in s)
    double = Counter(p for s in sets for p in combinations(sorted(s), 2))
    for least, lift in ((1, 0.0), (3, 1.1)):
        want = {(a, b, single[a], single[b], c, n) for (a, b), c in double.items() if c >= least and c * n >= lift * single[a] * single[b]}
        assert {tuple(r)[:6] for r in co.cooccurrence(df, "k", F.col("a"), least, lift).collect()} == want
    assert co.cooccurrence(df.limit(0), "k", F.col("a")).count() == 0


def test_leaves_split_what_is_too_large():
    rows = np.array([1, 1, 1, 1, 50, 60, 1, 1])
    leaf = leaves(rows, 3, 1, 55)
    assert len(set(leaf[:4])) == 1 and leaf[4] != leaf[5] and leaf[6] == leaf[7] != leaf[4]


def test_term_frequency_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice(["x", "y", "z", f"r{i}"]) for _ in range(rng.randint(0, 4))] + ["hot"] * (i % 2)) for i in range(60)] + [(100, None), (101, []), (102, [None])]
    df = spark.createDataFrame(rows, "k long, t array<string>").withColumn("term", F.lit("clash"))
    occurrences, records, n = Counter(), Counter(), 0
    for _, t in rows:
        terms = [x for x in t or [] if x]
        n += bool(terms)
        occurrences.update(terms)
        records.update(set(terms))
    mark = lambda c: "rare" if c <= 2 else "common" if c > 0.1 * n else None
    want = {("f", t, occurrences[t], c, n, mark(c)) for t, c in records.items()}
    assert {tuple(r) for r in term_frequency(df, {"f": F.col("t")}).collect()} == want
    # However small the leaves are, the rows are the same.
    assert {tuple(r) for r in term_frequency(df, {"f": F.col("t")}, leaf_bytes=60).collect()} == want
    assert term_frequency(df.limit(0), {"f": F.col("t")}).count() == 0


def test_best_fit_keeps_capacity_and_conflicts():
    rng = random.Random(6)
    items = [(rng.randint(1, 100), rng.randint(0, 40), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(2000)]
    bins = defaultdict(list)
    for item, b in zip(items, best_fit(items, 100), strict=True):
        bins[b].append(item)
    for held in bins.values():
        assert sum(s for s, *_ in held) <= 100
        groups = [g for *_, g in held if g]
        assert len(groups) == len(set(groups))
        assert len({s for _, s, _ in held}) == len(held)


def test_best_fit_of_many_copies_is_quick():
    assert len(set(best_fit([(10, 1, 7)] * 20_000, 2048))) == 20_000


def test_pack_is_a_partition_of_every_text(spark):
    long = "word " * 5000
    rows = [(1, "a b c", "s"), (2, long, "t"), (3, None, "t"), (4, "", None), (5, "A, b c!", "u"), (5, "A, b c!", "u"), (6, "x" * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash")).withColumn("shard", F.lit(1))
    out = pack(df, "doc_id", "text", "source").toPandas()
    want = dict(zip((1, 2, 6), sizes([rows[0][1], long, rows[6][1]], tokenizer_path()), strict=True))
    total = out.groupby("doc_id").tokens.sum()
    assert all(total[k] == n for k, n in want.items()) and total[3] == total[4] == 0
    assert out[out.tokens == 0].sequence.isna().all()
    placed = out[out.tokens > 0]
    assert (placed.groupby("sequence").tokens.sum() <= 2048).all()
    assert len(placed[(placed.doc_id == 2) & (placed.tokens == 2048)]) == want[2] // 2048
    # 1 and 5 are copies of each other, and 5 stands twice.
    assert placed[placed.doc_id.isin([1, 5])].sequence.nunique() == 3
    for _, held in placed.groupby("sequence"):
        held = held.sort_values("position")
        assert list(held.position) == list(range(len(held))) and list(held.start) == [0, *held.tokens.cumsum()[:-1]]
    assert pack(df.limit(0), "doc_id", "text", "source").count() == 0


def test_a_source_is_free_by_its_share_of_all_texts(spark, monkeypatch):
    """Whether a source is kept apart depends on its share, not on the shards."""
    from quire.llm import packing

    rows = [(i, f"text number {i} of many", "big" if i % 10 == 0 else f"s{i % 97}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {k: s for k, _, s in rows}
    for shard in (20_000, 150):
        monkeypatch.setattr(packing, "SHARD", shard)
        placed = pack(df, "doc_id", "text", "source", capacity=64).toPandas()
        held = placed.assign(source=placed.doc_id.map(source)).groupby("sequence").source
        small = held.agg(lambda s: (s != "big").sum() - s[s != "big"].nunique())
        assert (small == 0).all() and held.agg(lambda s: (s == "big").sum()).max() > 1
