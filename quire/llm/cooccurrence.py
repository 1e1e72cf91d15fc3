"""Items that stand together in a record, and how much more often than chance.

Method: a blocked Gram matrix. Each task holds blocks of records as binary sparse matrices X over the items and sums the
products of X's transpose with X over its record blocks; the heaviest items of a block, where X is nearly full, are
multiplied as a dense matrix. Spark then adds the tasks' partial sums, and the counts are divided by what the marginals
would lead one to expect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import written

from .arrow import ragged

#: Records in a record block, items in the dense block, entries of a sparse product held at a time.
RECORDS, DENSE, ENTRIES = 50_000, 256, 4_000_000
#: Rows of the item table that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ITEMS = 200_000


def gram(records: np.ndarray, items: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper triangle of the Gram matrix of one record block.

    `records` (sorted) and `items` are the coordinates of the ones, without repeats; `items` count from the heaviest, 0.
    Returns item a < item b and the number of records with both, in no order.
    """
    order = np.lexsort((items, records))
    records, items = records[order], items[order]
    out = []
    heavy = items < DENSE
    if heavy.any():
        rows, place = np.unique(records[heavy], return_inverse=True)
        width = int(min(DENSE, n_items))
        total = np.zeros((width, width))
        for at in range(0, len(rows), 20_000):
            pick = (place >= at) & (place < at + 20_000)
            x = np.zeros((min(20_000, len(rows) - at), width), np.float32)
            x[place[pick] - at, items[heavy][pick]] = 1
            total += x.T @ x
        a, b = np.nonzero(np.triu(total, 1))
        out.append((a.astype(np.int64), b.astype(np.int64), total[a, b].astype(np.int64)))
    # Every other entry of a row of X meets the entries to its left: their number is its place in the row.
    _, size = np.unique(records, return_counts=True)
    _, place = ragged(size)
    light = np.flatnonzero((items >= DENSE) & (place > 0))
    if len(light):
        ends = np.cumsum(place[light])
        cut = 0
        while cut < len(light):
            stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + ENTRIES, side="right")))
            part = light[cut:stop]
            group, back = ragged(place[part])
            right = part[group]
            key = items[right - 1 - back] * n_items + items[right]
            key, n = np.unique(key, return_counts=True)
            out.append((key // n_items, key % n_items, n))
            cut = stop
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def block() -> Iterator[pa.RecordBatch]:
        baskets = pa.chunked_array(held).combine_chunks()
        flat = baskets.flatten().to_numpy(zero_copy_only=False)
        size = np.diff(baskets.offsets.to_numpy())
        record, _ = ragged(size)
        names, items, weight = np.unique(flat, return_inverse=True, return_counts=True)
        heaviest = np.argsort(-weight, kind="stable")
        rank = np.empty_like(heaviest)
        rank[heaviest] = np.arange(len(heaviest))
        a, b, n = gram(record, rank[items], len(names))
        if len(n):
            key = a * len(names) + b
            key, place = np.unique(key, return_inverse=True)
            n = np.bincount(place, n, len(key)).astype(np.int64)
            a, b = names[heaviest[key // len(names)]], names[heaviest[key % len(names)]]
            for at in range(0, len(n), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[at : at + 100_000]), pa.array(np.maximum(a, b)[at : at + 100_000]), pa.array(n[at : at + 100_000])], ["a", "b", "n"])

    for batch in batches:
        held.append(batch.column(0))
        rows += batch.num_rows
        if rows >= RECORDS:
            yield from block()
            held, rows = [], 0
    if rows:
        yield from block()


def cooccurrence(df: DataFrame, key: str, items: Column, min_count: int = 1, min_lift: float = 0.0) -> DataFrame:
    """Pairs of items with the number of records holding both.

    `df` has one row for each record, `key` tells the records apart, `items` is the array of its items; an item counts once
    in a record. Returns `a`, `b` (a < b by code points), `n_a`, `n_b`, `n_ab`, `n_records` (records with at least one
    item) and `lift` = n_ab * n_records / (n_a * n_b), for the pairs with n_ab >= min_count and lift >= min_lift.
    Null or empty arrays and null items count for nothing; an empty table gives an empty result.

    Both limits also remove items, exactly: n_ab <= min(n_a, n_b), so an item needs min_count records, and since
    lift <= n_records / max(n_a, n_b) it may stand in at most n_records / min_lift of them. Thus the hottest items leave
    before any join where a lift is asked for.
    """
    records = df.select(F.col(key).alias("_key"), F.array_distinct(F.filter(items, lambda x: x.isNotNull())).alias("_items")).filter(F.size("_items") > 0)
    n_records = records.count()
    entries = records.select("_key", F.explode("_items").alias("item"))
    stats = entries.groupBy("item").agg(F.count("*").alias("n"))
    kept = stats.filter((F.col("n") >= max(1, min_count)) & (F.col("n") * F.lit(float(min_lift)) <= n_records))
    kept = written(kept.withColumn("id", F.monotonically_increasing_id()), "items")
    small = kept.count() <= BROADCAST_ITEMS
    side = lambda x: F.broadcast(x) if small else x
    baskets = entries.join(side(kept.select("item", "id")), "item").groupBy("_key").agg(F.collect_list("id").alias("ids")).filter(F.size("ids") > 1).select("ids")
    pairs = baskets.mapInArrow(_partial_sums, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n_ab")).filter(F.col("n_ab") >= min_count)
    left = kept.select(F.col("id").alias("a"), F.col("item").alias("item_a"), F.col("n").alias("count_a"))
    right = kept.select(F.col("id").alias("b"), F.col("item").alias("item_b"), F.col("n").alias("count_b"))
    both = pairs.join(side(left), "a").join(side(right), "b")
    swap = F.col("item_a") > F.col("item_b")
    out = both.select(
        F.when(swap, F.col("item_b")).otherwise(F.col("item_a")).alias("a"),
        F.when(swap, F.col("item_a")).otherwise(F.col("item_b")).alias("b"),
        F.when(swap, F.col("count_b")).otherwise(F.col("count_a")).alias("n_a"),
        F.when(swap, F.col("count_a")).otherwise(F.col("count_b")).alias("n_b"),
        "n_ab",
        F.lit(n_records).cast("long").alias("n_records"),
    ).withColumn("lift", F.col("n_ab") * F.col("n_records") / (F.col("n_a") * F.col("n_b")))
    whole = F.col("n_ab") * F.col("n_records") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b")
    return out.filter(whole)
