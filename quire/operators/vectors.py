"""Vector search: exact, a set of queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import written

#: Query vectors that are broadcast at a time.
BLOCK = 2_000


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, group: str | None = None) -> DataFrame:
    """(query, id, cosine): for each query the `k` rows with the largest cosine, itself left out; ties go to the smaller id.

    With `group`, a column of `rows`, the `k` groups with the best row are given, as (query, group, id, cosine), and a query's
    key is that of a group. The queries are worked through in blocks of about BLOCK vectors, each read and broadcast in turn; a
    task multiplies a block with its rows and keeps the best k of each query over all its batches, so that the shuffle carries
    k rows for each query and task. Null vectors are left out.
    """
    spark = rows.sparkSession
    kept = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(group or key).alias("part"), F.col(vector).alias("v"))
    asked = written(queries.filter(F.col(vector).isNotNull()).select(F.col(group or key).alias("query"), F.col(vector).alias("v")), "queries")
    blocks = -(-asked.count() // BLOCK)
    out = None
    for n in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n).toArrow().combine_chunks()
        if not len(block):
            continue
        column = block.column("v").combine_chunks()
        sent = spark.sparkContext.broadcast((block.column("query").to_numpy(), _unit(_matrix(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column))))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64))
            for batch in batches:
                ids, parts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                if not len(ids):
                    continue
                cosine = np.round(q @ _unit(_matrix(batch.column(2))).T, 6)
                cosine[names[:, None] == parts[None, :]] = -np.inf
                # All rows that are not below the k-th so far, and those equal to it.
                at = np.minimum(np.searchsorted(best[0], np.arange(len(names)), side="right") - 1, len(best[0]) - 1)
                full = np.bincount(best[0], minlength=len(names)) == k
                least = np.where(full, best[3][at] if len(best[3]) else 0.0, -np.inf)
                a, b = np.nonzero((cosine >= least[:, None]) & np.isfinite(cosine))
                best = _best(k, *(np.concatenate(x) for x in zip(best, (a, parts[b], ids[b], cosine[a, b]), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(names[best[0]]), *map(pa.array, best[1:])], ["query", "part", "id", "cosine"])

        found = kept.mapInArrow(work, "query long, part long, id long, cosine double")
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], "query long, part long, id long, cosine double")
    per_part = out.groupBy("query", "part").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "id")).alias("e"))
    order = Window.partitionBy("query").orderBy("e.c", "e.id")
    top = per_part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", F.col("part").alias("group"), "e.id", (-F.col("e.c")).alias("cosine"))
    return top if group else top.drop("group")


def _best(k: int, query: np.ndarray, part: np.ndarray, ids: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, ...]:
    """The best row of each part, and of those the k best of each query; smaller ids first among equals."""
    order = np.lexsort((ids, -cosine, query))
    query, part, ids, cosine = query[order], part[order], ids[order], cosine[order]
    _, first = np.unique(np.stack([query, part]), axis=1, return_index=True)
    first.sort()
    query, part, ids, cosine = query[first], part[first], ids[first], cosine[first]
    ok = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[ok], part[ok], ids[ok], cosine[ok]


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): the mean vector of each group, of length 1."""
    parts = rows.select(group, F.posexplode(vector).alias("at", "x")).groupBy(group, "at").agg(F.avg("x").alias("x"))
    whole = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return whole.select(group, F.transform("v", lambda e: e["x"] / F.col("norm")).alias("centroid"))
