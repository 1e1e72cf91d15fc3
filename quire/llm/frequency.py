"""How often every distinct term occurs, and in how many records.

Method: recursive radix spilling. The terms are partitioned to disk by the leading bits of their hash; a partition with
too many rows is split by further bits, again and again; each leaf is then aggregated by DuckDB in one task, under a memory
limit and with room to spill. Before the terms leave a task they are added up there, so that a hot term leaves it once.
"""

from __future__ import annotations

import math
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import shared_dir, written

#: Bits of the first split, least bits of the finest; bytes aimed at in a leaf, which DuckDB can add up in its memory.
FIRST_BITS, FINEST_BITS, LEAF_BYTES = 4, 12, 64_000_000
#: Memory of one DuckDB instance; bytes that a row takes besides its term.
MEMORY, ROW_BYTES = "160MB", 48
#: Terms, and bytes, that a task holds while adding up what it reads.
COMBINED, COMBINED_BYTES = 500_000, 32_000_000


def leaves(rows: np.ndarray, bits: int, first: int, most: int) -> np.ndarray:
    """For each value of the leading `bits` hash bits, the leaf it falls into.

    `rows` has the rows of each value. The first split takes `first` bits; a part with more than `most` rows is halved by
    its next bit until it is small enough or no bit is left.
    """
    sums = np.concatenate([[0], np.cumsum(rows)])
    leaf = np.zeros(len(rows), np.int64)
    todo = [(k << (bits - first), (k + 1) << (bits - first)) for k in range(1 << first)]
    done = 0
    while todo:
        at, to = todo.pop()
        if sums[to] - sums[at] > most and to - at > 1:
            middle = (at + to) // 2
            todo += [(at, middle), (middle, to)]
        else:
            leaf[at:to] = done
            done += 1
    return leaf


def _connect(folder: str) -> tuple[duckdb.DuckDBPyConnection, Callable[[], None]]:
    spill = os.path.join(folder, f"duckdb-{uuid.uuid4().hex}") if folder else ""
    con = duckdb.connect(config={"threads": "1", "memory_limit": MEMORY, "temp_directory": spill, "preserve_insertion_order": "false"})

    def close() -> None:
        con.close()
        if spill:
            shutil.rmtree(spill, ignore_errors=True)

    return con, close


def _combiner(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, close = _connect(folder)

        def added(held: list[pa.RecordBatch]) -> pa.Table:
            rows = pa.Table.from_batches(held)  # noqa: F841  DuckDB reads it by name
            return con.sql("select field, term, sum(occurrences)::bigint as occurrences, sum(records)::bigint as records from rows group by all").to_arrow_table().cast(held[0].schema)

        held: list[pa.RecordBatch] = []
        n = size = 0
        try:
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                size += batch.nbytes
                if n >= COMBINED or size >= COMBINED_BYTES:
                    table = added(held)
                    held, n, size = table.to_batches(), table.num_rows, table.nbytes
                    if n > COMBINED // 2 or size > COMBINED_BYTES // 2:
                        yield from held
                        held, n, size = [], 0, 0
            if held:
                yield from added(held).to_batches()
        finally:
            close()

    return run


def term_frequency(df: DataFrame, fields: dict[str, Column], rare: int = 2, common: float = 0.1, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """Every distinct term of each field with its occurrences and the records that hold it.

    `df` has one row for each record; each of `fields` is an array of terms. Returns `field`, `term`, `occurrences`,
    `records`, `field_records` (records with at least one term in the field) and `mark`: `rare` where at most `rare`
    records hold the term, else `common` where more than the share `common` of field_records hold it, else null.
    Null or empty arrays and null terms count for nothing; an empty table gives an empty result.
    """
    spark = df.sparkSession
    folder = shared_dir(spark).removeprefix("file://")
    folder = folder if folder.startswith("/") else ""  # DuckDB can spill to a path only; a leaf fits its memory anyway
    schema = "field string, term string, occurrences long, records long"
    parts = F.array(*(F.struct(F.lit(name).alias("field"), F.filter(terms, lambda x: x.isNotNull()).alias("terms")) for name, terms in fields.items()))
    lists = df.select(F.explode(parts).alias("p")).select("p.field", "p.terms").filter(F.size("terms") > 0)
    held = lists.select("field", "terms", F.explode(F.array_distinct("terms")).alias("term"))
    # The occurrences in a record are its length less the length without the term.
    counted = held.select("field", "term", (F.size("terms") - F.size(F.array_remove("terms", F.col("term")))).cast("long").alias("occurrences"), F.lit(1).cast("long").alias("records"))
    bits = lambda n: F.shiftrightunsigned(F.xxhash64("field", "term"), 64 - n).cast("int")
    spilled = counted.mapInArrow(_combiner(folder), schema).withColumn("radix", bits(FIRST_BITS))
    # The rows of a radix are written by several tasks, so that more than 2 ** FIRST_BITS work; what they hold of a term is added up later.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("term", F.lit("salt")), F.lit(max(1, -(-tasks // (1 << FIRST_BITS)))))
    spilled = written(spilled.repartition(tasks, "radix", salt).sortWithinPartitions("radix"), "radix", ["radix"])
    size = F.octet_length("term") + ROW_BYTES
    total = spilled.agg(F.sum(size)).first()[0] or 0
    finest = max(FINEST_BITS, math.ceil(math.log2(max(1.0, total / leaf_bytes))) + 2)
    weight = np.zeros(1 << finest, np.int64)
    for prefix, n in spilled.groupBy(bits(finest)).agg(F.sum(size)).collect():  # four rows for each leaf, or 2 ** FINEST_BITS
        weight[prefix] = n
    leaf = leaves(weight, finest, FIRST_BITS, leaf_bytes)
    n_leaves = int(leaf.max()) + 1
    which = spark.createDataFrame(pa.table({"prefix": np.arange(1 << finest, dtype=np.int32), "leaf": leaf.astype(np.int32)}))
    placed = spilled.withColumn("prefix", bits(finest)).join(which, "prefix").drop("prefix", "radix")

    def aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, close = _connect(folder)
        try:
            first = next(batches, None)
            if first is None:
                return

            def stream() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            rows = pa.RecordBatchReader.from_batches(first.schema, stream())  # noqa: F841
            out = con.sql("select field, term, sum(occurrences)::bigint as occurrences, sum(records)::bigint as records from rows group by all").to_arrow_table()
            yield from out.cast(pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])).to_batches(max_chunksize=50_000)
        finally:
            close()

    totals = placed.repartition(n_leaves, "leaf").drop("leaf").mapInArrow(aggregate, schema)
    sizes = lists.groupBy("field").agg(F.count("*").alias("field_records"))  # one row for each of `fields`
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common).cast("decimal(12,9)") * F.col("field_records"), "common")
    return totals.join(F.broadcast(sizes), "field").select("field", "term", "occurrences", "records", "field_records", mark.alias("mark"))
