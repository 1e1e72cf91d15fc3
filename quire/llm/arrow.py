"""Helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters worked on at a time, so that a task's arrays stay small. A longer text is worked on alone.
CHUNK_CHARS = 1_000_000


def slices(lengths: np.ndarray, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` characters together, or of one row."""
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and where each text begins (with the end as last element)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: each element's group and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    starts = np.cumsum(counts) - counts
    return group, np.arange(len(group)) - np.repeat(starts, counts)


def map_arrow(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None]) -> DataFrame:
    """`work` on each Arrow batch of `df`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            if out is None:
                continue
            yield from [out] if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(run, schema)
