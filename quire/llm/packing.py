"""Texts combined into sequences of a fixed number of tokens.

Method: conflict-constrained best fit. Open bins are kept by their free space; each carries a bitmap of the sources and of
the groups of copies in it. An item, largest first, looks for the bin with the least free space that is enough, and goes on
to the next larger one as long as the bin's bitmap conflicts with it. Bins of the same free space and bitmap are alike, so
that a conflict is tested once for all of them.

The items are spread by hash over shards of bounded size, each packed by one task; a shard of many thousand items leaves
next to nothing unused, so that more would not help.
"""

from __future__ import annotations

import base64
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import written

from .arrow import map_arrow

#: Items packed together (about); share of all texts above which a source is too large to be kept apart.
SHARD, HOT_SOURCE = 20_000, 0.05
#: Stands for a source that is not kept apart.
FREE = 0


def tokenizer_path() -> str:
    """The public byte-level vocabulary that sizes are measured with unless another is given."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(2)
def _encoding(path: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sizes(texts: list[str | None], path: str) -> list[int]:
    """The number of tokens of each text; 0 of null."""
    encode = _encoding(path).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each item (size, source, group of copies), sizes from 1 to `capacity`.

    Two items of the same group of copies never share a bin, nor do two of the same source; a group or source of 0 is none.
    """
    copies = [g for g, n in Counter(g for _, _, g in items if g).items() if n > 1]
    names = sorted({s for _, s, _ in items if s != FREE})
    bit = {("s", s): 1 << i for i, s in enumerate(names)} | {("g", g): 1 << (len(names) + i) for i, g in enumerate(copies)}
    # By free space: bins by bitmap. `free` has a bit for each free space that some bin has.
    bins: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(capacity + 1)]
    free, count = 0, 0
    out = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        size, source, group = items[i]
        own = bit.get(("s", source), 0) | bit.get(("g", group), 0)
        space, chosen, mask = size, -1, 0
        while rest := free >> space:
            space += (rest & -rest).bit_length() - 1
            mask = next((m for m in bins[space] if not m & own), -1)
            if mask >= 0:
                held = bins[space][mask]
                chosen = held.pop()
                if not held:
                    del bins[space][mask]
                    if not bins[space]:
                        free &= ~(1 << space)
                break
            space += 1
        if chosen < 0:
            chosen, space, mask = count, capacity, 0
            count += 1
        if space > size:
            bins[space - size][mask | own].append(chosen)
            free |= 1 << (space - size)
        out[i] = chosen
    return out


def pack(df: DataFrame, key: str, text: str, source: str, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """Where each text goes: `key`, `piece`, `sequence`, `position` (in the sequence, from 0), `start` (tokens before it)
    and `tokens`.

    A text of at most `capacity` tokens is one piece. A longer one is cut into full sequences and a rest, which is packed as
    other texts are. Copies (texts equal but for case, punctuation and blanks) never share a sequence, nor do two texts of a
    source, unless the source has more than HOT_SOURCE of all texts: those cannot all be kept apart, whatever the number of
    texts. A null source counts as a source. A null or empty text, or one without tokens, has a null
    sequence, position and start and 0 tokens. A repeated row is packed again. An empty table gives an empty result.
    """
    path = path or tokenizer_path()
    kind = df.schema[key].dataType.simpleString()
    copy = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{M}\p{N}]+", " ")
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(F.coalesce(F.col(source).cast("string"), F.lit(""))).alias("source"), F.when(F.length(F.trim(copy)) > 0, F.xxhash64(F.trim(copy))).otherwise(0).alias("copies"))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = pa.array(sizes(batch.column(1).to_pylist(), path), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), tokens], ["key", "source", "copies", "tokens"])

    measured = written(map_arrow(rows, f"key {kind}, source long, copies long, tokens long", measure), "sizes")
    hot = measured.groupBy("source").agg(F.count("*").alias("n")).filter(F.col("n") > F.lit(HOT_SOURCE) * measured.filter("tokens > 0").count()).select("source", F.lit(True).alias("hot"))  # at most 1 / HOT_SOURCE rows
    measured = measured.join(F.broadcast(hot), "source", "left").withColumn("source", F.when(F.col("hot"), F.lit(FREE)).otherwise(F.col("source"))).drop("hot")
    whole = F.floor(F.col("tokens") / capacity)
    full = measured.filter(F.col("tokens") >= capacity).select("key", "source", "copies", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece"), F.lit(capacity).cast("long").alias("tokens"))
    rest = measured.filter(F.col("tokens") % capacity > 0).select("key", "source", "copies", whole.alias("piece"), (F.col("tokens") % capacity).alias("tokens"))
    pieces = full.unionByName(rest)
    n = measured.agg(F.sum(F.ceil(F.col("tokens") / capacity))).first()[0] or 0
    shards = max(1, round(n / SHARD))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("piece", "ascending")])  # a task that runs again gives the same rows
        tokens = table.column("tokens").to_pylist()
        bins = best_fit(list(zip(tokens, table.column("source").to_pylist(), table.column("copies").to_pylist(), strict=True)), capacity)
        begun: dict[int, tuple[int, int]] = {}
        position, start = [], []
        for b, t in zip(bins, tokens, strict=True):
            p, s = begun.get(b, (0, 0))
            position.append(p)
            start.append(s)
            begun[b] = (p + 1, s + t)
        shard = table.column("shard")[0].as_py()
        return pa.Table.from_arrays([table.column("key"), table.column("piece"), pa.array([(shard << 32) + b for b in bins], pa.int64()), pa.array(position, pa.int32()), pa.array(start, pa.int32()), table.column("tokens")], ["key", "piece", "sequence", "position", "start", "tokens"])

    spread = pieces.withColumn("shard", F.pmod(F.xxhash64("key", "piece", F.lit("shard")), F.lit(shards)))
    placed = spread.groupBy("shard").applyInArrow(packed, f"key {kind}, piece long, sequence long, position int, start int, tokens long")
    none = measured.filter("tokens = 0").select("key", F.lit(0).cast("long").alias("piece"), *(F.lit(None).cast(t).alias(c) for c, t in (("sequence", "long"), ("position", "int"), ("start", "int"))), "tokens")
    return placed.unionByName(none).withColumnRenamed("key", key)
