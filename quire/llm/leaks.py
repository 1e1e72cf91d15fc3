"""Held-out passages that got into a corpus.

Method: q-gram lemma filtering. Texts become letters and digits without case, punctuation and blanks. A stretch that a
document shares with a passage shares its character q-grams on one diagonal (place in the document less place in the
passage); words replaced in between shift the diagonal a little and cost a known number of q-grams. So the shared q-grams
are counted on single diagonals and in overlapping bands of diagonals; regions with at least as many as the lemma demands
are kept and verified, by comparing along the diagonal and by banded alignment of words.

Of the document's q-grams every STEP-th is looked up. A run of n q-grams holds at least n // STEP of those, so that the
bounds are divided by STEP. Where a short passage leaves no bound above zero, one shared q-gram is asked for: a passage with
replaced words is then found if Q + STEP - 1 letters between two of them stayed. The evaluation texts, a given query set, pass
through the driver in blocks of bounded size; the documents are read once for each block and never moved.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import written

from .arrow import code_points, map_arrow, ragged, slices

#: Length of the q-grams, step of those looked up, width of a band of diagonals.
Q, STEP, BAND = 14, 4, 128
#: Words in a row that are a leak; one replaced word in so many is allowed in a whole passage.
RUN_WORDS, REPLACED = 20, 8
#: Characters of evaluation text in a block; characters of documents in a chunk; shared q-grams counted at a time.
BLOCK_CHARS, CHUNK, HITS = 4_000_000, 400_000, 6_000_000
#: Items that share a first sentence, or the frame of a last question, before it counts as their common instruction.
SHARED = 3

_B = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(Q + 1)]
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.?!:])\s+")


def plain(text: Column) -> Column:
    """Words in lower case, parted by one blank; words divided at the end of a line are joined."""
    joined = F.regexp_replace(text, "(?<=\\p{L})[-\u00ad\u00ac\u2010][ \\t]*[\\r\\n]+\\s*(?=\\p{L})", "")
    return F.trim(F.regexp_replace(F.lower(joined), r"[^\p{L}\p{M}\p{N}]+", " "))


def _words(text: str) -> list[str]:
    return _WORD.findall(re.sub("(?<=[^\\W\\d_])[-\u00ad\u00ac\u2010][ \\t]*[\\r\\n]+\\s*(?=[^\\W\\d_])", "", text).lower())


def _sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text.strip()) if _words(s)]


def _ends(text: str) -> tuple[str, str]:
    """An item's first sentence and the frame of its last question, if it has several sentences; else empty."""
    parts = _sentences(text)
    if len(parts) < 2:
        return "", ""
    return " ".join(_words(parts[0])), " ".join(_words(parts[-1])[:3]) if parts[-1].rstrip().endswith("?") else ""


def _passage(text: str, instruction: bool, question: bool) -> str:
    """The words of an item without its instruction and question."""
    parts = _sentences(text)
    start = int(instruction and len(parts) > 1)
    stop = len(parts) - 1 if question and len(parts) - start > 1 else len(parts)
    return " ".join(w for s in parts[start:stop] for w in _words(s))


def passages(items: DataFrame) -> DataFrame:
    """(id, passage) of `items` (id, text): each without a first sentence that SHARED items have in common, and without a last question whose frame they have in common, counted over all items."""

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        ends = [_ends(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([e[i] for e in ends], pa.string()) for i in (0, 1))], ["id", "text", "first", "frame"])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rest = [_passage(*row) for row in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rest, pa.string())], ["id", "passage"])

    kind = items.schema["id"].dataType.simpleString()
    looked = map_arrow(items.select("id", "text"), f"id {kind}, text string, first string, frame string", look)
    for name in ("first", "frame"):
        shared = looked.filter(F.col(name) != "").groupBy(name).count().filter(F.col("count") >= SHARED).select(name, F.lit(True).alias(f"has_{name}"))
        looked = looked.join(shared, name, "left")
    told = looked.select("id", "text", F.coalesce("has_first", F.lit(False)), F.coalesce("has_frame", F.lit(False)))
    return map_arrow(told, f"id {kind}, passage string", cut)


def hashes(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the q-grams that begin at the places `at`; each must have Q code points from there."""
    a = codes.astype(np.uint64)
    h2 = a[:-1] * _B[1] + a[1:]
    h4 = h2[:-2] * _B[2] + h2[2:]
    h8 = h4[at] * _B[4] + h4[at + 4]
    h = (h8 * _B[4] + h4[at + 8]) * _B[2] + h2[at + 12]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Items:
    """A block of passages, indexed by their q-grams."""

    ids: list[int]
    words: list[list[str]]
    codes: list[np.ndarray] = field(default_factory=list)
    starts: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        gram, item, place = [], [], []
        self.run_least = np.full(len(self.ids), 1 << 40, np.int64)
        self.whole_least = np.full(len(self.ids), 1 << 40, np.int64)
        self.budget = [len(w) // REPLACED for w in self.words]
        for k, words in enumerate(self.words):
            codes, starts = code_points(words)
            self.codes.append(codes)
            self.starts.append(starts)
            if len(codes) < Q:
                continue
            at = np.arange(len(codes) - Q + 1)
            gram.append(hashes(codes, at))
            item.append(np.full(len(at), k))
            place.append(at)
            run = min(RUN_WORDS, len(words))
            least = int((starts[run:] - starts[:-run]).min())
            self.run_least[k] = max(1, (least - Q + 1) // STEP)
            longest = sorted(np.diff(starts).tolist(), reverse=True)[: self.budget[k]]
            self.whole_least[k] = max(1, (len(codes) - Q + 1 - sum(x + Q - 1 for x in longest)) // STEP - self.budget[k])
        none = np.zeros(0, np.int64)
        gram_, item_, place_ = (np.concatenate(x) if x else none.astype(t) for x, t in ((gram, np.uint64), (item, np.int64), (place, np.int64)))
        order = np.argsort(gram_, kind="stable")
        self.item, self.place = item_[order], place_[order]
        self.grams, self.first, self.count = np.unique(gram_[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.grams >> np.uint64(42)).astype(np.int64)] = True

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(place of the text, item's place, longest run of whole words, words that differ or -1) of each leak."""
        out = []
        for start, stop in slices(np.fromiter(map(len, texts), np.int64, len(texts)), CHUNK):
            out += [(start + d, i, run, edits) for d, i, run, edits in self._chunk(texts[start:stop])]
        return out

    def _chunk(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        codes, begins = code_points(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(begins))
        solid = codes != 32
        codes, doc = codes[solid], doc[solid]
        begins = np.searchsorted(doc, np.arange(len(texts) + 1))
        if len(codes) < Q or not len(self.grams):
            return []
        own = np.arange(len(codes)) - begins[doc]
        at = np.flatnonzero(own % STEP == 0)
        at = at[at + Q <= begins[doc[at] + 1]]
        if not len(at):
            return []
        h = hashes(codes, at)
        maybe = self.filter[(h >> np.uint64(42)).astype(np.int64)]
        at, h = at[maybe], h[maybe]
        found = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
        hit = self.grams[found] == h
        at, found = at[hit], found[hit]
        runs: dict[tuple[int, int], list[int]] = {}
        wholes: dict[tuple[int, int], list[int]] = {}
        # Documents stay together, so that the hits of one are counted together.
        ends = np.searchsorted(doc[at], np.arange(len(texts)), side="right")
        total = np.concatenate([[0], np.cumsum(self.count[found])])[ends]
        cut = 0
        while cut < len(texts):
            base = total[cut - 1] if cut else 0
            upto = max(cut + 1, int(np.searchsorted(total, base + HITS, side="right")))
            low, high = (ends[cut - 1] if cut else 0), ends[upto - 1]
            self._count(at[low:high], found[low:high], doc, begins, runs, wholes)
            cut = upto
        out = []
        for d, i in runs.keys() | wholes.keys():
            text = codes[begins[d] : begins[d + 1]]
            run = max((self._run(text, i, g) for g in runs.get((d, i), [])), default=0)
            edits = -1
            if run < len(self.words[i]) and (d, i) in wholes:
                edits = min((e for band in wholes[d, i] if (e := self._align(texts[d], i, band)) >= 0), default=-1)
            if run == len(self.words[i]):
                edits = 0
            if run >= min(RUN_WORDS, len(self.words[i])) or edits >= 0:
                out.append((d, i, run, edits))
        return out

    def _count(self, at: np.ndarray, found: np.ndarray, doc: np.ndarray, begins: np.ndarray, runs: dict[tuple[int, int], list[int]], wholes: dict[tuple[int, int], list[int]]) -> None:
        group, nth = ragged(self.count[found])
        if not len(group):
            return
        where = self.first[found][group] + nth
        item, d = self.item[where], doc[at][group]
        diagonal = (at - begins[doc[at]])[group] - self.place[where]
        low = int(diagonal.min())
        span = int(diagonal.max()) - low + 2 * BAND
        pair = d * len(self.ids) + item
        key, n = np.unique(pair * span + (diagonal - low), return_counts=True)
        for k in key[n >= self.run_least[(key // span) % len(self.ids)]].tolist():
            p, g = divmod(k, span)
            runs.setdefault(divmod(p, len(self.ids)), []).append(g + low)
        for shift in (0, BAND // 2):
            bands = span // BAND + 2
            key2, place = np.unique(key // span * bands + (key % span + shift) // BAND, return_inverse=True)
            many = np.bincount(place, n)
            for k in key2[many >= self.whole_least[(key2 // bands) % len(self.ids)]].tolist():
                p, g = divmod(k, bands)
                wholes.setdefault(divmod(p, len(self.ids)), []).append(g * BAND - shift + low)

    def _run(self, text: np.ndarray, i: int, diagonal: int) -> int:
        """The longest run of whole words of the passage on a diagonal of the text."""
        codes, starts = self.codes[i], self.starts[i]
        low, high = max(0, -diagonal), min(len(codes), len(text) - diagonal)
        if high <= low:
            return 0
        equal = np.zeros(len(codes) + 1, np.int64)
        equal[1:][low:high] = codes[low:high] == text[low + diagonal : high + diagonal]
        whole = np.cumsum(equal)
        word = (whole[starts[1:]] - whole[starts[:-1]]) == np.diff(starts)
        edges = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
        return int((np.flatnonzero(edges == -1) - np.flatnonzero(edges == 1)).max(initial=0))

    def _align(self, text: str, i: int, band: int) -> int:
        """The words in which the text differs from the whole passage within a band of diagonals, or -1 if too many."""
        passage, budget = self.words[i], self.budget[i]
        words = text.split(" ")
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        slack = 2 * budget + 4
        low = max(0, int(np.searchsorted(ends, band)) - slack)
        high = min(len(words), int(np.searchsorted(ends, band + BAND + len(self.codes[i]))) + slack)
        region = words[low:high]
        # The passage is aligned whole, the region may begin and end anywhere.
        row = [0] * (len(region) + 1)
        for k, word in enumerate(passage):
            last, row = row, [k + 1]
            left = k + 1
            for j, other in enumerate(region):
                best = last[j] if word == other else last[j] + 1
                up = last[j + 1] + 1
                if up < best:
                    best = up
                if left + 1 < best:
                    best = left + 1
                row.append(best)
                left = best
            if min(row) > budget:
                return -1
        return min(row) if min(row) <= budget else -1


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents that contain passages of evaluation items: `item_id`, `doc_id`, `run_words` (the longest run of the
    passage's words found) and `edits` (words that differ where the whole passage was found, else null).

    A document counts if it has RUN_WORDS words of the passage in a row, or the whole passage with at most one word in
    REPLACED differing. Case, punctuation, blanks and line breaks are ignored. An item's common instruction and question are
    not part of its passage. Null or empty texts give nothing; a passage shorter than Q letters is not looked for; repeated
    rows count once; an empty table gives an empty result. The items, a given query set, are worked through in blocks of
    about `block_chars` characters, each broadcast in turn; the documents are never moved.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    given = items.select(F.col(item_key).alias("id"), F.col(item_text).cast("string").alias("text")).filter("text is not null and id is not null").distinct()
    rows = written(passages(given), "passages").orderBy("id", "passage")
    schema = f"item_id {item_kind}, doc_id {kind}, run_words int, edits int"
    plain_docs = docs.select(F.col(key).alias("doc_id"), plain(F.col(text).cast("string")).alias("text")).filter("text <> ''")
    out = spark.createDataFrame([], schema)
    held: list[tuple[int, str]] = []
    blocks: list[list[tuple[int, str]]] = []
    chars = 0
    for r in rows.toLocalIterator():
        held.append((r.id, r.passage))
        chars += len(r.passage)
        if chars > block_chars:
            blocks.append(held)
            held, chars = [], 0
    for block in [*blocks, held]:
        if block:
            out = out.unionByName(_searched(plain_docs, block, schema))
    return out.distinct()


def _searched(docs: DataFrame, block: list[tuple[int, str]], schema: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)  # of bounded size, but for one text
    index: list[Items] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not index:
            index.append(Items([k for k, _ in sent.value], [t.split() for _, t in sent.value]))
        found = index[0].search(batch.column(1).to_pylist())
        ids = batch.column(0).take(pa.array([d for d, *_ in found], pa.int64()))
        fields = [pa.array([index[0].ids[i] for _, i, *_ in found]), ids, pa.array([r for *_, r, _ in found], pa.int32()), pa.array([None if e < 0 else e for *_, e in found], pa.int32())]
        if not found:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), ids, fields[2], fields[3]], ["item_id", "doc_id", "run_words", "edits"])
        return pa.RecordBatch.from_arrays(fields, ["item_id", "doc_id", "run_words", "edits"])

    return map_arrow(docs, schema, work)
