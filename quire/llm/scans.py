"""Noise in text from scanned pages: found, and repaired into readable paragraphs.

Method: a lexicon of all words with their frequency gives, through an index of symmetric deletes, for each rare word the
frequent words that are close to it. A weighted edit distance, in which confusions of similar characters are cheap, keeps
those that a scanner may have misread; where several remain, the frequency of the pairs they make with their neighbours picks
one. Words divided at the end of a line are looked up joined, as compounds and in parts. Page numbers and running headers are
told by their place on the page, by their form, by the headers known for the document, and by whether the line before and the
line after go together better without them.

A text is read once, line by line in Arrow batches; whatever has to be looked up in the corpus becomes rows, so that no lexicon
has to fit in a task. A filter of fixed size picks the words that may have a correction, whatever their number.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import written

from .arrow import map_arrow
from .lookalike import same_look

# What a scanner reads, and what was printed.
CONFUSIONS = """
c e|e c|1 l|l 1|1 i|l i|i l|0 o|o 0|5 s|8 b|6 b|6 é|9 g|2 z|4 a|b h|h b|b ß|ß b|8 ß|t f|f t|ſ f|ſ s|rn m|m rn|ri n|n ri|ii u|u ii|ii ü|cl d|d cl|vv w|w vv|li h|h li|
in m|m in|nn m|ni m|fl ſl|fi ſi|y v|v y|@ a|@ o|@ e|q g|g q|ij ü|lc k|tl d|rri m|iii m|iu ui|hn lm|l t|t l|i j|j i|x z
"""
PAIRS = tuple(tuple(p.split()) for p in CONFUSIONS.replace("\n", "").split("|") if len(p.split()) == 2)
#: The confusions as the keys of words without accents have them, and a bar that may stand for any upright letter.
BARE_PAIRS = sorted({(a, b.replace("é", "e").replace("ü", "u")) for a, b in PAIRS} | {("|", x) for x in "lit"})
#: Cost of a confusion, of a lost accent, and the most that a misreading may cost.
CONFUSED, MOST = 0.3, 0.65
#: A correction has to be this many times as frequent as what it corrects, and a little more.
RATIO, LEAST = 30, 5
#: The filter of the words that have corrections has 2 ** FILTER_BITS places.
FILTER_BITS = 23
#: Good words with fewer letters are found by the variants of a misreading and one delete, longer ones by two deletes.
SHORT = 6
#: Height of the margins in which a page's headers and numbers stand, as a share of the page.
MARGIN = 0.06
#: Times that two words stand together, and the share of the first one's, from which on they go together.
TOGETHER, TOGETHER_SHARE = 2, 0.002
#: A word with less than this share of all words may be a name at the end of a title, not a word in a sentence.
NAME_SHARE = 1e-4
#: Words that a task holds before it counts them.
HELD = 2_000_000

#: Stands for a mark of division that is no hyphen of a word (soft hyphen, not sign).
DIVIDED = "\ue000"
BREAK = re.compile("\r\n|[\r\n\x85\u2028\u2029]")
TOKEN = re.compile(r"@?[^\W_]+(?:[@|][^\W_]+)*@?")
PLAIN_TOKEN = re.compile(r"[^\W_]+")
_LETTERS = "".join(c.lower() if c.isalnum() else " " for c in map(chr, range(128)))
END = re.compile(f"([^\\W_][\\w@]*)([-{DIVIDED}])\\s*$")
#: A number with letters in it that look like digits.
NUMBER = r"^(?=.*[0-9])(?=.*[a-z])(?:[0-9loi]|(?<=[0-9])[sbz](?=[0-9]))+$"
MARKS = "-" + DIVIDED
COMPOUND = re.compile(r"([^\W_]+)-([^\W_]+)")
_DIGIT = "0-9OoIlSsBZ"
_ROMAN = r"[ivxlcdm]{1,8}"
#: A page number as a line of its own: bare, or with something around it or before it.
BARE = re.compile(rf"^(?:\d[{_DIGIT}]{{0,4}}|[{_DIGIT}]\d{{1,4}}|{_ROMAN})[.,]?$", re.IGNORECASE)
NUMBERED = re.compile(
    rf"^(?:[-–—·•*~]\s*(?:[{_DIGIT}]{{1,5}}|{_ROMAN})\s*[-–—·•*~]|\[\s*(?:[{_DIGIT}]{{1,5}}|{_ROMAN})\s*\]|[{_DIGIT}]{{1,5}}\s*/\s*[{_DIGIT}]{{1,5}}"
    rf"|(?:page|seite|pagina|página|pág|pag|blz|bladzijde|p|s|fol)\b\.?\s*(?:[{_DIGIT}]{{1,5}}|{_ROMAN})(?:\s*(?:/|of|von|de|di|van)\s*[{_DIGIT}]{{1,5}})?)$",
    re.IGNORECASE,
)
#: The longest line that can be a page number.
NUMBER_LINE = 24
#: A journal with volume and year, and perhaps a page, as a line of its own.
JOURNAL = re.compile(r"^(?:\d+\s+)?[^\W\d_][^\d,;]*\s\d[\dOlI]{0,3} \([12][\dOlIS]{3}\)(?: [\dOlI]+)?$")


def normal(line: str) -> str:
    """A header without case, digits and punctuation."""
    return " ".join(re.findall(r"[^\W\d_]+", line.lower()))


def prepared(texts: list[str | None]) -> list[str]:
    """Texts in the one form of what looks the same, with marks of division that are no hyphens as DIVIDED."""
    marked = [re.sub("[\u00ad\u00ac](?=[ \\t]*(?:[\\r\\n]|$))", DIVIDED, t or "") for t in texts]
    odd = [i for i, t in enumerate(marked) if not t.isascii()]
    for i, t in zip(odd, same_look([marked[i] for i in odd]), strict=True):
        marked[i] = t
    return marked


def lines_of(text: str) -> list[str]:
    lines = text.split("\n") if text.isascii() and "\r" not in text else BREAK.split(text)
    return [y for x in lines if (y := x.strip())]


def _bare_line(line: str) -> str:
    return re.sub(r"^[\s'`\"|^~.,:;]+|[\s'`\"|^~,:;]+$", "", line)


def furniture(lines: list[str]) -> set[int]:
    """The lines of a text in the body of a page that are page numbers, or headers next to one or with a journal's form."""
    found: set[int] = set()
    last = len(lines) - 1
    if last < 1:
        return found
    usual = sorted(map(len, lines))[len(lines) // 2]
    for i, whole in enumerate(lines):
        if len(whole) > NUMBER_LINE:
            if "(" in whole and whole[-1] in ")0123456789OlI" and JOURNAL.match(whole) and _breaks_off(lines, i):
                found.add(i)
            continue
        line = _bare_line(whole)
        if NUMBERED.match(line):
            if i < last or line[0] != "[":
                found.add(i)
        elif (i < last and BARE.match(line) and len(line) < usual / 2) or (JOURNAL.match(line) and _breaks_off(lines, i)):
            found.add(i)
    for i in sorted(found):
        for j in (i - 1, i + 1):
            if 0 <= j <= last and j not in found and _foreign(lines, i, j):
                found.add(j)
    return found


def _breaks_off(lines: list[str], i: int) -> bool:
    """Whether a sentence goes on over line i: the line before has no end, or the line after no beginning."""
    before, after = (lines[i - 1] if i else ""), (lines[i + 1] if i + 1 < len(lines) else "")
    return bool((before and before[-1] not in ".?!:)") or (after and after[0].islower()))


def _foreign(lines: list[str], number: int, j: int) -> bool:
    """Whether line j, next to a page number, is no part of the sentence around it."""
    line = lines[j]
    if not re.match(r"^(?:\d+ )?[^\W\d_a-z]", line) or line[-1] in ".,;:?!-" + DIVIDED or len(line) > 90:
        return False
    if line.isupper():
        return True
    if j > number:
        after = lines[j + 1] if j + 1 < len(lines) else ""
        return bool(after) and (after[0].islower() or after[0] in "(" or after[0].isdigit())
    before = lines[j - 1] if j else ""
    after = lines[number + 1] if number + 1 < len(lines) else ""
    return bool(before) and before[-1] not in ".?!:" and after[:1].islower()


def _alone(lines: list[str], found: set[int]) -> list[int]:
    """Lines that may be a header though they are not found by a number: they begin as a title does."""
    out = []
    for i, line in enumerate(lines):
        if i in found or not 6 <= len(line) <= 90 or line[-1] in ".,;?!-(" + DIVIDED:
            continue
        if (line[0].isupper() or line[0].isdigit()) and ". " not in line and len(line.split()) >= 2:
            out.append(i)
    return out


def _context(lines: list[str], i: int) -> dict[str, bool]:
    """Whether a sentence goes on over line i, and whether one ends before it and another begins after it."""
    ended = lines[i - 1][-1] in ".?!"
    return {"goes_on": not ended, "parted": ended and lines[i + 1][0].isupper() and lines[i][-1].isalnum()}


def _tokens(line: str) -> list[str]:
    if "@" in line or "|" in line:
        return TOKEN.findall(line.lower())
    if line.isascii():
        return line.translate(_LETTERS).split()
    return PLAIN_TOKEN.findall(line.lower())


def _parts(lines: list[str], tokens: list[list[str]], skip: set[int]) -> Iterator[tuple[list[str], tuple[str, str] | None]]:
    """Each line's tokens without the halves of divided words, and the divided word at its end."""
    kept = [i for i in range(len(lines)) if i not in skip]
    head = False
    for n, i in enumerate(kept):
        words = tokens[i]
        if head and words:
            words = words[1:]
        head = False
        cut = END.search(lines[i].lower()) if lines[i][-1] in MARKS else None
        if cut and words:
            words = words[:-1]
            head = n + 1 < len(kept)
        yield words, (cut.group(1), cut.group(2)) if cut else None


@lru_cache(1)
def _by_last() -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = {}
    for bad, good in PAIRS:
        out.setdefault(bad[-1], []).append((bad, good))
    return out


@lru_cache(4096)
def _bare(char: str) -> str:
    return unicodedata.normalize("NFD", char)[:1]


def misreading(bad: str, good: str) -> float:
    """The weighted edit distance: what it costs to read `bad` where `good` is printed. Anything above MOST may be too low."""
    pairs = _by_last()
    n, m = len(bad), len(good)
    rows = [[float(j) for j in range(m + 1)]]
    for i in range(1, n + 1):
        a = bad[i - 1]
        row = [float(i)]
        above = rows[i - 1]
        for j in range(1, m + 1):
            b = good[j - 1]
            best = above[j - 1] + (0.0 if a == b else CONFUSED if a == _bare(b) or not a.isalnum() else 1.0)
            best = min(best, above[j] + 1, row[j - 1] + 1)
            for x, y in pairs.get(a, ()):
                if i >= len(x) and j >= len(y) and bad.endswith(x, 0, i) and good.endswith(y, 0, j):
                    best = min(best, rows[i - len(x)][j - len(y)] + CONFUSED)
            row.append(best)
        rows.append(row)
        if i > 3 and min(row) > MOST and min(above) > MOST and min(rows[i - 2]) > MOST:
            return MOST + 1
    return rows[n][m]


def bare_form(word: str) -> str:
    """The word without accents, as many letters as before."""
    return word if word.isascii() else "".join(map(_bare, word))


def variants(word: str) -> set[str]:
    """The word, and the words of which it is a misreading by one confusion, without accents."""
    out = {word}
    for bad, good in BARE_PAIRS:
        at = word.find(bad)
        while at >= 0:
            out.add(word[:at] + good + word[at + len(bad) :])
            at = word.find(bad, at + 1)
    return out


def deletes(word: str, most: int) -> set[str]:
    """The word and what remains when up to `most` of its characters are deleted."""
    out = {word}
    for size in range(1, most + 1):
        out.update("".join(c for i, c in enumerate(word) if i not in cut) for cut in combinations(range(len(word)), size))
    return out


def good_keys(word: str) -> set[str]:
    """The keys of a right word: itself and one delete where it is short, two deletes where it is long. Keys of two letters are no deletes, so that none is shared by many words."""
    bare = bare_form(word)
    if len(bare) >= SHORT:
        return deletes(bare, 2)
    return {"=" + k for k in (deletes(bare, 1) if len(bare) >= 4 else {bare})}


def bad_keys(word: str) -> set[str]:
    """The keys of a word that may be misread: those of all right words that two confusions lead to, or one where the right word has three letters or fewer, which two would make any word."""
    bare = bare_form(word)
    out = {k for k in deletes(bare, 2) if len(k) >= SHORT - 2}
    if len(bare) < SHORT + 2:
        for v in variants(bare):
            out.add("=" + v)
            if len(v) >= 4:
                out.update("=" + k for k in deletes(v, 1) if len(k) >= 3)
    return out


def corrections(words: DataFrame) -> DataFrame:
    """(word, good, cost, n_good) for each pair of a rare `word` and a frequent one that a scanner may have read it from, from
    `words` (word, n). Words of one letter or of more than forty and plain numbers are left alone."""
    usable = words.filter(F.length("word").between(2, 40) & ~F.col("word").contains("-") & ~F.col("word").rlike(r"^\d+$"))

    def indexed(df: DataFrame, keys: Callable[[str], set[str]]) -> DataFrame:
        def index(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = list(map(keys, batch.column(0).to_pylist()))
            at = pa.array(np.repeat(np.arange(len(sets)), list(map(len, sets))), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([k for s in sets for k in s], pa.string()), batch.column(0).take(at), batch.column(1).take(at)], ["key", "word", "n"])

        return map_arrow(df.select("word", "n"), "key string, word string, n long", index).select(F.xxhash64("key").alias("key"), "word", "n")

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        cost = pa.array([misreading(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.float64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cost, batch.column(2)], ["word", "good", "cost", "n_good"])

    good = indexed(usable.filter((F.col("n") >= LEAST) & ~F.col("word").rlike(r"[\d@|ſ]")), good_keys).select("key", F.col("word").alias("good"), F.col("n").alias("n_good"))
    most = F.lit(usable.agg(F.max("n")).first()[0] or 0)
    rare = usable.filter((LEAST + RATIO * (F.col("n") - 1) <= most) & ~F.col("word").rlike(NUMBER))
    near = indexed(rare, bad_keys).join(good, "key").filter((F.col("word") != F.col("good")) & (F.col("n_good") >= LEAST + RATIO * (F.col("n") - 1)) & (F.abs(F.length("word") - F.length("good")) <= 2))
    pairs = near.select("word", "good", "n_good").distinct()
    digits = F.translate("word", "loisbz", "101582")
    mixed = words.filter(F.col("word").rlike(NUMBER)).select("word", digits.alias("good"), F.lit(CONFUSED).alias("cost"), F.lit(0).cast("long").alias("n_good"))
    return mixed.unionByName(_weighed(pairs, weigh))


def _weighed(pairs: DataFrame, weigh: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    return map_arrow(pairs, "word string, good string, cost double, n_good long", weigh).filter(F.col("cost") <= MOST)


SOURCE = "field string, id long, document_id long, page int, place int, margin boolean, text string"
READ = (
    "field string, id long, document_id long, page int, place int, margin boolean, furniture boolean, first string, tail struct<a: string, mark: string>, "
    "headers array<struct<line: int, form: string, before: string, first: string, last: string, after: string, goes_on: boolean, parted: boolean>>, breaks array<struct<line: int, a: string, b: string, mark: string>>, "
    "lines array<int>, said string, word string, other string, n long"
)


def _read(df: DataFrame, held: int = HELD) -> DataFrame:
    """What each text has that is certain, and what has to be looked up; and how often its words and pairs of words stand in the texts.

    A row of a text has `said`: the words of each of `lines`, parted by blanks, the lines by line breaks, without the halves of
    divided words. A row with `n` counts `word`, or `word` followed by `other`, in some of the texts outside margins; words
    parted by a hyphen count as `a-b` too, words divided at the end of a line don't.
    """
    headers_type = pa.list_(pa.struct([("line", pa.int32()), *((f, pa.string()) for f in ("form", "before", "first", "last", "after")), ("goes_on", pa.bool_()), ("parted", pa.bool_())]))
    breaks_type = pa.list_(pa.struct([("line", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("mark", pa.string())]))
    names = "field id document_id page place margin furniture first tail headers breaks lines said word other n".split()
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.struct([("a", pa.string()), ("mark", pa.string())]), headers_type, breaks_type, pa.list_(pa.int32()), pa.string(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # All words in a row, runs parted by nulls.
        stream: list[pa.Array] = []

        def flush() -> Iterator[pa.RecordBatch]:
            all_words = pa.chunked_array(stream, pa.string()).combine_chunks().dictionary_encode() if stream else pa.array([], pa.string()).dictionary_encode()
            code = pc.fill_null(all_words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.bincount(code[code >= 0], minlength=len(all_words.dictionary))
            yield from counted(all_words.dictionary, pa.nulls(len(n), pa.string()), n)
            a, b = code[:-1], code[1:]
            both = (a >= 0) & (b >= 0)
            pair, times = np.unique(a[both] << 32 | b[both], return_counts=True)
            yield from counted(all_words.dictionary.take(pa.array(pair >> 32)), all_words.dictionary.take(pa.array(pair & 0xFFFFFFFF)), times)
            stream.clear()

        def counted(words: pa.Array, others: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(words), 100_000):
                part = words[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), t) for t in types[:13]] + [part, others[k : k + 100_000], pa.array(n[k : k + 100_000], pa.int64())], names)

        for batch in batches:
            has, first, tail, headers, breaks, lines_said, said = [], [], [], [], [], [], []
            words: list[str | None] = []
            for text, margin, page in zip(prepared(batch.column(6).to_pylist()), batch.column(5).to_pylist(), batch.column(3).to_pylist(), strict=True):
                lines = lines_of(text)
                if margin or not lines:
                    has.append(bool(lines))
                    first.append(None)
                    tail.append(None)
                    said.append(None)
                    for x in (headers, breaks, lines_said):
                        x.append([])
                    continue
                found = furniture(lines)
                has.append(bool(found) or (len(lines) == 1 and bool(NUMBERED.match(lines[0])) and lines[0][0] != "["))
                tokens = list(map(_tokens, lines))
                heads = []
                # A line that is all of a text on the first page is a title itself.
                for i in _alone(lines, found) if len(lines) > 1 or page else []:
                    head = dict.fromkeys(("before", "first", "last", "after", "goes_on", "parted")) | {"line": i, "form": normal(lines[i])}
                    # Only a line between two others, none of them a page number, can be told by what goes together around it.
                    if 0 < i < len(lines) - 1 and found.isdisjoint((i - 1, i + 1)) and tokens[i - 1] and tokens[i] and tokens[i + 1]:
                        head |= {"before": tokens[i - 1][-1], "first": tokens[i][0], "last": tokens[i][-1], "after": tokens[i + 1][0]} | _context(lines, i)
                    heads.append(head)
                kept = [i for i in range(len(lines)) if i not in found]
                first.append(next((tokens[i][0] for i in kept[:1] if tokens[i]), None))
                tail.append(None)
                cuts, at, parts = [], [], []
                for n, (ws, cut) in enumerate(_parts(lines, tokens, found)):
                    line = kept[n]
                    if ws:
                        at.append(line)
                        parts.append(" ".join(ws))
                        words += ws
                    if not cut:
                        continue
                    words.append(None)
                    if n + 1 < len(kept):
                        following = tokens[kept[n + 1]]
                        if following and lines[kept[n + 1]][:1].isalnum():
                            cuts.append({"line": line, "a": cut[0], "b": following[0], "mark": cut[1]})
                    else:
                        tail[-1] = {"a": cut[0], "mark": cut[1]}
                words.append(None)
                if "-" in text:
                    for a, b in COMPOUND.findall(text.lower()):
                        words += [f"{a}-{b}", None]
                headers.append(heads)
                breaks.append(cuts)
                lines_said.append(at)
                said.append("\n".join(parts))
            columns = [pa.array(x, t) for x, t in zip((has, first, tail, headers, breaks, lines_said, said), types[6:13], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).cast(t) for i, t in enumerate(types[:6])] + columns + [pa.nulls(len(has), t) for t in types[13:]], names)
            stream.append(pa.array(words, pa.string()))
            if sum(map(len, stream)) > held:
                yield from flush()
        yield from flush()

    return df.mapInArrow(run, READ)


def _slots(words: pa.Array, bits: int) -> np.ndarray:
    """The place in a filter of 2 ** bits places of each word."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    if not len(words) or ends[-1] == ends[0]:
        return np.zeros(len(words), np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    starts = ends[:-1] - ends[0]
    sizes = np.diff(ends)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    terms = (data.astype(np.uint64) + np.uint64(1)) * _powers()[place & 1023]
    full = sizes > 0
    h = np.zeros(len(words), np.uint64)
    h[full] = np.add.reduceat(terms, starts[full])
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


@lru_cache(1)
def _powers() -> np.ndarray:
    return np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(1024)], np.uint64)


def _filter(words: DataFrame, bits: int) -> np.ndarray:
    """A bit for the place of every word of the column `word`, as 64-bit integers; other words may share a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[_slots(batch.column(0), bits)] = True
        masks = np.packbits(seen, bitorder="little").view(np.int64)
        block = np.flatnonzero(masks)
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(masks[block])], ["block", "mask"])

    out = np.zeros(1 << bits - 6, np.int64)
    found = words.select("word").mapInArrow(run, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most 2 ** (bits - 6) rows
    out[found["block"].to_numpy()] = found["mask"].to_numpy()
    return out


def _asked(read: DataFrame, fixes: DataFrame, bits: int) -> DataFrame:
    """(field, id, line, before, word, after) of the words of `read` that may stand in `fixes`; a filter of fixed size lets a few others through."""
    sent = read.sparkSession.sparkContext.broadcast(_filter(fixes, bits))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = pc.split_pattern(batch.column(3), "\n")
        line = batch.column(2).flatten()
        text_of = np.repeat(np.arange(len(batch)), np.diff(batch.column(2).offsets.to_numpy()))
        split = pc.split_pattern(parts.flatten(), " ")
        words = split.flatten()
        part_of = np.repeat(np.arange(len(line)), np.diff(split.offsets.to_numpy()))
        slot = _slots(words, bits)
        at = np.flatnonzero((sent.value[slot >> 6] >> (slot & 63)) & 1)
        part = part_of[at]

        def beside(step: int) -> pa.Array:
            there = at + step
            ok = (there >= 0) & (there < len(words))
            ok[ok] = part_of[there[ok]] == part[ok]
            return words.take(pa.array(np.where(ok, there, 0), mask=~ok))

        row = pa.array(text_of[part])
        return pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), line.take(pa.array(part)), beside(-1), words.take(pa.array(at)), beside(1)], ["field", "id", "line", "before", "word", "after"])

    return map_arrow(read.filter("said <> ''").select("field", "id", "lines", "said"), "field string, id long, line int, before string, word string, after string", work)


class Scans:
    """The noise of a table of texts with columns as in SOURCE, worked out once and used by `noise` and `repaired`.

    `margin` says that a text stands in a page's margin. `titles` (document_id, form) are further headers that a document may
    have, normalised by `normal`. Null and empty texts have no noise. A repeated row is one case, though its words count again
    in the lexicon.
    """

    def __init__(self, texts: DataFrame, titles: DataFrame, filter_bits: int = FILTER_BITS, held: int = HELD) -> None:
        self.texts, self.filter_bits = texts, filter_bits
        read = written(_read(self.texts.select(*(c.split()[0] for c in SOURCE.split(", "))), held), "read")
        counts = read.filter("n is not null").groupBy("word", "other").agg(F.sum("n").alias("n"))
        counted = written(counts.filter("other is null or n >= %d" % TOGETHER), "words")
        self.words = counted.filter("other is null").select("word", "n")
        self.pairs = counted.filter("other is not null")
        self.fixes = written(corrections(self.words), "corrections")
        self.read = read.filter("n is null")
        self.headers = written(self._headers(titles), "headers")
        self.divided = written(self._divided(), "divided")

    def _n(self, df: DataFrame, out: str, *words: str) -> DataFrame:
        """`df` with the frequency of a word, or of two words in a row, as `out`."""
        if len(words) == 1:
            side = self.words.select(F.col("word").alias(words[0]), F.col("n").alias(out))
        else:
            side = self.pairs.select(F.col("word").alias(words[0]), F.col("other").alias(words[1]), F.col("n").alias(out))
        return df.join(side, list(words), "left").withColumn(out, F.coalesce(out, F.lit(0)))

    def _headers(self, titles: DataFrame) -> DataFrame:
        """(field, id, line) of headers that stand alone in a text."""
        asked = self.read.select("field", "id", "document_id", F.explode("headers").alias("h")).select("field", "id", "document_id", "h.*").filter(F.length("form") > 0)
        total = self.words.agg(F.sum("n")).first()[0] or 0
        form = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}]+", " "))
        known = self.texts.filter("margin").select("document_id", form.alias("form")).union(titles.select("document_id", "form")).filter(F.length("form") > 5).distinct()
        told = asked.join(known, ["document_id", "form"], "left_semi")
        asked = self._n(self._n(asked.filter("before is not null"), "often", "before"), "n_last", "last")
        for out, a, b in (("together", "before", "after"), ("into", "before", "first"), ("from", "last", "after")):
            asked = self._n(asked, out, a, b)
        flows = F.col("goes_on") & (F.col("together") >= TOGETHER) & (F.col("together") >= TOGETHER_SHARE * F.col("often"))
        apart = (flows | (F.col("parted") & (F.col("n_last") < NAME_SHARE * total))) & (F.col("into") < TOGETHER) & (F.col("from") < TOGETHER)
        return told.select("field", "id", "line").union(asked.filter(apart).select("field", "id", "line")).distinct()

    def _divided(self) -> DataFrame:
        """(field, id, line, a, b, joined, is_word, joined_good, n_joined, next): the words divided at the end of a line or (line null) of a text; `is_word` where the parts belong together without a hyphen; `next` the text where the second half stands."""
        inside = self.read.select("field", "id", F.explode("breaks").alias("x")).select("field", "id", "x.*")
        ends = self.read.filter("tail is not null").select("field", "id", "document_id", "page", "place", F.lit(None).cast("int").alias("line"), "tail.a", "tail.mark")
        # What follows is the next text of the page, or the first one of the next page.
        starts = self.read.filter("not margin and first is not null").select("field", "document_id", "page", "place", "first", F.col("id").alias("next"))
        ends = ends.filter("field = 'blocks.text'")
        same = starts.select("field", "document_id", "page", F.col("place").alias("place2"), F.col("first").alias("b1"), F.col("next").alias("id1"))
        near = ends.join(same, ["field", "document_id", "page"], "left").filter("place2 is null or place2 > place")
        near = ends.join(near.groupBy("field", "id").agg(F.min_by("b1", "place2").alias("b1"), F.min_by("id1", "place2").alias("id1")), ["field", "id"], "left")
        top = starts.groupBy("field", "document_id", "page").agg(F.min_by("first", "place").alias("b2"), F.min_by("next", "place").alias("id2")).withColumn("page", F.col("page") - 1)
        tails = near.join(top, ["field", "document_id", "page"], "left").select("field", "id", "line", "a", F.coalesce("b1", "b2").alias("b"), "mark", F.coalesce("id1", "id2").alias("next"))
        asked = inside.select("field", "id", "line", "a", "b", "mark", F.lit(None).cast("long").alias("next")).union(tails)
        asked = asked.withColumn("joined", F.concat("a", "b")).withColumn("hyphened", F.concat("a", F.lit("-"), "b"))
        for out, word in (("n_joined", "joined"), ("n_hyphened", "hyphened"), ("n_a", "a"), ("n_b", "b")):
            asked = self._n(asked, out, word)
        fixable = self.fixes.groupBy(F.col("word").alias("joined")).agg(F.min_by("good", F.struct("cost", -F.col("n_good"))).alias("joined_good"))
        asked = asked.join(fixable, "joined", "left")
        own = (F.col("n_hyphened") > 0) & (F.col("n_hyphened") >= F.col("n_joined"))
        two_words = (F.col("n_joined") == 0) & F.col("joined_good").isNull() & (F.col("n_a") >= LEAST) & (F.col("n_b") >= LEAST)
        plain = F.col("mark") == DIVIDED
        return asked.select("field", "id", "line", "a", "b", "joined", (plain | (~own & ~two_words) | F.col("b").isNull()).alias("is_word"), "joined_good", "n_joined", "next")

    def misread(self) -> DataFrame:
        """(field, id, line, word, good, cost): misread words outside headers, each with the correction that costs least and goes best with its neighbours."""
        asked = _asked(self.read, self.fixes, self.filter_bits).join(self.fixes, "word")
        asked = asked.join(self.headers, ["field", "id", "line"], "left_anti")
        halves = self.divided.filter("next is not null").select("field", F.col("next").alias("id"), F.col("b").alias("word"))
        asked = asked.join(halves, ["field", "id", "word"], "left_anti")
        left = self.pairs.select(F.col("word").alias("before"), F.col("other").alias("good"), F.col("n").alias("n_before"))
        right = self.pairs.select(F.col("word").alias("good"), F.col("other").alias("after"), F.col("n").alias("n_after"))
        asked = asked.join(left, ["before", "good"], "left").join(right, ["good", "after"], "left")
        rank = F.struct(F.round("cost", 3), -(F.coalesce("n_before", F.lit(0)) + F.coalesce("n_after", F.lit(0))), -F.col("n_good"), "good")
        return asked.groupBy("field", "id", "line", "word").agg(F.min_by("good", rank).alias("good"), F.min("cost").alias("cost"))

    def noise(self) -> DataFrame:
        """(field, row_id, noise): see TESTDATA's problem of scanned text."""
        case = lambda df, name: df.select("field", F.col("id").alias("row_id"), F.lit(name).alias("noise"))
        halves = self.divided.join(self.fixes.select(F.col("word").alias("joined")).distinct(), "joined", "left_semi").filter("is_word and n_joined = 0")
        return (
            case(self.read.filter("furniture"), "furniture")
            .union(case(self.headers, "furniture"))
            .union(case(self.divided.filter("is_word"), "hyphen"))
            .union(case(self.misread(), "misread"))
            .union(case(halves, "misread"))
            .distinct()
        )

    def repaired(self) -> DataFrame:
        """(field, row_id, text, continued): each text as one readable paragraph; null where nothing but headers and numbers
        was in it. `continued` says that its last word goes on in the next text; the second half stays there."""
        fixes = self.misread().groupBy("field", "id").agg(F.collect_list(F.struct("line", "word", "good")).alias("fixes"))
        heads = self.headers.groupBy("field", "id").agg(F.collect_set("line").alias("heads"))
        cuts = self.divided.groupBy("field", "id").agg(F.collect_list(F.struct("line", "is_word", "joined", "joined_good", "n_joined")).alias("cuts"))
        rows = self.texts.dropDuplicates(["field", "id"]).join(fixes, ["field", "id"], "left").join(heads, ["field", "id"], "left").join(cuts, ["field", "id"], "left").select("field", "id", "margin", "text", "fixes", "heads", "cuts")

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, goes_on = [], []
            rest = [batch.column(i).to_pylist() for i in (2, 4, 5, 6)]
            for text, margin, fix, head, cut in zip(prepared(batch.column(3).to_pylist()), *rest, strict=True):
                new, on = repair(text, bool(margin), fix or [], set(head or []), cut or [])
                texts.append(new)
                goes_on.append(on)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(goes_on, pa.bool_())], ["field", "row_id", "text", "continued"])

        return map_arrow(rows, "field string, row_id long, text string, continued boolean", work)


def _cased(good: str, like: str) -> str:
    if like.isupper() and len(like) > 1:
        return good.upper()
    return good[:1].upper() + good[1:] if like[:1].isupper() else good


def repair(text: str, margin: bool, fixes: list[dict], heads: set[int], cuts: list[dict]) -> tuple[str | None, bool]:
    """One text as a paragraph, and whether its last word goes on in the next text."""
    if margin:
        return None, False
    lines = lines_of(text)
    skip = furniture(lines) | heads
    good = {(f["line"], f["word"]): f["good"] for f in fixes}
    cut = {c["line"]: c for c in cuts}
    out, glue = "", " "
    for i, line in enumerate(lines):
        if i in skip:
            continue
        new = TOKEN.sub(lambda m, i=i: _cased(good[i, m.group().lower()], m.group()) if (i, m.group().lower()) in good else m.group(), line)
        out += (glue if out else "") + new
        glue = " "
        if i in cut and END.search(new):
            out = re.sub(f"[-{DIVIDED}]\\s*$", "", out) + ("" if cut[i]["is_word"] else "-")
            glue = ""
    on = None in cut and bool(END.search(out))
    if on and cut[None]["is_word"]:
        out = re.sub(f"[-{DIVIDED}]\\s*$", "", out)
    return (re.sub(r"\s+", " ", out).replace(DIVIDED, "-").strip() or None), on


def sources(blocks: DataFrame, segments: DataFrame, height: float = 800.0) -> DataFrame:
    """`blocks` and `segments` (tables as in TESTDATA) as texts with the columns of SOURCE; image blocks are left out."""
    low, high = MARGIN * height, (1 - MARGIN) * height
    margin: Column = F.coalesce((F.col("y0") < low) | (F.col("y0") > high), F.lit(False))
    a = blocks.filter(F.coalesce("block_type", F.lit(0)) == 0).select(F.lit("blocks.text").alias("field"), F.col("block_id").alias("id"), "document_id", F.col("page_index").alias("page"), F.col("block_index").alias("place"), margin.alias("margin"), "text")
    b = segments.select(F.lit("text_segments.text").alias("field"), F.col("segment_id").alias("id"), "document_id", "page", F.col("segment_index").alias("place"), F.lit(False).alias("margin"), "text")
    return a.union(b)
