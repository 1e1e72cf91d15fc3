"""Keyword-stuffed and link-list pages.

Method: each page's suffix automaton, over its words. A string of words that stands k times in a page holds only pairs of
words that stand k times, so the automaton is built over the stretches of such pairs; as far as strings repeated k times go
it is the automaton of the page. The characters covered by maximal repeated strings are weighed together with what lacks
clauses: links, tags, price lists and rows of words that are no sentences. What a sentence is, is told by its shape - its
length, how it ends, how many of its words begin small, how few commas it has - in any language; unpunctuated text counts too
where the small words of a known language are dense in it. Lists that scholars make - bibliographies, contents, indexes,
tables - lack clauses too and are told apart by their lines.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_arrow

# Frequent small words of the seven languages, by language.
SMALL_WORDS = {
    "en": "the of and to in is that it was for with as on by this be are from at which an or not were has had have been but than can its may what who when",
    "de": "der die das und in den von zu mit dem des ist im für auf ein eine nicht als auch es an wird dass sich bei nach aus hat wie man nur war sind oder wenn",
    "fr": "le la les de des et en un une du dans que qui est pour par sur au aux plus ne pas il ce se avec sont son sa ou cette été dont",
    "es": "el la los las de del y en un una que es se por con para al lo no su como más fue ha o esta este han sido sin sobre entre",
    "it": "il lo la i gli le di del della dei e in un una che è per con al da si non nel alla come più sono ha o dal sul fu",
    "nl": "de het een van en in is dat op te met voor niet aan er zijn door als bij ook uit naar of om wordt werd deze die maar men",
    "pt": "o a os as de do da dos das e em um uma que é se por com para ao no na não como mais foi são ou sua pelo à",
}
FUNCTION = frozenset(w for words in SMALL_WORDS.values() for w in words.split())

WORD = re.compile(r"[^\W_]+")
LINK = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)+/\S*")
TAG = re.compile(r"(?<!\S)[#@]\w+")
PRICE = re.compile(r"(?:\b(?:EUR|USD|GBP|CHF)\b|[€$£])\s?\d|\d\s?(?:€|\$|£|EUR\b|USD\b|GBP\b|CHF\b)|\bSKU\b")
YEAR = re.compile(r"(?<!\d)(?:1[4-9]\d\d|20\d\d)(?!\d)")
#: A person's name as bibliographies begin with it, or a number in brackets.
CITED = re.compile(r"^[^\S\n]*(?:\[?\d{1,3}[\].)][^\S\n]*)?[^\W\d_][\w'’-]+(?: [^\W\d_][\w'’-]+)?, ?[^\W\d_]\.|^[^\S\n]*\[\d{1,3}\]", re.MULTILINE)
#: The end of an index or contents line: page numbers after words; or a numbered heading with one.
PAGED = re.compile(r"[^\W\d_].*?(?:, ?|[.…]{2,} ?|[ .…]{3,}|\t|  )\d+(?:[-–]\d+)?$|^\d+(?:\.\d+)*\.? [^\W\d_].*[ .]\d+$")
#: Lines that end in a number.
LISTED = re.compile(r"^.*\d$", re.MULTILINE)
BLANK = re.compile(r"\n\s*\n")
LINES = re.compile("[\r\n\x85\u2028\u2029]+")
CELLS = re.compile(r"\t|\s{2,}|;|\|")

SENTENCE_END = re.compile(r"(?<=[.?!…:。！？।؟։])[\"'»”’)\]]*\s+")
#: Characters of scripts that write without blanks.
SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")

#: Words of a paragraph that counts as running text; of a sentence.
LEAST_WORDS, SENTENCE = 20, (5, 120)
#: Share of a page's characters that lack clauses, or are covered by dense strings, from which on it is unwanted; share of small words that make clauses without punctuation.
SPAM_SHARE, COVERED, SMALL_SHARE = 0.5, 0.42, 0.25
#: Times that a repeated string stands; words for each time it stands if it is dense; share covered by repeated strings, dense or not, that no text has.
REPEATED, DENSE_RATE, ALL_COVERED = 4, 50, 0.85


def covered(words: list[str], *least: int) -> list[int]:
    """Characters covered by the maximal strings of two words or more that stand at least so many times in `words`, for each of `least`, the smallest first."""
    n = len(words)
    often = {w for w, k in Counter(words).items() if k >= least[0]}
    pairs = Counter(p for p in zip(words, words[1:], strict=False) if p[0] in often and p[1] in often)
    strong = {p for p, k in pairs.items() if k >= least[0]}
    if not strong:
        return [0] * len(least)
    # The generalised suffix automaton of the stretches of such pairs.
    step: list[dict[str, int]] = [{}]
    link, length, times = [-1], [0], [0]
    ends: list[int] = []
    states: list[int] = []
    last, before = 0, False
    for i in range(n):
        now = i < n - 1 and (words[i], words[i + 1]) in strong
        if not (now or before):
            last = 0
            continue
        if not before:
            last = 0
        c = words[i]
        before = now
        p = last
        q = step[p].get(c)
        if q is not None and length[q] == length[p] + 1:
            last = q
        else:
            if q is None:
                cur = len(length)
                step.append({})
                length.append(length[p] + 1)
                link.append(0)
                times.append(0)
                while p != -1 and c not in step[p]:
                    step[p][c] = cur
                    p = link[p]
                if p != -1:
                    q = step[p][c]
            else:
                cur = -1
            if q is not None:
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(length)
                    step.append(step[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    times.append(0)
                    while p != -1 and step[p].get(c) == q:
                        step[p][c] = clone
                        p = link[p]
                    link[q] = clone
                    if cur == -1:
                        cur = clone
                    else:
                        link[cur] = clone
            last = cur
        times[last] += 1
        ends.append(i)
        states.append(last)
    order = sorted(range(1, len(length)), key=length.__getitem__)
    for s in reversed(order):
        if link[s] > 0:
            times[link[s]] += times[s]
    sizes = np.fromiter(map(len, words), np.int64, n)
    return [_marked(sizes, least_, order, length, link, times, ends, states) for least_ in least]


def _marked(sizes: np.ndarray, least: int, order: list[int], length: list[int], link: list[int], times: list[int], ends: list[int], states: list[int]) -> int:
    reach = [0] * len(length)
    for s in order:
        reach[s] = length[s] if times[s] >= least else reach[link[s]]
    mark = np.zeros(len(sizes) + 1, np.int64)
    for e, s in zip(ends, states, strict=True):
        if (size := reach[s]) >= 2:
            mark[e - size + 1] += 1
            mark[e + 1] -= 1
    return int(sizes[np.cumsum(mark[:-1]) > 0].sum())


def sentence_words(block: str) -> int:
    """The words of a block that stand in what has the shape of a sentence."""
    if block.isupper():
        block = block.lower()
    total = 0
    for part in SENTENCE_END.split(block):
        words = part.split()
        n = len(words) if part.isascii() else len(words) + len(SPACELESS.findall(part)) // 2
        if not SENTENCE[0] <= n <= SENTENCE[1] or part.rstrip("\"'»”’)] \r\n")[-1:] not in ".?!…:。！？।؟։":
            continue
        small = sum(w[0].isalpha() and not w[0].isupper() for w in words)
        if 2 * small >= len(words) and 3 * sum(map(part.count, ",;|/")) <= n:
            total += n
    return total


@dataclass
class Page:
    """Characters of a page's words, by kind."""

    chars: int = 0
    links: int = 0
    tags: int = 0
    scholarly: int = 0
    clauses: int = 0
    loose: int = 0
    repeated: int = 0
    dense: int = 0

    @property
    def is_spam(self) -> bool:
        """What lacks clauses and what dense strings cover are, together, most of the page; or repeated strings cover nearly all of it."""
        if not self.chars or self.scholarly >= SPAM_SHARE * self.chars:
            return False
        lacking = (self.links + self.tags + self.loose) / self.chars
        rest = max(0.0, 1 - lacking - self.scholarly / self.chars)
        return lacking / SPAM_SHARE + rest * self.dense / self.chars / COVERED > 1 or self.repeated > ALL_COVERED * self.chars


def _scholarly(line: str) -> bool:
    if PRICE.search(line):
        return False
    line = line.strip()
    if CITED.search(line) or (line[-1:].isdigit() and "|" not in line and PAGED.search(line)):
        return True
    bare = LINK.sub(" ", line)
    cells = [c for c in CELLS.split(bare) if c.strip()]
    if len(cells) >= 3 and 2 * sum(c.strip()[0].isdigit() for c in cells) >= len(cells):
        return True
    return bool(YEAR.search(bare)) and len(WORD.findall(bare)) >= 4


def read_page(text: str, running: list[list[str]] | None = None) -> Page:
    """The kinds of a page's characters. `running` gets the words of each block of clauses of at least LEAST_WORDS words."""
    page = Page()
    words: list[str] = []
    for block in BLANK.split(text):
        flat = WORD.findall(block.lower())
        if not flat:
            continue
        total = sum(map(len, flat))
        page.chars += total
        words += flat
        links = sum(len("".join(WORD.findall(x))) for x in LINK.findall(block)) if "://" in block or "www." in block or "/" in block else 0
        if 2 * links < total and _has_clauses(block, flat):
            n_lines = 1 + block.count("\n")
            if 2 * len(CITED.findall(block)) > n_lines or 2 * sum(bool(PAGED.search(x)) for x in LISTED.findall(block)) > n_lines:
                page.scholarly += total
            else:
                page.clauses += total
                if running is not None and len(flat) >= LEAST_WORDS and len(block.split()) >= LEAST_WORDS:
                    running.append(flat)
            continue
        # No clauses here: a heading, a list of scholars, or something else, line by line.
        lines = [x for x in LINES.split(block) if x.strip()]
        if len(lines) >= 3 and 2 * sum(map(_scholarly, lines)) >= len(lines):
            page.scholarly += total
            continue
        page.links += links
        tags = sum(len(x) - 1 for x in TAG.findall(block))
        page.tags += tags
        if len(flat) >= 12 or links or tags:
            page.loose += max(0, total - links - tags)
    page.repeated, page.dense = covered(words, REPEATED, max(REPEATED, -(-len(words) // DENSE_RATE)))
    return page


def _has_clauses(block: str, words: list[str]) -> bool:
    if 2 * sentence_words(block) >= len(block.split()):
        return True
    return len(words) >= 8 and sum(map(FUNCTION.__contains__, words)) >= SMALL_SHARE * len(words)


def page_kinds(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each row's key with the shares of its characters that are links, tags, scholarly lists, clauses, loose words, covered
    by strings that stand REPEATED times (`repeated`) and also once in every DENSE_RATE words (`dense`), and `spam`.

    A null, empty or blank text has no characters, shares of 0 and is no spam. Repeated rows stay repeated; other columns
    are left out.
    """
    names = ["links", "tags", "scholarly", "clauses", "loose", "repeated", "dense"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pages = [read_page(t or "") for t in batch.column(1).to_pylist()]
        shares = [pa.array([getattr(p, n) / max(1, p.chars) for p in pages], pa.float64()) for n in names]
        return pa.RecordBatch.from_arrays([batch.column(0), *shares, pa.array([p.is_spam for p in pages], pa.bool_())], [key, *names, "spam"])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(F.col(key), F.col(text).cast("string")), f"`{key}` {kind}, " + ", ".join(f"{n} double" for n in names) + ", spam boolean", work)
