"""References linked to the records of another source that has no key in common with them.

Method: the character pairs of a record's attributes are set as bits of a vector of fixed length. Two titles that differ
in at most r bits agree in at least two of r + 2 parts of their vectors, so that joining on every two parts and counting the
differing bits finds all close pairs exactly; for references without any, a second index over title, first author and year
together allows more differences. The pairs' Dice scores by attribute are weighted, which ranks the candidates of a reference, and turned into confidences by
fitting their levels of agreement as a mixture of matches and others.

A printed reference is first taken apart into the strings that may be its title, since the parsed title may be missing or
wrong. Vectors are made and joined for distinct strings only, so that a work that is cited by a third of all references weighs
no more than another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import written

from .arrow import code_points, map_arrow
from .lookalike import same_look
from .names import SMALL, TITLES, plain

#: 64-bit words of the title's vector, of the vector of title, author and year, and of that of the authors; the radius of the first two is their words less one.
TITLE_WORDS, RECORD_WORDS, AUTHOR_WORDS = 8, 16, 4
#: The filter of the parts that can meet has 2 ** FILTER_BITS places.
FILTER_BITS = 25
#: Weights of title, authors and year; the least confidence of a link.
WEIGHTS, CONFIDENT = (0.6, 0.25, 0.15), 0.5
#: Least title score of a pair that is looked at.
LEAST_TITLE = 0.6

YEAR = re.compile(r"(?<!\d)(?:1[4-9]\d\d|20\d\d)(?!\d)")
_ROMAN = "i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii"
#: Words that count the parts and editions of a work, in the seven languages; a scanner may have read l or 1 for i.
PART = re.compile(r"\b(?:part[ei]?|teil|teii|tl|partie|deel|dl)\s+([ivxl1]{1,4}|\d{1,2})\b")
#: Words that count volumes; outside the title they count those of a journal.
VOLUME = re.compile(r"\b(?:tome|tomo|band|bd|volume|vol|book|buch)\s+([ivxl1]{1,4}|\d{1,2})\b")
EDITION = re.compile(r"\b(\d{1,2}|se[ck]\w{1,3}d\w?|th\w?rd|zw\w?it\w|dr\w?tt\w|deu?x\w{2,5}|tro\w{1,3}eme|segund\w|terc\w{1,2}ra|terza|tw\w{2}de|d\w?rde)\s*(?:st|nd|rd|th|a|e|eme|ste|de)?\s*(?:rev\w*|erw\w*|verb\w*)?\s*(?:ed|edn|\w{1,2}?d\w?[tcz]\w{2,5}|aufl\w*|druk|uitg\w*)\b")
_NUMBERS = {w: str(i + 1) for i, w in enumerate(_ROMAN.split("|"))}


def folded(texts: list[str | None]) -> list[str]:
    """Texts in lower case, without accents and punctuation."""
    return list(map(_fold, same_look([t or "" for t in texts])))


def _fold(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", plain(text)))


def _number(m: str) -> str:
    return _NUMBERS.get(m.replace("l", "i").replace("1", "i"), m)


def text_marks(text: str) -> set[str]:
    """The parts and editions that a folded text names."""
    nth = lambda m: m if m.isdigit() else "3" if m[:2] in ("th", "dr", "te", "de") and not m.startswith("deu") or m.startswith("tro") else "2"
    return {"p" + _number(m) for m in PART.findall(text)} | {"e" + nth(m) for m in EDITION.findall(text)}


def marks(text: str, title: str, named: set[str] | None = None) -> str:
    """The parts and editions that a folded text names (`named`, if they are known), and the volume that a folded title names."""
    return " ".join(sorted((text_marks(text) if named is None else named) | {"v" + _number(m) for m in VOLUME.findall(title)}))


def title_candidates(raw: str, title: str | None) -> list[str]:
    """The strings that may be the title of a printed reference: the parsed title, and whatever stands where one of the styles has the title.

    A reference's style is not known, since initials, abbreviations and quotations make one look like another, so that all styles are tried.
    """
    out = [title] if title else []
    raw = re.sub(r"^\s*(?:\[\d+\]|\(\d+\)|\d+\.)\s*", "", raw.replace("\n", " ").replace("\r", " ")).strip()
    out += re.findall(r"[\"“„«»”]\s*([^\"“”„«»]{8,}?)[,.]?\s*[\"”“«»]", raw)
    if " / " in raw:
        out.append(raw.split(" / ")[0])
    if m := re.search(r"\(\D{0,4}\d{4}\w?\)[.,:]?\s+(.+)", raw):
        tail = m.group(1)
        out += [tail[: x.start()] for x in re.finditer(r"[.?!]\s", tail)] or [tail]
    if m := re.search(r"^[^:]{3,}?:\s+(.+?)[.,]\s+In:?\s", raw):
        parts = re.split(r":\s+", m.group(0))
        # An organisation may be written with a colon of its own.
        out += [m.group(1)] + ([": ".join(parts[2:]).rsplit("In", 1)[0]] if len(parts) > 2 else [])
    if m := re.search(r"^[^:]{3,}?:\s+(.+?)(?:\.\s|$)", raw):
        out.append(m.group(1))
    out += [s for s in re.split(r"\.\s+", raw) if len(s) >= 8]
    # Names, title, place and year, parted by commas: the title begins after one of the commas.
    pieces = re.split(r"[,;]\s+", re.sub(r",\s*[^,]*$", "", raw))
    out += [", ".join(pieces[k:]) for k in range(1, len(pieces))]
    return list(dict.fromkeys(out)) or [raw]


def surname(name: str) -> str:
    """The folded family name of a folded person, from a name in any order; the longest word where that is open."""
    head, comma, _ = name.partition(",")
    words = [w for w in re.findall(r"[^\W\d_]+", plain(head if comma else name)) if w not in TITLES and w not in SMALL]
    if not words:
        return ""
    if comma:
        return max(words, key=len)
    long = [w for w in words if len(w) > 2]
    return long[-1] if long else words[-1]


def _long(name: str) -> str:
    """The words of a name that have more than one letter, folded."""
    return " ".join(w for w in re.findall(r"[^\W\d_]+", plain(name)) if len(w) > 1 and w not in TITLES and w not in SMALL)


def bits(texts: list[str], words: int, seed: int, into: np.ndarray | None = None) -> np.ndarray:
    """Bit vectors of the texts' padded character pairs, `words` 64-bit words each, added to `into`."""
    codes, starts = code_points([f" {t} " if t else "" for t in texts])
    flat = np.zeros((len(texts), words * 64), np.uint8)
    if len(codes) > 1:
        row = np.repeat(np.arange(len(texts)), np.diff(starts))
        same = row[:-1] == row[1:]
        h = (codes[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(seed * 0x165667B19E3779F9 % (1 << 64))
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h >>= np.uint64(33)
        flat[row[:-1][same], (h % np.uint64(words * 64)).astype(np.int64)[same]] = 1
    out = np.packbits(flat, axis=1).view(np.int64)
    return out if into is None else into | out


def _record_bits(titles: list[str], names: list[str], years: list[str]) -> np.ndarray:
    out = bits(titles, RECORD_WORDS, 1)
    out = bits(names, RECORD_WORDS, 2, out)
    digits = ["".join(chr(97 + 10 * i + int(c)) for i, c in enumerate(y)) if y else "" for y in years]
    # Each digit with its place is a feature of its own.
    for i in range(4):
        out = bits([d[i : i + 1] and d[i] * 2 for d in digits], RECORD_WORDS, 3 + i, out)
    return out


def _words(column: pa.Array, words: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), words)


def _parts(v: np.ndarray, radius: int) -> np.ndarray:
    """The keys of each vector: a hash of every two of its radius + 2 parts.

    Of so many parts two at least are equal in vectors that differ in at most `radius` bits; a single part of a short title
    holds a bit or none and is shared by many, two together are not.
    """
    bits_ = v.shape[1] * 64
    edges = np.linspace(0, bits_, radius + 3).astype(np.int64)
    flat = np.unpackbits(np.ascontiguousarray(v).view(np.uint8), axis=1)
    parts = np.zeros((len(v), radius + 2), np.uint64)
    for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        whole = np.zeros((len(v), 8), np.uint8)
        packed = np.packbits(flat[:, low:high], axis=1)
        whole[:, : packed.shape[1]] = packed
        parts[:, k] = whole.view(np.uint64)[:, 0]
    one, two = np.triu_indices(radius + 2, 1)
    salt = (np.arange(1, len(one) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    h = (parts[:, one] ^ salt) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = (h + parts[:, two]) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _places(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter(df: DataFrame) -> np.ndarray:
    """A bit for the place of every `part` of `df`, as 64-bit words; other parts may share a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            seen[_places(batch.column(0).to_numpy().view(np.uint64))] = True
        masks = np.packbits(seen, bitorder="little").view(np.int64)
        block = np.flatnonzero(masks)
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(masks[block])], ["block", "mask"])

    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    found = df.select("part").mapInArrow(run, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most 2 ** (FILTER_BITS - 6) rows
    out[found["block"].to_numpy()] = found["mask"].to_numpy()
    return out


def close_pairs(left: DataFrame, right: DataFrame, words: int, radius: int | None = None) -> DataFrame:
    """(l, r) for all rows of `left` and `right` (`key`, `v` of `words` integers, distinct) whose vectors differ in at most `radius` bits (one less than `words`, if it is not given).

    Parts of `left` that a filter of fixed size shows to stand nowhere in `right` are left out of the join; the vectors are
    fetched for the pairs that meet.
    """

    radius = words - 1 if radius is None else radius

    def keyed(df: DataFrame, mask: Broadcast[np.ndarray] | None) -> DataFrame:
        def look(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            v = _words(batch.column(1), words)
            for start in range(0, len(v), 4096):
                some = v[start : start + 4096]
                keys, fold = _parts(some, radius), np.bitwise_xor.reduce(some, axis=1)
                place = _places(keys)
                row, at = np.nonzero((mask.value[place >> 6] >> (place & 63)) & 1) if mask else np.divmod(np.arange(keys.size), keys.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + start)), pa.array(keys[row, at].view(np.int64)), pa.array(fold[row])], ["key", "part", "fold"])

        return map_arrow(df.select("key", "v"), "key long, part long, fold long", look)

    ours = written(keyed(right, None), "parts")
    sent = left.sparkSession.sparkContext.broadcast(_filter(ours))
    # The words of a vector folded into one differ in no more bits than the vectors.
    met = keyed(left, sent).select(F.col("key").alias("l"), "part", F.col("fold").alias("lf")).join(ours.select(F.col("key").alias("r"), "part", F.col("fold").alias("rf")), "part")
    met = met.filter(F.bit_count(F.col("lf").bitwiseXOR(F.col("rf"))) <= radius).select("l", "r").distinct()
    both = met.join(left.select(F.col("key").alias("l"), F.col("v").alias("lv")), "l").join(right.select(F.col("key").alias("r"), F.col("v").alias("rv")), "r")
    differ = sum((F.bit_count(F.col("lv")[i].bitwiseXOR(F.col("rv")[i])) for i in range(1, words)), F.bit_count(F.col("lv")[0].bitwiseXOR(F.col("rv")[0])))
    return both.filter(differ <= radius).select("l", "r")


def _vectors(df: DataFrame, words: int) -> DataFrame:
    """(key, v) of the distinct rows (key, title, name, year) of `df`; the key is a hash."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        titles, names, years = (batch.column(i).to_pylist() for i in (1, 2, 3))
        v = bits(titles, TITLE_WORDS, 0) if words == TITLE_WORDS else _record_bits(titles, names, years)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, v.size + 1, words, dtype=np.int32), pa.array(v.ravel()))], ["key", "v"])

    return map_arrow(df.select("key", "title", "name", "year"), "key long, v array<long>", work)


READ = "id long, title string, name string, year string, years array<string>, authors array<string>, marks string"


def _references(df: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, raws, titles, years, authors = (batch.column(i).to_pylist() for i in range(5))
        raws, titles = same_look([r or "" for r in raws]), same_look([t or "" for t in titles])
        out = []
        for k, raw, title, year, names in zip(ids, raws, titles, years, authors, strict=True):
            found = YEAR.findall(year or "") or YEAR.findall(raw)
            named = [n for n in names or [] if n and not re.match(r"(?i)^\W*(?:et al|u\.? ?a)\b", n) and surname(n)]
            people = [_long(n) for n in named]
            given = [t for t in dict.fromkeys(map(_fold, title_candidates(raw, title))) if len(t) >= 8]
            whole = _fold(raw)
            first = surname(named[0]) if named else surname(re.split(r"[;&]|\band\b|\bund\b|,\s+(?=\S+\s+\S)|[.:(\"/]\s", re.sub(r"^\s*(?:\[\d+\]|\d+\.)\s*", "", raw))[0])
            named_marks, all_years = text_marks(whole), sorted(set(found))
            out += [(k, t, first, found[0] if found else "", all_years, people, marks(whole, t, named_marks)) for t in given]
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [f.split()[0] for f in READ.split(", ")])

    return map_arrow(df, READ, work)


def _works(df: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, titles, years, authors = (batch.column(i).to_pylist() for i in range(4))
        out = []
        for k, title, year, names in zip(ids, folded(titles), years, authors, strict=True):
            named = [n for n in names or [] if n and surname(n)]
            people = [_long(n) for n in named]
            if title:
                out.append((k, title, surname(named[0]) if named else "", str(year) if year else "", [str(year)] if year else [], people, marks(title, title)))
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [f.split()[0] for f in READ.split(", ")])

    return map_arrow(df, READ, work)


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # Of negative integers bitwise_count counts the bits of the absolute value.
    return tuple(np.bitwise_count(x.view(np.uint64)).sum(axis=1, dtype=np.int64) for x in (a & b, a, b))


def _scores(pairs: DataFrame) -> DataFrame:
    """(ref_id, work_id, score, title, author, year): the field-weighted score of each pair, and the fields' own; -1 where one side has no value.

    Titles have the Dice coefficient of their bits. Of authors, whose given names are often initials, the words of more than
    one letter are compared, and the common bits divided by the fewer; years are equal (1), a year apart (0.5) or not (0).
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        titles, others, people, makers, years, own = (batch.column(i).to_pylist() for i in range(2, 8))
        common, na, nb = _common(bits(titles, TITLE_WORDS, 0), bits(others, TITLE_WORDS, 0))
        title = 2 * common / np.maximum(na + nb, 1)
        # The first authors are compared, as many as the reference names.
        a = [" ".join(p) for p in people]
        b = [" ".join(m[: len(p)]) for p, m in zip(people, makers, strict=True)]
        common, na, nb = _common(bits(a, AUTHOR_WORDS, 5), bits(b, AUTHOR_WORDS, 5))
        author = np.where((na > 0) & (nb > 0), common / np.maximum(np.minimum(na, nb), 1), -1.0)
        year = np.array([-1.0 if not (x and y) else max({0: 1.0, 1: 0.5}.get(abs(int(z) - int(y[0])), 0.0) for z in x) for x, y in zip(years, own, strict=True)])
        parts = np.stack([title, author, year])
        weight = np.array(WEIGHTS)[:, None] * (parts >= 0)
        score = (weight * parts).sum(axis=0) / weight.sum(axis=0)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (score, title, author, year))], ["ref_id", "work_id", "score", "title", "author", "year"])

    return map_arrow(pairs, "ref_id long, work_id long, score double, title double, author double, year double", work)


#: Levels of agreement of a field: the least value of each, best first; the last is that of a missing value.
LEVELS = {"title": (0.97, 0.9, 0.8, 0.0), "author": (0.75, 0.5, 0.0, -1.0), "year": (1.0, 0.5, 0.0, -1.0)}
#: What is expected of matches and of other pairs before any was seen, and the pairs that this is worth.
MATCHES = {"title": (0.75, 0.18, 0.06, 0.01), "author": (0.82, 0.06, 0.02, 0.1), "year": (0.8, 0.05, 0.02, 0.13)}
OTHERS = {"title": (0.05, 0.1, 0.25, 0.6), "author": (0.05, 0.1, 0.75, 0.1), "year": (0.03, 0.04, 0.8, 0.13)}
PRIOR = 200.0


def calibration(counts: dict[tuple[int, int, int], int]) -> dict[tuple[int, int, int], float]:
    """The probability that pairs with given levels of agreement match, by expectation maximisation over the counts of pairs by
    their levels, in which the fields are taken to be independent among matches and among others."""
    fields = list(LEVELS)
    p_match, p_other, share = {f: np.array(MATCHES[f]) for f in fields}, {f: np.array(OTHERS[f]) for f in fields}, 0.5
    patterns = np.array(list(counts), np.int64).reshape(-1, 3)
    n = np.array(list(counts.values()), float)
    posterior = np.zeros(len(n))
    for _ in range(50):
        m = share * np.prod([p_match[f][patterns[:, i]] for i, f in enumerate(fields)], axis=0)
        u = (1 - share) * np.prod([p_other[f][patterns[:, i]] for i, f in enumerate(fields)], axis=0)
        posterior = m / (m + u)
        share = float((PRIOR / 2 + (posterior * n).sum()) / (PRIOR + n.sum()))
        for i, f in enumerate(fields):
            for table, start, weight in ((p_match, MATCHES, posterior * n), (p_other, OTHERS, (1 - posterior) * n)):
                seen = np.bincount(patterns[:, i], weight, len(LEVELS[f])) + PRIOR * np.array(start[f])
                table[f] = seen / seen.sum()
    return {tuple(p): float(c) for p, c in zip(patterns.tolist(), posterior, strict=True)}


def links(references: DataFrame, works: DataFrame) -> DataFrame:
    """(ref_id, work_id, confidence): the record that each reference is most likely to cite.

    `references` has ref_id, raw, title, year (text) and authors, `works` work_id, title, year and authors. Nulls in any field
    leave that field out; a reference without raw and title, or a work without title, has no link; repeated rows count once; ties
    go to the smaller work_id; an empty table gives an empty result. Works whose part or edition differs from the
    reference's are no candidates.
    """
    refs = written(_references(references.select("ref_id", "raw", "title", "year", "authors").dropDuplicates(["ref_id"])), "references")
    own = written(_works(works.select("work_id", "title", F.col("year").cast("string"), "authors").dropDuplicates(["work_id"])), "works")
    titles = lambda df: df.select(F.xxhash64("title").alias("key"), "title", F.lit("").alias("name"), F.lit("").alias("year")).distinct()
    record_key = F.xxhash64("title", "name", "year")
    records = lambda df: df.filter("name <> '' or year <> ''").select(record_key.alias("key"), "title", "name", "year").distinct()
    close = lambda a, b, words: close_pairs(written(_vectors(a, words), "vectors"), written(_vectors(b, words), "vectors"), words)
    by_title = close(titles(refs), titles(own), TITLE_WORDS)
    left = refs.select(F.col("id").alias("ref_id"), F.col("title").alias("lt"), F.xxhash64("title").alias("lh"), record_key.alias("lk"), F.col("authors").alias("la"), F.col("years").alias("ly"), F.col("marks").alias("lm"))
    right = own.select(F.col("id").alias("work_id"), F.col("title").alias("rt"), F.xxhash64("title").alias("rh"), record_key.alias("rk"), F.col("authors").alias("ra"), F.col("years").alias("ry"), F.col("marks").alias("rm"))
    columns = ["ref_id", "work_id", "lt", "rt", "la", "ra", "ly", "ry", "lm", "rm"]
    scores = lambda df: _scores(df.select(*columns).filter("lm = rm").drop("lm", "rm").distinct()).filter(F.col("title") >= LEAST_TITLE)
    found = written(scores(left.join(by_title, left.lh == by_title.l).join(right, right.rh == by_title.r)), "found")
    # The index of whole records is for the references that their titles alone bring to no record of their part and edition.
    rest = refs.join(found.select(F.col("ref_id").alias("id")).distinct(), "id", "left_anti")
    by_record = close(records(rest), records(own), RECORD_WORDS)
    scored = found.union(scores(left.join(by_record, left.lk == by_record.l).join(right, right.rk == by_record.r)))
    level = lambda f: F.coalesce(*(F.when(F.col(f) >= x, F.lit(i)) for i, x in enumerate(LEVELS[f])))
    scored = scored.groupBy("ref_id", "work_id").agg(F.max_by(F.struct("score", "title", "author", "year"), "score").alias("s")).select("ref_id", "work_id", "s.*")
    scored = written(scored.withColumn("levels", F.array(*map(level, LEVELS))), "scores")
    confidence = calibration({tuple(r["levels"]): r["count"] for r in scored.groupBy("levels").count().collect()})  # at most 64 rows
    table = F.create_map(*(F.lit(x) for p, c in confidence.items() for x in ("".join(map(str, p)), c))) if confidence else F.lit(None).cast("map<string,double>")
    sure = scored.withColumn("confidence", table[F.array_join(F.col("levels").cast("array<string>"), "")])
    best = sure.groupBy("ref_id").agg(F.max_by(F.struct("work_id", "confidence", "score", "title"), F.struct("confidence", "score", -F.col("work_id"))).alias("b"))
    return best.select("ref_id", "b.work_id", "b.confidence", "b.score", F.col("b.title").alias("title_score"))
