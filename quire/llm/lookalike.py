"""One consistent form for text that looks the same.

Method: a batch of texts becomes a column of positioned code points. Each is joined with a broadcast table of mappings -
decompositions and look-alikes, made from the Unicode character database by rule - which may give none, one or several code
points; combining marks are put in the order of their class, recomposed with their letters, and the strings are rebuilt.
The columns are Arrow batches and the joins array look-ups, so that no code point is ever a row of a shuffle.

What is visible stays: case, accents, digits, line breaks, superscripts, one ASCII character instead of another.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import written

from .arrow import code_points, map_arrow, ragged, slices

# Letters of other scripts, and the Latin letters of the same shape.
LETTERS = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԁ": "D",
    "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "H", "Ӏ": "I", "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l", "ѵ": "v", "Ѵ": "V", "ҽ": "e", "ԍ": "g",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "γ": "y", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Ս": "U", "Տ": "S", "Օ": "O", "Լ": "L", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ɑ": "a", "ɡ": "g",
}
# Characters that look like the hyphen. Dashes, being longer, are not among them.
HYPHENS = "‐‑⁃˗−﹣－"
#: Compatibility mappings that keep the look. Superscripts, fractions, circled and squared characters change it.
KEPT_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
JAMO = re.compile("[\u1100-\u11ff]")
SOFT_HYPHEN, LONG_S, LAST = 0x00AD, 0x017F, 0x110000
BREAKS = (0x0A, 0x0D, 0x0B, 0x0C, 0x85, 0x2028, 0x2029)


def _mapped(char: str) -> str:
    """The look of one character: its decomposition as far as it looks the same, with Latin look-alikes."""
    if char < "\x7f":
        return char
    if char in HYPHENS:
        return "-"
    if char in LETTERS:
        return LETTERS[char]
    code, kind = ord(char), unicodedata.category(char)
    if code in BREAKS or code == LONG_S:
        return char
    if kind == "Zs":
        return " "
    if kind == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0):
        return ""
    parts = unicodedata.decomposition(char).split()
    if not parts:
        return char
    if parts[0][0] == "<":
        if parts[0] not in KEPT_TAGS or parts[1] == "0020":  # a blank with an accent is a character with a look of its own
            return char
        parts = parts[1:]
    return "".join(_mapped(chr(int(x, 16))) for x in parts)


@lru_cache(1)
def tables() -> dict[str, np.ndarray]:
    """The mapping tables: for each code point the start and length of what it becomes, in one flat array; the class of each mark; letter and mark to the composed letter."""
    become, classes, composed = {}, np.zeros(LAST, np.uint8), {}
    for code in range(0x80, 0x30000):
        char = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        if mark := unicodedata.combining(char):
            classes[code] = mark
        if (new := _mapped(char)) != char:
            become[code] = [ord(x) for x in new]
        parts = unicodedata.decomposition(char).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", char) == char:
            composed[int(parts[0], 16) << 21 | int(parts[1], 16)] = code
    for code in range(0xE0000, 0xE01F0):
        become[code] = []
    size = np.ones(LAST, np.uint8)
    start = np.arange(LAST, dtype=np.int32)
    flat = []
    for code, new in become.items():
        size[code], start[code] = len(new), LAST + len(flat)
        flat += new
    keys = np.array(sorted(composed), np.int64)
    return {"size": size, "start": start, "flat": np.array(flat, np.uint32), "classes": classes, "pairs": keys, "composed": np.array([composed[k] for k in keys.tolist()], np.uint32)}


def _compose(codes: np.ndarray, rows: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Marks in the order of their class, then composed with the letter before them where Unicode has such a letter."""
    classes = t["classes"][codes]
    marks = classes > 0
    if not marks.any():
        return codes, rows
    at = np.flatnonzero(marks)
    fresh = np.r_[True, (np.diff(at) > 1) | (rows[at][1:] != rows[at][:-1])]
    run = np.cumsum(fresh) - 1
    order = np.lexsort((np.arange(len(at)), classes[at], run))
    codes = codes.copy()
    codes[at] = codes[at][order]
    classes = t["classes"][codes]
    base = at[fresh] - 1  # the letter that a run of marks follows
    alone = (base < 0) | (rows[np.maximum(base, 0)] != rows[at[fresh]])
    base = np.where(alone, at[fresh], base)
    place = np.arange(len(at)) - np.flatnonzero(fresh)[run]
    keep = np.ones(len(codes), bool)
    blocked = np.zeros(len(base), np.uint8)  # class of the last mark of the run that stayed
    for k in range(int(place.max()) + 1):
        now = at[(place == k) & ~alone[run]]
        runs = run[(place == k) & ~alone[run]]
        key = codes[base[runs]].astype(np.int64) << 21 | codes[now]
        found = np.minimum(np.searchsorted(t["pairs"], key), len(t["pairs"]) - 1)
        ok = (t["pairs"][found] == key) & (blocked[runs] != classes[now])
        codes[base[runs[ok]]] = t["composed"][found[ok]]
        keep[now[ok]] = False
        blocked[runs[~ok]] = classes[now[~ok]]
    return codes[keep], rows[keep]


def same_look(texts: list[str]) -> list[str]:
    """Each text in the one form that all texts of its look share."""
    t = tables()
    out: list[str] = []
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    for start, stop in slices(lengths):
        part = [unicodedata.normalize("NFC", x) if JAMO.search(x) else x for x in texts[start:stop]]
        codes, begins = code_points(part)
        rows = np.repeat(np.arange(len(part)), np.diff(begins))
        # At the end of a line a soft hyphen is seen, elsewhere not.
        soft = np.flatnonzero(codes == SOFT_HYPHEN)
        soft = soft[soft + 1 < len(codes)]
        soft = soft[np.isin(codes[soft + 1], BREAKS) & (rows[soft] == rows[soft + 1])]
        if len(soft):
            codes = codes.copy()
            codes[soft] = ord("-")
        size = t["size"][codes]
        changed = t["start"][codes] != codes
        if changed.any():
            origin, place = ragged(size.astype(np.int64))
            new = codes[origin]
            hit = changed[origin]
            new[hit] = t["flat"][t["start"][codes[origin[hit]]] - LAST + place[hit]]
            codes, rows = new, rows[origin]
        codes, rows = _compose(codes, rows, t)
        whole = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        ends = np.searchsorted(rows, np.arange(len(part) + 1))
        out += [whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return out


def same_look_column(texts: pa.Array) -> pa.Array:
    """`same_look` of a string column; nulls stay null, plain ASCII stays as it is."""
    todo = pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False)
    if not pc.any(todo).as_py():
        return texts
    return pc.replace_with_mask(texts, todo, pa.array(same_look(texts.filter(todo).to_pylist()), texts.type))


def canonical(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """`df` with the column `out`: `text` in the form shared by all texts that look alike. Null gives null, empty gives empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column(out, same_look_column(batch.column(batch.schema.get_field_index(text)).cast(pa.string())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_arrow(df, f"{fields}, `{out}` string", work)


def lookalikes(df: DataFrame, field: str, key: str, text: str) -> DataFrame:
    """Pairs of different rows of a field (by key) whose texts differ as strings and look alike: `field`, `id_a` < `id_b`.

    Rows with a null, empty or blank text give no pair; repeated rows count once; an empty table gives an empty result.
    Only hashes (128 bits) are shuffled. A group of texts of one look is joined with itself only if it holds at least two
    different strings, and only rows of different strings meet.
    """
    rows = _mixed(df, field, key, text)
    other = rows.select("field", "look", F.col("id").alias("id_b"), F.col("string").alias("string_b"))
    pairs = rows.join(other, ["field", "look"]).filter((F.col("string") != F.col("string_b")) & (F.col("id") < F.col("id_b")))
    return pairs.select("field", F.col("id").alias("id_a"), "id_b").distinct()


def look_classes(df: DataFrame, field: str, key: str, text: str) -> DataFrame:
    """The rows that look like a different string of their field, each once: `field`, `id`, `class_id` (the smallest id of its
    look), `strings` and `rows` (of the class). Odd rows as in `lookalikes`."""
    rows = _mixed(df, field, key, text)
    sizes = rows.groupBy("field", "look").agg(F.min("id").alias("class_id"), F.countDistinct("string").alias("strings"), F.count("*").alias("rows"))
    return rows.join(sizes, ["field", "look"]).select("field", "id", "class_id", "strings", "rows")


def _mixed(df: DataFrame, field: str, key: str, text: str) -> DataFrame:
    """(field, id, look, string) of the rows whose look has several strings; the last two are hashes."""
    digest = lambda c: F.concat(F.hex(F.xxhash64(c)), F.hex(F.xxhash64(F.lit(1), c)))
    rows = canonical(df.select(F.col(field).alias("field"), F.col(key).alias("id"), F.col(text).alias("text")).filter(F.length(F.trim("text")) > 0), "text")
    rows = rows.filter(F.length(F.trim("canonical")) > 0).select("field", "id", digest("canonical").alias("look"), digest("text").alias("string"))
    rows = written(rows, "looks")
    mixed = rows.groupBy("field", "look").agg(F.min("string").alias("least"), F.max("string").alias("most")).filter("least < most").select("field", "look")
    rows = written(rows.join(mixed, ["field", "look"], "left_semi").distinct(), "mixed")
    return rows
