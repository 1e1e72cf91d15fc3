"""A language, with a confidence, for every document and every running paragraph.

Method: nearest centroids. A paragraph is a normalised TF-IDF vector of hashed character trigrams; it is compared by cosine
with several centroids of each language, found by spherical k-means, and gets the language of the nearest one, unless all are
too far away. Weights and centroids are fitted on a bounded sample of labelled documents whose label agrees with the small
words of the text; everything else is applied to all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import code_points, map_arrow, slices
from .pages import SMALL_WORDS, read_page

LANGUAGES = tuple(SMALL_WORDS)
# The languages' names in the notations that catalogues use, by code.
NAMES = {
    "en": "en eng english englisch anglais inglés inglese engels inglês",
    "de": "de deu ger german deutsch allemand alemán tedesco duits alemão",
    "fr": "fr fra fre french französisch français francés francese frans francês",
    "es": "es spa spanish spanisch espagnol español castellano spagnolo spaans espanhol",
    "it": "it ita italian italienisch italien italiano italiaans",
    "nl": "nl nld dut dutch niederländisch néerlandais neerlandés olandese nederlands neerlandês holandês",
    "pt": "pt por portuguese portugiesisch portugais português portugués portoghese portugees",
}
#: Buckets of the trigrams; centroids of a language; labelled documents of a language used for fitting (about).
BUCKETS, CENTROIDS, SAMPLE = 4096, 3, 150
#: Paragraphs of each of those documents that are used.
SAMPLE_PARAGRAPHS = 4
#: Characters vectorised at a time; the share of the least training similarity below which a paragraph is rejected.
VECTOR_CHARS, REJECT = 250_000, 0.6
#: Sharpness of the confidence.
SHARPNESS = 25.0


def named_language(label: Column) -> Column:
    """The code of the language that a label names, in whatever notation; null if it names none of them."""
    names = {name: code for code, all_names in NAMES.items() for name in all_names.split()}
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    plain = F.lower(F.trim(label))
    return F.coalesce(table[plain], table[F.split(plain, r"[-_\s(;,/]")[0]])


def counts(texts: list[str]) -> np.ndarray:
    """Hashed trigram counts, a row for each text."""
    codes, starts = code_points(texts)
    out = np.zeros((len(texts), BUCKETS), np.float32)
    if len(codes) < 3:
        return out
    c = codes.astype(np.uint32)
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA6B)) ^ (c[2:] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h >>= np.uint32(20)
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    same = row[:-2] == row[2:]
    flat = np.bincount(row[:-2][same] * BUCKETS + h[same], minlength=len(texts) * BUCKETS)
    return flat.reshape(len(texts), BUCKETS).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    weights: np.ndarray
    centroids: np.ndarray
    languages: np.ndarray
    least: float

    def vectors(self, texts: list[str]) -> np.ndarray:
        return _unit(np.log1p(counts(texts)) * self.weights)

    def classify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the index of its language, or -1, and the confidence."""
        index = np.full(len(texts), -1, np.int64)
        confidence = np.zeros(len(texts))
        for start, stop in slices(np.fromiter(map(len, texts), np.int64, len(texts)), VECTOR_CHARS):
            cosine = self.vectors(texts[start:stop]) @ self.centroids.T
            best = np.stack([cosine[:, self.languages == k].max(axis=1, initial=-1.0) for k in range(len(LANGUAGES))], axis=1)
            top = best.max(axis=1)
            index[start:stop] = np.where(top >= self.least, best.argmax(axis=1), -1)
            confidence[start:stop] = 1 / np.exp(SHARPNESS * (best - top[:, None])).sum(axis=1)
        return index, confidence


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, begun with vectors far from each other."""
    mean = _unit(x.mean(axis=0, keepdims=True))
    seeds = [int((x @ mean[0]).argmax())]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(axis=1).argmin()))
    centres = x[seeds]
    for _ in range(20):
        own = (x @ centres.T).argmax(axis=1)
        fresh = _unit(np.stack([x[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))]))
        if np.allclose(fresh, centres):
            break
        centres = fresh
    return centres


def fit(labelled: list[tuple[str, str]]) -> Model:
    """A model from pairs of language code and paragraph. A language without paragraphs gets no centroid."""
    vocabulary = {code: frozenset(words.split()) for code, words in SMALL_WORDS.items()}
    clean = []
    for code, text in labelled:
        words = text.split()
        score = {k: sum(w in v for w in words) for k, v in vocabulary.items()}
        if score[code] == max(score.values()):
            clean.append((code, text))
    if not clean:
        return Model(np.ones(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.int64), 2.0)
    x = counts([t for _, t in clean])
    weights = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _unit(np.log1p(x) * weights)
    codes = np.array([LANGUAGES.index(c) for c, _ in clean])
    centroids, languages, nearest = [], [], []
    for k in range(len(LANGUAGES)):
        own = x[codes == k]
        if len(own):
            centres = _k_means(own, CENTROIDS)
            centroids.append(centres)
            languages += [k] * len(centres)
            nearest.append((own @ centres.T).max(axis=1))
    return Model(weights, np.concatenate(centroids), np.array(languages), REJECT * float(np.quantile(np.concatenate(nearest), 0.01)))


def paragraphs(text: str) -> tuple[bool, list[tuple[str, int]]]:
    """Whether the page is unwanted (see pages); its running paragraphs as lower-case words, with their number of words."""
    blocks: list[list[str]] = []
    page = read_page(text, blocks)
    return page.is_spam, [(" " + " ".join(x) + " ", len(x)) for x in blocks]


def train(df: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> Model:
    """A model fitted on about `sample` labelled documents of each language, picked by a hash of their key, and the first SAMPLE_PARAGRAPHS running paragraphs of each."""
    named = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), named_language(F.col(label)).alias("lang")).filter("lang is not null")
    sizes = dict(named.groupBy("lang").count().collect())  # a row for each language
    if not sizes:
        return fit([])
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))))
    part = (F.shiftrightunsigned(F.xxhash64("key", F.lit("sample")), 11) / F.lit(float(1 << 53))) < share[F.col("lang")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(lang, p) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p, _ in paragraphs(t or "")[1][:SAMPLE_PARAGRAPHS]]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["lang", "text"])

    found = map_arrow(named.filter(part).select("lang", "text"), "lang string, text string", work)
    return fit(sorted((r.lang, r.text) for r in found.collect()))  # bounded by `sample`


def languages(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """For each row: `key`, `spam`, `lang` (the language of most words in running paragraphs), `confidence` (of its
    paragraphs, weighted by words) and `segments`, an array of the running paragraphs' `position`, `lang`, `confidence` and
    `words`. A rejected paragraph has a null lang.

    A null or empty text, or one without running paragraphs, has a null lang and no segments; repeated rows stay repeated;
    ties between languages go to the one that is named first in LANGUAGES; other columns are left out.
    """
    kind = df.schema[key].dataType.simpleString()
    segment = "struct<position: int, lang: string, confidence: double, words: int>"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        spam, texts, words, size = [], [], [], []
        for t in batch.column(1).to_pylist():
            bad, found = paragraphs(t or "")
            spam.append(bad)
            size.append(len(found))
            texts += [x for x, _ in found]
            words += [n for _, n in found]
        index, confidence = model.classify(texts)
        names = [LANGUAGES[i] if i >= 0 else None for i in index.tolist()]
        main: list[str | None] = []
        sure: list[float | None] = []
        segments = []
        at = 0
        for n in size:
            total: dict[int, int] = {}
            for j in range(at, at + n):
                if (i := int(index[j])) >= 0:
                    total[i] = total.get(i, 0) + words[j]
            best = min(total, key=lambda i: (-total[i], i), default=None)
            main.append(None if best is None else LANGUAGES[best])
            sure.append(None if best is None else float(sum(confidence[j] * words[j] for j in range(at, at + n) if index[j] == best) / total[best]))
            segments.append([{"position": j - at, "lang": names[j], "confidence": float(confidence[j]), "words": words[j]} for j in range(at, at + n)])
            at += n
        kind_ = pa.list_(pa.struct([("position", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spam, pa.bool_()), pa.array(main, pa.string()), pa.array(sure, pa.float64()), pa.array(segments, kind_)], [key, "spam", "lang", "confidence", "segments"])

    return map_arrow(df.select(F.col(key), F.col(text).cast("string")), f"`{key}` {kind}, spam boolean, lang string, confidence double, segments array<{segment}>", work)


def label_errors(found: DataFrame, docs: DataFrame, results: DataFrame) -> DataFrame:
    """(field, row_id, lang) of wrong or missing labels, from `languages` of the documents (key `doc_id`), `docs` (doc_id,
    language) and `results` (result_id, document_id, primary_lang, is_multilingual). Unwanted pages and documents without a
    language give no case."""
    found = found.filter("not spam and lang is not null").select("doc_id", "lang", F.array_distinct(F.filter(F.col("segments.lang"), lambda x: x.isNotNull())).alias("langs"))
    named = docs.select("doc_id", named_language(F.col("language")).alias("named"))
    wrong = found.join(named, "doc_id").select(F.lit("documents.language").alias("field"), F.col("doc_id").alias("row_id"), F.explode("langs").alias("lang"), "named").filter("named is null or named <> lang").drop("named")
    runs = results.select("result_id", "document_id", named_language(F.col("primary_lang")).alias("primary"), F.coalesce("is_multilingual", F.lit(False)).alias("flag")).distinct()
    both = runs.join(found, runs.document_id == found.doc_id)
    primary = both.filter("primary is null or primary <> lang").select(F.lit("language_results.primary_lang").alias("field"), F.col("result_id").alias("row_id"), "lang")
    flags = both.filter(F.col("flag") != (F.size("langs") > 1)).select(F.lit("language_results.is_multilingual").alias("field"), F.col("result_id").alias("row_id"), "lang")
    return wrong.union(primary).union(flags).distinct()
