"""Variant spellings of the names of persons and organisations.

Method: a name is a bag of words in one form. Its character trigrams, weighted by their rarity, make a sparse vector; all pairs
of vectors with a cosine of at least COSINE that can name the same are found by a join on the rarest trigrams of each (those without which the rest
could not reach the threshold), each together with how another word of the name begins. A pair whose words contradict each other - other given names, other initials, other places -
has a similarity of 0; the others are grouped by average linkage, computed by merging clusters that are each other's nearest,
round by round, in joins, so that no family of names is ever gathered in one task.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import dropped, written

from .arrow import map_arrow
from .lookalike import same_look

#: Names that a small collection is taken to have besides its own, so that chance doesn't make its trigrams rare or frequent.
SMOOTH = 1000
#: Power of the rarity by which a trigram weighs.
SHARPNESS = 1.5
#: Two words that both stand in this many names, and neither in FEWER times fewer than the other, are two words and no slip.
KNOWN, FEWER = 3, 5
#: Least cosine of a pair, least average similarity of two clusters that are merged.
COSINE, LINKAGE = 0.3, 0.3

# Short forms of given names, and the names they stand for.
NICKNAMES = """
alex sandy sascha xander: alexander | sandra ale: alessandra alexandra | andy: andrew andreas | tony toni toño: antonio anthony anton | toinho to: antonio | ben benno beppo: benedikt benjamin |
conchita concha conchi: concepcion | kees cees cor: cornelis | lola loli: dolores | nell nellie ellie nora ella: eleanor | elsa betty beth liz lisa lise elise sisi liesl else: elisabeth |
steve etien: etienne | franco checco cecco franz: francesco | paco pancho curro chico kiko: francisco | fanchon fanny: françoise | fritz freddy fiete: friedrich | ginette genie gene viviane: genevieve |
beppe peppe pino peppino geppe: giuseppe | gianni: giovanni | gwen wendy: gwendolyn  | lena leni ellen: helene | henk rik hein: hendrik | nacho iñaki: ignacio |
quim joca: joaquim | jo josie fina: josephine johanna | hanna hanne joke: johanna | hans hannes jan: johann johannes | kalle charly charlie: karl | kate kathi kati käthe kathe trine kathy: katharina |
renzo enzo: lorenzo | lu lulu isa: luisa | greta grete gretel gretchen margot meg maggie gitta: margarete | anni annie: anna anne | merche meche mercy: mercedes | mike micha michel mick: michael |
nat nate nathan: nathaniel | otti tilly: ottilie | pippa pip phil: philippa | becky becca: rebecca | rod rory roddy: roderick | søs soren: søren | sue susi suzy susie: susan | ted teddy: theodore edward | theo: theodore | ed eddie ned: edward | tom tommy: thomas |
wally burga burgel: walburga | willi willy helm: wilhelm | mina minna wilma helma: wilhelmina | bill will billy willie: william | bob rob bobby robbie: robert | dick rick richie: richard | pepe: jose | joe: joseph |
jorgen: jurgen | bjorn: bjørn | zeca ze: jose | goncas: gonçalo | dre dede: andre | jeannot: jean
"""
# Words that stand before or after names, and words that name nobody.
TITLES = frozenset("dr prof professor professeur doctor mag dipl ing phd md hon sir herr frau mr mrs ms mme mlle sr sra jr".split())
SMALL = frozenset("van von der den de des del della dello di da do dos das du la le les el ten ter zu zum zur y e and und et en of for für fur the voor per pour".split())
FILLERS = frozenset("et al|u a|n n|anon|anonymous|anonym|anonyme|unknown|unbekannt|various authors|various|diverse|o a|and others|et alii|ed|eds|hrsg|author|autor|auteur|no author|red|red a|none|null|n a|na|nn|a a v v|aa vv|y otros|und andere|e outros|en anderen|et autres|e altri|collective|autores varios|vv aa|s n".split("|"))


@lru_cache(1)
def _nicknames() -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for group in NICKNAMES.replace("\n", " ").split("|"):
        short, full = group.split(":")
        for s in short.split():
            out.setdefault(plain(s), set()).update(map(plain, full.split()))
    return {k: frozenset(v) for k, v in out.items()}


def plain(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFD", text.lower().replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("ł", "l").replace("œ", "oe"))
    return text.translate(_combining())


@lru_cache(1)
def _combining() -> dict[int, None]:
    return {c: None for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))}


#: An acronym, and where it is explained.
ACRONYM = re.compile(r"(?<![^\W_])[A-ZÄÖÜ]{2,6}(?![^\W_])")
EXPLAINED = re.compile(r"^(.*?[^\W\d_].*?)\s*\(([A-ZÄÖÜ]{2,6})\)")


def words_of(names: list[str]) -> list[list[str]]:
    """The words that tell each name from others: no titles, particles, marks or acronyms in brackets; none for a filler.

    The parts of a word with hyphens end in `~`.
    """
    out = []
    for name in same_look(names):
        name = re.sub(r"\((?:[A-ZÄÖÜ]{2,6})\)", " ", name)
        name = re.sub(r"(?<=[a-zà-ÿ])\d+$|[*†‡§¹²³⁴]+", " ", name)
        text = plain(name)
        # E and Y between two words are an `and`, elsewhere an initial.
        alone = re.sub(r"(?<=[^\W\d_]\s)[ey](?=\s+[^\W\d_])", " ", name, flags=re.IGNORECASE if name.isupper() else 0)
        words = re.findall(r"[^\W\d_]+(?:\.?-[^\W\d_]+)*", plain(alone))
        if re.sub(r"[^a-z]+", " ", text).strip() in FILLERS:
            out.append([])
            continue
        # Initials run together (JS) are taken apart where the writing shows them.
        upper = {plain(w) for w in re.findall(r"(?<![^\W\d_-])[A-Z]{2}(?![^\W\d_-])", name)} if not name.isupper() else set()
        kept: list[str] = []
        for w in words:
            parts = [x.strip(".") for x in w.split("-")]
            if len(parts) > 1:
                kept += [x + "~" if len(x) > 1 else x for x in parts]
            elif w in upper:
                kept += list(w)
            elif len(w) == 1 or (w not in TITLES and w not in SMALL):
                kept.append(w)
        out.append(kept)
    return out


def _distance(a: str, b: str) -> int:
    """Edits and swaps of neighbours between two words, counted up to 2."""
    if abs(len(a) - len(b)) > 2:
        return 3
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j - 1] + (x != y), before[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[-1]


def _alike(a: str, b: str, na: int, nb: int, many: bool) -> float:
    """How well two words agree: 1 the same, less for a slip, a short form or an initial, 0 not. `na`, `nb` are the names that
    hold each; `many` says that both names have several words, as those of organisations do."""
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(short) == 1:
        return 0.5 if long[0] == short else 0.0
    if long in _nicknames().get(short, ()) or short in _nicknames().get(long, ()):
        return 0.7
    if _digraphs(a) == _digraphs(b):
        return 0.95
    established = min(na, nb) >= KNOWN and FEWER * min(na, nb) > max(na, nb)
    if len(short) >= 4 and not established and _distance(a, b) <= (1 if len(short) < 9 else 2):
        return 0.8
    if 3 <= len(short) <= 5 and len(long) >= len(short) + 3 and (long.startswith(short) or (many and _within(short, long))):
        return 0.6
    return 0.0


def _digraphs(word: str) -> str:
    """The word with umlauts written as two letters made one."""
    return word.replace("ue", "u").replace("oe", "o").replace("ae", "a")


def _within(short: str, long: str) -> bool:
    """Whether the letters of `short` stand in `long` in their order, from its first letter on."""
    rest = iter(long)
    return long[0] == short[0] and all(c in rest for c in short)


def agreement(a: list[str], b: list[str], na: list[int], nb: list[int]) -> float:
    """How well two names agree, 0 if they contradict each other. `na` and `nb` say how many names hold each of their words.

    Every word needs a partner, but for single letters and parts of words with hyphens left over on one side only. One long
    word has to agree but for a slip, and another word at least by its initial.
    """
    parts_a, parts_b = [w[-1] == "~" or len(w) == 1 for w in a], [w[-1] == "~" or len(w) == 1 for w in b]
    x, y = [w.rstrip("~") for w in a], [w.rstrip("~") for w in b]
    many = min(sum(len(w) > 1 for w in x), sum(len(w) > 1 for w in y)) >= 3
    scores = ((_alike(v, w, na[i], nb[j], many), i, j) for i, v in enumerate(x) for j, w in enumerate(y))
    pairs = sorted((p for p in scores if p[0]), key=lambda p: (-p[0], -min(len(x[p[1]]), len(y[p[2]])), p[1], p[2]))
    left, right, taken, long = set(range(len(x))), set(range(len(y))), [], 0
    for s, i, j in pairs:
        if i in left and j in right:
            left.discard(i)
            right.discard(j)
            taken.append(s)
            long += s >= 0.8 and min(len(x[i]), len(y[j])) >= 4
    if (left and right) or not all(parts_a[i] for i in left) or not all(parts_b[j] for j in right) or long < 1 or len(taken) < 2:
        return 0.0
    return sum(taken) / len(taken)


def _features(words: list[str]) -> list[str]:
    out = []
    for w in words:
        padded = f" {w.rstrip('~')} "
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return out


def _companions(words: list[str], own: int) -> set[str]:
    """How a word besides the one at `own` may begin in another spelling: its first letter, and those of the names it is short for."""
    out = set()
    for i, w in enumerate(words):
        if i != own:
            w = w.rstrip("~")
            out.add(_digraphs(w)[:1])
            out.update(full[:1] for full in _nicknames().get(w, ()))
    return out


def similar_pairs(keys: DataFrame, threshold: float = COSINE) -> DataFrame:
    """(a, b, cosine), a < b, of the names (`id`, `words`) whose weighted trigram vectors have a cosine of at least `threshold`,
    and that can name the same: they share a trigram of a word of four letters or more and the beginning of another word.

    Trigrams are looked up together with how another word begins, since that is what `agreement` asks for too; so a trigram
    that many names have brings only those together that have the other word's letter as well. Of each name the rarest
    trigrams are looked up, without which the rest could not reach the threshold.
    """

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [sorted({x: 0 for x in _features(ws)}) for ws in batch.column(1).to_pylist()]
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([f for r in rows for f in r], pa.string())], ["id", "feature"])

    n = keys.count()
    features = map_arrow(keys.select("id", "words"), "id long, feature string", explode)
    df = features.groupBy("feature").agg(F.count("*").alias("df"))
    weighted = features.join(df, "feature").select("id", "feature", F.pow(F.log(F.lit(float(n + SMOOTH)) / F.col("df")), SHARPNESS).alias("w"))
    # A vector: its features from the rarest on.
    gathered = weighted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("w"), F.col("feature"))), asc=False).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))

    def prefix(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, words, vs, norms = (batch.column(i).to_pylist() for i in range(4))
        out = set()
        for k, ws, v, norm in zip(ids, words, vs, norms, strict=True):
            left, head = norm * norm, set()
            for x in v:
                # What is left cannot reach the threshold alone.
                if left < (threshold * norm) ** 2:
                    break
                head.add(x["feature"])
                left -= x["w"] ** 2
            for i, w in enumerate(ws):
                if len(w.rstrip("~")) >= 4:
                    beside = _companions(ws, i)
                    out.update((k, f, c) for f in _features([w]) if f in head for c in beside)
        rows = list(out)
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in rows], pa.int64()), pa.array([o[1] for o in rows], pa.string()), pa.array([o[2] for o in rows], pa.string())], ["id", "feature", "beside"])

    vectors = written(gathered.join(keys.select("id", "words"), "id").select("id", "words", "v", "norm"), "vectors")
    heads = map_arrow(vectors, "id long, feature string, beside string", prefix).select("id", F.xxhash64("feature", "beside").alias("f"))
    pairs = heads.select(F.col("id").alias("a"), "f").join(heads.select(F.col("id").alias("b"), "f"), "f").filter("a < b").select("a", "b").distinct()
    side = lambda x: vectors.select(F.col("id").alias(x), F.transform("v", lambda e: F.xxhash64(e["feature"])).alias(f"f{x}"), F.transform("v", lambda e: e["w"] / F.col("norm")).alias(f"w{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "fa", "wa", "fb", "wb")

    def multiply(batch: pa.RecordBatch) -> pa.RecordBatch:
        fa, wa, fb, wb = (batch.column(i) for i in range(2, 6))
        _, code = np.unique(np.concatenate([x.flatten().to_numpy() for x in (fa, fb)]), return_inverse=True)
        rows = [np.repeat(np.arange(len(batch)), np.diff(x.offsets.to_numpy())) for x in (fa, fb)]
        width = int(code.max(initial=0)) + 1
        left = rows[0] * width + code[: len(rows[0])]
        right = rows[1] * width + code[len(rows[0]) :]
        _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
        dot = np.bincount(rows[0][i], wa.flatten().to_numpy()[i] * wb.flatten().to_numpy()[j], len(batch))
        keep = pa.array(np.flatnonzero(dot >= threshold))
        return pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(dot).take(keep)], ["a", "b", "cosine"])

    return map_arrow(both, "a long, b long, cosine double", multiply)


def average_linkage(edges: DataFrame, threshold: float) -> DataFrame:
    """(node, cluster) of average-linkage clustering of `edges` (a < b, s); pairs without an edge have a similarity of 0.

    Clusters that are each other's nearest are merged, all at once in each round; for average linkage this gives what merging
    the nearest pair again and again gives. Stops when no two clusters reach `threshold`. Nodes that are never merged have no
    row.
    """
    now = written(edges.select("a", "b", F.col("s").alias("total"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")), "edges")
    members = before = None
    while True:
        near = now.withColumn("sim", F.col("total") / (F.col("na") * F.col("nb"))).filter(F.col("sim") >= threshold)
        rank = F.struct("sim", -F.col("a"), -F.col("b"))
        ends = near.select(F.col("a").alias("c"), "a", "b", "na", "nb", rank.alias("rank")).union(near.select(F.col("b"), "a", "b", "na", "nb", rank))
        best = ends.groupBy("c").agg(F.max_by(F.struct("a", "b", "na", "nb"), "rank").alias("e"))
        merged = written(best.groupBy("e").agg(F.count("*").alias("n")).filter("n = 2").select("e.a", "e.b", (F.col("e.na") + F.col("e.nb")).alias("size")), "merged")
        if merged.isEmpty():
            dropped(merged)
            break
        moved = merged.select(F.col("a").alias("old"), F.col("a").alias("new"), "size").union(merged.select("b", "a", "size"))
        if members is None:
            members = moved.select(F.col("old").alias("node"), F.col("new").alias("cluster"))
        else:
            kept = members.join(moved, members.cluster == moved.old, "left").select("node", F.coalesce("new", "cluster").alias("cluster"))
            fresh = moved.join(members, moved.old == members.cluster, "left_anti").select(F.col("old").alias("node"), F.col("new").alias("cluster"))
            members = kept.union(fresh)
        members, old = written(members, "members"), before
        dropped(old)
        before = members
        left = moved.select(F.col("old").alias("a"), F.col("new").alias("a2"), F.col("size").alias("sa"))
        right = moved.select(F.col("old").alias("b"), F.col("new").alias("b2"), F.col("size").alias("sb"))
        changed = now.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"), "total", F.coalesce("sa", "na").alias("na"), F.coalesce("sb", "nb").alias("nb")).filter("a <> b")
        swap = F.col("a") > F.col("b")
        turned = changed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total", F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"))
        fresh_edges = written(turned.groupBy("a", "b").agg(F.sum("total").alias("total"), F.max("na").alias("na"), F.max("nb").alias("nb")), "edges")
        dropped(now, merged)
        now = fresh_edges
    return members if members is not None else edges.select(F.col("a").alias("node"), F.col("a").alias("cluster")).limit(0)


def variants(names: DataFrame, name: str) -> DataFrame:
    """(name, entity): each distinct name of the column with the entity it names.

    Null and empty names, fillers and names of a single word that no other name explains name nobody and have no row, unless
    they are written in several ways themselves. An empty table gives an empty result.
    """
    distinct = names.select(F.col(name).cast("string").alias("name")).filter(F.length(F.trim("name")) > 0).distinct()

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [n if e is None else n.replace(a, f" {e} ", 1) for n, a, e in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
        found = [sorted(ws) for ws in words_of(texts)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(ws) for ws in found], pa.string())], ["name", "key"])

    def acronyms(batch: pa.RecordBatch) -> pa.RecordBatch:
        names_, short, full = batch.column(0).to_pylist(), [], []
        for n in names_:
            told = EXPLAINED.search(n)
            bare = None if told or n.isupper() or "," in n else ACRONYM.search(n)
            short.append(told.group(2) if told else bare.group() if bare else None)
            full.append(told.group(1) if told else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.string()), pa.array(full, pa.string())], ["name", "acronym", "full"])

    marked = written(map_arrow(distinct, "name string, acronym string, full string", acronyms), "acronyms")
    meant = marked.filter("full is not null").groupBy("acronym", "full").agg(F.count("*").alias("n")).groupBy("acronym").agg(F.min_by("full", F.struct(-F.col("n"), "full")).alias("meaning"))
    told = marked.filter("acronym is not null and full is null").join(meant, "acronym", "left").select("name", "acronym", "meaning")
    plain_ = marked.filter("acronym is null or full is not null").select("name", F.lit(None).cast("string").alias("acronym"), F.lit(None).cast("string").alias("meaning"))
    spelled = written(map_arrow(told.union(plain_), "name string, key string", read).filter("key <> ''"), "names")
    keys = written(spelled.select("key").distinct().select("key", F.monotonically_increasing_id().alias("id"), F.split("key", " ").alias("words")), "keys")
    near = similar_pairs(keys)
    bag = keys.select("id", F.posexplode("words").alias("at", "w")).withColumn("w", F.regexp_replace("w", "~$", ""))
    counts = written(bag.groupBy("w").agg(F.count("*").alias("n")), "counts")
    counts = counts.join(misspelt(counts), "w", "left").select("w", "n", F.coalesce("meant", "w").alias("meant"))
    held = bag.join(counts, "w").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "n", "meant"))).alias("held")).select("id", F.col("held.n").alias("held"), F.col("held.meant").alias("meant"))
    known = written(keys.join(held, "id").select("id", "words", "held", "meant"), "known")
    texts = lambda x: known.select(F.col("id").alias(x), F.col("words").alias(f"w{x}"), F.col("held").alias(f"n{x}"), F.col("meant").alias(f"m{x}"))

    def agree(batch: pa.RecordBatch) -> pa.RecordBatch:
        wa, wb, na, nb, ma, mb = (batch.column(i).to_pylist() for i in range(3, 9))
        score = [agreement(*x) for x in zip(wa, wb, na, nb, strict=True)]
        sides = [_initial_only(*x) if s else (None, None) for s, x in zip(score, zip(wa, wb, na, nb, ma, mb, strict=True), strict=True)]
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(score, pa.float64()), *(pa.array([x[i] for x in sides], pa.string()) for i in (0, 1)), pa.array([_share_a_word(*x) for x in zip(wa, wb, strict=True)])]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "cosine", "agreement", "left", "right", "exact"])

    both = near.join(texts("a"), "a").join(texts("b"), "b").select("a", "b", "cosine", "wa", "wb", "na", "nb", "ma", "mb")
    judged = map_arrow(both, "a long, b long, cosine double, agreement double, left string, right string, exact boolean", agree)
    judged = written(judged.filter("agreement > 0"), "judged")
    # A name with an initial that fits several given names is left out of all of them. Names that it fits only by a slip count where
    # no other does: the more names there are, the more family names differ in one letter.
    given = judged.select(F.col("a").alias("id"), F.col("left").alias("g"), "exact").union(judged.select("b", "right", "exact")).filter("g is not null")
    same = F.when(F.col("exact"), F.col("g"))
    fits = given.groupBy("id").agg(F.coalesce(F.min(same), F.min("g")).alias("g"), F.coalesce(F.max(same), F.max("g")).alias("most")).filter("g = most")
    fits_a, fits_b = fits.select(F.col("id").alias("a"), F.col("g").alias("left")), fits.select(F.col("id").alias("b"), F.col("g").alias("right"))
    kept = judged.filter("left is null").unionByName(judged.filter("left is not null").join(fits_a, ["a", "left"], "left_semi"))
    kept = kept.filter("right is null").unionByName(kept.filter("right is not null").join(fits_b, ["b", "right"], "left_semi"))
    edges = kept.select("a", "b", (0.5 * F.col("cosine") + 0.5 * F.col("agreement")).alias("s"))
    clusters = average_linkage(edges, LINKAGE)
    entity = keys.join(clusters, keys.id == clusters.node, "left").select("key", F.coalesce("cluster", "id").alias("entity"))
    return spelled.join(entity, "key").select("name", "entity")


def misspelt(counts: DataFrame) -> DataFrame:
    """(w, meant): of the words (`w`, in `n` names) that stand in KNOWN names or more, those that are a slip of a word in at least FEWER
    times as many, with the most frequent such word. In a large collection slips of a frequent word are known words too."""

    def cuts(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(w, n, c) for w, n in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True) for c in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["w", "n", "cut"])

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, meant = (batch.column(i).to_pylist() for i in range(2))
        return batch.filter(pa.array([min(len(a), len(b)) >= 4 and _distance(a, b) <= (1 if min(len(a), len(b)) < 9 else 2) for a, b in zip(w, meant, strict=True)], pa.bool_()))

    keyed = map_arrow(counts.filter((F.col("n") >= KNOWN) & (F.length("w") >= 4)).select("w", "n"), "w string, n long, cut string", cuts)
    more = keyed.select(F.col("w").alias("meant"), F.col("n").alias("often"), "cut")
    pairs = keyed.join(more, "cut").filter(F.col("often") >= FEWER * F.col("n")).select("w", "meant", "often").distinct()
    return map_arrow(pairs, "w string, meant string, often long", near).groupBy("w").agg(F.max_by("meant", F.struct("often", "meant")).alias("meant"))


def _share_a_word(x: list[str], y: list[str]) -> bool:
    """Whether a word of four letters or more stands in both names as it is."""
    return not {_digraphs(w.rstrip("~")) for w in x if len(w.rstrip("~")) >= 4}.isdisjoint(_digraphs(w.rstrip("~")) for w in y)


def _initial_only(x: list[str], y: list[str], nx: list[int], ny: list[int], mx: list[str], my: list[str]) -> tuple[str | None, str | None]:
    """Where one of two names has an initial for the other's given name, a known one: how that given name begins, on the side of the initial.

    `nx` and `ny` say how many names hold each of their words, `mx` and `my` what each word is where it is misspelt."""
    x, y = [w.rstrip("~") for w in x], [w.rstrip("~") for w in y]

    def given(one: list[str], other: list[str], held: list[int], meant: list[str]) -> str | None:
        letters = {w for w in one if len(w) == 1}
        if not letters or sum(len(w) > 1 for w in one) > 1:
            return None
        own = [v for v in one if len(v) > 1]
        full = sorted(m for w, n, m in zip(other, held, meant, strict=True) if n >= KNOWN and len(w) > 1 and w[0] in letters and all(_distance(w, v) > 2 for v in own))
        if not full:
            return None
        return min(map(_digraphs, _nicknames().get(full[0], {full[0]})))[:3]

    return given(x, y, ny, my), given(y, x, nx, mx)


def variant_pairs(entities: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: all pairs of names of one entity, from `variants`."""
    a, b = entities.select("entity", F.col("name").alias("name_a")), entities.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")
