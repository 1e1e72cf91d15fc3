"""Look-alikes, languages, unwanted pages, scans, leaks."""

from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.llm import leaks as lk
from quire.llm import scans
from quire.llm.language import fit, label_errors, languages, named_language, paragraphs
from quire.llm.lookalike import canonical, look_classes, lookalikes, same_look
from quire.llm.pages import covered, page_kinds, read_page

SENTENCES = {
    "en": "The survey of the nave was compared with the record that had been kept in the archive, and it shows how the frame was moved when the roof had to be repaired by the carpenter.",
    "de": "Die Vermessung des Kirchenschiffs wurde mit der Akte verglichen, die im Archiv aufbewahrt ist, und sie zeigt, wie das Fachwerk verlegt wurde, als man das Dach ausbessern musste.",
    "fr": "Le relevé de la nef a été comparé avec le dossier qui était conservé dans les archives, et il montre comment la charpente fut déplacée quand on dut réparer le toit de la maison.",
    "es": "El levantamiento de la nave se comparó con el expediente que se conservaba en el archivo, y muestra cómo el entramado fue trasladado cuando hubo que reparar el techo de la casa.",
}


@pytest.mark.parametrize(
    ("a", "b"),
    [("cafe\u0301", "caf\u00e9"), ("\uff21\uff42\uff11", "Ab1"), ("\ufb01ne \ufb02ag", "fine flag"), ("\u0430\u200bb", "ab"), ("a\u00a0b", "a b"), ("a\u2010b", "a-b"), ("\u0430 \u0435 \u043e", "a e o"), ("e\u0324\u0302", "\u00ea\u0324"), ("a\u00adb", "ab"), ("\u1112\u1161\u11ab", "\ud55c")],
)
def test_same_look(a, b):
    assert same_look([a]) == same_look([b])


@pytest.mark.parametrize(("a", "b"), [("cafe", "café"), ("x2", "x²"), ("a\nb", "a\r\nb"), ("l", "I"), ("A", "a"), ("1", "l"), ("a-b", "a–b"), ("ſ", "s"), ("a  b", "a b")])
def test_other_look(a, b):
    assert same_look([a]) != same_look([b])


def test_recomposition_agrees_with_unicode():
    rng = random.Random(3)
    alphabet = [chr(c) for c in (*range(0xC0, 0x17F), *range(0x300, 0x340), *range(0x1E00, 0x1EF9)) if chr(c) not in "ĳĲŀĿŉſ"] + ["a", "o"]
    texts = ["a" + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 8))) for _ in range(1500)]
    want = [unicodedata.normalize("NFC", t) for t in texts]
    got = same_look(texts)
    assert sum(a != b for a, b in zip(got, want, strict=True) if not any(unicodedata.decomposition(c).startswith("<") for c in unicodedata.normalize("NFC", b))) <= 0


def test_lookalikes(spark):
    rows = [("f", 1, "caf\u00e9"), ("f", 2, "cafe\u0301"), ("f", 2, "cafe\u0301"), ("f", 3, "cafe"), ("f", 4, None), ("f", 5, ""), ("f", 6, "\u200b"), ("g", 7, "cafe\u0301"), ("f", 8, "caf\u00e9"), ("f", 9, "x" * 100_000)]
    df = spark.createDataFrame(rows, "field string, id long, text string").withColumn("look", F.lit("clash"))
    assert sorted(tuple(r) for r in lookalikes(df, "field", "id", "text").collect()) == [("f", 1, 2), ("f", 2, 8)]
    assert lookalikes(df.limit(0), "field", "id", "text").count() == 0
    assert sorted(tuple(r) for r in look_classes(df, "field", "id", "text").collect()) == [("f", 1, 1, 2, 3), ("f", 2, 1, 2, 3), ("f", 8, 1, 2, 3)]
    assert {r.id: r.canonical for r in canonical(df, "text").filter("id in (2, 4, 5)").collect()} == {2: "caf\u00e9", 4: None, 5: ""}


def test_named_language(spark):
    labels = ["EN", "en-GB", "Deutsch", "fra", "Español", "und", "", None, "pt-BR"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r.v for r in df.select(named_language(F.col("l")).alias("v")).collect()] == ["en", "en", "de", "fr", "es", None, None, None, "pt"]


def test_languages(spark):
    model = fit([(code, paragraphs(s)[1][0][0]) for code, s in SENTENCES.items() for _ in range(3)])
    rows = [(1, SENTENCES["en"]), (2, SENTENCES["de"] + "\n\n" + SENTENCES["de"] + "\n\n" + SENTENCES["fr"]), (3, None), (4, ""), (5, "Contents"), (6, "qwx zzkv " * 40), (7, SENTENCES["es"].upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("clash"))
    found = languages(df, "doc_id", "text", model)
    out = {r.doc_id: r for r in found.collect()}
    assert [out[i].lang for i in range(1, 8)] == ["en", "de", None, None, None, None, "es"]
    assert [s.lang for s in out[2].segments] == ["de", "de", "fr"] and out[2].confidence > 0.5
    docs = spark.createDataFrame([(1, "en"), (2, "ger"), (7, None)], "doc_id long, language string")
    runs = spark.createDataFrame([(10, 1, "en", False), (11, 2, "de", None), (12, 2, None, True), (12, 2, None, True)], "result_id long, document_id long, primary_lang string, is_multilingual boolean")
    got = sorted(tuple(r) for r in label_errors(found, docs, runs).collect())
    assert got == [("documents.language", 2, "fr"), ("documents.language", 7, "es"), ("language_results.is_multilingual", 11, "de"), ("language_results.primary_lang", 12, "de")]
    assert languages(df.limit(0), "doc_id", "text", fit([])).count() == 0
    # A language that the model doesn't know is rejected by its distance, not left out before.
    other = "Kościół parafialny został zbudowany w roku tysiąc osiemset dwunastym przez cieśli, którzy pracowali pod kierunkiem mistrza z sąsiedniej wsi i zostawili po sobie rysunki."
    row = languages(spark.createDataFrame([(1, other)], "doc_id long, text string"), "doc_id", "text", model).first()
    assert not row.spam and row.lang is None and [s.lang for s in row.segments] == [None]


def test_covered_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(0, 30)
        words = [rng.choice("abcdefgh"[: rng.choice([2, 5, 8])]) * rng.randint(1, 2) for _ in range(n)]
        for least in (2, 4):
            mark = [False] * n
            for size in range(2, n + 1):
                at: dict[tuple[str, ...], list[int]] = {}
                for i in range(n - size + 1):
                    at.setdefault(tuple(words[i : i + size]), []).append(i)
                for starts in at.values():
                    if len(starts) >= least:
                        for i in starts:
                            mark[i : i + size] = [True] * size
            assert covered(words, least)[0] == sum(len(w) for w, m in zip(words, mark, strict=True) if m)
            assert covered(words, 2, least)[1] == covered(words, least)[0]


@pytest.mark.parametrize(
    ("text", "spam"),
    [
        ("cheap oak beams " * 40, True),
        ("\n".join(f"https://shop{i}.example/p/{i}" for i in range(20)), True),
        (" ".join(f"#tag{i}x" for i in range(30)), True),
        ("\n".join(f"SKU {1000 + i} | Brand | oak | EUR {i}.50" for i in range(12)), True),
        (SENTENCES["en"], False),
        (SENTENCES["en"] + "\n\n" + SENTENCES["de"] + "\n\n[1] https://data.example/x/1\n[2] https://data.example/x/2\n[3] https://data.example/x/3", False),
        ("References\n" + "\n".join(f"Smith, J. A study of nave {i}. {1950 + i}" for i in range(15)), False),
        ("\n".join(f"Term{i}, {i}, {i + 3}, {i + 9}" for i in range(15)), False),
        ("\n".join(f"Place{i}\t{1600 + i}\t{i}.5\t{i}.7" for i in range(15)), False),
        ("\n".join(f"On the nave of Place{i} ........ {i}" for i in range(15)), False),
        ("", False),
        ("Kościół parafialny został zbudowany w roku tysiąc osiemset dwunastym przez cieśli, którzy pracowali pod kierunkiem mistrza z sąsiedniej wsi i zostawili po sobie rysunki.", False),
        ("Церковь была построена в начале девятнадцатого века плотниками из соседней деревни, которые оставили после себя чертежи и записи о ходе работ.", False),
        ("Kyrkan byggdes i början av artonhundratalet av timmermän från grannbyn, som lämnade efter sig ritningar och anteckningar om arbetets gång.", False),
        ("Η εκκλησία χτίστηκε στις αρχές του δέκατου ένατου αιώνα από ξυλουργούς του γειτονικού χωριού, οι οποίοι άφησαν σχέδια και σημειώσεις.", False),
        ("教会は十九世紀の初めに隣の村の大工によって建てられた。屋根は数年後に修理が必要になった。", False),
        # Eighty slogans, eight times each on a page of five thousand words: no string is dense, all are repeated.
        (". ".join(" ".join(f"{w}{k % 80}" if j % 3 else w for j, w in enumerate("the best of oak and beam for you".split())) for k in range(640)) + ".", True),
    ],
)
def test_pages(text, spam):
    assert read_page(text).is_spam is spam


def test_page_kinds_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b " * 50_000), (3, "a b " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spam", F.lit("clash"))
    assert sorted((r.doc_id, r.spam) for r in page_kinds(df, "doc_id", "text").collect()) == [(1, False), (2, False), (3, True), (3, True)]
    assert page_kinds(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize(("bad", "good"), [("rccords", "records"), ("werk5tatt", "werkstatt"), ("cornrnission", "commission"), ("griind", "grund"), ("naheren", "näheren"), ("oſfen", "offen"), ("m@terial", "material"), ("wircl", "wird")])
def test_misreadings_are_cheap(bad, good):
    assert scans.misreading(bad, good) <= scans.MOST < scans.misreading("nave", good)


@pytest.mark.parametrize("line", ["- 338 -", "[207]", "Seite 288", "p. 270", "83 / 952", "· 27 ·", "page 9", "2lO / 824"])
def test_page_numbers(line):
    assert scans.furniture(["the first line of a paragraph that goes on", line, "and ends here with a stop."]) == {1}


def test_scans(spark):
    body = "the survey of the parish records was compared with the frame"
    rows = [("blocks.text", i, 1, i, 1, False, body) for i in range(40)]
    rows += [
        ("blocks.text", 100, 2, 0, 0, True, "A STUDY OF NAVES"),
        ("blocks.text", 101, 2, 0, 1, False, "the survey of the parish rccords was com-\npared with the frame"),
        ("blocks.text", 102, 2, 0, 2, False, "the frame was kept sepa-"),
        ("blocks.text", 103, 2, 0, 3, False, "rate from the records"),
        ("blocks.text", 104, 2, 1, 0, False, None),
        ("blocks.text", 105, 2, 1, 1, False, ""),
        ("text_segments.text", 1, 2, 0, 0, False, "the survey of the parish\n- 12 -\nA study of naves\nrecords was compared with the frame"),
        ("text_segments.text", 1, 2, 0, 0, False, "the survey of the parish\n- 12 -\nA study of naves\nrecords was compared with the frame"),
        ("text_segments.text", 2, 2, 0, 1, False, "a well-\nknown frame"),
        ("text_segments.text", 3, 2, 0, 2, False, "the well-known frame, a well known to the known and well, well known known known well well well known"),
    ]
    df = spark.createDataFrame(rows, scans.SOURCE).withColumn("word", F.lit("clash"))
    work = scans.Scans(df.drop("word"), spark.createDataFrame([], "document_id long, form string"))
    got = sorted(tuple(r) for r in work.noise().collect())
    assert got == sorted([("blocks.text", 100, "furniture"), ("blocks.text", 101, "hyphen"), ("blocks.text", 101, "misread"), ("blocks.text", 102, "hyphen"), ("text_segments.text", 1, "furniture")])
    fixed = {(r.field, r.row_id): r.text for r in work.repaired().collect()}
    assert fixed["blocks.text", 101] == body and fixed["blocks.text", 100] is None and fixed["blocks.text", 102] == "the frame was kept sepa"
    assert fixed["text_segments.text", 1] == body and fixed["text_segments.text", 2] == "a well-known frame"


def test_known_headers_at_the_edges_of_a_text(spark):
    rows = [
        ("blocks.text", 1, 2, 1, 0, True, "PROCEEDINGS OF THE SURVEY"),
        ("blocks.text", 2, 2, 2, 1, False, "PROCEEDINGS OF THE SURVEY\nrecorded before the frame was moved."),
        ("blocks.text", 3, 2, 3, 1, False, "recorded before the frame was\nProceedings of the Survey"),
        ("blocks.text", 4, 2, 4, 1, False, "Proceedings of the survey 12"),
        ("blocks.text", 5, 3, 2, 1, False, "PROCEEDINGS OF THE SURVEY\nrecorded before the frame was moved."),
    ]
    work = scans.Scans(spark.createDataFrame(rows, scans.SOURCE), spark.createDataFrame([], "document_id long, form string"))
    assert {r.id for r in work.headers.collect()} == {2, 3, 4}
    fixed = {r.row_id: r.text for r in work.repaired().collect()}
    assert fixed[2] == "recorded before the frame was moved." and fixed[3] == "recorded before the frame was" and fixed[4] is None


def test_short_misreadings_at_any_size_of_input(spark):
    rows = [("blocks.text", i, 1, i, 1, False, "la nave se conserva en la torre") for i in range(40)]
    rows += [("blocks.text", 100, 2, 1, 1, False, "la nave 5e conserva en la torre"), ("blocks.text", 101, 2, 2, 1, False, "la nave l6 conserva en la torre")]
    df, none = spark.createDataFrame(rows, scans.SOURCE), spark.createDataFrame([], "document_id long, form string")
    for bits in (scans.FILTER_BITS, 6):
        assert {(r.id, r.word, r.good) for r in scans.Scans(df, none, bits).misread().collect()} == {(100, "5e", "se"), (101, "l6", "16")}


def test_scans_of_nothing(spark):
    work = scans.Scans(spark.createDataFrame([], scans.SOURCE), spark.createDataFrame([], "document_id long, form string"))
    assert work.noise().count() == 0 and work.repaired().count() == 0


def _passage(seed: int, n: int = 60) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def test_leaks(spark):
    p, q = _passage(1), _passage(2)
    other = " ".join(_passage(3, 300))
    replaced = [("zzz" if i % 9 == 4 else w) for i, w in enumerate(p)]
    too_many = [("zzz" if i % 5 == 4 else w) for i, w in enumerate(p)]
    docs = [
        (1, other + ". " + " ".join(p).upper() + " " + other),
        (2, other + " " + ",\n".join(q[10:32]) + " " + other),
        (3, other + " " + " ".join(q[10:28]) + " " + other),
        (4, " ".join(replaced)),
        (5, " ".join(too_many)),
        (6, None), (7, ""), (8, "Read the passage and answer."),
        (1, other + ". " + " ".join(p).upper() + " " + other),
    ]
    ask = ["Read the passage and answer. " + " ".join(w) + ". Which claim about it follows?" for w in (p, q, _passage(5), _passage(6))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([*enumerate(ask), (9, None), (8, "")], "item_id long, text string")
    out = {(r.item_id, r.doc_id): (r.run_words, r.edits) for r in lk.leaks(df, "doc_id", "text", items, "item_id", "text").collect()}
    assert set(out) == {(0, 1), (1, 2), (0, 4)}
    assert out[0, 1] == (60, 0) and out[1, 2][0] == 22 and out[0, 4][1] == 7
    assert lk.leaks(df.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert lk.leaks(df, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_leak_search_against_brute_force():
    rng = random.Random(7)
    items = lk.Items([0, 1, 2], [_passage(i, 40) for i in range(3)])
    for _ in range(40):
        k, n = rng.randrange(3), rng.randint(15, 40)
        at = rng.randint(0, 40 - n)
        text = " ".join([*_passage(rng.randrange(100, 999), 30), *items.words[k][at : at + n], *_passage(rng.randrange(100, 999), 30)])
        assert {(i, run) for _, i, run, _ in items.search([text])} == ({(k, n)} if n >= lk.RUN_WORDS else set())


def test_scans_with_a_full_filter_and_small_counts(spark):
    """Neither the filter's size nor the words counted at a time changes a row."""
    body = "the survey of the parish records was compared with the frame"
    rows = [("blocks.text", i, 1, i, 1, False, body) for i in range(40)]
    rows += [("blocks.text", 100, 2, 0, 1, False, "the frame of the parish stood for l9 years, and tbe rccords of tlie survey"), ("blocks.text", 101, 2, 0, 2, False, "a frame of 1o5 parts")]
    df = spark.createDataFrame(rows, scans.SOURCE)
    none = spark.createDataFrame([], "document_id long, form string")
    found = []
    for bits, held in ((23, 2_000_000), (6, 3)):
        work = scans.Scans(df, none, bits, held)
        found.append((sorted(tuple(r) for r in work.noise().collect()), sorted((r.id, r.word, r.good) for r in work.misread().collect())))
    assert found[0] == found[1]
    assert found[0][1] == [(100, "l9", "19"), (100, "rccords", "records"), (100, "tbe", "the"), (100, "tlie", "the"), (101, "1o5", "105")]


def test_keys_meet_where_two_confusions_lead():
    """Every word that at most two confusions (in words of up to three letters, one) make of a right word shares a key with it."""
    rng = random.Random(5)
    for good in ("for", "the", "nave", "frame", "modern", "über", "church", "parish", "archives", "mitte"):
        for _ in range(60):
            bad = good
            for _ in range(2 if len(good) > 3 else 1):
                options = [(x, y, i) for x, y in scans.PAIRS for i in range(len(bad)) if bad.startswith(y, i)]
                x, y, i = rng.choice(options)
                bad = bad[:i] + x + bad[i + len(y) :]
            if bad != good and abs(len(bad) - len(good)) <= 2 and len(good) < scans.SHORT and scans.misreading(bad, good) <= scans.MOST:
                assert scans.good_keys(good) & scans.bad_keys(bad), (bad, good)


def test_items_keep_their_instruction_however_they_are_blocked(spark):
    items = [(k, "Read the text below and answer. " + " ".join(_passage(k)).capitalize() + f". What does the word {k} mean?") for k in range(6)]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(_passage(0))), (2, "Read the text below and answer."), (3, " ".join(_passage(4)[5:30]))], "doc_id long, text string")
    found = [sorted(tuple(r) for r in lk.leaks(docs, "doc_id", "text", items_df, "item_id", "text", n).collect()) for n in (lk.BLOCK_CHARS, 100)]
    assert found[0] == found[1] and [r[:2] for r in found[0]] == [(0, 1), (4, 3)] and found[0][0][2] == 60
