"""Operators for training text against brute force, round trips and defined cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import language, packing, personal, quality, scanned, spans, tokenize, words

EN = "According to our records, the payment for the kitchen renovation has been entered and will be shown on the next statement. "
SV = "Enligt våra uppgifter har betalningen för takreparationen bokförts och visas på nästa utdrag så att du inte behöver göra något mer. "
DE = "Nach unseren Unterlagen wurde die Zahlung für die Dachreparatur bestätigt und erscheint auf dem nächsten Auszug der Bank. "
NL = "Volgens onze gegevens is de betaling van de rekening ontvangen en dat ziet u op het volgende overzicht van de bank. "
ROW = "src string, row_id long, text string"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: tuple((x is None, x) for x in r))


# --- 8: encoding --------------------------------------------------------------


def test_ids_equal_the_plain_encoder(spark):
    texts = [None, "", "a", "  two  blanks\r\n\ttab", "Ångström 日本 🙂 é", "<|endoftext|>", "x" * 5000, ("word " * 9 + "\n") * 9000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode_corpus(df).collect()}
    encoder = tokenize.encoder()
    for i, t in enumerate(texts):
        assert got[i] == ([] if not t else encoder.encode_ordinary(t))
    back = tokenize.decode_corpus(tokenize.encode_corpus(df))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert tokenize.round_trip(df).filter("not same").count() == 0


def test_safe_cuts_change_nothing():
    rng = random.Random(4)
    for _ in range(50):
        text = "".join(rng.choice(["word", " ", "  ", "\n", "12", "'s", "é", ".,", "\t", "日本"]) for _ in range(200))
        pieces = tokenize.safe_pieces(text, 37)
        assert "".join(pieces) == text
        assert [i for p in pieces for i in tokenize.encoder().encode_ordinary(p)] == tokenize.encoder().encode_ordinary(text)


# --- 9: packing ----------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_packing_holds_everything_once(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 9, 10, 11, 25, 64, rng.randint(1, 40)]) for _ in range(400)] + [None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n_tokens long")
    got = packing.pack(df, 10).collect()
    filled, parts = {}, {}
    for r in got:
        filled[r["container"]] = filled.get(r["container"], 0) + r["length"]
        parts.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert max(filled.values()) <= 10
    for i, n in enumerate(sizes):
        pieces = sorted(parts[i])
        assert sum(x for _, x in pieces) == (n or 0)
        assert len(pieces) == max(1, -(-(n or 0) // 10))
    total = sum(n or 0 for n in sizes)
    assert len([c for c, n in filled.items() if n]) <= -(-total // 10) * 1.25 + 1


def test_packing_of_nothing_and_of_one_hot_length(spark):
    none = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.pack(none, 10).count() == 0
    hot = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(3).cast("long").alias("n_tokens"))
    report = packing.fill_report(packing.pack(hot, 10), 10).first()
    assert (report["containers"], report["fullest"]) == (334, 9)


# --- 10: shared spans --------------------------------------------------------------


def planted(rng, least):
    letters = "abcdefghij klmnop"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 900))) for _ in range(40)]
    for _ in range(25):
        span = "".join(rng.choice(letters) for _ in range(rng.choice([least - 1, least, least + 1, least + 60])))
        for i in rng.sample(range(40), 2):
            at = rng.randint(0, len(texts[i]))
            texts[i] = texts[i][:at] + span + texts[i][at:]
    return texts + [texts[0], texts[1] * 2, "-" * 700, "-" * 900, "ab" * 300, None, "", " ", texts[2]]


def brute_pairs(texts, least):
    seen = {}
    for i, t in enumerate(texts):
        for k in range(len(t or "") - least + 1):
            seen.setdefault(t[k : k + least], set()).add(i)
    return {(a, b) for s in seen.values() for a in s for b in s if a < b}


@pytest.mark.parametrize("seed", range(3))
def test_pairs_equal_brute_force(spark, seed):
    texts = planted(random.Random(seed), 300)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, rep int")
    got = [tuple(r) for r in spans.sharing_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(texts, 300)


def test_share_equals_brute_force(spark):
    texts = planted(random.Random(9), 300)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    where = {}
    for i, t in enumerate(texts):
        for k in range(len(t or "") - 299):
            where.setdefault(t[k : k + 300], set()).add(i)
    for r in spans.shared_share(df).collect():
        t = texts[r["doc_id"]] or ""
        cover = np.zeros(len(t), bool)
        for k in range(len(t) - 299):
            if where[t[k : k + 300]] - {r["doc_id"]}:
                cover[k : k + 300] = True
        assert r["shared_chars"] == cover.sum(), r


def test_spans_of_nothing(spark):
    assert spans.sharing_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        spans.sharing_pairs(spark.createDataFrame([], "doc_id long, text string"), least=50)
    assert spans.shared_share(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("alphabet", ["prose", "abcd", "abcdefghijklmnopqrstuvwxyz ", "ab"])
def test_spans_at_the_limit_have_a_run_in_common(alphabet):
    """Spans of exactly 300 characters between different neighbours, 1,700 of each kind."""
    rng = random.Random(alphabet)
    vocabulary = (EN + SV + DE).split()

    def some(n):
        if alphabet == "prose":
            t = ""
            while len(t) < n:
                t += rng.choice(vocabulary) + " " * rng.choice([1, 1, 1, 2, 30])
            return t[:n]
        return "".join(rng.choices(alphabet, k=n))

    for _ in range(17):
        span = [some(300) for _ in range(100)]
        left, right = ([some(rng.randint(0, 90)) + s + some(rng.randint(0, 90)) for s in span] for _ in range(2))
        names = []
        for texts in (left, right):
            run, which, _, _ = spans.run_names(texts, spans.cover_of(300))
            names.append(set(zip(which.tolist(), run.tolist())))
        both = {i for i, _ in names[0] & names[1]}
        assert both == set(range(100))


# --- 1: languages -------------------------------------------------------------------


def test_labels():
    named = words.languages_named
    assert named("en-GB") == {"en"} and named("Danish and Swedish") == {"da", "sv"} and named("DEU") == {"de"}
    assert named("?") == named("und") == named(None) == named("") == set()


def test_passages(spark):
    docs = [
        (1, EN * 3 + "\n\n" + SV * 2, "English", "scan", "b1"), (2, SV * 4, "sv-SE", "scan", "b1"), (3, DE * 3, "n/a", "scan", "b1"),
        (4, EN * 3 + "\n\nVänliga hälsningar", "en", "scan", "b1"), (5, "- a roof\n- the house\n" * 20, None, "scan", "b1"), (6, None, None, None, None),
        (7, "", "en", None, None), (8, NL * 2, "Dutch", "scan", "b1"), (9, "gima leboba noske staba " * 20, "en", "scan", "b1"),
    ]
    df = spark.createDataFrame(docs, "row_id long, text string, label string, channel string, batch string").withColumn("src", F.lit("documents"))
    model = language.fit(df, "text", "label", key="row_id")
    got = language.passages(df, model)
    assert rows(language.unnamed(got), "row_id", "lang") == [(1, "sv"), (3, "de")]
    best = {r["row_id"]: r["language"] for r in language.main_language(got).collect()}
    assert {k: best[k] for k in (1, 2, 3, 8)} == {1: "en", 2: "sv", 3: "de", 8: "nl"}
    assert language.passages(df.limit(0), model).count() == 0


def test_confidence_does_not_fall_with_length():
    danish = "Ifølge vores oplysninger er betalingen for tagreparationen blevet bogført og vises på det næste udtog, så du ikke behøver gøre mere. "
    for model in (language.Model({}), language.Model({w: {"da": 3, "sv": 1} for w in language._WORD.findall(danish.lower())})):
        flat = np.full((1, len(words.LANGUAGES)), -np.log(len(words.LANGUAGES)), np.float32)
        seen = [language.passages_of([danish * n], flat.copy(), [None], model)[0] for n in (1, 16, 80, 1500)]
        assert all(len(p) == 1 and p[0][0] == "da" for p in seen)
        sure = [p[0][1] for p in seen]
        assert sure == sorted(sure) and sure[-1] > 0.99


def test_the_prior_counts_once_a_passage():
    model = language.Model({})
    flat = np.full((1, len(words.LANGUAGES)), -np.log(len(words.LANGUAGES)), np.float32)
    text = SV * 30
    for label in ("English", "German and English", "en"):
        assert language.passages_of([text], flat.copy(), [label], model)[0][0][:2] > ("sv", 0.99)


# --- 4: statistics -------------------------------------------------------------------


def test_kinds(spark):
    texts = {
        1: (EN * 4, "prose"), 2: ("\n".join(f"{i}) the roof repair {i * 7}" for i in range(1, 12)), "list"),
        3: ("\n".join(f"2024-01-{i:02d} | item | {i * 3},20 | {i}" for i in range(1, 12)), "table"),
        4: ("|||||||| ~~~~~~~~ iiiiiiii ........ -------- llllllll\n" * 4, "junk"), 5: ("xq zrtk bdfg hjkl mnpq rstv wxzc\n" * 5, "junk"),
        6: ("5a9 b3o1s 6tr8e n0u3i 9ol8a b5e6r t1u9n\n" * 5, "junk"), 7: ("short", None), 8: (None, None), 9: ("   " * 30, None), 10: (SV * 4, "prose"),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "extract_id long, text string")
    got = {r["extract_id"]: r for r in quality.text_kinds(df).collect()}
    assert {i: r["kind"] for i, r in got.items()} == {i: k for i, (_, k) in texts.items()}
    assert got[8]["words"] == 0 and got[1]["punct_line_share"] == 1.0 and 0.2 < got[1]["common_share"] < 0.6
    assert quality.text_kinds(df.limit(0)).count() == 0


def test_divergence_is_a_distance_of_distributions():
    p, q = np.array([[0.5, 0.5, 0.0]]), np.array([0.0, 0.5, 0.5])
    assert quality.divergence(p, p[0])[0] == 0 and np.isclose(quality.divergence(p, q)[0], 0.5)
    assert np.isclose(quality.divergence(np.array([[1.0, 0, 0]]), np.array([0, 0, 1.0]))[0], 1.0)


# --- 6: personal information ------------------------------------------------------------

PRIVATE = (
    "Please contact Vera K. Lindqvard on 070-174 06\n05 or vera.lind+post@mail.example.org. We met Lindqvard, Olof at Flat 4, 54 Harrow Lane. "
    "The form was signed by O. Lindqvard, born under number 811228-9874. Order 0513-059649 replaces parcel 811228-9874. Write @desk. "
    "Robert Hall Motors Ltd charged 33 GBP. Kontakta ÅSA BERGVIK, Lindåsgatan 12 B, lgh 1101, på +44 1632 960225."
)
WANT = [
    ("address", "Flat 4, 54 Harrow Lane"), ("address", "Lindåsgatan 12 B, lgh 1101"), ("email", "vera.lind+post@mail.example.org"), ("idnum", "811228-9874"),
    ("name", "Lindqvard, Olof"), ("name", "O. Lindqvard"), ("name", "Vera K. Lindqvard"), ("name", "ÅSA BERGVIK"), ("phone", "+44 1632 960225"),
    ("phone", "070-174 06 05"),
]
GIVEN = frozenset({"vera", "olof", "robert", "asa"})


def test_findings(spark):
    df = spark.createDataFrame([("x", 1, PRIVATE), ("x", 2, None), ("x", 3, "")], ROW)
    assert rows(personal.findings(df, GIVEN), "kind", "value") == WANT
    assert personal.findings(df.limit(0), GIVEN).count() == 0


def test_placeholders_leave_the_rest(spark):
    df = spark.createDataFrame([("x", 1, PRIVATE), ("x", 2, None), ("x", 3, "none here\n")], ROW)
    got = {r["row_id"]: r["text"] for r in personal.placeholders(df, GIVEN).collect()}
    assert got[2] is None and got[3] == "none here\n"
    want = PRIVATE.replace("06\n05", "06 05")
    for kind, value in sorted(WANT, key=lambda x: -len(x[1])):
        head, _, tail = want.partition(value)
        want = f"{head}[{kind.upper()}]{tail}"
    assert got[1] == want
    assert personal.placeholders(df.limit(0), GIVEN).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_surrogates_are_consistent_and_distinct(spark, monkeypatch, most):
    monkeypatch.setattr(personal, "MAX_REDRAWN", most)
    df = spark.createDataFrame([("x", i, f"We met Vera Lindqvard{c} and Lindqvard{c}, Vera on 0701740{i:03d}. Write to vera.lindqvarda@mail.example.") for i in range(40) for c in "a"], ROW)
    got = [r["text"] for r in personal.pseudonymise(df, GIVEN, "key").orderBy("row_id").collect()]
    first = [t.split(" and ")[0] for t in got]
    assert len(set(first)) == 1 and "Vera" not in first[0]
    phones = [t.split(". Write")[0].rsplit(" ", 1)[1] for t in got]
    assert len(set(phones)) == 40 and all(len(p) == 10 for p in phones)
    name = first[0].removeprefix("We met ").split()
    assert f"{name[1]}, {name[0]}" in got[0] and f"{name[0]}.{name[1]}@mail.".lower() in got[0]
    other = personal.pseudonymise(df, GIVEN, "other key").orderBy("row_id").first()["text"]
    assert other != got[0]


def test_surrogates_keep_type_and_format():
    def made(kind, value):
        return personal.surrogate(kind, value, "key", None, frozenset({"john", "jane", "vera"}))

    for value in ("811228-9874", "198112289874", "811288-9874", "8112289864"):
        new = made("idnum", value)
        digits = "".join(c for c in new if c.isdigit())[-10:]
        assert [c.isdigit() for c in new] == [c.isdigit() for c in value] and personal.luhn(digits)
        assert 1 <= int(digits[2:4]) <= 12 and 1 <= int(digits[4:6]) % 60 <= 28 and int(digits[4:6]) // 60 == int(value[-7 if "-" in value else -6]) // 6
        assert int(digits[8]) % 2 == int(value[-2]) % 2
    assert made("idnum", "811228-9874").replace("-", "") == made("idnum", "198112289874")[2:]
    assert "".join(made("phone", "+44 1632 960225").split()[1:]) == made("phone", "01632 960225")[1:].replace(" ", "")
    given, last = made("name", "John Smith").split()
    assert made("name", "Smith, John") == f"{last}, {given}" and made("name", "J. Smith") == f"{given[0]}. {last}" and made("name", "JOHN SMITH") == f"{given} {last}".upper()
    assert made("email", "john.smith@mail.example.org").startswith(f"{given}.{last}@mail.".lower())
    assert all("CYRILLIC" in __import__("unicodedata").name(c) for c in made("name", "Иван Петров") if c.isalpha())
    assert made("address", "221 Baker Street").endswith(" Street") and made("address", "Lindåsgatan 12 B, lgh 1101").split()[0].endswith("gatan")
    assert made("address", "12 bis, rue de la Paix").split()[1:5] == ["bis,", "rue", "de", "la"]
    assert personal.is_female("anna") and not personal.is_female("john") and personal.is_female("birgitta") and not personal.is_female("ottokar")
    assert made("name", "Vera Holm").split()[0][-1] == "a"


def test_no_surrogate_is_shared_or_real(spark):
    # Two figures are free, so nearly all of the numbers clash at first.
    df = spark.createDataFrame([("x", i, f"Call 0701 {i:06d} or Vera Bo{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'aeiou'[i % 5]}n now.") for i in range(0, 3000)], ROW)
    found = personal.findings(df, GIVEN)
    drawn = personal.drawn_entities(found, "key", GIVEN).collect()
    for space in ({"given", "word"}, {"phone"}):
        made_ = [r["made"] for r in drawn if r["kind"] in space]
        assert len(made_) == len(set(made_)) and not set(made_) & {r["entity"] for r in drawn if r["kind"] in space}
    rows_ = personal.pseudonyms(found, "key", GIVEN).select("kind", "value", "surrogate").distinct().collect()
    assert len({r["surrogate"] for r in rows_}) == len(rows_)


def test_given_names_are_learned_at_any_size(spark):
    last = "Lindhag Bergfalk Stenquer Almdahl Norrvik Sjoholt Ekmark Grankvist Hagdorf Tornblad".split()
    for n in (5, 20, 120):
        given = [f"{a}{b}{c}" for a in ("Zek", "Mor", "Tal", "Vin", "Pos") for b in ("ika", "olo", "unde", "eri", "aba") for c in ("ra", "so", "k", "ma", "tt")][:n]
        df = spark.createDataFrame([(f"{g} {x}", "Kontakta " + f"{g} {x} nu.") for g in given for x in last], "correspondent string, summary string")
        learned = personal.learn_given(df)
        assert {g.lower() for g in given} <= learned and "kontakta" not in learned


def test_very_long_texts(spark, vocabulary):
    """Long runs of blanks, of one letter and of words are read in time that follows their length."""
    for text in (" " * 400_000 + "x", "a" * 400_000, ("word " * 20 + "\n") * 4_000, "\n" * 200_000, "- " * 100_000, "1 " * 150_000, "Aa " * 100_000, "@" * 100_000):
        df = spark.createDataFrame([("x", 1, text)], ROW)
        assert personal.findings(df, GIVEN).count() >= 0
        assert scanned.findings(df, vocabulary).count() >= 0
        assert quality.text_kinds(df.withColumnRenamed("row_id", "extract_id")).count() == 1
        assert len(language.sentences(text)) >= 0
        assert spans.sharing_pairs(df.union(df.withColumn("row_id", F.lit(2).cast("long"))).withColumnRenamed("row_id", "doc_id")).count() == 1


# --- 3: scanned pages ---------------------------------------------------------------------

PAGES = (
    "NORTH BANK LTD\nPage 1\nAccording to our records, the payment for the kitchen reno-\nvation has been entered and will be shown on\n"
    "NORTH BANK LTO\nPage 2\nthe next state-\n\nPage 3\nNORTH BANK LTD\nment of the second-\nhand piano. The paymcnt was recorclecl by the bank, and will be\n"
    "shown with the Ein-\nund Ausgang. See HK-\n13731546 and the co-operative share.\n"
)


@pytest.fixture(scope="module")
def vocabulary(spark):
    text = EN * 3 + "the renovation was recorded. second-hand piano of the statement. The payment was recorded by the bank. "
    df = spark.createDataFrame([("x", i, text) for i in range(30)] + [("x", 30, PAGES)], ROW)
    return scanned.learn(df)


def test_scan_findings(spark, vocabulary):
    df = spark.createDataFrame([("x", 1, PAGES), ("x", 2, None), ("x", 3, ""), ("x", 4, "zq xw vbn 1l0 ;; ##\n" * 30)], ROW)
    got = rows(scanned.findings(df, vocabulary).distinct(), "row_id", "kind", "item")
    assert got == [
        (1, "glyph", "payment"), (1, "glyph", "recorded"), (1, "header", "NORTH BANK LTD"), (1, "header", "NORTH BANK LTO"),
        (1, "hyphen", "renovation"), (1, "hyphen", "second-hand"), (1, "hyphen", "statement"), (1, "page", "Page 1"), (1, "page", "Page 2"), (1, "page", "Page 3"),
    ]
    assert scanned.findings(df.limit(0), vocabulary).count() == 0


def test_scan_findings_do_not_depend_on_the_size_of_the_corpus(spark):
    # One misreading in a table is ten in ten copies of it; no word around is a frequent one.
    text = EN * 3 + "The telephone was repaired. "
    df = spark.createDataFrame([("x", i, text) for i in range(30)] + [("x", 30, EN + "Zqa zqb telephorie zqc zqd zqe. The tele-\nphorie was repaired. ")], ROW)
    ten = df
    for _ in range(9):
        ten = ten.unionAll(df)
    once = rows(scanned.findings(df).distinct(), "row_id", "kind", "item")
    assert (30, "glyph", "telephone") in once and (30, "hyphen", "telephone") in once
    assert rows(scanned.findings(ten).distinct(), "row_id", "kind", "item") == once


def test_context_only_chooses_between_candidates():
    pairs = np.zeros((2, 3), np.float32)
    pairs[0, 0], pairs[1, 1] = 50, 50
    word, context = scanned.skip_gram(pairs)
    company = scanned.Company({"ships": 0, "trees": 1, "the": 2}, dict(zip(["harbour", "barbour"], word)), context)
    w = scanned.Words(frozenset(), {"8arbour": ("harbour", "barbour"), "modcrn": ("modern",)}, frozenset(), company)
    assert w.correct("modcrn", ["trees"]) == "modern" and w.correct("modern", []) is None
    assert w.correct("8arbour", ["trees"]) == "barbour" and w.correct("8arbour", ["ships"]) == "harbour" and w.correct("8arbour", []) == "harbour"


def test_joined_links_find_the_same(spark, monkeypatch):
    text = EN * 3 + "the renovation was recorded. second-hand piano of the statement. The payment was recorded by the bank. "
    df = spark.createDataFrame([("x", i, text) for i in range(30)] + [("x", 40, PAGES), ("x", 40, PAGES), ("y", 1, None), ("y", None, PAGES + "the p@yment")], ROW)
    shipped = rows(scanned.findings(df))
    mended = rows(scanned.repair(df))
    monkeypatch.setattr(scanned, "MAX_LINKS", 0)
    assert scanned.learn(df)[1] is not None
    assert rows(scanned.findings(df)) == shipped and rows(scanned.repair(df)) == mended
    assert {"payment", "recorded"} <= {r[3] for r in shipped if r[2] == "glyph"}


def _lookalikes(pairs: int):
    """Texts in which each of so many misreadings could mean two words, and the words around tell which."""
    ends = ["".join("aekopvxyz"[i // 9**k % 9] for k in range(5)) for i in range(pairs)]
    ships = [("x", i, f"The harbour of ships was {' '.join(f'h{e} ship' for e in ends[i::40])}. ") for i in range(40)]
    trees = [("x", i + 40, f"The forest of trees was {' '.join(f'b{e} tree' for e in ends[i::40])}. ") for i in range(40)]
    read = [("y", i, f"The ship and ship of 6{e} ship and ship was there. The tree or tree of 6{e} tree or tree is there. ") for i, e in enumerate(ends[:5])]
    rest = [("y", i + 5, f"The ship and the ship of 6{e} is for the tree and the ship. ") for i, e in enumerate(ends[5:])]
    return [r for r in ships + trees for _ in range(6)] + read + rest, [(i, w + e) for i, e in enumerate(ends[:5]) for w in "bh"]


@pytest.mark.parametrize("bounds", [{"DENSE": 0}, {"DENSE": 0, "MAX_SEVERAL": 0}, {"MAX_LINKS": 0}, {"MAX_LINKS": 0, "DENSE": 0}])
def test_many_lookalikes_find_the_same(spark, monkeypatch, bounds):
    texts, meant = _lookalikes(90)
    df = spark.createDataFrame(texts, ROW)
    once = rows(scanned.findings(df).filter("src = 'y'"))
    assert [(i, item) for _, i, kind, item in once if kind == "glyph" and i < 5] == meant
    for name, value in bounds.items():
        monkeypatch.setattr(scanned, name, value)
    assert rows(scanned.findings(df).filter("src = 'y'")) == once


def test_no_number_of_lookalikes_is_too_many(spark):
    texts, meant = _lookalikes(10_100)
    got = rows(scanned.findings(spark.createDataFrame(texts, ROW)).filter("src = 'y' and kind = 'glyph'"))
    assert [(i, item) for _, i, _, item in got if i < 5] == meant and len({i for _, i, _, _ in got}) == 10_100


def test_vectors_made_by_rows_are_those_of_the_whole(spark):
    counts = np.random.default_rng(5).poisson(0.3, (300, 90)).astype(np.float32)
    counts[7] = 0
    beside = [(str(i), [int(c) for c in row.nonzero()[0]], [int(n) for n in row[row > 0]]) for i, row in enumerate(counts)]
    made, context = scanned.spread_skip_gram(spark.createDataFrame(beside, "word string, context array<int>, n array<bigint>"), 300, 90)
    vectors = {r["word"]: r["vector"] for r in made.collect()}
    word, whole = scanned.skip_gram(counts)
    assert np.allclose(np.array([vectors[str(i)] for i in range(300)]) @ context.T, word @ whole.T, atol=1e-3)


def test_sieve_and_cut_hold_every_word(spark):
    held = ["harbour", "l\u00e4rare", "co-operative", "operative"]
    s = scanned.sieve(spark.createDataFrame([(w,) for w in held], "word string"))
    assert all(w in s for w in held) and sum(f"w{i}" in s for i in range(10_000)) < 100
    text = "; a harbour, harbours l\u00e4rare-co-operative_x"
    for words in (s, held, held + [f"q{i}qqq" for i in range(64)]):
        assert sorted(text[a:b] for a, b in scanned._finder(words, 2)(text)) == ["co-operative", "harbour", "l\u00e4rare", "operative"]


def test_the_frequent_words_are_not_gathered_from_every_partition(spark, vocabulary, monkeypatch):
    # What the driver collects is what was written, at most KNOWN words, in order.
    seen = {}
    write = scanned.materialize
    monkeypatch.setattr(scanned, "materialize", lambda df, label: seen.setdefault(label, write(df, label)))
    monkeypatch.setattr(scanned, "KNOWN", 7)
    words, _ = scanned.learn(spark.createDataFrame([("x", i, EN) for i in range(30)], ROW))
    assert len(words.known) == 7 == seen["common"].count()


def test_short_words_are_meant_by_figures_only(spark):
    df = spark.createDataFrame([("x", i, EN + "The date of the posts and the banks. ") for i in range(40)] + [("x", 40, EN + "The da7e of the p0sts and the 6anks and the hand.")], ROW)
    assert [r[3] for r in rows(scanned.findings(df)) if r[1] == 40] == ["banks", "posts"]


def test_repair_reads_on(spark, vocabulary):
    df = spark.createDataFrame([("x", 1, PAGES), ("x", 2, None)], ROW)
    got = {r["row_id"]: r["text"] for r in scanned.repair(df, vocabulary).collect()}
    assert got[2] is None
    assert "kitchen renovation has been entered and will be shown on the next statement of the second-hand piano. The payment was recorded" in got[1]
    assert "NORTH BANK" not in got[1] and "Page" not in got[1]


def test_every_query_runs(spark):
    import os

    from paperloom.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    for name, query in queries.queries().items():
        assert query(spark, sf).limit(5).collect() is not None, name
