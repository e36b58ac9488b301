"""Mapping to a list, linking of names and frequencies on small inputs, with the defined edge cases."""

import pytest

from paperloom.llm import canonical, frequency, names
from paperloom.llm.symdelete import deletes, edit_cost, edits, shortens


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_deletions_reach_every_string_within_reach():
    import itertools

    words = ["".join(w) for n in (2, 3, 4) for w in itertools.product("ab", repeat=n)]
    for a in words:
        for b in words:
            if edits(a, b) <= 1:
                assert deletes(a, 1) & deletes(b, 1), (a, b)


def test_edit_costs():
    assert edits("statement", "statemnet") == 1
    assert edits("abc", "") == 3
    assert edit_cost("bank", "bsnk") < edit_cost("bank", "bpnk")
    assert edit_cost("", "ab") > 1.9
    assert shortens("stmts", "statements") and shortens("ins", "insurance") and not shortens("xns", "insurance")


REFERENCE = [("C1", "Bank statements"), ("C2", "Household insurance"), ("C3", "Tax returns"), ("C4", "Wills and estates")]


def test_category_forms(spark):
    ref = spark.createDataFrame(REFERENCE, "category_code string, category string")
    typed = [
        (1, "bnk statemets", "C1"), (2, "insurance, Household", "C2"), (3, "Tax returns 2019", "C3"), (4, "my tax returns (old)", "C3"),
        (5, "Bank stmts", "C1"), (6, "statements for bank", "C1"), (7, "taxeeturns", "C3"), (8, "blue folder 7", "none"), (9, "Wills_and_estates", "C4"),
    ]
    df = spark.createDataFrame([(i, v, "x") for i, v, _ in typed] + [(1, "bnk statemets", "y"), (10, "Bank statements", ""), (11, None, ""), (12, "", ""), (13, "  ", "")], "note_id long, category string, entry string")
    assert rows(canonical.map_rows(df, ref)) == [(i, c) for i, _, c in typed]
    assert rows(canonical.misses(df, ref)) == [("blue folder 7", 1)]


def test_category_join_agrees_with_broadcast(spark, monkeypatch):
    ref = spark.createDataFrame(REFERENCE, "category_code string, category string")
    longer = ref.union(spark.createDataFrame([("C5", "Deeds and plans of house garage and garden walls"), ("C6", "bank statements")], "category_code string, category string"))
    ref = longer
    typed = ["bnk statements", "household insurnce", "zzz", "tax returns", "Bank stmts", "Househ. insurance", "garden walls, garage house plans deeds",
             "deeds pln house garage walls garden", "statements for bank", "Bank statements", "bank statements", "12 34", "taxeeturns"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(typed)], "note_id long, category string")
    small = rows(canonical.map_values(df, ref))
    by = {v: c for v, c, _ in small}
    assert by["Bank stmts"] in ("C1", "C6") and by["Househ. insurance"] == "C2" and by["garden walls, garage house plans deeds"] == by["deeds pln house garage walls garden"] == "C5"
    assert by["12 34"] == by["zzz"] == "none" and by["bank statements"] == "C6" and by["Bank statements"] == "C1"
    monkeypatch.setattr(canonical, "MAX_DICTIONARY", 0)
    assert rows(canonical.map_values(df, ref)) == small


def test_category_empty_tables(spark):
    ref = spark.createDataFrame(REFERENCE, "category_code string, category string")
    none = spark.createDataFrame([], "note_id long, category string")
    assert canonical.map_rows(none, ref).count() == 0
    some = spark.createDataFrame([(1, "anything")], "note_id long, category string")
    assert rows(canonical.map_rows(some, ref.limit(0))) == [(1, "none")]


def brute_terms(data):
    notes = {}
    for note, terms in data:
        notes.setdefault(note, []).append(terms)
    count = {}
    for versions in notes.values():
        best = {}
        for terms in versions:
            own = {}
            for t in terms or []:
                t = (t or "").strip("   \t").lower()
                if t:
                    own[t] = own.get(t, 0) + 1
            for t, n in own.items():
                best[t] = max(best.get(t, 0), n)
        for t, n in best.items():
            o, r = count.get(t, (0, 0))
            count[t] = (o + n, r + 1)
    return sorted((t, o, r) for t, (o, r) in count.items())


@pytest.mark.parametrize("most", [1_000_000, 7])
def test_frequencies_at_any_partition_size(spark, most):
    """With tiny partitions the hot term is split by record and still exact."""
    data = [(i, ["Hot ", "hot", f"t{i % 5}", None, " "]) for i in range(60)] + [(3, ["Hot ", "hot", "t3", None, " "]), (None, ["hot"]), (90, None), (91, [])]
    df = spark.createDataFrame(data, "note_id long, tags array<string>")
    got = rows(frequency.term_frequencies(df, max_rows=most), "term", "occurrences", "records")
    assert got == brute_terms(data)


def test_marks(spark):
    data = [(i, ["common"] + (["rare"] if i < 2 else [])) for i in range(40)] + [(i, ["mid"]) for i in range(40, 43)]
    df = spark.createDataFrame(data, "note_id long, tags array<string>")
    assert rows(frequency.mark_terms(df), "term", "mark") == [("common", "common"), ("mid", None), ("rare", "rare")]
    empty = spark.createDataFrame([], "note_id long, tags array<string>")
    assert frequency.mark_terms(empty).count() == 0


SENDERS = {
    "a": ["Vera Lindholm", "LINDHOLM VERA", "Lindholm, Vera", "V. Lindholm", "Dr Vera Lindholm", "Vera G. Lindholm", " Vera  Lindholm", "Veraa Lindholm"],
    "b": ["Olof Lindholm", "Olle Lindholm", "O. Lindholm"],
    "c": ["Northgate Savings Bank", "NORTHGATE SAVINGS BANK", "Northgate Sav. Bank", "Northgate Bank", "Nothgate Savings Bank"],
    "d": ["Hamra Bygg AB", "Hamra Bygg Aktiebolag", "AB Hamra Bygg", "HAMRA Bygg"],
    "e": ["Hamra Elnät AB", "Hamra Elnat AB"],
    "f": ["Tall Valley Railways", "TVR Tall Valley Railways", "Tall Valley Rlwys"],
}


def test_sender_pairs(spark):
    names_ = [n for group in SENDERS.values() for n in group]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names_ * 3)] + [(None, 0), ("", 0), ("  ", 0)], "correspondent string, name long")
    got = {tuple(r) for r in names.name_pairs(df).collect()}
    want = {(a, b) for g in SENDERS.values() for a in g for b in g if a < b}
    assert got == want


def test_sender_edge_cases(spark):
    assert names.name_pairs(spark.createDataFrame([], "correspondent string")).count() == 0
    odd = spark.createDataFrame([("???",), ("x" * 500,), ("Ltd",)], "correspondent string")
    assert names.name_pairs(odd).count() == 0
    assert names.parts("G.m.b.H. Xavers & Söhne") == (["xavers", "sohne"], "gmbh")


def test_ambiguous_initial_stays_alone():
    got = names.link_block([("lindholm vera", "", 3), ("lindholm viktor", "", 3), ("lindholm v", "", 1)])
    assert got == []


def test_names_of_one_common_token_are_linked(spark):
    # Every name shares the surname, and "robert" is rarer than it.
    import random

    draw = random.Random(1)
    firsts = ["".join([draw.choice("kmtv"), *draw.choices("aeidlnstu", k=6)]) for _ in range(80)]
    full = ["Robert Andersson", "Robert Lind", "Robert Berg"]
    df = spark.createDataFrame([(f"{f} Andersson",) for f in firsts] + [(n,) for n in [*full, "Bob Andersson", "R. Andersson"]], "correspondent string")
    got = {tuple(r) for r in names.name_pairs(df).collect()}
    assert {("Bob Andersson", "Robert Andersson"), ("R. Andersson", "Robert Andersson"), ("Bob Andersson", "R. Andersson")} <= got


def test_blocks_equal_all_pairs(spark, monkeypatch):
    import random

    draw = random.Random(5)
    tokens = "andersson andersen anders robert roberto robt bob bobby chris christina christopher rbrt r a c bank abcd ab ar banken northgate nb savings sav".split()
    some = sorted({" ".join(sorted(draw.choices(tokens, k=draw.choice([1, 2, 2, 3, 3, 4])))) for _ in range(300)})
    legal = {s: draw.choice(["", "", "", "ab", "ltd"]) for s in some}
    order = {s: "\n".join({" ".join(draw.sample(w := s.split(" "), len(w))) for _ in range(2)}) for s in some}
    want = names._costs(names.combinations(some, 2), legal, order)
    df = spark.createDataFrame([(s, f, 1, order[s]) for s, f in legal.items()], "signature string, legal string, n long, written string")
    links = set(names.link_block([(s, f, 1) for s, f in legal.items()], order))
    for size in (2_000, 20):
        monkeypatch.setattr(names, "BLOCK", size)
        assert {(r["a"], r["b"]): r["cost"] for r in names._fitting(df).collect()} == want
        assert {(r["a"], r["b"]) for r in names._links(df).collect()} == links


def test_acronyms_follow_the_words_as_written(spark):
    want = {("STA Stockholm", "Swedish Tax Agency Stockholm"), ("NET Uppsala", "Nordic Energy Trade Uppsala"), ("ABC Uppsala", "Alpha Beta Corp Uppsala")}
    data = sorted({n for p in want for n in p} | {"AST Stockholm"})
    got = {tuple(r) for r in names.name_pairs(spark.createDataFrame([(n,) for n in data], "correspondent string")).collect()}
    assert got == {tuple(sorted(p)) for p in want}


def test_many_given_names_of_one_surname(spark):
    import random

    draw = random.Random(3)
    for n in (10, 74, 300):
        given = {"".join(draw.choices("bdfgklmnprst", k=1) + draw.choices("aeiou", k=1) + draw.choices("bdfgklmnprst", k=3) + draw.choices("aeiou", k=2)) for _ in range(n)}
        spelled = [f"{g.title()} Lindholm" for g in given if g[0] not in "vbr"] + ["V. Lindholm", "Vera Lindholm", "Bob Lindholm", "Robert Lindholm"]
        got = {tuple(r) for r in names.name_pairs(spark.createDataFrame([(x,) for x in spelled], "correspondent string")).collect()}
        assert {("V. Lindholm", "Vera Lindholm"), ("Bob Lindholm", "Robert Lindholm")} <= got, n


def test_long_chains_are_one_class(spark):
    links = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(99)], "a string, b string")
    signatures = spark.createDataFrame([(f"n{i:03d}",) for i in range(100)] + [("alone",)], "signature string")
    assert {r["class"] for r in names._classes(signatures, links).collect()} == {"n000", "alone"}


def test_frequencies_of_one_hot_term_and_of_rows_without_id(spark):
    data = [(i, ["Hot"]) for i in range(500)] + [(None, ["hot", "b", "hot"]), (None, ["b"]), (7, ["HOT ", "hot"])]
    df = spark.createDataFrame(data, "note_id long, tags array<string>")
    for most in (3, 50, 10_000):
        assert rows(frequency.term_frequencies(df, max_rows=most), "term", "occurrences", "records") == brute_terms(data)
    assert frequency.term_frequencies(df.limit(0)).count() == 0
