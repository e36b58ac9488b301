"""Staged classification, notes, tags beside a ledger and files, on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom.functions import dates
from paperloom.operators import classify, notes, tags
from paperloom.sources import scan
from paperloom.streaming.model import StubClient, ask, progress

CATEGORIES = ["Bank statements", "Other"]


def test_stages_of_classification(spark):
    class Answers:
        def chat_json(self, prompt):
            if "broken" in prompt:
                raise RuntimeError("no model")
            return '{"title": " A letter ", "category": "bank statement", "tags": ["x", ""], "subjects": ["a", "b", "c", "d", "e", "f"], "confidence": 7}' if "good" in prompt else "no idea"

    docs = spark.createDataFrame([(1, None), (2, " \n"), (3, "good text"), (4, "broken text"), (5, "odd text"), (6, "known text")], "doc_id int, text string")
    key = classify.memo_key(1, "stub", F.lit("en"), CATEGORIES, F.col("text"))
    memo = docs.filter("doc_id = 6").select(key.alias("memo_key"), F.lit('{"title": "T", "category": "Other"}').alias("response"))
    got = {r["doc_id"]: r for r in classify.classify(docs, CATEGORIES, Answers, memo).collect()}
    assert {i: r["classifier"] for i, r in got.items()} == {1: "empty", 2: "empty", 3: "llm", 4: "heuristic", 5: "heuristic", 6: "memo"}
    assert got[1]["tags"] == ["empty-text"] and got[3]["category"] == "Bank statements" and got[3]["title"] == "A letter"
    assert got[3]["tags"] == ["x"] and len(got[3]["subjects"]) == 5 and got[3]["confidence"] == 1.0 and got[4]["error"] == "no model" and got[4]["confidence"] == 0.2
    strict = {r["doc_id"]: r for r in classify.classify(docs, CATEGORIES, Answers, fallback=False).collect()}
    assert strict[4]["classifier"] == "failed" and strict[4]["title"] is None
    assert classify.remember(classify.classify(docs, CATEGORIES, Answers)).count() == 1
    assert classify.classify(docs.limit(0), CATEGORIES, Answers).count() == 0
    assert list(classify.json_schema(CATEGORIES)["properties"]) == [n for n, _ in classify.FIELDS]


def test_titles_from_names(spark):
    df = spark.createDataFrame([("a/Screenshot 2024-05-02 at 14.23.07.png",), ("a/Screenshot 2024-05-02 at 14.23.07 boiler.png",), ("x/scan_2020-01-02.pdf",), ("x/my lease.pdf",), (None,)], "path string")
    got = [r[0] for r in df.select(classify.filename_title(F.col("path"))).collect()]
    assert got == ["Screenshot 2024-05-02 14.23.07", "boiler", "Untitled document", "my lease", "Untitled document"]


def test_dates_in_order_of_trust(spark):
    d = dt.date
    rows = [
        ("Screenshot 2024-05-02 at 14.23.07.png", "x", d(2020, 1, 1), d(2024, 5, 2), "screenshot"),
        ("a.pdf", "Invoice date: 2021-03-04", d(2020, 1, 1), d(2021, 3, 4), "document"), ("a.pdf", "Sent 2020-01-01", d(2020, 1, 1), d(2020, 1, 1), "document"),
        ("a.pdf", "Paid 4 May 2019", d(2999, 1, 1), d(2019, 5, 4), "text"), ("scan 2018_02_03.pdf", "none", None, d(2018, 2, 3), "filename"), ("a.pdf", None, None, d(2017, 1, 1), "file-created"),
    ]
    df = spark.createDataFrame([(*r[:3], d(2017, 1, 1)) for r in rows], "path string, text string, document_date date, made date")
    got = [(r["date"], r["date_source"]) for r in classify.resolve_dates(df, "2026-01-01", created="made").collect()]
    assert got == [r[3:] for r in rows]
    with pytest.raises(ValueError):
        classify.resolve_dates(df, "2026-01-01", order=("stars",))


def test_date_readings():
    today = dt.date(2026, 9, 10)
    read = lambda t, first=True: [c[0] for c in dates.candidates(t, today, first)]
    d = dt.date
    assert read("on 5th of March") == [] and read("5 March 2020, May 1st, 2021 and June 2019") == [d(2020, 3, 5), d(2021, 5, 1), d(2019, 6, 1)]
    assert read("03/04/2020") == [d(2020, 4, 3)] and read("03/04/2020", False) == [d(2020, 3, 4)] and read("13.04.71") == [d(1971, 4, 13)] and read("31/13/2020") == []
    assert read("2020-01-01 - 2020-02-01") == read("from 2019-01-01 t.o.m. 2019-02-01") == read("Due date: 2020-01-01") == read("2031-01-01 20200101 1.2") == []
    assert read("den 3:e maj 2018") == [d(2018, 5, 3)] and dates.label_before("Invoice date: 2020", 14) == "invoice date" and dates.label_before("update: 2020", 8) == ""


def test_evaluation(spark):
    corpus = spark.createDataFrame([("a", "en", "personal", ["X", "Y"], ["t"], "2020-01-01"), ("b", "sv", "personal", ["Z"], [], None)], "id string, language string, context string, categories array<string>, tags array<string>, date string")
    answers = spark.createDataFrame([("a", "y", ["t", "u"], dt.date(2020, 1, 1)), ("b", "q", [], dt.date(2020, 1, 1))], "id string, category string, tags array<string>, date date")
    slices, misses = classify.evaluate(corpus, answers)
    by = {(r["language"], r["context"]): (r["n"], r["category_milli"], r["date_milli"], r["recall_milli"]) for r in slices.collect()}
    assert by == {("*", "*"): (2, 500, 500, 1000), ("en", "*"): (1, 1000, 1000, 1000), ("sv", "*"): (1, 0, 0, 1000), ("*", "personal"): (2, 500, 500, 1000)}
    assert [tuple(r) for r in misses.collect()] == [("b", "category q; date 2020-01-01")]


def test_notes_there_and_back(spark):
    df = spark.createDataFrame([("A \"b\"", dt.date(2020, 1, 2), ["x", "y"], 0.5, "Short.", "files/a.pdf", "line\n\nlast"), (None, None, None, None, None, None, None)],
                               "title string, date date, tags array<string>, confidence double, summary string, attachment string, body string")
    for style in ("callout", "details", "plain"):
        df_ = df.select("*", notes.render(df.columns, F.col("body"), style, prose=F.lit("My own words.")).alias("c"))
        from paperloom.functions import text

        meta = notes.meta_from_note(F.col("c"))
        got = df_.select(*[meta[k].alias(k) for k in ("title", "date", "tags", "confidence", "attachment")], text.embedded_text(F.col("c")).alias("t"), text.text_style(F.col("c")).alias("s"),
                         text.preserved_prose(F.regexp_replace(F.col("c"), r"(?s)\A---.*?---\n", ""), F.col("summary")).alias("p")).collect()
        assert tuple(got[0]) == ('A "b"', dt.date(2020, 1, 2), ["x", "y"], 0.5, "files/a.pdf", "line\n\nlast", style, "My own words.")
        assert tuple(got[1])[:7] == ("", None, [], 0.0, None, "", None)
    with pytest.raises(ValueError):
        notes.rendered_path("{nothing}", {})


def test_loose_and_duplicate_files(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")], "path string, digest string")
    known = spark.createDataFrame([("2",)], "digest string")
    assert {r["path"]: r["kind"] for r in notes.plan_loose(files, known).collect()} == {"a": "adopt", "b": "duplicate", "c": "duplicate", "d": "adopt"}


def test_protected_and_new_tags(spark):
    used = spark.createDataFrame([([t],) for t in ["counciltax"] * 9 + ["council-tax"] + ["mortgage"] * 3 + ["mortgagee"] * 2], "tags array<string>")
    kept = spark.createDataFrame([("council-tax",)], "tag string")
    assert {r["tag"]: r["canonical"] for r in tags.canonical_map(used, protected=kept).collect()} == {
        "counciltax": "council-tax", "council-tax": "council-tax", "mortgage": "mortgage", "mortgagee": "mortgage",
    }
    ledger = spark.createDataFrame([("council-tax", 9), ("skatteverket", 7)], "canonical string, total long")
    new = spark.createDataFrame([(["Council Tax", "skatteverkets", "holiday", "holidays", "year-2024"],), (["holidays"],)], "tags array<string>")
    assert {r["tag"]: (r["canonical"], r["how"]) for r in tags.against_ledger(new, ledger).collect()} == {
        "council-tax": ("council-tax", "same"), "skatteverkets": ("skatteverket", "same"), "holiday": ("holidays", "new"), "holidays": ("holidays", "new"), "year-2024": ("year-2024", "new"),
    }
    chain = spark.createDataFrame([(f"abcdefghijklmnopqrst{'x' * i}", 200 - i) for i in range(60)], "canonical string, total long")
    assert tags.consolidate(chain).count() > 0


def test_files_and_progress(spark, tmp_path):
    root = tmp_path / ".vault"
    (root / "in" / ".hidden").mkdir(parents=True)
    for name in ("b.pdf", "a.PNG", "c.txt", "x.ocr.pdf", ".hidden/d.pdf"):
        (root / "in" / name).write_bytes(b"x")
    names = lambda df: [r["path"].rsplit("/", 1)[1] for r in df.collect()]
    assert names(scan.scan_documents(spark, str(root))) == ["a.PNG", "b.pdf"]
    assert names(scan.scan_documents(spark, str(root / "in" / "c.txt"))) == ["c.txt"]
    assert scan.read_or_empty(spark, str(root / "none.json"), "a int").count() == 0
    (root / "t.json").write_text('{"a": 1, "version": 2}\nnot json\n{"a": 2, "version": 1}\n')
    assert [r["a"] for r in scan.read_or_empty(spark, str(root / "t.json"), "a int", 2).collect()] == [1]
    row = progress(ask(spark.createDataFrame([("one",), ("two",)], "prompt string"), StubClient, timed=True)).first()
    assert row["calls"] == 2 and row["failed"] == 0 and row["elapsed"] >= 0
