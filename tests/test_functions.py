"""Column functions against golden cases and plain restatements."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom.functions import dates, jsonfix, quality, rules, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value, slug",
    [("Ärendet  om_Bygge!", "arendet-om-bygge"), ("--a -- b--", "a-b"), (None, ""), ("", ""), ("ß & Co", "co"), ("x" * 100, "x" * 80)],
)
def test_slug(spark, value, slug):
    assert one(spark, value, text.slugify) == slug


def test_names_and_titles(spark):
    assert one(spark, 'a/b: "c"  d.', text.safe_filename) == "a-b- -c- d"
    assert one(spark, " .-", text.safe_filename) == "untitled"
    assert one(spark, "![[scan.jpg]]  My   title -", text.clean_title) == "My title"
    assert one(spark, "Boiler service 2019-04-02 - 1", text.clean_document_name) == "Boiler service"
    assert one(spark, "SwiftScan Feb 7, 2021 11.45 AM", text.clean_document_name) == ""
    assert one(spark, "Invoices-boxes", text.fingerprint) == "box invoice"
    assert one(spark, "a%20b+c", text.unquote) == "a b+c"


def test_blocks_round_trip(spark):
    body = "line one\n\nline > three"
    for style in ("callout", "details", "plain"):
        block = spark.createDataFrame([(body,)], "v string").select(text.text_block(F.col("v"), style).alias("b"))
        assert tuple(block.select(text.text_style(F.col("b")), text.embedded_text(F.col("b"))).first()) == (style, body)
    note = F.concat(F.lit("# T\n\nsum\n\nmine\n\n![[a.pdf]]\n\n"), text.text_block(F.col("v")))
    got = spark.createDataFrame([(body,)], "v string").select(text.preserved_prose(note, F.lit("sum")).alias("p")).first()["p"]
    assert got == "mine"


@pytest.mark.parametrize(
    "value, expected",
    [
        ("Fakturadatum: 2024-05-02\nFörfallodatum: 2024-06-01", (dt.date(2024, 5, 2), "fakturadatum")),
        ("Period 1 Jan 2024 - 31 Dec 2024", None),
        ("due date 02/05/2024", None),
        ("validated 3 May 2024", (dt.date(2024, 5, 3), "")),
        ("Dated May 2nd, 2024 and 2.5.23", (dt.date(2024, 5, 2), "dated")),
        ("May 2024", (dt.date(2024, 5, 1), "")),
        ("13/31/2024", None),
        ("", None),
        (None, None),
    ],
)
def test_date_in_text(spark, value, expected):
    got = one(spark, value, lambda c: dates.best_date(dates.find_dates(c, "2026-01-01")))
    assert (tuple(got) if got else None) == expected


def test_dates_elsewhere(spark):
    assert one(spark, "on 04/03/2024", dates.parse_date) == dt.date(2024, 3, 4)
    assert one(spark, "on 04/03/2024", lambda c: dates.parse_date(c, False)) == dt.date(2024, 4, 3)
    assert one(spark, "13/04/2024", lambda c: dates.parse_date(c, False)) == dt.date(2024, 4, 13)
    assert one(spark, "2024-13-40", dates.parse_date) is None
    assert one(spark, "602334_03_Jul_2025", dates.date_from_filename) == dt.date(2025, 7, 3)
    assert one(spark, "receipt Mar 5, 2017", dates.date_from_filename) == dt.date(2017, 3, 5)


@pytest.mark.parametrize(
    "name, at",
    [
        ("Screenshot 2024-05-02 at 4.15.22 PM", dt.datetime(2024, 5, 2, 16, 15, 22)),
        ("Skärmavbild 2024-05-02 kl. 14.23.07", dt.datetime(2024, 5, 2, 14, 23, 7)),
        ("Capture d’écran 2024-05-02 à 14.23.07", dt.datetime(2024, 5, 2, 14, 23, 7)),
        ("截屏2024-05-02 下午2.23.07", dt.datetime(2024, 5, 2, 14, 23, 7)),
        ("Screenshot 2024-05-02 report 14.30", None),
        ("Screenshot", None),
        ("Screenshot 2024-13-02 at 10.00.00", None),
    ],
)
def test_screenshot_names(spark, name, at):
    got = one(spark, name, dates.screenshot)
    assert (got and got["taken_at"]) == at


def quality_of(spark, value, pages=None):
    df = spark.createDataFrame([(1, value, pages)], "id int, text string, pages int")
    return quality.score_texts(df, "id").first()


def test_quality_verdicts(spark):
    letter = "Dear customer, thank you for your letter about the invoice. The total amount is due and we will write to you when it has been paid in full."
    assert quality_of(spark, letter)["verdict"] == "good"
    assert quality_of(spark, None)["verdict"] == "empty"
    assert quality_of(spark, "  \n ")["verdict"] == "empty"
    assert quality_of(spark, "Coffee 32 kr")["verdict"] == "thin"
    assert quality_of(spark, "||| ~~ xqz bdf ;; ## qwrt pfgh zzzz kkkk ,, .. lmnb vcxz hjkl qqqq wwww")["verdict"] == "gibberish"
    sparse = quality_of(spark, letter, 9)
    assert sparse["verdict"] in ("poor", "good") and sparse["score_milli"] < quality_of(spark, letter)["score_milli"]
    assert quality_of(spark, letter * 3000, 1)["chars"] == quality.SAMPLE_CHARS


def test_long_blanks_are_read_once(spark):
    blanks = "a" + " " * 300_000 + "b"
    assert quality_of(spark, blanks)["chars"] == quality.SAMPLE_CHARS
    assert one(spark, blanks, text.slugify) == "a-b"


def test_rules(spark):
    hay = spark.createDataFrame([("Försäkringsbrev", "risk of payee", "Facture n° 3")], "a string, b string, c string")
    tags = lambda c: rules.rule_tags(rules.haystack(F.col(c)), rules.RULES)
    got = hay.select(tags("a"), tags("b"), tags("c")).first()
    assert [list(g) for g in got] == [["insurance"], [], ["invoice"]]


def test_category_by_ratio(spark):
    names = ["Invoices", "Banking", "Utilities", "Other"]
    values = ["invoices", "Bank", "Utility bills", "Motherhood", "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(rules.match_category(F.col("v"), names)).collect()]
    assert got == ["Invoices", "Banking", "Utilities", "Other", "Other", "Other"]


@pytest.mark.parametrize(
    "answer, title",
    [
        ('{"title": "a"}', "a"),
        ('<think>{"title": "no"}</think>```json\n{"title": "a"}\n```', "a"),
        ('Well: {"title": "a" "category": "b"}', "a"),
        ('{"title": a, "category": "b"}', "a"),
        ('{"title": "a", "tags": ["x", "y"}', "a"),
        ('{"title": "say "a" twice", "category": "b"}', 'say "a" twice'),
        ("no object here", None),
        (None, None),
    ],
)
def test_answers(spark, answer, title):
    got = one(spark, answer, lambda c: jsonfix.parse_answer(c, "title string, category string, tags array<string>"))
    assert (got and got["title"]) == title
