"""Operators of the core on small inputs, with the defined edge cases."""

from pyspark.sql import functions as F

from paperloom.operators import tags, vault


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_tag_vocabulary(spark):
    used = ["mortgage"] * 5 + ["mortgages"] + ["council-tax"] * 4 + ["counciltax"] + ["year-2023"] * 3 + ["year-2024"] * 2 + ["tax-council"]
    df = spark.createDataFrame([([t],) for t in used], "tags array<string>")
    counts = tags.census(df)
    assert dict(rows(tags.elect(counts), "canonical", "total")) == {"mortgage": 6, "council-tax": 5, "counciltax": 1, "year-2023": 3, "year-2024": 2}
    mapping = dict(rows(tags.canonical_map(df)))
    assert mapping == {
        "mortgage": "mortgage", "mortgages": "mortgage", "council-tax": "council-tax", "counciltax": "council-tax", "tax-council": "council-tax",
        "year-2023": "year-2023", "year-2024": "year-2024",
    }
    kept = spark.createDataFrame([("mortgages",)], "tag string")
    assert "mortgages" in dict(rows(tags.elect(counts, kept), "canonical", "total"))


def test_content_status(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, "", 1), (4, None, 1), (5, "b", None)], "id int, text string, at int")
    assert rows(vault.content_status(df.withColumn("digest", F.sha2("text", 256)), "id", "at"), "id", "status") == [(1, "duplicate"), (2, "ingested"), (3, "skipped"), (4, "skipped"), (5, "ingested")]
    known = df.filter("id = 5").select(F.sha2("text", 256).alias("digest"))
    assert ("duplicate",) in rows(vault.content_status(df.withColumn("digest", F.sha2("text", 256)), "id", "at", known).filter("id = 5"), "status")


def test_links_paths_and_attempts(spark):
    files = spark.createDataFrame([("a/x.pdf",), ("b/x.pdf",), ("b/y.pdf",)], "path string")
    links = spark.createDataFrame([(1, "a", "x.pdf"), (2, "c", "b/x.pdf"), (3, "c", "y.pdf"), (4, "c", "x.pdf"), (5, "", "gone.pdf")], "src int, folder string, target string")
    assert rows(vault.resolve_links(links, files), "src", "path") == [(1, "a/x.pdf"), (2, "b/x.pdf"), (3, "b/y.pdf"), (4, None), (5, None)]
    tries = spark.createDataFrame([("a", 1, 0.3), ("a", 2, 0.8), ("a", 3, 0.99), ("b", 1, 0.5), ("b", 2, 0.52), ("c", 1, 0.1)], "k string, attempt long, score double")
    assert rows(vault.best_attempt(tries, "k"), "k", "attempt", "kind") == [("a", 2, "improved"), ("b", 2, "unchanged"), ("c", None, "failed")]
    scored = spark.createDataFrame([(1, 0.1, "poor"), (2, 0.2, "poor"), (3, 0.9, "good"), (4, 0.0, "thin")], "id int, score double, verdict string")
    assert rows(vault.worklist(scored, "id", 1), "id", "kind") == [(1, "reocr"), (2, "deferred"), (3, "good"), (4, "thin")]


def test_numbers_in_a_hot_group(spark):
    from paperloom.operators.ranking import number_in_groups

    df = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise(F.when(F.col("id") % 7 > 0, F.concat(F.lit("g"), F.col("id") % 7))).alias("g"), F.col("id").alias("o"))
    got = number_in_groups(df, ["g"], ["o"]).collect()
    want = {}
    for r in sorted(got, key=lambda r: r["o"]):
        want[r["g"]] = want.get(r["g"], 0) + 1
        assert r["number"] == want[r["g"]]
    assert number_in_groups(df.limit(0), ["g"], ["o"]).count() == 0
