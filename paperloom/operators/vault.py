"""Joins, ranking and planning over documents, notes and readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import number_in_groups


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """One row per key: the one last delivered; of equals the greatest row."""
    rest = [c for c in df.columns if c not in (key, by) and not df.schema[c].dataType.simpleString().startswith("map")]
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(by), F.xxhash64(*rest))
    return df.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def digests(df: DataFrame, key: str, text: str, *columns: str) -> DataFrame:
    """``(key, columns..., digest)``, each key once. Contents are hashed before rows delivered again meet, so no text is shuffled."""
    return df.select(key, *columns, F.sha2(F.col(text), 256).alias("digest")).dropDuplicates([key])


def content_status(df: DataFrame, key: str, order: str, known: DataFrame | None = None) -> DataFrame:
    """``(key, digest, status)``: ingested, duplicate or skipped (no content), the first of a content wins.

    ``df`` has a column ``digest``, and ``known`` one of contents ingested before.
    """
    rows = df.select(key, F.col(order).alias("_o"), "digest")
    blank = F.col("digest").isNull() | (F.col("digest") == F.sha2(F.lit(""), 256))
    # The first of each content comes from a combined aggregate, not a window: a
    # content that a third of all rows share costs one row per input partition.
    filled = rows.filter(~blank)
    first = filled.groupBy("digest").agg(F.min(F.struct(F.col("_o").isNull(), "_o", key)).alias("_f")).select("digest", F.col(f"_f.{key}").alias("_first"))
    if known is not None:
        seen = known.select("digest").distinct().withColumn("_seen", F.lit(True))
        first = first.join(seen, "digest", "left")
    else:
        first = first.withColumn("_seen", F.lit(None).cast("boolean"))
    status = F.when(F.col("_seen") | (F.col(key) != F.col("_first")), "duplicate").otherwise("ingested")
    none = rows.filter(blank).select(key, "digest", F.lit("skipped").alias("status"))
    return filled.join(first, "digest").select(key, "digest", status.alias("status")).unionByName(none)


def loose(files: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Files that no link points to."""
    return files.join(links.filter(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def prune(index: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Index entries whose file still exists."""
    return index.join(present.select(key).distinct(), key, "left_semi")


def upsert(index: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The index with changed entries replaced and new ones added."""
    return index.join(changes.select(key), key, "left_anti").unionByName(changes)


def numbered_paths(df: DataFrame, path: str, suffix: Column, order: str) -> DataFrame:
    """``unique_path``: the first of a path keeps it, later ones get -2, -3, ..."""
    numbered = number_in_groups(df, [path], [order], "_n")
    extra = F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise("")
    return numbered.withColumn("unique_path", F.concat(F.col(path), extra, suffix)).drop("_n")


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links ``(src, folder, target)`` resolved against file ``path``s.

    Relative to the folder, else to the root, else by a base name that only one
    file has; ambiguous and dead links resolve to null.
    """
    paths = files.select("path").distinct()
    names = (
        paths.groupBy(F.element_at(F.split("path", "/"), -1).alias("base")).agg(F.count("*").alias("n"), F.min("path").alias("only")).filter("n = 1")
    )
    near = F.when(F.col("folder") == "", F.col("target")).otherwise(F.concat_ws("/", "folder", "target"))
    return (
        links.withColumn("near", near)
        .withColumn("base", F.element_at(F.split("target", "/"), -1))
        .join(paths.select(F.col("path").alias("near"), F.lit(1).alias("is_near")), "near", "left")
        .join(paths.select(F.col("path").alias("target"), F.lit(1).alias("is_root")), "target", "left")
        .join(names.select("base", "only"), "base", "left")
        .select(
            *[c for c in links.columns],
            F.when(F.col("is_near") == 1, F.col("near")).when(F.col("is_root") == 1, F.col("target")).otherwise(F.col("only")).alias("path"),
        )
    )


def worklist(scored: DataFrame, key: str, limit: int) -> DataFrame:
    """Worst first: the first ``limit`` to read again, the rest deferred; readable ones are done.

    ``scored`` has ``score`` and ``verdict``. The cut is found by ranking within
    ranges of the score, so no task holds all rows.
    """
    ready = F.when(F.col("verdict") == "good", "good").when(F.col("verdict") == "thin", "thin")
    marked = scored.select(key, "score", "verdict", ready.alias("done"))
    todo = marked.filter("done is null")
    # Rows below the limit-th worst row, taken with a bounded top-k.
    first = todo.orderBy("score", key).limit(limit).select(key, F.lit("reocr").alias("kind"))
    rest = todo.join(first, key, "left").select(key, "score", "verdict", F.coalesce("kind", F.lit("deferred")).alias("kind"))
    return rest.unionByName(marked.filter("done is not null").select(key, "score", "verdict", F.col("done").alias("kind")))


def best_attempt(attempts: DataFrame, key: str, good: float = 0.7, gain: float = 0.05) -> DataFrame:
    """Of the attempts up to the first good one the best, if it beats the reading before by ``gain``.

    ``attempts`` has ``attempt`` (1, 2, ...) and ``score``; attempt 1 is the
    reading before.
    """
    before = Window.partitionBy(key).orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    tried = attempts.withColumn("good_before", F.coalesce(F.max(F.when((F.col("attempt") > 1) & (F.col("score") >= good), 1)).over(before), F.lit(0)))
    used = tried.filter((F.col("good_before") == 0) | (F.col("attempt") == 1))
    return used.groupBy(key).agg(
        F.max(F.when(F.col("attempt") == 1, F.col("score"))).alias("before"),
        F.max(F.when(F.col("attempt") > 1, F.struct(F.col("score"), (-F.col("attempt")).alias("o")))).alias("best"),
        F.count("*").alias("tried"),
    ).select(
        key,
        "before",
        F.col("best.score").alias("after"),
        (-F.col("best.o")).alias("attempt"),
        F.when(F.col("best").isNull(), "failed")
        .when(F.col("best.score") >= F.coalesce("before", F.lit(0.0)) + gain, "improved")
        .otherwise("unchanged")
        .alias("kind"),
        "tried",
    )


def plan_actions(notes: DataFrame) -> DataFrame:
    """``kind`` and ``reason`` for each note, by the first drift that applies.

    ``notes`` has the flags ``readable, is_index, managed, needs_ocr, moved,
    reclassified, restyled, retagged, reclassed``.
    """
    kinds = [
        (~F.col("readable"), "failed", "unreadable"),
        (F.col("is_index"), "index", "index note"),
        (~F.col("managed"), "skipped", "not managed"),
        (F.col("needs_ocr"), "ocr", "no text"),
        (F.col("moved"), "relocate", "path"),
        (F.col("reclassified"), "rewrite", "reclassified"),
        (F.col("restyled"), "rewrite", "text style"),
        (F.col("retagged"), "rewrite", "tags"),
        (F.col("reclassed"), "rewrite", "css classes"),
    ]
    kind, reason = F.lit("noop"), F.lit("")
    for when, k, r in reversed(kinds):
        when = F.coalesce(when, F.lit(False))
        kind, reason = F.when(when, k).otherwise(kind), F.when(when, r).otherwise(reason)
    return notes.withColumns({"kind": kind, "reason": reason})


def accuracy_slices(results: DataFrame) -> DataFrame:
    """Accuracy over all, by language and by context in one pass.

    ``results`` has ``language, context, category_ok, date_ok, tags_found,
    tags_wanted``. No expected tags at all count as full recall.
    """
    milli = lambda c: F.round(1000 * c).cast("int")
    recall = F.when(F.sum("tags_wanted") > 0, F.sum("tags_found") / F.sum("tags_wanted")).otherwise(1.0)
    sliced = results.groupingSets([[], [F.col("language")], [F.col("context")]], F.col("language"), F.col("context")).agg(
        F.count("*").alias("n"),
        milli(F.avg(F.col("category_ok").cast("int"))).alias("category_milli"),
        milli(F.avg(F.col("date_ok").cast("int"))).alias("date_milli"),
        milli(recall).alias("recall_milli"),
    )
    return sliced.withColumns({c: F.coalesce(c, F.lit("*")) for c in ("language", "context")})


def seen(notes: DataFrame, document: str = "doc_id", note: str = "note_id") -> DataFrame:
    """``(document, note, notes)``: the first note of each document filed, and how many there are."""
    return notes.filter(F.col(document).isNotNull()).groupBy(document).agg(F.min(note).alias(note), F.count("*").alias("notes"))


def assembled(readings: DataFrame, key: str, order: str, text: str = "text", pages: str = "pages") -> DataFrame:
    """``(key, text, pages)``: the texts of a note's readings in order, blank ones left out, readings delivered again once."""
    rows = readings.filter(F.col(key).isNotNull() & (F.trim(text) != ""))
    parts = F.array_sort(F.collect_set(F.struct(order, text, pages)))
    return rows.groupBy(key).agg(parts.alias("p")).select(
        key,
        F.array_join(F.transform("p", lambda x: x[text]), "\n\n").alias("text"),
        F.when(F.exists("p", lambda x: x[pages].isNotNull()), F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x[pages], F.lit(0)))).alias("pages"),
    )


def memo_key(version: int, model: str, language: Column, categories: list[str], text: Column) -> Column:
    """Key under which an answer is remembered: a hash of all that shaped it."""
    parts = [F.lit(str(version)), F.lit(model), F.coalesce(language, F.lit("")), F.lit("|".join(categories)), F.coalesce(text, F.lit(""))]
    return F.sha2(F.concat(*[x for p in parts for x in (p, F.char(F.lit(0)))]), 256)


def with_memo(rows: DataFrame, memo: DataFrame, key: str = "memo_key") -> tuple[DataFrame, DataFrame]:
    """Rows answered by the memo, and those that are not."""
    hit = rows.join(memo.select(key, "response"), key, "left")
    return hit.filter("response is not null"), hit.filter("response is null").drop("response")
