"""Classifying documents in stages: empty texts, remembered answers, a model, rules of thumb.

Every stage is a set of rows. Only rows that no earlier stage has answered reach
the model, which runs inside Arrow batches; a failed call is a row that falls back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, jsonfix, rules, text
from ..streaming.model import Client, ask
from .vault import memo_key, with_memo

#: Fields of an answer in the order they are asked for, evidence first, with the characters kept. Fixed values.
FIELDS = (
    ("correspondent", 120), ("document_type", 60), ("summary", None), ("context", None), ("category", None), ("title", None), ("document_date", None),
    ("tags", None), ("subjects", None), ("language", None), ("reference", 80), ("amount", 40), ("currency", 8), ("confidence", None),
)
REQUIRED = ("title", "category", "summary", "tags")
_KINDS = {"tags": "array<string>", "subjects": "array<string>", "confidence": "double"}
#: The schema answers are read with.
SCHEMA = ", ".join(f"{name} {_KINDS.get(name, 'string')}" for name, _ in FIELDS)
UNTITLED = "Untitled document"


def json_schema(categories: list[str]) -> dict:
    """The answer a model is asked for, as a JSON schema."""

    def kind(name: str) -> dict:
        if name == "category":
            return {"type": "string", "enum": categories}
        if name in _KINDS:
            return {"type": "number", "minimum": 0, "maximum": 1} if name == "confidence" else {"type": "array", "items": {"type": "string"}}
        return {"type": "string"}

    return {"type": "object", "properties": {name: kind(name) for name, _ in FIELDS}, "required": list(REQUIRED)}


def build_prompt(body: Column, categories: list[str], filename: Column | None = None, folder: Column | None = None, language: str = "en", most: int = 3000) -> Column:
    """What a model is asked about a document: its text in part, its place, the answers allowed."""
    where = [F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{what}: "), c)) for what, c in (("File name", filename), ("Folder", folder)) if c is not None]
    fixed = [
        F.lit("Describe this scanned document as one JSON object with the fields " + ", ".join(name for name, _ in FIELDS) + "."),
        F.lit("Take every value from the text; leave a field empty rather than guess."),
        F.lit(f"Write title and summary in the language '{language}'. Categories: " + "; ".join(categories)),
    ]
    return F.concat_ws("\n", *fixed, *where, F.lit("Text:"), text.excerpt(body, most))


def filename_title(path: Column) -> Column:
    """The title that a file's name offers: what was written into it, for a bare capture its time."""
    stem = text.stem_of(path)
    stamp = lambda shot: F.concat(F.lit("Screenshot "), F.date_format(shot["taken_at"], "yyyy-MM-dd HH.mm.ss"))
    name = lambda shot: F.when(shot.isNotNull(), shot["rest"]).otherwise(stem)
    chosen = lambda shot: text.let(text.clean_document_name(name(shot)), lambda n: F.when(n != "", n).when(shot.isNotNull(), stamp(shot)).otherwise(UNTITLED))
    return F.coalesce(text.let(dates.screenshot(stem), chosen), F.lit(UNTITLED))


def clipped(answer: Column) -> dict[str, Column]:
    """The fields of an answer without outer blanks, at their length; at most five subjects of 80 characters."""
    out = {}
    for name, most in FIELDS:
        c = answer[name]
        if _KINDS.get(name) == "array<string>":
            items = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
            out[name] = F.transform(F.slice(items, 1, 5), lambda x: F.substring(x, 1, 80)) if name == "subjects" else items
        elif name == "confidence":
            out[name] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
        else:
            s = F.trim(F.coalesce(c, F.lit("")))
            s = F.lower(s) if name == "context" else s
            out[name] = F.substring(s, 1, most) if most else s
    return out


def heuristic(body: Column, title: Column) -> dict[str, Column]:
    """The fields that rules of thumb give: a category by words, the title by lines, little confidence."""
    found = rules.heuristic_title(body)
    empty = F.array().cast("array<string>")
    named = {"category": rules.heuristic_category(body), "title": F.when(found != "", found).otherwise(title), "tags": empty, "subjects": empty, "confidence": F.lit(0.2)}
    return {name: named.get(name, F.lit("")) for name, _ in FIELDS}


def classify(
    docs: DataFrame, categories: list[str], make_client: Callable[[], Client] | None = None, memo: DataFrame | None = None, model: str = "stub",
    key: str = "doc_id", body: str = "text", path: str | None = None, fallback: bool = True,
) -> DataFrame:
    """``(key, fields..., classifier, memo_key, response, error)`` for every document.

    ``classifier`` is ``empty``, ``memo``, ``llm`` or ``heuristic``. Without a client
    all is heuristic; a failed or unreadable answer is heuristic too, or, without
    ``fallback``, a row with an error and no fields. ``memo`` has ``memo_key, response``.
    """
    title = filename_title(F.col(path)) if path else F.lit(UNTITLED)
    where = F.element_at(F.split(F.col(path), "/"), -1) if path else None
    rows = docs.select(
        key, F.coalesce(F.col(body), F.lit("")).alias("body"), title.alias("file_title"), memo_key(1, model, F.lit("en"), categories, F.col(body)).alias("memo_key"),
        build_prompt(F.coalesce(F.col(body), F.lit("")), categories, where).alias("prompt"),
    )
    blank = text.strip(F.col("body")) == ""
    nothing = [F.lit(None).cast("string").alias(c) for c in ("response", "error")]
    empty = rows.filter(blank).select("*", *nothing, F.lit("empty").alias("stage"))
    filled = rows.filter(~blank)
    if make_client is None:
        staged = empty.unionByName(filled.select("*", *nothing, F.lit("heuristic").alias("stage")))
    else:
        hits, open_ = with_memo(filled, memo) if memo is not None else (None, filled)
        staged = empty.unionByName(ask(open_, make_client).withColumn("stage", F.lit("llm")))
        if hits is not None:
            staged = staged.unionByName(hits.select(*filled.columns, "response", F.lit(None).cast("string").alias("error"), F.lit("memo").alias("stage")))
    read = staged.withColumn("a", jsonfix.parse_answer(F.col("response"), SCHEMA))
    answered = F.col("a").isNotNull() & F.col("stage").isin("llm", "memo")
    error = F.when(F.col("stage").isin("llm", "memo") & F.col("a").isNull(), F.coalesce("error", F.lit("no object in the answer")))
    by_model, by_rule = clipped(F.col("a")), heuristic(F.col("body"), F.col("file_title"))
    by_model["title"] = F.when(by_model["title"] != "", text.clean_title(by_model["title"])).otherwise(F.col("file_title"))
    by_model["category"] = rules.match_category(by_model["category"], categories)
    by_rule["tags"] = F.when(F.col("stage") == "empty", F.array(F.lit("empty-text"))).otherwise(by_rule["tags"])
    give = F.lit(True) if fallback else error.isNull()
    fields = [F.when(answered, by_model[name]).when(give, by_rule[name]).alias(name) for name, _ in FIELDS]
    how = F.when(answered, F.col("stage")).when(F.col("stage") == "empty", "empty").when(give, "heuristic").otherwise("failed")
    return read.select(key, *fields, how.alias("classifier"), "memo_key", "response", error.alias("error"))


def remember(classified: DataFrame) -> DataFrame:
    """``(memo_key, response)`` to add to the memo: the answers that could be read."""
    return classified.filter("classifier = 'llm'").groupBy("memo_key").agg(F.min("response").alias("response"))


def resolve_dates(
    docs: DataFrame, today: str, body: str = "text", path: str = "path", model: str = "document_date",
    order: tuple[str, ...] = ("text", "filename", "pdf-metadata", "file-created"), pdf: str | None = None, created: str | None = None,
) -> DataFrame:
    """``docs`` with ``date`` and ``date_source``.

    A capture is dated by its name. A plausible date of the model stays, unless it
    stands nowhere in the text and the text has one of strong label. Else the ways
    of ``order`` are tried in turn. Unknown ways are an error.
    """
    stem = text.stem_of(F.col(path))
    none = F.lit(None).cast("date")
    named = dates.main_dates(F.col(body), today)
    ways = {
        "text": F.col("_d.value"), "filename": dates.date_from_filename(stem), "pdf-metadata": F.col(pdf) if pdf else none, "file-created": F.col(created) if created else none,
    }
    if set(order) - set(ways):
        raise ValueError(f"unknown ways {sorted(set(order) - set(ways))}")
    said = F.when(dates.plausible(F.col(model), today), F.col(model))
    in_text = F.exists(dates.find_dates(F.when(F.col("_said").isNotNull(), F.col(body)), today), lambda c: c["value"] == F.col("_said"))
    taken = dates.screenshot(stem)["taken_at"].cast("date")
    rows = docs.withColumn("_said", said).withColumn("_d", named).withColumn("_in", in_text).withColumn("_taken", taken)
    taken = F.col("_taken")
    better = F.when(F.lit("text" in order) & ~F.coalesce("_in", F.lit(False)) & F.col("_d.strong").isNotNull(), F.col("_d.strong")).otherwise(F.col("_said"))
    tries = [(F.when(dates.plausible(taken, today), taken), "screenshot"), (F.when(F.col("_said").isNotNull(), better), "document")]
    tries += [(F.when(dates.plausible(ways[w], today), ways[w]), w) for w in order]
    best = F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("date"), F.lit(s).alias("source"))) for c, s in tries])
    return rows.withColumn("_b", best).select(*docs.columns, F.col("_b.date").alias("date"), F.col("_b.source").alias("date_source"))


def tag_by_place(tags: Column, path: Column, root: str, known: Column | None = None) -> Column:
    """Tags with those of the folders a file lay in and, for a capture, ``screenshot``; ``known`` maps a tag to the spelling in use."""
    folders = F.coalesce(F.split(text.source_folder(path, root), "/"), F.array().cast("array<string>"))
    shot = F.array(F.when(dates.screenshot(text.stem_of(path)).isNotNull(), "screenshot"))
    own = F.filter(F.transform(F.concat(folders, shot), lambda t: text.slugify(t)), lambda t: t != "")
    spelled = F.transform(own, lambda t: F.coalesce(F.element_at(known, t), t)) if known is not None else own
    return F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.array_compact(spelled))


def evaluate(corpus: DataFrame, answers: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Slices of accuracy, and the misses with what was wrong.

    ``corpus`` has ``language, context, categories, tags, date``; a row is right if
    its category is one of ``categories`` (an entry of any case); a corpus without
    a date wants none found. ``answers`` has ``category, tags, date``.
    """
    from .vault import accuracy_slices

    a = answers.select(key, F.col("category").alias("got_category"), F.col("tags").alias("got_tags"), F.col("date").alias("got_date"))
    none = F.array().cast("array<string>")
    wanted, got = F.coalesce("tags", none), F.coalesce("got_tags", none)
    low = F.transform("categories", F.lower)
    rows = corpus.join(a, key, "left").select(
        key, "language", "context", F.coalesce(F.array_contains(low, F.lower(F.coalesce("got_category", F.lit("")))), F.lit(False)).alias("category_ok"),
        F.col("date").cast("date").eqNullSafe(F.col("got_date")).alias("date_ok"), F.size(F.array_intersect(wanted, got)).alias("tags_found"), F.size(wanted).alias("tags_wanted"),
        F.array_except(wanted, got).alias("missing"), "got_category", "got_date",
    )
    wrong = rows.filter(~F.col("category_ok") | ~F.col("date_ok") | (F.size("missing") > 0))
    why = F.concat_ws(
        "; ", F.when(~F.col("category_ok"), F.concat(F.lit("category "), F.coalesce("got_category", F.lit("none")))),
        F.when(~F.col("date_ok"), F.concat(F.lit("date "), F.coalesce(F.col("got_date").cast("string"), F.lit("none")))),
        F.when(F.size("missing") > 0, F.concat(F.lit("without "), F.array_join("missing", ", "))),
    )
    return accuracy_slices(rows), wrong.select(key, why.alias("why"))
