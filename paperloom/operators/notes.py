"""Notes: rendering, reading back, and what must be done to bring a vault into the layout wanted."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.scan import is_image
from .vault import plan_actions, resolve_links

#: Keys of the front matter in order, and how each is written. Fixed values.
KEYS = (
    ("title", "str"), ("date", "raw"), ("date_source", "str"), ("title_source", "str"), ("category", "str"), ("correspondent", "str"), ("tags", "list"),
    ("document_type", "str"), ("context", "str"), ("subjects", "list"), ("reference", "str"), ("amount", "str"), ("currency", "str"), ("language", "str"),
    ("confidence", "raw"), ("para", "str"), ("classifier", "str"), ("version", "str"), ("processed", "raw"), ("source_file", "str"), ("source_folder", "str"),
    ("source_hash", "str"), ("ocr", "raw"), ("ocr_quality", "raw"), ("pages", "raw"), ("original", "str"), ("attachment", "str"), ("cssclasses", "list"),
)
#: Characters of a document's text that a note holds.
MOST_TEXT = 20_000
#: Any of these makes a note one of ours.
MANAGED_BY = ("source_hash", "classifier", "source_file", "version")


def is_managed(columns: list[str]) -> Column:
    """Is any of the keys that only we write filled?"""
    out = F.lit(False)
    for c in MANAGED_BY:
        if c in columns:
            out = out | F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    return out


def needs_ocr(documents: DataFrame, key: str = "note_id", least: int = 10) -> DataFrame:
    """``(key, needs_ocr)``: has a note a document that is an image or has hardly any text? ``documents`` has ``path, text``."""
    poor = F.coalesce(is_image(F.col("path")), F.lit(False)) | (F.coalesce(F.length(F.trim("text")), F.lit(0)) < least)
    return documents.groupBy(key).agg(F.bool_or(poor).alias("needs_ocr"))


def bucket(named: Column, path: Column, buckets: dict[str, str], default: str) -> Column:
    """The bucket a note names, else the one whose folder heads its path, else the default. ``buckets``: name to folder."""
    own = F.lower(F.trim(named))
    out = F.lit(default)
    for name, folder in buckets.items():
        out = F.when(path.startswith(folder + "/"), name).otherwise(out)
    return F.when(own.isin(*buckets), own).otherwise(out)


def rendered_path(template: str, values: dict[str, Column]) -> Column:
    """A path from a template such as ``{root}/{category}/{date} {name}``; every part is made safe.

    Unknown placeholders raise; a missing value is ``untitled``, but for the root,
    which may be missing; a path without parts is ``Other/untitled``.
    """
    pieces = re.split(r"\{(\w+)\}", template)
    unknown = set(pieces[1::2]) - set(values)
    if unknown:
        raise ValueError(f"unknown placeholders {sorted(unknown)} in {template!r}")
    filled = [F.lit(p) if i % 2 == 0 else F.when(F.lit(p == "root") & (F.coalesce(values[p], F.lit("")) == ""), "").otherwise(text.safe_filename(values[p])) for i, p in enumerate(pieces)]
    parts = F.filter(F.split(F.concat(*filled), "/"), lambda x: F.trim(x) != "")
    safe = F.array_join(F.transform(parts, lambda x: text.safe_filename(x)), "/")
    return F.when(safe == "", "Other/untitled").otherwise(safe)


def render(columns: list[str], body: Column, style: str = "callout", embeds: Column | None = None, prose: Column | None = None) -> Column:
    """A whole note: front matter, heading, summary, prose that was kept, embeds, text.

    Keys of the front matter that are no columns are left out.
    """
    nl, two = F.lit("\n"), F.lit("\n\n")
    front = text.frontmatter([(k, F.col(k), kind) for k, kind in KEYS if k in columns])
    filled = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(text.strip(c), two))
    none = F.lit(None).cast("string")
    attached = F.col("attachment") if "attachment" in columns else none
    links = F.array(attached) if embeds is None else F.array_distinct(F.concat(F.array(attached), F.coalesce(embeds, F.array().cast("array<string>"))))
    shown = F.array_join(F.transform(F.filter(F.array_compact(links), lambda x: x != ""), lambda x: F.concat(F.lit("![["), x, F.lit("]]"), two)), "")
    parts = [filled(F.col("summary")) if "summary" in columns else none, filled(prose) if prose is not None else none, shown]
    block = F.when(text.strip(F.coalesce(body, F.lit(""))) != "", text.text_block(F.substring(text.strip(body), 1, MOST_TEXT), style))
    return F.concat(front, two, F.lit("# "), F.coalesce("title", F.lit("")), two, *[F.coalesce(p, F.lit("")) for p in parts], F.coalesce(block, F.lit("")))


def meta_from_note(content: Column) -> dict[str, Column]:
    """The fields of a note's front matter, with defaults; a list given as one value is a list of one."""
    out = {}
    for key, kind in KEYS:
        one = text.front_value(content, key)
        if kind == "list":
            many = F.transform(text.front_list(content, key), lambda x: F.regexp_replace(F.trim(x), '^"(.*)"$', "$1"))
            out[key] = F.when(F.size(many) > 0, many).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))
        elif key == "date":
            out[key] = F.try_to_date(one, "yyyy-MM-dd")
        elif key in ("confidence", "ocr_quality"):
            out[key] = F.coalesce(one.try_cast("double"), F.lit(0.0)) if key == "confidence" else one.try_cast("double")
        elif key == "pages":
            out[key] = one.try_cast("int")
        elif key == "ocr":
            out[key] = one.try_cast("boolean")
        else:
            out[key] = F.coalesce(one, F.lit("")) if key in ("title", "category", "correspondent") else one
    return out


def linked_documents(notes: DataFrame, files: DataFrame, key: str = "note_id", folder: str = "folder", content: str = "content") -> DataFrame:
    """``(key, path, place)``: the documents a note links to, each once, in the order of their first link."""
    each = notes.select(key, F.col(folder).alias("folder"), F.posexplode(text.link_targets(F.col(content))).alias("place", "target"))
    each = each.withColumn("target", text.unquote(F.col("target")))
    found = resolve_links(each, files).filter("path is not null")
    return found.groupBy(key, "path").agg(F.min("place").alias("place"))


def loose_files(files: DataFrame, linked: DataFrame) -> DataFrame:
    """Files that no link resolves to and whose name no link has either. ``linked`` has ``path`` and ``target``."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    names = linked.select(base(F.col("target")).alias("base")).filter("base is not null").distinct()
    paths = linked.select("path").filter("path is not null").distinct()
    return files.join(paths, "path", "left_anti").withColumn("base", base(F.col("path"))).join(names, "base", "left_anti").drop("base")


def plan(notes: DataFrame, style: str, classes: list[str]) -> DataFrame:
    """``notes`` with ``kind, reason`` from what they are and what they should be.

    ``notes`` has ``path, content, wanted_path, wanted_category, wanted_tags,
    needs_ocr`` and the fields of the front matter. A note that is not readable, an
    index, not ours or without text is nothing to move or write again.
    """
    none = F.array().cast("array<string>")
    have = text.text_style(F.col("content"))
    flags = {
        "readable": F.col("content").isNotNull(),
        "is_index": F.lower(F.element_at(F.split("path", "/"), -1)).rlike(r"^_?index\.md$"),
        "managed": is_managed(notes.columns),
        "moved": F.col("wanted_path") != F.col("path"),
        "reclassified": F.col("wanted_category") != F.col("category"),
        "restyled": have.isNotNull() & (have != style),
        "retagged": F.col("wanted_tags").isNotNull() & (F.col("wanted_tags") != F.coalesce("tags", none)),
        "reclassed": F.size(F.array_except(F.array(*map(F.lit, classes)).cast("array<string>"), F.coalesce("cssclasses", none))) > 0,
    }
    return plan_actions(notes.withColumns({k: v for k, v in flags.items()})).drop(*flags)


def plan_loose(files: DataFrame, known: DataFrame) -> DataFrame:
    """``(path, digest, kind)`` of loose files: ``duplicate`` if their content is filed, else ``adopt``, the first of a content only."""
    first = files.groupBy("digest").agg(F.min("path").alias("_first"))
    seen = known.select("digest").distinct().withColumn("_seen", F.lit(True))
    kind = F.when(F.col("_seen") | (F.col("path") != F.col("_first")), "duplicate").otherwise("adopt")
    return files.join(first, "digest").join(seen, "digest", "left").select("path", "digest", kind.alias("kind"))
