"""Queries over the vault's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, jsonfix, quality, rules, text
from ..operators import classify, notes, tags, vault
from ..session import spread, table
from . import sqltext as q

TODAY = "2026-01-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _notes(s, d):
    """One row per note: deliveries of a note have the same content."""
    return table(s, d, "document_meta").drop("loaded_at").dropDuplicates(["note_id"])


_N = "notes as (select * exclude (loaded_at) from document_meta qualify row_number() over (partition by note_id order by loaded_at) = 1)"
_E = "extracts as (select * from extract_results qualify row_number() over (partition by extract_id order by loaded_at) = 1)"


def _extracts(s, d, *columns):
    return table(s, d, "extract_results").select("extract_id", *columns).dropDuplicates(["extract_id"])


# --- readability -----------------------------------------------------------


@query("quality_score", f"with {_E}, {q.quality_ctes('extracts', 'extract_id', 'pages')} select k as extract_id, cast(round(sc * 1000) as int) as score_milli, {q.VERDICT} as verdict, chars, words, common, garbled from scored")
def quality_score(s, d):
    # Scored before rows delivered again meet, so that no text is shuffled.
    scored = quality.score_texts(spread(table(s, d, "extract_results").select("extract_id", "text", "pages")), "extract_id")
    return scored.drop("reasons").dropDuplicates(["extract_id"])


@query("quality_histogram", f"with {q.quality_ctes('documents', 'doc_id', 'null::int')} select {q.VERDICT} as verdict, count(*) as n from scored group by 1")
def quality_histogram(s, d):
    return quality.score_texts(table(s, d, "documents"), "doc_id", pages=None).groupBy("verdict").agg(F.count("*").alias("n"))


@query("quality_reasons")
def quality_reasons(s, d):
    return quality.score_texts(table(s, d, "documents"), "doc_id", pages=None).select("doc_id", "verdict", "reasons")


_NOISY = "translate(text, 'eao', '340')"


@query("quality_noisy", f"with noisy as (select doc_id, {_NOISY} as text from documents), {q.quality_ctes('noisy', 'doc_id', '1')} select k as doc_id, cast(round(sc * 1000) as int) as score_milli, {q.VERDICT} as verdict from scored")
def quality_noisy(s, d):
    noisy = table(s, d, "documents").select("doc_id", F.translate("text", "eao", "340").alias("text"), F.lit(1).alias("pages"))
    return quality.score_texts(noisy, "doc_id").select("doc_id", "score_milli", "verdict")


# --- strings ---------------------------------------------------------------


@query("slugify_titles", f"with {_N} select note_id, {q.slug('title')} as slug, {q.slug('correspondent', 40)} as sender from notes")
def slugify_titles(s, d):
    return _notes(s, d).select("note_id", text.slugify(F.col("title")).alias("slug"), text.slugify(F.col("correspondent"), 40).alias("sender"))


@query("fold_text", f"select doc_id, {q.fold('text')} as folded from documents")
def fold_text(s, d):
    return table(s, d, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("safe_filename", f"with {_N} select note_id, {q.safe_filename('title')} as name from notes")
def safe_filename(s, d):
    return _notes(s, d).select("note_id", text.safe_filename(F.col("title")).alias("name"))


@query("clean_title", f"with {_N} select note_id, {q.clean_title("'![[' || source_file || ']] ' || title || ' -'")} as title from notes")
def clean_title(s, d):
    raw = F.concat(F.lit("![["), "source_file", F.lit("]] "), "title", F.lit(" -"))
    return _notes(s, d).select("note_id", text.clean_title(raw).alias("title"))


_STEM = "regexp_replace(source_file, '(.)\\.[^.]*$', '\\1')"


@query("clean_document_name", f"with {_N} select note_id, {q.clean_document_name(_STEM)} as name from notes where source_file is not null")
def clean_document_name(s, d):
    stem = text.stem_of(F.col("source_file"))
    return _notes(s, d).filter("source_file is not null").select("note_id", text.clean_document_name(stem).alias("name"))


@query(
    "truncate_words",
    """select doc_id, case when length(text) <= 200 then text else
  rtrim(case when strpos(substr(text, 1, 200), ' ') > 0 and 200 - strpos(reverse(substr(text, 1, 200)), ' ') > 120
    then substr(text, 1, 200 - strpos(reverse(substr(text, 1, 200)), ' ')) else substr(text, 1, 200) end) || chr(10) || '[...truncated...]' end as clipped from documents""",
)
def truncate_words(s, d):
    return table(s, d, "documents").select("doc_id", text.truncate_words(F.col("text"), 200).alias("clipped"))


@query("excerpt", "select doc_id, case when length(text) <= 3000 then text else substr(text, 1, 2550) || chr(10) || '[...]' || chr(10) || substr(text, length(text) - 449, 450) end as excerpt from documents")
def excerpt(s, d):
    return table(s, d, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@query(
    "document_name",
    f"with {_N}, p as (select note_id, coalesce(trim(correspondent, ' '), '') as c, coalesce(trim(title, ' '), '') as t from notes) "
    "select note_id, case when c = '' or contains(lower(t), lower(c)) then t else c || ' - ' || t end as name from p",
)
def document_name(s, d):
    return _notes(s, d).select("note_id", text.document_name(F.col("correspondent"), F.col("title")).alias("name"))


@query("digits_and_packs", "select doc_id, regexp_replace(text, '[^0-9]', '', 'g') as digits, string_split(lang || '+eng', '+') as packs from documents where lang is not null")
def digits_and_packs(s, d):
    docs = table(s, d, "documents").filter("lang is not null")
    return docs.select("doc_id", text.digits_of(F.col("text")).alias("digits"), F.split(F.concat("lang", F.lit("+eng")), r"\+").alias("packs"))


@query("source_folder", "select batch_id, case when lower(source_folder) like 'inbox/%' then nullif(substr(source_folder, 7), '') end as inner_folder from scan_batches")
def source_folder(s, d):
    path = F.concat(F.regexp_replace("source_folder", "(?i)^inbox", "Inbox"), F.lit("/x.pdf"))
    inner = F.when(F.lower("source_folder").startswith("inbox/"), text.source_folder(path, "Inbox"))
    return table(s, d, "scan_batches").select("batch_id", inner.alias("inner_folder"))


_BODY = "'# ' || title || chr(10) || coalesce(summary, '') || chr(10) || '![[files/' || source_file || ']]' || chr(10) || '[copy](old/' || source_hash || '.pdf)'"


def _body():
    nl = F.lit("\n")
    return F.concat(F.lit("# "), "title", nl, F.coalesce("summary", F.lit("")), nl, F.lit("![[files/"), "source_file", F.lit("]]"), nl, F.lit("[copy](old/"), "source_hash", F.lit(".pdf)"))


@query(
    "link_targets",
    f"with {_N}, b as (select note_id, {_BODY} as body from notes) select note_id, list_concat("
    "list_filter(list_transform(list_filter(string_split(body, '[[')[2:], lambda x: contains(x, ']')), lambda x: split_part(split_part(split_part(x, ']', 1), '|', 1), '#', 1)), lambda x: x <> ''), "
    "list_filter(list_transform(list_filter(string_split(body, '](')[2:], lambda x: contains(x, ')')), lambda x: split_part(x, ')', 1)), lambda x: x <> '' and not regexp_matches(x, '[\\s<>]'))) as targets from b",
)
def link_targets(s, d):
    return _notes(s, d).select("note_id", text.link_targets(_body()).alias("targets"))


@query("strip_markup", f"with {_N}, b as (select note_id, {_BODY} as body from notes) select note_id, {q.re_sub(q.re_sub(q.re_sub('body', '(?m)^#.*$', ''), q.LINK_MARKUP, ' '), chr(94) + chr(92) + 's+|' + chr(92) + 's+$', '')} as prose from b")
def strip_markup(s, d):
    return _notes(s, d).select("note_id", text.strip_markup(_body()).alias("prose"))


# --- notes -----------------------------------------------------------------

_FM = (
    "array_to_string(list_filter(['---', "
    "case when title <> '' then 'title: \"' || replace(replace(replace(title, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), ' ') || '\"' end, "
    "case when document_date is not null then 'date: ' || strftime(document_date, '%Y-%m-%d') end, "
    "case when len(tags) > 0 then 'tags:' || chr(10) || array_to_string(list_transform(tags, lambda t: '  - ' || t), chr(10)) end, "
    "'---'], lambda x: x is not null), chr(10))"
)


def _front():
    return text.frontmatter([("title", F.col("title"), "str"), ("date", F.col("document_date"), "raw"), ("tags", F.col("tags"), "list")])


@query(
    "note_render",
    f"with {_N}, e as (select note_id, arg_max(text, extract_id) as text from extract_results where text is not null and note_id is not null group by 1) "
    f"select note_id, {_FM} || chr(10) || chr(10) || '# ' || coalesce(title, '') || chr(10) || chr(10) || '> [!quote]- Extracted text' || chr(10) || '> ```text' || chr(10) || "
    "array_to_string(list_transform(string_split(substr(text, 1, 20000), chr(10)), lambda x: case when x = '' then '>' else '> ' || x end), chr(10)) || chr(10) || '> ```' || chr(10) as note "
    "from notes join e using (note_id)",
)
def note_render(s, d):
    found = table(s, d, "extract_results").filter("text is not null and note_id is not null").groupBy("note_id").agg(F.max_by("text", "extract_id").alias("text"))
    nl = F.lit("\n")
    note = F.concat(_front(), nl, nl, F.lit("# "), F.coalesce("title", F.lit("")), nl, nl, text.text_block(F.substring("text", 1, 20000)))
    return _notes(s, d).join(found, "note_id").select("note_id", note.alias("note"))


@query(
    "note_round_trip",
    f"with {_N} select note_id, nullif(replace(title, chr(10), ' '), '') as title, strftime(document_date, '%Y-%m-%d') as date, coalesce(list_filter(tags, lambda t: t is not null), []) as tags from notes",
)
def note_round_trip(s, d):
    content = _notes(s, d).select("note_id", F.concat(_front(), F.lit("\n\nbody")).alias("content"))
    c = F.col("content")
    return content.select("note_id", text.front_value(c, "title").alias("title"), text.front_value(c, "date").alias("date"), text.front_list(c, "tags").alias("tags"))


#: A line of the text that begins like a fence ends the block.
_UNFENCED = "case when starts_with(text, '```') then '' when contains(text, chr(10) || '```') then substr(text, 1, strpos(text, chr(10) || '```') - 1) else text end"


@query("text_blocks", f"select doc_id, style, {_UNFENCED} as embedded from documents, (values ('callout'), ('details'), ('plain')) s(style) where text is not null")
def text_blocks(s, d):
    docs = table(s, d, "documents").filter("text is not null")
    each = [docs.select("doc_id", text.text_block(F.col("text"), style).alias("body")) for style in ("callout", "details", "plain")]
    all_ = each[0].unionByName(each[1]).unionByName(each[2])
    return all_.select("doc_id", text.text_style(F.col("body")).alias("style"), text.embedded_text(F.col("body")).alias("embedded"))


@query(
    "note_path",
    f"with {_N}, p as (select note_id, {q.safe_filename('category')} || '/' || coalesce(strftime(document_date, '%Y'), 'undated') || '/' || {q.safe_filename('title')} as path from notes) "
    "select note_id, path || case when row_number() over w > 1 then '-' || row_number() over w else '' end || '.md' as unique_path from p window w as (partition by path order by note_id)",
)
def note_path(s, d):
    year = F.coalesce(F.date_format("document_date", "yyyy"), F.lit("undated"))
    path = F.concat_ws("/", text.safe_filename(F.col("category")), year, text.safe_filename(F.col("title")))
    return vault.numbered_paths(_notes(s, d).select("note_id", path.alias("path")), "path", F.lit(".md"), "note_id").select("note_id", "unique_path")


@query(
    "link_resolution",
    f"""with {_N}, files as (select distinct 'files/' || source_file as path from notes where source_file is not null),
names as (select list_extract(string_split(path, '/'), -1) as base, count(*) as n, min(path) as lone from files group by 1),
links as (select note_id, case when note_id % 3 = 0 then 'files' when note_id % 3 = 1 then '' else 'other' end as folder, case when note_id % 2 = 0 then source_file else 'files/' || source_file end as target from notes where source_file is not null)
select note_id, folder, target, case when (case when folder = '' then target else folder || '/' || target end) in (select path from files) then (case when folder = '' then target else folder || '/' || target end)
  when target in (select path from files) then target else (select lone from names where n = 1 and base = list_extract(string_split(target, '/'), -1)) end as path from links""",
)
def link_resolution(s, d):
    notes = _notes(s, d).filter("source_file is not null")
    files = notes.select(F.concat(F.lit("files/"), "source_file").alias("path")).distinct()
    folder = F.when(F.col("note_id") % 3 == 0, "files").when(F.col("note_id") % 3 == 1, "").otherwise("other")
    target = F.when(F.col("note_id") % 2 == 0, F.col("source_file")).otherwise(F.concat(F.lit("files/"), "source_file"))
    return vault.resolve_links(notes.select("note_id", folder.alias("folder"), target.alias("target")), files)


# --- contents, index, files -------------------------------------------------


@query(
    "sha256_dedupe",
    f"""with {_E}, h as (select extract_id, extracted_at, sha256(text) as digest from extracts),
r as (select *, row_number() over (partition by digest order by extracted_at nulls last, extract_id) as n from h)
select extract_id, digest, case when digest is null or digest = sha256('') then 'skipped' when n > 1 then 'duplicate' else 'ingested' end as status from r""",
)
def sha256_dedupe(s, d):
    return vault.content_status(vault.digests(table(s, d, "extract_results"), "extract_id", "text", "extracted_at"), "extract_id", "extracted_at")


@query(
    "status_counts",
    f"""with {_E}, known as (select distinct sha256(text) as digest from documents where text <> ''),
r as (select extract_id, sha256(text) as digest, row_number() over (partition by sha256(text) order by extracted_at nulls last, extract_id) as n from extracts)
select case when r.digest is null or r.digest = sha256('') then 'skipped' when known.digest is not null or n > 1 then 'duplicate' else 'ingested' end as status, count(*) as n from r left join known using (digest) group by 1""",
)
def status_counts(s, d):
    known = table(s, d, "documents").filter("text <> ''").select(F.sha2("text", 256).alias("digest"))
    rows = vault.digests(table(s, d, "extract_results"), "extract_id", "text", "extracted_at")
    return vault.content_status(rows, "extract_id", "extracted_at", known).groupBy("status").agg(F.count("*").alias("n"))


@query("loose_documents", "select doc_id from documents where doc_id not in (select doc_id from document_meta where doc_id is not null)")
def loose_documents(s, d):
    return vault.loose(table(s, d, "documents").select("doc_id"), table(s, d, "document_meta"), "doc_id")


@query("index_prune", "select distinct extract_id from text_quality where extract_id in (select extract_id from extract_results where text is not null)")
def index_prune(s, d):
    return vault.prune(table(s, d, "text_quality").select("extract_id").distinct(), table(s, d, "extract_results").filter("text is not null"), "extract_id")


@query(
    "index_upsert",
    f"""with {_N}, old as (select source_hash, min(note_id) as note_id from notes where source_hash is not null and note_id % 2 = 0 group by 1),
new as (select source_hash, max(note_id) as note_id from notes where source_hash is not null and note_id % 3 = 0 group by 1)
select source_hash, note_id from new union all select source_hash, note_id from old where source_hash not in (select source_hash from new)""",
)
def index_upsert(s, d):
    notes = _notes(s, d).filter("source_hash is not null")
    old = notes.filter("note_id % 2 = 0").groupBy("source_hash").agg(F.min("note_id").alias("note_id"))
    new = notes.filter("note_id % 3 = 0").groupBy("source_hash").agg(F.max("note_id").alias("note_id"))
    return vault.upsert(old, new, "source_hash")


@query(
    "text_assembly",
    f"with {_E} select note_id, string_agg(text, chr(10) || chr(10) order by extract_id) as text, sum(pages)::bigint as pages from extracts where note_id is not null and trim(text, ' ') <> '' group by note_id",
)
def text_assembly(s, d):
    return vault.assembled(table(s, d, "extract_results"), "note_id", "extract_id")


@query(
    "note_text",
    f"""with {_N}, {_E}, e as (select note_id, arg_max(text, extract_id) as text from extracts where note_id is not null and text is not null group by 1)
select note_id, case when length(e.text) >= 180 then e.text when trim(d.text, ' ') <> '' then d.text else coalesce(summary, '') end as text from notes n left join e using (note_id) left join documents d using (doc_id)""",
)
def note_text(s, d):
    # The text of the last reading is the same however often it was delivered.
    readings = table(s, d, "extract_results").filter("note_id is not null and text is not null")
    e = readings.groupBy("note_id").agg(F.max_by("text", "extract_id").alias("read"))
    docs = table(s, d, "documents").select("doc_id", F.col("text").alias("own"))
    chosen = F.when(F.length("read") >= 180, F.col("read")).when(F.trim("own") != "", F.col("own")).otherwise(F.coalesce("summary", F.lit("")))
    return _notes(s, d).join(e, "note_id", "left").join(docs, "doc_id", "left").select("note_id", chosen.alias("text"))


# --- filters -----------------------------------------------------------------

@query(
    "file_kinds",
    f"""with {_N} select note_id, lower(regexp_extract(source_file, '\\.([^.]+)$', 1)) in ('png','jpg','jpeg','tif','tiff','bmp','gif','webp','heic') as is_image,
lower(source_file) like '%.pdf' as is_pdf, coalesce(source_hash <> '', false) or coalesce(classifier <> '', false) as is_managed,
coalesce(title, '') = '' or coalesce(category, '') = '' or len(coalesce(tags, [])) = 0 or coalesce(classifier = 'heuristic', false) as needs_classification from notes where source_file is not null""",
)
def file_kinds(s, d):
    from ..sources.scan import is_image, is_pdf

    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return _notes(s, d).filter("source_file is not null").select(
        "note_id",
        is_image(F.col("source_file")).alias("is_image"),
        is_pdf(F.col("source_file")).alias("is_pdf"),
        (~empty("source_hash") | ~empty("classifier")).alias("is_managed"),
        (empty("title") | empty("category") | (F.coalesce(F.size("tags"), F.lit(0)) <= 0) | F.coalesce(F.col("classifier") == "heuristic", F.lit(False))).alias("needs_classification"),
    )


@query("needs_ocr", f"with {_E} select note_id, bool_or(coalesce(lower(regexp_extract(pdf_path, '\\.([^./]+)$', 1)) in ('png','jpg','jpeg','tif','tiff','bmp','gif','webp','heic'), false) or coalesce(length(trim(text, ' ')), 0) < 10) as needs_ocr from extracts where note_id is not null group by 1")
def needs_ocr(s, d):
    readings = table(s, d, "extract_results").filter("note_id is not null").select("note_id", F.col("pdf_path").alias("path"), "text")
    return notes.needs_ocr(readings)


@query("plausible_dates", f"with {_N} select note_id, document_date from notes where document_date between date '1900-01-01' and date '{TODAY}'")
def plausible_dates(s, d):
    return _notes(s, d).filter(dates.plausible(F.col("document_date"), TODAY)).select("note_id", "document_date")


@query(
    "tags_off_ledger",
    f"""with {_N}, each as (select distinct note_id, t from (select note_id, unnest(tags) as t from notes) where t is not null and t not in (select canonical from tag_groups where canonical is not null)),
per as (select note_id, list(t order by t) as off from each group by 1) select note_id, case when tags is not null then coalesce(off, []) end as off from notes left join per using (note_id)""",
)
def tags_off_ledger(s, d):
    known = table(s, d, "tag_groups").select(F.col("canonical").alias("tag")).distinct()
    notes = _notes(s, d).select("note_id", "tags")
    off = notes.select("note_id", F.explode("tags").alias("tag")).filter("tag is not null").distinct().join(known, "tag", "left_anti")
    per = off.groupBy("note_id").agg(F.array_sort(F.collect_list("tag")).alias("off"))
    filled = F.coalesce("off", F.array().cast("array<string>"))
    return notes.join(per, "note_id", "left").select("note_id", F.when(F.col("tags").isNotNull(), filled).alias("off"))


# --- dates -----------------------------------------------------------------

_LINE = "'Invoice date: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'Due date: ' || strftime(o_orderdate + interval 30 day, '%d/%m/%Y')"


def _dated(s, d):
    day = F.col("o_orderdate").cast("date")
    line = F.concat(F.lit("Invoice date: "), F.date_format(day, "yyyy-MM-dd"), F.lit("\nDue date: "), F.date_format(F.date_add(day, 30), "dd/MM/yyyy"))
    return table(s, d, "orders").select("o_orderkey", line.alias("text"))


@query("date_from_text", f"select o_orderkey, o_orderdate::date as value, 'invoice date' as label from orders where o_orderdate::date <= date '{TODAY}'")
def date_from_text(s, d):
    found = spread(_dated(s, d)).select("o_orderkey", dates.main_dates(F.col("text"), TODAY).alias("b"))
    return found.filter("b.value is not null").select("o_orderkey", "b.value", "b.label")


@query("date_candidates")
def date_candidates(s, d):
    rows = spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(dates.find_dates(F.col("text"), TODAY)).alias("c"))
    return rows.select("doc_id", "c.value", "c.start", "c.end", "c.label", "c.weak")


@query("document_dates")
def document_dates(s, d):
    found = spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", dates.main_dates(F.col("text"), TODAY).alias("b"))
    return found.select("doc_id", "b.value", "b.label", "b.strong")


_DMY = "strftime(o_orderdate, '%-d/%-m/%Y')"


@query(
    "date_parse",
    "select o_orderkey, o_orderdate::date as day_first, case when day(o_orderdate) <= 12 then make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) else o_orderdate::date end as month_first, "
    "case when o_orderkey % 100 < 70 then 2000 + o_orderkey % 100 else 1900 + o_orderkey % 100 end as two_digits from orders",
)
def date_parse(s, d):
    written = F.date_format("o_orderdate", "d/M/yyyy")
    short = F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")
    return table(s, d, "orders").select(
        "o_orderkey",
        dates.parse_date(written).alias("day_first"),
        dates.parse_date(written, False).alias("month_first"),
        dates.two_digit_year(short).cast("bigint").alias("two_digits"),
    )


@query("date_from_filename", "select o_orderkey, o_orderdate::date as value from orders")
def date_from_filename(s, d):
    k = F.col("o_orderkey") % 3
    stem = (
        F.when(k == 0, F.concat(F.lit("receipt "), F.date_format("o_orderdate", "MMM d, yyyy")))
        .when(k == 1, F.concat(F.lit("602334_"), F.date_format("o_orderdate", "dd_MMM_yyyy")))
        .otherwise(F.concat(F.lit("scan "), F.date_format("o_orderdate", "yyyy_MM_dd"), F.lit(" - 1")))
    )
    return table(s, d, "orders").select("o_orderkey", dates.date_from_filename(stem).alias("value"))


@query(
    "screenshot_name",
    "select event_id, date_trunc('second', ts) as taken_at, 'boiler' as rest from events where event_id % 4 <> 3",
)
def screenshot_name(s, d):
    k = F.col("event_id") % 4
    day = F.date_format("ts", "yyyy-MM-dd")
    name = (
        F.when(k == 0, F.concat(F.lit("Screenshot "), day, F.lit(" at "), F.date_format("ts", "HH.mm.ss"), F.lit(" boiler")))
        .when(k == 1, F.concat(F.lit("Screen Shot "), day, F.lit(" at "), F.date_format("ts", "h.mm.ss"), F.lit(" "), F.date_format("ts", "a"), F.lit(" boiler")))
        .when(k == 2, F.concat(F.lit("Skärmavbild "), day, F.lit(" kl. "), F.date_format("ts", "HH.mm.ss"), F.lit(" boiler")))
        .otherwise(F.concat(F.lit("Screenshot "), day, F.lit(" report")))
    )
    return table(s, d, "events").select("event_id", dates.screenshot(name).alias("shot")).filter("shot is not null").select("event_id", "shot.taken_at", "shot.rest")


@query(
    "resolve_date",
    f"""with {_N}, t as (select note_id, document_date as model, try_cast(regexp_extract(source_file, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) as date) as filename, processed_at::date as created from notes)
select note_id, case when model between date '1900-01-01' and date '{TODAY}' then model when filename between date '1900-01-01' and date '{TODAY}' then filename when created between date '1900-01-01' and date '{TODAY}' then created end as date,
case when model between date '1900-01-01' and date '{TODAY}' then 'model' when filename between date '1900-01-01' and date '{TODAY}' then 'filename' when created between date '1900-01-01' and date '{TODAY}' then 'file-created' end as source from t""",
)
def resolve_date(s, d):
    none = F.lit(None).cast("date")
    named = dates.make_date(*[F.regexp_extract("source_file", r"(\d{4})-(\d{2})-(\d{2})", i) for i in (1, 2, 3)])
    found = dates.resolve_date(none, F.col("document_date"), none, named, F.col("processed_at").cast("date"), TODAY)
    return _notes(s, d).select("note_id", found.alias("r")).select("note_id", "r.date", "r.source")


@query(
    "retag_year",
    f"""with {_N}, y as (select note_id, tags, coalesce('year-' || year(document_date), '') as was, coalesce('year-' || year(processed_at), '') as now from notes where tags is not null),
p as (select *, coalesce(nullif(list_position(tags, was), 0), len(tags) + 1) as spot, list_filter(tags, lambda t: t is null or t <> was) as rest from y)
select note_id, case when was = now then tags when now = '' or coalesce(list_contains(rest, now), false) then rest else list_concat(list_slice(rest, 1, least(spot, len(rest) + 1) - 1), [now], list_slice(rest, least(spot, len(rest) + 1), len(rest))) end as tags from p""",
)
def retag_year(s, d):
    rows = _notes(s, d).filter("tags is not null")
    return rows.select("note_id", dates.retag_year(F.col("tags"), F.col("document_date"), F.col("processed_at")).alias("tags"))


# --- rules ------------------------------------------------------------------

_HAY = q.fold("array_to_string(list_filter([nullif(title, ''), nullif(correspondent, ''), nullif(summary, ''), nullif(substr(coalesce(d.text, ''), 1, 4000), '')], lambda x: x is not null), chr(10))")
_RULED = f"ruled as (select n.note_id, {q.rule_tags('h')} as tags, {q.rule_tags('t')} as title_tags, category, classifier from (select n.note_id, n.category, n.classifier, {_HAY} as h, {q.fold("coalesce(title, '')")} as t from notes n left join documents d using (doc_id)) n)"


def _ruled(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    hay = rules.haystack(F.col("title"), F.col("correspondent"), F.col("summary"), F.coalesce("text", F.lit("")))
    rows = _notes(s, d).join(docs, "doc_id", "left").withColumn("hay", hay).withColumn("hay_title", text.fold(F.coalesce("title", F.lit(""))))
    return rows.withColumn("rule_tags", rules.rule_tags(F.col("hay"))).withColumn("title_tags", rules.rule_tags(F.col("hay_title")))


@query("rule_tags", f"with {_N}, {_RULED} select note_id, tags from ruled")
def rule_tags(s, d):
    return _ruled(s, d).select("note_id", F.col("rule_tags").alias("tags"))


def _first(tags: str, weak: bool) -> str:
    order = [t for t in rules.CATEGORY_OF if t not in rules.WEAK] + [t for t in rules.CATEGORY_OF if t in rules.WEAK] * weak
    return "coalesce(" + ", ".join(f"case when list_contains({tags}, {q.lit(t)}) then {q.lit(rules.CATEGORY_OF[t])} end" for t in order) + ")"


@query(
    "category_from_rules",
    f"with {_N}, {_RULED} select note_id, case when coalesce(category, 'none') in ('none', 'Private correspondence') then coalesce({_first('tags', True)}, category) "
    f"when coalesce(classifier, '') <> 'llm' then coalesce({_first('title_tags', True)}, {_first('tags', False)}, category) else category end as category from ruled",
)
def category_from_rules(s, d):
    c = rules.category_from_rules(F.col("category"), F.col("classifier"), F.col("title_tags"), F.col("rule_tags"))
    return _ruled(s, d).select("note_id", c.alias("category"))


def _heuristic_sql(e: str) -> str:
    cases = " ".join("when " + " or ".join(f"contains(lower({e}), {q.lit(w)})" for w in words) + f" then {q.lit(name)}" for name, words in rules.HEURISTICS)
    return f"case when {e} is null then 'none' {cases} else 'none' end"


@query("heuristic_category", f"select doc_id, {_heuristic_sql('text')} as category from documents")
def heuristic_category(s, d):
    return table(s, d, "documents").select("doc_id", rules.heuristic_category(F.col("text")).alias("category"))


@query("heuristic_title")
def heuristic_title(s, d):
    return table(s, d, "documents").select("doc_id", rules.heuristic_title(F.col("text")).alias("title"))


@query(
    "derived_tags",
    f"""with {_N} select note_id, list_filter(list_concat([{q.slug('category')}, case when document_date is not null then 'year-' || year(document_date) end, {q.slug('correspondent', 40)}],
list_transform(coalesce(subjects, [])[1:3], lambda x: {q.slug('x', 40)}), [{q.slug('document_type', 40)}, case when context = 'business' then 'business' end,
case when coalesce(classifier, '') <> 'llm' or (confidence < 0.5 and not isnan(confidence)) then 'needs-review' end]), lambda t: t is not null and t <> '') as tags from notes""",
)
def derived_tags(s, d):
    c = F.col
    sure = F.when(~F.isnan("confidence"), c("confidence"))
    got = rules.derived_tags(c("category"), c("document_date"), c("correspondent"), c("subjects"), c("document_type"), c("context"), F.array().cast("array<string>"), c("classifier"), sure)
    return _notes(s, d).select("note_id", got.alias("tags"))


@query("clean_tags")
def clean_tags(s, d):
    c = F.col
    got = rules.derived_tags(c("category"), c("document_date"), c("correspondent"), c("subjects"), c("document_type"), c("context"), c("rule_tags"), c("classifier"), c("confidence"))
    return _ruled(s, d).withColumn("derived", got).select("note_id", rules.clean_tags(["scan"], c("derived"), c("tags")).alias("tags"))


@query("category_match")
def category_match(s, d):
    names = [r[0] for r in table(s, d, "category_list").select("category").orderBy("category_code").collect()]  # a configured list
    return _notes(s, d).select("note_id", rules.match_category(F.col("category"), names).alias("category"))


# --- model answers ------------------------------------------------------------

_ANSWER = "title string, category string, tags array<string>, confidence double"


@query(
    "json_answers",
    f"with {_N} select note_id, title, category, [document_type] as tags from notes where title is not null and category is not null and document_type is not null",
)
def json_answers(s, d):
    rows = _notes(s, d).filter("title is not null and category is not null and document_type is not null")
    body = F.to_json(F.struct("title", "category", F.array("document_type").alias("tags")))
    k = F.col("note_id") % 3
    answer = (
        F.when(k == 0, F.concat(F.lit("<think>hm {</think>\n```json\n"), body, F.lit("\n```")))
        .when(k == 1, F.concat(F.lit("Here it is: "), body, F.lit(" Anything else?")))
        .otherwise(F.concat(F.lit("Sure: "), F.replace(body, F.lit(',"tags"'), F.lit(' "tags"'))))
    )
    return rows.select("note_id", jsonfix.parse_answer(answer, _ANSWER).alias("a")).select("note_id", "a.title", "a.category", "a.tags")


@query(
    "memo_key",
    "select doc_id, sha256('3' || chr(0) || 'stub' || chr(0) || coalesce(lang, '') || chr(0) || 'a|b' || chr(0) || coalesce(text, '') || chr(0)) as memo_key from documents",
)
def memo_key(s, d):
    return table(s, d, "documents").select("doc_id", vault.memo_key(3, "stub", F.col("lang"), ["a", "b"], F.col("text")).alias("memo_key"))


@query(
    "memo_misses",
    "with k as (select doc_id, sha256('3' || chr(0) || 'stub' || chr(0) || chr(0) || '' || chr(0) || coalesce(text, '') || chr(0)) as m from documents), memo as (select distinct m from k where doc_id % 2 = 0) select doc_id from k where m not in (select m from memo)",
)
def memo_misses(s, d):
    rows = table(s, d, "documents").select("doc_id", vault.memo_key(3, "stub", F.lit(""), [], F.col("text")).alias("memo_key"))
    memo = rows.filter("doc_id % 2 = 0").select("memo_key").distinct().withColumn("response", F.lit("{}"))
    return vault.with_memo(rows, memo)[1].select("doc_id")


# --- tags -------------------------------------------------------------------

_CENSUS = f"""{_N}, raw as (select unnest(tags) as t from notes), slugs as (select {q.slug("ltrim(t, '#')", 40)} as tag from raw where t is not null),
census as (select {q.fingerprint('tag')} as fp, tag, count(*) as n from slugs where tag <> '' group by tag)"""


@query("tag_census", f"with {_CENSUS} select fp, tag, n from census")
def tag_census(s, d):
    return tags.census(_notes(s, d))


@query("tag_election", f"with {_CENSUS} select fp, first(tag order by n desc, length(tag), tag) as canonical, sum(n)::bigint as total, count(*) as spellings from census group by fp")
def tag_election(s, d):
    return tags.elect(tags.census(_notes(s, d)))


#: Each fifth note writes its tags in the plural, so that there are spellings to put together.
_PLURALS = _CENSUS.replace("select unnest(tags) as t from notes", "select unnest(case when note_id % 5 = 0 then list_transform(tags, lambda t: t || 's') else tags end) as t from notes")


@query("tag_duplicates", f"with {_PLURALS} select first(tag order by n desc, length(tag), tag) as canonical, sum(n)::bigint as total, count(*) as spellings from census group by fp having count(*) > 1")
def tag_duplicates(s, d):
    plural = F.when(F.col("note_id") % 5 == 0, F.transform("tags", lambda t: F.concat(t, F.lit("s")))).otherwise(F.col("tags"))
    return tags.duplicates(tags.census(_notes(s, d).withColumn("tags", plural)))


@query(
    "tag_reserved",
    f"with {_CENSUS}, kept as (select {q.fingerprint('tag')} as fp, max(tag) as kept from (select {q.slug('canonical', 40)} as tag from tag_groups where protected) where tag <> '' group by 1) "
    "select fp, coalesce(kept, first(tag order by n desc, length(tag), tag)) as canonical, sum(n)::bigint as total, count(*) as spellings from census left join kept using (fp) group by fp, kept",
)
def tag_reserved(s, d):
    kept = table(s, d, "tag_groups").filter("protected").select(F.col("canonical").alias("tag"))
    return tags.elect(tags.census(_notes(s, d)), kept)


@query("tag_canonicalise")
def tag_canonicalise(s, d):
    return tags.canonical_map(_notes(s, d))


@query("tag_protected")
def tag_protected(s, d):
    kept = table(s, d, "tag_groups").filter("protected").select(F.col("canonical").alias("tag"))
    return tags.canonical_map(_notes(s, d), protected=kept)


def _ledger(s, d):
    total = F.aggregate(F.filter(F.map_values("counts"), lambda n: n.isNotNull()), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return table(s, d, "tag_groups").filter("canonical is not null and counts is not null").select("canonical", total.alias("total"))


@query("tag_against_ledger")
def tag_against_ledger(s, d):
    return tags.against_ledger(_notes(s, d), _ledger(s, d))


@query(
    "tags_applied",
    f"with {_N}, each as (select note_id, {q.slug("ltrim(t, '#')", 40)} as tag, place from (select note_id, unnest(tags) as t, generate_subscripts(tags, 1) as place from notes) where t is not null), "
    "one as (select note_id, tag, min(place) as place from each where tag <> '' group by 1, 2), per as (select note_id, list(tag order by place) as tags from one group by 1) "
    "select note_id, coalesce(per.tags, []) as tags from notes left join per using (note_id)",
)
def tags_applied(s, d):
    rows = _notes(s, d)
    same = tags.census(rows).select("tag", F.col("tag").alias("canonical"))
    return tags.applied(rows, same)


@query(
    "ledger_recorded",
    f"with {_N}, l as (select canonical, coalesce(list_sum(list_filter(map_values(counts), lambda x: x is not null)), 0)::bigint as total from tag_groups where canonical is not null and counts is not null), "
    "w as (select t as canonical, count(*) as total from (select unnest(tags) as t from notes) where t <> '' group by 1) select canonical, sum(total)::bigint as total from (select * from l union all select * from w) group by 1",
)
def ledger_recorded(s, d):
    return tags.recorded(_ledger(s, d), _notes(s, d))


# --- ranking and planning --------------------------------------------------------

_LATEST_Q = "latest as (select extract_id, score, verdict from text_quality where scored_at is not null and score is not null qualify row_number() over (partition by extract_id order by scored_at desc, score desc, verdict desc nulls last) = 1)"


def _scored(s, d):
    """The newest score of each reading; of several of one time the highest."""
    rows = table(s, d, "text_quality").filter("scored_at is not null and score is not null")
    best = F.max(F.struct("scored_at", "score", "verdict"))
    return rows.groupBy("extract_id").agg(best.alias("b")).select("extract_id", "b.score", "b.verdict")


@query(
    "reocr_worklist",
    f"with {_LATEST_Q}, todo as (select *, row_number() over (order by score, extract_id) as r from latest where verdict not in ('good', 'thin') or verdict is null) "
    "select extract_id, score, verdict, case when r <= 100 then 'reocr' else 'deferred' end as kind from todo union all select extract_id, score, verdict, verdict from latest where verdict in ('good', 'thin')",
)
def reocr_worklist(s, d):
    return vault.worklist(_scored(s, d), "extract_id", 100)


_ATTEMPTS = f"""{_E}, tried as (select note_id, row_number() over (partition by note_id order by attempt, extract_id) as attempt, score from extracts join latest using (extract_id) where note_id is not null),
marked as (select *, coalesce(max(case when attempt > 1 and score >= 0.7 then 1 end) over (partition by note_id order by attempt rows between unbounded preceding and 1 preceding), 0) as g from tried),
used as (select * from marked where g = 0 or attempt = 1)"""


@query(
    "best_attempt",
    f"with {_LATEST_Q}, {_ATTEMPTS}, r as (select note_id, max(case when attempt = 1 then score end) as before, max(case when attempt > 1 then score end) as after, "
    "first(attempt order by score desc, attempt) filter (attempt > 1) as attempt, count(*) as tried from used group by 1) "
    "select note_id, before, after, attempt, case when after is null then 'failed' when after >= coalesce(before, 0) + 0.05::double then 'improved' else 'unchanged' end as kind, tried from r",
)
def best_attempt(s, d):
    e = _extracts(s, d, "note_id", "attempt").filter("note_id is not null").join(_scored(s, d), "extract_id")
    n = F.row_number().over(Window.partitionBy("note_id").orderBy("attempt", "extract_id")).cast("bigint")
    return vault.best_attempt(e.select("note_id", n.alias("attempt"), "score"), "note_id")


_FLAGS = """select note_id, title is not null as readable, source_file ilike '%index%' as is_index, classifier <> '' as managed, doc_id is null as needs_ocr, para = 'archive' as moved,
classifier = 'heuristic' as reclassified, note_id % 7 = 0 as restyled, len(tags) = 0 as retagged, false as reclassed from notes"""


@query(
    "action_plan",
    f"with {_N}, f as ({_FLAGS}) select note_id, case when not readable then 'failed' when is_index then 'index' when not managed then 'skipped' when needs_ocr then 'ocr' when moved then 'relocate' "
    "when reclassified or restyled or retagged then 'rewrite' else 'noop' end as kind, case when not readable then 'unreadable' when is_index then 'index note' when not managed then 'not managed' when needs_ocr then 'no text' when moved then 'path' "
    "when reclassified then 'reclassified' when restyled then 'text style' when retagged then 'tags' else '' end as reason from f",
)
def action_plan(s, d):
    flags = _notes(s, d).selectExpr(
        "note_id", "title is not null as readable", "source_file ilike '%index%' as is_index", "classifier <> '' as managed", "doc_id is null as needs_ocr",
        "para = 'archive' as moved", "classifier = 'heuristic' as reclassified", "note_id % 7 = 0 as restyled", "size(tags) = 0 as retagged", "false as reclassed",
    )
    return vault.plan_actions(flags).select("note_id", "kind", "reason")


@query(
    "eval_slices",
    f"""with {_N}, r as (select n.language, n.context, n.category in (select category from category_list) as category_ok, coalesce(n.document_date between date '1990-01-01' and date '{TODAY}', false) as date_ok,
len(list_filter(coalesce(tags, []), lambda t: t is not null and t = lower(t))) as found, len(coalesce(tags, [])) as wanted from notes n)
select coalesce(language, '*') as language, coalesce(context, '*') as context, count(*) as n, cast(round(1000 * avg(cast(category_ok as int))) as int) as category_milli, cast(round(1000 * avg(cast(date_ok as int))) as int) as date_milli,
cast(round(1000 * case when sum(wanted) > 0 then sum(found) / sum(wanted) else 1 end) as int) as recall_milli from r group by grouping sets ((), (language), (context))""",
)
def eval_slices(s, d):
    entries = table(s, d, "category_list").select("category").distinct().withColumn("hit", F.lit(True))
    tags_ = F.coalesce("tags", F.array().cast("array<string>"))
    rows = _notes(s, d).join(F.broadcast(entries), "category", "left").select(
        "language",
        "context",
        F.when(F.col("category").isNotNull(), F.coalesce("hit", F.lit(False))).alias("category_ok"),
        F.coalesce(F.col("document_date").between("1990-01-01", TODAY), F.lit(False)).alias("date_ok"),
        F.size(F.filter(tags_, lambda t: t.isNotNull() & (t == F.lower(t)))).alias("tags_found"),
        F.size(tags_).alias("tags_wanted"),
    )
    return vault.accuracy_slices(rows)


@query("eval_misses", f"with {_N} select note_id, category from notes where category is not null and category not in (select category from category_list)")
def eval_misses(s, d):
    return _notes(s, d).join(table(s, d, "category_list").select("category"), "category", "left_anti").filter("category is not null").select("note_id", "category")


@query(
    "para_bucket",
    f"with {_N}, b as (select note_id, lower(trim(para, ' ')) as own, coalesce(source_file, '') as file from notes) select bucket, count(*) as n from "
    "(select case when own in ('project', 'area', 'resource', 'archive') then own when starts_with('Projects/' || file, 'Projects/doc') then 'project' else 'archive' end as bucket from b) group by 1",
)
def para_bucket(s, d):
    # Files of one prefix stand for those that lie in the folder of projects.
    folder = F.when(F.coalesce("source_file", F.lit("")).startswith("doc"), "Projects/").otherwise("Elsewhere/")
    path = F.concat(folder, F.coalesce("source_file", F.lit("")))
    buckets = {"project": "Projects", "area": "Areas", "resource": "Resources", "archive": "Archive"}
    return _notes(s, d).select(notes.bucket(F.col("para"), path, buckets, "archive").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def _categories(s, d) -> list[str]:
    return [r[0] for r in table(s, d, "category_list").select("category").orderBy("category_code").collect()]  # a configured list


@query("build_prompt")
def build_prompt(s, d):
    return table(s, d, "documents").select("doc_id", classify.build_prompt(F.coalesce("text", F.lit("")), _categories(s, d), F.col("source")).alias("prompt"))


@query("model_answers")
def model_answers(s, d):
    from ..streaming.model import StubClient, ask

    prompt = classify.build_prompt(F.col("text"), ["a", "b"])
    answered = ask(table(s, d, "documents").filter("text <> ''").select("doc_id", prompt.alias("prompt")), StubClient)
    answered = answered.withColumn("a", jsonfix.parse_answer(F.col("response"), _ANSWER))
    return answered.select("doc_id", "a.title", "a.category", "a.tags", "error")


@query("classify_staged")
def classify_staged(s, d):
    """Memo for half of the documents, the offline model for the rest."""
    from ..streaming.model import StubClient

    docs, names = table(s, d, "documents"), _categories(s, d)
    key = vault.memo_key(1, "stub", F.lit("en"), names, F.col("text"))
    answer = F.to_json(F.struct(F.lit("Remembered").alias("title"), F.lit(names[0]).alias("category"), F.array(F.lit("a")).alias("tags"), F.lit(0.9).alias("confidence")))
    memo = docs.filter("doc_id % 2 = 0 and text is not null").select(key.alias("memo_key"), answer.alias("response")).dropDuplicates(["memo_key"])
    return classify.classify(docs, names, StubClient, memo).drop("memo_key", "response")


@query(
    "classify_stages",
    "with e as (select *, regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+', '', 'g') = '' as blank from documents), m as (select distinct text from documents where doc_id % 2 = 0 and text is not null) "
    "select case when blank then 'empty' when text in (select text from m) then 'memo' else 'llm' end as classifier, count(*) as n from e group by 1",
)
def classify_stages(s, d):
    return classify_staged(s, d).groupBy("classifier").agg(F.count("*").alias("n"))


@query(
    "classify_offline",
    f"select doc_id, case when regexp_replace(coalesce(text, ''), '[\\s\\p{{Z}}]+', '', 'g') = '' then 'empty' else 'heuristic' end as classifier, {_heuristic_sql("coalesce(text, '')")} as category from documents",
)
def classify_offline(s, d):
    return classify.classify(table(s, d, "documents"), ["a", "b"]).select("doc_id", "classifier", "category")


@query(
    "filename_title",
    f"with {_N}, c as (select note_id, source_file, {q.clean_document_name(_STEM)} as name from notes) select note_id, case when source_file is null or name = '' then 'Untitled document' else name end as title from c",
)
def filename_title(s, d):
    return _notes(s, d).select("note_id", classify.filename_title(F.col("source_file")).alias("title"))


@query(
    "path_template",
    f"with {_N}, v as (select note_id, {q.safe_filename('category')} as c, {q.safe_filename('title')} as t, coalesce(strftime(document_date, '%Y'), 'untitled') as y from notes) select note_id, 'Notes/' || c || '/' || y || '/' || t as path from v",
)
def path_template(s, d):
    values = {"root": F.lit("Notes"), "category": F.col("category"), "year": F.date_format("document_date", "yyyy"), "name": F.col("title")}
    return _notes(s, d).select("note_id", notes.rendered_path("{root}/{category}/{year}/{name}", values).alias("path"))


def _full_notes(s, d):
    e = table(s, d, "extract_results").filter("text is not null and note_id is not null").groupBy("note_id").agg(F.max_by("text", "extract_id").alias("read"))
    rows = _notes(s, d).withColumn("date", F.col("document_date")).withColumn("cssclasses", F.array(F.lit("scan"))).withColumn("attachment", F.concat(F.lit("files/"), "source_file"))
    return rows.join(e, "note_id", "left")


@query("note_full")
def note_full(s, d):
    rows = _full_notes(s, d)
    return rows.select("note_id", notes.render(rows.columns, F.col("read")).alias("note"))


@query(
    "meta_round_trip",
    f"""with {_N} select note_id, coalesce(replace(nullif(title, ''), chr(10), ' '), '') as title, try_cast(strftime(document_date, '%Y-%m-%d') as date) as date, coalesce(replace(nullif(category, ''), chr(10), ' '), '') as category,
replace(nullif(amount, ''), chr(10), ' ') as amount, replace(nullif(para, ''), chr(10), ' ') as para, 'files/' || source_file as attachment, ['scan'] as cssclasses from notes""",
)
def meta_round_trip(s, d):
    rows = _full_notes(s, d)
    content = rows.select("note_id", notes.render(rows.columns, F.col("read")).alias("content"))
    meta = notes.meta_from_note(F.col("content"))
    return content.select("note_id", *[meta[k].alias(k) for k in ("title", "date", "category", "amount", "para", "attachment", "cssclasses")])


@query(
    "linked_in_order",
    f"with {_N}, files as (select distinct 'files/' || source_file as path from notes where source_file is not null) select note_id, 'files/' || source_file as path, 0 as place from notes where source_file is not null and contains(source_file, ' ') = false and regexp_matches(source_file, '^[^%+\\]|#]+$')",
)
def linked_in_order(s, d):
    rows = _notes(s, d).filter("source_file is not null")
    files = rows.select(F.concat(F.lit("files/"), "source_file").alias("path")).distinct()
    body = F.concat(F.lit("![["), "source_file", F.lit("]]\n[again](<"), "source_file", F.lit(">)\n![[files/"), "source_file", F.lit("]]"))
    content = rows.filter(~F.col("source_file").contains(" ") & F.col("source_file").rlike(r"^[^%+\]|#]+$")).select("note_id", F.lit("files").alias("folder"), body.alias("content"))
    return notes.linked_documents(content, files)


@query(
    "loose_files",
    f"with {_N}, f as (select distinct source_file as file, 'files/' || source_file as path from notes where source_file is not null), l as (select source_file from notes where source_file is not null and note_id % 2 = 0) select path from f where file not in (select source_file from l)",
)
def loose_files(s, d):
    rows = _notes(s, d).filter("source_file is not null")
    files = rows.select(F.concat(F.lit("files/"), "source_file").alias("path")).distinct()
    linked = rows.filter("note_id % 2 = 0").select(F.concat(F.lit("files/"), "source_file").alias("path"), F.col("source_file").alias("target"))
    return notes.loose_files(files, linked)


@query(
    "plan_from_notes",
    f"""with {_N} select note_id, case when title is null then 'failed' when not (coalesce(source_hash, '') <> '' or coalesce(classifier, '') <> '' or coalesce(source_file, '') <> '') then 'skipped' when doc_id is null then 'ocr' when note_id % 5 = 0 then 'relocate'
when coalesce(category <> 'Other', false) or coalesce(tags, []) <> ['a'] then 'rewrite' else 'rewrite' end as kind, case when title is null then 'unreadable' when not (coalesce(source_hash, '') <> '' or coalesce(classifier, '') <> '' or coalesce(source_file, '') <> '') then 'not managed' when doc_id is null then 'no text' when note_id % 5 = 0 then 'path'
when coalesce(category <> 'Other', false) then 'reclassified' when note_id % 2 = 0 then 'text style' when coalesce(tags, []) <> ['a'] then 'tags' else 'css classes' end as reason from notes""",
)
def plan_from_notes(s, d):
    style = F.when(F.col("note_id") % 2 == 0, text.text_block(F.lit("words"), "plain")).otherwise(text.text_block(F.lit("words"), "callout"))
    rows = _notes(s, d).withColumns(
        {
            "path": F.concat(F.lit("notes/"), F.col("note_id").cast("string"), F.lit(".md")), "content": F.when(F.col("title").isNotNull(), style),
            "needs_ocr": F.col("doc_id").isNull(), "wanted_category": F.lit("Other"), "wanted_tags": F.array(F.lit("a")), "cssclasses": F.array().cast("array<string>"),
        }
    )
    rows = rows.withColumn("wanted_path", F.when(F.col("note_id") % 5 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")))
    return notes.plan(rows, "callout", ["scan"]).select("note_id", "kind", "reason")


@query("dates_resolved")
def dates_resolved(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    rows = _notes(s, d).filter("doc_id is not null").join(docs, "doc_id").select("note_id", "text", F.col("source_file").alias("path"), "document_date", F.col("processed_at").cast("date").alias("created"))
    return classify.resolve_dates(spread(rows), TODAY, created="created").select("note_id", "date", "date_source")


@query("local_hosts", "select event_id, event_id % 2 = 0 as is_local from events")
def local_hosts(s, d):
    from ..streaming.model import is_local

    url = F.when(F.col("event_id") % 4 == 0, "http://localhost:11434/api").when(F.col("event_id") % 4 == 2, "http://127.0.0.1/x").otherwise("https://models.example.org/v1")
    return table(s, d, "events").select("event_id", is_local(url).alias("is_local"))


@query("selected_files", f"with {_N} select note_id from notes where source_file is not null and (lower(source_file) like '%.pdf' or lower(regexp_extract(source_file, '\\.([^.]+)$', 1)) in ('png','jpg','jpeg','tif','tiff','bmp','gif','webp','heic'))")
def selected_files(s, d):
    from ..sources.scan import keeper, parse_selectors

    return _notes(s, d).filter(F.col("source_file").isNotNull() & keeper(parse_selectors("pdfs,images"), F.col("source_file"))).select("note_id")


@query("css_drift", f"with {_N} select note_id, list_sort(list_distinct(list_concat(list_filter(coalesce(tags, []), lambda t: t is not null), ['scan', 'paper']))) as classes, not list_contains(list_filter(coalesce(tags, []), lambda t: t is not null), 'scan') or not list_contains(list_filter(coalesce(tags, []), lambda t: t is not null), 'paper') as drifted from notes")
def css_drift(s, d):
    have = F.array_compact(F.coalesce("tags", F.array().cast("array<string>")))
    ours = F.array(F.lit("scan"), F.lit("paper"))
    return _notes(s, d).select("note_id", F.array_sort(F.array_union(have, ours)).alias("classes"), (F.size(F.array_except(ours, have)) > 0).alias("drifted"))


@query("ledger_listing", "select canonical, list_sum(list_filter(map_values(counts), lambda x: x is not null))::bigint as total, len(map_keys(counts)) as spellings from (select distinct canonical, counts from tag_groups where counts is not null) where list_sum(list_filter(map_values(counts), lambda x: x is not null)) >= 3")
def ledger_listing(s, d):
    rows = table(s, d, "tag_groups").filter("counts is not null")
    pairs = F.array_sort(F.map_entries("counts"))
    once = rows.select("canonical", pairs.alias("pairs")).distinct()
    total = F.aggregate(F.filter("pairs", lambda p: p["value"].isNotNull()), F.lit(0).cast("bigint"), lambda a, p: a + p["value"])
    return once.select("canonical", total.alias("total"), F.size("pairs").cast("bigint").alias("spellings")).filter("total >= 3")


@query("seen_documents", f"with {_N} select doc_id, min(note_id) as note_id, count(*) as notes from notes where doc_id is not null group by 1")
def seen_documents(s, d):
    return vault.seen(_notes(s, d))


@query(
    "from_response",
    f"with {_N} select note_id, substr(trim(coalesce(correspondent, ''), ' '), 1, 120) as correspondent, list_transform(list_filter(list_transform(coalesce(subjects, []), lambda x: trim(x, ' ')), lambda x: x is not null and x <> '')[1:5], lambda x: substr(x, 1, 80)) as subjects, lower(trim(coalesce(context, ''), ' ')) as context, substr(trim(coalesce(document_type, ''), ' '), 1, 60) as document_type, substr(trim(coalesce(reference, ''), ' '), 1, 80) as reference, substr(trim(coalesce(amount, ''), ' '), 1, 40) as amount, substr(trim(coalesce(currency, ''), ' '), 1, 8) as currency from notes",
)
def from_response(s, d):
    known = {f.name for f in table(s, d, "document_meta").schema}
    answer = F.struct(*[F.col(n) if n in known else F.lit(None).cast("string").alias(n) for n, _ in classify.FIELDS])
    fields = classify.clipped(F.col("a"))
    return _notes(s, d).withColumn("a", answer).select("note_id", *[fields[n].alias(n) for n in ("correspondent", "subjects", "context", "document_type", "reference", "amount", "currency")])


@query("verdict_by_backend", "select upper(trim(backend, ' ')) as backend, count(*) as readings, count(*) filter (length(coalesce(text, '')) < 60) as thin, sum(pages)::bigint as pages from (select distinct on (extract_id) * from extract_results order by extract_id, loaded_at) group by 1")
def verdict_by_backend(s, d):
    rows = _extracts(s, d, "backend", "text", "pages")
    thin = F.count(F.when(F.length(F.coalesce("text", F.lit(""))) < 60, 1))
    return rows.groupBy(F.upper(F.trim("backend")).alias("backend")).agg(F.count("*").alias("readings"), thin.alias("thin"), F.sum("pages").alias("pages"))


@query("event_windows", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2")
def event_windows(s, d):
    from ..streaming.ingest import event_counts

    return event_counts(table(s, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_ingest", "select distinct sha256(text) as digest from documents where text <> ''")
def stream_ingest(s, d):
    from ..streaming.ingest import ingest_once

    return ingest_once(s, f"{d}/documents.parquet", table(s, d, "documents").schema)
