"""Queries of the training-text operators; see each operator's module."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import canonical, frequency, language, names, packing, personal, quality, scanned, spans, tokenize


def _p4(spark, sf):
    return quality.text_kinds(table(spark, sf, "extract_results"))


def _p1(spark, sf):
    return language.vault_passages(table(spark, sf, "documents"), table(spark, sf, "document_meta"))


def _secret(spark) -> str:
    """The key of the surrogates: the session's, else one for tests."""
    return spark.conf.get("paperloom.surrogates.key", "a key for tests")


def _p6(spark, sf):
    return personal.vault_pseudonyms(table(spark, sf, "extract_results"), table(spark, sf, "document_meta"), _secret(spark))


def _p6_texts(spark, sf):
    notes = table(spark, sf, "document_meta")
    return personal.vault_texts(table(spark, sf, "extract_results"), notes), personal.learn_given(notes)


def _p3(spark, sf):
    return scanned.vault_texts(table(spark, sf, "documents"), table(spark, sf, "extract_results"))


def _p7(spark, sf):
    return frequency.mark_terms(table(spark, sf, "document_meta"))


def queries() -> dict:
    return {
        "p2_found": lambda s, d: canonical.map_rows(table(s, d, "document_meta"), table(s, d, "category_list")),
        "p2_misses": lambda s, d: canonical.misses(table(s, d, "document_meta"), table(s, d, "category_list")),
        "p5_found": lambda s, d: names.name_pairs(table(s, d, "document_meta")),
        "p5_senders": lambda s, d: names.sender_index(table(s, d, "document_meta")),
        "p7_found": lambda s, d: _p7(s, d).filter("mark is not null").select(F.col("term").alias("tag"), "mark"),
        "p7_frequencies": lambda s, d: _p7(s, d).select(F.col("term").alias("tag"), "occurrences", F.col("records").alias("notes"), "mark"),
        "p7_ledger": lambda s, d: frequency.beside_ledger(_p7(s, d), table(s, d, "tag_groups")).withColumnRenamed("term", "tag").withColumnRenamed("records", "notes"),
        "p3_found": lambda s, d: scanned.findings(_p3(s, d)).distinct(),
        "p3_repaired": lambda s, d: scanned.repair(_p3(s, d)),
        "p6_found": lambda s, d: _p6(s, d).select("src", "row_id", "kind", "value").distinct(),
        "p6_placeholders": lambda s, d: personal.placeholders(*_p6_texts(s, d)),
        "p6_surrogates": lambda s, d: personal.pseudonymise(*_p6_texts(s, d), _secret(s)),
        "p6_entities": lambda s, d: _p6(s, d).groupBy("kind", "value", "surrogate").agg(F.count("*").alias("n")),
        "p1_found": lambda s, d: language.unnamed(_p1(s, d)),
        "p1_languages": lambda s, d: language.main_language(_p1(s, d)),
        "p4_found": lambda s, d: _p4(s, d).filter("kind in ('list', 'table', 'junk')").select("extract_id", "kind").distinct(),
        "p4_statistics": _p4,
        "p4_recorded": lambda s, d: quality.beside_recorded(_p4(s, d), table(s, d, "text_quality")),
        "p8_ids": lambda s, d: tokenize.encode_corpus(table(s, d, "documents")),
        "p8_round_trip": lambda s, d: tokenize.round_trip(table(s, d, "documents")),
        "p10_found": lambda s, d: spans.sharing_pairs(table(s, d, "documents")),
        "p10_shared": lambda s, d: spans.shared_share(table(s, d, "documents")),
        "p9_containers": lambda s, d: packing.pack_documents(table(s, d, "documents")),
    }


_TAGS = """
notes as (select distinct note_id, tags from document_meta),
cleaned as (
  select note_id, lower(regexp_replace(t, '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g')) as tag
  from (select note_id, unnest(tags) as t from notes)),
counted as (select tag, count(*) as occurrences, count(distinct note_id) as notes from cleaned where tag <> '' group by tag),
marked as (
  select *, case when notes < 3 then 'rare' when notes * 8 > (select count(distinct note_id) from document_meta) then 'common' end as mark
  from counted)
"""

_P_SQL = {
    "p7_found": f"with {_TAGS} select tag, mark from marked where mark is not null",
    "p7_frequencies": f"with {_TAGS} select tag, occurrences, notes, mark from marked",
    "p7_ledger": f"""with {_TAGS},
newest as (select canonical, arg_max(counts, coalesce(updated_at, timestamp '1970-01-01')) as counts from tag_groups group by canonical),
spelled as (select canonical, unnest(map_entries(counts)) as e from newest),
old as (select lower(regexp_replace(e.key, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')) as tag, sum(e.value)::bigint as ledger_count, min(canonical) as canonical
  from spelled group by 1)
select coalesce(m.tag, o.tag) as tag, canonical, coalesce(occurrences, 0) as occurrences, coalesce(notes, 0) as notes, ledger_count, mark
from marked m full join old o on m.tag = o.tag""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_P_SQL)
