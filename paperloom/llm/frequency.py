"""Exact counts of every distinct term, by recursive radix spilling.

Every occurrence of a term is written once, to a folder named by the leading bits
of the term's hash; how many bits the first level has follows from a count of the
occurrences by hash bits made before. A partition that still holds over
``max_rows`` is split by the next bits, all of one level in one job; one that
stays too large because a single term fills it is split by the hash of the
record, and its partial counts, over disjoint records, are added up afterwards.
Every partition is then aggregated out-of-core by DuckDB inside a task: it drops
what was delivered twice, counts within the record, and adds up over records.

A hash partition that holds a hot term is written by as many tasks as it has
``max_rows``. Occurrences without a record id are one record, so only their most
per term is wanted: they are combined before any shuffle.

Defined cases: null, empty and blank terms are no terms; terms are compared
without outer blanks, in lower case; rows with one record id are one record and
their terms count once per record and position (a row delivered again adds
nothing); all rows without a record id are one record; an empty table has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

#: Bits of the hash by which an oversized partition is split, and those of the first level at most.
RADIX_BITS, MOST_BITS = 6, 16
#: Rows that one DuckDB aggregation takes before its partition is split.
MAX_ROWS = 4_000_000
#: Bits of a hash that can tell terms or records apart.
HASH_BITS = 60
_BLANKS = " \t\n\r\x0b\x0c\xa0"


def clean_term(term: Column) -> Column:
    return F.lower(F.btrim(term, F.lit(_BLANKS)))


def occurrences(df: DataFrame, record: str, terms: str) -> DataFrame:
    """``(term, record, row, pos, h, rh)``: each term at each place of each row."""
    one = df.select(F.col(record).alias("record"), F.col(terms).alias("terms"))
    each = one.select("record", F.xxhash64("terms").alias("row"), F.posexplode("terms").alias("pos", "raw"))
    cleaned = each.select(clean_term(F.col("raw")).alias("term"), "record", "row", "pos").filter(F.length("term") > 0)
    return cleaned.withColumns({"h": F.xxhash64("term"), "rh": F.xxhash64("record", F.lit(7))})


def _top(by: str, bits: int) -> Column:
    """The first ``bits`` bits of a 64-bit hash."""
    return F.shiftrightunsigned(F.col(by), 64 - bits)


def _by_size(part: Column, sizes: dict[int, int], max_rows: int) -> Column:
    """How many tasks write a partition: one for each ``max_rows``. Only the larger are named."""
    large = {p: -(-n // max_rows) for p, n in sizes.items() if n > max_rows}
    if not large:
        return F.lit(1)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p, n in large.items() for x in (p, n)]), part), F.lit(1))


def _write(rows: DataFrame, part: Column, sizes: dict[int, int], path: str, max_rows: int) -> dict[int, str]:
    """One folder for each partition; returns them."""
    split = rows.withColumn("part", part)
    tasks = sum(-(-n // max_rows) for n in sizes.values())
    tasks = max(1, min(tasks, 8 * rows.sparkSession.sparkContext.defaultParallelism))
    salt = F.pmod(F.xxhash64("rh", "row", "pos"), _by_size(F.col("part"), sizes, max_rows))
    split.repartition(tasks, "part", salt).write.partitionBy("part").parquet(path)
    return {p: f"{path}/part={p}" for p in sizes}


def spill(rows: DataFrame, max_rows: int = MAX_ROWS) -> list[str]:
    """Write the occurrences as partitions of at most ``max_rows`` rows where hashes can tell them apart.

    Returns the folders. The driver sees folder names and row counts only, of
    which there are at most total / max_rows * 64.
    """
    spark = rows.sparkSession
    base = scratch(spark, "radix")
    count = lambda df, part: {r["part"]: r["n"] for r in df.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    coarse = count(rows, _top("h", RADIX_BITS))
    total = sum(coarse.values())
    bits = min(MOST_BITS, max(RADIX_BITS, math.ceil(math.log2(max(total / max_rows, 1)))))
    sizes = coarse if bits == RADIX_BITS else count(rows, _top("h", bits))
    folders = _write(rows, _top("h", bits), sizes, f"{base}/h{bits}", max_rows)
    done: list[str] = []
    todo = [(folders, sizes, "h", bits)]
    while todo:
        folders, sizes, by, bits = todo.pop()
        large = {p for p, n in sizes.items() if n > max_rows}
        done += [folders[p] for p in sizes if p not in large]
        if not large:
            continue
        if by == "rh" and bits >= HASH_BITS:
            done += [folders[p] for p in large]  # one record's occurrences of one term; DuckDB spills
            continue
        again = reduce(DataFrame.union, [spark.read.schema(rows.schema).parquet(folders[p]).withColumn("parent", F.lit(p)) for p in sorted(large)])
        if by == "h":
            spread = again.groupBy("parent").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).collect()
            one = {r["parent"] for r in spread if r["lo"] == r["hi"]} | (large if bits >= HASH_BITS else set())
            kinds = [(large - one, "h", bits + RADIX_BITS), (one, "rh", RADIX_BITS)]
        else:
            kinds = [(large, "rh", bits + RADIX_BITS)]
        for parents, key, depth in kinds:
            if not parents:
                continue
            some = again.filter(F.col("parent").isin(*parents)).withColumn("new", F.xxhash64("parent", _top(key, depth))).drop("parent")
            sizes_ = count(some, F.col("new"))
            folders_ = _write(some.select(*rows.columns, "new"), F.col("new"), sizes_, f"{base}/{key}{depth}-{len(done)}-{len(todo)}", max_rows)
            todo.append((folders_, sizes_, key, depth))
    return done


_COUNT = """
with once as (select distinct term, record, "row", pos from rows),
     per_row as (select term, record, "row", count(*) as n from once group by term, record, "row"),
     per_record as (select term, record, max(n) as n from per_row group by term, record)
select term, sum(n)::bigint as occurrences, count(*) as records from per_record group by term
"""


def _aggregate(spark: SparkSession, folders: list[str], memory: str = "256MB") -> DataFrame:
    """Each folder aggregated by DuckDB, out of core, in a task of its own.

    DuckDB spills below the shared folder; where that is not a file system it
    can write to, it is given more memory instead of a place of its own.
    """
    temp = scratch(spark, "duckdb")
    local = "://" not in temp or temp.startswith("file://")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import duckdb
        import pyarrow.dataset as ds
        from pyarrow import fs

        for pdf in batches:
            for folder in pdf["folder"]:
                files, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
                rows = ds.dataset(path, filesystem=files, format="parquet")  # noqa: F841  DuckDB finds it by name
                con = duckdb.connect(config={"threads": 1} | ({"memory_limit": memory, "temp_directory": temp.removeprefix("file://")} if local else {}))
                yield con.execute(_COUNT).df()
                con.close()

    if not folders:
        return spark.createDataFrame([], "term string, occurrences bigint, records bigint")
    work = spark.createDataFrame([(f,) for f in sorted(folders)], "folder string")
    tasks = min(len(folders), 4 * spark.sparkContext.defaultParallelism)
    return work.repartition(tasks).mapInPandas(run, "term string, occurrences bigint, records bigint")


def _without_record(df: DataFrame, record: str, terms: str) -> DataFrame:
    """``(term, occurrences, records)`` of the rows without a record id, which are one record."""
    rows = df.filter(F.col(record).isNull()).select(F.array_sort(F.filter(F.transform(terms, clean_term), lambda t: F.length(t) > 0)).alias("t"))
    # In the sorted terms of a row a term stands from its first place to its last.
    size = F.size("t")
    counted = rows.select(F.explode(F.array_distinct("t")).alias("term"), "t").select(
        "term", (size - F.array_position(F.reverse("t"), F.col("term")) + 1 - F.array_position("t", F.col("term")) + 1).cast("bigint").alias("n")
    )
    return counted.groupBy("term").agg(F.max("n").alias("occurrences")).withColumn("records", F.lit(1).cast("bigint"))


def term_frequencies(df: DataFrame, record: str = "note_id", terms: str = "tags", max_rows: int = MAX_ROWS) -> DataFrame:
    """``(term, occurrences, records)`` for every distinct term."""
    folders = spill(occurrences(df.filter(F.col(record).isNotNull()), record, terms), max_rows)
    return (
        _aggregate(df.sparkSession, folders)
        .unionByName(_without_record(df, record, terms))
        .groupBy("term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    )


def mark_terms(df: DataFrame, record: str = "note_id", terms: str = "tags", least: int = 3, share: int = 8, max_rows: int = MAX_ROWS) -> DataFrame:
    """Frequencies with ``mark``: ``rare`` below ``least`` records, ``common`` above one ``share``-th of all."""
    total = df.agg(F.countDistinct(F.struct(record))).first()[0]
    return term_frequencies(df, record, terms, max_rows).withColumn(
        "mark",
        F.when(F.col("records") < least, "rare").when(F.col("records") * share > total, "common"),
    )


def beside_ledger(frequencies: DataFrame, groups: DataFrame) -> DataFrame:
    """Counts beside those an older ledger holds for the same spelling.

    The ledger's spellings are cleaned like the terms; of a group that was
    written twice the newest counts, and null counts are no counts.
    """
    newest = groups.groupBy("canonical").agg(F.max_by("counts", F.struct(F.col("updated_at").isNotNull(), F.col("updated_at"))).alias("counts"))
    old = (
        newest.select("canonical", F.explode("counts").alias("spelling", "n"))
        .select(clean_term(F.col("spelling")).alias("term"), "n", "canonical")
        .groupBy("term")
        .agg(F.sum("n").alias("ledger_count"), F.min("canonical").alias("canonical"))
    )
    return frequencies.join(old, "term", "full").select(
        "term",
        "canonical",
        F.coalesce("occurrences", F.lit(0)).alias("occurrences"),
        F.coalesce("records", F.lit(0)).alias("records"),
        "ledger_count",
        "mark",
    )
