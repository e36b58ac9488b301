"""A tag vocabulary: census, election of a spelling, and folding of near spellings."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folding import fold
from ..functions.text import digits_of, fingerprint, slugify
from ..session import materialize

CUTOFF = 0.88


def census(df: DataFrame, tags: str = "tags") -> DataFrame:
    """``(fp, tag, n)``: each spelling and how often it is used."""
    slugs = df.select(F.explode(tags).alias("raw")).select(slugify(F.ltrim("raw", F.lit("#")), 40).alias("tag"))
    return slugs.filter("tag <> ''").groupBy("tag").agg(F.count("*").alias("n")).select(fingerprint(F.col("tag")).alias("fp"), "tag", "n")


def elect(counts: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """``(fp, canonical, total, spellings)``: the protected spelling, else the most used, shortest, first."""
    best = counts.groupBy("fp").agg(
        F.min_by("tag", F.struct(-F.col("n"), F.length("tag"), "tag")).alias("elected"), F.sum("n").alias("total"), F.count("*").alias("spellings")
    )
    if protected is None:
        return best.withColumnRenamed("elected", "canonical").select("fp", "canonical", "total", "spellings")
    kept = protected.select(slugify(F.col("tag"), 40).alias("kept")).filter("kept <> ''")
    kept = kept.select(fingerprint(F.col("kept")).alias("fp"), "kept").groupBy("fp").agg(F.max("kept").alias("kept"))
    return best.join(kept, "fp", "left").select("fp", F.coalesce("kept", "elected").alias("canonical"), "total", "spellings")


def duplicates(counts: DataFrame) -> DataFrame:
    return elect(counts).filter("spellings > 1").select("canonical", "total", "spellings")


def _ratio(pairs: DataFrame) -> DataFrame:
    """Adds ``ratio`` of the folded left and right spelling, in this order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(ratio=[SequenceMatcher(None, fold(a), fold(b)).ratio() for a, b in zip(pdf["left"], pdf["right"])])

    return pairs.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", ratio double")


def alike(groups: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Pairs of canonical spellings with equal figures and a ratio above ``cutoff``.

    A ratio above the cutoff bounds the length ratio, and strings of n and m
    letters that alike share a run of letters; pairs are therefore sought among
    spellings with equal figures and a common pair of neighbouring letters that
    is among the rarest of either, never among all.
    """
    base = groups.select("canonical", "total", digits_of(F.col("canonical")).alias("digits"), F.length("canonical").alias("len"))
    # Spellings this alike differ in at most (1 - cutoff) of their letters, so of
    # any (edits + 1) disjoint pieces one is whole in both: blocks of pieces.
    piece = base.withColumn("k", F.ceil(F.col("len") * (1 - cutoff) * 2).cast("int") + 1).withColumn(
        "piece", F.explode(F.expr("transform(sequence(1, greatest(len - 1, 1)), i -> substring(canonical, i, 2))"))
    )
    rare = Window.partitionBy("canonical").orderBy("df", "piece")
    df = piece.groupBy("piece").agg(F.countDistinct("canonical").alias("df"))
    keys = piece.distinct().join(df, "piece").withColumn("r", F.row_number().over(rare)).filter("r <= k + 2")
    a = keys.select("piece", "digits", F.col("canonical").alias("left"), F.col("total").alias("left_total"), F.col("len").alias("ll"))
    b = keys.select("piece", "digits", F.col("canonical").alias("right"), F.col("total").alias("right_total"), F.col("len").alias("rl"))
    near = (
        a.join(b, ["piece", "digits"])
        .filter("left <> right")
        .filter(2 * F.least("ll", "rl") > cutoff * (F.col("ll") + F.col("rl")))
        .select("left", "right", "left_total", "right_total")
        .distinct()
    )
    return _ratio(near).filter(F.col("ratio") > cutoff)


def consolidate(groups: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``(canonical, into)``: spellings absorbed by a bigger one alike.

    Order: protected ones first, then bigger, then by spelling; protected ones (a
    column ``protected``, if there is one) are never absorbed. A spelling is
    absorbed by the first alike one that is not itself absorbed; rounds settle who
    that is, until none is open.
    """
    kept = groups.select("canonical", F.coalesce("protected", F.lit(False)).alias("p")) if "protected" in groups.columns else groups.select("canonical", F.lit(False).alias("p"))
    near = alike(groups, cutoff)
    near = near.join(kept.select(F.col("canonical").alias("left"), F.col("p").alias("left_p")), "left").join(kept.select(F.col("canonical").alias("right"), F.col("p").alias("right_p")), "right")
    bigger = (F.col("left_total") > F.col("right_total")) | ((F.col("left_total") == F.col("right_total")) & (F.col("left") < F.col("right")))
    links = near.filter(~F.col("right_p") & (F.col("left_p") | bigger)).select("left", F.struct(~F.col("left_p"), -F.col("left_total"), "left").alias("rank"), "right")
    open_ = materialize(links, "alike")
    done = open_.select(F.col("right").alias("canonical"), F.col("left").alias("into")).limit(0)
    # The first in order is never absorbed, so every round settles some.
    while True:
        waiting = open_.select(F.col("right").alias("left")).distinct()
        free = open_.join(waiting, "left", "left_anti")
        best = materialize(free.groupBy(F.col("right").alias("canonical")).agg(F.min_by("left", "rank").alias("into")), "absorbed")
        if best.isEmpty():
            return done
        done = done.unionByName(best)
        gone = best.select(F.col("canonical").alias("right"))
        open_ = open_.join(gone, "right", "left_anti").join(gone.withColumnRenamed("right", "left"), "left", "left_anti").select("left", "rank", "right")
        open_ = materialize(open_, "open")


def canonical_map(df: DataFrame, tags: str = "tags", protected: DataFrame | None = None) -> DataFrame:
    """``(tag, canonical)`` for every spelling in use; ``protected`` has a column ``tag``."""
    counts = materialize(census(df, tags), "census")
    groups = elect(counts, protected)
    if protected is not None:
        kept = protected.select(slugify(F.col("tag"), 40).alias("canonical")).filter("canonical <> ''").distinct().withColumn("protected", F.lit(True))
        groups = groups.join(kept, "canonical", "left")
    groups = materialize(groups, "groups")
    absorbed = consolidate(groups)
    return (
        counts.join(groups.select("fp", "canonical"), "fp")
        .join(absorbed, "canonical", "left")
        .select("tag", F.coalesce("into", "canonical").alias("canonical"))
    )


def against_ledger(df: DataFrame, ledger: DataFrame, tags: str = "tags", cutoff: float = CUTOFF) -> DataFrame:
    """``(tag, canonical, how)`` of every spelling in use, beside a ledger ``(canonical, total)``.

    ``how``: ``same`` words as one of the ledger, the most ``alike`` one, or ``new``;
    new ones are put together among themselves as a census is.
    """
    counts = materialize(census(df, tags), "census")
    known = materialize(ledger.groupBy("canonical").agg(F.sum("total").alias("total")).withColumn("fp", fingerprint(F.col("canonical"))), "ledger")
    by_words = known.groupBy("fp").agg(F.min_by("canonical", F.struct(-F.col("total"), "canonical")).alias("canonical"))
    same = counts.join(by_words, "fp").select("tag", "canonical", F.lit("same").alias("how"))
    other = counts.join(by_words, "fp", "left_anti").groupBy(F.col("tag").alias("canonical")).agg(F.sum("n").alias("total"))
    both = other.withColumn("old", F.lit(False)).unionByName(known.select("canonical", "total", F.lit(True).alias("old")))
    pairs = alike(both.select("canonical", "total"), cutoff)
    near = pairs.join(known.select(F.col("canonical").alias("left")), "left", "left_semi").join(other.select(F.col("canonical").alias("right")), "right", "left_semi")
    best = near.groupBy(F.col("right").alias("tag")).agg(F.min_by("left", F.struct(-F.col("ratio"), "left")).alias("canonical")).withColumn("how", F.lit("alike"))
    best = materialize(best, "nearest")
    rest = materialize(other.join(best.select(F.col("tag").alias("canonical")), "canonical", "left_anti").withColumn("fp", fingerprint(F.col("canonical"))), "minted")
    minted = elect(rest.select("fp", F.col("canonical").alias("tag"), F.col("total").alias("n")))
    absorbed = consolidate(minted.select("canonical", "total"), cutoff)
    fresh = rest.select("fp", F.col("canonical").alias("tag")).join(minted.select("fp", "canonical"), "fp").join(absorbed, "canonical", "left")
    return same.unionByName(best.select("tag", "canonical", "how")).unionByName(fresh.select("tag", F.coalesce("into", "canonical").alias("canonical"), F.lit("new").alias("how")))


def recorded(ledger: DataFrame, written: DataFrame, tags: str = "tags") -> DataFrame:
    """The ledger ``(canonical, total)`` with the tags of notes just written counted in."""
    new = written.select(F.explode(tags).alias("canonical")).filter("canonical <> ''").groupBy("canonical").agg(F.count("*").alias("total"))
    return ledger.select("canonical", "total").unionByName(new).groupBy("canonical").agg(F.sum("total").alias("total"))


def applied(notes: DataFrame, mapping: DataFrame, key: str = "note_id", tags: str = "tags") -> DataFrame:
    """``(key, tags)``: each note's tags in the spelling of ``(tag, canonical)``, in order, each once."""
    slug = slugify(F.ltrim("raw", F.lit("#")), 40)
    each = notes.select(key, F.posexplode(tags).alias("place", "raw")).select(key, "place", slug.alias("tag")).filter("tag <> ''")
    spelled = each.join(mapping.select("tag", "canonical"), "tag", "left").select(key, "place", F.coalesce("canonical", "tag").alias("tag"))
    first = spelled.groupBy(key, "tag").agg(F.min("place").alias("place")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda x: x["tag"]).alias("tags"))
    return notes.select(key).join(first, key, "left").select(key, F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
