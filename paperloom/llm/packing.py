"""Filling containers of fixed capacity from a histogram of item lengths.

The plan is made over counts, not items: the histogram has at most
``capacity`` entries, so what reaches the driver is bounded by the capacity
whatever the corpus. Each step of the plan opens containers for the longest
length left, adds the longest length that still fits (best fit) until nothing
does, and repeats that pattern as often as the counts allow; each step uses up
at least one length, so the plan is bounded too. Items then take their slots by
their rank within their length.

Defined cases: an item longer than the capacity is cut into full containers and
one remainder, which is packed like any other item; an item without size (null
or empty text) takes no room and is spread over the containers in turn; an empty
table has an empty result; a repeated row is an item like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .tokenize import count_tokens

#: Items of one length numbered in one task, about. A length is cut into as many
#: sub-ranges as it would need if all items had it, so that one held by a third of
#: them is spread over tasks at any size.
PER_TASK = 1_000_000


def plan_histogram(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots for ``counts[length]`` items of each length.

    Returns rows ``(length, rank_from, rank_to, first_container, per_container)``:
    the item of that length and rank r goes to container
    ``first_container + (r - rank_from) // per_container``; and the number of
    containers.
    """
    left = {k: v for k, v in counts.items() if k > 0 and v > 0}
    used = dict.fromkeys(left, 0)
    present = np.zeros(capacity + 1, dtype=bool)
    present[list(left)] = True
    rows, container = [], 0
    longest = capacity
    while left:
        while not present[longest]:
            longest -= 1
        pattern: dict[int, int] = {}
        room = capacity
        while room > 0:
            fits = np.flatnonzero(present[1 : room + 1])
            length = 0
            for k in fits[::-1]:
                if left[k + 1] - pattern.get(k + 1, 0) > 0:
                    length = int(k) + 1
                    break
            if not length:
                break
            times = min(room // length, left[length] - pattern.get(length, 0))
            if not pattern:
                times = 1
            pattern[length] = pattern.get(length, 0) + times
            room -= times * length
        repeats = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            rows.append((k, used[k], used[k] + n * repeats, container, n))
            used[k] += n * repeats
            left[k] -= n * repeats
            if not left[k]:
                del left[k]
                present[k] = False
        container += repeats
    return rows, container


def pack(sizes: DataFrame, capacity: int = 2048, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``(key, piece, start, length, container)`` for every item of ``sizes``.

    ``sizes`` should be cheap to read twice (a written table): it is read for
    the histogram and again for the assignment.
    """
    items = sizes.select(F.col(key).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    cap = F.lit(capacity).cast("long")
    pieces = items.withColumn("full", F.floor(F.col("size") / cap)).select(
        "item",
        F.explode(
            F.when(
                F.col("size") > cap,
                F.transform(
                    F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / cap)),
                    lambda i: F.struct(i.alias("piece"), (i * cap).alias("start"), F.least(cap, F.col("size") - i * cap).alias("length")),
                ),
            ).otherwise(
                F.array(F.struct(F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.col("size").alias("length")))
            )
        ).alias("p"),
    ).select("item", "p.*")
    salts = max(8, -(-sizes.count() // PER_TASK))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("item", "piece"), F.lit(salts)).cast("int"))
    # At most a row for each length and salt; the driver sees a row a length.
    cells = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "cells")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    per_length = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, containers = plan_histogram(per_length, capacity)
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("item", "piece")).cast("long") - 1
    # The window has placed the rows by length and salt, so the merge moves only the offsets.
    ranked = salted.withColumn("rank", rank).join(offsets.hint("merge"), ["length", "salt"])
    return _take_slots(ranked.withColumn("rank", F.col("rank") + F.col("offset")), slots, containers).select(
        F.col("item").alias(key), "piece", "start", "length", "container"
    )


def _take_slots(ranked: DataFrame, slots, containers: int) -> DataFrame:
    """Join on rank within length; the plan is bounded by the capacity, so it rides along."""
    slots = sorted(slots)
    plan = {
        k: np.array([s[i] for s in slots], dtype=np.int64) for i, k in enumerate(("length", "lo", "hi", "first", "per"))
    }
    starts = plan["length"] * (1 << 44) + plan["lo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length = get["length"].to_numpy(zero_copy_only=False)
            rank = get["rank"].to_numpy(zero_copy_only=False)
            where = np.searchsorted(starts, length * (1 << 44) + rank, side="right") - 1
            if len(starts):
                at = np.clip(where, 0, None)
                container = plan["first"][at] + (rank - plan["lo"][at]) // plan["per"][at]
            else:
                container = np.zeros(len(rank), dtype=np.int64)
            empty = length == 0
            container[empty] = rank[empty] % max(containers, 1)
            yield pa.RecordBatch.from_arrays(
                [get["item"], get["piece"], get["start"], get["length"], pa.array(container)],
                ["item", "piece", "start", "length", "container"],
            )

    kind = ranked.schema["item"].dataType.simpleString()
    return ranked.select("item", "piece", "start", "length", "rank").mapInArrow(
        run, f"item {kind}, piece bigint, start bigint, length bigint, container bigint"
    )


def pack_documents(docs: DataFrame, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Measure in tokens of the public tokenizer, then pack."""
    return pack(materialize(count_tokens(docs, key, text), "sizes"), capacity, key)


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, fullest container and the share of room used."""
    per = packed.groupBy("container").agg(F.sum("length").alias("used"))
    return per.agg(
        F.count("*").alias("containers"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("fill"),
    )
