"""Long exact spans shared between documents, by recompression.

A text is rewritten in rounds. A round first names every short run of one symbol,
then every pair whose left symbol lies in one half of the alphabet and whose right
symbol in the other; the halves are drawn anew each round from the symbols'
names. A name is a 64-bit hash of what it stands for, so all tasks of the
cluster give equal content the same name without exchanging dictionaries. In
round k only symbols of at most ``SIZES[k]`` characters take part. Whether two
symbols are joined depends on these two only, so inside a repeated span all symbols
but a few at its ends are the same wherever it stands.

How few is proved: what stands beside the span can change, in a round of size n,
the run and the symbol at its end, of n characters at most each. All rounds
together lose ``LOST`` characters at either end. The runs of symbols that cover
``cover`` characters are named in turn, and of all that start within ``WINDOW``
characters the one of least name is exchanged; a symbol has ``GROWN`` characters at
most. As ``2 LOST + WINDOW + cover + GROWN - 2`` is the least length of a span, every
span of that length has an exchanged run in common.

Names that occur in several documents reveal the repeats and verify them: runs of
one alignment that overlap are one equal stretch. A stretch that may yet be longer
than its runs show is compared character by character, for which a window around
it travels, not the text.

Only one of several identical texts takes part; the others follow their class.
Defined cases: null, empty and short texts share nothing; identical texts of at
least ``least`` characters share all of it; a repeated row (same id and text)
counts once; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, spread

#: A span is long from this many characters.
LEAST = 300
#: Characters that a symbol which takes part has at most, round by round.
SIZES = (1, 1, 1, 2, 2, 3, 3, 4, 4)
#: Characters of a symbol at most; those at either end of a span that its neighbours can change.
GROWN = 2 * max(SIZES)
LOST = sum(SIZES) + sum(n for n in SIZES if n > 1)
#: Of the runs that start within so many characters at least one is exchanged (the one of least name).
WINDOW = 96
#: Texts parsed at once; keeps the arrays near the processor.
CHUNK_CHARS = 1_000_000

_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def cover_of(least: int) -> int:
    """Characters that the named runs cover at least, so that none of the spans is missed."""
    cover = least - 2 * LOST - WINDOW - GROWN + 2
    if cover < 64:
        raise ValueError(f"spans of under {least - cover + 64} characters need smaller symbols")
    return cover


def _name(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads 64 bits evenly."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def recompress(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, lengths in characters and text numbers of the high-level symbols."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    name = _name(code_points(texts).astype(_U) + _U(1))
    size = np.ones(len(name), dtype=np.int32)
    for turn, most in enumerate(SIZES):
        if len(name) < 2:
            break
        if most > 1:
            same = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1]) & (size[1:] <= most)
            if same.any():
                start = np.flatnonzero(np.concatenate(([True], ~same)))
                n = np.diff(np.append(start, len(name))).astype(np.int32)
                # Longer runs stay as they are, so what lies beyond a span changes little of them.
                short = (n > 1) & (n * size[start] <= most)
                keep = np.ones(len(name), dtype=bool)
                keep[1:][same & np.repeat(short, n)[1:]] = False
                head = start[short]
                name[head] = _name(name[head] * _K + n[short].astype(_U))
                size[head] *= n[short]
                name, size, doc = name[keep], size[keep], doc[keep]
        grows = size <= most
        draw = _U(((2 * turn + 1) * 0xD6E8FEB86659FD93) % (1 << 64))
        left = (_name(name + draw) & _U(1)).astype(bool)
        at = np.flatnonzero(left[:-1] & ~left[1:] & grows[:-1] & grows[1:] & (doc[:-1] == doc[1:]))
        if not len(at):
            continue
        name[at] = _name((name[at] * _K) ^ (name[at + 1] + _U(0x7F4A7C15)))
        size[at] += size[at + 1]
        keep = np.ones(len(name), dtype=bool)
        keep[at + 1] = False
        name, size, doc = name[keep], size[keep], doc[keep]
    return name, size, doc


def _least_in_window(run: np.ndarray, until: np.ndarray) -> np.ndarray:
    """For each place i that of the least of ``run[i:until[i]]``, the first of equals."""
    n = len(run)
    width = until - np.arange(n)
    best = np.arange(n)
    found = best.copy()
    step = 1
    while True:
        # ``best`` is the least of ``step`` places from i; two of them make up a window.
        here = np.flatnonzero((width >= step) & (width < 2 * step))
        a, b = best[here], best[np.maximum(until[here] - step, 0)]
        found[here] = np.where(run[b] < run[a], b, a)
        if 2 * step > width.max(initial=0):
            return found
        further = best[np.minimum(np.arange(n) + step, n - 1)]
        best = np.where(run[further] < run[best], further, best)
        step *= 2


def run_names(texts: list[str], cover: int, inner: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(name, text number, position, length)`` of the exchanged runs of symbols.

    Of a stretch of equal names (a long run) the first and the last will do,
    unless all are asked for: whatever lies within is found from these.
    """
    none = np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if not texts:
        return none
    name, size, doc = recompress(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    end = np.cumsum(size, dtype=np.int64)
    start = end - size
    first = np.flatnonzero(start + cover <= ends[doc])
    if not len(first):
        return none
    last = np.searchsorted(end, start[first] + cover, side="left")
    power = np.cumprod(np.full(len(name), _BASE, dtype=_U))
    inverse = np.cumprod(np.full(len(name), _BASE_INVERSE, dtype=_U))
    prefix = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(name * power, dtype=_U)))
    run = _name((prefix[last + 1] - prefix[first]) * inverse[first])
    which, begin, length = doc[first], start[first], end[last] - start[first]
    # The windows of a text end where it does: runs are in the order of texts.
    until = np.minimum(np.searchsorted(begin, begin + WINDOW, side="left"), np.searchsorted(which, which, side="right"))
    chosen = np.unique(_least_in_window(run, until))
    run, which, length = run[chosen], which[chosen], length[chosen]
    at = begin[chosen] - (ends[which] - sizes[which])
    if len(run) > 2 and not inner:
        same = (run[1:] == run[:-1]) & (which[1:] == which[:-1])
        drop = np.zeros(len(run), dtype=bool)
        drop[1:-1] = same[1:] & same[:-1]
        run, which, at, length = run[~drop], which[~drop], at[~drop], length[~drop]
    return run, which, at, length


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > CHUNK_CHARS:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _classes(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """``(doc, rep)``: each long enough document and the least id with its text."""
    hashed = docs.filter(F.length(text) >= least).select(F.col(key).alias("doc"), F.sha2(F.col(text), 256).alias("digest"))
    first = hashed.groupBy("digest").agg(F.min("doc").alias("rep"))
    return materialize(hashed.join(first, "digest").select("doc", "rep").distinct(), "classes")


#: Document ids that are broadcast at most; more are joined with a shuffle.
BROADCAST_IDS = 2_000_000


def _ids(docs: DataFrame) -> DataFrame:
    """Ids of documents, written, and broadcast if few enough: so the texts beside them stay where they are."""
    ids = materialize(docs.distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _texts(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    return docs.filter(F.length(text) >= least).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))


def _shared_runs(texts: DataFrame, cover: int, inner: bool = False) -> DataFrame:
    """``(name, doc, at, length)`` of the exchanged runs that stand in several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            words = batch.column(1).to_pylist()
            for i, j in _chunks([len(w) for w in words]):
                name, which, at, length = run_names(words[i:j], cover, inner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(docs[i + which]), pa.array(at.astype(np.int32)), pa.array(length.astype(np.int32))],
                    ["name", "doc", "at", "length"],
                )

    runs = materialize(spread(texts).mapInArrow(run, "name bigint, doc bigint, at int, length int"), "runs")
    # Counted by a combined aggregate, not a window, so that a name a third of all texts hold fills no task.
    several = runs.groupBy("name").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least <> most").select("name")
    return materialize(runs.join(several, "name"), "shared")


#: Appends a run to the equal stretches found so far if it does not overlap the last, else lengthens that.
_STRETCHES = """
aggregate(array_sort(collect_list(struct(at, at + length as stop))), cast(array() as array<struct<at:int,stop:int>>), (s, x) ->
  if(size(s) > 0 and element_at(s, -1).stop >= x.at,
     concat(slice(s, 1, size(s) - 1), array(struct(element_at(s, -1).at as at, greatest(element_at(s, -1).stop, x.stop) as stop))),
     concat(s, array(x))))
"""


def _stretches(shared: DataFrame) -> DataFrame:
    """``(doc_a, doc_b, shift, stretches)``: what two texts have in common at an alignment, as far as runs show."""
    a = shared.select("name", F.col("doc").alias("doc_a"), "at", "length")
    b = shared.select("name", F.col("doc").alias("doc_b"), F.col("at").alias("at_b"))
    return (
        a.join(b, "name")
        .filter("doc_a < doc_b")
        .groupBy("doc_a", "doc_b", (F.col("at") - F.col("at_b")).alias("shift"))
        .agg(F.expr(_STRETCHES).alias("stretches"))
    )


def _long_enough(open_: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """``(doc_a, doc_b)`` of ``(doc_a, doc_b, shift, at, stop)`` that prove ``least`` characters long when compared."""
    window = lambda start, stop: F.substring("text", F.greatest(F.lit(0), start - least) + 1, stop - F.greatest(F.lit(0), start - least) + least)
    with_a = open_.join(texts.withColumnRenamed("doc", "doc_a"), "doc_a").select(
        "doc_a", "doc_b", "shift", "at", "stop", window(F.col("at"), F.col("stop")).alias("a"), F.least("at", F.lit(least)).alias("from_a")
    )
    at_b, stop_b = F.col("at") - F.col("shift"), F.col("stop") - F.col("shift")
    both = with_a.join(texts.withColumnRenamed("doc", "doc_b"), "doc_b").select(
        "doc_a", "doc_b", "a", window(at_b, stop_b).alias("b"), "from_a", F.least(at_b, F.lit(least)).alias("from_b"), (F.col("stop") - F.col("at")).alias("n")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, a, b, from_a, from_b, n = (batch.column(i).to_pylist() for i in range(7))
            keep = [reach(*x) >= least for x in zip(a, b, from_a, from_b, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["doc_a", "doc_b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(compare, "doc_a bigint, doc_b bigint").distinct()


def reach(a: str, b: str, from_a: int, from_b: int, n: int) -> int:
    """Length of the equal stretch of two windows around ``n`` characters known to be equal."""
    left = min(from_a, from_b)
    x, y = code_points([a[from_a - left : from_a]]), code_points([b[from_b - left : from_b]])
    unequal = np.flatnonzero(x != y)
    before = left - 1 - unequal[-1] if len(unequal) else left
    x, y = code_points([a[from_a + n :]]), code_points([b[from_b + n :]])
    right = min(len(x), len(y))
    unequal = np.flatnonzero(x[:right] != y[:right])
    return int(before + n + (unequal[0] if len(unequal) else right))


def sharing_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``(doc_a, doc_b)``: all pairs with at least one shared span, copies expanded."""
    cover = cover_of(least)
    classes = _classes(docs, key, text, least)
    texts = _texts(docs, key, text, least)
    single = texts.join(_ids(classes.filter("doc <> rep").select("doc")), "doc", "left_anti")
    found = materialize(_stretches(_shared_runs(single, cover)), "stretches")
    sure = found.filter(F.exists("stretches", lambda x: x["stop"] - x["at"] >= least)).select("doc_a", "doc_b").distinct()
    open_ = found.join(sure, ["doc_a", "doc_b"], "left_anti").select("doc_a", "doc_b", "shift", F.explode("stretches").alias("x")).select("doc_a", "doc_b", "shift", "x.*")
    open_ = materialize(open_, "open")
    involved = _ids(open_.select(F.col("doc_a").alias("doc")).union(open_.select(F.col("doc_b").alias("doc"))))
    needed = materialize(texts.join(involved, "doc", "left_semi").dropDuplicates(["doc"]), "texts")
    spans = sure.union(_long_enough(open_, needed, least))
    across = (
        spans.select(F.col("doc_a").alias("rep_a"), F.col("doc_b").alias("rep_b"))
        .join(classes.select(F.col("rep").alias("rep_a"), F.col("doc").alias("a")), "rep_a")
        .join(classes.select(F.col("rep").alias("rep_b"), F.col("doc").alias("b")), "rep_b")
        .select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))
    )
    many = classes.groupBy("rep").count().filter("count > 1").select("rep")
    several = classes.join(many, "rep")
    within = (
        several.select("rep", F.col("doc").alias("doc_a"))
        .join(several.select("rep", F.col("doc").alias("doc_b")), "rep")
        .filter("doc_a < doc_b")
        .select("doc_a", "doc_b")
    )
    return across.union(within)


def window_hashes(text: str, runs: list[tuple[int, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """``(start, hash)`` of the stretches of ``least`` characters that hold one of the runs ``(at, length)``."""
    points = _name(code_points([text]).astype(_U) + _U(1))
    n = len(points) - least + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    marks = np.zeros(n + 1, dtype=np.int64)
    at, length = np.array(runs, dtype=np.int64).T
    np.add.at(marks, np.clip(at + length - least, 0, n), 1)
    np.add.at(marks, np.clip(at + 1, 0, n), -1)
    start = np.flatnonzero(np.cumsum(marks[:n]) > 0)
    power = np.cumprod(np.full(len(points), _BASE, dtype=_U))
    inverse = np.cumprod(np.full(len(points), _BASE_INVERSE, dtype=_U))
    prefix = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(points * power, dtype=_U)))
    return start, _name((prefix[start + least] - prefix[start]) * inverse[start])


def shared_share(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """For each document how many characters stand elsewhere too, and their share.

    No pairs are made: every stretch of ``least`` characters around a shared run
    is hashed, and those hashes that several texts have cover what is shared.
    """
    classes = _classes(docs, key, text, least)
    single = _texts(docs, key, text, least).join(_ids(classes.filter("doc <> rep").select("doc")), "doc", "left_anti")
    runs = _shared_runs(single, cover_of(least), inner=True).groupBy("doc").agg(F.collect_list(F.struct("at", "length")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, t, rs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                start, value = window_hashes(t, [(r["at"], r["length"]) for r in rs], least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(start), doc, np.int64)), pa.array(start), pa.array(value.view(np.int64))], ["rep", "start", "hash"]
                )

    runs = materialize(runs, "places")
    few = runs.count() <= BROADCAST_IDS
    some = single.join(_ids(runs.select("doc")), "doc", "left_semi").dropDuplicates(["doc"]) if few else single.dropDuplicates(["doc"])
    hashed = materialize(some.join(runs, "doc").select("doc", "text", "runs").mapInArrow(run, "rep bigint, start bigint, hash bigint"), "windows")
    several = hashed.groupBy("hash").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least <> most").select("hash")
    starts = hashed.join(several, "hash").select("rep", "start")
    # Stretches that overlap count their own part up to the next one's start.
    after = F.lead("start").over(Window.partitionBy("rep").orderBy("start"))
    union = starts.withColumn("own", F.least(F.lit(least), F.coalesce(after - F.col("start"), F.lit(least)))).groupBy("rep").agg(F.sum("own").alias("covered"))
    sizes = classes.groupBy("rep").agg(F.count("*").alias("copies"))
    per_doc = classes.join(sizes, "rep").join(union, "rep", "left").select(F.col("doc").alias(key), "copies", "covered")
    lengths = docs.groupBy(key).agg(F.max(F.length(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("chars"))
    shared = F.when(F.col("copies") > 1, F.col("chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return lengths.join(per_doc, key, "left").select(
        key,
        "chars",
        shared.cast("long").alias("shared_chars"),
        F.when(F.col("chars") > 0, F.round(shared / F.col("chars"), 6)).otherwise(F.lit(0.0)).alias("share"),
    )
