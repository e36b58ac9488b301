"""Statistics that tell prose from lists, tables and junk.

For each text: basic counts, and three distributions: of its characters over
classes, of its tokens over shapes (function words among them), of its lines
over layouts. Profiles of the same kind are averaged, by grouped aggregation
over all texts whose layout leaves no doubt, for the prose of each language and
for the varieties of lists, tables and junk. A text belongs to the profile of least
Jensen-Shannon divergence.

Defined cases: null, empty and blank texts have zero counts and kind null, as
have texts under ``LEAST_CHARS`` characters without outer blanks; long texts are
read whole; repeated rows give equal rows; other columns are not read; without
any undoubted text of a variety a built-in profile stands in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread
from .words import FUNCTION_WORDS, LANGUAGES

LEAST_CHARS = 40

CHAR_CLASSES = ("vowel", "consonant", "digit", "blank", "line", "stop", "delimiter", "dash", "other")
TOKEN_SHAPES = ("function", "word", "voiceless", "mixed", "number", "single")
LINE_LAYOUTS = ("item", "cells", "running", "short", "noise")

_TOKEN = re.compile(r"[^\W_]+")
_ITEM = re.compile(r"\s*(?:[-*•·–—▪◦]|\(?\d{1,3}[.)](?!\s+[^\W\d]+\.? \d{4}\b)|\(?[a-z]\)|\[.?\])\s+\S")
_RUN = re.compile(r"([^\W\d_])\1{3,}")
_CELL = re.compile(r"\t| {2,}|\s*\|\s*|;(?=\S|$)|\s,\s")
_ENDS = re.compile(r"[.!?:;…][\"'»”)]*\s*$")

_FUNCTION = {w: i for i, code in enumerate(LANGUAGES) for w in FUNCTION_WORDS[code]}
_OF = {w: [i for i, code in enumerate(LANGUAGES) if w in FUNCTION_WORDS[code]] for w in _FUNCTION}

#: Used only for varieties of which the data hold no undoubted text.
_BUILT_IN = {
    "prose en": ([0.28, 0.42, 0.1, 0.15, 0.01, 0.03, 0, 0, 0.01], [0.32, 0.48, 0.02, 0, 0.16, 0.02], [0.01, 0, 0.9, 0.09, 0]),
    "list marked": ([0.24, 0.38, 0.16, 0.11, 0.03, 0.03, 0, 0.02, 0.03], [0.15, 0.47, 0.03, 0, 0.33, 0.02], [0.99, 0, 0, 0.01, 0]),
    "list bare": ([0.26, 0.42, 0.17, 0.08, 0.03, 0.03, 0, 0.01, 0], [0.16, 0.49, 0.03, 0, 0.3, 0.02], [0.01, 0, 0, 0.99, 0]),
    "table cells": ([0.08, 0.13, 0.48, 0.13, 0.02, 0.09, 0.03, 0.03, 0.01], [0, 0.14, 0.02, 0, 0.84, 0], [0, 0.95, 0, 0.05, 0]),
    "junk figures": ([0.24, 0.29, 0.33, 0.13, 0.01, 0, 0, 0, 0], [0.01, 0.08, 0.02, 0.78, 0.11, 0], [0, 0, 0.9, 0.1, 0]),
    "junk glyphs": ([0.11, 0.03, 0.06, 0.13, 0.01, 0.14, 0.03, 0.03, 0.46], [0.01, 0.08, 0, 0.05, 0.28, 0.58], [0, 0, 0, 0, 1.0]),
    "junk strokes": ([0.24, 0.12, 0, 0.07, 0.01, 0.11, 0.12, 0.22, 0.11], [0, 0, 1.0, 0, 0, 0], [0, 0, 0, 0, 1.0]),
    "junk syllables": ([0.37, 0.49, 0, 0.13, 0.01, 0, 0, 0, 0], [0, 1.0, 0, 0, 0, 0], [0, 0, 0.85, 0.15, 0]),
    "junk voiceless": ([0, 0.86, 0, 0.13, 0.01, 0, 0, 0, 0], [0, 0, 1.0, 0, 0, 0], [0, 0, 0.85, 0.15, 0]),
}


def _class_table() -> np.ndarray:
    table = np.full(0x3000, 8, dtype=np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = 1
        elif ch.isdigit():
            table[c] = 2
        elif ch in "\n\r":
            table[c] = 4
        elif ch.isspace() and ch != "\t":
            table[c] = 3
    for code, chars in ((0, "aeiouyåäöæøAEIOUYÅÄÖÆØéèêëàâîïôûùüíóúáÉÀÜ"), (5, ".,!?:;…"), (6, "|\t"), (7, "-–—_")):
        for ch in chars:
            table[ord(ch)] = code
    return table


_CLASSES = _class_table()


def char_counts(texts: list[str]) -> np.ndarray:
    """One row of class counts for each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.where(points < 0x3000, _CLASSES[np.minimum(points, 0x2FFF)], 1).astype(np.int64)
    k = len(CHAR_CLASSES)
    return np.bincount(np.repeat(np.arange(len(texts)) * k, sizes) + kinds, minlength=len(texts) * k).reshape(-1, k)


_VOICED = re.compile(r"[aeiouyåäöæøéèêëàâîïôûùüíóúá]")


def _shape(token: str) -> int:
    low = token.lower()
    if low in _FUNCTION:
        return 0
    if token.isdigit():
        return 4
    if len(token) == 1:
        return 5
    if _RUN.search(low):
        return 2
    if token.isalpha():
        return 1 if _VOICED.search(low) else 2
    digits = sum(c.isdigit() for c in token)
    head = token.rstrip("0123456789")
    # Letters and then figures are a reference; figures among letters are not.
    return 4 if head.isalpha() and digits and len(head) <= 3 else 3


class Shapes(dict):
    """Shapes of tokens by token; words recur, so most are looked up."""

    def __missing__(self, token: str) -> int:
        shape = _shape(token)
        if len(self) < 200_000:
            self[token] = shape
        return shape


_STROKE = re.compile(r"(\S)\1{3,}")
_LETTERS = re.compile(r"[^\W\d_]+")
_FIGURES = re.compile(r"[^\W_]")


_SENTENCE = re.compile(r"[^\W\d_]{2}[.?!]\s+[^\W\d_a-zåäöæøéèà]")


def line_layout(line: str, suspect: bool = False, flows: bool = False) -> int:
    """Which of ``LINE_LAYOUTS`` a line that is not blank has.

    ``flows``: the text has sentences that follow one another, so that shorter
    lines too are parts of them.
    """
    if suspect:
        solid = len(line) - line.count(" ")
        rest = _STROKE.sub("", line)
        if 2 * len(_FIGURES.findall(rest)) < solid:
            return 4
    cells = len(_CELL.findall(line.lstrip(" ")))
    item = _ITEM.match(line) is not None
    if cells - item >= 2 and 60 * cells > len(line):
        return 1
    if item:
        return 0
    if len(line) >= 80:
        return 2
    words = len(_LETTERS.findall(line))
    long = words >= 4 and len(line) >= 25 if flows else words >= 7 or len(line) >= 45
    return 2 if long and words >= 4 + (not flows) and "@" not in line else 3


def measure(text: str, shapes: Shapes, suspect: bool = False) -> tuple:
    """Counts of one text: tokens, letters in them, shapes, characters by layout, lines, line ends, language hits.

    ``suspect``: so many characters are symbols that lines may be noise.
    """
    tokens = _TOKEN.findall(text)
    counts = [0] * len(TOKEN_SHAPES)
    for s in map(shapes.__getitem__, tokens):
        counts[s] += 1
    hits = [0.0] * len(LANGUAGES)
    if counts[0]:
        for t in tokens:
            for i in _OF.get(t.lower(), ()):
                hits[i] += 1
    layouts = [0] * len(LINE_LAYOUTS)
    ends = lines = 0
    flows = counts[0] > 0 and len(_SENTENCE.findall(text)) >= 2
    for line in text.splitlines():
        if line and not line.isspace():
            layouts[line_layout(line, suspect, flows)] += len(line)
            lines += 1
            ends += _ENDS.search(line) is not None
    return len(tokens), sum(map(len, tokens)), counts, layouts, lines, ends, hits


def undoubted(chars: np.ndarray, shapes: np.ndarray, layouts: np.ndarray, lines: int, ends: int) -> str | None:
    """The kind, and its variety, of a text whose layout and words leave no doubt."""
    size, tokens = max(layouts.sum(), 1), max(shapes.sum(), 1)
    item, cells, running, short, noise = layouts / size
    if noise >= 0.6:
        return "junk strokes" if shapes[2] >= 0.15 * tokens or not shapes.sum() else "junk glyphs"
    if item >= 0.7 and lines >= 3:
        return "list marked"
    if cells >= 0.7 and lines >= 3:
        return "table cells"
    if shapes[0] >= 0.15 * tokens and tokens >= 30 and running >= 0.7:
        return "prose"
    if shapes[2] >= 0.5 * tokens:
        return "junk voiceless"
    if shapes[3] >= 0.3 * tokens:
        return "junk figures"
    if shapes[0] <= 0.01 * tokens and item + cells <= 0.1 and shapes[4] <= 0.02 * tokens and tokens >= 6:
        return "junk syllables"
    if short + item >= 0.85 and lines >= 4 and ends <= 0.3 * lines and shapes[0] < 0.4 * tokens:
        return "list bare"
    return None


_FIELDS = (
    "words bigint, mean_word_length double, symbol_ratio double, punct_line_share double, common_share double, word_share double, "
    "known bigint, seed string, language string, classes array<float>, shapes array<float>, layouts array<float>"
)


def text_statistics(df: DataFrame, key: str = "extract_id", text: str = "text") -> DataFrame:
    """Counts and distributions of every row; nothing is compared yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            classes = char_counts(texts).astype(np.float32)
            out: dict[str, list] = {k: [] for k in ("words", "mean", "symbol", "ends", "common", "shaped", "known", "seed", "lang", "shapes", "layouts")}
            for i, t in enumerate(texts):
                solid = classes[i].sum() - classes[i][3] - classes[i][4]
                suspect = bool(classes[i][5:].sum() >= 0.25 * solid) or _STROKE.search(t) is not None
                n, letters, kinds, layouts, lines, ends, hits = measure(t, shapes, suspect)
                k, lay = np.array(kinds, dtype=np.float32), np.array(layouts, dtype=np.float32)
                out["words"].append(n)
                out["mean"].append(letters / n if n else 0.0)
                out["symbol"].append(float(classes[i][5:].sum() / solid) if solid else 0.0)
                out["ends"].append(ends / lines if lines else 0.0)
                out["common"].append(kinds[0] / n if n else 0.0)
                # Of the tokens with letters those that look like words; figures by themselves are neither.
                lettered = n - kinds[4] - kinds[5]
                out["shaped"].append((kinds[0] + kinds[1]) / lettered if lettered > 0 else 0.0)
                out["known"].append(int(len(t.strip())))
                out["seed"].append(undoubted(classes[i], k, lay, lines, ends))
                out["lang"].append(LANGUAGES[int(np.argmax(hits))] if any(hits) else None)
                out["shapes"].append(k / max(k.sum(), 1))
                out["layouts"].append(lay / max(lay.sum(), 1))
            share = classes / np.maximum(classes.sum(axis=1, keepdims=True), 1)
            kinds = pa.list_(pa.float32())
            columns = [
                batch.column(0),
                pa.array(out["words"], pa.int64()),
                pa.array(out["mean"], pa.float64()),
                pa.array(out["symbol"], pa.float64()),
                pa.array(out["ends"], pa.float64()),
                pa.array(out["common"], pa.float64()),
                pa.array(out["shaped"], pa.float64()),
                pa.array(out["known"], pa.int64()),
                pa.array(out["seed"], pa.string()),
                pa.array(out["lang"], pa.string()),
                pa.array(list(share), kinds),
                pa.array(out["shapes"], kinds),
                pa.array(out["layouts"], kinds),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, *(f.split()[0] for f in _FIELDS.split(", "))])

    source = spread(df.select(F.col(key), F.col(text).alias("text")))
    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"{key} {kind}, {_FIELDS}")


def profiles(stats: DataFrame) -> dict[str, list[np.ndarray]]:
    """Mean distributions of the undoubted texts, prose by language: some fifteen rows."""
    mean = lambda c, n: F.array(*[F.avg(F.col(c)[i]) for i in range(n)]).alias(c)
    rows = (
        stats.filter(f"seed is not null and known >= {LEAST_CHARS}")
        .groupBy("seed", F.when(F.col("seed") == "prose", F.col("language")).alias("language"))
        .agg(F.count("*").alias("n"), mean("classes", len(CHAR_CLASSES)), mean("shapes", len(TOKEN_SHAPES)), mean("layouts", len(LINE_LAYOUTS)))
        .collect()
    )
    found = {
        (f"prose {r['language']}" if r["language"] else r["seed"]): [np.array(r[c], dtype=float) for c in ("classes", "shapes", "layouts")]
        for r in rows
        if r["n"] >= 5
    }
    for kind, parts in _BUILT_IN.items():
        if kind not in found and not (kind.startswith("prose") and any(k.startswith("prose") for k in found)):
            found[kind] = [np.array(p, dtype=float) for p in parts]
    return found


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence, in bits, of each row of ``p`` from ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return (a + b) / 2


COUNTS = ("words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_share", "word_share")

#: Weights of characters, token shapes and line layouts in the comparison.
WEIGHTS = (1.0, 1.0, 1.0)


def classify(stats: DataFrame, key: str = "extract_id", known: dict | None = None) -> DataFrame:
    """Statistics with ``kind``, ``profile`` and its divergence ``jsd``."""
    known = profiles(stats) if known is None else known
    names = sorted(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            total = np.zeros((batch.num_rows, len(names)))
            for part, (column, weight) in enumerate(zip(("classes", "shapes", "layouts"), WEIGHTS)):
                flat = get[column].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                for j, name in enumerate(names):
                    total[:, j] += weight * divergence(flat, known[name][part])
            best = total.argmin(axis=1)
            enough = get["known"].to_numpy(zero_copy_only=False) >= LEAST_CHARS
            kind = [names[b].split()[0] if e else None for b, e in zip(best, enough)]
            profile = [names[b] if e else None for b, e in zip(best, enough)]
            jsd = np.where(enough, total[np.arange(len(best)), best], np.nan)
            keep = [get[c] for c in (key, *COUNTS)]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(kind, pa.string()), pa.array(profile, pa.string()), pa.array(jsd, pa.float64(), mask=~enough)],
                [key, *COUNTS, "kind", "profile", "jsd"],
            )

    schema = (
        f"{key} {stats.schema[key].dataType.simpleString()}, words bigint, mean_word_length double, symbol_ratio double, "
        "punct_line_share double, common_share double, word_share double, kind string, profile string, jsd double"
    )
    return stats.mapInArrow(run, schema)


def text_kinds(df: DataFrame, key: str = "extract_id", text: str = "text") -> DataFrame:
    return classify(materialize(text_statistics(df, key, text), "statistics"), key)


#: Ratios further apart than this were taken from another text. The older version had other
#: lists of common words and counted figures otherwise, so the ratios do not agree to the point.
FAR = {"word": 0.2, "common": 0.25}


def beside_recorded(kinds: DataFrame, recorded: DataFrame, key: str = "extract_id") -> DataFrame:
    """The statistics beside those an older version recorded, and whether they agree.

    Both recorded ratios are checked, ``word_ratio`` against the share of tokens
    that look like words, ``common_ratio`` against that of common words. Of several
    recorded rows of one text the newest counts.
    """
    newest = recorded.groupBy(key).agg(
        F.max_by(F.struct("words", "word_ratio", "common_ratio"), F.struct(F.col("scored_at").isNotNull(), F.col("scored_at"))).alias("old")
    )

    def check(ratio: str) -> Column:
        old = F.col(f"old.{ratio}_ratio")
        return (
            F.when(F.col("old").isNull(), "missing")
            .when(old.isNull() | F.isnan(old), "no ratio")
            .when(F.abs(old - F.col(f"{ratio}_share")) > FAR[ratio], "differs")
            .otherwise("agrees")
            .alias(f"{ratio}_check")
        )

    return (
        kinds.dropDuplicates([key])
        .join(newest, key, "left")
        .select(
            key,
            "words",
            F.round("word_share", 4).alias("word_share"),
            F.round("common_share", 4).alias("common_share"),
            "kind",
            F.col("old.words").alias("recorded_words"),
            F.col("old.word_ratio").alias("recorded_word_ratio"),
            F.col("old.common_ratio").alias("recorded_common_ratio"),
            check("word"),
            check("common"),
        )
    )
