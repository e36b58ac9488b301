"""Languages of documents and of the passages inside them.

Evidence is fused as log-odds. The text speaks through word likelihoods, fitted
on at most ``FIT_ROWS`` labelled rows whose label agrees with their function
words. The declared label, a country suffix of addresses in the text and the
host (channel, then batch below it) speak through priors; host priors are
counted by grouped aggregation over all rows and smoothed hierarchically: batch
counts lean on those of the channel, these on those of the whole table.

Every text is cut into sentences; each gets its own posterior, and neighbouring
sentences of one language form a passage. The confidence of a passage is its
posterior: the log-likelihoods of its words, tempered because words of one text
are not independent (n words weigh as much as 2 sqrt(n) independent ones), plus
the log-prior, once.

Defined cases: null, empty and blank texts have no passage; a text without known
words takes the language its priors favour, with their confidence; a label that
names no known language is no evidence; long texts are read whole; repeated rows
give equal rows; columns that are not named are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread
from .quality import line_layout
from .words import FUNCTION_WORDS, LANGUAGES, languages_named

#: Labelled rows that the word likelihoods are fitted on at most.
FIT_ROWS = 20_000
#: Rows of host priors that are broadcast at most; more are joined.
BROADCAST_HOSTS = 50_000
#: Characters that a reported passage has at least.
LEAST_CHARS = 120
#: Confidence that a reported passage has at least.
SURE = 0.98
#: Strength of the parent's share in a child's host prior, in rows.
SMOOTHING = 20.0
#: How often a label is right, as evidence.
LABEL_TRUST = 0.9
#: Weight of the priors beside the words: label, host and addresses are no independent witnesses.
PRIOR_WEIGHT = 0.5

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?:])[\"'»”)]*\s+(?=[\"'«“(]*[^\W\d_a-zåäöæøéèàêç])")
_BLANK_LINE = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_JOIN = re.compile(r"(?<=[^\W\d_])[-‐­¬][ ]*\n(?=[^\W\d_])")
_SUFFIX = re.compile(r"(?:@|www\.)[\w.-]+\.([a-z]{2})\b")
#: Country suffixes and the language they speak for. Fixed values.
SUFFIXES = {"uk": "en", "us": "en", "ie": "en", "se": "sv", "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "dk": "da", "nl": "nl"}


class Model:
    """Log-likelihoods of words, one row per word, centred over the languages."""

    def __init__(self, counts: dict[str, dict[str, int]], least: int = 3):
        seeds = {code: Counter({w: 40 for w in words}) for code, words in FUNCTION_WORDS.items()}
        totals = {c: sum(seeds[c].values()) for c in LANGUAGES}
        table: dict[str, np.ndarray] = {}
        for word, by in counts.items():
            if sum(by.values()) >= least or word in {w for c in LANGUAGES for w in seeds[c]}:
                table[word] = np.array([by.get(c, 0) for c in LANGUAGES], dtype=float)
        for i, code in enumerate(LANGUAGES):
            for w, n in seeds[code].items():
                table.setdefault(w, np.zeros(len(LANGUAGES)))[i] += n
        for row in table.values():
            for i, c in enumerate(LANGUAGES):
                totals[c] += row[i]
        size = np.array([totals[c] for c in LANGUAGES])
        self.ids = {w: i for i, w in enumerate(table)}
        rows = np.array(list(table.values()))
        like = np.log((rows + 0.3) / (size + 0.3 * len(table)))
        like -= like.mean(axis=1, keepdims=True)
        self.rows = np.vstack([np.clip(like, -5, 5), np.zeros(len(LANGUAGES))]).astype(np.float32)

    @property
    def unknown(self) -> int:
        return len(self.ids)


def fit(df: DataFrame, text: str = "text", label: str = "language", rows: int = FIT_ROWS, key: str = "doc_id") -> Model:
    """Word counts by language over a bounded sample of labelled rows, drawn by their key."""
    labelled = df.filter(F.length(F.trim(label)) > 0).select(F.col(text).alias("text"), F.col(label).alias("label"), F.col(key).alias("key"))
    total = labelled.count()
    if total > rows:
        cut = int(rows / total * (1 << 30))
        labelled = labelled.filter(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 30)) < cut)
    labelled = labelled.select("text", "label")
    sets = {c: set(words) for c, words in FUNCTION_WORDS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {c: Counter() for c in LANGUAGES}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                named = languages_named(name)
                if not t or len(named) != 1:
                    continue
                words = _WORD.findall(_JOIN.sub("", t).lower())
                (code,) = named
                hits = {c: sum(w in s for w in words) for c, s in sets.items()}
                if hits[code] and hits[code] == max(hits.values()):
                    counts[code].update(words)
        rows = [(w, c, n) for c in LANGUAGES for w, n in counts[c].items()]
        names = ["word", "code", "n"]
        kinds = [pa.string(), pa.string(), pa.int64()]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    counted = spread(labelled).mapInArrow(run, "word string, code string, n bigint").groupBy("word").pivot("code", list(LANGUAGES)).sum("n")
    total_n = sum((F.coalesce(F.col(c), F.lit(0)) for c in LANGUAGES), F.lit(0))
    # As many words as the bounded sample holds three times or more.
    best = counted.withColumn("total", total_n).filter("total >= 3").collect()
    return Model({r["word"]: {c: r[c] or 0 for c in LANGUAGES} for r in best})


def declared_hosts(rows: DataFrame) -> DataFrame:
    """``(channel, batch, code, n)``: rows by host and the one language their label declares.

    Labels are counted before they are read: a label is read once a host.
    """

    @F.pandas_udf("string")
    def one(labels):
        seen = {}
        for v in labels.unique():
            named = languages_named(v)
            seen[v] = next(iter(named)) if len(named) == 1 else None
        return labels.map(seen)

    labels = rows.filter(F.length(F.trim("label")) > 0).groupBy("channel", "batch", "label").agg(F.count("*").alias("n"))
    coded = labels.select("channel", "batch", one("label").alias("code"), "n")
    return coded.filter("code is not null").groupBy("channel", "batch", "code").agg(F.sum("n").alias("n"))


def host_priors(counts: DataFrame) -> DataFrame:
    """``(channel, batch, prior)``: smoothed log-priors of each host from ``(channel, batch, code, n)``."""
    by_batch = counts.groupBy("channel", "batch").pivot("code", list(LANGUAGES)).sum("n").fillna(0)
    by_channel = counts.groupBy("channel").pivot("code", list(LANGUAGES)).sum("n").fillna(0)
    total = {r["code"]: r["n"] for r in counts.groupBy("code").agg(F.sum("n").alias("n")).collect()}
    base = [total.get(c, 0) + 1.0 for c in LANGUAGES]
    share = [b / sum(base) for b in base]
    channel = by_channel.select(
        F.col("channel").alias("channel_"),
        *[
            ((F.col(c) + SMOOTHING * share[i]) / (sum((F.col(x) for x in LANGUAGES), F.lit(0)) + SMOOTHING)).alias(f"up_{c}")
            for i, c in enumerate(LANGUAGES)
        ],
    )
    joined = by_batch.join(channel, F.col("channel").eqNullSafe(F.col("channel_")))
    size = sum((F.col(x) for x in LANGUAGES), F.lit(0)) + SMOOTHING
    return joined.select("channel", "batch", F.array(*[F.log((F.col(c) + SMOOTHING * F.col(f"up_{c}")) / size) for c in LANGUAGES]).alias("prior"))


def sentences(text: str) -> list[tuple[bool, str]]:
    """``(running, sentence)`` of a text without its items, cells and noise.

    Sentences of a block that is mostly short lines (titles, addresses, bare
    lists) are not running.
    """
    text = _JOIN.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    flows = len(_SENTENCE.findall(text)) >= 1
    suspect = False
    found = []
    for paragraph in _BLANK_LINE.split(text):
        block: list[str] = []
        long = 0
        for line in paragraph.split("\n"):
            if not line or line.isspace():
                continue
            layout = line_layout(line, suspect, flows)
            if layout == 2 or layout == 3:
                block.append(line.strip())
                long += (layout == 2) * len(line)
            elif block:
                found += _cut(long, block)
                block, long = [], 0
        if block:
            found += _cut(long, block)
    return found


def _cut(long: int, lines: list[str]) -> list[tuple[bool, str]]:
    parts = []
    running = 2 * long >= sum(map(len, lines))
    for s in _SENTENCE.split(" ".join(lines)):
        while len(s) > 600:
            at = s.find(" ", 300)
            if at < 0:
                break
            parts.append((running, s[:at]))
            s = s[at + 1 :]
        parts.append((running, s))
    return parts


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def passages_of(texts: list[str], priors: np.ndarray, labels: list[str | None], model: Model) -> list[list[tuple]]:
    """For each text its passages ``(language, confidence, chars, known words, sentences)``.

    Characters and sentences are those of running sentences of mostly known words.
    """
    owner, chars, ends, flat, known, proper = [], [], [], [], [], []
    get, unknown = model.ids.get, model.unknown
    extra = np.zeros((len(texts), len(LANGUAGES)), dtype=np.float32)
    for i, text in enumerate(texts):
        if not text or text.isspace():
            continue
        for code in map(SUFFIXES.get, _SUFFIX.findall(text) if "@" in text or "www." in text else ()):
            if code:
                extra[i, LANGUAGES.index(code)] += 0.5
        for running, s in sentences(text):
            words = _WORD.findall(s.lower())
            ids = [get(w, unknown) for w in words]
            n = len(ids) - ids.count(unknown)
            owner.append(i)
            chars.append(len(s))
            known.append(n)
            proper.append(running and n >= 5 and 2 * n >= len(ids) and 2 * sum(map(len, words)) >= len(s))
            flat += ids
            flat.append(unknown)
            ends.append(len(flat))
    out: list[list[tuple]] = [[] for _ in texts]
    if not owner:
        return out
    starts = np.concatenate(([0], np.array(ends[:-1], dtype=np.int64)))
    like = np.add.reduceat(model.rows[np.array(flat, dtype=np.int64)], starts, axis=0)
    prior = priors + extra
    for i, label in enumerate(labels):
        named = [LANGUAGES.index(c) for c in languages_named(label)]
        if named:
            prior[i, named] += math.log(LABEL_TRUST / (1 - LABEL_TRUST))
    # A sentence by itself has the prior too; it tells where a passage ends.
    best = (like + PRIOR_WEIGHT * prior[np.array(owner)]).argmax(axis=1)
    i = 0
    while i < len(owner):
        j, total, size, words, whole = i, np.zeros(len(LANGUAGES)), 0, 0, 0
        while j < len(owner) and owner[j] == owner[i] and (best[j] == best[i] or known[j] < 3):
            if known[j] >= 3 or j == i:
                total += like[j]
                words += known[j]
                whole += proper[j]
            size += chars[j] + (j > i) if proper[j] else 0
            j += 1
        sure = _softmax(total * min(1.0, 2 / math.sqrt(max(words, 1))) + PRIOR_WEIGHT * prior[owner[i]])
        out[owner[i]].append((LANGUAGES[int(best[i])], float(sure[best[i]]), int(size), int(words), int(whole)))
        i = j
    return out


def _rows(df: DataFrame, src: str, key: str, text: str, label: str, channel: str | None, batch: str | None) -> DataFrame:
    lit = F.lit(None).cast("string")
    return df.select(
        F.lit(src).alias("src"),
        F.col(key).cast("long").alias("row_id"),
        F.col(text).alias("text"),
        F.col(label).alias("label"),
        (F.col(channel) if channel else lit).alias("channel"),
        (F.col(batch) if batch else lit).alias("batch"),
    )


def passages(rows: DataFrame, model: Model) -> DataFrame:
    """``(src, row_id, label, named, passage, language, confidence, chars, words, sentences)``.

    ``rows`` has ``src, row_id, text, label, channel, batch``; ``named`` tells
    whether the label names the passage's language.
    """
    counts = materialize(declared_hosts(rows.select("channel", "batch", "label")), "labels")
    hosts = materialize(host_priors(counts), "hosts")
    right = hosts.select(F.col("channel").alias("c_"), F.col("batch").alias("b_"), "prior")
    if hosts.count() <= BROADCAST_HOSTS:
        right = F.broadcast(right)
    joined = spread(rows).join(right, F.col("channel").eqNullSafe(F.col("c_")) & F.col("batch").eqNullSafe(F.col("b_")), "left")
    flat = np.full(len(LANGUAGES), -math.log(len(LANGUAGES)), dtype=np.float32)
    shipped = rows.sparkSession.sparkContext.broadcast(model)  # the words of FIT_ROWS texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            src, row_id, text, label, prior = (batch.column(i).to_pylist() for i in range(5))
            priors = np.array([p if p is not None else flat for p in prior], dtype=np.float32).reshape(-1, len(LANGUAGES))
            out = passages_of(text, priors, label, m)
            named = [languages_named(x) for x in label]
            rows = [(src[i], row_id[i], label[i], p[0] in named[i], k, *p) for i, ps in enumerate(out) for k, p in enumerate(ps)]
            columns = list(zip(*rows)) or [()] * 10
            kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            names = ["src", "row_id", "label", "named", "passage", "language", "confidence", "chars", "words", "sentences"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return joined.select("src", "row_id", "text", "label", "prior").mapInArrow(
        run,
        "src string, row_id bigint, label string, named boolean, passage int, language string, confidence double, chars int, words int, sentences int",
    )


def vault_rows(documents: DataFrame, notes: DataFrame) -> DataFrame:
    return _rows(documents, "documents", "doc_id", "text", "language", "source", "batch_id").unionByName(
        _rows(notes, "document_meta", "note_id", "summary", "language", "classifier", "batch_id")
    )


def vault_passages(documents: DataFrame, notes: DataFrame) -> DataFrame:
    return passages(vault_rows(documents, notes), fit(documents))


def unnamed(found: DataFrame) -> DataFrame:
    """``(src, row_id, lang)``: languages of long passages that the label does not name."""
    long = found.filter((F.col("chars") >= LEAST_CHARS) & (F.col("sentences") >= 1) & (F.col("confidence") >= SURE))

    return long.filter("not named").select("src", "row_id", F.col("language").alias("lang")).distinct()


def main_language(found: DataFrame) -> DataFrame:
    """One row per text: the language of most of it, how sure, and how many others it holds."""
    best = found.groupBy("src", "row_id", "language").agg(F.sum("chars").alias("chars"), F.max("confidence").alias("confidence"))
    return best.groupBy("src", "row_id").agg(
        F.max_by("language", F.struct("chars", "confidence", "language")).alias("language"),
        F.round(F.max_by("confidence", F.struct("chars", "confidence", "language")), 4).alias("confidence"),
        F.sum(F.when(F.col("chars") >= LEAST_CHARS, 1).otherwise(0)).alias("long_languages"),
    )
