"""Mapping freely entered values to the entries of a reference list.

The reference list is turned into a dictionary of keys: all strings left of its
entries' forms after up to ``MAX_EDITS`` deletions, and its words by place. A
value meets an entry where they share a key, and is then rated: forms by
weighted Damerau-Levenshtein cost, words by how they are cut short. The
dictionary is broadcast: its size follows the reference list, not the data, and
is checked against ``MAX_DICTIONARY`` before; a larger list is joined on the same
keys and rated by the same functions, so that both ways give the same answer.
Each *distinct* value is looked up once, candidates are ranked by cost, then by
how often the entry stands literally in the data, then by code; the answer is
joined back to the rows.

Defined cases: null, empty and blank values have no row; a value equal to an
entry maps to it; a value near nothing maps to ``none``; when two entries fit
equally well the more frequent one is taken, then the smaller code; repeated
rows give one row; extra columns are ignored; an empty table gives no rows, an
empty reference list maps everything to ``none``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .symdelete import deletes, edit_cost, fold, shortens

#: Keys of the broadcast dictionary at most; beyond it they are joined.
MAX_DICTIONARY = 2_000_000
#: Edits a value may be away from an entry.
MAX_EDITS = 2
#: Entries of so many words are written in every order; longer ones in sorted order.
ORDERED = 4
_ASIDE = re.compile(r"\([^)]*\)|\[[^\]]*\]")
_NOT_WORD = re.compile(r"[^\w]+|_+|\d+", re.UNICODE)
#: Words that carry no meaning in a label. Fixed values.
FILLERS = frozenset("a an and for in my of on our the to".split())


def words_of(value: str) -> list[str]:
    return [w for w in _NOT_WORD.sub(" ", _ASIDE.sub(" ", fold(value))).split() if w]


def content_of(value: str) -> list[str]:
    return [w for w in words_of(value) if w not in FILLERS]


def entry_forms(entry: str) -> set[str]:
    """The ways an entry may be written together: its words in any order."""
    words, content = words_of(entry), content_of(entry)
    forms = {"".join(words), "".join(content)}
    if len(content) <= ORDERED:
        forms |= {"".join(p) for p in permutations(content)}
    else:
        forms.add("".join(sorted(content)))
    return forms - {""}


def value_forms(value: str) -> set[str]:
    words, content = words_of(value), content_of(value)
    forms = {"".join(words), "".join(content)}
    if len(content) > ORDERED:
        forms.add("".join(sorted(content)))
    return forms - {""}


def word_keys(text: str) -> set[str]:
    """A value and an entry that ``abbreviates`` allows share one of these."""
    content = content_of(text)
    n = len(content)
    return {f"{n} {w}" if n > ORDERED else f"{n}.{i} {w}" for i, w in enumerate(content)}


def allowed(length: int) -> float:
    """The highest cost at which a form of this length still counts as near."""
    return min(MAX_EDITS + 0.1, 0.34 * length)


def _word_cost(w: str, e: str) -> float | None:
    if w == e:
        return 0.0
    if len(w) >= 3 and shortens(w, e):
        return 0.5
    return 1.0 if len(e) > 4 and edit_cost(w, e) <= 1.1 else None


def abbreviates(words: list[str], entry: list[str]) -> float | None:
    """Cost of reading ``words`` as ``entry`` with words cut short, or None.

    Words stand in the order of the entry; those of an entry of many words in any.
    """
    if len(words) != len(entry) or not words:
        return None
    cost, whole = 0.0, 0
    if len(words) > ORDERED:
        left = list(entry)
        for w in [w for w in words if w in entry] + [w for w in words if w not in entry]:
            near = [(c, e) for e in left if (c := _word_cost(w, e)) is not None]
            if not near:
                return None
            c, e = min(near)
            left.remove(e)
            cost, whole = cost + c, whole + (c == 0.0)
        return cost if whole else None
    for w, e in zip(words, entry):
        c = _word_cost(w, e)
        if c is None:
            return None
        cost, whole = cost + c, whole + (c == 0.0)
    return cost if whole or len(entry) == 1 else None


def rate_form(typed: str, form: str) -> float | None:
    """Cost of a typed form that shares a deletion with an entry's form, or None."""
    cost = edit_cost(typed, form)
    return cost if cost <= allowed(len(form)) else None


class Dictionary:
    """The keys of every entry, in memory."""

    def __init__(self, entries: list[tuple[str, str, int]]):
        self.entries = [(code, content_of(text), n) for code, text, n in entries]
        self.forms: dict[str, set[int]] = defaultdict(set)
        self.index: dict[str, set[str]] = defaultdict(set)
        self.by_word: dict[str, set[int]] = defaultdict(set)
        for k, (_, text, _) in enumerate(entries):
            for form in entry_forms(text):
                self.forms[form].add(k)
                for key in deletes(form, MAX_EDITS):
                    self.index[key].add(form)
            for key in word_keys(text):
                self.by_word[key].add(k)

    def rated(self, value: str) -> Iterator[tuple[int, float]]:
        for typed in value_forms(value):
            for form in {f for key in deletes(typed, MAX_EDITS) for f in self.index.get(key, ())}:
                cost = rate_form(typed, form)
                if cost is not None:
                    for k in self.forms[form]:
                        yield k, cost
        words = content_of(value)
        for k in {k for key in word_keys(value) for k in self.by_word.get(key, ())}:
            cost = abbreviates(words, self.entries[k][1])
            if cost is not None:
                yield k, cost

    def look_up(self, value: str) -> tuple[str, float | None]:
        """The code of the entry meant and the cost, or ``none``."""
        exact = {k for form in value_forms(value) for k in self.forms.get(form, ())}
        found = [(k, 0.0) for k in exact] or list(self.rated(value))
        if not found:
            return "none", None
        k, cost = min(found, key=lambda x: (round(x[1], 6), -self.entries[x[0]][2], self.entries[x[0]][0]))
        return self.entries[k][0], round(cost, 6)


@lru_cache(maxsize=2)
def _dictionary(entries: tuple[tuple[str, str, int], ...]) -> Dictionary:
    """One dictionary for all batches of a worker."""
    return Dictionary(list(entries))


def map_values(
    df: DataFrame, reference: DataFrame, value: str = "category", code: str = "category_code", entry: str = "category"
) -> DataFrame:
    """``(value, category_code, cost)`` for every distinct value that is not blank."""
    values = (
        df.select(F.col(value).alias("value"))
        .filter(F.length(F.regexp_replace("value", r"[\s\u00A0]+", "")) > 0)
        .groupBy("value")
        .agg(F.count("*").alias("n"))
    )
    ref = reference.select(F.col(code).alias("code"), F.col(entry).alias("entry")).filter("code is not null and entry is not null")
    counted = ref.join(values, F.col("entry") == F.col("value"), "left").select(
        "code", "entry", F.coalesce("n", F.lit(0)).alias("n")
    )
    # Deletions of a form of m letters number about m(m + 1)/2 at two edits.
    size = ref.agg(F.sum(F.length("entry") * (F.length("entry") + 1) * 3)).first()[0] or 0
    if size > MAX_DICTIONARY:
        return _join_keys(values, counted)
    rows = tuple((r["code"], r["entry"], r["n"]) for r in counted.collect())
    literal = {text: key for key, text, _ in sorted(rows, reverse=True)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dictionary = _dictionary(rows)
        for pdf in batches:
            got = [(literal[v], 0.0) if v in literal else dictionary.look_up(v) for v in pdf["value"]]
            yield pd.DataFrame({"value": pdf["value"], "category_code": [g[0] for g in got], "cost": [g[1] for g in got]})

    return values.select("value").mapInPandas(run, "value string, category_code string, cost double")


def _join_keys(values: DataFrame, counted: DataFrame) -> DataFrame:
    """The same look-up for a reference list too large to broadcast: a join on the keys."""

    def keys_of(forms: Callable[[str], set[str]]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [
                    (row[0], row[1], row[2], form, "d" + key)
                    for row in pdf.itertuples(index=False)
                    for form in forms(row[0])
                    for key in deletes(form, MAX_EDITS)
                ]
                rows += [(row[0], row[1], row[2], "", "w" + key) for row in pdf.itertuples(index=False) for key in word_keys(row[0])]
                yield pd.DataFrame(rows, columns=["text", "code", "n", "form", "key"])

        return run

    schema = "text string, code string, n bigint, form string, key string"
    left = counted.select(F.col("entry").alias("text"), "code", "n").mapInPandas(keys_of(entry_forms), schema)
    right = values.select(F.col("value").alias("text"), F.lit("").alias("code"), "n").mapInPandas(keys_of(value_forms), schema)
    pairs = (
        right.select(F.col("text").alias("value"), F.col("form").alias("typed"), "key")
        .join(left.select(F.col("text").alias("entry"), "code", "n", "form", "key"), "key")
        .select("value", "typed", "entry", "form", "code", "n")
        .distinct()
    )

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cost = []
            for value, typed, entry, form in zip(pdf["value"], pdf["typed"], pdf["entry"], pdf["form"]):
                if value == entry or typed == form != "":
                    c = -1.0 if value == entry else 0.0
                else:
                    c = rate_form(typed, form) if form else abbreviates(content_of(value), content_of(entry))
                cost.append(None if c is None else round(c, 6))
            pdf = pdf.assign(cost=pd.Series(cost, dtype="float64"))
            yield pdf[pdf["cost"].notna()][["value", "code", "n", "cost"]]

    # A literal entry comes before an equal form, of several the one of least code.
    best = (
        pairs.mapInPandas(rate, "value string, code string, n bigint, cost double")
        .groupBy("value")
        .agg(F.min(F.struct("cost", F.when(F.col("cost") < 0, 0).otherwise(-F.col("n")).alias("n"), "code")).alias("best"))
    )
    # A value without letters has no key; only its literal entry can be meant.
    literal = counted.groupBy(F.col("entry").alias("value")).agg(F.min("code").alias("literal"))
    return (
        values.join(best, "value", "left")
        .join(literal, "value", "left")
        .select(
            "value",
            F.coalesce("literal", "best.code", F.lit("none")).alias("category_code"),
            F.when(F.col("literal").isNotNull(), 0.0).otherwise(F.col("best.cost")).alias("cost"),
        )
    )


def map_rows(df: DataFrame, reference: DataFrame, key: str = "note_id", value: str = "category") -> DataFrame:
    """``(key, category_code)`` of every row whose value is neither blank nor literally an entry."""
    entries = reference.select(F.col("category").alias("value")).distinct()
    rows = df.select(F.col(key), F.col(value).alias("value")).join(entries, "value", "left_anti")
    mapped = map_values(rows, reference, "value").select("value", "category_code")
    return rows.join(mapped, "value").select(key, "category_code").distinct()


def misses(df: DataFrame, reference: DataFrame, value: str = "category") -> DataFrame:
    """Values that fit no entry and how many rows hold each."""
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n_rows"))
    return map_values(df, reference, value).filter("category_code = 'none'").join(counts, "value").select("value", "n_rows")
