"""Tags and categories from keyword rules given as data."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .folding import fold as fold_text
from .text import clean_title, fold, slugify

#: tag -> keywords; a keyword that ends in * matches anywhere inside a word. A
#: parameter of every function here; this small table of ours is the default.
RULES: dict[str, tuple[str, ...]] = {
    "invoice": ("faktur*", "invoice", "rechnung*", "facture", "amount due"),
    "insurance": ("forsakring*", "household insurance", "versicherung*", "assurance*", "seguro", "verzekering*", "forsikring*"),
    "property": ("tenancy", "bostadsratt*", "hyresavtal*", "mietvertrag", "huurcontract", "lejekontrakt*", "alquiler", "co-operative share"),
    "vehicle": ("vehicle inspection", "fordonsbesiktning*", "winter tyres", "vinterdack*", "bilsyn*", "kfz-steuer", "aparcamiento", "parking permit"),
    "medical": ("dental treatment", "tandvard*", "hospital referral", "remissen till sjukhus*", "zahnbehandlung", "soins dentaires", "tandbehandling*"),
    "utilities": ("water supply", "vattenleverans*", "wasserversorgung", "fourniture d'eau", "bredband*", "internet*"),
    "education": ("evening course", "kvallskurs*", "abendkurs", "aftenkurs*", "avondcursus", "orchestra rehearsal"),
    "travel": ("train journey", "tagresa*", "bahnreise", "voyage en train", "viaje en tren", "treinreis", "togrejse*"),
    "legal": ("signed original", "undertecknad* original*", "power of attorney"),
    "government": ("council", "kommun*", "registry", "registre"),
}
#: tag -> category in order of priority, and the tags too weak to overrule anything.
CATEGORY_OF = {
    "insurance": "Household insurance", "vehicle": "Vehicle inspections", "medical": "Medical letters", "education": "Course diplomas",
    "travel": "Train tickets", "utilities": "Water bills", "property": "Tenancy agreements", "invoice": "Supplier invoices",
    "government": "Council notices", "legal": "Court decisions",
}
WEAK = ("government", "legal", "property")
GENERIC = ("none", "Private correspondence")
#: category -> words any of which names it; the first category with a hit wins.
HEURISTICS = (
    ("Bank statements", ("statement of account", "kontoutdrag", "kontoauszug", "relevé de compte", "extracto de cuenta")),
    ("Supplier invoices", ("notice of payment", "meddelande om betalning", "avis de paiement", "aviso de pago")),
    ("Tenancy agreements", ("change of terms", "ändrade villkor")),
    ("Council notices", ("decision", "beslut", "bescheid", "décision", "resolución")),
)


def haystack(*parts: Column, most: int = 4000) -> Column:
    *fields, text = parts
    cleaned = [F.when(p != "", p) for p in fields] + [F.when(text != "", F.substring(text, 1, most))]
    return fold(F.array_join(F.array_compact(F.array(*cleaned)), "\n"))


def _pattern(keywords: tuple[str, ...]) -> tuple[str, list[str]]:
    exact = sorted((fold_text(k) for k in keywords if not k.endswith("*")), key=len, reverse=True)
    stems = [fold_text(k.rstrip("*")) for k in keywords if k.endswith("*")]
    return (r"(?<![a-z0-9])(?:" + "|".join(re.escape(k).replace("\\ ", " ") for k in exact) + r")(?![a-z0-9])" if exact else ""), stems


def fires(hay: Column, keywords: tuple[str, ...]) -> Column:
    pattern, stems = _pattern(keywords)
    hit = hay.rlike(pattern) if pattern else F.lit(False)
    for s in stems:
        hit = hit | F.contains(hay, F.lit(s))
    return hit


def rule_tags(hay: Column, rules: dict[str, tuple[str, ...]] = RULES) -> Column:
    """The tags whose rule fires, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(fires(hay, k), t) for t, k in rules.items()]))


def category_from_rules(category: Column, classifier: Column, title_tags: Column, all_tags: Column, mapping: dict[str, str] = CATEGORY_OF) -> Column:
    """A generic category gives way to any tag's, a guessed one to the title's or a strong tag's."""

    def first(tags: Column, weak_too: bool) -> Column:
        order = [t for t in mapping if t not in WEAK] + [t for t in mapping if t in WEAK] * weak_too
        return F.coalesce(*[F.when(F.array_contains(tags, t), mapping[t]) for t in order])

    generic = F.coalesce(category, F.lit("none")).isin(*GENERIC)
    guessed = F.coalesce(classifier, F.lit("")) != "llm"
    return (
        F.when(generic, F.coalesce(first(all_tags, True), category))
        .when(guessed, F.coalesce(first(title_tags, True), first(all_tags, False), category))
        .otherwise(category)
    )


def heuristic_category(text: Column, rules=HEURISTICS, fallback: str = "none") -> Column:
    low = F.lower(text)
    out = F.lit(fallback)
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return F.when(text.isNull(), fallback).otherwise(out)


#: Words that name a kind of document in its heading. Fixed values.
DOCUMENT_WORDS = (
    r"(?i)\b(invoice|receipt|statement|tariff|notice|letter|certificate|agreement|contract|bill|policy|summary|confirmation|reminder|payslip|declaration"
    r"|faktura|kvitto|besked|intyg|avtal|beslut|underrättelse)\b"
)


def heuristic_title(text: Column) -> Column:
    """Of the first twenty longer lines the first that names a document, else the first."""
    lines = F.filter(F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), 1, 20), F.trim), lambda x: F.length(x) > 8)
    named = F.filter(lines, lambda x: x.rlike(DOCUMENT_WORDS))
    return clean_title(F.coalesce(F.get(named, F.lit(0)), F.get(lines, F.lit(0)), F.lit("")), 80)


def derived_tags(category: Column, when: Column, correspondent: Column, subjects: Column, kind: Column, context: Column, rule: Column, classifier: Column, confidence: Column) -> Column:
    """Tags that follow from the other fields, in a fixed order."""
    one = lambda c: F.array(c)
    review = (F.coalesce(classifier, F.lit("")) != "llm") | (confidence < 0.5)
    all_tags = F.concat(
        one(slugify(category)),
        one(F.concat(F.lit("year-"), F.year(when).cast("string"))),
        one(slugify(correspondent, 40)),
        F.transform(F.slice(F.coalesce(subjects, F.array().cast("array<string>")), 1, 3), lambda s: slugify(s, 40)),
        one(slugify(kind, 40)),
        one(F.when(context == "business", "business")),
        rule,
        one(F.when(F.coalesce(review, F.lit(False)), "needs-review")),
    )
    return F.filter(F.array_compact(all_tags), lambda t: t != "")


def clean_tags(base: list[str], derived: Column, model: Column, most: int = 12) -> Column:
    """Slugs of all tags in order without repeats, deterministic ones first, capped."""
    every = F.concat(F.array(*[F.lit(b) for b in base]), derived, F.coalesce(model, F.array().cast("array<string>")))
    slugs = F.array_distinct(F.filter(F.transform(every, lambda t: slugify(F.ltrim(t, F.lit("#")), 40)), lambda t: t != ""))
    return F.slice(slugs, F.lit(1), F.greatest(F.lit(len(base)) + F.size(derived), F.lit(most)))


def match_category(value: Column, categories: list[str], cutoff: float = 0.72) -> Column:
    """The category most alike in the sense of Ratcliff and Obershelp; the last of equals, else the last of all."""
    low = [c.lower() for c in categories]

    def best(v) -> str:
        v = (v or "").strip().lower()
        if not v or v in low:
            return categories[low.index(v)] if v else categories[-1]
        tries = [w for w in [v, *re.split(r"\W+", v)] if w]
        score, at = max((max(SequenceMatcher(None, w, c).ratio() for w in tries), i) for i, c in enumerate(low))
        return categories[at] if score >= cutoff else categories[-1]

    @F.pandas_udf("string")
    def match(values: pd.Series) -> pd.Series:
        return values.map({v: best(v) for v in values.unique()})

    return match(value)
