"""Folding of single strings, for the functions that must leave the JVM."""

from __future__ import annotations

import unicodedata


def fold(text: str) -> str:
    """Case-folded, without diacritics; letters that do not decompose stay."""
    text = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in text if not unicodedata.combining(c))
