"""Languages, their names in labels, and their most frequent function words."""

from __future__ import annotations

import re

LANGUAGES = ("en", "sv", "de", "fr", "es", "da", "nl")

#: Function words by language. Fixed values.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it as was with be by on not this are or from at which you your we our has been will so".split(),
    "sv": "och att det som en på är av för med till den har de inte om ett vi du från vid eller er ditt vår enligt så under efter".split(),
    "de": "der die das und von zu auf nach mit wurde für ist nicht den dem ein eine wir sie im am bei oder auch aus über als".split(),
    "fr": "le la les de des du et un une est pour dans que qui pas sur avec au aux vous nous par votre notre ce en à".split(),
    "es": "el los las del en por para con que se su un una la de y al lo no ha sus como nuestro si está hasta sobre".split(),
    "da": "og at det som en er af for med til den har ikke om et vi du fra ved eller der på blevet vores din under efter hvis".split(),
    "nl": "het een van de en op te dat die met voor is niet zijn aan ook als er wij u uw in om wordt door bij naar na".split(),
}

#: Names of the languages as people and software write them. Fixed values.
LANGUAGE_NAMES = {
    "en": "en eng english anglais englisch engels engelska engelsk inglés ingles".split(),
    "sv": "sv swe se swedish svenska svensk suédois schwedisch zweeds sueco".split(),
    "de": "de deu ger german deutsch tyska tysk allemand duits alemán aleman".split(),
    "fr": "fr fra fre french français francais franska fransk französisch frans francés frances".split(),
    "es": "es spa spanish español espanol castellano spanska spansk espagnol spanisch spaans".split(),
    "da": "da dan dk danish dansk danska danois dänisch deens danés danes".split(),
    "nl": "nl nld dut dutch nederlands nederländska hollandsk néerlandais niederländisch neerlandés flemish vlaams".split(),
}
_BY_NAME = {name: code for code, names in LANGUAGE_NAMES.items() for name in names}
_WORD = re.compile(r"[^\W\d_]+")
_REGION = re.compile(r"\b([a-z]{2,3})[-_](?:[A-Z][a-z]{3}[-_])?[A-Z]{2}\b")


def languages_named(label: str | None) -> frozenset[str]:
    """Codes of the languages that a label names; regions (en-GB) name none."""
    if not label:
        return frozenset()
    label = _REGION.sub(r"\1", label)
    return frozenset(_BY_NAME[w] for w in _WORD.findall(label.lower()) if w in _BY_NAME)
