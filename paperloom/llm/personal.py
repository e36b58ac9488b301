"""Personal information in free text: finding it and putting surrogates in its place.

Emails, phone numbers, identity numbers and street addresses are found by form,
numbers also by what the words before them say (an order number is no phone
number). Names are found by form together with given names, learned by grouped
aggregation from a column of senders and completed by a table of short names.

Surrogates are keyed and made word by word, so that the same entity, however it is
written, gets the same one (coreference): a name agrees with its initials, its
other order and the email addresses that hold it, a phone number with its
international form. They are of the type and format: names keep script and case,
given names their gender (learned from endings), identity numbers have a valid
date and check digit, addresses keep the street's type. Entities that would share
a surrogate, or whose surrogate is a real entity, are drawn again until none does.

Defined cases: null and empty texts have no finding and stay as they are; long
texts are read whole; of findings that overlap the earlier and longer one counts;
repeated rows give equal findings; other columns are not read; an empty table has
no rows.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread
from .names import ADDRESS, LEGAL, NICKNAMES
from .symdelete import fold

#: Given names that are shipped to the workers; more are an error, none is left out.
MAX_GIVEN = 2_000_000
#: Different words that must follow a word for it to be a given name.
LEAST_LASTS = 5
#: A given name stands so many times more often before such a word than it is written small.
SELDOM = 2

_UP = "A-ZÀ-ÖØ-Þ"
# It begins where blanks begin, so that a long run of them is read once.
_BREAK = re.compile(r"(?<![^\S\n])[^\S\n]*\n[^\S\n]*|\r")
_EMAIL = re.compile(r"(?<![\w.+@-])[\w+-][\w.+-]*@[^\W_][\w-]*(?:\.[\w-]*[^\W_])+")
# A number wrapped at its hyphen has a blank behind it.
_PHONE = re.compile(
    r"(?<![\w+/.,-])(?:"
    r"\+1[ -] ?\(?\d{3}\)?[ -] ?\d{3}[ -] ?\d{4}"
    r"|\+44 (?:\d{4} \d{6}|\d{3} \d{3} \d{4}|\d{2} \d{4} \d{4})"
    r"|\+\d{2}[ -] ?\d{1,3}[ -] ?\d{2,3} \d{2} \d{2}"
    r"|\+\d{2} \d{1,3}(?: \d{2}){4}|\+\d{2} \d{3} \d{3} \d{3}|\+\d{2} \d{2,4} \d{5,8}"
    r"|00\d{2}[ -] ?\d{1,3}[ -] ?\d{3} \d{3} \d{2}|00\d{2}[ -] ?\d{1,3}[ -] ?\d{3} \d{2} \d{2}"
    r"|\(0\d{4}\) \d{3} \d{3}|\(0\d{3}\) \d{3} \d{4}|\(0\d{2}\) \d{4} \d{4}|\(0\d{1,3}\) \d{3} \d{2} \d{2}"
    r"|0\d{1,3}- ?\d{2,3} \d{2} \d{2}"
    r"|0\d{4} \d{6}|0\d{3} \d{3} \d{4}|0\d{2} \d{4} \d{4}"
    r"|0\d{9}"
    r")(?![\w/-]|[.,]\d)"
)
_IDNUM = re.compile(
    r"(?<![\w/.,+-])(?:(?:19|20)?\d{2}(?:0[1-9]|1[0-2])\d{2}(?:- ?|[ +])?\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![\w/-]|[.,]\d)"
)
_ADDRESS = re.compile(
    # number first: English and French
    rf"(?<![\w/.,-])(?:(?:Flat|Apt\.?|Apartment|Unit) \d+[A-Za-z]?, ?)?\d{{1,4}}[A-Za-z]? (?:[{_UP}][\w’'-]+ ){{1,3}}"
    r"(?:Street|Road|Lane|Avenue|Close|Drive|Court|Place|Way|Gardens|Crescent|Terrace|Square|Grove|Hill|Row|Mews|Walk)\b"
    rf"|(?<![\w/.,-])\d{{1,4}}(?: ?(?:bis|ter|[a-zA-Z]\b))?,? (?:rue|avenue|boulevard|chemin|place|allée|impasse|quai|route|cours|square)"
    rf"(?: (?:de|du|des|de la|de l’|de l'|la|le|les))*[ ’']?(?: ?[{_UP}][\w’'-]+){{1,3}}(?:,? (?:appt|app\.|apt|appartement)\.? ?\d+[A-Za-z]?)?"
    # number last: Spanish, the Nordic languages, German, Dutch
    rf"|\b(?:Calle|Avenida|Paseo|Plaza|Camino|Carrera|Ronda|Travesía)(?: (?:de|del|de la|de los|de las|la|el))*(?: [{_UP}][\w’'-]+){{1,3}},? \d{{1,4}}"
    r"(?:[a-z]\b| [A-Z]\b)?(?:, ?\d{1,2}\.?[ºª°o]?(?: ?[A-Z]\b| (?:izq|dcha)\b\.?)?)?"
    rf"|\b(?:(?:Am|An der|Im|In der|Auf der|Zum|Zur) [{_UP}][a-zäöüß-]+|(?:(?:Stora|Lilla|Norra|Södra|Östra|Västra|Gamla|Nya|Nieuwe|Oude|Sankt|Store|Lille|Alte|Neue) )?[{_UP}][\w’'-]*"
    r"(?:gatan|vägen|gränd|stigen|torget|allén|backen|platsen|väg|gata"
    r"|straße|strasse|weg|allee|gasse|platz|ring|ufer|damm"
    r"|vej|gade|stien|stræde|allé|torv|plads"
    r"|straat|laan|pad|plein|gracht|kade|singel|dreef))"
    r" \d{1,4}(?:[a-z]\b| [A-Z]\b)?(?:,? lgh\.? ?\d{3,4}|, ?\d{1,2}\. ?(?:tv|th|mf|sal)\b\.?|, ?st\. ?(?:tv|th|mf)\b)?"
)
_PART = r"(?:[^\W\d_]|[’'‐¬\u00ad-])+(?:(?<=[‐¬\u00ad-]) [a-zà-öø-ÿ]+)?(?!\w)"
_NAME = re.compile(
    rf"(?<![\w.@’'-])(?=(?P<a>[{_UP}](?:{_PART}|\.)?)(?P<comma>,?) (?P<middle>(?:[{_UP}]\.? ){{0,2}})(?P<b>[{_UP}]{_PART}))"
)
_FIRM = re.compile(
    rf"(?:(?: |, )[{_UP}&][\w’'&.-]*){{0,4}}(?: |, )(?:AB|Ltd|Limited|GmbH|ApS|SARL|PLC|Plc|Inc|LLC|AG|KG|BV|B\.V\.|NV|SA|S\.A\.|Oy|A/S|AS|KB|HB|Aktiebolag)\b"
)
_SMALL = re.compile(r"(?<!\w)[^\W\d_A-ZÀ-ÖØ-Þ][^\W\d_]{2,}(?!\w)")
_BEFORE = re.compile(r"([^\W\d_]+)[^\w]*$")
#: Words before a number that make it another kind of number. Fixed values.
OTHER_NUMBERS = frozenset(
    "order ordre auftrag bestelling commande pedido paket paquete parcel pakke pakket kolli colis quote serial meter "
    "organisationsnummer invoice faktura rechnung factura facture ref reference referens".split()
)
#: Words before a number that say it is an identity number. Fixed values.
ID_WORDS = frozenset(
    "no number nummer personnummer stod insurance cpr nin ssn id numéro número fødselsnummer burgerservicenummer bsn dni nie identity".split()
)


def luhn(digits: str) -> bool:
    """Is the last of ten digits the check digit of the others?"""
    total = 0
    for i, c in enumerate(digits[-10:]):
        x = int(c) * (2 - i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _word_before(text: str, at: int) -> str:
    found = _BEFORE.search(text[max(0, at - 30) : at])
    return found[1].lower() if found else ""


def _is_id(text: str, start: int, value: str) -> bool:
    before = _word_before(text, start)
    if before in OTHER_NUMBERS:
        return False
    if value[0].isalpha():
        return True
    digits = re.sub(r"\D", "", value)
    day = int(digits[-6:-4])
    if (1 <= day <= 31 or 61 <= day <= 91) and luhn(digits):
        return True
    # A made-up day or check digit is still one if the text calls it so.
    return before in ID_WORDS


_SPLIT = re.compile("[\u2010\u00ac\u00ad-] (?=[a-zà-öø-ÿ])")


def _shape_of_name(word: str) -> bool:
    word = _SPLIT.sub("", word)
    return len(word) >= 3 and (word[1:].islower() or word.isupper() or "-" in word)


def _key(word: str) -> str:
    return fold(_SPLIT.sub("", word))


def find_names(text: str, given: frozenset[str], common: frozenset[str]) -> Iterator[tuple[int, int]]:
    for m in _NAME.finditer(text):
        a, b, comma = m["a"], m["b"], m["comma"]
        start, end = m.start("a"), m.end("b")
        if fold(a) in ADDRESS:
            continue
        if comma:
            # Last, First
            if m["middle"] or _key(b) not in given or not _shape_of_name(a) or fold(a) in common or _key(a) in given:
                continue
        elif len(a.rstrip(".")) == 1:
            if not _shape_of_name(b) or fold(b) in common or _key(b) in given or b.isupper():
                continue
            if start and re.search(r"(?:\d|\b[A-Z])\s?$", text[max(0, start - 3) : start]):
                continue
            if not a.endswith("."):
                continue
        else:
            if _key(a) not in given or not _shape_of_name(b) or fold(b) in common:
                continue
            if _key(b) in given and not m["middle"]:
                # Two given names: the second must not begin a name of its own.
                follow = re.match(rf" (?:[{_UP}]\. )?([{_UP}][\w’'-]+)", text[end : end + 40])
                if follow and fold(follow[1]) not in common:
                    end += follow.end()
        if b in LEGAL or fold(b) in LEGAL or _FIRM.match(text, end):
            continue
        yield start, end


def find_all(text: str, given: frozenset[str], common: frozenset[str]) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` in ``text`` whose line breaks are single blanks."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15 and _word_before(text, m.start()) not in OTHER_NUMBERS | ID_WORDS:
            found.append((m.start(), m.end(), "phone"))
    found += [(m.start(), m.end(), "idnum") for m in _IDNUM.finditer(text) if _is_id(text, m.start(), m[0])]
    found += [(m.start(), m.end(), "address") for m in _ADDRESS.finditer(text)]
    found += [(s, e, "name") for s, e in find_names(text, given, common)]
    found.sort(key=lambda x: (x[0], -x[1]))
    kept: list[tuple[int, int, str]] = []
    for x in found:
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def unbroken(text: str) -> str:
    """Each line break, with the blanks around it, as one blank."""
    return _BREAK.sub(" ", text)


def learn_given(notes: DataFrame, sender: str = "correspondent", text: str = "summary") -> frozenset[str]:
    """Given names: capitalised words of senders and running text that stand before
    at least ``LEAST_LASTS`` different such words outside of firms' names. Shares
    over all rows tell them from other words, so that a table and ten copies of it,
    or a town where all have one surname, are judged alike: a given name is seldom
    written small, stands more often before such a word than behind one, and is
    seldom followed by another given name (as verbs and headings are)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs: Counter[tuple[str, str]] = Counter()
            for value in batch.column(0).to_pylist():
                value = unbroken(value)
                for m in _NAME.finditer(value):
                    a, b = m["a"], m["b"]
                    if m["comma"] or len(a.rstrip(".")) < 3 or not _shape_of_name(a) or not _shape_of_name(b):
                        continue
                    if fold(a) in COMMON or fold(b) in LEGAL or _FIRM.match(value, m.end("b")) or fold(a) in ADDRESS:
                        continue
                    pairs[_key(a), _key(b)] += 1
                # A small word is told by an empty second part.
                pairs.update((w, "") for w in _SMALL.findall(value))
            columns = list(zip(*((a, b, n) for (a, b), n in pairs.items()))) or [(), (), ()]
            kinds = [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["first", "last", "n"])

    both = notes.select(F.col(sender).alias("t")).union(notes.select(F.col(text).alias("t"))).filter("t is not null")
    counted = spread(both).mapInArrow(run, "first string, last string, n bigint").groupBy("first", "last").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "pairs")
    pairs = counted.filter("last <> ''")
    small = counted.filter("last = ''").select(F.col("first").alias("word"), F.col("n").alias("small"))
    behind = pairs.groupBy(F.col("last").alias("word")).agg(F.sum("n").alias("behind"))
    before = pairs.groupBy(F.col("first").alias("word")).agg(F.countDistinct("last").alias("lasts"), F.sum("n").alias("before"))
    firsts = materialize(
        before.filter(F.col("lasts") >= LEAST_LASTS)
        .join(behind, "word", "left")
        .join(small, "word", "left")
        .filter((F.coalesce("behind", F.lit(0)) < F.col("before")) & (F.coalesce("small", F.lit(0)) * SELDOM < F.col("before")))
        .select("word", "before"),
        "firsts",
    )
    known = {n for names in NICKNAMES.values() for n in names.split()} | set(NICKNAMES)
    short = notes.sparkSession.createDataFrame([(n,) for n in sorted(known)], "last string")
    given = firsts.select(F.col("word").alias("last")).union(short).distinct()
    led = (
        pairs.join(given, "last")
        .groupBy(F.col("first").alias("word"))
        .agg(F.sum("n").alias("given"))
        .join(firsts, "word")
        .filter(F.col("given") * 3 > F.col("before"))
    )
    kept = firsts.join(led, "word", "left_anti").select("word").limit(MAX_GIVEN + 1).collect()
    if len(kept) > MAX_GIVEN:
        raise ValueError(f"more than {MAX_GIVEN} given names")
    return frozenset({r["word"] for r in kept} | known) - frozenset(LEGAL)


#: Capitalised words that are no surnames: they begin sentences or follow names. Fixed values.
COMMON = frozenset(
    "the and for after according following order unless please we our your this that to as in of on at is was flat street road lane avenue close "
    "och att enligt efter order vi som det den brevet under från nach wie gemäß aufgrund im das der die und auftrag selon comme la le les el los de van het "
    "op na ordre for som efter på svar i bestelling zoals volgens january february march april may june july august september october november december".split()
)


def _texts(df: DataFrame, src: str, key: str, text: str) -> DataFrame:
    return df.select(F.lit(src).alias("src"), F.col(key).cast("long").alias("row_id"), F.col(text).alias("text"))


def vault_texts(extracts: DataFrame, notes: DataFrame) -> DataFrame:
    return _texts(extracts, "extract_results", "extract_id", "text").unionByName(_texts(notes, "document_meta", "note_id", "summary"))


_FOUND = "src string, row_id bigint, kind string, value string, start int, end int"


def _found_batch(batch: pa.RecordBatch, names: frozenset[str]) -> list[tuple]:
    rows = []
    for s, i, t in zip(*(batch.column(c).to_pylist() for c in range(3))):
        if t:
            t = unbroken(t)
            rows += [(s, i, kind, t[a:b], a, b) for a, b, kind in find_all(t, names, COMMON)]
    return rows


def findings(texts: DataFrame, given: frozenset[str]) -> DataFrame:
    """``(src, row_id, kind, value, start, end)``; positions refer to the text with unbroken lines."""
    shipped = texts.sparkSession.sparkContext.broadcast(given)  # at most MAX_GIVEN names and the short-name table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shipped.value
        for batch in batches:
            columns = list(zip(*_found_batch(batch, names))) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["src", "row_id", "kind", "value", "start", "end"])

    return spread(texts).mapInArrow(run, _FOUND)


# --- surrogates ---------------------------------------------------------------

#: Given names of women and of men, from which the endings that tell gender are learned. Fixed values.
FEMALE = (
    "anna maria eva karin sara lena kerstin marie ingrid christina linda birgitta emma hanna susanne elisabeth katherine rebecca victoria "
    "patricia helene ulrika margareta pernille tove vera zoe asa julia laura sofia claire camille isabel carmen lucia greta heidi ursula "
    "petra anja femke sanne lotte mette hanne kirsten nadia olga natalia irina"
).split()
MALE = (
    "john james robert michael william david thomas peter lars karl nils erik anders johan fredrik olof goran soren yngve jorg walter samuel "
    "daniel alexander edward anthony johannes inigo hans klaus stefan jurgen uwe pierre jean luc marc carlos jose miguel juan antonio "
    "jan pieter willem jens henrik mads niels rasmus ivan igor sergej dmitrij"
).split()
#: Vowels, consonants and endings by gender of the scripts that names are made up in. Fixed values.
SCRIPTS = {
    "LATIN": ("aeiou", "bdfgklmnprstv", ("a", "ia", "ina"), ("o", "us", "an")),
    "CYRILLIC": ("аеиоу", "бвгдзклмнпрст", ("а", "ия", "ина"), ("ий", "ов", "ан")),
    "GREEK": ("αειου", "βγδκλμνπρστ", ("α", "ια", "ινα"), ("ος", "ης", "ας")),
}
#: Words in the local part of an address that name no person. Fixed values.
ROLES = frozenset("info post mail kontakt contact office support service kundtjanst noreply www".split())
#: Parts of addresses that say what kind of place it is. Fixed values.
PLACE_WORDS = frozenset(
    "street road lane avenue close drive court place way gardens crescent terrace square grove hill row mews walk flat apt apartment unit "
    "rue boulevard chemin allée impasse quai route cours de du des la le les bis ter appt app appartement "
    "calle avenida paseo plaza camino carrera ronda travesía del los las el izq dcha am an der im in auf dem zum zur "
    "stora lilla norra södra östra västra gamla nya nieuwe oude sankt store lille alte neue lgh tv th mf sal st väg gata weg allee platz ring "
    "vej gade allé torv plads straat laan plein".split()
)
_STREET_END = re.compile(
    "(gatan|vägen|gränd|stigen|torget|allén|backen|platsen|väg|gata|straße|strasse|weg|allee|gasse|platz|ring|ufer|damm|vej|gade|stien|stræde|allé|torv|plads"
    "|straat|laan|pad|plein|gracht|kade|singel|dreef)$"
)
_WORD = re.compile(r"[^\W\d_]+")
#: Rounds of drawing again after which something is wrong.
MOST_ROUNDS = 60
#: Entities drawn again that are shipped to the workers; more are joined.
MAX_REDRAWN = 200_000


@lru_cache(maxsize=1)
def _endings() -> dict[str, float]:
    """Log-odds that a name of this ending is a woman's."""
    women, men = (Counter(n[-k:] for n in names for k in (1, 2)) for names in (FEMALE, MALE))
    return {e: math.log((women[e] + 0.5) / (men[e] + 0.5)) for e in women.keys() | men.keys()}


@lru_cache(maxsize=100_000)
def is_female(given: str) -> bool:
    """Gender of a folded given name: by the tables, else by its ending."""
    if given in FEMALE or given in MALE:
        return given in FEMALE
    odds = _endings()
    return odds.get(given[-2:], 0.0) + odds.get(given[-1:], 0.0) > 0


def script_of(word: str) -> str:
    return unicodedata.name(word[0], "").split(" ", 1)[0]


class Draw:
    """Numbers that follow from a key."""

    def __init__(self, secret: str, *parts: object):
        self.seed = hmac.new(secret.encode(), "\0".join(map(str, parts)).encode(), hashlib.sha256).digest()
        self.left = int.from_bytes(self.seed, "big")

    def __call__(self, n: int) -> int:
        if self.left < 1 << 64:
            self.seed = hashlib.sha256(self.seed).digest()
            self.left = int.from_bytes(self.seed, "big")
        self.left, x = divmod(self.left, n)
        return x


@lru_cache(maxsize=1_000)
def _initial(secret: str, letter: str) -> str:
    """The letter that stands for an initial: a permutation of the script's, vowels among vowels.

    So an initial and the name it stands for agree, and different initials differ.
    """
    vowels, consonants, *_ = SCRIPTS.get(script_of(letter), SCRIPTS["LATIN"])
    every = "bcdfghjklmnpqrstvwxz" if script_of(letter) == "LATIN" else consonants
    for group in ("aeiouy" if script_of(letter) == "LATIN" else vowels, every):
        if letter in group:
            order = list(group)
            draw = Draw(secret, "initial", group)
            for i in range(len(order) - 1, 0, -1):
                j = draw(i + 1)
                order[i], order[j] = order[j], order[i]
            return order[group.index(letter)]
    return letter


def made_word(word: str, given: bool, secret: str, attempt: int, longer: int | None = None) -> str:
    """A word of a name, folded, made up anew: same script, its initial mapped, ending by gender if a given name.

    Words of scripts that have no letters here are moved within their script's letters.
    """
    draw = Draw(secret, "word", word, attempt)
    script = script_of(word)
    if word.isdigit():
        return "".join(str(draw(10)) for _ in range(len(word) + (attempt + 1) // 2))
    if script not in SCRIPTS:
        first = ord(word[0]) & ~31
        letters = [c for c in map(chr, range(first, first + 32)) if c.isalpha() and unicodedata.name(c, "").startswith(script)]
        return "".join(letters[draw(len(letters))] if c.isalpha() else str(draw(10)) if c.isdigit() else c for c in word)
    vowels, consonants, women, men = SCRIPTS[script]
    out = _initial(secret, word[0]) if word[0].isalpha() else str(draw(10))
    ending = (women if is_female(word) else men)[draw(3)] if given else ""
    size = max(4, min(len(word), 10)) - len(ending) + ((attempt + 1) // 2 if longer is None else longer)
    while len(out) < size:
        pool = consonants if out[-1] in vowels or out[-1] in "yéèê" else vowels
        out += pool[draw(len(pool))]
    if ending and (out[-1] in vowels) == (ending[0] in vowels):
        out += (consonants if ending[0] in vowels else vowels)[draw(5)]
    out += ending
    # Figures stay figures.
    return out + "".join(str(draw(10)) for c in word[1:] if c.isdigit())


def national(phone: str) -> str:
    """The figures of a number without country code and trunk prefix."""
    digits = re.sub(r"\D", "", phone)
    if phone.lstrip("(").startswith("+") or digits.startswith("00"):
        digits = digits.removeprefix("00")
        digits = digits[1:] if digits.startswith("1") else digits[2:]
    return digits.removeprefix("0")


def made_phone(number: str, secret: str, attempt: int) -> str:
    """A national number of the same area; where that is full, of one nearby."""
    draw = Draw(secret, "phone", number, attempt)
    kept = 2 if attempt < 8 else 1 if attempt < 16 else 0
    return number[:kept] + "".join(str(draw(10)) for _ in number[kept:])


def check_digit(nine: str) -> str:
    return next(str(d) for d in range(10) if luhn(nine + str(d)))


def made_id(entity: str, secret: str, attempt: int) -> str:
    """Ten figures with a valid date and check digit, the figure of the gender kept odd or even; or letters, six figures and a letter."""
    draw = Draw(secret, "idnum", entity, attempt)
    if entity[0].isalpha():
        letters = "ABCEGHJKLMNPRSTWXYZ"
        return letters[draw(19)] + letters[draw(19)] + f"{draw(10**6):06d}" + "ABCD"[draw(4)]
    day = 1 + draw(28) + 60 * (int(entity[4:6]) > 60)
    nine = f"{1 + draw(99):02d}{1 + draw(12):02d}{day:02d}{draw(100):02d}{2 * draw(5) + int(entity[8]) % 2}"
    return nine + check_digit(nine)


def address_key(value: str) -> str:
    return re.sub(r"\W+", " ", fold(value)).strip()


def made_address(value: str, entity: str, secret: str, attempt: int) -> str:
    """Street type, number format and the words for the flat stay; the street's own name and the figures change."""
    draw = Draw(secret, "address", entity, attempt)

    def word(m: re.Match) -> str:
        w = m[0]
        low = w.lower()
        if low in PLACE_WORDS or len(w) < 3:
            return w
        end = _STREET_END.search(low)
        own = low[: end.start()] if end else low
        if not own:
            return w
        return _cased(made_word(fold(own), False, secret, draw(1 << 30), 0) + low[len(own) :], w)

    def figures(m: re.Match) -> str:
        return str(1 + draw(9)) + "".join(str(draw(10)) for _ in m[0][1:])

    return re.sub(r"\d+", figures, _WORD.sub(word, value))


def name_parts(value: str) -> list[tuple[int, int, str]]:
    """``(start, end, role)`` of the words of a name: given, initial or surname."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(value)]
    comma = value.find(",")
    last = [i for i, (s, _) in enumerate(words) if s < comma] if comma >= 0 else [len(words) - 1]
    # Of a hyphenated surname all words are one.
    if comma < 0:
        while last[0] > 0 and value[words[last[0]][0] - 1] in "-‐":
            last.insert(0, last[0] - 1)
    return [(s, e, "initial" if e - s == 1 else "surname" if i in last else "given") for i, (s, e) in enumerate(words)]


def entities(kind: str, value: str) -> list[tuple[str, str]]:
    """``(kind, entity)``: what a finding is made of. However an entity is written, it is the same here.

    A name is its words, so that it agrees with its initials, its other order
    and the addresses that hold it; a phone number is the national number.
    """
    if kind == "name":
        value = _SPLIT.sub("", value)
        return [("given" if role == "given" else "word", fold(value[s:e])) for s, e, role in name_parts(value) if role != "initial"]
    if kind == "email":
        local, _, host = value.partition("@")
        words = re.findall(r"[^\W_]+", fold(local)) + re.findall(r"[^\W_]+", fold(host))[:-1]
        return [("word", w) for w in words if w not in ROLES and len(w) > 1]
    if kind == "phone":
        return [("phone", national(value))]
    if kind == "idnum":
        return [("idnum", re.sub(r"\W", "", value).upper()[-10:])]
    return [("address", address_key(value))]


def made(kind: str, entity: str, value: str, secret: str, attempt: int) -> str:
    """What an entity is written as, in the form in which clashes are looked for."""
    if kind in ("given", "word"):
        return made_word(entity, kind == "given", secret, attempt)
    if kind == "phone":
        return made_phone(entity, secret, attempt)
    if kind == "idnum":
        return made_id(entity, secret, attempt)
    return address_key(made_address(value, entity, secret, attempt))


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word


def _filled(value: str, figures: str) -> str:
    """``value`` with its last letters and figures replaced by those of ``figures``."""
    out, left = [], list(figures)
    for c in reversed(value):
        out.append(left.pop() if c.isalnum() and left else c)
    return "".join(reversed(out))


def surrogate(kind: str, value: str, secret: str, attempts: dict[tuple[str, str], int] | None = None, given: frozenset[str] = frozenset()) -> str:
    """A replacement of the same type and format, the same for the same entity and key.

    ``attempts``: how often the entities that clashed were drawn again.
    """
    tries = attempts or {}

    def word(text: str, is_given: bool) -> str:
        entity = fold(text)
        k = "given" if is_given else "word"
        return _cased(made_word(entity, is_given, secret, tries.get((k, entity), 0)), text)

    if kind == "name":
        value = _SPLIT.sub("", value)
        out, at = [], 0
        for s, e, role in name_parts(value):
            w = value[s:e]
            out += [value[at:s], _cased(_initial(secret, fold(w)), w).upper() if role == "initial" else word(w, role == "given")]
            at = e
        return "".join(out) + value[at:]
    if kind == "email":

        def part(m: re.Match) -> str:
            w = m[0]
            return w if fold(w) in ROLES or len(w) < 2 else word(w, fold(w) in given)

        local, _, host = value.partition("@")
        names, dot, suffix = host.rpartition(".")
        return re.sub(r"[^\W_]+", part, local) + "@" + re.sub(r"[^\W_]+", lambda m: m[0] if fold(m[0]) in ROLES else word(m[0], False), names) + dot + suffix
    ((k, entity),) = entities(kind, value)
    attempt = tries.get((k, entity), 0)
    if kind == "address":
        return made_address(value, entity, secret, attempt)
    return _filled(value, made(k, entity, value, secret, attempt))


def drawn_entities(found: DataFrame, secret: str, given: frozenset[str]) -> DataFrame:
    """``(kind, entity, value, attempt, made)``: every entity of the findings and its surrogate, no two alike and none a real one.

    Of entities that drew the same the least keeps it, the others draw again, as
    does one that drew what another entity really is; until nothing clashes.
    """
    spark = found.sparkSession
    shipped = spark.sparkContext.broadcast(given)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = shipped.value
        for pdf in batches:
            rows = []
            for kind, value in zip(pdf["kind"], pdf["value"]):
                for k, e in entities(kind, value):
                    rows.append(("given" if kind == "email" and e in names else k, e, value if kind == "address" else ""))
            yield pd.DataFrame(rows, columns=["kind", "entity", "value"])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(made=[made(k, e, v, secret, int(a)) for k, e, v, a in zip(pdf["kind"], pdf["entity"], pdf["value"], pdf["attempt"])])

    schema = "kind string, entity string, value string, attempt int, made string"
    parts = found.select("kind", "value").distinct().mapInPandas(split, "kind string, entity string, value string")
    drawn = parts.groupBy("kind", "entity").agg(F.min("value").alias("value")).withColumn("attempt", F.lit(0))
    drawn = materialize(drawn.mapInPandas(draw, schema), "entities")
    # Given names and other words are one kind where they are read.
    space = F.when(F.col("kind") == "given", "word").otherwise(F.col("kind"))
    real = drawn.select(space.alias("space"), F.col("entity").alias("made")).distinct()
    for _ in range(MOST_ROUNDS):
        rows = drawn.withColumn("space", space)
        keeps = rows.groupBy("space", "made").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "entity", "kind")).alias("first")).filter("n > 1")
        twice = rows.join(keeps, ["space", "made"]).filter((F.col("entity") != F.col("first.entity")) | (F.col("kind") != F.col("first.kind")))
        taken = rows.join(real, ["space", "made"], "left_semi")
        again = materialize(twice.select("kind", "entity").union(taken.select("kind", "entity")).distinct().withColumn("more", F.lit(1)), "clashes")
        if again.isEmpty():
            return drawn
        redrawn = drawn.join(again, ["kind", "entity"]).select("kind", "entity", "value", (F.col("attempt") + 1).alias("attempt"))
        drawn = materialize(drawn.join(again, ["kind", "entity"], "left_anti").select(*schema_names(schema)).unionByName(redrawn.mapInPandas(draw, schema)), "entities")
    raise RuntimeError("surrogates still clash")


def schema_names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def pseudonyms(found: DataFrame, secret: str, given: frozenset[str]) -> DataFrame:
    """The findings with ``surrogate``, distinct and the same wherever an entity stands."""
    found = materialize(found, "findings")
    drawn = drawn_entities(found, secret, given)
    again = drawn.filter("attempt > 0").select("kind", "entity", "attempt")
    schema = f"{_FOUND}, surrogate string"
    few = again.limit(MAX_REDRAWN + 1).collect()
    if len(few) <= MAX_REDRAWN:
        shipped = found.sparkSession.sparkContext.broadcast(({(r["kind"], r["entity"]): r["attempt"] for r in few}, given))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            attempts, names = shipped.value
            seen: dict[tuple[str, str], str] = {}
            for pdf in batches:
                out = []
                for pair in zip(pdf["kind"], pdf["value"]):
                    if (made := seen.get(pair)) is None:
                        made = surrogate(*pair, secret, attempts, names)
                        if len(seen) < 100_000:
                            seen[pair] = made
                    out.append(made)
                yield pdf.assign(surrogate=out)

        return found.mapInPandas(run, schema)
    # Too many to ship: each distinct finding meets the attempts of its parts.
    names = found.sparkSession.sparkContext.broadcast(given)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (k, v, "given" if k == "email" and e in names.value else part, e) for k, v in zip(pdf["kind"], pdf["value"]) for part, e in entities(k, v)
            ]
            yield pd.DataFrame(rows, columns=["kind", "value", "part", "entity"])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tries = [{(t["part"], t["entity"]): t["attempt"] for t in ts} for ts in pdf["tries"]]
            made = [surrogate(k, v, secret, t, names.value) for k, v, t in zip(pdf["kind"], pdf["value"], tries)]
            yield pd.DataFrame({"kind": pdf["kind"], "value": pdf["value"], "surrogate": made})

    values = found.select("kind", "value").distinct()
    parts = values.mapInPandas(split, "kind string, value string, part string, entity string").distinct()
    tried = parts.join(again.withColumnRenamed("kind", "part"), ["part", "entity"], "left").groupBy("kind", "value").agg(
        F.collect_list(F.struct("part", "entity", F.coalesce("attempt", F.lit(0)).alias("attempt"))).alias("tries")
    )
    return found.join(tried.mapInPandas(write, "kind string, value string, surrogate string"), ["kind", "value"]).select(*schema_names(schema))


def put(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with ``(start, end, by)`` replaced; positions refer to unbroken lines."""
    starts, shift = [], 0
    for m in _BREAK.finditer(text):
        starts.append((m.start() - shift, m.end() - m.start() - 1))
        shift += m.end() - m.start() - 1
    out, at, k, moved = [], 0, 0, 0
    for start, end, by in spans:
        while k < len(starts) and starts[k][0] < start:
            moved += starts[k][1]
            k += 1
        out.append(text[at : start + moved])
        while k < len(starts) and starts[k][0] < end:
            moved += starts[k][1]
            k += 1
        out.append(by)
        at = end + moved
    return "".join(out) + text[at:]


def placeholders(texts: DataFrame, given: frozenset[str]) -> DataFrame:
    """``(src, row_id, text)`` with each finding replaced by its type ([EMAIL], [PHONE], ...).

    One pass over the texts, without a shuffle. The text around is unchanged but
    for line breaks inside a finding.
    """
    shipped = texts.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                put(t, [(a, b, f"[{kind.upper()}]") for a, b, kind in find_all(unbroken(t), shipped.value, COMMON)]) if t else t
                for t in batch.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["src", "row_id", "text"])

    return spread(texts).mapInArrow(run, "src string, row_id bigint, text string")


def pseudonymise(texts: DataFrame, given: frozenset[str], secret: str) -> DataFrame:
    """``(src, row_id, text)`` with each finding replaced by its surrogate.

    The texts are read twice and never shuffled: once for the findings, whose
    entities are drawn and checked, once to write the surrogates. Only if more
    than ``MAX_REDRAWN`` entities clashed do the surrogates travel to their rows.
    """
    found = materialize(findings(texts, given), "findings")
    again = drawn_entities(found, secret, given).filter("attempt > 0").select("kind", "entity", "attempt").limit(MAX_REDRAWN + 1).collect()
    if len(again) > MAX_REDRAWN:
        per_row = pseudonyms(found, secret, given).groupBy("src", "row_id").agg(F.array_sort(F.collect_set(F.struct("start", "end", "surrogate"))).alias("spans"))

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = [[(x["start"], x["end"], x["surrogate"]) for x in xs or ()] for xs in batch.column(3).to_pylist()]
                out = [put(t, xs) if t and xs else t for t, xs in zip(batch.column(2).to_pylist(), spans)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["src", "row_id", "text"])

        joined = texts.join(per_row, ["src", "row_id"], "left").select("src", "row_id", "text", "spans")
        return joined.mapInArrow(write, "src string, row_id bigint, text string")
    shipped = texts.sparkSession.sparkContext.broadcast(({(r["kind"], r["entity"]): r["attempt"] for r in again}, given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempts, names = shipped.value
        for batch in batches:
            out = []
            for t in batch.column(2).to_pylist():
                if t:
                    flat = unbroken(t)
                    t = put(t, [(a, b, surrogate(kind, flat[a:b], secret, attempts, names)) for a, b, kind in find_all(flat, names, COMMON)])
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["src", "row_id", "text"])

    return spread(texts).mapInArrow(run, "src string, row_id bigint, text string")


def vault_pseudonyms(extracts: DataFrame, notes: DataFrame, secret: str) -> DataFrame:
    """Findings of the vault's texts with their surrogates; p6_found are its rows."""
    given = learn_given(notes)
    return pseudonyms(findings(vault_texts(extracts, notes), given), secret, given)
