"""Readability of a text as column expressions: counts, score and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fold, strip

SAMPLE_CHARS = 250_000
#: Limits of the verdict and of the density cap. Fixed values.
THIN_BELOW, GIBBERISH_BELOW, GOOD_FROM, CHARS_PER_PAGE = 60, 0.25, 0.45, 400
#: Frequent words of several languages, folded. A parameter; this default is ours.
COMMON_WORDS = tuple(
    "the and that for was with this are not you your from have has will been our which all any when would "
    "och att det som den har inte med till fran var vid eller enligt efter under vart samt "
    "der die das und ist nicht mit von auf ein eine wir sie bei wurde fur sind nach oder "
    "les des est une pour dans que qui pas sur avec aux vous nous par votre notre sont "
    "los las del por para con sus una este esta como mas hasta sobre "
    "het een van voor zijn ook als met niet aan uit bij door "
    "til blev blevet vores din hvis fra selv "
    "date invoice amount payment account page reference total due letter number "
    "faktura datum belopp betalning konto sida nummer rechnung betrag konto seite montant facture compte importe cuenta bedrag".split()
)


def tokens(sample: Column) -> Column:
    return F.regexp_extract_all(sample, F.lit(r"[\p{L}\p{N}]+"), 0)


def is_word(t: Column) -> Column:
    """Has a token the shape of a word of some language?"""
    f = fold(t)
    n = F.length(f)
    inner = F.length(F.regexp_replace(F.substring(t, F.lit(2), F.length(t)), r"[^\p{Lu}]", ""))
    return t.rlike(r"^\p{L}+$") & (n <= 30) & F.when(n == 1, f.isin("a", "i")).when(
        ~f.rlike("[aeiouy]"), (n <= 4) & t.rlike(r"^\p{Lu}")
    ).otherwise(
        ~f.rlike(r"(.)\1{3,}") & ~f.rlike("[bcdfghjklmnpqrstvwxz]{5,}") & ~((F.length(t) > 2) & (t != F.upper(t)) & (inner > 1))
    )


def is_garbled(t: Column) -> Column:
    """Do figures run through a token rather than after it?"""
    return ~t.rlike(r"^\p{L}+$") & ~t.rlike(r"^\p{Nd}+$") & (F.size(F.regexp_extract_all(t, F.lit(r"\p{L}+|\p{Nd}+"), 0)) >= 3)


def quality_counts(df: DataFrame, text: str = "text", common: tuple[str, ...] = COMMON_WORDS) -> DataFrame:
    """``df`` with the counts ``q_*`` that the score is made of; one projection, no shuffle."""
    wanted = F.array(*[F.lit(w) for w in sorted(set(common))])
    sample = F.substring(strip(F.coalesce(F.col(text), F.lit(""))), 1, SAMPLE_CHARS)
    t = F.col("q_tokens")
    return (
        df.withColumn("q_sample", sample)
        .withColumn("q_tokens", tokens(F.col("q_sample")))
        .withColumns(
            {
                "q_chars": F.length("q_sample").cast("long"),
                "q_letters": F.length(F.regexp_replace("q_sample", r"[^\p{L}]", "")).cast("long"),
                "q_dense": F.length(F.regexp_replace("q_sample", r"[\s\p{Z}]", "")).cast("long"),
                "q_alpha": F.size(F.filter(t, lambda x: x.rlike(r"^\p{L}+$"))).cast("long"),
                "q_words": F.size(F.filter(t, is_word)).cast("long"),
                "q_garbled": F.size(F.filter(t, is_garbled)).cast("long"),
                "q_common": F.size(F.filter(t, lambda x: (F.length(x) >= 3) & F.array_contains(wanted, fold(x)))).cast("long"),
                "q_countable": F.size(F.filter(t, lambda x: F.length(x) > 1)).cast("long"),
                "q_all": F.size(t).cast("long"),
            }
        )
        .drop("q_sample", "q_tokens")
    )


def _ratio(a: str, b: Column | str) -> Column:
    b = F.col(b) if isinstance(b, str) else b
    return F.when(b > 0, F.col(a) / b).otherwise(0.0)


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def score(pages: Column) -> Column:
    """The score of a row with ``q_*`` counts."""
    letter = _ratio("q_letters", "q_dense")
    word = _ratio("q_words", F.col("q_alpha") + F.col("q_garbled"))
    common = _ratio("q_common", "q_countable")
    garbled = _ratio("q_garbled", "q_all")
    blend = 0.50 * word + 0.25 * _clamp((letter - 0.30) / 0.45) + 0.25 * _clamp(common / 0.12)
    s = blend * (1 - F.least(2 * garbled, F.lit(0.6)))
    density = F.col("q_chars") / F.when(pages > 0, pages)
    s = F.when((pages > 0) & (F.col("q_chars") < SAMPLE_CHARS), F.least(s, 0.25 + 0.75 * _clamp(density / CHARS_PER_PAGE))).otherwise(s)
    s = F.when((F.col("q_common") == 0) & (letter >= 0.6) & (F.col("q_countable") >= 15), F.least(s, F.lit(0.4))).otherwise(s)
    s = F.when((word < 0.1) & (F.col("q_common") == 0), F.least(s, F.lit(0.05))).otherwise(s)
    return F.when(F.col("q_chars") == 0, 0.0).otherwise(s)


def verdict(s: Column) -> Column:
    return (
        F.when(F.col("q_chars") == 0, "empty")
        .when(F.col("q_chars") < THIN_BELOW, "thin")
        .when(s < GIBBERISH_BELOW, "gibberish")
        .when(s < GOOD_FROM, "poor")
        .otherwise("good")
    )


def score_texts(df: DataFrame, key: str, text: str = "text", pages: str | None = "pages") -> DataFrame:
    """``(key, score_milli, verdict, chars, words, common, garbled, reasons)`` for every row."""
    counted = quality_counts(df.select(key, text, *( [pages] if pages else [])), text)
    p = F.col(pages) if pages else F.lit(None).cast("int")
    scored = counted.withColumn("s", score(p))
    word = _ratio("q_words", F.col("q_alpha") + F.col("q_garbled"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("q_words") == 0, "no word-shaped tokens").when(word < 0.6, "few tokens look like words"),
            F.when(F.col("q_common") == 0, "no common words"),
            F.when(_ratio("q_letters", "q_dense") < 0.6, "few characters are letters"),
            F.when(_ratio("q_garbled", "q_all") >= 0.05, "digits inside words"),
        )
    )
    return scored.select(
        key,
        F.round(F.col("s") * 1000).cast("int").alias("score_milli"),
        verdict(F.col("s")).alias("verdict"),
        F.col("q_chars").alias("chars"),
        F.col("q_words").alias("words"),
        F.col("q_common").alias("common"),
        F.col("q_garbled").alias("garbled"),
        F.array_join(reasons, ", ").alias("reasons"),
    )
