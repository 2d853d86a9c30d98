"""Text measures as Column expressions: words, tokens, n-grams, sentences, syllables, facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import count_of, find_all

WORD = r"[\p{L}\p{N}_]+"

# What counts as a number, a year and a proper-name run (Polish capitals, as the measures define).
NUMBER_WITH_UNIT = r"(?U)\b\d+(?:[.,]\d+)?(?:%|°C|°F|kg|mg|μg|ng|min|sek|h|ms|mm|cm|m|km|x)?\b"
NUMBER_WITH_UNIT_KEYWORDS = r"(?U)\b\d+(?:[.,]\d+)?(?:%|°C|°F|kg|mg|μg|min|sek|h|ms|mm|cm|m|km|x)?\b"
PLAIN_NUMBER = r"(?U)\b\d+(?:[.,]\d+)?\b"
YEAR = r"(?U)\b(19|20)\d{2}\b"
CAPITALISED = r"(?U)\b[A-ZĄĆĘŁŃÓŚŹŻ][a-ząćęłńóśźż]+"
PROPER_RUN = CAPITALISED + r"(?:\s+[A-ZĄĆĘŁŃÓŚŹŻ][a-ząćęłńóśźż]+){1,3}"


@dataclass(frozen=True)
class Readability:
    """What a language needs for sentence and syllable counting."""

    name: str
    vowels: str
    capitals: str
    abbreviations: tuple[str, ...]


# Polish vowels (ź and ż count as vowels in the measure), capitals and 31 abbreviations.
POLISH = Readability(
    name="pl",
    vowels="aąeęioóuyźż",
    capitals="A-ZĄĆĘŁŃÓŚŹŻ",
    abbreviations=(
        "np", "tj", "tzn", "tzw", "wg", "ok", "dr", "mgr", "prof", "inż", "płk", "gen", "ul", "al", "pl", "nr",
        "rok", "wiek", "godz", "min", "sek", "kg", "mln", "mld", "tys", "in", "et", "vs", "etc", "z.o.o", "S.A",
    ),
)
# Fallback for other Latin-script languages: generic vowels, any capital, no abbreviations.
LATIN = Readability(
    name="latin", vowels="aàáâãäåąeèéêëęiìíîïoòóôõöøuùúûüyýÿ", capitals=r"\p{Lu}", abbreviations=()
)


#: Rules by language code; other languages take ``LATIN``.
READABILITY = {"pl": POLISH}


def by_language(lang: Column, measure) -> Column:
    """``measure(rules)`` by the row's language, with the fallback for languages without rules of their own."""
    out = None
    for code, rules in READABILITY.items():
        out = F.when(lang == code, measure(rules)) if out is None else out.when(lang == code, measure(rules))
    return out.otherwise(measure(LATIN))


def rule_name(lang: Column) -> Column:
    """Which rules ``by_language`` takes."""
    return by_language(lang, lambda rules: F.lit(rules.name))


def words(text: Column) -> Column:
    return find_all(text, WORD)


def word_count(text: Column) -> Column:
    return count_of(text, WORD)


def space_tokens(text: Column) -> Column:
    """White-space separated tokens, none empty."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def first_tokens(text: Column, n: int) -> Column:
    return F.array_join(F.slice(space_tokens(text), 1, n), " ")


def tokens(text: Column, stopwords) -> Column:
    """Lower-case words of three letters or more that are neither stop-words nor all digits."""
    lowered = F.transform(words(text), F.lower)
    return F.filter(
        lowered,
        lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\p{Nd}+$") & ~w.isin(*stopwords),
    )


def ngrams(line: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring tokens of a line of tokens joined by single spaces, overlapping, in order.

    One regex pass with a look-ahead per token start; several times faster than array lambdas, which are interpreted.
    """
    return find_all(line, rf"(?<![^ ])(?=({' '.join(['[^ ]++'] * n)}))", 1)


def ngrams_upto3(toks: Column, line: Column) -> Column:
    """1-grams, then 2-grams, then 3-grams, each in text order; ``line`` is the tokens joined by spaces."""
    return F.concat(toks, ngrams(line, 2), ngrams(line, 3))


def sentences(text: Column, lang: Readability = POLISH) -> Column:
    """Split after . ! ? before a capital; full stops of known abbreviations do not end a sentence."""
    text = F.regexp_replace(text, r"\.{3,}", "…")
    if lang.abbreviations:
        # the full stop first, then a look back: only full stops are examined
        alternatives = "|".join(rf"\Q{a}\E" for a in lang.abbreviations)
        text = F.regexp_replace(text, rf"(?iuU)\.(?<=\b(?:{alternatives})\.)", "\u0001")
    parts = F.split(text, rf"(?U)(?<=[.!?])\s+(?=[{lang.capitals}])")
    restored = F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit("."))))
    return F.filter(restored, lambda s: s != "")


def syllables(word: Column, lang: Readability = POLISH) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), count_of(F.lower(word), f"[{lang.vowels}]+"))


def hard_word_count(text: Column, lang: Readability = POLISH, vowel_runs: int = 4) -> Column:
    """Words with at least ``vowel_runs`` runs of vowels, counted in one pass over the text.

    All vowels are made the same letter first, and a match may only start at the start of a word.
    """
    v = lang.vowels[0]
    same = F.translate(F.lower(text), lang.vowels, v * len(lang.vowels))
    other = rf"[\p{{L}}\p{{N}}_&&[^{v}]]"
    pattern = rf"(?<![\p{{L}}\p{{N}}_]){other}*+(?:{v}++{other}++){{{vowel_runs - 1}}}{v}"
    return count_of(same, pattern)


def fog(n_words: Column, n_sentences: Column, n_hard: Column) -> Column:
    """FOG index: (words per sentence + percent of hard words) / 3; NULL for an empty text."""
    return F.when(
        (n_words > 0) & (n_sentences > 0), (n_words / n_sentences + n_hard / n_words * 100) / 3
    )
