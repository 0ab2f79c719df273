"""Removal of letters, symbols and words."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .stopword_lists import STOP_WORDS


def remove_isolated_letters(text: Column) -> Column:
    """Letters that stand alone, but a and u, with the white space before them; and lone commas."""
    return F.regexp_replace(text, P.LONE_LETTER, "")


def remove_bracket_contents(text: Column) -> Column:
    """[...] and {...} with what is in them, if anything is."""
    return F.regexp_replace(F.regexp_replace(text, P.SQUARE, "$1"), P.CURLY, "$1")


def remove_symbol_runs(text: Column) -> Column:
    """Runs of symbols; of a run that touches an ASCII letter or digit, the symbol that touches it stays."""
    return F.regexp_replace(text, P.LONE_SYMBOLS, "")


def remove_lone_marks(text: Column) -> Column:
    """Quotes, hyphens, stars and percent signs that touch no ASCII letter or digit."""
    return F.regexp_replace(text, P.LONE_MARK, "")


def remove_isolated_symbols(text: Column) -> Column:
    """Bracket contents, then symbol runs, then lone marks."""
    return remove_lone_marks(remove_symbol_runs(remove_bracket_contents(text)))


def remove_punctuation(text: Column) -> Column:
    """All ASCII punctuation."""
    return F.translate(text, string.punctuation, "")


def remove_stop_words(text: Column, language: Column | str, languages: Sequence[str] | None = None) -> Column:
    """Words, as white space parts them, that aren't stop words of the language, joined by spaces.

    A word that punctuation is attached to is another word. A text whose language is null or has no list stays as it is.
    """
    if isinstance(language, str):
        language = F.lit(language)
    tokens = F.split(text, P.SPACES)

    def without(words: Sequence[str]) -> Column:
        return F.array_join(F.filter(tokens, lambda w: ~w.isin("", *words)), " ")

    out = None
    for name in languages or STOP_WORDS:
        kept = without(STOP_WORDS[name])
        out = F.when(language == name, kept) if out is None else out.when(language == name, kept)
    return out.otherwise(text)


def remove_words(text: Column, words: Sequence[str]) -> Column:
    """Each of ``words`` where it stands alone, the first in the list that fits; the spaces around it stay."""
    return F.regexp_replace(text, P.any_of_words(words), "") if words else text


def split_sentences(text: Column) -> Column:
    """Parts that end in . ! or ? before white space that no digit follows."""
    return F.split(text, P.SENTENCE_GAP)


def extract_acronyms(text: Column) -> Column:
    """Acronyms such as U.S., R&D2 or 3-D, in order."""
    return F.regexp_extract_all(text, F.lit(P.ACRONYM), F.lit(0))


def is_blank(text: Column) -> Column:
    """Whether a text has white space only, or nothing."""
    return ~F.coalesce(text, F.lit("x")).rlike(f"[^{P.SPACE}]")
