"""Detection of the language among a closed set, by its common words, and in texts without these by runs of letters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LANGUAGES
from .stopword_lists import STOP_WORDS

NOT_LETTERS = r"[^\p{L}']+"
#: Frequent words that aren't stop words; they tell short sentences apart.
FREQUENT = {
    "ENGLISH": "like good new time people year work works live lives say says said make made go going see know get got let us would could may also well",
    "DUTCH": "goed nieuw tijd mensen jaar werk werkt woon woont wonen leven zegt gaat gaan zien weten maken maakt heel graag moeten laat hebben kunnen",
    "GERMAN": "gut neue zeit leute jahr arbeit arbeitet wohnt wohnen lebt leben sagt sagen geht gehen sehen wissen machen macht ja bitte heute immer wurde",
    "SPANISH": "bueno nuevo tiempo gente trabajo trabaja vive viven vivir dice decir va ir ver saber hacer hace bien gracias hoy siempre puede casa",
    "FRENCH": "bon nouveau temps gens travail travaille vit vivent vivre dit dire va aller voir savoir faire fait bien merci toujours peut maison être très",
}


def vocabulary(language: str) -> tuple[str, ...]:
    return tuple(sorted({*STOP_WORDS[language], *FREQUENT[language].split()}))


@lru_cache
def profiles(languages: tuple[str, ...]) -> dict[str, tuple[str, ...]]:
    """For each language the runs of three letters, with the spaces around words, that its vocabulary has more often, in proportion, than those of the others."""
    counts = {n: Counter(f" {w} "[i : i + 3] for w in vocabulary(n) for i in range(len(w))) for n in languages}
    share = {n: {g: k / c.total() for g, k in c.items()} for n, c in counts.items()}
    return {n: tuple(sorted(g for g, k in own.items() if all(k >= share[o].get(g, 0) for o in languages))) for n, own in share.items()}


def _counts(found: Column, wanted: Sequence[tuple[str, ...]]) -> Column:
    """How many of the strings are in each of several lists; strings in none are sorted out first."""
    every = sorted({w for words in wanted for w in words})

    def of(words: Sequence[str]) -> Callable[[Column], Column]:
        return lambda w: w.isin(*words)

    def each(known: Column) -> Column:
        return F.array(*[F.size(F.filter(known, of(words))) for words in wanted])

    return F.get(F.transform(F.array(F.filter(found, lambda w: w.isin(*every))), each), F.lit(0))


def language_scores(text: Column, languages: Sequence[str] = LANGUAGES) -> Column:
    """For each language in turn, how many words of the text are in its vocabulary."""
    return _counts(F.split(F.lower(text), NOT_LETTERS), [vocabulary(n) for n in languages])


def letter_scores(text: Column, languages: Sequence[str] = LANGUAGES) -> Column:
    """For each language in turn, how many runs of three letters of the text are in its profile."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), NOT_LETTERS, " "), F.lit(" "))
    return _counts(F.regexp_extract_all(words, F.lit("(?s)(?=(...))"), F.lit(1)), list(profiles(tuple(languages)).values()))


def _best(scores: Column, languages: Sequence[str]) -> Column:
    """The language with the highest score, of equal ones the first; null if all are 0."""
    best = F.array_max(F.transform(scores, lambda n, i: F.when(n > 0, F.struct(n.alias("n"), (-i).alias("i")))))
    return F.get(F.array(*[F.lit(x) for x in languages]), -best["i"])


def detect_language(text: Column, languages: Sequence[str] = LANGUAGES) -> Column:
    """The language with the most words in its vocabulary, of equal ones the first; for texts without any such word, by runs of three letters; else null."""
    return F.coalesce(_best(language_scores(text, languages), languages), _best(letter_scores(text, languages), languages))
