"""Recognizers of named entities, and their use over a column."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow_stage import joined, text_parts, to_ascii
from .entities import ARROW_ENTITIES, DEFAULT_THRESHOLD, ENTITIES, anonymize_text

#: A recognizer takes a text and returns (entity group, score, start, end) for each entity; offsets are in characters.
Recognizer = Callable[[str], list[tuple[str, float, int, int]]]

_GIVEN = (
    "John Jane Mary James Robert Michael William David Richard Thomas Charles Sarah Emma Anna Alice Peter Paul Mark George Susan Linda Angela Hans Klaus Jürgen Wolfgang Heinrich Greta Ursula Sabine "
    "Pablo Juan José Carlos María Carmen Luis Miguel Javier Lucía Sofía Diego Willem Jan Pieter Kees Johan Sanne Femke Anouk Daan Bram Pierre Marie Jean Louis Camille Élodie"
).split()
_PLACES = (
    "New York|Los Angeles|San Francisco|Washington|London|Paris|Berlin|Madrid|Amsterdam|Rotterdam|Utrecht|Munich|München|Hamburg|Frankfurt|Köln|Wien|Vienna|Zürich|Barcelona|Sevilla|Valencia|Bogotá|Buenos Aires|Mexico|México|"
    "Germany|Deutschland|Spain|España|Netherlands|Nederland|France|Italy|Italia|Europe|England|Scotland|Ireland|Canada|Australia|China|Japan|India|Brazil|Chicago|Boston|Seattle|Brussels|Rome|Roma|Lisbon|Tokyo|Sydney"
).split("|")
_FIRMS = "Microsoft|Google|Apple|Amazon|IBM|Intel|Siemens|Volkswagen|BMW|Philips|Shell|Telefónica|Santander|NASA|UNESCO|Facebook|Netflix|Tesla|Oracle|SAP|Bosch|Heineken|Iberia".split("|")
# texts mostly come here in ASCII
_GIVEN, _PLACES, _FIRMS = (list(dict.fromkeys(x for n in names for x in (n, to_ascii(n)))) for names in (_GIVEN, _PLACES, _FIRMS))
_CAPITAL = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_FORMS = "Corp Inc Ltd LLC GmbH AG BV NV SA".split()
_ENDINGS = ("Corp", "Soft", "Tech", "Bank")
_RULES: list[tuple[str, float, re.Pattern]] = [
    ("PER", 0.99, re.compile(rf"\b(?:{'|'.join(_GIVEN)})\b(?:[ ]{_CAPITAL})?")),
    ("PER", 0.97, re.compile(rf"(?<=\b(?:Dr|Mr|Ms)\.[ ]){_CAPITAL}(?:[ ]{_CAPITAL})?")),
    ("PER", 0.97, re.compile(rf"(?<=\bMrs\.[ ]){_CAPITAL}(?:[ ]{_CAPITAL})?")),
    ("LOC", 0.98, re.compile(rf"\b(?:{'|'.join(map(re.escape, _PLACES))})\b")),
    ("ORG", 0.98, re.compile(rf"\b(?:{'|'.join(map(re.escape, _FIRMS))})\b(?:[ ](?:Corp|Inc|Ltd|GmbH|AG)\b\.?)?")),
    ("ORG", 0.96, re.compile(rf"\b{_CAPITAL}(?:[ ]{_CAPITAL}){{0,3}}[ ](?:{'|'.join(_FORMS)})\b\.?")),
    ("ORG", 0.96, re.compile(rf"\b[A-Z][a-z]+(?:{'|'.join(_ENDINGS)})\b")),
]
_CAPITAL_WORD = re.compile(r"[A-ZÀ-ÖØ-Þ]\w*")


def _one_of(words: Sequence[str]) -> Callable[[str, set[str]], bool]:
    """Whether the first word of one of ``words`` is among a text's capital words."""
    first = {w.split()[0] for w in words}
    return lambda _, found: not first.isdisjoint(found)


#: For each rule what must hold of a text and its capital words if the rule is to find anything, as that is told sooner.
_MAY_FIND: list[Callable[[str, set[str]], bool]] = [
    _one_of(_GIVEN),
    lambda t, _: "Dr. " in t or "Mr. " in t or "Ms. " in t,
    lambda t, _: "Mrs. " in t,
    _one_of(_PLACES),
    _one_of(_FIRMS),
    _one_of(_FORMS),
    lambda _, found: any(w.endswith(_ENDINGS) for w in found),
]


def rule_recognizer(text: str) -> list[tuple[str, float, int, int]]:
    """Entities by lists of names, places and firms, and by titles and company forms. Scores are fixed by the rule."""
    found = set(_CAPITAL_WORD.findall(text))
    return [(group, score, m.start(), m.end()) for (group, score, rule), may in zip(_RULES, _MAY_FIND) if may(text, found) for m in rule.finditer(text)]


#: By language; "MULTI" is asked if the English one finds nothing wanted.
DEFAULT_RECOGNIZERS: dict[str, Recognizer] = {"ENGLISH": rule_recognizer, "DUTCH": rule_recognizer, "GERMAN": rule_recognizer, "SPANISH": rule_recognizer, "MULTI": rule_recognizer}



class ModelRecognizer:
    """A recognizer that asks a model, loaded from ``folder`` by ``load`` once in a Python worker, when the first text comes.

    ``load(folder)`` gives a function of a list of texts to, for each, a list of dicts with entity_group (or entity), score, start and end, as
    token-classification pipelines do. Texts are given to it ``batch_size`` at a time. Only ``folder`` and ``load`` travel to the workers; the folder must be
    readable there. Without ``load`` the model is loaded by the transformers library, if that is installed.
    """

    def __init__(self, folder: str, load: Callable[[str], Callable] | None = None, batch_size: int = 8):
        self.folder, self.load, self.batch_size = folder, load or transformers_pipeline, batch_size

    def batch(self, texts: Sequence[str]) -> list[list[tuple[str, float, int, int]]]:
        key = (self.folder, getattr(self.load, "__module__", ""), getattr(self.load, "__qualname__", ""))
        if key not in _MODELS:
            _MODELS[key] = self.load(self.folder)
        out = []
        for i in range(0, len(texts), self.batch_size):
            for found in _MODELS[key](list(texts[i : i + self.batch_size])):
                out.append([(_group(e), float(e["score"]), int(e["start"]), int(e["end"])) for e in found])
        return out

    def __call__(self, text: str) -> list[tuple[str, float, int, int]]:
        return self.batch([text])[0]


_MODELS: dict[tuple, Callable] = {}


def _group(e: dict) -> str:
    return (e.get("entity_group") or e["entity"]).removeprefix("B-").removeprefix("I-")


def transformers_pipeline(folder: str) -> Callable:
    try:
        from transformers import pipeline
    except ModuleNotFoundError as e:
        raise ModuleNotFoundError("give ModelRecognizer a function to load the model, or install transformers") from e
    return pipeline("token-classification", model=folder, tokenizer=folder, aggregation_strategy="simple")


_CHUNK = re.compile(r"\s*(?:\S+\s*)")


@lru_cache
def _pieces(most: int) -> re.Pattern:
    return re.compile(rf"\s*+(?:\S++\s*+){{1,{most}}}+")


def chunk_starts(text: str, most: int, count: Callable[[str], int] | None = None) -> list[int]:
    """Where the pieces begin of ``most`` words each, or of at most ``most`` tokens in whole words if ``count`` counts a word's (of one word where it has more)."""
    if count is None:
        return [m.start() for m in _pieces(most).finditer(text)]
    out, room = [], 0
    for m in _CHUNK.finditer(text):
        n = count(m.group().strip())
        if not out or n > room:
            out.append(m.start() if out else 0)
            room = most
        room -= n
    return out


def _all_found(recognizer: Recognizer, pieces: Sequence[str]) -> list[list[tuple[str, float, int, int]]]:
    return recognizer.batch(pieces) if hasattr(recognizer, "batch") else [recognizer(p) for p in pieces]


def recognize_all(texts: Sequence[str | None], languages: Sequence[str | None], tags: Sequence[str], recognizers: dict[str, Recognizer], most: int, count: Callable[[str], int] | None = None) -> list[list[tuple[str, float, str, int, int]] | None]:
    """For each text its entities with wanted tags, piece by piece: of the language's own recognizer, or of the English and failing that the multilingual one.

    The pieces of all texts go to a recognizer together. The multilingual one isn't asked if it's the English one itself.
    """
    places: dict[str, list[tuple[int, int, int]]] = {}
    for i, (text, language) in enumerate(zip(texts, languages)):
        if text is not None:
            starts = chunk_starts(text, most, count)
            own = language if language in recognizers and language not in ("ENGLISH", "MULTI") else "ENGLISH"
            places.setdefault(own, []).extend((i, a, b) for a, b in zip(starts, [*starts[1:], len(text)]))
    out: list = [None if t is None else [] for t in texts]

    def ask(name: str, own: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Adds what is found; returns the pieces in which nothing is."""
        empty = []
        for (i, a, b), found in zip(own, _all_found(recognizers[name], [texts[i][a:b] for i, a, b in own])):
            wanted = [(g, float(s), texts[i][a + x : a + y], a + x, a + y) for g, s, x, y in found if g in tags]
            out[i] += wanted
            if not wanted:
                empty.append((i, a, b))
        return empty

    for name, own in places.items():
        empty = ask(name, own)
        if name == "ENGLISH" and empty and recognizers["MULTI"] is not recognizers["ENGLISH"]:  # the same one finds nothing again
            ask("MULTI", empty)
    return [None if found is None else sorted(found, key=lambda e: e[3]) if len(found) > 1 else found for found in out]


def recognize(text: str, language: str | None, tags: Sequence[str], recognizers: dict[str, Recognizer], chunk_words: int) -> list[tuple[str, float, str, int, int]]:
    """``recognize_all`` of one text."""
    return recognize_all([text], [language], tags, recognizers, chunk_words)[0]


def recognize_column(text: Column, language: Column, tags: Sequence[str], recognizers: dict[str, Recognizer] | None = None, chunk_words: int = 460, token_count: Callable[[str], int] | None = None) -> Column:
    """The entities of each text as an array of structs, found by Python functions over Arrow batches."""
    if not tags:
        raise ValueError("tags must name one entity group at least")
    by_language = recognizers or DEFAULT_RECOGNIZERS

    @F.arrow_udf(ENTITIES)
    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        names = ("entity_group", "score", "word", "start", "end")
        parts = (recognize_all(t, l, tags, by_language, chunk_words, token_count) for t, l in text_parts(texts, languages))
        return pa.concat_arrays([pa.array([None if found is None else [dict(zip(names, e)) for e in found] for found in part], ARROW_ENTITIES) for part in parts])

    return run(text, language)


def anonymizer(tags: Sequence[str], threshold: float | None = None, recognizers: dict[str, Recognizer] | None = None, chunk_words: int = 460, token_count: Callable[[str], int] | None = None) -> Callable[[list, list], list]:
    """What ``anonymize_column`` does, as a function of a list of texts and one of their languages."""
    if not tags:
        raise ValueError("tags must name one entity group at least")
    by_language, least = recognizers or DEFAULT_RECOGNIZERS, threshold or DEFAULT_THRESHOLD

    def one(t: str, found: list) -> str:
        best: dict[tuple[int, int], tuple] = {}
        for group, score, _, a, b in found:
            if score >= least and ((a, b) not in best or score > best[a, b][1]):
                best[a, b] = (group, score, a, b)
        return anonymize_text(t, list(best.values())) if best else t

    def run(texts: list[str | None], languages: list[str | None]) -> list[str | None]:
        every = recognize_all(texts, languages, tags, by_language, chunk_words, token_count)
        return [None if t is None else one(t, found) for t, found in zip(texts, every)]

    return run


def anonymize_column(text: Column, language: Column, tags: Sequence[str], threshold: float | None = None, recognizers: dict[str, Recognizer] | None = None, chunk_words: int = 460, token_count: Callable[[str], int] | None = None) -> Column:
    """The text with a token for each entity of ``recognize_column`` that scores ``threshold``, the best of each span; in one crossing to Python."""
    anonymize = anonymizer(tags, threshold, recognizers, chunk_words, token_count)

    @F.arrow_udf("string")
    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        return joined(anonymize(part, names) for part, names in text_parts(texts, languages))

    return run(text, language)
