"""The steps of a plan over texts in ASCII, in a Python stage that the plan has anyway: there they take a fraction of the time of as many passes of the JVM.

Each function gives what the one of the same name in ``filters``, ``normalize`` or ``redact`` gives for a text in ASCII; other texts are left to these.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CleanConfig
from . import patterns as P
from .arrow_stage import chained, text_parts, text_steps
from .recognizers import anonymizer
from .stopword_lists import STOP_WORDS

_SPACE, _ALNUM = r"\t-\r\x1c-\x20", "A-Za-z0-9"
_SYMBOL, _MARK = r"[!#(),./:;<>?@\\^_{|}~+]", r"[\"%'*-]"
# each begins with a class of signs, which is what is searched for fastest
_CURRENCY = re.compile(r"\$+")
_LONE_LETTER = re.compile(rf"[{_SPACE}][B-TV-Zb-tv-z, ](?=[{_SPACE}]|\Z)")
_SQUARE, _CURLY = re.compile(r"\[[^\]]++\]|(\[[^\]]++)\Z"), re.compile(r"\{[^}]++\}|(\{[^}]++)\Z")
_SYMBOLS = re.compile(rf"{_SYMBOL}(?<![{_ALNUM}]{_SYMBOL}){_SYMBOL}*(?![{_ALNUM}])")
_LONE_MARK = re.compile(rf"{_MARK}(?<![{_ALNUM}]{_MARK})(?![{_ALNUM}])")
_ANY_AT, _DIGIT = re.compile(P.ANY_AT), re.compile("[0-9]")
_PUNCTUATION = dict.fromkeys(map(ord, string.punctuation))


def _of_ascii(pattern: str) -> re.Pattern:
    """A pattern of the JVM, with classes that hold what they do of ASCII."""
    return re.compile(pattern.replace(P.SPACE, _SPACE).replace(P.WORD, "A-Za-z0-9_").replace(P.DIGIT, r"\d").replace(P.FOLDED, "").replace(r"\z", r"\Z"), re.ASCII)


_URL, _YEAR, _PHONE, _NUMBER = map(_of_ascii, (P.URL, P.YEAR, P.PHONE, P.NUMBER))
_SCHEME = re.compile("://|[wW]{3}")


def replace_urls(text: str, token: str) -> str:
    return _URL.sub(lambda _: token, text) if _SCHEME.search(text) else text


def replace_years(text: str, token: str) -> str:
    return _YEAR.sub(lambda _: token, text)


def replace_phone_numbers(text: str, token: str) -> str:
    return _PHONE.sub(lambda _: token, text)


def replace_numbers(text: str, token: str) -> str:
    return _NUMBER.sub(lambda _: token, text)


def replace_currencies(text: str, token: str | None) -> str:
    if "$" not in text:
        return text
    return text.replace("$", P.ISO["$"]) if token is None else _CURRENCY.sub(lambda _: token, text)


def remove_isolated_letters(text: str) -> str:
    marked = "\n" + text  # a letter at the start is one after white space too
    out = _LONE_LETTER.sub("", marked)
    return out if _LONE_LETTER.match(marked) else out[1:]


def remove_isolated_symbols(text: str) -> str:
    if "[" in text:
        text = _SQUARE.sub(r"\1", text)
    if "{" in text:
        text = _CURLY.sub(r"\1", text)
    return _LONE_MARK.sub("", _SYMBOLS.sub("", text))


def on_one_line(text: str) -> str:
    return " ".join(text.split())


def on_lines(text: str) -> str:
    return "\n".join([words for line in text.splitlines() if (words := " ".join(line.split()))])


def remove_punctuation(text: str) -> str:
    return text.translate(_PUNCTUATION)


def redactions(cfg: CleanConfig) -> Callable[[str], str | None] | None:
    """All steps up to the language-model text without entities; None for a text that may have e-mail addresses, whose pattern Python can't hold.

    None as a whole if the steps may put in what isn't ASCII.
    """
    last = last_redactions(cfg)
    if last is None or not (cfg.url_token + cfg.year_token + cfg.phone_token + cfg.number_token).isascii():
        return None
    digits = [
        (cfg.replace_years, lambda t: replace_years(t, cfg.year_token)),
        (cfg.replace_phones, lambda t: replace_phone_numbers(t, cfg.phone_token)),
        (cfg.replace_numbers, lambda t: replace_numbers(t, cfg.number_token)),
    ]
    of_digits = chained([step for wanted, step in digits if wanted])

    def run(text: str) -> str | None:
        if cfg.replace_urls:
            text = replace_urls(text, cfg.url_token)
        if cfg.replace_emails and _ANY_AT.search(text):
            return None
        if _DIGIT.search(text):
            text = of_digits(text)
        return last(text)

    return run


def last_redactions(cfg: CleanConfig) -> Callable[[str], str] | None:
    """The steps of ``pipeline.last_redactions``, or None if they may put in what isn't ASCII."""
    if cfg.replace_currencies and not (cfg.currency_token or "").isascii():
        return None
    steps = [
        (cfg.replace_currencies, lambda t: replace_currencies(t, cfg.currency_token)),
        (cfg.remove_isolated_letters, remove_isolated_letters),
        (cfg.remove_isolated_symbols, remove_isolated_symbols),
        (cfg.normalize_whitespace, on_one_line),
    ]
    return chained([step for wanted, step in steps if wanted])


def statistics_text(cfg: CleanConfig) -> Callable[[str, str | None], str] | None:
    """The steps of ``pipeline.statistics_text`` for a text and its language, or None if they have words of the user's."""
    if cfg.custom_stop_words:
        return None
    stop = {name: frozenset(STOP_WORDS[name]) for name in cfg.languages or STOP_WORDS} if cfg.remove_stop_words else {}
    steps = [(cfg.remove_punctuation, remove_punctuation), (cfg.remove_isolated_letters, remove_isolated_letters), (cfg.normalize_whitespace, on_lines)]
    rest = chained([step for wanted, step in steps if wanted])

    def run(text: str, language: str | None) -> str:
        if cfg.casefold:
            text = text.lower()
        if language in stop:
            words = stop[language]
            text = " ".join([w for w in text.split() if w not in words])
        return rest(text)

    return run


def last_stage(text: Column, ascii: Column, language: Column, cfg: CleanConfig) -> Column:
    """struct<lm, stat> of texts: the last redactions of those that ``ascii`` says need them, then tokens for entities, then the statistics text.

    ``stat`` is null where it is left to the JVM.
    """
    redact, reduce = last_redactions(cfg), statistics_text(cfg) if cfg.stat_text else None
    anonymize = anonymizer(cfg.entity_tags, cfg.ner_threshold, cfg.recognizers, cfg.ner_chunk_words, cfg.ner_token_count) if cfg.ner else None

    @F.arrow_udf("struct<lm:string,stat:string>")
    def run(texts: pa.Array, ascii: pa.Array, languages: pa.Array) -> pa.Array:
        parts = []
        for part, plain, names in text_parts(texts, ascii, languages):
            lm = [redact(t) if p and t is not None else t for t, p in zip(part, plain)] if redact else part
            if anonymize:
                lm = anonymize(lm, names)
            stat = [reduce(t, name) if reduce and t is not None and t.isascii() else None for t, name in zip(lm, names)]
            parts.append(pa.StructArray.from_arrays([pa.array(lm, pa.string()), pa.array(stat, pa.string())], ["lm", "stat"]))
        return pa.concat_arrays(parts)

    return run(text, ascii, language)


def whole_stage(text: Column, language: Column, cfg: CleanConfig) -> Column:
    """struct<text, lm, stat>: texts after repair, transliteration and HTML, and of those whose other steps can be taken here too the outcome in place of it."""
    prepare, redact, reduce = chained(text_steps(cfg.fix_unicode, cfg.to_ascii, cfg.replace_html, cfg.html_token)), redactions(cfg), statistics_text(cfg) if cfg.stat_text else None

    def one(text: str | None, language: str | None) -> tuple[str | None, str | None, str | None]:
        if text is None:
            return None, None, None
        text = prepare(text)
        lm = redact(text) if redact and text.isascii() else None
        return (text, None, None) if lm is None else (None, lm, reduce(lm, language) if reduce else None)

    @F.arrow_udf("struct<text:string,lm:string,stat:string>")
    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        parts = []
        for part, names in text_parts(texts, languages):
            columns = zip(*map(one, part, names)) if part else ([], [], [])
            parts.append(pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], ["text", "lm", "stat"]))
        return pa.concat_arrays(parts)

    return run(text, language)
