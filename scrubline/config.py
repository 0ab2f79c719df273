"""The settings of a cleaning plan, fixed when the plan is built."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

LANGUAGES = ("ENGLISH", "DUTCH", "GERMAN", "SPANISH")


@dataclass(frozen=True)
class CleanConfig:
    """Which steps run, what they put in place of what they find, and for which languages.

    ``language`` fixes the language of all texts; a value outside ``languages`` is passed over and the language detected.
    Texts go to recognizers in pieces of ``ner_chunk_words`` words, or tokens if ``ner_token_count`` counts those of a word.
    ``currency_token`` None stands for ISO codes. ``null_policy`` is "null" (null in, null out) or "raise".
    """

    detect_language: bool = True
    fix_unicode: bool = True
    to_ascii: bool = True
    replace_html: bool = True
    replace_urls: bool = True
    replace_emails: bool = True
    replace_years: bool = True
    replace_phones: bool = True
    replace_numbers: bool = True
    replace_currencies: bool = True
    ner: bool = True
    remove_isolated_letters: bool = True
    remove_isolated_symbols: bool = True
    normalize_whitespace: bool = True
    stat_text: bool = True
    casefold: bool = True
    remove_stop_words: bool = True
    remove_punctuation: bool = True
    custom_stop_words: tuple[str, ...] = ()
    url_token: str = "<URL>"
    html_token: str = "<HTML>"
    email_token: str = "<EMAIL>"
    year_token: str = "<YEAR>"
    phone_token: str = "<PHONE>"
    number_token: str = "<NUMBER>"
    currency_token: str | None = None
    entity_tags: tuple[str, ...] = ("PER", "LOC", "ORG")
    ner_threshold: float = 0.85
    ner_chunk_words: int = 460
    ner_token_count: Callable[[str], int] | None = field(default=None, hash=False)
    recognizers: dict[str, Callable] | None = field(default=None, hash=False)
    language: str | None = None
    languages: tuple[str, ...] = LANGUAGES
    null_policy: str = "null"

    def __post_init__(self) -> None:
        if self.ner and not self.entity_tags:
            raise ValueError("entity_tags must name one entity group at least")
        if self.null_policy not in ("null", "raise"):
            raise ValueError("null_policy is 'null' or 'raise'")

    @property
    def fixed_language(self) -> str | None:
        name = (self.language or "").upper()
        return name if name in self.languages else None

    @property
    def needs_language(self) -> bool:
        return self.detect_language or self.ner or self.remove_stop_words
