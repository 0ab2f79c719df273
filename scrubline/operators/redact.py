"""Redaction: what is found gives place to a token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _put(text: Column, pattern: str, token: str) -> Column:
    return F.regexp_replace(text, pattern, P.literal(token))


def replace_urls(text: Column, token: str = "<URL>") -> Column:
    """URLs that begin with http://, https://, ftp:// or www. and not inside a word or path."""
    return _put(text, P.URL, token)


def replace_emails(text: Column, token: str = "<EMAIL>") -> Column:
    """E-mail addresses, also with (at), [at], {at} or <at> for the sign."""
    return F.when(text.rlike(P.ANY_AT), _put(text, P.EMAIL, token)).otherwise(text)


def replace_phone_numbers(text: Column, token: str = "<PHONE>") -> Column:
    """Phone numbers, and with them any number of 7 digits or more that stands alone."""
    return _put(text, P.PHONE, token)


def replace_numbers(text: Column, token: str = "<NUMBER>") -> Column:
    """Numbers with their sign, grouped by commas, spaces or dots, or with a decimal point or comma."""
    return _put(text, P.NUMBER, token)


def replace_years(text: Column, token: str = "<YEAR>") -> Column:
    """Years from 1900 to 2099 that stand alone."""
    return _put(text, P.YEAR, token)


def replace_currencies(text: Column, token: str | None = "<CUR>") -> Column:
    """A run of currency signs becomes one token; with None, each sign becomes its ISO code."""
    if token is not None:
        return _put(text, P.CURRENCIES, token)
    for sign, code in P.ISO.items():
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text
