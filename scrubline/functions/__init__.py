"""All operators as functions of columns, and their registration for SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.arrow_stage import (
    arrow_stage,
    fix_bad_unicode_column,
    html_to_text,
    html_to_text_column,
    text_udf,
    to_ascii,
    to_ascii_column,
    unescape_backslashes,
    unescape_backslashes_column,
)
from ..operators.arrow_stage import fix_unicode as _fix_unicode
from ..operators.entities import anonymize, best_per_span, filter_confident, filter_tags, resolve_spans, route, split_chunks, vote
from ..operators.filters import (
    extract_acronyms,
    is_blank,
    remove_bracket_contents,
    remove_isolated_letters,
    remove_isolated_symbols,
    remove_lone_marks,
    remove_punctuation,
    remove_stop_words,
    remove_symbol_runs,
    remove_words,
    split_sentences,
)
from ..operators.language import detect_language, language_scores
from ..operators.normalize import casefold, fix_strange_quotes, normalize_whitespace
from ..operators.recognizers import recognize_column
from ..operators.redact import replace_currencies, replace_emails, replace_numbers, replace_phone_numbers, replace_urls, replace_years

__all__ = [
    "anonymize",
    "arrow_stage",
    "best_per_span",
    "casefold",
    "detect_language",
    "extract_acronyms",
    "filter_confident",
    "filter_tags",
    "fix_bad_unicode_column",
    "fix_strange_quotes",
    "html_to_text_column",
    "is_blank",
    "language_scores",
    "normalize_whitespace",
    "recognize_column",
    "register",
    "remove_bracket_contents",
    "remove_isolated_letters",
    "remove_isolated_symbols",
    "remove_lone_marks",
    "remove_punctuation",
    "remove_stop_words",
    "remove_symbol_runs",
    "remove_words",
    "replace_currencies",
    "replace_emails",
    "replace_numbers",
    "replace_phone_numbers",
    "replace_urls",
    "replace_years",
    "resolve_spans",
    "route",
    "split_chunks",
    "split_sentences",
    "to_ascii_column",
    "unescape_backslashes_column",
    "vote",
]

#: Operators of one text that SQL can call once ``register`` has run: those of the JVM as SQL functions, the others as Arrow UDFs.
_JVM = {
    "replace_urls": replace_urls,
    "replace_emails": replace_emails,
    "replace_phone_numbers": replace_phone_numbers,
    "replace_numbers": replace_numbers,
    "replace_years": replace_years,
    "fix_strange_quotes": fix_strange_quotes,
    "remove_isolated_letters": remove_isolated_letters,
    "remove_isolated_symbols": remove_isolated_symbols,
    "remove_punctuation": remove_punctuation,
    "casefold": casefold,
    "collapse_whitespace": lambda t: normalize_whitespace(t, no_line_breaks=True),
}
_PYTHON = {"fix_bad_unicode": _fix_unicode, "to_ascii": to_ascii, "html_to_text": html_to_text, "unescape_backslashes": unescape_backslashes}


def _as_sql(spark: SparkSession, function: Callable[[Column], Column]) -> str:
    """The SQL of ``function`` over a column ``t``, as the analyser resolves it."""
    plan = spark.createDataFrame([], "t string").select(function(F.col("t")).alias("x"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql()


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Makes the operators temporary functions of ``spark``, under their names after ``prefix``; returns these.

    A JVM operator becomes a SQL function of its expression, so Catalyst sees through it. Python ones take texts in Arrow batches.
    """
    for name, function in _JVM.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION `{prefix}{name}`(t STRING) RETURNS STRING RETURN {_as_sql(spark, function)}")
    for name, function in _PYTHON.items():
        spark.udf.register(prefix + name, text_udf(function))
    return [prefix + name for name in (*_JVM, *_PYTHON)]
