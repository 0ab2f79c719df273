"""Normalisation of quotes, white space and case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

SINGLE = "‘‛’❛❜`´"
DOUBLE = "«‹»›„“‟”❝❞❮❯〝〞〟＂"


def fix_strange_quotes(text: Column) -> Column:
    """Typographic, ornamental and angle quotes as ' and \"."""
    return F.translate(text, SINGLE + DOUBLE, "'" * len(SINGLE) + '"' * len(DOUBLE))


def normalize_whitespace(text: Column, strip_lines: bool = True, no_line_breaks: bool = False, keep_two_line_breaks: bool = False) -> Column:
    """White space in runs becomes one space, or one line break if it holds one; none at the ends.

    ``no_line_breaks`` makes all of it spaces. ``keep_two_line_breaks`` leaves two line breaks where there are more than one.
    Without ``strip_lines`` a run that begins with a blank becomes a space even if it holds a line break.
    """
    if no_line_breaks:
        return F.trim(F.regexp_replace(text, P.WIDE_SPACES, " "))
    if not strip_lines:
        if keep_two_line_breaks:
            text = F.regexp_replace(text, r"(?:\r\n|[\n\x0B])(?:\r\n|[\n\x0B])++", "\n\n")
        else:
            text = F.regexp_replace(text, P.NARROW_BREAKS, "\n")
        return F.regexp_replace(F.regexp_replace(text, P.NOT_BEFORE_BREAK, " "), P.OUTER, "")
    if keep_two_line_breaks:
        text = F.regexp_replace(F.regexp_replace(text, P.ONE_BREAK, "\n"), r"\n{2,}", "\n\n")
    else:
        text = F.regexp_replace(text, P.ANY_BREAKS, "\n")
    return F.btrim(F.regexp_replace(text, P.WIDE_BLANKS, " "), F.lit(" \n"))


def casefold(text: Column) -> Column:
    """Lower case for comparison: that of the JVM, with ss for sharp s and one form of Greek sigma."""
    text = F.regexp_replace(text, "[ßẞ]", "ss")
    return F.translate(F.lower(text), "ς", "σ")
