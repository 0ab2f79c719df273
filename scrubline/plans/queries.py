"""The registered queries of the cleaning operators, over whole tables, and their SQL.

DuckDB's regular expressions have no lookaround, and their word class is ASCII. So the SQL here captures what stands before a
match and puts it back, and where an end of word matters it first wraps accented letters in ASCII ones (``wrapped``).
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CleanConfig
from ..operators import arrow_stage, entities, filters, language, normalize, redact
from ..operators.stopword_lists import STOP_WORDS
from ..sources import small_batches, spread
from . import pipeline

LANGUAGES = ("ENGLISH", "GERMAN", "SPANISH", "FRENCH")
CODES = {"en": "ENGLISH", "de": "GERMAN", "es": "SPANISH", "fr": "FRENCH"}
CUSTOM_WORDS = ("the", "token", "und", "que")
CHUNK_WORDS = 64
TAGS, THRESHOLD = ("PER", "LOC", "ORG"), 0.85

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _text(name: str, function: Callable[[Column], Column], sql: str | None, table: str = "documents", key: str = "doc_id", text: str = "text") -> None:
    """A query (key, result) of ``function`` over the SQL expression ``text``; ``sql`` is an expression over ``t``."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, table).select(key, F.expr(text).alias("t"))
        return rows.select(key, function(F.col("t")).alias("result"))

    _add(name, query, sql and f"SELECT {key}, {sql} AS result FROM (SELECT {key}, {text} AS t FROM {table})")


# --- SQL of the operators, as functions of an expression ------------------------------------------------------------

ACCENTED = "À-ÖØ-öø-ÿ"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sub(x: str, pattern: str, by: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(by)}, '{flags}')"


def _wrapped(x: str, work: Callable[[str], str]) -> str:
    """``work`` on the text with each accented letter between Zq and qZ, so that it counts as part of a word."""
    return _sub(work(_sub(x, f"([{ACCENTED}])", r"Zq\1qZ")), f"Zq([{ACCENTED}])qZ", r"\1")


_H = r"[;-@:0-9\\\[a-zA-Z]"
_NAME = f"{_H}+(?:-{_H}+)*"
_SITE = rf"{_NAME}(?:[.]{_NAME})*[.]{_H}{{2,}}"


def sql_url(x: str) -> str:
    start = r"(?:[hH][tT]{2}[pP][sS]?://|[fF][tT][pP]://|[wW]{3}[0-9]{0,3}[.])"
    return _sub(x, rf"(^|[^{ACCENTED}\w./]){start}(?:\S+@)?(?:{_SITE}|(?i:localhost))(?::[0-9]{{2,5}}\b)?(?:/[^\s}}\])]*)?", r"\1<URL>")


def sql_email(x: str) -> str:
    local = rf"[-+\w{ACCENTED}]+"
    return _sub(x, rf"(^|[^.@)\w{ACCENTED}]){local}(?:[.]{local})*(?:@|[{{<\[(][aA][tT][]}})>]){_SITE}", r"\1<EMAIL>")


def sql_phone(x: str) -> str:
    gap = "[-. ]?"
    body = rf"(?:(?:[+]?[0-9]+|00?[0-9]*?){gap})?(?:[(]?[0-9]{{3,4}}[)]?/?{gap})?[0-9]{{3}}{gap}[0-9]{{4}}(?:\s?(?:[-x#]|ext[.]?)\s?[0-9]{{2,6}})?\b"
    return _wrapped(x, lambda t: _sub(t, rf"(^|[^)\w]){body}|[+]?[0-9]{{4,5}}[/ .][0-9]{{6,9}}", r"\1<PHONE>"))


def sql_number(x: str) -> str:
    head = "[1-9][0-9]{0,2}"
    body = rf"(?:{head}(?:,[0-9]{{3}})+(?:[.][0-9]*)?|{head}(?:[. ][0-9]{{3}})+(?:,[0-9]*)?|[0-9]*?[,.][0-9]+|[0-9]+)(?:\b|$)"
    return _wrapped(x, lambda t: _sub(t, rf"(^|[^.,\w])[-–+]?{body}", r"\1<NUMBER>"))


def sql_year(x: str) -> str:
    return _wrapped(x, lambda t: _sub(t, r"\b(?:20|19)[0-9]{2}\b", "<YEAR>"))


def sql_iso(x: str) -> str:
    from ..operators.patterns import ISO

    for sign, code in ISO.items():
        x = f"replace({x}, '{sign}', '{code}')"
    return x


def sql_currency_token(x: str) -> str:
    from ..operators.patterns import ISO

    return _sub(x, f"(?:{'|'.join('[$]' if s == '$' else s for s in ISO)})+", "<CUR>")


def sql_quotes(x: str) -> str:
    single, double = normalize.SINGLE, normalize.DOUBLE
    return f"translate({x}, '{single + double}', {_quoted(chr(39) * len(single) + chr(34) * len(double))})"


def sql_ascii(x: str) -> str:
    return f"replace(strip_accents({sql_quotes(x)}), 'ß', 'ss')"


def sql_one_line(x: str) -> str:
    return f"trim({_sub(x, r'\s+', ' ')})"


def sql_lines(x: str) -> str:
    return f"trim({_sub(_sub(x, r'\s*\n\s*', chr(10)), r'[\t ]+', ' ')}, ' ' || chr(10))"


def sql_paragraphs(x: str) -> str:
    one = _sub(x, r"[\t ]*\n[\t ]*", "\n")
    return f"trim({_sub(_sub(one, r'\n{2,}', chr(10) * 2), r'[\t ]+', ' ')}, ' ' || chr(10))"


def sql_keep_lines(x: str) -> str:
    return f"trim({_sub(_sub(x, r'\n+', chr(10)), r'[^\S\n]\s*', ' ')}, ' ' || chr(10) || chr(9) || chr(13))"


def sql_casefold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def sql_letters(x: str) -> str:
    """A mark after each white space stands for it, so that neighbours needn't share it."""
    marked = _sub(x, r"(\s)", "\\1\x02")
    cut = _sub(marked, "(^|\x02)(?:[B-TV-Zb-tv-z,]| \x02)(\\s|$)", "\x01\\2")
    return f"replace({_sub(cut, chr(92) + 's?' + chr(1))}, chr(2), '')"


def sql_brackets(x: str) -> str:
    return _sub(_sub(x, r"[[][^]]+[]]"), r"[{][^}]+[}]")


def sql_symbols(x: str) -> str:
    """Runs between marks; symbols beside a letter or digit move out of them."""
    s, a = r"[!#(),./:;<>?@\\^_{|}~+·]", "[0-9A-Za-z]"
    marked = _sub(x, f"({s}+)", "\x01\\1\x02")
    left = _sub(marked, f"({a})\x01({s})", "\\1\\2\x01")
    right = _sub(left, f"({s})\x02({a})", "\x02\\1\\2")
    return _sub(right, "\x01[^\x02]*\x02")


def sql_marks(x: str) -> str:
    """Marks beside a letter or digit are put in code while the others go."""
    m, a = "'\"*%-", "\x03\x04\x05\x06\x07"
    kept = _sub(_sub(x, "([0-9A-Za-z])([\"'*%-])", "\\1\\2\x01"), "([\"'*%-])([0-9A-Za-z])", "\\1\x01\\2")
    for c, code in zip(m, a):
        kept = f"replace({kept}, {_quoted(c + chr(1))}, '{code}')"
    return f"translate({_sub(kept, '''[\"'*%-]''')}, '{a}', {_quoted(m)})"


def sql_punctuation(x: str) -> str:
    return _sub(x, "[[:punct:]]")


def sql_stop_words(x: str, lang: str) -> str:
    def kept(name: str) -> str:
        words = ", ".join(_quoted(w) for w in STOP_WORDS[name])
        return f"array_to_string(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '' AND w NOT IN ({words})), ' ')"

    cases = " ".join(f"WHEN '{name}' THEN {kept(name)}" for name in LANGUAGES)
    return f"(CASE {lang} {cases} ELSE {x} END)"


def sql_language(x: str) -> str:
    """The first of the languages with the most words of its vocabulary, or if none has any, with the most runs of letters of its profile."""
    profiles = language.profiles(LANGUAGES)
    names = "[" + ", ".join(f"'{n}'" for n in LANGUAGES) + "]"

    def listed(found: str, wanted: dict[str, tuple[str, ...]]) -> str:
        return "[" + ", ".join(f"len(list_filter({found}, lambda w: w IN ({', '.join(map(_quoted, words))})))" for words in wanted.values()) + "]"

    def best(s: str) -> str:
        return f"CASE WHEN list_max({s}) > 0 THEN {names}[list_position({s}, list_max({s}))] END"

    words = listed(f"string_split_regex(lower({x}), '[^\\p{{L}}'']+')", {n: language.vocabulary(n) for n in LANGUAGES})
    spaced = f"' ' || {_sub(f'lower({x})', r'[^\p{L}' + chr(39) + ']+', ' ')} || ' '"
    letters = listed(f"list_transform(range(1, greatest(length({spaced}) - 1, 1)), lambda i: substr({spaced}, i, 3))", profiles)
    return f"(SELECT CASE WHEN list_max(s) > 0 THEN {best('s')} ELSE (SELECT {best('r')} FROM (SELECT {letters} AS r)) END FROM (SELECT {words} AS s))"


def sql_lm(x: str) -> str:
    """The language-model text of ``CONFIG``, for texts in Latin letters without markup."""
    for step in (sql_ascii, sql_url, sql_email, sql_year, sql_phone, sql_number, sql_iso, sql_letters, sql_brackets, sql_symbols, sql_marks, sql_one_line):
        x = step(x)
    return x


def sql_stat(x: str, lang: str) -> str:
    for step in (sql_punctuation, sql_letters, sql_lines):
        x = step(x if step is not sql_punctuation else sql_stop_words(sql_casefold(x), lang))
    return x


# --- redaction, normalisation, filters ------------------------------------------------------------------------------

_URLS = "concat('see ', url, ' or (', url, '), then <', url, '> and x', url)"
_BREAKS = "concat(' ', chr(9), replace(text, chr(10), concat(' ', chr(10), chr(9), chr(10), ' ')), ' ', chr(10))"
_text("url_replace", redact.replace_urls, sql_url("t"), "pages", "page_id", _URLS)
_text("email_replace", redact.replace_emails, sql_email("t"))
_text("phone_replace", redact.replace_phone_numbers, sql_phone("t"))
_text("number_replace", redact.replace_numbers, sql_number("t"))
_text("year_replace", redact.replace_years, sql_year("t"), "orders", "o_orderkey", "concat(substr(cast(o_orderdate AS string), 1, 10), ' ', substr(cast(o_orderdate AS string), 1, 4), 's')")
_text("currency_iso", lambda t: redact.replace_currencies(t, None), sql_iso("t"))
_text("currency_token", redact.replace_currencies, sql_currency_token("t"))
_text("strange_quotes", normalize.fix_strange_quotes, sql_quotes("t"), text="concat('“', text, '” ‘', lang, '’ «', source, '»')")
_text("to_ascii", arrow_stage.to_ascii_column, sql_ascii("t"))
_text("ws_single_line", lambda t: normalize.normalize_whitespace(t, no_line_breaks=True), sql_one_line("t"), text=_BREAKS)
_text("ws_lines", normalize.normalize_whitespace, sql_lines("t"), text=_BREAKS)
_text("ws_paragraphs", lambda t: normalize.normalize_whitespace(t, keep_two_line_breaks=True), sql_paragraphs("t"), text=_BREAKS)
_text("ws_keep_lines", lambda t: normalize.normalize_whitespace(t, strip_lines=False), sql_keep_lines("t"), text=_BREAKS)
_text("demojize", lambda t: arrow_stage.to_ascii_column(t, no_emoji=False), f"replace(replace({sql_ascii('t')}, '🙂', ':slightly_smiling_face:'), '✈', ':airplane:')", text="concat('🙂', text, ' ✈✈')")
_text("casefold", normalize.casefold, sql_casefold("t"))
_text("isolated_letters", filters.remove_isolated_letters, sql_letters("t"), text="concat('x ', replace(text, 'th', ' b '), ' c d')")
_text("bracket_contents", filters.remove_bracket_contents, sql_brackets("t"), "events", "event_id", "concat('a [', event_type, '] ', props, ' z')")
_text("isolated_symbols", filters.remove_symbol_runs, sql_symbols("t"))
_text("isolated_quotes", filters.remove_lone_marks, sql_marks("t"))
_text("punctuation", filters.remove_punctuation, sql_punctuation("t"))
_text("custom_words", lambda t: filters.remove_words(t, CUSTOM_WORDS), _wrapped("t", lambda x: _sub(x, rf"\b(?:{'|'.join(CUSTOM_WORDS)})\b")))
_text("detect_language", lambda t: language.detect_language(t, LANGUAGES), sql_language("t"))


def _fix_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts read as Latin-1, repaired."""
    garbled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return _table(spark, sf_dir, "documents").select("doc_id", arrow_stage.fix_bad_unicode_column(garbled).alias("result"))


def _unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with escapes for some letters, decoded."""
    escaped = F.replace(F.replace("text", F.lit("é"), F.lit("\\u00e9")), F.lit("\n"), F.lit("\\n"))
    return _table(spark, sf_dir, "documents").select("doc_id", arrow_stage.unescape_backslashes_column(escaped).alias("result"))


_add("fix_unicode", _fix_unicode, "SELECT doc_id, nfc_normalize(text) AS result FROM documents")
_add("unescape_backslash", _unescape, "SELECT doc_id, text AS result FROM documents")

_silent = _sub(_sub("t", "<!--.*?-->", flags="gs"), "<(?:style|script)[^>]*>.*?</(?:style|script)>", flags="gs")
_plain = _sub(_silent, "<[^>]*>")
for _entity, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "'"), ("#39", "'"), ("nbsp", "\xa0"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
    _plain = f"replace({_plain}, '&{_entity};', {_quoted(_char)})"
_text("html_to_text", arrow_stage.html_to_text_column, _plain, "pages", "page_id", "html")


def _stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return _table(spark, sf_dir, "documents").select("doc_id", filters.remove_stop_words(F.lower("text"), names[F.col("lang")], LANGUAGES).alias("result"))


_names = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODES.items()) + " END"
_add("stopwords", _stop_words, f"SELECT doc_id, {sql_stop_words('t', 'l')} AS result FROM (SELECT doc_id, lower(text) AS t, {_names} AS l FROM documents)")


def _exploded(function: Callable[[Column], Column]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(function(F.col("text"))).alias("pos", "result"))

    return query


def _unnested(listed: str) -> str:
    return f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS result FROM (SELECT doc_id, {listed} AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)"


_add("sentence_split", _exploded(filters.split_sentences), _unnested("string_split(" + _sub("text", r"([!?.])\s+([^0-9])", "\\1\x01\\2") + ", chr(1))"))
_add("chunk_split", _exploded(lambda t: entities.split_chunks(t, CHUNK_WORDS)), _unnested(rf"regexp_extract_all(text, '\s*(?:\S+\s*){{1,{CHUNK_WORDS}}}')"))
_marked = _sub(_sub("text", f"([{ACCENTED}])", r"Zq\1qZ"), r"([A-Z][.])(\W|$)", "\\1\x01\\2")  # a mark where a point may end an acronym
_acronym = "\\b(?:(?:[A-Z](?:[.]\x01?)?[&/0-9a-z-]?)+(?:[A-Z][.]\x01|[A-Z]s?\\b|[0-9]s?\\b)|[0-9](?:-?[A-Z])+\\b)"
_add("acronyms", _exploded(filters.extract_acronyms), _unnested(f"list_transform(regexp_extract_all({_marked}, {_quoted(_acronym)}), lambda a: replace(a, chr(1), ''))"))


def _blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"text": "text", "empty": "''", "spaces": "concat(' ', chr(10), chr(9))"}
    return _table(spark, sf_dir, "documents").select("doc_id", *[filters.is_blank(F.expr(x)).alias(f"{k}_blank") for k, x in kinds.items()])


_add("blank_rows", _blank, r"SELECT doc_id, NOT regexp_matches(text, '\S') AS text_blank, true AS empty_blank, true AS spaces_blank FROM documents")

# --- entities: arrays made of the documents' numbers ---------------------------------------------------------------

N_ENTITIES = 8
_GROUP = "CASE (doc_id + i) % 4 WHEN 0 THEN 'PER' WHEN 1 THEN 'LOC' WHEN 2 THEN 'ORG' ELSE 'MISC' END"
_SCORE = "CAST(60 + (doc_id * 7 + i * 13) % 40 AS DOUBLE) / 100"
_START = "CAST((doc_id + i * 3) % 4 * 12 AS INT)"
_LENGTH = "CAST(3 + (doc_id + i) % 2 AS INT)"


def _with_entities(df: DataFrame, shift: int = 0) -> Column:
    one = ", ".join(f"{x.replace(' i ', f' (i + {shift}) ').replace('+ i)', f'+ i + {shift})')} AS {n}" for x, n in ((_GROUP, "entity_group"), (_SCORE, "score"), ("'w'", "word"), (_START, "start"), (f"{_START} + {_LENGTH}", "end")))
    return F.expr(f"transform(sequence(0L, {N_ENTITIES - 1}L), i -> struct({one}))")


def _made(shift: int = 0) -> str:
    cols = (f"{x.replace(' i ', f' (i + {shift}) ').replace('+ i)', f'+ i + {shift})')} AS {n}" for x, n in ((_GROUP, "entity_group"), (_SCORE, "score"), (_START, '"start"'), (f"{_START} + {_LENGTH}", '"end"')))
    return f"SELECT doc_id, lang, text, i, {', '.join(cols)} FROM documents, range({N_ENTITIES}) r(i)"


def _entity_query(function: Callable[[DataFrame], Column]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents")
        return docs.select("doc_id", F.inline(function(docs))).select("doc_id", "entity_group", "score", "start", "end")

    return query


_FIELDS = 'doc_id, entity_group, score, "start", "end"'
_BEST = 'row_number() OVER (PARTITION BY doc_id, "start", "end" ORDER BY score DESC, i)'
_add("entity_tag_filter", _entity_query(lambda d: entities.filter_tags(_with_entities(d), TAGS)), f"SELECT {_FIELDS} FROM ({_made()}) WHERE entity_group IN {TAGS}")
_add("entity_confidence", _entity_query(lambda d: entities.filter_confident(_with_entities(d), THRESHOLD)), f"SELECT {_FIELDS} FROM ({_made()}) WHERE score >= {THRESHOLD}")
_add("entity_best_span", _entity_query(lambda d: entities.best_per_span(_with_entities(d))), f"SELECT {_FIELDS} FROM ({_made()}) QUALIFY {_BEST} = 1")
_add(
    "entity_vote",
    _entity_query(lambda d: entities.vote(_with_entities(d), 0.8)),
    f'SELECT {_FIELDS} FROM (SELECT *, avg(score) OVER (PARTITION BY doc_id, "start", "end") AS mean, {_BEST} AS best FROM ({_made()})) WHERE best = 1 AND mean >= 0.8',
)


def _routed(d: DataFrame) -> Column:
    names = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])[F.col("lang")]
    own = {"GERMAN": _with_entities(d, 1), "SPANISH": _with_entities(d, 2)}
    return entities.route(names, own, _with_entities(d, 3), _with_entities(d, 4), ("ORG",))


_add(
    "entity_route",
    _entity_query(_routed),
    f"""WITH a AS ({_made(1)}), b AS ({_made(2)}), c AS ({_made(3)}), e AS ({_made(4)}),
        english AS (SELECT DISTINCT doc_id FROM c WHERE entity_group = 'ORG')
        SELECT {_FIELDS} FROM a WHERE lang = 'de' AND entity_group = 'ORG' UNION ALL
        SELECT {_FIELDS} FROM b WHERE lang = 'es' AND entity_group = 'ORG' UNION ALL
        SELECT {_FIELDS} FROM c WHERE lang NOT IN ('de', 'es') AND entity_group = 'ORG' UNION ALL
        SELECT {_FIELDS} FROM e WHERE lang NOT IN ('de', 'es') AND entity_group = 'ORG' AND doc_id NOT IN (FROM english)""",
)


def _anonymized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five letters out of each ten at the start of a text, by groups that take turns."""
    spans = F.expr("transform(sequence(0, 5), i -> struct(CASE i % 4 WHEN 0 THEN 'PER' WHEN 1 THEN 'LOC' WHEN 2 THEN 'ORG' ELSE 'MISC' END AS entity_group, 0.9D AS score, '' AS word, i * 10 + 2 AS start, i * 10 + 7 AS `end`))")
    return _table(spark, sf_dir, "documents").select("doc_id", entities.anonymize(F.col("text"), spans).alias("result"))


def _sql_anonymized() -> str:
    parts = []
    for i, token in enumerate(("<PERSON>", "<LOCATION>", "<ORGANISATION>", None, "<PERSON>", "<LOCATION>")):
        middle = f"text[{i * 10 + 3}:{i * 10 + 7}]"
        parts += [f"text[{i * 10 + 1}:{i * 10 + 2}]", f"CASE WHEN length(text) >= {i * 10 + 7} THEN '{token}' ELSE {middle} END" if token else middle, f"text[{i * 10 + 8}:{i * 10 + 10}]"]
    return f"SELECT doc_id, {' || '.join(parts)} || text[61:] AS result FROM documents"


_add("anonymize", _anonymized, _sql_anonymized())


def _anonymized_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``_anonymized``, all over a text; without SQL, tests compare with brute force."""
    spans = F.expr("transform(sequence(0, CAST(length(text) DIV 10 AS INT)), i -> struct(CASE i % 4 WHEN 0 THEN 'PER' WHEN 1 THEN 'LOC' WHEN 2 THEN 'ORG' ELSE 'MISC' END AS entity_group, 0.9D AS score, '' AS word, i * 10 + 2 AS start, i * 10 + 7 AS `end`))")
    return _table(spark, sf_dir, "documents").select("doc_id", entities.anonymize(F.col("text"), spans).alias("result"))


_add("anonymize_whole", _anonymized_whole)

# --- whole plans ----------------------------------------------------------------------------------------------------

CONFIG = CleanConfig(ner=False, languages=LANGUAGES)


def _cleaned(*columns: str, cfg: CleanConfig = CONFIG):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pipeline.clean(_table(spark, sf_dir, "documents"), "text", cfg).select("doc_id", *columns)

    return query


_add("lm_text", _cleaned("lm_text"), f"SELECT doc_id, {sql_lm('text')} AS lm_text FROM documents")
_add(
    "stat_text",
    _cleaned("stat_text", "language"),
    f"SELECT doc_id, {sql_stat('t', 'language')} AS stat_text, language FROM (SELECT doc_id, {sql_lm('text')} AS t, {sql_language('text')} AS language FROM documents)",
)
_add(
    "fixed_language",
    _cleaned("stat_text", "language", cfg=dataclasses.replace(CONFIG, language="german")),
    f"SELECT doc_id, {sql_stat('t', chr(39) + 'GERMAN' + chr(39))} AS stat_text, 'GERMAN' AS language FROM (SELECT doc_id, {sql_lm('text')} AS t FROM documents)",
)

#: Words that a simple recognizer takes for entities, so that SQL can do the same.
ENTITY_WORDS = {"token": "PER", "und": "LOC", "que": "ORG"}


def word_recognizer(text: str) -> list[tuple[str, float, int, int]]:
    return [(ENTITY_WORDS[m.group()], 0.9, m.start(), m.end()) for m in re.finditer(rf"\b(?:{'|'.join(ENTITY_WORDS)})\b", text)]


def sql_words(x: str) -> str:
    """One token for words of a group in a row."""
    for word, group in ENTITY_WORDS.items():
        x = _sub(x, rf"\b{word}\b(?:\s+{word}\b)*", entities.TOKENS[group])
    return x


_add(
    "clean_words",
    _cleaned("lm_text", "stat_text", "language", cfg=dataclasses.replace(CONFIG, ner=True, recognizers=dict.fromkeys([*LANGUAGES, "MULTI"], word_recognizer))),
    f"""SELECT doc_id, t AS lm_text, {sql_stat('t', 'language')} AS stat_text, language
        FROM (SELECT doc_id, {sql_words(sql_lm('text'))} AS t, {sql_language('text')} AS language FROM documents)""",
)
_add("clean_struct", _cleaned("lm_text", "stat_text", "language", cfg=CleanConfig()))
