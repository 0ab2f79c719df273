"""Golden rows of each operator, worked out by hand, and long runs that must not exhaust the JVM's stack."""

import random

import pytest
from pyspark.sql import functions as F

from scrubline.functions import (
    anonymize,
    casefold,
    detect_language,
    extract_acronyms,
    fix_bad_unicode_column,
    fix_strange_quotes,
    html_to_text_column,
    normalize_whitespace,
    register,
    remove_bracket_contents,
    remove_isolated_letters,
    remove_isolated_symbols,
    remove_lone_marks,
    remove_punctuation,
    remove_stop_words,
    remove_symbol_runs,
    remove_words,
    replace_currencies,
    replace_emails,
    replace_numbers,
    replace_phone_numbers,
    replace_urls,
    replace_years,
    split_chunks,
    split_sentences,
    to_ascii_column,
    unescape_backslashes_column,
)
from scrubline.operators.arrow_stage import demojize, repair_mojibake
from scrubline.operators.entities import ENTITIES, anonymize_text

one_line = lambda t: normalize_whitespace(t, no_line_breaks=True)
paragraphs = lambda t: normalize_whitespace(t, keep_two_line_breaks=True)
no_strip = lambda t: normalize_whitespace(t, strip_lines=False)
iso = lambda t: replace_currencies(t, None)

GOLDEN = [
    (replace_years, "in 1999 and 2020s", "in <YEAR> and 2020s"),
    (replace_years, "1899 1900 2099 2100 x1999 1999x", "1899 <YEAR> <YEAR> 2100 x1999 1999x"),
    (lambda t: replace_numbers(replace_years(t)), "on 2023-10-01.", "on <YEAR><NUMBER>-<NUMBER>."),
    (replace_numbers, "5th of 50%", "5th of <NUMBER>%"),
    (replace_numbers, "10 200 people", "<NUMBER> people"),
    (replace_numbers, "v 1.2.3", "v <NUMBER>.3"),
    (replace_numbers, "192.168.1.1", "<NUMBER>.1.1"),
    (replace_numbers, "1,234.56 and 1.234,56 and -7 and –8 and .5", "<NUMBER> and <NUMBER> and <NUMBER> and <NUMBER> and <NUMBER>"),
    (replace_phone_numbers, "at +1-234-567-8900.", "at <PHONE>."),
    (replace_phone_numbers, "id 1234567 ok", "id <PHONE> ok"),
    (replace_phone_numbers, "555-2010 x55, (030) 123 4567 ext. 12 or 12345678901234567", "<PHONE>, <PHONE> or <PHONE>"),
    (lambda t: replace_phone_numbers(replace_years(t)), "555-2010", "555-<YEAR>"),
    (replace_emails, "a%b@x.com", "a%<EMAIL>"),
    (replace_emails, "to b@x.com; c", "to <EMAIL> c"),
    (replace_emails, "x.y+z(at)mail.example.org, a[at]b.de. é@x.fr", "<EMAIL>, <EMAIL>. <EMAIL>"),
    (replace_urls, "see www.example.com?x=1 ok", "see <URL> ok"),
    (replace_urls, "example.com", "example.com"),
    (replace_urls, "http://10.0.0.1/ http://10.0.0.12 ftp://8.8.8.8:21/x) HTTPS://localhost:8080/a]", "http://10.0.0.1/ <URL> <URL>) <URL>]"),
    (replace_urls, "xhttp://a.com (https://sub-a.ex-b.co.uk/p?q=1#f)", "xhttp://a.com (<URL>)"),
    (iso, "$$5 zł", "USDUSD5 PLN"),
    (iso, "£¥฿₡₦₩₪₫€₱₲₴₹", "GBPJPYTHBCRCNGNKRWILSVNDEURPHPPYGUAHINR"),
    (replace_currencies, "$$5 zł€ x", "<CUR>5 <CUR> x"),
    (lambda t: replace_currencies(t, r"\1$0"), "€", r"\1$0"),
    (remove_isolated_letters, "I saw a l e t u", " saw a u"),
    (remove_isolated_symbols, "((foo word... ok", "(foo word. ok"),
    (remove_symbol_runs, "a . b ,.; c!!d !! e", "a  b  c!!d  e"),
    (remove_lone_marks, "it's 'a' - b-c * % 5%", "it's 'a'  b-c   5%"),
    (remove_bracket_contents, "a [img] {x} b", "a   b"),
    (remove_bracket_contents, "[a\nb] [] {} {c", " [] {} {c"),
    (remove_punctuation, "<person> it's", "person its"),
    (lambda t: remove_stop_words(t, "ENGLISH"), "the, the cat", "the, cat"),
    (lambda t: remove_stop_words(t, F.lit(None).cast("string")), "the cat", "the cat"),
    (lambda t: remove_words(t, ["cat"]), "a cat cats", "a  cats"),
    (lambda t: remove_words(t, ["c++", "a.b"]), "a.b axb c++x", " axb c++x".replace("c++x", "x")),
    (one_line, "\ta\r\n  b\n", "a b"),
    (normalize_whitespace, "a  b\n\n c", "a b\nc"),
    (paragraphs, "a \n \t\n\n b\nc", "a\n\nb\nc"),
    (no_strip, "a \n b\n\nc", "a b\nc"),
    (casefold, "STRAẞE Straße ΣΑΣ", "strasse strasse σασ"),
    (fix_strange_quotes, "“a” ‘b’ «c» `d´", "\"a\" 'b' \"c\" 'd'"),
    (to_ascii_column, "Ærøskøbing Łódź straße – “x” 😀 Москва", 'AEroskobing Lodz strasse - "x"  Moskva'),
    (fix_bad_unicode_column, "schÃ¶n cafÃ©", "schön café"),
    (fix_bad_unicode_column, "a &amp; b &lt;", "a & b <"),
    (fix_bad_unicode_column, "&amp; <b>", "&amp; <b>"),
    (fix_bad_unicode_column, "ﬁne “x” e\u0301 １２\x1b[31mred\x00", 'fine "x" é 12red'),
    (unescape_backslashes_column, r"caf\u00e9\n\x41", "café\nA"),
    (unescape_backslashes_column, r"C:\new\xzz", r"C:\new\xzz"),
    (fix_bad_unicode_column, "schÃ¶n 😀 cafÃ© â€œxâ€\x9d ÃƒÂ© Ð¿Ñ€Ð¸", 'schön 😀 café "x" é при'),
    (fix_bad_unicode_column, "«CAFÉ» É» Äpfel Straße 東", "«CAFÉ» É» Äpfel Straße 東"),
    (html_to_text_column, "<p>a &amp; <b>b</b><!-- c --><script>x<y</script><style>p{}</style>d</p>", "a & bd"),
    (html_to_text_column, "no markup 1 < 2", "no markup 1 < 2"),
    (html_to_text_column, "<title>a&amp;&amp</title>b &quot", "a&&ampb &quot"),
    (html_to_text_column, "<p>?a=1&region=2&copy=3&ampx; &nosuch; &lt;&#39;&#x27; &</p>", "?a=1&region=2&copy=3&ampx; &nosuch; <'' &"),
    (html_to_text_column, "<![CDATA[a & b]]>\U0010ffff &", "a & b\U0010ffff &"),
    (fix_bad_unicode_column, "?a=1&region=2 &amp; &copy", "?a=1&region=2 & &copy"),
]


@pytest.mark.parametrize("i", range(1))
def test_golden_rows(spark, i):
    row = spark.range(1).select(*[f(F.lit(text)).alias(f"c{k}") for k, (f, text, _) in enumerate(GOLDEN)]).first()
    wrong = {f"{k}: {text!r}": (row[k], want) for k, (_, text, want) in enumerate(GOLDEN) if row[k] != want}
    assert not wrong


def test_null_stays_null(spark):
    functions = [f for f, _, _ in GOLDEN]
    row = spark.createDataFrame([(None,)], "t string").select(*[f(F.col("t")).alias(f"c{k}") for k, f in enumerate(functions)]).first()
    assert all(x is None for x in row)


def test_lists(spark):
    df = spark.createDataFrame([("One. Two! 3 is. 4 no? Yes",)], "t string")
    row = df.select(split_sentences(F.col("t")), split_chunks(F.col("t"), 2), split_chunks(F.lit("  "), 2), extract_acronyms(F.lit("The U.S. and NATO's R&D2, 3-D but not Abc"))).first()
    assert row[0] == ["One.", "Two! 3 is. 4 no?", "Yes"]
    assert row[1] == ["One. Two! ", "3 is. ", "4 no? ", "Yes"] and "".join(row[1]) == "One. Two! 3 is. 4 no? Yes"
    assert row[2] == [] and row[3] == ["U.S.", "NATO", "R&D2", "3-D"]
    assert df.select(extract_acronyms(F.lit("3AB-Cx A.B.c éAB ABé PCs"))).first()[0] == ["3AB", "A.B", "PCs"]


def test_languages(spark):
    texts = ["The people live in the house and they like it.", "De mensen wonen in het huis en zij vinden het goed.", "Die Leute wohnen in dem Haus und sie sind gut.", "La gente vive en la casa y está muy bien.", "qqq zzz", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(detect_language(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["ENGLISH", "DUTCH", "GERMAN", "SPANISH", None, None]


def test_short_texts_without_common_words_have_a_language(spark):
    texts = {"schwimmend": "GERMAN", "querían comerciantes": "SPANISH", "woonplaatsen": "DUTCH", "wherever": "ENGLISH", "12 %": None, "東京": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", detect_language(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == texts
    long = "zzq " * 50_000
    assert spark.range(1).select(detect_language(F.lit(long))).first()[0] is None


def test_anonymised_spans(spark):
    text = "John Smith of Microsoft"
    cases = [
        ([("PER", 0.9, "", 0, 4), ("PER", 0.9, "", 5, 10), ("ORG", 0.9, "", 14, 23)], "<PERSON> of <ORGANISATION>"),
        ([("PER", 0.9, "", 0, 10), ("LOC", 0.8, "", 5, 10)], "<PERSON> of Microsoft"),
        ([("MISC", 0.9, "", 0, 4), ("PER", 0.9, "", -1, 4), ("PER", 0.9, "", 20, 99)], text),
        ([("PER", 0.9, "", 0, 8), ("LOC", 0.9, "", 5, 13)], "<PERSON><LOCATION> Microsoft"),
        ([], text),
    ]
    df = spark.createDataFrame([(i, text, e) for i, (e, _) in enumerate(cases)], f"i int, t string, e {ENTITIES}")
    got = [r[1] for r in sorted(df.select("i", anonymize(F.col("t"), F.col("e"))).collect())]
    assert got == [want for _, want in cases]


def test_python_anonymises_like_the_jvm(spark):
    rng = random.Random(8)
    text = "ab cd  ef gh ij kl mn"
    cases = [[(rng.choice(["PER", "LOC", "ORG", "MISC"]), rng.choice([0.8, 0.9]), "", a, a + rng.randint(0, 7)) for a in (rng.randint(-1, 20) for _ in range(rng.randint(0, 7)))] for _ in range(400)]
    cases = [list({(e[3], e[4]): e for e in c}.values()) for c in cases]  # one a span, as best_per_span leaves it
    df = spark.createDataFrame(list(enumerate(cases)), f"i int, e {ENTITIES}")
    got = [r[1] for r in sorted(df.select("i", anonymize(F.lit(text), F.col("e"))).collect())]
    assert got == [anonymize_text(text, [(g, s, a, b) for g, s, _, a, b in c]) for c in cases]


def test_many_entities_of_one_span(spark):
    """However many there are, the one that scores most counts."""
    case = [("PER", 0.5 + i / 1000, "", 0, 2) for i in range(100)] + [("LOC", 0.9, "", 0, 2)]
    df = spark.createDataFrame([(case,)], f"e {ENTITIES}")
    assert df.select(anonymize(F.lit("ab cd"), F.col("e"))).first()[0] == anonymize_text("ab cd", [(g, s, a, b) for g, s, _, a, b in case]) == "<LOCATION> cd"


def test_mojibake_of_any_depth():
    text = garbled = "schön – “東京” 😀"
    for _ in range(7):
        garbled = garbled.encode().decode("latin-1")
    assert repair_mojibake(garbled) == text


def test_long_runs_dont_exhaust_the_stack(spark):
    n = 100_000
    runs = ["a" * n, "\n" * n, "a-" * n, "[" * n, "$" * n, "1" * n, "1," * n, "a." * n, "www." + "a." * n, "x@" + "a-" * n, ". " * n, "1 111" * n, " \n" * n, "A." * n]
    df = spark.createDataFrame(list(enumerate(runs)), "i int, t string").repartition(8)
    functions = [replace_urls, replace_emails, replace_years, iso, replace_currencies, replace_numbers, remove_isolated_letters, remove_isolated_symbols, one_line, normalize_whitespace, paragraphs, split_sentences, extract_acronyms]
    out = df.select(*[f(F.col("t")).alias(f"c{k}") for k, f in enumerate(functions)])
    assert len(out.collect()) == len(runs)


def test_sql_functions(spark):
    names = register(spark, "sl_")
    assert "sl_replace_years" in names
    row = spark.sql(r"SELECT sl_replace_years('in 1999') a, sl_html_to_text('<b>x</b>') b, sl_remove_punctuation('a''b\\c') c, sl_fix_strange_quotes('“') d, sl_replace_numbers('v 7') e").first()
    assert tuple(row) == ("in <YEAR>", "x", "abc", '"', "v <NUMBER>")


def test_pictographs_by_name():
    assert demojize("ok 😀") == "ok :grinning_face:"


def test_a_batch_becomes_strings_part_by_part(monkeypatch):
    """All texts of a batch were strings at once, of up to four bytes a character, beside all results."""
    import pyarrow as pa

    from scrubline.operators import arrow_stage

    monkeypatch.setattr(arrow_stage, "PART", 100)
    texts = ["x" * 30, None, "", "é" * 70, "y" * 500, None, "z", ""] * 5
    parts = [(list(a), list(b)) for a, b in arrow_stage.text_parts(pa.array(texts).slice(3), pa.array(range(40)).slice(3))]
    assert [t for a, _ in parts for t in a] == texts[3:] and [i for _, b in parts for i in b] == list(range(3, 40))
    assert len(parts) > 10 and all(sum(sorted(len(t or "") for t in a)[:-1]) <= 100 for a, _ in parts)
    assert arrow_stage.joined(a for a, _ in parts).to_pylist() == texts[3:]
    assert list(arrow_stage.text_parts(pa.array([], pa.string()))) == [[[]]] and len(arrow_stage.joined([])) == 0


def test_queries_and_plans_keep_batches_small(spark):
    from scrubline import clean
    from scrubline.plans import queries
    from scrubline.sources import BATCH_BYTES, BATCH_SETTING
    from tests.compare import DATA

    for use in (lambda: queries.QUERIES["to_ascii"](spark, DATA), lambda: clean(spark.createDataFrame([("a",)], "text string"))):
        spark.conf.unset(BATCH_SETTING)
        use()
        assert spark.conf.get(BATCH_SETTING) == BATCH_BYTES
    spark.conf.set(BATCH_SETTING, "5m")
    queries.QUERIES["to_ascii"](spark, DATA)
    assert spark.conf.get(BATCH_SETTING) == "5m"
    spark.conf.unset(BATCH_SETTING)
