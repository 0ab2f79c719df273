"""The last steps in Python against those in the JVM, on the same texts in ASCII."""

import dataclasses
import random
import string

import pytest
from pyspark.sql import functions as F

from scrubline import CleanConfig
from scrubline.operators import ascii_stage, filters, normalize, redact
from scrubline.plans import pipeline

STEPS = {
    "urls": (lambda t: redact.replace_urls(t, "\\1$0"), lambda t: ascii_stage.replace_urls(t, "\\1$0")),
    "years": (redact.replace_years, lambda t: ascii_stage.replace_years(t, "<YEAR>")),
    "phones": (redact.replace_phone_numbers, lambda t: ascii_stage.replace_phone_numbers(t, "<PHONE>")),
    "numbers": (redact.replace_numbers, lambda t: ascii_stage.replace_numbers(t, "<NUMBER>")),
    "currencies": (lambda t: redact.replace_currencies(t, None), lambda t: ascii_stage.replace_currencies(t, None)),
    "currency token": (lambda t: redact.replace_currencies(t, "\\1$0"), lambda t: ascii_stage.replace_currencies(t, "\\1$0")),
    "letters": (filters.remove_isolated_letters, ascii_stage.remove_isolated_letters),
    "symbols": (filters.remove_isolated_symbols, ascii_stage.remove_isolated_symbols),
    "one line": (lambda t: normalize.normalize_whitespace(t, no_line_breaks=True), ascii_stage.on_one_line),
    "lines": (normalize.normalize_whitespace, ascii_stage.on_lines),
    "punctuation": (filters.remove_punctuation, ascii_stage.remove_punctuation),
}


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    kinds = [string.printable + "\x1c\x1d\x1e\x1f\x00\x7f", "ab  \n,.", "[]{} a.", "$$ 1", " b\t\nI,", "a(*)'- ", "the and und der ".split(" ") + [" ", "-"]]
    kinds += ["0123456789 .,-+", "19 20 1999 2024 a _ . \n".split(" ") + [" "], "+1 (234) 555 5678 0 00 ext x # - . / ) a 12345 1,234,567.8".split(" ") + [" "]]
    kinds += ["http:// HTTPS:// ftp:// www. www2. a.b example com .org 10.0.0.1 8.8.8.8 localhost :80 :8080 / /x ) ] - user@ x".split(" ") + [" "]]
    made = ["", " ", "b", "b c", "\nb", "  b", "   b", "b\nc\n", "[" * 9, "{a", "a[b", "$", ".a.", "a..b", "(-)"]
    made += ["".join(rng.choice(kind) for _ in range(rng.randint(0, 25))) for kind in kinds for _ in range(1500)]
    return spark.createDataFrame([(t,) for t in made], "t string").repartition(8).cache()


@pytest.mark.parametrize("name", STEPS)
def test_a_step(texts, name):
    of_jvm, of_python = STEPS[name]
    wrong = [(r[0], r[1], of_python(r[0])) for r in texts.select("t", of_jvm(F.col("t"))).collect() if r[1] != of_python(r[0])]
    assert not wrong, wrong[:5]


@pytest.mark.parametrize("change", [{}, {"casefold": False}, {"remove_stop_words": False}, {"remove_punctuation": False}, {"remove_isolated_letters": False}, {"normalize_whitespace": False}, {"currency_token": "<C>"}])
def test_all_steps(texts, change):
    cfg = dataclasses.replace(CleanConfig(), **change)
    for language in ("ENGLISH", "GERMAN", "FRENCH", None):
        lm, stat = pipeline.last_redactions(F.col("t"), cfg), pipeline.statistics_text(F.col("t"), F.lit(language).cast("string"), cfg)
        redact_, reduce = ascii_stage.last_redactions(cfg), ascii_stage.statistics_text(cfg)
        every = pipeline.last_redactions(pipeline.redaction(F.col("t"), cfg), cfg)
        wrong = [r for r in texts.select("t", lm, stat, every).collect() if (r[1], r[2]) != (redact_(r[0]), reduce(r[0], language)) or ascii_stage.redactions(cfg)(r[0]) not in (None, r[3])]
        assert not wrong, wrong[:3]


def test_texts_that_are_not_ascii_are_left_to_the_jvm(spark):
    """By the same steps, whether a text is in ASCII from the start, only after the redactions, or never."""
    texts = ["see http://a.example.org/x, call 234 555 5678 in 1999 for $5.50 or 7", "write to a.b@example.org in 1999", "a B c [x] $5 Foo.", "ä B c [ö] €€ Foo.", "x · y", "Ünder £ the Straße ςΣ", None, " ", "$ · a b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for change in ({}, {"custom_stop_words": ("foo",)}, {"currency_token": "€"}, {"currency_token": "<C>"}, {"ner": False}):
        cfg = dataclasses.replace(CleanConfig(to_ascii=False, language="english"), **change)
        t = F.col("text")
        lm = F.when(filters.is_blank(t), "").otherwise(pipeline.last_redactions(pipeline.redaction(t, cfg), cfg))
        want = df.select("text", lm.alias("lm_text")).withColumn("stat_text", pipeline.statistics_text(F.col("lm_text"), F.lit("ENGLISH"), cfg))
        got = pipeline.clean(df, "text", cfg).select("text", "lm_text", "stat_text")
        key = lambda r: str(r[0])
        assert [r[:] for r in sorted(got.collect(), key=key)] == [(r[0], None, None) if r[0] is None else r[:] for r in sorted(want.collect(), key=key)]


@pytest.mark.parametrize("unit", ["[", "{", "$", ".", "-", " b", " ", "\n", "a.", "[a]", "1", "1,", "1 ", "1.1", "www.", "http://", "a-1.", "(1"])
def test_long_runs_take_little_time(unit):
    import time

    cfg, began = CleanConfig(), time.monotonic()
    ascii_stage.statistics_text(cfg)(ascii_stage.redactions(cfg)(unit * 300_000), "ENGLISH")
    assert time.monotonic() - began < 5
