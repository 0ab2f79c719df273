"""The whole cleaning plan: from a text column to language-model text, statistics text and language."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CleanConfig
from ..operators import ascii_stage, filters, language, normalize, redact
from ..operators.arrow_stage import arrow_stage
from ..sources import small_batches


def _chain(text: Column, steps: Sequence[tuple[bool, Callable[[Column], Column]]]) -> Column:
    for wanted, step in steps:
        if wanted:
            text = step(text)
    return text


def redaction(text: Column, cfg: CleanConfig) -> Column:
    """The steps after the first Python stage, in their order: tokens for what patterns find."""
    steps = [
        (cfg.replace_urls, lambda t: redact.replace_urls(t, cfg.url_token)),
        (cfg.replace_emails, lambda t: redact.replace_emails(t, cfg.email_token)),
        (cfg.replace_years, lambda t: redact.replace_years(t, cfg.year_token)),
        (cfg.replace_phones, lambda t: redact.replace_phone_numbers(t, cfg.phone_token)),
        (cfg.replace_numbers, lambda t: redact.replace_numbers(t, cfg.number_token)),
    ]
    return _chain(text, steps)


def last_redactions(text: Column, cfg: CleanConfig) -> Column:
    """The steps between ``redaction`` and the entities, of texts that aren't in ASCII; of others ``ascii_stage`` takes them."""
    steps = [
        (cfg.replace_currencies, lambda t: redact.replace_currencies(t, cfg.currency_token)),
        (cfg.remove_isolated_letters, filters.remove_isolated_letters),
        (cfg.remove_isolated_symbols, filters.remove_isolated_symbols),
        (cfg.normalize_whitespace, lambda t: normalize.normalize_whitespace(t, no_line_breaks=True)),
    ]
    return _chain(text, steps)


def statistics_text(text: Column, lang: Column, cfg: CleanConfig) -> Column:
    """From language-model text to text for statistics: case, stop words, punctuation, lone letters, white space."""
    if cfg.casefold:
        text = normalize.casefold(text)
    if cfg.remove_stop_words:
        text = filters.remove_stop_words(text, lang, cfg.languages)
    if cfg.custom_stop_words:
        text = filters.remove_words(text, cfg.custom_stop_words)
    if cfg.remove_punctuation:
        text = filters.remove_punctuation(text)
    if cfg.remove_isolated_letters:
        text = filters.remove_isolated_letters(text)
    if cfg.normalize_whitespace:
        text = normalize.normalize_whitespace(text)
    return text


def clean(df: DataFrame, text_col: str = "text", cfg: CleanConfig | None = None, prefix: str = "") -> DataFrame:
    """``df`` with ``lm_text`` and, as ``cfg`` has it, ``stat_text`` and ``language``; works on batches and streams, without a shuffle.

    Each text is read once by each stage: the expensive columns are made in projections of their own. A null text gives
    nulls (or fails, with ``null_policy`` "raise"), a blank one empty texts and a null language. The language is that of the raw text.
    """
    cfg = cfg or CleanConfig()
    small_batches(df.sparkSession)
    lm, stat, lang = (prefix + n for n in ("lm_text", "stat_text", "language"))
    raw_name = "__raw"
    while raw_name in df.columns:
        raw_name += "_"
    done = "__done"
    while done in df.columns:
        done += "_"
    raw = F.col(text_col).cast("string")
    if cfg.null_policy == "raise":
        raw = F.coalesce(raw, F.raise_error(F.lit("a text is null")).cast("string"))
    blank = filters.is_blank(F.col(raw_name))
    out = df.withColumn(raw_name, raw)
    if cfg.fixed_language:
        detected = F.lit(cfg.fixed_language)
    elif cfg.needs_language:
        detected = language.detect_language(F.col(raw_name), cfg.languages)
    else:
        detected = F.lit(None).cast("string")
    out = out.withColumn(lang, F.when(~blank & F.col(raw_name).isNotNull(), detected))
    # a blank text is emptied first: a condition around the steps would keep what they share from being worked out once
    text = F.when(blank, F.lit("")).otherwise(F.col(raw_name))
    if cfg.ner:
        staged = arrow_stage(text, cfg.fix_unicode, cfg.to_ascii, cfg.replace_html, cfg.html_token)
        out = out.withColumn(lm, redaction(staged, cfg))
        plain = F.coalesce(F.length(lm) == F.octet_length(lm), F.lit(False)) if ascii_stage.last_redactions(cfg) else F.lit(False)
        out = out.withColumn(done, ascii_stage.last_stage(F.when(plain, F.col(lm)).otherwise(last_redactions(F.col(lm), cfg)), plain, F.col(lang), cfg))
        out = out.withColumn(lm, F.col(done)["lm"])
    else:
        out = out.withColumn(done, ascii_stage.whole_stage(text, F.col(lang), cfg))
        out = out.withColumn(lm, F.coalesce(F.col(done)["lm"], last_redactions(redaction(F.col(done)["text"], cfg), cfg)))
    if cfg.stat_text:
        out = out.withColumn(stat, F.coalesce(F.col(done)["stat"], statistics_text(F.col(lm), F.col(lang), cfg)))
    if not (cfg.stat_text or cfg.detect_language):
        out = out.drop(lang)
    return out.drop(raw_name, done)


class TextCleaner:
    """Cleaning of Python strings, for a few texts at a time; ``clean`` is for tables."""

    def __init__(self, spark: SparkSession, cfg: CleanConfig | None = None):
        self.spark, self.cfg = spark, cfg or CleanConfig()

    def process_batch(self, texts: Sequence[str], batch_size: int | None = None) -> list:
        """For each text (lm_text, stat_text, language), or what of it the settings leave; ``batch_size`` changes nothing."""
        if not texts:
            return []
        for t in texts:
            if not isinstance(t, str):
                raise ValueError(f"a text must be a string, not {type(t).__name__}")
        df = self.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
        rows = sorted(clean(df, "text", self.cfg).collect(), key=lambda r: r["i"])
        fields = [c for c in ("lm_text", "stat_text", "language") if c in rows[0]]
        return [tuple(r[c] for c in fields) if len(fields) > 1 else r[fields[0]] for r in rows]

    def process(self, text: str):
        return self.process_batch([text])[0]


class TextCleanerTransformer(Transformer):
    """``clean`` as a stage of a ``pyspark.ml`` pipeline."""

    def __init__(self, text_col: str = "text", cfg: CleanConfig | None = None, prefix: str = ""):
        super().__init__()
        self.text_col, self.cfg, self.prefix = text_col, cfg or CleanConfig(), prefix

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return clean(dataset, self.text_col, self.cfg, self.prefix)
