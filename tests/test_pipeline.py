"""The whole plan: what the settings leave of it, blank and null rows, batches, streams and partitions."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from scrubline import CleanConfig, TextCleaner, TextCleanerTransformer, clean
from scrubline.sources import from_strings, html_pages, read_texts, spread, write_texts
from scrubline.streaming import clean_stream, write_stream
from tests.compare import DATA

TEXT = """
    <b>Special   offer:</b> $30 at http://shop.example.com/x, ask John Smith &amp; write to john.smith@example.com
    or phone +1-234-567-8900 before 2024!  l e t t e r s *** Microsoft in New York.
"""
SENTENCES = {
    "ENGLISH": "John Smith works at Microsoft in London and he likes it very much.",
    "GERMAN": "Hans Müller arbeitet bei Siemens in Berlin und er ist sehr zufrieden.",
    "SPANISH": "Pablo García trabaja en Telefónica en Madrid y está muy contento.",
    "DUTCH": "Jan Jansen werkt bij Philips in Amsterdam en hij is zeer tevreden.",
}


def rows(spark, df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("id").collect()]


def test_the_whole_plan(spark):
    lm, stat, language = TextCleaner(spark).process(TEXT)
    for token in ("USD<NUMBER>", "<URL>", "<EMAIL>", "<PHONE>", "<YEAR>", "<PERSON>", "<ORGANISATION>", "<LOCATION>"):
        assert token in lm
    for gone in ("<b>", "John", "Smith", "Microsoft", "New York", "http", "***", "  ", "\n", " l e"):
        assert gone not in lm
    assert language == "ENGLISH" and stat == stat.lower() and "<" not in stat and "person" in stat and " at " not in stat


def test_four_languages(spark):
    got = TextCleaner(spark).process_batch(list(SENTENCES.values()))
    assert [g[2] for g in got] == list(SENTENCES)
    for lm, _, _ in got:
        assert "<PERSON>" in lm and "<LOCATION>" in lm and "<ORGANISATION>" in lm


def test_batches(spark):
    cleaner = TextCleaner(spark)
    assert cleaner.process_batch([]) == []
    assert cleaner.process_batch(["", " \n "]) == [("", "", None)] * 2
    assert cleaner.process_batch([TEXT] * 4, batch_size=2) == cleaner.process_batch([TEXT] * 4, batch_size=5)
    for wrong in (None, 5):
        with pytest.raises(ValueError):
            cleaner.process_batch(["a", wrong])


def test_null_rows(spark):
    df = from_strings(spark, [None, "", "a text"])
    assert rows(spark, clean(df, cfg=CleanConfig(languages=("ENGLISH",))), "lm_text", "stat_text", "language") == [(None, None, None), ("", "", None), ("a text", "text", "ENGLISH")]
    with pytest.raises(Exception, match="null"):
        clean(df, cfg=CleanConfig(null_policy="raise")).collect()


WHOLE: list = []
FLAGS = [f.name for f in dataclasses.fields(CleanConfig) if f.type == "bool"]


@pytest.mark.parametrize("flag", FLAGS)
def test_each_step_can_be_left_out(spark, flag):
    text = TEXT + " Ünïcode caf\\u00e9 «x» the"
    if not WHOLE:
        WHOLE.append(TextCleaner(spark).process(text))
    (whole,) = WHOLE
    part = TextCleaner(spark, CleanConfig(**{flag: False})).process(text)
    if flag == "stat_text":
        assert part == (whole[0], whole[2])
    elif flag == "detect_language":  # other steps need it still
        assert part == whole
    else:
        assert part != whole


def test_output_shapes(spark):
    none = dict.fromkeys(FLAGS, False)
    assert TextCleaner(spark, CleanConfig(**none)).process(" A  b ") == " A  b "
    assert TextCleaner(spark, CleanConfig(**none | {"stat_text": True, "casefold": True})).process(" A  b ") == (" A  b ", " a  b ", None)
    with pytest.raises(ValueError):
        CleanConfig(entity_tags=())
    with pytest.raises(ValueError):
        CleanConfig(null_policy="drop")


def test_a_fixed_language_is_kept(spark):
    text = "der Hund und the dog"
    got = TextCleaner(spark, CleanConfig(language="german", ner=False)).process(text)
    assert got == (text, "hund the dog", "GERMAN")
    assert TextCleaner(spark, CleanConfig(language="klingon", ner=False)).process("the dog is in the house")[2] == "ENGLISH"


def test_tokens_are_put_in_as_they_are(spark):
    cfg = CleanConfig(ner=False, url_token=r"$0\1", email_token="", remove_isolated_symbols=False, replace_numbers=False, replace_currencies=False)
    assert TextCleaner(spark, cfg).process("see http://a.example.com or me@b.example.com now")[0] == r"see $0\1 or now"


def test_own_recognizers_and_custom_stop_words(spark):
    names = {"ENGLISH": lambda t: [("PER", 0.5, 0, 3)], "MULTI": lambda t: [("ORG", 0.99, 0, 3)]}
    base = dict(recognizers=names, language="ENGLISH", custom_stop_words=("cat",))
    assert TextCleaner(spark, CleanConfig(**base)).process("abc cat dog") == ("abc cat dog", "abc dog", "ENGLISH")
    assert TextCleaner(spark, CleanConfig(**base, ner_threshold=0.4)).process("abc cat dog")[0] == "<PERSON> cat dog"
    assert TextCleaner(spark, CleanConfig(**base, entity_tags=("ORG",))).process("abc cat dog")[0] == "<ORGANISATION> cat dog"


def test_a_long_text_in_chunks(spark):
    text = "John Smith " * 2000
    lm = TextCleaner(spark, CleanConfig(ner_chunk_words=7)).process(text)[0]
    assert "John" not in lm


def test_partitions_change_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    one, many = (rows(spark, clean(docs.repartition(n)), "id", "lm_text", "stat_text", "language") for n in (1, 7))
    assert one == many


def test_transformer_and_prefix(spark):
    df = from_strings(spark, [TEXT])
    out = TextCleanerTransformer(prefix="c_").transform(df)
    assert out.columns == ["id", "text", "c_language", "c_lm_text", "c_stat_text"]
    assert out.first()["c_lm_text"] == TextCleaner(spark).process(TEXT)[0]


def test_no_shuffle_and_one_python_stage_before_entities(spark):
    df = clean(spark.read.parquet(f"{DATA}/documents.parquet"), cfg=CleanConfig(ner=False)).select("doc_id", "lm_text", "stat_text", "language")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1 and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_streams_like_batches(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    write_texts(docs.repartition(3), f"{tmp_path}/in")
    stream = read_texts(spark, f"{tmp_path}/in", streaming=True, schema="id long, text string")
    write_stream(clean_stream(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    columns = ("id", "lm_text", "stat_text", "language")
    assert rows(spark, spark.read.parquet(f"{tmp_path}/out"), *columns) == rows(spark, clean(docs), *columns)
    with pytest.raises(ValueError):
        clean_stream(docs)


def test_text_files_and_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert sorted(r["text"] for r in read_texts(spark, str(tmp_path), "text").collect()) == ["one", "two"]
    assert [r["text"] for r in read_texts(spark, str(tmp_path), "wholetext").collect()] == ["one\ntwo"]
    pages = html_pages(spark, f"{DATA}/pages.parquet")
    assert not pages.filter("text like '%<p>%'").count()


def test_one_row_group_is_dealt_out_and_many_files_arent(spark, tmp_path):
    docs = from_strings(spark, [f"text {i}" for i in range(100)])
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    docs.repartition(40).write.parquet(f"{tmp_path}/many")
    one, many = (spread(spark.read.parquet(f"{tmp_path}/{n}")) for n in ("one", "many"))
    assert one.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and one.count() == 100
    assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString()
    assert spread(docs).count() == 100
