import base64
import os
import random
import unicodedata

import numpy as np
import pytest

from scrubline.llm import bpe, token_counts
from scrubline.llm.bpe import Codec, decode, encode, serialize
from scrubline.llm.token_counts import PRE_TOKENS, VOCABULARY, Remembering, merge, odd_signs, pre_tokenizer, read_ranks, whole_tokens
from tests.compare import DATA

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
TEXTS = ["", " ", "Hello world's  end\n\n\n next", "naïve café 東京 🙂🙂", "12345 a1b2 don't I'LL", "<|endoftext|>", "\x00\x7f\t \r\n", "a" * 5000, "ab" * 20_000, " " * 3000 + "x", "xyzzy" * 3, "é‍"]


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(VOCABULARY)


def tokenizer(ranks):
    import tiktoken

    import public_tokenizers as P

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(n):
    rng = random.Random(9)
    return ["".join(rng.choice("aàbc dE1 2.,'s\n\t東🙂-_ ") for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_counts_and_tokens_like_a_library(spark, ranks):
    t, texts = tokenizer(ranks), TEXTS + noise(800)
    want = [t.encode_ordinary(x) for x in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    counts = {r["doc_id"]: r for r in token_counts.token_counts(df).collect()}
    assert [counts[i]["n_tokens"] for i in range(len(texts))] == list(map(len, want))
    assert all(0 <= r["n_whole"] <= r["n_tokens"] for r in counts.values())
    coded = encode(df).cache()
    got = {r["doc_id"]: r for r in coded.collect()}
    assert [list(got[i]["tokens"]) for i in range(len(texts))] == want
    assert all(r["round_trip"] for r in got.values())
    assert {r["doc_id"]: r["text"] for r in decode(coded).collect()} == dict(enumerate(texts))


def test_real_documents_like_a_library(spark, ranks):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    t, texts = tokenizer(ranks), {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: list(r["tokens"]) for r in encode(docs).collect()} == {i: t.encode_ordinary(x) for i, x in texts.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs).collect()} == {i: len(t.encode_ordinary(x)) for i, x in texts.items()}


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "a b"), (None, "a b")], "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as tokens")
    assert sorted((r[0] is None, r[1] is None, r[1]) for r in token_counts.token_counts(df).collect()) == [(False, False, 0), (False, True, None), (True, False, 2), (True, False, 2)]
    rows = encode(df).collect()
    assert sorted(r["n_tokens"] is None for r in rows) == [False, False, False, True]
    assert token_counts.token_counts(df.limit(0)).count() == encode(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [10**6]), (3, [None]), (4, []), (5, [220])], "doc_id long, tokens array<int>")
    assert {r[0]: r[1] for r in decode(odd).collect()} == {1: None, 2: None, 3: None, 4: "", 5: " "}


def test_the_shortcut_is_proved_by_merging(ranks):
    proved = whole_tokens(ranks)
    assert len(proved) > 0.9 * len(ranks)
    for s in random.Random(3).sample(sorted(proved), 300):
        assert merge(s.encode(), ranks) == [ranks[s.encode()]]
    toy = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5, b"ca": 6, b"cab": 7}
    assert whole_tokens(toy) == {"a", "b", "c", "ab", "bc", "ca", "abc", "cab"} - ({"cab"} if merge(b"cab", toy) != [7] else set())
    unreachable = {b"a": 0, b"b": 1, b"c": 2, b"d": 3, b"bc": 4, b"ab": 5, b"cd": 6, b"abcd": 7}
    assert whole_tokens(unreachable) == {"a", "b", "c", "d", "ab", "bc", "cd"}


def test_long_pieces_merge_like_short_ones(ranks):
    rng = random.Random(1)
    for n in (300, 700):
        piece = bytes(rng.choice(b"abcdeft ") for _ in range(n))
        parts = [piece[i : i + 1] for i in range(n)]
        while True:
            best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert merge(piece, ranks) == [ranks[p] for p in parts]


def test_memory_of_pieces_is_bounded():
    known = Remembering({"a": 1}, len, 10)
    for i in range(100):
        assert known[str(i)] == len(str(i))
    assert len(known) <= 11 and known["a"] == 1


def test_the_model_is_made_from_the_vocabulary_alone(tmp_path):
    toy = {bytes([b]): b for b in range(256)} | {b"ab": 256, b" a": 257, b"aba": 258}
    path = tmp_path / "toy.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in toy.items()))
    assert read_ranks(str(path)) == toy
    codec = Codec(serialize(toy), toy)
    assert codec.encode("ab aba").tolist() == [256, 32, 258] and codec.decode_bytes([256, 257]) == b"ab a"
    assert len(set(bpe.byte_characters())) == 256
    with pytest.raises(ValueError):
        serialize({b"a": 5})
    assert codec.encode("").dtype == np.int32


def test_pre_tokens_of_both_libraries_are_the_same():
    import regex

    find, exact, rng = pre_tokenizer(odd_signs()), regex.compile(PRE_TOKENS).findall, random.Random(12)
    signs = ["a", "'s", "é", "1", ".", "_", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "\u200b", "'", "ll", "東", "一", "½", "Ⅷ", "²", "٣", "🙂", "\u0301", "\U0001e5ff"]
    for _ in range(20_000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))
        assert find(t) == exact(t), repr(t)
    for i in (*range(0xD800), *range(0xE000, 0x110000)):
        if unicodedata.category(c := chr(i)) != "Cn" and i < 0x3400 or i % 97 == 0:
            assert find(f"a{c} {c}1 {c}.") == exact(f"a{c} {c}1 {c}."), i


def test_the_codec_remembers_a_bounded_number(ranks):
    codec = Codec(serialize(ranks), ranks, most=50)
    texts = noise(300)
    for i in range(0, 300, 10):
        got = codec.encode_all([*texts[i : i + 10], None, "x" * 5000])
        assert got[10] is None and [codec.decode_bytes(x) for x in got[:10]] == [t.encode() for t in texts[i : i + 10]]
    assert len(codec.known) < 50 + 600 and not any(len(p) > 128 for p in codec.known)


def test_long_strings_arent_remembered():
    known = Remembering({}, len)
    assert known["x" * 5000] == 5000 and not known and known["abc"] == 3 and len(known) == 1


@pytest.mark.parametrize("kind", ["string", "double"])
def test_ids_of_other_types_come_back(spark, kind):
    df = spark.createDataFrame([("0", "a b"), ("01", "c"), ("1.5", None)], "i string, text string").selectExpr(f"cast(i as {kind}) as doc_id", "text")
    coded = encode(df)
    for out in (token_counts.token_counts(df), coded, decode(coded)):
        assert out.dtypes[0] == ("doc_id", kind) and sorted(r[0] for r in out.collect()) == sorted(r[0] for r in df.collect())
    assert sorted(map(str, decode(coded).collect())) == sorted(map(str, df.collect()))
    assert decode(coded.limit(0)).count() == 0 and decode(coded.unionByName(coded)).count() == 6
