"""The registered uses of ``pack`` count real tokens, those that ``op9_byte_bpe``'s tokenizer gives."""

from collections import defaultdict

import pytest

import corpus_pipeline
from scrubline.llm import queries
from scrubline.llm.packing import TIERS
from scrubline.llm.token_counts import PRE_TOKENS, VOCABULARY, merge, read_ranks
from tests.compare import DATA

SF = DATA


def tokens(text, ranks):
    import regex

    return sum(len(merge(p.encode(), ranks)) for p in regex.findall(PRE_TOKENS, text))


@pytest.fixture(scope="module")
def want(spark):
    ranks, docs = read_ranks(VOCABULARY), spark.read.parquet(f"{SF}/documents.parquet")
    return {r["doc_id"]: tokens(r["text"], ranks) for r in docs.collect() if r["text"]}


@pytest.mark.parametrize("name", ["op4_packing", "pipeline"])
def test_lengths_and_offsets_are_real_tokens(spark, want, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = (queries.op4_packing(spark, SF) if name == "op4_packing" else corpus_pipeline.packing(spark, docs, SF)).collect()
    by_doc, used = defaultdict(list), defaultdict(int)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["doc_start"], r["n_tokens"]))
        used[r["tier"], r["window_id"]] += r["n_tokens"]
    assert {d: sum(n for *_, n in parts) for d, parts in by_doc.items()} == want
    for parts in by_doc.values():
        assert [s for _, s, _ in sorted(parts)] == [sum(n for *_, n in sorted(parts)[:i]) for i in range(len(parts))]
    assert all(n <= tier and tier in TIERS for (tier, _), n in used.items())
