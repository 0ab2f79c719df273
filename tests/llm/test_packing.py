import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scrubline.llm.packing import pack, pack_tiers, windows
from scrubline.llm.token_counts import PRE_TOKENS, VOCABULARY, merge, read_ranks
from tests.compare import DATA


@pytest.mark.parametrize("seed", range(6))
def test_windows_hold_all_pieces_once(seed):
    rng = random.Random(seed)
    pieces = [(rng.choice([rng.randint(1, 10), rng.randint(1, 100)]), 0, i, 0, 0) for i in range(rng.randint(0, 300))]
    out, seen = pack_tiers(pieces, (10, 40, 100)), []
    for size, window in out:
        at = 0
        for start, n, p in window:
            assert start == at and n == p[0]
            at += n
            seen.append(p)
        assert at <= size and max(n for _, n, _ in window) <= size
        assert size == 10 or max(n for _, n, _ in window) > {40: 10, 100: 40}[size]  # a longer window has a piece that needs it
    assert sorted(seen) == sorted(pieces)


def test_long_windows_are_filled_from_shorter_tiers():
    out = pack_tiers([(90, 0, 1, 0, 0), (8, 0, 2, 0, 0), (2, 0, 3, 0, 0), (9, 0, 4, 0, 0)], (10, 100))
    assert sorted((size, sorted(p[2] for *_, p in w)) for size, w in out) == [(10, [2]), (100, [1, 4])] or sum(n for size, w in out if size == 100 for _, n, _ in w) >= 99


@pytest.mark.parametrize("cell_tokens", [1 << 24, 20_000])
def test_documents_are_packed_whole(spark, cell_tokens):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tiers = (256, 1024, 4096)
    rows = pack(docs, tiers, group_tokens=16_384, cell_tokens=cell_tokens).collect()
    want = {r[0]: -(-r[1] // 4) for r in docs.selectExpr("doc_id", "octet_length(text)").collect()}
    by_doc, by_window, groups = defaultdict(list), defaultdict(list), defaultdict(set)
    for r in rows:
        by_doc[r["doc_id"]].append((r["doc_start"], r["n_tokens"]))
        by_window[r["tier"], r["window_id"]].append((r["window_start"], r["n_tokens"]))
        groups[r["step_group"]].add((r["tier"], r["window_id"]))
    for d, n in want.items():
        at = 0
        for start, length in sorted(by_doc[d]):
            assert start == at
            at += length
        assert at == n
    for (tier, _), parts in by_window.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= tier
    cost = {w: sum(n * n for _, n in parts) for w, parts in by_window.items()}
    for tier in tiers:
        own = [sum(cost[w] for w in g) for g in groups.values() if {t for t, _ in g} == {tier} and len(g) == 16_384 // tier]
        assert all(len({t for t, _ in g}) == 1 for g in groups.values())
        assert not own or max(own) <= 1.5 * min(own)
    if cell_tokens == 1 << 24:
        assert sum(want.values()) / sum(t for t, _ in by_window) > 0.97


def test_nulls_ties_empty_tables_and_lengths_given(spark):
    df = spark.createDataFrame([(1, "abcd" * 5, 9), (1, "abcd" * 5, 9), (None, "x", 9), (2, None, 9), (3, "", None)], "doc_id long, text string, tier int").selectExpr("*", "1 as cell", "2 as n")
    rows = pack(df, (4, 16), group_tokens=16).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"]) for r in rows) == [(False, 1, 5), (False, 1, 5), (True, None, 1)]
    assert sum(r["n_tokens"] for r in pack(df, (4, 16), group_tokens=16, length_col="tier").collect()) == 36
    assert pack(df.limit(0), (4, 16), group_tokens=16).count() == 0
    with pytest.raises(ValueError):
        pack(df, (4, 16), group_tokens=8)


def plain_packer(lengths, tiers):
    """(tier, lengths in each window) by looking at all windows each time: best fit, longest first, then the room filled, from the longest tier down."""
    left = {t: sorted((n for n in lengths if n <= t and all(n > s for s in tiers if s < t)), reverse=True) for t in tiers}
    out = []
    for t in sorted(tiers, reverse=True):
        own = []
        for n in left[t]:
            fits = [w for w in own if sum(w) + n <= t]
            if fits:
                min(fits, key=lambda w: t - sum(w)).append(n)
            else:
                own.append([n])
        for w in sorted(own, key=lambda w: sum(w)):
            while True:
                small = [n for s in tiers if s < t for n in left[s] if sum(w) + n <= t]
                if not small:
                    break
                n = max(small)
                w.append(n)
                next(left[s] for s in tiers if s < t and n in left[s]).remove(n)
        out += [(t, sorted(w)) for w in own]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_windows_as_full_as_those_of_a_plain_packer(seed):
    rng, tiers = random.Random(seed), (10, 40, 100)
    lengths = [rng.choice([rng.randint(1, 10), rng.randint(11, 40), rng.randint(41, 100)]) for _ in range(rng.randint(1, 120))]
    got = [(size, sorted(n for _, n, _ in w)) for size, w in pack_tiers([(n, i) for i, n in enumerate(lengths)], tiers)]
    want = plain_packer(lengths, tiers)
    assert sorted(n for _, w in got for n in w) == sorted(n for _, w in want for n in w) == sorted(lengths)
    by_tier = lambda ws: {t: (len([1 for s, _ in ws if s == t]), sum(sum(w) for s, w in ws if s == t)) for t in tiers}
    a, b = by_tier(got), by_tier(want)
    assert a[100][0] == b[100][0] and sum(t * a[t][0] for t in tiers) <= 1.02 * sum(t * b[t][0] for t in tiers) + 10


def test_a_plain_packer_agrees_on_a_whole_table(spark):
    """With one cell, the windows of ``pack`` are those of ``pack_tiers`` over all lengths, and the groups are dealt in snake order by cost."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tiers = (256, 1024, 4096)
    rows = pack(docs, tiers, group_tokens=16_384).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["window_start"]):
        got[r["window_id"], r["tier"], r["step_group"]].append((r["n_tokens"], r["doc_id"], r["piece"]))
    pieces = [(min(4096, n - at), i, at // 4096) for i, n in ((r[0], -(-r[1] // 4)) for r in docs.selectExpr("doc_id", "octet_length(text)").collect()) for at in range(0, n, 4096)]
    want = [(size, [(n, *p[1:]) for _, n, p in w]) for size, w in pack_tiers(pieces, tiers)]
    assert sorted((t, sorted(w)) for (_, t, _), w in got.items()) == sorted((t, sorted(w)) for t, w in want)
    first = 0
    for t in tiers:
        own = sorted(((-sum(n * n for n, *_ in w), i, g) for (i, size, g), w in got.items() if size == t))
        n = -(-len(own) // (16_384 // t))
        deal = [first + (k % n if k // n % 2 == 0 else n - 1 - k % n) for k in range(len(own))]
        assert [g for *_, g in own] == deal
        first += n


@pytest.mark.parametrize("kind", ["string", "double"])
def test_ids_of_other_types(spark, kind):
    df = spark.createDataFrame([(f"0{i}.5", "abcd" * i) for i in range(1, 30)], "i string, text string").selectExpr(f"cast(i as {kind}) as doc_id", "text")
    out = pack(df, (4, 16), group_tokens=32)
    assert out.dtypes[0] == ("doc_id", kind) and {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in df.select("doc_id").collect()}
    assert out.agg(F.sum("n_tokens")).first()[0] == sum(range(1, 30))


def test_many_rows_of_one_id_are_in_many_cells(spark):
    df = spark.range(6000).selectExpr("if(id % 3 = 0, id, null) as doc_id", "'abcd' as text")
    rows = pack(df, (4, 16), group_tokens=16, cell_pieces=500).collect()
    cells = defaultdict(int)
    for r in rows:
        cells[r["window_id"] >> 32] += 1
    assert len(rows) == 6000 and len(cells) >= 11 and max(cells.values()) < 1000


def test_windows_hold_the_tokens_of_their_documents(spark):
    import regex

    ranks = read_ranks(VOCABULARY)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "null id"), (1, "again one"), (1, None), (2, "")], "doc_id long, text string")
    rows = windows(docs.unionByName(odd), (64, 256, 1024), group_tokens=4096).collect()
    got = defaultdict(list)
    for r in rows:
        assert len(r["tokens"]) <= r["tier"] and r["starts"][0] == 0
        for a, b, i in zip(r["starts"], [*r["starts"][1:], len(r["tokens"])], r["doc_ids"]):
            got[i].append(r["tokens"][a:b])
    want = defaultdict(list)
    for r in docs.unionByName(odd).collect():
        tokens = [t for p in regex.findall(PRE_TOKENS, r["text"] or "") for t in merge(p.encode(), ranks)]
        want[r["doc_id"]] += [tokens[i : i + 1024] for i in range(0, len(tokens), 1024)]
    assert {i: sorted(w) for i, w in got.items()} == {i: sorted(w) for i, w in want.items() if w}
    assert windows(docs.limit(0)).count() == 0
