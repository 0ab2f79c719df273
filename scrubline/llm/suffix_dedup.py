"""Removal of repeated passages by longest-previous-factor arrays over partitioned suffix order.

A passage of ``MIN_WORDS`` words or more that occurs twice contains, at the same place in both occurrences, the same anchor:
the run of ``ANCHOR_WORDS`` words whose hash is the least of a window. Suffixes that agree in their first MIN_WORDS words thus
have the same anchor at the same distance, so the suffix order of the corpus falls apart into one part an anchor, and
longest previous factors of MIN_WORDS words or more lie within a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import Scratch, col, free_name, keyed, likely_in, ship_package, within
from .textops import SPACE, U64, Ranges, mix, slices, words

MIN_WORDS = 50
ANCHOR_WORDS = 8
#: Parts with more distinct contexts than this are split further, by the first MIN_WORDS words of their suffixes. In such a part all suffixes share that
#: much, so that the previous factor of each but the first is long enough; an aggregate finds the first, whatever the part's size.
HOT_CONTEXTS = 4096


def other_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hashes of words whose runs have hashes independent of those of ``hashes``."""
    return mix(hashes ^ U64(0xD6E8FEB86659FD93))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(hashes: np.ndarray, bounds: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Anchors of the windows of ``min_words`` words: (row, first window, last window, fingerprint, two context hashes).

    Consecutive windows with the same anchor are one entry; its context is all their words.
    """
    k = min(ANCHOR_WORDS, min_words)
    none = np.zeros(0, np.int64)
    if len(hashes) < min_words:
        return none, none, none, *[none.astype(U64)] * 3
    r, again = Ranges(hashes), Ranges(other_hashes(hashes))
    at = np.arange(len(hashes) - k + 1)
    grams = r.hash(at, at + k)
    bits = max(1, int(len(grams)).bit_length())
    low = U64((1 << bits) - 1)
    best = (_least((grams & ~low) | at.astype(U64), min_words - k + 1) & low).astype(np.int64)  # the leftmost of equal ones
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(best)]
    good = np.arange(len(best)) + min_words <= bounds[1:][row]
    s = np.flatnonzero(good)
    if not len(s):
        return none, none, none, *[none.astype(U64)] * 3
    a, row = best[s], row[s]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    lo, hi, a = s[first], s[last], a[first]
    # the place of the anchor belongs to the context
    place = ((a - lo).astype(U64) * U64(0x9E3779B97F4A7C15)) ^ ((hi - lo).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    return row[first], lo, hi, grams[a], r.hash(lo, hi + min_words) ^ place, again.hash(lo, hi + min_words) ^ place


def _anchor_rows(min_words: int):
    """(fingerprint, context hashes, key, word, start, stop) of each anchor: the context's first word, its bytes in the text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for i, _, data, offs in slices(batch.column(1)):
                starts, ends, hashes, bounds = words(data, offs, SPACE)
                row, lo, hi, fp, context, other = anchors(hashes, bounds, min_words)
                if len(row):
                    base = offs[row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (fp.view(np.int64), context.view(np.int64), other.view(np.int64), keys[i + row], (lo - bounds[row]).astype(np.int32), (starts[lo] - base).astype(np.int32), (ends[hi + min_words - 1] - base).astype(np.int32))],
                        ["fp", "context", "other", "key", "word", "start", "stop"],
                    )

    return rows


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of ``symbols`` ordered by their first ``depth`` symbols, then place; and the ranks after 1, 2, 4 ... symbols."""
    _, rank = np.unique(symbols, return_inverse=True)
    ranks, n, length = [rank.astype(np.int64)], len(symbols), 1
    while length < depth:
        second = np.full(n, -1, np.int64)
        second[: n - length] = ranks[-1][length:]
        both = ranks[-1] * (n + 1) + second + 1
        _, rank = np.unique(both, return_inverse=True)
        ranks.append(rank)
        length *= 2
        if rank.max() == n - 1:
            break
    return np.argsort(ranks[-1], kind="stable"), ranks


def common_prefix(a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray], most: int) -> np.ndarray:
    """How many symbols, up to about twice ``most``, the suffixes at ``a`` and ``b`` have in common."""
    n = len(ranks[0])
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), dtype=bool)
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        step = same * (1 << level)
        out += step
        a += step
        b += step
    return out


def longest_previous_factors(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, source) of each suffix's longest common prefix with one at a smaller place.

    ``order`` is the suffix order, ``lcp[r]`` what ranks r - 1 and r share. The suffixes at smaller places that share most
    with a suffix are the previous and the next smaller place in suffix order; both are found with one stack.
    """
    n = len(order)
    length, source = [0] * n, [-1] * n
    order, lcp, stack = order.tolist(), lcp.tolist(), []  # of (place, shared with what is below)
    for r in range(n + 1):
        place, shared = (order[r], lcp[r]) if r < n else (-1, 0)
        while stack and stack[-1][0] > place:
            p, below = stack.pop()
            # next smaller place: ``place``; previous smaller place: the new top
            if shared > below:
                length[p], source[p] = shared, place
            elif below > 0:
                length[p], source[p] = below, stack[-1][0]
            shared = min(shared, below)
        stack.append((place, shared))
    return np.array(length, np.int64), np.array(source, np.int64)


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each word, the same for two of them if and only if their bytes are the same, whatever their hashes."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    model = first[number]  # the first word of the same hash
    size, wanted = ends - starts, (ends - starts)[model]
    own = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at, other = own + np.repeat(starts, size), own + np.repeat(starts[model], size)
    unlike = size != wanted
    differs = data[at] != data[np.minimum(other, len(data) - 1)]
    if differs.any():
        unlike |= np.bincount(np.repeat(np.arange(len(size)), size)[differs], minlength=len(size)) > 0
    number = number.astype(np.int64)
    if unlike.any():  # hashes that collide
        raw, known, n = data.tobytes(), {}, len(first)
        for i in np.flatnonzero(unlike):
            number[i] = known.setdefault((int(number[i]), raw[starts[i] : ends[i]]), n + len(known))
    return number


def repeated_windows(texts: list[bytes], keys: np.ndarray, first_word: np.ndarray, min_words: int) -> list[list[tuple[int, int]]]:
    """For each context, in order of (key, first word): byte spans covered by windows of which an earlier one is a copy.

    A window isn't a copy of one that it overlaps. Suffix array, longest previous factors and the chains of their
    sources, within one part of the suffix order.
    """
    joined = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    starts, ends, hashes, bounds = words(joined, offs, SPACE)
    counts = np.diff(bounds)
    # a separator after each context, different from all words and from each other
    n = len(hashes) + len(texts)
    symbols, origin = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    at = np.arange(len(hashes)) + np.repeat(np.arange(len(texts)), counts)
    symbols[at], origin[at] = word_numbers(joined, starts, ends, hashes) + len(texts), np.arange(len(hashes))
    symbols[bounds[1:] + np.arange(len(texts))] = np.arange(len(texts))
    order, ranks = suffix_array(symbols, min_words)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = common_prefix(order[:-1], order[1:], ranks, min_words)
    length, source = longest_previous_factors(order, lcp)
    ok = (length >= min_words) & (origin >= 0)
    context = np.repeat(np.arange(len(texts)), counts + 1)
    word = np.arange(n) - (bounds[:-1] + np.arange(len(texts)))[context] + np.asarray(first_word)[context]
    root = np.where(ok, source, np.arange(n))
    while True:  # to the first of all windows that are alike
        further = root[root]
        if (further == root).all():
            break
        root = further
    key = np.asarray(keys)[context]
    ok &= (key[root] != key) | (word - word[root] >= min_words)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for p in np.flatnonzero(ok):
        c, o = context[p], origin[p]
        a, b = int(starts[o] - offs[c]), int(ends[o + min_words - 1] - offs[c])
        own = spans[c]
        if own and a <= own[-1][1]:
            own[-1] = (own[-1][0], b)
        else:
            own.append((a, b))
    return spans


def _part(min_words: int):
    def part(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "word"])
        spans = repeated_windows(rows["piece"].tolist(), rows["key"].to_numpy(), rows["word"].to_numpy(), min_words)
        out = [(k, s + a, s + b) for k, s, own in zip(rows["key"], rows["start"], spans) for a, b in own]
        return pd.DataFrame(out, columns=["key", "start", "stop"])

    return part


def _parts(min_words: int):
    """Like ``_part`` for partitions sorted by fingerprint, so that many small parts share a batch."""
    one = _part(min_words)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for b in batches:
            b = b if left is None else pd.concat([left, b], ignore_index=True)
            last = b["fp"].iloc[-1]
            whole, left = b[b["fp"] != last], b[b["fp"] == last]
            if len(whole):
                yield from several(whole)
        if left is not None:
            yield from several(left)

    def several(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        size = rows.groupby("fp", sort=False)["piece"].size()
        group = pd.Series(np.cumsum(size.to_numpy()) // 2048, index=size.index)  # suffixes of different parts share less than an anchor
        for _, own in rows.groupby(rows["fp"].map(group), sort=False):
            yield one(own)

    return parts


def _windows(min_words: int):
    """(hash, key, word, start, stop) of each window of hot parts."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, first, start = (b.column(c).to_numpy() for c in (1, 2, 3))
            for i, j, data, offs in slices(b.column(4)):
                starts, ends, hashes, bounds = words(data, offs, SPACE)
                if len(hashes) < min_words:
                    continue
                s = np.arange(len(hashes) - min_words + 1)
                row = np.repeat(np.arange(j - i), np.diff(bounds))[: len(s)]
                s, row = (x[s + min_words <= bounds[1:][row]] for x in (s, row))
                h = Ranges(hashes).hash(s, s + min_words).view(np.int64)
                h2 = Ranges(other_hashes(hashes)).hash(s, s + min_words).view(np.int64)
                own = i + row
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, h2, keys[own], (first[own] + s - bounds[row]).astype(np.int32), (start[own] + starts[s] - offs[row]).astype(np.int32), (start[own] + ends[s + min_words - 1] - offs[row]).astype(np.int32))], ["h", "h2", "key", "word", "start", "stop"])

    return windows


def repeated_spans(docs: DataFrame, scratch: Scratch, key: str, text_col: str, min_words: int = MIN_WORDS, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """A written table (key, spans) of the byte spans [start, stop) of each text that repeat what is before in order of (key, place)."""
    texts = docs.filter(col(text_col).isNotNull()).select(col(key).alias("key"), col(text_col).alias("text"))
    found = scratch.write(texts.mapInArrow(_anchor_rows(min_words), "fp long, context long, other long, key long, word int, start int, stop int"))

    # most anchors occur once: these go before anything is sorted
    often = scratch.write(found.groupBy("fp").count().filter("count > 1").select("fp"))
    repeated = scratch.write(within(found, "fp", often))
    scratch.drop(found, often)
    # one entry for each distinct context of an anchor: where it occurs first
    contexts = repeated.groupBy("fp", "context", "other").agg(F.min(F.struct("key", "word", "start", "stop")).alias("first"), F.count("*").alias("n"))
    known = scratch.write(contexts.withColumn("contexts", F.count("*").over(Window.partitionBy("fp"))))

    # a later occurrence of a whole context is a copy, unless it overlaps the first
    again = repeated.join(known.filter("n > 1"), ["fp", "context", "other"]).filter("key <> first.key or word <> first.word")
    far = F.expr(f"key <> first.key or word - first.word >= {min_words}")
    again = scratch.write(again.select("fp", "key", "word", "start", "stop", "contexts", far.alias("far")))
    copied = again.filter("far").select("key", "start", "stop")

    # what is left: first occurrences, and those that overlap them, where an anchor has several contexts
    wanted = known.filter("contexts > 1").select("fp", "contexts", "first.*").unionByName(again.filter("not far and contexts > 1").drop("far"))
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("fp", "contexts", "word", "start", "stop")).alias("places"))
    wanted = scratch.write(wanted)
    cut = F.expr("transform(places, p -> struct(p.fp as fp, p.contexts as contexts, p.word as word, p.start as start, substring(data, p.start + 1, p.stop - p.start) as piece))")
    pieces = likely_in(texts, "key", wanted.select("key")).join(wanted, "key").withColumn("data", F.encode("text", "UTF-8")).select("key", F.inline(cut))
    pieces = pieces.select("fp", "contexts", "key", "word", "start", "piece")
    pieces = scratch.write(pieces)

    parts = pieces.filter(F.col("contexts") <= hot_contexts).select("fp", "key", "word", "start", "piece")
    parts = parts.repartition("fp").sortWithinPartitions("fp").mapInPandas(_parts(min_words), "key long, start int, stop int")
    hot = pieces.filter(F.col("contexts") > hot_contexts)
    windows = scratch.write(hot.select("fp", "key", "word", "start", "piece").mapInArrow(_windows(min_words), "h long, h2 long, key long, word int, start int, stop int"))
    firsts = windows.groupBy("h", "h2").agg(F.min(F.struct("key", "word")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    split = windows.join(firsts, ["h", "h2"]).filter(f"key <> first.key or word - first.word >= {min_words}").select("key", "start", "stop")

    spans = copied.unionByName(parts).unionByName(split).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("s"))
    out = scratch.write(spans.mapInArrow(_merge, "key long, spans array<struct<start:int,stop:int>>"))
    scratch.drop(repeated, known, again, wanted, pieces, windows)
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans that touch or overlap become one."""
    kind = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    for b in batches:
        if not b.num_rows:
            continue
        lists = b.column(1)
        ends = lists.offsets.to_numpy().astype(np.int64)
        spans = lists.values.slice(ends[0], ends[-1] - ends[0])
        base = np.repeat(np.arange(b.num_rows) << 32, np.diff(ends))  # rows apart from each other
        start, stop = (base + spans.field(i).to_numpy() for i in (0, 1))
        far = np.maximum.accumulate(stop)
        first = np.flatnonzero(np.append(True, start[1:] > far[:-1]))
        last = np.append(first[1:], len(start)) - 1
        merged = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (start[first] - base[first], far[last] - base[last])], fields=list(kind))
        own = np.searchsorted(first, ends - ends[0])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(own, pa.int32()), merged)], ["key", "spans"])


def without_spans(docs: DataFrame, spans: DataFrame, key: str, text_col: str) -> DataFrame:
    """``docs`` with the bytes of ``spans`` (a written table) cut from the text, with the white space after them.

    Up to EXACT_KEYS spans are broadcast, so that the texts are read once and not shuffled; for more, only texts that likely have spans are.
    """
    renamed, data, other = free_name(docs, "__spans", "__data", "__of")
    columns = [col(c) for c in docs.columns]
    own = spans.select(F.col("key").alias(other), F.col("spans").alias(renamed))
    rows, n = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    if rows + n <= common.EXACT_KEYS:
        joined, others = docs.join(F.broadcast(own), col(key) == F.col(other), "left"), None
    else:
        some, others = likely_in(docs, key, spans.select("key"), apart=True)
        joined = some.join(own, col(key) == F.col(other), "left")
    raw = F.encode(col(text_col), "UTF-8")
    # what is between the spans; the white space after a span goes, that before it stays
    kept = F.expr(
        f"transform(sequence(0, size(`{renamed}`)), i -> struct(if(i = 0, 0, element_at(`{renamed}`, greatest(i, 1)).stop) as a,"
        f" if(i = size(`{renamed}`), length(`{data}`), element_at(`{renamed}`, least(i + 1, size(`{renamed}`))).start) as b))"
    )
    pieces = F.transform(kept, lambda x: F.struct(x["a"].alias("a"), F.decode(F.substring(col(data), x["a"] + 1, x["b"] - x["a"]), "UTF-8").alias("t")))
    text = F.array_join(F.transform(pieces, lambda x: F.when(x["a"] == 0, x["t"]).otherwise(F.regexp_replace(x["t"], r"^[\t-\r\x1c-\x20]+", ""))), "")
    text = F.when(col(renamed).isNull(), col(text_col)).otherwise(text)
    cut = joined.withColumn(data, F.when(col(renamed).isNotNull(), raw)).withColumn(text_col, text).select(*columns)
    return cut if others is None else cut.union(others.select(*columns))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """``docs`` with, in ``text_col``, all passages removed of ``min_words`` words or more that occur before.

    "Before" is in order of id, then place in the text; the first occurrence stays. Words are what ASCII white space
    separates. Within a part of the suffix order they are compared byte for byte. Runs that occur again with all the context that shares
    their anchor, and windows of hot parts, are told by a 64-bit hash of each word and two independent ones of the run: among 10**13 runs, as many as 100 TB have,
    two unlike ones have the same with a probability below 10**-12. Every word goes that lies in a window of ``min_words`` words
    of which an earlier one, not overlapping it, has the same words. What surrounds a removed passage is kept as it
    was, but for the white space after the passage.

    Null and empty texts stay as they are, as do texts shorter than ``min_words`` words. Ids may be of any type that sorts. Null ids come after all others, and
    rows with equal ids are separate documents in order of a hash of the text. A document all of which occurred before stays with an
    empty text. No documents, no rows. All other columns are kept, whatever their names.
    """
    if min_words < 2:
        raise ValueError("min_words must be 2 or more")
    ship_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "suffix")
    (key,) = free_name(docs, "__key")
    rows = keyed(docs, scratch, id_col, text_col, key)
    spans = repeated_spans(rows, scratch, key, text_col, min_words, hot_contexts)
    return without_spans(rows, spans, key, text_col).select(*[col(c) for c in docs.columns])
