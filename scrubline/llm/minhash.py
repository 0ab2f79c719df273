"""Near duplicates by MinHash bands, sequential Bayesian verification and an exact check."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, free_name, keyed, likely_in, ship_package, with_ids, within, without
from .textops import LOWER, NOT_WORD, U64, Ranges, mix, ngrams, slices, words

#: Pairs just at the threshold share a band with a probability of 1 - (1 - 0.5**4)**40 = 0.92.
N_HASHES, BANDS, ROWS = 160, 40, 4
SHINGLE_WORDS = 3
#: Copies with a few words changed lie above it, documents that merely quote the same passage below.
THRESHOLD = 0.5
#: Hashes compared before each look at the posterior.
BATCH = 16
#: A pair is given up once the probability that it reaches the threshold is below this.
MISS = 1e-3
#: Of a bucket with more different texts that aren't linked yet, only pairs with a rare shingle in common are compared: those of which that can be.
MANY = 64

_rng = np.random.Generator(np.random.PCG64(20240607))
_A = _rng.integers(0, 1 << 32, N_HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, N_HASHES, dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of N_HASHES permutations of 32-bit numbers over ``shingles`` (uint32, one at least)."""
    best = np.full(N_HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 2048):
        x = shingles[None, i : i + 2048] * _A[:, None]
        x += _B[:, None]
        np.minimum(best, x.min(axis=1), out=best)
    return best


def sequence_hashes(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the words of each row in order, independent of each other."""
    first, after = bounds[:-1], bounds[1:]
    return Ranges(hashes).hash(first, after), Ranges(mix(hashes ^ U64(0xD6E8FEB86659FD93))).hash(first, after) + (after - first).astype(U64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offs in slices(batch.column(1)):
            _, _, hashes, bounds = words(data, offs, NOT_WORD, lower=True)
            grams, own = ngrams(hashes, bounds, SHINGLE_WORDS)
            small = (grams >> np.uint64(32)).astype(np.uint32)
            some = np.flatnonzero(np.diff(own))
            if len(some):
                sigs = np.stack([signature(small[own[r] : own[r + 1]]) for r in some])
                keys = batch.column(0).take(pa.array(i + some))
                bands = np.stack([_band(sigs, b) for b in range(BANDS)], axis=1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
                raw = pa.array([s.tobytes() for s in sigs], pa.binary())
                same = (pa.array(h[some].view(np.int64)) for h in sequence_hashes(hashes, bounds))
                yield pa.RecordBatch.from_arrays([keys, raw, lists, *same], ["key", "sig", "bands", "h1", "h2"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, the different shingles of its text)."""
    for batch in batches:
        for i, j, data, offs in slices(batch.column(1)):
            _, _, hashes, bounds = words(data, offs, NOT_WORD, lower=True)
            grams, own = ngrams(hashes, bounds, SHINGLE_WORDS)
            lists = [np.unique(grams[own[r] : own[r + 1]]).view(np.int64) for r in range(j - i)]
            ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *lists]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(ends, flat)], ["key", "shingles"])


def sharing_pairs(texts: DataFrame, some: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """(a, b) of all pairs of rows (key, root) of ``some``, of different roots, that can reach ``threshold``, and some others.

    An exact prefix filter: with the shingles of each text in order of how many texts have them, the rarest first, a text's first (1 - t) of
    them and the first (1 - t) / (1 + t) of one no longer must have one in common for a similarity of t. So what all have in common makes no pairs: texts of
    one length that share that alone, and not enough of it, meet nowhere.
    """
    own = within(texts, "key", scratch.write(some.select("key").distinct()))
    each = scratch.write(own.mapInArrow(_shingle_rows, "key long, shingles array<long>").select("key", F.explode("shingles").alias("s"), F.size("shingles").alias("size")))
    spread = each.groupBy("s").agg(F.count("*").alias("n"))
    ranked = each.join(spread, "s").groupBy("key", "size").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("x"))  # as long as the text

    def first(share: float):
        return F.filter(F.slice("x", F.lit(1), F.col("size") - F.ceil(F.lit(share) * F.col("size") - 1e-9).cast("int") + 1), lambda x: x["n"] > 1)

    short = first(2 * threshold / (1 + threshold))
    prefixes = scratch.write(ranked.join(some.select("key", "root").distinct(), "key").select("key", "root", "size", first(threshold).alias("long"), F.transform(short, lambda x: x["s"]).alias("short")))
    a = prefixes.select(F.col("key").alias("ka"), F.col("root").alias("ra"), F.col("size").alias("na"), F.explode("short").alias("s"))
    b = prefixes.select(F.col("key").alias("kb"), F.col("root").alias("rb"), F.col("size").alias("nb"), F.explode(F.transform("long", lambda x: x["s"])).alias("s"))
    near = f"ra <> rb and (na < nb or na = nb and ka < kb) and na >= {threshold} * nb - 1e-9"
    out = scratch.write(a.join(b, "s").filter(near).selectExpr("least(ka, kb) as a", "greatest(ka, kb) as b").distinct())
    scratch.drop(each, prefixes)
    return out


def _band(sigs: np.ndarray, b: int) -> np.ndarray:
    h = np.full(len(sigs), b + 1, np.uint64)
    for c in range(b * ROWS, (b + 1) * ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sigs[:, c])
    return h


@lru_cache
def fewest_matches(n_hashes: int, batch: int, threshold: float, miss: float) -> list[int]:
    """After each batch, the fewest matches with which a pair goes on.

    With a uniform prior on the similarity, its posterior after m matches of n is Beta(m + 1, n - m + 1); the
    probability that it reaches ``threshold`` is that of at most m successes in n + 1 trials of that chance.
    """
    out = []
    for n in range(batch, n_hashes + 1, batch):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which rows of the signatures ``a`` and ``b`` aren't given up in any batch."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for step, least in enumerate(fewest_matches(N_HASHES, BATCH, threshold, miss)):
        part = slice(step * BATCH, (step + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def _prune(threshold: float, miss: float):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, N_HASHES) for c in (2, 3))
                keep = pa.array(survivors(a, b, threshold, miss))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return prune


_SPLIT = bytes(32 if NOT_WORD[b] else int(LOWER[b]) for b in range(256))


def shingle_set(text: str) -> set:
    """The different runs of SHINGLE_WORDS words of a text; all its words if there are fewer."""
    w = text.encode().translate(_SPLIT).split()
    if len(w) < SHINGLE_WORDS:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(SHINGLE_WORDS))))


def _verify(threshold: float):
    """(a, b, similarity) of pairs that reach ``threshold`` exactly; the sets of an ``a`` met again in a row are kept."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            found: tuple[list, list, list] = ([], [], [])
            for r in range(batch.num_rows):
                a, b, ta, tb = (batch.column(c)[r].as_py() for c in range(4))
                if a != last:
                    last, own = a, shingle_set(ta)
                other = shingle_set(tb)
                both = len(own & other)
                if (s := both / (len(own) + len(other) - both)) >= threshold:
                    for column, x in zip(found, (a, b, s)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["a", "b", "similarity"])

    return verify


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """A written table (key, root) of the nodes of ``edges`` (a, b) and the least node that they hang together with.

    Alternating large-star and small-star steps: each makes smaller nodes the centres, until nothing changes;
    the rounds grow with the logarithm of the size.
    """
    now = scratch.write(edges.selectExpr("greatest(a, b) as u", "least(a, b) as v").filter("u <> v").distinct())
    mark = None
    while True:
        both = now.unionByName(now.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.join(least, "u").filter("v > u").selectExpr("v as u", "m as v").distinct()  # each larger neighbour to the least
        large = scratch.write(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("if(v = m, u, v) as u", "m as v").filter("u <> v").distinct()  # smaller neighbours and itself
        after = scratch.write(small)
        scratch.drop(now, large)
        now = after
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            out = scratch.write(now.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("key"), F.col("v").alias("root"))).distinct())
            scratch.drop(now)
            return out
        mark = new


def near_groups(docs: DataFrame, scratch: Scratch, key: str, text_col: str, threshold: float, miss: float, many: int = MANY) -> DataFrame:
    """A written table (key, root): rows that are linked by verified pairs, and the least key that they're linked to.

    1. Signatures, once a text. Texts of the same words in the same order are copies of the first of them, which alone goes on, with a row
       for each of BANDS bands.
    2. In each bucket of a band, its least key against each other key. These candidates are compared batch by batch of the
       signature and given up by the posterior; the rest is verified on the texts' own shingles.
    3. Pairs of one bucket that the verified ones don't already link are then compared in the same way: all of them in a bucket of ``many`` texts at most, in
       others those that ``sharing_pairs`` can't rule out. So the groups are those that all
       pairs of all buckets give, but a group of n copies costs n comparisons, and a passage that many texts share makes no pairs of them.
    """
    texts = docs.filter(col(text_col).isNotNull()).select(col(key).alias("key"), col(text_col).alias("text"))
    sigs = scratch.write(texts.mapInArrow(_signatures, "key long, sig binary, bands array<long>, h1 long, h2 long"))
    alike = sigs.groupBy("h1", "h2").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = scratch.write(sigs.select("key", "h1", "h2").join(alike, ["h1", "h2"]).filter("key <> first").select("key", "first"))
    own = without(sigs.select("key", "bands"), "key", copies.select("key"))
    rows = own.select("key", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("first")).filter("n > 1")
    members = scratch.write(rows.join(shared.select("band", "first"), "band"))

    def verified(pairs: DataFrame) -> DataFrame:
        ids = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        own = likely_in(sigs.select("key", "sig"), "key", ids)
        left = pairs.join(own.select(F.col("key").alias("a"), F.col("sig").alias("sa")), "a")
        both = left.join(own.select(F.col("key").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
        alive = scratch.write(both.mapInArrow(_prune(threshold, miss), "a long, b long"))
        found = scratch.write(alive.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        own = likely_in(texts, "key", found)
        # a hot a is in many pairs: its text travels once a partition of its pairs, which b spreads
        left = alive.join(own.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
        both = left.join(own.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
        out = scratch.write(both.mapInArrow(_verify(threshold), "a long, b long, similarity double"))
        scratch.drop(ids, alive, found)
        return out

    stars = scratch.write(members.filter("key <> first").selectExpr("first as a", "key as b").distinct())
    edges = verified(stars)
    roots = components(edges, scratch)

    labelled = members.join(roots, "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    open_ = labelled.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).filter("x <> y").select("band", (F.col("n") > many).alias("hot"))
    rest = scratch.write(labelled.join(open_, "band"))
    few = rest.filter("not hot")
    a, b = few.selectExpr("band", "key as a", "root as ra"), few.selectExpr("band", "key as b", "root as rb")
    more = a.join(b, "band").filter("a < b and ra <> rb").select("a", "b")
    hot = rest.filter("hot").select("key", "root")
    if hot.head(1):
        more = more.unionByName(sharing_pairs(texts, hot, scratch, threshold))
    more = scratch.write(more.distinct().join(stars, ["a", "b"], "left_anti"))
    if more.head(1):
        others = verified(more)
        linked = components(edges.select("a", "b").unionByName(others.select("a", "b")), scratch)
        scratch.drop(roots, others)
        roots = linked
    # the copies are where their first is
    follow = copies.join(roots.select(F.col("key").alias("first"), "root"), "first", "left").select("key", F.coalesce("root", "first").alias("root"))
    alone = copies.select(F.col("first").alias("key")).distinct().join(roots, "key", "left_anti").select("key", F.col("key").alias("root"))
    out = scratch.write(roots.select("key", "root").unionByName(follow).unionByName(alone))
    scratch.drop(sigs, copies, members, stars, edges, rest, more, roots)
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept_doc_id) for each document that is a near duplicate, or linked by a chain of such, of one before in order of id.

    Two texts are near duplicates if the Jaccard similarity of their sets of runs of 3 words (lower case, ASCII punctuation apart) is
    ``threshold`` or more; that is verified exactly. Candidates share one of 40 bands of 4 MinHash values, and are given up
    early if by Bayes' rule they reach the threshold with a probability below ``miss``. Texts of the same words in the same order are
    taken for copies by two 64-bit hashes of them. ``kept_doc_id`` is the least id of the
    group. Documents without near duplicates aren't listed.

    Null texts, and texts without words, are near nothing. A text of fewer than 3 words has one shingle. Ids may be of any type that sorts. Null ids come
    after all others; rows with equal ids are separate documents and may be listed with the same id twice. No documents, no rows. Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = keyed(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), scratch, "doc_id", "text")
    found = near_groups(rows, scratch, "__key", "text", threshold, miss).filter("key <> root")
    return with_ids(found.select("key", "root"), rows, "doc_id", "kept_doc_id")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that ``near_duplicates`` lists; all columns, whatever their names. One document of each group stays.

    Null texts and texts without words all stay. Of rows with equal ids and texts one stays. Ids of any type stay as they are. No documents, no rows.
    """
    ship_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "minhash")
    (key,) = free_name(docs, "__key")
    rows = keyed(docs, scratch, id_col, text_col, key)
    found = scratch.write(near_groups(rows, scratch, key, text_col, threshold, miss).filter("key <> root").select("key"))
    return without(rows, key, found).select(*[col(c) for c in docs.columns])
