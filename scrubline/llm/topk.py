"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import EXACT_KEYS, WHOLE, Scratch, col, kind_of, ship_package

#: Scores are cosines rounded to so many decimals, so that they and their ties are the same on any machine.
DECIMALS = 6
#: What a float32 product of unit vectors can be off, and half a unit of the last decimal.
SLACK = 5e-6 + 0.5 * 10.0**-DECIMALS


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = 1024,
    bins: int = 128,
    rounds: int = 3,
    candidates: int = 4,
    leave_out_own: bool = False,
) -> DataFrame:
    """The ``k`` rows of ``vectors`` most like each query by cosine, as (query_id, neighbor_id, rank, score).

    Without ``queries`` every row is a query and isn't its own neighbour; with it, no row is left out unless ``leave_out_own`` says
    that rows with the query's id are. All pairs are scored, in blocks. Each pass adds up per-query histograms of the scores in the range that
    holds the query's kth value, and narrows the range to that bin, until at most ``candidates * k`` scores are at or
    above it, or ``rounds`` passes are over. Pairs at or above the range's lower end are then scored anew in
    float64 and a fixed order, and ranked by (score rounded to 6 decimals, higher first, then id, lower first); of a query and a block at most ``k``
    go on to be ranked with those of other blocks, however many tie.

    Ids may be of any type that sorts, and are returned in it. Rows with a null id, a null or empty vector, a null or NaN or infinite component
    are no queries and no neighbours, nor are those whose vector is of another length than most of ``vectors`` are (of equally frequent lengths
    the longest counts). A zero vector scores 0 with all. If there are fewer than ``k`` others, all are returned. Repeated ids: each row is
    a neighbour of its own; rows with a query's id aren't its neighbours where those are left out, and repeated query ids give one query (the largest row by value). No
    rows give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "topk")
    own = queries is None or leave_out_own
    asked = vectors if queries is None else queries
    vectors, asked = (d.select(col(id_col).alias("id"), col(vector_col).cast("array<double>").alias("v")) for d in (vectors, asked))
    n_dim = _dimensions(vectors)
    ids = None
    if kind_of(vectors, "id") not in WHOLE or kind_of(asked, "id") not in WHOLE:
        every = (vectors if queries is None else vectors.unionByName(asked)).select("id").filter("id is not null").distinct()
        ids = scratch.write(every.repartitionByRange("id").sortWithinPartitions("id").select("id", F.monotonically_increasing_id().alias("key")))
        here = F.broadcast(ids) if ids.count() <= EXACT_KEYS else ids
        vectors, asked = (d.join(here, "id").select(F.col("key").alias("id"), "v") for d in (vectors, asked))
    left = scratch.write(_blocks(asked, block, n_dim, True).select(F.col("b").alias("qb"), F.col("ids").alias("qi"), F.col("m").alias("qm")))
    right = scratch.write(_blocks(vectors, block, n_dim, False))
    pairs = left.crossJoin(right)

    ranges = None
    for turn in range(rounds):
        todo = pairs if ranges is None else left.join(ranges.select("qb", "lo", "hi", "above", "open").filter("open"), "qb").crossJoin(right)
        cols = ["qb", "qi", "qm", "b", "ids", "m", *([] if ranges is None else ["lo", "hi"])]
        counts = todo.select(*cols).mapInArrow(_counter(n_dim, bins, own), "qb long, salt int, counts binary")
        for by in (["qb", "salt"], ["qb"]):  # a task adds up a part of a block's histograms, then one their sums, each holding one at a time
            counts = counts.repartition(*by).sortWithinPartitions(*by).mapInArrow(_adder(bins), "qb long, salt int, counts binary")
        counts = counts.select("qb", "counts")
        known = counts if ranges is None else counts.join(ranges, "qb", "right")
        prior = [] if ranges is None else ["lo", "hi", "above", "open"]
        ranges = scratch.write(known.select("qb", "counts", *prior).mapInArrow(_narrower(k, bins, candidates), "qb long, lo binary, hi binary, above binary, open boolean"))
        if not ranges.filter("open").head(1):
            break

    found = left.join(ranges.select("qb", "lo"), "qb").crossJoin(right)
    found = found.select("qb", "qi", "qm", "b", "ids", "m", "lo").mapInArrow(_finder(n_dim, own, k), "query_id long, neighbor_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("neighbor_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "neighbor_id", "rank", "score")
    if ids is not None:
        for n in ("query_id", "neighbor_id"):
            ranked = ranked.join(ids.select(F.col("key").alias(n), F.col("id").alias("own_id")), n).drop(n).withColumnRenamed("own_id", n)
    return ranked.select("query_id", "neighbor_id", "rank", "score")


_PROPER = "id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"


def _dimensions(vectors: DataFrame) -> int:
    row = vectors.filter("size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return row["n"] if row else 1


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero stays zero. Rows whose squares would overflow or vanish are scaled first."""
    most = np.abs(m).max(axis=1, keepdims=True)
    far = (most > 1e150) | ((most < 1e-150) & (most > 0))
    m = np.where(far, m / np.where(far, most, 1), m)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _blocks(df: DataFrame, block: int, n_dim: int, distinct: bool) -> DataFrame:
    """Rows (b, ids, m) of up to ``block`` unit vectors in float64 as bytes."""
    df = df.select(F.col("id").cast("long").alias("id"), "v").filter(_PROPER).filter(F.size("v") == n_dim)
    if distinct:
        df = df.groupBy("id").agg(F.max("v").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        b, ids, rows = TaskContext.get().partitionId() << 32, [], []

        def out() -> pa.RecordBatch:
            unit = _unit(np.concatenate(rows))
            return pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([np.concatenate(ids).astype(np.int64).tobytes()], pa.binary()), pa.array([unit.tobytes()], pa.binary())], ["b", "ids", "m"])

        for batch in batches:
            if not batch.num_rows:
                continue
            i, arr = batch.column(0).to_numpy(), batch.column(1)
            m = arr.flatten().to_numpy().reshape(-1, n_dim)
            while len(i):
                room = block - sum(map(len, ids))
                ids.append(i[:room])
                rows.append(m[:room])
                i, m = i[room:], m[room:]
                if sum(map(len, ids)) == block:
                    yield out()
                    b, ids, rows = b + 1, [], []
        if ids:
            yield out()

    return df.mapInArrow(pack, "b long, ids binary, m binary")


def _scores(n_dim: int, own: bool):
    """A function of (query ids, query vectors, ids, vectors) to scores in float32, -2 where a row meets itself."""
    cached: dict = {}

    def f32(raw: bytes) -> np.ndarray:
        if cached.get("raw") != raw:
            cached.update(raw=raw, m=np.frombuffer(raw, np.float64).reshape(-1, n_dim).astype(np.float32))
        return cached["m"]

    def scores(qi: np.ndarray, qm: bytes, ids: np.ndarray, m: bytes) -> np.ndarray:
        s = f32(qm) @ np.frombuffer(m, np.float64).reshape(-1, n_dim).astype(np.float32).T
        if own:
            both = np.isin(qi, ids)
            for r in np.flatnonzero(both):
                s[r, ids == qi[r]] = -2
        return s

    return scores


def _counter(n_dim: int, bins: int, own: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, sums = _scores(n_dim, own), {}
        for batch in batches:
            ranged = batch.num_columns > 6
            for r in range(batch.num_rows):
                qb, qi, qm, _, ids, m = (batch.column(c)[r].as_py() for c in range(6))
                qi, ids = np.frombuffer(qi, np.int64), np.frombuffer(ids, np.int64)
                s = scores(qi, qm, ids, m)
                if ranged:
                    lo, hi = (np.frombuffer(batch.column(c)[r].as_py(), np.float64)[:, None] for c in (6, 7))
                else:
                    lo, hi = np.full((len(qi), 1), -1.0 - SLACK), np.full((len(qi), 1), 1.0 + SLACK)
                if qb not in sums:
                    sums[qb] = np.zeros((len(qi), bins), np.int64)
                rows, at = np.nonzero((s >= lo.astype(np.float32)) & (s < hi.astype(np.float32)))
                scaled = (s[rows, at] - lo[rows, 0]) * (bins / (hi - lo)[rows, 0])
                cell = rows * bins + np.clip(scaled.astype(np.int64), 0, bins - 1)
                sums[qb] += np.bincount(cell, minlength=len(qi) * bins).reshape(-1, bins)
                if len(sums) > 16:  # the counts are added up after the shuffle
                    old = next(iter(sums))
                    yield _row(old, sums.pop(old))
        for qb, c in sums.items():
            yield _row(qb, c)

    return count


def _row(qb: int, c: np.ndarray) -> pa.RecordBatch:
    """A histogram as a row, with the number of its task modulo 64 as salt."""
    from pyspark import TaskContext

    return pa.RecordBatch.from_arrays([pa.array([qb], pa.int64()), pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([zlib.compress(c.astype(np.int64).tobytes(), 1)], pa.binary())], ["qb", "salt", "counts"])


def _adder(bins: int):
    """The sum of the histograms of each block of queries, of rows sorted by block."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                qb, c = batch.column(0)[r].as_py(), np.frombuffer(zlib.decompress(batch.column(2)[r].as_py()), np.int64).reshape(-1, bins)
                if qb != own:
                    if own is not None:
                        yield _row(own, total)
                    own, total = qb, np.zeros_like(c)
                total = total + c
        if own is not None:
            yield _row(own, total)

    return add


def _narrower(k: int, bins: int, candidates: int):
    """Takes the histograms of a block of queries and moves each query's range to the bin of its kth value."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qb, raw = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                prior = batch.num_columns > 2
                if prior and not batch.column(5)[r].as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([qb], pa.int64()), *(pa.array([batch.column(c)[r].as_py()], pa.binary()) for c in (2, 3, 4)), pa.array([False])], ["qb", "lo", "hi", "above", "open"])
                    continue
                c = np.frombuffer(zlib.decompress(raw), np.int64).reshape(-1, bins)
                n = len(c)
                if prior:
                    lo, hi, above = (np.frombuffer(batch.column(x)[r].as_py(), np.float64) for x in (2, 3, 4))
                else:
                    lo, hi, above = np.full(n, -1.0 - SLACK), np.full(n, 1.0 + SLACK), np.zeros(n)
                up = above[:, None] + np.cumsum(c[:, ::-1], axis=1)  # scores at or above each bin, from the top bin down
                reached = up >= k
                done = prior & (above + c.sum(axis=1) <= candidates * k)  # narrow enough in an earlier pass
                kth = np.where(reached.any(axis=1), reached.argmax(axis=1), bins - 1)
                cell, row = bins - 1 - kth, np.arange(n)
                width = (hi - lo) / bins
                new_lo = np.where(cell == 0, lo, lo + cell * width)
                new_hi = np.where(cell == bins - 1, hi, lo + (cell + 1) * width)
                new_above = np.where(kth > 0, up[row, np.maximum(kth - 1, 0)], above)
                total = up[row, kth]
                lo, hi, above = (np.where(done, a, b).astype(np.float64) for a, b in ((lo, new_lo), (hi, new_hi), (above, new_above)))
                is_open = bool((~done & (total > candidates * k) & (hi - lo > 4 * SLACK)).any())
                yield pa.RecordBatch.from_arrays([pa.array([qb], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in (lo, hi, above)), pa.array([is_open])], ["qb", "lo", "hi", "above", "open"])

    return narrow


def _finder(n_dim: int, own: bool, k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(n_dim, own)
        for batch in batches:
            for r in range(batch.num_rows):
                _, qi, qm, _, ids, m, lo = (batch.column(c)[r].as_py() for c in range(7))
                qi, ids = np.frombuffer(qi, np.int64), np.frombuffer(ids, np.int64)
                s = scores(qi, qm, ids, m)
                # a score may be off by the slack, and so may the one that set the range
                floor = np.maximum(np.frombuffer(lo, np.float64) - 3 * SLACK, -1.5).astype(np.float32)
                q, at = np.nonzero(s >= floor[:, None])
                a, b = (np.frombuffer(x, np.float64).reshape(-1, n_dim) for x in (qm, m))
                exact = np.zeros(len(q))
                for d in range(n_dim):  # in this order on any machine
                    exact += a[q, d] * b[at, d]
                exact, near = np.round(exact, DECIMALS) + 0.0, ids[at]
                order = np.lexsort((near, -exact, q))
                place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
                best = order[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(qi[q[best]]), pa.array(near[best]), pa.array(exact[best])], ["query_id", "neighbor_id", "score"])

    return find
