"""Packing of documents into windows of several context lengths."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encode
from .common import Scratch, col, keyed, kind_of, ship_package
from .sharding import prefix_sums
from .token_counts import VOCABULARY

TIERS = (2048, 8192, 32768)
#: Pieces that a cell has on average at most by default, however short they are.
CELL_PIECES = 100_000


def pack_tiers(pieces: list[tuple], tiers: tuple[int, ...]) -> list[tuple[int, list[tuple[int, int, tuple]]]]:
    """Windows (length, [(start, length, piece)]) that hold all ``pieces`` (length, ...), none longer than the last tier.

    A piece goes to the shortest tier that holds it. From the longest tier down: its pieces are packed best fit, longest
    first, then the room left is filled with the longest pieces of shorter tiers that fit; these leave their
    tier, so a tier packs what the longer ones didn't take.
    """
    waiting: list[list[tuple]] = [[] for _ in tiers]
    for p in pieces:
        waiting[bisect.bisect_left(tiers, p[0])].append(p)
    for w in waiting:
        w.sort(key=lambda p: (-p[0], *p[1:]))
    out = []
    for t in range(len(tiers) - 1, -1, -1):
        size, windows, room = tiers[t], [], []  # room: sorted (free, window)
        for p in waiting[t]:
            i = bisect.bisect_left(room, (p[0], -1))
            free, w = room.pop(i) if i < len(room) else (size, len(windows))
            if w == len(windows):
                windows.append([])
            windows[w].append((size - free, p[0], p))
            if free > p[0]:
                bisect.insort(room, (free - p[0], w))
        shorter = sorted(((p[0], *(-x if isinstance(x, int) else x for x in p[1:]), i, j) for i in range(t) for j, p in enumerate(waiting[i])), key=lambda s: (s[0], s[-2], -s[-1]))
        lengths, taken = [s[0] for s in shorter], [set() for _ in range(t)]
        for free, w in sorted(room, reverse=True):
            while lengths and lengths[0] <= free:
                i = bisect.bisect_right(lengths, free) - 1
                lengths.pop(i)
                *_, tier, j = shorter.pop(i)
                p = waiting[tier][j]
                taken[tier].add(j)
                windows[w].append((size - free, p[0], p))
                free -= p[0]
        for i in range(t):
            waiting[i] = [p for j, p in enumerate(waiting[i]) if j not in taken[i]]
        out += [(size, w) for w in windows]
    return out


def pack(
    docs: DataFrame,
    tiers: tuple[int, ...] = TIERS,
    bytes_per_token: int = 4,
    group_tokens: int = 1 << 19,
    cell_tokens: int = 1 << 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str | None = None,
    cell_pieces: int = CELL_PIECES,
) -> DataFrame:
    """Where each document goes: (doc_id, piece, doc_start, n_tokens, tier, window_id, window_start, step_group).

    A document's length is ``length_col`` if given, else its UTF-8 bytes over ``bytes_per_token``, rounded up. A document longer than
    the last tier is cut into pieces of that length and a rest. Pieces are spread by hash over cells of about
    ``cell_tokens`` tokens, or ``cell_pieces`` pieces if they are short; each cell is a task, whatever the input's size, and is packed by ``pack_tiers``. Only ids
    and lengths are shuffled. ``doc_start`` is the piece's first token in the document, ``window_start`` its first in the window.

    Step groups have ``group_tokens`` tokens of windows each of one tier (the last of a tier may have fewer). Windows
    of a tier are ordered by cost, the sum of squares of the pieces' lengths as in attention within documents, and dealt
    to the groups in snake order, so the groups' costs are close.

    Documents with a null or empty text, or no length, have no tokens and are in no window. Ids may be of any type that sorts, and are returned in it. Rows
    with equal or null ids are packed each for itself; where there are such, all rows are spread by where they lie instead of by id, so that many of
    one id are in no one cell. No documents, no rows. Other columns are ignored.
    """
    tiers = tuple(sorted(tiers))
    if tiers[0] < 1 or group_tokens < tiers[-1]:
        raise ValueError("tiers must be positive and fit in group_tokens")
    spark, last = docs.sparkSession, tiers[-1]
    ship_package(spark)
    scratch = Scratch(spark, "pack")
    n = F.ceil(F.octet_length(col(text_col)) / F.lit(bytes_per_token)) if length_col is None else col(length_col)
    lengths = docs.select(col(id_col).alias("doc_id"), n.cast("long").alias("n")).filter("n > 0")
    pieces = lengths.select("doc_id", F.posexplode(F.expr(f"transform(sequence(0L, (n - 1) div {last}L), i -> struct(i * {last}L as doc_start, cast(least(n - i * {last}L, {last}L) as int) as n_tokens))")).alias("piece", "p")).select("doc_id", "piece", "p.doc_start", "p.n_tokens")
    pieces = scratch.write(pieces.withColumn("place", F.monotonically_increasing_id()))
    n_pieces, total = pieces.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    cells = max(1, -(-total // cell_tokens), -(-n_pieces // cell_pieces))
    known = pieces.filter("piece = 0").groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max(F.col("n") + F.col("doc_id").isNull().cast("int"))).first()[0]

    def pack_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table, c = pa.Table.from_batches(batches), TaskContext.get().partitionId()
        order, tier, window_id, start, cost = [], [], [], [], []
        for w, (size, window) in enumerate(pack_tiers([(n, i) for i, n in enumerate(table.column("n_tokens").to_pylist())], tiers)):
            order += [p[1] for *_, p in window]
            start += [at for at, *_ in window]
            tier += [size] * len(window)
            window_id += [(c << 32) + w] * len(window)
            cost += [sum(n * n for _, n, _ in window)] * len(window)
        out = table.take(pa.array(order, pa.int64()))
        for name, values, kind in (("tier", tier, pa.int32()), ("window_id", window_id, pa.int64()), ("window_start", start, pa.int32()), ("cost", cost, pa.int64())):
            out = out.append_column(name, pa.array(values, kind))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    by = F.xxhash64("doc_id", "piece") if known == 1 else F.xxhash64("place")
    spread = pieces.withColumn("cell", F.pmod(by, F.lit(cells)).cast("int")).repartitionById(cells, F.col("cell"))
    ordered = spread.sortWithinPartitions(F.desc("n_tokens"), F.asc_nulls_last("doc_id"), "piece", "place").select("doc_id", "piece", "doc_start", "n_tokens")
    placed = scratch.write(ordered.mapInArrow(pack_cell, f"doc_id {kind_of(docs, id_col)}, piece int, doc_start long, n_tokens int, tier int, window_id long, window_start int, cost long"))

    windows = placed.filter("window_start = 0").select("tier", "window_id", "cost", F.lit(1).cast("long").alias("one"))
    ranked, _ = prefix_sums(windows, [F.asc("tier"), F.desc("cost"), F.asc("window_id")], "one", scratch, "rank")
    counts, before, first = {r["tier"]: r["n"] for r in windows.groupBy("tier").agg(F.count("*").alias("n")).collect()}, 0, 0
    group = F.lit(None).cast("long")
    for t in tiers:
        if n_windows := counts.get(t):
            groups = -(-n_windows // (group_tokens // t))
            at = F.col("rank") - before
            lap, place = F.expr(f"(rank - {before}) div {groups}"), at % groups
            group = F.when(F.col("tier") == t, first + F.when(lap % 2 == 0, place).otherwise(groups - 1 - place)).otherwise(group)
            before, first = before + n_windows, first + groups
    dealt = scratch.write(ranked.select("window_id", group.alias("step_group")))
    return placed.drop("cost").join(dealt, "window_id").select("doc_id", "piece", "doc_start", "n_tokens", "tier", "window_id", "window_start", "step_group")


def windows(docs: DataFrame, tiers: tuple[int, ...] = TIERS, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", **packing) -> DataFrame:
    """The packed windows themselves: (window_id, tier, step_group, tokens, starts, doc_ids).

    Documents are encoded by ``encode``, placed by ``pack`` by their real lengths (``packing`` are further arguments of it), and cut at the
    pieces' bounds. ``tokens`` are those of the window's pieces in a row, ``starts`` where each piece begins in it, ``doc_ids`` whose piece it is. A window
    is as long as its pieces, not padded to its tier. Tokens are shuffled twice, and no group is longer than the last tier.

    Null and empty texts are in no window. Ids may be of any type that sorts; rows with equal or null ids are documents of their own. No documents, no rows.
    Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "windows")
    rows = keyed(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), scratch, "doc_id", "text")
    coded = scratch.write(encode(rows, vocabulary, "__key", "text", check=False).select(F.col("doc_id").alias("key"), "tokens", "n_tokens"))
    placed = pack(coded, tiers, id_col="key", length_col="n_tokens", **packing).withColumnRenamed("doc_id", "key")
    ids = rows.select(F.col("__key").alias("key"), "doc_id") if rows.ids is None else rows.ids
    cut = F.expr("slice(tokens, cast(doc_start as int) + 1, n_tokens)")
    parts = placed.join(coded.drop("n_tokens"), "key").withColumn("own", cut).drop("tokens").join(ids, "key")
    own = F.array_sort(F.collect_list(F.struct("window_start", "own", "doc_id")))
    whole = parts.groupBy("window_id", "tier", "step_group").agg(own.alias("p"))
    return whole.select("window_id", "tier", "step_group", F.flatten("p.own").alias("tokens"), F.col("p.window_start").alias("starts"), F.col("p.doc_id").alias("doc_ids"))
