"""Exact duplicates by content-defined chunk recipes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, free_name, keyed, ship_package, with_ids, within, without
from .textops import U64, slices

#: Chunks end where a hash of the last 8 bytes has this many low bits zero: 1 KB on average.
CUT_BITS = 10
SHORTEST, LONGEST = 256, 8192


def cuts(data: np.ndarray, start: int, stop: int, marks: np.ndarray) -> list[int]:
    """Ends of the chunks of ``data[start:stop]``; a chunk has SHORTEST to LONGEST bytes, the last may have fewer."""
    if stop - start <= SHORTEST:
        return [stop] if stop > start else []
    out, at = [], start
    own = marks[np.searchsorted(marks, start + 8) : np.searchsorted(marks, stop)]  # no hash reaches into the row before
    i = 0
    while stop - at > SHORTEST:
        i = int(np.searchsorted(own, at + SHORTEST))
        cut = min(int(own[i]) if i < len(own) else stop, at + LONGEST, stop)
        out.append(cut)
        at = cut
    if at < stop:
        out.append(stop)
    return out


def marks(data: np.ndarray) -> np.ndarray:
    """Places after 8 bytes whose hash ends in CUT_BITS zeros; a hash is of these bytes alone."""
    n = len(data) - 7
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.empty(n, dtype=U64)
    padded = np.concatenate([data, np.zeros((-len(data)) % 8, np.uint8)])
    for s in range(8):  # eight interleaved views of 8-byte words
        words = padded[s : s + (len(padded) - s) // 8 * 8].view(U64)
        h[s::8] = words[: len(h[s::8])]
    h *= U64(0x9E3779B97F4A7C15)
    return np.flatnonzero((h >> U64(64 - CUT_BITS)) == 0) + 8


def _recipes(hash_bits: int):
    """(key, recipe) of each row: 16 bytes a chunk, and the size of the text."""

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, text = batch.column(0), batch.column(1)
            for i, j, data, offs in slices(text):
                m, raw, out, n = marks(data), data.tobytes(), [], []
                for r in range(j - i):
                    a, b = int(offs[r]), int(offs[r + 1])
                    n.append(b - a)
                    ids, at = [], a
                    for c in cuts(data, a, b, m):
                        ids.append(_chunk_id(xxhash, raw[at:c], hash_bits))
                        at = c
                    out.append(b"".join(ids))
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), pa.array(out, pa.binary()), pa.array(n, pa.int64())], ["key", "recipe", "size"])

    return recipes


def _chunk_id(xxhash, chunk: bytes, hash_bits: int) -> bytes:
    d = xxhash.xxh3_128_digest(chunk)
    return d if hash_bits == 128 else (int.from_bytes(d) % (1 << hash_bits)).to_bytes(16)


def _chunks(hash_bits: int):
    """(key, place, hash, bytes) of each chunk."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, j, data, offs in slices(batch.column(1)):
                m, raw = marks(data), data.tobytes()
                out: tuple[list, list, list, list] = ([], [], [], [])
                for r in range(j - i):
                    at = int(offs[r])
                    for place, c in enumerate(cuts(data, at, int(offs[r + 1]), m)):
                        chunk = raw[at:c]
                        for column, x in zip(out, (keys[i + r], place, _chunk_id(xxhash, chunk, hash_bits), chunk)):
                            column.append(x)
                        at = c
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["key", "place", "hash", "chunk"])

    return chunks


def duplicates(docs: DataFrame, scratch: Scratch, key: str, text_col: str = "text", hash_bits: int = 128) -> DataFrame:
    """A written table (key, kept) of the rows of ``docs`` whose text another row with a smaller key has.

    1. A pass over the texts makes each one's recipe: the 128-bit hashes of its content-defined chunks in order.
       Only rows whose recipe and size another row has can be copies; nothing but recipes is shuffled to see that.
    2. Chunks of those rows are deduplicated on (hash, bytes), once each, with a combine before the shuffle. A hash
       that has different bytes gives each its own number, so an identifier (hash, number) stands for verified bytes.
    3. Rows with equal ordered lists of identifiers are equal; the smallest key is kept.
    """
    spark = docs.sparkSession
    texts = docs.filter(col(text_col).isNotNull()).select(col(key).alias("key"), col(text_col).alias("text"))
    made = scratch.write(texts.mapInArrow(_recipes(hash_bits), "key long, recipe binary, size long").select("key", "recipe", "size", F.xxhash64("recipe", "size").alias("digest")))
    often = made.groupBy("digest").count().filter("count > 1").select("digest")
    same = scratch.write(made.join(often, "digest"))

    members = same.select("key")
    parts = within(texts, "key", members).mapInArrow(_chunks(hash_bits), "key long, place int, hash binary, chunk binary")
    distinct = parts.select("hash", "chunk").distinct()
    numbers = scratch.write(distinct.groupBy("hash").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("chunk")).alias("variants")).filter("n > 1").select("hash", "variants"))
    if numbers.head(1):  # hashes that collide: their chunks get numbers by their bytes
        clash = parts.join(numbers, "hash").select("key", "place", F.array_position("variants", F.col("chunk")).cast("int").alias("number"))
        marked = clash.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "number"))).alias("numbers"))
        identified = same.join(marked, "key", "left")
    else:
        identified = same.withColumn("numbers", F.lit(None).cast("array<struct<place:int,number:int>>"))
    groups = ["recipe", "size", "numbers"]
    kept = identified.groupBy(*groups).agg(F.min("key").alias("kept"), F.count("*").alias("n")).filter("n > 1")
    pairs = identified.alias("a").join(kept.alias("b"), F.expr(" and ".join(f"a.{g} <=> b.{g}" for g in groups))).filter("a.key > b.kept")
    found = scratch.write(pairs.select(F.col("a.key").alias("key"), F.col("b.kept").alias("kept")))
    scratch.drop(made, same, numbers)
    return found


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 128) -> DataFrame:
    """(doc_id, kept_doc_id) for each document whose text, byte for byte, one before in order of id has.

    ``kept_doc_id`` is the first with that text. Documents of which there is one only aren't listed. Null texts
    equal nothing; empty texts equal each other. Ids may be of any type that sorts, and are returned in it. Null ids come after all others; rows
    with equal ids are separate documents (in order of a hash of the text) and may be listed with the same id twice. No documents, no rows. Other
    columns are ignored. ``hash_bits`` below 128 is for tests of colliding hashes.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "exact")
    rows = keyed(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), scratch, "doc_id", "text")
    return with_ids(duplicates(rows, scratch, "__key", "text", hash_bits), rows, "doc_id", "kept_doc_id")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 128) -> DataFrame:
    """``docs`` without the documents that ``exact_duplicates`` lists; all columns, whatever their names.

    Null texts all stay, of empty ones the first does. Of rows with equal ids and texts one stays. Ids of any type stay as they are.
    No documents, no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "exact")
    (key,) = free_name(docs, "__key")
    rows = keyed(docs, scratch, id_col, text_col, key)
    found = duplicates(rows, scratch, key, text_col, hash_bits)
    return without(rows, key, found.select("key")).select(*[col(c) for c in docs.columns])
