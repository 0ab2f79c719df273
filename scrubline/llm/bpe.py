"""Byte-level BPE encoding and decoding with a sentencepiece model made from the vocabulary alone."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, kind_of, ship_package
from .token_counts import LONG, VOCABULARY, odd_signs, pre_tokenizer, read_ranks

#: Encoded pre-tokens that a worker remembers.
REMEMBERED = 400_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one in Latin-1, else one from U+0100 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialize(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece of id i is the token of rank i, and after these the unknown piece.

    Pieces are spelt in ``byte_characters`` and scored by negative rank, so that the pair merged next is the one of the
    lowest rank. Normalisation is the identity: no dummy prefix, no white space changed.
    """
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    chars = byte_characters()
    out = []
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(_field(1, _field(1, "".join(chars[b] for b in piece).encode()) + _field(2, float(-rank)) + _field(3, 1)))
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


def processor(model: bytes):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor()
    p.LoadFromSerializedProto(model)
    return p


def pieces_of(ranks: dict[bytes, int]) -> pa.Array:
    """The bytes of each token by its id."""
    out = [None] * len(ranks)
    for piece, rank in ranks.items():
        out[rank] = piece
    return pa.array(out, pa.binary())


def joined_pieces(pieces: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
    """The bytes of the tokens ``ids[ends[i]:ends[i + 1]]`` in a row, for each i: what Arrow puts side by side is looked at, not copied."""
    taken = pieces.take(pa.array(ids, pa.int32()))
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int32)[: len(ids) + 1][ends] if len(ids) else np.zeros(len(ends), np.int32)
    view = memoryview(data).cast("B") if data is not None else memoryview(b"")
    return [view[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


class Codec:
    """Encodes texts to token ids and decodes these, with the model of ``serialize``.

    Pre-tokens that aren't remembered are encoded together, for all texts given at once. Up to ``most`` are remembered, and those of the
    texts at hand; the older half goes beyond that.
    """

    def __init__(self, model: bytes, ranks: dict[bytes, int], odd: str | None = None, most: int = REMEMBERED):
        self.find, self.most, self.known = pre_tokenizer(odd or odd_signs()), most, {}
        self.encode_list = processor(model).EncodeAsIds
        self.table = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.pieces = pieces_of(ranks)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        found, known = [None if t is None else self.find(t) for t in texts], self.known
        if len(known) > self.most:
            for old in list(islice(known, len(known) - self.most // 2)):
                del known[old]
        new = list(set().union(*(x for x in found if x)).difference(known))
        if new:
            spelt = [p.encode().decode("latin-1").translate(self.table) for p in new]
            known.update(zip(new, (array("i", ids).tobytes() for ids in self.encode_list(spelt, num_threads=1))))
        out = [None if x is None else np.frombuffer(b"".join(map(known.__getitem__, x)), np.int32) for x in found]
        for p in new:
            if len(p) > LONG:
                del known[p]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode_bytes(self, ids) -> bytes:
        return joined_pieces(self.pieces, np.asarray(ids, np.int32), np.array([0, len(ids)]))[0]


def _encode(shared, check: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ranks, odd = shared.value
        codec = Codec(model, ranks, odd)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = part.column(1).to_pylist()
                ids = codec.encode_all(texts)
                ends = np.cumsum([0, *(0 if x is None else len(x) for x in ids)])
                flat = np.concatenate([np.zeros(0, np.int32), *(x for x in ids if x is not None)])
                if check:
                    same = [None if t is None else raw == t.encode() for t, raw in zip(texts, joined_pieces(codec.pieces, flat, ends))]
                nulls = pa.array([x is None for x in ids])
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=nulls)
                n = pa.array([None if x is None else len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), tokens, n, pa.array(same if check else [None] * len(ids), pa.bool_())], ["doc_id", "tokens", "n_tokens", "round_trip"])

    return encode


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip) of each document; ``round_trip`` says that decoding gives the text back.

    Texts are split in pre-tokens, and each is encoded by sentencepiece with a model made from the vocabulary file
    alone (``serialize``); a bounded number of encoded pre-tokens is remembered. Without ``check`` nothing is decoded and
    ``round_trip`` is null. There is no shuffle.

    A null text has nulls, an empty one no tokens. Texts are taken literally: special tokens' strings are ordinary
    text. Ids may be of any type, and are returned in it. Repeated rows are encoded each. No documents, no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    ranks = read_ranks(vocabulary)
    shared = spark.sparkContext.broadcast((serialize(ranks), ranks, odd_signs()))  # the size of the vocabulary, whatever the input
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return rows.mapInArrow(_encode(shared, check), f"doc_id {kind_of(docs, id_col)}, tokens array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, text) from token ids. Bytes that aren't UTF-8 become U+FFFD; null tokens, or an id that is null or not in the vocabulary, give null.

    No tokens give an empty text. Ids of rows may be of any type. Repeated rows are decoded each. No rows give none. Other columns are ignored.
    """
    spark = encoded.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(shared.value)
        for b in batches:
            lists = b.column(1)
            ends = lists.offsets.to_numpy()
            values = lists.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
            wrong = values.is_null().to_numpy(zero_copy_only=False)
            ids = values.fill_null(-1).to_numpy()
            wrong = np.concatenate([[0], np.cumsum(wrong | (ids < 0) | (ids >= len(pieces)))])
            ends = ends - ends[0]
            bad = (wrong[ends[1:]] > wrong[ends[:-1]]) | lists.is_null().to_numpy(zero_copy_only=False)
            parts = joined_pieces(pieces, np.clip(ids, 0, len(pieces) - 1).astype(np.int32), ends)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if no else str(raw, "utf-8", "replace") for no, raw in zip(bad, parts)], pa.string())], ["doc_id", "text"])

    rows = encoded.select(col(id_col).alias("doc_id"), col(tokens_col).cast("array<int>").alias("tokens"))
    return rows.mapInArrow(texts, f"doc_id {kind_of(encoded, id_col)}, text string")
