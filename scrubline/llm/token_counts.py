"""Token counts of byte-level BPE with a shortcut for whole tokens."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, kind_of, ship_package

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokens of this family of tokenizers: contractions, then runs of letters, digits or other signs with one space before, then white space.
PRE_TOKENS = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: The same for most texts, for Python's own library.
PLAIN = r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]++| ?\d++| ?(?:[^\s\w]|_)++|\s+(?!\S)|\s+"
#: Merged pre-tokens that a worker remembers; the older half is forgotten beyond it, and merged again when met.
REMEMBERED = 400_000
#: Strings longer than this aren't remembered.
LONG = 128
#: Whole tokens are counted from this bit on, all tokens below it.
WHOLE_BIT = 40


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of one pre-token by merging, as often as possible, the pair of neighbours of the lowest rank, leftmost first.

    That the whole piece is in the vocabulary isn't looked at.
    """
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 256:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        best, at = None, 0
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """``merge`` with a heap, for pieces so long that looking at all pairs each time would take too long."""
    import heapq

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if not alive[i] or j >= n or not alive[j] or after[i] != j or parts[i] + parts[j] != both:
            continue
        parts[i], alive[j], after[i] = both, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, b, parts[a] + parts[b]))
    return [ranks[p] for p, ok in zip(parts, alive) if ok]


def whole_tokens(ranks: dict[bytes, int]) -> set[str]:
    """Vocabulary strings proved to be one token when alone: merging them gives just themselves."""
    out = set()
    for piece, rank in ranks.items():
        try:
            s = piece.decode()
        except UnicodeDecodeError:
            continue
        if merge(piece, ranks) == [rank]:
            out.add(s)
    return out


class Remembering(dict):
    """A dict of pre-tokens that works out and remembers what it lacks, up to ``most`` beyond its first entries."""

    def __init__(self, first: dict, work_out: Callable[[str], object], most: int = REMEMBERED):
        super().__init__(first)
        self.work_out, self.first, self.most = work_out, len(first), most

    def __missing__(self, piece: str):
        value = self.work_out(piece)
        if len(piece) <= LONG:
            if len(self) >= self.first + self.most:
                for old in list(islice(self, self.first, self.first + self.most // 2)):
                    del self[old]
            self[piece] = value
        return value


@lru_cache
def odd_signs() -> str:
    """A class of all characters that ``PLAIN`` and ``PRE_TOKENS`` may take differently, found by asking about each of the first 65,536; all others are in it.

    Characters beyond those would be looked at one after the other at each place of a text.
    """
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    odd: set[str] = set()
    for exact, plain in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")):
        odd |= set(regex.findall(exact, every)) ^ set(re.findall(plain, every))
    return "[" + "".join(map(re.escape, sorted(odd))) + "\U00010000-\U0010ffff]"


def pre_tokenizer(odd: str) -> Callable[[str], list[str]]:
    """A function of a text to its pre-tokens: by the faster of two libraries, where the text has none of the ``odd`` characters."""
    import regex

    plain, exact, search = re.compile(PLAIN).findall, regex.compile(PRE_TOKENS).findall, re.compile(odd).search
    return lambda text: exact(text) if search(text) else plain(text)


def merger(ranks: dict[bytes, int]) -> Callable[[bytes], list[int]]:
    """``merge`` at compiled speed for pieces outside the vocabulary; those in it are merged by ``merge``."""
    import tiktoken

    encode = tiktoken.Encoding("own", pat_str=PRE_TOKENS.replace("++", "+"), mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    return lambda piece: merge(piece, ranks) if piece in ranks else encode(piece)


def _counts(vocabulary):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, whole, odd = vocabulary.value
        merged = merger(ranks)
        known = Remembering(dict.fromkeys(whole, 1 << WHOLE_BIT | 1), lambda p: len(merged(p.encode())))
        find, get = pre_tokenizer(odd), known.__getitem__
        for b in batches:
            both = [None if t is None else sum(map(get, find(t))) for t in b.column(1).to_pylist()]
            n, shortcut = [None if x is None else x & ((1 << WHOLE_BIT) - 1) for x in both], [None if x is None else x >> WHOLE_BIT for x in both]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(shortcut, pa.int64())], ["doc_id", "n_tokens", "n_whole"])

    return counts


@lru_cache(4)
def _proved(path: str, stamp: float) -> tuple[dict[bytes, int], set[str], str]:
    ranks = read_ranks(path)
    return ranks, whole_tokens(ranks), odd_signs()


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_whole) of each document: its byte-level BPE tokens, and those counted by the shortcut.

    The driver proves once for a vocabulary file which of its strings alone are one token (``whole_tokens``). Pre-tokens among
    them count 1 directly; only the rest are merged, and a bounded number of those remembered. There is no shuffle.

    A null text has null counts, an empty one 0. A text is taken literally: special tokens' strings are ordinary text.
    Ids may be of any type, and are returned in it. Repeated rows are counted each. No documents, no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(_proved(vocabulary, os.stat(vocabulary).st_mtime))  # the size of the vocabulary, whatever the input
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return rows.mapInArrow(_counts(shared), f"doc_id {kind_of(docs, id_col)}, n_tokens long, n_whole long")
