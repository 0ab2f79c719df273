"""A quality classifier from preference pairs (Bradley-Terry), and a threshold at a score quantile."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, free_name, ship_package, within
from .textops import NOT_WORD, U64, slices, words

#: Words and their first PREFIX bytes are hashed to so many bits each.
WORD_BITS, PREFIX = 18, 4
#: Labelled documents of each class that are learnt from, at most: those whose ids have the least hashes.
SAMPLE = 2500
#: Pairs that each bad document is in, at least.
PAIRS = 8
#: Words, and beginnings of words, that fewer documents of the sample have aren't learnt.
LEAST_DOCUMENTS = 10
#: Documents are rejected whose score is below this quantile of the scores of all labelled good documents.
QUANTILE = 0.003

_KINDS = [
    set(range(65, 91)),
    set(range(97, 123)),
    set(range(48, 58)),
    {10},
    set(b"!?"),
    set(b".,;:'\"-()"),
    set(b"|"),
    {b for b in range(33, 127) if not chr(b).isalnum()} - set(b"!?.,;:'\"-()|"),
    set(range(128, 256)),
]
_CLASSES = np.array([[float(b in k) for k in _KINDS] for b in range(256)])
N_SHAPE = len(_KINDS) + 4
SHAPE_AT = 2 << WORD_BITS
N_FEATURES = SHAPE_AT + N_SHAPE


def _shape(data: np.ndarray, offs: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, N_SHAPE): shares of kinds of bytes and of words like the one before; how many and how long the words are."""
    n, size, count = len(offs) - 1, np.diff(offs), np.diff(bounds)
    out = np.zeros((n, N_SHAPE))
    tally = np.bincount(np.repeat(np.arange(n) << 8, size) + data, minlength=n << 8).reshape(n, 256)
    out[:, : len(_KINDS)] = tally @ _CLASSES / np.maximum(size, 1)[:, None]
    if len(hashes):
        same = np.zeros(len(hashes) + 1)
        same[2:] = np.cumsum(hashes[1:] == hashes[:-1])
        inner = np.minimum(bounds[:-1] + 1, bounds[1:])
        out[:, -4] = (same[bounds[1:]] - same[inner]) / np.maximum(count, 1)
    out[:, -3] = 1 / (1 + count / 8)
    out[:, -2] = np.minimum(size / np.maximum(count, 1) / 20, 2)
    out[:, -1] = np.minimum(np.log1p(count) / 12, 1)
    return out


def features(arr: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row of each feature, feature, value, shape), by slices of the texts.

    The value of a word, or beginning of words, that occurs c times among n words is log(1 + c) / (n + 20) ** 0.25. With ``wanted``,
    features that are false there are left out.
    """
    for i, j, data, offs in slices(arr):
        _, _, hashes, bounds, prefixes = words(data, offs, NOT_WORD, lower=True, prefix=PREFIX)
        n = np.diff(bounds)
        row, found = np.repeat(np.arange(j - i), n), []
        for kind, h in enumerate((hashes, prefixes)):
            ids = (h >> U64(64 - WORD_BITS)).astype(np.int64) + (kind << WORD_BITS)
            rows = row
            if wanted is not None:
                good = wanted[ids]
                ids, rows = ids[good], row[good]
            found.append(rows * np.int64(2 << WORD_BITS) + ids)
        both, count = np.unique(np.concatenate(found), return_counts=True)
        r = both >> (WORD_BITS + 1)
        yield i, j, r, both & ((2 << WORD_BITS) - 1), np.log1p(count) / (n[r] + 20.0) ** 0.25, _shape(data, offs, hashes, bounds)


def scores(arr: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The score of each text; a null counts as empty."""
    out, wanted = np.zeros(len(arr)), weights != 0
    for i, j, r, ids, values, shape in features(arr, wanted):
        out[i:j] = np.bincount(r, weights=values * weights[ids], minlength=j - i) + shape @ weights[SHAPE_AT:]
    return out


def learn(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, good: np.ndarray, steps: int = 150, rate: float = 0.1, l1: float = 1e-4, l2: float = 0.1, seed: int = 7) -> np.ndarray:
    """Bradley-Terry weights: the chance that document a is preferred to b is the logistic of their scores' difference.

    Document ``rows[i]`` has feature ``ids[i]`` with ``values[i]``; documents that are ``good`` are preferred to the others. The logistic loss on
    the differences of the features, over PAIRS pairs for each bad document and one at least for each good one, is
    minimised by Adam with a penalty of both kinds; what stays near zero becomes zero. Without both classes all weights are zero.
    """
    w = np.zeros(N_FEATURES)
    g, b = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(g) or not len(b):
        return w
    rng = np.random.Generator(np.random.PCG64(seed))
    better, worse = np.concatenate([rng.choice(g, len(b) * PAIRS), g]), np.concatenate([np.repeat(b, PAIRS), rng.choice(b, len(g))])
    often = (np.bincount(ids, minlength=N_FEATURES) >= min(LEAST_DOCUMENTS, len(good) // 20 + 1)) | (np.arange(N_FEATURES) >= SHAPE_AT)
    rows, ids, values = (x[often[ids]] for x in (rows, ids, values))
    used, ids = np.unique(ids, return_inverse=True)
    v, m, s, n = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used)), len(good)
    for t in range(1, steps + 1):
        score = np.bincount(rows, weights=values * v[ids], minlength=n)
        p = 1 / (1 + np.exp(np.clip(score[better] - score[worse], -30, 30))) / len(better)
        by_doc = np.bincount(worse, weights=p, minlength=n) - np.bincount(better, weights=p, minlength=n)
        grad = np.bincount(ids, weights=values * by_doc[rows], minlength=len(used)) + l2 * v / len(used) + l1 * np.sign(v)
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        v -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-6)
    w[used] = np.where((np.abs(v) > 0.05) | (used >= SHAPE_AT), v, 0)
    return w.astype(np.float32).astype(np.float64)


def _labelled(labels: DataFrame, id_col: str, quality_col: str, toxic_col: str) -> DataFrame:
    """(id, good) once an id: good if it has a quality of 1 and isn't toxic in any of its rows; a null label is neither."""
    good = (F.coalesce(col(quality_col), F.lit(0)) == 1) & (F.coalesce(col(toxic_col), F.lit(0)) == 0)
    known = labels.filter(col(id_col).isNotNull() & (col(quality_col).isNotNull() | col(toxic_col).isNotNull()))
    return known.groupBy(col(id_col).alias("id")).agg(F.min(good).alias("good"))


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, r, ids, values, shape in features(b.column(1)):
            rows, at = np.nonzero(shape)
            r, ids, values = np.concatenate([r, rows]), np.concatenate([ids, SHAPE_AT + at]), np.concatenate([values, shape[rows, at]])
            order = np.argsort(r, kind="stable")
            r, ids, values = r[order], ids[order].astype(np.int32), values[order].astype(np.float32)
            cut = np.searchsorted(r, np.arange(j - i + 1))
            raw = [[x[cut[k] : cut[k + 1]].tobytes() for k in range(j - i)] for x in (ids, values)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(x, pa.binary()) for x in raw)], ["good", "ids", "values"])


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str, text_col: str, sample: int = SAMPLE, quality_col: str = "quality", toxic_col: str = "toxic") -> tuple[np.ndarray, DataFrame]:
    """The weights learnt from up to ``sample`` labelled documents of each class, and the written table (id, good) of all labels.

    Only labels of documents that there are, with a text, are sampled. Of several rows with a sampled id, the one of the least text hash is learnt from.
    """
    known = scratch.write(_labelled(labels, id_col, quality_col, toxic_col))
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).filter("text is not null")
    there = scratch.write(known.join(within(texts.select("id"), "id", known.select("id")).distinct(), "id", "left_semi"))
    picked = None
    for value in (True, False):
        part = there.filter(F.col("good") == value).orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    picked = F.broadcast(picked)  # 2 * sample rows of two columns at most
    one = F.min(F.struct(F.xxhash64("text"), "text"))["text"]
    texts = texts.join(picked, "id").groupBy("id", "good").agg(one.alias("text"))
    got = texts.select("good", "text").mapInArrow(_samples, "good boolean, ids binary, values binary").collect()
    got.sort(key=lambda r: (r["good"], r["ids"], r["values"]))  # whatever the tasks' order
    good = np.array([r["good"] for r in got], bool)
    rows = np.repeat(np.arange(len(got)), [len(r["ids"]) // 4 for r in got])
    ids = np.frombuffer(b"".join(r["ids"] for r in got), np.int32).astype(np.int64)
    values = np.frombuffer(b"".join(r["values"] for r in got), np.float32).astype(np.float64)
    return learn(rows, ids, values, good), known


def quantile(df: DataFrame, name: str, q: float, bins: int = 2048) -> float | None:
    """The value at rank ceil(q * n), 1 at least, of a column without nulls: exact, by histograms narrowed to the bin that holds it."""
    c = F.col(name)
    lo, hi, n = df.agg(F.min(c), F.max(c), F.count(c)).first()
    if not n:
        return None
    rank = max(1, math.ceil(q * n))
    while lo < hi:
        inside = df.filter((c >= lo) & (c <= hi))
        width = (hi - lo) / bins
        if width <= abs(lo) * 1e-15 or width < 1e-300:
            break
        cell = F.least(F.greatest(F.floor((c - lo) / width), F.lit(0)), F.lit(bins - 1))
        counts = sorted((r["cell"], r["n"], r["lo"], r["hi"]) for r in inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).collect())
        for _, k, a, b in counts:
            if rank <= k:
                lo, hi = a, b
                break
            rank -= k
    return lo


def _scorer(spark, weights: np.ndarray):
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))  # N_FEATURES numbers, whatever the input

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        return pd.Series(scores(pa.array(text, pa.string(), from_pandas=True), shared.value.astype(np.float64)))

    return score.asNondeterministic()  # else a filter of scores would work them out once more


def threshold(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, q: float = QUANTILE):
    """(scoring function of a column, least score that is kept, or None); of the texts only those of labelled good documents are scored here."""
    weights, known = train(docs, labels, scratch, id_col, text_col, sample)
    score = _scorer(docs.sparkSession, weights)
    if not weights.any():
        return score, None
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).filter("octet_length(text) > 0")
    good = within(texts, "id", scratch.write(known.filter("good").select("id")))
    return score, quantile(scratch.write(good.select(score(F.col("text")).alias("score"))), "score", q)


def rank_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, q: float = QUANTILE) -> DataFrame:
    """(doc_id, score) of the documents that the classifier keeps.

    Good labelled documents (quality 1, not toxic) are preferred to the other labelled ones. From pairs of a bounded sample
    of labelled documents, ``sample`` of each class at most, weights of hashed words, beginnings of words and the text's shape are learnt
    (``learn``). All documents are scored, in one pass, and those go whose score is below the ``q`` quantile of the scores of all labelled good documents.

    Null and empty texts have a null score and are kept. Ids may be of any type that sorts. Repeated rows are scored each, rows with a null id too.
    Without labels of both classes among the documents nothing is rejected. Labels of unknown documents or null texts and null labels are passed over;
    of several labels of an id the worst holds. No documents, no rows. Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    score, least = threshold(docs, labels, Scratch(docs.sparkSession, "quality"), id_col, text_col, sample, q)
    scored = docs.select(col(id_col).alias("doc_id"), F.when(F.octet_length(col(text_col)) > 0, score(col(text_col))).alias("score"))
    return scored if least is None else scored.filter((F.col("score") >= least) | F.col("score").isNull())


def drop_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, q: float = QUANTILE) -> DataFrame:
    """``docs``, all columns, without the documents that ``rank_documents`` doesn't list.

    Null and empty texts, null ids and repeated rows are kept or go as there; no documents, no rows; columns keep their names, whatever these are.
    """
    ship_package(docs.sparkSession)
    score, least = threshold(docs, labels, Scratch(docs.sparkSession, "quality"), id_col, text_col, sample, q)
    if least is None:
        return docs
    (name,) = free_name(docs, "__score")
    scored = docs.withColumn(name, score(col(text_col)))
    return scored.filter((col(name) >= least) | ~(F.coalesce(F.octet_length(col(text_col)), F.lit(0)) > 0)).select(*[col(c) for c in docs.columns])
