"""What is done with entities that a recognizer found: selection, routing, votes and anonymisation.

Entities are an array of struct<entity_group: string, score: double, word: string, start: int, end: int>, with offsets in characters.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

ENTITIES = "array<struct<entity_group:string,score:double,word:string,start:int,end:int>>"
SPANS = "array<struct<start:int,end:int,token:string>>"
ARROW_ENTITIES = pa.list_(pa.struct([("entity_group", pa.string()), ("score", pa.float64()), ("word", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string())]))
TOKENS = {"PER": "<PERSON>", "LOC": "<LOCATION>", "ORG": "<ORGANISATION>"}
DEFAULT_THRESHOLD = 0.85


def filter_tags(entities: Column, tags: Sequence[str]) -> Column:
    """Entities of the groups in ``tags``, of which there must be one."""
    if not tags:
        raise ValueError("tags must name one entity group at least")
    return F.filter(entities, lambda e: e["entity_group"].isin(*tags))


def filter_confident(entities: Column, threshold: float | None = DEFAULT_THRESHOLD) -> Column:
    """Entities that score ``threshold`` at least; None or 0 stand for the default."""
    return F.filter(entities, lambda e: e["score"] >= (threshold or DEFAULT_THRESHOLD))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` and its lambdas use it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _span(e: Column) -> Column:
    return F.struct(e["start"].alias("start"), e["end"].alias("end"))


def best_per_span(entities: Column) -> Column:
    """Of the entities with the same start and end the one that scores most, the first of equal ones; spans in order of appearance."""

    def all_best(entities: Column) -> Column:
        def best(span: Column) -> Column:
            own = F.filter(entities, lambda e: _span(e) == span)
            return _let(own, lambda own: F.reduce(own, F.get(own, F.lit(0)), lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a)))

        return F.transform(F.array_distinct(F.transform(entities, _span)), best)

    return _let(entities, all_best)


def vote(entities: Column, threshold: float) -> Column:
    """Spans whose mean score over all their entities is ``threshold`` at least, the best entity of each, in order of start."""

    def chosen(entities: Column) -> Column:
        def mean(e: Column) -> Column:
            own = F.filter(entities, lambda x: _span(x) == _span(e))
            return F.reduce(own, F.lit(0.0), lambda s, x: s + x["score"]) / F.size(own)

        return best_per_span(F.filter(entities, lambda e: mean(e) >= threshold))

    chosen = _let(entities, chosen)
    return F.array_sort(chosen, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def route(language: Column, by_language: dict[str, Column], english: Column, multilingual: Column, tags: Sequence[str]) -> Column:
    """The entities of the language's own recognizer; for other languages the English ones, or if none of those has a wanted tag the multilingual ones."""
    first = filter_tags(english, tags)
    other = F.when(F.size(first) > 0, first).otherwise(filter_tags(multilingual, tags))
    out = None
    for name, found in by_language.items():
        own = filter_tags(found, tags)
        out = F.when(language == name, own) if out is None else out.when(language == name, own)
    return other if out is None else out.otherwise(other)


def resolve_spans(text: Column, entities: Column) -> Column:
    """Spans to replace, in order and apart: array of struct<start, end, token>.

    Groups without a token, and spans that aren't inside the text, are passed over. Spans inside one that scores more, or
    as much and is longer, go. Spans of one group that overlap, or that only blanks part, become one. A span that overlaps one of another group begins
    where that ends. A span without a score counts as scoring most, then goes itself.
    """

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        spans = [None if e is None else [] if t is None else _resolved(t, e) for t, e in _with_spans(texts, found)]
        return pa.array([None if own is None else [dict(zip(("start", "end", "token"), s)) for s in own] for own in spans], ARROW_SPANS)

    return run(text, entities)


def anonymize(text: Column, entities: Column) -> Column:
    """The text with a token for each span of ``resolve_spans``; as it is if there is none. In one crossing to Python, in time that grows as the texts and spans do."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([_replaced(t, _resolved(t, e)) if t is not None and e else t for t, e in _with_spans(texts, found)], pa.string())

    return run(text, entities)


def _with_spans(texts: pa.Array, found: pa.Array) -> Iterator[tuple[str | None, list[tuple] | None]]:
    """Of each text, itself and its (start, end, rank of score, token), those that ``resolve_spans`` doesn't pass over; None for a null array."""
    size = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    flat = found.flatten()
    fields = dict(zip((f.name for f in flat.type), flat.flatten()))
    groups = fields["entity_group"].dictionary_encode()
    start, end, group = (pc.fill_null(a, -1).to_numpy(zero_copy_only=False).astype(np.int64) for a in (fields["start"], fields["end"], groups.indices))
    score = pc.cast(fields["score"], pa.float64()).to_numpy(zero_copy_only=False)
    unscored = fields["score"].is_null().to_numpy(zero_copy_only=False)
    if np.isnan(score).any():  # as nulls are here too; in Spark's order NaN comes after all numbers
        known = np.unique(score[~np.isnan(score)])
        score = np.where(unscored, len(known) + 1, np.searchsorted(known, np.where(np.isnan(score), np.inf, score), "left") + 0.0)
        score[np.isnan(pc.fill_null(pc.cast(fields["score"], pa.float64()), 0.0).to_numpy(zero_copy_only=False))] = len(known)
    tokens = [*(TOKENS.get(g) for g in groups.dictionary.to_pylist()), None]
    has_token = np.array([t is not None for t in tokens])
    length = np.repeat(pc.fill_null(pc.utf8_length(texts), -1).to_numpy(zero_copy_only=False), size)
    wanted = has_token[group] & (start >= 0) & (start < end) & (end <= length)
    for text, null, n, to in zip(texts, found.is_null().to_pylist(), size, ends):
        if null:
            yield text.as_py(), None
            continue
        own = np.flatnonzero(wanted[to - n : to]) + (to - n)
        lost = unscored[own].tolist()
        spans = zip(start[own].tolist(), end[own].tolist(), score[own].tolist(), [tokens[g] for g in group[own].tolist()])
        yield text.as_py(), [(a, b, s, None if gone else t) for (a, b, s, t), gone in zip(spans, lost)]


def _resolved(text: str, spans: Iterable[tuple[int, int, float, str | None]]) -> list[list]:
    """[start, end, token] of each span of ``resolve_spans``; one without a token beats others, but isn't kept."""
    kept: set[tuple[int, int, str]] = set()
    # of the spans so far those that may beat another: ends go up, scores go down; what has the same end or a later one stands from a place on, the highest score first
    ends: list[int] = []
    tops: list[tuple[float, int]] = []
    for a, b, score, token in sorted(spans, key=lambda s: (s[0], -s[1], -s[2])):
        i = bisect_left(ends, b)
        if i < len(ends) and (tops[i][0] > score or (tops[i][0] == score and (tops[i][1], ends[i]) != (a, b))):
            continue
        if token is not None:
            kept.add((a, b, token))
        if i < len(ends) and tops[i][0] == score:
            continue
        least = i
        while least and tops[least - 1][0] <= score:
            least -= 1
        ends[least:i], tops[least:i] = [b], [(score, a)]
    done: list[list] = []
    for a, b, token in sorted(kept):
        last = done[-1] if done else None
        if last and last[2] == token and (a <= last[1] or not text[last[1] : a].strip()):
            last[1] = max(last[1], b)
        elif not last or b > last[1]:
            done.append([max(a, last[1]) if last else a, b, token])
    return done


def _replaced(text: str, spans: Iterable[Sequence]) -> str:
    out, at = [], 0
    for a, b, token in spans:
        out += [text[at:a], token]
        at = b
    return "".join([*out, text[at:]])


def anonymize_text(text: str, entities: Sequence[tuple[str, float, int, int]]) -> str:
    """What ``anonymize`` gives, for a Python string and its (group, score, start, end)."""
    return _replaced(text, _resolved(text, [(a, b, score, TOKENS[g]) for g, score, a, b in entities if g in TOKENS and 0 <= a < b <= len(text)]))


def split_chunks(text: Column, max_tokens: int) -> Column:
    """Pieces of ``max_tokens`` words each, with the white space after them, that make up the text; none for a blank text."""
    if max_tokens < 1:
        raise ValueError("max_tokens must be 1 or more")
    piece = f"[{P.SPACE}]*+(?:[^{P.SPACE}]++[{P.SPACE}]*+){{1,{max_tokens}}}+"
    return F.regexp_extract_all(text, F.lit(piece), F.lit(0))
