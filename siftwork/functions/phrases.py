"""Four-word phrases: sets, overlap, and copied runs."""

from __future__ import annotations

from functools import reduce
from operator import add

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import PHRASE_STOPWORDS
from .text import WORD, bind, tokens

SIZE = 4


def placed_phrases(text: Column, size: int = SIZE, stopwords: list[str] | None = None) -> Column:
    """Array of (at, phrase) in order: runs with at least two words longer than two letters that are no stop words."""
    stopwords = PHRASE_STOPWORDS if stopwords is None else stopwords
    word = lambda w: F.struct(w.alias("word"), ((F.length(w) > 2) & ~w.isin(stopwords)).cast("int").alias("telling"))

    def from_words(ws: Column) -> Column:
        run = lambda i: [F.get(ws, i + k) for k in range(size)]
        telling = lambda i: reduce(add, [w["telling"] for w in run(i)]) >= 2
        starts = F.filter(F.sequence(F.lit(0), F.size(ws) - size), telling)
        made = F.transform(starts, lambda i: F.struct(i.alias("at"), F.concat_ws(" ", *[w["word"] for w in run(i)]).alias("phrase")))
        return F.when(F.size(ws) >= size, made).otherwise(F.array().cast("array<struct<at:int,phrase:string>>"))

    return bind(F.transform(tokens(text), word), from_words)


def phrases(text: Column, size: int = SIZE, stopwords: list[str] | None = None) -> Column:
    """Distinct phrases of a text, in order."""
    return F.array_distinct(F.transform(placed_phrases(text, size, stopwords), lambda p: p["phrase"]))


def overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller set; 0 if one is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))


def copied_run(text: str, source: str, size: int, stopwords: frozenset) -> tuple[int, str]:
    """How many phrases of source a lower-case text has, and its longest run of them (the first of equals), 90 characters of it."""
    words_of = regex.compile(WORD + "+").findall
    theirs = words_of(source)
    telling = [len(w) > 2 and w not in stopwords for w in theirs]
    known = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1) if sum(telling[i : i + size]) >= 2}
    if not known:
        return 0, ""
    first, words = {k[0] for k in known}, words_of(text)
    seen, run, last, best, start = set(), 0, -2, 0, 0
    for at in (i for i in range(len(words) - size + 1) if words[i] in first):
        phrase = tuple(words[at : at + size])
        if phrase in known:
            seen.add(phrase)
            run, last = run + 1 if at == last + 1 else 1, at
            if run > best:
                best, start = run, at + 1 - run
    return len(seen), " ".join(words[start : start + best + size - 1])[:90] if best else ""


def copied(text: Column, source: Column, size: int = SIZE, stopwords: list[str] | None = None) -> Column:
    """struct(count, example): phrases of source in text, and the longest copied run, as in ``copied_run``."""
    stop = frozenset(PHRASE_STOPWORDS if stopwords is None else stopwords)

    def found_in(texts: pa.Array, sources: pa.Array) -> pa.Array:
        rows = [dict(zip(("count", "example"), copied_run(t, s, size, stop), strict=True)) for t, s in zip(texts.to_pylist(), sources.to_pylist(), strict=True)]
        return pa.array(rows, pa.struct([("count", pa.int32()), ("example", pa.string())]))

    # Type hints as objects: the function type is read from them.
    found_in.__annotations__ = {"texts": pa.Array, "sources": pa.Array, "return": pa.Array}
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.arrow_udf(found_in, "count int, example string")(low(text), low(source))
