"""Removal of byte strings that occur elsewhere too, by sampled suffixes.

The difference-cover scheme sorts a sample of suffixes in which any two equal
strings have a sampled position at the same offset, names them, and settles the
remaining suffixes from (distance to a sampled one, its name).  Here the cover
is drawn from the text itself: in every window of ``length`` bytes the position
whose 64-byte gram has the least hash (ties: leftmost) is sampled.  Equal
windows sample the same offset, which is all the scheme needs, at 1/130 of the
positions where a residue cover for 400 bytes needs 1/17 and triples 2/3.

1. Sample: one pass yields for each sampled position its gram's name and the
   name of its whole run (all windows it stands for).
2. Name: runs whose name occurs twice are repeated as a whole.
3. Recurse on names: only grams that occur with different runs go on, with one
   member for each run name.
4. Merge the remaining suffixes: members of a gram meet, and every window of
   their runs is named; equal names mark repeated windows.
5. Removed bytes are the union of repeated windows; texts get them by row key,
   and texts without any stay where they are.

The same scheme runs over words instead of bytes (``unit="words"``), so that
passages of a number of words are found whatever their length in bytes, and
with ``across`` only strings that other rows hold too count as repeated.

Defined cases: null or empty texts have no bytes; a text shorter than
``length`` loses nothing; repeated rows are copies of each other for the removal
and one row for ``across``; a null doc_id is carried through; extra columns are
ignored by ``remove_repeats`` and kept by ``without_repeats``, where a character
that a cut splits goes as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_texts, held_by, materialize, mix, prefix_hashes, signed, sized_broadcast, small_batches, span_hashes, word_hashes

#: Symbols of a gram at most, by the unit of strings; shorter strings have grams of half their length.
GRAM = {"bytes": 64, "words": 8}
#: Positions inside a stretch take the low bits of a key; longer texts are sampled in stretches.
_LOW = np.uint64((1 << 24) - 1)
STRETCH = 8 << 20
#: Runs of one gram that are compared in memory; a gram with more is counted by window names in Spark.
GROUP_RUNS = 20_000
#: Runs that are put together for one vectorised comparison.
BATCH_BYTES = 4 << 20
#: Places and spans up to this size go to the texts; more, and they and the texts that have any are shuffled by row.
SIDE_BYTES = 1 << 20


@dataclass(frozen=True)
class Search:
    """Strings of ``length`` symbols that occur twice; with ``across``, in different rows."""

    length: int
    unit: str = "bytes"
    across: bool = False

    @property
    def gram(self) -> int:
        return min(GRAM[self.unit], -(-self.length // 2))

    @property
    def kind(self) -> type:
        return np.uint8 if self.unit == "bytes" else np.uint64

    def symbols(self, data: np.ndarray) -> np.ndarray:
        return data if self.unit == "bytes" else word_hashes(data)


def sampled(data: np.ndarray, prefix: np.ndarray, length: int, gram: int = GRAM["bytes"]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions, gram names, and the first and last window start that each stands for."""
    width = length - gram + 1
    parts = []
    for base in range(0, len(data) - length + 1, STRETCH):
        grams = min(len(data) - base, STRETCH + length - 1) - gram + 1
        at = np.arange(grams)
        names = span_hashes(prefix, at + base, at + base + gram)
        padded = np.full(-(-grams // width) * width, ~np.uint64(0))
        padded[:grams] = (names & ~_LOW) | at.astype(np.uint64)
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = grams - width + 1
        least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
        first = np.flatnonzero(np.diff(least, prepend=~least[:1]))
        last = np.append(first[1:], n) - 1
        pos = (least[first] & _LOW).astype(np.int64)
        parts.append((pos + base, names[pos], first + base, last + base))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _samples(searches: list[Search]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, search in enumerate(searches):
                out, rows = [], []
                for row, text in enumerate(byte_texts(batch.column("text"))):
                    data = search.symbols(text)
                    if len(data) < search.length:
                        continue
                    prefix = prefix_hashes(data)
                    pos, names, first, last = sampled(data, prefix, search.length, search.gram)
                    runs = span_hashes(prefix, first, last + search.length) ^ mix((pos - first).astype(np.uint64))
                    out.append((names, runs, first, last))
                    rows.append(np.full(len(pos), row))
                if not out:
                    continue
                names, runs, first, last = (np.concatenate(x) for x in zip(*out, strict=True))
                keys = batch.column("row_key").take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(names), number, np.int32)), pa.array(signed(names)), pa.array(signed(runs)), keys, *(pa.array(x.astype(np.int32)) for x in (first, last))],
                    names=["search", "gram", "run", "row_key", "first", "last"],
                )

    return run


def _contexts(searches: list[Search]):
    """The symbols of each run to compare: text[first : last + length]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, key, places in zip(byte_texts(batch.column("text")), batch.column("row_key").to_pylist(), batch.column("places").to_pylist(), strict=True):
                for number in sorted({p["search"] for p in places}):
                    search = searches[number]
                    data = search.symbols(text)
                    own = [p for p in places if p["search"] == number]
                    bodies = [data[p["first"] : p["last"] + search.length].tobytes() for p in own]
                    values = [[number] * len(own), [p["gram"] for p in own], [key] * len(own), [p["first"] for p in own], [p["alone"] for p in own], bodies]
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["search", "gram", "row_key", "first", "alone", "body"])

    return run


def _repeated_spans(keys: list, firsts: list, alone: list, bodies: list, length: int, kind: type, across: bool) -> list[tuple[int, int, int]]:
    """Spans of the windows that occur twice among the bodies (in different rows if ``across``); of bodies marked alone only."""
    sizes = np.array([len(b) for b in bodies]) // np.dtype(kind).itemsize
    prefix = prefix_hashes(np.frombuffer(b"".join(bodies), kind))
    begin = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(bodies)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begin[owner]
    names = span_hashes(prefix, start, start + length)
    twice = np.zeros(len(names), bool)
    if across:
        row = np.array(keys)[owner]
        order = np.lexsort((row, names))
        head = np.flatnonzero(np.diff(names[order], prepend=~names[order][:1]))
        tail = np.append(head[1:], len(order)) - 1
        # Of equal names, the least and the greatest row differ.
        twice[order] = np.repeat(row[order][head] != row[order][tail], tail - head + 1)
    else:
        order = np.argsort(names, kind="stable")
        same = names[order][1:] == names[order][:-1]
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    twice &= np.array(alone)[owner]
    hit = np.flatnonzero(twice)
    if len(hit) == 0:
        return []
    cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(owner[hit]) > 0))
    out = []
    for a, b in zip(hit[np.append(0, cut + 1)], hit[np.append(cut, len(hit) - 1)], strict=True):
        o = owner[a]
        out.append((keys[o], int(firsts[o] + start[a] - begin[o]), int(firsts[o] + start[b] - begin[o] + length)))
    return out


def _compared(searches: list[Search]):
    """Rows sorted by search and gram; whole grams are put together up to BATCH_BYTES and compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None

        def flush(number: int) -> pa.RecordBatch:
            search = searches[number]
            spans = _repeated_spans(*(list(x) for x in zip(*rows, strict=True)), search.length, search.kind, search.across)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([number] * len(spans), pa.int32()), *(pa.array([s[i] for s in spans], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32())))], names=["search", "row_key", "start", "end"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("search", "gram", "row_key", "first", "alone", "body")]
            for number, gram, *row in zip(*columns, strict=True):
                if rows and (number, gram) != last and (number != last[0] or size >= BATCH_BYTES):
                    yield flush(last[0])
                    size = 0
                last = number, gram
                rows.append(tuple(row))
                size += len(row[-1])
        if rows:
            yield flush(last[0])

    return run


def _window_names(searches: list[Search]):
    """One row for each window of a run of a very frequent gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, key, first, alone, body in zip(*(batch.column(c).to_pylist() for c in ("search", "row_key", "first", "alone", "body")), strict=True):
                data = np.frombuffer(body, searches[number].kind)
                at = np.arange(len(data) - searches[number].length + 1)
                names = span_hashes(prefix_hashes(data), at, at + searches[number].length)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, np.int32)), pa.array(signed(names)), pa.array(np.full(len(at), key)), pa.array((at + first).astype(np.int32)), pa.array(np.full(len(at), alone))], names=["search", "name", "row_key", "start", "alone"])

    return run


def _union(spans: list | None) -> list[list[int]]:
    runs: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


def _kept(data: np.ndarray, runs: list[list[int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(data)]
    return b"".join(data[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, n_removed, n_spans, n_shared, kept = [], [], [], [], []
        for data, spans in zip(byte_texts(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            runs, shared = (_union([s for s in spans or () if s["search"] == number]) for number in (0, 1))
            n_bytes.append(len(data))
            n_removed.append(sum(b - a for a, b in runs))
            n_spans.append(len(runs))
            n_shared.append(sum(b - a for a, b in shared))
            kept.append(_kept(data, runs))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans, n_shared)), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_shared_words", "kept"],
        )


def repeated_spans(docs: DataFrame, searches: list[Search]) -> DataFrame:
    """search (place in the list), row_key, start, end: spans (they may overlap) of docs(row_key, text) whose every symbol lies in a repeated string."""
    least = min(s.length if s.unit == "bytes" else 2 * s.length - 1 for s in searches)
    length = F.array(*[F.lit(s.length) for s in searches])[F.col("search")]
    across = F.array(*[F.lit(s.across) for s in searches])[F.col("search")]
    samples = materialize(docs.where(F.octet_length("text") >= least).mapInArrow(_samples(searches), "search int, gram long, run long, row_key long, first int, last int"), "samples")

    # Of all samples only what decides is shuffled: rows for ``across``, else numbers; runs are told apart among the repeated grams alone.
    row = F.when(across, F.col("row_key"))
    grams = samples.groupBy("search", "gram").agg(F.count("*").alias("n"), F.min(row).alias("low"), F.max(row).alias("high"))
    grams = materialize(grams.where(F.when(across, F.col("low") < F.col("high")).otherwise(F.col("n") > 1)).select("search", "gram"), "grams")
    repeated = samples.join(sized_broadcast(grams, 24), ["search", "gram"])
    runs = repeated.groupBy("search", "gram", "run").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "first", "last")).alias("m"), F.max("row_key").alias("high"))
    alone = F.when(across, F.col("m.row_key") == F.col("high")).otherwise(F.col("n") == 1)
    runs = materialize(runs.select("search", "gram", "run", "n", alone.alias("alone"), "m.*"), "runs")
    several = materialize(runs.groupBy("search", "gram").count().where("count > 1").select("search", "gram", F.lit(True).alias("several")), "several")
    runs = materialize(runs.join(sized_broadcast(several, 24), ["search", "gram"], "left").withColumn("several", F.coalesce("several", F.lit(False))), "runs")
    # Runs that are repeated as a whole, and runs that one row alone holds several times: all their places.
    placed = samples.join(sized_broadcast(runs.where("not alone or several and n > 1").select("search", "gram", "run", "alone"), 32), ["search", "gram", "run"])
    placed = materialize(placed.select("search", "gram", "row_key", "first", "last", "alone"), "placed")
    whole = placed.where("not alone").select("search", "row_key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))

    members = runs.where("several and (not alone or n = 1)").select("search", "gram", "row_key", "first", "last", "alone").unionByName(placed.where("alone"))
    frequent = materialize(members.groupBy("search", "gram").count().where(F.col("count") > GROUP_RUNS).select("search", "gram", F.lit(True).alias("frequent")), "frequent")
    places = materialize(members.groupBy("row_key").agg(F.collect_list(F.struct("search", "gram", "first", "last", "alone")).alias("places")), "places")
    texts = _joined(docs, places, "places", 28)
    # Of repeated rows no run is alone in bytes, and for ``across`` they are one row, so their bodies may stand there twice.
    bodies = texts.select("row_key", "text", "places").mapInArrow(_contexts(searches), "search int, gram long, row_key long, first int, alone boolean, body binary")
    some = frequent.limit(1).count()
    if some:
        bodies = materialize(bodies.join(sized_broadcast(frequent, 24), ["search", "gram"], "left"), "bodies")
    usual = bodies.where("frequent is null").drop("frequent") if some else bodies
    found = usual.repartition("search", "gram").sortWithinPartitions("search", "gram").mapInArrow(_compared(searches), "search int, row_key long, start int, end int")
    spans = whole.unionByName(found)
    if some:
        named = bodies.where("frequent").select("search", "row_key", "first", "alone", "body").mapInArrow(_window_names(searches), "search int, name long, row_key long, start int, alone boolean")
        twice = named.groupBy("search", "name").agg(F.count("*").alias("n"), F.min("row_key").alias("low"), F.max("row_key").alias("high"))
        twice = twice.where(F.when(across, F.col("low") < F.col("high")).otherwise(F.col("n") > 1)).select("search", "name")
        spans = spans.unionByName(named.where("alone").join(twice, ["search", "name"]).select("search", "row_key", "start", (F.col("start") + length).alias("end")))
    return spans


def _joined(docs: DataFrame, side: DataFrame, array: str, width: int, how: str = "inner") -> DataFrame:
    """docs with the arrays (``width`` bytes an entry) that side(row_key, array) has for their rows; only docs that a bitmap does not tell apart from these are shuffled."""
    small = sized_broadcast(side, 40 + width * F.size(array), SIDE_BYTES)
    if small is not side:
        return docs.join(small, "row_key", how)
    docs = held_by(docs, side.select("row_key"), "row_key")
    joined = docs.where("maybe").drop("maybe").join(side, "row_key", how)
    if how == "inner":
        return joined
    others = docs.where("not maybe").drop("maybe").withColumn(array, F.lit(None).cast(side.schema[array].dataType))
    return joined.unionByName(others)


def _with_spans(docs: DataFrame, searches: list[Search]) -> DataFrame:
    """docs with spans: the repeated spans of each text as an array, or null."""
    spans = repeated_spans(docs.select("row_key", "text"), searches).groupBy("row_key").agg(F.collect_set(F.struct("search", "start", "end")).alias("spans"))
    return _joined(docs, materialize(spans, "spans"), "spans", 20, "left")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row_key", F.xxhash64("doc_id", "text"))


def remove_repeats(docs: DataFrame, length: int = 400, shared_words: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_shared_words, kept (the remaining bytes) for each row of docs(doc_id, text).

    n_shared_words: words in passages of ``shared_words`` words or more that another row holds too; they stay unless ``length`` bytes repeat.
    """
    small_batches(docs.sparkSession)
    docs = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    searches = [Search(length), Search(shared_words, "words", across=True)]
    return _with_spans(docs, searches).select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, n_shared_words long, kept binary")


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs with text lacking every repeated byte string of ``length``; n_chars counted anew, other columns as they are."""
    small_batches(docs.sparkSession)
    columns, kinds = docs.columns, dict(docs.dtypes)
    plain = _keyed(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("whole")))
    joined = _with_spans(plain, [Search(length)]).select("whole", "text", "spans")
    schema = docs.sparkSession.createDataFrame([], f"whole {joined.schema['whole'].dataType.simpleString()}, new_text string").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_kept(data, _union(spans)).decode(errors="ignore") for data, spans in zip(byte_texts(batch.column("text")), batch.column("spans").to_pylist(), strict=True)]
            old = batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("whole"), pa.array([t if ok else None for t, ok in zip(texts, old.is_valid().to_pylist(), strict=True)], pa.string())], names=["whole", "new_text"])

    out = joined.mapInArrow(run, schema)
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text")}
    return out.select(*[new[c].cast(kinds[c]).alias(c) if c in new else F.col("whole")[c].alias(c) for c in columns])
