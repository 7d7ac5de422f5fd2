"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Texts are tokenized, cut into pieces of at most ``capacity`` tokens, and only
the number of pieces of each length (at most ``capacity`` counts) goes to the
driver.  There the dominance criterion fixes bins that some optimal packing
contains, in bulk; best-fit decreasing places the rest, also in bulk.  The plan
is a table of steps "pieces of length s with ranks from j go to bins from b, t
a bin"; its size depends on the capacity, not on the number of pieces.  Pieces
are ranked inside their length by bucketed counts, so no task sees a length
whole, and a join with the steps gives every piece its place.

Defined cases: null or empty texts have the end token alone (one piece of
length 1); repeated rows are packed each for itself; a null doc_id is carried
through; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, small_batches

#: Words whose ids a Python worker remembers, and the longest such word.
CACHE_WORDS, CACHE_CHARS = 150_000, 48
#: Pieces of one length are ranked in buckets of about this many.
RANKED = 50_000
#: A space before other white space, or at the end.
_WIDE = re.compile(r" (?:\s|\Z)")


@cache
def _encoder(path: str):
    """The byte-level BPE whose ranks stand beside the tokenizer file ``path`` (same vocabulary, same ids; its added tokens are split off first, as there)."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError(f"{path}: added tokens that take white space or whole words are not supported")
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t["content"]: t["id"] for t in added}
    encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    plain, whole, marks = encoding.encode_ordinary, partial(encoding.encode, allowed_special="all"), tuple(special)
    return lambda text: whole(text) if any(m in text for m in marks) else plain(text)


class _Words(dict):
    """Ids of a word with the space before it, as little-endian bytes."""

    def __init__(self, path: str):
        self.encode = _encoder(path)

    def ids(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.ids(" " + word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def tokenize(self, text: str) -> bytes:
        """A space before a non-space always starts a token, so a text may be cut there; other white space after a space sends the text to the encoder whole."""
        if _WIDE.search(text):
            return self.ids(text)
        first, *rest = text.split(" ")
        return self.ids(first) + b"".join(map(self.__getitem__, rest))


@cache
def _words(path: str) -> _Words:
    """One memory a Python worker."""
    return _Words(path)


def _pieces(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = words.tokenize(text or "") + end
                n = len(ids) // 4
                at = [0, *range(n % capacity or capacity, n, capacity), n]
                for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    rows.append(row)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def dominant_bins(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes out of counts, and returns as (lengths, how many), bins that dominate all others with their largest piece.

    For the piece j let k be the longest other piece that fits with it.  A bin
    dominates if any bin with j could swap its other pieces for those here:
    {j} if nothing fits; {j, k} if it is full, if no two others fit with j, or
    if at most two fit and k is at least as long as any such two together;
    {j, k, s} if at most two fit, s is the longest that fits after k, and no
    two pieces longer than s fit with j.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        fixed.append((lengths, times))
        counts.subtract({s: n * times for s, n in Counter(lengths).items()})

    again = True
    while again:
        again = False
        for j in range(capacity, 0, -1):
            while counts[j] > 0:
                have = np.array([s for s in range(1, capacity + 1) if counts[s] - (s == j) > 0])
                room = capacity - j
                fits = have[have <= room]
                if len(fits) == 0:
                    take((j,), counts[j])
                    again = True
                    break
                k, least = int(fits[-1]), int(fits[0])
                left = {int(s): counts[int(s)] - (s == j) for s in fits}
                # The two and the three shortest others.
                short = [s for s in map(int, fits[:3]) for _ in range(min(3, left[s]))]
                two = sum(short[:2]) if len(short) > 1 else capacity + 1
                three = sum(short[:3]) if len(short) > 2 else capacity + 1
                lengths = None
                if k == room or two > room:
                    lengths = (j, k)
                elif three > room:
                    pair = max((int(a) + int(b) for a in fits if len(b_ := fits[(fits <= room - a) & ((fits != a) | (left[int(a)] > 1))]) for b in b_[-1:]), default=0)
                    rest = [s for s in map(int, fits) if s <= room - k and left[s] - (s == k) > 0]
                    if k >= pair:
                        lengths = (j, k)
                    elif rest and not any(s > rest[-1] and (2 * s <= room and left[s] > 1 or any(s < b <= room - s for b in map(int, fits))) for s in map(int, fits)):
                        lengths = (j, k, rest[-1])
                if lengths is None:
                    break
                need = Counter(lengths)
                times = min(counts[s] // n for s, n in need.items())
                # The argument holds while the shortest pieces and k last.
                if k != room and two <= room:
                    times = max(1, min(times, *(counts[s] - 3 for s in set(short))))
                take(lengths, times)
                again = True
    return fixed


def packing_steps(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, last rank, first bin, pieces a bin, offset) that place every piece."""
    counts = Counter(histogram)
    used: Counter = Counter()
    steps: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def place(s: int, n: int, first_bin: int, each: int, offset: int) -> None:
        steps.append((s, used[s], used[s] + n - 1, first_bin, each, offset))
        used[s] += n

    # Bins by free room: intervals (first bin, how many).
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for lengths, times in dominant_bins(counts, capacity):
        offset = 0
        for s in lengths:
            place(s, times, bins, 1, offset)
            offset += s
        open_bins[capacity - offset].append((bins, times))
        bins += times
    for s in sorted((s for s in counts if counts[s] > 0), reverse=True):
        left = counts[s]
        while left:
            room = min((r for r, x in open_bins.items() if r >= s and x), default=None)
            if room is None:
                each = capacity // s
                whole, part = divmod(left, each)
                if whole:
                    place(s, whole * each, bins, each, 0)
                    open_bins[capacity - each * s].append((bins, whole))
                    bins += whole
                if part:
                    place(s, part, bins, part, 0)
                    open_bins[capacity - part * s].append((bins, 1))
                    bins += 1
                break
            first, many = open_bins[room].pop()
            each = room // s
            if left >= each:
                n = min(many, left // each)
            else:
                n, each = 1, left
            place(s, n * each, first, each, capacity - room)
            open_bins[room - each * s].append((first, n))
            if many > n:
                open_bins[room].append((first + n, many - n))
            left -= n * each
    return steps


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = docs.mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")
    # Repeated rows share a bucket and are told apart by the rank alone, so any order among them serves.
    pieces = materialize(pieces.withColumn("spread", F.xxhash64("doc_id", "piece", "ids_crc32")), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not histogram:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    spark = docs.sparkSession
    steps = spark.createDataFrame(packing_steps(histogram, capacity), "length long, low long, high long, bin long, each long, at long")
    buckets = -(-max(histogram.values()) // RANKED)
    bucketed = pieces.withColumn("bucket", F.pmod("spread", F.lit(buckets)))
    before = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = bucketed.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(F.broadcast(before) if buckets * len(histogram) < 500_000 else before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    # The steps are a few for each length; their number is bounded by the capacity.
    places = F.broadcast(steps.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "bin", "each", "at"))).alias("steps")))
    step = F.filter("steps", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") <= s["high"]))[0]
    return (
        ranked.join(places, "length")
        .withColumn("step", step)
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("step.bin") + F.floor((F.col("rank") - F.col("step.low")) / F.col("step.each"))).cast("long").alias("sequence_id"),
            (F.col("step.at") + F.pmod(F.col("rank") - F.col("step.low"), F.col("step.each")) * F.col("length")).cast("long").alias("offset"),
        )
    )
