"""Benchmark decontamination on canonical templates.

Words are stripped of punctuation at their edges and lower-cased; numbers,
units and names (capitalised inside a sentence) become typed placeholders.
Windows of ``size`` template words of the texts are hash-joined with those of
the benchmark; a window of placeholders alone goes by its raw values.  A matched
window keeps its slot values on both sides, and an item's slot must map to one
value in an occurrence: windows that contradict the mapping most windows agree
on are dropped.  A text holds an item if at least ``share`` of the item's words
lie in consistent windows, so re-parameterised copies are caught and chance
overlaps are not.

Defined cases: null or empty texts and items give no windows; an item shorter
than ``size`` words is one window of its own length; an item's first word may stand inside a sentence of the text if it is the same word;
repeated rows give one result; a null doc_id or item_id is carried through;
extra columns are ignored by ``leaks`` and kept by ``without_leaks``.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_texts, materialize, signed, sized_broadcast, small_batches, windows

#: Units that become a placeholder (fixed values).
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec min h hr hrs % $ € £ usd eur gbp dollar dollars euro euros pound pounds cent cents inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers gram grams kilogram kilograms litre litres liter liters second seconds minute minutes hour hours day days week weeks month months year years degree degrees percent".split())
#: Benchmark windows up to this number are looked up inside the scan; more are joined by shuffle.
LOOKUP = 2_000_000
#: Distinct words a worker remembers.
MEMORY = 300_000
#: First bits of a window's name by which most windows are told from benchmark windows.
_START_BITS = 20
#: Last bits of a word's checksum by which words of no item are told from words of items.
_WORD_BITS = 22
_EDGE = re.compile(r"^[^\w$€£%]+|[^\w$€£%]+$")
_STOP = re.compile(r"[.!?:][^\w]*$")
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/-]*%?$")
NUM, UNIT, NAME = "\0num", "\0unit", "\0name"


def _hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")


_SLOTS = {p: _hash(p) for p in (NUM, UNIT, NAME)}
_PLACEHOLDERS = np.array(sorted(_SLOTS.values()), np.uint64)


def _read(word: str) -> tuple[str, str, bool, bool]:
    """The template word after a sentence end and inside a sentence, whether it ends a sentence, and whether it counts as a word."""
    bare = word[:-1] if word[-1] in ".,;:!?" else word
    if bare.isalnum():
        # Most words: nothing else to strip.
        stop = bare is not word and word[-1] in ".!?:"
    else:
        bare = _EDGE.sub("", word).rstrip("_")
        bare = bare if bare in ("$", "€", "£", "%") else bare.strip("$€£%_") if not _NUMBER.match(bare) else bare
        stop = bool(_STOP.search(word))
    low = bare.lower()
    plain = UNIT if low in UNITS else low if low.isalpha() or not _NUMBER.match(low) else NUM
    inside = NAME if plain is low and bare[:1].isupper() and bare[1:].islower() else plain
    return plain, inside, stop, bool(low)


def _value(word: str) -> str:
    """A placeholder's value, told from template words."""
    return "\0=" + _EDGE.sub("", word).lower()


def _checksum(word: str) -> int:
    return crc32(word.encode()) & (1 << _WORD_BITS) - 1


class _Templates(dict):
    """Word bytes -> 4 * row + 2 if it ends a sentence + 1 if it counts as a word; a row: hash after a sentence end, hash inside a sentence, hash of a placeholder's value.

    ``known`` has the checksums of all words of the items: others are in no window of an item and have the hash 0.  Without ``values`` these are 0.
    """

    def __init__(self, known: np.ndarray | None = None, values: bool = True):
        self.rows = np.zeros((1 << 16, 3), np.uint64)
        self.values, self.known = values, None
        if known is not None:
            self.known = bytearray(1 << _WORD_BITS)
            np.frombuffer(self.known, np.uint8)[known] = 1
            for unit in UNITS:
                self.known[_checksum(unit)] = 1
        self.forget()

    def forget(self) -> None:
        self.clear()
        # Words of no item are most, and share a few rows, of which the first is all zeros.
        self.places = {(0, 0, 0): 0}
        self.rows[0] = 0

    def _hash(self, word: str) -> int:
        return _SLOTS.get(word) or (_hash(word) if self.known is None or self.known[_checksum(word)] else 0)

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode()
        bare = word[:-1] if word[-1] in ".,;:!?" else word
        if self.known is not None and bare.islower() and bare.isalpha() and not self.known[_checksum(bare.lower())]:
            # Most words that are new: in lower case and of no item.
            self[raw] = found = 3 if word[-1] in ".!?:" else 1
            return found
        plain, inside, stop, counts = _read(word)
        first = self._hash(plain)
        row = first, first if inside is plain else self._hash(inside), self._hash(_value(word)) if self.values and inside in _SLOTS else 0
        i = len(self) + 1 if self.known is None else self.places.setdefault(row, len(self.places))
        if i == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        self.rows[i] = row
        self[raw] = found = 4 * i + 2 * stop + counts
        return found

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Template hashes of a text's words that are not punctuation alone, which words those are, and their rows."""
        if len(self) > MEMORY:
            self.forget()
        raw = data.split()
        at = np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))
        counts = (at & 1).astype(bool)
        inside = np.zeros(len(at), np.int64)
        inside[1:] = (at[:-1] & 2) == 0
        place = at >> 2
        return self.rows[place, inside][counts], counts, place[counts]


def _slots(template: np.ndarray, raw: list[bytes], at: int, size: int) -> list[str]:
    """Placeholder values of a window, each with its kind's hash before it so kinds never mix."""
    return [f"{int(template[i]) & 0xFF:02x}{_EDGE.sub('', raw[i].decode()).lower()}" for i in range(at, min(at + size, len(template))) if template[i] in _PLACEHOLDERS]


def _named(template: np.ndarray, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the windows, and which are of placeholders alone and so named by their values."""
    found = windows(template, width)
    slots = np.concatenate(([0], np.cumsum(np.isin(template, _PLACEHOLDERS))))
    bare = slots[width:] - slots[:-width] == width
    if bare.any():
        found[bare] = windows(values, width)[bare]
    return found, bare


def _item_windows(size: int):
    """All windows of each item; the first one also with its first word as it reads elsewhere in a sentence (``fixed`` if that makes it a slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Templates()
        for batch in batches:
            rows = []
            for item, data in zip(batch.column("item_id").to_pylist(), byte_texts(batch.column("text")), strict=True):
                body = data.tobytes()
                template, counts, place = memory.words(body)
                n = len(template)
                if not n:
                    continue
                width, values = min(size, n), memory.rows[place, 2]
                raw = [w for w, c in zip(body.split(), counts, strict=True) if c]
                found, bare = _named(template, values, width)
                rows += [(item, name, at, _slots(template, raw, at, width), n, False, b) for at, (name, b) in enumerate(zip(signed(found).tolist(), bare.tolist(), strict=True))]
                start, inside = memory.rows[place[0], :2]
                if start != inside:
                    other = template[:width].copy()
                    other[0] = inside if template[0] == start else start
                    found, bare = _named(other, values[:width], width)
                    rows.append((item, signed(found).tolist()[0], 0, _slots(other, raw, 0, width), n, bool(np.isin(other[0], _PLACEHOLDERS)), bool(bare[0])))
            if rows:
                kinds = [batch.column("item_id").type, pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["item_id", "window", "item_at", "item_slots", "item_words", "fixed", "bare"])

    return run


def _item_checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checksums of all template words and values of the items."""
    for batch in batches:
        found = set()
        for data in byte_texts(batch.column("text")):
            for word in map(bytes.decode, data.tobytes().split()):
                found.update(map(_checksum, (*_read(word)[:2], _value(word))))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], names=["word"])


def _windowed(widths: list[int], bare: bool, known: np.ndarray | None, words: np.ndarray | None):
    """The windows of each text of the widths that items have, those in ``known`` of ``words`` if they are given; ``bare``: items have windows of placeholders alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Templates(words, bare)
        if known is not None:
            # Whether any known name starts with these bits: most windows need no search.
            starts = np.zeros(1 << _START_BITS, bool)
            starts[known >> np.uint64(64 - _START_BITS)] = True
        for batch in batches:
            rows, names, at_, slots = [], [], [], []
            for row, data in enumerate(byte_texts(batch.column("text"))):
                body = data.tobytes()
                template, counts, place = memory.words(body)
                raw = None
                for width in widths:
                    if width > len(template):
                        continue
                    found = _named(template, memory.rows[place, 2], width)[0] if bare else windows(template, width)
                    if known is None:
                        hit = np.arange(len(found))
                    else:
                        hit = np.flatnonzero(starts[found >> np.uint64(64 - _START_BITS)])
                        hit = hit[known[np.minimum(np.searchsorted(known, found[hit]), len(known) - 1)] == found[hit]]
                    if not len(hit):
                        continue
                    raw = raw or [w for w, c in zip(body.split(), counts, strict=True) if c]
                    rows += [row] * len(hit)
                    names.append(found[hit])
                    at_ += hit.tolist()
                    slots += [_slots(template, raw, i, width) for i in hit.tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_key").take(pa.array(rows)), pa.array(signed(np.concatenate(names))), pa.array(at_, pa.int32()), pa.array(slots, pa.list_(pa.string()))],
                    names=["row_key", "window", "at", "slots"],
                )

    return run


def _judged(met: list[dict], n: int, size: int, share: float) -> tuple[int, float, bool] | None:
    """n_windows, coverage, reparameterised of one text and one item of n words: their matched windows, judged over the whole text and round each alignment, the best of which counts."""
    item_at = [w["item_at"] for w in met]
    pairs = [list(zip(w["item_slots"], w["slots"], strict=True)) for w in met]

    def covered(which) -> int:
        return len({i for at in {item_at[w] for w in which} for i in range(at, min(at + size, n))})

    def agreed(which, already: dict) -> dict:
        votes: dict[str, Counter] = defaultdict(Counter)
        for w in which:
            for a, b in pairs[w]:
                if a not in already:
                    votes[a][b] += 1
        return already | {a: min(c, key=lambda b: (-c[b], b)) for a, c in votes.items()}

    def judged(first, among) -> tuple[int, bool, int]:
        """Words covered, whether no slot is changed, and the windows that agree: slots go by ``first``, those it lacks by the rest."""
        map_ = agreed(first, {})
        map_ = agreed([w for w in among if all(map_.get(a, b) == b for a, b in pairs[w])], map_)
        keep = [w for w in among if all(map_[a] == b if a in map_ else False for a, b in pairs[w])]
        return covered(keep), all(a == b for w in keep for a, b in pairs[w]), len(keep)

    whole = range(len(pairs))
    if covered(whole) < share * n:
        return None
    best = judged(whole, whole)
    offsets = np.array([w["at"] for w in met]) - np.array(item_at)
    if best[:2] != (n, True) and offsets.min() != offsets.max():
        order = np.argsort(offsets, kind="stable")
        placed = offsets[order]
        for o in np.unique(offsets).tolist():
            cut = np.searchsorted(placed, [o - n, o, o + 1, o + n + 1])
            best = max(best, judged(order[cut[1] : cut[2]].tolist(), order[cut[0] : cut[3]].tolist()))
    return None if best[0] < share * n else (best[2], best[0] / n, not best[1])


def _consistent(size: int, share: float):
    """The texts and items whose matched windows, an array in each row, agree on enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_judged(met.as_py(), n, size, share) for met, n in zip(batch.column("met"), batch.column("item_words").to_pylist(), strict=True)]
            at = pa.array([i for i, f in enumerate(found) if f], pa.int64())
            columns = list(zip(*filter(None, found), strict=True)) or [(), (), ()]
            kinds = [pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key").take(at), batch.column("item_id").take(at), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["row_key", "item_id", "n_windows", "coverage", "reparameterised"],
            )

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_row_key", F.xxhash64(F.col("doc_id"), F.col("text")))


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, share: float = 0.8) -> DataFrame:
    """row_key (xxhash64 of doc_id and text), item_id, n_windows, coverage, reparameterised for each text that holds an item."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.mapInArrow(_item_windows(size), "item_id long, window long, item_at int, item_slots array<string>, item_words int, fixed boolean, bare boolean")
    items = materialize(items.distinct(), "items")
    names = items.select("window").distinct()
    # 8 bytes a window, by Arrow; LOOKUP bounds them.
    known = np.sort(names.toArrow().column(0).to_numpy().view(np.uint64)) if names.limit(LOOKUP + 1).count() <= LOOKUP else None
    # 4 bytes a checksum, of which there are 4 million.
    words = None if known is None else benchmark.select(F.col("text").cast("string").alias("text")).mapInArrow(_item_checksums, "word int").distinct().toArrow().column(0).to_numpy()
    if items.limit(1).count() == 0:
        return spark.createDataFrame([], "row_key long, item_id long, n_windows long, coverage double, reparameterised boolean")
    texts = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select(F.col("_row_key").alias("row_key"), "text")
    has = items.agg(F.collect_set(F.least("item_words", F.lit(size))).alias("widths"), F.max("bare").alias("bare")).first()
    hits = texts.mapInArrow(_windowed(sorted(has.widths), bool(has.bare), known, words), "row_key long, window long, at int, slots array<string>")
    pairs = hits.join(sized_broadcast(items.drop("bare"), 120), "window").where(F.size("slots") == F.size("item_slots"))
    pairs = pairs.where(~F.col("fixed") | (F.get("slots", F.lit(0)) == F.get("item_slots", F.lit(0)))).drop("fixed")
    # Windows at so few places of an item cannot cover its share; such pairs, which are most, never reach Python.
    met = pairs.groupBy("row_key", "item_id").agg(F.first("item_words").alias("item_words"), F.collect_list(F.struct("window", "at", "slots", "item_at", "item_slots")).alias("met"))
    met = met.where(F.size(F.array_distinct("met.item_at")) * size >= F.lit(share) * F.col("item_words"))
    return met.mapInArrow(_consistent(size, share), "row_key long, item_id long, n_windows long, coverage double, reparameterised boolean")


def with_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, share: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, reparameterised for each text that holds an item."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(leaks(docs, benchmark, size, share), "leaks")
    return _keyed(docs).join(sized_broadcast(found, 48), F.col("_row_key") == F.col("row_key")).select("doc_id", "item_id", "n_windows", "coverage", "reparameterised").distinct()


def without_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, share: float = 0.8) -> DataFrame:
    """The rows of docs that hold no item, columns as they are."""
    found = materialize(leaks(docs, benchmark, size, share).select(F.col("row_key").alias("_row_key")).distinct(), "leaks")
    # The columns travel in a struct, so that one with a reserved name stays.
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    return _keyed(whole).join(sized_broadcast(found, 16), "_row_key", "left_anti").select("whole.*")
