"""Spelling variants: a self-join of the vocabulary trie with active-node sets.

1. Each task counts the words of its texts; the counts are added up, and the
   frequent long words are the *vocabulary*.
2. The trie is partitioned by prefix.  Words at distance one differ in one
   place, so either the first half of the shorter one stands in both, or its
   second half does: each word goes to the partition of its leading half in the
   trie, and to that of its trailing half in the trie of reversed words, with
   the halves of its own length and of one less (the longer side of an
   insertion).  Words of a partition differ only below its prefix.
3. A partition with more than WORDS words is cut again: the part that its words
   do not share is halved in the same way, until one letter is left.  So no
   prefix makes a large task, and nothing is dropped.
4. In a partition, nodes are visited from the prefix down.  A node's active set
   holds the nodes within distance one; it is derived from its parent's set by
   deletion, match, replacement and insertion.  A terminal node emits the
   terminal nodes at distance one in its set.
5. The pairs give near words, forms and, by doubling along the forms, roots.

Defined cases: null and empty texts have no words; a null doc_id counts as an
empty string; repeated rows count each time; a word whose deletion leaves fewer
letters than ``least`` is not counted; ties of n go to the word that is smaller
in code-point order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import byte_texts, materialize, sized_broadcast, small_batches

#: Words of a partition of the trie at most; counted words that a task holds before it passes them on.
WORDS, HELD = 5000, 200_000
_RUN = re.compile("[a-zÀ-ÿ]+")


def _counted(least: int, spoil: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text"))):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # bytes.lower() changes A-Z only.
                for word, n in Counter(_RUN.findall(data.tobytes().lower().decode())).items():
                    if len(word) < least:
                        continue
                    h = zlib.crc32(word.encode(), start)
                    if spoil and h % spoil == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return run


def vocabulary(docs: DataFrame, least: int = 6, times: int = 5, spoil: int = 199) -> DataFrame:
    """word, n: letter runs of docs(doc_id, text) with at least ``least`` letters and ``times`` occurrences.

    spoil: one in so many (document, word) pairs loses a letter, by a hash of both; 0 for none.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = docs.mapInArrow(_counted(least, spoil), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _halved(words: DataFrame) -> DataFrame:
    """words(word) with the partitions each goes to: length of the shorter side, letters shared in front and behind."""
    n = F.length("word")

    def place(shorter: Column) -> list[Column]:
        half = F.floor(shorter / 2).cast("int")
        return [F.struct(shorter.alias("length"), half.alias("front"), F.lit(0).alias("back")), F.struct(shorter.alias("length"), F.lit(0).alias("front"), (shorter - half).alias("back"))]

    return words.select("word", F.explode(F.array(*place(n), *place(n - 1))).alias("p")).select("word", "p.*").where("length > 0")


def _refined(places: DataFrame) -> DataFrame:
    """The same places with half of the part that is not shared yet added in front, and behind."""
    open_ = F.col("length") - F.col("front") - F.col("back")
    half = F.floor(open_ / 2).cast("int")
    halves = F.array(F.struct((F.col("front") + half).alias("front"), F.col("back").alias("back")), F.struct(F.col("front").alias("front"), (F.col("back") + open_ - half).alias("back")))
    return places.select("word", "length", F.explode(halves).alias("p")).select("word", "length", "p.*")


def _keyed(places: DataFrame) -> DataFrame:
    n = F.length("word")
    shared = F.substring("word", F.lit(1), F.col("front")), F.substring("word", n - F.col("back") + 1, F.col("back"))
    return places.withColumn("key", F.xxhash64("length", "front", "back", *shared))


class _Node:
    __slots__ = ("active", "below", "id", "word")

    def __init__(self, id: int):
        self.id, self.below, self.word, self.active = id, {}, None, None


def _trie(words: list[str]) -> tuple[_Node, list[_Node]]:
    root = _Node(0)
    nodes = [root]
    for word in words:
        at = root
        for letter in word:
            below = at.below.get(letter)
            if below is None:
                below = at.below[letter] = _Node(len(nodes))
                nodes.append(below)
            at = below
        at.word = word
    return root, nodes


def near_in_trie(words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs (a, b) of distinct words at distance one, each once, by active-node sets.

    A node's active set: itself at distance 0, and all other nodes at distance 1.
    """
    root, nodes = _trie(words)
    root.active = [nodes[x.id] for x in root.below.values()]
    todo = [root]
    while todo:
        node = todo.pop()
        for letter, child in node.below.items():
            # From the node itself: the letter deleted, replaced by a sibling's, or another one inserted behind it.
            near = {node.id: node} | {x.id: x for other, x in node.below.items() if other != letter} | {x.id: x for x in child.below.values()}
            # From nodes at distance 1: the letter must match.
            for other in node.active:
                match = other.below.get(letter)
                if match is not None and match is not child:
                    near[match.id] = match
            child.active = list(near.values())
            if child.word is not None:
                for x in child.active:
                    if x.word is not None and child.id < x.id:
                        yield child.word, x.word
            todo.append(child)
        node.active = None


def _partition_pairs(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, str]]:
    """Pairs (smaller, larger) of the words that came under one key: rows (word, front, back).

    The trie starts below the shared prefix, or for words that share only their end, below the reversed end.
    Words that differ there stand together only by a collision of keys and are kept apart.
    """
    tries = defaultdict(list)
    for word, front, back in rows:
        tries[front, back, word[:front], word[len(word) - back :]].append(word)
    for (front, back, start, end), words in tries.items():
        if len(words) < 2:
            continue
        if front or not back:
            found = ((start + a, start + b) for a, b in near_in_trie([w[front:] for w in words]))
        else:
            found = ((a[::-1] + end, b[::-1] + end) for a, b in near_in_trie([w[::-1][back:] for w in words]))
        yield from ((min(pair), max(pair)) for pair in found)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a partition of the trie may go on in the next batch."""

    def out(found: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.string()) for k in (0, 1)], names=["a", "b"])

    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist()
        rest, found = batch.select(["word", "front", "back"]), []
        for i, (a, b) in enumerate(zip(starts, starts[1:] + [len(keys)])):
            if keys[a] != key:
                found += _partition_pairs(held)
                key, held = keys[a], []
            # A word that stands alone under its key is not even looked at.
            if b - a > 1 or held or i == len(starts) - 1:
                held += zip(*(c.to_pylist() for c in rest.slice(a, b - a).columns))
        yield out(found)
    yield out(list(_partition_pairs(held)))


def near_words(words: DataFrame) -> DataFrame:
    """a, b (a < b): all pairs of distinct words(word) that differ by one letter inserted, deleted or replaced."""
    places = _keyed(_halved(words.select("word")))
    final = None
    while True:
        counts = places.groupBy("key").count()
        large = materialize(counts.where(F.col("count") > WORDS).select("key"), "large")
        if large.limit(1).count() == 0:
            break
        hint = sized_broadcast(large, 16)
        small, places = places.join(hint, "key", "left_anti"), places.join(hint, "key", "left_semi")
        single = F.col("length") - F.col("front") - F.col("back") <= 1
        final = (final.unionByName(small) if final is not None else small).unionByName(places.where(single))
        places = materialize(_keyed(_refined(places.where(~single).drop("key"))), "places")
    final = final.unionByName(places) if final is not None else places
    sorted_ = final.select("key", "word", "front", "back").repartition("key").sortWithinPartitions("key")
    return sorted_.mapInArrow(_joined, "a string, b string").distinct()


def _rooted(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms, by doubling."""
    steps = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = after.where("moved").limit(1).count()
        steps = after.select("word", "root")
        if not moved:
            return steps


def variants(docs: DataFrame, least: int = 6, times: int = 5, factor: int = 5, spoil: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary of docs(doc_id, text).

    A word's form is its near word of largest n, if that is at least ``factor`` times its own.
    """
    words = materialize(vocabulary(docs, least, times, spoil), "vocabulary")
    pairs = materialize(near_words(words), "near")
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_other")), "b")
    best = others.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("order"), F.col("b").alias("other"))).alias("best"))
    known = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    is_form = -F.col("best.order") >= factor * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.order")).alias("form_n"))
    known = materialize(known, "forms")
    roots = _rooted(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = """
WITH RECURSIVE polynomial AS (
    SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))
), runs AS (
    SELECT doc_id, run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents)
    WHERE length(run) >= 6 GROUP BY doc_id, run
), bytes AS (
    SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END)) AS b
    FROM runs
), hashed AS (
    SELECT run, n, xor(list_reduce([4294967295] || b, lambda h, x: xor(h >> 8, crc[(xor(h, x) & 255) + 1])), 4294967295) AS h FROM bytes, polynomial
), words AS (
    SELECT word, sum(n)::BIGINT AS n
    FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), less AS (
    SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
    SELECT a.word AS word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT l.word, w.word FROM less l JOIN words w ON l.rest = w.word
    UNION SELECT w.word, l.word FROM less l JOIN words w ON l.rest = w.word
), near AS (
    SELECT p.word, p.other, w.n AS n_other, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.other) AS place
    FROM pairs p JOIN words w ON p.other = w.word
), known AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN n_other >= 5 * w.n THEN other END AS form, CASE WHEN n_other >= 5 * w.n THEN n_other END AS form_n
    FROM words w LEFT JOIN near ON near.word = w.word AND place = 1
), chains AS (
    SELECT word, word AS root, form AS next FROM known
    UNION ALL SELECT c.word, k.word, k.form FROM chains c JOIN known k ON c.next = k.word
)
SELECT k.word, k.form, c.root, k.n, k.n_near, k.form_n FROM known k JOIN chains c ON c.word = k.word AND c.next IS NULL
"""
