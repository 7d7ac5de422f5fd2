import itertools
import random

import pytest
from pyspark.sql import functions as F

from siftwork.functions.phrases import copied
from siftwork.operators import linking, set_join


def table(spark, sets):
    return spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, set array<long>").repartition(3)


def brute(sets, near):
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) / min(len(x), len(y)) >= near:
            out[a, b] = len(x & y) / min(len(x), len(y))
    return out


@pytest.mark.parametrize("near", [0.5, 0.8, 1.0])
def test_against_all_pairs(spark, near):
    """Random sets, parts of others, copies, sets of one member, and sets of frequent members only."""
    rng = random.Random(int(near * 10))
    sets = {i: {int(60 * rng.random() ** 2) for _ in range(rng.randrange(0, 14))} for i in range(150)}
    for i in range(150, 220):
        base = sorted(sets[rng.randrange(150)])
        sets[i] = set(base[: rng.randrange(len(base) + 1)]) | {rng.randrange(1000, 9000) for _ in range(rng.randrange(0, 4))}
    sets |= {300 + i: {0, 1, 2} for i in range(6)} | {400: {0}, 401: {0, 5000}, 402: set()}
    found = {(r.a, r.b): r.overlap for r in set_join.overlapping(table(spark, sets), near).collect()}
    assert found == brute(sets, near) and len(found) > 20


def test_frequent_members_make_no_pairs(spark):
    """A passage that all texts share is in no prefix as long as a text has a fifth of its own."""
    sets = {i: set(range(40)) | {1000 + i * 20 + k for k in range(20)} for i in range(200)}
    sets |= {900: sets[3] | {77}, 901: set(range(40)) | {1060, 1061}}
    ordered = set_join.ordered_members(table(spark, sets))
    pairs = {tuple(r) for r in set_join.candidate_pairs(ordered, 0.8).select(F.least("a", "b"), F.greatest("a", "b")).collect()}
    expected = brute(sets, 0.8)
    assert set(expected) <= pairs
    # Only the set that is nearly all passage is compared with every other one.
    assert {p for p in pairs if 901 not in p} == {(3, 900)}


def test_near_copies_with_and_without_blocks(spark):
    """Without blocks a text inside a longer one is found though their smallest phrases differ."""
    inner = " ".join(f"word{i}" for i in range(40))
    outer = " ".join(f"aaa{i}" for i in range(60)) + " " + inner
    docs = spark.createDataFrame([(1, inner), (2, outer), (3, inner + " tail"), (4, inner.upper()), (5, None), (6, "the and of to")], "id long, text string")
    all_ = {(r.a, r.b, r.how) for r in linking.near_copies(docs, block=None).collect()}
    assert all_ == {(1, 2, "near"), (1, 3, "near"), (2, 3, "near"), (1, 4, "copy")}
    blocked = {(r.a, r.b, r.how) for r in linking.near_copies(docs).collect()}
    assert blocked == {(1, 3, "near"), (1, 4, "copy")}


def test_longest_copied_run(spark):
    """As the function on one text and one source has it, for all texts and sources at once."""
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(30)] + ["the", "of", "to"]
    sources = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(4)]
    texts = []
    for _ in range(40):
        ws = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 25))]
        for _ in range(rng.randrange(0, 4)):
            source = rng.choice(sources).split()
            at = rng.randrange(50)
            ws += source[at : at + rng.randrange(4, 12)] + [rng.choice(vocabulary) for _ in range(rng.randrange(0, 3))]
        texts.append(" ".join(ws))
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "id long, text string")
    targets = spark.createDataFrame([(f"t{k}", t) for k, t in enumerate(sources)], "tag string, text string")
    pairs = docs.join(targets.withColumnRenamed("text", "source")).select("id", "tag", copied(F.col("text"), F.col("source")).alias("c"))
    expected = {(r.id, r.tag): (r.c["count"], r.c.example) for r in pairs.collect() if r.c["count"] >= 4}
    found = linking.copied_runs(docs, targets).collect()
    assert {(r.id, r.tag): (r["count"], r.words[:90]) for r in found} == expected and len(expected) > 20
    assert all(texts[r.id].split()[r.first_word : r.first_word + r.run + 3] == r.words.split() for r in found)


def test_only_candidates_members_are_compared(spark, monkeypatch):
    """Members of sets that are in no candidate pair are not stored for the comparison."""
    kept = {}
    whole = set_join.stored
    monkeypatch.setattr(set_join, "stored", lambda df, name: kept.setdefault(name, whole(df, name)))
    sets = {i: {i * 100 + k for k in range(30)} | {7} for i in range(20)} | {50: {100 + k for k in range(29)} | {7}}
    found = [(r.a, r.b) for r in set_join.overlapping(table(spark, sets), 0.8).collect()]
    assert found == [(1, 50)] and {r.id for r in kept["compared"].collect()} == {1, 50}
