import random

import numpy as np
import pyarrow as pa
import pytest

from siftwork.llm import decontaminate as dc

ITEM = "A train leaves the old station at 40 km per hour and Anna waits for 15 minutes before she walks home along the river."


@pytest.fixture
def benchmark(spark):
    items = [(1, ITEM), (2, "Short item."), (3, None), (None, ""), (4, "Which of the planets in our solar system has the largest number of known moons today?")]
    return spark.createDataFrame([(i, t, "w", "a") for i, t in items], "item_id long, text string, window string, at string")


def test_leaks(spark, benchmark):
    lead = "Some words stand before it. "
    texts = [
        (1, lead + ITEM + " And after."),
        (2, lead + ITEM.replace("40", "95").replace("15", "20").replace("Anna", "Bert")),
        (3, lead * 20),
        (4, lead + " ".join(ITEM.split()[:9])),
        (5, None),
        (6, ""),
        (7, " ".join(w + "***" for w in ITEM.split())),
        (7, " ".join(w + "***" for w in ITEM.split())),
        (None, ITEM),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, window string")
    found = {(r.doc_id, r.item_id): r for r in dc.with_leaks(docs, benchmark).collect()}
    assert set(found) == {(1, 1), (2, 1), (7, 1), (None, 1)}
    assert found[2, 1].reparameterised and not found[1, 1].reparameterised
    left = dc.without_leaks(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6]


def test_slots_must_agree(spark, benchmark):
    """A text in which one slot takes many values is no copy of the item."""
    item = "The box holds 7 red and 7 blue and 7 green and 7 white and 7 black and 7 brown and 7 grey marbles."
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    values = iter(range(11, 30))
    mixed = " ".join(str(next(values)) if w == "7" else w for w in item.split())
    docs = spark.createDataFrame([(1, item.replace("7", "9")), (2, mixed)], "doc_id long, text string")
    assert [(r.doc_id, r.reparameterised) for r in dc.with_leaks(docs, bench).collect()] == [(1, True)]


def test_shuffled_lookup(spark, benchmark, monkeypatch):
    docs = spark.createDataFrame([(1, "x. " + ITEM), (2, "nothing to see in this text at all")], "doc_id long, text string")
    monkeypatch.setattr(dc, "LOOKUP", 3)
    assert [r.doc_id for r in dc.with_leaks(docs, benchmark).collect()] == [1]


def test_empty(spark, no_docs, odd_docs, benchmark):
    assert dc.with_leaks(no_docs, benchmark).count() == 0
    assert dc.with_leaks(odd_docs, benchmark.where("false")).count() == 0
    left = dc.without_leaks(odd_docs, benchmark)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count()
    assert {r._row_key for r in left.collect()} == {"f"}


def _held(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r.doc_id, r.item_id, r.reparameterised) for r in dc.with_leaks(docs, bench).collect())


def test_items_rich_in_numbers_and_names(spark):
    """Windows with one literal word count, and those with none by their values."""
    items = ["Compute 12 7 3 5 2", "12 7 3 55 2 9 11 4"]
    texts = ["now Compute 12 7 3 5 2 and stop", "row 12 7 3 55 2 9 11 4 is here", "row 13 8 4 56 3 10 12 5 is here"]
    assert _held(spark, items, texts) == [(0, 0, False), (1, 1, False)]


def test_two_variants_in_one_text(spark):
    """Slots are mapped by occurrence, so a worksheet of variants is a leak."""
    item = "What is 7 plus 5 minus 3 times 4 over 2 in all"
    put = lambda *v: item.replace("7", v[0]).replace("5", v[1]).replace("3", v[2]).replace("4", v[3]).replace("over 2", f"over {v[4]}")
    assert _held(spark, [item], [f"{put('1', '9', '1', '9', '1')}. Next one. {put('9', '1', '9', '1', '9')}."]) == [(0, 0, True)]


@pytest.mark.parametrize("limit", [0, 1000])
def test_short_texts_and_items_on_both_paths(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "LOOKUP", limit)
    items = ["Name three moons", "What is the blue thing"]
    texts = ["name three moons", "please name three moons and stop there", "name three", "Question What is the blue thing", "Question Anna is the blue thing", "blue"]
    assert _held(spark, items, texts) == [(0, 0, False), (1, 0, False), (3, 1, False)]


@pytest.mark.parametrize("limit", [0, 1000])
def test_against_brute_force(spark, monkeypatch, limit):
    """Literal items: the share of an item's words in windows that the text holds too, one of the texts being very long."""
    monkeypatch.setattr(dc, "LOOKUP", limit)
    rng = random.Random(5)
    words = [a + b for a in ("ba", "ku", "lor", "mit") for b in ("ne", "sol", "tar")]
    items = [[rng.choice(words) for _ in range(rng.randint(3, 30))] for _ in range(25)]
    texts = []
    for _ in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for item in rng.sample(items, 2):
            a = rng.randint(0, len(item) // 4)
            text += item[a : len(item) - rng.randint(0, len(item) // 4)] + [rng.choice(words) for _ in range(rng.randint(0, 5))]
        texts.append(text)
    texts.append([rng.choice(words) for _ in range(50_000)] + items[0])
    wanted = {}
    for i, text in enumerate(texts):
        for k, item in enumerate(items):
            size = min(5, len(item))
            held = {tuple(text[p : p + size]) for p in range(len(text) - size + 1)}
            covered = {q for p in range(len(item) - size + 1) if tuple(item[p : p + size]) in held for q in range(p, p + size)}
            if len(covered) >= 0.8 * len(item):
                wanted[i, k] = round(len(covered) / len(item), 9)
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(text)) for i, text in enumerate(texts)], "doc_id long, text string")
    found = dc.with_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id): round(r.coverage, 9) for r in found} == wanted and len(wanted) > 20
    assert not any(r.reparameterised for r in found)


def test_words_of_no_item_are_not_hashed(monkeypatch):
    """New words that no item has share rows and are never hashed; the windows found are those without the words' checksums."""
    rng = random.Random(3)
    items = [ITEM, "12 7 3 55 2 9 11 4", "Short item."]
    new = ["".join(rng.choice("abcdéñyz") for _ in range(9)) + rng.choice(["", "", ",", ".", "!"]) for _ in range(4000)]
    texts = [" ".join(new[k : k + 400] + ITEM.split() + new[k + 50 : k + 60] + ["Q" + w for w in new[k : k + 9]] + ["row 12 7 3 55 2 9 11 4 and a short item"]) for k in range(0, 4000, 400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(items))), pa.array(items)], names=["item_id", "text"])
    known = np.unique(np.concatenate([b.column("window").to_numpy() for b in dc._item_windows(5)([batch])]).view(np.uint64))
    words = np.concatenate([b.column("word").to_numpy() for b in dc._item_checksums([batch])])
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["row_key", "text"])
    hashed, plain = [], dc._hash
    monkeypatch.setattr(dc, "_hash", lambda word: hashed.append(word) or plain(word))
    for bare in (False, True):
        hashed.clear()
        found = [b.to_pydict() for b in dc._windowed([2, 5], bare, known, words)([docs])]
        assert len(hashed) < 100
        assert found == [b.to_pydict() for b in dc._windowed([2, 5], bare, known, None)([docs])] and len(found[0]["at"]) > 200
        assert len(hashed) > 4000
