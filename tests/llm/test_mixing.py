import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from siftwork.llm import mixing
from siftwork.llm.queries import op12_mixing_to_target_weights

SCHEMA = "doc_id long, text string, source string, size string, rank long, text_key string, _c0 string"


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def brute_targets(rows, weights=(1, 2, 3), most=3):
    """Shares by weight; whoever is above the limit stops there, and the others share what is left, until none is above."""
    size = Counter()
    for _, text, source in rows:
        size[source] += words(text)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    total, target, free = sum(size.values()), {}, set(size)
    while free:
        left = total - sum(target.values())
        share = {s: Fraction(left * weight[s], sum(weight[f] for f in free)) for s in free}
        above = {s for s in free if share[s] > most * size[s]}
        if not above:
            return size, target | share
        target |= {s: Fraction(most * size[s]) for s in above}
        free -= above
    return size, target


def check(rows, found, most=3):
    size, target = brute_targets(rows, most=most)
    assert Counter((r.doc_id, r.size, r.source) for r in found) == Counter((i, words(t), s) for i, t, s in rows)
    taken, largest = Counter(), defaultdict(int)
    for r in found:
        assert r.source_size == size[r.source] and abs(r.target - float(target[r.source])) <= 1e-9 * max(1, r.target)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= most
        if r.size:
            rate = target[r.source] / size[r.source]
            assert rate - 1 < r.copies < rate + 1
            largest[r.source] = max(largest[r.source], r.size)
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - float(t)) <= largest[s] / 2 + 1


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "a", 5, "b", "c") for i, t, s in rows], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def rows():
    out = [(i, " ".join(["w"] * (1 + i * 7 % 43)), f"s{i % 5}" if i % 3 else "hot") for i in range(700)]
    out += [(9000, "one  two\tthree\n", None), (9000, "one  two\tthree\n", None), (None, "a b", None), (None, "c d", "hot"), (9001, None, "s1"), (9002, "", "s2"), (9003, " \n", "empty"), (9004, "\x0bx y", "tiny"), (9005, "é" * 40 + " b", "Ωmega"), (9006, "w " * 30000, "s3")]
    return out + [(9100, "again and again", "s4")] * 300


@pytest.mark.parametrize("fan", [64, 3])
def test_targets_and_words(spark, rows, fan, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", fan)
    monkeypatch.setattr(mixing, "REPEATS", 7)
    found = mixing.mix(table(spark, rows)).collect()
    check(rows, found)
    again = mixing.mix(table(spark, rows[::-1]).repartition(7)).collect()
    assert Counter(found) == Counter(again)
    repeated = Counter(r.copies for r in found if r.doc_id == 9100)
    assert sum(repeated.values()) == 300 and max(repeated) - min(repeated) <= 1


def test_empty_tables_and_texts(spark):
    assert mixing.mix(table(spark, []).limit(0)).count() == 0
    found = mixing.mix(table(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in found] == [(0, 0.0, 0)] * 2


def test_expectation(spark):
    """In 100 sources of 210 fractional documents, documents win as often as their fraction says; no words are lost."""
    item = [(i, 5 + i % 5, (3 + 5 * (i % 7)) / 40) for i in range(210)]
    rows = [(rank, i, size, rank, int(part * size * mixing.UNIT), size * mixing.UNIT) for rank in range(100) for i, size, part in item]
    items = spark.createDataFrame(rows, "rank long, doc_id long, size long, text_key long, mass long, whole long")
    wins, words_of = Counter(), Counter()
    for r in mixing._rounded(items, 0).collect():
        assert r.mass in (0, r.whole)
        wins[r.doc_id % 35] += r.mass > 0
        words_of[r.rank] += r.mass / mixing.UNIT
    assert max(abs(wins[i] / 600 - part) for i, _, part in item[:35]) < 0.08
    expected = sum(size * part for _, size, part in item)
    assert max(abs(n - expected) for n in words_of.values()) <= 5


def test_mixed_rows_and_given_weights(spark, rows):
    docs = table(spark, rows)
    found = Counter()
    for r in mixing.mix(docs).collect():
        found[r.doc_id, r.source, r.size] += r.copies
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    made = Counter((r.doc_id, r.source, words(r.text)) for r in out.collect())
    assert made == Counter({k: n for k, n in found.items() if n})
    given = spark.createDataFrame([("hot", 5), (None, 1)], "source string, weight int")
    taken = Counter()
    for r in mixing.mix(docs, given).collect():
        taken[r.source] += r.taken
        assert r.source in ("hot", None) or r.target == 0
    assert set(s for s, n in taken.items() if n) == {"hot", None}


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    check(rows, op12_mixing_to_target_weights(spark, path).collect())
