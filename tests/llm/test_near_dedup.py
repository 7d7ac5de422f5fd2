import itertools
import random

import pytest

from siftwork.llm import near_dedup as nd
from siftwork.llm.components import connected_components

from .conftest import prose


def shingles(text, size):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            up[q] = p
    return sorted((i, len(s), None if i is None else find(i)) for i, s in sets if i is not None)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
@pytest.mark.parametrize("block", [256, 3])
def test_against_brute_force(odd_docs, odd_rows, size, percent, block, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_MEMBERS", block)
    found = nd.near_duplicates(odd_docs, size, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None) == brute(odd_rows, size, percent)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in found)
    assert len(found) == len(odd_rows)


def brute_texts(rows, size, percent):
    """Groups of texts, linked by their sets alone; the smallest id of each group stays, empty texts and rows without an id too."""
    texts = sorted({(i, t) for i, t in rows if i is not None and shingles(t, size)}, key=str)
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations([(k, shingles(t, size)) for k, (_, t) in enumerate(texts)], 2):
        if 100 * len(x & y) >= percent * len(x | y):
            up[find(b)] = find(a)
    groups = {}
    for k, (i, t) in enumerate(texts):
        groups.setdefault(find(k), []).append((i, t))
    return groups.values()


def check_one_of_each(left, rows, size, percent):
    kept = [(r.doc_id, r.text) for r in left]
    for group in brute_texts(rows, size, percent):
        stay = [row for row in kept if row in group]
        assert len(stay) == 1 and stay[0][0] == min(i for i, _ in group)
    plain = lambda some: sorted((i, t or "") for i, t in some if i is not None and not shingles(t, size))
    assert plain(kept) == plain(set(rows))
    assert sum(i is None for i, _ in kept) == sum(i is None for i, _ in rows)


def test_empty_and_one_of_each(odd_docs, odd_rows, no_docs):
    assert nd.near_duplicates(no_docs).count() == 0
    assert nd.one_of_each(no_docs).count() == 0
    left = nd.one_of_each(odd_docs, 5, 80)
    assert left.columns == odd_docs.columns
    check_one_of_each(left.collect(), odd_rows, 5, 80)


@pytest.fixture(scope="module")
def shared_rows():
    """Ids with several texts, which other ids hold too."""
    rng = random.Random(11)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(5, a), (9, a), (9, c), (12, c), (20, b), (21, b + " more"), (21, d), (22, ""), (22, d), (23, None), (23, prose(rng, 9)), (30, "one"), (30, "one"), (31, "one two")]
    return rows + [(40, prose(rng, 30)) for _ in range(200)] + [(41 + k, t) for k, (_, t) in enumerate(rows[:3])] + [(None, a), (50, c), (50, c)]


@pytest.mark.parametrize("block", [256, 2])
def test_ids_with_several_texts(spark, shared_rows, block, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_MEMBERS", block)
    docs = spark.createDataFrame(shared_rows, "doc_id long, text string").repartition(3)
    found = nd.near_duplicates(docs, 5, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None) == brute(shared_rows, 5, 80)
    assert {r.component_id for r in found if r.doc_id in (5, 9, 12, 50)} == {5}
    left = nd.one_of_each(docs, 5, 80).collect()
    check_one_of_each(left, shared_rows, 5, 80)
    texts = dict(shared_rows[:1]), shared_rows[2][1]
    assert {texts[0][5], texts[1]} <= {r.text for r in left}


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (50, 50)], "a long, b long")
    found = {r.node: r.component for r in connected_components(chain, "a", "b").collect()}
    assert found == {i: 0 for i in range(21)} | {100: 100, 101: 100}


def test_bands_miss_rarely():
    for percent in (70, 80, 85, 95):
        rows = nd.band_rows(percent / 100)
        assert (1 - (percent / 100) ** rows) ** (nd.BINS // rows) <= nd.MISS
