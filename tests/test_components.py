import random

from siftwork.operators import components, postings

POSTING = "id string, title string, company string, location string, url string, posted date, text string, source string, source_url string, searched_for array<string>"


def brute(edges):
    up = {n: n for e in edges for n in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        up[q] = p
    return {n: find(n) for n in up if any(n in e and e[0] != e[1] for e in edges)}


def test_random_graphs(spark, monkeypatch):
    rng = random.Random(2)
    for split in (0, 1_000_000):
        monkeypatch.setattr(components, "SMALL", split)
        edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(500, 500 + i) for i in range(40)] + [(7, 7)]
        found = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
        assert len(found) == len({r.node for r in found})
        assert {r.node: r.component for r in found} == brute(edges)
    none = spark.createDataFrame([], "a string, b string")
    assert components.connected_components(none, "a", "b").count() == 0


def test_a_long_chain_of_ads(spark, monkeypatch):
    """10,000 ads, each sharing its title with one neighbour and its id with the other, are one ad after few rounds."""
    rounds = []
    whole = components.contract
    monkeypatch.setattr(components, "contract", lambda *a: rounds.append(1) or whole(*a))
    names = list(range(10_000))
    random.Random(9).shuffle(names)
    row = lambda k, title: (f"id{names[k]:05d}", title, "c", "", "", None, "x" * (k % 7 + 1), "s", "", [f"w{k % 3}"])
    rows = [row(k // 2, f"title {(k + 1) // 2}") for k in range(10_000)]
    found = postings.deduplicated(spark.createDataFrame(rows, POSTING).repartition(4)).collect()
    assert len(found) == 1 and found[0].id == min(r[0] for r in rows)
    assert found[0].searched_for == ["w0", "w1", "w2"] and len(found[0].text) == 7
    assert len(rounds) < 12


def test_stars_need_no_round(spark, monkeypatch):
    rounds = []
    whole = components.contract
    monkeypatch.setattr(components, "contract", lambda *a: rounds.append(1) or whole(*a))
    stars = spark.createDataFrame([(0, i) for i in range(1, 9)] + [(20, 21), (20, 21)], "a long, b long")
    assert {tuple(r) for r in components.connected_components(stars, "a", "b").collect()} == {(i, 0) for i in range(9)} | {(20, 20), (21, 20)}
    assert not rounds
