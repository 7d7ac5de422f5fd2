import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from siftwork.llm import spelling
from siftwork.llm.queries import op13_spelling_variants, oracle_sql

SCHEMA = "doc_id long, text string, word string, n string, key string"


def distance_one(a, b):
    """By trying every edit."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=6, times=5, factor=5, spoil=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= times}
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if distance_one(a, b):
            near[a].append(b)
            near[b].append(a)
    best = {w: min(others, key=lambda o: (-n[o], o)) for w, others in near.items() if others}
    form = {w: o for w, o in best.items() if n[o] >= factor * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(5, 9))) for _ in range(80)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "straße", "façade", "façades", "x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 150]
    base += [f"{'common' * 3}{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"] + [f"{a}{b}{'common' * 3}" for a in "abcdefgh" for b in "stuvwxyz"]
    out = []
    for i in range(400):
        words = [base[int(len(base) * rng.random() ** 3)] for _ in range(40)]
        words += rng.sample(base, 30)
        k = rng.randrange(len(words))
        words[k] = words[k][1:]
        out.append((i, rng.choice([" ", "\n", "-", "7"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return out + [(None, out[0][1]), (None, None), (1, None), (2, ""), (3, "123 -- 99"), (7, out[7][1]), (7, out[7][1])]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA).repartition(4)


def result(frame):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()), key=str)


@pytest.mark.parametrize(("most", "held"), [(5000, 200_000), (3, 10)])
def test_against_all_pairs(spark, rows, most, held, monkeypatch):
    monkeypatch.setattr(spelling, "WORDS", most)
    monkeypatch.setattr(spelling, "HELD", held)
    found = result(spelling.variants(docs(spark, rows)))
    assert found == brute(rows)
    assert sum(w[2] != w[0] for w in found) > 20


def test_active_sets_alone():
    rng = random.Random(1)
    for size in (0, 1, 2, 30, 200):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(size)})
        found = sorted(tuple(sorted(p)) for p in spelling.near_in_trie(words))
        assert found == sorted((a, b) for a, b in itertools.combinations(words, 2) if distance_one(a, b))


def test_colliding_keys_are_kept_apart():
    rows = [("abcdef", 3, 0), ("abcdeg", 3, 0), ("xbcdef", 3, 0), ("xbcdeg", 0, 3), ("ybcdeg", 0, 3)]
    assert set(spelling._partition_pairs(rows)) == {("abcdef", "abcdeg"), ("xbcdeg", "ybcdeg")}


def test_chain_of_forms(spark):
    chain = [("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 625), ("aabbbb", 3125)]
    rows = [(1, " ".join([w] * n)) for w, n in chain]
    assert result(spelling.variants(docs(spark, rows), spoil=0)) == brute(rows, spoil=10**12)
    assert {r[2] for r in result(spelling.variants(docs(spark, rows), spoil=0))} == {"aabbbb"}


def test_empty(spark):
    assert result(spelling.variants(docs(spark, []).limit(0))) == []
    assert result(spelling.variants(docs(spark, [(1, None), (2, "a b c")]))) == []


def test_sql_on_the_whole_table(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    expected = con.execute(oracle_sql()["op13_spelling_variants"]).fetchall()
    assert result(op13_spelling_variants(spark, path)) == sorted(expected, key=str)
