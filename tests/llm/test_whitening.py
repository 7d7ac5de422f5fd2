import math
import random

import numpy as np
import pytest

from siftwork.llm import whitening
from siftwork.llm.queries import op11_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long, component int"


def brute(rows, components=16):
    """The contract in plain Python and numpy, one vector at a time."""
    left = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in left})
    n, sums = len(fit), [sum(d) for d in zip(*fit)]
    centred = np.array([[float(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    matrix = centred.T @ centred / n
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in left:
        y = np.array([float(n * a - s) / n for a, s in zip(x, sums)])
        for k in range(min(components, len(sums))):
            out[i, k + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), y @ vectors[:, k] / math.sqrt(values[k]), values[k] / np.trace(matrix))
    return out


def as_float(v):
    return None if v is None else [None if c is None else float(np.float32(c)) for c in v]


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) * (1 + d) + rng.gauss(0, 1) for d in range(20)] for _ in range(300)]
    rows = list(enumerate(base)) + [(1000 + i, base[0]) for i in range(400)]
    rows += [(2000, None), (2001, base[1][:5] + [None] + base[1][6:]), (2002, base[1][:5] + [float("nan")] + base[1][6:]), (2003, base[1][:5] + [float("inf")] + base[1][6:]), (2004, []), (2005, base[2][:7])]
    return [(i, as_float(v)) for i, v in rows]


@pytest.mark.parametrize(("rows", "tile"), [(1024, 64), (7, 8), (64, 20)])
def test_against_brute_force(spark, vectors, rows, tile, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", rows)
    monkeypatch.setattr(whitening, "TILE", tile)
    table = spark.createDataFrame([(i, v, 0, "a", 1, 2) for i, v in vectors], SCHEMA).repartition(5)
    found = whitening.whitened(table).collect()
    expected = brute([r for r in vectors if r[0] != 2005])
    assert len(found) == len(expected) == 700 * 16
    sign = {}
    for r in found:
        n, deviation, value, explained = expected[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.explained - explained) <= 1e-9 * explained
        assert 0 <= r.identity_error < 1e-9
        if abs(value) > 0.1:
            assert sign.setdefault(r.component, r.whitened * value > 0) == (r.whitened * value > 0)
        assert abs(abs(r.whitened) - abs(value)) < 1e-8
    assert len({r.identity_error for r in found}) == 1


def test_no_variance_and_few_dimensions(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    found = whitening.whitened(table).collect()
    assert len(found) == 12
    assert {r.n for r in found} == {2}
    assert {round(abs(r.whitened), 9) for r in found if r.component == 1} == {1.0}
    assert all(r.whitened is None and r.explained == 0 for r in found if r.component > 1)
    one = whitening.whitened(table.where("vec_id = 1")).collect()
    assert [(r.deviation, r.whitened, r.identity_error) for r in one] == [(0, None, None)] * 3


def test_empty_and_large_entries(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whitened(empty).count() == 0
    far = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitening.whitened(far).where("component = 1").orderBy("vec_id").collect()][:2] == [None, None]


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    found = op11_embedding_whitening(spark, path).collect()
    expected = brute(rows)
    assert len(found) == len(expected)
    assert all(expected[r.vec_id, r.component][:2] == (r.n, r.deviation) and abs(abs(r.whitened) - abs(expected[r.vec_id, r.component][2])) < 1e-8 for r in found)
