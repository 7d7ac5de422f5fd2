import hashlib
from collections import Counter

import pytest

from siftwork.llm import suffix_dedup as sd


def brute(rows, length):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in bodies for k in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i if i is not None else -1, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "runs"), [(400, 20_000), (100, 20_000), (400, 2)])
def test_against_brute_force(odd_docs, odd_rows, length, runs, monkeypatch):
    monkeypatch.setattr(sd, "GROUP_RUNS", runs)
    found = sd.remove_repeats(odd_docs, length).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found) == brute(odd_rows, length)


@pytest.mark.parametrize(("words", "runs"), [(50, 1_000), (20, 1_000), (20, 1)])
def test_shared_words_against_brute_force(odd_docs, odd_rows, words, runs, monkeypatch):
    """Passages of so many words that another row holds; repeats inside a row, and repeated rows, do not count."""
    monkeypatch.setattr(sd, "GROUP_RUNS", runs)
    split = [(i, (t or "").split()) for i, t in odd_rows]
    holders = {}
    for i, ws in split:
        for k in range(len(ws) - words + 1):
            holders.setdefault(tuple(ws[k : k + words]), set()).add((i, tuple(ws)))
    wanted = []
    for i, ws in split:
        covered = {j for k in range(len(ws) - words + 1) if len(holders[tuple(ws[k : k + words])]) > 1 for j in range(k, k + words)}
        wanted.append((-1 if i is None else i, len(covered)))
    found = sd.remove_repeats(odd_docs, 400, words).select("doc_id", "n_shared_words").collect()
    assert sorted((-1 if r[0] is None else r[0], r[1]) for r in found) == sorted(wanted) and any(n for _, n in wanted)


def test_repeats_inside_a_row_beside_another_row(spark):
    """A passage twice in one row and, with another start, in a second row: every place counts."""
    a = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(a + ["x"] + a + ["y"])), (2, " ".join(["z"] + a[5:])), (3, " ".join(["q"] * 60))]
    found = {r.doc_id: r.n_shared_words for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400, 20).collect()}
    assert found == {1: 70, 2: 35, 3: 0}


def test_remaining_texts(spark, odd_docs, odd_rows):
    """The texts without their repeats: as the kept bytes say, columns as they were, split characters left out."""
    out = sd.without_repeats(odd_docs, 400)
    assert out.columns == odd_docs.columns and dict(out.dtypes) == dict(odd_docs.dtypes)
    kept = sorted((str(r.doc_id), r.kept.decode(errors="ignore")) for r in sd.remove_repeats(odd_docs, 400).collect())
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == kept
    assert all(r.n_chars == len(r.text) for r in out.where("text is not null").collect()) and out.where("text is null").count() == 2
    cut = sd.without_repeats(spark.createDataFrame([(1, "é" * 30), (2, "a" + "é" * 30)], "doc_id long, text string"), 50)
    assert {r.text for r in cut.collect()} == {"", "a"}


def test_stretches(monkeypatch, odd_docs, odd_rows):
    """A text longer than a stretch is sampled in pieces with the same result."""
    import numpy as np

    data = np.frombuffer(b"".join((t or "").encode() for _, t in odd_rows), np.uint8)
    prefix = sd.prefix_hashes(data)
    whole = sd.sampled(data, prefix, 400)
    monkeypatch.setattr(sd, "STRETCH", 1000)
    cut = sd.sampled(data, prefix, 400)
    assert set(whole[0].tolist()) == set(cut[0].tolist())
    assert cut[2].min() == 0 and (np.sort(cut[2])[1:] == np.sort(cut[3])[:-1] + 1).all()


def test_empty(no_docs):
    assert sd.remove_repeats(no_docs).count() == sd.without_repeats(no_docs).count() == 0


@pytest.mark.parametrize("side", [0, 1 << 20])
def test_shuffled_and_sent_sides(odd_docs, odd_rows, side, monkeypatch):
    """Places and spans that are shuffled give what those that are sent give."""
    monkeypatch.setattr(sd, "SIDE_BYTES", side)
    found = sd.remove_repeats(odd_docs, 400).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found) == brute(odd_rows, 400)
    assert sd.without_repeats(odd_docs, 400).count() == len(odd_rows)


def test_only_texts_with_repeats_are_shuffled(spark, monkeypatch):
    """Of 3000 texts without a repeat about 1 in 16 is shuffled beside the 300 with one, and no row is lost."""
    import random

    rng = random.Random(9)
    one = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [one(450) for _ in range(150)]
    rows = [(i, one(420)) for i in range(3000)] + [(3000 + i, one(30) + passages[i // 2] + one(30)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held, sizes = sd.held_by, []

    def seen(df, keys, key):
        out = held(df, keys, key)
        sizes.append((keys.count(), out.count(), out.where("maybe").count(), out.join(keys, key).where("not maybe").count()))
        return out

    monkeypatch.setattr(sd, "held_by", seen)
    monkeypatch.setattr(sd, "SIDE_BYTES", 0)
    found = {r.doc_id: r.n_removed for r in sd.remove_repeats(docs, 400).collect()}
    assert len(found) == 3300 and all((n >= 450) == (i >= 3000) and (i >= 3000 or not n) for i, n in found.items())
    assert len(sizes) == 2
    for keys, n, maybe, lost in sizes:
        assert n == 3300 and lost == 0 and keys <= maybe < keys + 500


def test_held_by_any_hash(spark):
    """Each of its keys is held, negative and extreme ones too; an empty side holds none."""
    from siftwork.llm.shared import held_by

    keys = spark.createDataFrame([(k,) for k in (0, 1, -1, 2**63 - 1, -(2**63), 32767, 32768, 8 * 32768 + 5)], "k long")
    assert held_by(keys, keys, "k").where("maybe").count() == 8
    assert held_by(keys, keys.where("false"), "k").where("maybe").count() == 0
    many = spark.range(1000).selectExpr("xxhash64(id) as k")
    assert held_by(many, keys, "k").where("maybe").count() < 30
    assert held_by(many, many, "k").where("maybe").count() == 1000
