"""The pipeline on a small table against the stages done by hand."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from siftwork.llm import quality
from siftwork.llm.shared import materialize

from .test_near_dedup import brute, shingles
from .test_packing import tokenizer
from .test_pii import PATTERNS, valid
from .test_quality import brute as judged

ITEM = "A train leaves the old station at noon and arrives at the coast before anyone wakes up in the small blue house."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    good = lambda k, n=12: " ".join(f"Sentence {k}x{i} tells of thing{k * 31 + i} and place{k * 17 + i} quite plainly." for i in range(n))
    rows = [(1, good(1)), (2, good(1)), (3, good(1) + " Tail."), (4, good(2)), (5, good(3) + " " + ITEM), (6, good(4) + " Write to ann@mail.example or +1 (017) 555-7713."), (7, "too short"), (8, "a*** b### " * 40), (9, None), (10, good(5, 120)), (10, good(5, 120)), (None, good(6))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), rows


def test_stages(spark, folder):
    where, rows = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, where), name)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns, name
    ids = lambda name: sorted((r.doc_id for r in kept[name]), key=lambda i: (i is None, i))
    assert ids("quality") == [1, 2, 3, 4, 5, 6, 10, 10, None] == [i for i, t in rows if judged(t)[-1]]
    sound = [(r.doc_id, r.text) for r in kept["quality"]]
    assert ids("near_dedup") == [*sorted({c for _, _, c in brute([x for x in sound if x[0] is not None], 5, 80)}), None]
    item = shingles(re.sub("[.]", "", ITEM.lower()), 5)
    dirty = {r.doc_id for r in kept["near_dedup"] if len(item & shingles(re.sub("[.]", "", r.text.lower()), 5)) >= 0.8 * len(item)}
    assert dirty == {5} and ids("decontamination") == [i for i in ids("near_dedup") if i not in dirty]
    texts = {r.doc_id: r.text for r in kept["pii"]}
    assert texts[6].endswith("Write to [EMAIL] or [PHONE].") and texts[4] == dict(rows)[4]
    spans = sorted((m.start(), m.end(), kind) for kind, p in PATTERNS for m in re.finditer(p, dict(rows)[6]) if valid(kind, m.group()))
    plain = dict(rows)[6]
    for a, b, kind in reversed(spans):
        plain = f"{plain[:a]}[{kind.upper()}]{plain[b:]}"
    assert texts[6] == plain
    pieces = []
    for r in kept["pii"]:
        t = np.array([*tokenizer().encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(t) % 1024 or 1024, len(t), 1024), len(t)]
        pieces += [(r.doc_id or -1, k, a, b - a, zlib.crc32(t[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(pieces) == sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in kept["packing"])
    full = {}
    for r in kept["packing"]:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in full.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
    assert sorted(map(tuple, corpus_pipeline.run(spark, where).select("doc_id", "piece", "start", "length", "ids_crc32").na.fill(-1).collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "start", "length", "ids_crc32").na.fill(-1).collect()))


def test_clashing_columns(spark, folder, odd_docs):
    """Stages keep columns that bear names they might use themselves."""
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder[0]), name)
        assert docs.columns == odd_docs.columns and {(r.spans, r._row_key, r.component_id) for r in docs.collect()} == {("b", "f", "d")}, name
    assert corpus_pipeline.packing(spark, docs, folder[0]).count() >= docs.count() > 0


def test_empty_table(spark, folder, tmp_path):
    where, _ = folder
    spark.read.parquet(f"{where}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{where}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert quality.keep_good(spark.read.parquet(f"{where}/documents.parquet")).count() == 9
