import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from siftwork.llm import queries, quality


def test_counts_and_edges(odd_docs, odd_rows, no_docs):
    found = quality.judge(odd_docs).collect()
    assert len(found) == len(odd_rows)
    assert all(not r.kept for r in found if r.base_failed)
    empty = [r for r in found if r.doc_id in (7, 8, 10)]
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (0, 0, 0, 0, 0, True) for r in empty)
    assert quality.judge(no_docs).count() == 0
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(r.kept for r in found)


def test_lines(spark):
    good = "This is a plain line of prose that says something, and it ends well."
    text = "\n".join([good, "Home | News | Sport | About | Contact", "We use cookies. Privacy policy", "aa*** bb### cc$$$ dd*** ee&&&", good.replace("plain", "longer"), good.replace("plain", "third")])
    row = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string"), cleaned=True).first()
    assert row.clean_text.split("\n") == [good, good.replace("plain", "longer"), good.replace("plain", "third")]
    assert quality.line_fails(good) == ""
    assert quality.line_fails("Skip to main content") == "boilerplate"
    assert quality.line_fails("SALE!! NOW!! BUY!! ALL!! OF!! IT!!") == "noise"


def test_repeats(spark):
    words = [f"w{i}" for i in range(30)]
    text = " ".join(words + words[:9])
    row = quality.judge(spark.createDataFrame([(1, text), (2, "a\na\nb")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert row[0].n_repeat_words == 18 and row[0].base_failed
    assert row[1].n_dup_lines == 1


def test_failing_lines_leave(spark, tmp_path):
    """The stage of the pipeline removes the failing lines, and op2 shows what it removed."""
    good = [" ".join(f"é{i}word{k}" for k in range(14)) + "." for i in range(4)]
    text = "\n".join([good[0], "Home | News | Sport | About | Contact", good[1], "", good[2], "Skip to main content", good[3]])
    left = "\n".join([good[0], good[1], "", good[2], good[3]])
    docs = spark.createDataFrame([(1, text, "en", len(text)), (2, left, "en", len(left)), (3, "Home | News | Sport | About\n" * 9, "en", 1), (4, None, "en", 0)], "doc_id long, text string, lang string, n_chars int")
    found = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert found.dtypes == docs.dtypes
    assert sorted(map(tuple, found.collect())) == [(1, left, "en", len(left)), (2, left, "en", len(left))]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    shown = {r.doc_id: r for r in queries.op2_quality_rules(spark, str(tmp_path)).collect()}
    assert shown[1].clean_sha256 == shown[2].clean_sha256 == hashlib.sha256(left.encode()).hexdigest()
    assert (shown[1].lost_lines, shown[1].clean_words, shown[2].lost_lines) == (2, len(left.split()), 0)


def brute(text):
    """The base counts and the verdict word by word, with regular expressions instead of arrays."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup, lost = set(), 0, 0
    for line in (text or "").split("\n"):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
        if n:
            dup += line in seen
            seen.add(line)
            lost += n if quality.line_fails(line) else 0
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated), failed, not failed and lost <= 0.3 * len(words)


def test_against_brute_force(spark, odd_rows):
    rng = random.Random(17)
    pieces = ["word", "a", "é漢", "x#y", "***", "|", "\u00a0", "\u2003", "\x0b", "\x0c", "\x1c", "\r", "Click here", "A. B. C."]
    texts = ["".join(rng.choice(pieces) + rng.choice((" ", " ", "\n", "\t", "  ")) for _ in range(rng.randint(0, 90))) for _ in range(200)]
    texts += ["one two three four five six seven eight nine. " * k for k in (1, 2, 3, 200)] + ["line of words\n" * 50, "x " * 300_000, " ".join(f"w{i % 7919}" for i in range(200_000))]
    texts += [t for _, t in odd_rows]
    rows = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute(texts[r.doc_id]), texts[r.doc_id][:200]


@pytest.mark.parametrize(("lost", "kept"), [(12, True), (13, False)])
def test_loss_at_the_limit(spark, lost, kept):
    """Losing just the allowed share of words keeps a text: 12 of 40, at most 30 percent."""
    text = " ".join(f"good{i}" for i in range(40 - lost)) + ".\n" + " ".join(f"Click here {i}" for i in range(4))[: 10**6]
    extra = lost - len(text.split("\n")[1].split())
    text += " more" * extra if extra >= 0 else ""
    row = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.lost_words, row.kept) == (40, lost, kept)


@pytest.mark.parametrize("line", ["Alle Rechte vorbehalten", "Politique de confidentialité", "Aceptar las cookies", "Lees meer"])
def test_stock_phrases_in_other_languages(line):
    assert quality.line_fails(line) == "boilerplate"


def test_long_lines_are_judged_whole():
    """A long menu or legal line fails; one phrase in a long line of prose does not make it boilerplate."""
    menu = "Privacy policy and terms of use for all the pages that you may visit. " * 40
    assert len(menu) > 2000 and quality.line_fails(menu) == "boilerplate"
    assert quality.line_fails("Nothing else is in this long line of prose. " * 20 + "Read more about it in the annex.") == ""
    assert quality.line_fails("Nothing else is in this line. " * 4 + "Read more about it.") == "boilerplate"
    assert quality.line_fails("A bread moreover is not a stock phrase, nor is it one in a line of plain words.") == ""
    assert quality.stock_phrases("x READ MORE y") == ("read more",)
