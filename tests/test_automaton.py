"""Phrases by the automaton against regular expressions, and targets against plain Python over a whole table."""

import random
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from siftwork.functions import dictionaries as d
from siftwork.functions import parse
from siftwork.functions.automaton import Phrases, flat, no_term_after, no_term_before
from siftwork.functions.text import TITLE_NOISE
from siftwork.operators import linking
from siftwork.plans.queries import QUERIES, SKILLS

SF = "/root/testdata/sf0.001"


def one_by_one(text, terms):
    """Each term by its own pattern, taken out before the next is tried, if it occurs in the text at all."""
    rest, found, plain = text, [], regex.sub(r"[ \t\n\x0b\f\r]+", " ", text.lower())
    for t in terms:
        if t.lower() in plain:
            pattern = r"(?iu)(?<![\p{L}\p{N}#+.])" + regex.sub(r"\s+", r"[ \\t\\n\\x0b\\f\\r]+", regex.escape(t, literal_spaces=True)) + r"(?![\p{L}\p{N}#+])"
            if regex.search(pattern, rest):
                found.append(t)
                rest = regex.sub(pattern, " ", rest)
    return found


def test_phrases_against_patterns():
    rng = random.Random(6)
    terms = ["a b", "b", "a", "b a b", "c++", "c", "a.b", ".b", "#a", "éa", "b c", "aa", "a a"]
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b", "c", "é", " ", "  ", "\n", ".", "+", "#", "1", "A", "B"]) for _ in range(rng.randrange(0, 30)))
        found = Phrases([t.lower() for t in terms], no_term_before, no_term_after)
        assert [terms[i] for i in found.taken(flat(text.lower()))] == one_by_one(text, terms)
        plain = flat(text.lower())
        assert found.whole(plain) == {i for i, t in enumerate(terms) if any(True for _ in found.spans(plain, i))}
    assert Phrases([]).taken("a b") == [] and Phrases(["", "a"]).whole("a") == {1}
    assert Phrases(["aa"]).inside("xaaa") == [0] and list(Phrases(["ab", "ab"]).whole("ab")) == [0, 1]


@pytest.mark.parametrize("known", [SKILLS, None])
def test_skills_of_a_whole_table(spark, known):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = None if known else ["Thing", "on the"]
    found = docs.select("text", parse.skills(F.col("text"), extra, known).alias("s")).collect()
    listed = list(dict.fromkeys([*(s.lower() for s in extra or ()), *(known or d.SKILLS)]))
    assert [r.s for r in found] == [one_by_one(r.text or "", listed) for r in found]
    assert sum(map(len, (r.s for r in found))) > 30


def title_words(title):
    plain = "".join(c for c in unicodedata.normalize("NFD", title.lower()) if not unicodedata.combining(c))
    return list(dict.fromkeys(w for w in regex.findall("[a-z0-9+#]+", plain) if len(w) > 1 and w not in TITLE_NOISE))


def alike(a, b):
    a, b = title_words(a), title_words(b)
    same = lambda x, y: x == y or (len(x) >= 5 and len(y) >= 5 and x[:5] == y[:5])
    return 2 * sum(any(same(x, y) for y in b) for x in a) / (len(a) + len(b)) if a and b else 0


def brute_match(docs, targets):
    """Every document against every target."""
    out = {}
    wants = {tag: one_by_one(f"{title}\n{text}", SKILLS) for tag, title, text in targets}
    wants = {tag: w for tag, w in wants.items() if len(w) >= 3}
    for id_, text in docs:
        head = (text or "")[:1500]
        claims = [regex.sub(r"\s+", " ", c).strip() for p in linking._CLAIMS for c in regex.findall(p, head)]
        claims = [c for c in claims if title_words(c) and not regex.match(r"(?i)(your|our|this|that|the|jullie|uw|deze)\b", c)]
        ranked = sorted((-alike(c, title), k, tag) for k, c in enumerate(claims) for tag, title, _ in targets if alike(c, title) >= 0.6)
        named = {tag for tag, title, _ in targets if len(title_words(title)) >= 2 and regex.search(r"(?iu)(?<!\p{L})" + regex.sub(r"\s+", r"\\s+", regex.escape(title.strip(), literal_spaces=True)) + r"(?!\p{L})", head)}
        have = set(one_by_one(text or "", SKILLS))
        fits = sorted((-len(have & set(w)) / len(w), -len(have & set(w)), tag) for tag, w in wants.items() if have & set(w))
        if ranked:
            out[id_] = (ranked[0][2], "applied")
        elif len(named) == 1:
            out[id_] = (min(named), "named")
        elif fits and -fits[0][1] >= 3 and -fits[0][0] >= 0.5 and (len(wants) == 1 or -fits[0][0] + (fits[1][0] if len(fits) > 1 else 0) >= 0.2):
            out[id_] = (fits[0][2], "fit")
    return out


@pytest.mark.parametrize("block", [20_000, 3])
def test_targets_of_a_whole_table(spark, block, monkeypatch):
    monkeypatch.setattr(linking, "TARGETS", block)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    targets = [(f"t{i}", " ".join(t.split(" ")[1:4]), t) for i, t in items]
    found = {r.id: (r.tag, r.how) for r in QUERIES["matched_targets"](spark, SF).collect()}
    assert found == brute_match(docs, targets)


@pytest.mark.parametrize("block", [20_000, 2])
def test_tiers_against_every_pair(spark, block, monkeypatch):
    """Documents that name targets, want their skills or say what they apply for; ties and close runners-up included."""
    monkeypatch.setattr(linking, "TARGETS", block)
    rng = random.Random(8)
    words = ["the", "and the", "thing", "er", "on the", "le", "die", "que"]
    targets = [(f"t{k}", f"{rng.choice(['Senior', 'Chief', 'Local'])} {rng.choice(['Baker', 'Driver', 'Painter'])} {k % 4}{k % 4}", " . ".join(rng.sample(words, rng.randrange(0, 7)))) for k in range(14)]
    rows = []
    for k in range(150):
        text = " . ".join(rng.sample(words, rng.randrange(0, 6)))
        if k % 3 == 0:
            text += f" I met a {rng.choice(targets)[1].upper()}, and\nwent"
        if k % 5 == 0:
            text += f" I apply for the position of {rng.choice(targets)[1]} at once"
        rows.append((k, text))
    docs = spark.createDataFrame(rows + [(999, None)], "id long, text string").withColumn("letter_text", F.lit(None).cast("string")).withColumn("skills", parse.skills(F.col("text"), known=SKILLS))
    found = linking.match_targets(docs, spark.createDataFrame(targets, "tag string, title string, text string"), known_skills=SKILLS)
    found = {r.id: (r.tag, r.how) for r in found.collect()}
    assert found == brute_match(rows, targets)
    assert {how for _, how in found.values()} == {"applied", "named", "fit"}
    none = linking.match_targets(docs, spark.createDataFrame([], "tag string, title string, text string"), known_skills=SKILLS)
    assert none.count() == 0


def test_likely_phrases_leave_no_taken_one_out():
    """What is taken equals taking by all phrases that occur, and a letter inside words is not looked for in the text."""
    from siftwork.functions.automaton import no_term_after, no_term_before

    terms = Phrases(["r", "c#", ".net", "asp", "machine learning", "sql"], no_term_before, no_term_after)
    assert terms.likely("a harder word") == set() and terms.inside("a harder word") == [0]
    for text in ("asp.net", "xmachine learning machine sql learning", "r c#, r", "sql.r"):
        slow = Phrases(terms.phrases, no_term_before, no_term_after)
        slow.likely = lambda t, s=slow: set(s.inside(t))
        assert terms.taken(text) == slow.taken(text)
