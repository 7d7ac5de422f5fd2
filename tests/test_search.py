"""The search rows and what each search has to find."""

import pytest

from siftwork.functions.text import alignment_distance, similar_word, stem, within_one_edit
from siftwork.plans import search as s


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        ("Ann", "Ann Smit", "ann@x.example", "Utrecht", "English", "Master", "REQ-1", "ann.pdf", "Senior engineer with Python and SQL. Driver's licence, rijbewijs B. Recruiter of the year.", ["python", "sql"], ["Dutch", "English"], 6.0, 10),
        ("Bob", "Bob Bos", "bob@x.example", "Rotterdam", "Dutch", "Bachelor", "REQ-2", "bob.pdf", "SAP consultant, Oracle, former intern.", ["sap"], ["Dutch"], 2.0, 80),
    ]
    names = "id, name, email, location, cv_language, education, tag, file_name, text, skills, languages, years, ai_score".split(", ")
    kinds = ["string"] * 9 + ["array<string>"] * 2 + ["double", "int"]
    return s.searchable(spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_terms(people):
    w, p, pre, sim, num = s.word, s.phrase, s.prefix, s.similar, s.number
    expected = [
        (w("python") & w("utrecht"), ["Ann"]), (w("PYTHON") & w("rotterdam"), []), (w("sa"), []), (p("driver's licence"), ["Ann"]), (p("rijbewijs b"), ["Ann"]), (w("python") | w("oracle"), ["Ann", "Bob"]),
        ((w("sap") | w("python")) & ~w("intern"), ["Ann"]), (~w("intern"), ["Ann"]), (w("sap") & w("oracle"), ["Bob"]), (pre("recruit"), ["Ann"]), (pre("consult"), ["Bob"]), (w("sap", "skill"), ["Bob"]), (w("utrecht", "loc"), ["Ann"]),
        (w("dutch", "lang"), ["Ann", "Bob"]), (w("master", "edu"), ["Ann"]), (p("ann smit", "name"), ["Ann"]), (w("REQ-2", "tag"), ["Bob"]), (num("years", ">=", 5), ["Ann"]), (num("years", "<", 5) & num("ai", ">", 50), ["Bob"]), (num("tool", ">", 0), []),
        (sim("pyhton"), ["Ann"]), (sim("oracel"), ["Bob"]), (sim("lava"), []), (sim("sqp"), []), (w("x", "c#"), []),
    ]
    for predicate, found in expected:
        assert ids(s.search(people, predicate)) == found, predicate


def test_words_and_summaries(people):
    words = s.Words.of({"all": ["consultant"], "any": ["sap", "python"], "none": [{"text": "python", "mode": "exact", "field": "skill"}]})
    assert ids(s.search(people, words)) == ["Bob"]
    assert words.summary() == "consultant and (sap or python), without python (skills)"
    assert s.entered(" a, B;b ,, c", ("C",)) == ["a", "B"]
    counts = {r.term: r.n for r in s.term_counts(people, words).collect()}
    assert counts == {"consultant": 1, "sap": 1, "python": 1}
    row = people.where("id = 'Ann'").select(s.highlighted(people["text"], s.Words((s.Term("python"), s.Term("sql", "exact")))).alias("h")).first()
    assert "<mark>Python</mark> and <mark>SQL</mark>" in row.h


def test_filters_and_order(people):
    assert ids(s.filtered(people, hide="human")) == ["Ann"]
    assert ids(s.filtered(people, location="UTR")) == ["Ann"]
    assert ids(s.filtered(people, language="Dutch", years=(None, 3))) == ["Bob"]
    members = people.sparkSession.createDataFrame([("REQ-9", "Bob")], "tag string, id string")
    assert ids(s.filtered(people, tag="REQ-9", tagged_members=members)) == ["Bob"]
    assert ids(s.filtered(people, letter="has")) == []
    assert [r.id for r in s.ordered(people, "skills").collect()] == ["Ann", "Bob"]
    assert s.why_empty(people, words=s.word("sap"), place=s.word("utrecht", "loc")).first().asDict() == {"n_rows": 2, "n_words": 1, "n_place": 1, "n_all": 0}


def test_words_alike(spark):
    pairs = [("pyhton", "python", 1), ("ca", "abc", 3), ("management", "managment", 1), ("kitten", "sitting", 3), ("", "ab", 2), ("abcd", "badc", 2)]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    assert [r.x for r in df.select(alignment_distance(df.a, df.b).alias("x")).collect()] == [d for *_, d in pairs]
    assert [r.x for r in df.select(within_one_edit(df.a, df.b).alias("x")).collect()] == [d <= 1 for *_, d in pairs]
    words = spark.createDataFrame([("docx",), ("managments",), ("nurse",), ("nurses",)], "w string")
    assert [r[0] for r in words.select(similar_word(words.w, "docker")).collect()] == [False] * 4
    assert words.select(similar_word(words.w, "managment")).collect()[1][0]
    assert [r[0] for r in words.select(stem(words.w)).collect()] == ["docx", "manag", "nurse", "nurs"]
    text = spark.createDataFrame([("python and sql",), ("python",)], "text string")
    assert s.suggestions(text, "pyton").first().word == "python"
    assert s.suggestions(text, "zzzz").count() == 0


def test_suggestions_drop_other_words_before_the_shuffle(spark):
    from siftwork.plans import search as s

    df = s.suggestions(spark.createDataFrame([("thing things other thgin tin",), ("thgin",)], "text string"), "thingg")
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "levenshtein" in plan and [r.word for r in df.collect()] == ["thing"]
