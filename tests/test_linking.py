import random
from datetime import datetime

from pyspark.sql import functions as F

from siftwork.operators import facets, linking, tables
from siftwork.operators.intervals import union_length


def test_letters(spark):
    at = lambda d: datetime(2026, 1, d)
    rows = [
        ("c1", "cv", "Ann@x.example", "Ann Smit", "a.pdf", "", "T1", at(1), None),
        ("c2", "cv", "", "José Núñez", "jose.pdf", "cap1", "T1", at(2), None),
        ("c4", "cv", "", "Jose Nunez", "x.pdf", "", "T2", at(3), None),
        ("c3", "cv", "", "Piet", "piet-pot-cv.pdf", "", "T1", at(4), None),
        ("c9", "cv", "ann@x.example", "", "", "", "T1", at(9), "unreadable"),
        ("l1", "letter", "ann@x.example", "", "", "", "T1", at(5), None),
        ("l2", "letter", "", "jose nunez", "", "", "T1", at(5), None),
        ("l3", "letter", "", "", "", "cap1", "T1", at(5), None),
        ("l4", "letter", "", "", "Piet_Pot_motivation.docx", "", "T1", at(5), None),
        ("l5", "letter", "", "Nobody", "", "", "T1", at(5), None),
    ]
    docs = spark.createDataFrame(rows, "id string, kind string, email string, name string, file_name string, capture_id string, tag string, added_at timestamp, error string")
    links = linking.link_letters(docs)
    assert {(r.letter_id, r.cv_id, r.how) for r in links.collect()} == {("l1", "c1", "email"), ("l2", "c2", "name"), ("l3", "c2", "capture"), ("l4", "c3", "file")}
    nested = {r.id: r for r in linking.with_letters(docs.withColumn("text", F.col("id")), links).collect()}
    assert set(nested) == {"c1", "c2", "c3", "c4", "c9", "l5"}
    assert nested["c2"].letter_text == "l2\n\nl3" and nested["l5"].letter_only
    gone = tables.delete_with_letters(docs, docs.where("id = 'c2'"), links)
    assert "l2" not in {r.id for r in gone.collect()}


def test_letters_against_every_pair(spark):
    """Many of one name, shared mail addresses, tags that are null, and ties of time."""
    rng = random.Random(12)
    pick = lambda xs: rng.choice(xs)
    rows = [(f"d{k:03d}", pick(["cv", "letter"]), pick(["", "a@x.example", "B@x.example ", "b@x.example"]), pick(["", "Ann Smit", "ann  smit", "Jo"]), pick(["", "piet-pot.pdf", "Piet_Pot_cv.docx", "ab.pdf"]), pick(["", "c1", "c2"]), pick(["T1", "T2", None]), datetime(2026, 1, pick([1, 2, 3])), None) for k in range(120)]
    docs = spark.createDataFrame(rows, "id string, kind string, email string, name string, file_name string, capture_id string, tag string, added_at timestamp, error string")
    stem = {"piet-pot.pdf": "piet pot", "Piet_Pot_cv.docx": "piet pot", "": "", "ab.pdf": ""}
    keys = lambda r: [r[2].strip().lower(), " ".join(r[3].lower().split()), r[5], stem[r[4]]]
    expected = set()
    for letter in (r for r in rows if r[1] == "letter"):
        hits = [(rule, not (letter[6] is not None and cv[6] == letter[6]), -cv[7].timestamp(), cv[0]) for cv in rows if cv[1] == "cv" for rule in range(4) if keys(letter)[rule] and keys(letter)[rule] == keys(cv)[rule]]
        if hits:
            best = min(hits)
            expected.add((letter[0], best[3], ["email", "name", "capture", "file"][best[0]]))
    assert {(r.letter_id, r.cv_id, r.how) for r in linking.link_letters(docs).collect()} == expected and len({h for _, _, h in expected}) == 4


def test_targets(spark):
    targets = spark.createDataFrame([("t1", "Sales Manager", "sell"), ("t2", "Verpleegkundige", "zorg"), ("t3", "Data Engineer", "python sql spark airflow kafka"), ("t4", "Office Manager", "excel planning administratie")], "tag string, title string, text string")
    rows = [
        ("applied", "", "Subject: application for Sales Manager\nDear all", []),
        ("named", "I saw the Office Manager in your list", "", []),
        ("fit", "text", "", ["python", "sql", "spark", "docker"]),
        ("none", "text", "", ["python"]),
        ("both", "Data Engineer or Office Manager", "", []),
    ]
    docs = spark.createDataFrame(rows, "id string, text string, letter_text string, skills array<string>")
    found = {r.id: (r.tag, r.how) for r in linking.match_targets(docs, targets).collect()}
    assert found == {"applied": ("t1", "applied"), "named": ("t4", "named"), "fit": ("t3", "fit")}
    tagged = docs.select("id", F.when(F.col("id") == "fit", "T9").alias("tag"), (F.col("id") == "named").alias("no_auto"))
    out = {r.id: r.tag for r in linking.resolved_tags(tagged, linking.match_targets(docs, targets)).collect()}
    assert out == {"applied": "t1", "named": "", "fit": "T9", "none": "", "both": ""}


def test_copies(spark):
    text = " ".join(f"phrase{i}" for i in range(30))
    rows = [("a", text, "p", "T1", "h1"), ("b", text + " more words here", "p", "T2", "h2"), ("c", text, "q", "T1", "h1"), ("d", "other words entirely stand here now", "q", "T3", "h4")]
    docs = spark.createDataFrame(rows, "id string, text string, holder string, tag string, hash string")
    pairs = linking.near_copies(docs)
    assert sorted((r.a, r.b, r.how) for r in pairs.collect()) == [("a", "b", "near"), ("a", "c", "copy")]
    assert {r.id: r.representative for r in linking.copies_of(docs).collect()}["c"] == "a"
    assert {r.id: r.duplicates for r in linking.exact_copies(docs).collect()} == {"a": 1, "b": 0, "c": 1, "d": 0}
    assert {r.id: r.same_holder for r in linking.same_holder(docs).collect()} == {"a": 1, "b": 1, "c": 1, "d": 1}
    reuse = {r.id: (r.same_letter_targets, r.similar_letters) for r in linking.letter_reuse(pairs, docs).collect()}
    assert reuse == {"a": (1, 1), "b": (1, 1), "c": (0, 2)}


def test_letter_reuse_against_all_pairs(spark):
    """Classes of copies, blank holders and equal hashes, against comparing every pair."""
    import random

    rng = random.Random(4)
    text = [f"w{i}" for i in range(60)]
    forms = [" ".join(text), " ".join(text[:50]), " ".join(text[5:] + ["tail"] * 4), " ".join(f"z{i}" for i in range(40))]
    rows = [(i, forms[rng.randrange(4)], rng.choice(["p", "q", "", None]), f"T{rng.randrange(3)}", f"h{rng.randrange(3)}") for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string, holder string, tag string, hash string")
    pairs = linking.near_copies(docs)
    linked = {(r.a, r.b) for r in pairs.where("how = 'near'").collect()}
    rep = {i: min(j for j, *r in rows if r[0] == t) for i, t, *_ in rows}
    wanted = {}
    for i, _, holder, tag, hash_ in rows:
        like = [r for r in rows if r[0] != i and (rep[r[0]] == rep[i] or (rep[i], rep[r[0]]) in linked or (rep[r[0]], rep[i]) in linked)]
        same = lambda r: bool(holder) and r[2] == holder  # noqa: B023, E731
        wanted[i] = (len({r[3] for r in like if same(r) and r[3] != tag and r[4] != hash_}), sum(not same(r) for r in like))
    assert linked and {r.id: (r.same_letter_targets, r.similar_letters) for r in linking.letter_reuse(pairs, docs).collect()} == wanted


def test_tables_and_facets(spark):
    docs = spark.createDataFrame([("a", "x", ["sql", "sap"], ["Dutch"], "English"), ("b", "y", ["sql"], [], "")], "id string, tag string, skills array<string>, languages array<string>, cv_language string")
    assert [r.language for r in facets.language_facet(docs).collect()] == ["Dutch", "English"]
    assert [(r.skill, r.n) for r in facets.top_skills(docs, ["sap"]).collect()] == [("sql", 2)]
    lists = spark.createDataFrame([("l", "x", ["z", "a"])], "id string, vacancy string, members array<string>")
    more = tables.extended(lists, spark.createDataFrame([("l", "b"), ("l", "a")], "list_id string, member string"))
    assert more.first().members == ["z", "a", "b"]
    assert tables.pruned(more, docs).first().members == ["a", "b"]
    assert {r.id: r.list_ids for r in tables.lists_of(docs, more).collect()} == {"a": ["l"], "b": ["l"]}
    new = tables.upsert(docs.select("id", "tag"), spark.createDataFrame([("b", "z"), ("c", "w")], "id string, tag string"))
    assert {(r.id, r.tag) for r in new.collect()} == {("a", "x"), ("b", "z"), ("c", "w")}
    assert tables.overridden(new, spark.createDataFrame([("a", "set")], "id string, tag string"), ["tag"]).where("id = 'a'").first().tag == "set"
    assert [r.id for r in tables.between(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, position int"), "c", "b").collect()] == ["b", "c"]
    spans = spark.createDataFrame([(1, 0, 10), (1, 5, 12), (1, 12, 13), (1, 20, 25), (2, 3, 3)], "k int, a int, b int")
    assert {(r.k, r.covered, r.n_islands) for r in union_length(spans, "k", "a", "b").collect()} == {(1, 18, 2), (2, 0, 1)}


def test_fingerprints_are_made_once(spark):
    """The hash of a text is costly, so its plan stands in no plan that counts or joins it."""
    docs = spark.createDataFrame([("a", "x"), ("b", "x")], "id string, text string").selectExpr("id", "md5(text) as hash")
    copies = linking.exact_copies(docs)
    assert "md5" not in copies._jdf.queryExecution().optimizedPlan().toString() and copies.count() == 2
