"""Keyed tables, lists, postings' sources, reports and caches on small tables."""

import itertools
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftwork.operators import facets, linking, postings, reports, scoring, stored, tables
from siftwork.sources import addresses, documents
from siftwork.sources import postings as scans
from siftwork.streaming import limits

DAY = datetime(2026, 1, 5)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_keyed_tables(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "id string, score_version int")
    assert rows_of(tables.outdated(docs, 2).select("id")) == [("a",), ("c",)]
    assert tables.truncate(docs).count() == 0 and tables.truncate(docs).columns == docs.columns
    targets = spark.createDataFrame([("t1", "old"), ("t2", "x")], "tag string, text string")
    texts = spark.createDataFrame([("t1", "  "), ("t3", "new")], "tag string, text string")
    assert rows_of(tables.target_texts(targets, texts)) == [("t2", "x"), ("t3", "new")]
    sources = spark.createDataFrame([("u", "page", "one")], "url string, type string, label string")
    new = spark.createDataFrame([("u", "page", "again"), ("u", "tab", "two"), ("u", "tab", "two")], "url string, type string, label string")
    assert rows_of(tables.add_sources(sources, new)) == [("u", "page", "one"), ("u", "tab", "two")]


def test_settings(spark, tmp_path):
    none = tables.settings(spark, f"{tmp_path}/a")
    assert tables.setting(none, "theme", "string", "light") == "light"
    tables.store_settings(none, {"theme": "dark", "words": ["a", "b"]}, f"{tmp_path}/a")
    first = tables.settings(spark, f"{tmp_path}/a")
    tables.store_settings(first, {"theme": "blue"}, f"{tmp_path}/b")
    again = tables.settings(spark, f"{tmp_path}/b")
    assert tables.setting(again, "theme", "string") == "blue" and tables.setting(again, "words", "array<string>") == ["a", "b"]


def test_holders_and_targets(spark):
    docs = spark.createDataFrame([("c1", " Ann@X.example ", "Ann", "t1"), ("c2", "", "José Núñez", ""), ("l1", "", "", "b – Shop"), ("l2", None, None, "t9")], "id string, email string, name string, tag string")
    links = spark.createDataFrame([("l1", "c2")], "letter_id string, cv_id string")
    assert {r.id: r.holder for r in linking.holders(docs, links).collect()} == {"c1": "ann@x.example", "c2": "jose nunez", "l1": "jose nunez", "l2": ""}
    targets = spark.createDataFrame([("t1", "Nurse", "care"), ("Äpfel", "", ""), ("Zoo", None, None)], "tag string, title string, text string")
    assert {r.id: r.target_text for r in linking.with_target_text(docs, targets).collect()} == {"c1": "care", "c2": "", "l1": "", "l2": ""}
    listed = linking.target_list(targets, docs).collect()
    assert [r.tag for r in listed] == ["Äpfel", "b – Shop", "t1", "t9", "Zoo"] and [r.title for r in listed] == ["Äpfel", "b", "Nurse", "t9", "Zoo"]


def test_near_copies_and_members(spark):
    base = "we plan the complex migrations of large databases and report every quarter about progress of remote teams"
    rows = [(1, base), (2, base.upper() + "!"), (3, base + " indeed"), (4, "another text about nothing that looks like those"), (5, ""), (6, None)]
    found = linking.near_copies(spark.createDataFrame(rows, "id long, text string")).collect()
    assert {(r.a, r.b, r.how) for r in found} == {(1, 2, "copy"), (1, 3, "near")}


def test_scores_of_letters(spark):
    shape = "struct<score:int,level:string,reasons:array<string>,wording:double>"
    df = spark.createDataFrame([((50, "medium", ["x"], 3.0), (20, "low", [], 0.4)), ((50, "medium", ["x"], 1.0), (60, "high", [], 0.4))], f"own {shape}, cv {shape}")
    out = df.select(scoring.with_polish_gap(F.col("own"), F.col("own.wording"), F.col("cv.wording")).alias("p"), scoring.worst(F.col("cv"), F.col("own")).alias("w")).collect()
    assert [r.p.score for r in out] == [60, 50] and len(out[0].p.reasons) == 2
    assert [r.w.score for r in out] == [50, 60]
    runs = spark.createDataFrame([("I am very  fast, kind and",), ("a, b and c",), (None,)], "x string")
    assert [r[0] for r in runs.select(scoring.short_list("x")).collect()][:2] == ["am very fast, kind and", "a, b and c"]


def test_sources_and_lists(spark):
    sources = spark.createDataFrame([("u1", "page", "x"), ("u2", "tab", "Site/jobs"), ("u3", "page", "z")], "url string, type string, label string")
    ads = spark.createDataFrame([("1", "x", "u1", True, False), ("2", "Site", "other", False, None), ("3", "x", "u1", True, True)], "id string, source string, source_url string, is_new boolean, hidden boolean")
    assert rows_of(postings.of_sources(sources, ads)) == [("u1", 1, 1), ("u2", 1, 0), ("u3", 0, 0)]
    runs = spark.createDataFrame([("a", datetime(2026, 1, 3)), ("b", datetime(2026, 1, 5)), ("c", None)], "url string, last_run timestamp")
    assert rows_of(postings.stale(runs, "2026-01-05 12:00:00").select("url")) == [("a",), ("c",)]
    lists = spark.createDataFrame([("t1", ["a", "b"]), ("t1", ["b", "c"]), ("t2", ["a"])], "vacancy string, members array<string>")
    placed = spark.createDataFrame([("t1", "j1"), ("t2", "")], "tag string, job_id string")
    assert rows_of(facets.members_by_posting(placed, lists)) == [("j1", 3)]


def test_reports(spark, tmp_path):
    errors = spark.createDataFrame([("s", DAY, "load", "x 1", "", False, "sig"), ("s", datetime(2026, 1, 6), "load", "x 1", "", False, "sig"), ("s", DAY, "load", "x 1", "", True, "sig")], "session string, at timestamp, step string, message string, stack string, manual boolean, signature string")
    assert sorted((r.manual, r.action) for r in reports.issues(errors).collect()) == [(False, "comment"), (False, "open"), (True, "open")]
    docs = spark.createDataFrame([("a", "Ann", ["x", "y"], "")], "id string, name string, skills array<string>, email string")
    assert rows_of(reports.details(docs, [("Name", "name"), ("Skills", "skills"), ("Mail", "email")])) == [("a", "Name", "Ann"), ("a", "Skills", "x, y")]
    reports.write_csv(docs, f"{tmp_path}/csv")
    body = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert body.startswith(b"\xef\xbb\xbf") and body.count(b"\r\n") == 2 and b'"Ann"' in body


def test_caches_and_sessions(spark):
    answers = spark.createDataFrame([("h", datetime(2026, 1, 1, 10), "A", 200), ("h", datetime(2026, 1, 1, 10, 30), "B", 200), ("g", datetime(2026, 1, 1, 10), "", 404), ("f", datetime(2026, 1, 1, 10), "", 503)], "host string, ts timestamp, body string, status int")
    requests = spark.createDataFrame([(1, "h", datetime(2026, 1, 1, 10, 5)), (2, "h", datetime(2026, 1, 1, 10, 40)), (3, "h", datetime(2026, 1, 1, 12)), (4, "g", datetime(2026, 1, 1, 10, 1)), (5, "f", datetime(2026, 1, 1, 10, 1))], "n int, host string, ts timestamp")
    assert {r.n: r.body for r in limits.cached(answers, requests).collect()} == {1: "A", 2: "B", 3: None, 4: "", 5: "User-agent: *\nDisallow: /"}
    assert limits.first_of_session(requests, ["host"]).count() == 3
    seen = spark.createDataFrame([(1, DAY), (2, datetime(2026, 1, 9))], "n int, first_seen timestamp")
    assert {r.n: r.is_new for r in limits.new_since(seen, "2026-01-06").collect()} == {1: False, 2: True}


def test_captures_and_cards(spark):
    html = '<a href="/x/cv.pdf">file</a><a href="/about">about</a><a href="/y">My <b>resume</b></a>'
    pages = spark.createDataFrame([(1, "https://a.example/p", html)], "page_id long, url string, html string")
    assert [(r.href, r.label) for r in documents.captured_files(pages).collect()] == [("/x/cv.pdf", "file"), ("/y", "My resume")]
    long = "readable text " * 10
    captures = spark.createDataFrame([("k", "u", long, [("a.pdf", long), ("b.pdf", "")]), ("m", "u", long, None), ("n", "u", "", [])], "id string, url string, text string, files array<struct<name:string,text:string>>")
    found = {r.id: (r.file_name, r.error is None) for r in documents.captured_rows(captures).collect()}
    assert found == {"k-0": ("a.pdf", True), "k-1": ("b.pdf", False), "m-0": ("page", True), "n-0": ("page", False)}
    cards = '<li class="job-card"><a href="/jobs/1">Nurse</a> Gent</li><li class="job-card"><a href="/jobs/2">Cook</a></li>'
    got = scans.cards(spark.createDataFrame([("https://a.example/list", cards), ("https://a.example/plain", '<a href="/z">Z</a>')], "url string, html string")).collect()
    assert {(r.title, r.url) for r in got} == {("Nurse", "https://a.example/jobs/1"), ("Cook", "https://a.example/jobs/2"), ("Z", "https://a.example/z")}
    shape = "url string, ld array<string>, cards array<struct<title:string,company:string,location:string,url:string,context:string>>, detail struct<title:string,text:string>"
    tabs = spark.createDataFrame([("t1", [], [("Nurse", "C", "L", "u1", "short"), ("Cook", "C", "L", "u2", "short")], ("Nurse in Gent", "whole text")), ("t2", [], [], ("Alone", "its text"))], shape)
    rows = {(r.title, r.text) for r in scans.collected_postings(tabs).collect()}
    assert rows == {("Nurse", "whole text"), ("Cook", "short"), ("Alone", "its text")}


def test_small_rules(spark):
    df = spark.createDataFrame([("text/html; charset=utf-8", "an Office manager wanted"), ("image/png", "office managers"), (None, "")], "kind string, text string")
    assert [r[0] for r in df.select(addresses.readable_type(F.col("kind"))).collect()] == [True, False, False]
    assert [r[0] for r in df.select(linking.named_in(F.col("text"), "office manager")).collect()] == [True, False, False]


def test_shared_folder(spark):
    assert stored.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df = spark.range(3).withColumn("x", F.lit("a"))
    assert rows_of(stored.stored(df, "t")) == [(0, "a"), (1, "a"), (2, "a")]
    assert stored.drop_stored(spark) > 0 and stored.drop_stored(spark) == 0
    folder = stored.shared_folder(spark).removeprefix("file:")
    assert not any(f.startswith("t-") for f in os.listdir(f"{folder}/siftwork"))


def test_hashes_fold_utf16_units(spark):
    """Characters beyond the basic plane count as their two units."""
    from siftwork.functions.text import hash_id, text_hash

    def fold(text, seed):
        units = memoryview(text.encode("utf-16-le")).cast("H")
        a, b = 0x811C9DC5, seed
        for u in units:
            a, b = ((a ^ u) * 16777619) & 0xFFFFFFFF, (b * 31 + u) & 0xFFFFFFFF
        return a, b

    def base36(n):
        return (base36(n // 36) if n >= 36 else "") + "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36]

    texts = ["", "abc", "a😀b", "𝒳𝒴", "é漢"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r.h, r.i) for r in df.select(text_hash("t").alias("h"), hash_id(F.col("t")).alias("i")).collect()]
    alnum = lambda t: "".join(c for c in t.lower() if c.isalnum())
    assert got == [("%x%x" % fold(alnum(t), 0), "j" + "".join(map(base36, fold(t, 7)))) for t in texts]


@pytest.mark.parametrize("name", ["generated_scores", "tool_scores", "parsed_profiles", "rate_limits", "hash_ids", "deduplicated_postings", "page_links", "highlights", "html_text", "pages_as_postings", "near_copies", "near_copies_all", "merged_postings", "copied_runs", "copied_phrases"])
def test_sql_agrees(spark, name):
    import duckdb

    from siftwork.plans.queries import ORACLES, QUERIES

    folder, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "events", "benchmark"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    mine = sorted(str([str(r[c]) for c in cols]) for r in df.collect())
    theirs = db.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    assert mine and mine == sorted(str([str(v) for v in row]) for row in theirs)


def test_folds_equal_a_plain_loop():
    import random

    import numpy as np

    from siftwork.functions.text import folds

    rng = random.Random(1)
    for n, most in itertools.product((0, 1, 2, 9, 3000), (0, 1, 127, 255, 256, 65535)):
        units = [rng.randrange(most + 1) for _ in range(n)]
        a, b = 0x811C9DC5, 7
        for c in units:
            a, b = ((a ^ c) * 16777619) & 0xFFFFFFFF, (b * 31 + c) & 0xFFFFFFFF
        assert folds(np.array(units, np.uint32), 7) == (a, b)
