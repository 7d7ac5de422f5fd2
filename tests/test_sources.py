import io
import json
import zipfile

from pyspark.sql import functions as F

from siftwork.operators import postings, reports
from siftwork.sources import addresses, documents
from siftwork.sources import postings as found
from siftwork.streaming import limits


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_addresses(spark):
    urls = ["boards.greenhouse.io/acme/jobs/1", "https://jobs.lever.co/acme", "https://www.linkedin.com/jobs", "https://acme.recruitee.com", "https://x.jobs.personio.de/", "https://www.acme.example/jobs/", "nonsense", "https://apply.workable.com/acme/"]
    got = column(spark, urls, addresses.detect_source)
    assert [g.type for g in got] == ["greenhouse", "lever", "tab", "recruitee", "personio", "page", "page", "workable"]
    assert got[0].api == "https://boards-api.greenhouse.io/v1/boards/acme/jobs?content=true" and got[6].error
    assert column(spark, ["ftp://x.example", "https://nl.indeed.com/x", "http://10.0.0.1/", "http://localhost/", "https://x.example:8080/", "https://u:p@x.example/", "http://[::1]/", "https://x.example/a", None, "http://100.64.1.1"], addresses.check_url) == ["bad-url", "blocked-site", "private", "private", "bad-url", "bad-url", "private", None, "bad-url", "private"]
    assert column(spark, ["172.16.0.1", "172.32.0.1", "::ffff:10.1.1.1", "fd00::1", "8.8.8.8", "2001:db8::1", "224.0.0.1"], addresses.is_private) == [True, False, True, True, False, False, True]
    assert column(spark, ["https://x.example/?q={q}&l={city}"], lambda c: addresses.fill(c, "data engineer", "Den Haag")) == ["https://x.example/?q=data%20engineer&l=Den%20Haag"]
    sources = spark.createDataFrame([("https://x.example/?q={q}",), ("https://y.example/",)], "url string")
    assert addresses.search_urls(sources, "a, b,, c").count() == 4
    assert addresses.presets(spark).count() == 10


def test_robots(spark):
    body = "# c\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\n\nUser-agent: mybot\nDisallow: /jobs\nAllow: /jobs\nDisallow:\n"
    robots = spark.createDataFrame([("h", body)], "host string, body string")
    paths = ["/private/x", "/private/open/1", "/a.pdf", "/a.pdf?x", "/jobs/1", "/"]
    ask = spark.createDataFrame([("h", p) for p in [*paths]] + [("none", "/x")], "host string, path string")
    allowed = lambda agent: {(r.host, r.path): r.allowed for r in addresses.robots_allow(ask, robots, agent).collect()}
    anyone = allowed("somebody")
    assert [anyone["h", p] for p in paths] == [False, True, False, True, True, True] and anyone["none", "/x"]
    assert all(allowed("mybot/1.0").values())


LD = {"@graph": [{"@type": ["JobPosting"], "title": "Nurse &amp; carer", "hiringOrganization": {"name": "Care"}, "jobLocation": [{"address": {"addressLocality": "Amsterdam"}}, "Haarlem"], "url": "/jobs/12", "datePosted": "2026-10-01", "description": "&lt;p&gt;Care&lt;/p&gt;"}]}


def test_pages(spark):
    listing = '<a href="/jobs/1001-nurse#x">a</a><a href="/jobs/1001-nurse">b</a><a href="https://other.example/jobs/3333-x">c</a><a href="/jobs/2002-cook">d</a><a href="/jobs/3003-driver">e</a><a href="/jobs/sales-team">f</a><a href="/jobs/apply-99999">g</a>'
    rows = [
        ("https://a.example/x", f'<script type="application/ld+json">{json.dumps(LD)}</script>'),
        ("https://b.example/jobs/", listing),
        ("https://c.example/p", "<title>T</title><header>no</header><h1>Sales Manager</h1><p>What we offer: all</p>"),
        ("https://d.example/p", '<script type="application/ld+json">{broken</script>'),
    ]
    pages = spark.createDataFrame(rows, "url string, html string")
    jobs, links = found.read_pages(pages)
    by = {r.source_url: r for r in jobs.collect()}
    assert set(by) == {"https://a.example/x", "https://c.example/p"}
    first = postings.normalised(jobs.where("source_url like '%a.example%'"), "a.example").first()
    assert (first.title, first.company, first.location, first.url, first.posted, first.text) == ("Nurse & carer", "Care", "Amsterdam / Haarlem", "https://a.example/jobs/12", "2026-10-01", "Care")
    assert by["https://c.example/p"].title == "Sales Manager"
    assert sorted(r.link for r in links.collect()) == [f"https://b.example/jobs/{x}" for x in ("1001-nurse", "2002-cook", "3003-driver")]


def test_feeds_and_answers(spark):
    rss = "<?xml version='1.0'?><rss><item><title><![CDATA[Cook & baker]]></title><link>https://x.example/1</link><description>&lt;b&gt;Bake&lt;/b&gt;</description><pubDate>Mon, 05 Oct 2026 08:00:00 GMT</pubDate></item></rss>"
    feeds = spark.createDataFrame([("s", "acme.jobs.personio.de", rss)], "source_url string, host string, body string")
    assert feeds.select(found.is_feed(F.col("body"))).first()[0]
    item = postings.normalised(found.feed_postings(feeds)).first()
    assert (item.title, item.posted, item.text) == ("Cook & baker", "2026-10-05", "Bake")
    xml = "<workzag-jobs><position><id>123</id><name>Dev</name><office>Bonn</office><jobDescription><name>Tasks</name><value><![CDATA[<p>Code</p>]]></value></jobDescription></position></workzag-jobs>"
    p = found.personio_postings(feeds.withColumn("body", F.lit(xml))).first()
    assert (p.title, p.company, p.url, p.text) == ("Dev", "acme", "https://acme.jobs.personio.de/job/123", "Tasks\nCode")
    bodies = {
        "greenhouse": {"jobs": [{"title": "A", "location": {"name": "X"}, "absolute_url": "u", "updated_at": "2026-01-02T00:00:00Z", "content": "&lt;p&gt;hi&lt;/p&gt;"}]},
        "lever": [{"text": "A", "categories": {"allLocations": ["X"]}, "hostedUrl": "u", "createdAt": 1790000000000, "descriptionPlain": "hi", "lists": [{"text": "L", "content": "<li>i</li>"}]}],
        "smartrecruiters": {"content": [{"id": "7", "name": "A", "company": {"name": "C", "identifier": "cid"}, "location": {"city": "X", "country": "nl"}, "releasedDate": "2026-01-02"}]},
        "workable": {"name": "C", "jobs": [{"title": "A", "city": "X", "country": "NL", "shortlink": "u", "created_at": "2026-01-02", "description": "hi"}]},
        "recruitee": {"offers": [{"title": "A", "city": "X", "careers_url": "u", "created_at": "2026-01-02", "description": "hi", "requirements": "yo"}]},
        "adzuna": {"results": [{"title": "<b>A</b>", "company": {"display_name": "C"}, "location": {"display_name": "X"}, "redirect_url": "u", "created": "2026-01-02", "description": "hi"}]},
    }
    for kind, body in bodies.items():
        answers = spark.createDataFrame([("s", "host/co", json.dumps(body))], "source_url string, label string, body string")
        row = found.api_postings(answers, kind).first()
        assert row.title == "A" and row.location.startswith("X"), kind
    assert found.api_postings(answers, "unknown").count() == 0


def test_postings(spark):
    shape = "id string, title string, company string, location string, url string, posted string, text string, source string, source_url string, searched_for array<string>"
    rows = [("1", "Cook", "Inn", "", "", "", "short", "s", "u", ["a"]), ("2", "COOK", "inn", "", "", "", "much longer", "s", "u", ["b"]), ("2", "Baker", "x", "", "", "", "x", "s", "u", []), ("3", "", "x", "", "", "", "x", "s", "u", []), ("4", "Driver", "x", "Ede", "", "", "drive", "s", "u", ["trucks"])]
    df = spark.createDataFrame(rows, shape)
    out = {r.id: r for r in postings.deduplicated(df).collect()}
    assert set(out) == {"1", "4"} and out["1"].text == "much longer" and out["1"].searched_for == ["a", "b"]
    seen = postings.merged(postings.merged(df.where("id = '4'").withColumns({"first_seen": F.lit("2026-01-01").cast("timestamp"), "last_seen": F.lit("2026-01-01").cast("timestamp"), "hidden": F.lit(True)}), df.where("id = '1'"), "2026-01-02").drop("is_new"), df.where("id in ('1', '4')"), "2026-01-03")
    by = {r.id: r for r in seen.collect()}
    assert str(by["4"].first_seen.date()) == "2026-01-01" and by["4"].hidden and not by["1"].is_new and str(by["1"].last_seen.date()) == "2026-01-03"
    view = df.withColumn("hidden", F.lit(False))
    assert [r.id for r in postings.filtered(view, ["truck", "trucks"]).collect()] == ["4"]
    assert [r.id for r in postings.filtered(view, ["cooks"]).collect()] == ["1", "2"]
    assert [r.id for r in postings.filtered(view, city="ede").collect()] == ["4"]
    none = spark.createDataFrame([], "tag string, title string, company string, location string, url string, job_id string, text string")
    made = postings.to_targets(none, df.where("id in ('1', '4')"))
    assert {r.tag for r in made.collect()} == {"Cook – Inn", "Driver – x"}


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("plain words " * 10)
    (tmp_path / "b.html").write_text("<p>" + "web words " * 10 + "</p>")
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "d.txt").write_text("short")
    body = '<w:document xmlns:w="ns"><w:body>' + "".join(f"<w:p><w:r><w:t>paragraph {i} of text</w:t></w:r></w:p>" for i in range(5)) + "</w:body></w:document>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "e.docx").write_bytes(data.getvalue())
    rows = {r.file_name: r for r in documents.read_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.txt", "b.html", "d.txt", "e.docx"}
    assert rows["d.txt"].error and not rows["a.txt"].error and rows["e.docx"].text.startswith("paragraph 0 of text\n\n")
    items = spark.createDataFrame([(1, 1, 0, 10.0, 10.0, 9.0, 100.0, 100.0, "one"), (1, 1, 1, 20.0, 10.0, 9.0, 100.0, 100.0, "two"), (1, 1, 2, 10.0, 30.0, 1.0, 100.0, 100.0, "hid den")], "doc_id int, page int, at int, x double, y double, size double, width double, height double, text string")
    r = documents.page_lines(items).first()
    assert (r.text, r.hidden_words) == ("one two\nhid den", 2)


def test_exports(spark):
    docs = spark.createDataFrame([("1", 'A "q"', ["x", "y"], 3.0)], "id string, name string, skills array<string>, years double")
    head, line = (r.line for r in reports.csv_lines(docs).orderBy("at").collect())
    assert head.startswith('﻿"Name","E-mail"') and line.startswith('"A ""q""","",') and '"x, y"' in line
    errors = spark.createDataFrame([("s", i, "step", f"mail a{i % 2}@x.example", "", False) for i in range(9)] + [("s", 20 + i, "m", f"e{i}", "", True) for i in range(40)], "session string, at int, step string, message string, stack string, manual boolean")
    sent = reports.error_reports(errors)
    assert sent.count() == 25 and sent.where("not manual").count() == 1
    assert sent.first().message in ("mail <email>", "e0") and len(sent.first().signature) == 10


def test_limits(spark, tmp_path):
    times = [0.0, 1.0, 2.0, 3.0, 10.0, 11.0, 12.0, 12.5]
    assert limits.admitted(times, 2, 10, []) == [True, True, False, False, True, True, False, False]
    calls = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)] + [("b", 100, 0.0)], "caller string, call_id long, s double").select("caller", "call_id", F.timestamp_seconds("s").alias("ts"))
    batch = {r.call_id: r.allowed for r in limits.rate_limited(calls, 2, 10).collect()}
    assert [batch[i] for i in range(8)] == [True, True, False, False, True, True, False, False] and batch[100]
    calls.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    got = {}
    query = limits.stream_rate_limited(stream, 2, 10).writeStream.foreachBatch(lambda df, _: got.update({r.call_id: r.allowed for r in df.collect()})).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert got == batch
    rows = []
    done = limits.drain(stream, lambda df, _: rows.extend(df.collect()), str(tmp_path / "d"))
    done.awaitTermination(120)
    assert len(rows) == 9
