import json

from pyspark.sql import functions as F

from siftwork.sources import crawl

ANSWER = "url string, status int, location string, content_type string, body string"
HTML = "text/html; charset=utf-8"


def ad(title):
    return '<script type="application/ld+json">' + json.dumps({"@type": "JobPosting", "title": title, "description": "d", "hiringOrganization": {"name": "Firm"}}) + "</script>"


def site():
    page = lambda url, body, kind=HTML: (url, 200, None, kind, body)
    moved = lambda url, to: (url, 302, to, HTML, "")
    root = "https://jobs.example"
    links = "".join(f'<a href="/jobs/baker-{1000 + k}">x</a>' for k in range(40)) + f'<a href="{root}/jobs/moved-2000">m</a>'
    rows = [page(f"{root}/jobs", f"<html>{links}</html>")]
    rows += [page(f"{root}/jobs/baker-{1000 + k}", ad(f"Baker {k}") if k % 2 == 0 else f"<h1>Plain {k}</h1><p>Requirements and what we offer</p>") for k in range(1, 40)]
    rows += [moved(f"{root}/jobs/baker-1000", "/jobs/baker-1001")]
    rows += [moved("https://loop.example/a", "/b"), moved("https://loop.example/b", "/a")]
    rows += [moved(f"https://hops.example/{k}", f"/{k + 1}") for k in range(4)] + [page("https://hops.example/4", ad("Far away"))]
    rows += [page("https://listed.example/", '<script type="application/ld+json">' + json.dumps({"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "url": f"https://listed.example/vacancy/{k}"} for k in range(3)]}) + "</script>")]
    rows += [page(f"https://listed.example/vacancy/{k}", ad(f"Listed {k}") + "<a href='/jobs/deeper-5555'>d</a>") for k in range(3)]
    rows += [page("https://feed.example/rss", "<?xml version='1.0'?><rss><channel><item><title>Fed</title><link>https://feed.example/1</link></item></channel></rss>", "application/rss+xml")]
    rows += [page("https://pdf.example/x", "%PDF", "application/pdf"), ("https://gone.example/x", 404, None, HTML, ""), moved("https://inward.example/x", "http://127.0.0.1/secret"), page("http://127.0.0.1/secret", ad("Secret")), page("https://closed.example/jobs", ad("Closed"))]
    return rows


SEEDS = ["https://jobs.example/jobs", "https://loop.example/a", "https://hops.example/0", "https://listed.example/", "https://feed.example/rss", "https://pdf.example/x", "https://gone.example/x", "https://inward.example/x", "https://closed.example/jobs", "https://silent.example/", "ftp://x.example/"]


def walk(spark, **more):
    answers = spark.createDataFrame(site(), ANSWER)
    robots = spark.createDataFrame([("closed.example", "User-agent: *\nDisallow: /jobs")], "host string, body string")
    postings, log = crawl.crawl(spark.createDataFrame([(s,) for s in SEEDS], "url string"), answers, robots, **more)
    return postings.collect(), log.collect()


def test_a_recorded_site(spark):
    postings, log = walk(spark)
    errors = {r.url: r.error for r in log if r["round"] == 0}
    assert errors == {
        "https://jobs.example/jobs": None, "https://loop.example/a": "redirects", "https://hops.example/0": None, "https://listed.example/": None, "https://feed.example/rss": None, "https://pdf.example/x": "not-a-page",
        "https://gone.example/x": "site-404", "https://inward.example/x": "private", "https://closed.example/jobs": "robots", "https://silent.example/": "unanswered", "ftp://x.example/": "bad-url",
    }
    assert {r.url: r.final for r in log}["https://hops.example/0"] == "https://hops.example/4"
    second = [r.url for r in log if r["round"] == 1]
    assert len(second) == len(set(second)) == 30 + 3
    titles = [r.title for r in postings]
    assert {"Far away", "Listed 0", "Listed 1", "Listed 2", "Fed"} <= set(titles) and not {"Secret", "Closed"} & set(titles)
    # Thirty links; the first ends where the second one is, which is read once.
    baked = [t for t in titles if t.startswith(("Baker", "Plain"))]
    assert sorted(baked) == sorted({f"{'Baker' if k % 2 == 0 else 'Plain'} {k}" for k in range(1, 30)})
    assert max(r["round"] for r in log) == 1


def test_bounds_and_known_addresses(spark):
    known = spark.createDataFrame([("https://listed.example/vacancy/1",)], "url string")
    postings, log = walk(spark, known=known, links=2, redirects=1)
    asked = {r.url for r in log}
    assert "https://listed.example/vacancy/1" not in asked and len([u for u in asked if "/jobs/baker" in u]) == 2
    assert {r.url: r.error for r in log}["https://hops.example/0"] == "redirects"
    assert {r.title for r in postings if r.title.startswith("Listed")} == {"Listed 0"}
    empty = spark.createDataFrame([], "url string")
    none, log = crawl.crawl(empty, spark.createDataFrame(site(), ANSWER))
    assert none.count() == 0 and log.count() == 0


def test_third_round_goes_on(spark):
    answers = spark.createDataFrame([("https://a.example/jobs", 200, None, HTML, '<a href="/jobs/list-1234">l</a>'), ("https://a.example/jobs/list-1234", 200, None, HTML, '<a href="/jobs/one-5678">o</a><a href="/jobs">back</a>'), ("https://a.example/jobs/one-5678", 200, None, HTML, ad("One"))], ANSWER)
    seeds = spark.createDataFrame([("https://a.example/jobs",)], "url string")
    assert crawl.crawl(seeds, answers)[0].count() == 0
    postings, log = crawl.crawl(seeds, answers, depth=5)
    assert [r.title for r in postings.collect()] == ["One"] and log.count() == 3 and log.agg(F.max("round")).first()[0] == 2
