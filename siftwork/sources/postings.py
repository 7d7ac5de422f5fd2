"""Postings from pages, feeds and board APIs, all in one shape: title, company, location, url, posted, text."""

from __future__ import annotations

import json
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import clean, decoded, found, html_to_text

SHAPE = ["title", "company", "location", "url", "posted", "text"]


def _inner(xml: Column, tag: str) -> Column:
    """The content of the first element of a name, without a CDATA wrapper."""
    body = F.regexp_extract(xml, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.regexp_replace(body, r"^\s*<!\[CDATA\[|\]\]>\s*\z", "")


def _first(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def is_feed(text: Column) -> Column:
    return F.substring(text, 1, 2000).rlike(r"(?is)^\s*(<\?xml[^>]*>\s*)?(<!--.*?-->\s*)*<(rss|feed|rdf:RDF)\b")


def feed_postings(feeds: DataFrame) -> DataFrame:
    """Postings of RSS and Atom feeds(source_url, body)."""
    item = F.col("item")
    rows = feeds.select("source_url", F.explode(found(F.col("body"), r"(?is)<(?:item|entry)\b.*?</(?:item|entry)>")).alias("item"))
    return rows.select(
        "source_url", html_to_text(_inner(item, "title")).alias("title"), html_to_text(_first(_inner(item, "company"), _inner(item, "author"))).alias("company"), html_to_text(_inner(item, "location")).alias("location"),
        _first(clean(_inner(item, "link")), F.regexp_extract(item, r"(?i)<link\b[^>]*\bhref=[\"']([^\"']+)", 1)).alias("url"),
        _first(_inner(item, "pubDate"), _inner(item, "published"), _inner(item, "updated")).alias("posted"), html_to_text(_first(_inner(item, "description"), _inner(item, "content"), _inner(item, "summary"))).alias("text"),
    )


def personio_postings(feeds: DataFrame) -> DataFrame:
    """Postings of Personio feeds(source_url, host, body)."""
    p = F.col("p")
    rows = feeds.select("source_url", "host", F.explode(found(F.col("body"), r"(?is)<position\b.*?</position>")).alias("p"))
    sections = F.transform(found(p, r"(?is)<jobDescription\b.*?</jobDescription>"), lambda s: F.concat_ws("\n", html_to_text(_inner(s, "name")), html_to_text(_inner(s, "value"))))
    return rows.select(
        "source_url", html_to_text(_inner(p, "name")).alias("title"), _first(html_to_text(_inner(p, "subcompany")), F.split_part("host", F.lit("."), F.lit(1))).alias("company"), html_to_text(_inner(p, "office")).alias("location"),
        F.concat(F.lit("https://"), "host", F.lit("/job/"), clean(_inner(p, "id"))).alias("url"), _inner(p, "createdAt").alias("posted"), F.array_join(sections, "\n\n").alias("text"),
    )


#: The payload of each board API, as far as it is read.
PAYLOADS = {
    "greenhouse": "struct<jobs:array<struct<title:string,company_name:string,location:struct<name:string>,absolute_url:string,first_published:string,updated_at:string,content:string>>>",
    "lever": "array<struct<text:string,categories:struct<location:string,allLocations:array<string>>,hostedUrl:string,createdAt:bigint,descriptionPlain:string,lists:array<struct<text:string,content:string>>,additionalPlain:string>>",
    "smartrecruiters": "struct<content:array<struct<id:string,name:string,company:struct<name:string,identifier:string>,location:struct<city:string,country:string>,releasedDate:string>>>",
    "workable": "struct<name:string,jobs:array<struct<title:string,city:string,country:string,url:string,shortlink:string,published_on:string,created_at:string,description:string>>>",
    "recruitee": "struct<offers:array<struct<title:string,company_name:string,location:string,city:string,country:string,careers_url:string,published_at:string,created_at:string,description:string,requirements:string>>>",
    "adzuna": "struct<results:array<struct<title:string,company:struct<display_name:string>,location:struct<display_name:string>,redirect_url:string,created:string,description:string>>>",
}


def api_postings(answers: DataFrame, kind: str) -> DataFrame:
    """Postings of one kind of API from answers(source_url, label, body); an unknown kind gives none."""
    if kind not in PAYLOADS:
        return answers.where("false").select("source_url", *[F.lit("").alias(c) for c in SHAPE])
    data = answers.select("source_url", F.coalesce(F.get(F.split("label", "/"), F.lit(1)), F.lit("")).alias("co"), F.from_json("body", PAYLOADS[kind]).alias("d"))
    rows = {"lever": F.col("d"), "greenhouse": F.col("d.jobs") if kind == "greenhouse" else None, "workable": F.col("d.jobs") if kind == "workable" else None}.get(kind)
    if rows is None:
        rows = F.col({"smartrecruiters": "d.content", "recruitee": "d.offers", "adzuna": "d.results"}[kind])
    j = data.select("source_url", "co", "d", F.explode(rows).alias("j"))
    col = lambda path: F.coalesce(F.col(path).cast("string"), F.lit(""))
    pair = lambda a, b: F.concat_ws(", ", F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")))
    shaped = {
        "greenhouse": lambda: (col("j.title"), _first(col("j.company_name"), col("co")), col("j.location.name"), col("j.absolute_url"), _first(col("j.first_published"), col("j.updated_at")), html_to_text(decoded(col("j.content")))),
        "lever": lambda: (
            col("j.text"), col("co"), _first(col("j.categories.location"), F.array_join(F.coalesce("j.categories.allLocations", F.array().cast("array<string>")), " / ")), col("j.hostedUrl"), col("j.createdAt"),
            F.concat_ws("\n\n", F.nullif(col("j.descriptionPlain"), F.lit("")), F.nullif(F.array_join(F.transform(F.coalesce("j.lists", F.array().cast("array<struct<text:string,content:string>>")), lambda x: F.concat_ws("\n", x["text"], html_to_text(x["content"]))), "\n\n"), F.lit("")), F.nullif(col("j.additionalPlain"), F.lit(""))),
        ),
        "smartrecruiters": lambda: (col("j.name"), _first(col("j.company.name"), col("co")), F.concat_ws(", ", F.nullif(F.col("j.location.city"), F.lit("")), F.nullif(F.upper("j.location.country"), F.lit(""))), F.concat(F.lit("https://jobs.smartrecruiters.com/"), _first(col("j.company.identifier"), col("co")), F.lit("/"), col("j.id")), col("j.releasedDate"), F.lit("")),
        "workable": lambda: (col("j.title"), _first(col("d.name"), col("co")), pair("j.city", "j.country"), _first(col("j.url"), col("j.shortlink")), _first(col("j.published_on"), col("j.created_at")), html_to_text(col("j.description"))),
        "recruitee": lambda: (col("j.title"), _first(col("j.company_name"), col("co")), _first(col("j.location"), pair("j.city", "j.country")), col("j.careers_url"), _first(col("j.published_at"), col("j.created_at")), html_to_text(F.concat_ws("\n", F.nullif(F.col("j.description"), F.lit("")), F.nullif(F.col("j.requirements"), F.lit(""))))),
        "adzuna": lambda: (html_to_text(col("j.title")), col("j.company.display_name"), col("j.location.display_name"), col("j.redirect_url"), col("j.created"), html_to_text(col("j.description"))),
    }[kind]()
    return j.select("source_url", *[c.alias(n) for c, n in zip(shaped, SHAPE, strict=True)])


def adzuna_url(app_id: str, app_key: str, query: str = "", city: str = "", country: str = "nl") -> str:
    from urllib.parse import quote

    more = (f"&what={quote(query)}" if query else "") + (f"&where={quote(city)}" if city else "")
    return f"https://api.adzuna.com/v1/api/jobs/{country}/search/1?app_id={quote(app_id)}&app_key={quote(app_key)}&results_per_page=50{more}"


_SCRIPT = r"(?is)<script[^>]+type=[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"


def _listed(x) -> list:
    return x if isinstance(x, list) else [] if x in (None, "") else [x]


def _place(location) -> str:
    out = []
    for item in _listed(location):
        a = (item.get("address") or item) if isinstance(item, dict) else item
        out.append(a if isinstance(a, str) else ", ".join(filter(None, (a.get("addressLocality"), a.get("addressRegion")))) or a.get("name") or "")
    return " / ".join(filter(None, out))


def _structured(raw: str, base: str) -> list[tuple]:
    """(kind, title, company, location, url, posted, html) of one JSON-LD script: kinds are job and link."""
    raw = re.sub(r"^\s*<!--|-->\s*$|^\s*//<!\[CDATA\[|//\]\]>\s*$", "", raw).strip()
    for attempt in (raw, re.sub(r"[\x00-\x1f]+", " ", raw)):
        try:
            stack = [(json.loads(attempt), 0)]
            break
        except ValueError:
            continue
    else:
        return []
    jobs, links = [], []
    while stack:
        node, depth = stack.pop(0)
        if depth > 8:
            continue
        if isinstance(node, list):
            stack[:0] = [(x, depth + 1) for x in node]
        elif isinstance(node, dict):
            kind = " ".join(map(str, _listed(node.get("@type"))))
            if "jobposting" in kind.lower():
                firm, page = node.get("hiringOrganization"), node.get("mainEntityOfPage")
                remote = "Remote" if "telecommute" in str(node.get("jobLocationType", "")).lower() else ""
                url = node.get("url") or (page.get("@id") if isinstance(page, dict) else page) or ""
                jobs.append(("job", str(node.get("title") or node.get("name") or ""), str((firm.get("name") if isinstance(firm, dict) else firm) or ""), _place(node.get("jobLocation")) or remote, urljoin(base, str(url)) if url else base, str(node.get("datePosted") or ""), str(node.get("description") or "")))
                continue
            if "itemlist" in kind.lower():
                for it in _listed(node.get("itemListElement")):
                    inner = it.get("item") if isinstance(it, dict) else None
                    u = it if isinstance(it, str) else it.get("url") or (inner.get("url") if isinstance(inner, dict) else inner) if isinstance(it, dict) else ""
                    if u:
                        links.append(("link", "", "", "", urljoin(base, str(u)), "", ""))
            stack[:0] = [(node[k], depth + 1) for k in ("@graph", "itemListElement", "item") if k in node]
    return jobs + links


_ROW = StructType([StructField(c, StringType()) for c in ("kind", "title", "company", "location", "url", "posted", "html")])


@F.pandas_udf(ArrayType(_ROW))
def structured_data(raw: pd.Series, base: pd.Series) -> pd.Series:
    """Job postings and listed links of a JSON-LD script; its nesting has no bound, so a small function walks it."""
    return pd.Series([[dict(zip(("kind", "title", "company", "location", "url", "posted", "html"), row, strict=True)) for row in _structured(r or "", b or "")] for r, b in zip(raw, base, strict=True)])


def structured_postings(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and listed links in the JSON-LD of pages(url, html)."""
    scripts = pages.select(F.col("url").alias("source_url"), F.explode(found(F.col("html"), _SCRIPT, 1)).alias("raw"))
    rows = scripts.select("source_url", F.explode(structured_data("raw", "source_url")).alias("j")).select("source_url", "j.*")
    jobs = rows.where("kind = 'job'").select("source_url", "title", "company", "location", "url", "posted", html_to_text(F.col("html")).alias("text"))
    return jobs, rows.where("kind = 'link'").select("source_url", "url")


# Paths of single postings, and of pages that are none.
_JOBISH = r"(?i)/(vacatures?|vacancies|vacancy|jobs?|careers?|carriere|werken-bij|werkenbij|positions?|openings?|o|offer|stelle|stellen)/|[?&](job|vacancy|vacature)id=|/[0-9]{5,}-[a-z]"
_NO_JOB = r"(?i)\b(login|signin|apply|solliciteer|privacy|cookie|contact)\b"


def resolved(href: Column, base: Column) -> Column:
    """An absolute address; dots in paths are rare in links and kept as they are."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([^?#]*)", 1), r"(?<=[^/:])/[^/]*$", "/")
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))


def job_links(pages: DataFrame, most: int = 30, pattern: str = _JOBISH) -> DataFrame:
    """url, link: the links of listing pages(url, html) that look like single postings on the same site, in page order, at most ``most`` a page."""
    base = F.col("url")
    hrefs = F.transform(found(F.col("html"), r"(?i)<a\b[^>]*\bhref=[\"']([^\"'#]+)", 1), lambda h: F.regexp_replace(resolved(decoded(h), base), "#.*$", ""))
    host = lambda u: F.lower(F.regexp_extract(u, r"^https?://([^/?#:]*)", 1))
    path = lambda u: F.regexp_replace(F.regexp_extract(u, r"^https?://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = lambda u: F.regexp_extract(u, r"(\?[^#]*)", 1)
    last = lambda u: F.regexp_extract(path(u), "([^/]*)$", 1)
    good = lambda u: u.rlike("^https?://") & (host(u) == host(base)) & F.concat(path(u), F.lit("/"), query(u)).rlike(pattern) & (path(u) != path(base)) & (last(u).rlike("[0-9-]") | query(u).rlike(r"(?i)[?&](job|vacancy|vacature)id=")) & ~path(u).rlike(_NO_JOB)
    links = F.array_distinct(F.filter(hrefs, good))
    numbered = F.filter("links", lambda u: F.concat(last(u), query(u)).rlike("[0-9]{4,}"))
    rows = pages.select("url", links.alias("links")).withColumn("numbered", numbered)
    return rows.select("url", F.explode(F.slice(F.when(F.size("numbered") >= 3, F.col("numbered")).otherwise(F.col("links")), 1, most)).alias("link"))


# What a posting says somewhere.
_CUES = r"(?i)(solliciteer|apply now|apply for|wat vragen wij|wat bieden wij|what we offer|requirements|functie-eisen|jouw profiel|your profile|responsibilities)"


def page_postings(pages: DataFrame, cues: str = _CUES) -> DataFrame:
    """Pages(url, html) without structured data that read like a posting."""
    text = html_to_text(F.regexp_replace("html", r"(?is)<(header|nav|footer)\b.*?</\1>", " "))
    heading = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    title = F.split_part(html_to_text(_first(heading, F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit("\n"), F.lit(1))
    rows = pages.select(F.col("url").alias("source_url"), title.alias("title"), F.col("url"), text.alias("text"))
    return rows.where(F.col("text").rlike(cues) & (F.col("title") != "")).select("source_url", "title", F.lit("").alias("company"), F.lit("").alias("location"), "url", F.lit("").alias("posted"), "text")


def read_pages(pages: DataFrame, links_known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings of pages(url, html), and links to follow: listed links win over found ones; pages with postings are not crawled on; known links are left out."""
    jobs, listed = structured_postings(pages)
    with_jobs = jobs.select(F.col("source_url").alias("url")).distinct()
    rest = pages.join(with_jobs, "url", "left_anti")
    lists = listed.select("source_url", F.col("url").alias("link")).distinct()
    own = rest.join(lists.select(F.col("source_url").alias("url")).distinct(), "url", "left_anti")
    links = lists.join(with_jobs.withColumnRenamed("url", "source_url"), "source_url", "left_anti").unionByName(job_links(own).withColumnRenamed("url", "source_url"))
    if links_known is not None:
        links = links.join(links_known.select(F.col("url").alias("link")).distinct(), "link", "left_anti")
    return jobs.unionByName(page_postings(rest)), links


def cards(pages: DataFrame) -> DataFrame:
    """source_url, title, url, context: cards of result pages, at most 200 a page; pages without cards give links with text, at most 100."""
    card = r"(?is)<(?:li|div|article)\b[^>]*class=[\"'][^\"']*(?:job-card|job_seen|base-card|result|card)[^\"']*[\"'][^>]*>.*?</(?:li|article|div)>"
    bodies = F.slice(found(F.col("html"), card), 1, 200)
    anchor = r"(?is)<a\b[^>]*\bhref=[\"']([^\"'#]+)[\"'][^>]*>(.*?)</a>"
    from_cards = F.transform(bodies, lambda b: F.struct(clean(F.regexp_replace(F.regexp_extract(b, anchor, 2), "<[^>]+>", " ")).alias("title"), resolved(decoded(F.regexp_extract(b, anchor, 1)), F.col("url")).alias("link"), html_to_text(b).alias("context")))
    hrefs, labels = found(F.col("html"), anchor, 1), found(F.col("html"), anchor, 2)
    plain = F.transform(F.slice(F.arrays_zip(hrefs.alias("h"), labels.alias("l")), 1, 100), lambda x: F.struct(clean(F.regexp_replace(x["l"], "<[^>]+>", " ")).alias("title"), resolved(decoded(x["h"]), F.col("url")).alias("link"), F.lit("").alias("context")))
    chosen = F.when(F.size(bodies) > 0, from_cards).otherwise(plain)
    return pages.select(F.col("url").alias("source_url"), F.explode(chosen).alias("c")).where("c.title <> ''").select("source_url", F.col("c.title").alias("title"), F.col("c.link").alias("url"), F.col("c.context").alias("context"))


def collected_postings(tabs: DataFrame) -> DataFrame:
    """Postings of collected tabs(url, ld array<string>, cards array<struct<title,company,location,url,context>>, detail struct<title,text>).

    The open posting's text joins the first card whose title (40 letters) it holds; else it is a posting of its own if there is no structured data.
    """
    html = F.array_join(F.transform("ld", lambda s: F.concat(F.lit('<script type="application/ld+json">'), s, F.lit("</script>"))), "")
    jobs, _ = structured_postings(tabs.select("url", html.alias("html")))
    title = F.lower(F.coalesce("detail.title", F.lit("")))
    place = F.array_position(F.transform("cards", lambda c: (c["title"] != "") & F.contains(title, F.left(F.lower(c["title"]), F.lit(40)))), True)
    rows = tabs.select(F.col("url").alias("source_url"), F.size("ld").alias("n_ld"), "detail", place.alias("place"), F.posexplode_outer("cards").alias("at", "c"))
    text = F.when((F.col("detail").isNotNull()) & (F.col("at") + 1 == F.col("place")), F.col("detail.text")).otherwise(F.coalesce("c.context", F.lit("")))
    from_cards = rows.where("c is not null").select("source_url", F.col("c.title").alias("title"), F.col("c.company").alias("company"), F.col("c.location").alias("location"), F.col("c.url").alias("url"), F.lit("").alias("posted"), text.alias("text"))
    alone = tabs.where(F.col("detail").isNotNull() & (F.coalesce(place, F.lit(0)) == 0) & (F.size("ld") == 0))
    return jobs.unionByName(from_cards).unionByName(alone.select(F.col("url").alias("source_url"), F.col("detail.title").alias("title"), F.lit("").alias("company"), F.lit("").alias("location"), F.col("url"), F.lit("").alias("posted"), F.col("detail.text").alias("text")))
