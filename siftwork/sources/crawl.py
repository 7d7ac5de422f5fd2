"""A bounded crawl over recorded answers: a frontier of addresses, round by round, with what was seen as tables.

Answers are rows (url, status, location, content_type, body); whoever has a
network records them, and the rules here say which are read, in what order, and
what they give.  Every round is a few joins over the frontier, and its tables
are written, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stored import stored
from .addresses import check_url, host, readable_type, robots_allow
from .postings import feed_postings, is_feed, job_links, page_postings, resolved, structured_postings

#: Hops of one address at most, and links that one page gives at most.
REDIRECTS, LINKS = 4, 30


def fetched(requests: DataFrame, answers: DataFrame, robots: DataFrame | None = None, agent: str = "siftwork", redirects: int = REDIRECTS) -> DataFrame:
    """url, final, body, error for each distinct address of requests(url): redirects are followed, and every hop is checked.

    error: what check_url says, robots, unanswered, site-<status>, redirects (too many), not-a-page, or null.
    """
    open_ = requests.select("url").distinct().withColumn("at", F.col("url"))
    known = answers.groupBy(F.col("url").alias("at")).agg(F.min_by(F.struct("status", "location", "content_type", "body"), F.struct("status", "location", "content_type", "body")).alias("answer"))
    done = None
    for hop in range(redirects + 1):
        open_ = open_.withColumn("error", check_url(F.col("at")))
        if robots is not None:
            path = F.regexp_extract("at", r"^https?://[^/?#]*([^#]*)", 1)
            asked = open_.withColumns({"host": host(F.col("at")), "path": F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))})
            open_ = robots_allow(asked, robots, agent).withColumn("error", F.coalesce("error", F.when(~F.col("allowed"), "robots"))).select("url", "at", "error")
        met = open_.join(known, "at", "left")
        answer = lambda c: F.col(f"answer.{c}")
        moved = F.col("error").isNull() & answer("status").isin(301, 302, 303, 307, 308) & (F.coalesce(answer("location"), F.lit("")) != "")
        error = F.coalesce(
            F.col("error"),
            F.when(answer("status").isNull(), "unanswered").when(moved, "redirects").when(~answer("status").between(200, 299), F.concat(F.lit("site-"), answer("status").cast("string"))),
            F.when(~readable_type(answer("content_type")), "not-a-page"),
        )
        last = F.lit(hop == redirects)
        step = stored(met.select("url", "at", (moved & ~last).alias("moved"), resolved(answer("location"), F.col("at")).alias("next"), error.alias("error"), answer("body").alias("body")), "hop")
        ended = step.where("not moved").select("url", F.col("at").alias("final"), F.when(F.col("error").isNull(), F.col("body")).alias("body"), "error")
        done = ended if done is None else done.unionByName(ended)
        open_ = step.where("moved").select("url", F.col("next").alias("at"))
        if hop < redirects and open_.limit(1).count() == 0:
            break
    return done


def _read(pages: DataFrame, listing: bool, most: int) -> tuple[DataFrame, DataFrame]:
    """Postings of pages(url, html), and links (source_url, link): listed ones, else those of pages without postings; a page of the first round is no posting itself."""
    feeds = feed_postings(pages.where(is_feed(F.col("html"))).select(F.col("url").alias("source_url"), F.col("html").alias("body")))
    plain = pages.where(~is_feed(F.col("html")))
    jobs, lists = structured_postings(plain)
    lists = lists.select("source_url", F.col("url").alias("link")).distinct()
    place = F.row_number().over(Window.partitionBy("source_url").orderBy("link"))
    sources = jobs.select("source_url").union(lists.select("source_url")).distinct().withColumnRenamed("source_url", "url")
    rest = plain.join(sources, "url", "left_anti")
    found = job_links(rest, most).withColumnRenamed("url", "source_url")
    links = lists.unionByName(found).join(jobs.select("source_url", F.col("url").alias("link")).distinct(), ["source_url", "link"], "left_anti")
    links = links.withColumn("place", place).where(F.col("place") <= most).drop("place")
    with_jobs = jobs.select(F.col("source_url").alias("url")).distinct()
    postings = jobs.unionByName(feeds) if listing else jobs.unionByName(feeds).unionByName(page_postings(plain.join(with_jobs, "url", "left_anti")))
    return postings, links


def crawl(seeds: DataFrame, answers: DataFrame, robots: DataFrame | None = None, agent: str = "siftwork", depth: int = 2, links: int = LINKS, redirects: int = REDIRECTS, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings, and a log (url, round, final, error), of a walk from seeds(url): the listing pages, then what they link to, ``depth`` rounds in all.

    An address is asked once, whether it came as a link or was where a redirect ended; addresses of known(url) are never asked.
    """
    frontier = seeds.select("url").distinct()
    seen = known.select("url").distinct() if known is not None else frontier.where("false")
    postings, log = None, None
    for step in range(depth):
        asked = stored(frontier.join(seen, "url", "left_anti"), "frontier")
        if step and asked.limit(1).count() == 0:
            break
        got = stored(fetched(asked, answers, robots, agent, redirects), "fetched")
        pages = got.where("error is null and body is not null").select(F.col("final").alias("url"), F.col("body").alias("html")).dropDuplicates(["url"])
        # A page that an earlier round ended at was read then.
        pages = stored(pages.join(log.where("error is null").select(F.col("final").alias("url")).distinct(), "url", "left_anti") if log is not None else pages, "pages")
        made, out = _read(pages, step == 0, links)
        made = stored(made, "postings")
        postings = made if postings is None else postings.unionByName(made)
        row = got.select("url", F.lit(step).alias("round"), "final", "error")
        log = row if log is None else log.unionByName(row)
        seen = stored(seen.union(got.select("url")).union(got.where("error is null").select("final")).distinct(), "seen")
        frontier = out.select(F.col("link").alias("url")).distinct()
    return postings, log
