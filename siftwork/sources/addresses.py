"""What an address is and whether it may be read: source types, admissible URLs, private addresses, robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionaries as d
from ..functions.text import bind

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?"


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(d.PRESETS, "name string, url string")


def _encoded(text: str | Column) -> Column:
    return F.replace(F.url_encode(F.lit(text) if isinstance(text, str) else text), F.lit("+"), F.lit("%20"))


def fill(url: Column, query: str = "", city: str = "") -> Column:
    """A URL template with its search words."""
    return F.replace(F.replace(url, F.lit("{q}"), _encoded(query)), F.lit("{city}"), _encoded(city))


def search_urls(sources: DataFrame, keywords: str, city: str = "") -> DataFrame:
    """One row for each of the first five comma-separated keywords of a template source; others once."""
    words = F.slice(F.filter(F.transform(F.split(F.lit(keywords), ","), lambda w: F.trim(w)), lambda w: w != ""), 1, 5)
    rows = sources.withColumn("keyword", F.explode_outer(F.when(F.contains("url", F.lit("{q}")), words).otherwise(F.array(F.lit(keywords)))))
    filled = F.replace(F.replace("url", F.lit("{q}"), _encoded(F.coalesce("keyword", F.lit("")))), F.lit("{city}"), _encoded(city))
    return rows.withColumn("url", filled).withColumn("searched_for", F.when(F.coalesce("keyword", F.lit("")) != "", F.array(F.lower("keyword"))).otherwise(F.array().cast("array<string>"))).drop("keyword")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 3))


def detect_source(raw: Column) -> Column:
    """struct(type, url, label, api, error) of an address somebody typed."""
    typed = F.trim(F.coalesce(raw, F.lit("")))
    url = F.when(typed.rlike("(?i)^https?://"), typed).otherwise(F.concat(F.lit("https://"), typed))

    def described(u: Column) -> Column:
        h = host(u)
        company = F.regexp_extract(F.regexp_extract(u, _URL, 5), "^/+([^/]+)", 1)
        has = company != ""
        api = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
        kinds = [
            ("tab", h.rlike("(?i)" + d.TAB_ONLY), F.lit("")),
            ("greenhouse", h.rlike(r"(^|\.)greenhouse\.io$") & has, api("https://boards-api.greenhouse.io/v1/boards/", company, "/jobs?content=true")),
            ("lever", (h == "jobs.lever.co") & has, api("https://api.lever.co/v0/postings/", company, "?mode=json")),
            ("lever", (h == "jobs.eu.lever.co") & has, api("https://api.eu.lever.co/v0/postings/", company, "?mode=json")),
            ("smartrecruiters", h.rlike(r"^(jobs|careers)\.smartrecruiters\.com$") & has, api("https://api.smartrecruiters.com/v1/companies/", company, "/postings?limit=100")),
            ("workable", (h == "apply.workable.com") & has, api("https://apply.workable.com/api/v1/widget/accounts/", company, "?details=true")),
            ("recruitee", h.rlike(r"\.recruitee\.com$"), api("https://", h, "/api/offers/")),
            ("personio", h.rlike(r"\.jobs\.personio\.(de|com)$"), api("https://", h, "/xml")),
        ]
        kind, link = F.lit("page"), F.lit("")
        for name, test, made in kinds[::-1]:
            kind, link = F.when(test, F.lit(name)).otherwise(kind), F.when(test, made).otherwise(link)
        bad = ~F.contains(h, F.lit(".")) | h.rlike(r"\s")
        plain = F.regexp_replace(h, r"^www\.", "")
        return F.struct(kind.alias("type"), u.alias("url"), plain.alias("host"), company.alias("company"), link.alias("api"), F.when(bad, F.lit("Not a web address")).otherwise("").alias("error"))

    def labelled(s: Column) -> Column:
        own = s["type"].isin("recruitee", "personio")
        label = F.when(own | (s["company"] == ""), s["host"]).when(s["type"] == "page", F.concat_ws("/", s["host"], s["company"])).otherwise(F.concat_ws("/", s["host"], s["company"]))
        return F.struct(s["type"], s["url"], label.alias("label"), s["api"], s["error"])

    return bind(bind(url, described), labelled)


def is_private(ip: Column) -> Column:
    """Whether an address is private, local or reserved."""
    low = F.lower(ip)
    v4 = F.regexp_replace(low, "^::ffff:", "")

    def reserved(p: Column) -> Column:
        a, b = p[0].try_cast("int"), p[1].try_cast("int")
        return a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(0, 168)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19))

    six = low.isin("::", "::1") | low.rlike("^(f[cd]|fe[89ab]|ff|64:ff9b)")
    return F.when(v4.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), bind(F.split(v4, r"\."), reserved)).otherwise(six)


def check_url(url: Column) -> Column:
    """bad-url, blocked-site or private; null if the address may be read."""
    part = lambda i: F.regexp_extract(url, _URL, i)
    h = F.regexp_replace(F.lower(part(3)), r"^\[|\]$", "")
    ip = h.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | F.contains(h, F.lit(":"))
    return (
        F.when(url.isNull() | ~F.lower(part(1)).isin("http", "https") | (h == "") | ~part(4).isin("", "80", "443") | (part(2) != ""), "bad-url")
        .when(h.rlike("(?i)" + d.TAB_ONLY), "blocked-site")
        .when((h == "localhost") | h.endswith(".localhost") | h.endswith(".internal") | (ip & is_private(h)), "private")
    )


def readable_type(content_type: Column) -> Column:
    return F.coalesce(content_type.rlike(r"(?i)^(text/(html|xml|plain)|application/(xhtml\+xml|xml|json|ld\+json|rss\+xml|atom\+xml))\b"), F.lit(False))


def robots_rules(robots: DataFrame) -> DataFrame:
    """host, grp, agents, rules (allow, path) from robots(host, body): one row for each group, in order."""
    lines = robots.select("host", F.posexplode(F.split("body", "\r?\n")).alias("at", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", "#.*", ""))).where(F.contains("line", F.lit(":")))
    from pyspark.sql import Window

    order = Window.partitionBy("host").orderBy("at")
    kv = lines.select("host", "at", F.lower(F.trim(F.regexp_extract("line", "^([^:]*)", 1))).alias("k"), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("v"))
    starts = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(order), F.lit("")) != "user-agent")
    grouped = kv.withColumn("s", starts.cast("int")).withColumn("grp", F.sum("s").over(order)).where("grp > 0")
    agents = F.collect_list(F.when(F.col("k") == "user-agent", F.lower("v")))
    rules = F.collect_list(F.when(F.col("k").isin("allow", "disallow") & (F.col("v") != ""), F.struct((F.col("k") == "allow").alias("allow"), F.col("v").alias("path"))))
    return grouped.groupBy("host", "grp").agg(agents.alias("agents"), rules.alias("rules"))


def robots_allow(requests: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """requests(host, path) with allowed: the first group for the agent, else the first for all; the longest rule wins, allow on a tie."""
    groups = robots_rules(robots)
    mine = F.exists("agents", lambda a: (a != "*") & F.contains(F.lit(agent.lower()), a))
    rank = F.when(mine, 0).when(F.array_contains("agents", "*"), 1)
    chosen = groups.where(rank.isNotNull()).groupBy("host").agg(F.min_by("rules", F.struct(rank, "grp")).alias("rules"))
    # A rule becomes an anchored pattern: stars are any text, a dollar at the end is the end.
    pattern = lambda p: F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*"), r"\\\$$", r"\\z"))
    joined = requests.join(chosen, "host", "left")
    hits = F.filter("rules", lambda r: F.rlike(F.col("path"), pattern(r["path"])))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow"))))
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("rules")
