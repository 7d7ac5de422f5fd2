"""Temporal URL filter: dated list entries as validity intervals, joined as of each capture's time.

List events (kind, value, action, day) become intervals: an ``add`` holds until
the next event of the same entry, without end if there is none.  A capture asks
for every entry that can name it: its host's domains, its host, and its host
with each leading part of its path.  The as-of join is an equality on (kind,
value) and an interval condition; entries are broadcast only behind a check of
their size, else both sides shuffle on the key and skewed keys are split.

Defined cases: a null or unparsable URL, or a null time, asks for nothing and
is allowed; on one day a ``remove`` of an entry comes after its ``add``, so the
entry is not active then; equal events count once; events with a null field are
dropped; repeated captures keep their rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, sized_broadcast

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def intervals(events: DataFrame) -> DataFrame:
    """kind, value, valid_from, valid_to (null: open) from events(kind, value, action, day)."""
    events = events.select("kind", F.lower("value").alias("value"), "action", F.col("day").cast("date").alias("day")).na.drop().distinct()
    order = Window.partitionBy("kind", "value").orderBy("day", "action")
    spans = events.withColumn("valid_to", F.lead("day").over(order)).withColumnRenamed("day", "valid_from")
    return spans.where("action = 'add' and (valid_to is null or valid_to > valid_from)").select("kind", "value", "valid_from", "valid_to")


def _asked(url: F.Column) -> F.Column:
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    path = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")

    def keys(p: F.Column) -> F.Column:
        labels, parts, name = p["labels"], p["parts"], p["host"]
        key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        domains = F.transform(labels, lambda _, i: key("domain", F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
        paths = F.transform(parts, lambda _, i: key("path", F.lower(F.concat(name, F.lit("/"), F.array_join(F.slice(parts, 1, i + 1), "/")))))
        return F.concat(domains, F.array(key("host", name)), paths)

    bound = F.struct(F.split(host, r"\.").alias("labels"), path.alias("parts"), host.alias("host"))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return F.when(host != "", F.transform(F.array(bound), keys)[0]).otherwise(none)


def filter_urls(captures: DataFrame, events: DataFrame) -> DataFrame:
    """page_id, url, fetched_on, n_entries, first_entry, blocked for each row of captures(page_id, url, fetched_on)."""
    captures = captures.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("fetched_on").cast("date").alias("fetched_on"))
    keyed = captures.withColumn("row_key", F.xxhash64("page_id", "url", "fetched_on"))
    active = materialize(intervals(events), "intervals")
    asked = keyed.where("fetched_on is not null").select("row_key", "fetched_on", F.explode(_asked(F.col("url"))).alias("k")).select("row_key", "fetched_on", "k.*")
    hits = asked.join(sized_broadcast(active, 120), ["kind", "value"]).where("valid_from <= fetched_on and (valid_to is null or fetched_on < valid_to)")
    found = hits.groupBy("row_key").agg(F.count_distinct("kind", "value").alias("n_entries"), F.min(F.concat_ws(":", "kind", "value")).alias("first_entry"))
    found = materialize(found, "hits")
    return keyed.join(sized_broadcast(found, 120), "row_key", "left").select("page_id", "url", "fetched_on", F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), "first_entry", F.col("n_entries").isNotNull().alias("blocked"))


def sample_captures(pages: DataFrame) -> DataFrame:
    """Captures of pages, each with a day of 2024 derived from its id (the table has no fetch time)."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.coalesce(F.col("page_id"), F.lit(0)) * 37, F.lit(365)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched_on"))


#: Host words that are listed from the first day on (fixed values).
SPAM = "casino|poker|bets|pills|viagra|porn|payday|lottery"


def sample_events(pages: DataFrame) -> DataFrame:
    """A dated list over all hosts of pages: spam words list a host for good; digests choose the other entries and their days."""
    url = F.col("url")
    seen = pages.select(F.lower(F.regexp_extract(url, _HOST, 1)).alias("host"), F.regexp_extract(F.regexp_extract(url, _PATH, 1), "^/([^/]+)", 1).alias("part")).where("host <> ''").distinct()
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int")
    domains = seen.select(F.lit("domain").alias("kind"), F.regexp_replace("host", r"^[^.]+\.", "").alias("value"), F.lit(5).alias("one_in"))
    hosts = seen.select(F.lit("host").alias("kind"), F.col("host").alias("value"), F.lit(4).alias("one_in"))
    paths = seen.where("part <> ''").select(F.lit("path").alias("kind"), F.lower(F.concat_ws("/", "host", "part")).alias("value"), F.lit(3).alias("one_in"))
    entries = domains.union(hosts).union(paths).distinct().withColumn("n", number(F.concat("kind", F.lit(":"), "value"))).where("n % one_in = 0")
    first = F.date_add(F.lit("2024-01-01").cast("date"), F.col("n") % 300)
    dated = F.array(
        F.struct(F.lit("add").alias("action"), first.alias("day")),
        F.struct(F.lit("remove").alias("action"), F.date_add(first, 20 + F.col("n") % 50).alias("day")),
        F.struct(F.lit("add").alias("action"), F.date_add(first, 90 + F.col("n") % 30).alias("day")),
    )
    spam = seen.where(F.col("host").rlike(SPAM)).select(F.lit("host").alias("kind"), F.col("host").alias("value"), F.lit("add").alias("action"), F.lit("2024-01-01").cast("date").alias("day")).distinct()
    chosen = entries.where(~((F.col("kind") == "host") & F.col("value").rlike(SPAM)))
    return chosen.select("kind", "value", F.explode(dated).alias("e")).select("kind", "value", "e.*").union(spam)


ORACLE = r"""
with captured as (
  select page_id, url, date '2024-01-01' + cast((coalesce(page_id, 0) * 37) % 365 as integer) as fetched_on,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path
  from pages
), seen as (select distinct host, regexp_extract(path, '^/([^/]+)', 1) as part from captured where host <> ''),
listed as (
  select 'domain' as kind, regexp_replace(host, '^[^.]+\.', '') as value, 5 as one_in from seen
  union select 'host', host, 4 from seen
  union select 'path', lower(host || '/' || part), 3 from seen where part <> ''
), entries as (
  select * from (select kind, value, one_in, cast('0x' || substr(md5(kind || ':' || value), 1, 4) as integer) as n from listed) where n % one_in = 0 and not (kind = 'host' and regexp_matches(value, 'casino|poker|bets|pills|viagra|porn|payday|lottery'))
), spans as (
  select kind, value, date '2024-01-01' + n % 300 as valid_from, date '2024-01-01' + n % 300 + 20 + n % 50 as valid_to from entries
  union all select kind, value, date '2024-01-01' + n % 300 + 90 + n % 30, null from entries
  union all select distinct 'host', host, date '2024-01-01', null from seen where regexp_matches(host, 'casino|poker|bets|pills|viagra|porn|payday|lottery')
), parts as (
  select *, string_split(host, '.') as labels, list_filter(string_split(path, '/'), lambda s: s <> '') as segments from captured where host <> ''
), asked as (
  select page_id, url, fetched_on, 'domain' as kind, array_to_string(labels[i:], '.') as value from parts, unnest(range(1, len(labels) + 1)) as t(i)
  union all select page_id, url, fetched_on, 'host', host from parts
  union all select page_id, url, fetched_on, 'path', lower(host || '/' || array_to_string(segments[1:i], '/')) from parts, unnest(range(1, len(segments) + 1)) as t(i)
), hits as (
  select page_id, url, count(distinct kind || ':' || value) as n_entries, min(kind || ':' || value) as first_entry
  from asked join spans using (kind, value) where valid_from <= fetched_on and (valid_to is null or fetched_on < valid_to) group by page_id, url
)
select c.page_id, c.url, c.fetched_on, coalesce(h.n_entries, 0) as n_entries, h.first_entry, h.n_entries is not null as blocked
from captured c left join hits h on c.page_id is not distinct from h.page_id and c.url is not distinct from h.url
"""
