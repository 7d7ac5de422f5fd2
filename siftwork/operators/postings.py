"""Postings: one shape, one row for one ad, merge with what is known, filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_url, clean, date_only, hash_id
from ..plans.search import Term, searchable
from .components import connected_components

LONGEST = 20_000


def normalised(rows: DataFrame, label: str = "") -> DataFrame:
    """id, title, company, location, url, posted, text, source, source_url, searched_for."""
    searched = F.col("searched_for") if "searched_for" in rows.columns else F.array().cast("array<string>")
    base = rows.select(*[clean(F.col(c)).alias(c) for c in ("title", "company", "location")], F.trim(F.coalesce("url", F.lit(""))).alias("url"), date_only(F.col("posted")).alias("posted"), F.left(F.coalesce("text", F.lit("")), F.lit(LONGEST)).alias("text"), F.lit(label).alias("source"), F.col("source_url"), searched.alias("searched_for"))
    key = F.when(F.col("url") != "", canonical_url(F.col("url"))).otherwise(F.lower(F.concat_ws("|", "title", "company")))
    return base.select(hash_id(key).alias("id"), *base.columns)


def deduplicated(postings: DataFrame) -> DataFrame:
    """One row for each ad: rows with equal id, or equal title and company whatever the case, are one ad.

    The longest text wins, the least id stays, searched words are united; postings without a title are dropped.
    Ids and names are the nodes of a graph whose components are the ads, so chains are followed however long they are.
    """
    rows = postings.where("title <> ''").withColumn("name_key", F.lower(F.concat_ws("|", "title", "company")))
    # Ids are below all names, so an ad's least member is an id.
    ends = rows.select(F.concat(F.lit("0"), "id").alias("id_node"), F.concat(F.lit("1"), "name_key").alias("name_node"))
    labels = connected_components(ends, "id_node", "name_node").where(F.col("node").startswith("0"))
    labels = labels.select(F.substr("node", F.lit(2)).alias("id"), F.substr("component", F.lit(2)).alias("label"))
    grouped = rows.join(labels, "id").groupBy("label")
    best = F.max_by(F.struct("title", "company", "location", "url", "posted", "text", "source", "source_url"), F.struct(F.length("text"), F.col("id")))
    return grouped.agg(best.alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("searched_for")))).alias("searched_for")).select(F.col("label").alias("id"), "b.*", "searched_for")


def merged(known: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """Found postings into the known ones: first_seen and hidden stay, searched words are united, last_seen is now; is_new marks new rows."""
    at = F.lit(now).cast("timestamp")
    k = known.select([F.col(c).alias(f"k_{c}") for c in known.columns])
    both = found.join(k, found["id"] == k["k_id"], "full_outer")
    seen = F.col("id").isNotNull()
    pick = lambda c: F.when(seen, F.col(c)).otherwise(F.col(f"k_{c}")).alias(c)
    plain = [c for c in found.columns if c not in ("searched_for",)]
    none = F.array().cast("array<string>")
    return both.select(
        *[pick(c) for c in plain],
        F.array_union(F.coalesce("k_searched_for", none), F.coalesce("searched_for", none)).alias("searched_for"),
        F.coalesce("k_first_seen", at).alias("first_seen"),
        F.when(seen, at).otherwise(F.col("k_last_seen")).alias("last_seen"),
        F.coalesce("k_hidden", F.lit(False)).alias("hidden"),
        F.col("k_id").isNull().alias("is_new"),
    )


def filtered(postings: DataFrame, terms: list[str] = (), city: str = "", whole_text: bool = False, source_url: str = "", hidden: bool = False) -> DataFrame:
    """Postings that match one of the terms in title and company (or were searched for with it), a city, and a source."""
    words = [t.strip() for t in terms if t.strip()]
    text = F.concat_ws("\n", "title", "company", *(["text"] if whole_text else []))
    rows = postings if hidden else postings.where(~F.coalesce("hidden", F.lit(False)))
    if source_url:
        rows = rows.where(F.col("source_url") == source_url)
    if city.strip():
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "location", "text")), F.lit(city.strip().lower())))
    if not words:
        return rows
    asked = F.arrays_overlap("searched_for", F.array(*[F.lit(w.lower()) for w in words]))
    view = searchable(rows.withColumn("_text", F.col("text")).withColumn("text", text).withColumn("name", F.col("title")))
    hit = reduce(lambda a, b: a | b, [Term(w).predicate() for w in words])
    kept = view.where(F.coalesce(asked, F.lit(False)) | hit)
    return kept.withColumn("text", F.col("_text")).select(*postings.columns)


def ordered(postings: DataFrame, most: int = 500) -> DataFrame:
    """The newest first; a list shows at most ``most``."""
    return postings.orderBy(F.desc("first_seen"), F.desc("posted"), "id").limit(most)


def to_targets(targets: DataFrame, ads: DataFrame) -> DataFrame:
    """Targets(tag, title, company, location, url, job_id, text) with ads(id, title, ...) added or updated by job id.

    The tag is "title – company" cut at 90 characters; if another ad has it, the location or the end of the id follows.
    """
    name = F.left(F.concat_ws(" – ", F.nullif("title", F.lit("")), F.nullif("company", F.lit(""))), F.lit(90))
    text = F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).otherwise(F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif("company", F.lit("")), F.nullif("location", F.lit(""))))
    new = ads.select(name.alias("tag"), "title", "company", "location", "url", F.col("id").alias("job_id"), text.alias("text"))
    kept = targets.select(*new.columns).join(new.select("job_id"), "job_id", "left_anti").select(*new.columns)
    old_tags = targets.select("job_id", F.col("tag").alias("_old")).where("job_id is not null and job_id <> ''")
    new = new.join(old_tags, "job_id", "left")
    taken = kept.select("tag", F.lit(True).alias("_taken")).distinct()
    place = F.row_number().over(Window.partitionBy("tag").orderBy(F.col("_old").isNull(), "job_id"))
    new = new.withColumn("_place", place).join(taken, "tag", "left")
    clash = F.col("_old").isNull() & ((F.col("_place") > 1) | F.coalesce("_taken", F.lit(False)))
    tail = F.when((F.col("_place") <= 2) & (F.coalesce("location", F.lit("")) != ""), F.col("location")).otherwise(F.right("job_id", F.lit(4)))
    tag = F.coalesce("_old", F.when(clash, F.concat(F.col("tag"), F.lit(" ("), tail, F.lit(")"))).otherwise(F.col("tag")))
    return kept.unionByName(new.withColumn("tag", tag).select(*kept.columns))


def of_sources(sources: DataFrame, postings: DataFrame) -> DataFrame:
    """url, n, n_new for each source: postings by its address, and those of a tab source by its label; hidden ones do not count."""
    seen = postings.where(~F.coalesce("hidden", F.lit(False))).select("id", "source", "source_url", "is_new")
    by_url = sources.select("url").join(seen.withColumnRenamed("source_url", "url"), "url").select("url", "id", "is_new")
    by_label = sources.where("type = 'tab'").select("url", F.split_part("label", F.lit("/"), F.lit(1)).alias("source")).join(seen, "source").select("url", "id", "is_new")
    both = by_url.union(by_label).distinct()
    counts = both.groupBy("url").agg(F.count("*").alias("n"), F.count_if("is_new").alias("n_new"))
    return sources.select("url").join(counts, "url", "left").na.fill(0, ["n", "n_new"])


def stale(sources: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Sources whose last run is older than a day, or that never ran."""
    return sources.where(F.col("last_run").isNull() | (F.col("last_run") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours))))
