"""Counts for the choices of a search page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import found


def language_facet(docs: DataFrame) -> DataFrame:
    """Distinct languages, spoken or written in, sorted."""
    return docs.select(F.explode(F.array_union(F.coalesce("languages", F.array().cast("array<string>")), F.array(F.col("cv_language")))).alias("language")).where("language <> ''").distinct().orderBy("language")


def tag_counts(docs: DataFrame) -> DataFrame:
    return docs.where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))


def document_frequency(docs: DataFrame, text: str = "text", shortest: int = 3) -> DataFrame:
    """word, n: documents that hold each word of letters."""
    words = F.array_distinct(found(F.lower(F.col(text)), rf"\p{{L}}{{{shortest},}}"))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def top_skills(docs: DataFrame, chosen: list[str] = (), most: int = 10) -> DataFrame:
    """The most frequent skills that are not chosen; ties in alphabetical order."""
    rows = docs.select(F.explode(F.array_except("skills", F.array(*map(F.lit, chosen)).cast("array<string>"))).alias("skill"))
    return rows.groupBy("skill").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "skill").limit(most)


def members_by_posting(targets: DataFrame, lists: DataFrame) -> DataFrame:
    """job_id, n: distinct documents on lists(vacancy, members) that are placed on a target with a posting."""
    rows = lists.select(F.col("vacancy").alias("tag"), F.explode("members").alias("member"))
    return targets.where("job_id <> ''").join(rows, "tag").groupBy("job_id").agg(F.count_distinct("member").alias("n"))
