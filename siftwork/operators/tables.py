"""Keyed tables as DataFrames: every change gives the new table, which the caller writes."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """Rows replace those with their key; the others stay."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def delete_with_letters(docs: DataFrame, ids: DataFrame, links: DataFrame) -> DataFrame:
    """Documents and the letters linked to them go."""
    letters = links.join(ids.select(F.col("id").alias("cv_id")), "cv_id").select(F.col("letter_id").alias("id"))
    return delete(docs, ids.select("id").union(letters))


def truncate(table: DataFrame) -> DataFrame:
    return table.where("false")


def overridden(table: DataFrame, manual: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Values set by hand win over derived ones; an empty text unsets."""
    renamed = manual.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return table.join(renamed, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def hidden(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """A soft delete that later merges keep."""
    marked = ids.select("id", F.lit(True).alias("_hide")).distinct()
    return postings.join(marked, "id", "left").withColumn("hidden", F.coalesce("_hide", "hidden", F.lit(False))).drop("_hide")


def outdated(docs: DataFrame, version: int) -> DataFrame:
    """Rows whose score was made by an older version."""
    return docs.where(F.coalesce("score_version", F.lit(0)) != version)


def extended(lists: DataFrame, members: DataFrame) -> DataFrame:
    """Lists(id, members) with members(list_id, member) added behind, each once."""
    added = members.groupBy("list_id").agg(F.array_sort(F.collect_set("member")).alias("_new")).withColumnRenamed("list_id", "id")
    return lists.join(added, "id", "left").withColumn("members", F.array_union("members", F.coalesce("_new", F.array().cast("array<string>")))).drop("_new")


def pruned(lists: DataFrame, docs: DataFrame) -> DataFrame:
    """Lists without members that no longer exist; order is kept."""
    rows = lists.select("id", F.posexplode("members").alias("at", "member")).join(docs.select(F.col("id").alias("member")), "member", "left_semi")
    left = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "member"))), lambda s: s["member"]).alias("_left"))
    return lists.join(left, "id", "left").withColumn("members", F.coalesce("_left", F.array().cast("array<string>"))).drop("_left")


def lists_of(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """id, list_ids: the lists a document is on."""
    rows = lists.select(F.col("id").alias("list_id"), F.explode("members").alias("id")).distinct()
    return docs.select("id").join(rows, "id").groupBy("id").agg(F.array_sort(F.collect_list("list_id")).alias("list_ids"))


def target_texts(targets: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts set by tag; a blank text deletes the tag."""
    return upsert(targets, texts, "tag").where(F.trim(F.coalesce("text", F.lit(""))) != "")


def add_sources(sources: DataFrame, new: DataFrame) -> DataFrame:
    """Sources are unique by address and type; known ones stay as they are."""
    return sources.unionByName(new.dropDuplicates(["url", "type"]).join(sources.select("url", "type"), ["url", "type"], "left_anti"), allowMissingColumns=True)


def settings(spark: SparkSession, path: str) -> DataFrame:
    """key, value (JSON text) of a key/value table; one that was never written is empty."""
    try:
        return spark.read.schema("key string, value string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "key string, value string")


def setting(table: DataFrame, key: str, kind: str, fallback: object = None) -> object:
    """The value of one key by its schema, or the fallback."""
    row = table.where(F.col("key") == key).select(F.from_json("value", f"v {kind}").alias("s")).select("s.v").first()
    return fallback if row is None or row.v is None else row.v


def store_settings(table: DataFrame, values: dict[str, object], to: object) -> None:
    """Values replace those of their keys; to is a versioned table, which may be the one that was read, or the path of another one."""
    rows = table.sparkSession.createDataFrame([(k, json.dumps({"v": v})) for k, v in values.items()], "key string, value string")
    if isinstance(to, str):
        upsert(table, rows, "key").write.mode("overwrite").parquet(to)
    else:
        to.upsert(rows)


def between(ordered: DataFrame, first: str, last: str, position: str = "position") -> DataFrame:
    """Rows between two ids in a positioned table, either way round."""
    ends = ordered.where(F.col("id").isin(first, last)).agg(F.min(position).alias("_low"), F.max(position).alias("_high"))
    return ordered.join(F.broadcast(ends), F.col(position).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")
