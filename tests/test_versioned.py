import pytest
from pyspark.sql import functions as F

from siftwork.operators import tables
from siftwork.operators.versioned import Conflict, Versioned

SCHEMA = "id string, text string, score_version int"


def content(df):
    return {r.id: r.text for r in df.collect()}


def rows(spark, **texts):
    return spark.createDataFrame([(k, v, 1) for k, v in texts.items()], SCHEMA)


def test_changes_and_old_versions(spark, tmp_path):
    table = Versioned(spark, f"{tmp_path}/t", SCHEMA, buckets=4)
    assert table.version() == 0 and table.read().count() == 0
    assert table.upsert(rows(spark, a="1", b="2", c="3")) == 1
    assert table.upsert(rows(spark, b="two", d="4")) == 2
    assert table.delete(rows(spark, a="", x="")) == 3
    assert content(table.read()) == {"b": "two", "c": "3", "d": "4"}
    assert content(table.read(1)) == {"a": "1", "b": "2", "c": "3"}
    # A table may be written from its own rows.
    assert table.upsert(table.read().withColumn("text", F.upper("text"))) == 4
    assert content(table.read()) == {"b": "TWO", "c": "3", "d": "4"}
    assert table.delete(table.read()) == 5 and table.read().count() == 0
    assert table.replace(rows(spark, z="9")) == 6 and content(table.read()) == {"z": "9"}
    assert table.vacuum(keep=1) > 0 and content(table.read()) == {"z": "9"} and table.versions() == [6]


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = Versioned(spark, f"{tmp_path}/t", SCHEMA, buckets=8)
    table.replace(spark.range(200).select(F.col("id").cast("string"), F.lit("x").alias("text"), F.lit(1).alias("score_version")))
    before = table.manifest()
    table.upsert(rows(spark, **{"7": "new"}))
    changed = {b for b, f in table.manifest().items() if f != before[b]}
    assert len(before) == 8 and len(changed) == 1 and table.read().count() == 200 and content(table.read())["7"] == "new"


def test_a_dead_writer_and_a_second_one(spark, tmp_path, monkeypatch):
    table = Versioned(spark, f"{tmp_path}/t", SCHEMA, buckets=2)
    table.upsert(rows(spark, a="1"))
    with monkeypatch.context() as m:
        m.setattr(table, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("dies")))
        with pytest.raises(RuntimeError):
            table.upsert(rows(spark, a="lost", b="lost"))
    again = Versioned(spark, f"{tmp_path}/t", SCHEMA, buckets=2)
    assert again.version() == 1 and content(again.read()) == {"a": "1"}
    # A writer between reading and committing of another: the second attempt builds on its rows.
    tries = []

    def slow(old):
        tries.append(1)
        if len(tries) == 1:
            again.upsert(rows(spark, a="between"))
        return old.withColumn("text", F.concat("text", F.lit("!")))

    assert table.change(None, slow) == 3 and len(tries) == 2
    assert content(table.read()) == {"a": "between!"}
    with pytest.raises(Conflict):
        table._commit(1, {})
    assert table.vacuum() > 0 and content(table.read(2)) == {"a": "between"}


def test_only_outdated_rows_are_parsed_again(spark, tmp_path):
    table = Versioned(spark, f"{tmp_path}/t", SCHEMA, buckets=4)
    table.replace(spark.createDataFrame([("a", "old", 1), ("b", "new", 2), ("c", "none", None)], SCHEMA))
    seen = []

    def parse(df):
        seen.extend(sorted(r.id for r in df.collect()))
        return df.withColumn("text", F.concat(F.lit("parsed "), "text"))

    table.refresh(2, parse)
    assert seen == ["a", "c"] and content(table.read()) == {"a": "parsed old", "b": "new", "c": "parsed none"}
    at = table.version()
    assert table.refresh(2, parse) == at and seen == ["a", "c"]


def test_settings_are_written_where_they_are_read(spark, tmp_path):
    store = Versioned(spark, f"{tmp_path}/s", "key string, value string", key="key", buckets=1)
    tables.store_settings(store.read(), {"theme": "dark", "n": 1}, store)
    tables.store_settings(store.read(), {"theme": "light"}, store)
    assert tables.setting(store.read(), "theme", "string") == "light" and tables.setting(store.read(), "n", "int") == 1
