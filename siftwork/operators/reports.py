"""Exports and error reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import scrubbed

#: Columns of the export, with how they are made (fixed values).
EXPORT = [
    ("Name", "name"), ("E-mail", "email"), ("Phone", "phone"), ("LinkedIn", "linkedin"), ("Location", "location"), ("Languages", "languages"), ("CV language", "cv_language"), ("Skills", "skills"), ("Years", "years"),
    ("Education", "education"), ("AI score", "ai_score"), ("AI level", "ai_level"), ("AI reasons", "ai_reasons"), ("Tool score", "tool_score"), ("Tool reasons", "tool_reasons"), ("Vacancy", "tag"), ("Lists", "lists"), ("Cover letter", "letter"),
    ("File", "file_name"), ("Added", "added_at"), ("Source", "source"),
]


def export_rows(docs: DataFrame) -> DataFrame:
    """All cells as text: lists joined by commas, reasons and list names by bars, times in ISO form."""

    def cell(name: str) -> Column:
        if name not in docs.columns:
            return F.lit("")
        kind = docs.schema[name].dataType.typeName()
        if kind == "array":
            return F.coalesce(F.array_join(name, " | " if name in ("ai_reasons", "tool_reasons", "lists") else ", "), F.lit(""))
        if kind == "timestamp":
            return F.coalesce(F.date_format(F.to_utc_timestamp(name, "UTC"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return docs.select(*[cell(c).alias(title) for title, c in EXPORT])


def csv_lines(docs: DataFrame, id_column: str = "id") -> DataFrame:
    """at, line: the header (at 0, with a byte order mark) and one quoted line for each document."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    rows = export_rows(docs)
    body = rows.select(F.lit(1).alias("at"), F.concat_ws(",", *[quoted(F.col(f"`{t}`")) for t, _ in EXPORT]).alias("line"))
    head = docs.sparkSession.range(1).select(F.lit(0).alias("at"), F.lit("﻿" + ",".join(f'"{t}"' for t, _ in EXPORT)).alias("line"))
    return head.union(body)


def write_csv(docs: DataFrame, path: str) -> None:
    """Text files with Windows line ends; every partition is a file, the header leads the first."""
    csv_lines(docs).sortWithinPartitions("at").select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def signature(step: Column, message: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", step, message), 256), 1, 10)


def error_reports(errors: DataFrame, most: int = 25) -> DataFrame:
    """Reports to send from errors(session, at, step, message, stack, manual): scrubbed and clipped, each signature once a session unless manual, at most 25 a session."""
    from pyspark.sql import Window

    clipped = errors.select("session", "at", F.left(F.coalesce("step", F.lit("unknown")), F.lit(40)).alias("step"), F.left(scrubbed(F.col("message")), F.lit(300)).alias("message"), F.left(scrubbed(F.col("stack")), F.lit(2000)).alias("stack"), F.coalesce("manual", F.lit(False)).alias("manual"))
    again = F.row_number().over(Window.partitionBy("session", "step", "message", "manual").orderBy("at"))
    once = clipped.withColumn("again", again).where("manual or again = 1")
    numbered = once.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("at", "step", "message")))
    return numbered.where(F.col("place") <= most).select("session", "at", "step", "message", "stack", "manual", signature(F.col("step"), F.col("message")).alias("signature"))


def issues(reports: DataFrame) -> DataFrame:
    """signature, action, n: the first report of a signature opens an issue, repeats comment on it, manual ones always open."""
    from pyspark.sql import Window

    order = Window.partitionBy("signature", "manual").orderBy("at", "session")
    return reports.withColumn("action", F.when(F.col("manual") | (F.row_number().over(order) == 1), "open").otherwise("comment"))


def details(docs: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """id, label, value for each field of a document that is not empty."""
    pairs = F.array(*[F.struct(F.lit(label).alias("label"), F.coalesce(F.array_join(c, ", ") if docs.schema[c].dataType.typeName() == "array" else F.col(c).cast("string"), F.lit("")).alias("value")) for label, c in fields])
    return docs.select("id", F.explode(F.filter(pairs, lambda p: p["value"] != "")).alias("p")).select("id", "p.*")
