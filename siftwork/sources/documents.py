"""Documents from files, captures and pages; unreadable ones become rows with an error, never exceptions."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import html_to_text

#: A document needs this many characters that are no white space.
SHORTEST = 50


def file_kind(name: Column, mime: Column) -> Column:
    name, mime = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(name.endswith(".pdf") | (mime == "application/pdf"), "pdf")
        .when(name.endswith(".docx") | F.contains(mime, F.lit("wordprocessingml")), "docx")
        .when(name.endswith(".doc") | (mime == "application/msword"), "doc")
        .when(name.rlike(r"\.(txt|md|rtf)$") | (mime == "text/plain"), "txt")
        .when(name.rlike(r"\.html?$") | (mime == "text/html"), "html")
        .otherwise("unknown")
    )


@F.pandas_udf(StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """Paragraphs of a DOCX file; null if it cannot be read. Zip and XML have no built-in function."""

    def one(data: bytes | None) -> str | None:
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
        except Exception:
            return None
        space = root.tag.split("}")[0] + "}"
        return "\n\n".join("".join(t.text or "" for t in p.iter(space + "t")) for p in root.iter(space + "p"))

    return content.map(one)


def checked(df: DataFrame) -> DataFrame:
    """df(kind_of_file, text) with error: old and unknown formats, and texts too short to read."""
    size = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s ]+", ""))
    error = (
        F.when(F.col("file_kind") == "doc", "Old .doc files cannot be read: save as .docx or PDF")
        .when(F.col("file_kind") == "unknown", "Unknown kind of file")
        .when(size < SHORTEST, "No readable text: perhaps a scan")
    )
    return df.withColumn("error", error).withColumn("text", F.when(error.isNull(), F.col("text")).otherwise(""))


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, file_name, file_kind, text, error of all files under a folder; unknown kinds are left out before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    named = files.withColumn("file_name", F.regexp_extract("path", "([^/]+)$", 1)).withColumn("file_kind", file_kind(F.col("file_name"), F.lit("")))
    named = named.where("file_kind <> 'unknown'")
    plain = F.decode("content", "UTF-8")
    text = F.when(F.col("file_kind") == "txt", plain).when(F.col("file_kind") == "html", html_to_text(plain))
    other = named.where("file_kind not in ('docx')").withColumn("text", text)
    docx = named.where("file_kind = 'docx'").withColumn("text", docx_text("content"))
    return checked(other.unionByName(docx)).select("path", "file_name", "file_kind", "text", "error")


def page_lines(items: DataFrame) -> DataFrame:
    """doc_id, text, hidden_words from positioned items(doc_id, page, at, x, y, size, width, height, text) of the first 15 pages.

    A step of more than 2 in y starts a line; words below size 3 or outside the page by more than 5 are hidden.
    """
    items = items.where("page <= 15")
    order = Window.partitionBy("doc_id", "page").orderBy("at")
    step = F.abs(F.col("y") - F.lag("y").over(order)) > 2
    glue = F.when(F.row_number().over(order) == 1, "").when(step, "\n").otherwise(" ")
    hidden = (F.col("size") < 3) | (F.col("x") < -5) | (F.col("y") < -5) | (F.col("x") > F.col("width") + 5) | (F.col("y") > F.col("height") + 5)
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    rows = items.select("doc_id", "page", "at", F.concat(glue, "text").alias("piece"), F.when(hidden, words).otherwise(0).alias("hidden"))
    pages = rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda s: s["piece"]), "").alias("text"), F.sum("hidden").alias("hidden"))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda s: s["text"]), "\n").alias("text"), F.sum("hidden").cast("int").alias("hidden_words"))


def captured_files(pages: DataFrame) -> DataFrame:
    """page_id, url, href, label: at most eight links of a page that look like an application document."""
    link = r"(?is)<a\b[^>]*\bhref=[\"']([^\"'#]+)[\"'][^>]*>(.*?)</a>"
    links = F.arrays_zip(F.regexp_extract_all("html", F.lit(link), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(link), F.lit(2)).alias("label"))
    wanted = lambda x: x["href"].rlike(r"(?i)\.(pdf|docx?|rtf|txt)(\?|$)") | F.concat_ws(" ", x["href"], x["label"]).rlike(r"(?i)\b(cv|resume|résumé|curriculum|cover.?letter|motivat|attachment|bijlage)")
    return pages.select("page_id", "url", F.explode(F.slice(F.filter(links, wanted), 1, 8)).alias("f")).select("page_id", "url", F.col("f.href").alias("href"), F.regexp_replace("f.label", "<[^>]+>", "").alias("label"))


def captured_rows(captures: DataFrame) -> DataFrame:
    """Rows of captures(id, url, text, files array<struct<name, text>>): the attachments, else the page's text, else an error row."""
    rows = captures.select("id", "url", "text", F.posexplode_outer("files").alias("at", "file"))
    text = F.coalesce("file.text", F.left("text", F.lit(200_000)), F.lit(""))
    error = F.when(F.length(F.regexp_replace(text, r"\s+", "")) < SHORTEST, "No readable text: perhaps a scan")
    return rows.select(F.concat_ws("-", "id", F.coalesce("at", F.lit(0)).cast("string")).alias("id"), F.col("id").alias("capture_id"), F.col("url").alias("page_url"), F.coalesce("file.name", F.lit("page")).alias("file_name"), text.alias("text"), error.alias("error"))


def is_safe_pattern(pattern: str) -> bool:
    """Whether a glob stays inside its folder."""
    return not re.search(r"(^|/)\.\.(/|$)", pattern)
