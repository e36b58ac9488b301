"""Finding files: kinds of file, selectors and scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import screenshot
from ..functions.text import stem_of

IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif", "webp", "heic")
SELECTORS = ("all", "screenshots", "pdfs", "images")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_image(path: Column) -> Column:
    return suffix(path).isin(*IMAGES)


def is_pdf(path: Column) -> Column:
    return suffix(path) == "pdf"


def is_screenshot(path: Column) -> Column:
    return screenshot(stem_of(path)).isNotNull()


def parse_selectors(text: str) -> list[str]:
    """Names of file kinds from a comma list; unknown and missing names raise."""
    names = [x.strip() for x in text.split(",") if x.strip()]
    unknown = [n for n in names if n not in SELECTORS]
    if unknown or not names:
        raise ValueError(f"unknown selectors {unknown}" if unknown else "no selectors")
    return names


def keeper(names: list[str], path: Column) -> Column:
    """The union of the kinds named."""
    kinds = {"all": F.lit(True), "screenshots": is_screenshot(path), "pdfs": is_pdf(path), "images": is_image(path)}
    return reduce(lambda a, b: a | b, [kinds[n] for n in names])


def visible(path: Column, root: str = "") -> Column:
    """No part of the path below ``root`` is hidden, and the file is no product of OCR."""
    top = root.split("://", 1)[-1].rstrip("/")
    below = F.substring(path, F.locate(top, path) + len(top), F.length(path)) if top else path
    return ~below.rlike(r"/\.[^/]") & ~F.lower(path).endswith(".ocr.pdf")


def file_status(spark: SparkSession, path: str) -> str | None:
    """``file``, ``folder`` or None if there is neither, as the path's own file system says."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return None if not files.exists(where) else "file" if files.getFileStatus(where).isFile() else "folder"


def scan_documents(spark: SparkSession, folder: str, selectors: str = "all", content: bool = False) -> DataFrame:
    """Documents below a folder in the order of their paths: path, time, length and, if asked, content. A file named itself is taken as it is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    if file_status(spark, folder) != "file":
        files = files.filter(visible(F.col("path"), folder) & (is_image(F.col("path")) | is_pdf(F.col("path"))) & keeper(parse_selectors(selectors), F.col("path")))
    return (files if content else files.drop("content")).orderBy("path")


def scan_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes below a folder, one row each with its whole content."""
    notes = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return notes.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")).filter(visible(F.col("path"), folder))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A labelled corpus; a category may be one name or a list of names."""
    schema = "id string, language string, context string, category string, tags array<string>, date string, text string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    many = F.from_json("category", "array<string>")
    return rows.withColumn("categories", F.when(F.col("category").startswith("["), many).otherwise(F.array("category")))


def read_or_empty(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """A stored JSON table; a missing one, or one of another version, is empty, lines that are no JSON are left out.

    Any other failure (of the network, of rights) is one.
    """
    if file_status(spark, path) is None:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema + (", version int" if version is not None else "")).option("mode", "DROPMALFORMED").json(path)
    return rows.filter(F.col("version") == version).drop("version") if version is not None else rows
