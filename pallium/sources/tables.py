"""Readers of the standard tables, and of corpora of pages with label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_files(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """(page, html): one row for each HTML file under path whose name holds `only`."""
    files = spark.read.option("pathGlobFilter", "*.html").text(path, wholetext=True)
    page = F.regexp_extract(F.input_file_name(), r"([^/]+)\.html$", 1)
    rows = files.select(page.alias("page"), F.col("value").alias("html"))
    return rows.filter(F.contains("page", F.lit(only))) if only else rows


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """(page, note, mode, expect) of the JSON label files under path; the file's name is the page's."""
    schema = "note string, mode string, expect map<string,array<string>>"
    files = spark.read.option("multiLine", "true").option("pathGlobFilter", "*.json").schema(schema).json(path)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("page"), "note", F.coalesce("mode", F.lit("visible")).alias("mode"), "expect")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """(category, tp, fp, fn, precision, recall, f1) of a stored baseline; the overall row has category 'overall'."""
    one = "struct<tp:long,fp:long,fn:long,precision:double,recall:double,f1:double>"
    raw = spark.read.option("multiLine", "true").schema(f"overall {one}, categories map<string,{one}>").json(path)
    whole = raw.select(F.lit("overall").alias("category"), "overall.*")
    return whole.unionByName(raw.select(F.explode("categories").alias("category", "m")).select("category", "m.*"))


def write_baseline(metric_rows: DataFrame, path: str) -> None:
    """One JSON file in the layout that `baseline` reads; a row for each category, so it is small."""
    m = F.struct("tp", "fp", "fn", "precision", "recall", "f1")
    whole = metric_rows.filter("category = 'overall'").select(m.alias("overall"))
    rest = metric_rows.filter("category <> 'overall'").agg(F.map_from_entries(F.collect_list(F.struct("category", m.alias("m")))).alias("categories"))
    whole.join(rest, F.lit(True), "full_outer").coalesce(1).write.mode("overwrite").json(path)
