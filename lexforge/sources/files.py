"""Readers: CSV with a column check, JSON documents and lines, dataset folders, search responses; a report writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of CSV files with a header, quotes and line ends within quotes. Columns that are missing from the
    header fail; an empty value is null."""
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").schema(schema).csv(path)


def read_documents(rows: DataFrame, template: str, fields: list[str], wanted: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """``rows`` as templated documents: ``template`` has a ``%s`` a field, nulls are empty; ``wanted`` (a table of
    ``key``) restricts them."""
    if wanted is not None:
        rows = rows.join(wanted.select(key).distinct(), key, "left_semi")
    return rows.withColumn("content", F.format_string(template, *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))


def read_json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON object a line; blank lines are skipped, and broken ones give rows of nulls that are dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def records(spark: SparkSession, path: str, schema: str | StructType, within: str | None = None) -> DataFrame:
    """Rows of whole JSON documents; ``within`` names an array in each whose elements are the rows."""
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return docs if within is None else docs.select(*[c for c in docs.columns if c != within], F.explode(within).alias("_r")).select("*", "_r.*").drop("_r")


def datasets(spark: SparkSession, root: str) -> DataFrame:
    """Names of the folders right under ``root`` that hold Parquet files, sorted; only file names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root).select("path")
    tail = root.rstrip("/").rsplit("/", 1)[-1]
    return files.select(F.regexp_extract("path", rf"/{tail}/([^/]+)/", 1).alias("dataset")).where("dataset != ''").distinct().orderBy("dataset")


RESPONSE = "results array<struct<title:string,url:string,content:string,score:double>>, infoboxes array<struct<infobox:string,content:string>>"


def search_response(json: Column, snippet: int = 300) -> Column:
    """Rows of a metasearch answer: results (score 0.5 where there is none), then infoboxes (score 0.7)."""
    r = F.from_json(json, RESPONSE)
    found = F.transform(r["results"], lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), F.substring(x["content"], 1, snippet).alias("content"), F.coalesce(x["score"], F.lit(0.5)).alias("score")))
    boxes = F.transform(r["infoboxes"], lambda x: F.struct(x["infobox"].alias("title"), F.lit("").alias("url"), F.substring(x["content"], 1, snippet).alias("content"), F.lit(0.7).alias("score")))
    none = F.array().cast("array<struct<title:string,url:string,content:string,score:double>>")
    return F.concat(F.coalesce(found, none), F.coalesce(boxes, none))


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON objects, a line each, in text files."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
