"""Readers and writers: Parquet, JSON lines with line errors, suites, runs, datasets with rejects and manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A training row.
TRAINING_ROW = "input string, output string, metadata map<string,string>"


def read_json_lines(spark: SparkSession, path: str, schema: str = TRAINING_ROW) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, and ``corrupt`` holds lines that are no object of the schema."""
    return spark.read.schema(f"{schema}, corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)


def count_json_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count()


def read_suites(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of ``*.jsonl`` suites with ``suite`` from the row, its metadata or the file's name."""
    raw = spark.read.text(pattern).select("value", F.input_file_name().alias("file")).where(F.trim("value") != "")
    at = lambda p: F.get_json_object("value", p)
    stem = F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)
    return raw.select(F.coalesce(at("$.suite"), at("$.benchmark_suite"), at("$.metadata.benchmark_suite"), stem).alias("suite"), at("$.case_id").alias("case_id"), "value")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """Details of an evaluation run: a row for each, as JSON, under either of the names that runs use."""
    whole = spark.read.text(path, wholetext=True)
    rows = F.coalesce(F.get_json_object("value", "$.details"), F.get_json_object("value", "$.detailed_results"), F.lit("[]"))
    items = F.from_json(rows, "array<string>")
    return whole.select(F.explode(items).alias("detail")).select(F.get_json_object("detail", "$.dataset_index").cast("long").alias("dataset_index"), F.get_json_object("detail", "$.metrics").alias("metrics"), "detail")


def read_sqlite(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table over JDBC; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_dataset(df: DataFrame, path: str, accepted: Column, kind: str = "json", rejects: bool = True) -> dict:
    """Accepted rows under ``path``/accepted as json, csv or parquet, the others under ``path``/rejects as JSON.

    Nested columns become JSON in csv. Gives the counts, which a manifest takes.
    """
    tagged = df.withColumn("_ok", F.coalesce(accepted, F.lit(False)))
    good = tagged.where("_ok").drop("_ok")
    if kind == "csv":
        good = good.select(*[F.to_json(c).alias(c) if k.startswith(("struct", "array", "map")) else F.col(c) for c, k in good.dtypes])
    writer = good.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(f"{path}/accepted")
    if rejects:
        tagged.where("not _ok").drop("_ok").write.mode("overwrite").json(f"{path}/rejects")
    counts = tagged.groupBy("_ok").agg(F.count(F.lit(1)).alias("n")).collect()  # two rows
    return {"accepted": sum(r["n"] for r in counts if r["_ok"]), "rejected": sum(r["n"] for r in counts if not r["_ok"]), "format": kind}


def write_slices(df: DataFrame, path: str, column: str = "slice") -> None:
    df.write.mode("overwrite").partitionBy(column).json(path)


def content_digest(df: DataFrame) -> str:
    """Of a table's rows in any order: count and sum of row hashes, from one aggregate."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[F.to_json(F.struct(c)) for c in df.columns]).cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(f"{r['n']}:{r['h']}".encode()).hexdigest()


def write_manifest(spark: SparkSession, path: str, **entries) -> None:
    """One JSON object, with sorted keys, in a text folder."""
    spark.createDataFrame([(json.dumps(entries, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def reusable(spark: SparkSession, path: str, **wanted) -> bool:
    """Whether a manifest is there and has the wanted entries."""
    try:
        have = read_manifest(spark, path)
    except Exception:  # no such folder, or no JSON: nothing to reuse
        return False
    return all(have.get(k) == v for k, v in wanted.items())
