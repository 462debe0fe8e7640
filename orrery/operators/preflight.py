"""Preflight of datasets of JSON lines before training: errors by line, their counts, and the longest rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import validation
from orrery.functions.text import let, word_count

# Messages of the errors that the schema doesn't know.
SAID = {"json_parse_error": "Invalid JSON", "row_type_error": "Each JSONL row must be an object.", "metadata_type_error": "Field 'metadata' must be an object when present."}


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files; lines are numbered from 1 in each file.

    A split of a file is read in order, so a line's number is its place in the split after all lines of the splits before.
    Only one row for each split is ranked.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    splits = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.join(splits, ["file", "start"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def checked(lines: DataFrame, most: int, allow_legacy: bool = False, tokens: Callable[[Column], Column] | None = word_count, keep: tuple[str, ...] = (), strict_context: bool = True) -> DataFrame:
    """``keep``, line, blank, errors (code, message), valid, context and target of ``lines`` (line, value).

    A row with errors has no lengths. ``tokens`` counts the tokens of a column of texts.
    """
    blank = ~F.coalesce(F.col("value"), F.lit("")).rlike(r"(?U)\S")
    found = let(validation.parsed(F.trim("value")), lambda v: F.struct(_errors(v, allow_legacy).alias("errors"), _length(v, "input", tokens).alias("context"), _length(v, "output", tokens).alias("target")))

    def judged(x: Column) -> Column:
        valid = F.size(x["errors"]) == 0
        return F.struct(x["errors"].alias("errors"), valid.alias("valid"), F.when(valid, x["context"]).alias("context"), F.when(valid, x["target"]).alias("target"))

    def lengths(x: Column) -> Column:
        target, total = x["target"], x["context"] + x["target"]
        over = [
            F.when(target >= most, F.struct(F.lit("target_overlength").alias("code"), F.format_string("Target token length %d is >= max_seq_length %d.", target, F.lit(most)).alias("message"))),
            F.when((total > most) & F.lit(strict_context), F.struct(F.lit("context_overlength").alias("code"), F.format_string("Prompt token length %d exceeds max_seq_length %d.", total, F.lit(most)).alias("message"))),
        ]
        return F.struct(F.concat(x["errors"], F.filter(F.array(*over), lambda e: e.isNotNull())).alias("errors"), x["valid"].alias("valid"), x["context"].alias("context"), target.alias("target"))

    row = lines.select(*keep, "line", blank.alias("blank"), F.when(~blank, let(let(found, judged), lengths)).alias("x"))
    none = F.array().cast("array<struct<code:string,message:string>>")
    return row.select(*keep, "line", "blank", F.coalesce("x.errors", none).alias("errors"), F.coalesce("x.valid", F.lit(False)).alias("valid"), "x.context", "x.target")


def _length(v: Column, field: str, tokens: Callable[[Column], Column]) -> Column:
    return tokens(F.try_variant_get(v, f"$.{field}", "string")).cast("long")


def _errors(v: Column, allow_legacy: bool) -> Column:
    fault = lambda when, code, said: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(said).alias("message")))
    one = lambda code: F.array(F.struct(F.lit(code).alias("code"), F.lit(SAID[code]).alias("message")))

    def string(f: str) -> Column:
        def said(p: Column) -> Column:
            k = validation.kind(p)
            faults = F.array(
                fault(p.isNull(), f"missing_{f}", f"Missing required field: {f}"), fault(p.isNotNull() & (k != "string"), f"{f}_type_error", f"Field '{f}' must be a string."),
                fault((k == "string") & ~F.try_variant_get(p, "$", "string").rlike(r"(?U)\S"), f"empty_{f}", f"Field '{f}' must not be empty."),
            )
            return F.filter(faults, lambda e: e.isNotNull())

        return let(validation.part(v, f"$.{f}"), said)

    def deep(given: Column) -> Column:
        errors = F.transform(validation.metadata_errors(given, allow_legacy), lambda e: F.struct(e["code"].alias("code"), F.concat_ws(": ", e["field"], e["message"]).alias("message")))
        return F.when(validation.kind(given) == "object", errors).otherwise(one("metadata_type_error"))

    meta = let(validation.part(v, "$.metadata"), lambda m: F.when(m.isNull() | (validation.kind(m) == "null"), F.parse_json(F.lit("{}"))).otherwise(m))
    all_ = F.concat(string("input"), string("output"), let(meta, deep))
    return F.when(v.isNull(), one("json_parse_error")).when(validation.kind(v) != "object", one("row_type_error")).otherwise(all_)


def error_counts(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How often each code occurs; the counts combine before they are shuffled."""
    return rows.select(*by, F.explode("errors").alias("e")).groupBy(*by, F.col("e.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def first_errors(rows: DataFrame, most: int = 50) -> DataFrame:
    """line, code and message of the first errors, in order: the feature is the bound."""
    found = rows.select("line", F.posexplode("errors").alias("at", "e"))
    return found.orderBy("line", "at").limit(most).select("line", F.col("e.code").alias("code"), F.col("e.message").alias("message"))


def summary(rows: DataFrame, most: int, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each of ``by``: counts, the longest rows, and whether any error was found."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    top = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long")
    total = F.col("context") + F.col("target")
    return rows.groupBy(*by).agg(
        F.when(F.sum(F.size("errors")) > 0, "failed").otherwise("passed").alias("status"), count(~F.col("blank")).alias("row_count"), count(F.col("valid")).alias("valid_row_count"),
        count(F.col("blank")).alias("blank_line_count"), top("context").alias("max_context_tokens"), top("target").alias("max_target_tokens"), top(total).alias("max_total_tokens"),
        count(F.col("target") >= most).alias("target_overlength_count"), count(total > most).alias("context_overlength_count"),
    )


def over_datasets(datasets: dict[str, DataFrame], most: int, tokens: Callable[[Column], Column] | None = word_count, allow_legacy: bool = False) -> DataFrame:
    """``summary`` of each named dataset (line, value) in one pass. Without a way to count tokens all datasets fail."""
    if not datasets:
        raise ValueError("no datasets")
    tagged = [df.select(F.lit(name).alias("dataset"), "line", "value") for name, df in datasets.items()]
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.unionByName(more)
    if tokens is None:
        return rows.groupBy("dataset").agg(F.lit("failed").alias("status"), F.lit("tokenizer_unavailable").alias("error"))
    return summary(checked(rows, most, allow_legacy, tokens, keep=("dataset",)), most, ("dataset",))
