"""Grouped counts, numeric summaries, percentiles, segments and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def group_counts(df: DataFrame, column: str, default: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(default)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def length_statistics(df: DataFrame, column: str) -> DataFrame:
    n = F.length(column)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))


def top_groups(df: DataFrame, keys: list[Column], id_: str, limit: int = 10, samples: int = 5) -> DataFrame:
    """The largest groups with their first ids; samples are ranked for the largest groups only."""
    from orrery.operators.dedup import top_duplicates

    joined = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return top_duplicates(df, joined, id_, limit, samples)


def unpivot(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """A row (ids, metric, value) for each number; booleans count as 0 and 1, null and NaN are left out."""
    long = df.select(*ids, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select(*ids, "m.*")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def summary(value: str = "value") -> list[Column]:
    """mean, population deviation, median, extremes, count and the 95 % interval of the mean."""
    margin = F.when(F.count(value) > 1, Z95 * F.stddev_samp(value) / F.sqrt(F.count(value))).otherwise(F.lit(0.0))
    return [
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.count(value).alias("count"), (F.avg(value) - margin).alias("ci_low"), (F.avg(value) + margin).alias("ci_high"),
    ]


def metric_summary(df: DataFrame, metrics: list[str], by: list[str] = ()) -> DataFrame:
    return unpivot(df, list(by), metrics).groupBy(*by, "metric").agg(*summary())


def percentiles_linear(df: DataFrame, value: str, at: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[F.percentile(F.col(value).cast("double"), F.lit(p)).alias(f"p{round(100 * p)}") for p in at])


def percentiles_nearest(df: DataFrame, value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99), by: list[str] = ()) -> DataFrame:
    """The value of rank ceil(n * p)."""
    return df.groupBy(*by).agg(*[F.expr(f"percentile_disc({p}) within group (order by cast({value} as double))").alias(f"p{round(100 * p)}") for p in at])


def sequence_length(df: DataFrame, length: str, low: int = 128, high: int = 8192, share: float = 0.99) -> DataFrame:
    """The power of two at or above the nearest-rank percentile, within bounds."""
    p = df.agg(F.expr(f"percentile_disc({share}) within group (order by cast({length} as double))").alias("p"))
    power = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("p"), F.lit(1.0)))))
    return p.select(F.col("p").alias("p99"), F.least(F.greatest(power, F.lit(float(low))), F.lit(float(high))).cast("long").alias("sequence_length"))


def shares(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    return df.agg(*[F.avg(F.when(c, 1.0).otherwise(0.0)).alias(n) for n, c in conditions.items()])


def members(df: DataFrame, fields: dict[str, Column], keep: list[str]) -> DataFrame:
    """A row for each field and distinct value of a row; ``fields`` are strings or arrays of strings."""
    values = [F.struct(F.lit(n).alias("field"), c.alias("values")) for n, c in fields.items()]
    return df.select(*keep, F.explode(F.array(*values)).alias("f")).select(*keep, "f.field", F.explode(F.array_distinct("f.values")).alias("value"))


def as_values(c: Column, default: str = "unknown") -> Column:
    """A single value as an array."""
    return F.array(F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(default)))


def segment_metrics(df: DataFrame, fields: dict[str, Column], metrics: list[str], id_: str) -> DataFrame:
    """Summary of each metric for each value of each field; a row counts once for each distinct value."""
    long = members(df, fields, [id_, *metrics])
    renamed = long.withColumnRenamed("value", "segment")
    return unpivot(renamed, ["field", "segment"], metrics).groupBy("field", "segment", "metric").agg(*summary())


def coverage(df: DataFrame, split: Column, fields: dict[str, Column]) -> DataFrame:
    """Counts by split, field and value, with ``holdout`` (val and test) and ``total``, from one grouping."""
    long = members(df.withColumn("_split", split), fields, ["_split"])
    counts = long.groupBy("_split", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    n = lambda *names: F.coalesce(F.sum(F.when(F.col("_split").isin(*names), F.col("n"))), F.lit(0)).cast("long")
    return counts.groupBy("field", "value").agg(
        n("train").alias("train"), n("val").alias("val"), n("test").alias("test"), n("val", "test").alias("holdout"), F.sum("n").cast("long").alias("total")
    )


def coverage_violations(covered: DataFrame, least: int) -> DataFrame:
    """Values that val or test holds fewer than ``least`` of, where the total is at least three times that."""
    rows = covered.where(F.col("total") >= 3 * least).select("field", "value", "total", F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("n")) for s in ("val", "test")])).alias("s"))
    return rows.select("field", "value", "total", "s.split", "s.n").where(F.col("n") < least)


def prompt_diagnostics(df: DataFrame, truncated: Column, strategy: Column, sizes: list[str]) -> DataFrame:
    """Truncation rate and percentiles of sizes by strategy."""
    out = df.withColumn("_t", truncated).groupBy(strategy.alias("strategy")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col("_t").cast("double")).alias("truncation_rate"),
        *[F.percentile(F.col(s).cast("double"), F.lit(p)).alias(f"{s}_p{round(100 * p)}") for s in sizes for p in (0.5, 0.9, 0.95, 0.99)],
    )
    return out
