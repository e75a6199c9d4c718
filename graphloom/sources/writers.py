"""Sinks: distributed writes of every result the engine reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_predictions(items: DataFrame, path: str) -> None:
    """Scored items with their gold and predicted triples, as JSON lines."""
    items.write.mode("overwrite").json(path)


def write_summary(scores: DataFrame, path: str) -> None:
    """One line for each score column, four decimals."""
    row = scores.select([F.concat(F.lit(f"{c}: "), F.format_string("%.4f", F.col(c).cast("double")) if t in ("double", "float") else F.col(c).cast("string")).alias(c) for c, t in scores.dtypes])
    row.select(F.array_join(F.array(*row.columns), "\n").alias("value")).write.mode("overwrite").text(path)


def write_judgements(memo: DataFrame, path: str) -> None:
    memo.write.mode("overwrite").json(path)


def write_timings(timings: DataFrame, path: str) -> None:
    """CSV with six decimals; NaN and null are blank."""
    s = F.when(F.col("seconds").isNull() | F.isnan("seconds"), None).otherwise(F.format_string("%.6f", "seconds"))
    timings.select("algorithm", "N", s.alias("seconds")).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_timing_json(timings: DataFrame, path: str) -> None:
    timings.write.mode("overwrite").json(path)


def elo_table(elo: DataFrame) -> DataFrame:
    """A row for each (k, method), a column for each metric and the average, best first."""
    wide = elo.groupBy("k", "method").pivot("metric").agg(F.round(F.first("elo"), 2))
    return wide.join(elo.groupBy("k", "method").agg(F.round(F.avg("elo"), 2).alias("average")), ["k", "method"]).orderBy("k", F.desc("average"), "method")


def timing_table(timings: DataFrame) -> DataFrame:
    """A row for each algorithm, a column for each N."""
    return timings.groupBy("algorithm").pivot("N").agg(F.first("seconds")).orderBy("algorithm")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
