"""Data sources: everything becomes a DataFrame with reserved columns for unit, time and environment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce as fold

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causelake.errors import DataError
from causelake.functions.transforms import normal
from causelake.schema import ENVIRONMENT, TIME, UNIT


def ingest(spark: SparkSession, data) -> DataFrame:
    """A DataFrame as it is, a table by name, a Parquet path, an Arrow table, pandas, or a mapping of columns."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, str):
        return spark.read.parquet(data) if "/" in data else spark.table(data)
    if isinstance(data, Mapping):
        import pandas as pd

        if len({len(v) for v in data.values()}) > 1:
            raise DataError("columns differ in length")
        data = pd.DataFrame({k: list(v) for k, v in data.items()})
    return spark.createDataFrame(data)


def time_series(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn(TIME, F.col(time))


def panel(df: DataFrame, unit: str, time: str) -> DataFrame:
    return df.withColumn(UNIT, F.col(unit)).withColumn(TIME, F.col(time))


def environments(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Frames of one schema stacked, each with its environment's name."""
    schemas = {tuple(sorted(f.dtypes)) for f in frames.values()}
    if len(schemas) != 1:
        raise DataError("environments must share one schema")
    return fold(DataFrame.unionByName, [f.withColumn(ENVIRONMENT, F.lit(k)) for k, f in frames.items()])


def network(units: DataFrame, edges: DataFrame, unit: str = "unit") -> tuple[DataFrame, DataFrame]:
    """Units and directed weighted edges; an edge of an unknown unit, a loop or a repeated unit is refused."""
    ids = units.select(F.col(unit).alias("__u"))
    if units.groupBy(unit).count().where("count > 1").limit(1).count():
        raise DataError("a unit is listed twice")
    for end in ("src", "dst"):
        if edges.join(ids, F.col(end) == F.col("__u"), "left_anti").limit(1).count():
            raise DataError(f"an edge's {end} is no unit")
    if edges.where("src = dst").limit(1).count():
        raise DataError("a unit has an edge with itself")
    return units, edges if "w" in edges.columns else edges.withColumn("w", F.lit(1.0))


def simulate_lagged(spark: SparkSession, n: int, coefficient: float, lag: int, noise: float, seed: int = 0) -> DataFrame:
    """y_t = coefficient * x_{t - lag} + noise, with x white noise."""
    x = spark.range(n).select(F.col("id").alias("t"), normal(seed, "x", "id").alias("x"))
    before = F.lag("x", lag, 0.0).over(Window.partitionBy().orderBy("t"))
    return x.select("t", "x", (F.lit(coefficient) * before + F.lit(noise) * normal(seed, "y", "t")).alias("y"))


def dummies(df: DataFrame, column: str, levels: Sequence) -> DataFrame:
    return df.select("*", *[(F.col(column) == F.lit(v)).cast("double").alias(f"{column}[{v}]") for v in levels])
