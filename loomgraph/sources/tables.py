"""Columnar table source: one Parquet file or directory per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """Read a table; naming columns keeps the scan's ReadSchema to them and shields operators from extra columns."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df
