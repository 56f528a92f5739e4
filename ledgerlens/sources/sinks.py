"""Sinks (SNK-1): CSV without an index column, overwriting."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> str:
    if df is None:
        raise ValueError("No processed data to save")
    # quotes are doubled inside quotes, as the reader (and pandas) expects
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path
