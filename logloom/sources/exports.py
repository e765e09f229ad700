"""Query results as files for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame


def to_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled and line breaks inside fields are kept."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def to_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, with NULL fields written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
