"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str, date: str = "session_date", mode: str = "overwrite") -> None:
    """Parquet partitioned by year, so date filters prune directories."""
    years = df.withColumn("year", F.year(date))
    years.write.mode(mode).partitionBy("year").parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False, mode: str = "overwrite") -> None:
    """CSV with a header; ``one_file`` is for report tables of a few rows."""
    out = df.coalesce(1) if one_file else df
    out.write.mode(mode).option("header", True).csv(path)


def write_reports(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One folder per report table (metrics, importances, confusion, utility cells)."""
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}", one_file=True, mode=mode)
