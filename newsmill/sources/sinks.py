"""Sinks: idempotent appends, the evidence log and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_new(rows: DataFrame, path: str, keys: list[str], old: DataFrame | None = None) -> DataFrame:
    """Append the rows whose keys ``old`` (what lies at ``path``) doesn't hold, one for each key, and return them.
    Rows with a null key are always new.  Running it again over the same rows appends nothing."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    new = rows.where(known).dropDuplicates(keys).unionByName(rows.where(~known))
    if old is not None:
        new = new.join(old.select(*keys), keys, "left_anti")
    new = new.select(*rows.columns)
    new.write.mode("append").parquet(path)
    return new


def write_log(rows: DataFrame, path: str, kind: str, payload: list[str], status: Column) -> None:
    """Append evidence rows, their payload as JSON, in a folder for each kind."""
    rows.select(F.to_json(F.struct(*payload)).alias("payload"), status.alias("status"), F.col(kind).alias("artifact_type")).write.mode("append").partitionBy("artifact_type").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A small report as one JSON file; its rows should be counted before."""
    rows.coalesce(1).write.mode("overwrite").json(path)
