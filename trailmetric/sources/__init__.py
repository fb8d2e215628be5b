"""Scans and sinks of JSON collections and Parquet tables, with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of one array each, or of one record to a line (``.jsonl``)."""
    return spark.read.schema(schema).option("multiLine", not path.endswith("l")).json(path)


def read_wrapped(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """Files that hold an array under ``field`` beside their metadata, or just the array."""
    item = f"struct<{schema}>"
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", f"{field} array<{item}>")
    rows = F.coalesce(parsed[field], F.from_json("value", f"array<{item}>"))
    return whole.select(F.inline(rows))


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


#: Fixed value: format of exported units.
FORMAT_VERSION = "1.0"


def export_units(units: DataFrame, path: str, by: str | None = "benchmark") -> None:
    """Units as JSON records under ``path/units``, a folder for each value of ``by`` (null: 'unknown'), beside headers under ``path/metadata``.

    A header has exported_at, total_units and format_version and, with ``by``, its value and unit_count. Records stay in as many
    files as they have partitions, so no task writes a whole benchmark; without units there is one header, or none with ``by``.
    """
    if by is not None:
        units = units.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("unknown")))
    write_json(units, f"{path}/units", [by] if by is not None else None)
    whole = units.agg(F.count(F.lit(1)).alias("total_units"))
    head = whole if by is None else units.groupBy(by).agg(F.count(F.lit(1)).alias("unit_count")).crossJoin(whole)  # by one row
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    write_json(head.select(stamp.alias("exported_at"), "*", F.lit(FORMAT_VERSION).alias("format_version")).coalesce(1), f"{path}/metadata")


def read_units(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Units written by ``export_units``."""
    return spark.read.schema(schema).json(f"{path}/units")


def write_csv(df: DataFrame, path: str) -> None:
    """A report: one file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def export(df: DataFrame, condition: Column | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """A filtered part of a collection; a limit needs an order."""
    out = df if condition is None else df.filter(condition)
    return out if limit is None else out.orderBy(*(order or [])).limit(limit)


def status(collections: dict[str, DataFrame], experiment: str | None = None) -> DataFrame:
    """collection and number of records, of one experiment or all."""
    parts = []
    for name, df in collections.items():
        rows = df.filter(F.col("experiment_id") == experiment) if experiment and "experiment_id" in df.columns else df
        parts.append(rows.agg(F.lit(name).alias("collection"), F.count(F.lit(1)).alias("n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


STORAGE_FIELDS = ("_id", "stored_at", "updated_at", "version_tag")


def without_storage(df: DataFrame) -> DataFrame:
    return df.drop(*STORAGE_FIELDS)


def write_manifest(sample: DataFrame, rejections: DataFrame, path: str, dims: list[str], seed: int) -> None:
    """A sample's manifest: one record of totals and seed, counts by dimension, and the rejection log."""
    from ..operators.metrics import distribution

    write_json(sample.agg(F.count(F.lit(1)).alias("total"), F.lit(seed).alias("random_seed")).coalesce(1), f"{path}/manifest")
    write_json(distribution(sample, dims).coalesce(1), f"{path}/counts")
    write_json(rejections, f"{path}/rejections")
