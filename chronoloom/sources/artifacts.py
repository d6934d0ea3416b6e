"""Prepared data on disk: Parquet tables with a small JSON description."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


class ArtifactError(ValueError):
    """Prepared data that is absent or does not fit what is asked for."""


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_meta(spark: SparkSession, root: str, meta: dict) -> None:
    """One small JSON row, by Spark, so that any file system will do."""
    text = json.dumps({"version": VERSION, **meta}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/meta")


def read_meta(spark: SparkSession, root: str) -> dict:
    try:
        rows = spark.read.text(f"{root}/meta").collect()
    except Exception as e:
        raise ArtifactError(f"no description under {root}: run prepare first") from e
    return json.loads(rows[0]["value"])


def validated(spark: SparkSession, root: str, mode: str | None = None, parts: int | None = None, tables: tuple[str, ...] = ()) -> dict:
    """The description, if its version, mode, number of parts and tables fit."""
    meta = read_meta(spark, root)
    if meta.get("version") != VERSION:
        raise ArtifactError(f"version {meta.get('version')} found, {VERSION} needed")
    if mode is not None and meta.get("mode") != mode:
        raise ArtifactError(f"prepared for mode {meta.get('mode')}, not {mode}")
    if parts is not None and meta.get("parts") != parts:
        raise ArtifactError(f"prepared for {meta.get('parts')} parts, not {parts}")
    for table in tables:
        if table not in meta.get("tables", []):
            raise ArtifactError(f"the table {table} was not prepared")
    return meta


def read_artifact(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}")


def write_edge_lines(edges: DataFrame, path: str) -> None:
    """Lines "src dst ts"."""
    edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("ts").cast("string")).alias("value")).write.mode("overwrite").text(path)


def save_checkpoint(root: str, **tables: DataFrame) -> None:
    """State and weights as tables under one folder."""
    for name, df in tables.items():
        write_table(df, f"{root}/{name}")


def load_checkpoint(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}
