"""Sinks and resume.  Executors write; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def exclude(df: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not on the list."""
    return df.join(listed.select(*keys), list(keys), "left_anti")


def pending(wanted: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Resume: wanted rows that have no output yet."""
    return exclude(wanted, existing, keys)


def write_relations(df: DataFrame, path: str, fmt: str = "parquet", key: str = "pair_id") -> None:
    """One folder per direction, rows in key order inside each file.

    Range partitioning on (direction, key) spreads a dominant direction over many files.
    """
    rows = df.repartitionByRange("direction", key).sortWithinPartitions("direction", key)
    rows.write.mode("errorifexists").partitionBy("direction").format(fmt).save(path)


def write_sample_index(df: DataFrame, path: str, columns: Sequence[str], shard: str = "shard") -> None:
    """Scalar index columns only, one row per sample, partitioned by shard."""
    nested = [f.name for f in df.schema if f.name in columns and f.dataType.typeName() in ("array", "map", "struct")]
    if nested:
        raise ValueError(f"index columns must be scalar: {nested}")
    df.select(shard, *[c for c in columns if c != shard]).write.mode("errorifexists").partitionBy(shard).parquet(path)


def write_manifest(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Manifest as JSON lines or as a tab-separated comparison table."""
    writer = df.write.mode("errorifexists")
    if fmt == "tsv":
        writer.option("header", True).option("sep", "\t").csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown manifest format {fmt!r}")
