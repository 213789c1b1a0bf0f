"""Helpers shared by the operators: reading, keys, cutting lineage, guarded broadcast, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.session import cut_lineage, work_folder

#: A word, as the contracts of mixing and near-duplicate detection define it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rows that a side with a key per source, rule or benchmark shingle may have to be broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to an unused folder of the shared storage and read it back.

    Cuts the lineage like a checkpoint, but columnar: later steps read only the columns they need,
    and a lost executor costs a re-read, not a recomputation.
    """
    path = f"{work_folder(df.sparkSession)}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast if a count that stops after ``limit`` rows (``BROADCAST_ROWS``) proves it small.

    Beyond that Spark shuffles both sides and splits skewed partitions, with the same result.
    """
    limit = BROADCAST_ROWS if limit is None else limit
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def row_key(*cols: str) -> list[Column]:
    """Identity of a row without a unique id: the id and a hash of the text, null-safe.

    Rows that agree in both get the same results, so repeated rows may share a key.
    """
    return [F.coalesce(F.xxhash64(*cols), F.lit(0)).alias("_key")]


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of the frames is called so."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: one row per node with its smallest reachable node.

    Smallest labels travel along links to the neighbours and to the neighbours' labels, then every
    node takes its label's label, so that the number of rounds grows with the logarithm of the
    longest path.  A hub is one row on the label side of each join, so its links can be split over
    tasks.  Returns ``node, label``.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    both = saved(both)
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "label")
        near = near.groupBy("node").agg(F.min("label").alias("low"))
        met = labels.join(near, "node").select("node", "label", F.least("label", "low").alias("low"))
        told = met.select("node", "low").union(met.select(F.col("label"), F.col("low")))
        hooked = told.groupBy("node").agg(F.min("low").alias("label"))
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("over"))
        jumped = hooked.join(up, "label").select("node", F.least("label", "over").alias("label"))
        after = saved(jumped)
        old = labels.withColumnRenamed("label", "was")
        if not after.join(old, "node").filter("label <> was").limit(1).count():
            return after
        labels = after


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, everything else untouched."""
    return F.translate(c, UPPER, LOWER)


__all__ = ["BROADCAST_ROWS", "WORD", "components", "cut_lineage", "lower_ascii", "row_key", "saved", "small_side", "table", "unused"]
