"""Masks as one row each in a bucketed table, with area and hash computed once, at ingest.

A row holds the header, ``area``, ``mask_sha`` and ``runs``, the mask's sorted intervals (at most ``h * w / 2``).  The
table is bucketed by the mask's id, so a join by id moves only the other side: pairs, which are narrow.  Two masks on
one row are compared by a sweep over their own interval ends, with neither a window nor another shuffle.

The table is Spark's (``saveAsTable``): it lives in the warehouse or, with ``path``, in a folder that driver and
executors share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.masks import sha_of
from sightline.session import published

#: An id with at most so many pairs is never split, however small the table.
LEAST_PAIRS = 4_096


@dataclass(frozen=True)
class MaskStore:
    """A written store; reading it is planned anew each time."""

    spark: SparkSession
    name: str
    buckets: int

    def masks(self) -> DataFrame:
        return self.spark.table(self.name)

    def headers(self) -> DataFrame:
        """Headers with area and hash; intervals are not read."""
        return self.masks().drop("runs")

    def intervals(self, *columns: str) -> DataFrame:
        """``mask_id``, further header columns, and one row per interval; no shuffle."""
        return self.masks().select("mask_id", *columns, F.inline("runs"))


def write_store(
    headers: DataFrame, runs: DataFrame, name: str, path: str | None = None, buckets: int | None = None, mode: str = "errorifexists"
) -> MaskStore:
    """Write headers (``mask_id, h, w`` and further columns) and intervals (``mask_id, s, e``) as one bucketed table.

    Masks without intervals are stored with area 0; intervals without a header are not stored.  ``mode="append"`` adds
    masks to a store of the same buckets.  ``buckets``: ``spark.sql.shuffle.partitions`` if not given.
    """
    spark = headers.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = runs.groupBy("mask_id").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("runs"), F.sum(F.col("e") - F.col("s")).alias("area"))
    rows = headers.drop("area", "mask_sha", "runs").join(packed, "mask_id", "left")
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    rows = rows.withColumns({"area": F.coalesce("area", F.lit(0).cast("bigint")), "runs": F.coalesce("runs", none)})
    rows = rows.withColumn("mask_sha", sha_of(F.col("h"), F.col("w"), F.col("runs")))
    writer = rows.repartition(buckets, "mask_id").write.mode(mode).format("parquet").bucketBy(buckets, "mask_id").sortBy("mask_id")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return MaskStore(spark, name, buckets)


def common_pixels(a: Column, b: Column) -> Column:
    """Pixels that two interval lists of one row share: ends in order, with the number of open intervals of each list."""
    ends = lambda runs, da, db: F.flatten(
        F.transform(
            runs,
            lambda r: F.array(
                F.struct(r["s"].alias("pos"), F.lit(da).alias("da"), F.lit(db).alias("db")),
                F.struct(r["e"].alias("pos"), F.lit(-da).alias("da"), F.lit(-db).alias("db")),
            ),
        )
    )
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("pos"), F.lit(0).alias("a"), F.lit(0).alias("b"), zero.alias("n"))
    step = lambda acc, x: F.struct(
        x["pos"].alias("pos"),
        (acc["a"] + x["da"]).alias("a"),
        (acc["b"] + x["db"]).alias("b"),
        (acc["n"] + F.when((acc["a"] > 0) & (acc["b"] > 0), x["pos"] - acc["pos"]).otherwise(zero)).alias("n"),
    )
    return F.aggregate(F.sort_array(F.concat(ends(a, 1, 0), ends(b, 0, 1))), start, step, lambda acc: acc["n"])


def _with_mask(pairs: DataFrame, store: MaskStore, column: str, name: str, limit: int) -> DataFrame:
    """Pairs with the mask of ``column`` as struct ``name`` (null if unknown); the store's side is not shuffled.

    An id with more than ``limit`` pairs has its pairs dealt out to copies of the mask, one copy per ``limit`` pairs;
    with ``limit`` a share of all pairs, there are fewer such ids than buckets and at most twice as many copies.
    """
    masks = store.masks().select(F.col("mask_id").alias("_id"), F.struct("area", "runs").alias(name))
    counts = pairs.groupBy(F.col(column).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter((F.col("_n") > limit) & F.col("_hot").isNotNull())
    hot = published(hot.select("_hot", F.ceil(F.col("_n") / limit).cast("int").alias("_copies")))
    if hot.isEmpty():
        return pairs.join(masks, F.col(column) == F.col("_id"), "left").drop("_id")
    is_hot = F.col(column) == F.col("_hot")
    rest = pairs.join(F.broadcast(hot), is_hot, "left_anti").join(masks, F.col(column) == F.col("_id"), "left").drop("_id")
    dealt = pairs.join(F.broadcast(hot), is_hot).withColumn("_copy", F.pmod(F.xxhash64(*pairs.columns), F.col("_copies")).cast("int"))
    copies = masks.join(F.broadcast(hot), F.col("_id") == F.col("_hot")).select("_id", name, F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_nr"))
    split = dealt.join(copies, (F.col(column) == F.col("_id")) & (F.col("_copy") == F.col("_nr")), "left")
    return rest.unionByName(split.select(*pairs.columns, name))


def stored_overlap(pairs: DataFrame, store: MaskStore, least: int = LEAST_PAIRS) -> DataFrame:
    """:func:`masks.mask_overlap` of ``pairs`` (any columns with ``a_id`` and ``b_id``) over stored masks.

    Each side is one scan of the store without an exchange; areas are read, only the common pixels are counted.  An
    unknown or null id counts as an empty mask.
    """
    limit = max(least, pairs.count() // store.buckets)
    both = _with_mask(_with_mask(pairs, store, "a_id", "_a", limit), store, "b_id", "_b", limit)
    zero = F.lit(0).cast("bigint")
    counted = both.select(
        *pairs.columns,
        F.coalesce("_a.area", zero).alias("area_a"),
        F.coalesce("_b.area", zero).alias("area_b"),
        F.coalesce(common_pixels(F.col("_a.runs"), F.col("_b.runs")), zero).alias("inter"),
    )
    return counted.withColumn("union", F.col("area_a") + F.col("area_b") - F.col("inter"))
