"""Unions of directions, holdouts, balancing and seeded sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.functions.stable import seeded, seeded_int
from sightline.operators.ordered import ordered_scan


def joint_union(a: DataFrame, b: DataFrame, names: tuple[str, str], column: str = "direction") -> DataFrame:
    return a.withColumn(column, F.lit(names[0])).unionByName(b.withColumn(column, F.lit(names[1])))


def mix_ratio(joint: DataFrame, column: str = "direction") -> DataFrame:
    """Rows per direction and the probability that a uniform draw hits it."""
    counts = joint.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy(F.lit(0)))  # one row per direction
    return counts.withColumn("probability", F.try_divide(F.col("rows"), total))


def balance(joint: DataFrame, keys: Sequence[str], seed: int = 0, column: str = "direction", portable: bool = False) -> DataFrame:
    """Repeat the shorter directions until each has as many rows as the longest.

    Every row is repeated ``n div size`` times; the remainder goes to the rows first in seeded
    order, found by a bucketed ordinal, so no direction is sorted in one task.
    """
    counts = joint.groupBy(column).agg(F.count(F.lit(1)).alias("_size"))
    counts = counts.withColumn("_n", F.max("_size").over(Window.partitionBy(F.lit(0))))
    rows = joint.withColumn("_o", seeded(*keys, seed=seed, portable=portable))
    rows = ordered_scan(rows, ["_o", *keys], [column], ordinal="_pos").join(counts, column)
    times = F.floor(F.col("_n") / F.col("_size")) + (F.col("_pos") < F.col("_n") % F.col("_size")).cast("bigint")
    return rows.select(*joint.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), times)).alias("copy"))


def subset(df: DataFrame, keys: Sequence[str], one_in: int = 20, seed: int = 0, portable: bool = False) -> DataFrame:
    """About one row in ``one_in``, chosen by key; a sampling operator, no shuffle."""
    return df.filter(seeded_int(*keys, seed=seed, portable=portable) % one_in == 0)


def group_holdout(df: DataFrame, group: str, target: int, seed: int = 0, portable: bool = False) -> DataFrame:
    """Hold out whole groups, in seeded order, until at least ``target`` rows are held out.

    Returns the groups with their size and ``held_out``.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("_o", seeded(group, seed=seed, portable=portable))
    rows = ordered_scan(sizes, ["_o", group], running_sum={"_upto": "size"})
    return rows.select(group, "size", (F.col("_upto") - F.col("size") < target).alias("held_out"))


def sample_objects(
    df: DataFrame, record: Sequence[str], obj: str, n: int, replace: bool, seed: int = 0, portable: bool = False
) -> DataFrame:
    """``n`` objects per record, with or without replacement.

    Without: the first ``n`` in seeded order (a row-number limit that also runs map-side).
    With: ``n`` draws of a position; a draw meets its object on (record, position).
    """
    rows = df.select(*record, obj).distinct().withColumn("_o", seeded(*record, obj, seed=seed, portable=portable))
    if not replace:
        w = Window.partitionBy(*record).orderBy("_o", obj)
        picked = rows.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= n)
        return picked.select(*record, obj, (F.col("draw") - 1).cast("bigint").alias("draw"))
    placed = ordered_scan(rows, ["_o", obj], record, ordinal="_pos")
    sizes = rows.groupBy(*record).agg(F.count(F.lit(1)).alias("_k"))
    draws = sizes.select(*record, "_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    draws = draws.withColumn("_pos", seeded_int(*record, "draw", seed=seed + 1, portable=portable) % F.col("_k"))
    out = draws.join(placed, [*record, "_pos"])
    return out.select(*record, obj, F.col("draw").cast("bigint").alias("draw"))


def mismatch_partner(df: DataFrame, obj: str, frame: str, seed: int = 0, portable: bool = False) -> DataFrame:
    """For each (object, frame) one other frame of the same object; null when there is none.

    Frames of an object are put in seeded order and each takes the next one, the last taking
    the first: never itself, every frame used once, and no frame is compared with all others.
    """
    rows = df.select(obj, frame).distinct().withColumn("_o", seeded(obj, frame, seed=seed, portable=portable))
    scan = ordered_scan(rows, ["_o", frame], [obj], following={"_next": frame}, first_of={"_first": frame})
    other = F.coalesce("_next", F.when(F.col("_first") != F.col(frame), F.col("_first")))
    return scan.select(obj, frame, other.alias("partner"))


def smoke_subset(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows in canonical order: each task keeps ``n`` rows, then they are merged."""
    return df.orderBy(*keys).limit(n)


def contained(part: DataFrame, whole: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``part`` that ``whole`` lacks; empty when it is a true subset."""
    return part.select(*keys).join(whole.select(*keys), list(keys), "left_anti")


def shared_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present in both splits; empty when they are disjoint."""
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_semi")


def reverse_overlap(evaluation: DataFrame, train: DataFrame, source: str, target: str, obj: str) -> DataFrame:
    """Evaluation rows whose swapped (source, target) appears in training, counted with their share."""
    swapped = train.select(F.col(target).alias(source), F.col(source).alias(target), obj).distinct()
    rows = evaluation.join(swapped.withColumn("_r", F.lit(True)), [source, target, obj], "left")
    out = rows.agg(F.count(F.lit(1)).alias("rows"), F.count("_r").alias("reversed"))
    return out.withColumn("share", F.try_divide(F.col("reversed"), F.col("rows")))
