"""Tables that grow by one folder per micro-batch and are read in few.

A batch writes only its own rows.  Every ``FAN`` folders of a level are merged into one of the next, as digits carry
over, so a row is written once per level, and the state after ``n`` batches is read from fewer than ``FAN`` folders a
level.  Which folders these are follows from the number of the batch alone: a replayed batch writes the same ones again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FAN = 8
Folder = tuple[int, int]  # level, last batch


def cover(upto: int) -> list[Folder]:
    """The folders that hold batches ``0`` to ``upto - 1``, each batch once."""
    out, at, level = [], 0, 0
    while FAN ** (level + 1) <= upto:
        level += 1
    for step in range(level, -1, -1):
        for _ in range((upto - at) // FAN**step):
            at += FAN**step
            out.append((step, at - 1))
    return out


def read_folders(spark: SparkSession, path: str, folders: Sequence[Folder]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/level={level}/batch={batch}" for level, batch in folders])


def append_batch(rows: DataFrame, path: str, batch: int, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Write the rows of a batch, and merge the levels that it fills."""
    spark, level = rows.sparkSession, 0
    rows.write.mode("overwrite").parquet(f"{path}/level=0/batch={batch}")
    while (batch + 1) % FAN ** (level + 1) == 0:
        parts = [(level, batch - i * FAN**level) for i in range(FAN)]
        level += 1
        merge(read_folders(spark, path, parts)).write.mode("overwrite").parquet(f"{path}/level={level}/batch={batch}")


def newest(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of the highest version per key; a key has one row per folder read."""
    back = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_back", F.row_number().over(back)).filter("_back = 1").drop("_back")


def folders(spark: SparkSession, path: str) -> set[Folder]:
    """All folders with files."""
    names = (re.search(r"/level=(\d+)/batch=(\d+)/[^/]*$", f) for f in spark.read.parquet(path).inputFiles())
    return {(int(n[1]), int(n[2])) for n in names if n}


def _last(present: set[Folder]) -> int:
    return max((batch for level, batch in present if level == 0), default=-1)


def current_folders(present: set[Folder]) -> list[Folder]:
    """Folders of the present state; a merged one is used once a later batch shows that it is complete."""
    out, at, last = [], 0, _last(present)
    while at <= last:
        ends = [(level, at + FAN**level - 1) for level in {level for level, _ in present} if at % FAN**level == 0]
        usable = [f for f in ends if f in present and (f[0] == 0 or f[1] < last)]
        if usable:
            out.append(max(usable))
        at += FAN ** max(usable)[0] if usable else 1  # a folder without files has no rows
    return out


def drop_superseded(spark: SparkSession, path: str) -> list[Folder]:
    """Delete the folders whose rows are in a merged one that is complete, and name them.  Run it when nobody reads."""
    present = folders(spark, path)
    merged = [(level, batch) for level, batch in present if level > 0 and batch < _last(present)]
    inside = lambda f: any(m[0] > f[0] and m[1] - FAN ** m[0] < f[1] <= m[1] for m in merged)
    old, hadoop = sorted(filter(inside, present)), spark.sparkContext._jvm.org.apache.hadoop.fs
    for level, batch in old:
        folder = hadoop.Path(f"{path}/level={level}/batch={batch}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return old
