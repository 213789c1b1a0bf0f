"""Mixing sources to target weights (native).

Every document gets a hash-random key.  Within a source the keys are range-sorted: the leading hex
digits of the key are the range, and as keys are uniform the ranges are equally full without a
sample, also for a source with a third of all rows.  Sums per (source, range), a running total over
the ranges, and a running total of the documents inside the one range that the budget falls into
cut every source at its exact budget; whole epochs are repeated before the cut.

Only narrow rows (id, source, size, key) move, and of the documents only those of one range per
source are ever sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.common import WORD, saved, small_side

WEIGHTS = (5.0, 2.0, 1.0)
ROWS_PER_RANGE = 4_096


def word_count(text: Column) -> Column:
    """Number of words in a text; null has none.

    Every word is replaced, with the white space around it, by one letter, so the letters left are the
    words and no string per word is made.
    """
    gap = r"[\x20\x09-\x0D]*"
    letters = F.length(F.regexp_replace(text, f"{gap}{WORD}{gap}", "w"))
    return F.when(F.rlike(text, F.lit(WORD)), letters).otherwise(0).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, repeat: float = 2.0) -> DataFrame:
    """Target words per source, from ``source, source_size`` (one row per source).

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all
    words.  No target exceeds ``repeat`` times its source; the excess goes to the others by weight
    until none is above.  That fixed point is found at once: by ascending room per weight, sources
    are full up to the first whose room suffices for the remaining share.

    The windows run over one row per source, never over documents.
    """
    alone = Window.partitionBy(F.lit(0))
    at = F.row_number().over(alone.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    room = F.col("source_size") * F.lit(float(repeat))
    rows = sources.withColumns({"weight": weight, "room": room})
    by_room = alone.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("room").over(before), F.lit(0.0))
    left = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(alone) * F.lit(float(share)) - full) / left)
    # the level at the first source that is not filled; among equal rooms per weight the first has the highest
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("room"), F.struct(F.col("room") / F.col("weight"), (-F.col("level")).alias("down"))))
    rows = rows.withColumn("water", -open_level.over(alone)["down"])
    target = F.coalesce(F.least("room", F.col("water") * F.col("weight")), F.col("room"))
    return rows.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    repeat: float = 2.0,
    seed: int = 0,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs`` needs ``doc_id, text, source``.  Returns ``doc_id, source, size, source_size, target,
    taken, epochs``: ``taken`` counts repeats, ``epochs`` is the number of whole copies; the document
    on the budget gives the words that are left of it, so a source's ``taken`` sum is its target
    rounded down.

    Null text has no words; null source is a source of its own, the last.  Rows without an id have the
    key of their text, so that any number of them spread over the ranges; repeated rows have equal keys
    and are ordered by size.  Empty table: empty result.
    """
    of_text = F.concat(F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), of_text))).alias("key")
    rows = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key))
    n = rows.count()
    digits = min(32, max(1, math.ceil(math.log(max(1, n / rows_per_range), 16))))
    rows = rows.withColumn("range", F.substring("key", 1, digits))

    ranges = saved(rows.groupBy("source", "range").agg(F.sum("size").alias("words")))
    sources = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(sources, weights, share, repeat)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", epochs)
    plan = plan.withColumn("rest", F.floor("target").cast("long") - F.col("whole") * F.col("source_size"))

    # the range in which a source's rest ends, with the words before it
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    run = ranges.withColumn("upto", F.sum("words").over(upto)).withColumnRenamed("source", "of")
    run = run.join(small_side(plan), F.col("of").eqNullSafe(F.col("source"))).filter("upto > rest")
    cut = run.groupBy("source").agg(F.min(F.struct("range", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
    cut = cut.select(F.col("source").alias("cut_of"), F.col("cut.range").alias("cut_range"), F.col("cut.before").alias("before"))
    plan = saved(plan.join(cut, F.col("source").eqNullSafe(F.col("cut_of")), "left").drop("cut_of"))

    chosen = rows.withColumnRenamed("source", "of").join(small_side(plan), F.col("of").eqNullSafe(F.col("source"))).drop("of")
    on_cut = F.col("range") == F.col("cut_range")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = chosen.filter(on_cut).withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead")))
    cut_rows = ahead.withColumn("part", part.cast("long")).drop("ahead")
    clear = chosen.filter(~F.coalesce(on_cut, F.lit(False)))
    # beyond the last cut everything fits; before it a range is taken whole
    fits = F.col("cut_range").isNull() | (F.col("range") < F.col("cut_range"))
    clear = clear.withColumn("part", F.when(fits & (F.col("rest") > 0), F.col("size")).otherwise(0).cast("long"))
    out = clear.unionByName(cut_rows)
    return out.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), F.col("whole").alias("epochs"),
    )
