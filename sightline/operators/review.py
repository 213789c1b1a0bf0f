"""Human verdicts on cards and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _list(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.array().cast("array<bigint>"))


def edit_frames(idxs: Column, keep: Column, drop: Column, add: Column | None = None) -> Column:
    """Positive selection if ``keep`` is non-empty, else negative; additions united; sorted."""
    chosen = F.when(F.size(_list(keep)) > 0, F.array_intersect(idxs, _list(keep))).otherwise(F.array_except(idxs, _list(drop)))
    return F.array_sort(chosen if add is None else F.array_union(chosen, _list(add)))


def apply_verdicts(
    cards: DataFrame, verdicts: DataFrame, card: str = "card", include_unreviewed: bool = False, usable: str | None = None, prefix: str = ""
) -> DataFrame:
    """Cards with edited frame lists and a reason code.

    Precedence: no verdict -> ``unreviewed``; card dropped -> ``dropped``; views unusable ->
    ``unusable``; positive selection if any frame was kept, else negative; an emptied card is
    ``emptied``.  ``unmatched_picks`` are kept frames the card does not have.
    ``prefix`` marks the host whose verdict ids are read.
    """
    v = verdicts.select(
        F.col("id").alias("_id"), F.col("card").alias("_card"), "keep_frames", "drop_frames", "add_frames", F.lit(True).alias("_has")
    )
    rows = cards.join(v, F.concat(F.lit(prefix), F.col(card).cast("string")) == F.col("_id"), "left")
    keep, drop = _list("keep_frames"), _list("drop_frames")
    edited = edit_frames(F.col("idxs"), keep, drop)
    reviewed, good = F.coalesce("_has", F.lit(False)), F.col(usable) if usable else F.lit(True)
    reason = (
        F.when(~reviewed & F.lit(not include_unreviewed), "unreviewed")
        .when(F.coalesce(F.col("_card") == "drop", F.lit(False)), "dropped")
        .when(~good, "unusable")
        .when(F.size(edited) == 0, "emptied")
        .otherwise("kept")
    )
    none = F.array().cast("array<bigint>")
    counted = F.col("reason").isin("kept", "emptied")
    positive = F.size(keep) > 0
    rows = rows.withColumn("reason", reason)
    return rows.select(
        *cards.columns,
        "reason",
        F.when(counted, edited).otherwise(none).alias("frames"),
        F.when(counted & positive, F.size(edited)).otherwise(0).cast("bigint").alias("selected_frames"),
        F.when(counted, F.size("idxs") - F.size(edited)).otherwise(0).cast("bigint").alias("dropped_frames"),
        F.when(counted, F.size(_list("add_frames"))).otherwise(0).cast("bigint").alias("pending_adds"),
        F.when(counted, F.array_sort(F.array_except(keep, F.col("idxs")))).otherwise(none).alias("unmatched_picks"),
    )


def review_accounting(applied: DataFrame) -> DataFrame:
    """One row: cards by outcome and frames by outcome; cards and frames are never mixed."""
    n = lambda r: F.count_if(F.col("reason") == r)
    return applied.agg(
        n("kept").alias("kept_cards"),
        n("dropped").alias("dropped_cards"),
        n("emptied").alias("emptied_cards"),
        n("unreviewed").alias("unreviewed_cards"),
        n("unusable").alias("unusable_cards"),
        F.sum("selected_frames").alias("selected_frames"),
        F.sum("dropped_frames").alias("dropped_frames"),
        F.sum("pending_adds").alias("pending_adds"),
        F.sum(F.size("unmatched_picks")).cast("bigint").alias("unmatched_picks"),
    )


def missing_picks(verdicts: DataFrame, frames: DataFrame, n_views: DataFrame, host_prefix: str = "z_") -> DataFrame:
    """Picked (kept or added) frames that are not complete in every view of their card.

    ``frames``: card, view, t of existing files.  ``n_views``: card, views.
    """
    picked = F.array_union(_list("keep_frames"), _list("add_frames"))
    wanted = verdicts.select(F.regexp_replace("id", f"^{host_prefix}", "").alias("card"), F.explode(picked).alias("t")).distinct()
    have = frames.groupBy("card", "t").agg(F.countDistinct("view").alias("_have"))
    complete = have.join(n_views, "card").filter(F.col("_have") == F.col("views")).select("card", "t")
    known = wanted.join(n_views.select("card"), "card", "left_semi")
    return known.join(complete, ["card", "t"], "left_anti")
