"""Picking frames, candidates and shards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.functions.columns import frame_grid
from sightline.functions.stable import seeded
from sightline.operators.ordered import ordered_scan
from sightline.session import published

# Fixed values of the step score and of the spaced pick.
VISIBLE_PX = 200
PX_CAP = 20_000
WRIST_CAP = 40_000
PICKS = 8


def value_runs(df: DataFrame, part: Sequence[str], order: str, value: str) -> DataFrame:
    """Runs of equal consecutive values: part, value, ``start`` (position) and ``length``.

    Gaps and islands without a per-part window: the run number is a running sum over buckets
    of the sort key, so one very long part is spread over tasks.
    """
    marked = ordered_scan(
        df.select(*part, order, value), [order], part, ordinal="_pos", previous={"_prev": value}, keep_bucket=True
    )
    first = (F.col("_pos") == 0) | ~F.col(value).eqNullSafe(F.col("_prev"))
    marked = marked.withColumn("_new", first.cast("bigint"))
    numbered = ordered_scan(marked, [order], part, running_sum={"_run": "_new"}, bucketed=True)
    return numbered.groupBy(*part, "_run", value).agg(F.min("_pos").alias("start"), F.count(F.lit(1)).alias("length")).drop("_run")


def on_grid(steps: DataFrame, t: str = "t", total: str = "n_frames") -> DataFrame:
    """Rows on the sampling grid, with their grid position ``g``; a card keeps fewer than 480 steps."""
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col(total) / 240))
    return steps.filter(F.col(t) % step == 0).withColumn("g", F.floor(F.col(t) / step))


def score_steps(px: DataFrame, blank: DataFrame, keys: Sequence[str] = ("card",)) -> DataFrame:
    """Score terms per step from per-view target pixels (zero-filled grid).

    The score is lexicographic: not blank, close view sees the target, number of views with a
    substantial mask, then ``10 * total + close`` pixels.  The close view is the wrist pair, or
    the ego view when a card has no wrist cameras.
    """
    v, p = F.col("view"), F.col("px")
    at = lambda name: F.sum(F.when(v == name, p))
    steps = px.groupBy(*keys, "t").agg(
        F.count_if(p >= VISIBLE_PX).alias("n_vis"),
        F.sum(F.least(p, F.lit(PX_CAP))).alias("total_px"),
        F.sum(F.when(v.isin("left_wrist", "right_wrist"), p)).alias("_wrist"),
        at("head_gaze").alias("_gaze"),
        at("head").alias("_head"),
        F.bool_or(v.endswith("wrist")).alias("_w"),
        F.bool_or(v == "head_gaze").alias("_z"),
    )
    # which cameras a card has: over its steps, at most one row per frame of the episode
    card = Window.partitionBy(*keys)
    rows = steps.withColumns({"_has_wrist": F.bool_or("_w").over(card), "_has_gaze": F.bool_or("_z").over(card)})
    rows = rows.join(blank.select(*keys, "t", "blank"), [*keys, "t"], "left")
    ego = F.when(F.col("_has_gaze"), F.col("_gaze")).otherwise(F.col("_head"))
    close = F.when(F.col("_has_wrist"), F.col("_wrist")).otherwise(ego)
    close = F.least(F.coalesce(close, F.lit(0)), F.lit(WRIST_CAP))
    rows = rows.withColumn("close_px", close.cast("bigint")).withColumn("blank", F.coalesce("blank", F.lit(False)))
    return rows.select(
        *keys,
        "t",
        "n_vis",
        "total_px",
        "close_px",
        (F.col("close_px") >= VISIBLE_PX).alias("close_vis"),
        "blank",
        (F.col("n_vis") > 0).alias("alive"),
        (10 * F.col("total_px") + F.col("close_px")).cast("bigint").alias("px_score"),
    )


def with_window(steps: DataFrame, keys: Sequence[str] = ("card",), g: str = "g", n_grid: str = "n_grid") -> DataFrame:
    """Add ``win_lo`` and ``win_hi``: first to last grid step with a close view, padded by 10 % of the
    span; the full grid below two such steps.  A card has fewer than 480 grid steps."""
    card, seen = Window.partitionBy(*keys), F.when(F.col("close_vis"), F.col(g))
    rows = steps.withColumns({"_a": F.min(seen).over(card), "_b": F.max(seen).over(card), "_n": F.count(seen).over(card)})
    pad = F.greatest(F.lit(1), F.floor((F.col("_b") - F.col("_a")) / 10))
    enough, last = F.col("_n") >= 2, F.col(n_grid) - 1
    lo = F.when(enough, F.greatest(F.lit(0), F.col("_a") - pad)).otherwise(0).cast("bigint")
    hi = F.when(enough, F.least(last, F.col("_b") + pad)).otherwise(last).cast("bigint")
    return rows.withColumns({"win_lo": lo, "win_hi": hi}).drop("_a", "_b", "_n")


def manipulation_window(steps: DataFrame, keys: Sequence[str] = ("card",), g: str = "g", n_grid: str = "n_grid") -> DataFrame:
    """The window of each card, one row per card."""
    return with_window(steps, keys, g, n_grid).groupBy(*keys).agg(F.min("win_lo").alias("win_lo"), F.min("win_hi").alias("win_hi"))


def _spaced(ranked: Column, gap: Column, k: int) -> Column:
    """Walk the ranked steps and keep each one that lies at least ``gap`` from all kept before, up to ``k``."""

    def step(kept: Column, g: Column) -> Column:
        fits = (F.size(kept) < k) & F.forall(kept, lambda c: F.abs(c - g) >= gap)
        return F.when(fits, F.concat(kept, F.array(g))).otherwise(kept)

    return F.aggregate(ranked, F.array().cast("array<bigint>"), step)


def greedy_spaced_topk(scored: DataFrame, card: str = "card", k: int = PICKS) -> DataFrame:
    """Top ``k`` alive steps inside the window with a minimum gap that relaxes over three levels.

    Input rows lie on the sampling grid (:func:`on_grid`), so a card has fewer than 480 of them:
    its ranked steps form one short array, and the dependent picks are a fold over it.
    Blank steps rank equally, below all others; ties go to the earlier step.
    """
    inside = (F.col("g") >= F.col("win_lo")) & (F.col("g") <= F.col("win_hi")) & F.col("alive")
    live = ~F.col("blank")
    rank = F.struct(
        F.col("blank").alias("b"),
        F.when(live, ~F.col("close_vis")).alias("c"),
        F.when(live, -F.col("n_vis")).alias("v"),
        F.when(live, -F.col("px_score")).alias("p"),
        F.col("g").alias("g"),
        F.col("t").alias("t"),
    )
    per_card = scored.filter(inside).groupBy(card).agg(
        F.array_sort(F.collect_list(rank)).alias("_r"), F.max(F.col("win_hi") - F.col("win_lo") + 1).alias("_win")
    )
    steps = F.transform("_r", lambda r: r["g"])
    gaps = [F.floor(F.col("_win") / (k + 1)), F.floor(F.col("_win") / (2 * k)), F.lit(1)]
    levels = [_spaced(steps, F.greatest(F.lit(1), g), k) for g in gaps]
    per_card = per_card.withColumns({f"_l{i}": level for i, level in enumerate(levels)})
    full = lambda i: F.size(f"_l{i}") == k
    chosen = F.when(full(0), F.col("_l0")).when(full(1), F.col("_l1")).otherwise(F.col("_l2"))
    t_of = F.map_from_entries(F.transform("_r", lambda r: F.struct(r["g"], r["t"])))
    rows = per_card.select(card, t_of.alias("_t"), F.posexplode(F.array_sort(chosen)).alias("pick", "g"))
    return rows.select(card, F.element_at("_t", F.col("g")).alias("t"), "g", F.col("pick").cast("bigint").alias("pick"))


def round_robin(
    df: DataFrame, group: str, key: Sequence[str], n: int, seed: int = 0, portable: bool = False, covered: DataFrame | None = None, rounds: int | None = None
) -> DataFrame:
    """One row per group, then a second, ... up to ``n`` rows (and ``rounds``, if given); groups in seeded order.

    ``covered`` (group values already represented) moves those groups behind the others in each round.
    """
    w = Window.partitionBy(group).orderBy(*key)
    rows = df.withColumn("round", F.row_number().over(w)).filter(F.col("round") <= min(n, rounds or n))
    rows = rows.withColumn("_o", seeded(group, seed=seed, portable=portable))
    late = F.lit(False)
    if covered is not None:
        rows = rows.join(covered.select(group).distinct().withColumn("_c", F.lit(True)), group, "left")
        late = F.coalesce("_c", F.lit(False))
    rows = rows.withColumn("_late", late)
    return rows.orderBy("round", "_late", "_o", group).limit(n).select(*df.columns, F.col("round").cast("bigint").alias("round"))


def pack_shards(samples: DataFrame, order: Sequence[str], size: str, target_bytes: int, buckets: int | None = None) -> DataFrame:
    """Shard number by bytes in sample order: a shard closes after the sample that fills it to the target, and the next begins empty.

    A shard that closes with sample ``i`` makes the next one close with the first sample whose running bytes reach
    those of ``i`` plus the target, so every sample has one successor, found for all at once by counting samples below
    that mark.  The shards are the chain of successors from the first close on.  It is followed by doubling: the closes
    known so far jump as far as there are of them, while jumps are composed with themselves, in as many rounds as the
    logarithm of the number of shards.  Only samples that some jump still ends at stay in the table of jumps.

    ``order`` identifies a sample (nulls are equal); a null size counts as 0.  A sample of the target or more that
    meets an empty shard is one of its own.  Empty table: no rows.
    """
    if target_bytes <= 0:
        raise ValueError("target_bytes must be positive")
    sizes = samples.select(*order, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"))
    rows = published(ordered_scan(sizes, order, ordinal="_i", running_sum={"_upto": "_size"}, buckets=buckets).select(*order, "_i", "_upto"))
    jumps = published(_successors(rows, target_bytes, buckets))
    first = rows.filter(F.col("_upto") < target_bytes).count()
    closes = published(rows.filter(F.col("_i") == first).select("_i"))
    while True:
        landed = published(closes.join(jumps, "_i").select(F.col("_j").alias("_i")))
        if not landed.limit(1).count():
            break
        closes = published(closes.union(landed))
        onward = jumps.select(F.col("_i").alias("_j"), F.col("_j").alias("_k"))
        doubled = published(jumps.join(onward, "_j").select("_i", F.col("_k").alias("_j")))
        used = closes.union(doubled.select(F.col("_j").alias("_i"))).distinct()
        jumps = published(doubled.join(used, "_i", "left_semi"))
    marked = rows.join(closes.withColumn("_closes", F.lit(1)), "_i", "left").select(*order, "_i", F.coalesce("_closes", F.lit(0)).cast("bigint").alias("_closes"))
    counted = ordered_scan(marked, ["_i"], running_sum={"_closed": "_closes"}, buckets=buckets)
    shards = counted.select(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(order)], (F.col("_closed") - F.col("_closes")).alias("shard"))
    same = [samples[c].eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(order)]
    return samples.join(shards, reduce(lambda a, b: a & b, same)).drop(*[f"_k{n}" for n in range(len(order))])


def _successors(rows: DataFrame, target: int, buckets: int | None) -> DataFrame:
    """``_i, _j``: the sample that fills the shard begun after sample ``_i``; none for those whose shard stays open.

    Running bytes never fall, so the number of samples below a mark is the position of the first one at it.
    """
    samples = rows.select(F.col("_upto").alias("_at"), F.lit(1).alias("_kind"), "_i", F.lit(1).cast("bigint").alias("_one"))
    marks = rows.select((F.col("_upto") + target).alias("_at"), F.lit(0).alias("_kind"), "_i", F.lit(0).cast("bigint").alias("_one"))
    below = ordered_scan(samples.union(marks), ["_at", "_kind", "_i"], running_sum={"_j": "_one"}, buckets=buckets)
    last = rows.agg(F.max("_upto")).scalar()
    return below.filter((F.col("_kind") == 0) & (F.col("_at") <= last)).select("_i", "_j")


def first_accepted(candidates: DataFrame, task: str, rank: str, name: str, accepted: Column, moving: Column) -> DataFrame:
    """First accepted candidate per task; else the last one if it has a moving view; else none."""
    best = candidates.groupBy(task).agg(
        F.min_by(F.when(accepted, F.col(name)), F.when(accepted, F.col(rank))).alias("_first"),
        F.max_by(F.struct(F.col(name).alias("n"), moving.alias("m")), F.col(rank)).alias("_last"),
        F.count(F.lit(1)).alias("candidates"),
    )
    partial = F.col("_last")["m"]
    outcome = F.when(F.col("_first").isNotNull(), "COMPLETE").when(partial, "LAST-CANDIDATE").otherwise("GIVE-UP")
    chosen = F.coalesce("_first", F.when(partial, F.col("_last")["n"]))
    return best.select(task, chosen.alias("chosen"), outcome.alias("outcome"), "candidates")


def latest_status(events: DataFrame, job: str, ts: str, tie: str, columns: Sequence[str]) -> DataFrame:
    return events.groupBy(job).agg(F.max_by(F.struct(*columns), F.struct(ts, tie)).alias("_l")).select(job, "_l.*")


def anchor_midpoints(anchors: DataFrame, video: str, frame: str) -> DataFrame:
    """Frames half-way between consecutive anchors."""
    rows = ordered_scan(anchors.select(video, frame).distinct(), [frame], [video], following={"next_frame": frame})
    return rows.filter(F.col("next_frame").isNotNull()).withColumn("mid", F.floor((F.col(frame) + F.col("next_frame")) / 2))


def canonical_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range-partitioned and sorted by the keys: files in order, no single sorting task."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def grid_steps(lengths: DataFrame, keys: Sequence[str], total: str = "n_frames") -> DataFrame:
    return lengths.select(*keys, F.posexplode(frame_grid(total)).alias("g", "t")).withColumn("g", F.col("g").cast("bigint"))
