"""Coverage, visibility and card quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.functions.columns import token_flags
from sightline.operators.ordered import exact_rank_value, ordered_scan

# View preference, live threshold, wrist threshold, picks per card.
EGO_VIEWS = ("head_gaze", "head")
SCORE_VIEWS = ("exo0", "exo1", "exo2", "head", "head_gaze", "left_wrist", "right_wrist")
LIVE_SHARE = 0.05
WRIST_SHARE = 0.20
# Verdicts, best first.
VERDICTS = ("ok", "thin", "single-exo", "weak-wrist", "no-exo", "empty")


# --- coverage of annotation maps -----------------------------------------------------------


def pair_coverage(pairs: DataFrame, group: Sequence[str] = (), base: str = "base") -> DataFrame:
    """Complete pairs by mapped sides, ratios with 4 decimals, smallest base as example per class."""
    a, b = F.col("value_1").isNotNull(), F.col("value_2").isNotNull()
    classes = {"both": a & b, "one": a != b, "neither": ~a & ~b}
    out = pairs.groupBy(*group).agg(
        F.count(F.lit(1)).alias("complete"),
        *[F.count_if(c).alias(n) for n, c in classes.items()],
        *[F.min(F.when(c, F.col(base))).alias(f"{n}_example") for n, c in classes.items()],
    )
    return out.withColumns({f"{n}_ratio": F.round(F.try_divide(F.col(n), F.col("complete")), 4) for n in classes})


def primary_crosstab(df: DataFrame, view: str, key: str) -> DataFrame:
    """Counts per (primary view, primary has a mask, other has a mask), with the smallest key as example."""
    return df.groupBy(
        F.col(view).alias("primary_view"),
        F.col("primary_value").isNotNull().alias("primary_has"),
        F.col("other_value").isNotNull().alias("other_has"),
    ).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("example"))


def top_counts(df: DataFrame, col: str, n: int) -> DataFrame:
    """Most frequent values; ties by value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(col)).limit(n)


def profile_episodes(
    frames: DataFrame, episode: str, frame: str, first: Sequence[str], nonempty: Sequence[str] = ()
) -> DataFrame:
    """Attributes of the first row, frame count, and whether any row of a text column is non-empty."""
    text = lambda c: F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) > 0
    return frames.groupBy(episode).agg(
        F.min_by(F.struct(*first), F.col(frame)).alias("_first"),
        F.count(F.lit(1)).alias("frames"),
        *[F.bool_or(text(c)).alias(f"has_{c}") for c in nonempty],
    ).select(episode, "_first.*", "frames", *[f"has_{c}" for c in nonempty])


def chunk_summary(profiles: DataFrame, chunk: str, key: str, mapped: Column, samples: int = 10) -> DataFrame:
    """Coverage per chunk with the first ``samples`` keys of each side (row-number limit runs map-side)."""
    rows = profiles.withColumn("_m", mapped)
    counts = rows.groupBy(chunk).agg(F.count(F.lit(1)).alias("total"), F.count_if("_m").alias("mapped"))
    counts = counts.withColumn("ratio", F.round(F.try_divide(F.col("mapped"), F.col("total")), 4))
    w = Window.partitionBy(chunk, "_m").orderBy(key)
    firsts = rows.select(chunk, "_m", key).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= samples)
    sample = firsts.groupBy(chunk).agg(
        F.array_sort(F.collect_list(F.when(F.col("_m"), F.col(key)))).alias("sample_mapped"),
        F.array_sort(F.collect_list(F.when(~F.col("_m"), F.col(key)))).alias("sample_unmapped"),
    )
    return counts.join(sample, chunk)


def mapping_summary(mask_map: DataFrame, key: str, value: str) -> DataFrame:
    return mask_map.agg(
        F.count(F.lit(1)).alias("total_keys"),
        F.count(value).alias("non_null_values"),
        F.count_if(F.col(value).isNull()).alias("null_values"),
    )


def token_counts(df: DataFrame, key: str, tokens: Sequence[str]) -> DataFrame:
    return df.select(F.explode(token_flags(key, tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


# --- visibility -------------------------------------------------------------------------------


def target_pixels(id_pixels: DataFrame, ids: DataFrame, lengths: DataFrame, keys: Sequence[str] = ("demo", "view")) -> DataFrame:
    """Target pixels per (view, step), zero-filled on the step grid.

    ``lengths``: keys, n_frames.  The grid is a row-local sequence; the pixel join is on (keys, t).
    """
    px = id_pixels.join(ids, [*keys, "id"], "left_semi").groupBy(*keys, "t").agg(F.sum("px").alias("px"))
    grid = lengths.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_frames").cast("bigint") - 1)).alias("t"))
    return grid.join(px, [*keys, "t"], "left").withColumn("px", F.coalesce("px", F.lit(0).cast("bigint")))


def target_ids(id_map: DataFrame, names: DataFrame, keys: Sequence[str] = ("demo", "view"), target: Sequence[str] = ("demo",)) -> DataFrame:
    """Ids of a target: labels that contain an instance name of it; only if there are none, labels equal to a category."""
    rows = id_map.join(names, list(target))
    exact = F.col("label").contains(F.col("name"))
    category = F.col("label") == F.regexp_replace("name", r"_\d+$", "")
    marked = rows.withColumns({"_exact": exact, "_cat": category}).filter("_exact OR _cat")
    any_exact = marked.groupBy(*keys).agg(F.bool_or("_exact").alias("_any"))
    picked = marked.join(any_exact, list(keys)).filter(F.col("_exact") == F.col("_any"))
    return picked.select(*keys, "name", "id").distinct()


def blank_steps(id_pixels: DataFrame, keys: Sequence[str] = ("demo",), few: int = 2) -> DataFrame:
    """Per step: does any view show at most ``few`` distinct ids."""
    per_view = id_pixels.groupBy(*keys, "view", "t").agg(F.countDistinct("id").alias("_ids"))
    return per_view.groupBy(*keys, "t").agg(F.bool_or(F.col("_ids") <= few).alias("blank"))


def view_stats(px: DataFrame, keys: Sequence[str] = ("card", "view")) -> DataFrame:
    """``visible_frac``, ``median_px`` (mean of the middles, truncated) and steps over the zero-filled grid.

    A (card, view) group holds one row per grid step, so the exact percentile stays small.
    """
    return px.groupBy(*keys).agg(
        F.avg((F.col("px") > 0).cast("double")).alias("visible_frac"),
        F.percentile("px", 0.5).cast("bigint").alias("median_px"),
        F.count(F.lit(1)).alias("n_frames"),
    )


def contact_frames(
    frames: DataFrame, episode: str, cell: str, total: str, on_bad: str = "episode"
) -> DataFrame:
    """Most frequent contact frame (smallest on ties), clipped; else the middle of the episode.

    ``on_bad='episode'``: one malformed cell voids the whole episode; ``'cell'``: only that cell.
    A null cell counts as malformed, a blank one is skipped.
    """
    if on_bad not in ("episode", "cell"):
        raise ValueError("on_bad must be 'episode' or 'cell'")
    text = F.trim(F.col(cell))
    parsed = F.try_parse_json(text)
    value = F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint"))
    rows = frames.withColumns({"_v": F.when(value >= 0, value), "_bad": text.isNull() | ((text != "") & parsed.isNull())})
    votes = rows.filter(F.col("_v").isNotNull()).groupBy(episode, "_v").agg(F.count(F.lit(1)).alias("_c"))
    mode = votes.groupBy(episode).agg(F.min_by("_v", F.struct((-F.col("_c")).alias("c"), F.col("_v").alias("v"))).alias("_mode"))
    base = rows.groupBy(episode).agg(F.max(total).alias("_total"), F.bool_or("_bad").alias("_any_bad"))
    out = base.join(mode, episode, "left")
    void = F.col("_any_bad") if on_bad == "episode" else F.lit(False)
    picked = F.least(F.greatest(F.col("_mode"), F.lit(0)), F.col("_total") - 1)
    return out.select(
        episode,
        F.when(void | F.col("_mode").isNull(), F.floor(F.col("_total") / 2)).otherwise(picked).cast("bigint").alias("contact_frame"),
    )


def common_length(cams: DataFrame, episode: Sequence[str], frames: str = "frames") -> DataFrame:
    return cams.groupBy(*episode).agg(F.min(frames).alias("common_frames"), F.count(F.lit(1)).alias("cameras"))


def take_distribution(df: DataFrame, take: str, camera: str) -> DataFrame:
    """Takes by number of cameras, with the pairs ``k(k-1)/2`` they allow (counted, never formed)."""
    k = df.groupBy(take).agg(F.countDistinct(camera).alias("cameras"))
    out = k.groupBy("cameras").agg(F.count(F.lit(1)).alias("takes"))
    return out.withColumn("pairs", F.col("takes") * (F.col("cameras") * (F.col("cameras") - 1) / 2).cast("bigint"))


# --- cards -------------------------------------------------------------------------------------


def scorecard(
    view_meta: DataFrame, card: str = "card", views: Sequence[str] = SCORE_VIEWS, live: float = LIVE_SHARE
) -> DataFrame:
    """Per card: live views, live exos, best wrist, head visibility, length.  ``views`` is a parameter
    because builders may write more exo views than the default list reads."""
    rows = view_meta.filter(F.col("view").isin(*views))
    alive, wrist = F.col("visible_frac") >= live, F.col("view").isin("left_wrist", "right_wrist")
    return rows.groupBy(card).agg(
        F.count_if(alive).alias("n_live"),
        F.count_if(alive & F.col("view").startswith("exo")).alias("n_exo"),
        F.coalesce(F.max(F.when(wrist, F.col("visible_frac"))), F.lit(0.0)).alias("wrist_best"),
        F.coalesce(F.max(F.when(F.col("view") == "head_gaze", F.col("visible_frac"))), F.lit(0.0)).alias("head"),
        F.bool_or(F.col("view").endswith("wrist")).alias("has_wrist"),
        F.min("n_frames").alias("n_frames"),
    )


def card_verdict(wrist_min: float = WRIST_SHARE) -> Column:
    """First reason that applies, over the columns of :func:`scorecard`."""
    want = F.when(F.col("has_wrist"), 5).otherwise(3)
    return (
        F.when(F.col("n_live") == 0, "empty")
        .when(F.col("n_exo") == 0, "no-exo")
        .when(F.col("has_wrist") & (F.col("wrist_best") < wrist_min), "weak-wrist")
        .when(F.col("n_exo") < 2, "single-exo")
        .when(F.col("n_live") < want, "thin")
        .otherwise("ok")
    )


def verdict_histogram(cards: DataFrame, verdicts: Sequence[str] = VERDICTS) -> DataFrame:
    """Cards and share per verdict (all verdicts listed), and the upper-median length of ok / weak cards."""
    stats = cards.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("verdict") == v).alias(f"_v{i}") for i, v in enumerate(verdicts)])
    rows = F.inline(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(f"_v{i}").alias("cards")) for i, v in enumerate(verdicts)]))
    return stats.select("_n", rows).select("verdict", "cards", F.try_divide(F.col("cards"), F.col("_n")).alias("share"))


def verdict_lengths(cards: DataFrame) -> DataFrame:
    """Upper-median episode length of ``ok`` cards and of ``weak`` ones (neither ok nor thin)."""
    side = F.when(F.col("verdict") == "ok", "ok").when(F.col("verdict") != "thin", "weak")
    rows = cards.select(side.alias("side"), "n_frames").filter(F.col("side").isNotNull())
    return exact_rank_value(rows, ["side"], "n_frames", upper=True, name="median_length")


def rerun_candidates(cards: DataFrame, card: str = "card") -> DataFrame:
    """Weak cards with their position in (wrist, live views, id) order."""
    weak = cards.filter(~F.col("verdict").isin("ok", "thin"))
    return ordered_scan(weak, ["wrist_best", "n_live", card], ordinal="position")


def best_exos(view_meta: DataFrame, card: str = "card", k: int = 2, min_vis: float = LIVE_SHARE) -> DataFrame:
    """Best ``k`` exo views: median pixels, then visibility, then name; stray-pixel views are out."""
    ok = F.col("view").startswith("exo") & (F.col("visible_frac") >= min_vis) & (F.coalesce("median_px", F.lit(0)) > 0)
    w = Window.partitionBy(card).orderBy(F.desc("median_px"), F.desc("visible_frac"), F.asc("view"))
    rows = view_meta.filter(ok).withColumn("exo_rank", F.row_number().over(w)).filter(F.col("exo_rank") <= k)
    return rows.withColumn("exo_rank", F.col("exo_rank").cast("bigint"))


def pick_ego(view_meta: DataFrame, card: str = "card", prefs: Sequence[str] = EGO_VIEWS, min_vis: float = LIVE_SHARE) -> DataFrame:
    """First preferred ego view above the visibility threshold."""
    order = F.array_position(F.array(*[F.lit(p) for p in prefs]), F.col("view"))
    rows = view_meta.filter(F.col("view").isin(*prefs) & (F.col("visible_frac") >= min_vis))
    return rows.groupBy(card).agg(F.min_by("view", order).alias("ego"))


def card_views(view_meta: DataFrame, card: str = "card", min_vis: float = LIVE_SHARE, require_ego: bool = False) -> DataFrame:
    """(card, ego, exos) of usable cards: two exos, or one exo and an ego.

    ``require_ego`` is the stricter rule of the review package.  The same choices as
    :func:`best_exos` and :func:`pick_ego`, in one aggregation: a card has one row per camera.
    """
    live = F.col("visible_frac") >= min_vis
    exo = live & F.col("view").startswith("exo") & (F.coalesce("median_px", F.lit(0)) > 0)
    order = F.array_position(F.array(*[F.lit(p) for p in EGO_VIEWS]), F.col("view"))
    ego = live & F.col("view").isin(*EGO_VIEWS)
    rank = F.struct((-F.col("median_px")).alias("p"), (-F.col("visible_frac")).alias("f"), F.col("view").alias("view"))
    rows = view_meta.filter(exo | ego).groupBy(card).agg(
        F.min_by(F.when(ego, F.col("view")), F.when(ego, order)).alias("ego"),
        F.slice(F.array_sort(F.collect_list(F.when(exo, rank))), 1, 2).alias("_e"),
    )
    enough = (F.size("_e") >= 1) & (F.col("ego").isNotNull() | ((F.size("_e") >= 2) & F.lit(not require_ego)))
    return rows.filter(enough).select(card, "ego", F.transform("_e", lambda s: s["view"]).alias("exos"))


def card_relations(views: DataFrame, card: str = "card") -> DataFrame:
    """Directed relations of each card: ego <-> every exo, exo <-> exo."""
    ex, ego = F.col("exos"), F.col("ego")
    rel = lambda a, b, d: F.struct(a.alias("source"), b.alias("target"), F.lit(d).alias("direction"))
    none = F.lit(None).cast("array<struct<source:string,target:string,direction:string>>")
    with_ego = F.when(
        ego.isNotNull(),
        F.flatten(F.transform(ex, lambda x: F.array(rel(ego, x, "ego2exo"), rel(x, ego, "exo2ego")))),
    ).otherwise(none)
    a, b = F.get(ex, 0), F.get(ex, 1)
    exo_pair = F.when(F.size(ex) >= 2, F.array(rel(a, b, "exo2exo"), rel(b, a, "exo2exo"))).otherwise(none)
    empty = F.array().cast("array<struct<source:string,target:string,direction:string>>")
    return views.select(card, F.inline(F.concat(F.coalesce(with_ego, empty), F.coalesce(exo_pair, empty))))


def card_stats(frames: DataFrame, card: str = "card") -> DataFrame:
    """Weakest positive area (0 if none), black frames, steps and mean visibility with 3 decimals."""
    return frames.groupBy(card).agg(
        F.coalesce(F.min(F.when(F.col("px") > 0, F.col("px"))), F.lit(0)).cast("bigint").alias("min_px"),
        F.count_if("black").alias("black_frames"),
        F.countDistinct("t").alias("steps"),
        F.round(F.avg((F.col("px") > 0).cast("double")), 3).alias("vis"),
    )


# --- ledgers --------------------------------------------------------------------------------------


def dataset_ledger(relations: DataFrame, card: str = "card") -> DataFrame:
    """Relations, cards and moments per direction."""
    return relations.groupBy("direction").agg(
        F.count(F.lit(1)).alias("relations"),
        F.countDistinct(card).alias("cards"),
        F.countDistinct(card, "prompt_t").alias("moments"),
    )


def camera_usage(relations: DataFrame) -> DataFrame:
    both = relations.select(F.explode(F.array("source", "target")).alias("camera"))
    return both.groupBy("camera").agg(F.count(F.lit(1)).alias("uses"))


def image_references(relations: DataFrame, images: DataFrame) -> DataFrame:
    """Images referenced by relations and not referenced, counted."""
    refs = relations.select(F.explode(F.array("prompt_image", "target_image")).alias("image")).distinct()
    rows = images.select("image").distinct().join(refs.withColumn("_r", F.lit(True)), "image", "left")
    return rows.agg(F.count("_r").alias("referenced"), F.count_if(F.col("_r").isNull()).alias("unreferenced"))


def pooled_density(samples: DataFrame, group: str, size: str, rows: str, total_bytes: float, outliers: Column) -> DataFrame:
    """Bytes per row as a ratio of sums, with and without outlier groups, and the extrapolated row count.

    ``outliers`` is a condition over ``group_bytes`` and ``group_rows``.
    """
    out = samples.groupBy(group).agg(F.sum(size).alias("group_bytes"), F.sum(rows).alias("group_rows"))
    out = out.withColumn("_k", ~F.coalesce(outliers, F.lit(False)))
    kept = lambda c: F.sum(F.when(F.col("_k"), F.col(c)))
    out = out.agg(
        F.try_divide(F.sum("group_bytes"), F.sum("group_rows")).alias("density"),
        F.try_divide(kept("group_bytes"), kept("group_rows")).alias("density_kept"),
        F.count_if(~F.col("_k")).alias("outlier_groups"),
    )
    return out.withColumn("extrapolated_rows", F.floor(F.try_divide(F.lit(float(total_bytes)), F.col("density"))))


def scene_coverage(tasks: DataFrame, scenes: DataFrame, scene: str) -> DataFrame:
    """One row: scenes represented by tasks, missing, and known."""
    seen = tasks.select(scene).filter(F.col(scene).isNotNull()).distinct().withColumn("_s", F.lit(True))
    rows = scenes.select(scene).distinct().join(seen, scene, "left")
    return rows.agg(
        F.count(F.lit(1)).alias("scenes"), F.count("_s").alias("represented"), F.count_if(F.col("_s").isNull()).alias("missing")
    )
