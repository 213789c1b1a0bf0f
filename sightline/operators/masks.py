"""Mask algebra on intervals.

A mask is a header ``(mask_id, h, w, area)`` plus rows of ``(mask_id, s, e)``: half-open
foreground intervals in column-major pixel order.  Overlap, union and difference are sweeps
over interval ends - sorted events with running counters - so their cost is linear in the
number of intervals; no interval is ever paired with all intervals of another mask.  A sweep
window holds one mask (or one mask pair): at most ``h * w`` events, whatever the table size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.operators.ordered import exact_rank_value, ordered_scan
from sightline.session import published

EMPTY_RULES = ("eps", "one", "null")
#: Masks of a side that one tile of a frame holds: the bits of a BIGINT that need no sign.
TILE = 62


# --- building and converting ------------------------------------------------------------


def masks_from_bits(df: DataFrame, bits: str = "bits", key: str = "mask_id") -> DataFrame:
    """Column-major boolean arrays -> intervals; row-local, no shuffle."""
    b, n = F.col(bits), F.size(bits)
    at = lambda i: F.get(b, i)
    pos = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(pos, lambda i: at(i) & ~F.coalesce(at(i - 1), F.lit(False)))
    ends = F.filter(pos, lambda i: at(i) & ~F.coalesce(at(i + 1), F.lit(False)))
    rows = df.select(key, F.inline(F.arrays_zip(starts.alias("s"), ends.alias("e"))))
    return rows.select(key, F.col("s").cast("bigint").alias("s"), (F.col("e") + 1).cast("bigint").alias("e"))


def headers_from_bits(df: DataFrame, bits: str = "bits", key: str = "mask_id") -> DataFrame:
    area = F.size(F.filter(bits, lambda x: x)).cast("bigint")
    return df.select(key, "h", "w", area.alias("area"))


def masks_to_counts(runs: DataFrame, headers: DataFrame, key: str = "mask_id") -> DataFrame:
    """Intervals -> uncompressed alternating run counts, background first; empty masks give ``[h*w]``."""
    packed = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("r"))
    rows = headers.join(packed, key, "left")
    r, size = F.col("r"), (F.col("h") * F.col("w")).cast("bigint")
    before = lambda i: F.coalesce(F.get(r, i - 1)["e"], F.lit(0).cast("bigint"))
    body = F.flatten(F.transform(r, lambda x, i: F.array(x["s"] - before(i), x["e"] - x["s"])))
    rest = size - F.element_at(r, -1)["e"]
    counts = F.when(r.isNull(), F.array(size)).when(rest > 0, F.concat(body, F.array(rest))).otherwise(body)
    return rows.select(key, counts.alias("counts"), F.array(F.col("h"), F.col("w")).alias("size"))


def masks_from_counts(df: DataFrame, key: str = "mask_id") -> DataFrame:
    """Alternating run counts -> intervals."""
    runs = df.select(key, F.posexplode("counts").alias("p", "c"))
    w = Window.partitionBy(key).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ended = runs.withColumn("e", F.sum("c").over(w))
    odd = ended.filter((F.col("p") % 2 == 1) & (F.col("c") > 0))
    return odd.select(key, (F.col("e") - F.col("c")).alias("s"), "e")


def roundtrip_findings(runs: DataFrame, headers: DataFrame, key: str = "mask_id") -> DataFrame:
    """Intervals that differ after counts -> intervals; empty when the two forms agree."""
    back = masks_from_counts(masks_to_counts(runs, headers, key), key).select(key, "s", "e")
    here = runs.select(key, "s", "e")
    return here.exceptAll(back).withColumn("finding", F.lit("lost")).unionByName(
        back.exceptAll(here).withColumn("finding", F.lit("invented"))
    )


def mask_area(runs: DataFrame, headers: DataFrame, key: str = "mask_id") -> DataFrame:
    """Area recomputed from the intervals, with visibility; empty masks stay with area 0."""
    area = runs.groupBy(key).agg(F.sum(F.col("e") - F.col("s")).alias("run_area"))
    out = headers.select(key, "h", "w").join(area, key, "left")
    out = out.withColumn("area", F.coalesce("run_area", F.lit(0).cast("bigint"))).drop("run_area")
    return out.withColumn("visible", F.col("area") > 0)


# --- sweeps -----------------------------------------------------------------------------


def _events(runs: DataFrame, keys: Sequence[str], a: int, b: int) -> DataFrame:
    ends = F.array(
        F.struct(F.col("s").alias("pos"), F.lit(a).alias("da"), F.lit(b).alias("db")),
        F.struct(F.col("e").alias("pos"), F.lit(-a).alias("da"), F.lit(-b).alias("db")),
    )
    return runs.select(*keys, F.inline(ends))


def _segments(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Atomic segments between event positions with the number of open intervals on each side."""
    w = Window.partitionBy(*keys).orderBy("pos")  # default frame: equal positions count together
    rows = events.select(
        *keys,
        F.col("pos").alias("s"),
        F.lead("pos").over(w).alias("e"),
        F.sum("da").over(w).alias("in_a"),
        F.sum("db").over(w).alias("in_b"),
    )
    return rows.filter(F.col("s") < F.col("e"))


def pair_segments(pairs: DataFrame, runs_a: DataFrame, runs_b: DataFrame, key: str = "pair_id") -> DataFrame:
    """Segments per mask pair.  ``pairs`` has (key, a_id, b_id); runs are keyed by ``mask_id``."""
    a = pairs.select(key, F.col("a_id").alias("mask_id")).join(runs_a, "mask_id")
    b = pairs.select(key, F.col("b_id").alias("mask_id")).join(runs_b, "mask_id")
    return _segments(_events(a, [key], 1, 0).unionByName(_events(b, [key], 0, 1)), [key])


def merge_touching(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join segments that touch into maximal intervals."""
    w = Window.partitionBy(*keys).orderBy("s")
    marked = segments.select(*keys, "s", "e", F.coalesce(F.lag("e").over(w) < F.col("s"), F.lit(True)).alias("_new"))
    island = marked.withColumn("_i", F.sum(F.col("_new").cast("int")).over(w))
    return island.groupBy(*keys, "_i").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_i")


def mask_union(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of all intervals per key, for any number of masks per key.

    Events are first summed per (key, position): a key shared by billions of masks still
    reaches its window with at most ``h * w + 1`` rows.
    """
    events = _events(runs, list(keys), 1, 0).groupBy(*keys, "pos").agg(F.sum("da").alias("da"))
    segments = _segments(events.withColumn("db", F.lit(0)), keys).filter(F.col("in_a") > 0)
    return merge_touching(segments, keys)


def mask_intersect(pairs: DataFrame, runs_a: DataFrame, runs_b: DataFrame, key: str = "pair_id") -> DataFrame:
    seg = pair_segments(pairs, runs_a, runs_b, key).filter((F.col("in_a") > 0) & (F.col("in_b") > 0))
    return merge_touching(seg, [key])


def mask_minus(pairs: DataFrame, runs_a: DataFrame, runs_b: DataFrame, key: str = "pair_id") -> DataFrame:
    seg = pair_segments(pairs, runs_a, runs_b, key).filter((F.col("in_a") > 0) & (F.col("in_b") == 0))
    return merge_touching(seg, [key])


def mask_overlap(pairs: DataFrame, runs_a: DataFrame, runs_b: DataFrame | None = None, key: str = "pair_id") -> DataFrame:
    """Areas, intersection and union pixel counts; pairs without common or any pixels are kept with 0.

    One sweep gives all four counts, so the headers are not joined again.
    """
    size, zero = F.col("e") - F.col("s"), F.lit(0).cast("bigint")
    count = lambda c: F.sum(F.when(c, size))
    a, b = F.col("in_a") > 0, F.col("in_b") > 0
    swept = pair_segments(pairs, runs_a, runs_a if runs_b is None else runs_b, key)
    counts = swept.groupBy(key).agg(count(a).alias("area_a"), count(b).alias("area_b"), count(a & b).alias("inter"))
    out = pairs.join(counts, key, "left").withColumns({c: F.coalesce(c, zero) for c in ("area_a", "area_b", "inter")})
    return out.withColumn("union", F.col("area_a") + F.col("area_b") - F.col("inter"))


def _numbered(wanted: DataFrame, side: str) -> DataFrame:
    """Masks of a side, numbered within their frame and dealt out to tiles: ``_f, <side>_id, t<side>, n<side>``."""
    masks = ordered_scan(wanted.select("_f", f"{side}_id").distinct(), [f"{side}_id"], ["_f"], ordinal="_i")
    tile, bit = F.floor(F.col("_i") / TILE).cast("int"), (F.col("_i") % TILE).cast("int")
    return masks.select("_f", f"{side}_id", tile.alias(f"t{side}"), bit.alias(f"n{side}"))


def _tile_events(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """Interval ends of every mask, once per tile that the mask has a partner in, with its bit on its side."""
    tile, bit = ["_f", "ta", "tb"], lambda n: F.expr(f"shiftleft(1L, {n})")
    none = F.lit(0).cast("bigint")
    a = wanted.select(*tile, F.col("a_id").alias("mask_id"), bit("na").alias("a"), none.alias("b")).distinct()
    b = wanted.select(*tile, F.col("b_id").alias("mask_id"), none.alias("a"), bit("nb").alias("b")).distinct()
    return a.union(b).join(runs.select("mask_id", "s", "e"), "mask_id").select(*tile, "a", "b", F.explode(F.array("s", "e")).alias("pos"))


def frame_overlap(pairs: DataFrame, runs: DataFrame, frame: Sequence[str]) -> DataFrame:
    """:func:`mask_overlap` for masks with many partners in their frame, by one sweep per frame instead of one per pair.

    ``pairs``: ``a_id, b_id``, the columns ``frame`` and any others; ``runs``: intervals that are disjoint within a mask.
    The masks of a frame are numbered, a tile holds up to 62 of each side, and the masks open at a position are the bits
    of two numbers: a running exclusive or over the interval ends.  A mask's intervals go into the sweep once per tile
    of its partners, not once per partner; what comes out is pixels per set of open masks, of which only wanted pairs
    are taken.  A window holds at most ``h * w`` positions, however many masks a frame has.

    Null frames are a frame of their own; null or unknown ids count as empty masks.
    """
    f, tile, zero = F.struct(*frame).alias("_f"), ["_f", "ta", "tb"], F.lit(0).cast("bigint")
    wanted = published(pairs.select(f, "a_id", "b_id").filter("a_id is not null and b_id is not null").distinct())
    for side in ("a", "b"):
        wanted = wanted.join(_numbered(wanted, side), ["_f", f"{side}_id"])
    wanted = published(wanted)
    ends = _tile_events(wanted, runs).groupBy(*tile, "pos").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    w = Window.partitionBy(*tile).orderBy("pos")
    open_sets = ends.select(*tile, (F.lead("pos").over(w) - F.col("pos")).alias("n"), F.bit_xor("a").over(w).alias("a"), F.bit_xor("b").over(w).alias("b"))
    open_sets = open_sets.filter("a <> 0 and b <> 0").groupBy(*tile, "a", "b").agg(F.sum("n").alias("n"))
    bits = lambda c: F.explode(F.filter(F.sequence(F.lit(0), F.lit(TILE - 1)), lambda i: F.getbit(c, i) == 1))
    partners = wanted.groupBy(*tile, "na").agg(F.bit_or(F.expr("shiftleft(1L, nb)")).alias("_p"))
    met = open_sets.select(*tile, "b", "n", bits(F.col("a")).alias("na")).join(partners, [*tile, "na"])
    met = met.select(*tile, "na", "n", bits(F.col("b").bitwiseAND(F.col("_p"))).alias("nb"))
    inter = met.groupBy(*tile, "na", "nb").agg(F.sum("n").alias("inter"))
    counted = wanted.join(inter, [*tile, "na", "nb"]).select("_f", "a_id", "b_id", "inter")
    area = runs.groupBy(F.col("mask_id").alias("_id")).agg(F.sum(F.col("e") - F.col("s")).alias("_area"))
    out = pairs.withColumn("_f", f).join(counted, ["_f", "a_id", "b_id"], "left")
    for side in ("a", "b"):
        out = out.join(area.withColumnRenamed("_area", f"area_{side}"), F.col(f"{side}_id") == F.col("_id"), "left").drop("_id")
    out = out.select(*pairs.columns, *[F.coalesce(c, zero).alias(c) for c in ("area_a", "area_b", "inter")])
    return out.withColumn("union", F.col("area_a") + F.col("area_b") - F.col("inter"))


# --- scores -----------------------------------------------------------------------------


def score_columns(inter: Column, area_a: Column, area_b: Column, empty: str) -> dict[str, Column]:
    """IoU and Dice.  ``empty`` decides empty-on-empty: ``eps`` 0, ``one`` 1, ``null`` none."""
    if empty not in EMPTY_RULES:
        raise ValueError(f"empty must be one of {EMPTY_RULES}, got {empty!r}")
    union, total = area_a + area_b - inter, area_a + area_b
    if empty == "eps":
        return {"iou": inter / (union + F.lit(1e-6)), "dice": 2 * inter / (total + F.lit(1e-6))}
    none = F.lit(1.0) if empty == "one" else F.lit(None).cast("double")
    return {
        "iou": F.when(union == 0, none).otherwise(F.try_divide(inter, union)),
        "dice": F.when(total == 0, none).otherwise(F.try_divide(2 * inter, total)),
    }


def mask_scores(overlap: DataFrame, empty: str) -> DataFrame:
    """Add ``iou`` and ``dice`` to an overlap table."""
    return overlap.withColumns(score_columns(F.col("inter"), F.col("area_a"), F.col("area_b"), empty))


def region_j(overlap: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean region similarity: mean IoU with empty-on-empty counted as 1."""
    scored = mask_scores(overlap, "one")
    return scored.groupBy(*keys).agg(F.avg("iou").alias("mean_j"), F.count("iou").alias("objects"))


def size_gate(pairs: DataFrame, headers_a: DataFrame, headers_b: DataFrame) -> DataFrame:
    """Pairs with ``same_size``; score only the true ones, report the rest."""
    a = headers_a.select(F.col("mask_id").alias("a_id"), F.col("h").alias("h_a"), F.col("w").alias("w_a"))
    b = headers_b.select(F.col("mask_id").alias("b_id"), F.col("h").alias("h_b"), F.col("w").alias("w_b"))
    rows = pairs.join(a, "a_id").join(b, "b_id")
    return rows.withColumn("same_size", (F.col("h_a") == F.col("h_b")) & (F.col("w_a") == F.col("w_b")))


def compare_masks(scored: DataFrame, episode: str) -> DataFrame:
    """Mean IoU of two mask sets per episode."""
    return scored.groupBy(episode).agg(F.avg("iou").alias("mean_iou"), F.count(F.lit(1)).alias("frames"))


# --- ids, extents, hashes ----------------------------------------------------------------


def mask_from_ids(id_runs: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intervals of the wanted instance ids, merged into one mask per key."""
    on = [c for c in ids.columns if c in id_runs.columns]
    return mask_union(id_runs.join(ids, on, "left_semi"), keys)


def mask_extent(runs: DataFrame, headers: DataFrame, key: str = "mask_id") -> DataFrame:
    """Pixel extent per non-empty mask; an interval that crosses a column spans all rows."""
    rows = runs.join(headers.select(key, "h", "w"), key)
    s, last, h = F.col("s"), F.col("e") - 1, F.col("h")
    crosses = F.floor(s / h) < F.floor(last / h)
    return rows.groupBy(key, "h", "w").agg(
        F.min(F.floor(s / h)).alias("x0"),
        F.max(F.floor(last / h)).alias("x1"),
        F.min(F.when(crosses, F.lit(0).cast("bigint")).otherwise(s % h)).alias("y0"),
        F.max(F.when(crosses, (h - 1).cast("bigint")).otherwise(last % h)).alias("y1"),
    )


def mask_bbox(runs: DataFrame, headers: DataFrame, key: str = "mask_id") -> DataFrame:
    """Centre and size of the extent as fractions with 4 decimals; null for empty masks."""
    x0, x1, y0, y1, h, w = (F.col(c) for c in ("x0", "x1", "y0", "y1", "h", "w"))
    box = mask_extent(runs, headers, key).select(
        key,
        F.round((x0 + x1) / 2 / w, 4).alias("cx"),
        F.round((y0 + y1) / 2 / h, 4).alias("cy"),
        F.round((x1 - x0 + 1) / w, 4).alias("bw"),
        F.round((y1 - y0 + 1) / h, 4).alias("bh"),
    )
    return headers.select(key).join(box, key, "left")


def roi_union(df: DataFrame, box_arrays: Sequence[str], scale: str, extent: Sequence[str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """Smallest box over the mask extent (times ``scale``) and the point lists; null if there is nothing."""
    none = F.array().cast("array<array<double>>")
    ex = [F.col(c) * F.col(scale) for c in extent]
    mask_pts = F.when(
        F.col(extent[0]).isNotNull(),
        F.array(F.array(ex[0].cast("double"), ex[1].cast("double")), F.array(ex[2].cast("double"), ex[3].cast("double"))),
    )
    pts = F.concat(F.coalesce(mask_pts, none), *[F.coalesce(F.col(b), none) for b in box_arrays])
    xs, ys = F.transform(pts, lambda p: F.get(p, 0)), F.transform(pts, lambda p: F.get(p, 1))
    return df.withColumns(
        {"roi_x0": F.array_min(xs), "roi_y0": F.array_min(ys), "roi_x1": F.array_max(xs), "roi_y1": F.array_max(ys)}
    )


def sha_of(h: Column, w: Column, runs: Column) -> Column:
    """SHA-256 over size and ordered intervals (an array of structs; null: none)."""
    body = F.array_join(F.transform(runs, lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",")
    return F.sha2(F.concat_ws(";", h.cast("string"), w.cast("string"), F.coalesce(body, F.lit(""))), 256)


def mask_sha(runs: DataFrame, headers: DataFrame, key: str = "mask_id") -> DataFrame:
    """SHA-256 over size and ordered intervals; equal masks get equal hashes."""
    packed = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("r"))
    rows = headers.select(key, "h", "w").join(packed, key, "left")
    return rows.select(key, sha_of(F.col("h"), F.col("w"), F.col("r")).alias("mask_sha"))


def duplicate_masks(shas: DataFrame, key: str = "mask_id") -> DataFrame:
    """Hashes shared by several masks: size of the group and its smallest id."""
    grouped = shas.groupBy("mask_sha").agg(F.count(F.lit(1)).alias("masks"), F.min(key).alias("first_mask"))
    return grouped.filter(F.col("masks") > 1)


# --- points and polygons -----------------------------------------------------------------


def points_in_masks(points: DataFrame, runs: DataFrame, key: str = "mask_id") -> DataFrame:
    """Add ``inside`` to points (key, pos): as-of sweep, the last interval start at or before the position.

    Null for points without a position.

    Positions are made distinct first, so a mask asked about by a third of all points still
    reaches its window with at most ``h * w`` positions.
    """
    marks = runs.select(key, F.col("s").alias("pos"), F.col("e").alias("_e"), F.lit(False).alias("_asked"))
    asked = points.select(key, "pos").filter(F.col("pos").isNotNull()).distinct().select(key, "pos", F.lit(None).cast("bigint").alias("_e"), F.lit(True).alias("_asked"))
    w = Window.partitionBy(key).orderBy("pos", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.unionByName(asked).withColumn("_until", F.last("_e", ignorenulls=True).over(w)).filter("_asked")
    tested = seen.select(key, "pos", F.coalesce(F.col("pos") < F.col("_until"), F.lit(False)).alias("inside"))
    return points.join(tested, [key, "pos"], "left")


def _column_ranks(asked: DataFrame, columns: DataFrame, key: str) -> DataFrame:
    """For distinct ``(key, g)`` the number of the key's columns at or left of ``g``; a window holds at most two image widths."""
    marks = columns.select(key, F.col("c").alias("g"), F.lit(0).alias("_ask")).union(asked.select(key, "g", F.lit(1).alias("_ask")))
    upto = Window.partitionBy(key).orderBy("g", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("rank", F.sum(1 - F.col("_ask")).over(upto)).filter("_ask = 1").select(key, "g", "rank")


def _column_distances(asks: DataFrame, pixels: DataFrame, key: str) -> DataFrame:
    """The smallest squared distance per ``(key, x, y)`` to the pixels of the columns ``i`` it is paired with.

    ``asks``: key, x, y, ``i`` (column number), ``c`` (its position), ``gy`` (pixel row).  Within a column the nearest
    pixel is the last at or above the row or the first below; a window holds at most two image heights.
    """
    rows = pixels.select(key, "i", F.col("y").alias("gy"), F.col("y").alias("_y"), F.lit(0).alias("_ask"))
    rows = rows.union(asks.select(key, "i", "gy").distinct().select(key, "i", "gy", F.lit(None).cast("bigint").alias("_y"), F.lit(1).alias("_ask")))
    column = Window.partitionBy(key, "i")
    above = F.last("_y", ignorenulls=True).over(column.orderBy("gy", "_ask").rowsBetween(Window.unboundedPreceding, 0))
    below = F.last("_y", ignorenulls=True).over(column.orderBy(F.desc("gy"), F.desc("_ask")).rowsBetween(Window.unboundedPreceding, 0))
    near = rows.select(key, "i", "gy", "_ask", above.alias("_up"), below.alias("_down")).filter("_ask = 1").drop("_ask")
    met = asks.join(near, [key, "i", "gy"])
    dy = F.least(F.abs(F.col("_up") - F.col("y")), F.abs(F.col("_down") - F.col("y")))
    return met.groupBy(key, "x", "y").agg(F.min((F.col("c") - F.col("x")) ** 2 + dy**2).alias("d2"))


def nearest_pixels(points: DataFrame, pixels: DataFrame, key: str = "mask_id") -> DataFrame:
    """Exact distance of each distinct point ``(key, x, y)`` to the nearest of the key's pixels: ``key, x, y, near``.

    A separable distance transform, looked up per point: columns of pixels next to the point give a distance that only
    columns nearer than that can better, and within each column sorted neighbours decide.  No row carries a set of
    pixels.  Pixels have whole coordinates (others count as the pixel that holds them); points may lie anywhere.  Points
    without finite coordinates, or of keys without pixels, give no row.
    """
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in ("x", "y")]
    asks = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(finite[0] & finite[1]).distinct()
    pixels = pixels.select(key, F.floor("x").cast("bigint").alias("c"), F.floor("y").cast("bigint").alias("y")).filter("c is not null and y is not null").distinct()
    columns = pixels.select(key, "c").distinct().withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("c")).cast("bigint"))
    columns = published(columns)
    pixels = published(pixels.join(columns, [key, "c"]))
    box = published(pixels.groupBy(key).agg(F.min("c").alias("_c0"), F.max("c").alias("_c1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.max("i").alias("_n")))
    # beyond the box all positions have the same neighbours
    inside = lambda v, lo, hi: F.greatest(F.least(F.floor(v).cast("bigint"), F.col(hi)), F.col(lo) - 1)
    asks = asks.join(box, key).select(key, "x", "y", "_c0", "_c1", "_n", inside(F.col("y"), "_y0", "_y1").alias("gy"), inside(F.col("x"), "_c0", "_c1").alias("g"))
    asks = asks.join(_column_ranks(asks.select(key, "g").distinct(), columns, key), [key, "g"])
    asks = published(asks.drop("g"))

    def paired(rows: DataFrame, numbers: Column) -> DataFrame:
        return rows.select(key, "x", "y", "gy", F.explode(numbers).alias("i")).join(columns, [key, "i"])

    beside = F.filter(F.array(F.col("rank"), F.col("rank") + 1), lambda i: (i >= 1) & (i <= F.col("_n")))
    first = published(_column_distances(paired(asks, beside), pixels, key))
    # columns strictly nearer than what was found
    reach = asks.join(first, [key, "x", "y"]).withColumn("_r", F.sqrt("d2"))
    reach = reach.withColumns({"_a": inside(F.col("x") - F.col("_r"), "_c0", "_c1"), "_b": inside(F.ceil(F.col("x") + F.col("_r")) - 1, "_c0", "_c1")})
    marks = _column_ranks(reach.select(key, F.col("_a").alias("g")).union(reach.select(key, "_b")).distinct(), columns, key)
    for end in ("_a", "_b"):
        reach = reach.join(marks.select(key, F.col("g").alias(end), F.col("rank").alias(f"{end}_rank")), [key, end])
    between = F.when(F.col("_b_rank") > F.col("_a_rank"), F.sequence(F.col("_a_rank") + 1, F.col("_b_rank")))
    wanted = F.filter(between, lambda i: (i != F.col("rank")) & (i != F.col("rank") + 1))
    more = _column_distances(paired(reach, wanted), pixels, key).withColumnRenamed("d2", "_d2")
    return first.join(more, [key, "x", "y"], "left").select(key, "x", "y", F.sqrt(F.least("d2", "_d2")).alias("near"))


def cycle_evidence(
    points: DataFrame, runs: DataFrame, reference: DataFrame, heights: DataFrame, keys: Sequence[str] = ("mask_id", "expert")
) -> DataFrame:
    """Per (mask, expert): returned points inside the query mask and mean distance to the nearest reference point.

    ``points`` and ``reference`` carry x, y.  A group with any non-finite point is not valid.  Reference points are
    pixels of the query mask (:func:`nearest_pixels`).
    """
    mask = keys[0]
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = points.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    rows = rows.join(nearest_pixels(points, reference, mask), [mask, "x", "y"], "left").join(heights.select(mask, "h", "w"), mask)
    ok = finite(F.col("x")) & finite(F.col("y"))
    x, y = F.floor(F.col("x")), F.floor(F.col("y"))
    on_image = ok & (x >= 0) & (y >= 0) & (x < F.col("w")) & (y < F.col("h"))
    pos = F.when(on_image, x * F.col("h") + y).otherwise(F.lit(-1).cast("bigint"))
    prepared = rows.select(*keys, pos.alias("pos"), ok.alias("ok"), F.when(ok, F.col("near")).alias("near"))
    tested = points_in_masks(prepared, runs, mask)
    valid = F.bool_and("ok")
    return tested.groupBy(*keys).agg(
        F.when(valid, F.count_if("inside")).alias("inside_count"),
        F.when(valid, F.avg("near")).alias("cycle_distance"),
        valid.alias("valid"),
    )


def prompt_qa(prompts: DataFrame, runs: DataFrame) -> DataFrame:
    """Per task: positive points outside, negative points inside, boxes beyond [0, 1], and the flag.

    ``prompts``: task, mask_id, pos, positive (boolean), box (array of 4 fractions or null).
    A prompt without a position (a box alone) is checked by its box.
    """
    tested = points_in_masks(prompts, runs, "mask_id")
    bad_box = F.exists("box", lambda v: (v < 0) | (v > 1))
    out = tested.groupBy("task").agg(
        F.count_if(F.col("positive") & ~F.col("inside")).alias("positive_outside"),
        F.count_if(~F.col("positive") & F.col("inside")).alias("negative_inside"),
        F.count_if(F.coalesce(bad_box, F.lit(False))).alias("bad_boxes"),
    )
    return out.withColumn("flagged", (F.col("positive_outside") + F.col("negative_inside") + F.col("bad_boxes")) > 0)


def polygon_stats(polygons: DataFrame, meta: DataFrame, key: str = "base") -> DataFrame:
    """Scaled-down vertices (truncated to pixels), shoelace area, extent and vertex count per polygon."""
    rows = polygons.join(meta.select(key, "scale"), key)
    px = F.transform("points", lambda p: F.transform(p, lambda v: (v / F.col("scale")).cast("bigint")))
    rows = rows.withColumn("_v", px).withColumn("_n", F.size("_v"))
    v, n = F.col("_v"), F.col("_n")
    cross = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get(F.get(v, i), 0) * F.get(F.get(v, (i + 1) % n), 1)
        - F.get(F.get(v, (i + 1) % n), 0) * F.get(F.get(v, i), 1),
    )
    twice = F.aggregate(cross, F.lit(0).cast("bigint"), lambda acc, c: acc + c)
    xs, ys = F.transform(v, lambda p: F.get(p, 0)), F.transform(v, lambda p: F.get(p, 1))
    keep = [c for c in polygons.columns if c != "points"]
    return rows.select(
        *keep,
        n.cast("bigint").alias("vertices"),
        (F.abs(F.when(n >= 3, twice).otherwise(F.lit(0))) / 2).alias("area"),
        F.array_min(xs).alias("x0"),
        F.array_min(ys).alias("y0"),
        F.array_max(xs).alias("x1"),
        F.array_max(ys).alias("y1"),
    )


# --- series over frames --------------------------------------------------------------------


def mask_centroid(runs: DataFrame, headers: DataFrame, key: str = "mask_id") -> DataFrame:
    """Centre of mass, summed in closed form over the column pieces of each interval."""
    rows = runs.join(headers.select(key, "h"), key)
    h, s, last = F.col("h"), F.col("s"), F.col("e") - 1
    cols = rows.select(key, "h", "s", "e", F.explode(F.sequence(F.floor(s / h), F.floor(last / h))).alias("c"))
    top = F.greatest(F.col("s") - F.col("c") * F.col("h"), F.lit(0).cast("bigint"))
    low = F.least(F.col("e") - 1 - F.col("c") * F.col("h"), (F.col("h") - 1).cast("bigint"))
    n = low - top + 1
    return cols.groupBy(key).agg(
        (F.sum(F.col("c") * n) / F.sum(n)).alias("x"), (F.sum(n * (top + low)) / 2 / F.sum(n)).alias("y")
    )


def centroid_drift(centroids: DataFrame, video: str, frame: str, buckets: int | None = None) -> DataFrame:
    """Distance of the centroid to that of the previous frame of the same video."""
    rows = ordered_scan(centroids, [frame], [video], previous={"px": "x", "py": "y"}, buckets=buckets)
    drift = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
    return rows.withColumn("drift", drift).drop("px", "py")


def area_jumps(masks: DataFrame, video: str, frame: str, floor: int = 200, share: float = 0.6) -> DataFrame:
    """Previous area per frame and whether the change exceeds ``max(floor, share * previous)``."""
    rows = ordered_scan(masks, [frame], [video], previous={"prev_area": "area"})
    limit = F.greatest(F.lit(float(floor)), F.col("prev_area") * share)
    return rows.withColumn("jump", F.coalesce(F.abs(F.col("area") - F.col("prev_area")) > limit, F.lit(False)))


def propagation_qa(masks: DataFrame, anchors: DataFrame, old: DataFrame, video: str, frame: str) -> DataFrame:
    """Per video: mean anchor IoU, coverage, area jumps and agreement with an older mask set.

    ``masks``: video, frame, area.  ``anchors`` and ``old``: video plus ``inter`` and ``union`` of
    the compared frames.  Agreement is a ratio of sums and is null when nothing overlaps.
    """
    jumps = area_jumps(masks, video, frame).groupBy(video).agg(
        F.avg((F.col("area") > 0).cast("double")).alias("coverage"), F.count_if("jump").alias("area_jumps")
    )
    one = F.when(F.col("union") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("inter"), F.col("union")))
    hit = anchors.groupBy(video).agg(F.avg(one).alias("anchor_iou"))
    agree = old.groupBy(video).agg(F.try_divide(F.sum("inter"), F.sum("union")).alias("agreement"))
    return jumps.join(hit, video, "left").join(agree, video, "left")


def prediction_flags(masks: DataFrame, video: str, share: str = "share", total: str | None = None) -> DataFrame:
    """``blowup`` if any frame exceeds 70 % of the image, else ``mostly-empty`` below 20 % non-empty frames."""
    n = F.max(total) if total else F.count(F.lit(1))
    out = masks.groupBy(video).agg(F.max(share).alias("max_share"), F.count_if(F.col(share) > 0).alias("nonempty"), n.alias("frames"))
    flag = F.when(F.col("max_share") > 0.7, "blowup").when(F.col("nonempty") < F.col("frames") * 0.2, "mostly-empty")
    return out.withColumn("flag", F.coalesce(flag, F.lit("")))


# Mask-area bins in pixels.
AREA_BINS = ((1000, "<1k"), (5000, "1k-5k"), (20000, "5k-20k"))


def area_profile(masks: DataFrame, area: str = "area", bins: Sequence[tuple[int, str]] = AREA_BINS, top: str = ">=20k") -> DataFrame:
    """One row per bin with count and share, next to the table's min / median / mean / max; one pass."""
    a, edges = F.col(area), [None, *[limit for limit, _ in bins], None]
    names = [name for _, name in bins] + [top]
    inside = lambda lo, hi: (F.lit(True) if lo is None else a >= lo) & (F.lit(True) if hi is None else a < hi)
    stats = masks.agg(
        F.count(area).alias("_n"),
        F.min(area).alias("min_area"),
        F.avg(area).alias("mean_area"),
        F.max(area).alias("max_area"),
        *[F.count_if(inside(edges[i], edges[i + 1])).alias(f"_b{i}") for i in range(len(names))],
    )
    median = exact_rank_value(masks.select(area), [], area, upper=False, name="median_area")
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("bin"), F.col(f"_b{i}").alias("masks")) for i, n in enumerate(names)]))
    out = stats.withColumn("median_area", median.scalar()).select("*", rows)
    out = out.withColumn("share", F.try_divide(F.col("masks"), F.col("_n")))
    return out.select("bin", "masks", "share", "min_area", "median_area", "mean_area", "max_area")


def resolve_masks(tasks: DataFrame, base_runs: DataFrame, region_runs: DataFrame, key: str = "task") -> DataFrame:
    """Final mask: an edited base region replaces; new regions are united with the base; no base -> the regions.

    ``tasks``: key, edited (boolean).  Both run tables are keyed by ``key``.
    """
    kept = base_runs.join(tasks.filter(~F.coalesce("edited", F.lit(False))).select(key), key, "left_semi")
    return mask_union(kept.select(key, "s", "e").unionByName(region_runs.select(key, "s", "e")), [key])
