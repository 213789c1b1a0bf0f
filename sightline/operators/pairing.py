"""Joins of views, masks, metadata and time.

No side is broadcast by hint: Spark does that by measured size, and splits skewed
partitions of the shuffle joins otherwise (adaptive execution).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.columns import align_frame, map_state, parse_raw_path


def attach_masks(episodes: DataFrame, mask_map: DataFrame, key: str = "video_id", value: str = "npz") -> DataFrame:
    """Episode rows with ``map_present`` and ``map_state``; every episode row is kept."""
    m = mask_map.select(key, value, F.lit(True).alias("map_present"))
    rows = episodes.join(m, key, "left").withColumn("map_present", F.coalesce("map_present", F.lit(False)))
    return rows.withColumn("map_state", map_state("map_present", value))


def restrict_keys(mask_map: DataFrame, keys: DataFrame, key: str = "video_id", value: str = "npz") -> DataFrame:
    """Map restricted to a key list; listed keys without entry stay, with a null value."""
    return keys.select(key).distinct().join(mask_map.select(key, value), key, "left")


def pair_views(df: DataFrame, base: str = "base", view: str = "view", value: str = "value", views: tuple[str, str] = ("1", "2")) -> DataFrame:
    """One row per base that has both views, whatever their values (presence is counted, not inferred)."""
    at = lambda v: F.max(F.when(F.col(view) == v, F.col(value)))
    has = lambda v: F.count_if(F.col(view) == v) > 0
    rows = df.filter(F.col(view).isin(*views)).groupBy(base).agg(
        at(views[0]).alias("value_1"), at(views[1]).alias("value_2"), has(views[0]).alias("_h1"), has(views[1]).alias("_h2")
    )
    return rows.filter("_h1 AND _h2").drop("_h1", "_h2")


def primary_other(keys: DataFrame, mask_map: DataFrame, key: str, other: Column, value: str = "npz") -> DataFrame:
    """Primary key with its own value and that of the derived other key; presence in separate columns."""
    rows = keys.withColumn("other_key", other)
    p = mask_map.select(F.col(key), F.col(value).alias("primary_value"), F.lit(True).alias("primary_present"))
    o = mask_map.select(F.col(key).alias("other_key"), F.col(value).alias("other_value"), F.lit(True).alias("other_present"))
    out = rows.join(p, key, "left").join(o, "other_key", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("primary_present", "other_present")})


def _pair_literals(vocabulary: Sequence[str], directed: bool) -> Column:
    pairs = permutations(sorted(vocabulary), 2) if directed else combinations(sorted(vocabulary), 2)
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])


def view_combinations(df: DataFrame, group: Sequence[str], item: str, vocabulary: Sequence[str], directed: bool = False) -> DataFrame:
    """Pairs ``a < b`` (or both directions) of the views present in each card.

    The camera vocabulary is fixed, so a card turns into a set of at most ``len(vocabulary)``
    names map-side and its pairs are read off a constant list: no self-join, and a card with
    a third of all rows costs as much as any other.
    """
    present = df.groupBy(*group).agg(F.collect_set(F.when(F.col(item).isin(*vocabulary), F.col(item))).alias("_has"))
    wanted = F.filter(
        _pair_literals(vocabulary, directed),
        lambda p: F.array_contains("_has", p["a"]) & F.array_contains("_has", p["b"]),
    )
    return present.select(*group, F.inline(wanted))


def prompt_frames(px: DataFrame, card: str, view: str, t: str, visible: Column, vocabulary: Sequence[str]) -> DataFrame:
    """First step at which both views of a directed pair see the target, per card and pair."""
    together = view_combinations(px.filter(visible), [card, t], view, vocabulary, directed=True)
    return together.groupBy(card, F.col("a").alias("source"), F.col("b").alias("target")).agg(F.min(t).alias("prompt_t"))


def in_split(df: DataFrame, keys: DataFrame, on: Sequence[str], name: str = "in_split") -> DataFrame:
    flag = keys.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(flag, list(on), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def only_split(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def enrich_scenes(
    entries: DataFrame, rawmap: DataFrame, meta: DataFrame, key: str, prefix: str, tail: str, attributes: Sequence[str] = ("scene_id", "building", "current_task")
) -> DataFrame:
    """id -> raw path -> metadata.

    ``enrich_status``: ``ok``; ``no_raw_path`` (nothing filled); ``no_metadata`` (lab and date from the path).
    """
    parts = parse_raw_path("raw_path", prefix, tail)
    rows = entries.join(rawmap.select(key, "raw_path"), key, "left").withColumn("_p", parts)
    m = meta.select(key, F.col("lab").alias("_lab"), *attributes, F.lit(True).alias("_meta"))
    rows = rows.join(m, key, "left")
    known, found = F.col("raw_path").isNotNull(), F.col("_meta").isNotNull()
    status = F.when(~known, "no_raw_path").when(found, "ok").otherwise("no_metadata")
    return rows.select(
        *entries.columns,
        *[F.when(known, F.col(a)).alias(a) for a in attributes],
        F.when(known & found, F.col("_lab")).when(known, F.col("_p.lab")).alias("lab"),
        F.when(known & ~found, F.col("_p.collect_date")).alias("collect_date"),
        status.alias("enrich_status"),
    )


def reconcile_index(members: DataFrame, mapping: DataFrame, key: str, group: Sequence[str] = ()) -> DataFrame:
    """Counts per class of names in both listings, only in the archive, only in the mapping."""
    a = members.select(*group, key).distinct().withColumn("_a", F.lit(1))
    b = mapping.select(*group, key).distinct().withColumn("_b", F.lit(1))
    rows = a.join(b, [*group, key], "full_outer")
    both, la, lb = F.col("_a") + F.col("_b"), F.col("_b").isNull(), F.col("_a").isNull()
    out = rows.groupBy(*group).agg(
        F.count(both).alias("both"), F.count_if(la).alias("only_members"), F.count_if(lb).alias("only_mapping")
    )
    return out.withColumn("agrees", (F.col("only_members") == 0) & (F.col("only_mapping") == 0))


def align_frames(picks: DataFrame, views: DataFrame, card: str, t: str = "t") -> DataFrame:
    """Every picked step in every view of its card, at the same fraction of the episode.

    ``views``: card, view, n_frames.  The views of a card come from a short camera list, so they are
    folded into one array per card and the join stays one-to-many on the card.
    """
    folded = views.groupBy(card).agg(F.min("n_frames").alias("t_min"), F.array_sort(F.collect_set(F.struct("view", "n_frames"))).alias("_v"))
    rows = picks.join(folded, card).select(*picks.columns, "t_min", F.inline("_v"))
    return rows.withColumn("local_t", align_frame(t, "t_min", "n_frames"))
