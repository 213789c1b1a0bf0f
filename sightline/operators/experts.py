"""Choice between predictors without ground truth, and its audits.

Evidence: one row per (object, expert) with ``inside_count``, ``cycle_distance``, ``valid``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.ordered import dealt, tasks_for

# Preference among equal experts, and the order tried when no cycle is valid.
EXPERT_ORDER = ("A", "B", "C")
FALLBACK_ORDER = ("C", "B", "A")


def _rank(expert: Column, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(e) for e in order]), expert)


def select_expert(
    evidence: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = EXPERT_ORDER,
    fallback: Sequence[str] = FALLBACK_ORDER,
    query_empty: str | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Valid cycle -> most points inside -> smallest distance -> expert order; else the fallback order.

    One aggregation over the evidence: the winner is a minimum over a struct key.
    ``query_empty`` names a boolean column that sends the object to ``fallback_empty_query``; ``carry`` names columns
    of the chosen row that come along.
    """
    return _ranked(evidence, keys, order, fallback, query_empty, F.lit(False), carry).filter("_known > 0").drop("_known", "_flag")


def _ranked(
    evidence: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fallback: Sequence[str],
    query_empty: str | None,
    flag: Column,
    carry: Sequence[str] = (),
) -> DataFrame:
    """:func:`select_expert` with the number of rows of known experts, and whether any row has the flag.

    Aggregates over structs sort their rows, so the evidence is dealt by its keys to tasks of bounded size before.
    """
    d = F.col("cycle_distance")
    known = F.coalesce(F.col("expert").isin(*order), F.lit(False))
    ok = known & F.coalesce(F.col("valid"), F.lit(False)) & d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    key = F.struct(
        (-F.col("inside_count")).alias("inside"), d.alias("dist"), _rank(F.col("expert"), order).alias("rank")
    )
    back = F.struct(_rank(F.col("expert"), fallback).alias("rank"))
    empty = F.bool_or(known & F.coalesce(F.col(query_empty), F.lit(False))) if query_empty else F.lit(False)
    row = F.struct("expert", *carry)
    best = dealt(evidence, keys, tasks_for(evidence)).groupBy(*keys).agg(
        F.min_by(F.when(ok, row), F.when(ok, key)).alias("_cycle"),
        F.min_by(F.when(known, row), F.when(known, back)).alias("_back"),
        empty.alias("_empty"),
        F.count_if(ok).alias("valid_experts"),
        F.count_if(known).alias("_known"),
        F.bool_or(flag).alias("_flag"),
    )
    cycle = ~F.col("_empty") & F.col("_cycle").isNotNull()
    reason = F.when(F.col("_empty"), "fallback_empty_query").when(cycle, "cycle").otherwise("fallback_no_cycle")
    chosen = F.when(cycle, F.col("_cycle")).otherwise(F.col("_back"))
    return best.select(
        *keys,
        chosen["expert"].alias("selected"),
        reason.alias("reason"),
        "valid_experts",
        *[chosen[c].alias(c) for c in carry],
        "_known",
        "_flag",
    )


def fusion_first(
    evidence: DataFrame, quality_ok: Column, keys: Sequence[str], fusion: str = "C", order: Sequence[str] = EXPERT_ORDER
) -> DataFrame:
    """Take the fusion expert when its quality passes, else the best cycle among the others."""
    others = [e for e in order if e != fusion]
    passes = F.coalesce(F.col("expert") == fusion, F.lit(False)) & F.coalesce(quality_ok, F.lit(False))
    rows = _ranked(evidence, keys, others, list(reversed(others)), None, passes)
    some = F.col("_known") > 0
    return rows.select(
        *keys,
        F.when(F.col("_flag"), fusion).when(some, F.col("selected")).alias("selected"),
        F.when(F.col("_flag"), "fusion_quality").when(some, F.col("reason")).alias("reason"),
    )


def selection_distribution(decisions: DataFrame, setting: Sequence[str], experts: Sequence[str] = EXPERT_ORDER) -> DataFrame:
    """Counts per expert, objects and cycle uses per setting."""
    return decisions.groupBy(*setting).agg(
        F.count(F.lit(1)).alias("objects"),
        F.count_if(F.col("reason") == "cycle").alias("cycle_uses"),
        *[F.count_if(F.col("selected") == e).alias(f"n_{e}") for e in experts],
    )


def expert_means(scored: DataFrame, expert: str = "expert", metric: str = "iou") -> DataFrame:
    return scored.groupBy(expert).agg(F.avg(metric).alias(f"mean_{metric}"), F.count(metric).alias("objects"))


def audit_selected(decisions: DataFrame, candidates: DataFrame, keys: Sequence[str], sha: str = "mask_sha") -> DataFrame:
    """Decisions whose mask hash is not the hash of the chosen candidate."""
    c = candidates.select(*keys, F.col("expert").alias("selected"), F.col(sha).alias("candidate_sha"))
    tasks, on = tasks_for(candidates), [*keys, "selected"]
    rows = dealt(decisions, on, tasks).join(dealt(c, on, tasks), on, "left")
    return rows.filter(~F.col(sha).eqNullSafe(F.col("candidate_sha"))).select(*keys, "selected", sha, "candidate_sha")


def audit_selection_totals(dist: DataFrame, experts: Sequence[str] = EXPERT_ORDER) -> DataFrame:
    """Settings whose per-expert counts do not add up to the evaluated objects."""
    total = sum((F.col(f"n_{e}") for e in experts), F.lit(0))
    return dist.withColumn("selected_total", total).filter(F.col("selected_total") != F.col("objects"))


def audit_gt_isolation(inference: DataFrame, select, gt_columns: Sequence[str], variants: Sequence[DataFrame]) -> DataFrame:
    """Findings: ground-truth columns in the inference table, and decisions that change with the ground truth.

    ``select`` maps an evidence table to decisions; ``variants`` are the inference table with real,
    random, zero or absent ground truth attached.
    """
    base = select(inference)
    found = [c for c in inference.columns if c in gt_columns]
    columns = inference.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in found]).cast("array<string>")).alias("finding")
    )
    out = columns.select(F.concat(F.lit("column:"), F.col("finding")).alias("finding"))
    for i, variant in enumerate(variants):
        other = select(variant).select(*base.columns)
        changed = base.exceptAll(other).unionByName(other.exceptAll(base))
        out = out.unionByName(changed.select(F.lit(f"variant {i}: decision changed").alias("finding")))
    return out
