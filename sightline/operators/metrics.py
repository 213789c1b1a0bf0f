"""Aggregation rules for per-object scores, and the comparison tables built from them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.functions.stable import poisson_draw, poisson_weight
from sightline.operators.ordered import cut_group, ordered_scan, prefix_totals
from sightline.session import published

# --- metric registry ----------------------------------------------------------------------


@dataclass(frozen=True)
class MetricSpec:
    """A per-object score: its name, the expression that yields it and its direction."""

    name: str
    per_object_expr: Column
    higher_is_better: bool = True


@dataclass
class MetricRegistry:
    specs: dict[str, MetricSpec] = field(default_factory=dict)

    def register(self, name: str, per_object_expr: Column, higher_is_better: bool = True) -> MetricSpec:
        if name in self.specs:
            raise ValueError(f"metric {name!r} already registered")
        self.specs[name] = MetricSpec(name, per_object_expr, higher_is_better)
        return self.specs[name]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({s.name: s.per_object_expr for s in self.specs.values()})

    def names(self) -> list[str]:
        return list(self.specs)


# --- object tables -------------------------------------------------------------------------


def explode_pairs(pairs: DataFrame, keep: Sequence[str] = ("shard_no",)) -> DataFrame:
    """Array-per-pair records -> one row per object with its position."""
    zipped = F.arrays_zip(F.col("ious").alias("iou"), F.col("dices").alias("dice"))
    rows = pairs.select(*keep, "pair_idx", F.posexplode_outer(zipped).alias("obj_idx", "o"))
    return rows.select(*keep, "pair_idx", "obj_idx", F.col("o.iou").alias("iou"), F.col("o.dice").alias("dice"))


def global_ordinal(objects: DataFrame, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Position of each object in (shard, pair, object) order over all shards."""
    return ordered_scan(objects, order, ordinal=name)


def deinterleave(df: DataFrame, world: int, rank: str = "rank", index: str = "index", name: str = "global_index") -> DataFrame:
    """Undo round-robin sampling over ``world`` ranks."""
    return df.withColumn(name, F.col(index) * world + F.col(rank))


# --- the lattice ----------------------------------------------------------------------------


def _per_pair(objects: DataFrame, pair: Sequence[str], metrics: Sequence[str], on_empty: str) -> DataFrame:
    """Counts, sums and means per pair.  A pair without objects has a null score row (outer explode)."""
    empty = F.lit(float("nan")) if on_empty == "nan" else F.lit(None).cast("double")
    return objects.groupBy(*pair).agg(
        F.count(metrics[0]).alias("n_obj"),
        *[F.sum(m).alias(f"sum_{m}") for m in metrics],
        *[F.coalesce(F.avg(m), empty).alias(f"mean_{m}") for m in metrics],
    )


def metric_lattice(
    objects: DataFrame,
    pair: Sequence[str],
    order: Sequence[str],
    metrics: Sequence[str] | MetricRegistry = ("iou", "dice"),
    on_empty: str = "nan",
    buckets: int | None = None,
) -> DataFrame:
    """One row: stock (first ``n_pairs`` objects), per-object and per-pair means with counts.

    ``order`` starts with the pair columns and identifies an object.  ``on_empty='nan'`` lets a
    pair without objects poison the per-pair mean, as a mean of an empty list does;
    ``'skip'`` leaves it out.  ``metrics`` are columns, or a registry whose metrics are computed first.
    """
    if on_empty not in ("nan", "skip"):
        raise ValueError("on_empty must be 'nan' or 'skip'")
    if isinstance(metrics, MetricRegistry):
        objects, metrics = metrics.apply(objects), list(metrics.specs)
    groups = published(_per_pair(objects, pair, metrics, on_empty))  # one pass over the objects
    per_pair = groups.agg(F.count(F.lit(1)).alias("n_pairs"), *[F.avg(f"mean_{m}").alias(f"perpair_{m}") for m in metrics]).first()
    n_pairs = per_pair["n_pairs"]
    sums = _first_objects(objects, groups, pair, order, n_pairs, metrics, buckets)
    dropped = F.greatest(F.lit(0).cast("bigint"), F.col("total_n") - n_pairs)
    return sums.select(
        F.lit(n_pairs).cast("bigint").alias("n_pairs"),
        F.col("total_n").alias("n_objects"),
        dropped.alias("dropped"),
        F.coalesce(F.try_divide(dropped * 100.0, F.col("total_n")), F.lit(0.0)).alias("dropped_pct"),
        *[F.try_divide(F.col(f"prefix_{m}"), F.col("prefix_n")).alias(f"stock_{m}") for m in metrics],
        *[F.try_divide(F.col(f"total_{m}"), F.col("total_n")).alias(f"perobject_{m}") for m in metrics],
        *[F.lit(per_pair[f"perpair_{m}"]).cast("double").alias(f"perpair_{m}") for m in metrics],
    )


def _first_objects(
    objects: DataFrame, groups: DataFrame, pair: Sequence[str], order: Sequence[str], n: int, metrics: Sequence[str], buckets: int | None
) -> DataFrame:
    """One row: count and sums of the first ``n`` scored objects (``prefix_``) and of all (``total_``).

    Pairs are a prefix of the order, so whole pairs come from their sums; of the objects only those of
    the pair with the cut are read again.
    """
    before, whole, cut, take = cut_group(groups, pair, "n_obj", n, [f"sum_{m}" for m in metrics], buckets)
    inside = F.lit(False) if cut is None else reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(cut[c])) for c in pair])
    # the cut pair may hold a third of all objects: only the range of its order that the cut falls into is sorted
    first = prefix_totals(objects.filter(inside & F.col(metrics[0]).isNotNull()), order, take, metrics, buckets)
    return first.select(
        (F.col("prefix_n") + before[0]).alias("prefix_n"),
        *[(F.col(f"prefix_{m}") + float(before[i + 1])).alias(f"prefix_{m}") for i, m in enumerate(metrics)],
        F.lit(whole[0] if whole else 0).cast("bigint").alias("total_n"),
        *[F.lit(float(whole[i + 1])).alias(f"total_{m}") for i, m in enumerate(metrics)],
    )


def truncation_audit(objects: DataFrame, pair: Sequence[str], order: Sequence[str], metric: str = "iou", buckets: int | None = None) -> DataFrame:
    """Mean of the kept prefix, of the dropped tail and of all objects."""
    groups = published(_per_pair(objects, pair, [metric], "skip"))
    sums = _first_objects(objects, groups, pair, order, groups.count(), [metric], buckets)
    kept, total = F.col("prefix_n"), F.col("total_n")
    kept_sum, total_sum = F.col(f"prefix_{metric}"), F.col(f"total_{metric}")
    return sums.select(
        total.alias("n_objects"),
        kept.alias("kept"),
        (total - kept).alias("dropped"),
        F.try_divide((total - kept) * 100.0, total).alias("dropped_pct"),
        F.try_divide(kept_sum, kept).alias("prefix_mean"),
        F.try_divide(total_sum - kept_sum, total - kept).alias("tail_mean"),
        F.try_divide(total_sum, total).alias("full_mean"),
    )


def legacy_lattice(objects: DataFrame, pair: Sequence[str], order: Sequence[str], metric: str = "iou") -> DataFrame:
    """Older rules: mean over the last object of each pair, and mean over positive scores only."""
    last = objects.groupBy(*pair).agg(F.max_by(metric, F.struct(*order)).alias("last"), F.sum(F.when(F.col(metric) > 0, F.col(metric))).alias("_pos"),
                                      F.count_if(F.col(metric) > 0).alias("_npos"))
    return last.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("last").alias("last_object_mean"),
        F.try_divide(F.sum("_pos"), F.sum("_npos")).alias("positive_mean"),
        F.sum("_npos").alias("positive_objects"),
    )


def threshold_rates(df: DataFrame, group: Sequence[str], metric: str = "iou", at: float = 0.5) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count(metric).alias("objects"),
        F.avg((F.col(metric) == 0).cast("double")).alias("zero_share"),
        F.avg((F.col(metric) >= at).cast("double")).alias("hit_share"),
    )


def subset_means(df: DataFrame, flag: str, group: Sequence[str] = (), metric: str = "iou") -> DataFrame:
    """Mean where ``flag`` holds, where it does not, and overall."""
    return df.groupBy(*group).agg(
        F.avg(F.when(F.col(flag), F.col(metric))).alias("flagged_mean"),
        F.avg(F.when(~F.col(flag), F.col(metric))).alias("other_mean"),
        F.avg(metric).alias("overall_mean"),
        F.count_if(flag).alias("flagged"),
    )


def metric_matrix(df: DataFrame, group: Sequence[str], frame: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Object-level and frame-level means per group; frame level averages frame means."""
    by_frame = df.groupBy(*group, *frame).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(m).alias(f"_s_{m}") for m in metrics],
        *[F.count(m).alias(f"_c_{m}") for m in metrics],
        *[F.avg(m).alias(f"_a_{m}") for m in metrics],
    )
    return by_frame.groupBy(*group).agg(
        F.sum("_n").alias("objects"),
        F.count(F.lit(1)).alias("frames"),
        *[F.try_divide(F.sum(f"_s_{m}"), F.sum(f"_c_{m}")).alias(f"object_{m}") for m in metrics],
        *[F.avg(f"_a_{m}").alias(f"frame_{m}") for m in metrics],
    )


# --- comparisons ---------------------------------------------------------------------------------


def rowwise_bootstrap(
    df: DataFrame, a: str, b: str, keys: Sequence[str], reps: int, seed: int = 0, portable: bool = False
) -> DataFrame:
    """Mean difference ``a - b`` with a 95 % percentile interval over ``reps`` weighted resamples.

    Each row draws a Poisson(1) weight per replicate from its key, so replicates need no sampling state; the work is
    rows times replicates (:func:`paired_bootstrap` does the same with bins).  A row meets one replicate at a time in a
    loop of its own: many side by side make a method of more than 8,000 bytes of bytecode, which the JVM interprets.
    Partial sums combine map-side: one row per replicate leaves a task.
    """
    diff = df.select(*keys, (F.col(a) - F.col(b)).alias("_d"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = diff.repartition(tasks, *keys)  # few small rows stand for many draws
    rows = rows.select("_d", *keys, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    rows = rows.select("_d", "rep", poisson_draw(*keys, "rep", seed=seed, portable=portable).alias("_h"))
    rows = rows.select("_d", "rep", poisson_weight("_h", portable).alias("_w"))
    per_rep = rows.groupBy("rep").agg(F.try_divide(F.sum(F.col("_d") * F.col("_w")), F.sum("_w")).alias("mean_diff"))
    ci = per_rep.agg(F.percentile("mean_diff", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    point = diff.agg(F.avg("_d").alias("mean_diff"), F.count("_d").alias("pairs"))
    out = point.withColumn("ci", ci.scalar())
    return out.select("pairs", "mean_diff", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"))


#: Replicates that a bin draws for in one row, and the largest mean whose Poisson distribution is tabulated.
DRAWS_PER_ROW, LARGEST_TABLE = 1_000, 1_000_000


def _poisson_tables(means: DataFrame) -> DataFrame:
    """Per distinct whole ``c``: ``lo`` and the cumulative probabilities ``cdf`` of a Poisson variable from ``lo`` on.

    Relative probabilities follow from one value to the next (times ``c``, divided by ``k``) within nine standard
    deviations; outside lies less than 1e-17.
    """
    c, reach = F.col("c"), 9 * F.sqrt("c") + 12
    rows = means.select("c").distinct().withColumn("lo", F.greatest(F.lit(0), F.floor(c - reach)).cast("bigint"))
    rows = rows.select("c", "lo", F.explode(F.sequence(F.col("lo"), F.ceil(c + reach).cast("bigint"))).alias("k"))
    one = Window.partitionBy("c")
    upto = one.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("k") == F.col("lo"), 0.0).otherwise(F.log(c) - F.log("k"))
    rows = rows.withColumn("_l", F.sum(step).over(upto))
    rows = rows.withColumn("_w", F.exp(F.col("_l") - F.max("_l").over(one)))
    rows = rows.withColumn("_p", F.sum("_w").over(upto) / F.sum("_w").over(one))
    return rows.groupBy("c", "lo").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "_p"))), lambda x: x["_p"]).alias("cdf"))


def _uniform(*parts: Column, seed: int, portable: bool) -> Column:
    """A number between 0 and 1 that depends on the parts alone."""
    if portable:
        text = F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed)))
        return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return (F.shiftrightunsigned(F.xxhash64(*parts, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def paired_bootstrap(df: DataFrame, a: str, b: str, reps: int, seed: int = 0, portable: bool = False, bins: int = 512) -> DataFrame:
    """Mean difference ``a - b`` with a 95 % percentile interval over ``reps`` resamples of a histogram.

    The differences are counted in ``bins`` equally wide bins with the mean and variance of each; that is one pass,
    combined map-side, and what remains is bins times replicates whatever the number of rows.  Resampling rows with
    Poisson(1) weights draws a Poisson number of the rows of a bin; it is drawn as a whole here, by the inverse of its
    distribution (beyond a mean of a million by the normal one).  What the drawn rows of a bin add on top of its
    mean has the bin's variance per row; these parts add up to one normal deviate per replicate.  So mean and variance of
    a resample are those of row-wise resampling, exactly, with any number of bins, and equal differences lose nothing.

    Rows without a difference take no part.  Returns ``pairs, mean_diff, ci_low, ci_high``; null means without rows.
    """
    diff = df.select((F.col(a) - F.col(b)).alias("_d")).filter(F.col("_d").isNotNull() & ~F.isnan("_d"))
    ends = diff.agg(F.min("_d").alias("lo"), F.max("_d").alias("hi"), F.count("_d").alias("pairs"), F.avg("_d").alias("mean_diff")).first()
    width = (ends["hi"] - ends["lo"]) if ends["pairs"] else 0.0
    at = F.least(F.lit(bins - 1), F.floor((F.col("_d") - F.lit(ends["lo"])) / width * bins)) if width else F.lit(0)
    hist = diff.groupBy(at.cast("bigint").alias("bin")).agg(F.count("_d").alias("c"), F.avg("_d").alias("m"), F.var_pop("_d").alias("s2"))
    hist = published(hist)
    tables = published(_poisson_tables(hist.filter(F.col("c") <= LARGEST_TABLE)))
    longest = tables.agg(F.max(F.size("cdf"))).first()[0] or 1
    blocks = hist.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((reps - 1) // DRAWS_PER_ROW).cast("bigint"))).alias("_block"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.join(tables, "c", "left").repartition(tasks, "bin", "_block")  # few small rows stand for many draws
    first = F.col("_block") * DRAWS_PER_ROW
    rep = F.sequence(first, F.least(first + DRAWS_PER_ROW, F.lit(reps).cast("bigint")) - 1)

    def normal(u: Column, v: Column) -> Column:
        return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)

    # one row per bin and replicate, within one generated loop: the table is referred to, not copied
    drawn = blocks.select("bin", "c", "m", "s2", "lo", "cdf", F.explode(rep).alias("rep"))
    drawn = drawn.withColumns({"_u": _uniform(F.col("bin"), F.col("rep"), seed=seed, portable=portable), "_pos": F.lit(0)})
    # how many cumulative probabilities are at or below the draw, by binary search
    for step in reversed([1 << i for i in range(int(longest).bit_length())]):
        drawn = drawn.withColumn("_pos", F.when(F.get("cdf", F.col("_pos") + (step - 1)) <= F.col("_u"), F.col("_pos") + step).otherwise(F.col("_pos")))
    z = normal(F.col("_u"), _uniform(F.col("bin"), F.col("rep"), F.lit("v"), seed=seed, portable=portable))
    large = F.greatest(F.lit(0), F.round(F.col("c") + F.sqrt("c") * z + (z * z - 1) / 6)).cast("bigint")
    drawn = drawn.select("rep", "m", "s2", F.when(F.col("cdf").isNull(), large).otherwise(F.col("lo") + F.col("_pos")).alias("k"))
    k = F.col("k")
    sums = drawn.groupBy("rep").agg(F.sum(k).alias("_n"), F.sum(k * F.col("m")).alias("_s"), F.sum(k * F.col("s2")).alias("_v"))
    z = normal(_uniform(F.lit("u"), F.col("rep"), seed=seed, portable=portable), _uniform(F.lit("v"), F.col("rep"), seed=seed, portable=portable))
    per_rep = sums.select(F.try_divide(F.col("_s") + F.sqrt("_v") * z, F.col("_n")).alias("mean_diff"))
    ci = per_rep.agg(F.percentile("mean_diff", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    return ci.select(F.lit(ends["pairs"]).alias("pairs"), F.lit(ends["mean_diff"]).cast("double").alias("mean_diff"), F.get("ci", F.lit(0)).alias("ci_low"), F.get("ci", F.lit(1)).alias("ci_high"))


def metric_delta(ours: DataFrame, ref: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    r = ref.select(*keys, *[F.col(m).alias(f"ref_{m}") for m in metrics])
    rows = ours.join(r, list(keys))
    return rows.select(*keys, *[c for m in metrics for c in (F.col(m), F.col(f"ref_{m}"), (F.col(m) - F.col(f"ref_{m}")).alias(f"delta_{m}"))])


def score_join(pred: DataFrame, gt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: ``matched`` / ``missing`` (no prediction) / ``extra`` (no target) / ``duplicated``."""
    p = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pred"))
    g = gt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gt"))
    rows = p.join(g, list(keys), "full_outer")
    status = (
        F.when(F.col("n_pred").isNull(), "missing")
        .when(F.col("n_gt").isNull(), "extra")
        .when((F.col("n_pred") > 1) | (F.col("n_gt") > 1), "duplicated")
        .otherwise("matched")
    )
    return rows.withColumn("status", status)


def normalise_target(relations: DataFrame, frames: str = "video_path", own: str = "target_image") -> DataFrame:
    """Replace the frame list by the object's own target frame; ``changed`` marks rows that differed."""
    single = F.array(F.col(own))
    return relations.withColumn("changed", ~F.col(frames).eqNullSafe(single)).withColumn(frames, single)


def alias_experts(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename prediction columns; unknown names stay."""
    return df.withColumnsRenamed(dict(mapping))


def alias_values(col: str, mapping: Mapping[str, str]) -> Column:
    """The same for values of a column."""
    out = F.col(col)
    for old, new in mapping.items():
        out = F.when(F.col(col) == old, F.lit(new)).otherwise(out)
    return out


def dedup_padding(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop repeated (record, object) rows; :func:`padding_conflicts` tells whether the copies were equal."""
    return df.dropDuplicates(list(keys))


def padding_conflicts(df: DataFrame, keys: Sequence[str], evaluated: int | Column | None = None) -> DataFrame:
    """Findings on padding: keys whose copies differ, and a number of kept rows other than ``evaluated``."""
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    rest = F.xxhash64(*[F.col(c) for c in df.columns if c not in keys])
    per_key = df.groupBy(*keys).agg((F.min(rest) != F.max(rest)).alias("_differ"))
    out = per_key.filter("_differ").select(F.lit("conflicting_copies").alias("check"), text.alias("subject"))
    if evaluated is None:
        return out
    kept = per_key.agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") != evaluated)
    return out.unionByName(kept.select(F.lit("kept_rows").alias("check"), F.col("_n").cast("string").alias("subject")))


def ledger(results: DataFrame, label: str, name: str, metrics: Sequence[str], valid: str = "valid") -> DataFrame:
    """Runs per evidence label; only valid rows compete for the best run by the metrics in order (ties: smallest name)."""
    ok = F.col(label) == valid
    per_name = results.groupBy(label, name).agg(*[F.max(m).alias(m) for m in metrics])
    order = F.struct(*[(-F.col(m)).alias(f"k{i}") for i, m in enumerate(metrics)], F.col(name).alias("name"))
    best = F.min_by(F.struct(name, *metrics), F.when(ok, order)).alias("_b")
    top = per_name.groupBy(label).agg(F.count(F.lit(1)).alias("runs"), best)
    return top.select(label, "runs", *[F.col(f"_b.{m}").alias(f"best_{m}") for m in metrics], F.col(f"_b.{name}").alias("best_run"))


# --- selection of runs -----------------------------------------------------------------------------


def select_checkpoint(results: DataFrame, name: str, metrics: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Best run by the metrics in order; ties go to the smallest name."""
    key = F.struct(*[(-F.col(m)).alias(f"k{i}") for i, m in enumerate(metrics)], F.col(name).alias("name"))
    best = F.min_by(F.struct(name, *metrics), key)
    return results.groupBy(*group).agg(best.alias("_b")).select(*group, "_b.*")


def pareto(results: DataFrame, name: str, metrics: Mapping[str, bool], group: Sequence[str] = ()) -> DataFrame:
    """Flag results that no other result of the group beats: at least as good in every metric, better in one.

    ``metrics`` maps a column to True if higher is better, else False.  Equal results are on the front together.  A
    result with a null (or NaN) metric can't be compared: its flag is null and it beats nobody.  Returns group, name,
    metrics and ``on_front``, one row per row of ``results``.

    One metric needs a maximum, two a running maximum over the points sorted by the first.  Each further metric is
    ranked; the points at least as good in it lie in logarithmically many dyadic ranges of ranks, so a point enters
    the ranges that hold it, asks those that cover what is at least as good, and within a combination of ranges the
    running maximum over the last two metrics answers.  With ``d`` metrics ``n`` points become ``n log(n)^(d-2)`` rows;
    no point is compared with all others.  Points that one of a few good ones per group beats never get so far.
    """
    names = list(metrics)
    values = [f"_v{i}" for i in range(len(names))]
    signed = [F.col(m).cast("double") * (1.0 if up else -1.0) for m, up in metrics.items()]
    known = reduce(lambda a, b: a & b, [v.isNotNull() & ~F.isnan(v) for v in signed])
    keys = [f"_g{i}" for i in range(len(group))]
    rows = results.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], *[(v + 0.0).alias(c) for v, c in zip(signed, values, strict=True)], known.alias("_ok"))
    points = published(rows.filter("_ok").drop("_ok").distinct())
    if len(names) == 1:
        top = points.groupBy(*keys).agg(F.max("_v0").alias("_v0"))
    elif len(names) == 2:
        top = _undominated(points.withColumns({"_kind": F.lit(0), "_id": F.lit(0).cast("bigint")}), keys, values).filter("_on").drop("_on", "_id")
    else:
        top = _front(_hopeful(points, keys, values), keys, values)
    same = [results[g].eqNullSafe(F.col(f"_t{k}")) for g, k in zip(group, keys, strict=True)]
    same += [(v + 0.0).eqNullSafe(F.col(f"_t{c}")) for v, c in zip(signed, values, strict=True)]
    front = top.select(*[F.col(c).alias(f"_t{c}") for c in [*keys, *values]], F.lit(True).alias("_front"))
    found = results.join(front, reduce(lambda a, b: a & b, same), "left")
    return found.select(*group, name, *names, F.when(known, F.coalesce("_front", F.lit(False))).alias("on_front"))


def _hopeful(points: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Points that none of a few good ones of their group beats: the best by each metric and by the sum of shares."""
    spans = points.groupBy(*keys).agg(*[F.min(v).alias(f"{v}_a") for v in values], *[F.max(v).alias(f"{v}_b") for v in values])
    ends = [f"{v}_{end}" for v in values for end in "ab"]
    if keys:
        spans = spans.select(*[F.col(k).alias(f"_s{k}") for k in keys], *ends)
        met = points.join(spans, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys]))
    else:
        met = points.withColumns({e: spans.select(e).scalar() for e in ends})
    met = met.select(*keys, *values, *[F.coalesce(F.try_divide(F.col(v) - F.col(f"{v}_a"), F.col(f"{v}_b") - F.col(f"{v}_a")), F.lit(0.0)).alias(f"{v}_s") for v in values])
    shares = [F.col(f"{v}_s") for v in values]
    total = reduce(lambda a, b: a + b, shares)
    best = [F.max_by(F.struct(*values), F.struct(total + extra * len(values), *values)) for extra in [F.lit(0.0), *shares]]
    champions = met.groupBy(*keys).agg(F.array(*best).alias("_c")).select(*[F.col(k).alias(f"_h{k}") for k in keys], "_c")
    beats = lambda c: reduce(lambda a, b: a & b, [c[v] >= F.col(v) for v in values]) & reduce(lambda a, b: a | b, [c[v] > F.col(v) for v in values])
    if keys:
        with_them = points.join(champions, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h{k}")) for k in keys]))
    else:
        with_them = points.withColumn("_c", champions.select("_c").scalar())
    return published(with_them.filter(~F.exists("_c", beats)).select(*keys, *values))


def _undominated(events: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``_on`` for each asking event: no event before it, by the last two values downwards, has as much of the last.

    ``_kind`` 1 only holds, 0 and 2 ask, in this order where both values are equal; with 0 alone all do both.
    """
    a, b = values[-2], values[-1]
    only = "_holds" not in events.columns
    rows = events.withColumns({"_down_a": -F.col(a), "_down_b": -F.col(b), "_has": F.col(b) if only else F.when(F.col("_holds"), F.col(b))})
    scan = ordered_scan(rows, ["_down_a", "_down_b", "_kind", "_id"], keys, max_before={"_best": "_has"})
    kept = scan if only else scan.filter(~F.col("_holds"))
    return kept.select(*[k for k in keys if k != "_node"], *values, "_id", (F.col("_best").isNull() | (F.col("_best") < F.col(b))).alias("_on"))


def _ranges(rank: str, levels: int, above: bool) -> Column:
    """Dyadic ranges ``(l, n)`` of ranks that hold a rank, or (``above``) that together cover it and all higher ones."""
    number = lambda i: F.call_function("shiftright", F.col(rank), i)
    every = F.sequence(F.lit(0), F.lit(levels - 1))
    if not above:
        return F.transform(every, lambda i: F.struct(i.alias("l"), number(i).alias("n")))
    # the rank itself, and the right neighbour of its range wherever that is a left one
    right = F.transform(F.filter(every, lambda i: number(i) % 2 == 0), lambda i: F.struct(i.alias("l"), (number(i) + 1).alias("n")))
    return F.concat(F.array(F.struct(F.lit(0).alias("l"), F.col(rank).alias("n"))), right)


def _front(points: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The undominated of distinct points with three and more values."""
    ranked, lead = points, values[:-2]
    for v in lead:
        ranks = published(ordered_scan(points.select(*keys, v).distinct(), [v], keys, ordinal=f"{v}_r"))
        right = ranks.select(*[F.col(c).alias(f"_r{c}") for c in [*keys, v]], f"{v}_r")
        same = [ranked[c].eqNullSafe(F.col(f"_r{c}")) for c in [*keys, v]]
        ranked = ranked.join(right, reduce(lambda a, b: a & b, same)).drop(*[f"_r{c}" for c in [*keys, v]])
    ranked = published(ranked.withColumn("_id", F.xxhash64(*keys, *values)))
    levels = [int(ranked.agg(F.max(f"{v}_r")).first()[0] or 0).bit_length() + 1 for v in lead]
    holding = [_ranges(f"{v}_r", n, False) for v, n in zip(lead, levels, strict=True)]
    asking = [_ranges(f"{v}_r", n, True) for v, n in zip(lead, levels, strict=True)]

    def spread(ranges: list[Column], holds: bool) -> DataFrame:
        out = ranked.select(*keys, *values, "_id", *[f"{v}_r" for v in lead], F.array().cast("array<bigint>").alias("_node"))
        for r in ranges:
            out = out.select("*", F.explode(r).alias("_r")).withColumn("_node", F.concat("_node", F.array(F.col("_r.l").cast("bigint"), F.col("_r.n")))).drop("_r")
        own = F.array(*[x for v in lead for x in (F.lit(0).cast("bigint"), F.col(f"{v}_r"))])
        kind = F.lit(1) if holds else F.when(F.col("_node") == own, 0).otherwise(2)
        return out.select(*keys, *values, "_id", "_node", kind.alias("_kind"), F.lit(holds).alias("_holds"))

    asked = _undominated(spread(holding, True).union(spread(asking, False)), [*keys, "_node"], values)
    return asked.groupBy(*keys, *values).agg(F.bool_and("_on").alias("_on")).filter("_on").drop("_on")


def best_candidate(cands: DataFrame, group: Sequence[str], name: str, score: str, rank: str, share: str, lo: float, hi: float) -> DataFrame:
    """Highest score among candidates with a sane area; the earliest wins a tie."""
    ok = cands.filter(F.col(share).between(lo, hi))
    return ok.groupBy(*group).agg(
        F.max_by(F.struct(name, score), F.struct(F.col(score), (-F.col(rank)).alias("r"))).alias("_b")
    ).select(*group, "_b.*")


def top_instance(preds: DataFrame, sample: Sequence[str], instance: str, score: str) -> DataFrame:
    """Highest-scoring instance per sample; ties go to the smallest instance."""
    return preds.groupBy(*sample).agg(
        F.min_by(F.struct(instance, score), F.struct((-F.col(score)).alias("s"), F.col(instance).alias("i"))).alias("_b")
    ).select(*sample, "_b.*")


def smallest_candidate(objs: DataFrame, group: Sequence[str], name: str, volume: str, matched: str) -> DataFrame:
    """Smallest matched candidate, or the smallest of all when none matches; unknown volume ranks last."""
    size = F.coalesce(F.col(volume).cast("double"), F.lit(float("inf")))
    key = F.struct((~F.col(matched)).alias("m"), size.alias("v"), F.col(name).alias("n"))
    return objs.groupBy(*group).agg(F.min_by(F.struct(name, volume, matched), key).alias("_b")).select(*group, "_b.*")
