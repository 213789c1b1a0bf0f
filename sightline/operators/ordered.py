"""Ordinals, running values and neighbours over data of any size and skew.

A plain ``Window.partitionBy(group).orderBy(...)`` puts a whole group into one task,
and an unpartitioned one puts the whole table there.  The functions here cut the rows
into *buckets of the sort key* instead: a group with a third of all rows spans many
buckets, a thousand small groups share one.  Inside a bucket an ordinary window runs;
between buckets only one row per bucket travels (its first group, last group and
closing value), so the broadcast side never has more rows than there are buckets.

The cut points come from the rows whose key hashes below a threshold: which rows these are
depends only on the rows, not on partitioning, timing or task retries, so every evaluation of a
plan agrees on them, and only the sample moves.  The threshold is set from the row count so that
a few rows per bucket are expected.  The cut points are checkpointed as one row with a key per
bucket, enter the plan as a scalar subquery, and a row finds its bucket by binary search in JVM
code.  Buckets and rows per bucket both grow with the square root of the table.

The order columns together must identify a row (a total order), as every ordinal needs.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.session import cut_lineage

SAMPLE_PER_BUCKET = 32
#: A bucket has at least so many rows, and from there on eight times the root of the row count.
ROWS_PER_BUCKET = 65_536
#: Buckets that a task sorts, on average.
BUCKETS_PER_TASK = 4
_DRAWS = 1 << 53


def default_buckets(rows: int) -> int:
    """Number of buckets for so many rows."""
    return max(1, math.ceil(rows / max(ROWS_PER_BUCKET, 8 * math.isqrt(rows))))


def cut_points(df: DataFrame, keys: Sequence[str], buckets: int, rows: int) -> DataFrame:
    """One row: the sorted, distinct keys that cut the table of ``rows`` rows into about equally large ranges."""
    threshold = min(_DRAWS, _DRAWS * buckets * SAMPLE_PER_BUCKET // max(1, rows))
    drawn = df.select(*keys).filter(F.pmod(F.xxhash64(*keys), F.lit(_DRAWS)) < threshold)
    sample = drawn.agg(F.array_sort(F.collect_list(F.struct(*keys))).alias("_s"))
    index = lambda i: F.floor(i * F.size("_s") / F.lit(buckets)).cast("int")
    picks = F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda i: F.get("_s", index(i)))
    return sample.select(F.array_distinct(F.filter(picks, lambda x: x.isNotNull())).alias("cuts"))


def fixed_cuts(df: DataFrame, keys: Sequence[str], buckets: int | None) -> tuple[Column | None, int]:
    """The cut points as a scalar subquery over one checkpointed row, so that they are sampled once; and their bucket count.

    The rows are counted first.  One bucket needs no cut points.
    """
    if buckets == 1:
        return None, 1
    rows = df.select(*keys).count()
    buckets = buckets or default_buckets(rows)
    return (cut_lineage(cut_points(df, keys, buckets, rows)).scalar(), buckets) if buckets > 1 else (None, 1)


def with_bucket(
    df: DataFrame, keys: Sequence[str], buckets: int | None = None, name: str = "_bucket", cuts: Column | None = None
) -> DataFrame:
    """Add the equi-depth range bucket of the sort key: the number of cut points at or below it."""
    if cuts is None and buckets != 1:
        cuts, buckets = fixed_cuts(df, keys, buckets)
    if cuts is None or buckets is None:
        return df.withColumn(name, F.pmod(F.hash(*keys), F.lit(1)))  # a constant would turn joins on it into products
    rows = df.withColumns({"_key": F.struct(*keys), name: F.lit(0)})
    step = 1 << (buckets - 1).bit_length() - 1
    while step:
        probe = F.get(cuts, F.col(name) + (step - 1))
        rows = rows.withColumn(name, F.when(probe <= F.col("_key"), F.col(name) + step).otherwise(F.col(name)))
        step //= 2
    return rows.drop("_key")


def in_bucket(keys: Sequence[str], cuts: Column | None, bucket: int) -> Column:
    """Whether a row lies in a bucket, as a key range: a filter on the bucket's number is pushed below the search that
    finds it, and each step of the search names the one before several times."""
    if cuts is None:
        return F.lit(True)
    key = F.struct(*keys)
    return F.coalesce(key >= F.get(cuts, F.lit(bucket - 1)), F.lit(True)) & F.coalesce(key < F.get(cuts, F.lit(bucket)), F.lit(True))


def sort_tasks(df: DataFrame, buckets: int) -> int | None:
    """So many tasks that each sorts a few buckets; None where the session's shuffle partitions are enough."""
    tasks = math.ceil(buckets / BUCKETS_PER_TASK)
    return tasks if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def tasks_for(df: DataFrame, buckets_per_task: int = BUCKETS_PER_TASK) -> int:
    """So many tasks that each holds the rows of a few buckets, whatever the size of the table; counts the rows."""
    return max(1, math.ceil(df.count() / (ROWS_PER_BUCKET * buckets_per_task)))


def dealt(df: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    """Rows dealt to ``tasks`` by the hash of the keys, as they are if one is enough.

    The session's partitions, and those that adaptive execution merges by compressed bytes, grow with the table.
    """
    return df.repartition(tasks, *keys) if tasks > 1 else df


def ordered_scan(
    df: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    *,
    ordinal: str | None = None,
    running_sum: Mapping[str, str] | None = None,
    max_before: Mapping[str, str] | None = None,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    first_of: Mapping[str, str] | None = None,
    buckets: int | None = None,
    bucketed: bool = False,
    keep_bucket: bool = False,
) -> DataFrame:
    """Add window columns computed per ``group`` in ascending ``order``.

    ``ordinal`` names a zero-based position.  ``running_sum`` maps a new column to its input
    and includes the current row; ``max_before`` takes the rows before it only.
    ``previous`` / ``following`` map a new column to the input read one row back / ahead,
    ``first_of`` to the input in the first row of the group.

    The rows shuffle and sort once, on the bucket.  What a bucket needs from its neighbours is
    pre-aggregated map-side from the unsorted rows; a single bucket needs nothing, and its plan has no
    such step.  ``keep_bucket`` / ``bucketed`` chain two scans over the same keys with one shuffle.
    """
    sums, maxes = dict(running_sum or {}), dict(max_before or {})
    backs, aheads, firsts = dict(previous or {}), dict(following or {}), dict(first_of or {})
    keys = [*group, *order]
    base, tasks = df, None
    if not bucketed:
        cuts, buckets = fixed_cuts(df, keys, buckets)
        tasks = sort_tasks(df, buckets)
        base = with_bucket(df, keys, buckets, cuts=cuts).withColumn("_edges", F.lit(cuts is not None))
        if tasks:  # before the edges, whose aggregates sort too
            base = base.repartition(tasks, "_bucket")
    columns = [c for c in base.columns if keep_bucket or c not in ("_bucket", "_edges")]
    base = base.withColumn("_g", F.struct(*group) if group else F.lit(0))

    # one row per bucket: its first and last group, and the closing values of the last group
    at = F.struct(*keys)
    boxed = lambda c: F.struct(F.col(c).alias("v"))
    partial = [F.count(F.lit(1)).alias("_n")]
    partial += [F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())]
    partial += [F.max(c).alias(f"_m{i}") for i, c in enumerate(maxes.values())]
    partial += [F.max_by(boxed(c), at).alias(f"_p{i}") for i, c in enumerate(backs.values())]
    partial += [F.min_by(boxed(c), at).alias(f"_f{i}") for i, c in enumerate(aheads.values())]
    partial += [F.min_by(boxed(c), at).alias(f"_h{i}") for i, c in enumerate(firsts.values())]
    heads = [f"_f{i}" for i in range(len(aheads))]
    if group:
        per_group = base.filter("_edges").groupBy("_bucket", "_g").agg(*partial)
        tails = [c for c in per_group.columns if c not in ("_bucket", "_g", *heads)]
        edges = per_group.groupBy("_bucket").agg(
            F.min("_g").alias("first_g"),
            F.max("_g").alias("last_g"),
            *[F.max_by(c, "_g").alias(c) for c in tails],
            *[F.min_by(c, "_g").alias(c) for c in heads],
        )
    else:
        edges = base.filter("_edges").groupBy("_bucket").agg(F.lit(0).alias("first_g"), F.lit(0).alias("last_g"), *partial)

    same_tail = Window.partitionBy("last_g").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    chain = Window.partitionBy(F.lit(0)).orderBy("_bucket")  # at most `buckets` rows
    closing = {"_n": F.sum("_n").over(same_tail)}
    closing.update({f"_s{i}": F.sum(f"_s{i}").over(same_tail) for i in range(len(sums))})
    closing.update({f"_m{i}": F.max(f"_m{i}").over(same_tail) for i in range(len(maxes))})
    closing.update({f"_h{i}": F.first(f"_h{i}").over(same_tail) for i in range(len(firsts))})
    edges = edges.withColumns(closing)
    from_back = lambda c: F.when(F.lag("last_g").over(chain) == F.col("first_g"), F.lag(c).over(chain)).alias(f"_c{c}")
    from_ahead = lambda c: F.when(F.lead("first_g").over(chain) == F.col("last_g"), F.lead(c).over(chain)).alias(f"_c{c}")
    backward = [*closing, *[f"_p{i}" for i in range(len(backs))]]
    offsets = edges.select(
        F.col("_bucket").alias("_eb"), "first_g", "last_g", *[from_back(c) for c in backward], *[from_ahead(c) for c in heads]
    )

    w = Window.partitionBy("_bucket", "_g").orderBy(*order)
    upto, before = (w.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    local: dict[str, Column] = {}
    if ordinal:
        local["_n"] = F.row_number().over(w).cast("bigint")
    local.update({f"_s{i}": F.sum(c).over(upto) for i, c in enumerate(sums.values())})
    local.update({f"_m{i}": F.max(c).over(before) for i, c in enumerate(maxes.values())})
    local.update({f"_p{i}": F.lag(boxed(c)).over(w) for i, c in enumerate(backs.values())})
    local.update({f"_f{i}": F.lead(boxed(c)).over(w) for i, c in enumerate(aheads.values())})
    local.update({f"_h{i}": F.first(boxed(c)).over(upto) for i, c in enumerate(firsts.values())})
    rows = (base if bucketed or tasks else base.repartition("_bucket")).withColumns(local)

    joined = rows.join(F.broadcast(offsets), F.col("_bucket") == F.col("_eb"), "left")
    head, tail = F.col("_g") == F.col("first_g"), F.col("_g") == F.col("last_g")
    brought = lambda c: F.when(head, F.col(f"_c{c}"))
    out: dict[str, Column] = {}
    if ordinal:
        out[ordinal] = F.col("_n") - 1 + F.coalesce(brought("_n"), F.lit(0))
    for i, name in enumerate(sums):
        out[name] = F.col(f"_s{i}") + F.coalesce(brought(f"_s{i}"), F.lit(0))
    for i, name in enumerate(maxes):
        out[name] = F.greatest(F.col(f"_m{i}"), brought(f"_m{i}"))
    for i, name in enumerate(backs):
        out[name] = F.coalesce(F.col(f"_p{i}"), brought(f"_p{i}"))["v"]
    for i, name in enumerate(aheads):
        out[name] = F.coalesce(F.col(f"_f{i}"), F.when(tail, F.col(f"_c_f{i}")))["v"]
    for i, name in enumerate(firsts):
        out[name] = F.coalesce(brought(f"_h{i}"), F.col(f"_h{i}"))["v"]
    return joined.select(*columns, *[c.alias(name) for name, c in out.items()])


def prefix_totals(df: DataFrame, order: Sequence[str], n: int, values: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Count and sums of the first ``n`` rows in ``order``, and of all rows, without ordering the table.

    Buckets wholly inside the prefix contribute their totals; only the bucket that the cut falls
    into is shuffled and sorted.  The bucket totals, one row per bucket, are read on the
    driver.  Returns one row: ``prefix_n``, ``prefix_<value>``, ``total_n``, ``total_<value>``.
    """
    cuts, buckets = fixed_cuts(df, order, buckets)
    rows = df.select(*order, *[v for v in values if v not in order])
    rows = with_bucket(rows, order, buckets, cuts=cuts)
    sums = [F.coalesce(F.sum(v), F.lit(0.0)).alias(f"_t{i}") for i, v in enumerate(values)]
    totals = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"), *sums).collect()
    before, whole, cut = 0, [0.0] * len(values), None
    for row in sorted(totals, key=lambda r: r["_bucket"]):
        if before + row["_n"] > n:
            cut = row["_bucket"]
            break
        before += row["_n"]
        whole = [w + row[f"_t{i}"] for i, w in enumerate(whole)]
    take = n - before if cut is not None else 0
    inside = F.lit(False) if cut is None else in_bucket(order, cuts, cut)
    rn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    part = df.select(*order, *[v for v in values if v not in order]).filter(inside).withColumn("_rn", rn)
    part = part.filter(F.col("_rn") <= take).agg(F.count(F.lit(1)).alias("_n"), *sums)
    return part.select(
        (F.col("_n") + before).alias("prefix_n"),
        *[(F.col(f"_t{i}") + whole[i]).alias(f"prefix_{v}") for i, v in enumerate(values)],
        F.lit(sum(r["_n"] for r in totals)).cast("bigint").alias("total_n"),
        *[F.lit(float(sum(r[f"_t{i}"] for r in totals))).alias(f"total_{v}") for i, v in enumerate(values)],
    )


def cut_group(
    groups: DataFrame, group: Sequence[str], size: str, n: int, values: Sequence[str], buckets: int | None = None
) -> tuple[list[float], list[float], dict | None, int]:
    """The group in which the first ``n`` members end, for groups in ascending order with their sizes and sums.

    ``groups`` has one row per group.  Bucket totals are read on the driver, and only the bucket with the
    cut is sorted.  Returns size and sums of the groups before it, those of all groups, the group's key
    (None if ``n`` covers everything) and how many of its members belong to the first ``n``.
    """
    columns = [F.coalesce(F.col(c), F.lit(0)).alias(f"_t{i}") for i, c in enumerate([size, *values])]
    names = [f"_t{i}" for i in range(len(columns))]
    cuts, buckets = fixed_cuts(groups, group, buckets)
    rows = with_bucket(groups.select(*group, *columns), group, buckets, cuts=cuts)
    totals = sorted(rows.groupBy("_bucket").agg(*[F.sum(t).alias(t) for t in names]).collect(), key=lambda r: r["_bucket"])
    whole = [sum(r[t] for r in totals) for t in names]
    before = [0 for _ in names]
    for row in totals:
        if before[0] + row["_t0"] > n:
            earlier = Window.partitionBy(F.lit(0)).orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
            ahead = [F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"_b{t}") for t in names]
            inside = groups.select(*group, *columns).filter(in_bucket(group, cuts, row["_bucket"])).select(*group, "_t0", *ahead)
            cut = inside.filter(F.col("_b_t0") + F.col("_t0") + before[0] > n).orderBy(*group).first()
            before = [b + cut[f"_b{t}"] for b, t in zip(before, names, strict=True)]
            return before, whole, {g: cut[g] for g in group}, n - before[0]
        before = [b + row[t] for b, t in zip(before, names, strict=True)]
    return before, whole, None, 0


def exact_rank_value(df: DataFrame, keys: Sequence[str], value: str, upper: bool, name: str) -> DataFrame:
    """Exact median per key of an integer column, for groups of any size.

    ``upper=True`` takes element ``n div 2`` of the sorted list (the upper middle); otherwise the
    two middle elements are averaged and truncated towards zero.  Rows are first counted per
    (key, value) map-side.  The window then holds one row per distinct value of a key: pixel
    counts and frame numbers are bounded by the image and by the episode, not by the row count.
    """
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumns({"_upto": F.sum("_c").over(upto), "_n": F.sum("_c").over(part)})
    hi = F.floor(F.col("_n") / 2)
    lo = hi if upper else F.floor((F.col("_n") - 1) / 2)
    at = lambda i: F.max(F.when((F.col("_upto") > i) & (F.col("_upto") - F.col("_c") <= i), F.col(value)))
    picked = run.groupBy(*keys).agg(at(lo).alias("_lo"), at(hi).alias("_hi"))
    middle = F.col("_hi") if upper else ((F.col("_lo") + F.col("_hi")) / 2).cast("bigint")
    return picked.select(*keys, middle.alias(name))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
