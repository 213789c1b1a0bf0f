"""Published counts reproduced as arithmetic over tables of the same shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import audit as A
from sightline.operators import experts as X
from sightline.operators import quality as Q
from sightline.operators import metrics
from sightline.operators.metrics import _poisson_tables, paired_bootstrap, rowwise_bootstrap
from sightline.session import published

from helpers import rows


@pytest.mark.parametrize(
    "both,one,neither,ratios", [(56_566, 15_734, 4_200, (0.7394, 0.2057, 0.0549)), (1_678, 175, 7, (0.9022, 0.0941, 0.0038))]
)
def test_pair_coverage(spark, both, one, neither, ratios):
    n = both + one + neither
    ids = spark.range(n).withColumnRenamed("id", "base")
    pairs = ids.select("base", F.when(F.col("base") < both + one, "a").alias("value_1"), F.when(F.col("base") < both, "b").alias("value_2"))
    row = Q.pair_coverage(pairs).first()
    assert (row.complete, row.both, row.one, row.neither) == (n, both, one, neither)
    assert (row.both_ratio, row.one_ratio, row.neither_ratio) == ratios


def test_mapping_summary(spark):
    m = spark.range(235_920).select("id", F.when(F.col("id") < 198_194, "x").alias("v"))
    assert tuple(Q.mapping_summary(m, "id", "v").first()) == (235_920, 198_194, 37_726)


def test_dispositions(spark):
    kinds = {"valid": 1_081, "target_not_visible": 315, "reject": 40}
    tasks = spark.createDataFrame([(f"{k}{i}", k) for k, n in kinds.items() for i in range(n)], "task string, disposition string")
    rel = A.relations_by_disposition(tasks)
    assert rel.count() == 7_116
    assert A.asymmetric(rel).count() == 0
    totals = A.masks_by_disposition(tasks).agg(F.sum("relations"), F.sum("masks")).first()
    assert tuple(totals) == (7_116, 3_873)


def test_direction_ledger(spark):
    ledger = spark.createDataFrame([("ego2exo", 243), ("exo2ego", 243), ("exo2exo", 222)], "direction string, relations bigint")
    assert A.audit_direction_sum(ledger, 708).count() == 0
    assert A.audit_direction_sum(ledger, 709).count() == 1


@pytest.mark.parametrize("counts", [(164, 325, 605), (480, 913, 769), (14, 70, 159)])
def test_selection_counts_sum_to_objects(spark, counts):
    data = [(e, "cycle") for e, n in zip("ABC", counts) for _ in range(n)]
    dist = X.selection_distribution(spark.createDataFrame(data, "selected string, reason string").withColumn("s", F.lit("x")), ["s"])
    row = dist.first()
    assert (row.objects, row.n_A, row.n_B, row.n_C) == (sum(counts), *counts)
    assert X.audit_selection_totals(dist).count() == 0
    assert X.audit_selection_totals(dist.withColumn("n_A", F.col("n_A") - 1)).count() == 1


def test_truncation_share():
    assert round(100 * (1 - 40_517 / 100_223), 1) == 59.6


def test_pooled_density(spark):
    df = spark.createDataFrame([("a", 659.0, 13), ("b", 839.0, 13), ("c", 2939.0, 12)], "g string, mb double, episodes bigint")
    row = Q.pooled_density(df, "g", "mb", "episodes", 1168.0, F.col("group_bytes") > 2000).first()
    assert round(row.density, 1) == 116.8
    assert row.density_kept == pytest.approx((659 + 839) / 26)
    assert (row.outlier_groups, row.extrapolated_rows) == (1, 10)


def test_take_distribution(spark):
    df = spark.createDataFrame([(t, c) for t, k in [(1, 8), (2, 8), (3, 2), (4, 1)] for c in range(k)], "take int, cam int")
    assert rows(Q.take_distribution(df, "take", "cam")) == [(1, 1, 0), (2, 1, 1), (8, 2, 56)]


def test_expected_totals(spark):
    df = spark.createDataFrame([(1,)], "x int")
    right = {"trajectories": F.lit(56_566), "samples": F.lit(14_035_692), "images_per_sample": F.lit(2)}
    assert A.audit_totals(df, {k: F.max(v) for k, v in right.items()}, A.EXPECTED_TOTALS).count() == 0
    wrong = {**right, "samples": F.lit(3)}
    assert rows(A.audit_totals(df, {k: F.max(v) for k, v in wrong.items()}, A.EXPECTED_TOTALS), "subject", "detail") == [("samples", "3 vs 14035692")]


def test_rowwise_bootstrap_covers_the_mean(spark):
    df = spark.range(2_000).select("id", (F.rand(5) + 0.1).alias("a"), F.rand(6).alias("b"))
    row = rowwise_bootstrap(df, "a", "b", ["id"], reps=200, seed=20260814).first()
    assert row.pairs == 2_000 and row.ci_low < row.mean_diff < row.ci_high
    se = 0.408 / 2_000**0.5
    assert row.ci_high - row.ci_low == pytest.approx(2 * 1.96 * se, rel=0.25)
    again = rowwise_bootstrap(df.repartition(7), "a", "b", ["id"], reps=200, seed=20260814).first()
    assert again.ci_low == pytest.approx(row.ci_low)


@pytest.mark.parametrize(("bins", "kind"), [(512, "smooth"), (7, "smooth"), (512, "steps"), (3, "skewed")])
def test_bootstrap_agrees_with_the_rowwise_one(spark, bins, kind):
    x = {"smooth": F.rand(5) - F.rand(6), "steps": (F.floor(F.rand(5) * 5) - 1.0), "skewed": F.exp(3 * F.rand(5))}[kind]
    df = published(spark.range(600).select("id", x.alias("a"), F.lit(0.0).alias("b")))
    row = paired_bootstrap(df.repartition(5), "a", "b", reps=20_000, seed=3, bins=bins).first()
    rowwise = rowwise_bootstrap(df, "a", "b", ["id"], reps=3_000, seed=4).first()
    width = rowwise.ci_high - rowwise.ci_low
    assert row.pairs == 600 and row.mean_diff == pytest.approx(rowwise.mean_diff)
    assert row.ci_high - row.ci_low == pytest.approx(width, rel=0.08)
    assert row.ci_low == pytest.approx(rowwise.ci_low, abs=0.06 * width) and row.ci_high == pytest.approx(rowwise.ci_high, abs=0.06 * width)
    again = paired_bootstrap(df.repartition(2), "a", "b", reps=20_000, seed=3, bins=bins).first()
    assert again.ci_low == pytest.approx(row.ci_low) and again.ci_high == pytest.approx(row.ci_high)


def test_poisson_tables_and_large_means(spark):
    import math

    table = _poisson_tables(spark.createDataFrame([(1,), (40,), (3000,)], "c bigint")).collect()
    for row in table:
        p = [math.exp(k * math.log(row.c) - row.c - math.lgamma(k + 1)) for k in range(row.lo, row.lo + len(row.cdf))]
        assert np.allclose(np.cumsum(p), row.cdf, atol=1e-11)
    equal = spark.createDataFrame([(2.0, 0.5)] * 9 + [(None, 1.0)], "a double, b double")
    row = paired_bootstrap(equal, "a", "b", reps=300).first()
    assert (row.pairs, row.mean_diff, row.ci_low, row.ci_high) == (9, 1.5, 1.5, 1.5)
    none = paired_bootstrap(equal.filter("a is null"), "a", "b", reps=300).first()
    assert (none.pairs, none.mean_diff, none.ci_low) == (0, None, None)


def test_bootstrap_of_large_bins(spark, monkeypatch):
    monkeypatch.setattr(metrics, "LARGEST_TABLE", 50)
    df = spark.range(4_000).select((F.col("id") % 4).cast("double").alias("a"), F.lit(0.0).alias("b"))
    row = paired_bootstrap(df, "a", "b", reps=20_000, seed=1).first()
    assert row.ci_high - row.ci_low == pytest.approx(2 * 1.96 * (1.25 / 4_000) ** 0.5, rel=0.05)


def test_assert_clean(spark):
    found = spark.createDataFrame([("missing", "a", "")], "check string, subject string, detail string")
    A.assert_clean(found.filter("subject = 'b'"))
    with pytest.raises(A.DirtyTable, match="missing"):
        A.assert_clean(found)
