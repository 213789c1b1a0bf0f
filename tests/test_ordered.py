"""Bucketed scans against pandas, with a group that holds most of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators.metrics import legacy_lattice, metric_lattice, pareto, truncation_audit
from sightline.operators.ordered import exact_rank_value, ordered_scan, prefix_totals, with_bucket
from sightline.operators.selection import value_runs

RNG = np.random.default_rng(0)


def frame(n=3000):
    pdf = pd.DataFrame(
        {
            "g": np.where(RNG.random(n) < 0.6, 7, RNG.integers(0, 40, n)),
            "k": RNG.permutation(n),
            "v": RNG.integers(-5, 50, n),
        }
    )
    return pdf.astype("int64")


@pytest.mark.parametrize("buckets", [2, 5, 64])
@pytest.mark.parametrize("partitions", [1, 7])
def test_scan_matches_pandas(spark, buckets, partitions):
    pdf = frame()
    df = spark.createDataFrame(pdf).repartition(partitions)
    got = ordered_scan(
        df, ["k"], ["g"], ordinal="o", running_sum={"s": "v"}, max_before={"m": "v"}, previous={"p": "v"}, following={"f": "k"},
        first_of={"h": "v"}, buckets=buckets
    ).toPandas()
    want = pdf.sort_values(["g", "k"]).reset_index(drop=True)
    by = want.groupby("g")
    want["o"], want["s"] = by.cumcount(), by.v.cumsum()
    want["m"] = by.v.transform(lambda x: x.cummax().shift())
    want["p"], want["f"] = by.v.shift(), by.k.shift(-1)
    want["h"] = by.v.transform("first")
    got = got.sort_values(["g", "k"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns].astype("float64"), want.astype("float64"))


def test_scan_without_group(spark):
    pdf = frame(500)
    got = ordered_scan(spark.createDataFrame(pdf), ["k"], ordinal="o", running_sum={"s": "v"}).toPandas().sort_values("k")
    assert (got.o.to_numpy() == np.arange(500)).all()
    assert (got.s.to_numpy() == pdf.sort_values("k").v.cumsum().to_numpy()).all()


def test_scan_keeps_nulls_and_empty_input(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5), (1, 3, None)], "g int, k int, v int")
    got = {r["k"]: r["p"] for r in ordered_scan(df, ["k"], ["g"], previous={"p": "v"}, buckets=3).collect()}
    assert got == {1: None, 2: None, 3: 5}
    assert ordered_scan(df.filter("g > 9"), ["k"], ["g"], ordinal="o", buckets=3).count() == 0


def test_small_groups_a_hot_one_and_a_missing_one(spark):
    pdf = frame()
    pdf["g"] = pdf["g"].where(pdf["g"] == 7, pdf["k"] // 5 + 100).astype("Int64").mask(pdf["k"] < 9)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g long, k long, v long")
    want = pdf.sort_values(["g", "k"])
    by = want.groupby("g", dropna=False)
    want = want.assign(o=by.cumcount(), p=by.v.shift(), f=by.v.shift(-1), h=by.k.transform("first")).sort_values("k").astype("float64")
    for buckets in (1, 12):
        got = ordered_scan(df, ["k"], ["g"], ordinal="o", previous={"p": "v"}, following={"f": "v"}, first_of={"h": "k"}, buckets=buckets).toPandas()
        pd.testing.assert_frame_equal(got.sort_values("k")[want.columns].astype("float64").reset_index(drop=True), want.reset_index(drop=True))


def test_one_bucket_needs_no_edges(spark):
    df = spark.createDataFrame(frame())
    scan = ordered_scan(df, ["k"], ["g"], ordinal="o", previous={"p": "v"}, keep_bucket=True)
    scan = ordered_scan(scan, ["k"], ["g"], running_sum={"s": "v"}, bucketed=True)
    assert "Aggregate" not in scan._jdf.queryExecution().optimizedPlan().toString()


def test_hot_group_spans_buckets(spark):
    df = spark.createDataFrame(frame())
    sizes = [r["count"] for r in with_bucket(df, ["g", "k"], 16).groupBy("_bucket").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 3000 / 16 * 2.5


@pytest.mark.parametrize("n", [0, 1, 999, 1500, 2999, 3000, 5000])
def test_prefix_totals(spark, n):
    pdf = frame()
    row = prefix_totals(spark.createDataFrame(pdf), ["k"], n, ["v"], buckets=8).first()
    head = pdf.sort_values("k").head(n)
    assert (row["prefix_n"], row["prefix_v"]) == (len(head), head.v.sum())
    assert (row["total_n"], row["total_v"]) == (3000, pdf.v.sum())


@pytest.mark.parametrize("upper", [True, False])
def test_exact_median(spark, upper):
    pdf = frame()
    got = {r["g"]: r["m"] for r in exact_rank_value(spark.createDataFrame(pdf), ["g"], "v", upper, "m").collect()}
    for g, part in pdf.groupby("g"):
        want = sorted(part.v)[len(part) // 2] if upper else int(np.median(part.v))
        assert got[g] == want


def test_value_runs_are_not_a_group_by(spark):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate([4, 4, 9, 9, 9, 4])], "part string, at int, e int")
    got = sorted(tuple(r) for r in value_runs(df, ["part"], "at", "e").select("start", "e", "length").collect())
    assert got == [(0, 4, 2), (2, 9, 3), (5, 4, 1)]


def objects(spark, pairs):
    flat = [(s, p, o, float(v)) for (s, p), vs in pairs.items() for o, v in enumerate(vs)]
    empty = [(s, p, None, None) for (s, p), vs in pairs.items() if not vs]
    return spark.createDataFrame(flat + empty, "shard string, pair int, obj int, iou double")


def lattice(df, **kw):
    return metric_lattice(df, ["shard", "pair"], ["shard", "pair", "obj"], ["iou"], **kw).first()


@pytest.mark.parametrize("partitions", [1, 7])
def test_lattice_follows_text_order_of_shards(spark, partitions):
    # raw_10 sorts before raw_2; three pairs, so the stock mean reads the first three objects
    pairs = {("raw_2", 0): [1, 1], ("raw_10", 0): [0, 0.5], ("raw_10", 1): [0.4, 0.4, 0.4]}
    row = lattice(objects(spark, pairs).repartition(partitions), buckets=3)
    assert (row.n_pairs, row.n_objects, row.dropped) == (3, 7, 4)
    assert row.stock_iou == pytest.approx((0 + 0.5 + 0.4) / 3)
    assert row.perobject_iou == pytest.approx(3.7 / 7)
    assert row.perpair_iou == pytest.approx((1 + 0.25 + 0.4) / 3)


def test_empty_pair_poisons_or_is_skipped(spark):
    df = objects(spark, {("a", 0): [1, 0], ("a", 1): []})
    row = lattice(df)
    assert row.n_pairs == 2 and np.isnan(row.perpair_iou) and row.stock_iou == 0.5
    assert lattice(df, on_empty="skip").perpair_iou == 0.5


def test_dropped_is_never_negative(spark):
    row = lattice(objects(spark, {("a", 0): [1.0], ("a", 1): [], ("a", 2): []}), on_empty="skip")
    assert (row.dropped, row.dropped_pct) == (0, 0.0)


def test_truncation_and_legacy(spark):
    df = objects(spark, {("a", 0): [1, 0], ("a", 1): [0.5, 0.25]})
    t = truncation_audit(df, ["shard", "pair"], ["shard", "pair", "obj"]).first()
    assert (t.kept, t.prefix_mean, t.tail_mean, t.full_mean) == (2, 0.5, 0.375, 0.4375)
    l = legacy_lattice(df, ["shard", "pair"], ["shard", "pair", "obj"]).first()
    assert (l.last_object_mean, l.positive_objects) == (0.125, 3)


def brute_front(pts, ups):
    """pts: (group, run, *values); None for results that can't be compared."""
    good = [p for p in pts if all(v is not None and v == v for v in p[2:])]
    better = lambda x, y, up: (x >= y, x > y) if up else (x <= y, x < y)
    out = {}
    for p in pts:
        rivals = [[better(x, y, up) for x, y, up in zip(q[2:], p[2:], ups, strict=True)] for q in good if q[0] == p[0]] if p in good else []
        out[p[1]] = not any(all(a for a, _ in r) and any(b for _, b in r) for r in rivals) if p in good else None
    return out


@pytest.mark.parametrize(("ups", "top", "drift"), [((True,), 9, 0), ((True, False), 12, 0), ((False, True, True), 7, 0), ((True, False, True, True), 5, 0), ((True, True, True), 60, 1)])
def test_pareto_against_brute_force(spark, ups, top, drift):
    d = len(ups)
    values = RNG.integers(0, top, (130, d)).astype(float)
    if drift:  # nearly all on the front
        values[:, -1] = 100 - values[:, :-1].sum(1) + RNG.integers(0, 3, 130)
    pts = [(("a", "b", None)[i % 3], i, *map(float, v)) for i, v in enumerate(values)]
    pts += [("a", 500, None, *[99.0] * (d - 1)), ("b", 501, *[99.0] * (d - 1), float("nan")), ("c", 502, *[0.0] * d), ("c", 503, *[-0.0] * d)]
    pts += [(p[0], p[1] + 1000, *p[2:]) for p in pts[:20]]  # ties
    names = [f"m{i}" for i in range(d)]
    df = spark.createDataFrame(pts, "grp string, run int, " + ", ".join(f"{n} double" for n in names)).repartition(4)
    got = {r["run"]: r["on_front"] for r in pareto(df, "run", dict(zip(names, ups, strict=True)), group=["grp"]).collect()}
    assert got == brute_front(pts, ups)


def test_pareto_without_groups_and_with_missing_values(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0, 0.0), ("y", 2.0, 1.0, 0.0), ("z", 0.5, 0.5, 0.0), ("n", None, 3.0, 9.0)], "run string, a double, b double, c double")
    for metrics in ({"a": True, "b": True}, {"a": True, "b": True, "c": False}):
        assert {r["run"]: r["on_front"] for r in pareto(df, "run", metrics).collect()} == {"x": True, "y": True, "z": False, "n": None}
        assert pareto(df.limit(0), "run", metrics).count() == 0


def test_stock_mean_with_a_third_of_the_objects_in_the_cut_pair(spark):
    df = objects(spark, {("a", 0): [0.5], **{("b", i): [0.25] for i in range(40)}, ("a", 1): [((i * 7) % 11) / 11 for i in range(400)], ("c", 0): [1.0]})
    for buckets in (1, 9):
        row = lattice(df, buckets=buckets)
        flat = sorted((r["shard"], r["pair"], r["obj"], r["iou"]) for r in df.collect())
        assert row.stock_iou == pytest.approx(np.mean([x[3] for x in flat[:43]]))


def test_scan_repeats_after_recomputation(spark):
    df = spark.createDataFrame(frame()).withColumn("x", F.col("v") * 2)
    a = ordered_scan(df.repartition(5), ["k"], ["g"], running_sum={"s": "x"}, buckets=9)
    b = ordered_scan(df.repartition(2), ["k"], ["g"], running_sum={"s": "x"}, buckets=3)
    assert a.exceptAll(b.select(a.columns)).count() == 0
