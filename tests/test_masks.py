"""Interval algebra against dense arrays."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import rows
from sightline.operators import mask_store as store
from sightline.operators import masks as M
from sightline.session import published

H, W = 5, 4
FIXED = [
    np.zeros((H, W), bool),
    np.ones((H, W), bool),
    np.eye(H, W, dtype=bool),
    np.eye(H, W, 1, dtype=bool),
    np.array([[c == 0 and r == 0 for c in range(W)] for r in range(H)]),
]


def tables(spark, dense):
    rows = [(i, H, W, [bool(b) for b in m.T.reshape(-1)]) for i, m in enumerate(dense)]
    bits = spark.createDataFrame(rows, "mask_id bigint, h int, w int, bits array<boolean>")
    return M.headers_from_bits(bits), M.masks_from_bits(bits)


def densify(df, key, n):
    out = np.zeros((n, H * W), bool)
    for r in df.collect():
        assert not out[r[key], r["s"] : r["e"]].any()
        out[r[key], r["s"] : r["e"]] = True
    return out.reshape(n, W, H).transpose(0, 2, 1)


def pairs(spark, n):
    return spark.createDataFrame([(i, i, (i + 1) % n) for i in range(n)], "pair_id bigint, a_id bigint, b_id bigint")


def check_all(spark, dense):
    n = len(dense)
    heads, runs = tables(spark, dense)
    nxt = [dense[(i + 1) % n] for i in range(n)]
    p = pairs(spark, n)
    assert (densify(runs, "mask_id", n) == np.array(dense)).all()
    assert M.roundtrip_findings(runs, heads).count() == 0
    ov = {r["pair_id"]: r for r in M.mask_overlap(p, runs).collect()}
    for i in range(n):
        assert ov[i]["inter"] == (dense[i] & nxt[i]).sum()
        assert ov[i]["union"] == (dense[i] | nxt[i]).sum()
        assert ov[i]["area_a"] + ov[i]["area_b"] == ov[i]["inter"] + ov[i]["union"]
    assert (densify(M.mask_intersect(p, runs, runs), "pair_id", n) == [a & b for a, b in zip(dense, nxt)]).all()
    assert (densify(M.mask_minus(p, runs, runs), "pair_id", n) == [a & ~b for a, b in zip(dense, nxt)]).all()
    union = M.mask_union(runs.withColumn("g", runs.mask_id % 2), ["g"])
    assert (densify(union, "g", 2) == [np.any(dense[k::2], axis=0) for k in (0, 1)]).all()
    ext = {r["mask_id"]: r for r in M.mask_extent(runs, heads).collect()}
    cen = {r["mask_id"]: r for r in M.mask_centroid(runs, heads).collect()}
    for i, m in enumerate(dense):
        ys, xs = np.nonzero(m)
        assert (i in ext) == (len(xs) > 0)
        if len(xs):
            assert [ext[i][c] for c in ("x0", "x1", "y0", "y1")] == [xs.min(), xs.max(), ys.min(), ys.max()]
            assert (cen[i]["x"], cen[i]["y"]) == (pytest.approx(xs.mean()), pytest.approx(ys.mean()))


def test_fixed_shapes(spark):
    check_all(spark, FIXED)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.booleans(), min_size=H * W, max_size=H * W), min_size=40, max_size=40))
def test_random_shapes(spark, bits):
    check_all(spark, [np.array(b).reshape(H, W) for b in bits])


def test_counts_of_empty_and_full(spark):
    heads, runs = tables(spark, FIXED)
    got = {r["mask_id"]: r["counts"] for r in M.masks_to_counts(runs, heads).collect()}
    assert got[0] == [20] and got[1] == [0, 20] and got[4] == [0, 1, 19]


@pytest.mark.parametrize("empty,iou", [("eps", 0.0), ("one", 1.0), ("null", None)])
def test_empty_on_empty(spark, empty, iou):
    heads, runs = tables(spark, [np.zeros((H, W), bool)])
    p = spark.createDataFrame([(0, 0, 0)], "pair_id bigint, a_id bigint, b_id bigint")
    row = M.mask_scores(M.mask_overlap(p, runs), empty).first()
    assert (row["iou"], row["dice"]) == (iou, iou)
    with pytest.raises(ValueError):
        M.mask_scores(M.mask_overlap(p, runs), "zero")


def test_iou_is_symmetric(spark):
    heads, runs = tables(spark, FIXED)
    p = pairs(spark, len(FIXED))
    back = p.selectExpr("pair_id", "b_id AS a_id", "a_id AS b_id")
    score = lambda q: {r["pair_id"]: r["iou"] for r in M.mask_scores(M.mask_overlap(q, runs), "one").collect()}
    assert score(p) == score(back)


def test_equal_masks_share_a_hash(spark):
    heads, runs = tables(spark, [FIXED[2], FIXED[3], FIXED[2], FIXED[0], FIXED[0]])
    dup = {(r["first_mask"], r["masks"]) for r in M.duplicate_masks(M.mask_sha(runs, heads)).collect()}
    assert dup == {(0, 2), (3, 2)}


def test_points_and_cycle_evidence(spark):
    heads, runs = tables(spark, [FIXED[1], FIXED[4]])
    pts = spark.createDataFrame(
        [(0, "A", 0.0, 0.0), (0, "A", 9.0, 0.0), (1, "A", 0.0, 0.0), (1, "B", 1.0, 1.0), (1, "C", float("nan"), 0.0), (1, "C", 0.0, 0.0)],
        "mask_id bigint, expert string, x double, y double",
    )
    ref = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (1, 3, 4)], "mask_id bigint, x int, y int")
    got = {(r["mask_id"], r["expert"]): (r["inside_count"], r["cycle_distance"], r["valid"]) for r in M.cycle_evidence(pts, runs, ref, heads).collect()}
    assert got[(0, "A")] == (1, 4.5, True)
    assert got[(1, "A")] == (1, 0.0, True)
    assert got[(1, "B")][0] == 0 and got[(1, "B")][1] == pytest.approx(2**0.5)
    assert got[(1, "C")] == (None, None, False)


@pytest.mark.parametrize("share", [0.0002, 0.01, 0.4])
def test_nearest_pixels_against_brute_force(spark, share):
    rng = np.random.default_rng(int(share * 10_000))
    pixels, points = [], []
    for mask in range(4):
        field = rng.random((256, 256)) < share
        field[:, 100:180] &= mask % 2 == 0  # a wide gap
        field[3, 7] = True
        xs, ys = np.nonzero(field)
        pixels += [(mask, int(x), int(y)) for x, y in zip(xs, ys, strict=True)]
        points += [(mask, *map(float, p)) for p in rng.uniform(-60, 320, (60, 2))] + [(mask, float(p[0]), float(p[1])) for p in rng.integers(0, 256, (30, 2))]
        points += [(mask, 3.0, 7.0), (mask, 1e6, -1e6), (mask, float("nan"), 1.0), (mask, None, 1.0)]
    pixels += pixels[:50]
    asked = spark.createDataFrame([*points, *points[:9], (99, 0.0, 0.0)], "mask_id bigint, x double, y double").repartition(3)
    got = {(r["mask_id"], r["x"], r["y"]): r["near"] for r in M.nearest_pixels(asked, spark.createDataFrame(pixels, "mask_id bigint, x int, y int")).collect()}
    want = {}
    for mask, x, y in points:
        if x is not None and x == x:
            own = np.array([(a, b) for m, a, b in pixels if m == mask])
            want[(mask, x, y)] = np.sqrt(((own - [x, y]) ** 2).sum(1).min())
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_polygon_statistics(spark):
    poly = spark.createDataFrame([("a", [[0.0, 0.0], [8.0, 0.0], [8.0, 6.0], [0.0, 6.9]]), ("a", [[2.0, 2.0]])], "base string, points array<array<double>>")
    meta = spark.createDataFrame([("a", 2)], "base string, scale int")
    got = sorted((r["vertices"], r["area"], r["x1"], r["y1"]) for r in M.polygon_stats(poly, meta).collect())
    assert got == [(1, 0.0, 1, 1), (4, 12.0, 4, 3)]


def test_area_jump_threshold(spark):
    df = spark.createDataFrame([("v", i, a) for i, a in enumerate([100, 300, 301, 1000, 400, 0])], "video string, frame int, area bigint")
    got = [r["jump"] for r in M.area_jumps(df, "video", "frame").orderBy("frame").collect()]
    assert got == [False, False, False, True, False, True]


def test_resolve_masks(spark):
    tasks = spark.createDataFrame([("edit", True), ("add", False), ("new", None)], "task string, edited boolean")
    base = spark.createDataFrame([("edit", 0, 5), ("add", 0, 5)], "task string, s bigint, e bigint")
    regions = spark.createDataFrame([("edit", 8, 9), ("add", 4, 7), ("new", 1, 2), ("new", 2, 3)], "task string, s bigint, e bigint")
    got = sorted(tuple(r) for r in M.resolve_masks(tasks, base, regions).collect())
    assert got == [("add", 0, 7), ("edit", 8, 9), ("new", 1, 3)]


def test_roi_union(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 2, [[0.5, 9.0], [20.0, 10.0]]), (None, None, None, None, 2, None)],
                               "x0 int, y0 int, x1 int, y1 int, scale int, box array<array<double>>")
    got = [tuple(r)[-4:] for r in M.roi_union(df, ["box"], "scale").collect()]
    assert got == [(0.5, 4.0, 20.0, 10.0), (None, None, None, None)]


def test_prediction_flags(spark):
    df = spark.createDataFrame([("blow", 0.8)] + [("thin", 0.1)] + [("thin", 0.0)] * 9 + [("fine", 0.5)] * 2, "v string, share double")
    assert {r["v"]: r["flag"] for r in M.prediction_flags(df, "v").collect()} == {"blow": "blowup", "thin": "mostly-empty", "fine": ""}


def random_masks(spark, n, seed):
    rng = np.random.default_rng(seed)
    dense = [rng.random((H, W)) < rng.choice([0.0, 0.2, 0.5, 0.9, 1.0]) for _ in range(n)]
    heads, runs = tables(spark, dense)
    return [m.reshape(-1) for m in dense], published(heads), published(runs)


def overlap_rows(df, *cols):
    return rows(df, *cols, "a_id", "b_id", "area_a", "area_b", "inter", "union")


def expected(dense, pairs_of):
    """Counts over dense masks; unknown ids are empty."""
    none = np.zeros(H * W, bool)
    out = []
    for *cols, a, b in pairs_of:
        x, y = (dense[i] if i is not None and i < len(dense) else none for i in (a, b))
        out.append((*cols, a, b, int(x.sum()), int(y.sum()), int((x & y).sum()), int((x | y).sum())))
    return sorted(out, key=repr)


def test_frame_sweep_against_dense_masks(spark):
    """More masks than a tile has bits, several frames, one of them null, repeated pairs, unknown and null ids."""
    dense, _, runs = random_masks(spark, 150, 1)
    rng = np.random.default_rng(2)
    wanted = [(int(rng.integers(3)), int(rng.integers(150)), int(rng.integers(150))) for _ in range(400)]
    wanted += [(3, a, 7) for a in range(150)] + [(None, 1, 2), (None, 2, 1), (0, 5, 5), (0, 5, 5), (0, 900, 3), (0, 3, 900), (1, None, 3), (1, 3, None)]
    p = spark.createDataFrame(wanted, "frame int, a_id bigint, b_id bigint")
    assert overlap_rows(M.frame_overlap(p, runs, ["frame"]), "frame") == expected(dense, wanted)
    assert M.frame_overlap(p.limit(0), runs, ["frame"]).count() == 0


def test_frame_sweep_is_linear_in_intervals(spark, monkeypatch):
    """One target and 200 predictions: every interval of a prediction goes in once, the target's once per tile."""
    seen = {}
    events = M._tile_events
    monkeypatch.setattr(M, "_tile_events", lambda *a: seen.setdefault("ends", events(*a)))
    _, _, runs = random_masks(spark, 201, 3)
    p = spark.range(1, 201).selectExpr("0 AS frame", "id AS a_id", "0L AS b_id")
    M.frame_overlap(p, runs, ["frame"])
    counts = {r["mask_id"]: r["n"] for r in runs.groupBy("mask_id").agg(F.count("*").alias("n")).collect()}
    tiles = -(-200 // M.TILE)
    assert seen["ends"].count() == 2 * (sum(n for i, n in counts.items() if i) + tiles * counts.get(0, 0))


@pytest.fixture
def stored(spark, tmp_path):
    dense, heads, runs = random_masks(spark, 60, 4)
    name = f"masks_{tmp_path.name}"
    yield dense, heads, runs, store.write_store(heads, runs, name, str(tmp_path / "store"), buckets=8)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


@pytest.mark.parametrize("least", [1, 4096])
def test_stored_overlap_with_a_hot_mask(spark, stored, least):
    dense, _, _, masks = stored
    wanted = [(k, k % 60, 7) for k in range(200)] + [(k, 9, k % 60) for k in range(200)] + [(1, k, 59 - k) for k in range(60)]
    wanted += [(5, 700, 1), (5, 1, 700), (6, None, 1), (6, 1, None), (7, 3, 3), (7, 3, 3)]
    p = spark.createDataFrame(wanted, "tag int, a_id bigint, b_id bigint")
    assert overlap_rows(store.stored_overlap(p, masks, least=least), "tag") == expected(dense, wanted)
    assert store.stored_overlap(p.limit(0), masks).count() == 0


def test_store_keeps_area_hash_and_intervals(spark, stored):
    dense, heads, runs, masks = stored
    assert rows(masks.intervals()) == rows(runs.select("mask_id", "s", "e"))
    kept = {r["mask_id"]: r for r in masks.headers().collect()}
    assert [kept[i]["area"] for i in range(60)] == [int(m.sum()) for m in dense]
    assert {i: r["mask_sha"] for i, r in kept.items()} == {r["mask_id"]: r["mask_sha"] for r in M.mask_sha(runs, heads).collect()}
    more = heads.withColumn("mask_id", F.col("mask_id") + 100), runs.withColumn("mask_id", F.col("mask_id") + 100)
    store.write_store(*more, masks.name, buckets=8, mode="append")
    assert masks.headers().count() == 120
    p = spark.createDataFrame([(k, k + 100) for k in range(60)], "a_id bigint, b_id bigint")
    assert store.stored_overlap(p, masks).filter("inter <> area_a or inter <> area_b").count() == 0


def test_stored_masks_are_joined_without_a_shuffle(spark, stored):
    masks = stored[3]
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {k: spark.conf.get(k) for k in names}
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "false")
        p = published(spark.range(60).selectExpr("id AS a_id", "59 - id AS b_id"))
        plan = store.stored_overlap(p, masks)._jdf.queryExecution().executedPlan().toString()
        union = M.mask_union(masks.intervals("area"), ["area"])._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Bucketed: true") == 2 and plan.count("FileScan") == 3
    # only the pairs move: by the first id, then by the second
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(moved) == 2 and all("hashpartitioning(a_id" in m or "hashpartitioning(b_id" in m for m in moved), plan
    assert union.count("FileScan") == 1
