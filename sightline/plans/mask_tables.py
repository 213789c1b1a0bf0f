"""Mask algebra, extents, points and mask series."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions.columns import add_visibility, sane_area
from sightline.operators import mask_store as store
from sightline.operators import masks as M
from sightline.plans.registry import big, joined, r6, register
from sightline.plans.tables import MASK_SQL, mask_bits, mask_pairs, mask_tables, table
from sightline.session import work_folder

_INTERVALS = """SELECT {k}, min(pos) AS s, max(pos) + 1 AS e FROM (SELECT {k}, pos, pos - row_number() OVER (PARTITION BY {k} ORDER BY pos) AS isl FROM ({src})) GROUP BY {k}, isl"""


def _overlap(spark, d):
    headers, runs = mask_tables(spark, d)
    return M.mask_overlap(mask_pairs(headers), runs)


@register("masks_from_bits", "H01", f"WITH {MASK_SQL} SELECT * FROM runs")
def masks_from_bits(spark, d):
    return mask_tables(spark, d)[1]


@register(
    "mask_counts",
    "H02",
    f"""WITH {MASK_SQL}, b AS (SELECT mask_id, pos, on_, coalesce(lag(on_) OVER (PARTITION BY mask_id ORDER BY pos) <> on_, on_) AS chg FROM px),
      g AS (SELECT mask_id, pos, on_, sum(CASE WHEN chg THEN 1 ELSE 0 END) OVER (PARTITION BY mask_id ORDER BY pos) AS grp FROM b),
      c AS (SELECT mask_id, grp, count(*) AS n, bool_or(on_) AS on_ FROM g GROUP BY 1, 2)
    SELECT mask_id, CASE WHEN (SELECT bool_or(x.on_) FROM c x WHERE x.mask_id = c.mask_id AND x.grp = 0) THEN '0,' WHEN min(grp) = 1 THEN '0,' ELSE '' END
      || string_agg(CAST(n AS VARCHAR), ',' ORDER BY grp) AS counts, '8,8' AS size FROM c GROUP BY 1""",
)
def mask_counts(spark, d):
    headers, runs = mask_tables(spark, d)
    return M.masks_to_counts(runs, headers).select("mask_id", joined("counts", "counts"), joined("size", "size"))


@register(
    "mask_roundtrip",
    "H02",
    f"""WITH {MASK_SQL} SELECT count(*) AS intervals, 0::BIGINT AS findings, count(*) FILTER (mask_id % 5 = 0) AS seeded FROM runs""",
)
def mask_roundtrip(spark, d):
    headers, runs = mask_tables(spark, d)
    count = lambda r: M.roundtrip_findings(r, headers).agg(F.count(F.lit(1))).scalar()
    # intervals without pixels, which no run count can hold
    empty = runs.filter("mask_id % 5 = 0").select("mask_id", F.col("e").alias("s"), "e")
    torn = runs.select("mask_id", "s", "e").union(empty)
    return runs.agg(F.count(F.lit(1)).alias("intervals")).withColumns({"findings": count(runs), "seeded": count(torn)})


@register("mask_area", "H03", f"WITH {MASK_SQL} SELECT mask_id, 8 AS h, 8 AS w, area, area > 0 AS visible FROM heads")
def mask_area(spark, d):
    headers, runs = mask_tables(spark, d)
    return M.mask_area(runs, headers)


@register("mask_overlap", "H04", f'WITH {MASK_SQL} SELECT pair_id, a_id, b_id, label, area_a, area_b, inter, area_a + area_b - inter AS "union" FROM ov')
def mask_overlap(spark, d):
    return _overlap(spark, d)


@register(
    "frame_overlap",
    "H04",
    f"""WITH {MASK_SQL}, t AS (SELECT label, min(mask_id) AS lo, max(mask_id) AS hi FROM heads GROUP BY 1),
      q AS (SELECT h.mask_id AS a_id, unnest([t.lo, t.hi]) AS b_id, h.label, h.area AS area_a FROM heads h JOIN t USING (label))
    SELECT q.a_id, q.b_id, q.label, q.area_a, any_value(b.area) AS area_b, count(y.pos) AS inter, q.area_a + any_value(b.area) - count(y.pos) AS "union"
    FROM q JOIN heads b ON b.mask_id = q.b_id LEFT JOIN fg x ON x.mask_id = q.a_id LEFT JOIN fg y ON y.mask_id = q.b_id AND y.pos = x.pos GROUP BY 1, 2, 3, 4""",
)
def frame_overlap(spark, d):
    # two targets in each label's frame, and all masks of the label as predictions
    headers, runs = mask_tables(spark, d)
    targets = headers.groupBy("label").agg(F.array(F.min("mask_id"), F.max("mask_id")).alias("t"))
    pairs = headers.select(F.col("mask_id").alias("a_id"), "label").join(targets, "label").select("a_id", F.explode("t").alias("b_id"), "label")
    return M.frame_overlap(pairs, runs, ["label"])


@register(
    "stored_overlap",
    "H04 H10",
    f"""WITH {MASK_SQL}, t AS (SELECT max(mask_id) AS last FROM heads),
      q AS (SELECT a_id, b_id, label, area_a, area_b, inter FROM ov UNION ALL
        SELECT h.mask_id, t.last, h.label, h.area, l.area, CAST((SELECT count(*) FROM fg x JOIN fg y ON x.pos = y.pos WHERE x.mask_id = h.mask_id AND y.mask_id = t.last) AS BIGINT)
        FROM heads h, t JOIN heads l ON l.mask_id = t.last)
    SELECT a_id, b_id, label, area_a, area_b, inter, area_a + area_b - inter AS "union",
      round(CASE WHEN area_a + area_b - inter > 0 THEN inter::DOUBLE / (area_a + area_b - inter) END, 6) AS iou FROM q""",
)
def stored_overlap(spark, d):
    # each mask with the next one and with the last, which half of all pairs share
    headers, runs = mask_tables(spark, d)
    path = work_folder(spark)
    stored = store.write_store(headers, runs, "masks_" + path.rsplit("/", 1)[-1], path)
    heads = stored.headers()
    last = heads.agg(F.max("mask_id")).first()[0]
    pairs = mask_pairs(heads).select("a_id", "b_id", "label").union(heads.select("mask_id", F.lit(last), "label"))
    scored = M.mask_scores(store.stored_overlap(pairs, stored), "null")
    return scored.withColumn("iou", r6("iou")).drop("dice")


@register(
    "mask_scores",
    "D01",
    f"""WITH {MASK_SQL} SELECT pair_id, round(inter / (area_a + area_b - inter + 1e-6::DOUBLE), 6) AS iou, round(2 * inter / (area_a + area_b + 1e-6::DOUBLE), 6) AS dice FROM ov""",
)
def mask_scores(spark, d):
    return M.mask_scores(_overlap(spark, d), "eps").select("pair_id", r6("iou"), r6("dice"))


@register(
    "region_j",
    "H11",
    f"""WITH {MASK_SQL} SELECT label, round(avg(CASE WHEN area_a + area_b - inter = 0 THEN 1.0::DOUBLE ELSE inter::DOUBLE / (area_a + area_b - inter) END), 6) AS mean_j,
      count(*) AS objects FROM ov GROUP BY 1""",
)
def region_j(spark, d):
    return M.region_j(_overlap(spark, d), ["label"]).select(big("label"), r6("mean_j"), "objects")


@register("mask_union", "H05", f"WITH {MASK_SQL} " + _INTERVALS.format(k="label", src="SELECT DISTINCT label, pos FROM fg WHERE pos % 9 <> label % 9"))
def mask_union(spark, d):
    bits = mask_bits(spark, d)
    holes = F.transform("bits", lambda b, i: b & (i % 9 != F.col("label") % 9))
    return M.mask_union(M.masks_from_bits(bits.withColumn("bits", holes), key="label"), ["label"]).select(big("label"), "s", "e")


_PAIR_FG = "FROM pairs p JOIN fg x ON x.mask_id = p.a_id"


@register(
    "mask_intersect",
    "H05",
    f"WITH {MASK_SQL} " + _INTERVALS.format(k="pair_id", src=f"SELECT p.pair_id, x.pos {_PAIR_FG} JOIN fg y ON y.mask_id = p.b_id AND y.pos = x.pos"),
)
def mask_intersect(spark, d):
    headers, runs = mask_tables(spark, d)
    return M.mask_intersect(mask_pairs(headers), runs, runs)


@register(
    "mask_minus",
    "H05",
    f"WITH {MASK_SQL} " + _INTERVALS.format(k="pair_id", src=f"SELECT p.pair_id, x.pos {_PAIR_FG} WHERE NOT EXISTS (SELECT 1 FROM fg y WHERE y.mask_id = p.b_id AND y.pos = x.pos)"),
)
def mask_minus(spark, d):
    headers, runs = mask_tables(spark, d)
    return M.mask_minus(mask_pairs(headers), runs, runs)


@register(
    "size_gate",
    "H06",
    f"""WITH {MASK_SQL} SELECT label, count(*) AS pairs, count(*) FILTER (a_id % 5 <> 0 AND b_id % 5 <> 0) AS same_size FROM ov GROUP BY 1""",
)
def size_gate(spark, d):
    headers, _ = mask_tables(spark, d)
    odd = headers.withColumn("h", F.when(F.col("mask_id") % 5 == 0, 16).otherwise(F.col("h")))
    gated = M.size_gate(mask_pairs(headers), odd, odd)
    return gated.groupBy(big("label")).agg(F.count(F.lit(1)).alias("pairs"), F.count_if("same_size").alias("same_size"))


@register(
    "mask_from_ids",
    "H07",
    f"WITH {MASK_SQL} " + _INTERVALS.format(k="frame", src="SELECT DISTINCT mask_id // 4 AS frame, pos FROM fg WHERE mask_id % 4 IN (1, 2)"),
)
def mask_from_ids(spark, d):
    _, runs = mask_tables(spark, d)
    id_runs = runs.select(F.floor(F.col("mask_id") / 4).alias("frame"), (F.col("mask_id") % 4).alias("id"), "s", "e")
    ids = id_runs.select("frame", "id").distinct().filter(F.col("id").isin(1, 2))
    return M.mask_from_ids(id_runs, ids, ["frame"])


_EXTENT = "ext AS (SELECT mask_id, min(pos // 8) AS x0, max(pos // 8) AS x1, min(pos % 8) AS y0, max(pos % 8) AS y1 FROM fg GROUP BY 1)"


@register("mask_extent", "H08", f"WITH {MASK_SQL}, {_EXTENT} SELECT mask_id, 8 AS h, 8 AS w, x0, x1, y0, y1 FROM ext")
def mask_extent(spark, d):
    headers, runs = mask_tables(spark, d)
    return M.mask_extent(runs, headers)


@register(
    "mask_bbox",
    "D30",
    f"""WITH {MASK_SQL}, {_EXTENT} SELECT h.mask_id, round((x0 + x1) / 2 / 8, 4) AS cx, round((y0 + y1) / 2 / 8, 4) AS cy, round((x1 - x0 + 1) / 8, 4) AS bw,
      round((y1 - y0 + 1) / 8, 4) AS bh FROM heads h LEFT JOIN ext USING (mask_id)""",
)
def mask_bbox(spark, d):
    headers, runs = mask_tables(spark, d)
    return M.mask_bbox(runs, headers)


@register(
    "roi_union",
    "D31",
    f"""WITH {MASK_SQL}, {_EXTENT} SELECT h.mask_id, least(x0 * 2.0, h.mask_id % 17)::DOUBLE AS roi_x0, least(y0 * 2.0, h.mask_id % 5)::DOUBLE AS roi_y0,
      greatest(x1 * 2.0, h.mask_id % 17 + 3)::DOUBLE AS roi_x1, greatest(y1 * 2.0, h.mask_id % 5 + 4)::DOUBLE AS roi_y1 FROM heads h LEFT JOIN ext USING (mask_id)""",
)
def roi_union(spark, d):
    headers, runs = mask_tables(spark, d)
    x, y = F.col("mask_id") % 17, F.col("mask_id") % 5
    box = F.array(F.array(x.cast("double"), y.cast("double")), F.array((x + 3).cast("double"), (y + 4).cast("double")))
    rows = headers.select("mask_id").join(M.mask_extent(runs, headers), "mask_id", "left").withColumns({"box": box, "scale": F.lit(2)})
    none = F.lit(None).cast("array<array<double>>")
    out = M.roi_union(rows.withColumn("gripper", none), ["box", "gripper"], "scale")
    return out.select("mask_id", "roi_x0", "roi_y0", "roi_x1", "roi_y1")


@register(
    "duplicate_masks",
    "H10",
    f"""WITH {MASK_SQL}, two AS (SELECT mask_id, mask_id AS id FROM heads UNION ALL SELECT mask_id, -1 - mask_id FROM heads WHERE mask_id % 3 = 0),
      sig AS (SELECT h.id AS mask_id, coalesce(string_agg(r.s || '-' || r.e, ',' ORDER BY r.s), '') AS body FROM two h LEFT JOIN runs r USING (mask_id) GROUP BY 1),
      sha AS (SELECT mask_id, sha256('8;8;' || body) AS mask_sha FROM sig)
    SELECT mask_sha, count(*) AS masks, min(mask_id) AS first_mask FROM sha GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_masks(spark, d):
    headers, runs = mask_tables(spark, d)
    # every third mask also under a second id
    twice = lambda t: t.union(t.filter("mask_id % 3 = 0").withColumn("mask_id", -1 - F.col("mask_id")))
    return M.duplicate_masks(M.mask_sha(twice(runs), twice(headers)))


@register(
    "cycle_evidence",
    "H12",
    f"""WITH {MASK_SQL}, pts AS (SELECT mask_id, e.expert, (mask_id * e.k + i) % 8 + 0.25 AS x, (mask_id + i * e.k) % 8 + 0.5 AS y, mask_id % 11 = 0 AND e.k = 2 AND i = 0 AS bad
        FROM heads, (VALUES ('A', 1), ('B', 2), ('C', 3)) e(expert, k), unnest(range(4)) u(i)),
      ref AS (SELECT mask_id, (mask_id + j * 3) % 8 AS x, (mask_id * 2 + j) % 8 AS y FROM heads, unnest(range(3)) u(j)),
      near AS (SELECT p.mask_id, p.expert, p.x, p.y, bool_or(p.bad) AS bad, min(sqrt((r.x - p.x) ** 2 + (r.y - p.y) ** 2)) AS dist, count(*) AS c FROM
        (SELECT *, row_number() OVER () AS rid FROM pts) p JOIN ref r USING (mask_id) GROUP BY p.rid, p.mask_id, p.expert, p.x, p.y)
    SELECT n.mask_id, n.expert, CASE WHEN NOT bool_or(bad) THEN count(f.pos) END AS inside_count, round(CASE WHEN NOT bool_or(bad) THEN avg(dist) END, 6) AS cycle_distance,
      NOT bool_or(bad) AS valid FROM near n LEFT JOIN fg f ON f.mask_id = n.mask_id AND f.pos = CAST(floor(n.x) AS BIGINT) * 8 + CAST(floor(n.y) AS BIGINT) GROUP BY 1, 2""",
)
def cycle_evidence(spark, d):
    headers, runs = mask_tables(spark, d)
    experts = F.inline(F.array(*[F.struct(F.lit(e).alias("expert"), F.lit(k).alias("k")) for k, e in enumerate("ABC", 1)]))
    m, k, i = F.col("mask_id"), F.col("k"), F.col("i")
    rows = headers.select("mask_id", experts).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    bad = (m % 11 == 0) & (k == 2) & (i == 0)
    points = rows.select(
        "mask_id",
        "expert",
        F.when(bad, F.lit(float("nan"))).otherwise((m * k + i) % 8 + 0.25).alias("x"),
        ((m + i * k) % 8 + 0.5).alias("y"),
    )
    j = F.col("j")
    ref = headers.select("mask_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")).select("mask_id", ((m + j * 3) % 8).alias("x"), ((m * 2 + j) % 8).alias("y"))
    out = M.cycle_evidence(points, runs, ref, headers)
    return out.select("mask_id", "expert", "inside_count", r6("cycle_distance"), "valid")


@register(
    "prompt_qa",
    "H13",
    f"""WITH {MASK_SQL}, q AS (SELECT mask_id AS task, mask_id, (mask_id * 7 + i * 13) % 64 AS pos, i < 2 AS positive, i >= 3 AND mask_id % 6 = 0 AS bad, i = 4 AS box_only FROM heads, unnest(range(5)) u(i)),
      t AS (SELECT q.* REPLACE (positive AND NOT box_only AS positive), f.pos IS NOT NULL AND NOT box_only AS inside FROM q LEFT JOIN fg f ON f.mask_id = q.mask_id AND f.pos = q.pos)
    SELECT task, count(*) FILTER (positive AND NOT inside) AS positive_outside, count(*) FILTER (NOT positive AND inside) AS negative_inside, count(*) FILTER (bad) AS bad_boxes,
      bool_or((positive AND NOT inside) OR (NOT positive AND inside) OR bad) AS flagged FROM t GROUP BY 1""",
)
def prompt_qa(spark, d):
    headers, runs = mask_tables(spark, d)
    i, m = F.col("i"), F.col("mask_id")
    box = F.when(i >= 3, F.array(F.lit(0.1), F.lit(0.2), F.when(m % 6 == 0, 1.5).otherwise(0.5), F.lit(1.0)))
    rows = headers.select("mask_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    # the last prompt of a mask is a box alone
    prompts = rows.select(m.alias("task"), "mask_id", F.when(i < 4, (m * 7 + i * 13) % 64).alias("pos"), (i < 2).alias("positive"), box.alias("box"))
    return M.prompt_qa(prompts, runs)


@register(
    "centroid_drift",
    "H14",
    f"""WITH {MASK_SQL}, c AS (SELECT mask_id, any_value(label) AS label, avg(pos // 8) AS x, avg(pos % 8) AS y FROM fg GROUP BY 1),
      l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM c WINDOW w AS (PARTITION BY label ORDER BY mask_id))
    SELECT label, mask_id, round(x, 6) AS x, round(y, 6) AS y, round(sqrt((x - px) ** 2 + (y - py) ** 2), 6) AS drift FROM l""",
)
def centroid_drift(spark, d):
    headers, runs = mask_tables(spark, d)
    cent = M.mask_centroid(runs, headers).join(headers.select("mask_id", "label"), "mask_id")
    out = M.centroid_drift(cent, "label", "mask_id")
    return out.select(big("label"), "mask_id", r6("x"), r6("y"), r6("drift"))


@register(
    "area_profile",
    "D22",
    f"""WITH {MASK_SQL}, a AS (SELECT area * 400 AS area FROM heads), s AS (SELECT count(*) AS n, min(area) AS mn, CAST(trunc(median(area)) AS BIGINT) AS md, avg(area) AS av, max(area) AS mx FROM a),
      b(bin, lo, hi) AS (VALUES ('<1k', -1, 1000), ('1k-5k', 1000, 5000), ('5k-20k', 5000, 20000), ('>=20k', 20000, 1000000000))
    SELECT bin, (SELECT count(*) FROM a WHERE area >= lo AND area < hi) AS masks, round((SELECT count(*) FROM a WHERE area >= lo AND area < hi)::DOUBLE / n, 6) AS share,
      mn AS min_area, md AS median_area, round(av, 6) AS mean_area, mx AS max_area FROM b, s""",
)
def area_profile(spark, d):
    headers, _ = mask_tables(spark, d)
    out = M.area_profile(headers.withColumn("area", F.col("area") * 400))
    return out.select("bin", "masks", r6("share"), "min_area", "median_area", r6("mean_area"), "max_area")


_JUMP = """series AS (SELECT label, mask_id AS frame, CASE WHEN mask_id % 13 = 0 THEN 0 ELSE area * (1 + mask_id % 3) * 20 END AS area FROM heads),
  jmp AS (SELECT *, lag(area) OVER (PARTITION BY label ORDER BY frame) AS prev_area FROM series),
  jj AS (SELECT *, coalesce(abs(area - prev_area) > greatest(200.0, prev_area * 0.6::DOUBLE), false) AS jump FROM jmp)"""


def _series(headers):
    m = F.col("mask_id")
    area = F.when(m % 13 == 0, F.lit(0).cast("bigint")).otherwise(F.col("area") * (1 + m % 3) * 20)
    return headers.select("label", m.alias("frame"), area.alias("area"))


@register("area_jumps", "E05", f"WITH {MASK_SQL}, {_JUMP} SELECT label, frame, area, prev_area, jump FROM jj")
def area_jumps(spark, d):
    return M.area_jumps(_series(mask_tables(spark, d)[0]), "label", "frame")


@register(
    "propagation_qa",
    "D25",
    f"""WITH {MASK_SQL}, {_JUMP}, a AS (SELECT label, avg(CASE WHEN u = 0 THEN 1.0::DOUBLE ELSE inter::DOUBLE / u END) AS anchor_iou FROM (SELECT label, inter, area_a + area_b - inter AS u FROM ov WHERE pair_id % 4 = 0) GROUP BY 1),
      o AS (SELECT label, sum(inter)::DOUBLE / sum(area_a + area_b - inter) AS agreement FROM ov WHERE pair_id % 4 = 1 GROUP BY 1)
    SELECT j.label, round(avg(CASE WHEN area > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, count(*) FILTER (jump) AS area_jumps, round(any_value(anchor_iou), 6) AS anchor_iou,
      round(any_value(agreement), 6) AS agreement FROM jj j LEFT JOIN a USING (label) LEFT JOIN o USING (label) GROUP BY 1""",
)
def propagation_qa(spark, d):
    ov = _overlap(spark, d).select("label", "pair_id", "inter", "union")
    k = F.col("pair_id") % 4
    out = M.propagation_qa(_series(mask_tables(spark, d)[0]), ov.filter(k == 0), ov.filter(k == 1), "label", "frame")
    return out.select(big("label"), r6("coverage"), "area_jumps", r6("anchor_iou"), r6("agreement"))


@register(
    "prediction_flags",
    "D26",
    f"""WITH {MASK_SQL}, s AS (SELECT mask_id // 6 AS video, CASE WHEN mask_id // 6 % 5 = 0 AND mask_id % 6 > 0 THEN 0.0::DOUBLE ELSE area / 64.0::DOUBLE END AS share FROM heads)
    SELECT video, round(max(share), 6) AS max_share, count(*) FILTER (share > 0) AS nonempty, count(*) AS frames,
      CASE WHEN max(share) > 0.7 THEN 'blowup' WHEN count(*) FILTER (share > 0) < count(*) * 0.2 THEN 'mostly-empty' ELSE '' END AS flag FROM s GROUP BY 1""",
)
def prediction_flags(spark, d):
    m = F.col("mask_id")
    video = F.floor(m / 6)
    share = F.when((video % 5 == 0) & (m % 6 > 0), F.lit(0.0)).otherwise(F.col("area") / F.lit(64.0))
    rows = mask_tables(spark, d)[0].select(video.alias("video"), share.alias("share"))
    return M.prediction_flags(rows, "video").select("video", r6("max_share"), "nonempty", "frames", "flag")


@register(
    "compare_masks",
    "D34",
    f"""WITH {MASK_SQL} SELECT pair_id // 10 AS episode, round(avg(inter / (area_a + area_b - inter + 1e-6::DOUBLE)), 6) AS mean_iou, count(*) AS frames FROM ov GROUP BY 1""",
)
def compare_masks(spark, d):
    scored = M.mask_scores(_overlap(spark, d), "eps").withColumn("episode", F.floor(F.col("pair_id") / 10))
    return M.compare_masks(scored, "episode").select("episode", r6("mean_iou"), "frames")


@register(
    "resolve_masks",
    "G06",
    f"WITH {MASK_SQL}, src AS (SELECT mask_id // 3 AS task, mask_id % 3 AS part, pos FROM fg) "
    + _INTERVALS.format(k="task", src="SELECT DISTINCT task, pos FROM src WHERE part > 0 OR task % 4 <> 1"),
)
def resolve_masks(spark, d):
    headers, runs = mask_tables(spark, d)
    task, part = F.floor(F.col("mask_id") / 3).alias("task"), F.col("mask_id") % 3
    tasks = headers.select(task).distinct().withColumn("edited", F.col("task") % 4 == 1)
    return M.resolve_masks(tasks, runs.filter(part == 0).select(task, "s", "e"), runs.filter(part > 0).select(task, "s", "e"))


@register(
    "visibility_flags",
    "B10",
    f"""WITH {MASK_SQL}, v AS (SELECT pair_id, CASE WHEN pair_id % 3 = 0 THEN 0 ELSE area_a END AS a, CASE WHEN pair_id % 4 = 0 THEN NULL ELSE area_b END AS b FROM ov)
    SELECT pair_id, coalesce(a, 0) > 0 AS visible_a, coalesce(b, 0) > 0 AS visible_b, coalesce(a, 0) > 0 AND coalesce(b, 0) > 0 AS co_visible FROM v""",
)
def visibility_flags(spark, d):
    headers, _ = mask_tables(spark, d)
    pairs = mask_pairs(headers)
    a = headers.select(F.col("mask_id").alias("a_id"), F.when(F.col("mask_id") % 3 == 0, 0).otherwise(F.col("area")).alias("a"))
    b = headers.select(F.col("mask_id").alias("b_id"), F.when((F.col("mask_id") - 1) % 4 == 0, None).otherwise(F.col("area")).alias("b"))
    rows = add_visibility(pairs.join(a, "a_id").join(b, "b_id"), "a", "b")
    return rows.select("pair_id", "visible_a", "visible_b", "co_visible")


@register("sane_areas", "B13", f"WITH {MASK_SQL} SELECT mask_id, round(area / 64.0::DOUBLE, 6) AS share FROM heads WHERE area / 64.0 BETWEEN 0.003 AND 0.55")
def sane_areas(spark, d):
    rows = mask_tables(spark, d)[0].select("mask_id", (F.col("area") / F.lit(64.0)).alias("share"))
    return sane_area(rows, "share").select("mask_id", r6("share"))


@register(
    "polygon_stats",
    "H09",
    """WITH v AS (SELECT vec_id, i, CAST(trunc(floor(abs(embedding[2 * i + 1]) * 1000) / 2.0) AS BIGINT) AS x, CAST(trunc(floor(abs(embedding[2 * i + 2]) * 1000) / 2.0) AS BIGINT) AS y FROM embeddings, unnest(range(5)) u(i)),
      n AS (SELECT a.vec_id, a.x * b.y - b.x * a.y AS c, a.x, a.y FROM v a JOIN v b ON b.vec_id = a.vec_id AND b.i = (a.i + 1) % 5)
    SELECT vec_id AS base, count(*) AS vertices, abs(sum(c)) / 2::DOUBLE AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM n GROUP BY 1""",
)
def polygon_stats(spark, d):
    at = lambda i: F.floor(F.abs(F.get("embedding", F.lit(i))) * 1000).cast("double")
    points = F.array(*[F.array(at(2 * i), at(2 * i + 1)) for i in range(5)])
    poly = table(spark, d, "embeddings").select(F.col("vec_id").alias("base"), points.alias("points"))
    meta = table(spark, d, "embeddings").select(F.col("vec_id").alias("base"), F.lit(2.0).alias("scale"))
    return M.polygon_stats(poly, meta)


