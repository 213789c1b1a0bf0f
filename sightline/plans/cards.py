"""From view pixels to cards: visibility, view choice, frame choice, relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import columns as C
from sightline.operators import pairing as P
from sightline.operators import quality as Q
from sightline.operators import selection as L
from sightline.operators.ordered import dealt, tasks_for
from sightline.plans.registry import big, joined, r6, register
from sightline.plans.tables import IDPX_SQL, VIEWS, VMETA_SQL, id_map, id_pixels, table, view_grid, view_meta, view_pixels, viewpx_sql

_ROUNDED = "round(visible_frac, 6) AS visible_frac"

# --- pixels ------------------------------------------------------------------------------------


@register(
    "target_ids",
    "B19",
    f"""WITH {IDPX_SQL}, n AS (SELECT DISTINCT demo, CASE WHEN demo % 3 = 0 THEN 'ring_9' WHEN demo % 3 = 1 THEN 'ring_2' ELSE 'red_bolt_77' END AS name FROM idpx),
      idmap2 AS (SELECT demo, view, id, CASE WHEN id % 5 = 0 THEN 'ring' ELSE label END AS label FROM idmap),
      m AS (SELECT i.demo, i.view, i.id, n.name, contains(i.label, n.name) AS exact, i.label = regexp_replace(n.name, '_[0-9]+$', '') AS cat
            FROM idmap2 i JOIN n USING (demo))
    SELECT demo, view, name, id FROM m WHERE CASE WHEN (SELECT bool_or(x.exact) FROM m x WHERE x.demo = m.demo AND x.view = m.view) THEN exact ELSE cat END""",
)
def target_ids(spark, d):
    labels = id_map(spark, d).withColumn("label", F.when(F.col("id") % 5 == 0, "ring").otherwise(F.col("label")))
    k = F.col("demo") % 3
    names = id_pixels(spark, d).select("demo").distinct().withColumn("name", F.when(k == 0, "ring_9").when(k == 1, "ring_2").otherwise("red_bolt_77"))
    return Q.target_ids(labels, names)


@register(
    "target_pixels",
    "D15",
    f"""WITH {IDPX_SQL}, l AS (SELECT demo, view, max(t) + 1 AS n_frames FROM idpx GROUP BY 1, 2),
      g AS (SELECT demo, view, unnest(range(n_frames)) AS t FROM l), p AS (SELECT demo, view, t, sum(px) AS px FROM idpx WHERE id IN (1, 2, 5) GROUP BY 1, 2, 3)
    SELECT g.demo, g.view, g.t, CAST(coalesce(p.px, 0) AS BIGINT) AS px FROM g LEFT JOIN p ON p.demo = g.demo AND p.view = g.view AND p.t = g.t""",
)
def target_pixels(spark, d):
    px = id_pixels(spark, d)
    ids = px.select("demo", "view", "id").distinct().filter(F.col("id").isin(1, 2, 5))
    lengths = px.groupBy("demo", "view").agg((F.max("t") + 1).alias("n_frames"))
    return Q.target_pixels(px, ids, lengths)


@register(
    "blank_steps",
    "B14",
    f"""WITH {IDPX_SQL} SELECT demo, t, bool_or(n <= 2) AS blank FROM (SELECT demo, view, t, count(DISTINCT id) AS n FROM idpx GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def blank_steps(spark, d):
    return Q.blank_steps(id_pixels(spark, d))


@register("black_pages", "B15", "SELECT page_id, length(html) % 7 < 3.0 AS black FROM pages")
def black_pages(spark, d):
    return table(spark, d, "pages").select("page_id", C.is_black(F.length("html") % 7).alias("black"))


@register("view_stats", "D14", f"WITH {VMETA_SQL} SELECT card, view, {_ROUNDED}, median_px, n_frames FROM vmeta")
def view_stats(spark, d):
    return view_meta(spark, d).select("card", "view", r6("visible_frac"), "median_px", "n_frames")


# --- view choice -----------------------------------------------------------------------------------

_EXO_SQL = """exo AS (SELECT card, view, visible_frac, median_px, k AS exo_rank FROM (SELECT *, row_number() OVER (PARTITION BY card
      ORDER BY median_px DESC, visible_frac DESC, view) AS k FROM vmeta WHERE view LIKE 'exo%' AND visible_frac >= 0.5 AND median_px > 0) WHERE k <= 2),
ego AS (SELECT card, CASE WHEN bool_or(view = 'head_gaze') THEN 'head_gaze' ELSE 'head' END AS ego FROM vmeta
      WHERE view IN ('head_gaze', 'head') AND visible_frac >= 0.5 GROUP BY 1)"""


@register("best_exos", "E02", f"WITH {VMETA_SQL}, {_EXO_SQL} SELECT card, view, exo_rank, {_ROUNDED}, median_px FROM exo")
def best_exos(spark, d):
    return Q.best_exos(view_meta(spark, d), min_vis=0.5).select("card", "view", "exo_rank", r6("visible_frac"), "median_px")


@register("pick_ego", "E03", f"WITH {VMETA_SQL}, {_EXO_SQL} SELECT card, ego FROM ego")
def pick_ego(spark, d):
    return Q.pick_ego(view_meta(spark, d), min_vis=0.5)


_SCORE_SQL = """sc AS (SELECT card, count(*) FILTER (visible_frac >= 0.6) AS n_live, count(*) FILTER (visible_frac >= 0.6 AND view LIKE 'exo%') AS n_exo,
      coalesce(max(visible_frac) FILTER (view IN ('left_wrist', 'right_wrist')), 0) AS wrist_best, coalesce(max(visible_frac) FILTER (view = 'head_gaze'), 0) AS head,
      bool_or(view LIKE '%wrist') AS has_wrist, CAST(min(n_frames) + any_value(card) % 7 AS BIGINT) AS n_frames
    FROM (SELECT card, CASE WHEN view = 'exo2' AND card % 3 = 0 THEN 'left_wrist' ELSE view END AS view, visible_frac, n_frames FROM vmeta) GROUP BY 1),
ver AS (SELECT *, CASE WHEN n_live = 0 THEN 'empty' WHEN n_exo = 0 THEN 'no-exo' WHEN has_wrist AND wrist_best < 0.7 THEN 'weak-wrist' WHEN n_exo < 2 THEN 'single-exo'
      WHEN n_live < CASE WHEN has_wrist THEN 5 ELSE 3 END THEN 'thin' ELSE 'ok' END AS verdict FROM sc)"""


def _cards(spark, d):
    wrist = F.when((F.col("view") == "exo2") & (F.col("card") % 3 == 0), "left_wrist").otherwise(F.col("view"))
    sc = Q.scorecard(view_meta(spark, d).withColumn("view", wrist), live=0.6)
    return sc.withColumn("n_frames", F.col("n_frames") + F.col("card") % 7).withColumn("verdict", Q.card_verdict(0.7))


@register(
    "scorecard",
    "D17 D18",
    f"""WITH {VMETA_SQL}, {_SCORE_SQL} SELECT card, n_live, n_exo, round(wrist_best, 6) AS wrist_best, round(head, 6) AS head, has_wrist, n_frames, verdict FROM ver""",
)
def scorecard(spark, d):
    return _cards(spark, d).select("card", "n_live", "n_exo", r6("wrist_best"), r6("head"), "has_wrist", "n_frames", "verdict")


@register(
    "verdict_histogram",
    "D19",
    f"""WITH {VMETA_SQL}, {_SCORE_SQL}, v(verdict) AS (VALUES ('ok'), ('thin'), ('single-exo'), ('weak-wrist'), ('no-exo'), ('empty'))
    SELECT v.verdict, count(ver.card) AS cards, round(count(ver.card)::DOUBLE / (SELECT count(*) FROM ver), 6) AS share FROM v LEFT JOIN ver ON ver.verdict = v.verdict GROUP BY 1""",
)
def verdict_histogram(spark, d):
    return Q.verdict_histogram(_cards(spark, d)).select("verdict", "cards", r6("share"))


@register(
    "verdict_lengths",
    "D19",
    f"""WITH {VMETA_SQL}, {_SCORE_SQL}, s AS (SELECT CASE WHEN verdict = 'ok' THEN 'ok' ELSE 'weak' END AS side, n_frames FROM ver WHERE verdict <> 'thin')
    SELECT side, list_sort(list(n_frames))[len(list(n_frames)) // 2 + 1] AS median_length FROM s GROUP BY 1""",
)
def verdict_lengths(spark, d):
    return Q.verdict_lengths(_cards(spark, d))


@register(
    "rerun_candidates",
    "D19",
    f"""WITH {VMETA_SQL}, {_SCORE_SQL} SELECT card, verdict, row_number() OVER (ORDER BY wrist_best, n_live, card) - 1 AS position FROM ver WHERE verdict NOT IN ('ok', 'thin')""",
)
def rerun_candidates(spark, d):
    return Q.rerun_candidates(_cards(spark, d)).select("card", "verdict", "position")


# --- frame choice ---------------------------------------------------------------------------------------

_STEP_SQL = f"""{viewpx_sql(12)},
blk AS (SELECT card, t, (card * 31 + t * 7) % 11 = 0 AS blank FROM (SELECT DISTINCT card, t FROM grid)),
has AS (SELECT card, bool_or(view = 'head_gaze') AS gaze FROM grid GROUP BY 1),
st AS (SELECT g.card, g.t, count(*) FILTER (px >= 200) AS n_vis, CAST(sum(least(px, 20000)) AS BIGINT) AS total_px,
         CAST(least(coalesce(CASE WHEN any_value(h.gaze) THEN sum(px) FILTER (view = 'head_gaze') ELSE sum(px) FILTER (view = 'head') END, 0), 40000) AS BIGINT) AS close_px
       FROM grid g JOIN has h USING (card) GROUP BY 1, 2),
steps AS (SELECT st.card, st.t, n_vis, total_px, close_px, close_px >= 200 AS close_vis, blank, n_vis > 0 AS alive, 10 * total_px + close_px AS px_score
          FROM st JOIN blk ON blk.card = st.card AND blk.t = st.t),
win AS (SELECT card, min(t) FILTER (close_vis) AS a, max(t) FILTER (close_vis) AS b, count(*) FILTER (close_vis) AS n, count(*) AS n_frames FROM steps GROUP BY 1),
wnd AS (SELECT card, CASE WHEN n >= 2 THEN greatest(0, a - greatest(1, (b - a) // 10)) ELSE 0 END AS win_lo,
               CASE WHEN n >= 2 THEN least(n_frames - 1, b + greatest(1, (b - a) // 10)) ELSE n_frames - 1 END AS win_hi FROM win)"""


def _steps(spark, d):
    px = view_grid(spark, d, hours=12)
    blank = px.select("card", "t").distinct().withColumn("blank", (F.col("card") * 31 + F.col("t") * 7) % 11 == 0)
    scored = L.score_steps(px, blank).withColumn("n_frames", F.lit(60).cast("bigint"))
    return L.on_grid(scored).withColumn("n_grid", F.size(C.frame_grid("n_frames")).cast("bigint"))


@register("score_steps", "F01", f"WITH {_STEP_SQL} SELECT * FROM steps")
def score_steps(spark, d):
    return _steps(spark, d).drop("n_frames", "g", "n_grid")


@register("manipulation_window", "E06", f"WITH {_STEP_SQL} SELECT card, CAST(win_lo AS BIGINT) AS win_lo, CAST(win_hi AS BIGINT) AS win_hi FROM wnd")
def manipulation_window(spark, d):
    return L.manipulation_window(_steps(spark, d))


_FOLD = """list_reduce(r, lambda acc, x: CASE WHEN len(acc) < 8 AND len([c FOR c IN acc IF abs(c - x[1]) < {gap}]) = 0 THEN list_concat(acc, x) ELSE acc END)"""
_GREEDY_SQL = f"""{_STEP_SQL},
lst AS (SELECT s.card, any_value(w.win_hi - w.win_lo + 1) AS win,
          list([s.t] ORDER BY blank, CASE WHEN blank THEN 0 WHEN close_vis THEN 0 ELSE 1 END, CASE WHEN blank THEN 0 ELSE -n_vis END, CASE WHEN blank THEN 0 ELSE -px_score END, s.t) AS r
        FROM steps s JOIN wnd w ON w.card = s.card WHERE s.t BETWEEN w.win_lo AND w.win_hi AND alive GROUP BY 1),
lv AS (SELECT card, {_FOLD.format(gap="greatest(1, win // 9)")} AS a, {_FOLD.format(gap="greatest(1, win // 16)")} AS b, {_FOLD.format(gap="1")} AS c FROM lst),
ch AS (SELECT card, list_sort(CASE WHEN len(a) = 8 THEN a WHEN len(b) = 8 THEN b ELSE c END) AS p FROM lv)"""


@register("greedy_spaced_topk", "F02", f"WITH {_GREEDY_SQL} SELECT card, p[i + 1] AS t, p[i + 1] AS g, i AS pick FROM ch, unnest(range(len(p))) u(i)")
def greedy_spaced_topk(spark, d):
    return L.greedy_spaced_topk(L.with_window(_steps(spark, d)))


@register(
    "sample_indices",
    "F10",
    """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
    SELECT user_id, n, CASE WHEN n <= 1 THEN '0' WHEN n <= 6 THEN array_to_string(range(n), ',')
      ELSE array_to_string([CAST(round_even(i * (n - 1) / 5, 0) AS BIGINT) FOR i IN range(6)], ',') END AS six,
      array_to_string(list_sort(list_distinct([0, n // 2, n - 1])), ',') AS three FROM n""",
)
def sample_indices(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", "n", joined(C.sample_indices("n", 6), "six"), joined(C.three_point("n"), "three"))


@register(
    "frame_grid",
    "I09",
    """WITH n AS (SELECT event_type, count(*) AS n_frames FROM events GROUP BY 1)
    SELECT event_type, g - 1 AS g, (g - 1) * greatest(1, n_frames // 240) AS t FROM n, unnest(range(1, 481)) u(g) WHERE (g - 1) * greatest(1, n_frames // 240) < n_frames""",
)
def frame_grid(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_frames"))
    return L.grid_steps(n, ["event_type"])


@register(
    "align_frames",
    "C08",
    f"""WITH {viewpx_sql(12)}, v AS (SELECT card, view, max(t) + 1 AS n_frames FROM viewpx GROUP BY 1, 2), m AS (SELECT card, min(n_frames) AS t_min FROM v GROUP BY 1),
      p AS (SELECT card, unnest(list_distinct([0, t_min // 2, t_min - 1])) AS t, t_min FROM m)
    SELECT p.card, p.t, v.view, v.n_frames, least(v.n_frames - 1, CAST(round_even(p.t / greatest(1, t_min - 1)::DOUBLE * (v.n_frames - 1), 0) AS BIGINT)) AS local_t FROM p JOIN v USING (card)""",
)
def align_frames(spark, d):
    views = view_pixels(spark, d, 12).groupBy("card", "view").agg((F.max("t") + 1).alias("n_frames"))
    picks = views.groupBy("card").agg(F.min("n_frames").alias("m")).select("card", F.explode(C.three_point("m")).alias("t"))
    return P.align_frames(picks, views, "card").select("card", "t", "view", "n_frames", "local_t")


# --- relations --------------------------------------------------------------------------------------------


@register(
    "prompt_frames",
    "E01",
    f"""WITH {viewpx_sql()} SELECT a.card, a.view AS source, b.view AS target, min(a.t) AS prompt_t FROM viewpx a JOIN viewpx b ON a.card = b.card AND a.t = b.t AND a.view <> b.view
      WHERE a.px > 2000 AND b.px > 2000 GROUP BY 1, 2, 3""",
)
def prompt_frames(spark, d):
    return P.prompt_frames(view_pixels(spark, d), "card", "view", "t", F.col("px") > 2000, VIEWS)


_REL_SQL = f"""{VMETA_SQL}, {_EXO_SQL},
cv AS (SELECT e.card, g.ego, e.exos FROM (SELECT card, list(view ORDER BY exo_rank) AS exos FROM exo GROUP BY 1) e LEFT JOIN ego g USING (card)
       WHERE g.ego IS NOT NULL OR len(e.exos) >= 2),
dirs AS (SELECT card, ego AS source, x AS target, 'ego2exo' AS direction FROM cv, unnest(exos) u(x) WHERE ego IS NOT NULL
   UNION ALL SELECT card, x, ego, 'exo2ego' FROM cv, unnest(exos) u(x) WHERE ego IS NOT NULL
   UNION ALL SELECT card, exos[1], exos[2], 'exo2exo' FROM cv WHERE len(exos) >= 2
   UNION ALL SELECT card, exos[2], exos[1], 'exo2exo' FROM cv WHERE len(exos) >= 2),
pf AS (SELECT a.card, a.view AS source, b.view AS target, min(a.t) AS prompt_t FROM viewpx a JOIN viewpx b ON a.card = b.card AND a.t = b.t AND a.view <> b.view
   WHERE a.px > 0 AND b.px > 0 GROUP BY 1, 2, 3),
rel AS (SELECT d.*, pf.prompt_t, d.card || '_' || d.source || '__' || d.target AS pair_id FROM dirs d JOIN pf ON pf.card = d.card AND pf.source = d.source AND pf.target = d.target)"""


def relation_table(spark, d):
    """Directed relations with their prompt step, from view pixels to pair ids."""
    px = view_pixels(spark, d)
    views = Q.card_views(view_meta(spark, d), min_vis=0.5)
    prompts = P.prompt_frames(px, "card", "view", "t", F.col("px") > 0, VIEWS)
    rel = Q.card_relations(views).join(prompts, ["card", "source", "target"])
    return rel.withColumn("pair_id", C.pair_id("card", "source", "target"))


@register("relation_build", "E01 E02 E03 C04 B21 A13", f"WITH {_REL_SQL} SELECT pair_id, card, source, target, direction, prompt_t FROM rel")
def relation_build(spark, d):
    return relation_table(spark, d).select("pair_id", "card", "source", "target", "direction", "prompt_t")


@register(
    "dataset_ledger",
    "D23",
    f"""WITH {_REL_SQL} SELECT direction, count(*) AS relations, count(DISTINCT card) AS cards, count(DISTINCT (card, prompt_t)) AS moments FROM rel GROUP BY 1""",
)
def dataset_ledger(spark, d):
    return Q.dataset_ledger(relation_table(spark, d))


@register(
    "camera_usage",
    "D23",
    f"WITH {_REL_SQL} SELECT camera, count(*) AS uses FROM (SELECT source AS camera FROM rel UNION ALL SELECT target FROM rel) GROUP BY 1",
)
def camera_usage(spark, d):
    return Q.camera_usage(relation_table(spark, d))


@register(
    "image_references",
    "D23 G04",
    f"""WITH {_REL_SQL}, refs AS (SELECT card || '/' || source || '/' || prompt_t AS image FROM rel UNION SELECT card || '/' || target || '/' || prompt_t FROM rel),
      img AS (SELECT DISTINCT card || '/' || view || '/' || t AS image FROM viewpx)
    SELECT count(*) FILTER (image IN (SELECT image FROM refs)) AS referenced, count(*) FILTER (image NOT IN (SELECT image FROM refs)) AS unreferenced FROM img""",
)
def image_references(spark, d):
    name = lambda v: F.concat_ws("/", F.col("card").cast("string"), F.col(v), F.col("prompt_t").cast("string"))
    rel = relation_table(spark, d).withColumns({"prompt_image": name("source"), "target_image": name("target")})
    images = view_pixels(spark, d).withColumn("prompt_t", F.col("t")).select(name("view").alias("image"))
    return Q.image_references(rel, images)


@register(
    "card_stats",
    "D29",
    f"""WITH {viewpx_sql()} SELECT card, coalesce(min(px) FILTER (px > 0), 0) AS min_px, count(*) FILTER (px % 10 = 3) AS black_frames, count(DISTINCT t) AS steps,
      round(avg(CASE WHEN px > 0 THEN 1.0::DOUBLE ELSE 0 END), 3) AS vis FROM grid GROUP BY 1""",
)
def card_stats(spark, d):
    return Q.card_stats(view_grid(spark, d).withColumn("black", F.col("px") % 10 == 3))


@register(
    "goal_subjects",
    "B16",
    """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_size FROM part)
    SELECT p_partkey, w[2] || '.n.01' AS subject, 0 AS pos FROM w WHERE p_size % 2 = 0
    UNION ALL SELECT p_partkey, w[1] || '.n.01', CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END FROM w""",
)
def goal_subjects(spark, d):
    w = F.split("p_name", " ")
    obj = lambda i: F.concat(F.get(w, i), F.lit(".n.01_1"))
    even = F.col("p_size") % 2 == 0
    first = F.when(even, F.concat(F.lit("(inside ?"), obj(1), F.lit(" ?box.n.01_1) (open ?"), obj(0), F.lit(")"))).otherwise("")
    text = F.concat(F.lit("(:init (ontop ?x.n.01_1 ?y.n.01_1)) (:goal (and "), first, F.lit(" (ontop ?"), obj(0), F.lit(" ?shelf.n.02_1)"),
                    F.when(~even, F.concat(F.lit(" (ontop ?q.n.01_1 ?"), obj(1), F.lit(") (nextto ?"), obj(1), F.lit(" ?q.n.01_1)"))).otherwise(""), F.lit("))"))
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    part = dealt(part, ["p_partkey"], tasks_for(part, 1))  # few small files stand for many texts to parse
    goals = C.extract_goals(part.select("p_partkey", text.alias("text")), "text", ["p_partkey"])
    return C.manipulanda(goals, ["p_partkey"]).select("p_partkey", "subject", big("pos"))
