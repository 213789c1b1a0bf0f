"""Verdicts on cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import review as R
from sightline.plans.registry import joined, register
from sightline.plans.tables import VERD_SQL, VIEWS, cards, table, verdicts

_APPLIED_SQL = f"""{VERD_SQL}, a AS (
  SELECT c.card, c.usable, c.idxs, v.id IS NOT NULL AS reviewed, v.verdict, v.add_frames, coalesce(v.keep_frames, []) AS keep_frames,
    CASE WHEN len(coalesce(v.keep_frames, [])) > 0 THEN [x FOR x IN c.idxs IF list_contains(v.keep_frames, x)]
         ELSE [x FOR x IN c.idxs IF NOT list_contains(coalesce(v.drop_frames, []), x)] END AS edited
  FROM cards c LEFT JOIN verd v ON v.id = c.card),
r AS (SELECT *, CASE WHEN NOT reviewed THEN 'unreviewed' WHEN verdict = 'drop' THEN 'dropped' WHEN NOT usable THEN 'unusable' WHEN len(edited) = 0 THEN 'emptied' ELSE 'kept' END AS reason FROM a),
applied AS (SELECT card, reason, CASE WHEN reason IN ('kept', 'emptied') THEN array_to_string(edited, ',') ELSE '' END AS frames,
  CASE WHEN reason IN ('kept', 'emptied') AND len(keep_frames) > 0 THEN len(edited) ELSE 0 END AS selected_frames,
  CASE WHEN reason IN ('kept', 'emptied') THEN len(idxs) - len(edited) ELSE 0 END AS dropped_frames,
  CASE WHEN reason IN ('kept', 'emptied') THEN len(add_frames) ELSE 0 END AS pending_adds,
  CASE WHEN reason IN ('kept', 'emptied') THEN len([x FOR x IN keep_frames IF NOT list_contains(idxs, x)]) ELSE 0 END AS unmatched FROM r)"""


def _applied(spark, d):
    return R.apply_verdicts(cards(spark, d), verdicts(spark, d), usable="usable")


@register("apply_verdicts", "C09", f"WITH {_APPLIED_SQL} SELECT * FROM applied")
def apply_verdicts(spark, d):
    return _applied(spark, d).select(
        "card", "reason", joined("frames", "frames"), "selected_frames", "dropped_frames", "pending_adds", F.size("unmatched_picks").cast("bigint").alias("unmatched")
    )


@register(
    "review_accounting",
    "D33",
    f"""WITH {_APPLIED_SQL} SELECT """
    + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}_cards" for r in ("kept", "dropped", "emptied", "unreviewed", "unusable"))
    + """, CAST(sum(selected_frames) AS BIGINT) AS selected_frames, CAST(sum(dropped_frames) AS BIGINT) AS dropped_frames,
      CAST(sum(pending_adds) AS BIGINT) AS pending_adds, CAST(sum(unmatched) AS BIGINT) AS unmatched_picks FROM applied""",
)
def review_accounting(spark, d):
    return R.review_accounting(_applied(spark, d))


@register(
    "edit_frames",
    "G02",
    f"""WITH {VERD_SQL} SELECT c.card, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN len(v.keep_frames) > 0 THEN [x FOR x IN c.idxs IF list_contains(v.keep_frames, x)]
      ELSE [x FOR x IN c.idxs IF NOT list_contains(v.drop_frames, x)] END, v.add_frames))), ',') AS frames FROM cards c JOIN verd v ON v.id = c.card""",
)
def edit_frames(spark, d):
    rows = cards(spark, d).join(verdicts(spark, d).drop("card"), F.col("card").cast("string") == F.col("id"))
    edited = R.edit_frames(F.col("idxs"), F.col("keep_frames"), F.col("drop_frames"), F.col("add_frames"))
    return rows.select("card", joined(edited, "frames"))


@register(
    "missing_picks",
    "G07",
    f"""WITH {VERD_SQL}, w AS (SELECT DISTINCT id AS card, unnest(list_concat(keep_frames, add_frames)) AS t FROM verd),
      f AS (SELECT c.card, u.t, k.v FROM cards c, unnest(idxs) u(t), unnest(range(5)) k(v) WHERE NOT (k.v = 4 AND (c.card + u.t) % 3 = 0)),
      h AS (SELECT card, t FROM f GROUP BY 1, 2 HAVING count(DISTINCT v) = 5)
    SELECT CAST(w.card AS VARCHAR) AS card, w.t FROM w WHERE w.card IN (SELECT card FROM cards) AND NOT EXISTS (SELECT 1 FROM h WHERE h.card = w.card AND h.t = w.t)""",
)
def missing_picks(spark, d):
    c = cards(spark, d).withColumn("card", F.col("card").cast("string"))
    views = F.explode(F.array(*[F.lit(v) for v in VIEWS])).alias("view")
    files = c.select("card", F.explode("idxs").alias("t")).select("*", views)
    files = files.filter(~((F.col("view") == VIEWS[4]) & ((F.col("card").cast("bigint") + F.col("t")) % 3 == 0)))
    n_views = c.select("card", F.lit(len(VIEWS)).alias("views"))
    v = verdicts(spark, d).withColumn("id", F.when(F.col("id").cast("bigint") % 2 == 0, F.concat(F.lit("z_"), F.col("id"))).otherwise(F.col("id")))
    return R.missing_picks(v, files, n_views)
