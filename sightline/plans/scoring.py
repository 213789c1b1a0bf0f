"""Scores, aggregation rules, expert selection and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions.columns import exact_mean, restored_index
from sightline.functions.stable import POISSON_ONE
from sightline.operators import audit as A
from sightline.operators import experts as X
from sightline.operators import metrics as S
from sightline.plans.registry import big, r6, register
from sightline.session import published
from sightline.plans.tables import EVID_SQL, OBJ_ORDER, OBJS_SQL, PAIR, evidence, objs, table

_ORDER = ", ".join(OBJ_ORDER)
_RANKED = f"{OBJS_SQL}, ranked AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS ordinal FROM objs)"
_NPAIRS = "(SELECT count(*) FROM (SELECT DISTINCT shard, pair FROM objs))"


@register(
    "metric_lattice",
    "D02",
    f"""WITH {_RANKED}, per AS (SELECT shard, pair, avg(iou) AS i, avg(dice) AS d, count(*) AS n FROM objs GROUP BY 1, 2)
    SELECT (SELECT count(*) FROM per) AS n_pairs, (SELECT count(*) FROM objs) AS n_objects,
      greatest(0, (SELECT count(*) FROM objs) - (SELECT count(*) FROM per)) AS dropped,
      round(100.0::DOUBLE * greatest(0, (SELECT count(*) FROM objs) - (SELECT count(*) FROM per)) / (SELECT count(*) FROM objs), 6) AS dropped_pct,
      round((SELECT avg(iou) FROM ranked WHERE ordinal < {_NPAIRS}), 6) AS stock_iou,
      round((SELECT avg(dice) FROM ranked WHERE ordinal < {_NPAIRS}), 6) AS stock_dice,
      round((SELECT avg(iou) FROM objs), 6) AS perobject_iou, round((SELECT avg(dice) FROM objs), 6) AS perobject_dice,
      round((SELECT avg(i) FROM per), 6) AS perpair_iou, round((SELECT avg(d) FROM per), 6) AS perpair_dice""",
)
def metric_lattice(spark, d):
    out = S.metric_lattice(objs(spark, d), PAIR, OBJ_ORDER)
    return out.select(*[r6(c) if t == "double" else c for c, t in out.dtypes])


@register(
    "truncation_audit",
    "D03",
    f"""WITH {_RANKED}, n AS (SELECT count(*) AS a, {_NPAIRS} AS k FROM objs)
    SELECT a AS n_objects, least(a, k) AS kept, a - least(a, k) AS dropped, round(100.0::DOUBLE * (a - least(a, k)) / a, 6) AS dropped_pct,
      round((SELECT avg(iou) FROM ranked WHERE ordinal < n.k), 6) AS prefix_mean,
      round((SELECT avg(iou) FROM ranked WHERE ordinal >= n.k), 6) AS tail_mean,
      round((SELECT avg(iou) FROM objs), 6) AS full_mean FROM n""",
)
def truncation_audit(spark, d):
    out = S.truncation_audit(objs(spark, d), PAIR, OBJ_ORDER)
    return out.select(*[r6(c) if t == "double" else c for c, t in out.dtypes])


@register(
    "legacy_lattice",
    "D04",
    f"""WITH {OBJS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY shard, pair ORDER BY {_ORDER.replace('shard, pair, ', '')} DESC) AS rn FROM
      (SELECT shard, pair, -l_linenumber AS l_linenumber, -l_partkey AS l_partkey, -l_suppkey AS l_suppkey, -l_extendedprice AS l_extendedprice,
              -epoch_us(l_shipdate) AS l_shipdate, l_quantity, iou FROM objs))
    SELECT (SELECT count(*) FROM r WHERE rn = 1) AS pairs, round((SELECT avg(iou) FROM r WHERE rn = 1), 6) AS last_object_mean,
      round((SELECT avg(iou) FROM objs WHERE iou > 0), 6) AS positive_mean, (SELECT count(*) FROM objs WHERE iou > 0) AS positive_objects""",
)
def legacy_lattice(spark, d):
    out = S.legacy_lattice(objs(spark, d), PAIR, OBJ_ORDER)
    return out.select("pairs", r6("last_object_mean"), r6("positive_mean"), "positive_objects")


@register(
    "threshold_rates",
    "D05",
    f"""WITH {OBJS_SQL} SELECT l_returnflag, count(*) AS objects, round(avg(CASE WHEN iou = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_share,
      round(avg(CASE WHEN iou >= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_share FROM objs GROUP BY 1""",
)
def threshold_rates(spark, d):
    return S.threshold_rates(objs(spark, d), ["l_returnflag"]).select("l_returnflag", "objects", r6("zero_share"), r6("hit_share"))


@register(
    "subset_means",
    "D06",
    f"""WITH {OBJS_SQL} SELECT l_returnflag, round(avg(iou) FILTER (l_linestatus = 'F'), 6) AS flagged_mean,
      round(avg(iou) FILTER (l_linestatus <> 'F'), 6) AS other_mean, round(avg(iou), 6) AS overall_mean,
      count(*) FILTER (l_linestatus = 'F') AS flagged FROM objs GROUP BY 1""",
)
def subset_means(spark, d):
    rows = objs(spark, d).withColumn("same_frame", F.col("l_linestatus") == "F")
    return S.subset_means(rows, "same_frame", ["l_returnflag"]).select(
        "l_returnflag", r6("flagged_mean"), r6("other_mean"), r6("overall_mean"), "flagged"
    )


@register(
    "metric_matrix",
    "D07",
    f"""WITH {OBJS_SQL}, m AS (SELECT o.*, l_tax AS cont_a, l_tax / 2 AS loc_e FROM
        (SELECT l_returnflag AS direction, l_linestatus AS method, l_orderkey AS pair, least(1.0::DOUBLE, l_discount * 10) AS iou, l_tax FROM lineitem) o),
      f AS (SELECT direction, method, pair, count(*) AS n, avg(iou) AS i, avg(cont_a) AS c, avg(loc_e) AS l FROM m GROUP BY 1, 2, 3)
    SELECT direction, method, CAST(sum(n) AS BIGINT) AS objects, count(*) AS frames,
      round(sum(n * i) / sum(n), 6) AS object_iou, round(sum(n * c) / sum(n), 6) AS object_cont_a, round(sum(n * l) / sum(n), 6) AS object_loc_e,
      round(avg(i), 6) AS frame_iou, round(avg(c), 6) AS frame_cont_a, round(avg(l), 6) AS frame_loc_e FROM f GROUP BY 1, 2""",
)
def metric_matrix(spark, d):
    registry = S.MetricRegistry()
    registry.register("iou", F.least(F.lit(1.0), F.col("l_discount") * 10))
    registry.register("cont_a", F.col("l_tax"))
    registry.register("loc_e", F.col("l_tax") / 2, higher_is_better=False)
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("direction"), F.col("l_linestatus").alias("method"), F.col("l_orderkey").alias("pair"), "l_discount", "l_tax"
    )
    out = S.metric_matrix(registry.apply(rows), ["direction", "method"], ["pair"], registry.names())
    return out.select(*[r6(c) if t == "double" else c for c, t in out.dtypes])


@register(
    "global_ordinal",
    "E08",
    f"""WITH {_RANKED} SELECT shard, CAST(min(ordinal) AS BIGINT) AS first_ordinal, CAST(max(ordinal) AS BIGINT) AS last_ordinal,
      CAST(sum(ordinal * (pair % 7 + 1)) AS BIGINT) AS checksum FROM ranked GROUP BY 1""",
)
def global_ordinal(spark, d):
    rows = S.global_ordinal(objs(spark, d), OBJ_ORDER)
    return rows.groupBy("shard").agg(
        F.min("ordinal").alias("first_ordinal"),
        F.max("ordinal").alias("last_ordinal"),
        F.sum(F.col("ordinal") * (F.col("pair") % 7 + 1)).alias("checksum"),
    )


@register(
    "deinterleave",
    "E09",
    "SELECT o_orderkey, (o_orderkey // 4) * 4 + o_orderkey % 4 AS global_index, o_orderkey AS same FROM orders",
)
def deinterleave(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 4).alias("rank"), F.floor(F.col("o_orderkey") / 4).alias("index")
    )
    return S.deinterleave(rows, 4).select("o_orderkey", "global_index", restored_index("index", "rank", 4).alias("same"))


@register(
    "one_object_audit",
    "L08 D02",
    f"""WITH {OBJS_SQL}, one AS (SELECT iou, dice FROM (SELECT *, row_number() OVER (PARTITION BY shard, pair ORDER BY {_ORDER}) AS rn FROM objs) WHERE rn = 1)
    SELECT 0::BIGINT AS findings, count(*) FILTER (rn = 1) // greatest(count(*), 1) AS seeded, count(*) AS pairs, round(avg(iou), 6) AS iou FROM (SELECT *, 1 AS rn FROM one)""",
)
def one_object_audit(spark, d):
    first = objs(spark, d).groupBy(*PAIR).agg(F.min_by(F.struct("iou", "dice"), F.struct(*OBJ_ORDER)).alias("o")).select(*PAIR, "o.*")
    lattice = published(S.metric_lattice(first, PAIR, PAIR))  # one row, read three times
    count = lambda df: A.audit_one_object(df).agg(F.count(F.lit(1))).scalar()
    off = lattice.withColumn("stock_iou", F.col("stock_iou") + 1e-9)  # more than the audit tolerates
    return lattice.select(count(lattice).alias("findings"), count(off).alias("seeded"), F.col("n_pairs").alias("pairs"), r6("perobject_iou", "iou"))


_BOOT = """w AS (SELECT p.pair, p.diff, r.rep, CAST('0x' || substr(md5(p.pair || '|' || r.rep || '|7'), 1, 12) AS BIGINT) AS h
      FROM pd p CROSS JOIN (SELECT unnest(range(210)) AS rep) r)"""
_POISSON = "".join(
    f" WHEN h < {int(p * 2**48)} THEN {k}" for k, p in enumerate(POISSON_ONE)
)


_ROWWISE_SQL = f"""WITH {OBJS_SQL}, pd AS (SELECT pair, avg(iou) - avg(dice) AS diff FROM objs GROUP BY 1), {_BOOT},
      ww AS (SELECT *, CASE{_POISSON} ELSE 10 END AS k FROM w),
      reps AS (SELECT rep, sum(diff * k) / sum(k) AS m FROM ww GROUP BY 1)
    SELECT (SELECT count(*) FROM pd) AS pairs, round((SELECT avg(diff) FROM pd), 6) AS mean_diff,
      round((SELECT quantile_cont(m, 0.025) FROM reps), 6) AS ci_low, round((SELECT quantile_cont(m, 0.975) FROM reps), 6) AS ci_high"""


@register(
    "rowwise_bootstrap",
    "D28",
    _ROWWISE_SQL,

)
def rowwise_bootstrap(spark, d):
    pairs = objs(spark, d).groupBy("pair").agg(F.avg("iou").alias("a"), F.avg("dice").alias("b"))
    out = S.rowwise_bootstrap(pairs, "a", "b", ["pair"], reps=210, seed=7, portable=True)
    return out.select("pairs", r6("mean_diff"), r6("ci_low"), r6("ci_high"))


def _draw_sql(*parts: str) -> str:
    text = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"((('0x' || substr(md5({text} || '|7'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)"


@register("paired_bootstrap", "D28", _ROWWISE_SQL)
def paired_bootstrap(spark, d):
    """Every pair is resampled; :func:`histogram_bootstrap` resamples bins."""
    return rowwise_bootstrap(spark, d)


@register(
    "histogram_bootstrap",
    "D28",
    f"""WITH {OBJS_SQL}, pd AS (SELECT round(avg(iou) - avg(dice), 9) AS d FROM objs GROUP BY pair), e AS (SELECT min(d) AS lo, max(d) AS hi FROM pd),
      h AS (SELECT least(511, floor((d - lo) / (hi - lo) * 512))::BIGINT AS bin, count(*) AS c, avg(d) AS m, var_pop(d) AS s2 FROM pd, e GROUP BY 1),
      l AS (SELECT DISTINCT c, greatest(0, floor(c - (9 * sqrt(c) + 12)))::BIGINT AS lo, ceil(c + (9 * sqrt(c) + 12))::BIGINT AS hi FROM h),
      t AS (SELECT c, lo, k, sum(p) OVER (PARTITION BY c ORDER BY k) / sum(p) OVER (PARTITION BY c) AS cdf
        FROM (SELECT c, lo, k, exp(k * ln(c) - c - lgamma(k + 1)) AS p FROM (SELECT *, unnest(range(lo, hi + 1)) AS k FROM l))),
      u AS (SELECT bin, c, m, s2, rep, {_draw_sql("bin", "rep")} AS u FROM h, (SELECT unnest(range(210)) AS rep)),
      w AS (SELECT bin, rep, any_value(m) AS m, any_value(s2) AS s2, any_value(lo) + count(*) FILTER (cdf <= u) AS k FROM u JOIN t USING (c) GROUP BY 1, 2),
      r AS (SELECT (sum(k * m) + sqrt(sum(k * s2)) * sqrt(-2 * ln({_draw_sql("'u'", "rep")})) * cos(2 * pi() * {_draw_sql("'v'", "rep")})) / sum(k) AS x FROM w GROUP BY rep)
    SELECT (SELECT count(*) FROM pd) AS pairs, round((SELECT avg(d) FROM pd), 6) AS mean_diff,
      round((SELECT quantile_cont(x, 0.025) FROM r), 6) AS ci_low, round((SELECT quantile_cont(x, 0.975) FROM r), 6) AS ci_high""",
)
def histogram_bootstrap(spark, d):
    pairs = objs(spark, d).groupBy("pair").agg(F.round(F.avg("iou") - F.avg("dice"), 9).alias("a"), F.lit(0.0).alias("b"))
    out = S.paired_bootstrap(pairs, "a", "b", reps=210, seed=7, portable=True)
    return out.select("pairs", r6("mean_diff"), r6("ci_low"), r6("ci_high"))


@register(
    "metric_delta",
    "C13",
    f"""WITH {OBJS_SQL}, a AS (SELECT l_returnflag AS k, avg(iou) AS iou FROM objs GROUP BY 1),
      b AS (SELECT l_returnflag AS k, avg(iou) AS iou FROM objs WHERE l_linestatus = 'F' GROUP BY 1)
    SELECT a.k AS l_returnflag, round(a.iou, 6) AS iou, round(b.iou, 6) AS ref_iou, round(a.iou - b.iou, 6) AS delta_iou FROM a JOIN b USING (k)""",
)
def metric_delta(spark, d):
    rows = objs(spark, d)
    mean = lambda df: df.groupBy("l_returnflag").agg(F.avg("iou").alias("iou"))
    out = S.metric_delta(mean(rows), mean(rows.filter(F.col("l_linestatus") == "F")), ["l_returnflag"], ["iou"])
    return out.select("l_returnflag", r6("iou"), r6("ref_iou"), r6("delta_iou"))


@register(
    "score_join",
    "C15",
    """WITH p AS (SELECT doc_id // 3 AS k, count(*) AS n FROM documents GROUP BY 1), g AS (SELECT doc_id // 2 AS k, count(*) AS n FROM labels GROUP BY 1)
    SELECT CASE WHEN p.n IS NULL THEN 'missing' WHEN g.n IS NULL THEN 'extra' WHEN p.n > 1 OR g.n > 1 THEN 'duplicated' ELSE 'matched' END AS status,
      count(*) AS keys, CAST(sum(coalesce(p.n, 0)) AS BIGINT) AS predictions, CAST(sum(coalesce(g.n, 0)) AS BIGINT) AS targets
    FROM p FULL OUTER JOIN g ON p.k = g.k GROUP BY 1""",
)
def score_join(spark, d):
    pred = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 3).alias("k"))
    gt = table(spark, d, "labels").select(F.floor(F.col("doc_id") / 2).alias("k"))
    return S.score_join(pred, gt, ["k"]).groupBy("status").agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum(F.coalesce("n_pred", F.lit(0))).alias("predictions"),
        F.sum(F.coalesce("n_gt", F.lit(0))).alias("targets"),
    )


# --- experts ------------------------------------------------------------------------------------


@register("select_expert", "F03", f"WITH {EVID_SQL} SELECT object_id, selected, reason, CAST(valid_experts AS BIGINT) AS valid_experts FROM decided")
def select_expert(spark, d):
    return X.select_expert(evidence(spark, d), ["object_id"])


@register(
    "fusion_first",
    "F04",
    f"""WITH {EVID_SQL}, q AS (SELECT object_id, inside_count >= 4 AS ok FROM evid WHERE expert = 'C'),
      rest AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY inside_count DESC, cycle_distance, expert) AS k FROM evid WHERE valid AND expert <> 'C')
    SELECT q.object_id, CASE WHEN q.ok THEN 'C' ELSE coalesce(r.expert, 'B') END AS selected,
      CASE WHEN q.ok THEN 'fusion_quality' WHEN r.expert IS NULL THEN 'fallback_no_cycle' ELSE 'cycle' END AS reason
    FROM q LEFT JOIN (SELECT * FROM rest WHERE k = 1) r USING (object_id)""",
)
def fusion_first(spark, d):
    return X.fusion_first(evidence(spark, d), F.col("inside_count") >= 4, ["object_id"])


@register(
    "selection_distribution",
    "D24 L13",
    f"""WITH {EVID_SQL} SELECT setting, count(*) AS objects, count(*) FILTER (reason = 'cycle') AS cycle_uses,
      count(*) FILTER (selected = 'A') AS "n_A", count(*) FILTER (selected = 'B') AS "n_B", count(*) FILTER (selected = 'C') AS "n_C",
      (count(*) FILTER (selected = 'A') % 2)::BIGINT AS unbalanced FROM decided GROUP BY 1""",
)
def selection_distribution(spark, d):
    dist = X.selection_distribution(X.select_expert(evidence(spark, d), ["object_id", "setting"]), ["setting"])
    # settings with an odd number of A get one object too many
    tampered = dist.withColumn("objects", F.col("objects") + F.col("n_A") % 2)
    off = X.audit_selection_totals(tampered).select("setting", F.lit(1).alias("_off"))
    return dist.join(off, "setting", "left").withColumn("unbalanced", big(F.coalesce("_off", F.lit(0)), "unbalanced")).drop("_off")


@register(
    "expert_means",
    "D24",
    f"""WITH {EVID_SQL} SELECT expert, round(avg(inside_count / 7.0::DOUBLE), 6) AS mean_iou, count(*) AS objects FROM evid GROUP BY 1""",
)
def expert_means(spark, d):
    out = X.expert_means(evidence(spark, d).withColumn("iou", F.col("inside_count") / F.lit(7.0)))
    return out.select("expert", r6("mean_iou"), "objects")


@register(
    "audit_selected",
    "L07",
    f"""WITH {EVID_SQL}, c AS (SELECT d.object_id, d.selected, CASE WHEN d.object_id % 13 = 0 THEN 'stale' ELSE e.mask_sha END AS mask_sha, e.mask_sha AS candidate_sha
      FROM decided d JOIN evid e ON e.object_id = d.object_id AND e.expert = d.selected)
    SELECT * FROM c WHERE mask_sha <> candidate_sha""",
)
def audit_selected(spark, d):
    ev = evidence(spark, d)
    chosen = X.select_expert(ev, ["object_id"], carry=["mask_sha"])
    stored = chosen.withColumn("mask_sha", F.when(F.col("object_id") % 13 == 0, "stale").otherwise(F.col("mask_sha")))
    return X.audit_selected(stored, ev, ["object_id"])


@register(
    "gt_isolation",
    "L06",
    f"""WITH {EVID_SQL}, m AS (SELECT object_id, min(md5(mask_sha)) AS real, min(md5(mask_sha || 'x')) AS drawn FROM evid GROUP BY 1)
    SELECT 'column:target_mask' AS finding, 'clean' AS selector, 1::BIGINT AS n WHERE (SELECT count(*) FROM evid) > 0
    UNION ALL SELECT 'column:target_mask', 'leaky', 1 WHERE (SELECT count(*) FROM evid) > 0
    UNION ALL SELECT 'variant 1: decision changed', 'leaky', 2 * count(*) FROM m WHERE real <> '0'
    UNION ALL SELECT 'variant 2: decision changed', 'leaky', 2 * count(*) FROM m WHERE real <> drawn""",
)
def gt_isolation(spark, d):
    ev = evidence(spark, d)
    leaky = ev.withColumn("target_mask", F.md5("mask_sha"))
    drawn = ev.withColumn("target_mask", F.md5(F.concat("mask_sha", F.lit("x"))))
    variants = [leaky, ev.withColumn("target_mask", F.lit("0")), drawn]
    clean = lambda e: X.select_expert(e, ["object_id"])
    peeking = lambda e: e.groupBy("object_id").agg(F.min("target_mask").alias("selected"))
    # without ground truth only a clean selector can run at all
    rows = [("clean", clean, [*variants, ev]), ("leaky", peeking, variants)]
    found = [X.audit_gt_isolation(leaky, f, ["target_mask", "target_area"], v).withColumn("selector", F.lit(n)) for n, f, v in rows]
    return found[0].union(found[1]).groupBy("finding", "selector").agg(F.count(F.lit(1)).alias("n"))


@register(
    "alias_experts",
    "B18",
    f"""WITH {EVID_SQL} SELECT object_id, CASE expert WHEN 'A' THEN 'visual' WHEN 'B' THEN 'anchor' ELSE 'C' END AS expert, inside_count AS sparse FROM evid""",
)
def alias_experts(spark, d):
    ev = evidence(spark, d).select("object_id", "expert", F.col("inside_count").alias("anchor"))
    named = ev.withColumn("expert", S.alias_values("expert", {"A": "visual", "B": "anchor"}))
    return S.alias_experts(named, {"anchor": "sparse"})


@register(
    "normalise_target",
    "B17",
    """SELECT o_orderpriority, count(*) AS rows, count(*) FILTER (o_orderkey % 3 <> 0) AS changed FROM orders GROUP BY 1""",
)
def normalise_target(spark, d):
    own = F.concat(F.lit("img/"), F.col("o_orderkey").cast("string"))
    listed = F.when(F.col("o_orderkey") % 3 == 0, F.array(own)).otherwise(F.array(own, F.lit("img/other")))
    rows = table(spark, d, "orders").select("o_orderpriority", listed.alias("video_path"), own.alias("target_image"))
    out = S.normalise_target(rows)
    return out.groupBy("o_orderpriority").agg(F.count_if(F.size("video_path") == 1).alias("rows"), F.count_if("changed").alias("changed"))


# --- runs ---------------------------------------------------------------------------------------------

_RUNS_SQL = f"""{OBJS_SQL}, runs AS (SELECT l_suppkey AS run, l_suppkey % 4 AS label_no,
      CASE l_suppkey % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'superseded' WHEN 2 THEN 'smoke' ELSE 'valid' END AS label,
      CAST(round(avg(iou) * 1000) AS BIGINT) AS iou, CAST(round(avg(l_quantity) * 10) AS BIGINT) AS loc
    FROM objs GROUP BY 1)"""


def _steps(mean, digits):
    """Number of steps of 10**-digits, ties upwards; times 1000 first, 0.5025 would give 502.49999999999994."""
    return F.round(F.round(mean, digits) * 10**digits).cast("bigint")


def _runs(spark, d):
    label = F.when(F.col("run") % 4 == 1, "superseded").when(F.col("run") % 4 == 2, "smoke").otherwise("valid")
    rows = objs(spark, d).groupBy(F.col("l_suppkey").alias("run")).agg(
        _steps(exact_mean("iou"), 3).alias("iou"), _steps(exact_mean("l_quantity"), 1).alias("loc")
    )
    return rows.withColumns({"label": label, "label_no": F.col("run") % 4})


@register(
    "select_checkpoint",
    "F05",
    f"""WITH {_RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY iou DESC, loc DESC, run) AS k FROM runs)
    SELECT label, run, iou, loc FROM r WHERE k = 1""",
)
def select_checkpoint(spark, d):
    return S.select_checkpoint(_runs(spark, d), "run", ["iou", "loc"], ["label"])


_SCORES_SQL = f"""{_RUNS_SQL}, scores AS (SELECT label, run, CASE WHEN run % 7 <> 3 THEN iou END AS iou, loc, iou * 7 % 50 AS dice, loc * 3 % 20 AS cont FROM runs)"""


def _scores(spark, d):
    """Runs with four metrics, some of them missing."""
    iou, loc = F.col("iou"), F.col("loc")
    return _runs(spark, d).select("label", "run", F.when(F.col("run") % 7 != 3, iou).alias("iou"), "loc", (iou * 7 % 50).alias("dice"), (loc * 3 % 20).alias("cont"))


@register(
    "pareto_front",
    "F06",
    f"""WITH {_RUNS_SQL} SELECT label, run, iou, loc, NOT EXISTS (SELECT 1 FROM runs b WHERE b.label = a.label AND b.iou >= a.iou AND b.loc <= a.loc
      AND (b.iou > a.iou OR b.loc < a.loc)) AS on_front FROM runs a""",
)
def pareto_front(spark, d):
    return S.pareto(_runs(spark, d), "run", {"iou": True, "loc": False}, group=["label"])


@register(
    "pareto_front_many",
    "F06",
    f"""WITH {_SCORES_SQL} SELECT label, run, iou, dice, cont, loc, CASE WHEN iou IS NOT NULL THEN NOT EXISTS (SELECT 1 FROM scores b WHERE b.label = a.label AND b.iou >= a.iou
      AND b.dice >= a.dice AND b.cont >= a.cont AND b.loc <= a.loc AND (b.iou > a.iou OR b.dice > a.dice OR b.cont > a.cont OR b.loc < a.loc)) END AS on_front FROM scores a""",
)
def pareto_front_many(spark, d):
    return S.pareto(_scores(spark, d), "run", {"iou": True, "dice": True, "cont": True, "loc": False}, group=["label"])


@register(
    "result_ledger",
    "D35",
    f"""WITH {_RUNS_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY iou DESC, loc DESC, run) AS k FROM runs)
    SELECT label, count(*) AS runs, max(iou) FILTER (label = 'valid') AS best_iou,
      max(loc) FILTER (label = 'valid' AND k = 1) AS best_loc, max(run) FILTER (label = 'valid' AND k = 1) AS best_run FROM v GROUP BY 1""",
)
def result_ledger(spark, d):
    return S.ledger(_runs(spark, d), "label", "run", ["iou", "loc"])


@register(
    "best_candidate",
    "F07 B13",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity / 100 AS share, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS k FROM lineitem WHERE l_quantity / 100 BETWEEN 0.1 AND 0.4)
    SELECT l_orderkey, l_partkey, l_extendedprice FROM c WHERE k = 1""",
)
def best_candidate(spark, d):
    rows = table(spark, d, "lineitem").withColumn("share", F.col("l_quantity") / 100)
    return S.best_candidate(rows, ["l_orderkey"], "l_partkey", "l_extendedprice", "l_partkey", "share", 0.1, 0.4)


@register(
    "top_instance",
    "F08",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM
      (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1""",
)
def top_instance(spark, d):
    return S.top_instance(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")


@register(
    "smallest_candidate",
    "F09",
    """SELECT p_brand, p_partkey, p_size, matched FROM (SELECT p_brand, p_partkey, CAST(p_size AS BIGINT) AS p_size, p_name LIKE '%ring%' AS matched,
      row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_name LIKE '%ring%' THEN 0 ELSE 1 END, p_size, p_partkey) AS k FROM part) WHERE k = 1""",
)
def smallest_candidate(spark, d):
    rows = table(spark, d, "part").select("p_brand", "p_partkey", big("p_size"), F.col("p_name").contains("ring").alias("matched"))
    return S.smallest_candidate(rows, ["p_brand"], "p_partkey", "p_size", "matched")


@register(
    "dedup_padding",
    "G03",
    """WITH k AS (SELECT l_orderkey, l_linenumber, count(DISTINCT (l_partkey, l_quantity)) > 1 AS differ FROM lineitem GROUP BY 1, 2)
    SELECT (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM lineitem WHERE l_orderkey % 9 = 0) + (SELECT count(*) FROM lineitem WHERE l_orderkey % 50 = 1) AS rows, count(*) AS records,
      count(*) FILTER (differ OR l_orderkey % 50 = 1) AS conflicts, (count(*) <> (SELECT count(*) FROM lineitem))::BIGINT AS wrong_total FROM k""",
)
def dedup_padding(spark, d):
    keys = ["l_orderkey", "l_linenumber"]
    rows = table(spark, d, "lineitem").select(*keys, "l_partkey", "l_quantity")
    # padding: some rows again, and some again with another value
    wrong = rows.filter("l_orderkey % 50 = 1").withColumn("l_quantity", F.col("l_quantity") + 1)
    padded = rows.union(rows.filter("l_orderkey % 9 = 0")).union(wrong)
    kept = S.dedup_padding(padded, keys).agg(F.count(F.lit(1))).scalar()
    found = S.padding_conflicts(padded, keys, rows.agg(F.count(F.lit(1))).scalar())
    number = lambda check: found.filter(F.col("check") == check).agg(F.count(F.lit(1))).scalar()
    out = padded.agg(F.count(F.lit(1)).alias("rows")).withColumn("records", kept)
    return out.withColumns({"conflicts": number("conflicting_copies"), "wrong_total": number("kept_rows")})
