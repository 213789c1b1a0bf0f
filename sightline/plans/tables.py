"""Adapters: the driver tables seen as objects, view pixels, masks, maps, takes and verdicts.

Every adapter has an SQL twin (``*_SQL``, a WITH body) used by the oracles.  Steps of a card are
fixed slots of a 30-day cycle and pixels are summed per slot first, so a card is bounded
by slots x cameras whatever its share of the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import masks as M
from sightline.operators.quality import view_stats

VIEWS = ("exo0", "exo1", "exo2", "head", "head_gaze")
PERIOD_HOURS = 720
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scored objects ------------------------------------------------------------------------

PAIR = ["shard", "pair"]
OBJ_KEYS = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]
OBJ_ORDER = PAIR + OBJ_KEYS

OBJS_SQL = """objs AS (
  SELECT l_orderkey % 8 AS shard, l_orderkey AS pair, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         l_shipdate, l_quantity, l_returnflag, l_linestatus,
         least(1.0::DOUBLE, l_discount * 10) AS iou,
         2 * least(1.0::DOUBLE, l_discount * 10) / (1 + least(1.0::DOUBLE, l_discount * 10)) AS dice
  FROM lineitem)"""


def objs(spark: SparkSession, sf_dir: str) -> DataFrame:
    iou = F.least(F.lit(1.0), F.col("l_discount") * 10)
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 8).alias("shard"),
        F.col("l_orderkey").alias("pair"),
        *OBJ_KEYS,
        "l_returnflag",
        "l_linestatus",
        iou.alias("iou"),
        (2 * iou / (1 + iou)).alias("dice"),
    )


# --- view pixels ------------------------------------------------------------------------------

_VIEW_SQL = """CASE event_type WHEN 'click' THEN 'head_gaze' WHEN 'view' THEN 'head' WHEN 'error' THEN 'exo0'
              WHEN 'signup' THEN 'exo1' ELSE 'exo2' END"""


def viewpx_sql(hours: int = 72) -> str:
    """viewpx(card, view, t, px), lens(card, view, t_view), grid(card, view, t, px)."""
    return f"""viewpx AS (
  SELECT user_id AS card, {_VIEW_SQL} AS view,
         (date_sub('hour', TIMESTAMP '2024-01-01', ts) // {hours}) % {PERIOD_HOURS // hours} AS t,
         CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS px
  FROM events GROUP BY 1, 2, 3),
grid AS (
  SELECT c.card, c.view, g.t, CAST(coalesce(p.px, 0) AS BIGINT) AS px
  FROM (SELECT DISTINCT card, view FROM viewpx) c
  CROSS JOIN (SELECT unnest(range({PERIOD_HOURS // hours})) AS t) g
  LEFT JOIN viewpx p ON p.card = c.card AND p.view = c.view AND p.t = g.t)"""


VMETA_SQL = (
    viewpx_sql()
    + """,
vmeta AS (
  SELECT card, view, avg(CASE WHEN px > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS visible_frac,
         CAST(trunc(median(px)) AS BIGINT) AS median_px, count(*) AS n_frames
  FROM grid GROUP BY 1, 2)"""
)


def _view(df: DataFrame) -> DataFrame:
    e = F.col("event_type")
    view = F.when(e == "click", "head_gaze").when(e == "view", "head").when(e == "error", "exo0").when(e == "signup", "exo1").otherwise("exo2")
    return df.withColumn("view", view)


def slot(hours: int):
    start = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    return F.floor(F.timestamp_diff("HOUR", start, F.col("ts").cast("timestamp_ntz")) / hours) % (PERIOD_HOURS // hours)


def view_pixels(spark: SparkSession, sf_dir: str, hours: int = 72) -> DataFrame:
    ev = _view(table(spark, sf_dir, "events"))
    px = F.sum(F.floor(F.col("value") * 100))
    return ev.groupBy(F.col("user_id").alias("card"), "view", slot(hours).alias("t")).agg(px.cast("bigint").alias("px"))


def view_grid(spark: SparkSession, sf_dir: str, hours: int = 72) -> DataFrame:
    """Zero-filled (card, view, t, px); a (card, view) row holds at most one entry per slot."""
    slots = PERIOD_HOURS // hours
    by_view = view_pixels(spark, sf_dir, hours).groupBy("card", "view").agg(
        F.map_from_entries(F.collect_list(F.struct("t", "px"))).alias("_m")
    )
    rows = by_view.select("card", "view", "_m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint"))).alias("t"))
    return rows.select("card", "view", "t", F.coalesce(F.try_element_at("_m", F.col("t")), F.lit(0).cast("bigint")).alias("px"))


def view_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_stats(view_grid(spark, sf_dir))


# --- id pixels ----------------------------------------------------------------------------------

IDPX_SQL = f"""idpx AS (
  SELECT user_id AS demo, {_VIEW_SQL} AS view, (date_sub('hour', TIMESTAMP '2024-01-01', ts) // 72) % {PERIOD_HOURS // 72} AS t,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 16 AS id,
         CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS px
  FROM events GROUP BY 1, 2, 3, 4),
idmap AS (
  SELECT i.demo, i.view, i.id, replace(p.p_name, ' ', '_') || '_' || (i.id % 4) AS label
  FROM (SELECT DISTINCT demo, view, id FROM idpx) i, (SELECT min(p_partkey) AS lo, max(p_partkey) - min(p_partkey) + 1 AS n FROM part) k
  JOIN part p ON p.p_partkey = k.lo + (i.demo * 16 + i.id) % k.n)"""


def id_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _view(table(spark, sf_dir, "events"))
    k = F.get_json_object("props", "$.k").cast("bigint") % 16
    return ev.groupBy(F.col("user_id").alias("demo"), "view", slot(72).alias("t"), k.alias("id")).agg(
        F.sum(F.floor(F.col("value") * 100)).cast("bigint").alias("px")
    )


def id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every demo names its ids after parts of its own, so that all parts occur
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    low, n = part.agg(F.min("p_partkey")).scalar(), part.agg(F.max("p_partkey") - F.min("p_partkey") + 1).scalar()
    ids = id_pixels(spark, sf_dir).select("demo", "view", "id").distinct()
    ids = ids.withColumn("p_partkey", low + (F.col("demo") * 16 + F.col("id")) % n)
    label = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), (F.col("id") % 4).cast("string"))
    return ids.join(part, "p_partkey").select("demo", "view", "id", label.alias("label"))


# --- masks -----------------------------------------------------------------------------------------

MASK_SQL = """px AS (SELECT vec_id AS mask_id, label, unnest(range(64)) AS pos, unnest(embedding) > 0 AS on_ FROM embeddings),
fg AS (SELECT mask_id, label, pos FROM px WHERE on_),
heads AS (SELECT mask_id, any_value(label) AS label, CAST(count(*) FILTER (on_) AS BIGINT) AS area FROM px GROUP BY 1),
runs AS (
  SELECT mask_id, min(pos) AS s, max(pos) + 1 AS e
  FROM (SELECT mask_id, pos, pos - row_number() OVER (PARTITION BY mask_id ORDER BY pos) AS isl FROM fg)
  GROUP BY mask_id, isl),
pairs AS (SELECT a.mask_id AS pair_id, a.mask_id AS a_id, b.mask_id AS b_id, a.label, a.area AS area_a, b.area AS area_b
          FROM heads a JOIN heads b ON b.mask_id = a.mask_id + 1),
ov AS (SELECT p.*, CAST((SELECT count(*) FROM fg x JOIN fg y ON x.pos = y.pos WHERE x.mask_id = p.a_id AND y.mask_id = p.b_id) AS BIGINT) AS inter
       FROM pairs p)"""


def mask_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("mask_id"),
        F.col("label").cast("bigint").alias("label"),
        F.lit(SIDE).alias("h"),
        F.lit(SIDE).alias("w"),
        F.transform("embedding", lambda x: x > 0).alias("bits"),
    )


def mask_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(headers, runs); headers also carry the label."""
    bits = mask_bits(spark, sf_dir)
    area = F.size(F.filter("bits", lambda x: x)).cast("bigint")
    return bits.select("mask_id", "label", "h", "w", area.alias("area")), M.masks_from_bits(bits)


def mask_pairs(headers: DataFrame) -> DataFrame:
    """Prediction = mask, target = the next mask."""
    nxt = headers.select((F.col("mask_id") - 1).alias("a_id"), F.col("mask_id").alias("b_id"))
    return headers.select(F.col("mask_id").alias("a_id"), "label").join(nxt, "a_id").withColumn("pair_id", F.col("a_id"))


# --- maps, pairs, verdicts ----------------------------------------------------------------------------

MMAP_SQL = """mmap AS (SELECT doc_id AS video_id, CASE WHEN quality = 1 THEN 'npz/' || doc_id END AS npz, toxic FROM labels)"""

PAIRS2_SQL = (
    MMAP_SQL
    + """,
views2 AS (SELECT d.doc_id, d.doc_id // 2 AS base, CAST(d.doc_id % 2 + 1 AS VARCHAR) AS view, m.npz AS value
           FROM documents d LEFT JOIN mmap m ON m.video_id = d.doc_id),
pairs2 AS (SELECT base, max(value) FILTER (view = '1') AS value_1, max(value) FILTER (view = '2') AS value_2
           FROM views2 GROUP BY base
           HAVING count(*) FILTER (view = '1') > 0 AND count(*) FILTER (view = '2') > 0)"""
)


def mask_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("quality") == 1, F.concat(F.lit("npz/"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("video_id"), value.alias("npz"), "toxic")


def doc_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"))
    rows = docs.join(mask_map(spark, sf_dir).select("video_id", "npz"), "video_id", "left")
    return rows.select(
        F.col("video_id").alias("doc_id"),
        F.floor(F.col("video_id") / 2).alias("base"),
        (F.col("video_id") % 2 + 1).cast("string").alias("view"),
        F.col("npz").alias("value"),
    )


VERD_SQL = """cards AS (SELECT doc_id AS card, source, lang,
                 list_sort(list_distinct([n_chars % 8, (n_chars + 3) % 8, (n_chars + 5) % 8])) AS idxs, n_chars % 11 <> 0 AS usable
          FROM documents),
verd AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'drop' ELSE 'keep' END AS verdict,
                CASE WHEN quality = 1 THEN [doc_id % 8] ELSE [] END AS keep_frames,
                [(doc_id + 3) % 8] AS drop_frames, [(doc_id + 1) % 8] AS add_frames FROM labels)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("card"),
        "source",
        "lang",
        F.array_sort(F.array_distinct(F.array(n % 8, (n + 3) % 8, (n + 5) % 8))).alias("idxs"),
        (n % 11 != 0).alias("usable"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    none = F.array().cast("array<bigint>")
    return table(spark, sf_dir, "labels").select(
        d.cast("string").alias("id"),
        F.when(F.col("toxic") == 1, "drop").otherwise("keep").alias("card"),
        F.when(F.col("quality") == 1, F.array(d % 8)).otherwise(none).alias("keep_frames"),
        F.array((d + 3) % 8).alias("drop_frames"),
        F.array((d + 1) % 8).alias("add_frames"),
    )


# --- takes, evidence, log lines, geography ------------------------------------------------------------

PRIORITY_VIEWS = {"1-URGENT": "cam0", "2-HIGH": "cam1", "3-MEDIUM": "cam2", "4-NOT SPECIFIED": "cam3", "5-LOW": "cam4"}
TAKE_VIEWS = tuple(PRIORITY_VIEWS.values())
TAKES_SQL = """takes AS (SELECT o_custkey AS take, 'cam' || (CAST(substr(o_orderpriority, 1, 1) AS INT) - 1) AS cam, * FROM orders)"""


def takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cam = F.concat(F.lit("cam"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("string"))
    return table(spark, sf_dir, "orders").withColumns({"take": F.col("o_custkey"), "cam": cam})


EVID_SQL = """evid AS (
  SELECT c_custkey AS object_id, c_mktsegment AS setting, e.expert, (c_custkey * e.k) % 7 AS inside_count,
         ((c_custkey * e.k) % 97) / 10.0::DOUBLE AS cycle_distance, (c_custkey + e.k) % 5 <> 0 AND (c_custkey * e.k) % 7 > 2 AS valid,
         md5(c_custkey || '|' || e.expert) AS mask_sha
  FROM customer CROSS JOIN (VALUES ('A', 1), ('B', 2), ('C', 3)) e(expert, k)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY inside_count DESC, cycle_distance, expert) AS rk FROM evid WHERE valid),
decided AS (
  SELECT o.object_id, o.setting, coalesce(r.expert, 'C') AS selected,
         CASE WHEN r.expert IS NULL THEN 'fallback_no_cycle' ELSE 'cycle' END AS reason,
         coalesce(v.n, 0) AS valid_experts
  FROM (SELECT DISTINCT object_id, setting FROM evid) o
  LEFT JOIN (SELECT * FROM ranked WHERE rk = 1) r ON r.object_id = o.object_id
  LEFT JOIN (SELECT object_id, count(*) AS n FROM evid WHERE valid GROUP BY 1) v ON v.object_id = o.object_id)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    experts = F.inline(F.array(*[F.struct(F.lit(e).alias("expert"), F.lit(k).alias("k")) for k, e in enumerate("ABC", 1)]))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", experts)
    n = F.col("c_custkey") * F.col("k")
    return rows.select(
        F.col("c_custkey").alias("object_id"),
        F.col("c_mktsegment").alias("setting"),
        "expert",
        (n % 7).alias("inside_count"),
        ((n % 97) / F.lit(10.0)).alias("cycle_distance"),
        (((F.col("c_custkey") + F.col("k")) % 5 != 0) & (n % 7 > 2)).alias("valid"),
        F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit("|"), F.col("expert"))).alias("mask_sha"),
    )


LOG_SQL = """loglines AS (
  SELECT event_id, ts, CASE WHEN event_id % 50 = 7 THEN 'Traceback (most recent call last) value=' || CAST(floor(value) AS BIGINT)
              WHEN event_id % 50 = 8 THEN 'Mean IoU reached value=' || CAST(floor(value) AS BIGINT)
              WHEN event_id % 50 = 9 THEN 'Iter(val) step' ELSE
              'PROD ' || user_id || ' ' || event_type || ' value=' || CAST(floor(value) AS BIGINT) END AS line, user_id, event_type, value
  FROM events),
parsed AS (
  SELECT *, CASE WHEN regexp_matches(line, 'Traceback|Error:|Exception:') THEN 'error'
                 WHEN regexp_matches(line, '^PROD (\\S+) (\\S+)') THEN 'status'
                 WHEN regexp_matches(line, 'Mean IoU|Mean Dice|Mean Location Score|Mean Shape Accuracy') THEN 'metric'
                 WHEN regexp_matches(line, 'Iter\\((train|val|test)\\)') THEN 'progress' ELSE 'other' END AS kind,
         nullif(regexp_extract(line, '^PROD (\\S+) (\\S+)', 1), '') AS subject,
         nullif(regexp_extract(line, '^PROD (\\S+) (\\S+)', 2), '') AS status,
         TRY_CAST(nullif(regexp_extract(line, '(\\w+)=([-+0-9.eE]+)\\s*$', 2), '') AS DOUBLE) AS number
  FROM loglines)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    e, tail = F.col("event_id") % 50, F.floor("value").cast("string")
    line = (
        F.when(e == 7, F.concat(F.lit("Traceback (most recent call last) value="), tail))
        .when(e == 8, F.concat(F.lit("Mean IoU reached value="), tail))
        .when(e == 9, F.lit("Iter(val) step"))
        .otherwise(F.concat(F.lit("PROD "), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"), F.lit(" value="), tail))
    )
    # the lines of a user are one log file
    return ev.select("event_id", "ts", line.alias("line"), F.concat(F.lit("job"), F.col("user_id").cast("string"), F.lit(".log")).alias("file"))
