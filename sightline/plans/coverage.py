"""Names, ids, annotation maps and view pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import columns as C
from sightline.operators import pairing as P
from sightline.operators import quality as Q
from sightline.operators.selection import value_runs
from sightline.plans.registry import big, joined, r6, register
from sightline.plans.tables import MMAP_SQL, PAIRS2_SQL, TAKE_VIEWS, TAKES_SQL, doc_views, mask_map, table, takes

_ROLE_NAMES = ("Wrist_cam", "front_view", "eye_in_hand", "global", "primary", "external")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# --- names and ids ---------------------------------------------------------------------------


@register(
    "camera_role",
    "B01",
    f"""SELECT p_partkey, {_sql_list(_ROLE_NAMES)}[p_partkey % 6 + 1] || '_' || p_size AS cam,
      CASE p_partkey % 6 WHEN 0 THEN 'WRIST' WHEN 2 THEN 'WRIST' WHEN 1 THEN 'DERIVED' WHEN 4 THEN 'DERIVED' ELSE 'EXO' END AS role FROM part""",
)
def camera_role(spark, d):
    cam = F.concat(_pick(_ROLE_NAMES, F.col("p_partkey") % 6), F.lit("_"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", cam.alias("cam")).withColumn("role", C.camera_role("cam"))


_EMB = ("h5_franka_1rgb", "h5_agilex_3rgb", "misc", "misc")


@register(
    "infer_embodiment",
    "B02 B03 B04",
    """SELECT p_partkey, e AS embodiment, e IN ('h5_franka_3rgb', 'h5_franka_1rgb', 'h5_ur_1rgb', 'h5_franka_fr3_dual') AS bgr, first_rank, ordered FROM (
      SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'h5_franka_1rgb' WHEN 1 THEN 'h5_agilex_3rgb'
        ELSE CASE p_size % 3 WHEN 0 THEN 'h5_franka_3rgb' WHEN 1 THEN 'h5_agilex_3rgb' ELSE 'unknown' END END AS e,
        CASE p_size % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 13 END AS first_rank,
        CASE p_size % 3 WHEN 0 THEN 'camera_left,camera_top,camera_right' WHEN 1 THEN 'camera_front,camera_left_wrist,camera_right_wrist'
          ELSE 'camera_head,zoom' END AS ordered FROM part)""",
)
def infer_embodiment(spark, d):
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    third = F.col("p_size") % 3
    cams = (
        F.when(third == 0, arr("camera_right", "camera_left", "camera_top"))
        .when(third == 1, arr("camera_right_wrist", "camera_front", "camera_left_wrist"))
        .otherwise(arr("zoom", "camera_head"))
    )
    path = F.concat_ws("/", F.lit("data"), _pick(_EMB, F.col("p_partkey") % 4), F.col("p_partkey").cast("string"))
    rows = table(spark, d, "part").select("p_partkey", path.alias("path"), cams.alias("cameras"))
    emb = C.infer_embodiment("path", "cameras")
    return rows.select(
        "p_partkey",
        emb.alias("embodiment"),
        C.needs_bgr_swap(emb).alias("bgr"),
        C.camera_rank(F.element_at("cameras", 1)).alias("first_rank"),
        joined(C.sort_cameras("cameras"), "ordered"),
    )


_SERIALS = ("cam_front_view", "cam_036422060215", "cam_side_view", "cam_104122061850", "cam_eye_in_hand")


@register(
    "consistent_cameras",
    "B05",
    f"""SELECT o_orderkey, cam FROM (SELECT o_orderkey, {_sql_list(_SERIALS)}[o_orderkey % 5 + 1] AS cam, o_orderkey % 7 AS frames FROM orders)
      WHERE cam NOT IN ('cam_front_view', 'cam_side_view', 'cam_eye_in_hand') AND frames > 0""",
)
def consistent_cameras(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey", _pick(_SERIALS, F.col("o_orderkey") % 5).alias("cam"), (F.col("o_orderkey") % 7).alias("frames")
    )
    return C.consistent_cameras(rows, "cam", "frames").select("o_orderkey", "cam")


@register("pretty_name", "B06", "SELECT p_partkey, p_name AS pretty FROM part")
def pretty_name(spark, d):
    glue = F.when(F.col("p_partkey") % 2 == 0, "_").otherwise("__")
    stem = F.replace("p_name", F.lit(" "), glue)
    tail = F.when(F.col("p_partkey") % 3 == 0, ".n.01").otherwise(F.concat(F.lit("_"), F.col("p_partkey").cast("string")))
    return table(spark, d, "part").select("p_partkey", C.pretty_name(F.concat(stem, tail)).alias("pretty"))


@register(
    "candidate_objects",
    "B20",
    """SELECT p_partkey, p_name, split_part(p_name, ' ', 1) IN ('red', 'old') AS matched FROM part WHERE NOT regexp_matches(p_name, 'plate')""",
)
def candidate_objects(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.replace("p_name", F.lit(" "), F.lit("_")).alias("n"))
    # a plate stands for a fixture here, so the fixture word goes into the name
    named = rows.withColumn("n", F.when(F.col("p_name").contains("plate"), F.concat("n", F.lit("_wall"))).otherwise(F.col("n")))
    return named.filter(C.is_candidate("n")).select("p_partkey", "p_name", C.matches_task("n", F.lit("Move_reds and olds")).alias("matched"))


_SUFFIX = {"1": "_exterior_image_1_left", "2": "_exterior_image_2_left"}


@register(
    "split_ids",
    "B07 B21",
    """SELECT doc_id, source || '-' || doc_id AS base, CAST(doc_id % 2 + 1 AS VARCHAR) AS view, source || '-' || doc_id AS base_contains,
      source AS take, CAST(doc_id AS VARCHAR) AS serial, CAST(doc_id AS VARCHAR) AS demo, CASE WHEN doc_id % 2 = 0 THEN lang END AS target,
      'set_' || doc_id || '_' || printf('%06d', n_chars) AS sample_key,
      doc_id || '_head__' || source AS pair_id FROM documents""",
)
def split_ids(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    base = F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"))
    video = F.concat(base, F.lit("_exterior_image_"), (F.col("doc_id") % 2 + 1).cast("string"), F.lit("_left"))
    card = F.concat(F.lit("z_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("__"), F.col("lang"))).otherwise(""))
    take = F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"))
    rows = docs.select(
        "*",
        C.split_video_id(video, _SUFFIX).alias("v"),
        C.split_video_id(F.concat(video, F.lit("_copy")), _SUFFIX, "contains").alias("vc"),
        C.split_take(take).alias("t"),
        C.split_card(card).alias("c"),
    )
    return rows.select(
        "doc_id",
        "v.base",
        "v.view",
        F.col("vc.base").alias("base_contains"),
        "t.take",
        "t.serial",
        "c.demo",
        "c.target",
        C.sample_key("set", "doc_id", "n_chars").alias("sample_key"),
        C.pair_id("doc_id", F.lit("head"), "source").alias("pair_id"),
    )


@register(
    "raw_paths",
    "B08",
    """WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') || '/' AS suffix FROM pages),
      p AS (SELECT page_id, suffix, string_split(regexp_replace(regexp_replace(suffix, '^/+', ''), '/+$', ''), '/') AS parts FROM u)
    SELECT page_id, suffix, parts[1] AS lab, parts[3] AS collect_date FROM p""",
)
def raw_paths(spark, d):
    raw = F.concat(F.lit("raw://store/"), F.regexp_replace("url", "^https?://", ""), F.lit("/trajectory.h5"))
    rows = table(spark, d, "pages").select("page_id", C.parse_raw_path(raw, "raw://store/", "trajectory.h5").alias("p"))
    return rows.select("page_id", "p.*")


_TOKENS = ["RING", "red", "rod", "economy", "o"]


@register(
    "token_counts",
    "B09 D13",
    "WITH n AS (SELECT lower(p_name || ' ' || p_type) AS k FROM part) "
    + " UNION ALL ".join(f"SELECT '{t}' AS token, count(*) AS n FROM n WHERE contains(k, '{t.lower()}') HAVING count(*) > 0" for t in _TOKENS),
)
def token_counts(spark, d):
    rows = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("key"))
    return Q.token_counts(rows, "key", _TOKENS)


@register(
    "mapping_summary",
    "D13",
    f"WITH {MMAP_SQL} SELECT count(*) AS total_keys, count(npz) AS non_null_values, count(*) - count(npz) AS null_values FROM mmap",
)
def mapping_summary(spark, d):
    return Q.mapping_summary(mask_map(spark, d), "video_id", "npz")


_STATE = "CASE WHEN m.video_id IS NULL THEN 'absent' WHEN m.npz IS NULL THEN 'null' ELSE 'mapped' END"


@register(
    "attach_masks",
    "C01 B11",
    f"""WITH {MMAP_SQL} SELECT d.source, {_STATE} AS map_state, count(*) AS episodes FROM documents d LEFT JOIN mmap m ON m.video_id = d.doc_id GROUP BY 1, 2""",
)
def attach_masks(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), "source")
    return P.attach_masks(docs, mask_map(spark, d)).groupBy("source", "map_state").agg(F.count(F.lit(1)).alias("episodes"))


@register(
    "json_points",
    "B12",
    """WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS points,
      CASE event_id % 5 WHEN 0 THEN k + 0.5 WHEN 1 THEN 2 * k + 1.0 END::DOUBLE AS sum_x FROM k""",
)
def json_points(spark, d):
    k = F.get_json_object("props", "$.k")
    ki, kind = k.cast("bigint"), F.col("event_id") % 5
    txt = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    cell = (
        F.when(kind == 0, txt(" [", k, ".5, 1]"))
        .when(kind == 1, txt("[[", k, ",1],[", (ki + 1).cast("string"), ",2]]"))
        .when(kind == 2, "nan")
        .when(kind == 3, "")
        .otherwise(txt("[[", k, ","))
    )
    rows = table(spark, d, "events").select("event_id", C.json_points(cell).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda acc, p: acc + F.get(p, 0))
    return rows.select("event_id", F.when(F.col("p").isNotNull(), F.size("p")).cast("int").alias("points"), total.alias("sum_x"))


# --- pairs -----------------------------------------------------------------------------------------

_COVER = """count(*) AS complete, count(*) FILTER (value_1 IS NOT NULL AND value_2 IS NOT NULL) AS "both",
      count(*) FILTER ((value_1 IS NOT NULL) <> (value_2 IS NOT NULL)) AS one, count(*) FILTER (value_1 IS NULL AND value_2 IS NULL) AS neither,
      min(base) FILTER (value_1 IS NOT NULL AND value_2 IS NOT NULL) AS both_example,
      min(base) FILTER ((value_1 IS NOT NULL) <> (value_2 IS NOT NULL)) AS one_example,
      min(base) FILTER (value_1 IS NULL AND value_2 IS NULL) AS neither_example"""
_RATIOS = ", ".join(f'round("{n}"::DOUBLE / complete, 4) AS {n}_ratio' for n in ("both", "one", "neither"))


@register("pair_coverage", "C02 D08", f"WITH {PAIRS2_SQL}, c AS (SELECT {_COVER} FROM pairs2) SELECT *, {_RATIOS} FROM c")
def pair_coverage(spark, d):
    return Q.pair_coverage(P.pair_views(doc_views(spark, d)))


@register(
    "pair_coverage_listed",
    "C05 D08",
    f"""WITH {MMAP_SQL}, keys AS (SELECT doc_id FROM documents WHERE lang = 'en'),
      views2 AS (SELECT k.doc_id // 2 AS base, CAST(k.doc_id % 2 + 1 AS VARCHAR) AS view, m.npz AS value FROM keys k LEFT JOIN mmap m ON m.video_id = k.doc_id),
      pairs2 AS (SELECT base, max(value) FILTER (view = '1') AS value_1, max(value) FILTER (view = '2') AS value_2 FROM views2 GROUP BY base HAVING count(*) = 2),
      c AS (SELECT {_COVER} FROM pairs2) SELECT *, {_RATIOS} FROM c""",
)
def pair_coverage_listed(spark, d):
    keys = table(spark, d, "documents").filter(F.col("lang") == "en").select(F.col("doc_id").alias("video_id"))
    rows = P.restrict_keys(mask_map(spark, d), keys)
    view = (F.col("video_id") % 2 + 1).cast("string")
    return Q.pair_coverage(P.pair_views(rows.select(F.floor(F.col("video_id") / 2).alias("base"), view.alias("view"), F.col("npz").alias("value"))))


@register(
    "split_membership",
    "C05",
    """SELECT d.source, count(*) AS docs, count(l.doc_id) AS in_split, count(l.doc_id) AS restricted FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""",
)
def split_membership(spark, d):
    docs, keys = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels")
    flagged = P.in_split(docs, keys, ["doc_id"]).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if("in_split").alias("in_split"))
    only = P.only_split(docs, keys, ["doc_id"]).groupBy("source").agg(F.count(F.lit(1)).alias("restricted"))
    return flagged.join(only, "source")


@register(
    "primary_crosstab",
    "C03 D09",
    f"""WITH {MMAP_SQL}, k AS (SELECT doc_id, doc_id - doc_id % 2 + (1 - doc_id % 2) AS other FROM documents)
    SELECT CAST(k.doc_id % 2 + 1 AS VARCHAR) AS primary_view, p.npz IS NOT NULL AS primary_has, o.npz IS NOT NULL AS other_has, count(*) AS n, min(k.doc_id) AS example
    FROM k LEFT JOIN mmap p ON p.video_id = k.doc_id LEFT JOIN mmap o ON o.video_id = k.other GROUP BY 1, 2, 3""",
)
def primary_crosstab(spark, d):
    keys = table(spark, d, "documents").select(F.col("doc_id").alias("video_id"))
    v = F.col("video_id")
    rows = P.primary_other(keys, mask_map(spark, d), "video_id", v - v % 2 + (1 - v % 2))
    return Q.primary_crosstab(rows.withColumn("view", (v % 2 + 1).cast("string")), "view", "video_id")


@register(
    "view_combinations",
    "C04",
    f"""WITH {TAKES_SQL}, c AS (SELECT DISTINCT take, cam FROM takes)
    SELECT x.take, x.cam AS a, y.cam AS b FROM c x JOIN c y ON x.take = y.take AND x.cam < y.cam""",
)
def view_combinations(spark, d):
    return P.view_combinations(takes(spark, d), ["take"], "cam", TAKE_VIEWS)


@register(
    "take_distribution",
    "D21",
    f"""WITH {TAKES_SQL}, k AS (SELECT take, count(DISTINCT cam) AS cameras FROM takes GROUP BY 1)
    SELECT cameras, count(*) AS takes, CAST(count(*) * (cameras * (cameras - 1) // 2) AS BIGINT) AS pairs FROM k GROUP BY cameras""",
)
def take_distribution(spark, d):
    return Q.take_distribution(takes(spark, d), "take", "cam")


# --- metadata -----------------------------------------------------------------------------------------

_GEO_SQL = """geo AS (SELECT c_custkey AS base, c_mktsegment, CASE WHEN c_custkey % 7 <> 0 THEN 'raw://' || 'lab' || (c_nationkey % 6) || '/success/199' || (c_custkey % 10) || '-01-01/' || c_custkey || '/' END AS suffix,
      c_nationkey, c_custkey % 10 <> 0 AS has_meta FROM customer),
enriched AS (SELECT g.base, CASE WHEN suffix IS NOT NULL AND has_meta THEN n.n_name END AS scene_id, CASE WHEN suffix IS NOT NULL AND has_meta THEN r.r_name END AS building,
      CASE WHEN suffix IS NOT NULL AND has_meta THEN g.c_mktsegment END AS current_task,
      CASE WHEN suffix IS NULL THEN NULL WHEN has_meta THEN 'meta' || r.r_regionkey ELSE 'lab' || (c_nationkey % 6) END AS lab,
      CASE WHEN suffix IS NOT NULL AND NOT has_meta THEN '199' || (base % 10) || '-01-01' END AS collect_date,
      CASE WHEN suffix IS NULL THEN 'no_raw_path' WHEN has_meta THEN 'ok' ELSE 'no_metadata' END AS enrich_status
    FROM geo g JOIN nation n ON n.n_nationkey = g.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey)"""


def _enriched(spark, d):
    cust = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    entries = cust.select(F.col("c_custkey").alias("base"))
    s = lambda c: F.col(c).cast("string")
    path = F.concat(
        F.lit("raw://lab"), (F.col("c_nationkey") % 6).cast("string"), F.lit("/success/199"), (F.col("c_custkey") % 10).cast("string"),
        F.lit("-01-01/"), s("c_custkey"), F.lit("/trajectory.h5"),
    )
    rawmap = cust.filter(F.col("c_custkey") % 7 != 0).select(F.col("c_custkey").alias("base"), path.alias("raw_path"))
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    places = n.join(r, n.n_regionkey == r.r_regionkey)
    meta = cust.filter(F.col("c_custkey") % 10 != 0).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    meta = meta.select(
        F.col("c_custkey").alias("base"), F.concat(F.lit("meta"), s("r_regionkey")).alias("lab"), F.col("n_name").alias("scene_id"),
        F.col("r_name").alias("building"), F.col("c_mktsegment").alias("current_task"),
    )
    return P.enrich_scenes(entries, rawmap, meta, "base", "raw://", "trajectory.h5")


@register("enrich_scenes", "C06", f"WITH {_GEO_SQL} SELECT * FROM enriched")
def enrich_scenes(spark, d):
    return _enriched(spark, d)


@register(
    "scene_coverage",
    "D32",
    f"""WITH {_GEO_SQL}, s AS (SELECT DISTINCT n_name FROM nation WHERE n_nationkey < 25 UNION SELECT 'NATION_X')
    SELECT count(*) AS scenes, count(*) FILTER (n_name IN (SELECT scene_id FROM enriched WHERE scene_id IS NOT NULL)) AS represented,
      count(*) FILTER (n_name NOT IN (SELECT scene_id FROM enriched WHERE scene_id IS NOT NULL)) AS missing FROM s""",
)
def scene_coverage(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("scene_id"))
    extra = n.select(F.when(F.col("scene_id") == "NATION_0", "NATION_X").alias("scene_id")).filter(F.col("scene_id").isNotNull())
    return Q.scene_coverage(_enriched(spark, d), n.unionByName(extra), "scene_id")


@register(
    "reconcile_index",
    "C07",
    """WITH a AS (SELECT DISTINCT doc_id % 3 AS camera, doc_id // 2 AS name FROM documents), b AS (SELECT DISTINCT doc_id % 3 AS camera, doc_id // 2 AS name FROM labels)
    SELECT coalesce(a.camera, b.camera) AS camera, count(*) FILTER (a.name IS NOT NULL AND b.name IS NOT NULL) AS "both",
      count(*) FILTER (b.name IS NULL) AS only_members, count(*) FILTER (a.name IS NULL) AS only_mapping,
      count(*) FILTER (b.name IS NULL) = 0 AND count(*) FILTER (a.name IS NULL) = 0 AS agrees
    FROM a FULL OUTER JOIN b ON a.camera = b.camera AND a.name = b.name GROUP BY 1""",
)
def reconcile_index(spark, d):
    side = lambda t: table(spark, d, t).select((F.col("doc_id") % 3).alias("camera"), F.floor(F.col("doc_id") / 2).alias("name"))
    return P.reconcile_index(side("documents"), side("labels"), "name", ["camera"])


# --- episode profiles -----------------------------------------------------------------------------------


@register("top_counts", "D10", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def top_counts(spark, d):
    return Q.top_counts(table(spark, d, "documents"), "source", 5)


@register(
    "profile_episodes",
    "D11",
    """SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_min(props, event_id) AS props, count(*) AS frames,
      bool_or(CASE WHEN event_id % 9 = 0 THEN event_type ELSE '' END <> '') AS has_note FROM events GROUP BY 1""",
)
def profile_episodes(spark, d):
    rows = table(spark, d, "events").withColumn("note", F.when(F.col("event_id") % 9 == 0, F.col("event_type")).otherwise(""))
    return Q.profile_episodes(rows, "user_id", "event_id", ["event_type", "props"], ["note"])


@register(
    "chunk_summary",
    "D12",
    f"""WITH {MMAP_SQL}, p AS (SELECT d.lang, d.doc_id, m.npz IS NOT NULL AS mapped FROM documents d LEFT JOIN mmap m ON m.video_id = d.doc_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY lang, mapped ORDER BY doc_id) AS k FROM p)
    SELECT lang, count(*) AS total, count(*) FILTER (mapped) AS mapped, round(count(*) FILTER (mapped) / count(*)::DOUBLE, 4) AS ratio,
      coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (mapped AND k <= 10), '') AS sample_mapped,
      coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (NOT mapped AND k <= 10), '') AS sample_unmapped FROM r GROUP BY 1""",
)
def chunk_summary(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), "lang")
    rows = P.attach_masks(docs, mask_map(spark, d))
    out = Q.chunk_summary(rows, "lang", "video_id", F.col("map_state") == "mapped")
    return out.select("lang", "total", "mapped", "ratio", joined("sample_mapped", "sample_mapped"), joined("sample_unmapped", "sample_unmapped"))


@register(
    "value_runs",
    "E04",
    """WITH p AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
      c AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS isl FROM p)
    SELECT user_id, event_type, CAST(min(pos) AS BIGINT) AS start, count(*) AS length FROM c GROUP BY user_id, event_type, isl""",
)
def runs_of_values(spark, d):
    return value_runs(table(spark, d, "events"), ["user_id"], "event_id", "event_type")


_CELL = """CASE WHEN conv_id % 10 = 3 AND turn = 1 THEN 'x{' WHEN role = 'system' THEN ' ' WHEN role = 'user' THEN CAST(turn % 3 AS VARCHAR) WHEN turn % 4 = 1 THEN 'null' ELSE CAST(turn AS VARCHAR) END"""


@register(
    "contact_frame",
    "D16",
    f"""WITH c AS (SELECT conv_id, turn, {_CELL} AS cell FROM conversations),
      v AS (SELECT conv_id, TRY_CAST(cell AS BIGINT) AS v, count(*) AS n FROM c WHERE TRY_CAST(cell AS BIGINT) IS NOT NULL GROUP BY 1, 2),
      m AS (SELECT conv_id, arg_min(v, (-n, v)) AS mode FROM v GROUP BY 1), b AS (SELECT conv_id, bool_or(cell = 'x{{') AS bad FROM c GROUP BY 1)
    SELECT b.conv_id, CASE WHEN bad OR mode IS NULL THEN 2 ELSE least(greatest(mode, 0), 4) END::BIGINT AS contact_frame FROM b LEFT JOIN m USING (conv_id)""".replace("x{{", "x{"),
)
def contact_frame(spark, d):
    t = F.col("turn")
    cell = (
        F.when((F.col("conv_id") % 10 == 3) & (t == 1), "x{")
        .when(F.col("role") == "system", " ")
        .when(F.col("role") == "user", (t % 3).cast("string"))
        .when(t % 4 == 1, "null")
        .otherwise(t.cast("string"))
    )
    rows = table(spark, d, "conversations").select("conv_id", cell.alias("cell"), F.lit(5).alias("total"))
    return Q.contact_frames(rows, "conv_id", "cell", "total")


@register(
    "common_length",
    "D20",
    """SELECT user_id, min(n) AS common_frames, count(*) AS cameras FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def common_length(spark, d):
    cams = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("frames"))
    return Q.common_length(cams, ["user_id"])


@register(
    "pooled_density",
    "D27",
    """WITH g AS (SELECT p_brand, sum(p_retailprice) AS b, sum(p_size) AS r FROM part GROUP BY 1)
    SELECT round(sum(b) / sum(r), 6) AS density, round(sum(b) FILTER (r >= 1800) / sum(r) FILTER (r >= 1800), 6) AS density_kept,
      count(*) FILTER (r < 1800) AS outlier_groups, CAST(floor(1e9 / (sum(b) / sum(r))) AS BIGINT) AS extrapolated_rows FROM g""",
)
def pooled_density(spark, d):
    out = Q.pooled_density(table(spark, d, "part"), "p_brand", "p_retailprice", "p_size", 1e9, F.col("group_rows") < 1800)
    return out.select(r6("density"), r6("density_kept"), "outlier_groups", big("extrapolated_rows"))
