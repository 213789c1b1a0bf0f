"""Scans, job logs, plans and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import selection as L
from sightline.operators.metrics import explode_pairs
from sightline.plans.registry import big, r6, register
from sightline.plans.tables import LOG_SQL, TAKES_SQL, log_lines, table, takes
from sightline.session import work_folder
from sightline import schemas
from sightline.sources import scans as N
from sightline.sources import sinks as K
from sightline.sources.json_ranges import scan_entries
from sightline.streaming import jobs as J

# --- scans of the driver files ----------------------------------------------------------------------


@register(
    "scan_episodes",
    "A01",
    """SELECT count(*) AS rows, count(DISTINCT user_id) AS episodes, count(*) FILTER (event_id % 2 = 1 AND event_type = 'click') AS segmentation,
      count(DISTINCT CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END) AS files FROM events""",
)
def scan_episodes(spark, d):
    """Two files, of which only the second has the optional column."""
    folder, events = work_folder(spark), table(spark, d, "events")
    even = events.filter("event_id % 2 = 0").select("user_id", "event_id")
    odd = events.filter("event_id % 2 = 1").select("user_id", "event_id", F.when(F.col("event_type") == "click", "m.npz").alias("segmentation"))
    for part, rows in (("a", even), ("b", odd)):
        rows.coalesce(1).write.parquet(f"{folder}/{part}")
    rows = N.scan_episodes(spark, [f"{folder}/a", f"{folder}/b"], ["user_id", "event_id"], {"segmentation": "string"})
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("user_id").alias("episodes"), F.count("segmentation").alias("segmentation"),
        F.countDistinct("file_name").alias("files"),
    )


_FILES_SQL = " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS file, true AS has_bytes, true AS has_mtime" for t in
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


@register("file_inventory", "A11", _FILES_SQL)
def file_inventory(spark, d):
    """The tables of the folder, each a file or a folder of files."""
    files = N.file_inventory(spark, d, "*.parquet")
    name = F.regexp_extract("path", r"([^/]+\.parquet)(?:/[^/]*)?$", 1).alias("file")
    return files.groupBy(name).agg((F.sum("bytes") > 0).alias("has_bytes"), F.bool_and(F.col("mtime").isNotNull()).alias("has_mtime"))


# --- annotation JSON built from the tables row by row, then parsed ------------------------------------


@register(
    "parse_json_map",
    "A03",
    """WITH m AS (SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id))
    SELECT doc_id || '_left' AS key, CASE WHEN quality = 1 THEN 'npz/' || doc_id END AS value FROM m UNION ALL SELECT doc_id || '_right', 'r,' || doc_id FROM m""",
)
def parse_json_map(spark, d):
    i = F.col("doc_id").cast("string")
    value = F.when(F.col("quality") == 1, F.concat(F.lit("npz/"), i))
    obj = F.create_map(F.concat(i, F.lit("_left")), value, F.concat(i, F.lit("_right")), F.concat(F.lit("r,"), i))
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id")
    return N.parse_json_map(rows.select(F.to_json(obj, {"ignoreNullFields": "false"}).alias("value")))


@register(
    "parse_rawpath_map",
    "A04",
    """SELECT 'raw/' || o_custkey || '/' || o_orderkey AS raw_path, 'ep' || o_orderkey || '_' || k AS id, o_orderkey % 50 + k AS first, o_orderkey % 50 + 10 AS last FROM orders, unnest(range(2)) u(k)""",
)
def parse_rawpath_map(spark, d):
    o = F.col("o_orderkey")
    rec = lambda k: F.struct(
        F.concat(F.lit("ep"), o.cast("string"), F.lit(f"_{k}")).alias("id"), F.array((o % 50 + k).cast("int"), (o % 50 + 10).cast("int")).alias("range_nop")
    )
    path = F.concat_ws("/", F.lit("raw"), F.col("o_custkey").cast("string"), o.cast("string"))
    text = table(spark, d, "orders").select(F.to_json(F.create_map(path, F.array(rec(0), rec(1)))).alias("value"))
    rows = N.parse_rawpath_map(text)
    return rows.select("raw_path", "id", big(F.get("range_nop", F.lit(0)), "first"), big(F.get("range_nop", F.lit(1)), "last"))


#: Entries of a file of the raw-path map, about.
MAP_FILE_ROWS = 200_000


@register(
    "split_rawpath_map",
    "A04",
    """SELECT 'raw/' || o_custkey || '/' || o_orderkey AS raw_path, 'ep' || o_orderkey || '_' || k AS id, o_orderkey % 50 + k AS first, o_orderkey % 50 + 10 AS last FROM orders, unnest(range(2)) u(k)""",
)
def split_rawpath_map(spark, d):
    """The map of ``parse_rawpath_map`` written as files of one line each, then read in byte ranges."""
    o = F.col("o_orderkey")
    rec = lambda k: F.struct(
        F.concat(F.lit("ep"), o.cast("string"), F.lit(f"_{k}")).alias("id"), F.array((o % 50 + k).cast("int"), (o % 50 + 10).cast("int")).alias("range_nop")
    )
    path = F.concat_ws("/", F.lit("raw"), F.col("o_custkey").cast("string"), o.cast("string"))
    entry = F.concat(F.lit(', "'), path, F.lit('": '), F.to_json(F.array(rec(0), rec(1))))
    orders = table(spark, d, "orders")
    files = range(max(4, -(-orders.count() // MAP_FILE_ROWS)))  # a task sorts and writes one file
    rows = orders.select((o % len(files)).cast("int").alias("file"), F.lit(1).alias("part"), entry.alias("value"))
    ends = spark.createDataFrame([(f, part, text) for f in files for part, text in ((0, '{"": []'), (2, "}"))], "file int, part int, value string")
    folder = work_folder(spark)
    whole = rows.union(ends).repartitionById(len(files), "file").sortWithinPartitions("file", "part")
    whole.select("value").write.option("lineSep", " ").text(folder)
    found = N.parse_rawpath_map(scan_entries(spark, folder, 1 << 20).select(F.concat(F.lit("{"), "entry", F.lit("}")).alias("value")))
    return found.select("raw_path", "id", big(F.get("range_nop", F.lit(0)), "first"), big(F.get("range_nop", F.lit(1)), "last"))


@register(
    "parse_metric_shards",
    "A08 E08",
    """WITH s AS (SELECT p_size, p_partkey, 'raw_' || p_size || '.json' AS shard, p_retailprice / 3000 AS a, p_size / 100 AS b FROM part),
      k AS (SELECT *, dense_rank() OVER (ORDER BY shard) - 1 AS shard_no FROM s)
    SELECT shard, CAST(shard_no AS BIGINT) AS shard_no, 0::BIGINT AS pair_idx, u.i AS obj_idx, round(CASE WHEN u.i = 0 THEN a ELSE b END, 6) AS iou, round(a, 6) AS dice, p_partkey FROM k, unnest(range(2)) u(i)""",
)
def parse_metric_shards(spark, d):
    part = table(spark, d, "part")
    name = F.concat(F.lit("raw_"), F.col("p_size").cast("string"), F.lit(".json"))
    a, b = F.col("p_retailprice") / 3000, F.col("p_size") / 100
    text = part.select(
        name.alias("shard"), F.to_json(F.array(F.struct(F.array(a, b).alias("ious"), F.array(a, a).alias("dices"), F.col("p_partkey").alias("id")))).alias("value"), "p_partkey"
    )
    pairs = N.parse_metric_shards(text.select("shard", "value", "p_partkey"), keep=["p_partkey"])
    rows = explode_pairs(pairs, ["shard", "shard_no", "p_partkey"])
    return rows.select("shard", "shard_no", "pair_idx", big("obj_idx"), r6("iou"), r6("dice"), "p_partkey")


@register(
    "parse_relations",
    "A06",
    """SELECT 'p' || o_orderkey AS pair_id, '0' AS object_key, 'a/' || o_orderkey || '.jpg' AS prompt_image, 'b/' || o_orderkey || '.jpg' AS target_image, (o_orderkey % 90)::DOUBLE AS prompt_area,
      (o_orderkey % 70)::DOUBLE AS target_area, o_orderpriority AS text FROM orders""",
)
def parse_relations(spark, d):
    o, n = F.col("o_orderkey").cast("string"), F.col("o_orderkey")
    pid = F.concat(F.lit("p"), o)
    seg = F.struct(F.array(F.lit(0), n % 90).alias("counts"), F.array(F.lit(8), F.lit(8)).alias("size"))
    ann = F.struct(seg.alias("segmentation"), (n % 90).cast("double").alias("area"), F.lit(1.0).alias("category_id"), F.col("o_orderpriority").alias("text"))
    target = F.concat(F.lit("b/"), o, F.lit(".jpg"))
    obj = F.struct(pid.alias("video_id"), F.lit(0).alias("obj_id"), F.array(target).alias("video_path"), seg.alias("segmentation"), (n % 70).cast("double").alias("area"))
    rel = F.struct(
        pid.alias("video_id"),
        F.array(target).alias("video_path"),
        F.struct(F.concat(F.lit("a/"), o, F.lit(".jpg")).alias("first_frame_image"), F.create_map(F.lit("0"), ann).alias("first_frame_anns")).alias("prompt"),
        F.create_map(F.lit("0"), obj).alias("objects"),
    )
    text = table(spark, d, "orders").select(F.to_json(F.create_map(pid, rel)).alias("value"))
    rows = N.parse_relations(text, "ego2exo")
    return rows.select("pair_id", "object_key", "prompt_image", "target_image", "prompt_area", "target_area", "text")


@register(
    "project_features",
    "A02",
    """SELECT doc_id AS total_episodes, n_chars AS total_frames, f AS feature, CASE f WHEN 'image' THEN 'video' WHEN 'mask' THEN 'bool' END AS dtype, CASE f WHEN 'image' THEN n_chars % 100 END AS width
      FROM documents, (VALUES ('image'), ('mask'), ('absent')) w(f)""",
)
def project_features(spark, d):
    n = F.col("n_chars")
    image = F.struct(F.lit("video").alias("dtype"), F.array((n % 100).cast("int")).alias("shape"))
    mask = F.struct(F.lit("bool").alias("dtype"), F.lit(None).cast("array<int>").alias("shape"))
    features = F.create_map(F.lit("image"), image, F.lit("mask"), mask, F.lit("other"), mask)
    text = F.to_json(F.struct(F.col("doc_id").alias("total_episodes"), n.alias("total_frames"), F.lit(10).alias("fps"), features.alias("features")))
    info = table(spark, d, "documents").select(F.from_json(text, schemas.DATASET_INFO).alias("i")).select("i.*")
    rows = N.project_features(info, ["image", "mask", "absent"])
    return rows.select("total_episodes", "total_frames", "feature", "dtype", F.get("shape", F.lit(0)).alias("width"))


@register(
    "parse_view_meta",
    "A05",
    """SELECT CAST(user_id AS VARCHAR) AS demo, event_type AS view, count(*) AS n_frames, count(*) // 2 AS n_frames_min, 'obj' || user_id % 7 AS target, round(avg(value), 6) AS visible_frac FROM events GROUP BY user_id, event_type""",
)
def parse_view_meta(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    name = F.concat(F.lit("obj"), (F.col("user_id") % 7).cast("string"))
    body = F.struct(
        F.lit("stale").alias("demo"), F.col("n").alias("T"), F.floor(F.col("n") / 2).alias("Tmin"), F.struct(name.alias("name")).alias("target"), F.col("v").alias("visible_frac")
    )
    path = F.concat_ws("/", F.lit("root"), F.col("user_id").cast("string"), F.col("event_type"), F.lit("meta.json"))
    rows = N.parse_view_meta(g.select(path.alias("path"), F.to_json(body).alias("value")))
    return rows.select("demo", "view", big("n_frames"), big("n_frames_min"), F.col("target.name").alias("target"), r6("visible_frac"))


@register(
    "parse_polygons",
    "A12",
    """SELECT 'e' || vec_id AS base, vec_id % 900 AS frame, s AS shape_no, 'c' || label || '_' || s AS label, s + 3 AS vertices, round(embedding[1]::DOUBLE, 6) AS first_x FROM embeddings, unnest(range(2)) u(s)""",
)
def parse_polygons(spark, d):
    x = F.round(F.get("embedding", F.lit(0)).cast("double"), 6)
    point = F.array(x, F.lit(1.0))
    shape = lambda s: F.struct(F.concat(F.lit("c"), F.col("label").cast("string"), F.lit(f"_{s}")).alias("label"), F.array(*[point] * (s + 3)).alias("points"))
    path = F.format_string("root/e%d/f%05d.json", "vec_id", F.col("vec_id") % 900)
    text = table(spark, d, "embeddings").select(path.alias("path"), F.to_json(F.struct(F.array(shape(0), shape(1)).alias("shapes"))).alias("value"))
    rows = N.parse_polygons(text)
    return rows.select("base", big("frame"), big("shape_no"), "label", big(F.size("points"), "vertices"), r6(F.element_at("points", 1)[0], "first_x"))


@register("parse_manifest", "A07", "SELECT o_orderkey AS sample, o_orderpriority AS shard, o_totalprice AS bytes FROM orders")
def parse_manifest(spark, d):
    body = F.struct(F.col("o_orderkey").alias("sample"), F.col("o_orderpriority").alias("shard"), F.col("o_totalprice").alias("bytes"))
    return N.parse_manifest(table(spark, d, "orders").select(F.to_json(body).alias("value")), "sample BIGINT, shard STRING, bytes DOUBLE")


# --- sinks, written below the shared folder and read back -----------------------------------------------


@register(
    "write_relations",
    "A13",
    """SELECT CASE WHEN o_orderstatus = 'F' THEN 'ego2exo' ELSE 'exo2exo' END AS direction, 'p' || o_orderkey AS pair_id, o_custkey FROM orders""",
)
def write_relations(spark, d):
    rows = table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "ego2exo").otherwise("exo2exo").alias("direction"),
        F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("pair_id"),
        "o_custkey",
    )
    folder = work_folder(spark)
    K.write_relations(rows, folder)
    return spark.read.parquet(folder).select("direction", "pair_id", "o_custkey")


@register("write_sample_index", "A14", "SELECT page_id AS sample, length(html) AS bytes, page_id % 4 AS shard FROM pages")
def write_sample_index(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("sample"), F.length("html").alias("bytes"), (F.col("page_id") % 4).alias("shard"), "url")
    folder = work_folder(spark)
    K.write_sample_index(rows, folder, ["sample", "bytes"])
    return spark.read.parquet(folder).select("sample", "bytes", "shard")


@register("write_manifest", "A15", "SELECT doc_id, CASE WHEN quality = 1 THEN toxic END AS toxic FROM labels")
def write_manifest(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, F.col("toxic")).alias("toxic"))
    folder = work_folder(spark)
    K.write_manifest(rows, folder)
    return N.scan_manifest(spark, folder, "doc_id BIGINT, toxic INT")


# --- plans and logs --------------------------------------------------------------------------------------


@register(
    "parse_plan",
    "A09",
    """SELECT o_orderkey * 37 // 10000 AS task, r AS rank, CAST(CASE r WHEN 0 THEN o_orderkey * 37 ELSE o_custkey END AS VARCHAR) AS demo FROM orders, unnest(range(2)) u(r)""",
)
def parse_plan(spark, d):
    line = F.concat(F.lit(" "), (F.col("o_orderkey") * 37).cast("string"), F.lit("   "), F.col("o_custkey").cast("string"))
    return N.parse_plan(table(spark, d, "orders").select(line.alias("value")))


@register(
    "parse_job_log",
    "A10",
    f"WITH {LOG_SQL} SELECT event_id, kind, subject, status, number FROM parsed",
)
def parse_job_log(spark, d):
    return N.parse_job_log(log_lines(spark, d), "line").select("event_id", "kind", "subject", "status", "number")


@register(
    "latest_status",
    "E12",
    f"WITH {LOG_SQL} SELECT subject, status, number FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, event_id DESC) AS k FROM parsed WHERE kind = 'status') WHERE k = 1",
)
def latest_status(spark, d):
    ev = N.parse_job_log(log_lines(spark, d), "line").filter(F.col("kind") == "status")
    return L.latest_status(ev, "subject", "ts", "event_id", ["status", "number"])


_MONITOR_SQL = f"""WITH {LOG_SQL} SELECT 'job' || user_id || '.log' AS file, count(*) AS events, arg_max(status, (ts, event_id)) FILTER (status IS NOT NULL) AS last_status,
      arg_max(number, (ts, event_id)) FILTER (number IS NOT NULL) AS last_value, count(*) FILTER (kind = 'error' OR coalesce(status = 'error', false)) AS errors FROM parsed GROUP BY 1"""


@register("monitor_jobs", "J01", _MONITOR_SQL)
def monitor_jobs(spark, d):
    return J.monitor_jobs(N.parse_job_log(log_lines(spark, d), "line"), order=("ts", "event_id"))


@register("stream_monitor", "J01", _MONITOR_SQL)
def stream_monitor(spark, d):
    """The same from a stream of four micro-batches; the last snapshot has every job's state."""
    folder = work_folder(spark)
    log_lines(spark, d).repartition(4, F.col("event_id") % 4).write.option("maxRecordsPerFile", 0).parquet(f"{folder}/lines")
    lines = spark.readStream.schema("event_id long, ts timestamp_ntz, line string, file string").option("maxFilesPerTrigger", 1)
    q = J.start_monitor(
        lines.parquet(f"{folder}/lines"), f"{folder}/history", f"{folder}/snapshot", f"{folder}/progress", order=("ts", "event_id"), value="line"
    )
    q.awaitTermination()
    return J.current_snapshot(spark, f"{folder}/snapshot").drop("batch_id")


@register(
    "first_accepted",
    "E11",
    f"""WITH {TAKES_SQL}, r AS (SELECT take, o_orderkey, o_orderstatus, o_totalprice > 100000 AS moving, row_number() OVER (PARTITION BY take ORDER BY o_orderkey) AS k, row_number() OVER (PARTITION BY take ORDER BY o_orderkey DESC) AS back FROM takes),
      a AS (SELECT take, min(o_orderkey) FILTER (o_orderstatus = 'F') AS f, max(o_orderkey) FILTER (back = 1 AND moving) AS l, count(*) AS candidates FROM r GROUP BY 1)
    SELECT take, coalesce(f, l) AS chosen, CASE WHEN f IS NOT NULL THEN 'COMPLETE' WHEN l IS NOT NULL THEN 'LAST-CANDIDATE' ELSE 'GIVE-UP' END AS outcome, candidates FROM a""",
)
def first_accepted(spark, d):
    return L.first_accepted(takes(spark, d), "take", "o_orderkey", "o_orderkey", F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000)


@register(
    "anchor_midpoints",
    "E13",
    """WITH a AS (SELECT DISTINCT conv_id, turn * 7 AS turn FROM conversations WHERE role = 'user'), n AS (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_frame FROM a)
    SELECT conv_id, turn, next_frame, (turn + next_frame) // 2 AS mid FROM n WHERE next_frame IS NOT NULL""",
)
def anchor_midpoints(spark, d):
    rows = table(spark, d, "conversations").filter(F.col("role") == "user").select("conv_id", (F.col("turn") * 7).alias("turn"))
    return L.anchor_midpoints(rows, "conv_id", "turn")


# --- streams over the events file -------------------------------------------------------------------------------


def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")


@register(
    "stream_ingest",
    "J02",
    "SELECT user_id, count(*) AS samples, count(*) FILTER (value <= 20) AS repaired FROM events WHERE value > 10 GROUP BY 1",
)
def stream_ingest(spark, d):
    """Every valid sample once, although samples come repeatedly, in several batches, and the job is started twice; then a retry."""
    folder = work_folder(spark)
    events = table(spark, d, "events").select("user_id", "event_id", "value")
    repeated = events.union(events.filter("event_id % 5 = 0"))
    repeated.repartition(4, F.rand(1)).write.parquet(f"{folder}/queue")
    where = (f"{folder}/done", f"{folder}/failed")
    for _ in range(2):
        queue = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/queue")
        J.ingest_samples(queue, *where, f"{folder}/progress", ["event_id"], "value > 20").awaitTermination()
    J.run_retries(spark, *where, ["event_id"], "value > 20", lambda rows: rows.withColumn("value", F.col("value") + 10))
    done = spark.read.parquet(where[0])
    return done.groupBy("user_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("batch") < 0).alias("repaired"))


@register(
    "stream_dedup",
    "J03",
    "SELECT user_id, count(*) AS rows FROM events GROUP BY 1",
)
def stream_dedup(spark, d):
    """Replayed rows (each event twice) reduced to one."""
    folder = work_folder(spark)
    stream = _event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    doubled = stream.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).drop("copy")
    rows = J.stream_dedup(doubled, ["event_id"], "ts", "1 hour")
    q = rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/rows")
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))
