"""Scans.  Each names its columns, so the reader gets a pruned schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sightline import schemas
from sightline.operators.ordered import ordered_scan
from sightline.session import published
from sightline.sources.json_ranges import scan_entries


def _file_name() -> Column:
    return F.col("_metadata.file_name")


def _from_tail(position: int, path: str = "_metadata.file_path") -> Column:
    """Path part counted from the end: 1 is the file name."""
    return F.try_element_at(F.split(F.col(path), "/"), F.lit(-position))


def scan_episodes(
    spark: SparkSession, path: str | Sequence[str], required: Sequence[str], optional: Mapping[str, str] | None = None
) -> DataFrame:
    """Frame rows with the listed columns; optional ones (name -> type) are null in files that lack them.

    The read schema has the required columns as one file's footer declares them and the optional
    ones as the caller does, so each file gives what it has and no other footer is opened first.
    """
    paths = [path] if isinstance(path, str) else list(path)
    found = {f.name: f for f in spark.read.parquet(*paths).schema}
    missing = [c for c in required if c not in found]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    schema = T.StructType([found[c] for c in required])
    for c, kind in (optional or {}).items():
        schema = schema.add(T.StructType.fromDDL(f"`{c}` {kind}").fields[0])
    raw = spark.read.schema(schema).parquet(*paths)
    return raw.select(*[F.col(f"`{c}`") for c in schema.names], _file_name().alias("file_name"))


def scan_info(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """Dataset descriptor: one row per wanted feature next to the totals (null feature if absent)."""
    return project_features(spark.read.schema(schemas.struct(schemas.DATASET_INFO)).json(path, multiLine=True), wanted)


def project_features(info: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Descriptor rows -> one row per wanted feature."""
    head = [c for c in info.columns if c != "features"]
    name = F.explode(F.array(*[F.lit(w) for w in wanted])).alias("feature")
    rows = info.select(*head, "features", name)
    spec = F.try_element_at("features", F.col("feature"))
    return rows.select(*head, "feature", spec["dtype"].alias("dtype"), spec["shape"].alias("shape"))


def scan_json_map(spark: SparkSession, path: str, layout: str = "object") -> DataFrame:
    """JSON object(s) of scalars -> (key, value), keeping keys whose value is null.

    ``layout='object'``: one object per file; files are the unit of parallelism.
    ``layout='lines'``: indented files with one entry per line are split like any text,
    so one very large map is read by many tasks.
    ``layout='ranges'``: files of any form, one long line too, are split into byte ranges.
    """
    return parse_json_map(_objects(spark, path, layout))


def _objects(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """JSON objects as text: whole files, or an object of one entry per line of files with an entry per line."""
    if layout == "object":
        return spark.read.text(path, wholetext=True)
    if layout == "ranges":
        return scan_entries(spark, path).select(F.concat(F.lit("{"), "entry", F.lit("}")).alias("value"))
    if layout != "lines":
        raise ValueError(f"unknown layout {layout!r}")
    rows = spark.read.text(path).filter(F.trim("value").startswith('"'))
    return rows.select(F.concat(F.lit("{"), F.regexp_replace(F.trim("value"), ",$", ""), F.lit("}")).alias("value"))


def parse_json_map(text: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """JSON objects in ``value`` -> (key, value) rows; a null value keeps its key."""
    return text.select(*keep, F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def parse_rawpath_map(text: DataFrame) -> DataFrame:
    pairs = text.select(F.explode(F.from_json("value", schemas.RAW_RECORDS)).alias("raw_path", "records"))
    return pairs.select("raw_path", F.inline("records"))


def scan_rawpath_map(spark: SparkSession, path: str, layout: str = "object") -> DataFrame:
    """JSON object raw path -> records, as (raw_path, id, range_nop); layouts as in :func:`scan_json_map`."""
    return parse_rawpath_map(_objects(spark, path, layout))


def scan_view_meta(spark: SparkSession, root: str) -> DataFrame:
    """View descriptors ``<root>/<demo>/<view>/meta.json``; directory names decide demo and view."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="meta.json")
    return parse_view_meta(raw.select(F.col("_metadata.file_path").alias("path"), "value"))


def parse_view_meta(text: DataFrame) -> DataFrame:
    """(path, value) -> view descriptors; the names stored inside the JSON are ignored."""
    meta = text.select("path", F.from_json("value", schemas.VIEW_META).alias("m")).select("path", "m.*")
    named = meta.withColumnsRenamed({"T": "n_frames", "Tmin": "n_frames_min"})
    return named.withColumns({"demo": _from_tail(3, "path"), "view": _from_tail(2, "path")}).drop("path")


def scan_relations(spark: SparkSession, path: str, direction: str, layout: str = "object") -> DataFrame:
    """Relation file -> one row per pair and object; layouts as in :func:`scan_json_map`."""
    return parse_relations(_objects(spark, path, layout), direction)


def parse_relations(text: DataFrame, direction: str) -> DataFrame:
    pairs = text.select(F.explode(F.from_json("value", f"map<string,{schemas.RELATION}>")).alias("pair_id", "r"))
    rows = pairs.select("pair_id", "r", F.explode("r.objects").alias("object_key", "o"))
    ann = F.try_element_at("r.prompt.first_frame_anns", F.col("object_key"))
    return rows.select(
        F.lit(direction).alias("direction"),
        "pair_id",
        F.col("r.video_id").alias("video_id"),
        F.col("r.video_path").alias("video_path"),
        F.col("r.prompt.first_frame_image").alias("prompt_image"),
        ann["segmentation"].alias("prompt_segmentation"),
        ann["area"].alias("prompt_area"),
        ann["text"].alias("text"),
        "object_key",
        F.element_at("o.video_path", 1).alias("target_image"),
        F.col("o.segmentation").alias("target_segmentation"),
        F.col("o.area").alias("target_area"),
    )


def scan_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; a bad line raises instead of turning into nulls."""
    return parse_manifest(spark.read.text(path), schema)


def parse_manifest(lines: DataFrame, schema: str) -> DataFrame:
    rows = lines.filter(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return rows.select("r.*")


def scan_metric_shards(spark: SparkSession, path: str, layout: str = "object") -> DataFrame:
    """Raw metric shards (JSON arrays of {ious, dices}); shard = file name, pair_idx = position.

    The shard ordinal follows the *text* order of file names.  ``layout='object'`` reads a file as a whole;
    ``layout='lines'`` splits files with an element per line and numbers the lines of each file over tasks;
    ``layout='ranges'`` splits files of any form and numbers the elements.
    """
    if layout == "object":
        return parse_metric_shards(spark.read.text(path, wholetext=True).select(_file_name().alias("shard"), "value"))
    if layout == "ranges":
        entries = scan_entries(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("shard"), "at", F.col("entry").alias("value"))
        return _numbered_pairs(published(entries), ["at"])
    if layout != "lines":
        raise ValueError(f"unknown layout {layout!r}")
    lines = spark.read.text(path).select(_file_name().alias("shard"), F.col("_metadata.file_block_start").alias("_block"), "value")
    # in a block rows keep the order of the file; written once, so that the numbers stay as they are
    lines = published(lines.withColumn("_line", F.monotonically_increasing_id()).filter(F.trim("value").startswith("{")))
    return _numbered_pairs(lines, ["_block", "_line"])


def _numbered_pairs(elements: DataFrame, order: Sequence[str]) -> DataFrame:
    """Elements of shards as text, numbered per shard in ``order``."""
    placed = ordered_scan(elements, order, ["shard"], ordinal="pair_idx")
    row = F.from_json(F.regexp_replace(F.trim("value"), ",$", ""), "ious array<double>, dices array<double>")
    out = placed.select("shard", "pair_idx", row.alias("r")).select("shard", "pair_idx", "r.ious", "r.dices")
    return out.join(shard_ordinals(elements), "shard")


def parse_metric_shards(text: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(shard, value) -> (shard, pair_idx, ious, dices, shard_no) and the ``keep`` columns."""
    rows = F.from_json("value", "array<struct<ious:array<double>,dices:array<double>>>")
    out = text.select("shard", *keep, F.posexplode(rows).alias("pair_idx", "r"))
    out = out.select("shard", *keep, F.col("pair_idx").cast("bigint").alias("pair_idx"), "r.ious", "r.dices")
    return out.join(shard_ordinals(text), "shard")


def shard_ordinals(df: DataFrame) -> DataFrame:
    """(shard, shard_no) by text order; the window holds one row per file."""
    names = df.select("shard").distinct()
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("shard")) - 1
    return names.withColumn("shard_no", position.cast("bigint"))


def parse_plan(lines: DataFrame, value: str = "value") -> DataFrame:
    """Candidate lines ``primary alt alt`` -> (task, rank, demo); task = primary div 10000."""
    words = F.filter(F.split(F.trim(F.col(value)), r"\s+"), lambda w: w != "")
    rows = lines.filter(F.trim(F.col(value)) != "").select(words.alias("w"))
    task = F.floor(F.element_at("w", 1).try_cast("bigint") / 10000).alias("task")
    return rows.select(task, F.posexplode("w").alias("rank", "demo")).withColumn("rank", F.col("rank").cast("bigint"))


def scan_plan(spark: SparkSession, path: str) -> DataFrame:
    return parse_plan(spark.read.text(path))


# Line patterns of the job logs.
STATUS_LINE = r"^PROD (\S+) (\S+)"
PROGRESS_WORDS = r"Iter\((train|val|test)\)"
METRIC_WORDS = r"Mean IoU|Mean Dice|Mean Location Score|Mean Shape Accuracy"
ERROR_WORDS = r"Traceback|Error:|Exception:"


def parse_job_log(lines: DataFrame, value: str = "value", metric_key: str = r"(\w+)=([-+0-9.eE]+)\s*$") -> DataFrame:
    """Typed events: ``kind`` status / progress / metric / error / other, subject, status and trailing key=value."""
    text = F.col(value)
    kind = (
        F.when(text.rlike(ERROR_WORDS), "error")
        .when(text.rlike(STATUS_LINE), "status")
        .when(text.rlike(METRIC_WORDS), "metric")
        .when(text.rlike(PROGRESS_WORDS), "progress")
        .otherwise("other")
    )
    some = lambda pattern, i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return lines.withColumns(
        {
            "kind": kind,
            "subject": some(STATUS_LINE, 1),
            "status": some(STATUS_LINE, 2),
            "key": some(metric_key, 1),
            "number": some(metric_key, 2).try_cast("double"),
        }
    )


def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, mtime); the content column is never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    rows = files.load(path)
    return rows.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))


def scan_polygons(spark: SparkSession, root: str) -> DataFrame:
    """Polygon files ``<root>/<base>/f<frame>.json`` -> (base, frame, shape_no, label, points)."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="f*.json")
    return parse_polygons(raw.select(F.col("_metadata.file_path").alias("path"), "value"))


def parse_polygons(text: DataFrame) -> DataFrame:
    """(path, value) -> one row per shape."""
    frame = F.regexp_extract(_from_tail(1, "path"), r"^f(\d+)", 1).try_cast("int")
    shapes = F.from_json("value", schemas.POLYGONS)["shapes"]
    rows = text.select(_from_tail(2, "path").alias("base"), frame.alias("frame"), F.posexplode(shapes).alias("shape_no", "s"))
    return rows.select("base", "frame", "shape_no", "s.label", "s.points")


def parse_path_list(lines: DataFrame, value: str = "value", names: Sequence[str] = ("subset", "task", "split", "episode")) -> DataFrame:
    """Path lines -> named leading parts; empty lines skipped, short paths give nulls."""
    parts = F.split(F.regexp_replace(F.trim(F.col(value)), "^/+|/+$", ""), "/")
    rows = lines.filter(F.trim(F.col(value)) != "")
    return rows.select(*[F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def scan_path_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_path_list(spark.read.text(path))
