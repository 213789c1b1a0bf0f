"""Data-quality checks.  Each returns findings: ``check``, ``subject``, ``detail`` (all text)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.ordered import union_all
from sightline.sources.file_pieces import hashed_files

# Published totals of the dual-view dataset (trajectories, samples, images per sample).
EXPECTED_TOTALS = {"trajectories": 56_566, "samples": 14_035_692, "images_per_sample": 2}

# Disposition -> relations it yields and views it keeps.
DISPOSITION_RULES = (
    ("valid", ("ego2exo", "exo2ego", "exo2exo"), 3, 6),
    ("target_not_visible", ("exo2exo",), 2, 2),
)


class DirtyTable(ValueError):
    """Raised by :func:`assert_clean`."""


def assert_clean(findings: DataFrame, show: int = 5) -> None:
    """Raise when there is any finding; reads at most ``show`` rows."""
    head = findings.limit(show).collect()
    if head:
        raise DirtyTable("; ".join(str(r.asDict()) for r in head))


def finding(check: str, subject: Column | str, detail: Column | str = "") -> list[Column]:
    s = F.col(subject) if isinstance(subject, str) else subject
    d = F.lit(detail) if isinstance(detail, str) else detail
    return [F.lit(check).alias("check"), s.cast("string").alias("subject"), d.cast("string").alias("detail")]


# --- closures --------------------------------------------------------------------------------


def closure(refs: DataFrame, files: DataFrame, key: str, well_formed: Column | None = None) -> DataFrame:
    """References without file, how many rows refer to nothing, and (optionally) referenced files that are not well-formed."""
    wanted = refs.select(key).filter(F.col(key).isNotNull()).distinct()
    missing = wanted.join(files.select(key), key, "left_anti").select(*finding("missing", key))
    empty = refs.filter(F.col(key).isNull()).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0")
    missing = missing.unionByName(empty.select(*finding("null_reference", F.lit(key), F.col("_n"))))
    if well_formed is None:
        return missing
    bad = files.filter(~well_formed).join(wanted, key, "left_semi").select(*finding("malformed", key))
    return missing.unionByName(bad)


def jpeg_ok(content: str | Column) -> Column:
    """Starts with FFD8 and ends with FFD9 (for the ``content`` column of a binary scan)."""
    c = F.col(content) if isinstance(content, str) else content
    return (F.hex(F.substring(c, 1, 2)) == "FFD8") & (F.hex(F.substring(c, -2, 2)) == "FFD9")


def all_refs(relations: Sequence[DataFrame], column: str) -> DataFrame:
    """Distinct references over all directions."""
    return union_all([r.select(column) for r in relations]).distinct()


def schema_closure(expected: DataFrame, observed: DataFrame, name: str = "name", shape: str = "shape") -> DataFrame:
    """Missing, unexpected and differently shaped tensors."""
    e = expected.select(name, F.col(shape).alias("_e"), F.lit(True).alias("_in_e"))
    o = observed.select(name, F.col(shape).alias("_o"), F.lit(True).alias("_in_o"))
    rows = e.join(o, name, "full_outer")
    check = (
        F.when(F.col("_in_o").isNull(), "missing")
        .when(F.col("_in_e").isNull(), "unexpected")
        .when(~F.col("_e").eqNullSafe(F.col("_o")), "shape")
    )
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return rows.withColumn("check", check).filter(F.col("check").isNotNull()).select(
        "check", F.col(name).cast("string").alias("subject"), F.concat(text("_e"), F.lit(" vs "), text("_o")).alias("detail")
    )


def prefix_counts(manifest: DataFrame, name: str = "name", depth: int = 1) -> DataFrame:
    return manifest.groupBy(F.substring_index(name, ".", depth).alias("prefix")).agg(F.count(F.lit(1)).alias("tensors"))


def append_only(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Existing rows that vanished or changed, and new ids that are not contiguous after the old ones."""
    sig = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    b, a = before.select(key, sig.alias("_b")), after.select(key, sig.alias("_a"))
    rows = b.join(a, key, "full_outer")
    check = F.when(F.col("_a").isNull(), "removed").when(F.col("_b").isNotNull() & (F.col("_a") != F.col("_b")), "changed")
    existing = rows.withColumn("check", check).filter(F.col("check").isNotNull()).select(
        "check", F.col(key).cast("string").alias("subject"), F.lit("").alias("detail")
    )
    new = rows.agg(
        F.max(F.when(F.col("_b").isNotNull(), F.col(key))).alias("last_old"),
        F.min(F.when(F.col("_b").isNull(), F.col(key))).alias("first_new"),
        F.max(F.when(F.col("_b").isNull(), F.col(key))).alias("last_new"),
        F.count_if(F.col("_b").isNull()).alias("n_new"),
    )
    gap = (F.col("n_new") > 0) & (
        (F.col("last_new") - F.col("first_new") + 1 != F.col("n_new")) | (F.col("first_new") != F.col("last_old") + 1)
    )
    ids = new.filter(gap).select(*finding("not_contiguous", "first_new", F.concat_ws("..", F.col("first_new"), F.col("last_new"))))
    return existing.unionByName(ids)


# --- relations -----------------------------------------------------------------------------------


def audit_relations(relations: DataFrame, images: DataFrame, areas: DataFrame) -> DataFrame:
    """Key equals video id; both images exist; mask size equals image size; stored area equals the
    recomputed one; prompt and target come from the same moment.

    ``relations``: pair_id, video_id, prompt_image, target_image, prompt_t, target_t, mask_id, area.
    ``images``: image, h, w.  ``areas``: mask_id, h, w, area (recomputed).
    """
    sizes = images.select(F.col("image").alias("target_image"), F.col("h").alias("_ih"), F.col("w").alias("_iw"))
    masks = areas.select("mask_id", F.col("h").alias("_mh"), F.col("w").alias("_mw"), F.col("area").alias("_area"))
    rows = relations.join(masks, "mask_id", "left").join(sizes, "target_image", "left")
    found = lambda bad, check, detail="": F.when(
        bad, F.struct(F.lit(check).alias("check"), (F.lit(detail) if detail == "" else F.col(detail)).alias("detail"))
    )
    checks = F.array(
        found(F.col("pair_id") != F.col("video_id"), "key_differs", "video_id"),
        found((F.col("_mh") != F.col("_ih")) | (F.col("_mw") != F.col("_iw")), "mask_size"),
        found(~F.col("area").eqNullSafe(F.col("_area")), "area"),
        found(F.col("prompt_t") != F.col("target_t"), "moment"),
    )
    per_row = rows.select(F.col("pair_id").alias("subject"), F.inline(F.filter(checks, lambda x: x.isNotNull())))
    refs = relations.select(F.explode(F.array("prompt_image", "target_image")).alias("image"))
    return per_row.select("check", "subject", "detail").unionByName(closure(refs, images, "image"))


def audit_direction_sum(ledger: DataFrame, total: int | Column, column: str = "relations") -> DataFrame:
    t = F.lit(total) if isinstance(total, int) else total
    rows = ledger.agg(F.sum(column).alias("_s"))
    return rows.filter(F.col("_s") != t).select(*finding("direction_sum", F.col("_s"), t))


def relations_by_disposition(tasks: DataFrame, task: str = "task", disposition: str = "disposition") -> DataFrame:
    """Directed relations per task by its disposition; rejected tasks yield none."""
    ego, a, b = F.lit("ego"), F.lit("exo1"), F.lit("exo2")
    pairs = {"ego2exo": [(ego, a), (ego, b)], "exo2ego": [(a, ego), (b, ego)], "exo2exo": [(a, b), (b, a)]}
    none = F.array().cast("array<struct<direction:string,source:string,target:string>>")
    rel = none
    for name, directions, _, _ in DISPOSITION_RULES:
        made = F.array(*[F.struct(F.lit(d).alias("direction"), s.alias("source"), t.alias("target")) for d in directions for s, t in pairs[d]])
        rel = F.when(F.col(disposition) == name, made).otherwise(rel)
    return tasks.select(task, F.inline(rel))


def masks_by_disposition(tasks: DataFrame, disposition: str = "disposition") -> DataFrame:
    """Relations and masks a set of tasks yields, per disposition."""
    views, rels = F.lit(0), F.lit(0)
    for name, _, n_views, n_rel in DISPOSITION_RULES:
        hit = F.col(disposition) == name
        views, rels = F.when(hit, n_views).otherwise(views), F.when(hit, n_rel).otherwise(rels)
    return tasks.groupBy(disposition).agg(
        F.count(F.lit(1)).alias("tasks"), F.sum(rels).alias("relations"), F.sum(views).alias("masks")
    )


def asymmetric(relations: DataFrame, task: str = "task") -> DataFrame:
    """Relations whose swap is missing."""
    swap = relations.select(task, F.col("target").alias("source"), F.col("source").alias("target"))
    return relations.join(swap, [task, "source", "target"], "left_anti")


def quarantine(submissions: DataFrame, task: str = "task") -> DataFrame:
    """First conflict per task, or null: two sources for a view, missing status, missing mask, active draft.

    ``submissions``: task, view, source, status, has_mask, draft.
    """
    # grouped by source first: no text is an aggregate's value, so all steps are hash aggregates
    per_source = submissions.groupBy(task, "view", "source").agg(
        F.bool_or(F.col("status").isNull()).alias("_no_status"),
        F.bool_and("has_mask").alias("_mask"),
        F.bool_or("draft").alias("_draft"),
    )
    per_view = per_source.groupBy(task, "view").agg(
        F.count("source").alias("_sources"),
        F.bool_or("_no_status").alias("_no_status"),
        F.bool_and("_mask").alias("_mask"),
        F.bool_or("_draft").alias("_draft"),
    )
    rows = per_view.groupBy(task).agg(
        F.bool_or(F.col("_sources") > 1).alias("two"),
        F.bool_or("_no_status").alias("no_status"),
        F.bool_or(~F.col("_mask")).alias("no_mask"),
        F.bool_or("_draft").alias("draft"),
    )
    reason = (
        F.when(F.col("two"), "two_sources").when(F.col("no_status"), "missing_status").when(F.col("no_mask"), "missing_mask").when(F.col("draft"), "active_draft")
    )
    return rows.select(task, reason.alias("reason"))


# --- shards, trajectories, records --------------------------------------------------------------------


def audit_shards(members: DataFrame, index: DataFrame, per_sample: int = 3) -> DataFrame:
    """Samples without exactly ``per_sample`` members, keys used twice, samples without index row or
    index rows without sample, missing digests.  ``members``: sample, member.  ``index``: sample, digest."""
    m = members.groupBy("sample").agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("member").alias("_d"))
    i = index.groupBy("sample").agg(F.count(F.lit(1)).alias("_i"), F.count("digest").alias("_g"))
    rows = m.join(i, "sample", "full_outer")
    c = lambda x: F.coalesce(F.col(x), F.lit(0))
    checks = F.array(
        F.when(c("_n") != c("_d"), "duplicate_member"),
        F.when(c("_d") != per_sample, "member_count"),
        F.when(c("_i") == 0, "no_index_row").when(c("_i") > 1, "duplicate_index_row"),
        F.when(c("_n") == 0, "index_without_sample"),
        F.when(c("_g") < c("_i"), "no_digest"),
    )
    found = rows.select("sample", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("check"))
    return found.select("check", F.col("sample").cast("string").alias("subject"), F.lit("").alias("detail"))


def audit_trajectories(views: DataFrame, key: Sequence[str], h: int, w: int) -> DataFrame:
    """Trajectories whose video and mask lengths differ, whose size is not ``h x w`` or whose masks are not binary.

    ``views``: keys, video_frames, mask_frames, h, w, mask_max.
    """
    subject = F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("subject")
    checks = F.array(
        F.when(F.min(F.least("video_frames", "mask_frames")) != F.max(F.greatest("video_frames", "mask_frames")), "length"),
        F.when(F.bool_or((F.col("h") != h) | (F.col("w") != w)), "frame_size"),
        F.when(F.max("mask_max") > 1, "not_binary"),
    )
    rows = views.groupBy(*key).agg(checks.alias("_c")).select(subject, F.explode(F.filter("_c", lambda x: x.isNotNull())).alias("check"))
    return rows.select("check", "subject", F.lit("").alias("detail"))


def audit_records(df: DataFrame, key: str, required: Sequence[str], equal_lengths: Sequence[str] = ()) -> DataFrame:
    """Null required fields and annotation lists of unequal length."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"null:{c}")) for c in required]
    if equal_lengths:
        sizes = [F.coalesce(F.size(c), F.lit(-1)) for c in equal_lengths]
        checks += [F.when(s != sizes[0], F.lit(f"length:{c}")) for s, c in zip(sizes[1:], equal_lengths[1:])]
    rows = df.select(F.col(key).cast("string").alias("subject"), F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("check"))
    return rows.select("check", "subject", F.lit("").alias("detail"))


def audit_totals(df: DataFrame, observed: Mapping[str, Column], expected: Mapping[str, int]) -> DataFrame:
    """Named totals that miss their expected value."""
    row = df.agg(*[c.cast("bigint").alias(n) for n, c in observed.items()])
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("got"), F.lit(int(expected[n])).cast("bigint").alias("want")) for n in observed])
    rows = row.select(F.inline(items)).filter(~F.col("got").eqNullSafe(F.col("want")))
    return rows.select(*finding("total", "name", F.concat_ws(" vs ", F.coalesce(F.col("got").cast("string"), F.lit("null")), F.col("want").cast("string"))))


def audit_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Non-finite or out-of-range metric values, and duplicated ids."""
    subject = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    bad = lambda m: F.col(m).isNull() | F.isnan(m) | ~F.col(m).between(lo, hi)
    checks = F.array(*[F.when(bad(m), F.lit(m)) for m in metrics])
    values = df.select(subject.alias("subject"), F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("detail"))
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return values.select(F.lit("value").alias("check"), "subject", "detail").unionByName(
        dup.select(F.lit("duplicate").alias("check"), subject.alias("subject"), F.col("_n").cast("string").alias("detail"))
    )


def audit_one_object(lattice: DataFrame, metrics: Sequence[str] = ("iou", "dice"), tolerance: float = 1e-12) -> DataFrame:
    """With one object per pair the three aggregations must agree."""
    far = lambda a, b: F.abs(F.col(a) - F.col(b)) > tolerance
    one = lattice.filter(F.col("n_pairs") == F.col("n_objects"))
    parts = [
        one.filter(far(f"stock_{m}", f"perobject_{m}") | far(f"perobject_{m}", f"perpair_{m}")).select(*finding("one_object", F.lit(m)))
        for m in metrics
    ]
    return union_all(parts)


def verify_digests(files: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Missing and unlisted files, and files whose size or SHA-256 differs from the manifest."""
    f = files.select(key, F.col("bytes").alias("_fb"), F.col("sha").alias("_fs"))
    m = manifest.select(key, F.col("bytes").alias("_mb"), F.col("sha").alias("_ms"))
    rows = f.join(m, key, "full_outer")
    check = (
        F.when(F.col("_fs").isNull(), "missing")
        .when(F.col("_ms").isNull(), "unlisted")
        .when(F.col("_fb") != F.col("_mb"), "size")
        .when(F.col("_fs") != F.col("_ms"), "digest")
    )
    return rows.withColumn("check", check).filter(F.col("check").isNotNull()).select(
        "check", F.col(key).cast("string").alias("subject"), F.lit("").alias("detail")
    )


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha) of every file below ``path`` whose name fits ``glob``; each file is hashed inside a task, piece by piece.

    A digest takes a file's bytes in order, so a file is one task's work, but never more than a piece of it is held:
    files of any size are hashed in the same memory.  Spark's listing leaves out empty files.  Python reads them
    (see ``sightline.sources.file_pieces``).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    listed = files.select("path", F.col("length").alias("bytes"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(tasks, "path").mapInArrow(hashed_files, "path string, bytes long, sha string")
