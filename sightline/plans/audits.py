"""Closures and data-quality findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import audit as A
from sightline.plans.cards import _REL_SQL, relation_table
from sightline.plans.registry import register
from sightline.plans.tables import MASK_SQL, mask_tables, table, view_pixels
from sightline.operators import masks as M
from sightline.session import published


@register(
    "closure",
    "C10",
    """WITH r AS (SELECT CASE WHEN doc_id % 40 <> 3 THEN doc_id END AS doc_id FROM documents)
    SELECT 'missing' AS "check", CAST(doc_id AS VARCHAR) AS subject, '' AS detail FROM r WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'malformed', CAST(doc_id AS VARCHAR), '' FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM r)
    UNION ALL SELECT 'null_reference', 'doc_id', CAST(count(*) AS VARCHAR) FROM r WHERE doc_id IS NULL""",
)
def closure(spark, d):
    refs = table(spark, d, "documents").select(F.when(F.col("doc_id") % 40 != 3, F.col("doc_id")).alias("doc_id"))
    return A.closure(refs, table(spark, d, "labels"), "doc_id", F.col("toxic") == 0)


@register(
    "jpeg_markers",
    "C10",
    """SELECT event_id, event_id % 3 = 0 AS ok FROM events""",
)
def jpeg_markers(spark, d):
    third = F.col("event_id") % 3
    body = F.hex(F.col("event_type"))
    text = F.when(third == 0, F.concat(F.lit("FFD8"), body, F.lit("FFD9"))).when(third == 1, F.concat(F.lit("FFD8"), body)).otherwise(F.concat(body, F.lit("FFD9")))
    return table(spark, d, "events").select("event_id", A.jpeg_ok(F.unhex(text)).alias("ok"))


@register(
    "schema_closure",
    "C11",
    """WITH e AS (SELECT 'layer' || (p_partkey % 9) || '.w' || p_partkey AS name, '[' || p_size || ', 8]' AS shape FROM part WHERE p_partkey % 17 <> 0),
      o AS (SELECT 'layer' || (p_partkey % 9) || '.w' || p_partkey AS name, '[' || CASE WHEN p_partkey % 23 = 0 THEN p_size + 1 ELSE p_size END || ', 8]' AS shape FROM part WHERE p_partkey % 19 <> 0)
    SELECT CASE WHEN o.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'unexpected' ELSE 'shape' END AS "check", coalesce(e.name, o.name) AS subject,
      coalesce(e.shape, '-') || ' vs ' || coalesce(o.shape, '-') AS detail FROM e FULL OUTER JOIN o ON e.name = o.name WHERE e.shape IS DISTINCT FROM o.shape""",
)
def schema_closure(spark, d):
    p = F.col("p_partkey")
    name = F.concat(F.lit("layer"), (p % 9).cast("string"), F.lit(".w"), p.cast("string"))
    rows = table(spark, d, "part").select("p_partkey", name.alias("name"), F.array("p_size", F.lit(8)).alias("shape"))
    seen = rows.withColumn("shape", F.when(p % 23 == 0, F.array(F.get("shape", F.lit(0)) + 1, F.lit(8))).otherwise(F.col("shape")))
    return A.schema_closure(rows.filter(p % 17 != 0), seen.filter(p % 19 != 0))


@register("prefix_counts", "C11", "SELECT 'layer' || (p_partkey % 9) AS prefix, count(*) AS tensors FROM part GROUP BY 1")
def prefix_counts(spark, d):
    name = F.concat(F.lit("layer"), (F.col("p_partkey") % 9).cast("string"), F.lit(".w"), F.col("p_partkey").cast("string"))
    return A.prefix_counts(table(spark, d, "part").select(name.alias("name")))


@register(
    "append_only",
    "C14",
    """WITH m AS (SELECT max(doc_id) AS mx, min(doc_id) AS mn FROM documents)
    SELECT 'removed' AS "check", CAST(doc_id AS VARCHAR) AS subject, '' AS detail FROM documents, m WHERE doc_id % 97 = 5
    UNION ALL SELECT 'changed', CAST(doc_id AS VARCHAR), '' FROM documents WHERE doc_id % 89 = 3 AND doc_id % 97 <> 5
    UNION ALL SELECT 'not_contiguous', CAST(mx + 2 AS VARCHAR), (mx + 2) || '..' || (mx + 1 + (SELECT count(*) FROM labels)) FROM m""",
)
def append_only(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    i = F.col("doc_id")
    kept = docs.filter(i % 97 != 5).withColumn("n_chars", F.when(i % 89 == 3, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    last = docs.agg(F.max("doc_id")).scalar()
    # new ids start two after the last one: contiguous among themselves, but with a gap
    ranked = table(spark, d, "labels").select("doc_id")
    from sightline.operators.ordered import ordered_scan

    new = ordered_scan(ranked, ["doc_id"], ordinal="_n").select((last + 2 + F.col("_n")).alias("doc_id"))
    new = new.select("doc_id", F.lit("new").alias("source"), F.lit("xx").alias("lang"), F.lit(1).cast("bigint").alias("n_chars"))
    return A.append_only(docs, kept.unionByName(new), "doc_id", ["source", "lang", "n_chars"])


# --- relations --------------------------------------------------------------------------------


_IMG = "card || '/' || {v} || '/' || prompt_t"


@register(
    "audit_relations",
    "L01",
    f"""WITH {_REL_SQL}, {MASK_SQL}, r AS (SELECT *, card % 500 AS mid, {_IMG.format(v='source')} AS pi, CASE WHEN card % 13 <> 4 THEN {_IMG.format(v='target')} END AS ti FROM rel),
      img AS (SELECT DISTINCT card || '/' || view || '/' || t AS image, 8 AS h, CASE WHEN card % 12 = 0 THEN 9 ELSE 8 END AS w FROM viewpx WHERE card % 9 <> 0),
      f AS (SELECT 'key_differs' AS "check", pair_id AS subject FROM r WHERE card % 10 = 1
        UNION ALL SELECT 'missing', x FROM (SELECT DISTINCT x FROM (SELECT pi AS x FROM r UNION ALL SELECT ti FROM r)) WHERE x NOT IN (SELECT image FROM img)
        UNION ALL SELECT * FROM (SELECT 'null_reference', 'image' WHERE EXISTS (SELECT 1 FROM r WHERE ti IS NULL))
        UNION ALL SELECT 'mask_size', pair_id FROM r JOIN img ON img.image = r.ti WHERE img.w <> 8
        UNION ALL SELECT 'area', r.pair_id FROM r JOIN heads h ON h.mask_id = r.mid WHERE card % 8 = 2
        UNION ALL SELECT 'moment', pair_id FROM r WHERE card % 7 = 3)
    SELECT "check", count(*) AS n, min(subject) AS first_subject FROM f GROUP BY 1""",
)
def audit_relations(spark, d):
    headers, runs = mask_tables(spark, d)
    areas = M.mask_area(runs, headers)
    c = F.col("card")
    name = lambda v: F.concat_ws("/", c.cast("string"), F.col(v), F.col("prompt_t").cast("string"))
    rel = relation_table(spark, d).withColumns(
        {
            "video_id": F.when(c % 10 == 1, F.concat("pair_id", F.lit("_x"))).otherwise(F.col("pair_id")),
            "prompt_image": name("source"),
            "target_image": F.when(c % 13 != 4, name("target")),
            "target_t": F.when(c % 7 == 3, F.col("prompt_t") + 1).otherwise(F.col("prompt_t")),
            "mask_id": c % 500,
        }
    )
    stored = headers.select("mask_id", "area")
    rel = rel.join(stored, "mask_id", "left").withColumn("area", F.when(c % 8 == 2, F.col("area") + 1).otherwise(F.col("area")))
    rel = published(rel)  # the table that the checks read
    px = view_pixels(spark, d).filter(c % 9 != 0).withColumn("prompt_t", F.col("t"))
    images = px.select(name("view").alias("image"), F.lit(8).alias("h"), F.when(c % 12 == 0, 9).otherwise(8).alias("w")).distinct()
    found = A.audit_relations(rel, images, areas)
    return found.groupBy("check").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("first_subject"))


@register(
    "direction_sum",
    "L01",
    f"""WITH {_REL_SQL} SELECT 'direction_sum' AS "check", CAST(count(*) AS VARCHAR) AS subject, CAST(count(*) + 1 AS VARCHAR) AS detail FROM rel""",
)
def direction_sum(spark, d):
    from sightline.operators.quality import dataset_ledger

    rel = published(relation_table(spark, d))
    total = rel.agg(F.count(F.lit(1)) + 1).scalar()
    return A.audit_direction_sum(dataset_ledger(rel), total)


_DISP = "CASE WHEN o_orderstatus = 'F' THEN 'valid' WHEN o_orderstatus = 'O' THEN 'target_not_visible' ELSE 'reject' END"


def _tasks(spark, d):
    s = F.col("o_orderstatus")
    disp = F.when(s == "F", "valid").when(s == "O", "target_not_visible").otherwise("reject")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("task"), disp.alias("disposition"))


@register(
    "relations_by_disposition",
    "L02",
    f"""WITH t AS (SELECT o_orderkey AS task, {_DISP} AS disposition FROM orders), p(disposition, direction, source, target) AS (VALUES
      ('valid', 'ego2exo', 'ego', 'exo1'), ('valid', 'ego2exo', 'ego', 'exo2'), ('valid', 'exo2ego', 'exo1', 'ego'), ('valid', 'exo2ego', 'exo2', 'ego'), ('valid', 'exo2exo', 'exo1', 'exo2'),
      ('valid', 'exo2exo', 'exo2', 'exo1'), ('target_not_visible', 'exo2exo', 'exo1', 'exo2'), ('target_not_visible', 'exo2exo', 'exo2', 'exo1'))
    SELECT direction, source, target, count(*) AS relations, (SELECT count(*) FROM t WHERE disposition = 'valid' AND task % 7 = 0) AS asymmetric FROM t JOIN p USING (disposition) GROUP BY 1, 2, 3""",
)
def relations_by_disposition(spark, d):
    rel = A.relations_by_disposition(_tasks(spark, d))
    # every seventh task lacks one relation, which leaves its swap alone
    torn = rel.filter("NOT (task % 7 = 0 AND source = 'ego' AND target = 'exo1')")
    lonely = A.asymmetric(torn).agg(F.count(F.lit(1))).scalar()
    return rel.groupBy("direction", "source", "target").agg(F.count(F.lit(1)).alias("relations")).withColumn("asymmetric", lonely)


@register(
    "disposition_totals",
    "L02",
    f"""WITH t AS (SELECT o_orderkey AS task, {_DISP} AS disposition FROM orders)
    SELECT disposition, count(*) AS tasks, CAST(count(*) * CASE disposition WHEN 'valid' THEN 6 WHEN 'target_not_visible' THEN 2 ELSE 0 END AS BIGINT) AS relations,
      CAST(count(*) * CASE disposition WHEN 'valid' THEN 3 WHEN 'target_not_visible' THEN 2 ELSE 0 END AS BIGINT) AS masks FROM t GROUP BY disposition""",
)
def disposition_totals(spark, d):
    return A.masks_by_disposition(_tasks(spark, d))


@register(
    "quarantine",
    "L03",
    """WITH s AS (SELECT l_orderkey AS task, l_linenumber AS view, l_returnflag AS source, CASE WHEN l_partkey % 40 <> 0 THEN l_linestatus END AS status, l_quantity > 3 AS has_mask, l_tax = 0.08 AND l_quantity < 20 AS draft FROM lineitem),
      v AS (SELECT task, view, min(source) <> max(source) AS two, bool_or(status IS NULL) AS ns, bool_or(NOT has_mask) AS nm, bool_or(draft) AS dr FROM s GROUP BY 1, 2)
    SELECT task, CASE WHEN bool_or(two) THEN 'two_sources' WHEN bool_or(ns) THEN 'missing_status' WHEN bool_or(nm) THEN 'missing_mask' WHEN bool_or(dr) THEN 'active_draft' END AS reason FROM v GROUP BY 1""",
)
def quarantine(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("task"),
        F.col("l_linenumber").alias("view"),
        F.col("l_returnflag").alias("source"),
        F.when(F.col("l_partkey") % 40 != 0, F.col("l_linestatus")).alias("status"),
        (F.col("l_quantity") > 3).alias("has_mask"),
        ((F.col("l_tax") == 0.08) & (F.col("l_quantity") < 20)).alias("draft"),
    )
    return A.quarantine(rows)


# --- shards, trajectories, records -------------------------------------------------------------


@register(
    "audit_shards",
    "L04",
    """WITH m AS (SELECT l_orderkey AS sample, l_linenumber % 3 AS member FROM lineitem), i AS (SELECT o_orderkey AS sample, CASE WHEN o_orderkey % 11 <> 0 THEN 'x' END AS digest FROM orders WHERE o_orderkey % 13 <> 0
        UNION ALL SELECT o_orderkey, 'x' FROM orders WHERE o_orderkey % 29 = 0),
      a AS (SELECT sample, count(*) AS n, count(DISTINCT member) AS d FROM m GROUP BY 1), b AS (SELECT sample, count(*) AS i, count(digest) AS g FROM i GROUP BY 1),
      r AS (SELECT coalesce(a.sample, b.sample) AS sample, coalesce(n, 0) AS n, coalesce(d, 0) AS d, coalesce(i, 0) AS i, coalesce(g, 0) AS g FROM a FULL OUTER JOIN b ON a.sample = b.sample),
      f AS (SELECT 'duplicate_member' AS "check", sample FROM r WHERE n <> d UNION ALL SELECT 'member_count', sample FROM r WHERE d <> 3 UNION ALL SELECT 'no_index_row', sample FROM r WHERE i = 0
        UNION ALL SELECT 'duplicate_index_row', sample FROM r WHERE i > 1 UNION ALL SELECT 'index_without_sample', sample FROM r WHERE n = 0 UNION ALL SELECT 'no_digest', sample FROM r WHERE g < i)
    SELECT "check", count(*) AS n, min(CAST(sample AS VARCHAR)) AS first_subject FROM f GROUP BY 1""",
)
def audit_shards(spark, d):
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), (F.col("l_linenumber") % 3).alias("member"))
    o = F.col("o_orderkey")
    orders = table(spark, d, "orders").select("o_orderkey")
    index = orders.filter(o % 13 != 0).select(o.alias("sample"), F.when(o % 11 != 0, "x").alias("digest"))
    index = index.unionByName(orders.filter(o % 29 == 0).select(o.alias("sample"), F.lit("x").alias("digest")))
    return A.audit_shards(members, index).groupBy("check").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("first_subject"))


@register(
    "audit_trajectories",
    "L05",
    """WITH v AS (SELECT user_id, event_type, count(*) AS vf, count(*) - CASE WHEN user_id % 6 = 0 AND event_type = 'view' THEN 1 ELSE 0 END AS mf FROM events GROUP BY 1, 2),
      f AS (SELECT 'length' AS "check", user_id || '/' || event_type AS subject FROM v WHERE vf <> mf UNION ALL SELECT 'frame_size', user_id || '/' || event_type FROM v WHERE user_id % 9 = 0
        UNION ALL SELECT 'not_binary', user_id || '/' || event_type FROM v WHERE user_id % 14 = 0)
    SELECT "check", subject, '' AS detail FROM f""",
)
def audit_trajectories(spark, d):
    u = F.col("user_id")
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("video_frames"))
    short = F.when((u % 6 == 0) & (F.col("event_type") == "view"), 1).otherwise(0)
    views = n.withColumns(
        {
            "mask_frames": F.col("video_frames") - short,
            "h": F.lit(180),
            "w": F.when(u % 9 == 0, 321).otherwise(320),
            "mask_max": F.when(u % 14 == 0, 255).otherwise(1),
        }
    )
    return A.audit_trajectories(views, ["user_id", "event_type"], 180, 320)


@register(
    "audit_records",
    "L09",
    """WITH r AS (SELECT conv_id || '-' || turn AS subject, CASE WHEN turn % 5 = 2 THEN NULL ELSE role END AS role, len(string_split(text, ' ')) AS a, len(string_split(text, ' ')) + CASE WHEN conv_id % 7 = 1 THEN 1 ELSE 0 END AS b FROM conversations)
    SELECT 'null:role' AS "check", subject, '' AS detail FROM r WHERE role IS NULL UNION ALL SELECT 'length:marks', subject, '' FROM r WHERE a <> b""",
)
def audit_records(spark, d):
    words = F.split("text", " ")
    marks = F.when(F.col("conv_id") % 7 == 1, F.concat(words, F.array(F.lit("x")))).otherwise(words)
    rows = table(spark, d, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("record"),
        F.when(F.col("turn") % 5 != 2, F.col("role")).alias("role"),
        words.alias("words"),
        marks.alias("marks"),
    )
    return A.audit_records(rows, "record", ["role"], ["words", "marks"])


@register(
    "audit_totals",
    "L10",
    """WITH t AS (SELECT count(DISTINCT user_id) AS tr, count(*) AS s FROM events)
    SELECT 'total' AS "check", 'trajectories' AS subject, tr || ' vs 56566' AS detail FROM t WHERE tr <> 56566 UNION ALL SELECT 'total', 'samples', s || ' vs 14035692' FROM t WHERE s <> 14035692""",
)
def audit_totals(spark, d):
    rows = table(spark, d, "events")
    observed = {"trajectories": F.countDistinct("user_id"), "samples": F.count(F.lit(1)), "images_per_sample": F.max(F.lit(2))}
    return A.audit_totals(rows, observed, A.EXPECTED_TOTALS)


@register(
    "audit_metrics",
    "L11",
    """WITH m AS (SELECT l_orderkey, l_linenumber, l_discount * 12 AS iou FROM lineitem), f AS (SELECT 'value' AS "check", l_orderkey || '/' || l_linenumber AS subject, 'iou' AS detail FROM m WHERE iou > 1
      UNION ALL SELECT 'duplicate', l_orderkey || '/' || l_linenumber, CAST(count(*) AS VARCHAR) FROM m GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    SELECT "check", detail, count(*) AS n, min(subject) AS first_subject FROM f GROUP BY 1, 2""",
)
def audit_metrics(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 12).alias("iou"))
    found = A.audit_metrics(rows, ["l_orderkey", "l_linenumber"], ["iou"])
    return found.groupBy("check", "detail").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("first_subject"))


@register(
    "verify_digests",
    "L12",
    """WITH x AS (SELECT doc_id, sha256(text) AS sha, octet_length(encode(text)) AS bytes FROM documents)
    SELECT CASE WHEN doc_id % 31 = 0 THEN 'missing' WHEN doc_id % 37 = 0 THEN 'unlisted' WHEN doc_id % 41 = 0 THEN 'size' ELSE 'digest' END AS "check", CAST(doc_id AS VARCHAR) AS subject, '' AS detail
    FROM x WHERE (doc_id % 31 = 0) <> (doc_id % 37 = 0) OR (doc_id % 31 <> 0 AND doc_id % 37 <> 0 AND (doc_id % 41 = 0 OR doc_id % 43 = 0))""",
)
def verify_digests(spark, d):
    i = F.col("path")
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha"))
    manifest = files.filter(i % 37 != 0).withColumns(
        {"bytes": F.when(i % 41 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")), "sha": F.when(i % 43 == 0, "stale").otherwise(F.col("sha"))}
    )
    return A.verify_digests(files.filter(i % 31 != 0), manifest)


@register("file_digests", "L12")
def file_digests(spark, d):
    """Size and digest of the files of the given tables; no SQL engine lists the folder, the test hashes them by itself."""
    rows = A.file_digests(spark, d, "*.parquet")
    return rows.select(F.substring_index("path", "/", -1).alias("file"), "bytes", "sha")
