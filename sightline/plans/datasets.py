"""Building datasets: unions, holdouts, sampling, packing, resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions.columns import shard_of
from sightline.operators import selection as L
from sightline.operators import splits as T
from sightline.plans.registry import r6, register
from sightline.plans.tables import TAKES_SQL, table, takes
from sightline.session import published
from sightline.sources.scans import parse_path_list
from sightline.sources.sinks import exclude, pending

_JOINT_SQL = f"""{TAKES_SQL}, joint AS (SELECT o_orderkey, take, cam, 'ego2exo' AS direction FROM takes WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, take, cam, 'exo2ego' FROM takes WHERE o_orderstatus <> 'F')"""


def _joint(spark, d):
    rows = takes(spark, d)
    a = rows.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "take", "cam")
    b = rows.filter(F.col("o_orderstatus") != "F").select("o_orderkey", "take", "cam")
    return T.joint_union(a, b, ("ego2exo", "exo2ego"))


@register(
    "mix_ratio",
    "G01 I02",
    f"WITH {_JOINT_SQL} SELECT direction, count(*) AS rows, round(count(*)::DOUBLE / (SELECT count(*) FROM joint), 6) AS probability FROM joint GROUP BY 1",
)
def mix_ratio(spark, d):
    return T.mix_ratio(_joint(spark, d)).select("direction", "rows", r6("probability"))


@register(
    "balance",
    "I03",
    f"""WITH {_JOINT_SQL}, s AS (SELECT direction, count(*) AS size FROM joint GROUP BY 1), m AS (SELECT max(size) AS n FROM s),
      r AS (SELECT j.*, s.size, row_number() OVER (PARTITION BY j.direction ORDER BY md5(o_orderkey || '|3'), o_orderkey) - 1 AS pos FROM joint j JOIN s USING (direction))
    SELECT direction, o_orderkey, CAST(n // size + CASE WHEN pos < n % size THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r, m""",
)
def balance(spark, d):
    out = T.balance(_joint(spark, d), ["o_orderkey"], seed=3, portable=True)
    return out.groupBy("direction", "o_orderkey").agg(F.count(F.lit(1)).alias("copies"))


@register(
    "subset",
    "I04",
    f"""WITH {_JOINT_SQL} SELECT direction, o_orderkey FROM joint WHERE CAST('0x' || substr(md5(o_orderkey || '|11'), 1, 12) AS BIGINT) % 20 = 0""",
)
def subset(spark, d):
    return T.subset(_joint(spark, d), ["o_orderkey"], 20, seed=11, portable=True).select("direction", "o_orderkey")


@register(
    "group_holdout",
    "I01",
    """WITH s AS (SELECT o_custkey, count(*) AS size, md5(o_custkey || '|5') AS o FROM orders GROUP BY 1),
      c AS (SELECT *, sum(size) OVER (ORDER BY o, o_custkey) AS upto FROM s)
    SELECT o_custkey, size, upto - size < 500 AS held_out FROM c""",
)
def group_holdout(spark, d):
    return T.group_holdout(table(spark, d, "orders"), "o_custkey", 500, seed=5, portable=True)


@register(
    "shared_keys",
    "G05 I01",
    """WITH s AS (SELECT o_custkey, count(*) AS size, md5(o_custkey || '|5') AS o FROM orders GROUP BY 1),
      c AS (SELECT *, sum(size) OVER (ORDER BY o, o_custkey) AS upto FROM s), h AS (SELECT o_custkey, upto - size < 500 AS held FROM c)
    SELECT (SELECT count(*) FROM orders JOIN h USING (o_custkey) WHERE held) AS held_rows, 0::BIGINT AS shared_groups,
      (SELECT count(*) FROM (SELECT o_custkey FROM orders JOIN h USING (o_custkey) WHERE held GROUP BY 1 HAVING bool_or(o_orderpriority = '1-URGENT') AND bool_or(o_orderpriority <> '1-URGENT'))) AS seeded_groups,
      (SELECT count(*) FROM (SELECT DISTINCT o_orderpriority FROM orders)) AS shared_priorities""",
)
def shared_keys(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority")
    assigned = published(T.group_holdout(orders, "o_custkey", 500, seed=5, portable=True))  # the split
    rows = orders.join(assigned, "o_custkey")
    held, rest = rows.filter("held_out"), rows.filter("NOT held_out")
    n = lambda keys: T.shared_keys(held, rest, keys).agg(F.count(F.lit(1))).scalar()
    out = held.agg(F.count(F.lit(1)).alias("held_rows"))
    # a leak: the urgent orders of held-out customers on the other side
    urgent = F.col("o_orderpriority") == "1-URGENT"
    leaked = T.shared_keys(held.filter(~urgent), held.filter(urgent), ["o_custkey"]).agg(F.count(F.lit(1))).scalar()
    return out.withColumns({"shared_groups": n(["o_custkey"]), "seeded_groups": leaked, "shared_priorities": n(["o_orderpriority"])})


_OBJ = "SELECT DISTINCT o_custkey AS record, o_orderkey AS obj FROM orders"


@register(
    "sample_objects",
    "I05",
    f"""WITH o AS ({_OBJ}) SELECT record, obj, draw FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY md5(record || '|' || obj || '|9'), obj) - 1 AS draw FROM o) WHERE draw < 3""",
)
def sample_objects(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderkey").alias("obj"))
    return T.sample_objects(rows, ["record"], "obj", 3, replace=False, seed=9, portable=True)


@register(
    "sample_objects_replace",
    "I05",
    f"""WITH o AS ({_OBJ}), p AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY md5(record || '|' || obj || '|9'), obj) - 1 AS pos FROM o),
      k AS (SELECT record, count(*) AS k FROM o GROUP BY 1), dr AS (SELECT record, u.draw, CAST('0x' || substr(md5(record || '|' || u.draw || '|10'), 1, 12) AS BIGINT) % k AS pos FROM k, unnest(range(4)) u(draw))
    SELECT dr.record, p.obj, dr.draw FROM dr JOIN p ON p.record = dr.record AND p.pos = dr.pos""",
)
def sample_objects_replace(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderkey").alias("obj"))
    return T.sample_objects(rows, ["record"], "obj", 4, replace=True, seed=9, portable=True)


@register(
    "mismatch_partner",
    "I06",
    """WITH o AS (SELECT DISTINCT l_partkey AS obj, l_orderkey AS frame FROM lineitem), s AS (SELECT *, md5(obj || '|' || frame || '|2') AS h FROM o),
      n AS (SELECT obj, frame, lead(frame) OVER w AS nx, first_value(frame) OVER w AS fv FROM s WINDOW w AS (PARTITION BY obj ORDER BY h, frame))
    SELECT obj, frame, CASE WHEN nx IS NOT NULL THEN nx WHEN fv <> frame THEN fv END AS partner FROM n""",
)
def mismatch_partner(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("obj"), F.col("l_orderkey").alias("frame"))
    return T.mismatch_partner(rows, "obj", "frame", seed=2, portable=True)


@register("shard_of", "I07", "SELECT (l_orderkey // 100) % 4 AS shard, count(*) AS rows FROM lineitem GROUP BY 1")
def shards(spark, d):
    rows = table(spark, d, "lineitem").select(shard_of(F.floor(F.col("l_orderkey") / 100), 4).alias("shard"))
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))


@register(
    "smoke_subset",
    "I08 F11",
    """WITH s AS (SELECT o_custkey, o_orderkey FROM orders ORDER BY 1, 2 LIMIT 100) SELECT o_custkey, o_orderkey, (SELECT count(*) FROM s WHERE o_orderkey % 3 = 0) AS outside FROM s""",
)
def smoke_subset(spark, d):
    full = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    part = T.smoke_subset(full, ["o_custkey", "o_orderkey"], 100)
    # a third of the subset under keys that the table lacks
    strayed = part.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey")))
    outside = T.contained(strayed, full, ["o_custkey", "o_orderkey"]).agg(F.count(F.lit(1))).scalar()
    return part.withColumn("outside", outside)


@register(
    "canonical_order",
    "F11",
    "SELECT o_custkey, count(*) AS rows, min(o_orderkey) AS first_order FROM orders GROUP BY 1",
)
def canonical_order(spark, d):
    rows = L.canonical_order(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"])
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    return placed.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("rows"), F.min_by("o_orderkey", "_at").alias("first_order"))


@register(
    "reverse_overlap",
    "C12",
    f"""WITH {TAKES_SQL}, r AS (SELECT take AS obj, cam AS source, 'cam' || ((CAST(substr(cam, 4) AS INT) + o_orderkey % 4 + 1) % 5) AS target, o_orderstatus FROM takes),
      t AS (SELECT DISTINCT target AS source, source AS target, obj FROM r WHERE o_orderstatus = 'F'), e AS (SELECT r.*, t.obj IS NOT NULL AS rev FROM r LEFT JOIN t USING (source, target, obj) WHERE o_orderstatus <> 'F')
    SELECT count(*) AS rows, count(*) FILTER (rev) AS reversed, round(count(*) FILTER (rev)::DOUBLE / count(*), 6) AS share FROM e""",
)
def reverse_overlap(spark, d):
    nxt = (F.substring("cam", 4, 1).cast("int") + F.col("o_orderkey") % 4 + 1) % 5
    rows = takes(spark, d).select(
        F.col("take").alias("obj"), F.col("cam").alias("source"), F.concat(F.lit("cam"), nxt.cast("string")).alias("target"), "o_orderstatus"
    )
    train = rows.filter(F.col("o_orderstatus") == "F")
    out = T.reverse_overlap(rows.filter(F.col("o_orderstatus") != "F"), train, "source", "target", "obj")
    return out.select("rows", "reversed", r6("share"))


@register(
    "round_robin",
    "E07",
    """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round FROM documents)
    SELECT source, doc_id, round FROM r ORDER BY round, md5(source || '|4'), source LIMIT 70""",
)
def round_robin(spark, d):
    return L.round_robin(table(spark, d, "documents").select("source", "doc_id"), "source", ["doc_id"], 70, seed=4, portable=True)


@register(
    "round_robin_uncovered",
    "E07",
    """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round FROM documents), c AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
    SELECT source, doc_id, round FROM r ORDER BY round, source IN (SELECT source FROM c), md5(source || '|4'), source LIMIT 25""",
)
def round_robin_uncovered(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id")
    covered = docs.join(table(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id").select("source")
    return L.round_robin(docs, "source", ["doc_id"], 25, seed=4, portable=True, covered=covered)


@register(
    "pack_shards",
    "E10",
    """WITH RECURSIVE c AS (SELECT page_id, length(html) AS bytes, row_number() OVER (ORDER BY url, page_id) AS i, sum(length(html)) OVER (ORDER BY url, page_id) AS upto FROM pages),
      s(shard, last, mark) AS (SELECT -1, 0::BIGINT, 0::HUGEINT UNION ALL
        SELECT shard + 1, min(i), min(upto) FROM s JOIN c ON upto >= mark + 50000 GROUP BY shard)
    SELECT page_id, bytes, (SELECT count(*) FROM s WHERE s.shard >= 0 AND s.last < c.i)::BIGINT AS shard FROM c""",
)
def pack_shards(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", F.length("html").cast("bigint").alias("bytes"))
    return L.pack_shards(rows, ["url", "page_id"], "bytes", 50_000).select("page_id", "bytes", "shard")


@register("pending", "A16", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_docs(spark, d):
    return pending(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"])


@register(
    "path_list",
    "A17",
    """WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '/+$', ''), '/') AS x FROM pages), l AS (SELECT x[1] AS subset, x[2] AS task, x[3] AS split FROM p WHERE page_id % 3 = 0)
    SELECT page_id, x[1] AS subset, x[2] AS task, x[3] AS split FROM p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.subset = p.x[1] AND l.task = p.x[2] AND l.split = p.x[3])""",
)
def path_list(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("value"))
    names = ("subset", "task", "split")
    parts = F.split(F.regexp_replace("value", "/+$", ""), "/")
    rows = pages.select("page_id", *[F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    return exclude(rows, parse_path_list(pages.filter("page_id % 3 = 0"), names=names), names)


@register(
    "referenced_frames",
    "G04",
    f"WITH {TAKES_SQL} SELECT DISTINCT take || '/' || cam AS image FROM takes",
)
def referenced_frames(spark, d):
    from sightline.operators.audit import all_refs

    rows = takes(spark, d).withColumn("image", F.concat_ws("/", F.col("take").cast("string"), "cam"))
    return all_refs([rows.filter("o_orderstatus = 'F'"), rows.filter("o_orderstatus <> 'F'")], "image")

