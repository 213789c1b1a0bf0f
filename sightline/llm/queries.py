"""One registered query per operator, with production parameters, and the SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import (
    decontamination,
    hard_negatives,
    mixing,
    ngram_join,
    pii,
    secret_scan,
    spelling,
    token_counts,
    token_files,
    topk,
    toxicity,
    url_filter,
    warc,
)
from sightline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


_WORD_SQL = r"[^\x20\x09-\x0D]+"

OP1_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, md5('0:' || coalesce(doc_id::VARCHAR, ':' || md5(coalesce(text, '')))) AS key,
    coalesce(len(regexp_extract_all(text, '{_WORD_SQL}')), 0)::BIGINT AS size FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
  w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0 * source_size AS room FROM s),
  steps AS (SELECT 0 AS round, source, weight, room, false AS filled, (SELECT 1.5 * sum(source_size) FROM s)::DOUBLE AS budget FROM w
    UNION ALL
    SELECT round + 1, source, weight, room, filled OR over, budget - sum(CASE WHEN over AND NOT filled THEN room ELSE 0 END) OVER ()
    FROM (SELECT *, NOT filled AND weight * budget / sum(CASE WHEN filled THEN 0 ELSE weight END) OVER () > room AS over FROM steps)
    WHERE round < 40),
  t AS (SELECT source, CASE WHEN filled THEN room ELSE weight * budget / sum(CASE WHEN filled THEN 0 ELSE weight END) OVER () END AS target FROM steps WHERE round = 40),
  p AS (SELECT s.source, s.source_size, t.target, CASE WHEN s.source_size > 0 THEN floor(t.target / s.source_size)::BIGINT ELSE 0 END AS whole
    FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
  r AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, floor(p.target)::BIGINT - p.whole * p.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (whole * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM r"""


@register(OP1_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

OP10_SQL = r"""
WITH rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
  a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
  c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path, row_number() OVER () AS n FROM b),
  m AS (SELECT n, max({'len': length(rh) + length(rp), 'rule': rh || rp, 'v': v}) AS best
    FROM c JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM c LEFT JOIN m USING (n)"""


@register(OP10_SQL)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


@register()
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@register()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_texts(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted)


_TERM_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_TERM_SQL}, []) AS w FROM documents),
  i AS (SELECT item_id, {_TERM_SQL} AS w FROM benchmark),
  iw AS (SELECT item_id, least(10, len(w)) AS size, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
  dw AS (SELECT r, s, size, array_to_string(w[s:s + size - 1], ' ') AS win
    FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM iw))),
  o AS (SELECT DISTINCT r, s, iw.size, item_id FROM dw JOIN iw USING (win)),
  h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS p FROM o) GROUP BY 1),
  n AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM o GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)"""


@register(OP3_SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), listed, "contaminated")


def _span_list(spans) -> Column:
    """kind:start:end, comma-joined in the given order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


@register()
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs), keep=["doc_id"])
    by_rule = F.filter("spans", lambda x: x["kind"] != "tagged")
    counts = [_count_of(k) for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(_span_list(by_rule), 256).alias("base_sha256"), _span_list(F.col("spans")).alias("spans"))


@register()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, str(public_tokenizers.path("byte_bpe_50k.json")), limit=512, keep=["doc_id"])


OP8_SQL = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


@register(OP8_SQL)
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double"))
    clean = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    vectors = table(spark, sf_dir, "embeddings").filter(clean).select("vec_id", whole.alias("v"))
    return topk.top_products(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
  h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY sha1(body)) AS first FROM p),
  b AS (SELECT *, list_reduce([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)
      FOR i IN range(32)], lambda x, y: x || y) AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""


@register(OP5_SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


@register()
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    by_rule = F.filter("spans", lambda x: x["kind"] != "term")
    counts = [_count_of(k) for k in pii.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(_span_list(by_rule), 256).alias("base_sha256"), _span_list(F.col("spans")).alias("spans"))


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
    FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
  h AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 3"""


@register(OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    clean = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").filter(clean).select("vec_id", label.alias("label"), whole.alias("v"))
    return hard_negatives.mine(rows, anchor_every=50, positives=5, negatives=3, low=50, high=95)


@register()
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = token_files.write_tokens(docs, str(public_tokenizers.path("word_bpe_49k.json")), end=1)
    return token_files.checksums(token_files.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids"))


# levenshtein compares bytes there, so letters above ASCII become capitals, digits and marks, which lower-cased words lack
OP13_SQL = r"""
WITH RECURSIVE bits(b, c, i) AS (SELECT b, b, 0 FROM range(256) t(b) UNION ALL
    SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM bits WHERE i < 8),
  crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE i = 8),
  r AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents) GROUP BY 1, 2),
  k AS (SELECT w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM r),
  b AS (SELECT w, n, [('0x' || substr(x, 2 * i + 1, 2))::BIGINT FOR i IN range(length(x) // 2)] AS bytes FROM k),
  h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) AS h FROM b, crc),
  e AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS w, n FROM h),
  c AS (SELECT w AS word, sum(n)::BIGINT AS n FROM e WHERE length(w) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
  a AS (SELECT word, n, length(word) AS len, translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!"#$%&()*+,-./:;<=>?@[]^_{|}') AS ascii FROM c),
  l AS (SELECT x.word, y.word AS near, y.n AS near_n FROM a x JOIN a y ON x.word <> y.word AND y.len BETWEEN x.len - 1 AND x.len + 1 AND levenshtein(x.ascii, y.ascii) = 1),
  f AS (SELECT c.word, c.n, count(l.near) AS n_near, min({'k': -near_n, 'w': near}) AS best FROM c LEFT JOIN l ON l.word = c.word GROUP BY 1, 2),
  o AS (SELECT word, n, n_near, CASE WHEN n_near > 0 AND -best.k >= 5 * n THEN best.w END AS form, CASE WHEN n_near > 0 AND -best.k >= 5 * n THEN -best.k END AS form_n FROM f),
  u(word, here, d) AS (SELECT word, word, 0 FROM o UNION ALL SELECT u.word, o.form, d + 1 FROM u JOIN o ON o.word = u.here WHERE o.form IS NOT NULL),
  z AS (SELECT word, arg_max(here, d) AS root FROM u GROUP BY 1)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM o JOIN z USING (word)"""


@register(OP13_SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), least=5, shortest=6, one_in=199)
    return spelling.variant_groups(words, ratio=5)
