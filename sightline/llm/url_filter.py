"""URL filters by expression expansion (native).

Every URL becomes the expressions host suffix + path prefix that a rule could be written as.  They
meet the rules on a short prefix of the expression's SHA-256, the full digest confirms, and of the
rules that fit the longest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import lower_ascii, saved, small_side, unused

SHORT = 8  # hex digits of the digest that are joined on


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules ``host, path, verdict`` with the digest of their expression; of equal rules a block wins."""
    text = F.concat_ws("\n", "host", "path")
    keyed = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("digest", F.sha2(text, 256))
    return keyed.select(
        F.substring("digest", 1, SHORT).alias("short"), "digest", "verdict", F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"),
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_len"),
    )


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge each row's ``url``; all columns stay, ``host, path, rule, verdict`` are added (replacing theirs).

    A rule fits its host and all subdomains if the path starts with the rule's path.  The longest
    expression wins, then the longer host; without a fitting rule the verdict is ``default``.  Only
    suffixes with as many labels and prefixes as long as some rule has are expanded, so a URL makes at
    most (label counts x path lengths) expressions, however long it is.  Null or odd URLs have an empty
    host and path and fit no rule.
    Repeated rows and repeated ids are judged one by one: a row's own array of expressions meets the
    rules, and a key per distinct (host, path) carries the answer back.
    """
    keyed = rule_table(rules)
    # label counts and path lengths that rules have: a handful of integers, bounded by the rules' own text
    shape = keyed.agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("path_len")).alias("lengths")).first()
    labels, lengths = list(shape["labels"] or []), list(shape["lengths"] or [])
    host, path = split_url(F.col("url"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    if not labels:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # a suffix of n labels exists if the host has as many; a prefix if the path is as long
    n_labels = F.size(F.split("host", r"\."))
    suffixes = F.array(*[F.when(n_labels >= n, F.substring_index("host", ".", -n)) for n in labels])
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    suffixes, prefixes = (F.filter(a, lambda x: x.isNotNull()) for a in (suffixes, prefixes))
    told = rows.select("host", "path").distinct().select("host", "path", suffixes.alias("s"), prefixes.alias("p"))
    told = told.select("host", "path", F.explode("s").alias("suffix"), "p").select("host", "path", "suffix", F.explode("p").alias("prefix"))
    told = told.withColumn("digest", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256))
    told = told.select("host", "path", F.substring("digest", 1, SHORT).alias("short"), F.col("digest").alias("full"))
    fits = told.join(small_side(keyed), "short").filter(F.col("full") == F.col("digest"))
    rank = F.struct(F.length("rule").alias("n"), "host_len", "rule", "verdict")
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    h, p = unused("_h", rows), unused("_p", rows)
    # written, so that a URL of very many pages can be split in the join; its files compress too well to judge its size by
    best = saved(best.select(F.col("host").alias(h), F.col("path").alias(p), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")))
    out = rows.join(best.hint("merge"), (F.col("host") == F.col(h)) & (F.col("path") == F.col(p)), "left")
    return out.select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
