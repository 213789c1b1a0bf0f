"""Benchmark decontamination as a prefix-filtered set join (native).

A window of an item is a set of positioned word shingles, and an occurrence must contain all of them,
so the necessary prefix is a single shingle: the one that is rarest over all documents.  One pass over
the texts keeps the positions of shingles that benchmark windows have at all and counts them; windows
with a shingle that no document has are out, the others look only where their rarest shingle is.  Its
position fixes where the window would start (positional bound) and the document must be long enough
(length bound); then every other shingle has to stand at its own position, which is the exact check.

Shingles are compared by two 64-bit hashes of their words under different seeds: among N shingles the chance of
any wrong equality is below N^2 / 2^129.  Only these numbers leave the task that split a text, never its words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.common import lower_ascii, row_key, saved, small_side, unused

WINDOW, SHINGLE = 10, 5
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # in lower-cased text


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Windows of the items: ``item_id, wid, length, k, words``; a shorter item is one window, one without words has none."""
    w = items.select("item_id", _words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.lit(window), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    w = w.select("item_id", "w", length.alias("length"), F.explode(starts).alias("start"))
    w = w.select("item_id", "length", F.least(F.lit(shingle), F.col("length")).alias("k"), F.slice("w", F.col("start"), F.col("length")).alias("words"))
    return w.select("item_id", F.xxhash64("words").alias("wid"), "length", "k", "words")


def _digests(words: Column, at: Column | int, k: int) -> list[Column]:
    """Two hashes of the ``k`` words from ``at`` on; the second one starts from another seed."""
    picked = [F.get(words, F.lit(at + i) if isinstance(at, int) else at + i) for i in range(k)]
    return [F.xxhash64(*picked), F.xxhash64(F.lit(SHINGLE), *picked)]


def shingle_hits(docs: DataFrame, shingles: DataFrame, ks: list[int]) -> DataFrame:
    """Positions of the benchmark's shingles (``k, sid, check``) in whole texts, and a row at -1 for every row of ``docs``.

    Returns ``doc_id, _key, n, pos, sid``; the id is on the rows at -1 only.  ``ks`` are the shingle lengths
    that occur, usually one, so that the texts are split into words once.
    """
    words = docs.select("doc_id", *row_key("doc_id", "text"), _words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    parts = []
    for k in ks or [SHINGLE]:
        first = -1 if not parts else 0
        rows = words if first else words.filter(F.col("n") >= k)
        rows = rows.select("doc_id", "_key", "w", "n", F.explode(F.sequence(F.lit(first), F.greatest(F.lit(first), F.col("n") - k))).alias("pos"))
        digest, again = (F.when(F.col("pos") >= 0, d) for d in _digests(F.col("w"), F.col("pos"), k))
        digest = F.coalesce(digest, "_key")  # rows at -1 match nothing, but must not share a key
        rows = rows.select(F.when(F.col("pos") == -1, F.col("doc_id")).alias("doc_id"), "_key", "n", "pos", digest.alias("digest"), again.alias("again"))
        known = small_side(shingles.filter(F.col("k") == k).select("sid", "check"))
        hits = rows.join(known, (F.col("digest") == F.col("sid")) & (F.col("again") == F.col("check")), "left").filter("pos = -1 or sid is not null")
        parts.append(hits.select("doc_id", "_key", "n", "pos", "sid"))
    return reduce(DataFrame.union, parts)


def window_occurrences(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, _key, n`` of all texts, and every occurrence ``_key, start, length, wid`` of a window."""
    distinct = windows.dropDuplicates(["wid"]).drop("item_id")
    at = F.sequence(F.lit(0), F.col("length") - F.col("k"))
    grams = distinct.select("wid", "length", "k", "words", F.explode(at).alias("j"))
    grams = grams.withColumn("gram", F.slice("words", F.col("j") + 1, F.col("k")))
    ks = [r["k"] for r in distinct.select("k").distinct().collect()]  # at most SHINGLE numbers
    # the hashes of the words one by one, as on the side of the documents (a constant where there are no items)
    both = [F.coalesce(*[F.when(F.col("k") == k, _digests(F.col("gram"), 0, k)[i]) for k in ks], F.lit(0)) for i in range(2)]
    grams = saved(grams.select("wid", "length", "k", "j", both[0].alias("sid"), both[1].alias("check")))
    shingles = grams.select("k", "sid", "check").distinct()

    read = saved(shingle_hits(docs, shingles, ks))
    rows = read.filter("pos = -1").select("doc_id", "_key", "n")
    hits = read.filter("pos >= 0").select("_key", "n", "pos", "sid").distinct()

    rarity = hits.groupBy("sid").agg(F.count("*").alias("count"))
    ranked = grams.join(small_side(rarity), "sid", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    prefix = F.min(F.struct("count", "j", "sid")).alias("rarest")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("j", "sid"))), lambda x: x["sid"]).alias("sids")
    needed = ranked.groupBy("wid", "length", "k").agg(prefix, ordered).filter("rarest.count > 0")
    needed = saved(needed.select("wid", "length", "sids", F.col("rarest.sid").alias("sid"), F.col("rarest.j").alias("j")))

    found = hits.join(small_side(needed), "sid").withColumn("start", F.col("pos") - F.col("j"))
    found = found.filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n")))
    asked = found.select("_key", "start", "length", "wid", F.size("sids").alias("want"), F.posexplode("sids").alias("i", "sid"))
    asked = asked.withColumn("pos", F.col("start") + F.col("i")).drop("i")
    there = asked.join(hits.select("_key", "pos", "sid"), ["_key", "pos", "sid"])
    whole = there.groupBy("_key", "start", "length", "wid").agg(F.count("*").alias("have"), F.first("want").alias("want"))
    return rows, whole.filter("have = want").select("_key", "start", "length", "wid")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Benchmark words in each text: one row per row of ``docs`` (needs ``doc_id, text``).

    Returns ``doc_id, _key, n_words, n_hit, item_ids, contaminated``; ``item_ids`` holds the items with
    occurring windows as sorted strings.  ``items`` needs ``item_id, text``.  Null texts have no words
    and no hits; an item without an id hits but is not listed; repeated rows each get the same result;
    an empty benchmark or corpus gives no hits or no rows.
    """
    windows = saved(item_windows(items, window))
    rows, found = window_occurrences(docs, windows)
    found = saved(found)

    by = Window.partitionBy("_key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("_key", "start", "length").distinct()
    spans = spans.withColumn("end", F.col("start") + F.col("length")).withColumn("before", F.coalesce(F.max("end").over(by), F.lit(0)))
    gained = F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))
    hit = spans.groupBy("_key").agg(F.sum(gained).alias("n_hit"))
    owners = windows.select("wid", F.col("item_id").cast("string").alias("item")).distinct()
    named = found.select("_key", "wid").distinct().join(small_side(owners), "wid")
    named = named.groupBy("_key").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    results = hit.join(named, "_key")

    out = rows.join(results, "_key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "_key", F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), (n_hit > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with their columns as they are."""
    name = unused("_hit", docs)
    hit = contamination(docs, items, window).filter("contaminated").select(F.col("_key").alias(name)).distinct()
    return docs.join(small_side(saved(hit)), row_key("doc_id", "text")[0] == F.col(name), "left_anti")
