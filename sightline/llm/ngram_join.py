"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

1. *Sets.*  A text's distinct word shingles become sorted 64-bit hashes; a hash of the set is the
   text's node, so equal sets are one row of the incidence from here on.
2. *Blocks.*  Incidence entries go to blocks of n-gram hashes as packed arrays.  A block finds the
   n-grams that two nodes hold at least, the only columns with a product off the diagonal.
3. *Bounds.*  Back by node, a set of ``n`` needs ``ceil(t n)`` shared n-grams to reach similarity ``t``
   with anything; smaller ones are discarded.  Of the others only the rarest n-grams, the prefix, have
   to meet: the first of ``a`` common n-grams is at a rank of ``shared - a`` at most in both sets.
4. *Product.*  Overlap counts of pairs accumulate over the ranks that their sizes allow.  Pairs whose
   count and remaining ranks stay below what their sizes demand go, and the rest is decided on the
   whole sets of shared n-grams.

Large groups: before the product, in a few rounds, each node is compared with the pivot that it shares
most of its prefix with, one pivot per n-gram: the most central set, of which least is its own.  That is
linear in the incidence, and links found make classes; the product then takes only pairs from different
classes, whose links can still change a class.  N-grams that a sample of sets shows to be in
many documents are not gathered in a block but pass straight to their nodes.  That list only steers
where rows go and the order of rarity; it is the same everywhere, so results do not depend on it.

Two sets are taken for equal if their 64-bit hashes are, and two n-grams if 48 bits and the block are: for
N sets the chance of any wrong equality is below N^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import components, row_key, saved, small_side, unused
from sightline.llm.hashing import hashed_words, release, shingle_sets

#: Similarity as a fraction, 3/4.
NUM, DEN = 3, 4
SHINGLE = 5
ENTRIES_PER_BLOCK = 1_000_000
#: A task sends so many entries at a time.
ENTRIES_PER_SEND = 500_000
#: One set in SAMPLE is looked at for n-grams in at least 1/HOT of the sampled documents; at most HOT_MOST are listed.
SAMPLE, HOT, HOT_MOST = 64, 200, 100_000
PIVOT_ROUNDS = 3
_LOW = np.uint64((1 << 48) - 1)
_HOT_BLOCK, _HOT_DF = 0xFFFF, 0xFFFF


def _node(grams: np.ndarray) -> int:
    return int.from_bytes(blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes: list[int] = []
        nodes: list[int | None] = []
        sample: list[np.ndarray | None] = []
        for _, words, bounds in hashed_words(batch.column("text")):
            for grams in shingle_sets(words, bounds, SHINGLE):
                node = _node(grams) if len(grams) else None
                sizes.append(len(grams))
                nodes.append(node)
                sample.append(grams.view(np.int64) if node is not None and node % SAMPLE == 0 else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sample, pa.list_(pa.int64()))],
            names=["doc_id", "_key", "n_shingles", "node", "sample"],
        )
    release()


def _packed(keys: np.ndarray, nodes: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple]:
    """Entries with ascending ``keys``, each key's nodes in runs: one packed row per key."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
        runs = np.concatenate([[0], np.flatnonzero(np.diff(nodes[a:b])) + 1]) + a
        counts = np.diff(np.append(runs, b)).astype(np.uint32)
        yield (int(keys[a]), nodes[runs].tobytes(), counts.tobytes(), *[c[a:b].tobytes() for c in columns])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ENTRIES = pa.schema([("block", pa.int32()), ("nodes", pa.binary()), ("counts", pa.binary()), ("low", pa.binary()), ("mid", pa.binary())])
_SHARED = pa.schema([("bucket", pa.int32()), ("nodes", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary()), ("df", pa.binary())])
_BOUND = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("prefix", pa.int64()), ("grams", pa.list_(pa.int64()))])


def _sql(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _unpack(part: pa.Table, *columns: tuple[str, type]) -> list[np.ndarray]:
    whole = lambda name, kind: np.frombuffer(b"".join(part.column(name).to_pylist()), kind)
    return [np.repeat(whole("nodes", np.int64), whole("counts", np.uint32)), *[whole(n, k) for n, k in columns]]


def _to_blocks(blocks: int, hot: np.ndarray):
    """Incidence entries by block of n-grams; entries of hot n-grams by node behind the blocks."""

    def deal(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        grams = np.concatenate(sets)
        node = np.repeat(np.array(nodes, np.int64), [len(s) for s in sets])
        key = (((grams >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int32)
        if len(hot):
            at = np.searchsorted(hot, grams)
            known = hot[np.minimum(at, len(hot) - 1)] == grams
            key[known] = (blocks + np.mod(node[known], blocks)).astype(np.int32)
        order = np.argsort(key.astype(np.uint16) if 2 * blocks < 1 << 16 else key, kind="stable")
        grams = grams[order]
        low = grams.astype(np.uint32), ((grams & _LOW) >> np.uint64(32)).astype(np.uint16)
        return _batch(list(_packed(key[order], node[order], list(low))), _ENTRIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task's input count once; at most one number per row of the split
        nodes: list[int] = []
        sets: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for _, words, bounds in hashed_words(batch.column("text")):
                for grams in shingle_sets(words, bounds, SHINGLE):
                    if len(grams) and (node := _node(grams)) not in seen:
                        seen.add(node)
                        nodes.append(node)
                        sets.append(grams)
                        held += len(grams)
                if held > ENTRIES_PER_SEND:
                    yield deal(nodes, sets)
                    nodes, sets, held = [], [], 0
        if sets:
            yield deal(nodes, sets)
        release()

    return run


def _share(blocks: int):
    """Entries of a block whose n-gram two nodes hold at least, by bucket of nodes, with the number of holders."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        block = key[0].as_py()
        node, low, mid = _unpack(part, ("low", np.uint32), ("mid", np.uint16))
        grams = low.astype(np.uint64) | (mid.astype(np.uint64) << np.uint64(32))
        if block >= blocks:
            order, df = np.argsort(node, kind="stable"), np.full(len(node), _HOT_DF, np.uint16)
            node, grams = node[order], grams[order] | np.uint64(_HOT_BLOCK << 48)
        else:
            order = np.argsort(grams)
            same = grams[order][1:] == grams[order][:-1]
            some = order[np.append(same, False) | np.insert(same, 0, False)]  # held more than once, copies included
            node, grams = node[some], grams[some]
            order = np.lexsort((node, grams))
            node, grams = node[order], grams[order]
            new = np.insert((np.diff(node) != 0) | (np.diff(grams) != 0), 0, True)[: len(node)]
            node, grams = node[new], grams[new]
            _, which, count = np.unique(grams, return_inverse=True, return_counts=True)
            df = np.minimum(count, _HOT_DF - 1)[which]
            node, grams, df = node[df > 1], grams[df > 1], df[df > 1].astype(np.uint16)
            grams = grams | np.uint64((block % _HOT_BLOCK) << 48)
        bucket = np.mod(node, blocks)
        order = np.lexsort((node, bucket))
        rows = list(_packed(bucket[order], node[order], [grams[order], df[order]])) if len(node) else []
        return pa.Table.from_batches([_batch(rows, _SHARED)])

    return run


def _bound(part: pa.Table, sizes: pa.Table) -> pa.Table:
    """Nodes with enough shared n-grams, rarest n-gram first, and how many of them form the prefix."""
    node, grams, df = _unpack(part, ("grams", np.uint64), ("df", np.uint16)) if part.num_rows else [np.empty(0, t) for t in (np.int64, np.uint64, np.uint16)]
    order = np.lexsort((grams, df, node))
    node, grams = node[order], grams[order]
    new = np.insert((np.diff(node) != 0) | (np.diff(grams) != 0), 0, True)[: len(node)]
    node, grams = node[new], grams[new]
    names, starts, shared = np.unique(node, return_index=True, return_counts=True)
    known, n = sizes.column("node").to_numpy(), sizes.column("n").to_numpy()
    by = np.argsort(known)
    n = n[by][np.searchsorted(known[by], names)] if len(names) else np.empty(0, np.int64)
    need = (NUM * n + DEN - 1) // DEN
    keep = shared >= need
    lists = [grams[a : a + c].view(np.int64) for a, c in zip(starts[keep].tolist(), shared[keep].tolist(), strict=True)]
    return pa.table([pa.array(names[keep]), pa.array(n[keep]), pa.array(shared[keep] - need[keep] + 1), pa.array(lists, pa.list_(pa.int64()))], schema=_BOUND)


def describe_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, _key, n_shingles, node`` per row of ``docs`` (node null for an empty set), plus a sample of whole sets."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", *row_key("doc_id", "text"), "text")
    return rows.mapInArrow(_describe, f"doc_id {kind}, _key long, n_shingles long, node long, sample array<long>")


def bounded_sets(docs: DataFrame, described: DataFrame, blocks: int | None = None) -> DataFrame:
    """Steps 2 and 3: ``node, n, prefix, grams`` of the sets that can link with some other set."""
    spark = docs.sparkSession
    total = described.agg(F.sum("n_shingles").alias("entries"), F.count("sample").alias("sampled")).first()
    if blocks is None:
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["entries"] or 0) // ENTRIES_PER_BLOCK))
    often = max(8, total["sampled"] // HOT)
    hot = described.filter("sample is not null").dropDuplicates(["node"]).select(F.explode("sample").alias("gram"))
    hot = hot.groupBy("gram").count().filter(F.col("count") >= often).orderBy(F.desc("count"), "gram").limit(HOT_MOST)
    hot_list = np.sort(np.array([r["gram"] for r in hot.collect()], np.int64).view(np.uint64))

    entries = docs.select("text").mapInArrow(_to_blocks(blocks, hot_list), _sql(_ENTRIES))
    shared = entries.groupBy("block").applyInArrow(_share(blocks), _sql(_SHARED))
    sizes = described.filter("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n"))
    sizes = sizes.withColumn("bucket", F.pmod("node", F.lit(blocks)).cast("int"))
    return shared.groupBy("bucket").cogroup(sizes.groupBy("bucket")).applyInArrow(_bound, _sql(_BOUND))


def _fits(a: str, b: str):
    """Sizes of which one is less than three quarters of the other cannot link."""
    return (F.col(a) * NUM <= F.col(b) * DEN) & (F.col(b) * NUM <= F.col(a) * DEN)


def _needed(a: str, b: str):
    """Overlap * (NUM + DEN) >= NUM * (n_a + n_b) says that the Jaccard similarity is NUM / DEN or more."""
    return (F.col(a) + F.col(b)) * NUM


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs ``a, b`` those that link; every common n-gram is among the shared ones of both."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("grams_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    overlap = F.size(F.array_intersect("grams_a", "grams_b")).alias("overlap")
    return both.select("a", "b", "n_a", "n_b", overlap).filter(F.col("overlap") * (NUM + DEN) >= _needed("n_a", "n_b")).select("a", "b")


def linked_nodes(sets: DataFrame, rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """Step 4: classes ``node, label`` of the nodes that link with another node."""
    spark = sets.sparkSession
    shared = F.size("grams").alias("shared")
    posts = sets.select("node", "n", shared, F.posexplode(F.slice("grams", F.lit(1), F.col("prefix").cast("int"))).alias("rank", "gram"))
    met = posts.groupBy("gram").count().filter("count > 1").select("gram")
    posts = saved(posts.join(met, "gram"))
    links = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "node long, label long")

    def labelled() -> DataFrame:
        return posts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def open_grams(own: DataFrame, turn: int) -> DataFrame:
        # after the first round only a part of the nodes can be pivots, another part each time
        may = (F.lit(turn) == 0) | (F.pmod(F.xxhash64("node"), F.lit(rounds)) == turn)
        pivot = F.max(F.when(may, F.struct((F.col("shared") / F.col("n")).alias("common"), "node", "n", "label"))).alias("pivot")
        return own.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), pivot).filter("low < high")

    for turn in range(rounds):
        own = labelled()
        aims = open_grams(own, turn).filter("pivot is not null")
        aims = aims.select("gram", F.col("pivot.node").alias("b"), F.col("pivot.n").alias("n_b"), F.col("pivot.label").alias("label_b"))
        near = own.join(aims, "gram").filter((F.col("label") != F.col("label_b")) & _fits("n", "n_b"))
        best = near.groupBy("node", "b").count().groupBy("node").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
        found = saved(_verified(best.select(F.col("node").alias("a"), "b"), sets))
        links = links.union(found)
        labels = components(links)

    own = labelled()
    own = saved(own.join(open_grams(own, 0).select("gram"), "gram"))
    a, b = own.alias("a"), own.alias("b")
    needed = F.ceil(_needed("a.n", "b.n") / (NUM + DEN))
    ranked = (F.col("a.rank") <= F.col("a.shared") - needed) & (F.col("b.rank") <= F.col("b.shared") - needed)
    across = (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label")) & _fits("a.n", "b.n") & ranked
    pairs = a.join(b, (F.col("a.gram") == F.col("b.gram")) & across)
    # what can still follow the last common n-gram that was counted
    left = F.least(F.max(F.col("a.shared")) - F.max("a.rank"), F.max(F.col("b.shared")) - F.max("b.rank")) - 1
    pairs = pairs.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg((F.count("*") + left).alias("most"), F.max(needed).alias("needed"))
    return components(saved(links.union(_verified(pairs.filter("most >= needed"), sets))))


def classed_rows(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """``doc_id, _key, n_shingles, label`` per row of ``docs``; rows of a class share the label, null for an empty set."""
    described = saved(describe_sets(docs))
    labels = linked_nodes(saved(bounded_sets(docs, described, blocks)))
    rows = described.drop("sample").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return saved(rows.select("doc_id", "_key", "n_shingles", "label"))


def jaccard_components(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Classes of documents linked by similar shingle sets: ``doc_id, n_shingles, component_id`` per row of ``docs``.

    ``docs`` needs ``doc_id, text``; other columns are not read.  Null and blank texts have an empty set,
    link with nothing and are their own class.  Equal texts, ids repeated or not, are in one class.  A row
    without an id links like any other; the class is named after the smallest id in it, null if there is
    none.  Empty table: empty result.
    """
    rows = classed_rows(docs, blocks)
    # written, so that a class of very many rows can be split in the join
    names = saved(rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")))
    named = rows.filter("label is not null").join(names, "label").select("doc_id", "n_shingles", "component_id")
    return named.union(rows.filter("label is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the one with the smallest id stays, with its columns.

    Rows without an id come last, among equal ids the row's hash decides, of repeated rows one stays.  Rows
    with an empty set all stay.
    """
    rows = classed_rows(docs).filter("label is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_key").alias("key"))).alias("first")
    kept = saved(rows.groupBy("label").agg(first).select("label", F.col("first.key").alias("key")))
    lost, again = unused("_lost", docs), unused("_again", docs)
    losers = saved(rows.join(kept, "label").filter("_key <> key").select(F.col("_key").alias(lost)).distinct())
    repeated = rows.groupBy("_key").count().filter("count > 1").join(losers, F.col("_key") == F.col(lost), "left_anti")
    repeated = saved(repeated.select(F.col("_key").alias(again)))
    key = row_key("doc_id", "text")[0]
    out = docs.join(small_side(losers), key == F.col(lost), "left_anti")
    if not repeated.limit(1).count():
        return out
    once = out.join(small_side(repeated), key == F.col(again)).dropDuplicates([again]).drop(again)
    return out.join(small_side(repeated), key == F.col(again), "left_anti").union(once)
