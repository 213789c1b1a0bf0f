"""Exact top-k inner products over norm-sorted vectors.

The second-moment matrix of the candidates, one small sum over the table, gives the rotation (its
eigenvectors, the right singular vectors of the table) that moves most of every product into the first
coordinates.  Candidates are range-sorted by descending length into blocks.  Queries meet the longest
vectors first, which gives each a floor: the k-th best score so far.  A block whose longest vector times
the query's length stays below the floor is skipped, vectors whose rotated partial sum plus the product
of the residual lengths (Cauchy-Schwarz) stays below are pruned, and the rest is scored exactly, in
integers.  Ties go to the smaller id, so pruning takes only what is strictly below the floor.

Queries travel in packed blocks to the blocks of candidates that their floor leaves open, in waves of eight
times as many blocks each, with higher floors after each.  As blocks come by descending length, the open ones are
those up to a last one, which a running maximum over lengths finds; pairs of blocks that are not open never
exist.  No block of either kind grows with the data, and no task holds all queries or all candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.common import saved
from sightline.operators.ordered import ordered_scan

BLOCK = 2_048
#: Queries that meet a block of candidates at once.
CHUNK = 128
#: The first wave ends before the block of this number, each later one has so many times as many blocks.
WAVE = 8
#: Coordinates of the partial sums.
LEADING = 16


def _gram(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = np.array(batch.column("v").to_pylist(), float).reshape(-1, dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["g"])

    return run


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthogonal matrix whose columns are the directions of the vectors by descending weight."""
    parts = vectors.select("v").mapInArrow(_gram(dim), "g array<double>")
    sums = parts.select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    gram = np.array([r["x"] for r in sums]).reshape(dim, dim) if sums else np.eye(dim)
    return np.linalg.eigh(gram)[1][:, ::-1]


_PACK = "block long, ids binary, vectors binary, top double"


def _pack(key: tuple, part: pa.Table) -> pa.Table:
    """One row per block, longest vectors first, and the length of the longest."""
    ids = part.column("vec_id").to_numpy()
    x = np.array(part.column("v").to_pylist(), float).reshape(len(ids), -1)
    squares = (x * x).sum(1)
    order = np.lexsort((ids, -squares))
    return pa.table({"block": [key[0].as_py()], "ids": [ids[order].tobytes()], "vectors": [x[order].tobytes()], "top": [float(np.sqrt(squares.max()))]})


def _block_best(q_id, q, c_id, c, floor, k: int, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of a block of candidates for a few queries, but for those strictly below the floor."""
    lead = min(LEADING, len(turn))
    qr, cr = q @ turn, c @ turn
    size = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((c * c).sum(1).max())
    rest = np.outer(np.sqrt((qr[:, lead:] ** 2).sum(1)), np.sqrt((cr[:, lead:] ** 2).sum(1)))
    bound = qr[:, :lead] @ cr[:, :lead].T + rest + 1e-6 * (1 + size)
    at, to = np.nonzero((bound >= floor[:, None]) & (q_id[:, None] != c_id[None, :]))
    # whole numbers below 2^53 are exact in any order of summation; the denser way where little is pruned
    score = np.einsum("ij,ij->i", q[at], c[to]) if len(at) < bound.size // 16 else (q @ c.T)[at, to]
    order = np.lexsort((c_id[to], -score, at))
    at, to, score = at[order], to[order], score[order]
    best = np.arange(len(at)) - np.searchsorted(at, at) < k
    return q_id[at[best]], c_id[to[best]], score[best].astype(np.int64)


def _search(k: int, turn: np.ndarray, with_floor: bool):
    dim = len(turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_id, c_id = (np.frombuffer(row[n], np.int64) for n in ("q_ids", "c_ids"))
                q, c = (np.frombuffer(row[n]).reshape(-1, dim) for n in ("q_vectors", "c_vectors"))
                floor = np.frombuffer(row["floors"]) if with_floor else np.full(len(q), -np.inf)
                longest = np.sqrt((q * q).sum(1)) * np.sqrt((c * c).sum(1).max())
                open_ = np.flatnonzero(longest * (1 + 1e-9) + 1e-6 >= floor)
                parts = [open_[i : i + CHUNK] for i in range(0, len(open_), CHUNK)]
                for part in parts:
                    found = _block_best(q_id[part], q[part], c_id, c, floor[part], k, turn)
                    yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["query_id", "vec_id", "score"])

    return run


_FOUND = "query_id long, vec_id long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _last_open(floored: DataFrame, tops: DataFrame) -> DataFrame:
    """``q_block, upto``: the last block of candidates that is long enough to reach some floor of a block of queries, -1 for none."""
    long_ = tops.select((-(F.col("top") * (1 + 1e-9) + 1e-6)).alias("at"), F.lit(0).alias("asks"), F.col("block").alias("id"), "block")
    asks = floored.select((-F.col("reach")).alias("at"), F.lit(1).alias("asks"), F.col("q_block").alias("id"), F.lit(None).cast("long").alias("block"))
    counted = ordered_scan(long_.unionByName(asks), ["at", "asks", "id"], max_before={"upto": "block"})
    return counted.filter("asks = 1").select(F.col("id").alias("q_block"), F.coalesce("upto", F.lit(-1)).alias("upto"))


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """The ``k`` highest inner products of each query with all vectors but those of its own id.

    Both sides need ``vec_id long, v array<double>`` of whole numbers (their products below 2^53).  Returns
    ``query_id, rank, vec_id, score``; ties go to the smaller id.  Rows without an id or with null or
    non-finite components take no part; of several lengths the commonest (then the longer) counts, other
    vectors take no part.  Repeated ids are separate candidates and one query each per distinct vector.
    """
    spark = vectors.sparkSession
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    vectors = vectors.filter(good).select("vec_id", "v")
    common = vectors.groupBy(F.size("v").alias("dim")).count().filter("dim > 0").orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = common["dim"]
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("length")
    rows = saved(vectors.filter(F.size("v") == dim).select("vec_id", "v", length))
    asked = queries.filter(good).filter(F.size("v") == dim).select("vec_id", "v").distinct()
    asked = saved(asked.withColumn("block", F.xxhash64("vec_id")))
    turn = rotation(rows, dim)

    n, n_queries = rows.count(), asked.count()
    blocks, q_blocks = max(1, -(-n // block)), max(1, -(-n_queries // block))
    # equal lengths may be any number of rows: the id's hash splits them
    ranged = rows.repartitionByRange(blocks, F.desc("length"), F.xxhash64("vec_id")).withColumn("block", F.spark_partition_id().cast("long"))
    packed = ranged.groupBy("block").applyInArrow(_pack, _PACK)
    packed = saved(packed.select("block", "top", F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors")))
    last = packed.agg(F.max("block")).first()[0]
    asked = asked.withColumn("block", F.pmod("block", F.lit(q_blocks)).cast("long"))
    asks = saved(asked.groupBy("block").applyInArrow(_pack, _PACK).select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))

    # every query block with the first block of candidates, one row that is sent to all of them
    start = F.broadcast(packed.filter("block = 0").drop("top"))
    head = asks.withColumn("block", F.pmod("q_block", F.lit(1)).cast("long")).join(start, "block")
    best = saved(_best(head.mapInArrow(_search(k, turn, False), _FOUND), k))

    def floors(best: DataFrame) -> DataFrame:
        """The k-th score so far of each query of a block; a query with fewer than k results has none."""
        kth = best.groupBy("query_id").agg(F.count("*").alias("have"), F.min("score").alias("low"))
        kth = kth.select(F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("q_block"), "query_id", F.when(F.col("have") >= k, F.col("low").cast("double")).alias("low"))
        return kth.groupBy("q_block").agg(F.collect_list(F.struct("query_id", "low")).alias("floors"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known = {f["query_id"]: f["low"] for f in row["floors"] or []}
                low = [known.get(i) for i in np.frombuffer(row["q_ids"], np.int64).tolist()]
                floors = np.array([-np.inf if x is None else x for x in low])
                longest = np.sqrt((np.frombuffer(row["q_vectors"]).reshape(-1, dim) ** 2).sum(1))
                # the length from which on a candidate can reach some floor
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(longest > 0, floors / longest, np.where(floors > 0, np.inf, -np.inf)).min(initial=np.inf)
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("q_block", "q_ids", "q_vectors")} | {"floors": floors.tobytes(), "reach": float(reach)}])

    lo = 1
    while lo <= last:
        hi = min(last, lo * WAVE - 1)
        floored = saved(asks.join(floors(best), "q_block", "left").mapInArrow(place, "q_block long, q_ids binary, q_vectors binary, floors binary, reach double"))
        upto = _last_open(floored.select("q_block", "reach"), packed.select("block", "top"))
        until = F.least("upto", F.lit(hi).cast("long"))
        open_ = upto.filter(until >= lo).select("q_block", F.explode(F.sequence(F.lit(lo).cast("long"), until)).alias("block"))
        pairs = open_.join(floored.drop("reach"), "q_block")
        more = pairs.join(packed.drop("top"), "block").mapInArrow(_search(k, turn, True), _FOUND)
        best = saved(_best(best.drop("rank").union(more), k))
        lo = hi + 1
    return best.select("query_id", "rank", "vec_id", "score")
