"""Hard negatives by best-first search in R-trees packed by sort-tile-recursion.

Vectors are sorted by label, then cut into slabs of the coordinate that varies most, those into slabs of the next,
and ordered by a third (sort-tile-recursive packing): once over the cluster into tiles of bounded size, again inside
a tile into leaves.  A node's minimum bounding box gives, per coordinate, the interval of products with a query's
component; their sums are the interval of its inner products.  The label is one more side of the box.

A query walks a tile's tree from the node of the highest upper bound on.  A box is pruned if its interval lies
outside the score window, if its labels can't qualify, or if its upper bound is strictly below the k-th best score
so far (an equal one may hold a smaller id).  Queries travel in blocks that lie in one tile; the box of a block
decides level by level which tiles are open to it, so neither queries nor tiles are ever held by one task.

Components are whole numbers, so products, sums and bounds are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.common import saved, small_side

#: Components of the vectors of a tile, rows of a leaf, children of a node, coordinates that are cut into slabs.
TILE, LEAF, FANOUT, AXES = 1 << 21, 64, 8, 3
#: Queries of a block, and blocks that meet a copy of a tile.
ASK, PER_LANE = 128, 256
#: Tile boxes below one box of the directory, and boxes that may be broadcast.
SPAN, BROADCAST = 32, 2_000
_CHUNKS = 1 << 20


# --- packing ---------------------------------------------------------------------------------------------------------


def _spread(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, dim))
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            total += [np.full(dim, len(x)), x.sum(0), (x * x).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["s"])

    return run


def _axes(rows: DataFrame, dim: int) -> list[int]:
    """The coordinates of the largest variance, most first."""
    parts = rows.select("v").mapInArrow(_spread(dim), "s array<double>")
    sums = parts.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    n, first, second = np.array([r["x"] for r in sums]).reshape(3, dim)
    return [int(i) for i in np.argsort(-(second / n - (first / n) ** 2), kind="stable")[:AXES]]


def _tiled(x: np.ndarray, at: np.ndarray, axes: list[int]) -> list[np.ndarray]:
    """Leaves of the rows ``at``: slabs along the first axis, each cut along the next, ordered by the last."""
    if len(at) <= LEAF:
        return [at]
    at = at[np.argsort(x[at, axes[0]], kind="stable")]
    leaves = -(-len(at) // LEAF)
    wide = LEAF * (-(-leaves // math.ceil(leaves ** (1 / len(axes)) - 1e-9)) if len(axes) > 1 else 1)
    parts = [at[i : i + wide] for i in range(0, len(at), wide)]
    return parts if len(axes) == 1 else [leaf for p in parts for leaf in _tiled(x, p, axes[1:])]


def _leaves(x: np.ndarray, labels: np.ndarray, axes: list[int]) -> list[np.ndarray]:
    """Leaves of a tile sorted by label: labels of many rows have their own, runs of small ones share some."""
    edges = np.flatnonzero(np.diff(labels)) + 1
    starts, ends = [0, *edges.tolist()], [*edges.tolist(), len(labels)]
    out, held = [], []
    for a, b in zip(starts, ends, strict=True):
        if b - a >= LEAF:
            if held:
                out += _tiled(x, np.concatenate(held), axes)
                held = []
            out += _tiled(x, np.arange(a, b), axes)
        else:
            held.append(np.arange(a, b))
            if sum(map(len, held)) >= LEAF * FANOUT:
                out += _tiled(x, np.concatenate(held), axes)
                held = []
    return out + (_tiled(x, np.concatenate(held), axes) if held else [])


def _small(x: np.ndarray) -> tuple[str, bytes]:
    """The vectors in the narrowest type that holds them."""
    most = np.abs(x).max(initial=0)
    kind = next((k for k, top in (("<i1", 127), ("<i2", 32767), ("<i4", 2**31 - 1)) if most <= top), "<f8")
    return kind, x.astype(kind).tobytes()


_TILE = "block long, lo array<double>, hi array<double>, low_label long, high_label long, ids binary, labels binary, sizes binary, kind string, vectors binary"
_ASK = (
    "q_block long, block long, lo array<double>, hi array<double>, low_label long, high_label long, q_ids binary, q_labels binary, q_vectors binary"
)


def _packer(dim: int, axes: list[int], most: int):
    def pack(block: int, ids: list, labels: list, x: list) -> pa.RecordBatch:
        ids, labels, x = np.concatenate(ids), np.concatenate(labels), np.concatenate(x)
        leaves = _leaves(x, labels, axes)
        order = np.concatenate(leaves)
        kind, vectors = _small(x[order])
        row = {
            "block": block, "lo": x.min(0).tolist(), "hi": x.max(0).tolist(), "low_label": int(labels.min()), "high_label": int(labels.max()),
            "ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "sizes": np.array([len(a) for a in leaves], np.int64).tobytes(), "kind": kind, "vectors": vectors,
        }
        return pa.RecordBatch.from_pylist([row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, rows = TaskContext.get().partitionId() * _CHUNKS, ([], [], []), 0
        for batch in batches:
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            done = 0
            while done < len(ids):
                take = min(most - rows, len(ids) - done)
                for kept, part in zip(held, (ids, labels, x), strict=True):
                    kept.append(part[done : done + take])
                done, rows = done + take, rows + take
                if rows == most:
                    yield pack(block, *held)
                    block, held, rows = block + 1, ([], [], []), 0
        if rows:
            yield pack(block, *held)

    return run


def _slabs(rows: DataFrame, axis: int, count: int) -> Column:
    """The slab of a coordinate, of about equally many rows each; any cut points give right results."""
    if count < 2:
        return F.lit(0)
    value = F.get("v", F.lit(axis))
    cuts = rows.agg(F.percentile_approx(value, [i / count for i in range(1, count)], 10_000).alias("c")).first()[0]
    return F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= value))


def pack_tiles(rows: DataFrame, dim: int, n: int, tile: int = TILE) -> DataFrame:
    """Saved tiles of ``rows`` (``vec_id, label, v``), at most ``tile`` components each, with their boxes."""
    axes, most = _axes(rows, dim), max(LEAF, tile // dim)
    tiles = -(-n // most)
    slabs = math.ceil(tiles ** (1 / AXES) - 1e-9)
    # equal vectors may be any number of rows: the id's hash splits them
    order = [F.col("label"), *[_slabs(rows, a, slabs) for a in axes[:-1]], F.get("v", F.lit(axes[-1])), F.xxhash64("vec_id")]
    names = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select("vec_id", "label", "v", *[c.alias(n) for c, n in zip(order, names, strict=True)])
    dealt = keyed.repartitionByRange(tiles, *names).sortWithinPartitions(*names).drop(*names)
    return saved(dealt.mapInArrow(_packer(dim, axes, most), _TILE))


# --- trees and walks -------------------------------------------------------------------------------------------------


class Tree:
    """A tile with the boxes of its leaves and of the levels above, ``FANOUT`` nodes below each."""

    def __init__(self, row: dict, dim: int):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.x = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, dim).astype(float)
        ends = np.frombuffer(row["sizes"], np.int64).cumsum()
        self.starts, self.ends = [0, *ends[:-1].tolist()], ends.tolist()
        boxes = [(np.minimum.reduceat(a, self.starts), np.maximum.reduceat(a, self.starts)) for a in (self.x, self.labels)]
        self.levels = [(*boxes[0], *boxes[1])]
        while len(self.levels[-1][0]) > 1:
            lo, hi, low, high = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def bounds(self, q: np.ndarray) -> tuple[list[list], list[list]]:
        """Upper and lower bounds of the inner products of each query with each node, level by level."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return [up @ hi.T + down @ lo.T for lo, hi, _, _ in self.levels], [up @ lo.T + down @ hi.T for lo, hi, _, _ in self.levels]


class Window_:
    """The ``k`` best scores between ``low`` and ``high`` so far, ties to the smaller id."""

    __slots__ = ("best", "floor", "high", "k")

    def __init__(self, k: int, low: float, high: float):
        self.k, self.floor, self.high, self.best = k, low, high, []

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = (scores >= self.floor) & (scores <= self.high)
        if fits.any():
            self.best = sorted([*self.best, *zip((-scores[fits]).tolist(), ids[fits].tolist(), strict=True)])[: self.k]
            if len(self.best) == self.k:
                self.floor = max(self.floor, -self.best[-1][0])


def walk(tree: Tree, upper: list, lower: list, i: int, q: np.ndarray, own: int, label: int, same: bool, windows: list[Window_]) -> None:
    """Best-first search of query ``i`` of a block; fills ``windows``."""
    top = len(tree.levels) - 1
    queue = [(-upper[top][i, 0], top, 0)]
    while queue:
        bound, level, node = heappop(queue)
        low = lower[level][i, node]
        if -bound < min(w.floor for w in windows):
            return
        if not any(-bound >= w.floor and low <= w.high for w in windows):
            continue
        if level:
            _, _, first, last = tree.levels[level - 1]
            ups = upper[level - 1][i]
            for c in range(node * FANOUT, min((node + 1) * FANOUT, len(first))):
                if (first[c] <= label <= last[c]) if same else not (first[c] == label == last[c]):
                    heappush(queue, (-ups[c], level - 1, c))
            continue
        a, b = tree.starts[node], tree.ends[node]
        scores = tree.x[a:b] @ q
        if scores.max() < min(w.floor for w in windows):
            continue
        fits = ((tree.labels[a:b] == label) == same) & (tree.ids[a:b] != own)
        scores, ids = scores[fits], tree.ids[a:b][fits]
        for w in windows:
            w.offer(scores, ids)


# --- blocks of queries -----------------------------------------------------------------------------------------------


def _asks(dim: int, every: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                at = np.flatnonzero(wanted(ids))
                x = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, dim)
                labels = np.frombuffer(row["labels"], np.int64)
                for j, i in enumerate(range(0, len(at), every)):
                    part = at[i : i + every]
                    q = x[part].astype(float)
                    yield pa.RecordBatch.from_pylist([{
                        "q_block": row["block"] * _CHUNKS + j, "block": row["block"], "lo": q.min(0).tolist(), "hi": q.max(0).tolist(),
                        "low_label": int(labels[part].min()), "high_label": int(labels[part].max()),
                        "q_ids": ids[part].tobytes(), "q_labels": labels[part].tobytes(), "q_vectors": q.tobytes(),
                    }])

    return run


_BOX = ["lo", "hi", "low_label", "high_label"]


def _meets(same: bool):
    """Keep the pairs of a query box and a node box whose inner products and labels can qualify."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            wide = lambda name: np.stack([np.asarray(a) for a in batch.column(name).to_pylist()])  # noqa: E731,B023
            ql, qh, tl, th = (wide(n) for n in ("lo", "hi", "t_lo", "t_hi"))
            corners = np.stack([ql * tl, ql * th, qh * tl, qh * th])
            upper, lower = corners.max(0).sum(1), corners.min(0).sum(1)
            a, b, c, d, least, most = (batch.column(n).to_numpy() for n in ("low_label", "high_label", "t_low_label", "t_high_label", "least", "most"))
            labels = (a <= d) & (c <= b) if same else ~((a == b) & (c == d) & (a == c))
            keep = labels & (upper >= least) & (lower <= most)
            names = ["q_block", "node"]
            out = pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(upper)], names=[*names, "upper"])
            yield out.filter(pa.array(keep))

    return run


class Directory:
    """Boxes of tiles and of ``SPAN`` to the power of a level tiles, found by the number of the tile's range."""

    def __init__(self, tiles: DataFrame):
        boxes = saved(tiles.select(F.col("block").alias("node"), *_BOX))
        self.last = boxes.agg(F.max("node")).first()[0] // _CHUNKS
        self.levels = [boxes]
        scale = _CHUNKS
        while True:
            self.levels.append(saved(self._above(self.levels[-1], scale if len(self.levels) == 1 else SPAN)))
            if self.last < SPAN ** len(self.levels[1:]):
                break

    @staticmethod
    def _above(boxes: DataFrame, step: int) -> DataFrame:
        up = F.floor(F.col("node") / step)
        ends = boxes.groupBy(up.alias("node")).agg(F.min("low_label").alias("low_label"), F.max("high_label").alias("high_label"))
        each = boxes.select(up.alias("node"), F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "b"))
        sides = each.groupBy("node", "i").agg(F.min("b.lo").alias("lo"), F.max("b.hi").alias("hi"))
        sides = sides.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("s"))
        return ends.join(sides, "node").select("node", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), "low_label", "high_label")

    def open(self, asks: DataFrame, same: bool) -> DataFrame:
        """``q_block, block, upper`` of the tiles open to the blocks of ``asks`` (their box, ``least``, ``most``)."""
        narrow = asks.select("q_block", "least", "most", *_BOX)
        top = len(self.levels) - 1
        roots = self.last // SPAN ** (top - 1)
        pairs = narrow.select("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(roots).cast("long"))).alias("node"))
        for level in range(top, -1, -1):
            boxes = self.levels[level].select("node", *[F.col(c).alias(f"t_{c}") for c in _BOX])
            met = pairs.join(small_side(boxes, BROADCAST), "node").join(narrow, "q_block")
            pairs = met.mapInArrow(_meets(same), "q_block long, node long, upper double")
            if level > 1:
                first = F.col("node") * SPAN
                pairs = pairs.select("q_block", F.explode(F.sequence(first, F.least(first + SPAN - 1, F.lit(self.last // SPAN ** (level - 2))))).alias("node"))
            elif level == 1:
                inside = self.levels[0].select("node", F.floor(F.col("node") / _CHUNKS).alias("_p"))
                pairs = pairs.select("q_block", F.col("node").alias("_p")).join(inside, "_p").select("q_block", "node")
            pairs = saved(pairs)
        return pairs.withColumnRenamed("node", "block")


_FOUND = "q_block long, pos int, low double, high double, vec_id long, score long"


def _search(dim: int, k: int, same: bool):
    """Search the tile of a row for its queries; each window is ``pos, low, high, floor`` of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, block = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if tree is None or row["block"] != block:
                    tree, block = Tree(row, dim), row["block"]
                q_ids, labels = np.frombuffer(row["q_ids"], np.int64).tolist(), np.frombuffer(row["q_labels"], np.int64).tolist()
                q = np.frombuffer(row["q_vectors"]).reshape(-1, dim)
                upper, lower = tree.bounds(q)
                asked: dict[int, list] = {}
                for pos, low, high, floor in np.frombuffer(row["windows"]).reshape(-1, 4).tolist():
                    asked.setdefault(int(pos), []).append((low, high, Window_(k, max(low, floor), high)))
                out: list[list] = [[], [], [], [], []]
                for pos, windows in asked.items():
                    walk(tree, upper, lower, pos, q[pos], q_ids[pos], labels[pos], same, [w for _, _, w in windows])
                    for low, high, w in windows:
                        for minus, other in w.best:
                            for column, value in zip(out, (pos, low, high, other, int(-minus)), strict=True):
                                column.append(value)
                kinds = (pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
                columns = [pa.array([row["q_block"]] * len(out[0]), pa.int64()), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, names=["q_block", "pos", "low", "high", "vec_id", "score"])

    return run


def _visit(pairs: DataFrame, asks: DataFrame, tiles: DataFrame, dim: int, k: int, same: bool, blocks: int, n_tiles: int) -> DataFrame:
    """Search the tiles of ``pairs`` for their blocks; a tile is copied for every ``PER_LANE`` blocks that meet it."""
    tasks = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = max(-(-tasks // n_tiles), -(-blocks // PER_LANE))
    dealt = pairs.select("q_block", "block", F.pmod(F.xxhash64("q_block"), F.lit(lanes)).alias("lane"))
    copies = dealt.select("block", "lane").distinct().join(tiles.drop(*_BOX), "block")
    sent = dealt.join(asks.select("q_block", "q_ids", "q_labels", "q_vectors", "windows"), "q_block")
    return saved(sent.join(copies, ["block", "lane"]).mapInArrow(_search(dim, k, same), _FOUND))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best per window, from at most ``k`` per window and tile."""
    rank = F.row_number().over(Window.partitionBy("q_block", "pos", "low", "high").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _with_windows(asks: DataFrame, windows: DataFrame) -> DataFrame:
    """Pack the windows (``q_block, pos, low, high, floor``, a bounded number per block) into the rows of their blocks."""
    listed = windows.groupBy("q_block").agg(
        F.collect_list(F.struct(F.col("pos").cast("double").alias("pos"), "low", "high", "floor")).alias("_w"), F.min("floor").alias("least"), F.max("high").alias("most")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array([[w["pos"], w["low"], w["high"], w["floor"]] for w in ws]).tobytes() for ws in batch.column("_w").to_pylist()]
            names = [n for n in batch.schema.names if n != "_w"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(packed, pa.binary())], names=[*names, "windows"])

    rows = asks.join(listed, "q_block")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_w")
    return saved(rows.mapInArrow(place, f"{kinds}, windows binary"))


def _two_visits(directory: Directory, asks: DataFrame, windows: DataFrame, tiles: DataFrame, dim: int, k: int, same: bool, n_tiles: int) -> DataFrame:
    """Each block first visits the tile of its highest bound; what it finds there is the floor for all others."""
    ready = _with_windows(asks, windows)
    blocks = ready.count()
    if not blocks:
        return tiles.sparkSession.createDataFrame([], f"{_FOUND}, rank int")
    pairs = directory.open(ready, same)
    first = saved(pairs.groupBy("q_block").agg(F.max_by("block", F.struct("upper", "block")).alias("block")))
    near = _best(_visit(first, ready, tiles, dim, k, same, blocks, n_tiles), k)
    kth = near.groupBy("q_block", "pos", "low", "high").agg(F.count("*").alias("_c"), F.min("score").cast("double").alias("_f"))
    kth = kth.select("q_block", "pos", "low", "high", F.when(F.col("_c") >= k, F.col("_f")).alias("_f"))
    raised = windows.join(kth, ["q_block", "pos", "low", "high"], "left")
    raised = raised.select("q_block", "pos", "low", "high", F.greatest("floor", "_f").alias("floor"))
    again = _with_windows(asks, raised)
    left = pairs.join(again.select("q_block", "least"), "q_block").filter(F.col("upper") >= F.col("least"))
    left = saved(left.join(first, ["q_block", "block"], "left_anti").select("q_block", "block"))
    return _best(near.drop("rank").union(_visit(left, again, tiles, dim, k, same, blocks, n_tiles)), k)


def mine(rows: DataFrame, anchor_every: int, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, tile: int = TILE) -> DataFrame:
    """Hard negatives of each anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id long, label long, v array<double>`` of whole numbers (products below 2^53).  Anchors are the
    rows whose id ``anchor_every`` divides.  An anchor's positives are its ``positives`` best other rows of its label by
    inner product; a positive's negatives the ``negatives`` best rows of other labels whose score is between ``low``
    and ``high`` per cent of the positive's, both included.  Ties go to the smaller id.

    Rows with a null id, label or vector or with a null or non-finite component take no part; of several lengths the
    commonest (then the longer) counts.  Rows of an anchor's own id never partner it; otherwise rows that repeat an id
    are rows of their own, and as anchors they have results of their own.  Empty table: no rows.
    """
    spark = rows.sparkSession
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("v").cast("array<double>")).filter(good)
    common = rows.groupBy(F.size("v").alias("dim")).count().filter("dim > 0").orderBy(F.desc("count"), F.desc("dim")).first()
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if common is None:
        return spark.createDataFrame([], shape)
    dim, n = common["dim"], common["count"]
    tiles = pack_tiles(saved(rows.filter(F.size("v") == dim)), dim, n, tile)
    n_tiles = tiles.count()
    directory = Directory(tiles)
    asks = saved(tiles.mapInArrow(_asks(dim, ASK, lambda ids: ids % anchor_every == 0), _ASK)).drop("block")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(ids), pa.int64()), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["q_block", "pos", "anchor_id"])

    anchors = saved(asks.select("q_block", "q_ids").mapInArrow(numbered, "q_block long, pos int, anchor_id long"))
    everything = F.lit(math.inf)
    all_scores = anchors.select("q_block", "pos", (-everything).alias("low"), everything.alias("high"), (-everything).alias("floor"))
    near = _two_visits(directory, asks, all_scores, tiles, dim, positives, True, n_tiles)
    near = saved(near.select("q_block", "pos", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # whole scores between the two shares: ceil(low * s / 100) and floor(high * s / 100)
    share = F.col("positive_score")
    windows = near.select("q_block", "pos", F.ceil(share * low / 100).cast("double").alias("low"), F.floor(share * high / 100).cast("double").alias("high")).distinct()
    windows = saved(windows.filter("low <= high").withColumn("floor", F.col("low")))
    hard = _two_visits(directory, asks, windows, tiles, dim, negatives, False, n_tiles)
    found = near.withColumns({"low": F.ceil(share * low / 100).cast("double"), "high": F.floor(share * high / 100).cast("double")})
    found = found.join(hard.select("q_block", "pos", "low", "high", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["q_block", "pos", "low", "high"])
    return found.join(anchors, ["q_block", "pos"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
