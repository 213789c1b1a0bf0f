"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs, pairs with one word between, and
word beginnings of five and seven bytes; the hash space is so large that features hardly ever collide.
Training is online with a rate per coordinate and L1 regularisation: a coordinate whose summed gradient
stays below ``l1`` has weight zero, so the model is a short list of features that every task can hold.
The sample of labelled rows is bounded; with several ``shards`` each fits a part and weights are averaged.

Every feature of the sample is fitted.  Those that a single text has take the same steps from the same start, so they
share a state: one coordinate per text stands for all of them, with their number as its value in the sum.  Nothing is
lost by that, and what is held grows with the features that texts share.

The text alone is the input of a score: no id, language or source.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.hashing import gram_hashes, hashed_words, release

#: At most about so many labelled rows are fitted, chosen by a hash of the id.
SAMPLE_ROWS = 8_000
SHARDS = 1
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 3.0, 0.01
HEADS = (5, 7)
THRESHOLD = 0.3
_BITS, _COUNTERS = 22, 24
#: About so many hashes are gathered before they are merged into the counted ones.
_GATHERED = 1_000_000


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes with their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def _grams(words: np.ndarray) -> np.ndarray:
    return np.concatenate([words[0], *[h for h in words[1:]], gram_hashes(words[0], (0, 1)), gram_hashes(words[0], (0, 2))])


def features_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """Distinct feature hashes of each text."""
    for _, words, bounds in hashed_words(texts, HEADS):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(_grams(words[:, a:b]))


def ftrl(rows: list[np.ndarray], toxic: np.ndarray, size: int, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of ``size`` coordinates, of each row's own coordinate, and the bias after EPOCHS passes over the rows in their order.

    ``alone`` is the number of features that only the row has (none): they have the weight of its own coordinate.
    """
    z, n, b_sum, b_n = np.zeros(size), np.zeros(size), 0.0, 0.0
    own_z, own_n, own = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows)) if alone is None else alone

    def weight(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    bias = 0.0
    for _ in range(EPOCHS):
        for i, (at, y) in enumerate(zip(rows, toxic.tolist(), strict=True)):
            zi, ni = np.append(z[at], own_z[i]), np.append(n[at], own_n[i])
            w = weight(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w[:-1].sum() + own[i] * w[-1] + bias, -35, 35))) - y
            zi, ni = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w, ni + g * g
            z[at], own_z[i], n[at], own_n[i] = zi[:-1], zi[-1], ni[:-1], ni[-1]
            step = (np.sqrt(b_n + g * g) - np.sqrt(b_n)) / ALPHA
            b_sum, b_n = b_sum + g - step * bias, b_n + g * g
            bias = -b_sum / ((BETA + np.sqrt(b_n)) / ALPHA)
    return weight(z, n), weight(own_z, own_n), float(bias)


def _merged(known: np.ndarray, docs: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted features with their document counts, ``more`` texts' features added."""
    new, times = np.unique(np.concatenate(more), return_counts=True)
    at = np.searchsorted(known, new)
    there = at < len(known)
    there[there] = known[at[there]] == new[there]
    docs[at[there]] += times[there].astype(np.int32)
    return np.insert(known, at[~there], new[~there]), np.insert(docs, at[~there], times[~there].astype(np.int32))


def _frequent(texts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features that several texts have, each text's positions in them as one array with bounds, and how many only it has.

    Texts are hashed three times, so that no pass holds all their hashes: a table of counts by hash leaves out
    most features of one text (never a shared one), the rest are counted exactly, then positions are looked up.
    """
    mask = np.uint64((1 << _COUNTERS) - 1)
    counts = np.zeros(1 << _COUNTERS, np.uint8)
    for part in texts:
        for f in features_of(part):
            at, times = np.unique((f & mask).astype(np.int64), return_counts=True)
            counts[at] = np.minimum(counts[at] + times, 255)
    known, docs, more, size = np.empty(0, np.uint64), np.empty(0, np.int32), [np.empty(0, np.uint64)], 0
    for part in texts:
        for f in features_of(part):
            more.append(f[counts[(f & mask).astype(np.int64)] >= 2])
            size += len(more[-1])
            if size >= _GATHERED:
                known, docs = _merged(known, docs, more)
                more, size = [], 0
    del counts
    if more:
        known, docs = _merged(known, docs, more)
    known, docs = known[docs >= 2], docs[docs >= 2]
    flat, bounds, alone = np.empty(docs.sum(dtype=np.int64), np.int32), [0], []
    for part in texts:
        for f in features_of(part):
            at = np.searchsorted(known, f)
            there = at < len(known)
            there[there] = known[at[there]] == f[there]
            bounds.append(bounds[-1] + int(there.sum()))
            flat[bounds[-2] : bounds[-1]] = at[there]
            alone.append(len(f) - int(there.sum()))
    return known, flat, np.array(bounds, np.int64), np.array(alone, float)


def _own_features(texts: list[pa.Array], known: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """The features that are not ``known`` of each text whose own weight is not zero."""
    at = 0
    for part in texts:
        for i in np.flatnonzero(weights[at : at + len(part)]).tolist():
            f = next(features_of(part.slice(i, 1)))
            yield np.setdiff1d(f, known, assume_unique=True), float(weights[at + i])
        at += len(part)


def _train_shard(part: pa.Table) -> pa.Table:
    part = part.sort_by([("draw", "ascending"), ("toxic", "ascending")])
    texts = part.column("text").chunks
    known, flat, bounds, alone = _frequent(texts)
    rows = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    w, own, bias = ftrl(rows, part.column("toxic").to_numpy(), len(known), alone)
    on = np.flatnonzero(w)
    found = [(known[on], w[on])] + [(f, np.full(len(f), x)) for f, x in _own_features(texts, known, own)]
    features, weights = (np.concatenate(c) for c in zip(*found, strict=True))
    names = pa.array(np.append(features.view(np.int64), 0))
    release()
    return pa.table({"feature": names, "weight": np.append(weights, bias), "is_bias": np.append(np.zeros(len(features), bool), True)})


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never used: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, shards: int = SHARDS) -> Model:
    """Fit on labelled rows that are not held out.

    ``docs`` needs ``doc_id, text``, ``labels`` needs ``doc_id, toxic``.  Rows without an id or label are not
    fitted; an id labelled twice counts as toxic if one label says so.  Only the sampled ids (about
    ``sample_rows`` at most) are broadcast to pick their texts.  No labelled row: the score is 0.5.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = known.count()
    known = known.withColumn("draw", F.xxhash64("doc_id", F.lit(7)))
    if rows > sample_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * sample_rows / rows))
    picked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").withColumn("shard", F.pmod("draw", F.lit(shards)))
    fitted = picked.groupBy("shard").applyInArrow(_train_shard, "feature long, weight double, is_bias boolean")
    shares = fitted.groupBy("feature", "is_bias").agg((F.sum("weight") / shards).alias("weight"), F.count("*").alias("fits"))
    found = shares.select("feature", "is_bias", F.round("weight", 9).alias("weight"), "fits").collect()
    # a shard without rows has no model; the others' mean counts
    fits = max([r["fits"] for r in found if r["is_bias"]], default=0)
    rescale = shards / fits if fits else 0.0
    kept = sorted((r["feature"] % (1 << 64), r["weight"] * rescale) for r in found if not r["is_bias"] and r["weight"])
    bias = sum(r["weight"] for r in found if r["is_bias"]) * rescale
    return Model(np.array([k for k, _ in kept], np.uint64), np.array([w for _, w in kept]), bias)


def _scorer(model: Model, keep: list[str], text: str):
    mask = np.uint64((1 << _BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.zeros(1 << _BITS, bool)
        maybe[(model.features & mask).astype(np.int64)] = True
        for batch in batches:
            total = np.full(batch.num_rows, model.bias)
            for first, words, bounds in hashed_words(batch.column(text), HEADS):
                hits, texts = [], []
                # every family of features over the whole run of texts; pairs must not cross texts
                families = [(row, 0) for row in words] + [(gram_hashes(words[0], (0, d)), d) for d in (1, 2)]
                for grams, reach in families:
                    at = np.flatnonzero(maybe[(grams & mask).astype(np.int64)])
                    if len(at) and len(model.features):
                        where = np.minimum(np.searchsorted(model.features, grams[at]), len(model.features) - 1)
                        found = model.features[where] == grams[at]
                        at, where = at[found], where[found]
                        owner = np.searchsorted(bounds, at, "right") - 1
                        inside = at + reach < bounds[owner + 1]
                        hits.append(where[inside])
                        texts.append(owner[inside])
                if hits:
                    pair = np.unique(np.concatenate(texts) * len(model.features) + np.concatenate(hits))
                    owner, where = np.divmod(pair, len(model.features))
                    total[first : first + len(bounds) - 1] += np.bincount(owner, model.weights[where], len(bounds) - 1)
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(score)], names=[*keep, "score"])
        release()

    return run


def score_texts(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) to the columns ``keep`` (all) of every row; a column of that name is replaced.

    Null and empty texts have the bias's score.  Only ``keep`` and the text go through Python.  The
    model, a few thousand features, is sent to every task.
    """
    keep = [c for c in keep or docs.columns if c != "score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    rows = docs.select(*keep, *[F.col(text)] * (text not in keep))
    return rows.mapInArrow(_scorer(model, keep, text), f"{schema}, score double")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score stays below ``threshold``, with their columns as they are."""
    scored = score_texts(docs.withColumnsRenamed({"score": "_score"}), train(docs, labels))
    return scored.filter(F.col("score") < threshold).drop("score").withColumnsRenamed({"_score": "score"})
