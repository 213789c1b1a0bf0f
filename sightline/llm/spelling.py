"""Groups of spelling variants: words one insertion, deletion or replacement apart, by asymmetric chunks.

Of two words the shorter one (of equal lengths the smaller in code-point order) contributes two disjoint chunks, its
halves.  The other contributes positional grams of a chunk's length: one edit leaves a chunk whole, and it then lies
in the other word at its own place or, behind the edit, shifted by the difference of the lengths, at most one.  Of
all positional grams only those that lie within this shift of a chunk can meet one, and only they are sent.  Chunks
and grams meet in an equi-join, and what meets is verified.

A chunk that very many words share would make every pair of them.  Such groups are split before they meet: the rest
of the word is again cut into two chunks, of which the same edit leaves one whole, so the key grows by that chunk.
This goes on until a key is met by few words or its rest is a single character; then all words of the key but for
the ends are near ones.  No group is capped and no pair lost.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import saved

#: Distinct words a task counts before it sends the counts on.
HELD = 400_000
#: Pairs that a key may make before it is split further.
PAIRS = 20_000
_RUN = re.compile(rb"[A-Za-z\xC0-\xFF]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _counter(shortest: int, one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(counts: dict[bytes, int]) -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: dict[bytes, int] = {}
        crc, get = zlib.crc32, counts.get
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # a run holds no code point above 255, so that others may all become one separator
                raw = (text.as_py() or "").encode("latin-1", "replace").translate(_LOWER)
                here: dict[bytes, int] = {}
                for word in _RUN.findall(raw):
                    here[word] = here.get(word, 0) + 1
                start = crc(b"%s:" % (b"" if key is None else str(key).encode()))
                for word, n in here.items():
                    if one_in:
                        h = crc(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if not h % one_in:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= shortest:
                        counts[word] = get(word, 0) + n
                if len(counts) >= HELD:
                    yield send(counts)
                    counts.clear()
        yield send(counts)

    return run


def word_counts(docs: DataFrame, least: int = 5, shortest: int = 6, one_in: int = 199, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of all whole texts with their occurrences: ``word, n``, those of at least ``shortest`` code points and ``least`` occurrences.

    A run is a maximal sequence of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased.  With ``one_in`` > 0 the runs of a
    document whose CRC-32 of ``<key>:<run>`` it divides lose one code point (planted misspellings); 0 leaves all as
    they are.  Null texts hold no words, a null key is the empty string.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_counter(shortest, one_in), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _cut(word: Column, start: Column, length: Column) -> Column:
    return F.substring(word, start + 1, length)


def _halves(rest: str, other: Column | int) -> list[Column]:
    """The two pieces of a word's rest that one edit may leave whole, beside a word with ``other`` more code points.

    ``other`` 0 is the chunk word itself; for the longer word 0 or 1.  Each piece comes with what remains.
    """
    more = F.lit(other) if isinstance(other, int) else other
    size = F.length(rest)
    half = F.floor((size - more) / 2).cast("int")
    word = F.col(rest)
    first = F.struct(F.lit(0).alias("side"), _cut(word, F.lit(0), half).alias("piece"), _cut(word, half, size - half).alias("rest"))
    last = F.struct(F.lit(1).alias("side"), _cut(word, half + more, size - half - more).alias("piece"), _cut(word, F.lit(0), half + more).alias("rest"))
    return [first, last]


def _split(rows: DataFrame, chunk_side: bool) -> DataFrame:
    """Rows ``key, more, rest, word`` with the keys extended by one more chunk."""
    pieces = F.explode(F.array(*_halves("rest", 0 if chunk_side else F.col("more")))).alias("p")
    cut = rows.select("key", "more", "word", pieces)
    # the key is a hash; words that meet are compared in full
    return cut.select(F.xxhash64("key", "p.side", "p.piece").alias("key"), "more", F.col("p.rest").alias("rest"), "word")


def near_pairs(words: DataFrame, limit: int = PAIRS) -> DataFrame:
    """Pairs ``a, b`` of distinct words that differ by exactly one inserted, deleted or replaced code point.

    ``words`` has one row per distinct ``word``; nulls take no part.  Each unordered pair comes once, the shorter word
    (of equal lengths the smaller) as ``a``.  The words of a key meet at once if that makes at most ``limit`` pairs.
    """
    base = words.filter("word is not null").select("word", F.col("word").alias("rest"))
    # the key starts with the length of the chunk word: a word meets those as long as itself and those one shorter
    chunks = base.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("more"), "rest", "word")
    chunks = chunks.select(F.xxhash64(F.length("word"), "more").alias("key"), "more", "rest", "word")
    grams = base.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("more"), "rest", "word")
    grams = grams.filter(F.length("word") >= F.col("more")).select(F.xxhash64(F.length("word") - F.col("more"), "more").alias("key"), "more", "rest", "word")
    found = []
    while True:
        left, right = saved(_split(chunks, True)), saved(_split(grams, False))
        # how many pairs each key would make, and whether it can be split further
        count = left.groupBy("key").agg(F.count("*").alias("_l"), F.max(F.length("rest")).alias("_r"))
        many = count.join(right.groupBy("key").agg(F.count("*").alias("_g")), "key").filter(f"_r > 1 and _l * _g > {limit}")
        many = saved(many.select(F.col("key").alias("hot"), F.lit(True).alias("_hot")))
        some = many.limit(1).count()
        if some:
            left, right = (saved(side.join(many, F.col("key") == F.col("hot"), "left").drop("hot")) for side in (left, right))
            chunks, grams = (side.filter("_hot").drop("_hot") for side in (left, right))
            left, right = (side.filter("_hot is null").drop("_hot") for side in (left, right))
        a = left.select("key", F.col("word").alias("a"))
        b = right.select("key", F.col("word").alias("b"), "more")
        met = a.join(b, "key").filter((F.col("more") == 1) | (F.col("a") < F.col("b")))
        met = met.filter((F.length("b") == F.length("a") + F.col("more")) & (F.levenshtein("a", "b", 1) == 1))
        found.append(met.select("a", "b"))
        if not some:
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return saved(pairs.distinct())  # both chunks may be whole


def variant_groups(words: DataFrame, ratio: int = 5, limit: int = PAIRS) -> DataFrame:
    """Per word its near words, its form and the root that the forms lead to: ``word, form, root, n, n_near, form_n``.

    ``words`` has ``word, n``, one row per word.  The form is the near word of largest ``n`` (ties: smallest in
    code-point order) if its ``n`` is at least ``ratio`` times the word's, else null.  ``n`` grows with every step
    from a word to its form (``ratio`` > 1), so the way ends; it is followed by doubling, in as many rounds as the
    logarithm of its length.  Null words give no row, an empty table none.  ``limit`` as in :func:`near_pairs`.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = saved(words.filter("word is not null").select("word", "n"))
    pairs = near_pairs(words, limit)
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select("b", "a"))
    links = links.join(words.select(F.col("word").alias("near"), F.col("n").alias("_nn")), "near")
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("_nn")).alias("k"), F.col("near").alias("w"))).alias("_b"))
    rows = words.join(best, "word", "left")
    strong = -F.col("_b.k") >= F.col("n") * ratio
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("_b.w")).alias("form"), F.when(strong, -F.col("_b.k")).alias("form_n"))
    rows = saved(rows)
    steps = saved(rows.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = saved(steps.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on")))
        steps = longer.select("word", "root")
        if not longer.filter("_on").limit(1).count():
            break
    return rows.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
