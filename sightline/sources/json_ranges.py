"""Entries of JSON documents of any size, read in byte ranges by many tasks, whole documents on one line included.

Where an entry begins in a range depends on everything before it: whether a string is open, whether a backslash is,
how many brackets are.  Two passes find out.  The first reads every range by itself and reports what it does to each
state it may begin in: the state it ends in and how many brackets it leaves open.  Composed in order, a few numbers
per range, these give the state each range begins in.  The second pass then cuts the entries of its range; the last
one is read to its end in the ranges that follow.

Here and for file digests Python runs on executors outside ``sightline/llm``: no reader of Spark begins inside a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sightline.sources.file_pieces import read_range

#: Bytes of a range, of a piece read beyond it, and of the entries that a task sends at once.
RANGE, AHEAD, SEND = 16 << 20, 1 << 20, 4 << 20
_QUOTE, _ESCAPE, _COMMA = b'"\\,'
_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1


def _read(path: str, start: int, stop: int) -> np.ndarray:
    return np.frombuffer(read_range(path, start, stop), np.uint8)


def _real_quotes(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Positions of quotes that no backslash covers, and whether the byte after ``data`` is covered.

    ``escaped`` says so of the first byte.  A run of backslashes covers what follows if its length is odd; one that
    begins at a covered byte counts one less.
    """
    slashes = np.flatnonzero(data == _ESCAPE)
    firsts = slashes[np.diff(slashes, prepend=-2) != 1]
    quotes = np.flatnonzero(data == _QUOTE)

    def covered(at: np.ndarray) -> np.ndarray:
        """Whether an odd run ends right before these positions."""
        run = np.searchsorted(firsts, at - 1, "right") - 1
        after = (at > 0) & (run >= 0)
        after[after] = data[at[after] - 1] == _ESCAPE
        first = firsts[np.maximum(run, 0)] if len(firsts) else np.zeros_like(at)
        length = np.where(after, at - first, 0) - (after & escaped & (first == 0))
        return (length % 2 == 1) | ((at == 0) & escaped)

    return quotes[~covered(quotes)], bool(covered(np.array([len(data)]))[0])


def _brackets(data: np.ndarray, quotes: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions and steps of the brackets outside strings; ``inside``: the data begin within one."""
    at = np.flatnonzero(_STEP[data])
    at = at[(np.searchsorted(quotes, at) + inside) % 2 == 0]
    return at, _STEP[data[at]]


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            data = _read(row["path"], row["start"], row["stop"])
            quotes, after = _real_quotes(data, False)
            for escaped in (False, True):
                if escaped and data[0] in (_QUOTE, _ESCAPE):  # else a covered first byte changes nothing
                    quotes, after = _real_quotes(data, True)
                at = np.flatnonzero(_STEP[data])
                odd, steps = np.searchsorted(quotes, at) % 2 == 1, _STEP[data[at]]
                for inside in (False, True):
                    opened = int(steps[odd == inside].sum(dtype=np.int64))
                    out.append(row | {"inside": inside, "escaped": escaped, "to_inside": bool((len(quotes) + inside) % 2), "to_escaped": after, "opened": opened})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), *[(n, pa.bool_()) for n in ("inside", "escaped", "to_inside", "to_escaped")], ("opened", pa.int64())]))


def _cuts(data: np.ndarray, inside: bool, escaped: bool, depth: int) -> tuple[np.ndarray, np.ndarray, tuple[bool, bool, int]]:
    """Where entries begin and end in ``data`` (an end is the comma or bracket behind it), and the state after it."""
    quotes, after = _real_quotes(data, escaped)
    at, steps = _brackets(data, quotes, inside)
    depths = depth + np.cumsum(steps, dtype=np.int64)
    commas = np.flatnonzero(data == _COMMA)
    commas = commas[(np.searchsorted(quotes, commas) + inside) % 2 == 0]
    before = np.searchsorted(at, commas)
    commas = commas[(np.concatenate([[depth], depths])[before] if len(depths) else np.full(len(commas), depth)) == 1]
    begins = np.sort(np.concatenate([at[(steps > 0) & (depths == 1)], commas])) + 1
    ends = np.sort(np.concatenate([at[(steps < 0) & (depths == 0)], commas]))
    state = bool((len(quotes) + inside) % 2), after, int(depths[-1]) if len(depths) else depth
    return begins, ends, state


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def send(path: str, at: list[int], texts: list[bytes]) -> pa.RecordBatch:
        whole = [(a, t.decode()) for a, t in zip(at, texts, strict=True) if t.strip()]  # an empty container holds no entry
        return pa.RecordBatch.from_arrays([pa.array([path] * len(whole)), pa.array([a for a, _ in whole], pa.int64()), pa.array([t for _, t in whole], pa.string())], names=["path", "at", "entry"])

    for batch in batches:
        for row in batch.to_pylist():
            path, start, stop = row["path"], row["start"], row["stop"]
            data = _read(path, start, stop)
            begins, ends, state = _cuts(data, row["inside"], row["escaped"], row["depth"])
            raw, at, texts, size = data.tobytes(), [], [], 0
            close = np.searchsorted(ends, begins)
            for begin, i in zip(begins.tolist(), close.tolist(), strict=True):
                if i < len(ends):
                    text = raw[begin : ends[i]]
                else:
                    parts, place = [raw[begin:]], stop
                    while place < row["size"]:
                        more = _read(path, place, min(place + AHEAD, row["size"]))
                        _, ahead, state = _cuts(more, *state)
                        parts.append(more[: ahead[0]].tobytes() if len(ahead) else more.tobytes())
                        if len(ahead):
                            break
                        place += len(more)
                    text = b"".join(parts)
                at.append(start + begin)
                texts.append(text)
                size += len(text)
                if size >= SEND:
                    yield send(path, at, texts)
                    at, texts, size = [], [], 0
            yield send(path, at, texts)


def _composed(effects: list) -> list[tuple]:
    """The ranges of all files in order, with the size of the file and the state that each begins in."""
    known = {(e["path"], e["start"], e["inside"], e["escaped"]): (e["to_inside"], e["to_escaped"], e["opened"]) for e in effects}
    sizes: dict[str, int] = {}
    for e in effects:
        sizes[e["path"]] = max(sizes.get(e["path"], 0), e["stop"])
    placed, state = [], (False, False, 0)
    for path, start, stop in sorted({(e["path"], e["start"], e["stop"]) for e in effects}):
        inside, escaped, depth = state if start else (False, False, 0)
        placed.append((path, start, stop, sizes[path], inside, escaped, depth))
        inside, escaped, opened = known[(path, start, inside, escaped)]
        state = (inside, escaped, depth + opened)
    return placed


def scan_entries(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """Entries of the outermost objects or arrays of JSON files as text: ``path, at, entry``.

    An entry of an object is ``"key": value``, one of an array its element, as they stand in the file; ``at`` is its
    byte position and orders the entries of a file.  Files are cut into ranges of ``range_bytes``, each read by a task
    of its own, twice; an entry may be longer than a range.  The driver holds eight numbers per range.  Empty files
    and empty containers give no rows; texts that are not JSON give entries that the caller's parser refuses.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").collect()  # a listing
    ranges = [(f["path"], a, min(a + range_bytes, f["length"])) for f in files for a in range(0, f["length"], range_bytes)]
    schema = "path string, start long, stop long"
    if not ranges:
        return spark.createDataFrame([], "path string, at long, entry string")
    dealt = spark.createDataFrame(ranges, schema).repartition(len(ranges))
    effects = dealt.mapInArrow(_effects, f"{schema}, inside boolean, escaped boolean, to_inside boolean, to_escaped boolean, opened long").collect()
    begun = spark.createDataFrame(_composed(effects), f"{schema}, size long, inside boolean, escaped boolean, depth long")
    return begun.repartition(len(ranges)).mapInArrow(_entries, "path string, at long, entry string")
