"""Token ids in Parquet files: list columns with dictionary pages, delta-encoded places, small pages with an index.

Rows are range-sorted by id, tokenised where they lie, and written by Spark's Parquet writer.  The ids of a
document are one list, its pages coded by the dictionary of a row group; the document's place is a plain number
column, delta-encoded.  Row groups and pages have stated sizes and every page has its bounds in the column index,
so that a reader of places skips the lists altogether and a reader of a few documents or of a stretch of the token
stream skips all pages but those it needs.

A file knows the places of its documents from its own beginning.  How many tokens come before it is the sum over
the files before, taken from the place columns of the written files: one row per file, kept as a second table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from sightline.llm.common import small_side
from sightline.llm.token_counts import byte_letters
from sightline.session import work_folder

#: Bytes of text that go to one file, bytes of a row group and of a page, and rows a page may have.
FILE_TEXT, ROW_GROUP, PAGE, PAGE_ROWS = 512 << 20, 64 << 20, 256 << 10, 2_000
#: Pieces a worker remembers, and the longest of them in characters; neither changes an id.
MEMORY, LONGEST = 300_000, 64
#: Ids a task gathers before it sends them on.
SEND = 1 << 20

_LETTER, _NUMBER, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
#: The pre-token pattern below with its classes spelled out for the first 256 code points.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
# The configuration that the shortcut is proven for (fixed values of the file format).
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class Encoder:
    """Ids of a text as the library gives them without added special tokens, little-endian, four bytes each.

    White space always ends a pre-token and is dropped, code points below 256 are their own normal form and
    change case one by one: under the configuration above a text of them falls into pre-tokens by a plain
    pattern, and each distinct one is merged once.  Other texts go through the same way chunk by chunk between
    white space, and only chunks with further code points or a special string through the whole library.
    Files of another configuration are encoded by the library alone.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        config = json.loads(Path(path).read_text())
        added = config.get("added_tokens") or []
        known = (config.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
        known &= (config.get("pre_tokenizer") or {}).get("pretokenizers") == [_SPLIT, _BYTES]
        known &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in added)
        self.special = [t["content"] for t in added]
        self.shortcut = known
        self.letters = dict(enumerate(byte_letters()))
        self.pieces: dict[str, bytes] = _Memo(self._merged)
        self.chunks: dict[str, bytes] = _Memo(self._whole)

    def _merged(self, piece: str) -> bytes:
        found = self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return np.array([t.id for t in found], "<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))

    def __call__(self, text: str) -> bytes:
        if not self.shortcut:
            return self._whole(text)
        special = any(s in text for s in self.special)
        if not special and _low(text):
            return self._plain(text)
        out = []
        for chunk in re.split(f"[{_SPACE}]+", text):
            odd = not _low(chunk) or (special and any(s in chunk for s in self.special))
            out.append(self.chunks[chunk] if odd else self._plain(chunk))
        return b"".join(out)


class _Memo(dict):
    """What ``make`` gives, remembered for short keys while there is room."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < MEMORY and len(key) <= LONGEST:
            self[key] = value
        return value


def _low(text: str) -> bool:
    """Whether all code points are below 256."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per file and worker process, with what it remembers."""
    return Encoder(path)


def _encode(path: str, end: int | None, keep: list[str], text_column: str):
    close = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, done = batch.column(text_column), 0
            while done < batch.num_rows:
                ids, size, first = [], 0, done
                while done < batch.num_rows and size < SEND:
                    ids.append(encode(texts[done].as_py() or "") + close)
                    size, done = size + len(ids[-1]) // 4, done + 1
                n = np.array([len(i) // 4 for i in ids], np.int64)
                ends = n.cumsum()
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), flat)
                kept = [batch.column(c).slice(first, done - first) for c in keep]
                places = [pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends - n), pa.array(n)]
                yield pa.RecordBatch.from_arrays([*kept, *places, lists], names=[*keep, "_part", "_place", "n_tokens", "ids"])
                at += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, folder: str | None = None, end: int | None = 1, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> str:
    """Write the ids of every row's whole text, in ascending order of ``key``, and return the folder.

    ``path`` is a file of the tokenizers library, at that place on every machine; no special tokens are added but
    the id ``end`` after each document (None: none).  ``keep`` (default: the key) names the columns kept beside the
    ids; ``text``, ``n_tokens``, ``ids`` and names that begin with ``_`` are not kept.  Null keys come first; rows of
    one key are ordered by a hash of their kept columns and text, and equal rows are interchangeable.  A null text
    is an empty document, an empty table gives files without rows.

    Files hold about ``FILE_TEXT`` bytes of text each, at least as many files as the session has shuffle partitions
    unless the table is small; a range that repeats one row very often is split by the rows' places in the input.
    """
    spark = docs.sparkSession
    folder = folder or work_folder(spark)
    own = ("n_tokens", "ids")
    keep = [c for c in dict.fromkeys([key, *(keep or [])]) if c not in own and c != text and not c.startswith("_")]
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions")) if size > 1 << 20 else 1
    order = [F.col("_k"), F.col("_h"), F.col("_n")]
    rows = docs.select(*keep, *[text] * (text not in keep), F.col(key).alias("_k"))
    rows = rows.withColumns({"_h": F.xxhash64(*keep, text), "_n": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(max(at_least, -(-size // FILE_TEXT)), *order).sortWithinPartitions(*order).drop("_k", "_h", "_n")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    encoded = dealt.mapInArrow(_encode(path, end, keep, text), f"{kinds}, _part int, _place long, n_tokens long, ids array<int>")
    writer = encoded.write.option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("parquet.page.row.count.limit", PAGE_ROWS)
    # numbers that only grow are smaller as differences; token ids repeat
    for column in ("_part", "_place", "n_tokens", key):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer = writer.option("parquet.enable.dictionary", "true").option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd")
    writer.parquet(f"{folder}/tokens")
    stored = _stored(spark, folder).groupBy("_part").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    before = F.sum("tokens").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    stored.withColumn("_before", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{folder}/files")
    return folder


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/tokens")


def file_table(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file with rows: ``part, documents, tokens, first_key, last_key`` and ``start``, the tokens before it."""
    return spark.read.parquet(f"{folder}/files").withColumnsRenamed({"_part": "part", "_before": "start"})


def read_tokens(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """All documents with ``start`` (the ids of all documents before), ``n_tokens`` and ``ids``, and the kept columns.

    With ``first`` or ``last`` only documents that hold one of the stream's ids ``first <= place < last``: other
    files are not opened, other pages not read.  Columns that are not selected are not read either, so that a
    selection without ``ids`` costs the places alone.
    """
    files = spark.read.parquet(f"{folder}/files").select(F.col("_part").alias("_file"), "_before", "tokens")
    rows = _stored(spark, folder)
    if first is not None or last is not None:
        low, high = first or 0, (1 << 63) - 1 if last is None else last
        wanted = files.filter((F.col("_before") + F.col("tokens") > low) & (F.col("_before") < high))
        ends = wanted.agg(F.min("_file"), F.max("_file"), F.min("_before"), F.max(F.when(F.col("_before") <= low, F.col("_before"))), F.max("_before")).first()
        rows = rows.filter(F.col("_part").between(ends[0], ends[1])) if ends[0] is not None else rows.limit(0)
        if ends[0] is not None and ends[0] == ends[1]:
            # within one file the place itself can be pushed to the page index
            rows = rows.filter(F.col("_place") < high - ends[2])
        place = F.col("_before") + F.col("_place")
        met = rows.join(small_side(wanted), F.col("_part") == F.col("_file"))
        met = met.filter((place < high) & (place + F.col("n_tokens") > low))
    else:
        met = rows.join(small_side(files), F.col("_part") == F.col("_file"))
    return met.withColumn("start", F.col("_before") + F.col("_place")).drop("_part", "_file", "_before", "_place", "tokens")


def read_documents(spark: SparkSession, folder: str, keys: list, key: str = "doc_id") -> DataFrame:
    """The documents with these keys, with ``start``; pages whose bounds exclude the keys are not read."""
    return read_tokens(spark, folder).filter(F.col(key).isin(*keys))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from zlib import crc32

    for batch in batches:
        lists = batch.column("ids")
        offsets = lists.offsets.to_numpy()
        flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        crcs = [crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        names = [n for n in batch.schema.names if n != "ids"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(crcs, pa.int64())], names=[*names, "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``, the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name != "ids")
    return tokens.mapInArrow(_crc, f"{kinds}, ids_crc32 long")
