"""Files read in pieces inside tasks, for work that no reader of Spark can do: byte ranges, and digests in constant memory.

Files are opened with ``pyarrow.fs``, so they lie in a store that it knows (a mounted path, HDFS, S3, GCS).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs

#: Bytes of a file that a digest holds at once.
PIECE = 8 << 20


def opened(path: str) -> pa.NativeFile:
    """A file by the path that Spark lists it under."""
    whole = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    store, name = fs.FileSystem.from_uri(whole)
    return store.open_input_file(name)


def read_range(path: str, start: int, stop: int) -> bytes:
    with opened(path) as file:
        return file.read_at(stop - start, start)


def hashed_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, bytes) -> (path, bytes, sha), the bytes as read."""
    for batch in batches:
        sizes, digests = [], []
        for path in batch.column("path").to_pylist():
            digest, size = hashlib.sha256(), 0
            with opened(path) as file:
                while piece := file.read(PIECE):
                    digest.update(piece)
                    size += len(piece)
            sizes.append(size)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["path", "bytes", "sha"])
