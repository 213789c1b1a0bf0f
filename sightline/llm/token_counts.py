"""Token counts with the whole-token shortcut.

Offline, every string of the vocabulary is put through the tokenizer's merges by itself; those that come
out as one token, and that the pre-tokenizer would leave in one piece, are proven to count one wherever
they are a pre-token.  Texts are split into pre-tokens by the tokenizer's own pattern; proven ones are
counted directly and only the rest is merged, once per distinct pre-token and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

#: Pre-token pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct merged pre-tokens a task remembers, and the longest of them in characters; neither changes a count.
MEMORY, LONGEST = 200_000, 64


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return [table[b] for b in range(256)]


class Counts(dict):
    """Tokens per pre-token: proven whole tokens from the start, others merged when first met."""

    def __init__(self, tokenizer: Tokenizer, letters: list[str], whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.model, self.letters, self.room = tokenizer.model, letters, MEMORY

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize("".join([self.letters[b] for b in piece.encode()])))
        if self.room > 0 and len(piece) <= LONGEST:
            self.room -= 1
            self[piece] = n
        return n


def whole_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and come out of the merges as one token."""
    split, back = regex.compile(PATTERN), {c: b for b, c in enumerate(byte_letters())}
    found = set()
    for token in tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(back[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # not the letters of bytes, or a part of a character: never a pre-token
        if split.fullmatch(text) and len(tokenizer.model.tokenize(token)) == 1:
            found.add(text)
    return frozenset(found)


def special_strings(tokenizer: Tokenizer) -> list[str]:
    """Added tokens, which the library recognises inside texts by default; only plain ones are supported."""
    added = tokenizer.get_added_tokens_decoder().values()
    for t in added:
        if t.lstrip or t.rstrip or t.single_word or t.normalized:
            raise ValueError(f"added token {t.content!r} matches more than its own string")
    return sorted((t.content for t in added), key=len, reverse=True)


def _counter(path: str, whole: frozenset[str], keep: list[str], limit: int, text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.from_file(path)
        counts = Counts(tokenizer, byte_letters(), whole)
        pieces, special = regex.compile(PATTERN).findall, special_strings(tokenizer)
        cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        get = counts.__getitem__
        for batch in batches:
            tokens, size = [], []
            for text in batch.column(text_column).to_pylist():
                text = text or ""
                size.append(len(text.encode()))
                parts = [text]
                if cut and any(s in text for s in special):
                    parts = cut.split(text)
                tokens.append(sum(sum(map(get, pieces(p))) for p in parts) + len(parts) - 1)
            over = pa.array([n > limit for n in tokens])
            columns = [*[batch.column(c) for c in keep], pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), over]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to the columns ``keep`` (all) of every row.

    ``path`` is a byte-level BPE file of the tokenizers library, at that place on every machine.  Counts
    are the library's without begin, end or added special tokens, truncation or padding; special strings in
    a text are one token.  Null counts as empty.  The proven strings, at most the vocabulary, go to every task.
    """
    tokenizer = Tokenizer.from_file(path)
    names = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in keep or docs.columns if c not in names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    run = _counter(path, whole_tokens(tokenizer), keep, limit, text)
    rows = docs.select(*keep, *[text] * (text not in keep))
    return rows.mapInArrow(run, f"{schema}, n_bytes long, n_tokens long, over_limit boolean")
