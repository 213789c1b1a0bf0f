"""Seeded orderings and draws that depend only on the key and the seed.

``seeded`` is the default (64-bit, JVM-side).  ``portable=True`` uses MD5 text instead,
which any SQL engine reproduces; registered queries use it so that they can be checked.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(*cols: str | Column, seed: int) -> Column:
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.concat_ws("|", *parts, F.lit(str(seed)))


def seeded(*cols: str | Column, seed: int = 0, portable: bool = False) -> Column:
    """Sort key that shuffles rows the same way on every run."""
    if portable:
        return F.md5(_text(*cols, seed=seed))
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols], F.lit(seed))


def seeded_int(*cols: str | Column, seed: int = 0, portable: bool = False) -> Column:
    """Non-negative BIGINT draw."""
    if portable:
        return F.conv(F.substring(F.md5(_text(*cols, seed=seed)), 1, 12), 16, 10).cast("bigint")
    return F.shiftrightunsigned(seeded(*cols, seed=seed), 1)


# cumulative Poisson(1) probabilities P(X <= k), k = 0..9
POISSON_ONE = tuple(itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(10)))


def poisson_draw(*cols: str | Column, seed: int = 0, portable: bool = False) -> Column:
    """Uniform draw per key for :func:`poisson_weight`: 12 hex digits, or a 63-bit integer."""
    if portable:
        return F.substring(F.md5(_text(*cols, seed=seed)), 1, 12)
    return seeded_int(*cols, seed=seed)


def poisson_weight(draw: str | Column, portable: bool = False) -> Column:
    """Poisson(1) weight of a draw (pass a column, so that the draw is computed once)."""
    d = F.col(draw) if isinstance(draw, str) else draw
    limit = (lambda p: F.lit(f"{int(p * 2**48):012x}")) if portable else (lambda p: F.lit(int(p * 2**63)))
    out = F
    for k, p in enumerate(POISSON_ONE):
        out = out.when(d < limit(p), F.lit(k))
    return out.otherwise(F.lit(len(POISSON_ONE)))
