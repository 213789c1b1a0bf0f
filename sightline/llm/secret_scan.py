"""Secret scans with a linear-chain conditional random field.

Tokens are tagged as secret begin, inside or outside.  Features are the token's shape, key words and
separators before it, and properties of the file; Viterbi decodes.  The field is trained here on a
bounded sample of texts whose secrets are known by rule (assignments to a password or key, access key
ids, long hexadecimal runs); it then finds strings that look and stand alike but fit no rule.  Spans by
rule always stay; tagged spans are added where no rule's span is.

Away from digits and key words all tokens have the same features, and the trained field keeps them
outside by more than transitions can return (checked per text).  There decoding is skipped without a
change in the result; were the check to fail, the whole text is decoded.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import saved

#: About so many texts at most, chosen by a hash, and so many sequences are fitted; longer stretches are several
#: sequences of so many tokens.
SAMPLE_ROWS, SAMPLE_SEQUENCES, SAMPLE_TOKENS = 20_000, 3_000, 48
ROUNDS, RATE, RIDGE = 250, 0.25, 1e-6
KINDS = ("assign", "access", "hex", "tagged")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs of 32 and more, as shorter ones are dropped
_STEMS = ("passw", "secret", "token", "api", "key", "credential")

_TOKEN = re.compile(r"""[^\s"'`=:;,<>(){}\[\]]+|["'`=:;,<>(){}\[\]]""")
_KEY = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|access_?key|credentials?|private_?key)$", re.I | re.A)
_DIGIT = re.compile("[0-9]")
_ANCHOR = re.compile(r"[0-9]+|pass|pwd|secret|token|key|credential", re.I | re.A)
#: How far, in characters and tokens, a key word acts; a decoded stretch reaches as far around its anchors.
REACH, BACK = 64, 3
OUT, BEGIN, INSIDE = 0, 1, 2
_FEATURES = 26
_FILE = (20, 21, 22)


def rule_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by rule, leftmost and non-overlapping per kind, by start and then kind as listed."""
    spans = []
    low = text.lower()
    if any(stem in low for stem in _STEMS[:4]):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _shape(word: str) -> list[int]:
    """Features of a token by itself; a token without digits has none but for key words."""
    if _KEY.search(word):
        return [13]
    if not _DIGIT.search(word):
        return []
    n = len(word)
    letters = sum(c.isalpha() for c in word)
    found = [1, 6 if n < 8 else 7 if n < 16 else 8 if n < 32 else 9]
    if not letters:
        found.append(10)
    elif all(c.isalnum() for c in word):
        found.append(2)
    if any(c.islower() for c in word) and any(c.isupper() for c in word):
        found.append(3)
    if n >= 16 and all(c in "0123456789abcdef" for c in word):
        found.append(4)
    if word.startswith("AKIA"):
        found.append(5)
    if "@" in word or "://" in word or word.count(".") >= 2:
        found.append(11)
    if sum(a.isdigit() != b.isdigit() for a, b in zip(word, word[1:], strict=False)) >= 4:
        found.append(12)
    if letters and 2 * letters < n:
        found.append(24)
    return found


def file_features(text: str) -> list[int]:
    """Properties of the whole text: key words, code, many digits."""
    low = text.lower()
    digits = sum(map(text.count, "0123456789"))
    checks = (any(s in low for s in _STEMS), "{" in text or ";" in text, digits * 20 > len(text))
    return [f for f, on in zip(_FILE, checks, strict=True) if on]


def _tokens(text: str, start: int, end: int, of_file: list[int]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Tokens of a stretch with their features; the stretch begins and ends at white space."""
    where, features = [], []
    words: list[str] = []
    keys: list[int] = []
    for m in _TOKEN.finditer(text, start, end):
        word, i = m[0], len(words)
        found = [0, *of_file, *_shape(word)]
        separated = i > 0 and words[-1] in "=:" or i > 1 and words[-1] in "\"'`" and words[-2] in "=:"
        near = keys and i - keys[-1] <= BACK + 2 and m.start() - where[keys[-1]][1] <= REACH
        if near:
            found.append(14)
            if separated:
                found.append(15)
                if len(word) >= 8:
                    found.append(16)
        if 1 in found:
            if separated:
                found.append(17)
            if i and 1 in features[-1]:
                found.append(18)
            if i and words[-1] in "\"'`":
                found.append(19)
        if 13 in found:
            keys.append(i)
        words.append(word)
        where.append(m.span())
        features.append(found)
    return where, features


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """Where digits or key words are, with REACH characters around, widened to white space; disjoint."""
    start = end = -1
    for m in _ANCHOR.finditer(text):
        if end >= 0 and m.start() - REACH <= end:
            end = max(end, m.end() + REACH)
            continue
        if end >= 0:
            yield start, _widen(text, end)
        start, end = m.start() - REACH, m.end() + REACH
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        start = max(0, start)
    if end >= 0:
        yield start, _widen(text, end)


def _widen(text: str, end: int) -> int:
    while end < len(text) and not text[end].isspace():
        end += 1
    return min(end, len(text))


def _merged(text: str) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in _stretches(text):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@dataclass(frozen=True)
class Field:
    """Emission weights per feature and tag, and transitions tag -> tag (inside never follows outside)."""

    emit: np.ndarray
    move: np.ndarray

    def plain_stays_out(self, of_file: list[int]) -> bool:
        """Whether a best path is outside on every token without features of its own, more than one away from others.

        Taking such tokens out of a secret must gain: for a secret wholly among them, for the end of one
        that reaches into them, and for its start (where the first token left becomes the begin).
        """
        e, t = self.emit[[0, *of_file]].sum(0), self.move
        gain = e[OUT] - max(e[BEGIN], e[INSIDE])
        within, leave = t[1:, 1:].max(), t[1:, OUT].max()
        end = gain + min(t[x, OUT] - t[x, 1:].max() for x in (BEGIN, INSIDE)) + t[OUT, OUT] - leave
        start = gain + t[OUT, OUT] - within + min(0.0, e[BEGIN] - e[INSIDE]) + (t[BEGIN] - t[INSIDE]).min()
        return t[OUT, OUT] >= max(within, leave, t[OUT, BEGIN]) and min(gain, end, start) > 0

    def viterbi(self, features: list[list[int]], after_out: bool = False, before_out: bool = False) -> list[int]:
        """Best tags, between outside tokens if said so; plain floats, as stretches are short and tags three."""
        known: dict[tuple, list[float]] = {}
        move = self.move.tolist()
        best, back = move[OUT] if after_out else [0.0, 0.0, -1e9], []
        for i, found in enumerate(features):
            at = tuple(found)
            if at not in known:
                known[at] = self.emit[found].sum(0).tolist()
            if i:
                paths = [[best[a] + move[a][b] for a in (0, 1, 2)] for b in (0, 1, 2)]
                back.append([p.index(max(p)) for p in paths])
                best = [max(p) for p in paths]
            best = [x + e for x, e in zip(best, known[at], strict=True)]
        if not features:
            return []
        if before_out:
            best = [x + move[a][OUT] for a, x in enumerate(best)]
        tags = [best.index(max(best))]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return tags[::-1]


def tagged_spans(text: str, field: Field) -> list[tuple[int, int]]:
    """Secrets that the field finds in a whole text."""
    of_file = file_features(text)
    stretches = _merged(text) if field.plain_stays_out(of_file) else [(0, len(text))]
    spans: list[list[int]] = []
    for a, b in stretches:
        where, features = _tokens(text, a, b, of_file)
        previous = OUT
        for (s, e), tag in zip(where, field.viterbi(features, a > 0, b < len(text)), strict=True):
            if tag == BEGIN or tag == INSIDE and previous == OUT:
                spans.append([s, e])
            elif tag == INSIDE:
                spans[-1][1] = e
            previous = tag
    return [(s, e) for s, e in spans]


def _reach(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts in ascending order, and the largest end up to each: what touches a place is found by bisection."""
    spans = sorted(spans)
    return [a for a, _ in spans], list(accumulate((b for _, b in spans), max))


def _covering(values: list[tuple[int, int]], places: list[int]) -> list[tuple[int, int] | None]:
    """For ascending places the first of the sorted values that holds each; one pass over both."""
    out, i = [], 0
    for s in places:
        while i < len(values) and values[i][1] <= s:
            i += 1
        out.append(values[i] if i < len(values) and values[i][0] <= s else None)
    return out


def all_spans(text: str | None, field: Field) -> list[tuple[str, int, int]]:
    """Spans by rule, and tagged ones that touch none of them."""
    if not text:
        return []
    spans = rule_spans(text)
    starts, reach = _reach([(a, b) for _, a, b in spans])
    before = lambda e: bisect_left(starts, e)
    extra = [("tagged", s, e) for s, e in tagged_spans(text, field) if not before(e) or reach[before(e) - 1] <= s]
    return sorted(spans + extra, key=lambda s: (s[1], KINDS.index(s[0])))


# --- training ----------------------------------------------------------------------------------------


def _examples(longest: int):
    """Tagged pieces of at most ``longest`` tokens; ``before`` is the tag ahead of a piece, null where the stretch begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, befores, rows, tags = [], [], [], [], []
            for draw, text in zip(batch.column("_text").to_pylist(), batch.column("text").to_pylist(), strict=True):
                # of an assignment the value is the secret, not the key word
                values = sorted((_ASSIGN.match(text, s).start(2) if kind == "assign" else s, e) for kind, s, e in rule_spans(text))
                of_file = file_features(text)
                begins, reach = _reach(values)
                for a, b in _merged(text):
                    where, features = _tokens(text, a, b, of_file)
                    near = [v for v in values[bisect_right(reach, a) : bisect_left(begins, b)] if a < v[1]]
                    inside = _covering(near, [s for s, _ in where])
                    marks = [OUT if v is None else INSIDE if i and inside[i - 1] == v else BEGIN for i, v in enumerate(inside)]
                    for i in range(0, len(marks), longest):
                        texts.append(draw)
                        starts.append(where[i][0])
                        befores.append(marks[i - 1] if i else None)
                        rows.append(features[i : i + longest])
                        tags.append(marks[i : i + longest])
            columns = [pa.array(texts, pa.int64()), pa.array(starts, pa.int32()), pa.array(befores, pa.int32())]
            columns += [pa.array(rows, pa.list_(pa.list_(pa.int32()))), pa.array(tags, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_text", "start", "before", "features", "tags"])

    return run


def fit(
    sequences: list[tuple[list[list[int]], list[int]]], weights: list[float] | None = None, before: list[int | None] | None = None
) -> Field:
    """Maximise the conditional likelihood by gradient steps over all sequences at once, each counted by its weight (1).

    A sequence with a tag ``before`` it goes on from there: its first transition is fitted, too.
    """
    n, longest = max(1, len(sequences)), max([len(t) for _, t in sequences], default=1)
    x = np.zeros((n, longest, _FEATURES))
    y = np.zeros((n, longest), int)
    on = np.zeros((n, longest), bool)
    often = np.ones((n, 1))
    often[: len(sequences), 0] = weights or 1.0
    ahead_of = np.zeros((n, 3))
    for i, tag in enumerate(before or []):
        if tag is not None:
            ahead_of[i, tag] = 1
    begins = 1 - ahead_of.sum(1, keepdims=True)
    for i, (features, tags) in enumerate(sequences):
        for j, f in enumerate(features):
            x[i, j, f] = 1
        y[i, : len(tags)], on[i, : len(tags)] = tags, True
    emit, move = np.zeros((_FEATURES, 3)), np.zeros((3, 3))
    banned = np.zeros((3, 3))
    banned[OUT, INSIDE] = -1e4
    first = np.array([0.0, 0.0, -1e4])
    counted = on * often
    gold = np.eye(3)[y] * on[..., None]
    both = counted[:, 1:, None, None]
    gold_move = (gold[:, :-1, :, None] * gold[:, 1:, None, :] * both).sum((0, 1)) + (ahead_of * often).T @ gold[:, 0]
    means, squares = [[np.zeros_like(emit), np.zeros_like(move)] for _ in range(2)]
    lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
    total = max(1.0, counted.sum())
    for step_no in range(1, ROUNDS + 1):
        e, t = x @ emit, move + banned
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0] + begins * first + ahead_of @ t
        for j in range(1, longest):
            step = lse(ahead[:, j - 1, :, None] + t, 1) + e[:, j]
            ahead[:, j] = np.where(on[:, j, None], step, ahead[:, j - 1])
        for j in range(longest - 2, -1, -1):
            step = lse(t + (e[:, j + 1] + behind[:, j + 1])[:, None, :], 2)
            behind[:, j] = np.where(on[:, j + 1, None], step, 0.0)
        z = lse(ahead[:, -1], 1)
        one = np.exp(ahead + behind - z[:, None, None])
        two = np.exp(ahead[:, :-1, :, None] + t + (e + behind)[:, 1:, None, :] - z[:, None, None, None]) * both
        moved = two.sum((0, 1)) + (ahead_of * often).T @ one[:, 0]
        slopes = [np.tensordot(x, (gold - one) * counted[..., None], ((0, 1), (0, 1))) / total - RIDGE * emit, (gold_move - moved) / total - RIDGE * move]
        for k, g in enumerate(slopes):  # steps with decaying means of the slope and its square
            means[k] = 0.9 * means[k] + 0.1 * g
            squares[k] = 0.9 * squares[k] + 0.1 * g * g
        ups = [RATE * m / (1 - 0.9**step_no) / (np.sqrt(q / (1 - 0.9**step_no)) + 1e-9) for m, q in zip(means, squares, strict=True)]
        emit, move = emit + ups[0], move + ups[1]
    return Field(emit, move + banned)


def _drawn(examples: DataFrame, limit: int) -> list[tuple[list[list[int]], list[int], float, int | None]]:
    """At most ``limit`` different sequences with their weights and the tags before them, those with and without a secret drawn separately.

    Rows ``draw, before, features, tags``: every occurrence has its own ``draw`` in [0, 1).  Equal sequences are one with a
    count, drawn by its lowest occurrence; a weight is the count over the chance to be drawn.  Either kind has half
    of the limit, and what the other leaves of its half.
    """
    each = examples.groupBy("before", "features", "tags").agg(F.count("*").alias("times"), F.min("draw").alias("draw"))
    each = saved(each.withColumn("secret", F.exists("tags", lambda t: t != OUT)))
    lowest = {kind: each.filter(F.col("secret") == kind).orderBy("draw").limit(limit + 1).collect() for kind in (True, False)}
    found = []
    for kind, rows in lowest.items():
        share = max(limit // 2, limit - len(lowest[not kind]))
        upto = rows[share]["draw"] if len(rows) > share else 1.0
        for r in rows[:share]:
            chance = -np.expm1(r["times"] * np.log1p(-upto)) if upto < 1 else 1.0
            found.append((r["features"], r["tags"], r["times"] / chance, r["before"]))
    return found


def train(
    docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_sequences: int = SAMPLE_SEQUENCES, sample_tokens: int = SAMPLE_TOKENS
) -> Field:
    """Fit the field on a bounded sample of ``docs`` (needs ``doc_id, text``), tagged by rule.

    Rows are chosen by a hash of id and text, sequences by one of id, text and place, so the sample depends on the
    rows alone and copies do not push others out.  Stretches of more than ``sample_tokens`` are drawn from in pieces
    of so many.  Without any example the weights are zero and everything is outside.
    """
    texts = docs.select("text", F.xxhash64("doc_id", "text").alias("_text")).filter("text is not null and text <> ''")
    rows = docs.count()
    if rows > sample_rows:
        texts = texts.filter(F.pmod("_text", F.lit(1_000_000)) < int(1_000_000 * sample_rows / rows))
    examples = texts.mapInArrow(_examples(sample_tokens), "_text long, start int, before int, features array<array<int>>, tags array<int>")
    place = F.pmod(F.xxhash64("_text", "start"), F.lit(1 << 53)) / float(1 << 53)
    found = _drawn(examples.select(place.alias("draw"), "before", "features", "tags"), sample_sequences)
    return fit([f[:2] for f in found], [f[2] for f in found], [f[3] for f in found])


# --- application -------------------------------------------------------------------------------------

_SPANS = "array<struct<kind: string, start: int, end: int>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every stretch covered by spans replaced by one mark."""
    parts, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _scanner(field: Field, keep: list[str], redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = [all_spans(t, field) for t in texts]
            listed = [[{"kind": k, "start": s, "end": e} for k, s, e in found] for found in spans]
            columns = [*[batch.column(c) for c in keep], pa.array(listed, _SPANS_ARROW)]
            if redact:
                columns.append(pa.array([redacted(t, f) if f else t for t, f in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "spans", *["redacted"] * redact])

    return run


def scan(docs: DataFrame, field: Field, keep: list[str] | None = None, redact: bool = False) -> DataFrame:
    """Secrets of each row's ``text``: the columns ``keep`` (all) with ``spans`` added, in code points, end exclusive.

    ``spans`` is ordered by start, then kind; with ``redact`` the cleaned text comes as ``redacted``.
    Null and empty texts have no spans (and stay as they are); a column named like a result is replaced.
    """
    keep = [c for c in keep or docs.columns if c not in ("spans", "redacted")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    schema += f", spans {_SPANS}" + ", redacted string" * redact
    return docs.select(*keep, *["text"] * ("text" not in keep)).mapInArrow(_scanner(field, keep, redact), schema)


def redact_secrets(docs: DataFrame, mark_length: bool = True) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced, and ``n_chars`` of changed rows counted anew; no row is dropped."""
    columns = docs.columns
    clean = scan(docs.withColumnsRenamed({"spans": "_spans", "redacted": "_redacted"}), train(docs), redact=True)
    changed = F.size("spans") > 0
    if mark_length and "n_chars" in columns:
        clean = clean.withColumn("n_chars", F.when(changed, F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    clean = clean.withColumn("text", F.when(changed, F.col("redacted")).otherwise(F.col("text"))).drop("spans", "redacted")
    return clean.withColumnsRenamed({"_spans": "spans", "_redacted": "redacted"}).select(*columns)
