"""Hard negatives, token files and spelling variants against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from cases import rows
from tokenizers import Tokenizer

from sightline.llm import hard_negatives, spelling, token_files
from sightline.session import work_folder

WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))

# --- hard negatives ----------------------------------------------------------------------------------------------


def brute_negatives(data, every, k=5, m=3, low=50, high=95):
    out = []
    for i, lab, v in data:
        if i % every:
            continue
        scored = sorted((-int(np.dot(v, w)), j, l) for j, l, w in data if j != i)
        for s, j, _ in [x for x in scored if x[2] == lab][:k]:
            fits = [x for x in scored if x[2] != lab and low * -s <= 100 * -x[0] <= high * -s]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fits[:m])]
    return sorted(out)


def clustered(rng, n, dim, labels):
    centre = rng.normal(size=(labels, dim)) * 7
    label = rng.choice(labels, n, p=[0.4] + [0.6 / (labels - 1)] * (labels - 1))
    x = np.floor(centre[label] + rng.normal(size=(n, dim)) * 6)
    return [(i, int(c), [float(a) for a in v]) for i, (c, v) in enumerate(zip(label, x, strict=True))]


@pytest.mark.parametrize(("n", "dim", "labels", "tile"), [(700, 6, 4, 600), (400, 3, 40, 1 << 21), (260, 9, 3, 2000)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, n, dim, labels, tile):
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    monkeypatch.setattr(hard_negatives, "SPAN", 4)
    monkeypatch.setattr(hard_negatives, "ASK", 5)
    rng = np.random.default_rng(n)
    data = clustered(rng, n, dim, labels)
    data[10:90] = [(i, data[10][1], data[10][2]) for i in range(10, 90)]  # many equal vectors
    data[95] = (95, 1, [0.0] * dim)
    odd = [(5000, None, [1.0] * dim), (None, 1, [1.0] * dim), (5100, 1, None), (5200, 1, [float("nan")] * dim), (5300, 1, [None] * dim), (5400, 1, [1.0])]
    frame = spark.createDataFrame(data + odd, "vec_id long, label int, v array<double>").repartition(3)
    got = rows(hard_negatives.mine(frame, anchor_every=10, tile=tile))
    want = brute_negatives(data, 10)
    assert len(want) > 50
    assert sorted(got) == want


def test_hard_negatives_of_few_rows(spark):
    schema = "vec_id long, label long, v array<double>, anchor string"
    few = [(0, 1, [4.0, 0.0], "x"), (1, 1, [5.0, 1.0], "y"), (2, 2, [3.0, 9.0], "z")]
    frame = spark.createDataFrame(few, schema)
    assert rows(hard_negatives.mine(frame, 10)) == [(0, 1, 1, 2, 20, 12)]
    assert hard_negatives.mine(frame.limit(0), 10).count() == 0
    assert hard_negatives.mine(frame.filter("vec_id > 0"), 10).count() == 0
    only = hard_negatives.mine(spark.createDataFrame([(0, 1, [1.0], ""), (10, 1, [-1.0], "")], schema), 10)
    assert only.count() == 0  # a negative positive score has an empty window
    twice = spark.createDataFrame([few[0], few[0], *few[1:]], schema)
    assert rows(hard_negatives.mine(twice, 10)) == [(0, 1, 1, 2, 20, 12)] * 2


def test_tree_bounds_hold_every_product():
    rng = np.random.default_rng(3)
    x, labels = np.floor(rng.normal(size=(900, 5)) * 20), np.sort(rng.integers(0, 5, 900))
    leaves = hard_negatives._leaves(x, labels, [0, 3, 1])
    order = np.concatenate(leaves)
    assert sorted(order.tolist()) == list(range(900)) and max(map(len, leaves)) <= hard_negatives.LEAF
    kind, vectors = hard_negatives._small(x[order])
    row = {"ids": order.astype(np.int64).tobytes(), "labels": labels[order].astype(np.int64).tobytes(), "sizes": np.array([len(a) for a in leaves]).tobytes(), "kind": kind, "vectors": vectors}
    tree, q = hard_negatives.Tree(row, 5), np.floor(rng.normal(size=(7, 5)) * 9)
    upper, lower = tree.bounds(q)
    scores = q @ x[order].T
    for leaf, (a, b) in enumerate(zip(tree.starts, tree.ends, strict=True)):
        assert (scores[:, a:b].max(1) <= upper[0][:, leaf]).all() and (scores[:, a:b].min(1) >= lower[0][:, leaf]).all()
    assert (upper[-1][:, 0] >= scores.max(1)).all() and kind == "<i1"


# --- token files -------------------------------------------------------------------------------------------------

ODD_TEXTS = [
    "", None, " ", "Hello, World's", "don't we'll I'D", "A\x1cB\x1d.\x1e", "x y　z\xa0w\x85v", "Σίσυφος ΟΔΟΣ", "é É ́a a ́", "ﬁ Ǆ İ ß ẞ",
    "<|endoftext|>", "a<|startoftext|>b <|endoftext|> c", "<|ENDOFTEXT|>", "日本語テスト 12½²³ x²", "no\u0000null\u0007", "'s'S 're'RE", "_a_1__2", "ªºµ¼", "🙂🙂a🙂", "\t\n\v\f\r a",
    "w" * 30_000, "ab1!" * 20_000, "٣٤٥ Ⅷ", "​﻿x", "¡Hola! ¿qué? ÀÉÎ",
]


@pytest.mark.parametrize("path", [WORD_BPE, str(public_tokenizers.path("byte_bpe_50k.json"))])
def test_encoder_equals_the_library(path):
    whole, encode = Tokenizer.from_file(path), token_files.Encoder(path)
    rng = random.Random(4)
    letters = [chr(i) for i in range(256)] + ["'s", " ", " ", "é", "Σ", " ", "<|endoftext|>", "１"]
    texts = [t for t in ODD_TEXTS if t is not None] + ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(1500)]
    texts += [a + b for a in map(chr, range(256)) for b in ("a", ".", "1", "'", " ")]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text[:50])
    assert encode.shortcut == (path == WORD_BPE)


def brute_tokens(docs, end=1):
    whole, start, out = Tokenizer.from_file(WORD_BPE), 0, []
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def token_docs(rng, n=400):
    texts = [" ".join(rng.choice(["The", "cat's", "42", "naïve,", "x-y", "—"]) for _ in range(rng.randrange(60))) for _ in range(n)]
    docs = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    rng.shuffle(docs)
    return docs


def test_token_files_round_trip(spark, rng, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TEXT", 40_000)
    docs = token_docs(rng)
    schema = "doc_id long, text string, start string, n_tokens string, _part int, lang string"
    frame = spark.createDataFrame([(i, t, "clash", "clash", 7, "en") for i, t in docs], schema).repartition(6)
    folder = token_files.write_tokens(frame, WORD_BPE, keep=["lang"])
    got = rows(token_files.checksums(token_files.read_tokens(spark, folder)), "doc_id", "start", "n_tokens", "ids_crc32")
    want = brute_tokens(docs)
    assert got == sorted(want, key=repr)
    files = token_files.file_table(spark, folder).collect()
    assert len(files) > 3 and sum(f["documents"] for f in files) == len(docs)
    places = sorted((f["start"], f["tokens"]) for f in files)
    assert [s + t for s, t in places[:-1]] == [s for s, _ in places[1:]]
    assert [f["first_key"] for f in sorted(files, key=lambda f: f["start"])] == sorted(f["first_key"] for f in files)


def test_token_files_selective_reads(spark, rng, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TEXT", 40_000)
    docs = token_docs(rng)
    folder = token_files.write_tokens(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), WORD_BPE)
    want = brute_tokens(docs)
    total = want[-1][1] + want[-1][2]
    for first, last in ((0, 1), (total // 3, total // 2), (777, 778), (total - 1, None), (total, None), (None, 40), (0, 0)):
        got = rows(token_files.read_tokens(spark, folder, first, last), "doc_id", "start")
        assert got == sorted((d[0], d[1]) for d in want if d[1] + d[2] > (first or 0) and d[1] < (total if last is None else last)), (first, last)
    some = token_files.read_documents(spark, folder, [3, 1003, 99999])
    assert {r["doc_id"]: r["start"] for r in some.collect()} == {d[0]: d[1] for d in want if d[0] in (3, 1003)}
    plan = some.select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split(">")[0] and "In(doc_id" in plan.replace(" ", "")


def test_token_files_use_the_stated_encodings(spark, rng):
    docs = token_docs(rng)
    folder = token_files.write_tokens(spark.createDataFrame(docs, "doc_id long, text string"), WORD_BPE)
    paths = spark.read.parquet(f"{folder}/tokens").inputFiles()
    group = pq.ParquetFile(paths[0].removeprefix("file://")).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    for name in ("doc_id", "_place", "n_tokens"):
        assert "DELTA_BINARY_PACKED" in columns[name].encodings
    lists = next(c for n, c in columns.items() if n.startswith("ids."))
    assert any("DICTIONARY" in e for e in lists.encodings)
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())


def test_token_files_of_odd_tables(spark):
    schema = "doc_id long, text string"
    empty = spark.createDataFrame([], schema)
    folder = token_files.write_tokens(empty, WORD_BPE)
    assert token_files.read_tokens(spark, folder).count() == 0 and token_files.read_tokens(spark, folder, 3, 9).count() == 0
    same = [(None, "a b"), (None, "a b"), (None, None), (5, "x"), (5, "x"), (5, "y z")]
    folder = token_files.write_tokens(spark.createDataFrame(same, schema).repartition(4), WORD_BPE, folder=work_folder(spark))
    found = token_files.read_tokens(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None] * 3 + [5] * 3
    assert [r["start"] for r in found] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in found])[:-1]]).tolist()
    bare = token_files.write_tokens(spark.createDataFrame([(1, "a"), (2, None)], schema), WORD_BPE, end=None)
    assert rows(token_files.read_tokens(spark, bare), "doc_id", "n_tokens") == [(1, 1), (2, 0)]


# --- spelling variants -------------------------------------------------------------------------------------------


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_variants(words, ratio=5):
    out = {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if is_near(w, v))
        strong = near and -near[0][0] >= ratio * n
        out[w] = (near[0][1] if strong else None, n, len(near), -near[0][0] if strong else None)
    result = []
    for w, (form, n, k, fn) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        result.append((w, form, root, n, k, fn))
    return sorted(result, key=repr)


@pytest.mark.parametrize(("limit", "seed"), [(20_000, 1), (0, 2), (3, 3)])
def test_variants_against_brute_force(spark, limit, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices("abé", k=rng.randrange(1, 8))): rng.choice([1, 5, 30, 200, 1000]) for _ in range(160)}
    words |= {"shared" + "".join(rng.choices("xyzü", k=rng.randrange(5))): rng.randrange(1, 400) for _ in range(120)}  # a third with one first half
    words |= {"": 3, "\U0001f600a": 2, "\U0001f600b": 40, "q" * 3000: 9, "q" * 3001: 60, "q" * 1500 + "r" + "q" * 1499: 1}
    frame = spark.createDataFrame([*words.items(), (None, 4)], "word string, n long").repartition(4)
    assert rows(spelling.variant_groups(frame, limit=limit)) == brute_variants(words)


def test_chains_of_forms_and_empty_words(spark):
    chain = {"a" * (3 + i): 6**i for i in range(12)}
    frame = spark.createDataFrame(list(chain.items()), "word string, n long")
    assert {r["root"] for r in spelling.variant_groups(frame).collect()} == {"a" * 14}
    assert spelling.variant_groups(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="ratio"):
        spelling.variant_groups(frame, ratio=1)


def test_word_counts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    import re

    rng = random.Random(7)
    letters = ["Été", "mÀison", "ABCdef", "wonderful", "x×y÷zab", "ſtraße", "日本", "don't", "İstanbul", "abcdefgh", "short"]
    docs = [(i if i % 17 else None, " ".join(rng.choices(letters, k=rng.randrange(200))) + rng.choice(["", "…", "\x00wonderful"])) for i in range(300)]
    docs += [(1, None), (2, ""), (3, "a" * 50_000), (3, "a" * 50_000)]
    want = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            want[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 2}
    frame = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, word int").repartition(5)
    assert dict(rows(spelling.word_counts(frame, least=2))) == want
    assert spelling.word_counts(frame.limit(0)).count() == 0
