"""Near copies and benchmark hits against brute force."""

import random
import re
from collections import defaultdict

import pytest
from cases import lower_ascii, prose, rows

from sightline.llm import common, decontamination, ngram_join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(docs):
    """(id, set size, class) per row, rows without an id included."""
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    names = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        names[root(i)].append(d)
    name = lambda i: docs[i][0] if not sets[i] else min([d for d in names[root(i)] if d is not None], default=None)
    return sorted(((d, len(sets[i]), name(i)) for i, (d, _) in enumerate(docs)), key=repr)


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    rng = random.Random(seed)
    line = prose(rng, 12)
    base = prose(rng, 90)
    docs = [(i, prose(rng, rng.randrange(1, 60)) + (" " + line if i % 3 == 0 else "")) for i in range(60)]
    docs += [(100 + i, edited(rng, base, rng.randrange(0, 5))) for i in range(70)]  # a large group, chained
    docs += [(300 + i, docs[5][1]) for i in range(20)] + [(400, docs[5][1].upper()), (401, "  " + docs[5][1].replace(" ", "\n"))]
    chain = prose(rng, 40)
    for i in range(8):  # each links with the next, the ends do not
        docs.append((500 + i, chain))
        w = chain.split()
        w[5 * i] = f"c{i}"
        chain = " ".join(w)
    docs += [(600, None), (601, ""), (602, " \t\n"), (603, "a"), (604, "A"), (605, "a b c d"), (606, "a b c d e"), (607, "é É"), (None, base), (None, "z z"), (100, docs[60][1]), (700, "q " * 3000)]
    return docs


@pytest.mark.parametrize(("seed", "blocks"), [(1, None), (2, 1), (3, 7)])
def test_classes_against_brute_force(frame, seed, blocks):
    docs = corpus(seed)
    got = ngram_join.jaccard_components(frame(docs), blocks)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_classes(docs)


def test_hot_grams_do_not_change_classes(frame, monkeypatch):
    docs = corpus(4)
    monkeypatch.setattr(ngram_join, "SAMPLE", 1)
    monkeypatch.setattr(ngram_join, "HOT", 10**6)  # whatever eight sampled sets share passes by
    assert rows(ngram_join.jaccard_components(frame(docs), 3)) == brute_classes(docs)


def test_one_of_each_class_stays(frame):
    docs = corpus(6)
    kept = ngram_join.keep_one_per_class(frame(docs))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = {c for _, n, c in brute_classes(docs) if n and c is not None}
    ids = [r["doc_id"] for r in kept.filter("trim(text) <> '' and doc_id is not null").collect() if r["text"].strip()]
    assert sorted(ids) == sorted(want)
    assert kept.filter("doc_id in (600, 601, 602)").count() == 3


def test_no_documents(frame):
    assert ngram_join.jaccard_components(frame([])).count() == 0
    assert ngram_join.keep_one_per_class(frame([(1, None)])).count() == 1


def brute_hits(docs, items, window=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t))
    wins = defaultdict(set)
    for i, t in items:
        w = terms(t)
        if w:
            n = min(window, len(w))
            for s in range(len(w) - n + 1):
                wins[tuple(w[s : s + n])].add(i)
    out = []
    for d, t in docs:
        w = terms(t)
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        out.append((d, len(w), len(hit), tuple(sorted(str(i) for i in found if i is not None)), bool(hit)))
    return sorted(out, key=repr)


def test_contamination_against_brute_force(spark, frame):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 11, 30]), 60)) for i in range(25)]
    items += [(70, None), (71, "... "), (72, "Two words"), (None, prose(rng, 12, 60)), (73, items[4][1]), (10, items[3][1]), (74, "Été naïve ça là où déjà vu père mère frère")]
    docs = []
    for i in range(80):
        parts = [prose(rng, rng.randrange(0, 30), 60)]
        if i % 3 == 0:
            w = (items[rng.randrange(len(items))][1] or "x").split()
            at = rng.randrange(len(w))
            parts += [" ".join(w[at:]).upper().replace(" ", ", "), prose(rng, 4, 60)]
        docs.append((i, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, items[2][1]), (202, items[2][1]), (202, "two  WORDS two words"), (None, items[2][1]), (203, "ÉTÉ naïve ça là où déjà vu père mère frère"), (204, "été naïve-ça là où déjà vu père mère frère")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(frame(docs), table).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"]) for r in got), key=repr)
    assert got == brute_hits(docs, items)
    clean = decontamination.remove_contaminated(frame(docs), table)
    assert sorted((r["doc_id"], r["text"]) for r in clean.filter("doc_id is not null").collect() if r["text"] is not None) == sorted(
        (d, t) for d, t in docs if d is not None and t is not None and not brute_hits([(d, t)], items)[0][4]
    )


@pytest.mark.parametrize("seed", [9, 10])
def test_contamination_with_a_benchmark_too_large_to_broadcast(spark, frame, monkeypatch, seed):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = random.Random(seed)
        items = [(i, prose(rng, rng.choice([3, 10, 40]), 50)) for i in range(30)]
        docs = [(i, prose(rng, rng.randrange(40), 50) + " " + rng.choice(items)[1]) for i in range(60)] + [(None, items[1][1]), (100, None), (101, "x " * 300_000 + items[4][1])]
        table = spark.createDataFrame(items, "item_id long, text string")
        got = decontamination.contamination(frame(docs), table).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"]) for r in got), key=repr) == brute_hits(docs, items)
        known = spark.createDataFrame([(5, 1, 2)], "k int, sid long, check long")
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = decontamination.shingle_hits(frame(docs), known, [5])._jdf.queryExecution().explainString(mode)
        sent = [line for name, line in re.findall(r"\) (\w+)\nInput \[\d+\]: (.*)", plan) if name == "Exchange"]
        columns = [set(re.findall(r"(\w+)#", line)) for line in sent]
        assert {"doc_id", "_key", "n", "pos", "digest", "again"} in columns and not any({"w", "words", "shingle"} & c for c in columns)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_columns_with_names_of_the_operators(spark):
    columns = "doc_id long, text string, _lost long, _again string, _hit int, _key long, label int, node int, w int, pos int"
    data = [(i, t, 1, "a", 2, 3, 4, 5, 6, 7) for i, t in enumerate(["a b c d e f", "a b c d e f", "g h", "some words of a benchmark item here now ok yes", "some words of a benchmark item here now ok yes"])]
    docs = spark.createDataFrame([*data, data[0]], columns)
    kept = ngram_join.keep_one_per_class(docs)
    assert kept.columns == docs.columns and rows(kept, "doc_id") == [(0,), (2,), (3,)]
    items = spark.createDataFrame([(1, "some words of a benchmark item here now ok yes")], "item_id long, text string")
    clean = decontamination.remove_contaminated(docs, items)
    assert clean.columns == docs.columns and rows(clean, "doc_id", "_hit") == [(0, 2), (0, 2), (1, 2), (2, 2)]


@pytest.mark.parametrize("size", [64, 128, 512, 1024, 2048])
def test_long_regular_words_are_told_apart(frame, size):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
    other = word.translate(str.maketrans("ab", "ba"))
    got = ngram_join.jaccard_components(frame([(1, word), (2, other), (3, word.upper()), (4, f"x {word}"), (5, f"x {other}")]))
    assert rows(got, "doc_id", "component_id") == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 5)]


def test_contamination_without_items_or_documents(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(decontamination.contamination(frame([(1, "a b c"), (2, None)]), none), "doc_id", "n_words", "n_hit") == [(1, 3, 0), (2, 0, 0)]
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontamination.contamination(frame([]), some).count() == 0
