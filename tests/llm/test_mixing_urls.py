"""Mixing against its definition, URL verdicts against brute force, and both against SQL."""

import random
from collections import defaultdict

import duckdb
import pytest
from cases import rows
from pyspark.sql import functions as F

from sightline.llm import mixing, queries, url_filter


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, repeat=2.0):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if w[s] * level > repeat * sizes[s] + 1e-12]
        if not over:
            return full | {s: w[s] * level for s in open_}
        for s in over:
            full[s] = repeat * sizes[s]
            left -= full[s]


@pytest.mark.parametrize("per_range", [3, 4096])
def test_mix_cuts_each_source_at_its_budget(spark, frame, rng, per_range):
    docs = [(i, " ".join(["x"] * rng.randrange(1, 40)), rng.choice(["a", "a", "a", "b", "ç", "d", None])) for i in range(300)]
    docs += [(900, None, "a"), (901, "", "e"), (None, "one two", "b"), (None, "one two", "b"), (7, docs[7][1], docs[7][2])]
    got = mixing.mix_sources(frame(docs), rows_per_range=per_range).collect()
    assert len(got) == len(docs)
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = brute_targets(size)
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert taken[s] == int(target[s] + 1e-9)


def test_mix_does_not_depend_on_ranges_or_partitions(frame, rng):
    docs = [(i, " ".join(["x"] * rng.randrange(1, 9)), rng.choice("abc")) for i in range(200)]
    a = mixing.mix_sources(frame(docs), rows_per_range=2)
    b = mixing.mix_sources(frame(docs[::-1]).repartition(2), rows_per_range=10_000)
    assert rows(a) == rows(b)


def test_rows_without_an_id_spread_over_ranges(spark, frame):
    """A third of all rows has no id: their keys are those of their texts, in SQL alike."""
    docs = [(i if i % 3 else None, " ".join(["x"] * (1 + i % 50) + [str(i)]), "abc"[i % 5 % 3]) for i in range(600)]
    docs += [(None, None, "a"), (None, "", "b"), (None, "same same", "a"), (None, "same same", "a")]
    got = mixing.mix_sources(frame(docs), rows_per_range=20)
    taken = {r["source"]: r["taken"] for r in got.groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    target = {r["source"]: r["target"] for r in got.collect()}
    assert taken == {s: int(t + 1e-9) for s, t in target.items()}
    # a row's cut depends on its own place, so rows without an id are not all on one side
    cut = [r for r in got.collect() if r["doc_id"] is None and r["size"] > 2]
    assert len({(r["source"], r["taken"] // r["size"]) for r in cut}) > 2
    con = duckdb.connect()
    con.register("documents", frame(docs).toArrow())
    want = con.execute(queries.OP1_SQL).fetchall()
    have = mixing.mix_sources(frame(docs)).select("doc_id", "size", "source_size", F.round("target", 6), "taken")
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in have.collect())


def test_equal_rooms_share_alike(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 4), ("c", 2), ("d", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sources).collect()}
    assert got == pytest.approx(brute_targets({"a": 10, "b": 4, "c": 2, "d": 0}))


def test_mix_of_nothing(frame):
    assert mixing.mix_sources(frame([])).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(frame([(1, None), (2, " \t")])).collect()] == [0, 0]


def verdict(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:].split("?")[0].split("#")[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls_against_brute_force(spark):
    rng = random.Random(1)
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.b", "/x", "block"), ("b", "", "allow")]
    hosts = ["com", "Example.com", "www.example.COM", "myexample.com", "x.net", "net", "A.B", "q.a.b", "", "b", "É.com", "..", "a..b"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/EN/', '/es/q', '/xyz', '?a=/en/', '#/en/'])}{rng.choice(['', '?q', '#f', '/z://y'])}" for _ in range(400)]
    urls += [None, "", "://", "no scheme", "http://", "x" * 5000, "http://" + "a." * 3000 + "com/" + "p/" * 2000]
    pages = spark.createDataFrame([(i % 390, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted(((r["url"] or "", r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in url_filter.filter_urls(pages, table).collect()))
    want = sorted((u or "", h, p, r or "", v) for u in urls for h, p, r, v in [verdict(u, rules)])
    assert got == want
    none = url_filter.filter_urls(pages.limit(0), table)
    assert none.count() == 0
    without = url_filter.filter_urls(pages, table.limit(0))
    assert without.filter("rule is null and verdict = 'allow'").count() == len(urls)
    assert pages.select(F.count("*")).first()[0] == len(urls)


def test_url_columns_with_names_of_the_operator(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x", "h", "p", "s"), (1, "http://a.b/x", "h", "p", "s"), (2, None, "h", "p", None)], "page_id long, url string, _h string, _p string, short string")
    rules = spark.createDataFrame([("b", "/x", "block")], "host string, path string, verdict string")
    got = url_filter.filter_urls(pages, rules)
    assert rows(got, "page_id", "_h", "_p", "short", "rule", "verdict") == [(1, "h", "p", "s", "b/x", "block")] * 2 + [(2, "h", "p", None, None, "allow")]
