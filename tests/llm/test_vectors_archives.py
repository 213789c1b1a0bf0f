"""Exact search, archives, and the registered queries with SQL twins; the pipeline stage by stage."""

import base64
import hashlib
import random

import numpy as np
import pytest
from cases import rows
from oracle_compare import DATA, compare, duck
from pyspark.sql import functions as F

import corpus_pipeline
from sightline.llm import queries, toxicity, topk, warc
from sightline.llm.common import components, saved, table
from sightline.session import work_folder
from test_copies_leaks import brute_classes, brute_hits


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_top_products_against_brute_force(spark, block):
    rng = np.random.default_rng(block)
    x = np.floor(rng.normal(size=(230, 12)) * rng.choice([1, 4, 30], size=(230, 1)))
    x[50:120] = x[50]  # a third of all vectors are equal
    x[7] = 0
    data = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(300, None), (301, [1.0, None] * 6), (302, [float("nan")] * 12), (303, [float("inf")] * 12), (304, [1.0]), (None, data[0][1]), (305, [])]
    table = spark.createDataFrame(data + odd, "vec_id long, v array<double>").repartition(3)
    got = {}
    for r in topk.top_products(table, table.filter("vec_id % 10 = 0"), k=5, block=block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for i in range(0, 230, 10):
        score = x @ x[i]
        order = sorted((j for j in range(230) if j != i), key=lambda j: (-score[j], j))[:5]
        want[i] = [(k + 1, j, int(score[j])) for k, j in enumerate(order)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_top_products_with_few_vectors(spark):
    two = spark.createDataFrame([(0, [1.0, 2.0]), (20, [3.0, -1.0])], "vec_id long, v array<double>")
    assert rows(topk.top_products(two, two)) == [(0, 1, 20, 1), (20, 1, 0, 1)]
    assert topk.top_products(two.limit(0), two.limit(0)).count() == 0
    assert topk.top_products(two, two.limit(0)).count() == 0


def test_archives_come_back_whole(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "SHARD_LINES", 20)
    rng = random.Random(1)
    pages = [(i, f"http://Www.{rng.choice('abc')}.org:80/p{i % 9}?q={i}#f", rng.choice(["<p>é</p>\r\n\r\nx", "", f"unique {i}", None])) for i in range(120)]
    pages += [(500, None, "<a>"), (501, "http://x.org/ \r\nWARC-Type: bad", "<a>"), (502, "no scheme\ttab", "big" * 100_000), (None, "http://y.org", "<a>"), (3, pages[3][1], pages[3][2])]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    got = rows(warc.archive_round_trip(frame), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        revisit = i != first.get(h or "")
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert got == sorted(want, key=repr)
    assert warc.archive_round_trip(frame.limit(0)).count() == 0
    folder = work_folder(spark)
    captures = warc.write_archives(frame, folder)
    directory = warc.build_index(captures, folder)
    assert directory.count() >= 120 // 7
    some = captures.filter("page_id in (4, 77)")
    records = warc.read_records(warc.lookup(some, directory, folder), folder, payload=True)
    assert rows(records, "page_id") == [(4,), (77,)]
    absent = spark.createDataFrame([("zz,y)/", 1), ("", 77)], "url_key string, page_id long")
    assert warc.lookup(absent, directory, folder).count() == 0
    assert warc.url_key("https://u@Www.A.org:8080/x?y#z") == "org,a,www:8080)/x?y"


def test_components_of_long_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, j) for j in range(1001, 1040)] + [(70, 70), (61, 60), (2000, 1020)]
    got = dict(rows(components(spark.createDataFrame(links, "a long, b long"))))
    assert all(got[i] == 0 for i in range(62)) and all(got[j] == 1000 for j in range(1000, 1040)) and got[2000] == 1000 and 70 not in got


@pytest.fixture(scope="module")
def con():
    return duck("0.001")


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_match_sql(spark, con, name):
    diff, n = compare(spark, con, name, queries.QUERIES[name], queries.ORACLES.get(name), "0.001")
    assert not diff, "\n".join(diff)
    assert n > 0


@pytest.mark.parametrize("name", [f"op{n}_" for n in (1, 3, 6, 10)])
def test_native_queries_run_no_python(spark, name):
    full = next(q for q in queries.QUERIES if q.startswith(name))
    plan = queries.QUERIES[full](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas", "InArrow"):
        assert bad not in plan, bad


def test_pipeline_stage_by_stage(spark):
    sf = f"{DATA}/sf0.001"
    docs = table(spark, sf, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "secrets", "mix"]
    before = docs
    after = []
    for _, stage in corpus_pipeline.STAGES:
        after.append(saved(stage(spark, before, sf)))
        before = after[-1]
    assert all(a.columns == columns for a in after[:4])
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    scores = toxicity.score_texts(docs, toxicity.train(docs, table(spark, sf, "labels")), keep=["doc_id"])
    assert ids(after[0]) == ids(scores.filter(F.col("score") < toxicity.THRESHOLD))
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert ids(after[1]) == {c for _, _, c in brute_classes(texts(after[0]))}
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    assert ids(after[2]) == {h[0] for h in brute_hits(texts(after[1]), items) if not h[4]}
    assert ids(after[3]) == ids(after[2])
    assert ids(after[4]) <= ids(after[3]) and after[4].filter("taken <= 0").count() == 0
    assert rows(corpus_pipeline.run(spark, sf), "doc_id", "taken") == rows(after[4], "doc_id", "taken")
