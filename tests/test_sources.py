"""Files written by hand or by the sinks, then scanned."""

import hashlib
import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.operators import audit as A
from sightline.operators.metrics import explode_pairs, metric_lattice
from sightline.plans import load_all
from sightline.sources import json_ranges as J
from sightline.sources import scans as N
from sightline.sources import sinks as K

from helpers import rows
from oracle_compare import DATA


def put(path, obj, indent=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(obj if isinstance(obj, str) else json.dumps(obj, indent=indent))
    return str(path)


def test_optional_columns(spark, tmp_path):
    spark.range(3).withColumn("a.b", F.lit("x")).write.parquet(str(tmp_path / "e"))
    df = N.scan_episodes(spark, str(tmp_path / "e"), ["id"], {"a.b": "string", "q": "double"})
    assert df.columns[:3] == ["id", "a.b", "q"] and df.filter("q IS NULL").count() == 3
    with pytest.raises(ValueError, match="gone"):
        N.scan_episodes(spark, str(tmp_path / "e"), ["gone"])


def test_scan_is_pruned(spark, tmp_path):
    spark.range(3).select("id", F.lit(1).alias("b"), F.lit(2).alias("c")).write.parquet(str(tmp_path / "e"))
    plan = N.scan_episodes(spark, str(tmp_path / "e"), ["id"], {"b": "int"}).filter("id > 1")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,b:int>" in plan and "GreaterThan(id,1)" in plan


def test_descriptor(spark, tmp_path):
    info = {"total_episodes": 5, "total_frames": 50, "fps": 10, "features": {"x": {"dtype": "video", "shape": [3, 4], "names": ["h"]}}}
    df = N.scan_info(spark, put(tmp_path / "info.json", info, 1), ["x", "y"])
    assert rows(df, "feature", "dtype", "shape", "total_episodes") == [("x", "video", [3, 4], 5), ("y", None, None, 5)]


@pytest.mark.parametrize("layout,indent", [("object", None), ("object", 1), ("lines", 1)])
def test_json_map(spark, tmp_path, layout, indent):
    path = put(tmp_path / "m.json", {"a": "x,y", "b": None, "c": ""}, indent)
    assert rows(N.scan_json_map(spark, path, layout)) == [("a", "x,y"), ("b", None), ("c", "")]


def test_rawpath_map(spark, tmp_path):
    path = put(tmp_path / "r.json", {"p/q": [{"id": "e1", "range_nop": [1, 2]}, {"id": "e2"}]})
    assert rows(N.scan_rawpath_map(spark, path)) == [("p/q", "e1", [1, 2]), ("p/q", "e2", None)]


def test_view_meta_tree(spark, tmp_path):
    for demo, view in [("270", "exo0"), ("270__apple", "head")]:
        put(tmp_path / demo / view / "meta.json", {"demo": "stale", "T": 9, "Tmin": 7, "idxs": [1, 5], "target": {"name": "a"}, "visible_frac": 0.5, "median_px": 3}, 1)
    df = N.scan_view_meta(spark, str(tmp_path))
    assert rows(df, "demo", "view", "n_frames", "n_frames_min", "target.name") == [("270", "exo0", 9, 7, "a"), ("270__apple", "head", 9, 7, "a")]


def test_relations_file(spark, tmp_path):
    ann = {"segmentation": {"counts": [0, 3], "size": [1, 3]}, "area": 3.0, "category_id": 1.0, "text": "cup"}
    rel = {"p1": {"video_id": "p1", "video_path": ["a/1.jpg", "a/2.jpg"], "prompt": {"first_frame_image": "b/1.jpg", "first_frame_anns": {"0": ann}},
                  "objects": {"0": {"video_id": "p1", "obj_id": 0, "video_path": ["a/1.jpg"], "segmentation": ann["segmentation"], "area": 3.0}}}}
    row = N.scan_relations(spark, put(tmp_path / "r.json", rel, 1), "ego2exo").first()
    assert (row.pair_id, row.prompt_image, row.target_image, row.prompt_area, row.text) == ("p1", "b/1.jpg", "a/1.jpg", 3.0, "cup")
    assert row.target_segmentation.counts == [0, 3]


def test_manifest_fails_on_bad_lines(spark, tmp_path):
    good = put(tmp_path / "g.jsonl", '{"k": 1}\n{"k": 2}\n')
    assert rows(N.scan_manifest(spark, good, "k int")) == [(1,), (2,)]
    bad = put(tmp_path / "b.jsonl", '{"k": 1}\n{"k": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        N.scan_manifest(spark, bad, "k int").collect()


def test_metric_shards_in_text_order(spark, tmp_path):
    put(tmp_path / "raw_2.json", [{"ious": [1.0, 1.0], "dices": [1.0, 1.0]}])
    put(tmp_path / "raw_10.json", [{"ious": [0.0, 0.5], "dices": [0.0, 0.5]}, {"ious": [0.4], "dices": [0.4]}])
    pairs = N.scan_metric_shards(spark, str(tmp_path / "raw_*.json"))
    assert rows(pairs.select("shard", "shard_no").distinct()) == [("raw_10.json", 0), ("raw_2.json", 1)]
    objs = explode_pairs(pairs)
    row = metric_lattice(objs, ["shard_no", "pair_idx"], ["shard_no", "pair_idx", "obj_idx"]).first()
    assert row.stock_iou == pytest.approx(0.3) and row.perobject_dice == pytest.approx(2.9 / 5)


def test_plan_and_path_list(spark, tmp_path):
    plan = put(tmp_path / "plan.txt", "270010 270020\n\n 310001\n")
    assert rows(N.scan_plan(spark, plan)) == [(27, 0, "270010"), (27, 1, "270020"), (31, 0, "310001")]
    paths = put(tmp_path / "paths.txt", "/s/t/train/e1/\n\ns/t\n")
    listed = N.scan_path_list(spark, paths)
    assert rows(listed) == [("s", "t", "train", "e1"), ("s", "t", None, None)]
    have = spark.createDataFrame([("s", "t", "train", "e1"), ("s", "t", "train", "e2")], "subset string, task string, split string, episode string")
    assert rows(K.exclude(have, listed, have.columns), "episode") == [("e2",)]


def test_job_log(spark):
    lines = ["PROD 12 COMPLETE exo=2", "Iter(test) [1/2]", "Best Mean IoU: 0.4 iou=0.4", "RuntimeError: no", "else"]
    got = N.parse_job_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r["kind"] for r in got.collect()] == ["status", "progress", "metric", "error", "other"]
    first = got.first()
    assert (first.subject, first.status, first.number) == ("12", "COMPLETE", 2.0)


def test_polygon_files(spark, tmp_path):
    put(tmp_path / "ep1" / "f00042.json", {"shapes": [{"label": "cup", "points": [[1, 2], [3, 4]]}, {"label": "lid", "points": [[0, 0]]}]}, 1)
    put(tmp_path / "ep1" / "meta.json", {"scale": 2})
    assert rows(N.scan_polygons(spark, str(tmp_path)), "base", "frame", "shape_no", "label") == [("ep1", 42, 0, "cup"), ("ep1", 42, 1, "lid")]


def test_relation_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i:03d}", "ego2exo" if i % 3 else "exo2exo", i) for i in range(100)], "pair_id string, direction string, v int")
    out = str(tmp_path / "rel")
    K.write_relations(df, out)
    assert rows(spark.read.parquet(out).select(df.columns)) == rows(df)
    only = spark.read.parquet(out).filter("direction = 'exo2exo'")
    assert "PartitionFilters: [isnotnull(direction" in only._jdf.queryExecution().executedPlan().toString()


def test_sample_index_scalars_only(spark, tmp_path):
    df = spark.createDataFrame([("k", 1, [1])], "key string, shard int, idxs array<int>")
    with pytest.raises(ValueError, match="idxs"):
        K.write_sample_index(df, str(tmp_path / "i"), ["key", "idxs"])
    K.write_sample_index(df, str(tmp_path / "i"), ["key"])
    assert rows(spark.read.parquet(str(tmp_path / "i")), "key", "shard") == [("k", 1)]


def test_manifest_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 1)], "k string, v int")
    K.write_manifest(df, str(tmp_path / "j"))
    assert rows(N.scan_manifest(spark, str(tmp_path / "j"), "k string, v int")) == rows(df)
    K.write_manifest(df, str(tmp_path / "t"), "tsv")
    assert rows(spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t"))) == [("a", None), ("b", "1")]
    with pytest.raises(ValueError):
        K.write_manifest(df, str(tmp_path / "x"), "xml")


def test_inventory_and_pending(spark, tmp_path):
    put(tmp_path / "a.jpg", "xyz")
    put(tmp_path / "sub" / "b.jpg", "x")
    put(tmp_path / "c.txt", "x")
    inv = N.file_inventory(spark, str(tmp_path), "*.jpg").withColumn("name", F.substring_index("path", "/", -1))
    assert rows(inv, "name", "bytes") == [("a.jpg", 3), ("b.jpg", 1)]
    wanted = spark.createDataFrame([("a.jpg",), ("z.jpg",)], "name string")
    assert rows(K.pending(wanted, inv, ["name"])) == [("z.jpg",)]


def test_file_digests(spark, tmp_path):
    put(tmp_path / "a.bin", "hello")
    put(tmp_path / "b.bin", "world")
    got = A.file_digests(spark, str(tmp_path)).withColumn("path", F.substring_index("path", "/", -1))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    manifest = spark.createDataFrame([("a.bin", 5, sha("hello")), ("b.bin", 5, sha("other")), ("c.bin", 1, sha("x"))], "path string, bytes bigint, sha string")
    assert rows(A.verify_digests(got, manifest), "check", "subject") == [("digest", "b.bin"), ("missing", "c.bin")]


def test_file_digests_of_the_tables(spark):
    folder = f"{DATA}/sf0.001"
    got = rows(load_all().QUERIES["file_digests"](spark, folder))
    names = sorted(n for n in os.listdir(folder) if n.endswith(".parquet"))
    raw = {n: open(f"{folder}/{n}", "rb").read() for n in names}
    assert got == [(n, len(raw[n]), hashlib.sha256(raw[n]).hexdigest()) for n in names]


def test_large_files_are_hashed_in_pieces(spark, tmp_path):
    size, piece = 3 << 30, bytes(1 << 20)
    with open(tmp_path / "sparse.bin", "wb") as file:  # takes no room on the disk
        file.truncate(size)
    (tmp_path / "small.bin").write_bytes(b"x")
    digest = hashlib.sha256()
    for _ in range(size // len(piece)):
        digest.update(piece)
    got = {r["path"].rsplit("/", 1)[-1]: (r["bytes"], r["sha"]) for r in A.file_digests(spark, str(tmp_path)).collect()}
    assert got == {"sparse.bin": (size, digest.hexdigest()), "small.bin": (1, hashlib.sha256(b"x").hexdigest())}


def test_jpeg_closure(spark, tmp_path):
    (tmp_path / "ok.jpg").write_bytes(b"\xff\xd8abc\xff\xd9")
    (tmp_path / "cut.jpg").write_bytes(b"\xff\xd8abc")
    files = spark.read.format("binaryFile").load(str(tmp_path)).withColumn("image", F.substring_index("path", "/", -1))
    refs = spark.createDataFrame([("ok.jpg",), ("cut.jpg",), ("gone.jpg",), (None,)], "image string")
    assert rows(A.closure(refs, files, "image", A.jpeg_ok("content")), "check", "subject") == [("malformed", "cut.jpg"), ("missing", "gone.jpg"), ("null_reference", "image")]


def test_optional_columns_that_only_some_files_have(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "id int").coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(3, "m"), (4, None)], "id int, seg string").coalesce(1).write.parquet(str(tmp_path / "b"))
    for order in ("ab", "ba"):
        df = N.scan_episodes(spark, [str(tmp_path / p) for p in order], ["id"], {"seg": "string"})
        assert rows(df, "id", "seg") == [(1, None), (2, None), (3, "m"), (4, None)]


def test_a_cluster_needs_a_named_folder():
    from sightline.session import default_folder

    assert default_folder("local[2]") and default_folder("local")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            default_folder(master)


def test_a_session_writes_into_one_folder(spark, tmp_path, monkeypatch):
    from sightline import session

    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    kept = [session.published(spark.range(n)) for n in (3, 5)]
    assert [k.count() for k in kept] == [3, 5]
    assert [str(p) for p in tmp_path.iterdir()] == [session.session_folder(spark)]
    assert session.clear_session(spark) and not list(tmp_path.iterdir())
    assert not session.clear_session(spark)


def test_large_json_files_are_split_by_line(spark, tmp_path):
    path = {f"a/{i}": [{"id": f"e{i}", "range_nop": [i, i + 1]}] for i in range(50)}
    by_line = lambda d: "{\n" + ",\n".join(f"  {json.dumps(k)}: {json.dumps(v)}" for k, v in d.items()) + "\n}\n"
    (tmp_path / "m.json").write_text(by_line(path))
    assert rows(N.scan_rawpath_map(spark, str(tmp_path / "m.json"), "lines")) == rows(N.scan_rawpath_map(spark, str(tmp_path / "m.json")))
    rel = {f"p{i}": {"video_id": f"p{i}", "video_path": ["a.jpg"], "prompt": {"first_frame_image": "b.jpg", "first_frame_anns": {}},
                     "objects": {"0": {"video_id": f"p{i}", "obj_id": 0, "video_path": ["a.jpg"], "area": 1.0}}} for i in range(20)}
    (tmp_path / "r.json").write_text(by_line(rel))
    assert rows(N.scan_relations(spark, str(tmp_path / "r.json"), "d", "lines")) == rows(N.scan_relations(spark, str(tmp_path / "r.json"), "d"))
    for shard in range(3):
        elements = [json.dumps({"ious": [shard + i / 100], "dices": [0.5]}) for i in range(40)]
        (tmp_path / f"raw_{shard}.json").write_text("[\n" + ",\n".join(elements) + "\n]\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # several splits per file
    try:
        split = rows(N.scan_metric_shards(spark, str(tmp_path / "raw_*.json"), "lines"), "shard", "pair_idx", "ious", "shard_no")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert split == rows(N.scan_metric_shards(spark, str(tmp_path / "raw_*.json")), "shard", "pair_idx", "ious", "shard_no")


ODD = ['', ' ', '"', '\\', '\\\\"', '{', '}', '],[', ',', '":', '\\u007b', '\n', 'é', '\U0001f600', 'a"b\\']


def odd_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    text = "".join(rng.choices(ODD, k=rng.randrange(4)))
    if kind < 4:
        return [text, rng.randrange(-9, 9), None, rng.random() < 0.5][kind]
    return [odd_value(rng, depth + 1) for _ in range(rng.randrange(4))] if kind == 4 else {text + str(i): odd_value(rng, depth + 1) for i in range(rng.randrange(4))}


def read_in_ranges(path, size):
    """The two passes of the reader on local batches."""
    total = path.stat().st_size
    ranges = [{"path": str(path), "start": a, "stop": min(a + size, total)} for a in range(0, total, size)]
    effects = [e for b in J._effects(iter([pa.RecordBatch.from_pylist(ranges)])) for e in b.to_pylist()] if ranges else []
    names = ("path", "start", "stop", "size", "inside", "escaped", "depth")
    begun = [dict(zip(names, p, strict=True)) for p in J._composed(effects)]
    return [e for b in J._entries(iter([pa.RecordBatch.from_pylist(begun)])) for e in b.to_pylist()] if begun else []


@pytest.mark.parametrize("seed", range(6))
def test_entries_of_ranges_are_those_of_the_document(tmp_path, monkeypatch, seed):
    monkeypatch.setattr(J, "AHEAD", 3)
    rng = random.Random(seed)
    for n in range(25):
        doc = odd_value(rng, 0)
        doc = doc if isinstance(doc, (dict, list)) else {"k": doc, "l": [doc]}
        text = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 1]))
        path = tmp_path / f"{n}.json"
        path.write_text(rng.choice(["", " \n"]) + text + rng.choice(["", "\n"]))
        for size in (1, 2, 3, 7, 50, 10_000):
            got = sorted(read_in_ranges(path, size), key=lambda e: e["at"])
            entries = [json.loads("[" + e["entry"] + "]")[0] if isinstance(doc, list) else json.loads("{" + e["entry"] + "}") for e in got]
            assert entries == (doc if isinstance(doc, list) else [{k: v} for k, v in doc.items()]), (text, size)


def test_one_line_files_are_split_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "scan_entries", lambda spark, path: J.scan_entries(spark, path, 700))
    raw = {f"a/{i}": [{"id": f'e}}"{i}', "range_nop": [i, i + 1]}] for i in range(80)}
    path = put(tmp_path / "m.json", raw)
    assert rows(N.scan_rawpath_map(spark, path, "ranges")) == rows(N.scan_rawpath_map(spark, path))
    flat = {f"k{i}": None if i % 3 else "{" * i for i in range(60)}
    path = put(tmp_path / "f.json", flat)
    assert rows(N.scan_json_map(spark, path, "ranges")) == rows(N.scan_json_map(spark, path))
    rel = {f"p{i}": {"video_id": f"p{i}", "video_path": ["a.jpg"], "prompt": {"first_frame_image": "b.jpg", "first_frame_anns": {}},
                     "objects": {"0": {"video_id": f"p{i}", "obj_id": 0, "video_path": ["a.jpg"], "area": 1.0}}} for i in range(20)}
    path = put(tmp_path / "r.json", rel)
    assert rows(N.scan_relations(spark, path, "d", "ranges")) == rows(N.scan_relations(spark, path, "d"))
    for shard in range(3):
        put(tmp_path / f"raw_{shard}.json", [{"ious": [shard + i / 100], "dices": [0.5]} for i in range(40)])
    names = str(tmp_path / "raw_*.json")
    columns = ("shard", "pair_idx", "ious", "shard_no")
    assert rows(N.scan_metric_shards(spark, names, "ranges"), *columns) == rows(N.scan_metric_shards(spark, names), *columns)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.json").write_text("")
    assert J.scan_entries(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="layout"):
        N.scan_json_map(spark, path, "pages")
