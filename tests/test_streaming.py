"""Streams replayed file by file equal the batch result, also after a restart."""

import pytest
from pyspark.sql import functions as F

from sightline.sources.scans import parse_job_log
from sightline.streaming import batches as B
from sightline.streaming import jobs as J

from helpers import rows


def log_files(folder, batches):
    folder.mkdir(exist_ok=True)
    for i, lines in enumerate(batches):
        (folder / f"log{i}.txt").write_text("\n".join(lines) + "\n")


BATCHES = [
    ["PROD 1 downloaded step=1", "PROD 2 downloaded step=1"],
    ["PROD 1 COMPLETE step=2", "PROD 1 error step=3"],
    ["PROD 2 POISON step=4", "PROD 3 ok step=5"],
]


def test_monitor_equals_batch(spark, tmp_path):
    log_files(tmp_path / "logs", BATCHES)
    step = F.regexp_extract("value", r"step=(\d+)", 1).cast("int")
    stream = J.read_log_stream(spark, str(tmp_path / "logs"), files_per_trigger=1).withColumn("ts", step)
    q = J.start_monitor(stream, str(tmp_path / "history"), str(tmp_path / "snapshot"), str(tmp_path / "cp"), job="subject")
    q.awaitTermination()
    history = spark.read.parquet(str(tmp_path / "history"))
    assert history.select("batch_id").distinct().count() == 3
    batch = J.monitor_jobs(parse_job_log(spark.read.text(str(tmp_path / "logs")).withColumn("ts", step)), job="subject")
    snapshot = J.current_snapshot(spark, str(tmp_path / "snapshot"), "subject")
    assert rows(snapshot.select(batch.columns)) == rows(batch)
    assert rows(batch, "subject", "last_status", "errors") == [("1", "error", 1), ("2", "POISON", 0), ("3", "ok", 0)]


def test_errors_belong_to_their_log_file(spark, tmp_path):
    log_files(tmp_path / "logs", [["PROD 1 run step=1", "Traceback x step=2", "ValueError: y step=3"], ["Mean IoU step=4"]])
    lines = spark.read.text(str(tmp_path / "logs")).select("value", F.col("_metadata.file_name").alias("file"))
    events = parse_job_log(lines.withColumn("ts", F.regexp_extract("value", r"step=(\d+)", 1).cast("int")))
    assert rows(J.monitor_jobs(events), "file", "errors", "last_value") == [("log0.txt", 2, 3.0), ("log1.txt", 0, 4.0)]


def test_ingest_once_across_restarts(spark, tmp_path):
    src, schema = tmp_path / "src", "k int, v int, ok boolean"

    def add(name, data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(src))

    def run():
        s = spark.readStream.schema(schema).parquet(str(src))
        J.ingest_samples(s, str(tmp_path / "done"), str(tmp_path / "failed"), str(tmp_path / "cp"), ["k"], "ok").awaitTermination()
        return spark.read.parquet(str(tmp_path / "done"))

    add("a", [(1, 10, True), (1, 10, True), (2, 20, False)])
    assert rows(run(), "k") == [(1,)]
    assert rows(run(), "k") == [(1,)]
    add("b", [(1, 10, True), (2, 21, True), (3, 30, True), (4, 40, False)])
    done = run()
    assert rows(done, "k", "v") == [(1, 10), (2, 21), (3, 30)]
    failed = spark.read.parquet(str(tmp_path / "failed"))
    assert rows(J.retry_failed(failed, done, ["k"]), "k") == [(4,)]
    for _ in range(2):
        J.run_retries(spark, str(tmp_path / "done"), str(tmp_path / "failed"), ["k"], "ok", lambda df: df.withColumn("ok", F.lit(True)))
        assert rows(spark.read.parquet(str(tmp_path / "done")), "k") == [(1,), (2,), (3,), (4,)]


def test_folders_hold_each_batch_once(monkeypatch):
    monkeypatch.setattr(B, "FAN", 3)
    present = set()
    for n in range(60):
        held = [b for level, last in B.cover(n) for b in range(last - 3**level + 1, last + 1)]
        assert held == list(range(n)) and len(B.cover(n)) <= 2 * 4
        level = 0
        while (n + 1) % 3**level == 0:  # the folders that batch n writes, seen after each of them
            present.add((level, n))
            level += 1
            held = [b for at, last in B.current_folders(present) for b in range(last - 3**at + 1, last + 1)]
            assert held == list(range(n + 1))


def test_snapshot_writes_what_a_batch_changed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "FAN", 3)
    path, schema = str(tmp_path / "snapshot"), "job int, v int, batch_id int"
    state, written = {}, 0
    for n in range(11):
        changed = [(n % 4, 10 * n, n), (100 + n, n, n)]
        state.update({job: (job, v, b) for job, v, b in changed})
        for _ in range(1 + n % 2):  # a batch that is written again leaves the same
            B.append_batch(spark.createDataFrame(changed, schema).coalesce(1), path, n, lambda parts: B.newest(parts, ["job"], "batch_id"))
        assert rows(J.current_snapshot(spark, path, "job"), "job", "v", "batch_id") == sorted(state.values(), key=repr)
        written += spark.read.parquet(f"{path}/level=0/batch={n}").count()
    assert written == 2 * 11
    present = B.folders(spark, path)
    dropped = B.drop_superseded(spark, path)
    assert (1, 2) in dropped and (0, 8) in dropped and (2, 8) not in dropped
    assert B.folders(spark, path) == present - set(dropped) == set(B.cover(11))
    assert rows(J.current_snapshot(spark, path, "job"), "job", "v", "batch_id") == sorted(state.values(), key=repr)


def test_ingest_survives_a_stop_between_its_writes_and_knows_old_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "FAN", 2)
    src, schema = tmp_path / "src", "k int, v int, ok boolean"
    real, stops = J.append_batch, iter([True])

    def stopping(written, path, batch, merge):
        if batch == 2 and next(stops, False):
            raise RuntimeError("stopped between the data and the ledger")
        real(written, path, batch, merge)

    monkeypatch.setattr(J, "append_batch", stopping)

    def run():
        s = spark.readStream.schema(schema).parquet(str(src))
        J.ingest_samples(s, str(tmp_path / "done"), str(tmp_path / "failed"), str(tmp_path / "cp"), ["k"], "ok").awaitTermination()

    want = {}
    for n in range(6):
        # the keys of the first batch and a missing key come again in each
        data = [(None, n, True), (1, n, True), (2, n, False), (10 + n, n, True)]
        want.update({k: v for k, v, ok in data if ok and k not in want})
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(src))
        if n == 2:
            with pytest.raises(Exception, match="stopped between"):
                run()
        run()
        assert rows(spark.read.parquet(str(tmp_path / "done")), "k", "v") == sorted(want.items(), key=repr)
    assert rows(spark.read.parquet(str(tmp_path / "failed")), "k", "v") == [(2, 0)]
    ledger = B.read_folders(spark, str(tmp_path / "done-ledger"), B.cover(6))
    assert rows(ledger, "k", "_ok") == sorted([(k, True) for k in want] + [(2, False)], key=repr)


def test_dedup_drops_replays(spark, tmp_path):
    data = [(i, f"2024-01-01 00:{i:02d}:00") for i in range(20)]
    df = spark.createDataFrame(data, "k int, t string").withColumn("t", F.to_timestamp("t"))
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    out = J.stream_dedup(s, ["k"], "t", "1 hour")
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "k") == sorted([(i,) for i in range(20)], key=repr)


def test_streams_are_streams(spark, tmp_path):
    log_files(tmp_path / "logs", BATCHES[:1])
    assert J.read_log_stream(spark, str(tmp_path / "logs")).isStreaming
    with pytest.raises(Exception):
        J.read_log_stream(spark, str(tmp_path / "absent")).isStreaming
