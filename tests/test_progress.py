"""Runs' progress: events by files, last states as a table, and as a stream with a manual clock."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from terracell import runs
from terracell.streaming import progress

START = 1_700_000_000


def at(seconds):
    return datetime.datetime.fromtimestamp(START + seconds, datetime.UTC)


def stamp(seconds):
    return at(seconds).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_log_and_killed_run(spark, tmp_path):
    root, now = str(tmp_path), [float(START)]
    assert progress.events(spark, root).isEmpty()
    one, two = (progress.Log(spark, root, name, beat=0, clock=lambda: now[0]) for name in ("run-a", "run-b"))
    one.event("ingest", "in_progress")
    now[0] += 10.5
    one.event("ingest", "complete")
    one.event("pipeline", "complete")
    two.event("layer:regions", "in_progress", note="level 2", layer_name="regions")  # killed here
    rows = {r.run_id: r for r in progress.last_states(progress.events(spark, root), at(100), 300).collect()}
    assert (rows["run-a"].status, rows["run-a"].active, rows["run-a"].stale, rows["run-a"].events, rows["run-a"].elapsed_s) == ("complete", False, False, 3, 10.5)
    assert (rows["run-b"].note, rows["run-b"].layer_name, rows["run-b"].active, rows["run-b"].stale) == ("level 2", "regions", True, False)
    assert [(r.run_id, r.stale) for r in runs.active(spark, root, at(311)).collect()] == [("run-b", True)]
    assert runs.status(spark, root, "run-b", at(311))["progress"]["stale"] and not runs.status(spark, root, "run-b", at(311))["published"]


def test_heartbeat_and_failure(spark, tmp_path):
    log = progress.Log(spark, str(tmp_path), "run-c", beat=0.2)
    log.event("ingest", "in_progress")
    log.thread.join(2)
    log.close()
    notes = [r.note for r in progress.events(spark, str(tmp_path)).orderBy("seq").collect()]
    assert notes[0] is None and len(notes) > 1 and set(notes[1:]) == {"alive"}
    (tmp_path / "a.tsv").write_text("ORGANIZATION\tNODE_NAME\tLATITUDE\tLONGITUDE\tSOURCE\tASOF_DATE\nA\tB\t1.5\t2.5\tx\t2026-01-01\n")
    with pytest.raises(ValueError):
        runs.run(spark, {"f": str(tmp_path / "a.tsv")}, {"resolutions": [7], "layers": {"regions": {"resolution": 6}}}, str(tmp_path / "out"))
    last = progress.last_states(progress.events(spark, str(tmp_path / "out")), at(0)).first()
    assert (last.stage, last.status, last.note, last.active) == ("pipeline", "failed", "ValueError", False)


def test_stream_with_a_manual_clock(spark, tmp_path):
    root, ticks, out = tmp_path / "root", tmp_path / "ticks", str(tmp_path / "out")
    (root / "progress").mkdir(parents=True)
    ticks.mkdir()
    clock = spark.readStream.schema("ts timestamp").json(str(ticks))
    found = progress.states(progress.events(spark, str(root), stream=True), clock, stale_s=100, late="10 seconds")
    query = found.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda rows, k: rows.withColumn("batch", F.lit(k)).write.mode("append").parquet(out)).start()
    names = iter(range(1000))

    def send(rows, tick):
        for r in rows:
            (root / "progress" / f"{next(names)}.json").write_text(json.dumps(r))
        (ticks / f"{next(names)}.json").write_text(json.dumps({"ts": stamp(tick)}))
        query.processAllAvailable()

    def said():
        rows = spark.read.parquet(out)
        return {r.run_id: (r.l.stage, r.l.status, r.l.active, r.l.stale, r.l.events) for r in rows.groupBy("run_id").agg(F.max_by(F.struct("*"), "batch").alias("l")).collect()}

    event = lambda run, t, stage, status, seq: {"ts": stamp(t), "run_id": run, "stage": stage, "status": status, "seq": seq, "elapsed_s": float(t)}
    try:
        send([event("a", 0, "ingest", "in_progress", 0), event("b", 1, "ingest", "in_progress", 0), event("b", 1, "ingest", "complete", 1)], 5)
        assert said() == {"a": ("ingest", "in_progress", True, False, 1), "b": ("ingest", "complete", True, False, 2)}
        send([event("b", 60, "pipeline", "complete", 2)], 100)
        assert said()["b"] == ("pipeline", "complete", False, False, 3) and said()["a"][3] is False
        send([], 200)  # a was heard of last at 0
        send([], 201)
        assert said()["a"] == ("ingest", "in_progress", True, True, 1) and said()["b"][3] is False
        send([event("a", 205, "ingest", "in_progress", 1)], 206)  # it goes on
        assert said()["a"] == ("ingest", "in_progress", True, False, 2)
        table = progress.last_states(progress.events(spark, str(root)), at(206), 100).collect()
        assert {r.run_id: (r.stage, r.status, r.active, r.stale, r.events) for r in table} == said()
    finally:
        query.stop()
