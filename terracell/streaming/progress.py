"""Progress of runs: events as files that a stream reads, and each run's last state kept by the stream, stale once nothing is heard of it.

An event is one small file (object stores can't append), written under another name and renamed, so a reader sees whole ones only."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terracell.sources import files

EVENT = "ts timestamp, run_id string, stage string, status string, elapsed_s double, note string, layer_name string, seq long"
STATE = "run_id string, stage string, status string, elapsed_s double, note string, layer_name string, seen_ms long, active boolean, stale boolean, events long"
#: The stage that ends a run, and the states that end it.
WHOLE, ENDS = "pipeline", ("complete", "failed")


class Log:
    """Writes a run's events below root/progress; a stage in progress is told again each `beat` seconds, by a thread of the driver."""

    def __init__(self, spark: SparkSession, root: str, run_id: str, beat: float = 60.0, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.run_id, self.clock = spark, f"{root}/progress/{run_id}", run_id, clock
        self.began, self.seq, self.last, self.lock, self.over = clock(), 0, None, threading.Lock(), threading.Event()
        self.thread = threading.Thread(target=self._beat, args=(beat,), daemon=True) if beat > 0 else None
        if self.thread:
            self.thread.start()

    def event(self, stage: str, status: str, note: str | None = None, layer_name: str | None = None) -> None:
        with self.lock:
            now = self.clock()
            said = {"ts": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(now)) + f".{int(now % 1 * 1000):03d}Z", "run_id": self.run_id, "stage": stage, "status": status, "elapsed_s": round(now - self.began, 6), "seq": self.seq}
            said |= {k: v for k, v in (("note", note), ("layer_name", layer_name)) if v}
            self.seq, self.last = self.seq + 1, (stage, status, layer_name)
            name = f"{said['seq']:09d}-{uuid.uuid4().hex[:8]}.json"
            files.write_text(self.spark, f"{self.folder}/_{name}", json.dumps(said, sort_keys=True) + "\n")
            place = files.hadoop_path(self.spark, f"{self.folder}/_{name}")
            if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(place, files.hadoop_path(self.spark, f"{self.folder}/{name}")):
                raise OSError(f"{place.toString()} can't be moved")

    def _beat(self, seconds: float) -> None:
        while not self.over.wait(seconds):
            if self.last and self.last[1] == "in_progress":
                self.event(*self.last[:2], note="alive", layer_name=self.last[2])

    def close(self) -> None:
        self.over.set()
        if self.thread:
            self.thread.join()


def events(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """All runs' events, as a table or a stream; a root without any gives none."""
    path = f"{root}/progress"
    folder = files.hadoop_path(spark, path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        if not stream:
            return spark.createDataFrame([], EVENT)
        fs.mkdirs(folder)
    reader = (spark.readStream if stream else spark.read).schema(EVENT).option("recursiveFileLookup", "true")
    return reader.json(path)


def last_states(rows: DataFrame, now: Any, stale_s: float = 300.0) -> DataFrame:
    """Each run's last event, by time and then number, with active, stale and how many events it has: one aggregation. Runs that haven't ended are active, and stale
    if nothing was heard of them for more than stale_s before `now` (a column or a timestamp). Events without a run or a time are left out."""
    own = rows.where("run_id is not null and ts is not null")
    last = own.groupBy("run_id").agg(F.max_by(F.struct("stage", "status", "elapsed_s", "note", "layer_name", "ts"), F.struct("ts", F.coalesce("seq", F.lit(-1)))).alias("l"), F.count(F.lit(1)).alias("events"))
    ended = (F.col("l.stage").eqNullSafe(WHOLE)) & F.coalesce(F.col("l.status").isin(*ENDS), F.lit(False))
    now = now if hasattr(now, "cast") else F.lit(now).cast("timestamp")
    silent = F.col("l.ts").cast("double") + stale_s < now.cast("timestamp").cast("double")
    return last.select("run_id", "l.stage", "l.status", "l.elapsed_s", "l.note", "l.layer_name", F.col("l.ts").alias("seen"), (~ended).alias("active"), (~ended & silent).alias("stale"), "events")


def states(rows: DataFrame, ticks: DataFrame, stale_s: float = 300.0, late: str = "1 minute", keep_s: float = 86_400.0) -> DataFrame:
    """The same of a stream, a row whenever a run's state changes (output mode update).

    ticks: a stream with a column ts, such as the rate source's, that is the clock: events may come `late` behind it at most. A silent run becomes stale
    when the clock has passed its last event by more than stale_s and `late`; it is active again if it goes on. State is one row a run; that of ended runs, and of
    runs silent for keep_s, goes when the clock passes it."""
    clock = ticks.select(F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("run_id"))
    both = rows.where("run_id is not null").unionByName(clock, allowMissingColumns=True).where("ts is not null").withWatermark("ts", late)
    columns = ["stage", "status", "elapsed_s", "note", "layer_name"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        said = list(state.get) if state.exists else None  # ts in ms, seq, stage, status, elapsed, note, layer, events, stale
        if state.hasTimedOut:
            seen, ended = said[0], said[2] == WHOLE and said[3] in ENDS
            if ended or said[8]:
                state.remove()
                return
            said[8] = True
            state.update(tuple(said))
            state.setTimeoutTimestamp(max(seen + int(keep_s * 1000), state.getCurrentWatermarkMs() + 1))
        else:
            n = said[7] if said else 0
            for b in batches:
                for r in b.itertuples(index=False):
                    if pd.isna(key[0]):
                        continue
                    at, seq = int(r.ms), -1 if pd.isna(r.seq) else int(r.seq)
                    n += 1
                    if said is None or (at, seq) >= (said[0], said[1]):
                        said = [at, seq, *(None if pd.isna(v) else v for v in (r.stage, r.status, r.elapsed_s, r.note, r.layer_name)), n, False]
            if said is None:
                return  # the clock's own rows
            said[7] = n
            state.update(tuple(said))
            state.setTimeoutTimestamp(max(said[0] + int(stale_s * 1000), state.getCurrentWatermarkMs() + 1))
            ended = said[2] == WHOLE and said[3] in ENDS
        yield pd.DataFrame([(key[0], *said[2:7], said[0], not ended, said[8], said[7])], columns=["run_id", *columns, "seen_ms", "active", "stale", "events"])

    kept = "ts long, seq long, stage string, status string, elapsed_s double, note string, layer_name string, events long, stale boolean"
    rows = both.select("ts", "run_id", *columns, "seq", F.unix_millis("ts").alias("ms"))
    found = rows.groupBy("run_id").applyInPandasWithState(step, STATE, kept, "update", GroupStateTimeout.EventTimeTimeout)
    return found.select("run_id", *columns, F.timestamp_millis("seen_ms").alias("seen"), "active", "stale", "events")
