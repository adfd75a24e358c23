"""Structured Streaming: label ingest behind done markers, and event sessions over late frames."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


#: transformWithState keeps its lists and maps in this store.
PROVIDER, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_RECORD = ("row_id", "attr", "value", "leaf", "tool")


@contextmanager
def state_store(spark: SparkSession, idle: bool = True) -> Iterator[None]:
    """Within it, streams that are started use the store of lists, maps and timers; the session's own settings come back. idle false: no batches without data (a stream on processing time would never run out of them)."""
    new = {PROVIDER: STORE} | ({} if idle else {"spark.sql.streaming.noDataMicroBatches.enabled": "false"})
    own = {k: spark.conf.get(k) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)


#: Groups of clips that share a task's call and its state; fixed for the life of a checkpoint.
BUCKETS = 1024


class _Ingest(StatefulProcessor):
    """Holds clips' records until their marker arrives, gives them out once and frees them. Until `grace` passes, 64-bit keys of what was given out tell repeated records from new ones, which pass at once.

    A call takes all clips of a bucket; state is kept, read and freed clip by clip, and not asked for where the bucket has none.
    """

    def __init__(self, grace_ms: int) -> None:
        self.grace = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "clip string, key bigint", ", ".join(f"{c} string" for c in _RECORD) + ", score double")
        self.waits = handle.getMapState("waits", "clip string", "keys array<bigint>")  # the keys of a clip's held records
        self.told = handle.getMapState("told", "clip string", "keys array<bigint>", ttlDurationMs=self.grace)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        clips, done = {}, set()
        for pdf in rows:
            pdf = pdf[["owner", *_RECORD, "score", "done"]].astype(object)
            for clip, *r, score, end in pdf.where(pdf.notna(), None).itertuples(index=False, name=None):
                new = clips.setdefault(clip, {})
                if end is not None:
                    done.add(clip)
                if r[0] is not None:
                    new.setdefault(_key(tuple(r)), (*r, score))
        some_told, some_held, out = self.told.exists(), self.waits.exists(), []
        for clip, new in clips.items():
            told = self.told.getValue((clip,)) if some_told else None
            wait = self.waits.getValue((clip,)) if some_held else None
            held = list(wait[0]) if wait is not None else []
            if told is None and clip not in done:
                kept = set(held)
                more = {k: r for k, r in new.items() if k not in kept}
                for k, r in more.items():
                    self.held.updateValue((clip, k), r)
                if more:
                    self.waits.updateValue((clip,), ([*held, *more],))
                continue
            if held:
                new = new | {k: self.held.getValue((clip, k)) for k in held}
                for k in held:
                    self.held.removeKey((clip, k))
                self.waits.removeKey((clip,))
            known = list(told[0]) if told is not None else []
            given = set(known)
            new = {k: r for k, r in new.items() if k not in given}
            self.told.updateValue((clip,), ([*known, *new],))
            out += [(*r[:4], r[5], r[4]) for r in new.values()]
        if out:
            yield pd.DataFrame(out, columns=["row_id", "attr", "value", "leaf", "score", "tool"])

    def close(self) -> None:
        pass


def _key(record: tuple) -> int:
    return int.from_bytes(hashlib.blake2b(repr(record).encode(), digest_size=8).digest(), "little", signed=True)


def finished_records(records: DataFrame, grace: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """row_id, attr, value, leaf, score, tool: records of a stream of label shards whose clip's marker (a row with `done`, the clip) has arrived, each once, whatever the order of arrival.

    Clips are dealt to `buckets` by a hash, so a call of a task settles many. Held records are freed when the marker comes; keys of those given out end after `grace`, so a record that is repeated later than that is given out again if a marker follows it.
    Start it within state_store(idle=False).
    """
    ms = records.sparkSession.sql(f"select cast(interval {grace} as interval day to second) d").first()["d"] // timedelta(milliseconds=1)
    s = records.withColumn("_clip", F.coalesce("done", F.substring_index("row_id", ":", 1))).filter("_clip is not null")
    s = s.select(F.pmod(F.hash("_clip"), F.lit(buckets)).alias("bucket"), F.col("_clip").alias("owner"), *_RECORD, F.col("score").cast("double").alias("score"), "done")
    return s.groupBy("bucket").transformWithStateInPandas(_Ingest(ms), "row_id string, attr string, value string, leaf string, score double, tool string", "append", "ProcessingTime")


def label_ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, grace: str = "1 day", files: int | None = None):
    """Starts (availableNow) a stream of label shards into a Parquet table of finished records, each batch a folder of its own. Returns the query. files: at most so many files a batch.

    A batch's folder is overwritten if the batch is run again, so a restart repeats nothing.
    """
    s = spark.readStream.schema(schema).option("mode", "DROPMALFORMED")
    s = (s.option("maxFilesPerTrigger", files) if files else s).json(source)

    def put(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={no}")

    with state_store(spark, idle=False):
        return finished_records(s, grace).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def visible(ingested: DataFrame) -> DataFrame:
    """Records whose clip's marker has arrived, whatever the order of arrival."""
    done = ingested.filter("done is not null").select(F.col("done").alias("_c")).distinct()
    r = ingested.filter("done is null").withColumn("_c", F.substring_index("row_id", ":", 1))
    return r.join(done.hint("merge"), "_c", "left_semi").drop("_c", "done")


def event_sessions(frames: DataFrame, tau: float, gap: str, late: str) -> DataFrame:
    """clip, label, t0, t1, peak, n: sessions of frames with p >= tau (streaming or batch), closed by a gap; frames later than `late` are dropped. frames: clip, label, ts, p."""
    s = frames.filter(F.col("p") >= tau).withWatermark("ts", late) if frames.isStreaming else frames.filter(F.col("p") >= tau)
    g = s.groupBy(F.session_window("ts", gap).alias("w"), "clip", "label").agg(F.max("p").alias("peak"), F.count("*").alias("n"))
    return g.select("clip", "label", F.col("w.start").alias("t0"), F.col("w.end").alias("t1"), "peak", "n")


class _Segments(StatefulProcessor):
    """Frames of a bucket's series wait in one of two lists: those up to a due time in the first, later ones in the second. When the watermark reaches the due time, the first is read once, each series in order, and
    freed; the second takes its place. No later frame can be due earlier, as the watermark drops it. Where a series ends before, its bucket's frames up to the watermark are read, and the others put back.

    A call takes all series of a bucket: what is open is one value, a list's row holds many frames, and one timer, the next due time or end of a series, stands for all.
    """

    def __init__(self, tau_on: float, tau_off: float, frame_s: float, gap: float, least: float, idle_ms: int) -> None:
        self.on, self.off, self.frame, self.gap, self.least, self.idle = tau_on, tau_off, frame_s, gap, least, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lists = [handle.getListState(f"frames{i}", "series array<string>, ms array<bigint>, t array<int>, p array<double>") for i in (0, 1)]
        # the list in use, its due time, the latest frame of the other list, the timer; each series' latest frame, and its run that is open (a < 0: none)
        self.at = handle.getValueState("at", "cur int, due bigint, later bigint, wake bigint, series array<string>, newest array<bigint>, ison array<boolean>, a array<int>, b array<int>, peak array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cur, due, later, wake, live = self._load()
        for pdf in rows:
            every = list(zip(*(pdf[c].tolist() for c in ("series", "ms", "t", "p")), strict=True))
            for s, ms, _, _ in every:
                if s not in live:
                    live[s] = (ms, False, -1, -1, 0.0)
                elif ms > live[s][0]:
                    live[s] = (ms, *live[s][1:])
            frames = [f for f in every if f[3] == f[3]]
            if frames and due is None:
                due = max(f[1] for f in frames)
            late = [f for f in frames if f[1] > due]
            self._wait(cur, [f for f in frames if f[1] <= due])
            self._wait(1 - cur, late)
            if late:
                later = max(f[1] for f in late) if later is None else max(later, *(f[1] for f in late))
        self._save(cur, due, later, wake, live)
        yield self._rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.at.exists():
            return
        cur, due, later, _, live = self._load()
        mark, events = timerValues.getCurrentWatermarkInMs(), []
        ends = [s for s, run in live.items() if run[0] + self.idle <= mark]
        while due is not None and (ends or due <= mark):
            frames = [f for row in self.lists[cur].get() for f in zip(*row, strict=True)]
            for s, _, t, p in sorted((f for f in frames if f[1] <= mark), key=lambda f: (f[0], f[2])):
                newest, *run = live[s]
                *run, done = self._step(t, p, *run)
                live[s] = (newest, *run)
                events += [(s, *done)] if done else []
            self.lists[cur].clear()
            if due > mark:
                self._wait(cur, [f for f in frames if f[1] > mark])
                break
            cur, due, later = 1 - cur, later, None
        for s in ends:
            _, _, *run = live.pop(s)
            events += [(s, *run)] if run[0] >= 0 else []
        self._save(cur, due, later, None, live)
        yield self._rows(events)

    def _load(self) -> tuple:
        if not self.at.exists():
            return 0, None, None, None, {}
        cur, due, later, wake, series, *run = self.at.get()
        return cur, due, later, wake, dict(zip(series, zip(*run, strict=True), strict=True))

    def _save(self, cur: int, due: int | None, later: int | None, wake: int | None, live: dict) -> None:
        """Keeps what is open and moves the timer, `wake`, to what comes next."""
        first = min([run[0] + self.idle for run in live.values()] + ([] if due is None else [due]), default=None)
        if wake is not None and first != wake:
            self.handle.deleteTimer(wake)
        if first is not None and first != wake:
            self.handle.registerTimer(first)
        if live:
            self.at.update((cur, due, later, first, list(live), *(list(x) for x in zip(*live.values(), strict=True))))
        else:
            self.at.clear()

    def _wait(self, no: int, frames: list) -> None:
        if frames:
            self.lists[no].appendValue(tuple(list(x) for x in zip(*frames, strict=True)))

    def _step(self, t: int, p: float, on: bool, a: int, b: int, peak: float) -> tuple:
        """The run after a frame (a < 0: none is held), and the event that is complete by it."""
        now, done = p >= self.on or (on and p >= self.off), None
        if now and a >= 0 and not on and (t - b) * self.frame >= self.gap:
            done, a = (a, b, peak), -1
        if now:
            a, b, peak = (t, t + 1, p) if a < 0 else (a, t + 1, max(peak, p))
        elif a >= 0 and (t + 1 - b) * self.frame >= self.gap:
            done, a = (a, b, peak), -1
        return bool(now), int(a), int(b), float(peak), done

    def _rows(self, events: list) -> pd.DataFrame:
        rows = [(s, x * self.frame, y * self.frame, z) for s, x, y, z in events if (y - x) * self.frame >= self.least]
        return pd.DataFrame(rows, columns=["series", "t0", "t1", "peak"])

    def close(self) -> None:
        pass


def segment_stream(frames: DataFrame, tau_on: float, tau_off: float, frame_s: float = 0.1, gap: float = 0.3, least: float = 0.2, late: str = "1 hour", idle_ms: int = 60_000, buckets: int = BUCKETS) -> DataFrame:
    """clip, label, t0, t1, peak: segment_events over a stream of frames in any order. frames: clip, label, t (number of the frame), ts, p. Start it within state_store.

    Frames wait in lists until the watermark has passed them; an event leaves once no later run can join it. A series without frames for `idle_ms` beyond the
    watermark is closed, its open event included, so a row of any series with a later ts and a null p flushes all others. Series are dealt to `buckets` by a hash, so a call of a task takes many.
    """
    f = frames.select(F.to_json(F.struct(F.col("clip").cast("long").alias("clip"), "label")).alias("series"), F.col("t").cast("int").alias("t"), "ts", F.unix_millis("ts").alias("ms"), F.col("p").cast("double").alias("p"))
    f = f.withWatermark("ts", late).withColumn("bucket", F.pmod(F.hash("series"), F.lit(buckets)))
    how = _Segments(tau_on, tau_off, frame_s, gap, least, idle_ms)
    out = f.groupBy("bucket").transformWithStateInPandas(how, "series string, t0 double, t1 double, peak double", "append", "EventTime")
    return out.select(F.from_json("series", "clip long, label string").alias("s"), "t0", "t1", "peak").select("s.*", "t0", "t1", "peak")
