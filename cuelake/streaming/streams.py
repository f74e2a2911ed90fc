"""Positions, searches, hits and tasks as streams.

Each operator maps a streaming DataFrame to a streaming DataFrame and has a batch twin.  Rows of one
key are put in time order inside a micro-batch; how many there can be is bounded by the source's
admission limit (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).

Every stateful operator has a watermark: rows later than ``delay`` behind the newest are dropped and counted
(``drained`` returns the counter).  A key that stays silent for ``idle_ms`` of event time is forgotten: a timer drops its
state, and a row that comes after a longer silence finds none, in whichever micro-batch it comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from cuelake import schemas
from cuelake.operators.ordered import file_intervals
from cuelake.operators.tasks import COLD_FLOOR, HEAT_KEEP
from cuelake.operators.timeline import DRIFT_MS, STALL_MS, cue_spans
from cuelake.session import checkpoint_root
from cuelake.sources.srt import decode_text, srt_scan

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _struct(**fields) -> StructType:
    kinds = {"long": LongType(), "double": DoubleType(), "string": StringType(), "bool": BooleanType()}
    return StructType([StructField(n, kinds[k]) for n, k in fields.items()])


DELAY, IDLE_MS = "10 minutes", 30 * 86_400_000  # how late a row may be; when a silent key is forgotten
HEAT_BUCKETS = 1 << 12  # fixed for the life of a stream; a million videos are 250 a bucket


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is available now into Parquet under the shared folder; read it back."""
    return drained(stream, mode)[0]


def drained(stream: DataFrame, mode: str = "append") -> tuple[DataFrame, dict[str, int]]:
    """As ``drain``, with figures: rows dropped as late, and rows of state held at the end.

    The number of state stores is fixed for the life of a stream: one per core.  The session gets its settings back.
    """
    spark = stream.sparkSession
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
              "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        return _drain(stream, mode)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _drain(stream: DataFrame, mode: str) -> tuple[DataFrame, dict[str, int]]:
    spark = stream.sparkSession
    root = f"{checkpoint_root(spark)}/stream-{uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{root}/out").start()
    else:
        def put(batch: DataFrame, epoch: int) -> None:
            # A retried epoch overwrites its own folder, so the result stays exactly-once.
            batch.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")
        query = writer.foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out"), figures(query)


def figures(query) -> dict[str, int]:
    """Late rows over the kept progress reports of a query, and the rows of state after the last one."""
    reports = [[op for op in p["stateOperators"]] for p in query.recentProgress]
    return {"n_late": sum(op["numRowsDroppedByWatermark"] for ops in reports for op in ops),
            "n_state": sum(op["numRowsTotal"] for op in reports[-1]) if reports else 0}


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


class _Keyed(StatefulProcessor):
    """One value per key."""

    state_schema: StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)

    def read(self):
        return self.state.get() if self.state.exists() else None

    def close(self) -> None:
        pass


class _Session(_Keyed):
    """A fold over the rows of a key in time order; its state ends with the time of the last row.

    ``step`` takes the state (None for a key that is new or was silent too long) and a row, and returns the new state
    and the row to put out, or None.
    """

    columns: list[str]
    reads: list[str]

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def arranged(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):
        rows, out = self.arranged(_in_order(rows, ["ts", "event_id"])), []
        held = self.read()
        state, at = (tuple(held[:-1]), held[-1]) if held is not None else (None, None)
        for ms, *row in zip(rows["ms"], *[rows[c] for c in self.reads]):
            ms = int(ms)
            if at is not None and ms - at > self.idle_ms:
                state = None
            state, said = self.step(state, row)
            at = ms if at is None else max(at, ms)
            if said is not None:
                out.append((*key, *said))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at + self.idle_ms)
        self.state.update((*state, at))
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        yield pd.DataFrame([], columns=self.columns)


def _keyed(stream: DataFrame, keys: list[str], processor: StatefulProcessor, out: StructType, mode: str = "append",
           time: str = "none") -> DataFrame:
    return stream.groupBy(*keys).transformWithStateInPandas(processor, out, mode, time)


def _timed(rows: DataFrame, delay: str, *columns) -> DataFrame:
    return rows.withWatermark("ts", delay).select("ts", F.unix_millis("ts").alias("ms"), *columns)


# ---- positions ----------------------------------------------------------------------------------

class _Changes(_Session):
    state_schema = _struct(video_id="long", cue_no="long", at="long")
    columns, reads = ["session", "event_id", "video_id", "cue_no"], ["event_id", "video_id", "cue_no"]

    def arranged(self, rows):
        return rows.groupby(["ts", "ms", "event_id", "video_id"], sort=False, as_index=False)["cue_no"].max()

    def step(self, state, row):
        event, video, cue = row
        cue = -1 if pd.isna(cue) else int(cue)
        was = state[1] if state is not None and state[0] == video else -1
        return (int(video), cue), (int(event), int(video), cue) if cue != was else None


def follow_stream(positions: DataFrame, cues: DataFrame, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """Active cue per session, a row per change; cue_no -1 means none."""
    spans = cue_spans(cues)
    located = file_intervals(positions.withWatermark("ts", delay), spans, ["video_id"], "t_ms", "lo", "hi")
    rows = located.select("session", "ts", F.unix_millis("ts").alias("ms"), "event_id", "video_id", F.col("cue_no").cast("bigint").alias("cue_no"))
    return _keyed(rows, ["session"], _Changes(idle_ms), _struct(session="long", event_id="long", video_id="long", cue_no="long"), time="eventtime")


class _Drift(_Session):
    state_schema = _struct(video_id="long", t_ms="long", at="long")
    columns, reads = ["session", "event_id", "video_id", "t_ms"], ["event_id", "video_id", "t_ms"]

    def __init__(self, idle_ms: int, epsilon_ms: int):
        super().__init__(idle_ms)
        self.epsilon_ms = epsilon_ms

    def step(self, state, row):
        event, video, t = map(int, row)
        if state is not None and state[0] == video and abs(state[1] - t) < self.epsilon_ms:
            return state, None
        return (video, t), (event, video, t)


def drift_stream(positions: DataFrame, epsilon_ms: int = DRIFT_MS, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """Positions that moved at least ``epsilon_ms`` from the last kept one."""
    rows = _timed(positions, delay, "session", "event_id", "video_id", "t_ms")
    return _keyed(rows, ["session"], _Drift(idle_ms, epsilon_ms), _struct(session="long", event_id="long", video_id="long", t_ms="long"), time="eventtime")


class _Stall(_Keyed):
    state_schema = _struct(last_ms="long", down="bool")

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def _frame(self, rows):
        return pd.DataFrame(rows, columns=["session", "responding", "at_ms"])

    def handleInputRows(self, key, rows, timerValues):
        times = sorted(int(t) for batch in rows for t in batch["ms"])
        state, out = self.read(), []
        last, down = state if state is not None else (None, False)
        for t in times:
            if last is not None and not down and t - last >= self.silence_ms:
                out.append((key[0], False, last + self.silence_ms))
                down = True
            if down:
                out.append((key[0], True, t))
            last, down = (t if last is None else max(last, t)), False
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.silence_ms)
        self.state.update((last, down))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, _ = self.read()
        self.state.update((last, True))
        yield self._frame([(key[0], False, last + self.silence_ms)])


def stall_stream(events: DataFrame, silence_ms: int = STALL_MS, delay: str = "1 minute") -> DataFrame:
    """Flips of each session: not responding after ``silence_ms`` without an event, back with the next one."""
    rows = events.withWatermark("ts", delay).select("session", "ts", F.unix_millis("ts").alias("ms"))
    return _keyed(rows, ["session"], _Stall(silence_ms), _struct(session="long", responding="bool", at_ms="long"),
                  time="eventtime")


class _Switch(_Session):
    state_schema = _struct(seq="long", at="long")
    columns, reads = ["session", "event_id", "seq"], ["event_id", "seq"]

    def step(self, state, row):
        event, seq = map(int, row)
        return (seq,), (event, seq) if state is None or state[0] != seq else None


def parse_player_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines to (event, name, t, pause, path); values of the wrong type are ignored."""
    raw = F.col(value)
    ev = F.from_json(raw, schemas.PLAYER_EVENT)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), "$.data", "variant"))
    change = ev["event"] == "property-change"
    on = lambda name: change & (ev["name"] == name)
    return lines.select(
        "*", ev["event"].alias("event"), ev["name"].alias("name"),
        F.when(on("playback-time") & kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), ev["data"].try_cast("double")).alias("t"),
        F.when(on("pause") & (kind == "BOOLEAN"), ev["data"].try_cast("boolean")).alias("pause"),
        F.when(on("path") & (kind == "STRING"), ev["data"]).alias("path"))


def player_switches(events: DataFrame, playlist: DataFrame, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """Path events that name another playlist entry; unknown paths and echoes are ignored.

    ``events`` is (session, ts, event_id, path), ``playlist`` (seq, path); of equal paths the first counts.
    """
    known = playlist.groupBy("path").agg(F.min("seq").alias("seq"))
    rows = _timed(events, delay, "session", "event_id", "path").join(known, "path").drop("path")
    return _keyed(rows, ["session"], _Switch(idle_ms), _struct(session="long", event_id="long", seq="long"), time="eventtime")


# ---- searches -----------------------------------------------------------------------------------

def debounced_pattern(searches: DataFrame, quiet: str = "300 milliseconds", delay: str = "1 second") -> DataFrame:
    """The last pattern of each burst, once ``quiet`` passed without another."""
    burst = searches.withWatermark("ts", delay).groupBy("session", F.session_window("ts", quiet).alias("burst"))
    last = burst.agg(F.max_by("pattern", F.struct("ts", "event_id")).alias("pattern"), F.count("*").alias("n_typed"))
    return last.select("session", F.col("burst.start").alias("started_at"), "pattern", "n_typed")


class _Heat(_Keyed):
    """Heat of the videos of one bucket: a call per bucket and micro-batch instead of several per video."""

    columns = ["video_id", "heat", "n"]

    def __init__(self, idle_ms: int, keep: float):
        self.idle_ms, self.keep = idle_ms, keep
        self.state_schema = StructType([StructField(n, ArrayType(kind)) for n, kind in (
            ("video_id", LongType()), ("heat", DoubleType()), ("n", LongType()), ("at", LongType()))])

    def held(self) -> dict[int, tuple[float, int, int]]:
        state = self.read()
        return {} if state is None else {video: rest for video, *rest in zip(*state)}

    def hold(self, held: dict[int, tuple[float, int, int]]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.handle.registerTimer(min(last for _, _, last in held.values()) + self.idle_ms)
            self.state.update((list(held), *map(list, zip(*held.values()))))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues):
        rows, held, met = _in_order(rows, ["n"]), self.held(), {}
        for video, *row in zip(*[rows[c].tolist() for c in ("video_id", "n", "add", "ms")]):
            met.setdefault(video, []).append(row)
        for video, added in met.items():
            heat, at, last = held.get(video, (0.0, added[0][0], 0))
            times = [ms for _, _, ms in added]
            if video in held and min(times) - last > self.idle_ms:
                heat = 0.0
            for n, add, _ in added:
                # One that comes late has faded by now; what is there does not grow from it.
                heat = heat * self.keep ** max(n - at, 0) + add * self.keep ** max(at - n, 0)
                at = max(at, n)
            held[video] = met[video] = (heat if heat >= COLD_FLOOR else 0.0, at, max(last, *times))
        self.hold({video: state for video, state in held.items() if state[0] > 0})
        out = pd.DataFrame([(video, heat, at) for video, (heat, at, _) in met.items()], columns=self.columns)
        yield out if key[0] >= 0 else out.assign(video_id=None)  # bucket -1: rows without a video

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        self.hold({video: state for video, state in self.held().items() if state[2] + self.idle_ms > now})
        yield pd.DataFrame([], columns=self.columns)


def heat_stream(contributions: DataFrame, keep: float = HEAT_KEEP, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """Interest per video as of its latest contribution (ts, video_id, n, add); it fades by n when read.

    A contribution that comes out of order has faded by its distance.  A video whose heat falls below the floor is
    cold: heat 0, and forgotten; so is one without a contribution for ``idle_ms``.  State is kept by ``HEAT_BUCKETS``
    buckets of videos: most of what a key costs is the calls for its state and timer, whatever it holds.
    """
    bucket = F.when(F.col("video_id").isNotNull(), F.pmod(F.xxhash64("video_id"), F.lit(HEAT_BUCKETS))).otherwise(F.lit(-1)).alias("bucket")
    video = F.coalesce("video_id", F.lit(0)).alias("video_id")  # a null would turn the ids of a batch into floats
    return _keyed(_timed(contributions, delay, bucket, video, "n", "add"), ["bucket"], _Heat(idle_ms, keep),
                  _struct(video_id="long", heat="double", n="long"), mode="update", time="eventtime")


# ---- hits, replies, tasks -----------------------------------------------------------------------

class _FirstSeen(_Session):
    """Accepted or open; an abort opens again."""

    state_schema = _struct(accepted="bool", at="long")
    columns, reads = ["video_id", "hit_ms", "event_id"], ["event_id", "aborted"]

    def step(self, state, row):
        event, aborted = row
        if aborted:
            return (False,), None
        return (True,), None if state is not None and state[0] else (int(event),)


def first_seen_hits(hits: DataFrame, delay: str = DELAY, memory_ms: int = IDLE_MS) -> DataFrame:
    """Acceptances (video_id, hit_ms, event_id): a (video, time) hit once, and again after each abort.

    ``hits`` is (ts, event_id, video_id, hit_ms, aborted).  A hit is remembered while it keeps coming and for
    ``memory_ms`` after that.
    """
    rows = _timed(hits, delay, "video_id", "hit_ms", "event_id", "aborted")
    return _keyed(rows, ["video_id", "hit_ms"], _FirstSeen(memory_ms), _struct(video_id="long", hit_ms="long", event_id="long"), time="eventtime")


def one_completion(replies: DataFrame, owed: DataFrame, memory: str = "1 hour") -> DataFrame:
    """One outcome per accepted request of the current generation; ``owed`` is (task_id, epoch, target), a row per request."""
    request = ["task_id", "epoch", "target"]
    current = replies.join(owed, request, "left_semi")
    return current.withWatermark("ts", memory).dropDuplicatesWithinWatermark(request).select(*request)


class _Tasks(_Keyed):
    """State of every task of one plan."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tasks = handle.getMapState("tasks", _struct(id="long"), _struct(state="string"))

    def handleInputRows(self, key, rows, timerValues):
        rows, touched = _in_order(rows, ["seq"]), {}
        to = {"take": "running", "done": "done", "fail": "parked"}
        for task, op in zip(rows["id"], rows["op"]):
            task = int(task)
            if op == "reset":
                for known in [k[0] for k in self.tasks.keys()]:
                    touched[known] = None
                self.tasks.clear()
            elif op != "add":
                self.tasks.updateValue((task,), (to[op],))
                touched[task] = to[op]
            elif not self.tasks.containsKey((task,)):
                self.tasks.updateValue((task,), ("pending",))
                touched[task] = "pending"
        yield pd.DataFrame([(key[0], t, s) for t, s in touched.items()], columns=["plan", "id", "state"])


def task_state_stream(events: DataFrame) -> DataFrame:
    """State changes per (plan, id); a NULL state means forgotten by a reset."""
    return _keyed(events.select("plan", "id", "seq", "op"), ["plan"], _Tasks(),
                  _struct(plan="long", id="long", state="string"), mode="update")


# ---- ingestion ----------------------------------------------------------------------------------

def read_file_stream(spark: SparkSession, path: str, glob: str = "*.srt") -> DataFrame:
    return (spark.readStream.format("binaryFile").schema(schemas.BINARY_FILE).option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").load(path))


def incremental_ingest(files: DataFrame, key: str = "video_id") -> DataFrame:
    """New files to cues.  The parse never leaves a file's row, so the stream keeps no state."""
    return srt_scan(decode_text(files), key)
