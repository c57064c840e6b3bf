"""Streaming operators and the helpers that run a bounded stream to its end."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.index import change_status, merged_index
from ..session import scratch_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
QUIET, STALE, FUTURE = 20, 3600, 300  # fixed values: seconds until waiting and unknown, and how far ahead an event may be


def table_stream(spark: SparkSession, directory: str, name: str, at: str) -> DataFrame:
    """A table as a file stream; ``at`` becomes a timestamp with zone, as event time must be."""
    path = f"{directory}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    pattern = f"{directory}/{name}[.]parquet"  # a pattern, since the file source takes no single file
    return spark.readStream.schema(schema).parquet(pattern).withColumn(at, F.col(at).cast("timestamp"))


def run_to_end(stream: DataFrame, *, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and gives its output as a table; of complete-mode batches the last one.

    Each micro-batch has a folder of its number, so one that is tried again takes its own place.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark), scratch_path(spark)
    numbers: set[int] = set()

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number:09d}")
        numbers.add(number)

    if spark.conf.get(STATE_STORE, None) != ROCKSDB:  # stays set, so that streams side by side don't change it for each other
        spark.conf.set(STATE_STORE, ROCKSDB)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    wanted = sorted(numbers)[-1:] if mode == "complete" else sorted(numbers)
    if not wanted:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{out}/{n:09d}" for n in wanted])


def first_deliveries(stream: DataFrame, *, key: str, at: str, within: str) -> DataFrame:
    """Each key once within the watermark: later copies are dropped, and state goes when the watermark has passed."""
    return stream.where(F.col(key).isNotNull()).withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def daily_totals(stream: DataFrame, *, at: str, value: str, late: str, by: str) -> DataFrame:
    """(by, day, total, n): totals of UTC days; a day is final once the watermark has passed it."""
    windows = stream.withWatermark(at, late).groupBy(by, F.window(at, "1 day").alias("w"))
    return windows.agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("day"), "total", "n")


def refreshed_index(batch: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, status counts) after a micro-batch of scanned files: the body of a ``foreachBatch`` index refresh."""
    status = change_status(batch, existing)
    return merged_index(batch, existing), status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


INTERRUPTED = "[Request interrupted by user"
TURN_EVENTS = "array<struct<event:string,tool:string>>"


def turn_blocks(blocks: DataFrame) -> DataFrame:
    """(delivery_id, opening, answers, calls) of every delivered row with blocks: its first text block's beginning, whether it
    holds a tool result, and its tool events in order of their blocks.  A tool block without an id can't be followed."""
    kind = F.col("block_type")
    tool = F.when(kind == "tool_use", F.col("block_id")).when(kind == "tool_result", F.col("tool_use_id"))
    event = F.when(kind == "tool_use", "tool_started").otherwise("tool_finished")
    begins = F.substring(F.coalesce("block_text", F.lit("")), 1, len(INTERRUPTED))
    return blocks.groupBy("delivery_id").agg(
        F.min_by(begins, F.when(kind == "text", F.col("block_no"))).alias("opening"),
        F.max(kind == "tool_result").alias("answers"),
        F.array_sort(F.collect_list(F.when(tool.isNotNull(), F.struct("block_no", event.alias("event"), tool.alias("tool"))))).alias("calls"),
    )


def turn_events(row_type: Column, stop_reason: Column, aside: Column, opening: Column, answers: Column, calls: Column) -> Column:
    """What a message row says of its turn, as an array of (event, tool) in order; empty for a row that says nothing.

    A user row starts a turn if it has text and no tool result, and interrupts one if its text says so.  An assistant row is
    activity, and ends or interrupts the turn after its calls.  Every tool block is one event under its own id.
    """
    role, text = F.lower(F.trim(row_type)), F.coalesce(opening, F.lit(""))
    stopped = (role == "user") & (text == INTERRUPTED)
    first = F.when(stopped, "interrupted").when((role == "user") & (text != "") & ~F.coalesce(answers, F.lit(False)), "started").when(role == "assistant", "activity")
    last = F.when((role == "assistant") & stop_reason.isin("end_turn", "stop_sequence"), "ended").when((role == "assistant") & (stop_reason == "max_tokens"), "interrupted")

    def one(event: Column) -> Column:
        return F.array(F.struct(event.alias("event"), F.lit(None).cast("string").alias("tool")))

    tools = F.transform(F.coalesce(calls, F.array().cast("array<struct<block_no:int,event:string,tool:string>>")), lambda c: F.struct(c["event"].alias("event"), c["tool"].alias("tool")))
    said = F.when(stopped, one(first)).otherwise(F.filter(F.concat(one(first), tools, one(last)), lambda e: e["event"].isNotNull()))
    return F.when(role.isin("user", "assistant") & ~F.coalesce(aside, F.lit(False)), said).otherwise(F.array().cast(TURN_EVENTS))


# What a line of the event dialect says of its turn, by its type and its payload's.
LINE_EVENTS = {
    "event_msg": {
        "started": ("task_started", "turn_started", "user_message"), "ended": ("task_complete", "turn_completed"),
        "interrupted": ("turn_aborted", "turn_interrupted", "task_failed", "shutdown"), "activity": ("agent_message", "agent_reasoning"),
    },
    "response_item": {
        "tool_started": ("function_call", "custom_tool_call", "tool_search_call"),
        "tool_finished": ("function_call_output", "custom_tool_call_output", "tool_search_output"), "activity": ("reasoning",),
    },
}
EVENT_LINE = "type string, timestamp string, payload struct<type:string, call_id:string, name:string, role:string, phase:string>"


def line_events(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """(columns of ``lines``, at, event, tool, readable) of lines in the event dialect, one row for a line that says something.

    A line with a call id is a call or its output whatever else it is; one of these without an id says nothing.  A message
    starts a turn if it is the user's, ends it if it is a final answer, and is activity otherwise.  A line that can't be
    read, or has no time, comes out with ``readable`` false and no event: its session is unknown from there on.
    """
    from ..sources.readers import epoch_of

    e = F.from_json(value, EVENT_LINE)
    kind, call = F.col("e.payload.type"), F.col("e.payload.call_id")
    one = F.lit(None).cast("string")
    for outer, events in LINE_EVENTS.items():
        for event, kinds in events.items():
            needs = call.isNotNull() if event.startswith("tool") else call.isNull() if outer == "response_item" else F.lit(True)
            one = F.when((F.col("e.type") == outer) & kind.isin(*kinds) & needs, event).otherwise(one)
    message = (F.col("e.type") == "response_item") & (kind == "message") & call.isNull()
    role, final = F.col("e.payload.role"), F.col("e.payload.phase") == "final_answer"
    said = F.when(message & (role == "user"), "started").when(message & (role == "assistant"), F.when(final, "ended").otherwise("activity")).otherwise(one)
    rows = lines.withColumn("e", e).withColumns({"at": epoch_of(F.col("e.timestamp")), "__said": said})
    readable = F.col("e.type").isNotNull() & F.col("at").isNotNull()
    rows = rows.withColumns({"readable": readable, "event": F.when(readable, F.col("__said")), "tool": F.when(readable & F.col("__said").startswith("tool"), call)})
    return rows.where(~F.col("readable") | F.col("event").isNotNull()).drop("e", "__said")


#: Where a turn goes from each kind of phase; nothing for an event that is ignored there.
TURN_STEPS = {
    "unknown": {"started": "working", "activity": "working", "tool_started": "working", "ended": "completed", "interrupted": "interrupted"},
    "working": {"started": "working", "activity": "working", "tool_started": "working", "tool_finished": "working", "ended": "completed", "interrupted": "interrupted"},
    "closed": {"started": "working", "tool_started": "working", "ended": "completed", "interrupted": "interrupted"},
}
EDGES = ("started", "ended", "interrupted")  # events that put what is open aside and bar earlier ones


@dataclass
class Turn:
    """Lifecycle of one session by ``TURN_STEPS``.  Late events of a finished turn never reopen it, and silence never ends one."""

    phase: str = "unknown"
    started: float | None = None
    ended: float | None = None
    last: float | None = None
    edge: float = float("-inf")  # time of the last edge
    pending: list[str] = field(default_factory=list)

    @property
    def working(self) -> bool:
        return self.phase == "working"

    def _barred(self, event: str, at: float, now: float) -> bool:
        """Events from too far ahead or from before the last edge, a repeated start, and what comes at the moment of an end."""
        reopens = event in ("started", "tool_started") and self.phase in ("completed", "interrupted") and at == self.edge
        return at > now + FUTURE or at < self.edge or reopens or (event == "started" and at == self.started)

    def apply(self, event: str, at: float, tool: str | None, now: float) -> None:
        kind = self.phase if self.phase in TURN_STEPS else "closed"
        goal = None if self._barred(event, at, now) else TURN_STEPS[kind].get(event)
        if goal is None:
            return
        begins, opens = event == "started", event == "tool_started"
        if event in EDGES:
            self.edge, self.pending = at, []
        if begins or (opens and kind != "working"):  # a call alone shows work, but not when it began
            self.started, self.ended = (at if begins else None), None
        elif goal != "working":
            self.ended = at
        kept = [t for t in self.pending if t != tool]
        self.pending = [*kept, tool] if opens and tool is not None else kept
        self.phase, self.last = goal, max(at, self.last if self.last is not None else at)

    def status(self, now: float) -> tuple[str, float | None]:
        """(phase shown, when it changes by itself): waiting after a quiet while, unknown after a long one."""
        if not self.working or self.last is None:
            return self.phase, None
        for shown, until in (("working", QUIET), ("waiting", STALE)):
            if now < self.last + until:
                return shown, self.last + until
        return "unknown", None


TURN_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("phase", T.StringType()), T.StructField("turn", T.StringType()), T.StructField("started", T.DoubleType()),
    T.StructField("ended", T.DoubleType()), T.StructField("last", T.DoubleType()), T.StructField("pending", T.IntegerType()), T.StructField("recheck", T.DoubleType()),
])


class TurnProcessor(StatefulProcessor):
    """Keeps one ``Turn`` a session; an event-time timer reports the change that silence brings and bounds the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", T.StructType([T.StructField("json", T.StringType())]))

    def _read(self) -> Turn:
        return Turn(**json.loads(self.turn.get()[0])) if self.turn.exists() else Turn()

    def _row(self, key, turn: Turn, now: float) -> Row:
        phase, recheck = turn.status(now)
        return Row(*TURN_SCHEMA.names)(key[0], phase, turn.phase, turn.started, turn.ended, turn.last, len(turn.pending), recheck)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.turn.exists()
        turn = self._read() if known else Turn()
        events = sorted(((r.at, r.line_no, r.step, r.event, r.tool) for r in rows), key=lambda e: (*e[:4], e[4] or ""))
        now = events[-1][0]
        for at, _, _, event, tool in events:
            turn.apply(event, at, tool, now)
        self.turn.update((json.dumps(asdict(turn)),))
        if turn.working and turn.last is not None:
            for timer in list(self.handle.listTimers()) if known else ():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((turn.last + QUIET) * 1000))
        yield self._row(key, turn, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        turn = self._read()
        phase, recheck = turn.status(now)
        if phase == "waiting":
            self.handle.registerTimer(int(recheck * 1000))
        yield self._row(key, turn, now)

    def close(self) -> None:
        pass


def turn_states(events: DataFrame, *, late: str = "10 minutes") -> DataFrame:
    """Status rows of every session as its events come in; ``events`` has (session_id, ts, at, line_no, event, tool), and
    step where a line has several events."""
    if "step" not in events.columns:
        events = events.withColumn("step", F.lit(0))
    return events.withWatermark("ts", late).groupBy("session_id").transformWithState(
        statefulProcessor=TurnProcessor(), outputStructType=TURN_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


SKEW, MOST_SOURCES, MOST_OF_A_DAY = 2.0, 4, 93_600.0  # fixed values: seconds of clock skew, sources at once, seconds of a day


@dataclass
class Focus:
    """What is known of one source: its last number, whether it has focus, when it was last active and last heard of."""

    sequence: int = 0
    focused: bool = False
    active: float | None = None
    seen: float = 0.0

    def until(self, idle: float, lease: float) -> float:
        """How far its last packet covers."""
        return min(self.active + idle, self.seen + lease) if self.focused and self.active is not None else float("-inf")


@dataclass
class Ledger:
    """Time of a local day in which a source has focus: up to ``idle`` after activity and ``lease`` after a packet.

    Coverage ends without being made up where numbers have a gap, the clock and the packets' ticks part by ``SKEW`` seconds
    or more, ticks run back, the local day or zone changes, or sources disconnect; the day is partial then.
    """

    idle: float = 300.0
    lease: float = 45.0
    day: str | None = None
    zone: str | None = None
    total: float | None = None
    partial: bool = False
    sources: dict[str, Focus] = field(default_factory=dict)
    tick: float | None = None
    wall: float | None = None

    def _restart(self, tick: float, wall: float) -> None:
        self.sources, self.partial, self.tick, self.wall = {}, True, tick, wall

    def _moved(self, day: str | None, zone: str | None) -> bool:
        known, self.day, self.zone = (self.day, self.zone), day, zone
        if known == (day, zone) or known == (None, None):
            return False
        self.total, self.partial = None, True
        return True

    def advance(self, tick: float, wall: float, day: str | None, zone: str | None) -> None:
        """Adds what is covered from the last tick to this one."""
        moved = self._moved(day, zone)
        if self.tick is not None:
            if moved or tick < self.tick or abs((wall - self.wall) - (tick - self.tick)) >= SKEW:
                return self._restart(tick, wall)
            covered = max((f.until(self.idle, self.lease) for f in self.sources.values()), default=float("-inf"))
            gained = min(tick, covered) - self.tick
            if gained > 0:
                self.total = min((self.total or 0.0) + gained, MOST_OF_A_DAY)
            lost = [f for f in self.sources.values() if f.focused and tick - f.seen >= self.lease]
            for f in lost:
                f.focused, f.active = False, None
            self.partial = self.partial or bool(lost)
        self.tick, self.wall = tick, wall

    def disconnect(self, source: str | None, tick: float, wall: float, day: str, zone: str) -> None:
        """One source, or all of them, is gone."""
        self.advance(tick, wall, day, zone)
        self.sources = {k: f for k, f in self.sources.items() if source is not None and k != source}
        self.partial = True

    def receive(self, source: str, sequence: int, kind: str, focused: bool, tick: float, wall: float | None = None, day: str | None = None, zone: str | None = None) -> None:
        wall = tick if wall is None else wall
        if not source or len(source.encode()) > 128 or sequence <= 0:
            self.partial = True
            return
        last = self.sources[source].sequence if source in self.sources else 0
        if sequence <= last:
            return
        if kind == "gap" or sequence != last + 1:
            self._moved(day, zone)
            self._restart(tick, wall)
        if kind != "gap":
            self.advance(tick, wall, day, zone)
        if source not in self.sources and len(self.sources) >= MOST_SOURCES:
            self.partial = True
            return
        own = self.sources.setdefault(source, Focus())
        own.sequence, own.seen = sequence, tick
        if kind != "heartbeat":
            own.focused = focused and kind != "gap"
            own.active = tick if own.focused else None
            for other in self.sources.values():
                other.focused = other.focused and (other is own or not own.focused)
        if own.until(self.idle, self.lease) > float("-inf") and self.total is None:
            self.total = 0.0

    def stored(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def restored(cls, text: str) -> Ledger:
        values = json.loads(text)
        return cls(**values | {"sources": {k: Focus(**f) for k, f in values["sources"].items()}})


LEDGER_OUT = "day string, seconds double, partial boolean"


def activity_ledger(stream: DataFrame, *, zone: str = "UTC", idle: float = 300.0, lease: float = 45.0, late: str = "1 hour") -> DataFrame:
    """(day, seconds, partial) running totals by day; ``stream`` has (day, ts, source, sequence, kind, focused, tick) and may
    have ``wall``, the clock in seconds (the tick, if it has none).  Kind is focus, activity, edit, heartbeat, gap or
    disconnect (of the source, or of all where it is null)."""
    if "wall" not in stream.columns:
        stream = stream.withColumn("wall", F.col("tick"))

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ledger = Ledger.restored(state.get[0]) if state.exists else Ledger(idle=idle, lease=lease)
        for r in sorted((r for b in batches for r in b.itertuples()), key=lambda r: (r.tick, r.source or "", r.sequence)):
            clock = (float(r.tick), float(r.wall), key[0], zone)
            if r.kind == "disconnect":
                ledger.disconnect(r.source, *clock)
            else:
                ledger.receive(r.source, int(r.sequence), r.kind, bool(r.focused), *clock)
        state.update((ledger.stored(),))
        yield pd.DataFrame([(key[0], ledger.total, ledger.partial)], columns=["day", "seconds", "partial"])

    return stream.withWatermark("ts", late).groupBy("day").applyInPandasWithState(step, LEDGER_OUT, "state string", "update", "NoTimeout")


def coalesced(requests: DataFrame, *, key: str, at: str, gap: str, late: str, flags: Sequence[str] = (), levels: Sequence[str] = ()) -> DataFrame:
    """(key, first, last, n, flags, levels): requests that come within ``gap`` of each other make one.

    A flag is set if any of them sets it, a level is the highest that any asks for, so nothing asked for is lost.  Works on a
    stream, where a merged request comes out once the watermark has passed it, and on a table.
    """
    timed = requests.withWatermark(at, late) if requests.isStreaming else requests
    merged = timed.groupBy(key, F.session_window(at, gap).alias("w")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags], *[F.max(v).alias(v) for v in levels],
    )
    return merged.drop("w")


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], state: str, *, every: str | None = None):
    """Starts a stream whose micro-batches go to ``write``; one batch is active at a time, so requests coalesce."""
    writer = stream.writeStream.option("checkpointLocation", state).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
