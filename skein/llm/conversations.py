"""Rebuilding conversations from delivered message rows and their blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.delivery import kept_copies
from ..session import Table

#: White space, separators, control and format characters, and letters and marks that show nothing.
INVISIBLE = r"\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}"
#: Lines of a log that one task looks through for an earlier time.
LINE_BLOCK = 1024
PLACE = ("at", "line_no", "delivery_id")  # what orders turns
SORTED = "session_id string, turn_no long, message_id string, part int, turns long, broken boolean, opening string, first_act string, last_act string"
GRAPH = ("session_id", "at", "line_no", "delivery_id", "message_id", "act", "src_at", "src_line_no", "src_delivery_id", "step")


def shows(text: str) -> Column:
    """True if a text has any visible character."""
    return F.coalesce(F.col(text).rlike(f"[^{INVISIBLE}]"), F.lit(False))


def turns_of(messages: DataFrame) -> DataFrame:
    """The surviving copy of each message that is a user or assistant turn of a session's main line."""
    kept = kept_copies(messages, payload=(
        F.col("session_id"),
        F.when(F.col("event_ts").isNull(), F.col("log_path")).alias("log_path"),
        F.col("line_no").cast("long").alias("line_no"),
        F.col("event_ts").alias("at"),
        F.lower(F.regexp_replace("row_type", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).alias("role"),
        F.col("is_sidechain").alias("aside"),
    ))
    main = F.col("session_id").isNotNull() & F.col("role").isin("user", "assistant") & ~F.coalesce("aside", F.lit(False))
    return kept.where(main).drop("aside").withColumnRenamed("kept", "delivery_id")


def earlier_times(asked: DataFrame, messages: DataFrame) -> DataFrame:
    """(log_path, line_no, found): for each asked line, the time of the nearest earlier line of its log that has one.

    Lines are gathered in blocks of ``LINE_BLOCK``; the last time of each block is carried over the blocks of a log,
    then over the lines of one block, so a log of any length spreads over many tasks.  Where rows share a line, the
    latest time counts.
    """
    asked = asked.where("log_path is not null and line_no is not null").select("log_path", "line_no").distinct()
    timed = messages.where("event_ts is not null and line_no is not null").join(
        asked.select("log_path").distinct(), "log_path", "left_semi"
    )
    lines = timed.groupBy("log_path", F.col("line_no").cast("long").alias("line_no")).agg(F.max("event_ts").alias("at"))
    both = lines.withColumn("asks", F.lit(False)).unionByName(
        asked.withColumns({"at": F.lit(None).cast(lines.schema["at"].dataType), "asks": F.lit(True)})
    ).withColumn("block", F.floor(F.col("line_no") / LINE_BLOCK))
    ends = both.groupBy("log_path", "block").agg(F.max_by("at", F.when(F.col("at").isNotNull(), F.col("line_no"))).alias("end"))
    over_blocks = Window.partitionBy("log_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("log_path", "block", F.last("end", ignorenulls=True).over(over_blocks).alias("carried"))
    over_lines = Window.partitionBy("log_path", "block").orderBy("line_no").rangeBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("own", F.last("at", ignorenulls=True).over(over_lines)).where("asks")
    return inside.join(ends, ["log_path", "block"]).select("log_path", "line_no", F.coalesce("own", "carried").alias("found"))


def conversations(messages: DataFrame, blocks: DataFrame, *, parts: int | None = None) -> DataFrame:
    """(session_id, turn_no, message_id): the turns of every whole conversation, in order.

    The turns of a session are the nodes of its reply graph; a tool call has an edge to the turn with its result.  Kahn's
    algorithm sorts each graph, the earliest turn first where several are free (time, line, then delivery id; a turn of
    unknown time takes the time of the nearest earlier line of its log, and comes first where there is none).  Its order
    numbers the turns.  A session is dropped if turns are left over (calls and results in a cycle, or one without the
    other) or a turn comes free only after one that is later in time (a result before its call); then the order is walked:
    the first turn must be a prompt (a user turn with visible text) and every prompt must be followed by a reply (an
    assistant turn with visible text and no tool call) before the next prompt or the end.  A call or result without an id
    can't meet another.  Rows without session or message id, and sessions without turns, give no rows.

    Graphs are cut along a range partitioning by session and time into ``parts`` (shuffle partitions, if not given), so no
    task holds more than one part of a session of any size: an edge from an earlier part is free already, one from a later
    part never comes free, and what each part's order says is put together over the parts of a session.
    """
    turns = Table(_spoken_turns(messages, blocks))
    nodes = turns.df.select("session_id", "at", "line_no", "delivery_id", "message_id", "act", *[F.lit(None).cast(turns.df.schema[c].dataType).alias(f"src_{c}") for c in PLACE], F.lit(0).alias("step"))
    graph = nodes.unionByName(reply_edges(turns.df))
    order = ("session_id", *PLACE, "step")
    parts = parts or max(2, int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = graph.repartitionByRange(parts, "session_id", *PLACE).sortWithinPartitions(*order)
    stamped = ranged.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("at", "src_at")})
    sorted_parts = Table(stamped.mapInArrow(_sort_parts, SORTED))
    return _joined_parts(sorted_parts.df)


def _spoken_turns(messages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(session_id, at, line_no, delivery_id, message_id, act, tools): turns with their time, what they are and their tools."""
    turns = turns_of(messages)
    found = earlier_times(turns.where("at is null").select("log_path", "line_no"), messages)
    turns = turns.join(found, ["log_path", "line_no"], "left").withColumn("at", F.coalesce("at", "found"))
    kind, calling = F.col("block_type"), F.col("block_type") == "tool_use"
    narrow = blocks.where(kind.isin("text", "tool_use", "tool_result")).select(
        "delivery_id", calling.alias("call"), ((kind == "text") & shows("block_text")).alias("speaks"),
        F.when(kind != "text", F.struct(calling.alias("call"), F.when(calling, F.col("block_id")).otherwise(F.col("tool_use_id")).alias("tool"))).alias("tool"),
    )
    own = narrow.groupBy("delivery_id").agg(F.max("speaks").alias("speaks"), F.max("call").alias("calls"), F.collect_list("tool").alias("tools"))
    act = F.when(F.col("speaks"), F.when(F.col("role") == "user", "prompt").when(~F.col("calls"), "reply"))
    return turns.join(own, "delivery_id", "left").select("session_id", *PLACE, "message_id", act.alias("act"), "tools")


def reply_edges(turns: DataFrame) -> DataFrame:
    """Edges of the reply graphs, at the turn they lead to (step 1), with the place of the turn they come from.

    Of one tool id the first call leads to the first result, so every result has its call, and the last call to the last
    result, so every call has its result.  What lacks its other end leads to itself, and so never comes free.
    """
    tools = turns.select("session_id", F.struct(*PLACE).alias("place"), F.explode("tools").alias("t")).select("session_id", "place", "t.*")
    call, result = F.when(F.col("call"), F.col("place")), F.when(~F.col("call"), F.col("place"))
    ends = tools.groupBy("session_id", "tool").agg(
        F.min(call).alias("first_call"), F.max(call).alias("last_call"), F.min(result).alias("first_result"), F.max(result).alias("last_result")
    )
    alone = F.col("tool").isNull() | F.col("first_call").isNull() | F.col("first_result").isNull()
    one = F.coalesce("first_call", "first_result")
    edge = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    pairs = F.when(alone, F.array(F.struct(one.alias("src"), one.alias("dst")))).otherwise(
        F.array_distinct(F.array(edge("first_call", "first_result"), edge("last_call", "last_result")))
    )
    edges = ends.select("session_id", F.explode(pairs).alias("e"))
    return edges.select(
        "session_id", *[F.col(f"e.dst.{c}").alias(c) for c in PLACE], F.lit(None).cast("string").alias("message_id"), F.lit(None).cast("string").alias("act"),
        *[F.col(f"e.src.{c}").alias(f"src_{c}") for c in PLACE], F.lit(1).alias("step"),
    )


def kahn_order(nodes: int, edges: Iterable[tuple[int, int]]) -> list[int]:
    """Nodes 0, 1, ... by Kahn's algorithm, the smallest free node first; those on or behind a cycle are left out."""
    waits, leads = [0] * nodes, {}
    for src, dst in edges:
        waits[dst] += 1
        leads.setdefault(src, []).append(dst)
    free = [n for n in range(nodes) if not waits[n]]  # ascending, so a heap
    order = []
    while free:
        node = heapq.heappop(free)
        order.append(node)
        for after in leads.get(node, ()):
            waits[after] -= 1
            if not waits[after]:
                heapq.heappush(free, after)
    return order


def _rank(at: int | None, line: int | None, delivery: int | None) -> tuple:
    """A place as a tuple that sorts as Spark does: what is missing comes first."""
    return (at is not None, at or 0, line is not None, line or 0, delivery is not None, delivery or 0)


class _Graph:
    """One part of a session's reply graph, its turns in order of their places."""

    def __init__(self, session: str) -> None:
        self.session = session
        self.places: list[tuple] = []
        self.messages: list[str] = []
        self.acts: list[str | None] = []
        self.edges: list[tuple[tuple, int]] = []  # place of the source, number of the target

    def walked(self) -> tuple[list[int], tuple]:
        """Kahn's order of the part and its summary: turns, whether it is broken, opening, first and last act."""
        n, number = len(self.places), {place: k for k, place in enumerate(self.places)}
        inner = []
        for src, dst in self.edges:
            k = number.get(src)
            if k is None:  # in another part: free already if that is an earlier one, else waits for good
                if src < self.places[0]:
                    continue
                k = dst
            inner.append((k, dst))
        order = kahn_order(n, inner)
        broken = len(order) < n or any(a > b for a, b in zip(order, order[1:]))
        acts = [a for a in map(self.acts.__getitem__, order) if a]
        broken = broken or any(a == b == "prompt" for a, b in zip(acts, acts[1:]))
        return order, (n, broken, self.acts[0] or "", acts[0] if acts else None, acts[-1] if acts else None)


def _sort_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts the graphs of one range partition.  Graphs inside it are judged here; its first and last may go on in the parts
    before and after, so all their turns come out (with ``part``), and a row of number 0 with the summary."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    columns: list[list] = [[] for _ in range(9)]

    def put(graph: _Graph, edge_of_part: bool) -> None:
        order, (n, broken, opening, first, last) = graph.walked()
        if edge_of_part:
            rows = [(graph.session, 0, None, part, n, broken, opening, first, last)]
            rows += [(graph.session, k, graph.messages[i], part, None, None, None, None, None) for k, i in enumerate(order, 1)]
        elif broken or opening != "prompt" or last == "prompt":
            return
        else:
            rows = [(graph.session, k, graph.messages[i], None, None, None, None, None, None) for k, i in enumerate(order, 1)]
        for column, values in zip(columns, zip(*rows)):
            column.extend(values)

    def flush() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string())
        names = [f.split()[0] for f in SORTED.split(", ")]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        for c in columns:
            c.clear()
        return batch

    graph, first = None, True
    for batch in batches:
        rows = batch.to_pydict()
        for session, at, line, delivery, message, act, src_at, src_line, src_delivery, step in zip(*(rows[c] for c in GRAPH)):
            if graph is None or session != graph.session:
                if graph is not None:
                    put(graph, first)
                    first = False
                graph = _Graph(session)
            if step:
                graph.edges.append((_rank(src_at, src_line, src_delivery), len(graph.places) - 1))
            else:
                graph.places.append(_rank(at, line, delivery))
                graph.messages.append(message)
                graph.acts.append(act)
        if len(columns[0]) > 20_000:
            yield flush()
    if graph is not None:
        put(graph, True)
    yield flush()


def _joined_parts(rows: DataFrame) -> DataFrame:
    """Whole sessions as they are, and those that meet the edge of a part if all their parts together make one."""
    whole = rows.where("part is null").select("session_id", "turn_no", "message_id")
    summary = rows.where("turn_no = 0")  # at most two rows a part
    over = Window.partitionBy("session_id").orderBy("part")
    later = Window.partitionBy("session_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumns({
        "before": F.coalesce(F.sum("turns").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "next_act": F.last("first_act", ignorenulls=True).over(later),
    })
    unanswered = (F.col("last_act") == "prompt") & F.coalesce(F.col("next_act") != "reply", F.lit(True))
    bad = F.col("broken") | F.coalesce(unanswered, F.lit(False)) | ((F.col("before") == 0) & (F.col("opening") != "prompt"))
    judged = summary.withColumn("bad", F.max(bad).over(Window.partitionBy("session_id"))).where("not bad").select("session_id", "part", "before")
    cut = rows.where("part is not null and turn_no > 0").select("session_id", "part", "turn_no", "message_id").join(judged, ["session_id", "part"])
    return whole.unionByName(cut.select("session_id", (F.col("turn_no") + F.col("before")).alias("turn_no"), "message_id"))
