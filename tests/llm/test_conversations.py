import random
from datetime import datetime, timedelta

import pytest

from skein.llm import conversations as C

MESSAGES = (
    "delivery_id long, received_at timestamp_ntz, session_id string, log_path string, line_no int, row_type string, event_ts timestamp_ntz, is_sidechain boolean, message_id string, "
    "input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long, kept string"
)
BLOCKS = "delivery_id long, block_no int, session_id string, block_type string, block_id string, tool_use_id string, block_text string, act string"
T0 = datetime(2026, 1, 1)


class Log:
    def __init__(self):
        self.messages, self.blocks = [], []

    def add(self, session, role, *blocks, at=None, line=None, path=None, aside=False, message="new", tokens=None):
        d = len(self.messages) + 1
        line = d if line is None else line
        when = T0 + timedelta(seconds=d) if at is None else at or None
        self.messages.append((d, T0, session, path or f"{session}.jsonl", line, role, when, aside, f"m{d}" if message == "new" else message, tokens, None, None, None, "x"))
        for n, (kind, value) in enumerate(blocks):
            self.blocks.append((d, n, session, kind, value if kind == "tool_use" else None, value if kind == "tool_result" else None, value if kind == "text" else None, "x"))
        return d

    def run(self, spark, **options):
        m, b = spark.createDataFrame(self.messages, MESSAGES), spark.createDataFrame(self.blocks, BLOCKS)
        out = {}
        for r in C.conversations(m, b, **options).collect():
            out.setdefault(r["session_id"], []).append((r["turn_no"], r["message_id"]))
        return {s: [m for _, m in sorted(v)] for s, v in out.items()}


def sample():
    log = Log()
    text = lambda t="hi": ("text", t)
    log.add("ok", "User ", text())
    log.add("ok", "ASSISTANT", ("tool_use", "c1"))
    log.add("ok", "user", ("tool_result", "c1"))
    log.add("ok", "assistant", text(), ("image", None))
    log.add("blank", "user", text("​ ⁠　"))
    log.add("blank", "assistant", text())
    log.add("unanswered", "user", text())
    log.add("unanswered", "user", text())
    log.add("unanswered", "assistant", text())
    log.add("open", "user", text())
    log.add("open", "assistant", text(), ("tool_use", "z"))
    log.add("open", "assistant", text())
    log.add("orphan", "user", text())
    log.add("orphan", "user", ("tool_result", "q"))
    log.add("orphan", "assistant", text())
    log.add("same", "user", text())
    log.add("same", "assistant", ("tool_use", "s"), ("tool_result", "s"))
    log.add("same", "assistant", text())
    log.add("nameless", "user", text())
    log.add("nameless", "assistant", ("tool_use", None))
    log.add("nameless", "user", ("tool_result", None))
    log.add("nameless", "assistant", text())
    log.add("cycle", "user", text())
    log.add("cycle", "assistant", ("tool_use", "a"), ("tool_result", "b"))
    log.add("cycle", "assistant", ("tool_result", "a"), ("tool_use", "b"))
    log.add("cycle", "assistant", text())
    log.add("late", "assistant", text())
    log.add("late", "user", text())
    log.add("late", "assistant", text())
    log.add(None, "user", text())
    log.add("nomessage", "user", text(), message=None)
    log.add("aside", "user", text())
    log.add("aside", "user", text(), aside=True)
    log.add("aside", "system", text())
    log.add("aside", "assistant", text(), aside=None)
    return log


@pytest.mark.parametrize("parts", [1, 2, 7, 60])
def test_whole_conversations_only(spark, parts):
    assert sample().run(spark, parts=parts) == {"ok": ["m1", "m2", "m3", "m4"], "aside": ["m32", "m35"]}


@pytest.mark.parametrize("parts", [1, 5])
def test_times_ties_and_copies(spark, parts):
    log = Log()
    same = T0 + timedelta(hours=1)
    log.add("s", "assistant", ("text", "b"), at=same, line=9)
    log.add("s", "user", ("text", "a"), at=same, line=3)  # line breaks the tie
    log.add("s", "user", ("text", "c"), at=False, line=11)  # takes the time of line 9
    log.add("s", "assistant", ("text", "d"), at=same, line=12)
    log.add("s", "system", at=T0, line=5)
    log.add("s", "user", ("text", "x"), line=1, message="m1", at=T0)  # a copy of m1 that arrived with fewer tokens
    assert log.run(spark, parts=parts) == {"s": ["m2", "m1", "m3", "m4"]}


def test_only_the_kept_copy_speaks(spark):
    log = Log()
    log.add("s", "user", ("text", "a"))
    log.add("s", "assistant", ("text", "b"), message="r", tokens=1)
    log.add("s", "assistant", ("tool_use", "t"), message="r", tokens=2)
    assert log.run(spark) == {}


def test_earlier_times_cross_blocks(spark):
    at = lambda n: T0 + timedelta(seconds=n)
    rows = [("p", 5, at(5)), ("p", 5, at(6)), ("p", 3000, None), ("p", 9000, at(9)), ("p", 9001, None), ("q", 4, None), ("p", 5, None), ("p", None, at(1)), (None, 7, at(1))]
    df = spark.createDataFrame(rows, "log_path string, line_no int, event_ts timestamp_ntz")
    asked = df.where("event_ts is null").selectExpr("log_path", "cast(line_no as long) line_no")
    got = {(r["log_path"], r["line_no"]): r["found"] for r in C.earlier_times(asked, df).collect()}
    assert got == {("p", 3000): at(6), ("p", 9001): at(9), ("q", 4): None, ("p", 5): None}


def leftover(nodes, edges):
    """Nodes on or behind a cycle, by taking away free nodes until none is left."""
    left = set(range(nodes))
    while free := {n for n in left if not any(a in left and b == n for a, b in edges)}:
        left -= free
    return left


def test_kahn_order():
    rng = random.Random(1)
    cycles = 0
    for _ in range(300):
        n = rng.randrange(1, 9)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(9))]
        order, rest = C.kahn_order(n, edges), leftover(n, edges)
        cycles += bool(rest)
        assert sorted(order) == sorted(set(range(n)) - rest)
        place = {v: k for k, v in enumerate(order)}
        for k, v in enumerate(order):  # the smallest node that was free
            free = [m for m in order[k:] if all(place[a] < k for a, b in edges if b == m)]
            assert v == min(free)
    assert cycles > 30


def test_long_chain():
    assert C.kahn_order(5000, [(i, i + 1) for i in range(4999)]) == list(range(5000))


def test_order_and_drops_come_from_kahn(spark, monkeypatch):
    """Without the algorithm, sessions whose calls and results form a cycle or run back would stay."""
    whole = sample().run(spark)
    monkeypatch.setattr(C, "kahn_order", lambda nodes, edges: list(range(nodes)))
    assert {"cycle", "open", "orphan", "same", "nameless"} <= set(sample().run(spark)) - set(whole)
    monkeypatch.setattr(C, "kahn_order", lambda nodes, edges: list(range(nodes))[::-1])
    assert sample().run(spark) != whole


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_repeated_tool_ids(spark, parts):
    rng = random.Random(7)
    log, want = Log(), {}
    for s in range(60):
        name = f"s{s:02d}"
        log.add(name, "user", ("text", "t"))
        turns = [(kind, rng.choice("xy")) for kind in rng.choices(("tool_use", "tool_result"), k=rng.randrange(7))]
        for kind, tool in turns:
            log.add(name, "assistant" if kind == "tool_use" else "user", (kind, tool))
        log.add(name, "assistant", ("text", "t"))
        calls, results = ([(i, t) for i, (k, t) in enumerate(turns) if k == kind] for kind in ("tool_use", "tool_result"))
        want[name] = all(any(j > i and u == t for j, u in results) for i, t in calls) and all(any(j < i and u == t for j, u in calls) for i, t in results)
    assert set(log.run(spark, parts=parts)) == {n for n, w in want.items() if w} and 5 < sum(want.values()) < 55


@pytest.mark.parametrize("parts", [1, 2, 9])
def test_hot_session(spark, parts):
    log = Log()
    for i in range(150):
        log.add("hot", "user" if i % 2 == 0 else "assistant", ("text", "t"))
        if i % 30 == 0:
            log.add(f"s{i}", "user", ("text", "t"))
    got = log.run(spark, parts=parts)
    assert list(got) == ["hot"] and got["hot"] == [f"m{d}" for d, *_ in log.messages if _[1] == "hot"]


def test_empty_tables(spark):
    assert C.conversations(spark.createDataFrame([], MESSAGES), spark.createDataFrame([], BLOCKS)).count() == 0
