import os
from datetime import timezone

import pytest

import __spark_entry__ as entry
from skein.streaming import streams as S

DIRECTORY = "/root/testdata/sf0.001"


def turn(*events, now=None):
    t = S.Turn()
    for event, at, *tool in events:
        t.apply(event, at, tool[0] if tool else None, now or at)
    return t


@pytest.mark.parametrize("age, shown", [(19, "working"), (20, "waiting"), (78, "waiting"), (3600, "unknown"), (7200, "unknown")])
def test_silence_never_ends_a_turn(age, shown):
    t = turn(("started", 100))
    assert t.status(100 + age)[0] == shown and t.ended is None


def test_late_and_future_events():
    t = turn(("started", 100), ("ended", 200), ("activity", 150), ("started", 150))
    assert t.phase == "completed" and t.ended == 200
    t.apply("tool_started", 200, "x", 200)
    assert t.phase == "completed"
    t.apply("tool_started", 201, "x", 201)
    assert t.working and t.pending == ["x"] and t.started is None
    t.apply("ended", 900, None, 201)  # more than five minutes ahead
    assert t.working


def test_repeated_start_is_idempotent():
    t = turn(("started", 100), ("tool_started", 110, "a"), ("started", 100))
    assert t.pending == ["a"]
    assert turn(("tool_started", 5, "a"), ("tool_finished", 6, "a")).pending == []
    assert turn(("started", 1), ("interrupted", 2)).phase == "interrupted"


@pytest.mark.parametrize("packets, total, partial", [
    ([("focus", 0), ("heartbeat", 10)], 10, False),
    ([("focus", 0)] + [("heartbeat", t) for t in range(30, 331, 30)], 300, False),
    ([("focus", 0), ("heartbeat", 1000)], 45, True),
])
def test_ledger(packets, total, partial):
    ledger = S.Ledger()
    for n, (kind, tick) in enumerate(packets, 1):
        ledger.receive("a", n, kind, True, tick)
    assert ledger.total == total and ledger.partial is partial


def test_ledger_gaps_and_replays():
    ledger = S.Ledger()
    ledger.receive("a", 1, "focus", True, 0)
    ledger.receive("a", 1, "focus", True, 5)
    ledger.receive("a", 3, "heartbeat", True, 10)  # a number is missing: the open span is lost
    assert ledger.total == 0 and ledger.partial


def test_streamed_turns_end_like_the_batch(spark, tmp_path):
    rows = [("s1", 0, 1, "started", None), ("s1", 30, 2, "tool_started", "a"), ("s1", 40, 3, "ended", None), ("s2", 10, 1, "started", None)]
    df = spark.createDataFrame(rows, "session_id string, sec long, line_no int, event string, tool string")
    df.selectExpr("session_id", "timestamp_seconds(sec) ts", "cast(sec as double) at", "line_no", "event", "tool").write.parquet(str(tmp_path / "t.parquet"))
    stream = S.table_stream(spark, str(tmp_path), "t", "ts")
    out = {r["session_id"]: r for r in S.run_to_end(S.turn_states(stream)).collect()}
    assert out["s1"]["phase"] == "completed" and out["s1"]["ended"] == 40.0 and out["s2"]["phase"] == "working"


def test_dedup_within_watermark(spark, tmp_path):
    spark.sql("select stack(3, 'a', 1, 'a', 2, 'b', 3) as (k, n)").selectExpr("k", "timestamp_seconds(n) ts").write.parquet(str(tmp_path / "d.parquet"))
    stream = S.table_stream(spark, str(tmp_path), "d", "ts")
    assert S.run_to_end(S.first_deliveries(stream, key="k", at="ts", within="1 hour")).count() == 2


def followed(messages, blocks):
    """{session: (phase, started, ended, last, pending)} by a plain walk over rows and their blocks, as the tracker reads a log."""
    by_row = {}
    for b in sorted(blocks, key=lambda b: b["block_no"]):
        by_row.setdefault(b["delivery_id"], []).append(b)
    sessions = {}
    for m in messages:
        if m["session_id"] is not None and m["event_ts"] is not None and not m["is_sidechain"]:
            sessions.setdefault(m["session_id"], []).append(m)
    out = {}
    for session, rows in sessions.items():
        steps = []
        for m in rows:
            role, mine = (m["row_type"] or "").strip().lower(), by_row.get(m["delivery_id"], [])
            first = next((b["block_text"] or "" for b in mine if b["block_type"] == "text"), "")
            said = []
            if role == "user" and first.startswith("[Request interrupted by user"):
                said = [("interrupted", None)]
            elif role in ("user", "assistant"):
                if role == "assistant":
                    said.append(("activity", None))
                elif first and all(b["block_type"] != "tool_result" for b in mine):
                    said.append(("started", None))
                for b in mine:
                    if b["block_type"] == "tool_use" and b["block_id"] is not None:
                        said.append(("tool_started", b["block_id"]))
                    elif b["block_type"] == "tool_result" and b["tool_use_id"] is not None:
                        said.append(("tool_finished", b["tool_use_id"]))
                if role == "assistant" and m["stop_reason"] in ("end_turn", "stop_sequence"):
                    said.append(("ended", None))
                elif role == "assistant" and m["stop_reason"] == "max_tokens":
                    said.append(("interrupted", None))
            at = m["event_ts"].replace(tzinfo=timezone.utc).timestamp()
            steps += [(at, m["line_no"], n, event, tool or "") for n, (event, tool) in enumerate(said)]
        if steps:
            state, now = S.Turn(), max(s[0] for s in steps)
            for at, _, _, event, tool in sorted(steps):
                state.apply(event, at, tool or None, now)
            out[session] = (state.status(now)[0], state.started, state.ended, state.last, len(state.pending))
    return out


def queried(spark, directory):
    out = {}
    for r in entry.queries()["stream_turn_states"](spark, str(directory)).collect():
        out.setdefault(r["session_id"], set()).add((r["phase"], r["started"], r["ended"], r["last"], r["pending"]))
    return out


def agrees(got, want):
    """The state of a session is among its rows; the others only tell what silence makes of its phase."""
    assert got.keys() == want.keys()
    for session, state in want.items():
        assert state in got[session] and {row[1:] for row in got[session]} == {state[1:]}, session


def test_turns_follow_tool_blocks(spark, tmp_path):
    log = [  # (session, second, type, stop reason, blocks)
        ("a", 0, "user", None, [("text", None, "do it")]),
        ("a", 10, "assistant", "tool_use", [("text", None, "two calls"), ("tool_use", "t1", ""), ("tool_use", "t2", "")]),
        ("a", 20, "User ", None, [("tool_result", "t1", "done")]),
        ("b", 0, "user", None, [("text", None, "go")]),
        ("b", 5, "assistant", None, [("tool_use", "t1", "")]),
        ("b", 6, "user", None, [("tool_result", None, "no id")]),
        ("b", 7, "user", None, [("image", None, None)]),
        ("b", 8, "assistant", "tool_use", [("thinking", None, "x")]),
        ("c", 0, "user", None, [("text", None, "go")]),
        ("c", 9, "user", None, [("text", None, "[Request interrupted by user for tool use]")]),
        ("d", 1, "user", None, [("text", None, "go")]),
        ("d", 3, "assistant", "end_turn", [("text", None, "done")]),
    ]
    messages, blocks = [], []
    for n, (session, second, kind, stop, parts) in enumerate(log):
        messages.append((n, session, 100 + second, n, kind, False, stop, f"m{n}"))
        blocks += [(n, i, k, name if k == "tool_use" else None, name if k == "tool_result" else None, text) for i, (k, name, text) in enumerate(parts)]
    m = spark.createDataFrame(messages, "delivery_id long, session_id string, s long, line_no int, row_type string, is_sidechain boolean, stop_reason string, message_id string")
    m.selectExpr("*", "cast(timestamp_seconds(s) as timestamp_ntz) event_ts").drop("s").write.parquet(str(tmp_path / "log_messages.parquet"))
    b = spark.createDataFrame(blocks, "delivery_id long, block_no int, block_type string, block_id string, tool_use_id string, block_text string")
    b.write.parquet(str(tmp_path / "log_blocks.parquet"))
    got = queried(spark, tmp_path)
    assert {row[1:] for row in got["a"]} == {(100.0, None, 120.0, 1)}
    assert {row[1:] for row in got["b"]} == {(100.0, None, 108.0, 1)}
    assert got["c"] == {("interrupted", 100.0, 109.0, 109.0, 0)} and got["d"] == {("completed", 101.0, 103.0, 103.0, 0)}


@pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no test tables")
def test_turn_states_against_a_plain_walk(spark):
    messages = spark.read.parquet(f"{DIRECTORY}/log_messages.parquet").toPandas().astype(object)
    blocks = spark.read.parquet(f"{DIRECTORY}/log_blocks.parquet").toPandas().astype(object)
    rows = [t.where(t.notna(), None).to_dict("records") for t in (messages, blocks)]
    agrees(queried(spark, DIRECTORY), followed(*rows))
