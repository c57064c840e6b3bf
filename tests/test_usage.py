import random

import pytest
from pyspark.sql import functions as F

from skein.operators import delivery as V
from skein.operators import intervals as I
from skein.operators import journal as J
from skein.operators import usage as U
from skein.sources import readers as R


@pytest.mark.parametrize("readings, total", [([100, 100, 130, 5, 8, 5], 143), ([999], 999), ([1000, 10], 1010), ([None, 5], 5), ([], None)])
def test_counter_resets(spark, readings, total):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(readings)], "s string, i int, v long")
    assert U.counter_deltas(df, key=["s"], order=["i"], value="v").agg(F.sum("delta")).first()[0] == total


@pytest.mark.parametrize("hot", [0, 40, 10**6])
def test_hot_keys_give_the_same(spark, hot):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), i, rng.choice([None, rng.randrange(500)]), rng.choice([None, "a", "b"]), rng.randrange(3000), rng.randrange(-2, 30)) for i in range(400)]
    df = spark.createDataFrame([(k, i, v, c, a, a + n) for k, i, v, c, a, n in rows], "k string, i int, v long, c string, a long, b long")
    last, seen, want_delta, want_carry = {}, {}, [], []
    for k, i, v, c, *_ in rows:
        if v is not None:
            delta = v if k not in last or v < last[k] else v - last[k]
            last[k] = v
            if delta > 0:
                want_delta.append((i, delta))
        seen[k] = c if c is not None else seen.get(k)
        want_carry.append((i, seen[k]))
    got = U.counter_deltas(df, key=["k"], order=["i"], value="v", hot_rows=hot).collect()
    assert sorted((r["i"], r["delta"]) for r in got) == want_delta
    assert sorted((r["i"], r["c"]) for r in U.carried_forward(df, key=["k"], order=["i"], columns=["c"], hot_rows=hot).collect()) == want_carry
    covered = {}
    for k, _, _, _, a, n in rows:
        if n >= 0:
            covered.setdefault(k, set()).update(range(a, a + n))
    got = {r["k"]: r["length"] for r in I.union_length(df, key=["k"], start="a", end="b", hot_rows=hot).collect()}
    assert got == {k: len(v) for k, v in covered.items()}


def test_copied_counters(spark):
    rows = [("s", 1, 0, 100), ("s", 2, 0, 100), ("s", 3, 0, 130), ("s", 4, 0, 5), ("s", 5, 0, 8)]
    df = spark.createDataFrame(rows + rows, "s string, at int, n int, v long")
    assert U.canonical_counters(df, key=["s"], at="at", sequence="n", value="v").agg(F.sum("delta")).first()[0] == 138
    clash = spark.createDataFrame([("s", 1, 0, 999), ("s", 1, 0, 1000)], "s string, at int, n int, v long")
    row = U.canonical_counters(clash, key=["s"], at="at", sequence="n", value="v").first()
    assert row["delta"] == 1000 and row["conflicting"]


def test_streamed_message_counts_once(spark):
    df = spark.createDataFrame([("m", 1, 190, 10), ("m", 2, 180, 20), ("m", 3, 180, 20), ("z", 4, 0, 0), ("n", 5, None, None)], "id string, at int, a long, b long")
    got = {r["id"]: (r["tokens"], r["first_at"]) for r in U.message_totals(df, key="id", counters=["a", "b"], at="at", tie="at").collect()}
    assert got == {"m": (200, 1), "z": (0, 4)}


def test_savings(spark):
    df = spark.createDataFrame([(-3600.0, 100, 1000), (60.0, 200, 500), (120.0, 700, 400)], "ts double, selected long, full long")
    assert tuple(U.savings_totals(df, F.lit(0.0)).first()) == (3, 1200, 300)
    assert tuple(U.savings_totals(df.limit(0), F.lit(0.0)).first()) == (0, 0, 0)


def test_quartiles_take_the_lower_index(spark):
    df = spark.createDataFrame([("g", v) for v in (6, 5, 4, 3, 2, 1, 0)], "g string, v long")
    assert tuple(U.quartile_levels(df, group=["g"], value="v").first())[1:] == (2, 3, 4)


@pytest.mark.parametrize("age, phase", [(19, "working"), (20, "waiting"), (3599, "waiting"), (3600, "unknown"), (None, "unknown")])
def test_phase_by_silence(spark, age, phase):
    last = F.lit(None).cast("timestamp") if age is None else F.timestamp_seconds(F.lit(100_000 - age))
    assert spark.range(1).select(U.session_phase(last, F.timestamp_seconds(F.lit(100_000)))).first()[0] == phase


@pytest.mark.parametrize("spans, length", [([(0, 10), (5, 20)], 20), ([(0, 3), (10, 14)], 7), ([(100, 100)], 0), ([(5, 2)], None), ([(0, 10), (10, 12), (3, 4)], 12)])
def test_unions(spark, spans, length):
    df = spark.createDataFrame([("k", a, b) for a, b in spans], "k string, a long, b long")
    row = I.union_length(df, key=["k"], start="a", end="b").first()
    assert (row and row["length"]) == length


def test_runs(spark):
    events = [(1, "start", -100), (1, "end", -60), (2, "start", -80), (2, "end", -50), (3, "start", -20), (3, "end", -10)] * 2
    df = spark.createDataFrame(events, "id int, kind string, at long")
    runs = I.paired_runs(df, key=["id"], kind="kind", at="at", now=F.lit(0))
    assert tuple(I.day_summary(runs, day_start=F.lit(-1000), day_end=F.lit(1000)).first()) == (60, 0, "ready")
    bad = [(1, "start", -9), (2, "end", -9), (3, "start", -9), (3, "start", -8), (3, "end", -1), (4, "start", -9), (4, "end", -8), (4, "abort", -8), (5, "start", -2), (5, "end", -8), (6, "start", -2), (6, "end", 9)]
    runs = I.paired_runs(spark.createDataFrame(bad, "id int, kind string, at long"), key=["id"], kind="kind", at="at", now=F.lit(0))
    assert tuple(I.day_summary(runs, day_start=F.lit(-1000), day_end=F.lit(1000)).first()) == (None, 6, "partial")


def test_range_join_matches_brute_force(spark):
    points = [("p", float(t)) for t in range(0, 500, 7)] + [("q", 3.0)]
    spans = [("p", float(a), float(a + n), i) for i, (a, n) in enumerate([(0, 0), (3, 200), (100, 100), (490, 50)])] + [("p", 9.0, 2.0, 9)]
    got = I.covered_points(
        spark.createDataFrame(points, "k string, t double"), spark.createDataFrame(spans, "k string, a double, b double, i int"), key="k", at="t", start="a", end="b", width=60.0
    ).select("k", "t", "i").collect()
    want = {(k, t, i) for k, t in points for j, a, b, i in spans if j == k and a <= t <= b}
    assert len(got) == len(want) and {tuple(r) for r in got} == want and want


@pytest.mark.parametrize("beats, seconds", [([(0, True, True), (10, True, False)], 55), ([(t, True, t == 0) for t in range(0, 331, 30)], 300), ([(0, True, True), (1000, False, False)], 45)])
def test_focus(spark, beats, seconds):
    df = spark.createDataFrame([("k", *b) for b in beats], "k string, at long, f boolean, a boolean")
    assert I.focus_intervals(df, key="k", at="at", focused="f", active="a").agg(F.sum(F.col("end") - F.col("start"))).first()[0] == seconds


def test_baselines(spark):
    df = spark.sql("select 'p' project, 'todo' kind, date '2026-07-01' day, 3L `count` union all select 'p', 'todo', date '2026-07-05', 8L union all select 'p', 'todo', date '2026-01-01', 1L")
    at = lambda day: [r["count"] for r in J.oldest_baseline(df, since=F.lit(day).cast("date"), days=30).collect()]
    assert at("2026-07-10") == [3] and at("2026-07-01") == []


def test_numstat(spark):
    stat = "10\t2\tsrc/a.py\n5\t1\tsrc/{b => c}.py\n-\t-\timg.bin\n900\t1\tpackage-lock.json"
    row = J.numstat(spark.createDataFrame([("h", stat)], "hash string, stat string")).first()
    assert tuple(row) == ("h", 15, 3, 2)


def test_trailers_and_sessions(spark):
    commits = spark.createDataFrame([("a", "p", 50.0, "x\nCo-Authored-By: Codex <c>"), ("b", "p", 500.0, "openai is only mentioned"), ("c", "q", 50.0, None)], "hash string, project string, at double, body string")
    sessions = spark.createDataFrame([("p", "heron", 0.0, 50.0), ("q", "quill", 51.0, 60.0)], "project string, agent string, start double, end double")
    got = {r["hash"]: r["agents"] for r in J.attributed(commits, sessions).collect()}
    assert got["a"] == ["Codex", "heron"] and got["b"] == [] and not got["c"]


DELIVERIES = "delivery_id long, message_id string, received_at int, input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long, extra string"


def test_one_copy_per_message(spark):
    rows = [
        (1, "m", 5, 1, None, None, None, "x"), (2, "m", 4, 2, None, None, None, "x"), (3, "m", 3, None, None, None, None, "x"),  # greatest sum stays
        (4, "t", 9, 1, 1, None, None, "x"), (5, "t", 8, 2, None, None, None, "x"), (6, "t", 8, 0, 2, None, None, None),  # earliest, then smallest id
        (7, "z", 9, 0, None, None, None, "x"), (8, "z", 1, None, None, None, None, "x"),  # zero beats unknown
        (9, "M", 1, None, None, None, None, "x"), (10, None, 1, 1, 1, 1, 1, "x"), (11, None, 1, 1, 1, 1, 1, "x"),
        (12, "n", None, 1, None, None, None, "x"), (13, "n", 7, 1, None, None, None, "x"),  # unknown arrival is last
        (14, "big", 1, 2**63 - 1, 2**63 - 1, 0, 0, "x"), (15, "big", 0, 2**63 - 1, 0, 0, 0, "x"),
    ]
    df = spark.createDataFrame(rows, DELIVERIES)
    assert {r[0] for r in V.surplus_copies(df).collect()} == {1, 3, 4, 6, 8, 12, 15}
    assert V.single_copies(df).count() == len(rows) - 7
    assert V.surplus_copies(df.limit(0)).count() == 0


def test_many_copies_of_one_message(spark):
    df = spark.range(5000).selectExpr("id delivery_id", "if(id % 3 = 0, 'hot', concat('m', id)) message_id", "cast(id % 7 as int) received_at", "id % 5 input_tokens",
                                      "cast(null as long) output_tokens", "cast(null as long) cache_read_input_tokens", "cast(null as long) cache_creation_input_tokens")
    kept = [r for r in V.kept_copies(df).where("message_id = 'hot'").collect()]
    hot = [(-(i % 5), i % 7, i) for i in range(5000) if i % 3 == 0]
    assert len(kept) == 1 and kept[0]["kept"] == min(hot)[2]


def test_log_lines(spark):
    import json

    line = lambda t, o, **more: json.dumps({"type": "assistant", "timestamp": "2026-01-02T03:04:05.5+01:00", "cwd": "/a", "message": {"id": "m", "usage": {"input_tokens": t, "output_tokens": o}}, **more})
    rows = [line(100, 20), line(-1, 5), "{broken", json.dumps({"type": "user"}), json.dumps({"usage": {"output_tokens": 7}, "timestamp": "no"})]
    got = R.message_usage(spark.createDataFrame([("f", r) for r in rows], "path string, value string")).collect()
    assert sorted((r["tokens"] is None, r["tokens"] or 0) for r in got if r["counted"]) == [(False, 7), (False, 120)]
    assert [r["at"] for r in got if r["tokens"] == 120] == [1767319445.5]


@pytest.mark.parametrize("stamp, epoch", [
    ("1970-01-01T00:00:10Z", 10.0), ("1970-01-01T00:00:10", 10.0), ("1970-01-01T01:00:00+0100", 0.0), ("1970-01-01T01:00:00.250+01:00", 0.25), ("1970-13-01T00:00:00Z", None), ("x", None), (None, None),
])
def test_iso_epochs(spark, stamp, epoch):
    df = spark.createDataFrame([(stamp,)], "s string")
    assert df.select(R.epoch_of(F.col("s"))).first()[0] == epoch


def test_packets_are_a_closed_schema(spark):
    import json

    good = {"nonce": "n", "sequence": 1, "kind": "edit", "focused": True, "count": 2, "activity": False}
    rows = [good, good | {"more": 1}, {k: v for k, v in good.items() if k != "count"}, good | {"sequence": 0}, good | {"kind": "x"}, good | {"count": -1}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("[]",), (None,)], "value string")
    assert R.packets(df).count() == 1
