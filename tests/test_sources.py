import bisect
import os
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import paths as P
from skein.operators import intervals as I
from skein.operators import usage as U
from skein.sources import readers as R
from skein.sources import stores as S
from skein.streaming import streams as W


@pytest.mark.parametrize("line, hits, misses", [
    ("*.log", ["a.log", "x/a.log"], ["a.log/b", "alog"]), ("/dist", ["dist"], ["a/dist"]), ("a/**/b", ["a/b", "a/x/y/b"], ["b", "xa/b"]), ("**/x", ["x", "q/x"], ["qx"]),
    ("\\#keep", ["#keep", "d/#keep"], ["\\#keep"]), ("\\!x", ["!x"], ["x"]), ("foo\\ ", ["foo "], ["foo"]), ("foo   ", ["foo"], ["foo "]), ("a?c", ["abc"], ["a/c", "ac"]), ("x.[y]", ["x.[y]"], ["x.y"]),
    ("logs/**", ["logs/a", "logs/a/b"], ["logs", "x/logs/a"]), ("로그*", ["로그인", "a/로그"], ["로"]),
])
def test_ignore_lines(spark, line, hits, misses):
    rule = P.compile_ignore_rule(line)
    assert not rule.negated and not rule.directories_only
    rows = spark.createDataFrame([(p,) for p in hits + misses], "p string").where(F.col("p").rlike(rule.pattern)).collect()
    assert {r["p"] for r in rows} == set(hits)


def test_lines_that_are_no_rules():
    assert [P.compile_ignore_rule(x) for x in ("", "   ", "# c", "#", "!", "\r\n")] == [None] * 6
    rule = P.compile_ignore_rule("!/a b/ \n")
    assert rule.negated and rule.directories_only and rule.pattern == "^a\\ b$"


def ignored(spark, rules, paths):
    return {r["path"] for r in P.ignored_by_rules(spark.createDataFrame([(p,) for p in paths], "path string"), rules).where("ignored").collect()}


def test_nothing_comes_back_from_a_pruned_directory(spark):
    assert ignored(spark, ["build/", "!build/keep.txt", "*.tmp", "!keep.tmp"], ["build/keep.txt", "x/build/a", "a.tmp", "keep.tmp", "d/keep.tmp", "build"]) == {"build/keep.txt", "x/build/a", "a.tmp"}


def test_inner_directories_overrule_outer_ones_inside_themselves(spark):
    rules = {"": ["*.log"], "a": ["!*.log", "/only.txt"], "a/b": ["z.log"]}
    paths = ["x.log", "a/x.log", "a/b/x.log", "a/b/z.log", "a/only.txt", "a/b/only.txt", "only.txt", "ab/x.log"]
    assert ignored(spark, rules, paths) == {"x.log", "a/b/z.log", "a/only.txt", "ab/x.log"}


def tree(root, files):
    for path, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
        with open(os.path.join(root, path), "w") as f:
            f.write(text)


@pytest.mark.parametrize("fan", [1, 64])
def test_scanned_tree(spark, tmp_path, fan):
    root = str(tmp_path)
    tree(root, {"a/x.py": "one\ntwo", "a/y.log": "l", "a/b/c/z.py": "z", ".github/w.yml": "w", ".git/c": "c", "node_modules/m.js": "m", "a/.gitignore": "b/\n*.log\n", "_u.py": "u", "k/.env": "secret"})
    os.symlink(os.path.join(root, "a/x.py"), os.path.join(root, "link.py"))
    listed = {r["path"] for r in R.list_tree(spark, root, fan=fan).collect()}
    assert listed == {"a/x.py", "a/y.log", "a/b/c/z.py", ".github/w.yml", "a/.gitignore", "_u.py", "k/.env"}
    assert {r["path"]: r["line_count"] for r in R.scan_tree(spark, root, ["_u*"]).collect()} == {"a/x.py": 2, ".github/w.yml": 1}
    with pytest.raises(OSError):
        R.list_tree(spark, root + "/none")


def test_rules_as_rows_decide_as_one_expression(spark):
    rules = {"": ["*.log", "build/", "!keep.log"], "a": ["!*.log", "/only.txt", "b/"], "a/b": ["!z.log"], "c": ["sub", "!sub/x", "*"], "c/d": ["!*"], "é": ["/x"]}
    paths = [f"{d}{n}" for d in ("", "a/", "a/b/", "ab/", "build/", "a/build/", "c/", "c/d/", "c/sub/", "é/", "é/x/") for n in ("x", "x.log", "keep.log", "only.txt", "b", "z.log", "sub")]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    made = spark.createDataFrame([(d, n, r.pattern, r.negated, r.directories_only) for d, lines in rules.items() for n, r in enumerate(map(P.compile_ignore_rule, lines))], R.RULE_ROW)
    assert {r["path"] for r in P.ignored_by_rule_rows(df, made).where("ignored").collect()} == ignored(spark, rules, paths)
    assert P.ignored_by_rule_rows(df, made).count() == len(paths)


def test_tree_with_many_ignore_files(spark, tmp_path):
    """Ignore files over a million characters in all, and more folders than tasks."""
    root = str(tmp_path)
    for n in range(120):
        tree(root, {f"p{n}/.gitignore": "#" + "x" * 10_000 + f"\n*.t{n % 7}\n", f"p{n}/a.t3": f"{n}", f"p{n}/b.py": "b"})
    assert R.list_tree(spark, root).rdd.getNumPartitions() <= 64 + spark.sparkContext.defaultParallelism
    got = {r["path"]: r["content"] for r in R.scan_tree(spark, root).collect()}
    assert got == {f"p{n}/b.py": "b" for n in range(120)} | {f"p{n}/a.t3": f"{n}" for n in range(120) if n % 7 != 3}


def test_files_that_must_not_be_read(spark, tmp_path):
    root = str(tmp_path / "in")
    tree(root, {"ok.txt": "ok", "big.txt": "x" * 50, "d/e.txt": ""})
    tree(str(tmp_path), {"out.txt": "out"})
    with open(os.path.join(root, "bin"), "wb") as f:
        f.write(b"\xff\xfe\xff")
    os.symlink("../out.txt", os.path.join(root, "link"))
    os.symlink(root + "/d", os.path.join(root, "linked"))
    os.mkfifo(os.path.join(root, "pipe"))
    asked = ["ok.txt", "big.txt", "d/e.txt", "bin", "link", "linked/e.txt", "pipe", "d", "../out.txt", "/etc/passwd", "d//e.txt", "./ok.txt", "none"]
    got = {r["path"]: (r["content"], r["problem"]) for r in R.read_files(spark.createDataFrame([(p,) for p in asked], "path string"), root, most=20).collect()}
    assert got["ok.txt"] == ("ok", None) and got["d/e.txt"] == ("", None) and got["big.txt"] == (None, "too large") and got["bin"] == (None, "not text") and got["none"] == (None, "missing")
    assert all(got[p] == (None, "refused") for p in ("link", "linked/e.txt", "../out.txt", "/etc/passwd", "d//e.txt", "./ok.txt"))
    assert got["pipe"] == got["d"] == (None, "not a file")


class Logs:
    """One log followed over passes."""

    def __init__(self, spark, root, **bounds):
        self.spark, self.root, self.bounds = spark, str(root), bounds
        self.state = spark.createDataFrame([], R.TAIL_STATE)

    def put(self, text, mode="a"):
        os.makedirs(self.root + "/p", exist_ok=True)
        with open(self.root + "/p/a.jsonl", mode) as f:
            f.write(text)

    def look(self, bootstrap=None):
        listing, _ = R.list_logs(self.spark, self.root, layout="flat")
        plan = R.tail_plan(listing, self.state, bootstrap=bootstrap)
        self.planned = plan.count()
        lines, read = R.read_tails(plan, self.root, **self.bounds)
        self.state = self.spark.createDataFrame(R.next_state(self.state, read, listing).collect(), R.TAIL_STATE)
        return [r["value"] for r in lines.orderBy("at").collect()]


def test_a_log_is_read_on_from_where_it_was(spark, tmp_path):
    log = Logs(spark, tmp_path)
    log.put("one\n\ntwo\nthr")
    assert log.look() == ["one", "two"] and log.look() == [] and log.planned == 0
    log.put("ee\nfour\n")
    assert log.look() == ["three", "four"]
    log.put("new\n", "w")  # it shrank
    assert log.look() == ["new"]
    os.utime(tmp_path / "p/a.jsonl", (1, 1))  # touched without growing: read anew
    assert log.look() == ["new"]
    os.replace(tmp_path / "p/a.jsonl", tmp_path / "old")
    log.put("other\nand more\n")  # another file under the name
    assert log.look() == ["other", "and more"]
    os.remove(tmp_path / "p/a.jsonl")
    assert log.look() == [] and log.state.count() == 0


def test_passes_and_lines_are_bounded(spark, tmp_path):
    log = Logs(spark, tmp_path, most_read=20, most_line=8)
    log.put("aa\n" + "b" * 30 + "\ncc\n" + "d" * 9 + "\nee\n")
    got = []
    for _ in range(5):
        got += log.look()
    row = log.state.first()
    assert got == ["aa", "cc", "ee"] and not row["more"] and row["offset"] == row["size"]


def test_a_first_look_reads_the_end_of_a_log(spark, tmp_path):
    log = Logs(spark, tmp_path)
    log.put("".join(f"line {i}\n" for i in range(100)))
    assert log.look(bootstrap=20) == ["line 98", "line 99"]
    log.put("more\n")
    assert log.look(bootstrap=20) == ["more"]


def test_listed_logs(spark, tmp_path):
    tree(str(tmp_path), {"p/a.jsonl": "", "p/q/b.jsonl": "", "c.jsonl": "", "p/d.txt": "", "p/q/r/rollout-1.jsonl": "", "rollout-2.jsonl": ""})
    os.symlink(str(tmp_path / "p/a.jsonl"), str(tmp_path / "p/l.jsonl"))
    flat, issues = R.list_logs(spark, str(tmp_path), layout="flat")
    assert [r["path"] for r in flat.collect()] == ["p/a.jsonl"] and issues == ["link"]
    deep, issues = R.list_logs(spark, str(tmp_path), layout="deep")
    assert [r["path"] for r in deep.collect()] == ["p/q/r/rollout-1.jsonl", "rollout-2.jsonl"] and issues == ["link"]
    assert R.list_logs(spark, str(tmp_path), layout="deep", most_entries=2)[1] == ["truncated"]
    assert R.list_logs(spark, str(tmp_path / "none"), layout="deep")[1] == ["unreadable"]


def test_blame_and_status(spark):
    sha = "a" * 40
    text = f"{sha} 1 1 2\nauthor x\nauthor-time 100\nsummary author-time 9\n\tcode\n{sha} 2 2\n\tcode\n{'b' * 40} 7 3 1\nauthor-time 55.5\n\t{sha} not a header"
    got = {(r["line"], r["author_time"]) for r in R.blame_times(spark.createDataFrame([("f", text), ("g", ""), ("h", None)], "path string, text string")).collect()}
    assert got == {(1, 100.0), (3, 55.5)}
    lines = spark.createDataFrame([("p", " M a.py"), ("p", "R  old -> new/b.py"), ("p", "?? .own/x"), ("p", ""), ("p", None)], "project string, value string")
    assert {r["path"] for r in R.status_paths(lines, own=".own/").collect()} == {"a.py", "new/b.py"}


def test_present_agents(spark):
    homes = spark.createDataFrame([("h", ".a/x"), ("h", ".b"), ("i", ".c"), ("i", None)], "home string, path string")
    assert {tuple(r) for r in R.present_agents(homes, {"one": [".a/x", ".b"], "two": [".c"]}).collect()} == {("h", "one"), ("i", "two")}


def test_snapshots_are_guarded(spark, tmp_path):
    daily = spark.createDataFrame([("2026-01-0%d" % i, i) for i in range(1, 8)], "day string, tokens long")
    ranks = spark.createDataFrame([("m", "a", 3), ("m", "b", 2)], "kind string, name string, tokens long")
    path = str(tmp_path / "s")
    S.write_snapshot(daily, ranks, path)
    assert S.read_snapshot(spark, path).count() == 9
    with pytest.raises(S.SnapshotError):
        S.write_snapshot(daily, ranks, path, sample=True)
    S.write_snapshot(daily, ranks, path, sample=True, production=False)
    for bad_days, bad_ranks in ((daily.union(daily), ranks), (daily, ranks.union(ranks)), (daily.selectExpr("day", "-tokens tokens"), ranks), (daily, ranks.selectExpr("kind", "repeat('x', 300000) name", "tokens"))):
        with pytest.raises(S.SnapshotError):
            S.write_snapshot(bad_days, bad_ranks, path)
    daily.selectExpr("'day' kind", "day name", "-tokens tokens").write.mode("overwrite").json(path)
    with pytest.raises(S.SnapshotError):
        S.read_snapshot(spark, path)


def test_activity_documents(spark, tmp_path):
    good = '{"version":1,"day":"2026-01-01","timeZoneID":"Asia/Seoul","estimatedNanoseconds":%s,"phase":"paused","partial":false,"idleSeconds":300,"generatedAt":%d}'
    bad = [good % (-1, 1), good % (93_600_000_000_001, 1), (good % (1, 1)).replace("Seoul", "Nowhere"), (good % (1, 1)).replace("}", ',"path":"x"}'), (good % (1, 1)).replace("300", "299"), "[]", "", None, (good % (1, 1)) + " " * 20_000]
    rows = spark.createDataFrame([(good % (n, 1), True) for n in (0, 5, "null", 93_600_000_000_000)] + [(b, False) for b in bad], "d string, want boolean")
    assert all(r["want"] == r["got"] for r in rows.withColumn("got", S.sound_activity(F.col("d"))).collect())
    root = str(tmp_path / "a")
    batch = lambda *docs: spark.createDataFrame(docs, "key string, document string")
    assert S.read_activity(spark, root).count() == 0
    S.write_activity(batch(("k", good % (1, 1)), ("k", good % (2, 9)), ("l", bad[0])), root, 0)
    S.write_activity(batch(("k", good % (3, 10)), ("m", good % (4, 1))), root, 1)
    S.write_activity(batch(("k", good % (3, 10)), ("m", good % (4, 1))), root, 1)  # tried again
    os.makedirs(root + "/v=000002")  # a write that never ended
    assert {(r["key"], r["estimatedNanoseconds"]) for r in S.read_activity(spark, root).collect()} == {("k", 3), ("m", 4)}


@pytest.mark.parametrize("events, want", [
    ([("begin", 10, "a"), ("end", 20, "a"), ("begin", 15, "b"), ("end", 30, "b")], (20, 1, False)), ([("begin", 5, "a"), ("begin", 9, "a"), ("end", 10, "a")], (5, 1, False)),
    ([("begin", 7, "a"), ("end", 7, "a")], (0, 0, False)), ([("begin", 7, "a")], (None, 0, False)), ([("end", 7, "a")], (None, 0, False)), ([("begin", 9, "a"), ("end", 3, "a")], (None, 0, True)),
    ([("begin", 1, "a"), ("interrupt", 2, None), ("end", 9, "a")], (None, 0, True)), ([("begin", 1, "a"), ("end", 3, "a"), ("interrupt", 4, None), ("begin", 5, "a"), ("end", 6, "a")], (3, 2, False)),
    ([("begin", 1, ""), ("end", 3, "")], (None, 0, True)), ([("begin", 1, "x" * 129)], (None, 0, True)),
])
def test_measured_time(spark, events, want):
    rows = [(None if k == "interrupt" else "s", i, k, at, n) for n, (k, at, i) in enumerate(events)]
    got = I.measured_time(spark.createDataFrame(rows, "source string, id string, kind string, at long, n long")).collect()
    assert [(r["length"], r["ranges"], r["partial"]) for r in got] == [want]


def test_measured_time_with_many_interrupts(spark):
    """Against a walk along the order; interrupts are as many as anything else, so they can't be held in one row."""
    draw = random.Random(3)
    kinds = draw.choices(["begin", "end", "interrupt"], k=20_000)
    events = [(None, None, k, n, n) if k == "interrupt" else (f"s{draw.randrange(3)}", f"i{draw.randrange(4)}", k, n, n) for n, k in enumerate(kinds)]
    opened, spans, broken = {}, {}, set()
    for source, i, kind, at, _ in events:
        if kind == "begin":
            opened.setdefault((source, i), at)
        elif kind == "end" and (source, i) in opened:
            spans.setdefault(source, []).append((opened.pop((source, i)), at))
        elif kind == "interrupt":
            broken |= {s for s, _ in opened}
            opened.clear()
    want = {}
    for source, found in spans.items():
        merged = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        want[source] = (sum(b - a for a, b in merged), len(merged), source in broken)
    df = spark.createDataFrame(events, "source string, id string, kind string, at long, n long").repartition(4)
    assert {r["source"]: (r["length"], r["ranges"], r["partial"]) for r in I.measured_time(df, most_ranges=10_000).collect()} == want
    epochs = I._epochs(df)
    assert "collect_list" not in epochs._jdf.queryExecution().toString()
    stops = [n for n, k in enumerate(kinds) if k == "interrupt"]
    assert all(r["epoch"] == bisect.bisect_left(stops, r["n"]) for r in epochs.collect())


def test_interrupts_of_equal_or_no_order(spark):
    """An interrupt counts for larger numbers only; one without a number for none, but it leaves what is open partial."""
    rows = [("s", "i", "begin", 1, 1), (None, None, "interrupt", 2, 3), ("s", "i", "end", 4, 3), ("t", "j", "begin", 1, None), ("t", "j", "end", 5, 5), (None, None, "interrupt", 9, None)]
    got = I.measured_time(spark.createDataFrame(rows, "source string, id string, kind string, at long, n long")).collect()
    assert {(r["source"], r["length"], r["ranges"], r["partial"]) for r in got} == {("s", 3, 1, False), ("t", None, 0, True)}


def test_measured_ranges_are_bounded(spark):
    rows = spark.range(40).selectExpr("'s' source", "'i' id", "if(id % 2 = 0, 'begin', 'end') kind", "id at", "id n")
    assert I.measured_time(rows, most_ranges=19).first()["partial"] and not I.measured_time(rows, most_ranges=20).first()["partial"]


def ledger(*packets, day="d", zone="UTC"):
    out = W.Ledger()
    for n, p in enumerate(packets, 1):
        kind, tick, wall = (*p, p[1])[:3]
        out.receive("a", n, kind, True, tick, wall, day, zone)
    return out


def test_ledger_discards_what_clocks_do_not_agree_on():
    assert ledger(("focus", 0), ("heartbeat", 10, 11.9)).total == 10
    skewed = ledger(("focus", 0), ("heartbeat", 10, 12.0))
    assert skewed.total == 0 and skewed.partial
    back = ledger(("focus", 10), ("heartbeat", 5))
    assert back.total == 0 and back.partial


def test_ledger_starts_anew_with_the_day_and_the_zone():
    for day, zone in (("e", "UTC"), ("d", "Asia/Seoul")):
        one = ledger(("focus", 0), ("heartbeat", 10))
        one.receive("a", 3, "heartbeat", True, 20, 20, day, zone)
        assert one.total is None and one.partial and (one.day, one.zone) == (day, zone)


def test_ledger_sources():
    one = ledger(("focus", 0))
    one.receive("b", 1, "focus", True, 10, 10, "d", "UTC")  # takes the focus
    one.disconnect("b", 15, 15, "d", "UTC")
    one.receive("a", 2, "heartbeat", True, 30, 30, "d", "UTC")
    assert one.total == 15 and one.partial
    for n in "cdefg":
        one.receive(n, 1, "heartbeat", False, 31, 31, "d", "UTC")
    assert set(one.sources) == {"a", "c", "d", "e"}
    copy = W.Ledger.restored(one.stored())
    assert copy == one
    one.receive("", 1, "focus", True, 1, 1, "d", "UTC")
    assert one.partial


def test_line_events(spark):
    at = '"timestamp":"2026-01-01T00:00:01Z"'
    lines = [
        ('{"type":"event_msg",%s,"payload":{"type":"task_started"}}' % at, "started"), ('{"type":"event_msg",%s,"payload":{"type":"turn_completed"}}' % at, "ended"), ('{"type":"event_msg",%s,"payload":{"type":"shutdown"}}' % at, "interrupted"),
        ('{"type":"response_item",%s,"payload":{"type":"custom_tool_call","call_id":"c"}}' % at, "tool_started"), ('{"type":"response_item",%s,"payload":{"type":"function_call_output","call_id":"c"}}' % at, "tool_finished"),
        ('{"type":"response_item",%s,"payload":{"type":"message","role":"assistant","phase":"final_answer"}}' % at, "ended"), ('{"type":"response_item",%s,"payload":{"type":"message","role":"user"}}' % at, "started"),
        ('{"type":"response_item",%s,"payload":{"type":"function_call"}}' % at, "none"), ('{"type":"event_msg",%s,"payload":{"type":"token_count"}}' % at, "none"), ("{broken", None), ('{"type":"event_msg","payload":{"type":"shutdown"}}', None),
    ]
    rows = W.line_events(spark.createDataFrame([(i, v) for i, (v, _) in enumerate(lines)], "i int, value string")).collect()
    got = {r["i"]: r["event"] for r in rows}
    assert got == {i: e for i, (_, e) in enumerate(lines) if e != "none"} and all(r["readable"] == (r["event"] is not None) for r in rows)


def test_gates(spark):
    rows = [("fix it", True, ["git:x", "symbol:y"], True), (" fix  ", True, ["symbol:y"], False), ("fix all", True, ["git:x"], False), ("fix all", False, ["symbol:y"], False), (None, True, ["symbol:y"], False), ("fix all", None, ["s"], False), ("fix all", True, [], False)]
    df = spark.createDataFrame(rows, "p string, r boolean, why array<string>, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", U.worth_injecting(F.col("p"), F.col("r"), F.col("why"))).collect())


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from skein import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_ids_of_new_files_stay(spark):
    from skein.operators import index as X

    new = spark.createDataFrame([(None, f"p{i}", i) for i in range(50)], "id long, path string, byte_size long")
    old = spark.createDataFrame([(7, "p3"), (9, "p4"), (2, "gone")], "id long, path string")
    ids = [{r["path"]: r["id"] for r in X.merged_index(new.repartition(k), old).collect()} for k in (1, 5)]
    assert ids[0] == ids[1] and ids[0]["p3"] == 7 and ids[0]["p4"] == 9
    assert sorted(v for p, v in ids[0].items() if p not in ("p3", "p4")) == list(range(10, 58))
