"""Queries on intervals, journals and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import journal as J
from ..registry import Registry, table
from .text import once

registry = Registry()
query = registry.query

_spans = "(SELECT user_id, floor(epoch(ts))::BIGINT AS s, (floor(epoch(ts)) + floor(value) * 20)::BIGINT AS e FROM events)"


def spans(spark, d):
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("user_id", start.alias("s"), (start + F.floor("value") * 20).cast("long").alias("e"))


_islands = f"""WITH o AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {_spans} WHERE s <= e),
  i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o),
  m AS (SELECT user_id, island, min(s) AS s, max(e) AS e FROM i GROUP BY ALL)"""


@query("merged_intervals", f"{_islands} SELECT user_id, s, e FROM m")
def merged_intervals(spark, d):
    return I.merged_intervals(spans(spark, d), key=["user_id"], start="s", end="e")


@query("interval_union", f"{_islands} SELECT user_id, sum(e - s)::BIGINT AS length FROM m GROUP BY user_id")
def interval_union(spark, d):
    return I.union_length(spans(spark, d), key=["user_id"], start="s", end="e")


_kind = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' WHEN 'error' THEN 'abort' END"
_runs = f"""WITH r AS (SELECT user_id, ts::DATE AS day, count(DISTINCT CASE WHEN k = 'start' THEN ts END) AS starts, count(DISTINCT CASE WHEN k = 'end' THEN ts END) AS ends,
    count(*) FILTER (WHERE k = 'abort') AS aborts, min(CASE WHEN k = 'start' THEN ts END) AS a, min(CASE WHEN k = 'end' THEN ts END) AS b
    FROM (SELECT *, {_kind} AS k FROM events) GROUP BY user_id, ts::DATE),
  v AS (SELECT *, coalesce(starts = 1 AND ends = 1 AND aborts = 0 AND a <= b AND b <= TIMESTAMP '2024-01-29', false) AS valid FROM r)"""


def runs(spark, d):
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end").when(F.col("event_type") == "error", "abort")
    rows = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), kind.alias("kind"), F.col("ts").alias("at"))
    return I.paired_runs(rows, key=["user_id", "day"], kind="kind", at="at", now=F.lit("2024-01-29").cast("timestamp_ntz"))


@query("pair_runs", f"{_runs} SELECT user_id, day::VARCHAR AS day, a AS start, b AS \"end\", valid FROM v")
def pair_runs(spark, d):
    return runs(spark, d).withColumn("day", F.col("day").cast("string"))


@query("day_run_summary", f"""{_runs},
    c AS (SELECT greatest(floor(epoch(a)), epoch(TIMESTAMP '2024-01-10 05:00'))::BIGINT AS s, least(floor(epoch(b)), epoch(TIMESTAMP '2024-01-11 05:00'))::BIGINT AS e FROM v
      WHERE valid AND floor(epoch(b)) >= epoch(TIMESTAMP '2024-01-10 05:00') AND floor(epoch(a)) < epoch(TIMESTAMP '2024-01-11 05:00')),
    o AS (SELECT *, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
    SELECT sum(greatest(0, e - greatest(s, coalesce(before, s))))::BIGINT AS length, (SELECT count(*) FROM v WHERE NOT valid) AS missing,
      CASE WHEN (SELECT count(*) FROM v WHERE NOT valid) > 0 THEN 'partial' WHEN count(*) > 0 THEN 'ready' ELSE 'no records' END AS state FROM o""")
def day_run_summary(spark, d):
    """Runs clipped to a New York day (five hours after UTC midnight in January)."""
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    rows = runs(spark, d).select("valid", seconds("start").alias("start"), seconds("end").alias("end"))
    first, last = I.day_bounds(F.lit("2024-01-10").cast("date"), "America/New_York")
    return I.day_summary(rows, day_start=first, day_end=last)


_sessions = """(SELECT project, agent, session_id, epoch(min(last_event_at)) - 21600 AS start_, epoch(max(last_event_at)) AS end_ FROM session_status WHERE project IS NOT NULL AND last_event_at IS NOT NULL GROUP BY ALL)"""
_commits = "(SELECT delivery_id, split_part(log_path, '/', 1) AS project, epoch(event_ts) AS tick FROM log_messages WHERE event_ts IS NOT NULL)"


def session_spans(spark, d):
    at = F.unix_micros(F.col("last_event_at").cast("timestamp")) / 1e6
    rows = table(spark, d, "session_status").where("project is not null and last_event_at is not null")
    return rows.groupBy("project", "agent", "session_id").agg((F.min(at) - 21600).alias("start"), F.max(at).alias("end"))


@query("range_attribution", f"""
    SELECT delivery_id, agent, count(*) AS sessions FROM {_commits} c JOIN {_sessions} s ON s.project = c.project AND c.tick BETWEEN start_ AND end_ GROUP BY ALL""")
def range_attribution(spark, d):
    rows = table(spark, d, "log_messages").where("event_ts is not null")
    points = rows.select("delivery_id", F.split_part("log_path", F.lit("/"), F.lit(1)).alias("project"), (F.unix_micros(F.col("event_ts").cast("timestamp")) / 1e6).alias("at"))
    hits = I.covered_points(points, session_spans(spark, d), key="project", at="at", start="start", end="end", width=86_400.0)
    return hits.groupBy("delivery_id", "agent").agg(F.count(F.lit(1)).alias("sessions"))


_US = "chr(31)"
_chunk = f"(SELECT doc_id, concat_ws({_US}, sha256(doc_id::VARCHAR), epoch(written_at)::BIGINT, coalesce(lang, 'x'), split_part(text, chr(10), 1), text || chr(10) || 'Co-authored-by: Claude <a@b>') AS chunk FROM documents WHERE channel = 'commits' AND text IS NOT NULL AND written_at IS NOT NULL)"


def _chunks(spark, d):
    docs = table(spark, d, "documents").where("channel = 'commits' and text is not null and written_at is not null")
    at = F.round(F.unix_micros(F.col("written_at").cast("timestamp")) / 1e6).cast("long").cast("string")
    body = F.concat("text", F.lit("\nCo-authored-by: Claude <a@b>"))
    return docs.select("doc_id", F.concat_ws(J.FIELD, F.sha2(F.col("doc_id").cast("string"), 256), at, F.coalesce("lang", F.lit("x")), F.split_part("text", F.lit("\n"), F.lit(1)), body).alias("chunk"))


@query("commit_records", f"""
    SELECT substr(p[1], 1, 7) AS hash, p[2]::DOUBLE AS at, p[3] AS author, p[4] AS subject, 'Claude Code' AS agents
    FROM (SELECT string_split(chunk, {_US}) AS p FROM {_chunk}) WHERE len(p) >= 5""")
def commit_records(spark, d):
    records = J.commit_records(_chunks(spark, d))
    return records.select("hash", "at", "author", "subject", F.array_join(J.trailer_agents(F.col("body")), ",").alias("agents"))


@query("numstat_totals", """
    SELECT project AS hash, sum(line_count)::BIGINT AS added, sum(byte_size)::BIGINT AS deleted, count(*) AS files FROM (SELECT DISTINCT * FROM files)
    WHERE line_count IS NOT NULL AND byte_size IS NOT NULL AND NOT regexp_matches(regexp_extract(path, '([^/]*)$', 1), '(\\.min\\.js|\\.min\\.css|\\.map|\\.lock|\\.pb\\.go|_pb2\\.py|_pb2_grpc\\.py|\\.pb\\.cc|\\.pb\\.h|\\.generated\\.swift)$')
      AND NOT regexp_matches(path, '(^|/)(node_modules|vendor|\\.build|dist|build|out|Pods|Carthage|\\.venv|venv|target|__pycache__|\\.next|\\.nuxt|coverage|__snapshots__|\\.yarn|\\.gradle|DerivedData|\\.terraform|migrations)/')
    GROUP BY project""")
def numstat_totals(spark, d):
    """Each indexed file as one line of a commit's statistics, a file of unknown size as a binary one."""
    f = once(table(spark, d, "files"))
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = F.concat_ws("\t", cell("line_count"), cell("byte_size"), F.col("path"))
    return J.numstat(f.select(F.col("project").alias("hash"), line.alias("stat")))


@query("day_journal", f"""
    WITH c AS (SELECT written_at::DATE AS day, contains(lower(text), 'agent') AS marked FROM documents WHERE channel = 'commits' AND written_at IS NOT NULL),
    days AS (SELECT day, count(*) AS commits, count(*) FILTER (WHERE marked) AS by_agents FROM c GROUP BY day),
    tokens AS (SELECT event_ts::DATE AS day, sum(input_tokens)::BIGINT AS tokens FROM log_messages WHERE event_ts IS NOT NULL GROUP BY 1)
    SELECT coalesce(days.day, tokens.day)::VARCHAR AS day, coalesce(commits, 0) AS commits, coalesce(by_agents, 0) AS by_agents, tokens FROM days FULL JOIN tokens ON days.day = tokens.day""")
def day_journal(spark, d):
    docs = table(spark, d, "documents").where("channel = 'commits' and written_at is not null")
    agents = F.when(F.lower("text").contains("agent"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    tokens = table(spark, d, "log_messages").where("event_ts is not null").select(F.to_date("event_ts").alias("day"), F.col("input_tokens").alias("tokens"))
    return J.day_journal(docs.select(F.to_date("written_at").alias("day"), agents.alias("agents")), tokens).withColumn("day", F.col("day").cast("string"))


_snap = "(SELECT (user_id % 20)::BIGINT AS project, event_type AS kind, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)"


def snapshots(spark, d):
    rows = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("project"), F.col("event_type").alias("kind"), F.to_date("ts").alias("day"))
    return rows.agg(F.count(F.lit(1)).alias("count"))


_base = f"""(SELECT s.project, s.kind, s.n FROM {_snap} s JOIN (SELECT project, min(day) AS day FROM {_snap} WHERE day < DATE '2024-01-20' AND day >= DATE '2024-01-06' GROUP BY project) f ON f.project = s.project AND f.day = s.day)"""


@query("oldest_baseline", f"SELECT project, kind, n FROM {_base}")
def oldest_baseline(spark, d):
    return J.oldest_baseline(snapshots(spark, d), since=F.lit("2024-01-20").cast("date"), days=14).withColumnRenamed("count", "n")


@query("debt_changes", f"SELECT t.project, t.kind, (t.n - b.n)::BIGINT AS change FROM {_snap} t JOIN {_base} b ON b.project = t.project AND b.kind = t.kind WHERE t.day = DATE '2024-01-20'")
def debt_changes(spark, d):
    snaps = snapshots(spark, d)
    base = J.oldest_baseline(snaps, since=F.lit("2024-01-20").cast("date"), days=14)
    return J.debt_change(snaps.where("day = date '2024-01-20'").select("project", "kind", "count"), base)


@query("trend_series", f"SELECT day::VARCHAR AS day, n, (n - lag(n) OVER (ORDER BY day))::BIGINT AS change FROM {_snap} WHERE project = 3 AND kind = 'error' AND day >= DATE '2024-01-01'")
def trend_series(spark, d):
    from pyspark.sql import Window

    one = snapshots(spark, d).where("project = 3 and kind = 'error' and day >= date '2024-01-01'")
    return one.select(F.col("day").cast("string").alias("day"), F.col("count").alias("n"), (F.col("count") - F.lag("count").over(Window.partitionBy("project").orderBy("day"))).alias("change"))


@query("focus_time", f"""
    WITH p AS (SELECT user_id, floor(epoch(ts))::BIGINT AS tick, event_type <> 'error' AS f, event_type IN ('click', 'view') AS a FROM events),
    q AS (SELECT user_id, tick, bool_or(f) AS f, bool_or(a) AS a FROM p GROUP BY ALL),
    w AS (SELECT *, lead(tick) OVER o AS nxt, last_value(CASE WHEN a THEN tick END IGNORE NULLS) OVER (o ROWS UNBOUNDED PRECEDING) AS touched FROM q WINDOW o AS (PARTITION BY user_id ORDER BY tick))
    SELECT user_id, sum(e - tick)::BIGINT AS seconds FROM (SELECT user_id, tick, least(coalesce(nxt, tick + 4500), tick + 4500, touched + 30000) AS e FROM w WHERE f AND touched IS NOT NULL) WHERE e > tick GROUP BY user_id""")
def focus_time(spark, d):
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    packets = table(spark, d, "events").groupBy("user_id", at.alias("at")).agg(
        F.bool_or(F.col("event_type") != "error").alias("f"), F.bool_or(F.col("event_type").isin("click", "view")).alias("a")
    )
    rows = I.focus_intervals(packets, key="user_id", at="at", focused="f", active="a", idle=30_000, lease=4_500)
    return rows.groupBy("user_id").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))


@query("sequence_gaps", """
    SELECT log_path, sum(n)::BIGINT AS packets, sum(gaps)::BIGINT AS gaps, sum(gaps) > 0 OR count(*) > 1 AS partial FROM (
      SELECT log_path, nonce, count(*) AS n, count(*) FILTER (WHERE line_no - before <> 1) AS gaps FROM (
        SELECT log_path, nonce, line_no, lag(line_no) OVER (PARTITION BY log_path, nonce ORDER BY line_no) AS before FROM (SELECT DISTINCT log_path, coalesce(session_id, '') AS nonce, line_no FROM log_messages)) GROUP BY ALL) GROUP BY log_path""")
def sequence_gaps(spark, d):
    """Lines of a log as numbered packets, their session as the nonce."""
    from ..operators.usage import sequence_summary

    return sequence_summary(table(spark, d, "log_messages"), key="log_path", sequence="line_no", nonce="session_id")


_commit_rows = """(SELECT doc_id::VARCHAR AS hash, split_part(source, '/', 1) AS project, epoch(written_at) AS tick, written_at::DATE AS day, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Co-authored-by: Cursor <c@d>' ELSE '' END AS body, n_chars
  FROM documents WHERE channel = 'commits' AND written_at IS NOT NULL)"""


def commits(spark, d):
    """Texts of the commits channel as commits; every third one names an agent."""
    docs = table(spark, d, "documents").where("channel = 'commits' and written_at is not null")
    trailer = F.when(F.col("doc_id") % 3 == 0, "\nCo-authored-by: Cursor <c@d>").otherwise("")
    return docs.select(
        F.col("doc_id").cast("string").alias("hash"), F.split_part("source", F.lit("/"), F.lit(1)).alias("project"), (F.unix_micros(F.col("written_at").cast("timestamp")) / 1e6).alias("at"),
        F.to_date("written_at").alias("day"), F.concat(F.coalesce("text", F.lit("")), trailer).alias("body"), F.col("n_chars").alias("added"), F.lit(0).alias("deleted"),
        F.substring(F.coalesce("text", F.lit("")), 1, 20).alias("subject"),
    )


_named = """list_filter(['Claude Code', 'Codex', 'Cursor', 'Gemini', 'Copilot'], lambda a: len(list_filter(string_split(lower(body), chr(10)), lambda l: contains(l, 'co-authored-by:') AND (
  (a = 'Claude Code' AND contains(l, 'claude')) OR (a = 'Codex' AND (contains(l, 'codex') OR contains(l, 'openai'))) OR (a = 'Cursor' AND contains(l, 'cursor')) OR (a = 'Gemini' AND contains(l, 'gemini')) OR (a = 'Copilot' AND contains(l, 'copilot'))))) > 0)"""


@query("attributed_commits", f"""
    WITH c AS (SELECT *, {_named} AS named FROM {_commit_rows}),
    live AS (SELECT c.hash, list(DISTINCT s.agent) AS agents FROM c JOIN {_sessions} s ON s.project = c.project AND c.tick BETWEEN start_ AND end_ GROUP BY c.hash)
    SELECT c.hash, array_to_string(list_sort(list_distinct(list_concat(named, coalesce(live.agents, [])))), ',') AS agents FROM c LEFT JOIN live USING (hash)""")
def attributed_commits(spark, d):
    """Agents of each commit: those it names and those with a session of the project at its time."""
    return J.attributed(commits(spark, d), session_spans(spark, d)).select("hash", F.array_join("agents", ",").alias("agents"))


def _day_tokens(spark, d):
    return table(spark, d, "log_messages").where("event_ts is not null").select(F.to_date("event_ts").alias("day"), F.coalesce("input_tokens", F.lit(0)).alias("tokens"))


_tokens = "(SELECT event_ts::DATE AS day, coalesce(input_tokens, 0) AS tokens FROM log_messages WHERE event_ts IS NOT NULL)"


@query("journal_summary", f"""
    SELECT commits, by_agents, added, 0::BIGINT AS deleted, (SELECT count(DISTINCT day) FROM (SELECT day FROM {_commit_rows} UNION SELECT day FROM {_tokens} WHERE tokens > 0)) AS active_days, (SELECT sum(tokens) FROM {_tokens})::BIGINT AS tokens
    FROM (SELECT count(*) AS commits, count(*) FILTER (WHERE len({_named}) > 0) AS by_agents, coalesce(sum(n_chars), 0)::BIGINT AS added FROM {_commit_rows})""")
def journal_summary(spark, d):
    rows = commits(spark, d).withColumn("agents", J.trailer_agents(F.col("body")))
    return J.journal_summary(rows, _day_tokens(spark, d))


@query("nested_journal", f"""
    WITH n AS (SELECT day, list(hash ORDER BY tick DESC, hash) AS hashes FROM {_commit_rows} GROUP BY day), t AS (SELECT day, sum(tokens)::BIGINT AS tokens FROM {_tokens} GROUP BY day),
    j AS (SELECT coalesce(n.day, t.day) AS day, array_to_string(coalesce(hashes, []), ',') AS hashes, tokens FROM n FULL JOIN t ON t.day = n.day)
    SELECT day::VARCHAR AS day, hashes, tokens, row_number() OVER (ORDER BY day DESC)::INTEGER AS place FROM j""")
def nested_journal(spark, d):
    rows = J.nested_journal(commits(spark, d), _day_tokens(spark, d))
    return rows.select(F.col("day").cast("string").alias("day"), F.array_join(F.transform("commits", lambda c: c["hash"]), ",").alias("hashes"), "tokens", "place")
