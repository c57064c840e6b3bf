"""Queries on usage, counters and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as U
from ..operators.delivery import USAGE_COUNTERS, single_copies
from ..functions import dates as D
from ..operators import intervals as I
from ..registry import Registry, table

registry = Registry()
query = registry.query
NOW = "2026-06-20 00:00:00"


def events(spark, d):
    return table(spark, d, "events").withColumns({"cents": F.round(F.col("value") * 100).cast("long"), "day": F.to_date("ts")})


_ev = "(SELECT *, round(value * 100)::BIGINT AS cents, ts::DATE AS day FROM events)"


@query("counter_delta", _counter_delta := f"""
    SELECT user_id, sum(delta)::BIGINT AS total, count(*) AS steps FROM (
      SELECT user_id, CASE WHEN p IS NULL OR cents < p THEN cents ELSE cents - p END AS delta
      FROM (SELECT user_id, cents, lag(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM {_ev})) WHERE delta > 0 GROUP BY user_id""")
def counter_delta(spark, d):
    deltas = U.counter_deltas(events(spark, d), key=["user_id"], order=["ts", "event_id"], value="cents")
    return deltas.groupBy("user_id").agg(F.sum("delta").alias("total"), F.count(F.lit(1)).alias("steps"))


@query("highwater_counter", f"""
    SELECT user_id, sum(delta)::BIGINT AS total, bool_or(conflicting) AS partial FROM (
      SELECT user_id, conflicting, CASE WHEN p IS NULL OR cents < p THEN cents ELSE cents - p END AS delta FROM (
        SELECT *, lag(cents) OVER (PARTITION BY user_id ORDER BY day, event_type) AS p FROM (
          SELECT user_id, day, event_type, max(cents) AS cents, min(cents) <> max(cents) AS conflicting FROM {_ev} GROUP BY ALL)))
    WHERE delta > 0 GROUP BY user_id""")
def highwater_counter(spark, d):
    rows = U.canonical_counters(events(spark, d), key=["user_id"], at="day", sequence="event_type", value="cents")
    return rows.groupBy("user_id").agg(F.sum("delta").alias("total"), F.bool_or("conflicting").alias("partial"))


_by_line = "PARTITION BY log_path ORDER BY line_no, delivery_id ROWS UNBOUNDED PRECEDING"


@query("counter_delta_parts", _counter_delta)
def counter_delta_parts(spark, d):
    """As ``counter_delta``, every user of more than 20 events cut into parts."""
    deltas = U.counter_deltas(events(spark, d), key=["user_id"], order=["ts", "event_id"], value="cents", hot_rows=20)
    return deltas.groupBy("user_id").agg(F.sum("delta").alias("total"), F.count(F.lit(1)).alias("steps"))


@query("carried_labels", _carried := f"""
    SELECT cwd, model, count(*) AS n FROM (
      SELECT last_value(cwd IGNORE NULLS) OVER w AS cwd, last_value(model IGNORE NULLS) OVER w AS model FROM log_messages
      WINDOW w AS ({_by_line})) GROUP BY ALL""")
def carried_labels(spark, d):
    rows = U.carried_forward(table(spark, d, "log_messages"), key=["log_path"], order=["line_no", "delivery_id"], columns=["cwd", "model"])
    return rows.groupBy("cwd", "model").agg(F.count(F.lit(1)).alias("n"))


@query("carried_labels_parts", _carried)
def carried_labels_parts(spark, d):
    """As ``carried_labels``, every log of more than 20 lines cut into parts."""
    rows = U.carried_forward(table(spark, d, "log_messages"), key=["log_path"], order=["line_no", "delivery_id"], columns=["cwd", "model"], hot_rows=20)
    return rows.groupBy("cwd", "model").agg(F.count(F.lit(1)).alias("n"))


_sum4 = " + ".join(f"greatest(coalesce({c}, 0), 0)" for c in USAGE_COUNTERS)
_messages = f"""messages AS (
  SELECT message_id, max(tokens) AS tokens, min(event_ts) AS first_at, arg_min(coalesce(model, '?'), ROW(-tokens, event_ts IS NULL, coalesce(event_ts, TIMESTAMP '1970-01-01'), delivery_id)) AS model
  FROM (SELECT *, {_sum4} AS tokens FROM log_messages WHERE message_id IS NOT NULL AND coalesce({', '.join(USAGE_COUNTERS)}) IS NOT NULL) GROUP BY message_id)"""


def _messages_df(spark, d):
    rows = table(spark, d, "log_messages").withColumn("model", F.coalesce("model", F.lit("?")))
    return U.message_totals(rows, key="message_id", counters=USAGE_COUNTERS, at="event_ts", tie="delivery_id", labels=["model"])


@query("message_replacement", f"WITH {_messages} SELECT message_id, tokens::BIGINT AS tokens, first_at, model FROM messages")
def message_replacement(spark, d):
    return _messages_df(spark, d)


@query("every_line_usage", f"""
    SELECT log_path, coalesce(cwd, '') AS cwd, sum(t)::BIGINT AS tokens, min(event_ts) AS first_at, max(event_ts) AS last_at
    FROM (SELECT *, {_sum4} AS t FROM log_messages) WHERE t > 0 GROUP BY ALL""")
def every_line_usage(spark, d):
    """The older collector: each usage line adds, copies included; a line without a time has tokens but no span."""
    t = sum((F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in USAGE_COUNTERS[1:]), F.greatest(F.coalesce(USAGE_COUNTERS[0], F.lit(0)), F.lit(0)))
    rows = table(spark, d, "log_messages").withColumn("t", t).where("t > 0")
    return rows.groupBy("log_path", F.coalesce("cwd", F.lit("")).alias("cwd")).agg(F.sum("t").alias("tokens"), F.min("event_ts").alias("first_at"), F.max("event_ts").alias("last_at"))


@query("usage_rollup", f"""WITH {_messages}, m AS (SELECT model, first_at::DATE AS day, tokens FROM messages)
    SELECT model, day::VARCHAR AS day, grouping(day, model)::BIGINT AS level, sum(tokens)::BIGINT AS tokens, count(*) AS n FROM m GROUP BY GROUPING SETS ((), (model), (day), (model, day))""")
def usage_rollup(spark, d):
    rows = _messages_df(spark, d).withColumn("day", F.to_date("first_at"))
    return U.usage_rollup(rows, tokens="tokens", dimensions=[(), ("model",), ("day",), ("model", "day")]).withColumn("day", F.col("day").cast("string"))


@query("top_models", f"WITH {_messages} SELECT model, sum(tokens)::BIGINT AS tokens FROM messages GROUP BY model ORDER BY tokens DESC, model LIMIT 3")
def top_models(spark, d):
    return _messages_df(spark, d).groupBy("model").agg(F.sum("tokens").alias("tokens")).orderBy(F.desc("tokens"), "model").limit(3)


@query("ordered_models", f"""WITH {_messages}, t AS (SELECT split_part(model, '-', 1) AS provider, model, sum(tokens)::BIGINT AS tokens FROM messages GROUP BY ALL)
    SELECT *, row_number() OVER (ORDER BY tokens DESC, provider, model)::INTEGER AS place FROM t""")
def ordered_models(spark, d):
    """Models by tokens, then provider, then name; the first part of a model's name stands for its provider."""
    totals = _messages_df(spark, d).groupBy(F.split_part("model", F.lit("-"), F.lit(1)).alias("provider"), "model").agg(F.sum("tokens").alias("tokens"))
    return U.ordered_models(totals)


@query("topk_hidden", """
    WITH t AS (SELECT source, sum(n_chars)::BIGINT AS size FROM documents WHERE source IS NOT NULL GROUP BY source),
    top AS (SELECT * FROM t ORDER BY size DESC, source LIMIT 5)
    SELECT source, size, ((SELECT count(*) FROM t) - (SELECT count(*) FROM top))::BIGINT AS hidden_count,
      ((SELECT sum(size) FROM t) - (SELECT sum(size) FROM top))::BIGINT AS hidden_value, (SELECT sum(size) FROM t)::BIGINT AS total FROM top""")
def topk_hidden(spark, d):
    totals = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.sum("n_chars").alias("size"))
    return U.top_with_rest(totals, name="source", value="size", k=5)


@query("model_shares", f"WITH {_messages}, t AS (SELECT model, sum(tokens)::BIGINT AS tokens FROM messages GROUP BY model) SELECT model, tokens, round(tokens * 100.0::DOUBLE / (SELECT sum(tokens) FROM t))::BIGINT AS share FROM t")
def model_shares(spark, d):
    return U.share_of_total(_messages_df(spark, d).groupBy("model").agg(F.sum("tokens").alias("tokens")), value="tokens")


_ledger = "(SELECT o_orderdate AS ts, o_custkey, round(o_totalprice)::BIGINT AS full_, (o_custkey * 100)::BIGINT AS selected FROM orders)"


def ledger(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderdate").alias("ts"), F.round("o_totalprice").cast("long").alias("full"), (F.col("o_custkey") * 100).alias("selected"))


@query("savings_onepass", f"SELECT count(*) AS queries, coalesce(sum(greatest(full_ - selected, 0)), 0)::BIGINT AS saved, coalesce(sum(greatest(full_ - selected, 0)) FILTER (WHERE ts >= TIMESTAMP '1998-01-01'), 0)::BIGINT AS saved_today FROM {_ledger}")
def savings_onepass(spark, d):
    return U.savings_totals(ledger(spark, d), F.lit("1998-01-01").cast("timestamp_ntz"))


@query("savings_by_day", f"SELECT ts::DATE::VARCHAR AS day, sum(greatest(full_ - selected, 0))::BIGINT AS saved FROM {_ledger} GROUP BY 1")
def savings_by_day(spark, d):
    return U.savings_by_day(ledger(spark, d)).withColumn("day", F.col("day").cast("string"))


@query("day_fill", f"""
    SELECT c.day::DATE::VARCHAR AS day, v.saved FROM (SELECT unnest(generate_series(DATE '1998-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS day) c
    LEFT JOIN (SELECT ts::DATE AS day, sum(greatest(full_ - selected, 0))::BIGINT AS saved FROM {_ledger} GROUP BY 1) v ON v.day = c.day::DATE""")
def day_fill(spark, d):
    return U.day_filled(U.savings_by_day(ledger(spark, d)), first="1998-01-01", last="1998-12-31", value="saved").withColumn("day", F.col("day").cast("string"))


@query("ledger_summary", f"""
    WITH l AS (SELECT *, o_custkey % 37 AS project FROM {_ledger}), top AS (SELECT project, count(*) AS n FROM l GROUP BY project ORDER BY n DESC, project LIMIT 10)
    SELECT t.*, project, n FROM top, (SELECT count(*) AS queries, coalesce(sum(greatest(full_ - selected, 0)), 0)::BIGINT AS saved, trunc(avg(full_))::BIGINT AS mean_full, trunc(avg(selected))::BIGINT AS mean_selected FROM l) t""")
def ledger_summary(spark, d):
    """A customer's group stands for the project."""
    rows = ledger(spark, d).withColumn("project", (F.col("selected") / 100).cast("long") % 37)
    return U.ledger_summary(rows).select("queries", "saved", "mean_full", "mean_selected", F.explode("projects").alias("p")).select("*", "p.project", "p.n").drop("p")


@query("quartile_levels", f"""
    SELECT event_type, l[(floor((len(l) - 1) * 0.25) + 1)::BIGINT] AS q1, l[(floor((len(l) - 1) * 0.5) + 1)::BIGINT] AS q2, l[(floor((len(l) - 1) * 0.75) + 1)::BIGINT] AS q3
    FROM (SELECT event_type, list_sort(list(cents)) AS l FROM {_ev} WHERE cents > 0 GROUP BY event_type)""")
def quartile_levels(spark, d):
    return U.quartile_levels(events(spark, d), group=["event_type"], value="cents")


@query("heat_levels", f"""
    WITH q AS (SELECT event_type, l[(floor((len(l) - 1) * 0.25) + 1)::BIGINT] AS q1, l[(floor((len(l) - 1) * 0.5) + 1)::BIGINT] AS q2, l[(floor((len(l) - 1) * 0.75) + 1)::BIGINT] AS q3
      FROM (SELECT event_type, list_sort(list(cents)) AS l FROM {_ev} WHERE cents > 0 GROUP BY event_type))
    SELECT event_type, ((cents > q1)::INT + (cents > q2)::INT + (cents > q3)::INT)::BIGINT AS level, count(*) AS n FROM {_ev} JOIN q USING (event_type) GROUP BY ALL""")
def heat_levels(spark, d):
    rows = events(spark, d)
    levels = U.quartile_levels(rows, group=["event_type"], value="cents")
    level = U.heat_level(F.col("cents"), [F.col("q1"), F.col("q2"), F.col("q3")]).cast("long")
    return rows.join(levels, "event_type").groupBy("event_type", level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("weekday_counts", "SELECT (dayofweek(o_orderdate))::INTEGER AS weekday, count(*) AS n FROM orders GROUP BY 1")
def weekday_counts(spark, d):
    return table(spark, d, "orders").groupBy((F.dayofweek("o_orderdate") - 1).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


@query("latest_session_rows", """
    SELECT session_id, agent, phase FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last_event_at DESC NULLS LAST, recheck_at DESC NULLS LAST, phase, agent) AS place FROM session_status) WHERE place = 1""")
def latest_session_rows(spark, d):
    order = [F.desc_nulls_last("last_event_at"), F.desc_nulls_last("recheck_at"), F.asc("phase"), F.asc("agent")]
    return U.latest_rows(table(spark, d, "session_status"), key=["session_id"], order=order).select("session_id", "agent", "phase")


@query("session_phases", f"""
    SELECT phase, count(*) AS n FROM (
      SELECT CASE WHEN max(event_ts) IS NULL OR TIMESTAMP '{NOW}' - max(event_ts) >= INTERVAL 30 DAY THEN 'unknown'
        WHEN TIMESTAMP '{NOW}' - max(event_ts) >= INTERVAL 7 DAY THEN 'waiting' ELSE 'working' END AS phase FROM log_messages GROUP BY session_id) GROUP BY phase""")
def session_phases(spark, d):
    last = table(spark, d, "log_messages").groupBy("session_id").agg(F.max("event_ts").alias("last"))
    phase = U.session_phase(F.col("last"), F.lit(NOW).cast("timestamp_ntz"), quiet=7 * 86_400, stale=30 * 86_400)
    return last.select(phase.alias("phase")).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


@query("sessions_by_agent", """
    SELECT agent, count(*) AS sessions, count(*) FILTER (WHERE phase = 'working') AS working, count(*) FILTER (WHERE phase = 'waiting') AS waiting, min(recheck_at) AS next_check FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last_event_at DESC NULLS LAST, recheck_at DESC NULLS LAST, phase, agent) AS place FROM session_status) WHERE place = 1 GROUP BY agent""")
def sessions_by_agent(spark, d):
    order = [F.desc_nulls_last("last_event_at"), F.desc_nulls_last("recheck_at"), F.asc("phase"), F.asc("agent")]
    rows = U.latest_rows(table(spark, d, "session_status"), key=["session_id"], order=order)
    return rows.groupBy("agent").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("phase") == "working").alias("working"),
        F.count_if(F.col("phase") == "waiting").alias("waiting"), F.min("recheck_at").alias("next_check"),
    )


@query("pending_calls", """
    SELECT session_id, tool FROM (
      SELECT m.session_id, coalesce(block_id, tool_use_id) AS tool, arg_max(block_type = 'tool_use', ROW(line_no, m.delivery_id, block_no)) AS open
      FROM log_blocks b JOIN log_messages m USING (delivery_id) WHERE block_type IN ('tool_use', 'tool_result') AND coalesce(block_id, tool_use_id) IS NOT NULL AND m.session_id IS NOT NULL GROUP BY 1, 2) WHERE open""")
def pending_calls(spark, d):
    blocks = table(spark, d, "log_blocks").where(F.col("block_type").isin("tool_use", "tool_result")).drop("session_id")
    rows = blocks.join(table(spark, d, "log_messages").select("delivery_id", "session_id", "line_no"), "delivery_id")
    rows = rows.withColumn("tool", F.coalesce("block_id", "tool_use_id")).where("tool is not null and session_id is not null")
    return U.pending_calls(rows, key=["session_id", "tool"], order=["line_no", "delivery_id", "block_no"], opens=F.col("block_type") == "tool_use")


@query("limit_then_filter", "SELECT event_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 5")
def limit_then_filter(spark, d):
    newest = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return newest.where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(5).select("event_id")


@query("json_payload", "SELECT (props->>'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def json_payload(spark, d):
    k = F.from_json("props", "k long").getField("k")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("length_chars_bytes", "SELECT lang, sum(length(text))::BIGINT AS characters, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY lang")
def length_chars_bytes(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(F.char_length("text")).alias("characters"), F.sum(F.octet_length("text")).alias("bytes"))


@query("activity_verdicts", """
    WITH s AS (SELECT user_id, max(floor(epoch(ts))::BIGINT) FILTER (WHERE event_type <> 'error') AS activity, max(floor(epoch(ts))::BIGINT) FILTER (WHERE event_type = 'error') AS stop,
      max(floor(epoch(ts))::BIGINT) AS written, bool_or(event_type = 'purchase') AS pending FROM events GROUP BY user_id),
    v AS (SELECT *, 1706572800 AS now FROM s),
    h AS (SELECT *, CASE WHEN now - activity <= 7200 THEN activity + 7200 END AS a,
      CASE WHEN now - written <= 7200 THEN written + 7200 WHEN now - written <= 86400 AND pending THEN written + 86400 END AS b FROM v)
    SELECT user_id, coalesce(NOT stop > activity, true) AND least(a, b) IS NOT NULL AS working, CASE WHEN coalesce(NOT stop > activity, true) THEN least(a, b) END AS recheck_at FROM h""")
def activity_verdicts(spark, d):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    s = table(spark, d, "events").groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") != "error", seconds)).alias("activity"), F.max(F.when(F.col("event_type") == "error", seconds)).alias("stop"),
        F.max(seconds).alias("written"), F.bool_or(F.col("event_type") == "purchase").alias("pending"),
    )
    verdict = U.activity_verdict(F.lit(1706572800).cast("long"), F.col("activity"), F.col("stop"), F.col("written"), F.col("pending"), window=7200, cap=86_400)
    return s.select("user_id", verdict.alias("v")).select("user_id", "v.working", "v.recheck_at")


@query("single_copy_counts", """
    SELECT row_type, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY coalesce(input_tokens, output_tokens, cache_read_input_tokens, cache_creation_input_tokens) IS NULL,
      coalesce(input_tokens, 0) + coalesce(output_tokens, 0) + coalesce(cache_read_input_tokens, 0) + coalesce(cache_creation_input_tokens, 0) DESC, received_at, delivery_id) AS p FROM log_messages)
    WHERE message_id IS NULL OR p = 1 GROUP BY row_type""")
def single_copy_counts(spark, d):
    return single_copies(table(spark, d, "log_messages")).groupBy("row_type").agg(F.count(F.lit(1)).alias("n"))


_latest_log = "(SELECT *, coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS t FROM log_messages)"


@query("merged_sessions", f"""
    WITH m AS (SELECT CASE WHEN length(log_path) % 2 = 0 THEN 'a' ELSE 'b' END AS agent, session_id AS session, message_id AS key, t AS tokens, line_no AS sequence, stop_reason IS NOT NULL AS cumulative FROM {_latest_log} WHERE session_id IS NOT NULL AND message_id IS NOT NULL),
    one AS (SELECT agent, session, key, arg_max(tokens, ROW(CASE WHEN cumulative THEN sequence ELSE tokens END, tokens)) AS tokens FROM m GROUP BY ALL),
    s AS (SELECT CASE WHEN length(log_path) % 2 = 0 THEN 'a' ELSE 'b' END AS agent, session_id AS session, log_path AS path, max(event_ts) AS last, bool_or(cwd IS NULL) AS partial FROM log_messages WHERE session_id IS NOT NULL GROUP BY ALL),
    c AS (SELECT agent, session, max(last) AS last_event, bool_or(partial) AS partial FROM s GROUP BY ALL)
    SELECT agent, session, sum(tokens)::BIGINT AS tokens, coalesce(count(key), 0) AS metrics, last_event, partial FROM c LEFT JOIN one USING (agent, session) GROUP BY ALL""")
def merged_sessions(spark, d):
    """Messages as metrics of their session's logs, those with a reason to stop as readings of a counter."""
    m = table(spark, d, "log_messages").where("session_id is not null").withColumns({
        "agent": F.when(F.char_length("log_path") % 2 == 0, "a").otherwise("b"), "session": F.col("session_id"), "path": F.col("log_path"),
        "tokens": F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)), "sequence": F.col("line_no").cast("long"),
    })
    metrics = m.where("message_id is not null").withColumns({"key": F.col("message_id"), "cumulative": F.when(F.col("stop_reason").isNotNull(), F.col("tokens"))})
    sessions = m.groupBy("agent", "path", "session").agg(F.max("event_ts").alias("last_event"), F.bool_or(F.col("cwd").isNull()).alias("partial"))
    return U.merged_sessions(metrics, sessions).drop("path")


@query("sessions_by_model", """
    WITH l AS (SELECT split_part(log_path, '/', 1) AS provider, session_id, coalesce(arg_max(s, ROW(coalesce(event_ts, TIMESTAMP '1970-01-01'), model, phase)).model, '') AS model,
        arg_max(s, ROW(coalesce(event_ts, TIMESTAMP '1970-01-01'), model, phase)).phase AS phase
      FROM (SELECT *, {'model': model, 'phase': phase} AS s FROM (SELECT log_path, session_id, event_ts, coalesce(model, '') AS model, CASE WHEN stop_reason = 'end_turn' THEN 'completed' WHEN stop_reason = 'tool_use' THEN 'waiting' ELSE 'working' END AS phase
        FROM log_messages WHERE session_id IS NOT NULL)) GROUP BY ALL),
    g AS (SELECT provider, model, count(*) AS sessions, count(*) FILTER (WHERE phase = 'working') AS working, count(*) FILTER (WHERE phase = 'waiting') AS waiting FROM l GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY provider ORDER BY working DESC, waiting DESC, sessions DESC, model)::INTEGER AS place FROM g""")
def sessions_by_model(spark, d):
    m = table(spark, d, "log_messages").where("session_id is not null")
    phase = F.when(F.col("stop_reason") == "end_turn", "completed").when(F.col("stop_reason") == "tool_use", "waiting").otherwise("working")
    return U.sessions_by_model(m.select(
        F.split_part("log_path", F.lit("/"), F.lit(1)).alias("provider"), F.col("session_id").alias("session"), F.coalesce("model", F.lit("")).alias("model"), phase.alias("phase"),
        F.coalesce("event_ts", F.lit("1970-01-01").cast("timestamp_ntz")).alias("at"),
    ))


@query("project_cards", """
    WITH r AS (SELECT split_part(log_path, '/', 1) AS project, coalesce(model, '?') AS agent, sum(coalesce(output_tokens, 0))::BIGINT AS tokens FROM log_messages GROUP BY ALL),
    top AS (SELECT project, sum(tokens)::BIGINT AS total FROM r GROUP BY project ORDER BY total DESC, project LIMIT 8)
    SELECT project, total, agent, tokens, (row_number() OVER (PARTITION BY project ORDER BY tokens DESC, agent) - 1)::INTEGER AS place FROM r JOIN top USING (project)""")
def project_cards(spark, d):
    m = table(spark, d, "log_messages")
    rows = m.select(F.split_part("log_path", F.lit("/"), F.lit(1)).alias("project"), F.coalesce("model", F.lit("?")).alias("agent"), F.coalesce("output_tokens", F.lit(0)).alias("tokens"))
    return U.project_cards(rows).select("project", "total", F.posexplode("agents").alias("place", "a")).select("project", "total", "place", "a.agent", "a.tokens")


@query("month_totals", """
    SELECT strftime(m, '%Y-%m-01') AS month, coalesce(total, 0)::BIGINT AS total FROM (SELECT unnest(generate_series((SELECT min(date_trunc('month', o_orderdate)) FROM orders), (SELECT max(date_trunc('month', o_orderdate)) FROM orders), INTERVAL 1 MONTH)) AS m)
    LEFT JOIN (SELECT date_trunc('month', o_orderdate) AS m, sum(round(o_totalprice)::BIGINT) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (m)""")
def month_totals(spark, d):
    orders = table(spark, d, "orders")
    ends = orders.agg(F.trunc(F.min("o_orderdate"), "month").alias("a"), F.trunc(F.max("o_orderdate"), "month").alias("b"))
    months = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m")).select(F.col("m").cast("string").alias("month"))
    daily = orders.where("o_orderstatus = 'F'").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum(F.round("o_totalprice").cast("long")).alias("total"))
    return U.month_totals(daily, D.month_grid(months), value="total")


@query("fourteen_days", f"""
    WITH c AS (SELECT unnest(generate_series(DATE '2024-01-22', DATE '2024-02-04', INTERVAL 1 DAY))::DATE AS day), v AS (SELECT day, sum(cents)::BIGINT AS cents FROM {_ev} GROUP BY day),
    f AS (SELECT c.day, coalesce(cents, 0) AS cents FROM c LEFT JOIN v ON v.day = c.day)
    SELECT day::VARCHAR AS day, cents, (SELECT sum(cents) FROM f WHERE day > DATE '2024-01-28')::BIGINT AS week_total, (SELECT max(cents) FROM f) AS most FROM f""")
def fourteen_days(spark, d):
    daily = events(spark, d).groupBy("day").agg(F.sum("cents").alias("cents"))
    return U.trend(daily, last="2024-02-04", value="cents").withColumn("day", F.col("day").cast("string"))


@query("period_totals", f"""
    WITH {_messages}, m AS (SELECT model, split_part(log_path, '/', 1) AS project, first_at::DATE AS day, tokens FROM messages JOIN (SELECT message_id, min(log_path) AS log_path FROM log_messages GROUP BY 1) USING (message_id))
    SELECT project, model, coalesce(sum(tokens) FILTER (WHERE day = DATE '2026-05-01'), 0)::BIGINT AS today, coalesce(sum(tokens) FILTER (WHERE day > DATE '2026-04-24' AND day <= DATE '2026-05-01'), 0)::BIGINT AS week, sum(tokens)::BIGINT AS total,
      grouping(project, model)::BIGINT AS level FROM m GROUP BY GROUPING SETS ((), (model), (project))""")
def period_totals(spark, d):
    """Today, the last seven days and all time, in total, by model and by project."""
    logs = table(spark, d, "log_messages").where("message_id is not null").groupBy("message_id").agg(F.min("log_path").alias("log_path"))
    rows = _messages_df(spark, d).join(logs, "message_id").select("model", F.split_part("log_path", F.lit("/"), F.lit(1)).alias("project"), F.to_date("first_at").alias("day"), "tokens")
    return U.period_totals(rows, today="2026-05-01", groups=[(), ("model",), ("project",)])


@query("activity_summary", """
    WITH t AS (SELECT m.session_id, arg_max(coalesce(stop_reason, ''), ROW(line_no, m.delivery_id)) AS stop, max(event_ts) AS last FROM log_messages m WHERE session_id IS NOT NULL GROUP BY 1),
    o AS (SELECT session_id, list(DISTINCT substr(block_id, 1, 6)) AS tools FROM log_blocks WHERE block_type = 'tool_use' AND block_id IS NOT NULL AND session_id IS NOT NULL GROUP BY 1),
    s AS (SELECT CASE stop WHEN 'end_turn' THEN 'completed' WHEN 'tool_use' THEN 'waiting' ELSE 'working' END AS phase, coalesce(tools, []) AS tools, last + INTERVAL 20 SECOND AS recheck_at FROM t LEFT JOIN o USING (session_id))
    SELECT count(*) FILTER (WHERE w) AS active, coalesce(bool_or(w AND list_contains(tools, 'toolu_')), false) AS optimizing,
      coalesce(bool_or(w AND len(list_filter(tools, lambda x: starts_with(x, 'to') AND x <> 'toolu_')) > 0), false) AS planning, min(recheck_at) FILTER (WHERE w) AS recheck_at FROM (SELECT *, phase IN ('working', 'waiting') AS w FROM s)""")
def activity_summary(spark, d):
    """The beginning of a call's id stands for the name of its tool."""
    m = table(spark, d, "log_messages").where("session_id is not null")
    t = m.groupBy("session_id").agg(F.max_by(F.coalesce("stop_reason", F.lit("")), F.struct("line_no", "delivery_id")).alias("stop"), F.max("event_ts").alias("last"))
    blocks = table(spark, d, "log_blocks").where("block_type = 'tool_use' and block_id is not null and session_id is not null")
    tools = blocks.groupBy("session_id").agg(F.collect_set(F.substring("block_id", 1, 6)).alias("tools"))
    phase = F.when(F.col("stop") == "end_turn", "completed").when(F.col("stop") == "tool_use", "waiting").otherwise("working")
    rows = t.join(tools, "session_id", "left").select(phase.alias("phase"), F.coalesce("tools", F.array().cast("array<string>")).alias("tools"), (F.col("last") + F.expr("interval 20 seconds")).alias("recheck_at"))
    return U.activity_summary(rows, optimizer="toolu_", family="to")


@query("agent_calls", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS calls FROM events GROUP BY event_type")
def agent_calls(spark, d):
    """Purchases stand for tool calls, other events for housekeeping of the connection."""
    method = F.when(F.col("event_type") == "purchase", "tools/call").when(F.col("event_type") == "error", "ping").when(F.col("event_type") != "view", "tools/list")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(U.agent_activity(method)).alias("calls"))


@query("gated_prompts", r"""
    SELECT doc_id FROM documents WHERE length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) >= 6 AND source IS NOT NULL AND (lang = 'en' OR channel = 'docs')""")
def gated_prompts(spark, d):
    """Texts as prompts; a source stands for a project's root, a language and a channel for reasons."""
    reasons = F.array_compact(F.array(F.lit("git:changed"), F.when(F.col("lang") == "en", "symbol:x"), F.when(F.col("channel") == "docs", "path:x")))
    docs = table(spark, d, "documents")
    return docs.where(U.worth_injecting(F.col("text"), F.col("source").isNotNull(), reasons)).select("doc_id")


_measured = """e AS (SELECT 's' || user_id % 5 AS source, 'i' || user_id AS id, CASE WHEN event_type IN ('view', 'signup') THEN 'begin' WHEN event_type = 'error' AND value > 60 THEN 'interrupt' ELSE 'end' END AS kind, floor(epoch(ts))::BIGINT AS tick, event_id AS n FROM events)"""


@query("measured_time", f"""
    WITH {_measured}, p AS (SELECT *, (SELECT count(*) FROM e s WHERE s.kind = 'interrupt' AND s.n < e.n) AS epoch FROM e WHERE kind <> 'interrupt'),
    l AS (SELECT *, lag(kind) OVER w AS before FROM p WINDOW w AS (PARTITION BY source, id, epoch ORDER BY n)),
    k AS (SELECT *, lag(tick) OVER w AS began, lead(kind) OVER w AS later FROM l WHERE coalesce(before, 'end') <> kind WINDOW w AS (PARTITION BY source, id, epoch ORDER BY n)),
    r AS (SELECT source, began AS a, tick AS b FROM k WHERE kind = 'end' AND began <= tick),
    o AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY source ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM r),
    g AS (SELECT source, min(a) AS a, max(b) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM o) GROUP BY source, island),
    t AS (SELECT source, sum(b - a)::BIGINT AS length, count(*) FILTER (WHERE b > a) AS ranges FROM g GROUP BY source)
    SELECT s.source, length, coalesce(ranges, 0) AS ranges, coalesce(ranges, 0) > 512 OR s.source IN (SELECT source FROM k WHERE kind = 'begin' AND later IS NULL AND epoch < (SELECT count(*) FROM e WHERE kind = 'interrupt')) AS partial
    FROM (SELECT DISTINCT source FROM e WHERE kind <> 'interrupt') s LEFT JOIN t USING (source)""")
def measured_time(spark, d):
    """Views and signups begin, other events end; large errors interrupt everything."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("view", "signup"), "begin").when((F.col("event_type") == "error") & (F.col("value") > 60), "interrupt").otherwise("end")
    user = lambda mark, c: F.when(kind != "interrupt", F.concat(F.lit(mark), c.cast("string")))
    rows = e.select(user("s", F.col("user_id") % 5).alias("source"), user("i", F.col("user_id")).alias("id"), kind.alias("kind"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("n"))
    return I.measured_time(rows)
