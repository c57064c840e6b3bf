"""Queries that run a table as a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import Registry, table
from ..session import scratch_path
from ..streaming import streams as S
from .common import FILES
from .text import once

registry = Registry()
query = registry.query


@query("stream_first_deliveries", "SELECT DISTINCT message_id FROM log_messages WHERE message_id IS NOT NULL")
def stream_first_deliveries(spark, d):
    stream = S.table_stream(spark, d, "log_messages", "received_at")
    return S.run_to_end(S.first_deliveries(stream, key="message_id", at="received_at", within="365 days")).select("message_id")


@query("stream_daily_totals", "SELECT event_type, ts::DATE::VARCHAR AS day, sum(round(value * 100)::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_totals(spark, d):
    stream = S.table_stream(spark, d, "events", "ts").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    totals = S.run_to_end(S.daily_totals(stream, at="ts", value="cents", late="2 days", by="event_type"), mode="complete")
    return totals.withColumn("day", F.to_date("day").cast("string"))


@query("stream_turn_states")
def stream_turn_states(spark, d):
    stream = S.table_stream(spark, d, "log_messages", "event_ts").where("session_id is not null and event_ts is not null")
    rows = stream.join(S.turn_blocks(table(spark, d, "log_blocks")), "delivery_id", "left")
    said = S.turn_events(*(F.col(c) for c in ("row_type", "stop_reason", "is_sidechain", "opening", "answers", "calls")))
    events = rows.select(
        "session_id", F.col("event_ts").alias("ts"), (F.unix_micros("event_ts") / 1e6).alias("at"), "line_no", F.posexplode(said).alias("step", "e")
    ).select("session_id", "ts", "at", "line_no", "step", "e.event", "e.tool")
    return S.run_to_end(S.turn_states(events))


_turn_events = r"""b AS (SELECT delivery_id, arg_min(coalesce(block_text, ''), block_no) FILTER (WHERE block_type = 'text') AS opening, bool_or(block_type = 'tool_result') AS answers FROM log_blocks GROUP BY delivery_id),
m AS (SELECT session_id, delivery_id, line_no, event_ts AS tick, lower(trim(row_type, ' ')) AS role, stop_reason, coalesce(opening, '') AS opening, coalesce(answers, false) AS answers
  FROM log_messages LEFT JOIN b USING (delivery_id) WHERE session_id IS NOT NULL AND event_ts IS NOT NULL AND NOT coalesce(is_sidechain, false)),
s AS (SELECT *, role = 'user' AND starts_with(opening, '[Request interrupted by user') AS stopped FROM m WHERE role IN ('user', 'assistant')),
e AS (
  SELECT session_id, tick, line_no, -1 AS step, 'interrupted' AS event, NULL AS tool, delivery_id FROM s WHERE stopped
  UNION ALL SELECT session_id, tick, line_no, -1, 'started', NULL, delivery_id FROM s WHERE NOT stopped AND role = 'user' AND opening <> '' AND NOT answers
  UNION ALL SELECT session_id, tick, line_no, -1, 'activity', NULL, delivery_id FROM s WHERE role = 'assistant'
  UNION ALL SELECT s.session_id, tick, line_no, block_no, CASE block_type WHEN 'tool_use' THEN 'tool_started' ELSE 'tool_finished' END, CASE block_type WHEN 'tool_use' THEN block_id ELSE tool_use_id END, s.delivery_id
    FROM s JOIN log_blocks l ON l.delivery_id = s.delivery_id WHERE NOT stopped AND ((block_type = 'tool_use' AND block_id IS NOT NULL) OR (block_type = 'tool_result' AND tool_use_id IS NOT NULL))
  UNION ALL SELECT session_id, tick, line_no, 1000000, CASE WHEN stop_reason = 'max_tokens' THEN 'interrupted' ELSE 'ended' END, NULL, delivery_id FROM s WHERE NOT stopped AND role = 'assistant' AND stop_reason IN ('end_turn', 'stop_sequence', 'max_tokens'))"""


@query("stream_turn_phases", f"""
    WITH {_turn_events},
    c AS (SELECT *, max(CASE WHEN event IN ('ended', 'interrupted') THEN tick END) OVER (PARTITION BY session_id ORDER BY tick, line_no, step, event, coalesce(tool, '') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed FROM e),
    r AS (SELECT session_id, arg_max(event, ROW(tick, line_no, step, event)) AS last_event, max(tick) FILTER (WHERE event IN ('ended', 'interrupted')) AS ended FROM c
      WHERE event IN ('ended', 'interrupted') OR (event IN ('started', 'tool_started') AND closed IS DISTINCT FROM tick) GROUP BY session_id),
    p AS (SELECT DISTINCT session_id, bool_or(event = 'activity') OVER (PARTITION BY session_id) AS busy FROM e)
    SELECT session_id, CASE last_event WHEN 'ended' THEN 'completed' WHEN 'interrupted' THEN 'interrupted' WHEN 'started' THEN 'working' WHEN 'tool_started' THEN 'working' ELSE CASE WHEN busy THEN 'working' ELSE 'unknown' END END AS turn,
      CASE WHEN last_event IN ('ended', 'interrupted') THEN epoch_us(ended) END AS ended_us FROM p LEFT JOIN r USING (session_id)""")
def stream_turn_phases(spark, d):
    """What phase each session's turn is in after all its events, apart from what silence makes of it."""
    rows = stream_turn_states(spark, d)
    return rows.select("session_id", "turn", F.round(F.col("ended") * 1e6).cast("long").alias("ended_us")).distinct()


@query("line_events", """
    SELECT event, tool IS NOT NULL AS tool, count(*) AS n FROM (
      SELECT CASE WHEN k = 'bad' THEN NULL WHEN k IN ('user') THEN 'started' WHEN k = 'final' THEN 'ended' WHEN k = 'call' THEN 'tool_started' WHEN k = 'output' THEN 'tool_finished' WHEN k = 'aborted' THEN 'interrupted' ELSE 'activity' END AS event,
        CASE WHEN k IN ('call', 'output') THEN 'x' END AS tool FROM (
        SELECT CASE WHEN event_ts IS NULL THEN 'bad' WHEN lower(trim(row_type, ' ')) = 'user' THEN 'user' WHEN stop_reason = 'end_turn' THEN 'final' WHEN stop_reason = 'tool_use' THEN 'call' WHEN stop_reason = 'max_tokens' THEN 'aborted'
          WHEN lower(trim(row_type, ' ')) = 'assistant' THEN 'talk' WHEN lower(trim(row_type, ' ')) = 'system' THEN 'output' ELSE 'thought' END AS k FROM log_messages)) GROUP BY ALL""")
def line_events(spark, d):
    """Every message as a line of the event dialect; one without a time can't be read."""
    m = table(spark, d, "log_messages")
    role = F.lower(F.trim("row_type"))
    line = lambda outer, **inner: F.struct(F.lit(outer).alias("type"), F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.struct(*[F.lit(v).alias(k) for k, v in inner.items()]).alias("payload"))
    value = (
        F.when(role == "user", F.to_json(line("event_msg", type="user_message"))).when(F.col("stop_reason") == "end_turn", F.to_json(line("response_item", type="message", role="assistant", phase="final_answer")))
        .when(F.col("stop_reason") == "tool_use", F.to_json(line("response_item", type="function_call", call_id="c", name="n"))).when(F.col("stop_reason") == "max_tokens", F.to_json(line("event_msg", type="turn_aborted")))
        .when(role == "assistant", F.to_json(line("response_item", type="message", role="assistant"))).when(role == "system", F.to_json(line("response_item", type="function_call_output", call_id="c")))
        .otherwise(F.to_json(line("response_item", type="reasoning")))
    )
    rows = S.line_events(m.select(value.alias("value")))
    return rows.groupBy("event", F.col("tool").isNotNull().alias("tool")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_index_refresh", f"""
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'new' WHEN n.content_hash = o.content_hash THEN 'touched' ELSE 'changed' END AS status
      FROM (SELECT project || '/' || path AS path, content_hash FROM {FILES}) n FULL JOIN (SELECT project || '/' || path AS path, CASE WHEN language = 'go' THEN 'x' ELSE content_hash END AS content_hash FROM {FILES} WHERE language IS DISTINCT FROM 'rust') o USING (path)) GROUP BY status""")
def stream_index_refresh(spark, d):
    """All files as one micro-batch of a scan, against an index without those in Rust and with other contents of those in Go."""
    files = once(table(spark, d, "files")).withColumn("path", F.concat_ws("/", "project", "path")).select("id", "path", "byte_size", "modified_at", "content_hash", "language")
    old = files.where("language is distinct from 'rust'").withColumns({"content_hash": F.when(F.col("language") == "go", "x").otherwise(F.col("content_hash")), "modified_at": F.col("modified_at") - 1})
    scans, out, state = scratch_path(spark), scratch_path(spark), scratch_path(spark)
    files.write.parquet(scans)

    def refresh(batch, number):
        index, counts = S.refreshed_index(batch, old)
        index.write.mode("overwrite").parquet(f"{out}/index-{number}")
        counts.write.mode("overwrite").parquet(f"{out}/counts-{number}")

    S.each_batch(spark.readStream.schema(files.schema).parquet(scans), refresh, state).awaitTermination()
    return spark.read.parquet(f"{out}/counts-0")


@query("stream_activity_ledger")
def stream_activity_ledger(spark, d):
    stream = S.table_stream(spark, d, "events", "ts")
    packets = stream.select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", F.concat(F.lit("s"), F.col("user_id") % 3).alias("source"), (F.col("event_id") + 1).alias("sequence"),
        F.when(F.col("event_type") == "error", "gap").when(F.col("event_type") == "view", "heartbeat").otherwise("activity").alias("kind"),
        (F.col("event_type") != "error").alias("focused"), (F.unix_micros("ts") / 1e6).alias("tick"),
    )
    return S.run_to_end(S.activity_ledger(packets), mode="update")


_coalesced = """
    WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS new FROM events),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g)
    SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, bool_or(event_type = 'error') AS force, max(value) AS level FROM i GROUP BY user_id, island"""


def _requests(rows):
    return rows.select("user_id", "ts", (F.col("event_type") == "error").alias("force"), F.col("value").alias("level"))


@query("coalesced_requests", _coalesced)
def coalesced_requests(spark, d):
    """Events of a user within two hours of each other as one request."""
    rows = S.coalesced(_requests(table(spark, d, "events")), key="user_id", at="ts", gap="2 hours", late="1 hour", flags=["force"], levels=["level"])
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query("stream_coalesced", _coalesced)
def stream_coalesced(spark, d):
    """As ``coalesced_requests``, as a stream; one more event of each user far ahead moves the watermark past all others."""
    path, end = scratch_path(spark), F.lit("2100-01-01").cast("timestamp")
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    _requests(events).write.parquet(f"{path}/requests.parquet")
    _requests(events.limit(1).withColumn("ts", end)).write.mode("append").parquet(f"{path}/requests.parquet")
    stream = spark.readStream.schema("user_id long, ts timestamp, force boolean, level double").parquet(f"{path}/requests.parquet")
    rows = S.run_to_end(S.coalesced(stream, key="user_id", at="ts", gap="2 hours", late="1 hour", flags=["force"], levels=["level"]))
    return rows.where(F.col("first") < end).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})
