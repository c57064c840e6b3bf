"""Queries on log records, calendars, listings and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..registry import Registry, table
from ..sources import readers as R
from ..sources import stores as S
from .common import FILES
from .text import once

registry = Registry()
query = registry.query


def _lines(spark, d, *more):
    m = table(spark, d, "log_messages")
    counters = F.when(
        F.coalesce("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens").isNotNull(),
        F.struct("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"),
    )
    message = F.struct(F.col("message_id").alias("id"), "model", "stop_reason", counters.alias("usage"))
    line = F.to_json(F.struct(
        F.lower(F.trim("row_type")).alias("type"), F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "cwd",
        F.col("session_id").alias("sessionId"), F.col("is_sidechain").alias("isSidechain"), message.alias("message"),
    ))
    return m.select(F.col("log_path").alias("path"), line.alias("value"), *more)


@query("log_message_usage", """
    SELECT path, count(*) AS lines, count(tokens) AS counted, sum(tokens)::BIGINT AS tokens, count(*) FILTER (WHERE aside) AS asides, max(event_ts) AS last_at FROM (
      SELECT log_path AS path, event_ts, coalesce(is_sidechain, false) AS aside, CASE WHEN coalesce(input_tokens, output_tokens, cache_read_input_tokens, cache_creation_input_tokens) IS NOT NULL
        THEN coalesce(input_tokens, 0) + coalesce(output_tokens, 0) + coalesce(cache_read_input_tokens, 0) + coalesce(cache_creation_input_tokens, 0) END AS tokens FROM log_messages) GROUP BY path""")
def log_message_usage(spark, d):
    """Every message written as a log line and read back by the metadata-only schema."""
    usage = R.message_usage(_lines(spark, d))
    return usage.groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"), F.count("tokens").alias("counted"), F.sum("tokens").alias("tokens"), F.count_if("aside").alias("asides"),
        F.timestamp_micros(F.round(F.max("at") * 1e6).cast("long")).cast("timestamp_ntz").alias("last_at"),
    )


@query("needle_lines", "SELECT count(*) FILTER (WHERE model IS NOT NULL OR coalesce(input_tokens, output_tokens, cache_read_input_tokens, cache_creation_input_tokens) IS NOT NULL) AS n FROM log_messages")
def needle_lines(spark, d):
    lines = _lines(spark, d)
    kept, _ = R.bounded_lines(lines.where(F.col("value").contains('"usage"') | F.col("value").contains('"model"')))
    return kept.agg(F.count(F.lit(1)).alias("n"))


@query("packets", "SELECT source, count(*) AS n, max(sequence) AS last, sum(edits)::BIGINT AS edits FROM (SELECT 'n' || user_id AS source, event_id + 1 AS sequence, floor(value)::BIGINT AS edits FROM events WHERE event_type IN ('click', 'view')) GROUP BY source")
def packets(spark, d):
    """Clicks and views as valid packets; errors with a missing key and purchases with an unknown one are refused."""
    e = table(spark, d, "events")
    body = lambda kind, *more: F.to_json(F.struct(
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("nonce"), (F.col("event_id") + 1).alias("sequence"), F.lit(kind).alias("kind"),
        F.lit(True).alias("focused"), F.floor("value").alias("count"), *more))
    value = F.when(F.col("event_type").isin("click", "view"), body("edit", F.lit(True).alias("activity"))).when(F.col("event_type") == "error", body("edit")).otherwise(body("edit", F.lit(True).alias("activity"), F.lit(1).alias("extra")))
    rows = R.packets(e.select(value.alias("value")))
    return rows.groupBy(F.col("nonce").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.max("sequence").alias("last"), F.sum("count").alias("edits"))


@query("newest_logs", """
    SELECT project, path FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY last DESC NULLS LAST, path) AS place FROM (
      SELECT split_part(log_path, '/', 1) AS project, log_path AS path, max(epoch(received_at)) AS last FROM log_messages GROUP BY ALL)) WHERE place <= 8""")
def newest_logs(spark, d):
    m = table(spark, d, "log_messages")
    listing = m.groupBy(F.split_part("log_path", F.lit("/"), F.lit(1)).alias("project"), F.col("log_path").alias("path")).agg(F.max("received_at").alias("last"))
    return R.newest_logs(listing, provider="project", modified="last", most=8).select("project", "path")


@query("fresh_logs", "SELECT log_path AS path FROM log_messages GROUP BY 1 HAVING floor(epoch(max(received_at))) >= 1781913600 - 7 * 86400")
def fresh_logs(spark, d):
    m = table(spark, d, "log_messages").groupBy(F.col("log_path").alias("path")).agg(F.unix_seconds(F.max("received_at").cast("timestamp")).alias("last"))
    return R.fresh_logs(m, modified="last", now=F.lit(1781913600)).select("path")


@query("shallowest_names", f"""
    SELECT project, arg_min(path, ROW(rank, deep, path)) AS path FROM (
      SELECT project, path, len(string_split(path, '/')) - 1 AS deep, CASE lower(regexp_extract(path, '([^/]*)$', 1)) WHEN 'app.bundle.js' THEN 0 WHEN 'index_view.py' THEN 1 WHEN 'render_helper.py' THEN 2 END AS rank FROM {FILES})
    WHERE rank IS NOT NULL AND deep <= 3 GROUP BY project""")
def shallowest_names(spark, d):
    files = once(table(spark, d, "files")).select("project", "path")
    return R.nearest_image(files, ["app.bundle.js", "index_view.py", "render_helper.py"])


@query("rule_files", f"""
    SELECT project, string_agg('===== ' || language || ' =====' || chr(10) || n || ' files', chr(10) || chr(10) ORDER BY list_position(['rust', 'go', 'ruby', 'c'], language)) AS text
    FROM (SELECT project, language, count(*) AS n FROM {FILES} WHERE language IN ('rust', 'go', 'ruby') GROUP BY ALL) GROUP BY project""")
def rule_files(spark, d):
    """The language of a file stands for the rule file's name; those of C are blank."""
    files = once(table(spark, d, "files")).groupBy("project", F.col("language").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    text = F.when(F.col("path") == "c", " \n ").otherwise(F.concat(F.lit("\n "), F.col("n").cast("string"), F.lit(" files \n")))
    return R.rule_files(files.select("project", "path", text.alias("text")), ["rust", "go", "ruby", "c"])


@query("iso_epochs", "SELECT delivery_id, floor(epoch(event_ts))::BIGINT AS seconds, floor(epoch(event_ts))::BIGINT - 19800 AS offset_seconds FROM log_messages WHERE event_ts IS NOT NULL")
def iso_epochs(spark, d):
    m = table(spark, d, "log_messages").where("event_ts is not null")
    text = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    seconds = lambda c: F.floor(R.epoch_of(c)).cast("long")
    return m.select("delivery_id", seconds(text).alias("seconds"), seconds(F.concat(text, F.lit("+0530"))).alias("offset_seconds"))


@query("local_days", "SELECT day, count(*) AS n FROM (SELECT strftime((event_ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d') AS day FROM log_messages WHERE event_ts IS NOT NULL) GROUP BY day")
def local_days(spark, d):
    m = table(spark, d, "log_messages").where("event_ts is not null")
    return m.groupBy(D.local_day(F.col("event_ts"), "America/New_York").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("month_grid", """
    WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS first FROM orders),
    g AS (SELECT first, dayofweek(first) AS lead, unnest(range(0, (ceil((dayofweek(first) + day(last_day(first))) / 7.0) * 7)::BIGINT)) AS cell FROM m)
    SELECT first::VARCHAR AS month, (cell // 7)::INTEGER AS week, (cell % 7)::INTEGER AS weekday,
      CASE WHEN date_trunc('month', first + (cell - lead)::INTEGER) = first THEN (first + (cell - lead)::INTEGER)::DATE::VARCHAR END AS day FROM g""")
def month_grid(spark, d):
    months = table(spark, d, "orders").select(F.trunc(F.to_date("o_orderdate"), "month").cast("string").alias("month")).distinct()
    return D.month_grid(months).withColumn("day", F.col("day").cast("string"))


@query("covering_periods", """
    SELECT period, count(*) AS n FROM (SELECT CASE WHEN age < 7 THEN 7 WHEN age < 30 THEN 30 WHEN age < 90 THEN 90 END AS period
      FROM (SELECT date_diff('day', event_ts::DATE, DATE '2026-06-01') AS age FROM log_messages)) GROUP BY period""")
def covering_periods(spark, d):
    period = D.covering_period(F.to_date("event_ts"), F.lit("2026-06-01").cast("date"))
    return table(spark, d, "log_messages").groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("day_lengths", """
    SELECT day::DATE::VARCHAR AS day, (epoch(((day + INTERVAL 1 DAY)::TIMESTAMP) AT TIME ZONE 'America/New_York') - epoch((day::TIMESTAMP) AT TIME ZONE 'America/New_York'))::BIGINT AS seconds
    FROM (SELECT DISTINCT event_ts::DATE AS day FROM log_messages WHERE event_ts IS NOT NULL)""")
def day_lengths(spark, d):
    days = table(spark, d, "log_messages").where("event_ts is not null").select(F.to_date("event_ts").alias("day")).distinct()
    return days.select(F.col("day").cast("string").alias("day"), D.day_seconds(F.col("day"), "America/New_York").alias("seconds"))


@query("day_comparisons", """
    WITH t AS (SELECT event_ts::DATE AS day, sum(output_tokens)::BIGINT AS n FROM log_messages WHERE event_ts IS NOT NULL GROUP BY 1),
    l AS (SELECT day, n, lag(n) OVER (ORDER BY day) AS b FROM t)
    SELECT day::VARCHAR AS day, CASE WHEN n IS NULL OR b IS NULL THEN '전일 비교 기록 없음' WHEN b <= 0 AND n = 0 THEN '전일과 동일' WHEN b <= 0 THEN '전일 0 · 오늘 기록 있음'
      WHEN p > 999 THEN '전일 전체 대비 +999% 초과' ELSE '전일 전체 대비 ' || printf('%+d', round_even(p, 0)::BIGINT) || '%' END AS change FROM (SELECT *, (n::DOUBLE / nullif(b, 0) - 1) * 100 AS p FROM l)""")
def day_comparisons(spark, d):
    from pyspark.sql import Window

    t = table(spark, d, "log_messages").where("event_ts is not null").groupBy(F.to_date("event_ts").alias("day")).agg(F.sum("output_tokens").alias("n"))
    before = F.lag("n").over(Window.orderBy("day"))  # one row a day
    return t.withColumn("b", before).select(F.col("day").cast("string").alias("day"), T.day_comparison(F.col("n"), F.col("b")).alias("change"))


@query("duration_texts", """
    SELECT session_id, CASE WHEN s IS NULL THEN '—' WHEN s >= 360000 THEN '≥100h' ELSE lpad((s // 3600)::VARCHAR, 2, '0') || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS lasted
    FROM ((SELECT session_id, floor(epoch(max(event_ts)))::BIGINT - floor(epoch(min(event_ts)))::BIGINT AS s FROM log_messages WHERE session_id IS NOT NULL GROUP BY session_id))""")
def duration_texts(spark, d):
    at = F.unix_seconds(F.col("event_ts").cast("timestamp"))
    s = table(spark, d, "log_messages").where("session_id is not null").groupBy("session_id").agg((F.max(at) - F.min(at)).alias("s"))
    return s.select("session_id", D.duration_text(F.col("s")).alias("lasted"))


@query("stale_snapshots", """
    SELECT stale, count(*) AS n FROM (
      SELECT g IS NULL OR 1777593600 - g > 8640000 OR g - 1777593600 > 86400 OR strftime(to_timestamp(g) AT TIME ZONE 'UTC', '%Y-%m-%d') <> '2026-05-01' AS stale
      FROM (SELECT floor(epoch(last_event_at))::BIGINT AS g FROM session_status)) GROUP BY stale""")
def stale_snapshots(spark, d):
    g = F.unix_seconds(F.col("last_event_at").cast("timestamp"))
    flag = D.stale(g, F.lit(1777593600).cast("long"), "UTC", after=8_640_000, ahead=86_400)
    return table(spark, d, "session_status").groupBy(flag.alias("stale")).agg(F.count(F.lit(1)).alias("n"))


@query("stale_widgets", """
    SELECT stale, count(*) AS n FROM (SELECT g IS NULL OR 1777593600 - g > 90 * 86400 OR g - 1777593600 > 90 * 86400 OR strftime(to_timestamp(g) AT TIME ZONE 'Asia/Seoul', '%Y-%m-%d') <> strftime(to_timestamp(1777593600) AT TIME ZONE 'Asia/Seoul', '%Y-%m-%d') AS stale
      FROM (SELECT floor(epoch(last_event_at))::BIGINT AS g FROM session_status)) GROUP BY stale""")
def stale_widgets(spark, d):
    """The display's shorter rule (90 units back and ahead, here days), in another zone."""
    g = F.unix_seconds(F.col("last_event_at").cast("timestamp"))
    flag = D.stale(g, F.lit(1777593600).cast("long"), "Asia/Seoul", after=90 * 86_400, ahead=90 * 86_400)
    return table(spark, d, "session_status").groupBy(flag.alias("stale")).agg(F.count(F.lit(1)).alias("n"))


@query("civil_days", "SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INTEGER AS day FROM orders")
def civil_days(spark, d):
    return table(spark, d, "orders").select("o_orderkey", D.civil_day_number(F.col("o_orderdate")).alias("day"))


@query("upserted_sessions", """
    WITH s AS (SELECT session_id, max(phase) AS phase FROM session_status GROUP BY session_id), m AS (SELECT session_id, 'seen' AS phase FROM log_messages WHERE session_id IS NOT NULL GROUP BY session_id)
    SELECT coalesce(m.phase, s.phase) AS phase, count(*) AS n FROM s FULL JOIN m USING (session_id) GROUP BY 1""")
def upserted_sessions(spark, d):
    old = table(spark, d, "session_status").groupBy("session_id").agg(F.max("phase").alias("phase"))
    new = table(spark, d, "log_messages").where("session_id is not null").select("session_id", F.lit("seen").alias("phase")).distinct()
    return S.upserted(old, new, key=["session_id"]).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


@query("pruned_sessions", "SELECT DISTINCT session_id FROM session_status WHERE session_id IN (SELECT session_id FROM log_messages)")
def pruned_sessions(spark, d):
    rows = table(spark, d, "session_status").select("session_id").distinct()
    return S.pruned(rows, table(spark, d, "log_messages"), key="session_id")


@query("collection_health", "SELECT CASE WHEN bool_or(phase = 'partial') THEN '집계 범위 제한' WHEN bool_or(phase = 'ready') THEN '로컬 기록 집계' ELSE '기록 없음' END AS health FROM (SELECT CASE phase WHEN 'unknown' THEN 'partial' ELSE 'ready' END AS phase FROM session_status)")
def collection_health(spark, d):
    from ..operators.usage import collection_health as health

    return health(table(spark, d, "session_status").select(F.when(F.col("phase") == "unknown", "partial").otherwise("ready").alias("state")), state="state")
