"""Token usage from session logs: counters, latest values, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_remote, saturating_sum
from . import scan


def counter_deltas(rows: DataFrame, *, key: Sequence[str], order: Sequence[str], value: str, hot_rows: int = scan.HOT_ROWS) -> DataFrame:
    """``rows`` with ``delta``: growth of a cumulative counter; a fall means a restart, whose value is the growth.

    The first reading counts in full.  Readings without a value are left out, and growth of 0 or less gives no row.
    """
    known = rows.where(F.col(value).isNotNull())

    def small(df: DataFrame) -> DataFrame:
        return df.withColumn("__before", F.lag(value).over(Window.partitionBy(*key).orderBy(*order)))

    def large(df: DataFrame) -> DataFrame:
        parts = scan.parted(df, key, order)
        last = F.struct(scan.ROW, F.col(value).alias("v"))
        parts = scan.carried(parts, key, {"__carry": last}, pick=F.max, fold=F.max)
        inside = F.lag(value).over(Window.partitionBy(*key, scan.PART).orderBy(scan.ROW))
        return parts.withColumn("__before", F.coalesce(inside, F.col("__carry.v"))).drop("__carry", scan.PART, scan.ROW)

    seen = scan.by_size(known, key, small, large, hot_rows)
    before = F.col("__before")
    delta = F.when(before.isNull() | (F.col(value) < before), F.col(value)).otherwise(F.col(value) - before)
    return seen.withColumn("delta", delta).drop("__before").where("delta > 0")


def canonical_counters(rows: DataFrame, *, key: Sequence[str], at: str, sequence: str, value: str) -> DataFrame:
    """(key, at, sequence, delta, conflicting): as ``counter_deltas`` over logs that were copied.

    Identical readings collapse; where copies disagree on one (at, sequence), the greatest value counts and
    ``conflicting`` is set.
    """
    points = rows.groupBy(*key, at, sequence).agg(F.max(value).alias(value), (F.min(value) != F.max(value)).alias("conflicting"))
    return counter_deltas(points, key=key, order=[at, sequence], value=value).drop(value)


def carried_forward(rows: DataFrame, *, key: Sequence[str], order: Sequence[str], columns: Sequence[str], hot_rows: int = scan.HOT_ROWS) -> DataFrame:
    """``rows`` with each of ``columns`` filled from the latest earlier row of the key that has it."""

    def small(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})

    def large(df: DataFrame) -> DataFrame:
        parts = scan.parted(df, key, order)
        known = {f"__{c}_carry": F.when(F.col(c).isNotNull(), F.struct(scan.ROW, F.col(c).alias("v"))) for c in columns}
        parts = scan.carried(parts, key, known, pick=F.max, fold=F.max)
        w = Window.partitionBy(*key, scan.PART).orderBy(scan.ROW).rowsBetween(Window.unboundedPreceding, 0)
        filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"__{c}_carry.v")) for c in columns}
        return parts.withColumns(filled).drop(*known, scan.PART, scan.ROW)

    return scan.by_size(rows, key, small, large, hot_rows)


def message_totals(rows: DataFrame, *, key: str, counters: Sequence[str], at: str, tie: str, labels: Sequence[str] = ()) -> DataFrame:
    """(key, tokens, first_at, labels): a streamed message counts once, with its greatest total and its first time.

    The labels come from the row with the greatest total, the earliest of equal ones.  A row with no counter at all is
    no accounting and is left out; a missing counter of another row adds nothing.
    """
    parts = [F.greatest(F.col(c), F.lit(0)) for c in counters]
    known = F.coalesce(*[F.col(c) for c in counters]).isNotNull()
    counted = rows.where(F.col(key).isNotNull() & known).withColumn("tokens", sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0))))
    best = F.struct(-F.col("tokens"), F.col(at).isNull(), at, tie)
    return counted.groupBy(key).agg(
        F.max("tokens").alias("tokens"), F.min(at).alias("first_at"), *[F.min_by(c, best).alias(c) for c in labels]
    )


def latest_rows(rows: DataFrame, *, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key by ``order`` (descending columns), every column kept."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def usage_rollup(rows: DataFrame, *, tokens: str, dimensions: Sequence[Sequence[str]]) -> DataFrame:
    """Totals of several groupings in one pass: the grouping columns (null where a grouping lacks one), level, total, rows."""
    names = sorted({c for group in dimensions for c in group})
    return rows.groupingSets([[F.col(c) for c in g] for g in dimensions], *names).agg(
        F.grouping_id().cast("long").alias("level"), saturating_sum(F.col(tokens)).alias("tokens"), F.count(F.lit(1)).alias("n")
    )


def top_with_rest(totals: DataFrame, *, name: str, value: str, k: int) -> DataFrame:
    """(name, value, hidden_count, hidden_value, total): the k largest, and what the others add up to.

    One pass: the k largest of each partition go on with its sums, so only those meet.
    """
    place = Window.partitionBy("__part").orderBy(F.desc(value), name)
    local = totals.select(name, value, F.spark_partition_id().alias("__part")).withColumn("__place", F.row_number().over(place))
    best = F.array_sort(F.collect_list(F.when(F.col("__place") <= k, F.struct((-F.col(value)).alias("less"), F.col(name).alias("name"), F.col(value).alias("value")))))
    one = local.agg(F.slice(best, 1, k).alias("top"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    shown = F.aggregate("top", F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x["value"], F.lit(0)).cast("long"))
    rows = one.select(F.explode("top").alias("t"), (F.col("n") - F.size("top")).alias("hidden_count"), (F.col("total") - shown).alias("hidden_value"), "total")
    return rows.select(F.col("t.name").alias(name), F.col("t.value").alias(value), "hidden_count", "hidden_value", "total")


def ordered_models(totals: DataFrame) -> DataFrame:
    """``totals`` (provider, model, tokens; a row a model) with ``place``: most tokens first, then provider, then name."""
    return totals.withColumn("place", F.row_number().over(Window.orderBy(F.desc("tokens"), "provider", "model")))


def merged_sessions(metrics: DataFrame, sessions: DataFrame) -> DataFrame:
    """(agent, session, tokens, metrics, last_event, path, partial): one row for all copies of a session's log.

    ``metrics`` has (agent, path, session, key, tokens, cumulative, sequence), ``sessions`` (agent, path, session, last_event,
    partial).  Of copies of one metric the one with most tokens counts, of a cumulative one that with the higher sequence;
    what else a session has comes from the copy with the latest event, and it is partial if any copy is.
    """
    worth = F.when(F.col("cumulative").isNotNull(), F.col("sequence")).otherwise(F.col("tokens"))
    one = metrics.where("session <> ''").groupBy("agent", "session", "key").agg(F.max_by("tokens", F.struct(worth, "tokens")).alias("tokens"))
    sums = one.groupBy("agent", "session").agg(saturating_sum(F.col("tokens")).alias("tokens"), F.count(F.lit(1)).alias("metrics"))
    copies = sessions.where("session <> ''").groupBy("agent", "session").agg(
        F.max("last_event").alias("last_event"), F.max_by("path", F.struct("last_event", "path")).alias("path"), F.bool_or("partial").alias("partial")
    )
    return copies.join(sums, ["agent", "session"], "left").select("agent", "session", "tokens", F.coalesce("metrics", F.lit(0)).alias("metrics"), "last_event", "path", "partial")


def sessions_by_model(sessions: DataFrame) -> DataFrame:
    """(provider, model, sessions, working, waiting, place): the latest row of each session id, grouped by model.

    Groups are in order of working sessions, then waiting ones, then size, then name.  ``sessions`` has (provider, session,
    model, phase, at).
    """
    best = sessions.groupBy("provider", "session").agg(F.max_by(F.struct("model", "phase"), F.struct("at", "model", "phase")).alias("s"))
    groups = best.groupBy("provider", F.col("s.model").alias("model")).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("s.phase") == "working").alias("working"), F.count_if(F.col("s.phase") == "waiting").alias("waiting")
    )
    order = Window.partitionBy("provider").orderBy(F.desc("working"), F.desc("waiting"), F.desc("sessions"), "model")
    return groups.withColumn("place", F.row_number().over(order))


def project_cards(rows: DataFrame, *, most: int = 8) -> DataFrame:
    """(project, total, agents): the projects with most tokens, each with (agent, tokens), the largest first.

    ``rows`` has (project, agent, tokens); ties go by name.
    """
    by_agent = rows.groupBy("project", "agent").agg(saturating_sum(F.col("tokens")).alias("tokens"))
    top = by_agent.groupBy("project").agg(saturating_sum(F.col("tokens")).alias("total")).orderBy(F.desc("total"), "project").limit(most)
    sorted_agents = F.array_sort(F.collect_list(F.struct((-F.col("tokens")).alias("less"), "agent", "tokens")))
    agents = by_agent.join(top, "project").groupBy("project", "total").agg(sorted_agents.alias("a"))
    return agents.select("project", "total", F.transform("a", lambda x: F.struct(x["agent"].alias("agent"), x["tokens"].alias("tokens"))).alias("agents"))


def project_identity(rows: DataFrame, remotes: DataFrame, *, project: str, url: str) -> DataFrame:
    """``rows`` with ``identity``: the canonical remote of their project where ``remotes`` (project, url) has one, else the project."""
    known = remotes.where(F.col(url).isNotNull()).groupBy(project).agg(F.min(normalized_remote(F.col(url))).alias("__remote"))
    return rows.join(known, project, "left").withColumn("identity", F.coalesce("__remote", project)).drop("__remote")


def month_totals(daily: DataFrame, grid: DataFrame, *, value: str) -> DataFrame:
    """(month, total): what the days of each month's grid add up to; a month without any has 0.  ``grid`` has (month, day)."""
    inside = grid.where("day is not null").select("month", F.to_date("day").alias("day")).distinct()
    return inside.join(daily.select("day", value), "day", "left").groupBy("month").agg(F.coalesce(saturating_sum(F.col(value)), F.lit(0)).alias("total"))


def period_totals(rows: DataFrame, *, today: str, groups: Sequence[Sequence[str]], days: int = 7) -> DataFrame:
    """(group columns, level, today, week, total) of several groupings in one pass; ``rows`` has them, day and tokens."""
    now, tokens = F.lit(today).cast("date"), F.col("tokens")
    names = sorted({c for group in groups for c in group}, reverse=True)
    within = lambda test: F.coalesce(saturating_sum(F.when(test, tokens)), F.lit(0))
    return rows.groupingSets([[F.col(c) for c in g] for g in groups], *names).agg(
        F.grouping_id().cast("long").alias("level"), within(F.col("day") == now).alias("today"),
        within((F.col("day") > F.date_sub(now, days)) & (F.col("day") <= now)).alias("week"), saturating_sum(tokens).alias("total"),
    )


def trend(daily: DataFrame, *, last: str, value: str, days: int = 14, week: int = 7) -> DataFrame:
    """(day, value, week_total, most) of the last ``days`` days: days without a row have 0, ``week_total`` adds up the last
    ``week`` of them and ``most`` is the largest."""
    end = F.lit(last).cast("date")
    calendar = daily.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    filled = calendar.join(daily.select("day", value), "day", "left").withColumn(value, F.coalesce(value, F.lit(0)))
    over = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row a day
    recent = F.when(F.col("day") > F.date_sub(end, week), F.col(value))
    return filled.select("day", value, F.coalesce(F.sum(recent).over(over), F.lit(0)).alias("week_total"), F.max(value).over(over).alias("most"))


def ledger_summary(ledger: DataFrame, *, most: int = 10) -> DataFrame:
    """(queries, saved, mean_full, mean_selected, projects): totals, means cut to whole numbers, and the projects with most
    queries as (project, n), ties by name."""
    top = ledger.groupBy("project").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "project").limit(most)
    named = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "project", "n"))), lambda x: F.struct(x["project"].alias("project"), x["n"].alias("n"))).alias("projects"))
    saved = F.greatest(F.col("full") - F.col("selected"), F.lit(0))
    return ledger.agg(
        F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum(saved), F.lit(0)).alias("saved"),
        F.coalesce(F.avg("full"), F.lit(0)).cast("long").alias("mean_full"), F.coalesce(F.avg("selected"), F.lit(0)).cast("long").alias("mean_selected"),
    ).join(named)  # one row each


def activity_summary(sessions: DataFrame, *, optimizer: str, family: str) -> DataFrame:
    """(active, optimizing, planning, recheck_at): sessions at work, and whether any has the optimizer or another tool of its
    family open.  ``sessions`` has (phase, tools, recheck_at), tools being the names of open calls."""
    working = F.col("phase").isin("working", "waiting")
    uses = lambda test: F.coalesce(F.bool_or(working & F.exists("tools", test)), F.lit(False))
    return sessions.agg(
        F.count_if(working).alias("active"), uses(lambda t: t == optimizer).alias("optimizing"),
        uses(lambda t: t.startswith(family) & (t != optimizer)).alias("planning"), F.min(F.when(working, F.col("recheck_at"))).alias("recheck_at"),
    )


def agent_activity(method: Column) -> Column:
    """Whether a request means that an agent is at work: only a tool call does."""
    return F.coalesce(method == "tools/call", F.lit(False))


def worth_injecting(prompt: Column, at_project_root: Column, reasons: Column, *, least: int = 6) -> Column:
    """Whether context should go with a prompt: long enough, from a project's root, and for a reason other than recent changes
    alone (``reasons`` is an array; those that begin with 'git:' don't count)."""
    long_enough = F.char_length(F.regexp_replace(prompt, r"^\s+|\s+$", "")) >= least
    return F.coalesce(long_enough & at_project_root & F.exists(reasons, lambda r: ~r.startswith("git:")), F.lit(False))


def savings_totals(ledger: DataFrame, since: Column) -> DataFrame:
    """(queries, saved, saved_today): savings never count below zero; an empty ledger gives zeros."""
    saved = F.greatest(F.col("full") - F.col("selected"), F.lit(0))
    return ledger.agg(
        F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum(saved), F.lit(0)).alias("saved"),
        F.coalesce(F.sum(F.when(F.col("ts") >= since, saved)), F.lit(0)).alias("saved_today"),
    )


def savings_by_day(ledger: DataFrame, zone: str = "UTC") -> DataFrame:
    saved = F.greatest(F.col("full") - F.col("selected"), F.lit(0))
    return ledger.groupBy(F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)).alias("day")).agg(F.sum(saved).alias("saved"))


def day_filled(daily: DataFrame, *, first: str, last: str, value: str) -> DataFrame:
    """(day, value) for every day of the range; a day without a row keeps a null, which is not zero."""
    days = daily.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.join(daily.select("day", value), "day", "left")


def quartile_levels(rows: DataFrame, *, group: Sequence[str], value: str, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(group, q1..qk): the values at index floor((n - 1) * share) of each group's positive values in order.

    Found from counts of equal values with running totals, so a group's rows are never gathered.
    """
    counts = rows.where(F.col(value) > 0).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group)
    placed = counts.withColumns({"upto": F.sum("n").over(w.orderBy(value)), "all": F.sum("n").over(w)})
    return placed.groupBy(*group).agg(*[
        F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * share), F.col(value))).alias(f"q{i}") for i, share in enumerate(shares, 1)
    ])


def heat_level(value: Column, thresholds: Sequence[Column]) -> Column:
    """How many of the thresholds a value exceeds; unknown values have none."""
    return sum((F.coalesce((value > t).cast("int"), F.lit(0)) for t in thresholds[1:]), F.coalesce((value > thresholds[0]).cast("int"), F.lit(0)))


def share_of_total(rows: DataFrame, *, value: str) -> DataFrame:
    """``rows`` with ``share``: percent of the total, rounded."""
    total = rows.agg(F.sum(value)).scalar()
    return rows.withColumn("share", F.round(F.col(value) * 100.0 / total).cast("long"))


def session_phase(last: Column, now: Column, *, quiet: int = 20, stale: int = 3600) -> Column:
    """working, waiting from ``quiet`` seconds on, unknown from ``stale`` on or without any event."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))
    return F.when(last.isNull() | (age >= stale * 1_000_000), "unknown").when(age >= quiet * 1_000_000, "waiting").otherwise("working")


def activity_verdict(now: Column, activity: Column, stop: Column, written: Column, pending: Column, *, window: int = 20, cap: int = 900) -> Column:
    """Struct (working, recheck_at, needs_check) of a turn from its latest signals, all in epoch seconds.

    A stop after the last activity ends it.  Recent activity or a recent write holds it for ``window`` seconds; an
    unanswered call holds it for ``cap`` seconds from the last write, and asks for a check where that is not known.
    """
    stopped = stop > activity
    by_activity = F.when((now - activity <= window), activity + window)
    quiet = now - written
    by_write = F.when(quiet <= window, written + window).when((quiet <= cap) & pending, written + cap)
    recheck = F.least(by_activity, by_write)
    return F.struct(
        (F.coalesce(~stopped, F.lit(True)) & recheck.isNotNull()).alias("working"),
        F.when(F.coalesce(~stopped, F.lit(True)), recheck).alias("recheck_at"),
        F.coalesce(~stopped & (quiet > window) & (quiet <= cap) & pending.isNull(), F.lit(False)).alias("needs_check"),
    )


def sequence_summary(packets: DataFrame, *, key: str, sequence: str, nonce: str) -> DataFrame:
    """(key, packets, gaps, partial): numbered packets that came again count once; a number without the one before it, apart
    from the first, is a gap; gaps and a change of ``nonce`` make the source partial.

    The one before is found by an equality join on the number, so the packets of a source need no order.
    """
    rows = packets.where(F.col(key).isNotNull() & (F.col(sequence) > 0)).select(key, nonce, sequence).distinct()
    after = rows.select(key, F.col(nonce).alias("__nonce"), (F.col(sequence) + 1).alias(sequence), F.lit(1).alias("__follows"))
    same = rows.withColumn("__nonce", F.col(nonce)).withColumn("__n", F.coalesce("__nonce", F.lit(""))).join(
        after.withColumn("__n", F.coalesce("__nonce", F.lit(""))).drop("__nonce"), [key, "__n", sequence], "left"
    )
    runs = same.groupBy(key, "__n").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count("__follows") - 1).alias("gaps"))
    return runs.groupBy(key).agg(
        F.sum("n").alias("packets"), F.sum("gaps").alias("gaps"), ((F.sum("gaps") > 0) | (F.count(F.lit(1)) > 1)).alias("partial")
    )


def pending_calls(events: DataFrame, *, key: Sequence[str], order: Sequence[str], opens: Column) -> DataFrame:
    """Keys whose last event opens a call: nothing has answered it since."""
    last = events.groupBy(*key).agg(F.max_by(opens, F.struct(*order)).alias("open"))
    return last.where("open").select(*key)


def collection_health(states: DataFrame, *, state: str) -> DataFrame:
    """(health): one label for all providers, the worst first; unsupported ones don't count."""
    supported = states.where(F.col(state) != "unsupported")
    any_of = lambda *values: F.coalesce(F.bool_or(F.col(state).isin(*values)), F.lit(False))
    return supported.agg(
        F.when(F.count(F.lit(1)) == 0, "앱 연결 필요").when(any_of("unavailable", "failed"), "일부 수집 불가").when(any_of("partial"), "집계 범위 제한")
        .when(any_of("ready"), "로컬 기록 집계").otherwise("기록 없음").alias("health")
    )
