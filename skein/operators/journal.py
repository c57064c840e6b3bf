"""Commit records, numstat, attribution to sessions and daily roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import noise_path, rename_target
from .intervals import covered_points

FIELD, RECORD = "\u001f", "\u001e"
# Names that a co-author line may hold, and the agent each stands for.
TRAILERS = {"claude": "Claude Code", "codex": "Codex", "openai": "Codex", "cursor": "Cursor", "gemini": "Gemini", "copilot": "Copilot"}


def commit_records(chunks: DataFrame, *, text: str = "chunk") -> DataFrame:
    """(hash, at, author, subject, body, stat) from unit-separated records; records of fewer than five fields are dropped."""
    parts = F.split(F.col(text), FIELD)
    return chunks.where(F.size(parts) >= 5).select(
        F.substring(F.trim(parts[0]), 1, 7).alias("hash"), parts[1].try_cast("double").alias("at"), parts[2].alias("author"),
        parts[3].alias("subject"), parts[4].alias("body"), F.coalesce(F.try_element_at(parts, F.lit(6)), F.lit("")).alias("stat"),
    )


def numstat(commits: DataFrame, *, key: str = "hash", stat: str = "stat") -> DataFrame:
    """(key, added, deleted, files): lines of 'added, deleted, path'; binary files and noise paths don't count."""
    lines = commits.select(key, F.explode(F.split(stat, "\n")).alias("line"))
    cells = F.split("line", "\t", 3)
    rows = lines.where(F.size(cells) == 3).select(key, cells[0].try_cast("long").alias("added"), cells[1].try_cast("long").alias("deleted"), rename_target(cells[2]).alias("path"))
    counted = rows.where(F.col("added").isNotNull() & F.col("deleted").isNotNull() & ~noise_path(F.col("path")))
    return counted.groupBy(key).agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count(F.lit(1)).alias("files"))


def trailer_agents(body: Column) -> Column:
    """Agents that a co-author line of the body names, sorted."""
    lines = F.filter(F.split(F.lower(body), "\n"), lambda line: line.contains("co-authored-by:"))
    found = [F.when(F.exists(lines, _holding(word)), F.lit(agent)) for word, agent in TRAILERS.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def _holding(word: str):
    return lambda line: line.contains(word)


def attributed(commits: DataFrame, sessions: DataFrame, *, width: float = 86_400.0) -> DataFrame:
    """``commits`` (hash, project, at, body) with ``agents``: named in a trailer, or in a session of the project at that time."""
    live = covered_points(commits.select("hash", "project", "at"), sessions.select("project", "agent", "start", "end"), key="project", at="at", start="start", end="end", width=width)
    by_session = live.groupBy("hash").agg(F.collect_set("agent").alias("live"))
    joined = commits.join(by_session, "hash", "left")
    return joined.withColumn("agents", F.array_sort(F.array_union(trailer_agents(F.col("body")), F.coalesce("live", F.array().cast("array<string>"))))).drop("live")


def day_journal(commits: DataFrame, tokens: DataFrame) -> DataFrame:
    """(day, commits, by_agents, tokens): commits a day, and days that only have tokens."""
    days = commits.groupBy("day").agg(F.count(F.lit(1)).alias("commits"), F.count_if(F.size("agents") > 0).alias("by_agents"))
    daily = tokens.groupBy("day").agg(F.sum("tokens").alias("tokens"))
    return days.join(daily, "day", "full").select("day", F.coalesce("commits", F.lit(0)).alias("commits"), F.coalesce("by_agents", F.lit(0)).alias("by_agents"), "tokens")


def nested_journal(commits: DataFrame, tokens: DataFrame) -> DataFrame:
    """(day, place, tokens, commits): days with the newest first, each with its commits (at, hash, subject), the newest first.

    Days without a commit but with tokens are there too.  A day's commits are one array, as in the report they are for.
    """
    newest = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("at")).alias("less"), "hash", "at", "subject"))), lambda c: F.struct(c["at"].alias("at"), c["hash"].alias("hash"), c["subject"].alias("subject")))
    days = commits.groupBy("day").agg(newest.alias("commits"))
    daily = tokens.groupBy("day").agg(F.sum("tokens").alias("tokens"))
    joined = days.join(daily, "day", "full").withColumn("commits", F.coalesce("commits", F.array().cast(days.schema["commits"].dataType)))
    return joined.withColumn("place", F.row_number().over(Window.orderBy(F.desc("day"))))  # a row a day


def journal_summary(commits: DataFrame, tokens: DataFrame) -> DataFrame:
    """(commits, by_agents, added, deleted, active_days, tokens) over all days; a day is active with a commit or with tokens."""
    totals = commits.agg(
        F.count(F.lit(1)).alias("commits"), F.count_if(F.size("agents") > 0).alias("by_agents"),
        F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"),
    )
    days = commits.select("day").unionByName(tokens.where("tokens > 0").select("day")).agg(F.count_distinct("day").alias("active_days"))
    return totals.join(days).join(tokens.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")))  # one row each


def oldest_baseline(snapshots: DataFrame, *, since: Column, days: int) -> DataFrame:
    """(project, kind, count): each project's counts on the oldest day of the window before ``since``."""
    inside = snapshots.where((F.col("day") < since) & (F.col("day") >= F.date_sub(since, days)))
    first = inside.groupBy("project").agg(F.min("day").alias("day"))
    return inside.join(first, ["project", "day"]).select("project", "kind", "count")


def debt_change(today: DataFrame, baseline: DataFrame) -> DataFrame:
    """(project, kind, change): no baseline, no row."""
    now = today.withColumnRenamed("count", "now")
    return now.join(baseline, ["project", "kind"]).select("project", "kind", (F.col("now") - F.col("count")).alias("change"))
