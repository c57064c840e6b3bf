"""Rendering context: slices of files, bundles within a budget, what was delivered before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MIN_LINES, MOST_KEPT, PREAMBLE = 40, 0.75, 3  # fixed values: shorter files, and slices that keep more, go out whole


def name_matches(name: Column, terms: list[str]) -> Column:
    wanted = F.array(*map(F.lit, terms)).cast("array<string>")
    return F.exists(T.subwords(name), lambda w: F.exists(wanted, lambda t: (w == t) | ((F.char_length(t) >= 3) & w.contains(t))))


def sliced_files(sources: DataFrame, declared: DataFrame, terms: list[str]) -> DataFrame:
    """(file_id, content, sliced, kept_lines, total_lines): imports, signatures, matching bodies and the first lines.

    ``sources`` has (file_id, language, text); ``declared`` (file_id, line, end_line, kind, name).  A file under 40
    lines, without a matching declaration, or of which over three quarters would stay, goes out whole.  A mark with
    the count stands for lines left out.
    """
    matched = (F.col("kind") != "import") & name_matches(F.col("name"), terms)
    spans = declared.groupBy("file_id").agg(
        F.collect_set("line").alias("heads"), F.collect_set(F.when(matched, F.struct("line", F.coalesce("end_line", "line").alias("end")))).alias("bodies")
    )
    rows = sources.join(spans, "file_id", "left").withColumn("lines", F.split("text", "\n")).withColumn("total", F.size("lines"))
    none = F.array().cast("array<int>")
    heads = F.filter(F.coalesce("heads", none), lambda n: n <= F.col("total"))
    bodies = F.flatten(F.transform(F.coalesce("bodies", F.array().cast("array<struct<line:int,end:int>>")), lambda b: F.sequence(b["line"], F.least(F.greatest(b["end"], b["line"]), F.col("total")))))
    first = F.sequence(F.lit(1), F.least(F.lit(PREAMBLE), F.col("total")))
    rows = rows.withColumn("keep", F.array_sort(F.array_distinct(F.concat(heads, bodies, first))))
    whole = (F.col("total") < MIN_LINES) | (F.size(F.coalesce("bodies", F.array().cast("array<struct<line:int,end:int>>"))) == 0) | (F.size("keep") > MOST_KEPT * F.col("total"))
    mark = F.when(F.col("language").isin("python", "ruby"), "#").otherwise("//")
    gap = lambda n: F.concat(mark, F.lit(" … ("), n.cast("string"), F.lit("줄 생략)"))

    def part(n: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.col("keep"), F.greatest(i, F.lit(1))))
        line = F.element_at(F.col("lines"), n)
        return F.when(n - before > 1, F.array(gap(n - before - 1), line)).otherwise(F.array(line))

    parts = F.flatten(F.transform(F.col("keep"), part))
    rest = F.col("total") - F.element_at("keep", -1)
    parts = F.when(rest > 0, F.concat(parts, F.array(gap(rest)))).otherwise(parts)
    text = F.concat(F.array_join(parts, "\n"), F.lit("\n"))
    return rows.select(
        "file_id", F.when(whole, F.col("text")).otherwise(text).alias("content"), (~whole).alias("sliced"),
        F.when(whole, F.col("total")).otherwise(F.size("keep")).alias("kept_lines"), F.col("total").alias("total_lines"),
    )


def unsent(bodies: DataFrame, delivered: DataFrame, *, now: Column, ttl: int = 900) -> DataFrame:
    """Bodies without those sent unchanged to the project within ``ttl`` seconds: (project, path, digest) in both."""
    recent = delivered.where((now - F.col("at") <= ttl) & (F.col("at") <= now)).select("project", "path", "digest").distinct()
    return bodies.join(recent, ["project", "path", "digest"], "left_anti")


def recorded_deliveries(deliveries: DataFrame) -> DataFrame:
    """Deliveries worth recording: less went out than the whole would have been."""
    return deliveries.where("full > selected")


def prompt_paths(ranked: DataFrame, shown_before: DataFrame, *, most: int = 6) -> DataFrame:
    """The best included paths of a request that the session has not been shown yet."""
    fresh = ranked.where("included").join(shown_before.select("project", "path"), ["project", "path"], "left_anti")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("score"), "tokens", "path"))
    return fresh.withColumn("place", place).where(F.col("place") <= most).drop("place")


def bundled(entries: DataFrame, budget: int) -> DataFrame:
    """(request_id, bundle, tokens): rendered entries in rank order, each charged with its heading; what doesn't fit is skipped.

    ``entries`` has (request_id, id, rank, heading, body, sent): a body sent before gives way to a short note where
    that is shorter.
    """
    from .ranking import fill_budget

    note = F.lit("(unchanged)")
    body = F.when(F.col("sent") & (F.char_length(note) < F.char_length("body")), note).otherwise(F.col("body"))
    rendered = entries.withColumn("piece", F.concat("heading", F.lit("\n"), body)).withColumn("size", T.estimated_tokens(F.char_length("piece"), F.lit("unknown")))
    chosen = fill_budget(rendered, budget, group="request_id", size="size", order=[F.col("rank"), F.col("id")]).where("included")
    return chosen.groupBy("request_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "piece"))), lambda x: x["piece"]), "\n\n").alias("bundle"),
        F.sum("size").alias("tokens"),
    )
