"""Queries that write tables as trees, logs and stores into the shared folder and read them back by the readers."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import usage as U
from ..registry import Registry, table
from ..session import scratch_path
from ..sources import readers as R
from ..sources import stores as S
from .common import FILES, in_list
from .records import _lines
from .text import _dirs, _sensitive, once

registry = Registry()
query = registry.query


def _folder(spark) -> str:
    """A new folder as a path that tasks can open; trees and logs need a shared file system that is mounted."""
    uri = scratch_path(spark)
    scheme, found, path = uri.partition("://")
    if found and scheme != "file":
        raise RuntimeError(f"trees and logs are read from a mounted folder, not from {scheme}")
    path = path if found else uri
    os.makedirs(path)
    return path


def _write_files(rows, root: str, *, append: bool = False) -> None:
    """Writes (path, content) rows as files, or adds to them; rows of one path must be together and in order."""

    def write(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                place = os.path.join(root, path)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(place, "a" if append else "w", encoding="utf-8", newline="") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    rows.select("path", "content").mapInPandas(write, "n long").write.format("noop").mode("overwrite").save()


@query("scanned_tree", f"""
    SELECT project || '/' || path AS path, length(text)::BIGINT AS characters, sha256(text) AS content_hash FROM (
      SELECT *, {_sensitive} AS sens FROM (
        SELECT f.*, string_split(path, '/') AS parts, regexp_extract(path, '([^/]*)$', 1) AS name, lower(regexp_extract(path, '([^/]*)$', 1)) AS n, '/' || lower(regexp_extract(path, '([^/]*)$', 1)) AS p, h.text
        FROM {FILES} f JOIN (SELECT file_id, coalesce(max(head_text), '') AS text FROM file_heads GROUP BY file_id) h ON h.file_id = f.id))
    WHERE NOT sens AND name NOT IN {in_list(P.IGNORED_NAMES)} AND NOT regexp_matches(n, '{P.one_of(P.IGNORED_SUFFIXES)}$')
      AND len(list_filter(parts[:-2], lambda x: x IN {_dirs} OR (starts_with(x, '.') AND x <> '.' AND x <> '.github'))) = 0
      AND NOT CASE WHEN list_contains(parts[:-3], 'session') THEN true WHEN parts[-2] = 'session' THEN NOT ends_with(path, '.go') ELSE contains(name, '_view.') END""")
def scanned_tree(spark, d):
    """The heads of all files as a tree with two kinds of ignore file, listed, filtered and read back."""
    root = _folder(spark)
    heads = table(spark, d, "file_heads").groupBy("file_id").agg(F.coalesce(F.max("head_text"), F.lit("")).alias("content"))
    files = once(table(spark, d, "files")).select(F.col("id").alias("file_id"), "project", F.concat_ws("/", "project", "path").alias("path"))
    rules = files.select("project").distinct().select(F.concat("project", F.lit("/.gitignore")).alias("path"), F.lit("session/**\n**/session/**\n!**/session/*.go\n").alias("content"))
    _write_files(files.join(heads, "file_id").select("path", "content").unionByName(rules), root)
    found = R.scan_tree(spark, root, ["*_view.*"])
    return found.select("path", F.char_length("content").cast("long").alias("characters"), "content_hash")


@query("read_problems", f"""
    SELECT path, CASE WHEN k = 0 THEN text END AS content, CASE k WHEN 1 THEN 'refused' WHEN 2 THEN 'missing' WHEN 3 THEN 'too large' END AS problem FROM (
      SELECT CASE k WHEN 1 THEN '../' || n WHEN 2 THEN 'none/' || n ELSE n END AS path, CASE WHEN k IN (1, 2) THEN k WHEN strlen(text) > 300 THEN 3 ELSE 0 END AS k, text
      FROM (SELECT file_id || '.txt' AS n, coalesce(max(head_text), '') AS text FROM file_heads GROUP BY file_id), (SELECT unnest([0, 1, 2]) AS k))""")
def read_problems(spark, d):
    """Every head read as a file, and under paths that leave the folder or aren't there; heads over 300 bytes are too large."""
    root = _folder(spark)
    rows = table(spark, d, "file_heads").groupBy("file_id").agg(F.coalesce(F.max("head_text"), F.lit("")).alias("content"))
    rows = rows.withColumn("path", F.concat(F.col("file_id").cast("string"), F.lit(".txt")))
    _write_files(rows, root)
    asked = rows.select(F.explode(F.array("path", F.concat(F.lit("../"), "path"), F.concat(F.lit("none/"), "path"))).alias("path"))
    return R.read_files(asked, root, most=300)


def _written_logs(spark, d, root, *, later: bool):
    """Writes the first or the second half of every log's lines; the first half ends in the middle of a line."""
    lines = _lines(spark, d, "line_no", "delivery_id")
    by_log = Window.partitionBy("path")
    place = F.row_number().over(by_log.orderBy("line_no", "delivery_id"))
    lines = lines.withColumns({"place": place, "all": F.count(F.lit(1)).over(by_log)})
    cut = F.col("place") == F.floor((F.col("all") + 1) / 2)
    half = F.floor(F.char_length("value") / 2).cast("int")
    early, late = F.substring(F.col("value"), F.lit(1), half), F.concat(F.substring(F.col("value"), half + 1, F.lit(2**30)), F.lit("\n"))
    whole = F.concat("value", F.lit("\n"))
    content = F.when(cut, late if later else early).otherwise(whole)
    chosen = lines.where(F.col("place") >= F.floor((F.col("all") + 1) / 2) if later else F.col("place") <= F.floor((F.col("all") + 1) / 2))
    _write_files(chosen.withColumn("content", content).repartition("path").sortWithinPartitions("path", "place"), root, append=True)


@query("log_tails", "SELECT log_path AS path, count(*) AS lines, count(*) FILTER (WHERE model IS NOT NULL) AS models, 0::BIGINT AS lost, false AS more FROM log_messages GROUP BY 1")
def log_tails(spark, d):
    """Every message written as a log line; each log is read when it has half of its lines and a fragment, then from where
    that pass ended, in passes of bounded size."""
    root = _folder(spark)
    state = spark.createDataFrame([], R.TAIL_STATE)
    found = None
    for later in (False, True):
        _written_logs(spark, d, root, later=later)
        listing, _ = R.list_logs(spark, root, layout="flat", most_entries=2**31)
        while True:
            lines, read = R.read_tails(R.tail_plan(listing, state), root)
            found = lines if found is None else found.unionByName(lines)
            state = R.next_state(state, read, listing)
            if read.where("more").isEmpty():
                break
    lines = found.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("value").contains('"model":"')).alias("models"))
    return lines.join(state.select("path", "lost", "more"), "path")


@query("log_needles", "SELECT log_path AS path, count(*) AS n FROM log_messages WHERE stop_reason IS NOT NULL GROUP BY 1")
def log_needles(spark, d):
    """Lines of written logs that name a reason to stop, found before parsing."""
    root = _folder(spark)
    _written_logs(spark, d, root, later=False)
    _written_logs(spark, d, root, later=True)
    lines = R.log_lines(spark, f"file://{root}/*/*.jsonl", ['"stop_reason":"'])
    return lines.groupBy(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path")).agg(F.count(F.lit(1)).alias("n"))


_cents = "(SELECT *, round(value * 100)::BIGINT AS cents FROM events)"


@query("counter_lines", f"""
    SELECT user_id, sum(CASE WHEN p IS NULL OR cents < p THEN cents ELSE cents - p END)::BIGINT AS total FROM (
      SELECT user_id, cents, lag(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM {_cents} WHERE event_type <> 'error') WHERE p IS NULL OR cents <> p GROUP BY user_id""")
def counter_lines(spark, d):
    """Counter events written as lines of the second dialect, every line twice as in a copied log, and folded to totals."""
    e = table(spark, d, "events")
    value = F.to_json(F.struct(
        F.lit("event_msg").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.struct(
            F.when(F.col("event_type") == "error", "other").otherwise("token_count").alias("type"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("turn_id"),
            F.struct(F.struct(F.round(F.col("value") * 100).cast("long").alias("total_tokens")).alias("total_token_usage")).alias("info"),
        ).alias("payload"),
    ))
    lines = e.select(F.col("user_id").cast("string").alias("path"), value.alias("value"))
    rows = R.counter_usage(lines.unionByName(lines)).where("kind = 'token_count'")
    deltas = U.canonical_counters(rows, key=["path"], at="at", sequence="turn_id", value="cumulative")
    return deltas.groupBy(F.col("path").cast("long").alias("user_id")).agg(F.sum("delta").alias("total"))


@query("changed_paths", f"SELECT DISTINCT project, CASE WHEN language = 'go' THEN 'moved/' || path ELSE path END AS path FROM {FILES} WHERE path NOT LIKE 'app/%'")
def changed_paths(spark, d):
    """A status line for every file, those in Go renamed; the tool's own folder is left out."""
    files = once(table(spark, d, "files"))
    entry = F.when(F.col("language") == "go", F.concat(F.lit("R  "), "path", F.lit(" -> moved/"), "path")).otherwise(F.concat(F.lit(" M "), "path"))
    rows = files.withColumn("kept", F.coalesce(F.col("language") == "go", F.lit(False)) & F.col("path").startswith("app/"))
    return R.status_paths(rows.where("not kept").select("project", entry.alias("value")), own="app/")


@query("recent_names", f"SELECT DISTINCT project, path FROM {FILES} WHERE path NOT LIKE 'app/%'")
def recent_names(spark, d):
    files = once(table(spark, d, "files"))
    value = F.explode(F.array(F.lit(""), F.col("path"), F.concat(F.lit(" "), "path", F.lit(" "))))
    return R.recent_paths(files.select("project", value.alias("value")), own="app/")


@query("blame_lines", f"SELECT DISTINCT f.id::VARCHAR AS path, line, (1700000000 + line)::DOUBLE AS author_time FROM symbols s JOIN {FILES} f ON f.id = s.file_id WHERE line > 0")
def blame_lines(spark, d):
    """Porcelain output with a header and an author time for every declared line."""
    rows = table(spark, d, "symbols").where("line > 0").join(once(table(spark, d, "files")).select(F.col("id").alias("file_id")), "file_id").select("file_id", "line").distinct()
    number = F.col("line").cast("string")
    piece = F.concat(F.sha1(number), F.lit(" 7 "), number, F.lit(" 1\nauthor A B\nauthor-time "), (F.col("line") + 1_700_000_000).cast("string"), F.lit("\nsummary author-time 5\n\tx = 1"))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("line", piece.alias("piece"))))["piece"], "\n")
    return R.blame_times(rows.groupBy(F.col("file_id").cast("string").alias("path")).agg(text.alias("text")))


@query("manifest_targets", f"""
    SELECT project, dir AS name, CASE WHEN length(dir) % 2 = 0 THEN 'Code/' || dir ELSE 'Sources/' || dir END AS path
    FROM (SELECT DISTINCT project, string_split(path, '/')[2] AS dir FROM {FILES}) WHERE dir IS NOT NULL AND regexp_matches(dir, '^[a-z_]+$')""")
def manifest_targets(spark, d):
    """A manifest for every project with a target for each of its directories, read back."""
    dirs = once(table(spark, d, "files")).select("project", F.try_element_at(F.split("path", "/"), F.lit(2)).alias("dir")).where(F.col("dir").rlike("^[a-z_]+$")).distinct()
    target = F.concat(F.lit('        .target(\n            name: "'), "dir", F.lit('", dependencies: [.product(name: "X", package: "x")]'),
                      F.when(F.char_length("dir") % 2 == 0, F.concat(F.lit(', path: "Code/'), "dir", F.lit('"'))).otherwise(""), F.lit("),\n"))
    texts = dirs.groupBy("project").agg(F.concat(F.lit("let package = Package(targets: [\n"), F.array_join(F.collect_list(target), ""), F.lit("])")).alias("text"))

    targets = R.manifest_targets

    def read(batches):
        for batch in batches:
            rows = [(project, name, path) for project, text in zip(batch["project"], batch["text"]) for name, path in targets(text)]
            yield pd.DataFrame(rows, columns=["project", "name", "path"])

    return texts.mapInPandas(read, "project string, name string, path string")


@query("config_remotes", f"SELECT DISTINCT project, 'github.com/team/' || lower(project) AS remote FROM {FILES} WHERE project IS NOT NULL")
def config_remotes(spark, d):
    """A repository's configuration for every project, and the canonical name of its remote."""
    from ..functions.text import normalized_remote

    projects = once(table(spark, d, "files")).where("project is not null").select("project").distinct()
    text = F.concat(F.lit('[core]\n\tbare = false\n[remote "backup"]\n\turl = no\n[remote "origin"]\n\turl = git@github.com:team/'), "project", F.lit('.git\n[branch "main"]\n\tmerge = x\n'))

    remote = R.remote_of_config

    def read(batches):
        for batch in batches:
            yield batch.assign(url=[remote(t) for t in batch["text"]])[["project", "url"]]

    urls = projects.select("project", text.alias("text")).mapInPandas(read, "project string, url string")
    return urls.select("project", normalized_remote(F.col("url")).alias("remote"))


@query("canonical_projects", """
    WITH r AS (SELECT DISTINCT cwd, CASE WHEN length(cwd) % 3 > 0 THEN 'https://github.com/Team/' || string_split(cwd, '/')[-1] || '.git' END AS url FROM log_messages WHERE cwd IS NOT NULL)
    SELECT rtrim('github.com/team/' || lower(string_split(m.cwd, '/')[-1]), '/') AS identity, count(*) AS n FROM log_messages m LEFT JOIN r ON r.cwd = m.cwd AND r.url IS NOT NULL
    WHERE m.cwd IS NOT NULL AND r.url IS NOT NULL GROUP BY 1
    UNION ALL SELECT m.cwd, count(*) FROM log_messages m JOIN r ON r.cwd = m.cwd AND r.url IS NULL GROUP BY 1""")
def canonical_projects(spark, d):
    """Messages by the identity of their directory: its remote where one is known, else the directory."""
    rows = table(spark, d, "log_messages").where("cwd is not null").select("cwd")
    last = F.element_at(F.split("cwd", "/"), -1)
    known = rows.distinct().where(F.char_length("cwd") % 3 > 0).select("cwd", F.concat(F.lit("https://github.com/Team/"), last, F.lit(".git")).alias("url"))
    return U.project_identity(rows, known, project="cwd", url="url").groupBy("identity").agg(F.count(F.lit(1)).alias("n"))


@query("usage_appends", "SELECT count(*) AS n, count(*) FILTER (WHERE contains(text, 'zz')) AS zz FROM (SELECT text FROM documents WHERE text IS NOT NULL UNION ALL SELECT text FROM documents WHERE text IS NOT NULL)")
def usage_appends(spark, d):
    """Every text appended twice as a request, and read back."""
    root = scratch_path(spark)
    events = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("query"))
    S.append_usage(events, root)
    S.append_usage(events, root)
    return spark.read.parquet(root).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("query").contains("zz")).alias("zz"))


@query("snapshot_round_trip", """
    WITH t AS (SELECT event_type AS name, ts::DATE AS day, round(sum(value) * 100)::BIGINT AS tokens FROM events GROUP BY ALL)
    SELECT 'day' AS kind, day::VARCHAR AS name, sum(tokens)::BIGINT AS tokens FROM t WHERE day > (SELECT max(day) FROM t) - 7 GROUP BY day
    UNION ALL (SELECT 'type', name, sum(tokens)::BIGINT FROM t GROUP BY name ORDER BY 3 DESC, name LIMIT 3)""")
def snapshot_round_trip(spark, d):
    """The last seven days and the three largest types, written as a snapshot and read back with its checks."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("name"), F.to_date("ts").alias("day")).agg(F.round(F.sum("value") * 100).cast("long").alias("tokens"))
    last = e.agg(F.max("day")).scalar()
    daily = e.where(F.col("day") > F.date_sub(last, 7)).groupBy("day").agg(F.sum("tokens").alias("tokens"))
    ranks = e.groupBy("name").agg(F.sum("tokens").alias("tokens")).orderBy(F.desc("tokens"), "name").limit(3).withColumn("kind", F.lit("type"))
    path = scratch_path(spark)
    S.write_snapshot(daily, ranks, path)
    return S.read_snapshot(spark, path)


@query("activity_round_trip", """
    SELECT key, day, nanoseconds FROM (SELECT event_type AS key, strftime(ts, '%Y-%m-%d') AS day, floor(value)::BIGINT * 1000000 AS nanoseconds,
      row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE value < 90) WHERE place = 1""")
def activity_round_trip(spark, d):
    """An activity document for every event in two batches, the second one written twice; a type's newest sound one stays.

    Documents of events with a value of 90 and more have a key too many."""
    e = table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    extra = F.when(F.col("value") >= 90, 1)
    document = F.to_json(F.struct(
        F.lit(1).alias("version"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit("Asia/Seoul").alias("timeZoneID"), (F.floor("value") * 1_000_000).alias("estimatedNanoseconds"),
        F.lit("paused").alias("phase"), F.lit(False).alias("partial"), F.lit(300).alias("idleSeconds"), at.alias("generatedAt"), extra.alias("project"),
    ))
    rows = e.select(F.col("event_type").alias("key"), "ts", document.alias("document"))
    middle = e.agg(F.timestamp_micros(F.avg(F.unix_micros(F.col("ts").cast("timestamp"))).cast("long")).cast("timestamp_ntz")).scalar()
    root = scratch_path(spark)
    S.write_activity(rows.where(F.col("ts") <= middle), root, 0)
    for _ in range(2):
        S.write_activity(rows.where(F.col("ts") > middle), root, 1)
    return S.read_activity(spark, root).select("key", "day", F.col("estimatedNanoseconds").alias("nanoseconds"))


@query("agent_homes", f"""
    SELECT DISTINCT project AS home, agent FROM {FILES}, (VALUES ('one', 'src'), ('one', 'core'), ('two', 'assets'), ('three', 'none')) m(agent, marker) WHERE string_split(path, '/')[1] = marker""")
def agent_homes(spark, d):
    """A project stands for a home, its top folders for what exists there."""
    homes = once(table(spark, d, "files")).select(F.col("project").alias("home"), F.split("path", "/")[0].alias("path")).distinct()
    return R.present_agents(homes, {"one": ["src", "core"], "two": ["assets"], "three": ["none"]})
