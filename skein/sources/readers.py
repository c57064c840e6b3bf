"""Readers that give typed frames: source trees, session logs in two dialects, closed packets, manifests."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..functions import text as X
from ..session import Table

MOST_BYTES = 2_000_000  # fixed value: larger files are not indexed
MOST_LINE_BYTES = 2 * 1024 * 1024  # fixed value: longer log lines are skipped and counted

_long = T.LongType()
_usage = T.StructType([T.StructField(n, _long) for n in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")])
#: Dialect A: one message a line.  There is no field for its text, so prompts are never read.
MESSAGE_LINE = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("cwd", T.StringType()),
    T.StructField("sessionId", T.StringType()), T.StructField("isSidechain", T.BooleanType()), T.StructField("usage", _usage),
    T.StructField("message", T.StructType([
        T.StructField("id", T.StringType()), T.StructField("model", T.StringType()), T.StructField("stop_reason", T.StringType()), T.StructField("usage", _usage),
    ])),
])
#: Dialect B: events with a cumulative counter.
COUNTER_LINE = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("payload", T.StructType([
        T.StructField("type", T.StringType()), T.StructField("id", T.StringType()), T.StructField("cwd", T.StringType()),
        T.StructField("turn_id", T.StringType()), T.StructField("model", T.StringType()),
        T.StructField("info", T.StructType([T.StructField("total_token_usage", T.StructType([T.StructField("total_tokens", _long)]))])),
    ])),
])


TREE_ROW = "path string, byte_size long, modified_at double, rules string"
IGNORE_FILE = ".gitignore"
RULE_ROW = "directory string, place long, pattern string, negated boolean, only boolean"
MOST_HELD = 4_000_000  # characters that a task holds before it hands rows on


def _entries(root: str, here: str) -> tuple[list[str], list[tuple]]:
    """Directories below ``here`` that may be entered, and rows of its regular files."""
    folders, found = [], []
    for e in os.scandir(os.path.join(root, here)):
        path = f"{here}/{e.name}" if here else e.name
        if e.is_dir(follow_symlinks=False):
            hidden = e.name.startswith(".") and e.name not in P.KEPT_HIDDEN_DIRECTORIES
            if not hidden and e.name not in P.IGNORED_DIRECTORIES:
                folders.append(path)
        elif e.is_file(follow_symlinks=False):
            known, rules = e.stat(follow_symlinks=False), None
            if e.name == IGNORE_FILE:
                with open(e.path, errors="replace") as lines:
                    rules = lines.read(MOST_BYTES)
            found.append((path, known.st_size, known.st_mtime, rules))
    return folders, found


def list_tree(spark: SparkSession, root: str, *, fan: int = 64) -> DataFrame:
    """(path, byte_size, modified_at, rules) of the regular files under ``root``, by relative path; ``rules`` is the text of
    an ignore file.

    Denied directories are not entered, links are not followed, and a directory that can't be read is left out unless it
    is the root.  The driver lists from the top until ``fan`` directories are open; tasks walk these to the bottom, in a
    folder that all of them see.  Spark's own listing would leave out every name that begins with an underscore or a dot.
    """
    todo, found = _entries(root, "")
    while todo and len(todo) < fan:
        try:
            inner, files = _entries(root, todo.pop(0))
        except OSError:
            continue
        todo += inner
        found += files

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "byte_size", "modified_at", "rules"]
        for batch in batches:
            stack, rows, held = list(batch["path"]), [], 0
            while stack:
                try:
                    inner, files = _entries(root, stack.pop())
                except OSError:
                    continue
                stack += inner
                rows += files
                held += sum(len(path) + len(rules or "") for path, _, _, rules in files)
                if held >= MOST_HELD:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    top = spark.createDataFrame(sorted(found), TREE_ROW)
    if not todo:
        return top
    tasks = min(len(todo), max(fan, 2 * spark.sparkContext.defaultParallelism))  # a wide folder leaves far more open than are needed
    return top.unionByName(spark.createDataFrame([(t,) for t in todo], "path string").repartition(tasks).mapInPandas(walk, TREE_ROW))


def _rule_rows(written: DataFrame, first: list[str]) -> DataFrame:
    """``RULE_ROW`` of the lines of ignore files (path, rules), and of ``first``, which stand before the root's own."""

    def rows(directory: str, lines: list[str], place: int) -> list[tuple]:
        found = ((n, P.compile_ignore_rule(line)) for n, line in enumerate(lines, place))
        return [(directory, n, r.pattern, r.negated, r.directories_only) for n, r in found if r]

    def compiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, text in zip(batch["path"], batch["rules"]):
                if found := rows(os.path.dirname(path), text.splitlines(), 0):
                    yield pd.DataFrame(found, columns=["directory", "place", "pattern", "negated", "only"])

    return written.mapInPandas(compiled, RULE_ROW).unionByName(written.sparkSession.createDataFrame(rows("", first, -len(first)), RULE_ROW))


def scan_tree(spark: SparkSession, root: str, ignore_lines: list[str] | None = None) -> DataFrame:
    """(path, language, byte_size, line_count, content_hash, modified_at, content) of the indexable files under ``root``.

    Denied and sensitive names, files over 2 MB and files that are not text stay out, and so does what the ignore file of
    any directory above says (``ignore_lines`` stands before the root's own).  Names and sizes are tested first; what is
    left is read by the tasks, from a folder that all of them see.
    """
    listed = Table(list_tree(spark, root)).df
    rules = _rule_rows(listed.where("rules is not null").select("path", "rules"), list(ignore_lines or ()))
    files = listed.drop("rules").where(F.col("byte_size") <= MOST_BYTES)
    files = files.where(~P.ignored_directory(F.col("path")) & ~P.ignored_file(F.col("path")))
    files = P.ignored_by_rule_rows(files, rules).where("not ignored").drop("ignored")
    files = files.repartition(2 * spark.sparkContext.defaultParallelism)  # paths are small, what they lead to isn't
    texts = read_files(files, root, kept={"byte_size": "long", "modified_at": "double"}).where("problem is null")
    return texts.select(
        "path", X.language_of(F.col("path")).alias("language"), "byte_size", F.size(F.split("content", "\n")).alias("line_count"),
        F.sha2("content", 256).alias("content_hash"), "modified_at", "content",
    )


def read_files(paths: DataFrame, root: str, *, most: int = MOST_BYTES, kept: dict[str, str] | None = None) -> DataFrame:
    """(path, content, problem): whole text of each relative path below ``root``, read by the tasks; ``kept`` columns of
    ``paths`` (with their types) come along after the path.

    A path that leaves the root, has an empty or dotted component or goes over a link is refused; so are files that aren't
    regular, have more than ``most`` bytes or aren't UTF-8.  Nothing is cut: the content is null where there is a problem.
    """

    def read(path: str) -> tuple[str | None, str | None]:
        parts = path.split("/")
        if any(p in ("", ".", "..") or "\0" in p for p in parts):
            return None, "refused"
        try:
            place = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
            try:
                for i, part in enumerate(parts):
                    last = os.O_NONBLOCK if i + 1 == len(parts) else os.O_DIRECTORY
                    below = os.open(part, os.O_RDONLY | os.O_NOFOLLOW | last, dir_fd=place)
                    os.close(place)
                    place = below
                known = os.fstat(place)
                if not stat.S_ISREG(known.st_mode):
                    return None, "not a file"
                with os.fdopen(os.dup(place), "rb") as f:
                    data = f.read(most + 1)
            finally:
                os.close(place)
            return (None, "too large") if len(data) > most else (data.decode("utf-8"), None)
        except UnicodeDecodeError:
            return None, "not text"
        except FileNotFoundError:
            return None, "missing"
        except OSError:
            return None, "refused"

    known = {"path": "string"} | (kept or {})
    names = [*known, "content", "problem"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for row in batch.itertuples(index=False, name=None):
                content, problem = read(row[0])
                rows.append((*row, content, problem))
                held += len(content or "")
                if held >= MOST_HELD:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return paths.select(*known).mapInPandas(run, ", ".join(f"{c} {kind}" for c, kind in known.items()) + ", content string, problem string")


def log_lines(spark: SparkSession, location: str, needles: list[str]) -> DataFrame:
    """(path, value): lines that hold one of ``needles``; the test runs on the raw text before any parsing."""
    lines = spark.read.text(location).select(F.input_file_name().alias("path"), "value")
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.col("value").contains(needle)
    return lines.where(hit) if needles else lines


def bounded_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of tolerable length, and (path, lost) the count of those skipped by file."""
    size = F.octet_length("value")
    return lines.where(size <= MOST_LINE_BYTES), lines.where(size > MOST_LINE_BYTES).groupBy("path").agg(F.count(F.lit(1)).alias("lost"))


TAIL_STATE = "path string, size long, modified_at double, inode long, offset long, skipping boolean, lost long, more boolean"
MOST_READ = 4 * 1024 * 1024  # fixed value: bytes of one log that one pass reads
BOOTSTRAP = 2 * 1024 * 1024  # fixed value: bytes from the end that a first look at a log reads


def tail_plan(listing: DataFrame, state: DataFrame, *, bootstrap: int | None = None) -> DataFrame:
    """(path, size, modified_at, inode, start, skipping, whole): from where each log of ``listing`` (path, size, modified_at,
    inode) is to be read, given the ``state`` (``TAIL_STATE``) of the last pass.

    A log with the same size, time and inode is left alone unless its last pass stopped early; one that grew goes on at
    its offset; one that shrank, changed without growing or is another file under the name starts anew (``whole``), and so
    does a new one.  With ``bootstrap`` a start reads that many bytes from the end and drops the first fragment.
    """
    old = state.select("path", *[F.col(c).alias(f"old_{c}") for c in ("size", "modified_at", "inode", "offset", "skipping", "more")])
    rows = listing.select("path", "size", "modified_at", "inode").join(old, "path", "left")
    same = (F.col("size") == F.col("old_size")) & (F.col("modified_at") == F.col("old_modified_at"))
    replaced = F.col("old_size").isNull() | ~F.col("inode").eqNullSafe(F.col("old_inode")) | (F.col("size") < F.col("old_size"))
    whole = replaced | ((F.col("size") == F.col("old_size")) & ~same)
    first = F.greatest(F.lit(0), F.col("size") - bootstrap) if bootstrap else F.lit(0)
    return rows.where(whole | ~same | F.col("old_more")).select(
        "path", "size", "modified_at", "inode", F.when(whole, first).otherwise(F.col("old_offset")).cast("long").alias("start"),
        F.when(whole, first > 0).otherwise(F.col("old_skipping")).alias("skipping"), whole.alias("whole"),
    )


def read_tails(plan: DataFrame, root: str, *, most_read: int = MOST_READ, most_line: int = MOST_LINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """((path, at, value), state): whole lines from each start with the byte where each begins, and where the next pass goes on.

    A pass reads ``most_read`` bytes of a log; ``more`` says that there is more.  The last line is left unread until it has
    its end.  Lines over ``most_line`` bytes are passed over, also across passes, and counted as ``lost``; empty ones don't
    come out.  Logs are read by the tasks from a folder that all of them see; a log that can't be read has no row.
    """

    def one(path: str, start: int, skipping: bool) -> tuple[list[tuple], tuple]:
        with open(os.path.join(root, path), "rb") as f:
            f.seek(start)
            data = f.read(most_read)
            more = bool(f.read(1))
        at, lost, out, fragment = 0, 0, [], skipping
        while (end := data.find(b"\n", at)) >= 0:
            if fragment:
                fragment = False
            elif end - at > most_line:
                lost += 1
            elif end > at:
                out.append((path, start + at, data[at:end].decode("utf-8", "replace")))
            at = end + 1
        if len(data) - at > most_line or (fragment and len(data) > at):  # the start of a line that is passed over
            lost += not fragment
            at, fragment = len(data), True
        elif more and at == 0 and len(data) == most_read:
            raise ValueError("a pass must read more than a line may have")
        return out, (start + at, fragment, lost, more)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "at", "value", "size", "modified_at", "inode", "offset", "skipping", "lost", "more"]
        for batch in batches:
            for r in batch.itertuples():
                try:
                    lines, (offset, skipping, lost, more) = one(r.path, int(r.start), bool(r.skipping))
                except OSError:
                    continue
                rows = [(*line, None, None, None, None, None, None, None) for line in lines]
                yield pd.DataFrame([*rows, (r.path, None, None, r.size, r.modified_at, r.inode, offset, skipping, lost, more)], columns=names).astype(
                    {c: "Int64" for c in ("at", "size", "inode", "offset", "lost")}
                )

    read = Table(plan.mapInPandas(run, "path string, at long, value string, size long, modified_at double, inode long, offset long, skipping boolean, lost long, more boolean")).df
    return read.where("value is not null").select("path", "at", "value"), read.where("value is null").drop("at", "value")


def next_state(state: DataFrame, read: DataFrame, listing: DataFrame) -> DataFrame:
    """The state after a pass: that of the logs read, the old one of those left alone, none for those that are gone."""
    kept = state.join(read.select("path"), "path", "left_anti")
    return kept.unionByName(read.select(*kept.columns)).join(listing.select("path"), "path", "left_semi")


def list_logs(spark: SparkSession, root: str, *, layout: str, most_entries: int = 4096) -> tuple[DataFrame, list[str]]:
    """((path, size, modified_at, inode), issues): the logs below ``root``.

    Layout ``flat`` has ``*.jsonl`` one directory down, ``deep`` has ``rollout-*.jsonl`` at any depth.  Links are refused and
    reported as ``link``, a root that can't be read as ``unreadable``, and more than ``most_entries`` as ``truncated``.
    """
    found, issues, seen = [], set(), 0
    todo = [("", 0)]
    while todo:
        here, depth = todo.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, here)), key=lambda e: e.name)
        except OSError:
            issues.add("unreadable" if not here else "unreadable part")
            continue
        for e in entries:
            seen += 1
            if seen > most_entries:
                issues.add("truncated")
                todo = []
                break
            path = f"{here}/{e.name}" if here else e.name
            wanted = e.name.endswith(".jsonl") and (depth == 1 if layout == "flat" else e.name.startswith("rollout-"))
            if e.is_symlink():
                issues.add("link")
            elif e.is_dir(follow_symlinks=False):
                if layout == "deep" or depth == 0:
                    todo.append((path, depth + 1))
            elif wanted and e.is_file(follow_symlinks=False):
                known = e.stat(follow_symlinks=False)
                found.append((path, known.st_size, known.st_mtime, known.st_ino))
    return spark.createDataFrame(sorted(found), "path string, size long, modified_at double, inode long"), sorted(issues)


def epoch_of(stamp: Column) -> Column:
    """Epoch seconds of an ISO-8601 text; without a zone it is UTC, and malformed text is null."""
    shaped = stamp.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$")
    zoned = F.when(stamp.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), stamp).otherwise(F.concat(stamp, F.lit("Z")))
    spelled = F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(shaped, F.unix_micros(F.try_to_timestamp(spelled)) / 1e6)


def message_usage(lines: DataFrame) -> DataFrame:
    """Dialect A: (path, at, session, project, message_id, model, stop_reason, aside, tokens, counted).

    Tokens are the sum of four counters; a negative counter rejects the record and a record without usage has none.
    """
    e = F.from_json("value", MESSAGE_LINE)
    usage = F.coalesce("e.message.usage", "e.usage")
    rows = lines.select("path", e.alias("e")).where("e is not null").select("path", "e", usage.alias("u"))
    parts = [F.col(f"u.{f.name}") for f in _usage.fields]
    negative = F.coalesce(F.least(*[F.coalesce(p, F.lit(0)) for p in parts]) < 0, F.lit(False))
    total = sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))
    known = F.coalesce(*parts).isNotNull()
    return rows.where(~negative).select(
        "path", epoch_of(F.col("e.timestamp")).alias("at"), F.col("e.sessionId").alias("session"), F.col("e.cwd").alias("project"),
        F.col("e.message.id").alias("message_id"), F.col("e.message.model").alias("model"), F.col("e.message.stop_reason").alias("stop_reason"),
        F.coalesce("e.isSidechain", F.lit(False)).alias("aside"), F.when(known, total).alias("tokens"), known.alias("counted"),
    )


def counter_usage(lines: DataFrame) -> DataFrame:
    """Dialect B: (path, at, kind, turn_id, cwd, cumulative) of counter and turn events."""
    e = F.from_json("value", COUNTER_LINE)
    rows = lines.select("path", e.alias("e")).where("e is not null and e.payload is not null")
    return rows.select(
        "path", epoch_of(F.col("e.timestamp")).alias("at"), F.coalesce("e.payload.type", "e.type").alias("kind"), F.col("e.payload.turn_id").alias("turn_id"),
        F.col("e.payload.cwd").alias("cwd"), F.col("e.payload.info.total_token_usage.total_tokens").alias("cumulative"),
    )


def newest_logs(listing: DataFrame, *, provider: str, modified: str, most: int = 128) -> DataFrame:
    """The newest logs of each provider, ties by path."""
    place = F.row_number().over(Window.partitionBy(provider).orderBy(F.desc(modified), "path"))
    return listing.withColumn("place", place).where(F.col("place") <= most).drop("place")


def fresh_logs(listing: DataFrame, *, modified: str, now: Column, days: int = 7) -> DataFrame:
    return listing.where(F.col(modified) >= now - days * 86_400)


PACKET_KEYS = ("activity", "count", "focused", "kind", "nonce", "sequence")
PACKET = "nonce string, sequence bigint, kind string, focused boolean, count bigint, activity boolean"


def packets(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """Closed schema: exactly the known keys, all of the right type and range; anything else is dropped."""
    keys = F.array_sort(F.json_object_keys(value))
    exact = F.coalesce(keys == F.array(*map(F.lit, PACKET_KEYS)), F.lit(False)) & (F.octet_length(value) <= 1024)
    rows = lines.where(exact).select(F.from_json(value, PACKET).alias("p")).select("p.*")
    sound = F.col("nonce").isNotNull() & (F.char_length("nonce") <= 128) & (F.col("sequence") > 0) & F.col("kind").isin("focus", "edit", "heartbeat", "gap")
    return rows.where(sound & F.col("focused").isNotNull() & (F.col("count") >= 0))


def rule_files(files: DataFrame, names: list[str]) -> DataFrame:
    """(project, text): all of the named rule files that a project has, in the order of ``names``, each under a line with its
    name; blank files don't count, and a project without any has no row.  ``files`` has (project, path, text)."""
    body = F.regexp_replace("text", r"^\s+|\s+$", "")
    order = F.array_position(F.array(*map(F.lit, names)), F.col("path"))
    rows = files.where(F.col("path").isin(*names) & (body != "")).select("project", order.alias("at"), F.concat(F.lit("===== "), "path", F.lit(" =====\n"), body).alias("part"))
    one = rows.groupBy("project", "at").agg(F.max("part").alias("part"))  # a name is in a project once
    parts = F.array_sort(F.collect_list(F.struct("at", "part")))
    return one.groupBy("project").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("text"))


def nearest_image(paths: DataFrame, ranked_names: list[str], *, depth: int = 3) -> DataFrame:
    """(project, path): a project's logo, by the rank of its name, then by how deep it lies."""
    order = F.create_map(*[x for i, n in enumerate(ranked_names) for x in (F.lit(n), F.lit(i))])
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    deep = F.size(F.split("path", "/")) - 1
    rows = paths.where((deep <= depth) & name.isin(*ranked_names))
    return rows.groupBy("project").agg(F.min_by("path", F.struct(F.element_at(order, name), deep, "path")).alias("path"))


def manifest_targets(text: str) -> list[tuple[str, str]]:
    """(name, path) of the library targets of a build manifest; read on the driver, one small file a project."""
    found = []
    for start in re.finditer(r"\.(?:target|macro)\(", text):
        depth, end = 1, start.end()
        while end < len(text) and depth:
            depth += (text[end] == "(") - (text[end] == ")")
            end += 1
        body = text[start.end() : end]
        name, path = (re.search(rf'{field}:\s*"([^"]+)"', body) for field in ("name", "path"))
        if name:
            found.append((name[1], path[1] if path else f"Sources/{name[1]}"))
    return found


def remote_of_config(text: str) -> str | None:
    """The url of the remote named origin in a repository's configuration text."""
    section = re.search(r'\[remote "origin"\](.*?)(?=^\[|\Z)', text, re.S | re.M)
    url = section and re.search(r"^\s*url\s*=\s*(\S+)", section[1], re.M)
    return url[1] if url else None


def status_paths(lines: DataFrame, *, value: str = "value", own: str = "") -> DataFrame:
    """(project, path): changed paths of ``status --porcelain`` lines, a rename by where it went; paths below ``own`` are left out."""
    entry = F.substring(F.col(value), 4, 2**30)
    path = F.when(F.instr(entry, " -> ") > 0, F.substring(entry, F.instr(entry, " -> ") + 4, F.lit(2**30))).otherwise(entry)
    rows = lines.select("project", path.alias("path")).where("path <> ''")
    return (rows.where(~F.col("path").startswith(own)) if own else rows).distinct()


def recent_paths(lines: DataFrame, *, value: str = "value", own: str = "") -> DataFrame:
    """(project, path): paths that ``log --name-only`` with an empty format names."""
    rows = lines.select("project", F.trim(value).alias("path")).where("path <> ''")
    return (rows.where(~F.col("path").startswith(own)) if own else rows).distinct()


def blame_times(output: DataFrame, *, text: str = "text") -> DataFrame:
    """(path, line, author_time) from ``blame --porcelain`` output, one text a file.

    A header has a hash of 40 digits, the original and the final line; the author-time that follows before the next header
    belongs to it.  A commit that comes again has none of its own, and its lines none.
    """
    lines = output.select("path", F.posexplode(F.split(text, "\r?\n")).alias("at", "line"))
    header = r"^[0-9a-fA-F]{40} \d+ (\d+)"
    marks = lines.select(
        "path", "at", F.regexp_extract("line", header, 1).try_cast("int").alias("number"),
        F.regexp_extract("line", r"^author-time (-?\d+(\.\d+)?)$", 1).try_cast("double").alias("seconds"),
    ).where("number is not null or seconds is not null")
    before = Window.partitionBy("path").orderBy("at")  # the lines of one file
    placed = marks.withColumns({"line": F.lag("number").over(before)}).where("seconds is not null and line is not null")
    return placed.groupBy("path", "line").agg(F.max_by("seconds", "at").alias("author_time"))


def present_agents(homes: DataFrame, markers: dict[str, list[str]]) -> DataFrame:
    """(home, agent): agents of which a home has one of the marker paths, by name; ``homes`` has (home, path) of what exists."""
    pairs = homes.sparkSession.createDataFrame([(agent, path) for agent, paths in markers.items() for path in paths], "agent string, path string")
    return homes.join(F.broadcast(pairs), "path").select("home", "agent").distinct()  # a fixed list of markers
