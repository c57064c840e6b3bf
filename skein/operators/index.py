"""Indexing: declarations and imports of sources, change detection and the merged index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan

_NAME, _DOTTED, _JS = r"([A-Za-z_][A-Za-z0-9_]*)", r"([A-Za-z_][A-Za-z0-9_.]*)", r"([A-Za-z_$][A-Za-z0-9_$]*)"
_INCLUDE = r'^\s*#\s*include\s*[<"]([^>"]+)[>"]'
#: A definition of the C family: a type, the name and its parameters, with no semicolon after.
C_FUNCTION = r"^[A-Za-z_][A-Za-z0-9_\s\*]*[\s\*]([A-Za-z_][A-Za-z0-9_]*)\s*\([^;]*$"
C_CONTROL = r"^\s*(?:if|else|while|for|switch|return|do|case|sizeof)\b"
_JS_RULES = (
    ("import", r"""^\s*import\b.*?from\s+['"]([^'"]+)['"]"""), ("import", r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)"""),
    ("type", rf"\b(?:class|interface|type|enum)\s+{_JS}"), ("function", rf"\bfunction\s+{_JS}"),
)
_JVM_RULES = (("import", rf"^\s*import\s+{_DOTTED}"), ("type", rf"\b(?:class|interface|enum)\s+{_NAME}"), ("function", rf"\bfun\s+{_NAME}"))
# What declares a symbol or an import in each language; the first rule that matches a line counts.
RULES: dict[str, tuple[tuple[str, str], ...]] = {
    "swift": (
        ("import", rf"^\s*import\s+{_DOTTED}"), ("type", rf"\b(?:class|struct|enum|protocol|actor|extension)\s+{_NAME}"),
        ("function", rf"\bfunc\s+{_NAME}"),
    ),
    "python": (
        ("import", rf"^\s*(?:import|from)\s+{_DOTTED}"), ("type", rf"^\s*class\s+{_NAME}"),
        ("function", rf"^\s*(?:async\s+)?def\s+{_NAME}"),
    ),
    "javascript": _JS_RULES,
    "typescript": _JS_RULES,
    "go": (
        ("import", r"""^\s*import\s+(?:\w+\s+)?['"]([^'"]+)['"]"""), ("type", rf"\btype\s+{_NAME}"),
        ("function", rf"\bfunc\s+(?:\([^)]*\)\s+)?{_NAME}"),
    ),
    "rust": (
        ("import", r"^\s*use\s+([A-Za-z_][A-Za-z0-9_:]*)"), ("type", rf"\b(?:struct|enum|trait)\s+{_NAME}"),
        ("function", rf"\bfn\s+{_NAME}"),
    ),
    "java": _JVM_RULES,
    "kotlin": _JVM_RULES,
    "c": (("import", _INCLUDE), ("type", rf"\b(?:struct|enum|union)\s+{_NAME}\s*\{{"), ("function", C_FUNCTION)),
    "cpp": (("import", _INCLUDE), ("type", rf"\b(?:class|struct|enum|union|namespace)\s+{_NAME}\s*[:{{]"), ("function", C_FUNCTION)),
    "ruby": (
        ("import", r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]"""), ("type", r"^\s*(?:class|module)\s+([A-Z][A-Za-z0-9_]*)"),
        ("function", r"^\s*def\s+(?:self\.)?([A-Za-z_][A-Za-z0-9_]*[?!=]?)"),
    ),
    "objectiveC": (
        ("import", r'^\s*#\s*(?:import|include)\s*[<"]([^>"]+)[>"]'), ("type", rf"^\s*@(?:interface|implementation|protocol)\s+{_NAME}"),
        ("function", rf"^\s*[-+]\s*\([^)]*\)\s*{_NAME}"), ("function", C_FUNCTION),
    ),
}


def _first_rule(line: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    found = F.lit(None).cast("struct<kind:string,name:string>")
    for kind, pattern in reversed(rules):
        hit = line.rlike(pattern)
        if pattern == C_FUNCTION:
            hit = hit & ~line.rlike(C_CONTROL)
        found = F.when(hit, F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, pattern, 1).alias("name"))).otherwise(found)
    return found


def declarations(sources: DataFrame) -> DataFrame:
    """(file_id, line, kind, name): imports, types and functions of (file_id, language, text), at most one a line.

    Unknown languages and missing texts declare nothing.  Lines are split and matched in the JVM.
    """
    lines = sources.where(F.col("language").isin(*RULES)).select("file_id", "language", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    found = F.lit(None).cast("struct<kind:string,name:string>")
    for language, rules in RULES.items():
        found = F.when(F.col("language") == language, _first_rule(F.col("text"), rules)).otherwise(found)
    return lines.select("file_id", (F.col("at") + 1).cast("int").alias("line"), found.alias("d")).where("d is not null").select("file_id", "line", "d.kind", "d.name")


def change_status(scanned: DataFrame, existing: DataFrame, *, force: bool = False) -> DataFrame:
    """(path, status): new, deleted, unchanged (size and time alike), touched (same content) or changed.

    Both sides have (path, byte_size, modified_at, content_hash), one row a path; ``force`` sets the first two
    shortcuts aside.
    """
    new = scanned.select("path", *[F.col(c).alias(f"new_{c}") for c in ("byte_size", "modified_at", "content_hash")], F.lit(True).alias("in_new"))
    old = existing.select("path", "byte_size", "modified_at", "content_hash", F.lit(True).alias("in_old"))
    same = F.col("byte_size").eqNullSafe(F.col("new_byte_size")) & F.col("modified_at").eqNullSafe(F.col("new_modified_at"))
    status = (
        F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "deleted")
        .when(same & F.lit(not force), "unchanged")
        .when(F.col("content_hash").eqNullSafe(F.col("new_content_hash")) & F.lit(not force), "touched").otherwise("changed")
    )
    return new.join(old, "path", "full").select("path", status.alias("status"))


def merged_index(scanned: DataFrame, existing: DataFrame) -> DataFrame:
    """The index after a scan: scanned rows, a file that is not new keeping its id; vanished files are gone.

    New files get the ids above the greatest one in order of a hash of their path, then the path.  They are numbered over a
    range partitioning that is written once, so the ids stay the same however often the result is read.
    """
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    joined = scanned.drop("id").join(existing.select("path", "id"), "path", "left")
    fresh = scan.parted(joined.where("id is null").drop("id").withColumn("__hash", F.xxhash64("path")), [], ["__hash", "path"])
    before = Window.orderBy(scan.PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    starts = fresh.groupBy(scan.PART).agg(F.min(scan.ROW).alias("__first"), F.count(F.lit(1)).alias("__n"))
    starts = starts.select(scan.PART, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    number = F.col(scan.ROW) - F.col("__first") + F.col("__before") + 1 + top
    numbered = fresh.join(starts, scan.PART).withColumn("id", number).select(*joined.columns)
    return joined.where("id is not null").unionByName(numbered)


def without_deleted(children: DataFrame, deleted: DataFrame, *, key: str = "file_id") -> DataFrame:
    """Child rows (symbols, imports) whose file is still there."""
    return children.join(deleted.select(F.col("id").alias(key)), key, "left_anti")


def index_counts(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(kind, n): rows of each of the three tables."""
    one = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one(files, "files").unionByName(one(symbols, "symbols")).unionByName(one(imports, "imports"))


def index_statistics(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


def top_symbols(symbols: DataFrame, *, most: int = 2000) -> DataFrame:
    """(name, n): the most frequent symbol names, ties by name."""
    return symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(most)


def symbols_of_paths(files: DataFrame, symbols: DataFrame, paths: list[str]) -> DataFrame:
    """(path, line, name, kind) of the named files, by line; the path list reaches the scan of files."""
    chosen = files.where(F.col("path").isin(*paths)).select(F.col("id").alias("file_id"), "path")
    return symbols.join(chosen, "file_id").select("path", "line", "name", "kind").orderBy("path", "line")
