"""Telling hand-written source from generated, minified, vendored and data files by indexed facts and layout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Directory names under which package managers and code generators put files.
VENDOR_DIRS = (
    "node_modules", "bower_components", "jspm_packages", "vendor", "vendored", "third_party", "third-party", "thirdparty",
    "3rdparty", "external", "externals", "deps", "site-packages", "dist-packages", "Pods", "Checkouts", "Carthage",
)
OUTPUT_DIRS = ("__generated__", "generated", "gen", "DerivedSources", "DerivedData", ".build", "dist", "generated-sources")

_names = lambda names: "|".join(n.replace(".", r"\.").replace("-", r"\-") for n in names)
VENDOR_PATH = rf"(^|/)({_names(VENDOR_DIRS)})/[^/]+/"
OUTPUT_PATH = rf"(^|/)({_names(OUTPUT_DIRS)}|target/codegen)/"
PACKAGE = rf"(?:^|/)(?:{_names(VENDOR_DIRS)})/(?:Checkouts/|lib/)?([^/]+)/"
GENERATED_NAME = r"(\.(pb|g|gen|generated|freezed|designer)\.\w+|_pb2(_grpc)?\.pyi?|[a-z]Grpc\.java|_generated\.\w+)$"
BUNDLE_NAME = r"(\.min\.\w+|[.\-](bundle|chunk)\.\w+|\.[0-9a-f]{6,}\.(js|ts|css|mjs))$"
RELEASE_NAME = r"[A-Za-z][\w.\-]*-v?\d+\.\d+(\.\d+)*\.\w+$"
#: What a generator writes at the start of a comment line; a mention inside a sentence does not begin that way.
GENERATOR_LINE = (
    r"(?im)^\s*(//|#|--|/\*+!?|\*|;|<!--)\s*("
    r"code generated (by|from)\b|@?(auto[- ]?)?generated by\b|<auto-?generated|auto-?generated (file|code|by|from)\b|@generated\b"
    r"|(this )?(file|code|class) (was|is|has been) (auto(matically)?[- ]?)?(generated|created by a tool|produced by a tool)\b"
    r"|produced by \S+ [\d.]+ *; *regenerate|do not edit\b|automatisch (erzeugt|generiert)\b|자동 ?생성된 파일)"
)
#: A licence banner: name, version, copyright or licence in the first comment.
BANNER_LINE = r"(?i)^\s*(//|#|--|/\*+!?|;)\s*[\w.\-]+ v?\d+\.\d+(\.\d+)*\s*\|\s*\(c\).*licen[sc]e"


NUMBER = r"^(0x[0-9a-fA-F]+|[0-9]+(\.[0-9]+)?)$"
ENCODED = r"([0-9a-fA-F]{32,}|[A-Za-z0-9+/]{60,})"


@dataclass(frozen=True)
class Layout:
    """Thresholds for one language: what hand-written code of it stays under."""

    mean_line: float = 56.0  # bytes a line over the whole file
    longest_line: int = 90  # characters, within the head
    dense_whitespace: float = 0.12  # a head line that long with less white space is packed
    statement_share: float = 0.025  # ';', '{' and '}' a character in a packed head
    numbers: float = 0.08  # numeric literals a character
    alphanumeric: float = 0.85  # a head with more, and with a stretch without white space that long, is an encoded run
    unbroken: int = 60
    encoded_run: int = 40  # characters of hexadecimal or base64 without a break


#: Languages written with longer lines get wider limits.
LAYOUTS = {
    "java": Layout(mean_line=60.0, longest_line=100),
    "kotlin": Layout(mean_line=60.0, longest_line=100),
    "swift": Layout(mean_line=60.0, longest_line=100),
    "objectiveC": Layout(mean_line=64.0, longest_line=110),
    "python": Layout(mean_line=54.0, statement_share=0.03),
    "ruby": Layout(mean_line=54.0, statement_share=0.03),
}
#: A file of this size or length without one declaration is not code.
BARREN_BYTES, BARREN_LINES = 2048, 64


def layout_statistics(head: Column) -> dict[str, Column]:
    """Layout of a text: missing and empty texts give zeros."""
    text = F.coalesce(head, F.lit(""))
    size = F.length(text)
    share = lambda kept: F.when(size > 0, F.length(F.regexp_replace(text, kept, "")) / size).otherwise(0.0)
    many = lambda pattern: F.when(size > 0, F.regexp_count(text, F.lit(pattern)) / size).otherwise(0.0)
    lengths = F.transform(F.split(text, "\n"), lambda line: F.length(line))
    longest = lambda pattern: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda r: F.length(r))), F.lit(0))
    return {
        "longest_line": F.array_max(lengths),
        "mean_line": F.when(size > 0, size / F.size(lengths)).otherwise(0.0),
        "whitespace": share(r"\S"),
        "alphanumeric": share(r"[^\p{L}\p{N}]"),
        "numbers": F.when(size > 0, F.size(F.filter(F.regexp_extract_all(text, F.lit(r"([\w.]+)"), 1), lambda w: w.rlike(NUMBER))) / size).otherwise(0.0),
        "statements": many(r"[;{}]"),
        "encoded_run": longest(ENCODED),
        "unbroken": longest(r"(\S+)"),
    }


def _limit(language: Column, field: str) -> Column:
    found = F.lit(getattr(Layout(), field))
    for name, layout in LAYOUTS.items():
        found = F.when(language == name, F.lit(getattr(layout, field))).otherwise(found)
    return found


def file_origins(files: DataFrame, heads: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, origin, evidence): generated, bundled, vendored, data or written, one row per file id.

    ``layout`` is looked at first: statistics of the head and the bytes a line of the whole file against thresholds per
    language, and, where neither head nor lengths are known, a size that hand-written code never has without one
    declaration.  Generated and vendored code is often laid out as code by hand is, which no threshold can tell; what
    layout leaves is found by its ``path`` (whole components and name endings that package managers, generators and
    bundlers use) or the ``marker`` line that a generator or a release opens a file with.  A file with no evidence is
    written by hand, also when every column but its id is missing; its evidence is null.

    Files written twice count once (the row indexed last); files without an id give no row.  Heads: the longest of
    repeated rows counts.
    """
    f = files.where("id is not null").groupBy(F.col("id").alias("file_id")).agg(
        F.max(F.struct("indexed_at", "path", "language", "byte_size", "line_count")).alias("f")
    ).select("file_id", "f.*")
    h = heads.groupBy("file_id").agg(F.max_by("head_text", F.length("head_text")).alias("head"))
    s = symbols.where("file_id is not null").groupBy("file_id").agg(F.count(F.lit(1)).alias("declared"))
    rows = f.join(h, "file_id", "left").join(s, "file_id", "left").withColumns({
        "path": F.coalesce("path", F.lit("")),
        "declared": F.coalesce("declared", F.lit(0)),
        "line_bytes": F.when((F.col("line_count") > 0) & (F.col("byte_size") >= 0), F.col("byte_size") / F.col("line_count")),
        "headless": F.coalesce(F.length(F.trim("head")), F.lit(0)) == 0,
        "package": F.regexp_extract("path", PACKAGE, 1),
        "stem": F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.\w+$", ""),
        "vendor_dir": F.col("path").rlike(VENDOR_PATH),
    }).withColumns({f"h_{name}": c for name, c in layout_statistics(F.col("head")).items()})

    packages = rows.where("vendor_dir and package <> ''").groupBy(F.col("package").alias("stem")).agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.join(packages.where("copies > 1"), "stem", "left")

    over = lambda field, column: F.coalesce(F.col(column) > _limit(F.col("language"), field), F.lit(False))
    dense = over("mean_line", "line_bytes")
    packed = over("longest_line", "h_longest_line") & (F.col("h_whitespace") < _limit(F.col("language"), "dense_whitespace")) & over("statement_share", "h_statements")
    encoded = over("encoded_run", "h_encoded_run") | over("numbers", "h_numbers") | (over("alphanumeric", "h_alphanumeric") & over("unbroken", "h_unbroken"))
    barren = (F.col("declared") == 0) & F.col("headless") & (
        F.coalesce(F.col("byte_size") >= BARREN_BYTES, F.lit(False)) | F.coalesce(F.col("line_count") >= BARREN_LINES, F.lit(False))
    )
    head, path = F.coalesce("head", F.lit("")), F.col("path")
    by_layout = F.when(packed, "bundled").when(encoded, "data").when(dense & (F.col("declared") > 0), "bundled").when(dense | barren, "data")
    by_path = (
        F.when(F.col("vendor_dir"), "vendored").when(path.rlike(OUTPUT_PATH) | path.rlike(GENERATED_NAME), "generated").when(path.rlike(BUNDLE_NAME), "bundled")
        .when(path.rlike(rf"(^|/){RELEASE_NAME}") | (F.col("headless") & F.col("copies").isNotNull()), "vendored")
    )
    by_marker = F.when(head.rlike(GENERATOR_LINE), "generated").when(head.rlike(BANNER_LINE), "vendored")
    evidence = F.when(by_layout.isNotNull(), "layout").when(by_path.isNotNull(), "path").when(by_marker.isNotNull(), "marker")
    return rows.select("file_id", F.coalesce(by_layout, by_path, by_marker, F.lit("written")).alias("origin"), evidence.alias("evidence"))


def not_written_here(files: DataFrame, heads: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id): files that nobody wrote by hand in their project."""
    return file_origins(files, heads, symbols).where("evidence is not null").select("file_id")
