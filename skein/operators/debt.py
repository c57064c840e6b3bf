"""Code debt: stale markers, branches, duplicate bodies, untested files."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import test_path

HASH_LANGUAGES = ("python", "ruby")
BRANCH_WORDS = r"(?<![\p{L}_])(if|for|while|case|catch|guard|elif|except|rescue|when)(?![\p{L}_])"
BRANCH_SIGNS = r"(&&|\|\|| \? )"
DEBT_KINDS = ("todo", "complexity", "duplicate", "untested")
MIN_LINES, MIN_CHARACTERS = 5, 40  # fixed values: smaller bodies are no clones
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"  # category Zs, as SQL's trim takes off

#: Strings (with escapes, up to their end or the text's), then comments: blanked in this order of appearance.
_STRING = r'"(?:\\.|[^"\\])*(?:"|\z)|\'(?:\\.|[^\'\\])*(?:\'|\z)'
SLASH_CODE = rf"(?s)({_STRING})|//[^\n]*|/\*.*?(?:\*/|\z)"
HASH_CODE = rf"(?s)({_STRING})|#[^\n]*"
#: The same strings for Java, whose loops over a group with branches recurse for each turn unless they are possessive.  No turn
#: given back could end a string, so the matches are the same; a string may be of any length.
_LOOPED = {quote: rf"{quote}(?:[^{quote}\\]++|\\.)*+(?:{quote}|\z)" for quote in "\"'"}
_SLASH, _HASH = r"//[^\n]*|/\*.*?(?:\*/|\z)", r"#[^\n]*"
#: The only texts in which a quote may begin no string; each such quote would be tried up to the end of the text.
_CUT = r"(?<!\\)(?:\\\\)*+\\\z"


def code_only(text: Column, language: Column) -> Column:
    """Source without string literals and comments; line breaks after line comments stay.

    A scan from left to right is what one alternation of 'string or comment' does, so no Python is needed.
    """
    hashed = F.coalesce(language.isin(*HASH_LANGUAGES), F.lit(False))
    return F.when(hashed, _stripped(text, _HASH)).otherwise(_stripped(text, _SLASH))


def _stripped(text: Column, comments: str) -> Column:
    """A text that ends within an escape is cut before the first quote that ends nowhere, of either kind.

    After a quote that ends nowhere none of its kind ends: escapes are the same from whichever quote they are counted.
    """

    def without(part: Column, quotes: str) -> Column:
        return F.regexp_replace(part, "(?s)" + "|".join([*(_LOOPED[q] for q in quotes), comments]), "")

    def scan(quotes: str) -> str:
        return "(?:" + "|".join([f"[^{quotes}/#]++", *(_LOOPED[q] for q in quotes), comments, "[/#]"]) + ")*+"

    parts = rf"""(?s)\A({scan("\"'")})("{scan("'")}|'{scan('"')}|)(.*)\z"""
    first, second, third = (F.regexp_extract(text, parts, n) for n in (1, 2, 3))
    one_kind = F.when(second.startswith('"'), without(second, "'")).otherwise(without(second, '"'))
    cut = text.endswith("\\") & text.rlike(_CUT)
    return F.when(cut, F.concat(without(first, "\"'"), one_kind, without(third, ""))).otherwise(without(text, "\"'"))


def branch_count(code: Column) -> Column:
    """Decisions in stripped code: branch words and short-circuit or conditional signs."""
    return (F.regexp_count(code, F.lit(BRANCH_WORDS)) + F.regexp_count(code, F.lit(BRANCH_SIGNS))).cast("long")


def body_lines(code: Column) -> Column:
    """Lines that aren't blank, without the spaces around them."""
    return F.filter(F.transform(F.split(code, "\n"), lambda x: F.trim(x, F.lit(SPACES))), lambda x: x != "")


def body_digest(code: Column) -> Column:
    """Digest of a body without its first line, spaces and blank lines; null if it is too small to matter."""
    lines = body_lines(code)
    rest = F.replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), "\n"), F.lit(" "))
    return F.when((F.size(lines) >= MIN_LINES) & (F.char_length(rest) >= MIN_CHARACTERS), F.sha2(F.concat_ws(":", F.size(lines).cast("string"), rest), 256))


def duplicate_groups(bodies: DataFrame, *, digest: str, order: Sequence[str], lines: str) -> DataFrame:
    """(digest, copies, first..., severity): bodies that occur more than once; the first by ``order`` stands for the group.

    Members are counted and the least one is kept; they are never gathered.
    """
    least = F.min(F.struct(*order, lines))
    groups = bodies.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count(F.lit(1)).alias("copies"), least.alias("first")).where("copies > 1")
    return groups.select(digest, "copies", *[F.col(f"first.{c}").alias(c) for c in order], (F.col(f"first.{lines}") * (F.col("copies") - 1)).alias("severity"))


def untested_files(files: DataFrame, symbols: DataFrame, mentioned: DataFrame, roots: Sequence[str] = ()) -> DataFrame:
    """(id): source files under the library roots of which tests mention no declared symbol.

    ``mentioned`` has (project, name), the identifiers of the project's test files.  Files without a declaration have
    nothing to test.  Without roots every source file counts.
    """
    source = files.where(~test_path(F.col("path")))
    if roots:
        source = source.where(F.col("path").rlike("^(" + "|".join(r.rstrip("/").replace(".", r"\.") for r in roots) + ")/"))
    declared = symbols.select(F.col("file_id").alias("id"), "name").distinct().join(source.select("project", "id"), "id")
    tested = declared.join(mentioned.select("project", "name").distinct(), ["project", "name"], "left_semi").select("id").distinct()
    return declared.select("id").distinct().join(tested, "id", "left_anti")


def stale_markers(markers: DataFrame, blame: DataFrame, *, now: Column, days: int = 90) -> DataFrame:
    """(path, line, age_days): marker lines last touched ``days`` ago or longer; a line without blame is new."""
    age = F.floor((now - F.col("author_time")) / 86_400).cast("long")
    return markers.join(blame, ["path", "line"]).withColumn("age_days", age).where(F.col("age_days") >= days).select("path", "line", "age_days")


def counts_by_kind(items: DataFrame, *, kind: str = "kind") -> DataFrame:
    """(kind, n) for all four kinds, 0 where there is none."""
    kinds = items.sparkSession.createDataFrame([(k,) for k in DEBT_KINDS], "kind string")
    counts = items.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def block_ends(sources: DataFrame, *, key: str = "file_id") -> DataFrame:
    """(key, line, end_line): the end of each declared block; (key, language, text, lines) in, ``lines`` the declarations.

    Brace languages: where depth returns to 0 outside strings and comments; a declaration without a brace within four
    lines is one line, and a block that can't be followed for certain, or is longer than 4,000 lines (a fixed value), runs
    to the end.  Python and Ruby: up to the next
    line that is not indented deeper.  One file is one row here, so the cost is bounded by the file.
    """
    schema = f"{key} long, line int, end_line int"

    def ends(batches):
        for batch in batches:
            rows = []
            for k, language, text, at in zip(batch[key], batch["language"], batch["text"], batch["lines"]):
                lines = text.split("\n") if text is not None and at is not None else ()
                rows += [(k, line, block_end(lines, int(line), language)) for line in (at if lines else ()) if 1 <= line <= len(lines)]
            yield pd.DataFrame(rows, columns=[key, "line", "end_line"])

    return sources.select(key, "language", "text", "lines").mapInPandas(ends, schema)


def block_end(lines: Sequence[str], line: int, language: str | None) -> int:
    """Last line (from 1) of the block declared on ``line``."""
    if language in HASH_LANGUAGES:
        return _indented_end(lines, line)
    return _braced_end(lines, line, language)


def _indent(text: str) -> int:
    lead = text[: len(text) - len(text.lstrip(" \t"))]
    return len(lead) + 3 * lead.count("\t")


def _indented_end(lines: Sequence[str], line: int) -> int:
    base, end = _indent(lines[line - 1]), line
    for number in range(line + 1, len(lines) + 1):
        text = lines[number - 1]
        if text.strip():
            if _indent(text) <= base:
                break
            end = number
    return end


def _braced_end(lines: Sequence[str], line: int, language: str | None, most: int = 4_000) -> int:
    import re

    word = re.compile(r"""//|/\*|\*/|'[A-Za-z_](?!')|["'`{}]""") if language == "rust" else re.compile(r"""//|/\*|\*/|["'`{}]""")
    closers = {'"': re.compile(r'(?:\\.|[^"\\])*"'), "'": re.compile(r"(?:\\.|[^'\\])*'"), "`": re.compile(r"(?:\\.|[^`\\])*`")}
    depth, opened, nested = 0, False, 0
    quote = None
    for number in range(line, min(len(lines), line + most - 1) + 1):
        text, at = lines[number - 1], 0
        while True:
            if quote:
                inside = text[at:]
                done = closers[quote].match(inside)
                body = inside[: done.end()] if done else inside
                if (language == "swift" and re.search(r"(?<!\\)(?:\\\\)*\\\(", body)) or (quote == "`" and "${" in body):
                    return len(lines)  # an expression inside a string needs a real lexer
                if not done:
                    break
                at, quote = at + done.end(), None
                continue
            found = word.search(text, at)
            if not found:
                break
            at, sign = found.end(), found.group()
            if nested:
                nested += (sign == "/*") - (sign == "*/")
            elif sign == "//":
                break
            elif sign == "/*":
                nested = 1
            elif sign in closers:
                quote = sign
            elif sign == "{":
                depth, opened = depth + 1, True
            elif sign == "}":
                depth -= 1
                if opened and depth <= 0:
                    return number
        if not opened and number >= line + 3:
            break
    return len(lines) if opened else line


def outline(files: DataFrame, symbols: DataFrame, *, files_most: int = 5, symbols_most: int = 12) -> DataFrame:
    """(path, line, name): the first symbols of the first files by path, for a display of signatures."""
    from pyspark.sql import Window

    chosen = files.orderBy("path").limit(files_most)
    place = F.row_number().over(Window.partitionBy("path").orderBy("line", "name"))
    rows = symbols.select(F.col("file_id").alias("id"), "line", "name").distinct().join(F.broadcast(chosen.select("id", "path")), "id")
    return rows.withColumn("place", place).where(F.col("place") <= symbols_most).select("path", "line", "name")


def by_severity(items: DataFrame, *, order: Sequence[str]) -> DataFrame:
    """``items`` with ``place`` in their kind, the most severe first, then by the columns of ``order``."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc_nulls_last("severity"), *order)))
