"""Tokens, terms, identifiers and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about which file is meant.
STOPWORDS = (
    "the", "a", "an", "to", "of", "in", "on", "for", "and", "or", "is",
    "fix", "update", "change", "add", "remove", "make", "please", "code",
    "file", "files", "function", "method", "class", "this", "that", "with",
    "it", "its", "them", "they", "me", "my", "you", "your", "we", "our",
    "수정", "변경", "추가", "삭제", "고쳐", "고쳐줘", "해줘", "관련", "기능",
)
# File extension to language; extensions of text files that count as references.
LANGUAGES = {
    "swift": "swift", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java",
    "kt": "kotlin", "kts": "kotlin", "c": "c", "h": "cpp", "hpp": "cpp", "hh": "cpp", "cc": "cpp", "cpp": "cpp",
    "cxx": "cpp", "rb": "ruby", "m": "objectiveC", "mm": "objectiveC",
}
TEXT_EXTENSIONS = ("md", "txt", "json", "yaml", "yml", "toml", "xml", "html", "css", "sql", "sh")
REFERENCE = r"([\p{L}\p{N}_./-]+\.[\p{L}\p{N}_-]+)"
MARKER = r"(^|[^\p{L}\p{N}_])(TODO|FIXME|HACK|XXX)([^\p{L}\p{N}_]|$)"
# Spellings of an unknown model, and what is shown for them.
UNKNOWN_MODELS = ("", "unknown", "unknown model", "unknown-model", "unknown_model", "(unknown)", "모델 미상", "미상")
UNKNOWN_MODEL = "모델 미상"
CODE_CHARACTERS, PROSE_CHARACTERS = 3.6, 4.0  # fixed values: characters a token


def subwords(text: Column) -> Column:
    """Lower-case words of an identifier, path or phrase; digits make no boundary (jwt2Helper is one word)."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.transform(F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda w: w != ""), F.lower)


def query_terms(text: Column) -> Column:
    """Distinct subwords of two or more characters that are no stop words, in order of first use."""
    return F.array_distinct(F.filter(subwords(text), lambda w: (F.char_length(w) >= 2) & ~w.isin(*STOPWORDS)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def language_of(path: Column) -> Column:
    pairs = [F.lit(x) for item in LANGUAGES.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(path)), F.lit("unknown"))


def file_references(text: Column) -> Column:
    """Path-like words: with a slash, a source extension or a text extension (a dotted symbol is none)."""
    known = [*LANGUAGES, *TEXT_EXTENSIONS]
    return F.filter(
        F.regexp_extract_all(text, F.lit(REFERENCE), 1),
        lambda r: r.contains("/") | F.lower(F.regexp_extract(r, r"\.([^.]*)$", 1)).isin(*known),
    )


def without_references(text: Column) -> Column:
    return F.aggregate(file_references(text), text, lambda acc, r: F.replace(acc, r, F.lit(" ")))


def path_stem(path: Column) -> Column:
    """Name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"^(.+)\.[^.]*$", "$1")


def module_stem(module: Column) -> Column:
    parts = F.filter(F.split(module, r"[/.:]"), lambda p: p != "")
    return F.lower(F.coalesce(F.try_element_at(parts, F.lit(-1)), module))


def is_code(language: Column) -> Column:
    return F.coalesce(language, F.lit("unknown")) != "unknown"


def estimated_tokens(characters: Column, language: Column) -> Column:
    per = F.when(is_code(language), CODE_CHARACTERS).otherwise(PROSE_CHARACTERS)
    return F.when(characters > 0, F.ceil(characters / per)).otherwise(0).cast("long")


def has_marker(line: Column) -> Column:
    return line.rlike(MARKER)


def identifiers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1))


def model_name(model: Column) -> Column:
    trimmed = F.trim(model)
    return F.when(trimmed.isNull() | F.lower(trimmed).isin(*UNKNOWN_MODELS), UNKNOWN_MODEL).otherwise(trimmed)


def safe_label(value: Column, fallback: str) -> Column:
    cleaned = F.substring(F.regexp_replace(value, r"\p{Cc}", ""), 1, 100)
    return F.when(F.coalesce(F.char_length(cleaned), F.lit(0)) == 0, fallback).otherwise(cleaned)


def short_digest(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 12)


def normalized_remote(url: Column) -> Column:
    """One spelling for a repository address: no scheme or user, slashes, no .git, lower case."""
    out = F.trim(url)
    out = F.regexp_replace(out, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    out = F.regexp_replace(out, r"^git@", "")
    out = F.replace(out, F.lit(":"), F.lit("/"))
    out = F.regexp_replace(F.regexp_replace(out, r"/+$", ""), r"\.git$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(out, r"/+", "/"), r"/+$", ""))


def decoded_directory(name: Column) -> Column:
    return F.translate(name, "-", "/")


def abbreviated(tokens: Column) -> Column:
    """Approximate size with one decimal and K, M or B."""
    value = tokens.cast("double")
    one = lambda by, unit: F.concat(F.lit("~"), F.format_string("%.1f", value / by), F.lit(unit))
    return (
        F.when(tokens < 1_000, F.concat(F.lit("~"), tokens.cast("string")))
        .when(tokens < 1_000_000, one(1e3, "K"))
        .when(tokens < 1_000_000_000, one(1e6, "M"))
        .when(tokens.isNotNull(), one(1e9, "B"))
    )


def compact(value: Column) -> Column:
    """As ``abbreviated`` to the trillions, a dash for no value and an exponent (1.2e15) from 1e15."""
    v = value.cast("double")
    one = lambda by, unit: F.concat(F.format_string("%.1f", v / by), F.lit(unit))
    return (
        F.when(value.isNull(), "—")
        .when(v >= 1e15, F.replace(F.format_string("%.1e", v), F.lit("e+"), F.lit("e")))
        .when(v >= 1e12, one(1e12, "T"))
        .when(v >= 1e9, one(1e9, "B"))
        .when(v >= 1e6, one(1e6, "M"))
        .when(v >= 1e3, one(1e3, "K"))
        .otherwise(value.cast("string"))
    )


def saturating_sum(values: Column) -> Column:
    """Aggregate: sum of non-negative parts, held at the greatest long; null where no value is known."""
    total = F.sum(F.greatest(values, F.lit(0)).cast("decimal(38,0)"))
    return F.least(total, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")


def saturating_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(F.greatest(a, F.lit(0).cast("long")), F.greatest(b, F.lit(0).cast("long"))), F.lit(2**63 - 1))


def korean_count(tokens: Column) -> Column:
    """Count in units of ten thousand and a hundred million, whole or with one decimal; grouped digits below."""

    def unit(by: float, name: str) -> Column:
        tenths = F.round(tokens / by * 10).cast("long")
        whole = F.floor(tenths / 10).cast("string")
        return F.concat(F.when(tenths % 10 == 0, whole).otherwise(F.concat(whole, F.lit("."), (tenths % 10).cast("string"))), F.lit(name))

    return F.when(tokens >= 100_000_000, unit(1e8, "억")).when(tokens >= 10_000, unit(1e4, "만")).otherwise(F.format_number(tokens, 0))


def human_age(seconds: Column) -> Column:
    """Age in years, months or days."""
    days = F.floor(seconds / 86_400)
    part = lambda by, unit: F.concat(F.floor(days / by).cast("string"), F.lit(unit))
    return F.when(days >= 365, part(365, "년")).when(days >= 30, part(30, "개월")).when(days >= 1, part(1, "일")).otherwise("오늘")


def day_comparison(today: Column, before: Column) -> Column:
    """Change against the day before in percent, halves to even, over 999 as such; nothing known, nothing said."""
    percent = (F.try_divide(today.cast("double"), before) - 1) * 100
    shown = F.bround(percent).cast("long")
    return (
        F.when(today.isNull() | before.isNull(), "전일 비교 기록 없음")
        .when((before <= 0) & (today == 0), "전일과 동일")
        .when(before <= 0, "전일 0 · 오늘 기록 있음")
        .when(percent > 999, "전일 전체 대비 +999% 초과")
        .otherwise(F.concat(F.lit("전일 전체 대비 "), F.format_string("%+d", shown), F.lit("%")))
    )
