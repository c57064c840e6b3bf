import pytest
from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import paths as P
from skein.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, words", [
    ("LoginService", ["login", "service"]), ("auth/jwt_helper.py", ["auth", "jwt", "helper", "py"]), ("HTTPClient", ["http", "client"]),
    ("jwt2Helper", ["jwt2helper"]), ("", []), ("로그인Service", ["로그인service"]),
])
def test_subwords(spark, text, words):
    assert value(spark, T.subwords(F.lit(text))) == words


def test_null_texts_stay_null(spark):
    nothing = F.lit(None).cast("string")
    for f in (T.subwords, T.query_terms, T.path_stem, T.identifiers, T.normalized_remote, P.rename_target):
        assert value(spark, f(nothing)) is None
    assert value(spark, T.model_name(nothing)) == T.UNKNOWN_MODEL and value(spark, T.safe_label(nothing, "x")) == "x"


def test_terms_and_references(spark):
    assert value(spark, T.query_terms(F.lit("Please fix the Login login of Session"))) == ["login", "session"]
    assert value(spark, T.file_references(F.lit("see src/a.py, Memory.isUnchanged and notes.md"))) == ["src/a.py", "notes.md"]


@pytest.mark.parametrize("path, language", [("a/b.PY", "python"), ("x.hpp", "cpp"), ("Makefile", "unknown"), (".py", "unknown"), ("a.b/c", "unknown")])
def test_language(spark, path, language):
    assert value(spark, T.language_of(F.lit(path))) == language


@pytest.mark.parametrize("path, stem", [("a/b.tar.gz", "b.tar"), (".env", ".env"), ("a/b", "b"), ("a/.x.y", ".x")])
def test_stems(spark, path, stem):
    assert value(spark, T.path_stem(F.lit(path))) == stem


def test_tokens(spark):
    assert value(spark, T.estimated_tokens(F.lit(1200), F.lit("python"))) == 334
    assert value(spark, T.estimated_tokens(F.lit(720), F.lit("swift"))) == 200
    assert value(spark, T.estimated_tokens(F.lit(1200), F.lit("unknown"))) == 300
    assert value(spark, T.estimated_tokens(F.lit(-5), F.lit("python"))) == 0


def test_numbers(spark):
    assert [value(spark, T.compact(F.lit(n).cast("long"))) for n in (None, 999, 1500, 2_500_000, 3 * 10**12)] == ["—", "999", "1.5K", "2.5M", "3.0T"]
    assert value(spark, T.saturating_add(F.lit(2**63 - 2), F.lit(5).cast("long"))) == 2**63 - 1
    assert value(spark, T.saturating_add(F.lit(-9).cast("long"), F.lit(5).cast("long"))) == 5
    assert [value(spark, T.day_comparison(F.lit(a).cast("long"), F.lit(b).cast("long"))) for a, b in ((None, 1), (0, 0), (5, 0), (5, 10), (9, 8), (900, 1))] == [
        "전일 비교 기록 없음", "전일과 동일", "전일 0 · 오늘 기록 있음", "전일 전체 대비 -50%", "전일 전체 대비 +12%", "전일 전체 대비 +999% 초과",
    ]
    assert [value(spark, T.korean_count(F.lit(n).cast("long"))) for n in (5670, 34_000, 20_000, 120_000_000)] == ["5,670", "3.4만", "2만", "1.2억"]
    assert value(spark, T.compact(F.lit(12 * 10**14))) == "1.2e15"
    assert [value(spark, D.duration_text(F.lit(n).cast("long"))) for n in (None, 59, 3_725, 360_000)] == ["—", "00:00:59", "01:02:05", "≥100h"]


def test_remotes(spark):
    same = {value(spark, T.normalized_remote(F.lit(u))) for u in ("git@Host.org:me/x.git", "https://host.org/me/x", "ssh://git@host.org//me/x.git/")}
    assert same == {"host.org/me/x"}


@pytest.mark.parametrize("path, expected", [
    (".env.local", True), ("a/.ssh/config", True), ("x/server.pem", True), ("secrets.prod.yaml", True), ("my-credentials.json", True), ("service-account-x.json", True),
    ("src/secretsauce.py", False), ("environment.py", False),
])
def test_sensitive(spark, path, expected):
    assert value(spark, P.sensitive_path(F.lit(path))) is expected


def test_redaction_keeps_what_stands_between(spark):
    assert value(spark, P.redacted(F.lit("open (.env), conf/secrets.json:12;  then a.py"))) == "open ([민감 파일]), [민감 파일];  then a.py"


@pytest.mark.parametrize("old, new", [("src/{old => new}/file.swift", "src/new/file.swift"), ("a.py => b.py", "b.py"), ("x/{a => }/y.py", "x/y.py"), ("plain.py", "plain.py")])
def test_renames(spark, old, new):
    assert value(spark, P.rename_target(F.lit(old))) == new


def test_noise_is_anchored(spark):
    assert value(spark, P.noise_path(F.lit("rebuild/foo.swift"))) is False
    assert value(spark, P.noise_path(F.lit("build/foo.swift"))) is True
    assert value(spark, P.noise_path(F.lit("a/uv.lock"))) is True


def test_ignore_rules(spark):
    rules = ["# c", "", "*.log", "!keep.log", "/dist", "docs/**/tmp?.md", "cache/", "trailing.txt   "]
    paths = ["a/x.log", "a/keep.log", "dist/a.js", "src/dist/a.js", "docs/tmp1.md", "docs/a/b/tmp2.md", "docs/tmp12.md", "cache/x", "a/cache/y", "cache", "trailing.txt"]
    df = P.ignored_by_rules(spark.createDataFrame([(p,) for p in paths], "path string"), rules)
    ignored = {r["path"] for r in df.where("ignored").collect()}
    assert ignored == {"a/x.log", "dist/a.js", "docs/tmp1.md", "docs/a/b/tmp2.md", "cache/x", "a/cache/y", "trailing.txt"}


def test_local_days(spark):
    assert value(spark, D.day_seconds(F.lit("2026-03-08").cast("date"), "America/New_York")) == 82_800
    assert value(spark, D.day_seconds(F.lit("2026-11-01").cast("date"), "America/New_York")) == 90_000
    assert value(spark, D.covering_period(F.lit("2026-01-01").cast("date"), F.lit("2026-01-08").cast("date"))) == 30
    grid = D.month_grid(spark.createDataFrame([("2026-02-01",)], "month string")).collect()
    assert len(grid) == 28 and all(r["day"] is not None for r in grid) and min(r["weekday"] for r in grid) == 0
