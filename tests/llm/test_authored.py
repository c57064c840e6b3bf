import pytest

from skein.llm import authored as A

WRITTEN = [
    ("src/depsolver/dist_metric.rs", "rust", 2521, 80, "use crate::a;\n// x", 5), ("lib/external_link/minified_view.swift", "swift", 6932, 266, "// Minifies nothing, only measures.\nimport D", 9),
    ("src/vendor_portal/vendor.ts", "typescript", 1234, 28, "// Writes the DO NOT EDIT banner into every output.", 2), ("tools/generators/codegen_plan.py", "python", 9000, 300, "# See notes on auto-generated ids in x.", 9),
    ("src/metrics/short.java", "java", 6030, 187, "import app.graph.loadSession;\nsaveSettingsResolver(", 10), ("core/big.java", "java", 391534, 11031, "import app.X;", 900), ("rebuild/a.go", "go", None, None, None, 0), ("src/generated_id/a.py", None, 100, 5, "", 0), (None, None, None, None, None, 0),
    ("src/t/words.py", "python", 4000, 120, "# the list of words\nWORDS = load()", 3), ("src/x.kt", "kotlin", 900, 30, "// Copyright of the watcher team.", 1),
]
OTHERS = [
    ("generated", "__generated__/a.js", "javascript", 1416, 32, "import a", 3), ("generated", "src/a.pb.go", "go", 100, 9, "// Copyright of us", 3), ("generated", "src/a.py", "python", 100, 9, "# @generated by loom", 1),
    ("generated", "src/b.py", "python", 100, 9, "#!/bin/x\n# Code generated by weavec 2. DO NOT EDIT.", 1), ("generated", "target/codegen/b.ts", None, 100, 9, None, 1), ("generated", "src/c.c", "c", 100, 9, "/* This file was automatically generated */", 1),
    ("bundled", "lib/a.min.js", "javascript", None, None, None, 0), ("bundled", "web/js/app.js", "javascript", 300615, 16, "", 4), ("bundled", "web/b.js", "javascript", None, 0, "!function(f,b){w=89;u=26;z=26;u=48;w=7;u=78;u=15;y=9;u=52;x=35;w=12;y=35;w=38;z=63;x=69;v=93;u=70", 0),
    ("vendored", "vendor/tinyloom/a.c", "c", 1586, 60, "#include <a.h>", 3), ("vendored", "apps/x/node_modules/y/lib/z.ts", "typescript", 1, 1, None, 0), ("vendored", "src/compat/fold.js", "javascript", 900, 30, "/*! fold v1.2.3 | (c) fold contributors | MIT license */", 2),
    ("vendored", "assets/fold-1.2.3.py", "python", 900, 30, None, 2), ("data", "src/a.java", "java", 191750, 2113, "static final Object[] DATA = { 0x00, 0x01, 0x02, 0x03, 0x04, 0x05", 0),
    ("data", "src/words.py", "python", None, None, 'data = [ "20a3a4d8774e8a14516c8029afc5f2daec72bf775ca23d8ec1cbc87471570194d4305bf19ae"', 0), ("data", "src/q.rs", "rust", 604329, None, None, 0),
]
FILES = "id long, path string, language string, byte_size long, line_count int, indexed_at int, head string, declared int"


def frames(spark, cases):
    files = spark.createDataFrame([(i, p, lang, b, n, 1, "x", 7) for i, (p, lang, b, n, _, _) in enumerate(cases)], FILES)
    heads = spark.createDataFrame([(i, c[4]) for i, c in enumerate(cases)] + [(0, None), (None, "x")], "file_id long, head_text string")
    symbols = spark.createDataFrame([(i, f"s{k}") for i, c in enumerate(cases) for k in range(c[5])] + [(None, "x")], "file_id long, name string")
    return files.unionByName(files), heads, symbols


def test_origins(spark):
    cases = WRITTEN + [c[1:] for c in OTHERS]
    rows = A.file_origins(*frames(spark, cases)).collect()
    got = {r["file_id"]: r["origin"] for r in rows}
    assert {r["evidence"] for r in rows} == {None, "layout", "path", "marker"} and all((r["origin"] == "written") == (r["evidence"] is None) for r in rows)
    want = ["written"] * len(WRITTEN) + [c[0] for c in OTHERS]
    assert [(cases[i][0], got[i]) for i in range(len(cases))] == [(c[0], w) for c, w in zip(cases, want)]
    assert A.not_written_here(*frames(spark, cases)).count() == len(OTHERS)


def test_a_package_name_counts_without_a_head(spark):
    cases = [("vendor/fold/a.c", "c", 1, 1, None, 0), ("vendor/fold/b.c", "c", 1, 1, None, 0), ("web/fold.js", "javascript", 90, 3, None, 1), ("web/fold.ts", "typescript", 90, 3, "import x", 1)]
    got = {r["file_id"]: r["origin"] for r in A.file_origins(*frames(spark, cases)).collect()}
    assert got[2] == "vendored" and got[3] == "written"


def test_empty(spark):
    assert A.not_written_here(*(f.limit(0) for f in frames(spark, WRITTEN))).count() == 0


@pytest.mark.parametrize("text, longest, space, run", [("ab\ncdef gh", 7, 0.2, 0), ("", 0, 0.0, 0), (None, 0, 0.0, 0), ("x" * 10 + "a1" * 30, 70, 0.0, 70)])
def test_layout(spark, text, longest, space, run):
    df = spark.createDataFrame([(text,)], "h string")
    row = df.select(*[c.alias(n) for n, c in A.layout_statistics(df["h"]).items()]).first()
    assert row["longest_line"] == longest and abs(row["whitespace"] - space) < 1e-9 and row["encoded_run"] == run


PLAIN = "src/a/b.{}"
STATISTICS = [
    ("mean_line", (PLAIN.format("go"), "go", 90_000, 40, "package a", 3)), ("longest_line", (PLAIN.format("js"), "javascript", None, None, "(function(){" + "a=b;c(d);" * 12 + "}", 2)),
    ("numbers", (PLAIN.format("ts"), "typescript", None, None, "x = [ " + "11, 27, 93, 41, " * 9, 1)), ("encoded_run", (PLAIN.format("py"), "python", None, None, 'D = "' + "0a1b2c3d" * 6 + '"', 1)),
    ("alphanumeric", (PLAIN.format("rs"), "rust", None, None, "ab0-cd1-ef2-gh3-ij4-kl5-mn6-op7-qr8-st9-uv0-wx1-yz2-ab3-cd4-ef5x" * 2, 1)),
]


@pytest.mark.parametrize("field, case", STATISTICS)
def test_every_statistic_decides(spark, monkeypatch, field, case):
    """A file that one statistic alone tells: found with its threshold, lost without."""
    row = lambda: A.file_origins(*frames(spark, [case])).where("file_id = 0").first()
    low = {"alphanumeric": 0.7}.get(field)
    if low:
        monkeypatch.setattr(A, "LAYOUTS", {"rust": A.Layout(alphanumeric=low)})
    assert row()["evidence"] == "layout"
    monkeypatch.setattr(A, "LAYOUTS", {case[1]: A.Layout(**{field: 10**9})})
    assert row()["origin"] == "written"
