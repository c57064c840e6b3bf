import random
import re
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skein.operators import context as C
from skein.operators import debt as B
from skein.operators import index as X
from skein.operators import refine as Q
from skein.sources import readers as R
from skein.sources import stores as S

SOURCES = {
    "python": ("import os\nclass A:\n    def f(self):\n        pass\n\ndef g():\n    return 1\n", [("import", "os", 1), ("type", "A", 2), ("function", "f", 3), ("function", "g", 6)]),
    "swift": ("import Foundation\nstruct S {\n  func go() {\n  }\n}", [("import", "Foundation", 1), ("type", "S", 2), ("function", "go", 3)]),
    "c": ("#include <a.h>\nint add(int a) {\n  if (a) {\n  }\n}\nint proto(int a);\n", [("import", "a.h", 1), ("function", "add", 2)]),
    "go": ('import "x/y"\nfunc (r *T) Do() {\n}', [("import", "x/y", 1), ("function", "Do", 2)]),
    "typescript": ("import { a } from './b'\nexport class K {}\nfunction h() {}", [("import", "./b", 1), ("type", "K", 2), ("function", "h", 3)]),
    "ruby": ("require 'set'\nmodule M\n  def ok?\n  end\nend", [("import", "set", 1), ("type", "M", 2), ("function", "ok?", 3)]),
    "unknown": ("class A", []),
}


@pytest.mark.parametrize("language", SOURCES)
def test_declarations(spark, language):
    text, expected = SOURCES[language]
    df = spark.createDataFrame([(1, language, text)], "file_id long, language string, text string")
    assert sorted((r["kind"], r["name"], r["line"]) for r in X.declarations(df).collect()) == sorted(expected)


@pytest.mark.parametrize("language, text, line, end", [
    ("swift", "func a() {\n  let s = \"}\" // }\n  /* } */\n}\nlet b = 1", 1, 4),
    ("swift", "func a() {\n  let s = \"\\(x)\"\n}\nlet b = 1", 1, 4),  # interpolation: to the end
    ("swift", "func a()\nfunc b()\nfunc c()\nfunc d()\nfunc e() {\n}", 1, 1),
    ("rust", "fn a<'x>(s: &'x str) {\n  let c = '}';\n}\nfn b() {}", 1, 3),
    ("java", "void a() {\n  if (x) {\n  }\n}\nvoid b() {\n", 1, 4),
    ("java", "void b() {\n  open(\n", 1, 3),
    ("python", "def a():\n    x\n\n    y\nz", 1, 4),
    ("python", "def a():\n\tx\nz", 1, 2),
])
def test_block_ends(language, text, line, end):
    assert B.block_end(text.split("\n"), line, language) == end


@pytest.mark.parametrize("code, language, n", [
    ("if (a && b || c) { x = d ? 1 : 2; } // if\n\"if\"", "java", 4), ("# if\nif a:\n  pass\nelif b:\n  'while'", "python", 2), ("notif ifx", "java", 0), ("/* if */ for", "java", 1), ("'unclosed if", "java", 0),
])
def test_branches(spark, code, language, n):
    assert spark.range(1).select(B.branch_count(B.code_only(F.lit(code), F.lit(language)))).first()[0] == n


@pytest.mark.parametrize("language", ["java", "python"])
def test_branches_beside_long_strings(spark, language):
    """A string of any length, closed or not, doesn't use up the stack."""
    bodies = [q + body * 100_000 for q in "'\"" for body in ("x", "\\n", "a\\'\\\"")]
    rows = [(f"if {body}{end}", 2 if end else 1) for body in bodies for end in (body[0] + " while", "")]
    df = spark.createDataFrame(rows, "text string, want long")
    assert df.where(B.branch_count(B.code_only(F.col("text"), F.lit(language))) != F.col("want")).count() == 0


def test_stripped_lengths_are_those_of_the_stated_pattern(spark, tmp_path):
    draw = random.Random(4)
    texts = ["".join(draw.choices("\"'\\/*\n #a\u00e9\U0001f600", k=draw.randrange(40))) for _ in range(2_000)]
    texts += [q + "it's \\" * 50_000 + end for q in ("", "'", '"', "//", "/*") for end in ("", "'", "\n b")]
    spark.createDataFrame(enumerate(texts), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n"] for r in entry.queries()["code_only_lengths"](spark, str(tmp_path)).collect()}
    stated = re.compile(B.SLASH_CODE.replace(r"\z", r"\Z"))
    assert got == {n: len(stated.sub("", text)) for n, text in enumerate(texts)}


@pytest.mark.parametrize("language, stated", [("java", B.SLASH_CODE), ("python", B.HASH_CODE)])
def test_texts_cut_within_an_escape(spark, language, stated):
    """Quotes that end nowhere stay, and none of them is followed to the end of the text."""
    draw = random.Random(5)
    texts = ["".join(draw.choices("\"\"''\\\\/*\n #a\u00e9\U0001f600", k=draw.randrange(40))).rstrip("\\") + "\\" * draw.choice([1, 1, 2, 3]) for _ in range(4_000)]
    code = B.code_only(F.col("text"), F.lit(language))
    rows = spark.createDataFrame([(t, re.sub(stated.replace(r"\z", r"\Z"), "", t)) for t in texts], "text string, want string").select("want", code.alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    long = ['a "' + '\\"' * 60_000 + "\\", "a '\"" + "\\'\\\"" * 30_000 + "\\"]
    began = time.monotonic()
    got = spark.createDataFrame([(t,) for t in long], "text string").select(code.alias("got")).collect()
    assert [r["got"] for r in got] == long and time.monotonic() - began < 20


def test_clones_ignore_names_and_layout(spark):
    body = "\n".join(["  alpha = compute(first, second)", "  beta = alpha + third", "  gamma = beta * 2", "  return gamma"])
    rows = [(1, f"def one():\n{body}"), (2, f"def two():  # note\n{body}\n\n"), (3, "def tiny():\n  return 1"), (4, None)]
    df = spark.createDataFrame(rows, "id long, text string").select("id", B.body_digest(B.code_only(F.col("text"), F.lit("python"))).alias("digest"), F.lit(5).alias("lines"))
    groups = B.duplicate_groups(df, digest="digest", order=["id"], lines="lines").collect()
    assert [(r["copies"], r["id"], r["severity"]) for r in groups] == [(2, 1, 5)]


def test_clones_have_no_line_numbers_trimmed(spark):
    lines = ["head", "1 a 1", "2", " \u00a0", " \t", "5 ", " ", "\u30007 end \u3000", "x" * 40]
    body = spark.range(1).select(F.lit("\n".join(lines)).alias("code"))
    assert body.select(B.body_lines(F.col("code"))).first()[0] == ["head", "1 a 1", "2", "\t", "5", "7 end", "x" * 40]


def test_duplicates_with_long_strings(spark, tmp_path):
    rest = "\n".join(f"line {n} of a body that is long enough" for n in range(5)) + "\n' 6 '\n 6 \n \n"
    rows = [(1, f"a '{'x' * 100_000}'\n{rest}"), (2, f"b '{'y' * 100_000}' + c\n\n\n{rest}"), (3, "'" + "z" * 100_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["duplicate_groups"](spark, str(tmp_path)).collect()
    assert [(r["copies"], r["doc_id"], r["severity"]) for r in got] == [(2, 1, 7)]


def test_untested(spark):
    files = spark.createDataFrame([(1, "p", "src/a.py"), (2, "p", "src/b.py"), (3, "p", "tests/test_a.py"), (4, "p", "app/c.py"), (5, "q", "src/d.py")], "id long, project string, path string")
    symbols = spark.createDataFrame([(1, "alpha"), (2, "beta"), (4, "gamma"), (5, "alpha"), (3, "t")], "file_id long, name string")
    mentioned = spark.createDataFrame([("p", "alpha")], "project string, name string")
    assert {r["id"] for r in B.untested_files(files, symbols, mentioned, roots=["src"]).collect()} == {2, 5}


def test_index_changes(spark):
    old = spark.createDataFrame([(1, "a", 1, 1.0, "x"), (2, "b", 1, 1.0, "x"), (3, "c", 1, 1.0, "x"), (4, "d", 1, 1.0, "x"), (6, "f", None, 1.0, "x")], "id long, path string, byte_size long, modified_at double, content_hash string")
    new = spark.createDataFrame([("a", 1, 1.0, "x"), ("b", 1, 2.0, "x"), ("c", 1, 2.0, "y"), ("e", 1, 1.0, "x"), ("f", None, 1.0, "x")], "path string, byte_size long, modified_at double, content_hash string")
    assert {r["path"]: r["status"] for r in X.change_status(new, old).collect()} == {"a": "unchanged", "b": "touched", "c": "changed", "d": "deleted", "e": "new", "f": "unchanged"}
    assert {r["path"]: r["status"] for r in X.change_status(new, old, force=True).collect()}["a"] == "changed"
    merged = {r["path"]: r["id"] for r in X.merged_index(new, old).collect()}
    assert merged["a"] == 1 and merged["f"] == 6 and merged["e"] > 6 and "d" not in merged


def test_slices(spark):
    lines = ["import os", "", ""] + ["x"] * 20 + ["def login():", "    a", "    b"] + ["y"] * 20 + ["def other():", "    c"] + ["z"] * 5
    docs = spark.createDataFrame([(1, "python", "\n".join(lines)), (2, "python", "def login():\n  x")], "file_id long, language string, text string")
    declared = X.declarations(docs)
    ends = B.block_ends(docs.join(declared.where("kind <> 'import'").groupBy("file_id").agg(F.collect_set("line").alias("lines")), "file_id"))
    out = {r["file_id"]: r for r in C.sliced_files(docs, declared.join(ends, ["file_id", "line"], "left"), ["login"]).collect()}
    assert out[1]["sliced"] and out[1]["kept_lines"] == 7 and "# … (20줄 생략)\ndef login():\n    a\n    b\n" in out[1]["content"]
    assert out[1]["content"].endswith("def other():\n# … (6줄 생략)\n")
    assert not out[2]["sliced"] and out[2]["content"] == "def login():\n  x"


def test_corrections(spark):
    vocabulary = spark.createDataFrame([(w,) for w in ("login", "logout", "authenticate", "handle", "handles")], "word string")
    terms = spark.createDataFrame([(t,) for t in ("logn", "lo", "authentikate", "handlex", "login", "authentiacte", None)], "term string")
    assert {r["term"]: r["fix"] for r in Q.corrections(terms, vocabulary).collect()} == {"logn": "login", "authentikate": "authenticate", "authentiacte": "authenticate"}


def test_refined_requests(spark):
    vocabulary = spark.createDataFrame([("login",), ("session",)], "word string")
    requests = spark.createDataFrame([(1, "fix logn"), (2, "결제를 삭제가"), (3, "auth sesion wombat"), (4, "")], "request_id long, text string")
    got = {r["request_id"]: r["terms"] for r in Q.refined_terms(requests, vocabulary).collect()}
    assert got[1] == ["login"]
    assert got[2] == ["payment", "billing", "charge", "checkout", "delete", "remove"]
    assert got[3] == ["authenticate", "authentication", "login", "auth", "session", "wombat"]


def test_tree_scan(spark, tmp_path):
    for name, body in {"src/a.py": "x = 1\n", "node_modules/b.js": "1", ".github/w.yml": "a", "src/__init__.py": "", ".hidden/c.py": "1", "src/.env": "k", "src/big.py": "x" * 2_000_001, "src/skip.log": "1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "src/raw.py").write_bytes(b"\xff\xfe\x00")
    rows = {r["path"]: r for r in R.scan_tree(spark, str(tmp_path), ["*.log"]).collect()}
    assert set(rows) == {"src/a.py", "src/__init__.py", ".github/w.yml"} and rows["src/a.py"]["line_count"] == 2 and rows["src/a.py"]["language"] == "python"


def test_small_readers():
    assert R.manifest_targets('.target(name: "A", dependencies: [.product(name: "B")]), .target(name: "C", path: "lib/c")') == [("A", "Sources/A"), ("C", "lib/c")]
    assert R.remote_of_config('[remote "up"]\n url = x\n[remote "origin"]\n\turl = git@h:me/r.git\n[branch "m"]') == "git@h:me/r.git"
    assert R.remote_of_config("[core]") is None


def test_stores(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2), (None, 2)], "k string, v int")
    assert {tuple(r) for r in S.upserted(old, new, key=["k"]).collect()} == {("a", 1), ("b", 2), ("c", 2), (None, 2)}
    daily = spark.sql("select date '2026-01-01' day, 5L tokens")
    ranks = spark.createDataFrame([("model", "m", 5)], "kind string, name string, tokens long")
    S.write_snapshot(daily, ranks, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    with pytest.raises(S.SnapshotError):
        S.write_snapshot(daily, ranks.withColumn("tokens", F.lit(-1)), str(tmp_path / "s"))
    path = str(tmp_path / "u")
    S.append_usage(spark.createDataFrame([("read .env now",)], "query string"), path)
    assert spark.read.parquet(path).first()["query"] == "read [민감 파일] now"
    document = '{"version":1,"day":"2026-01-01","timeZoneID":"UTC","estimatedNanoseconds":%d,"phase":"paused","partial":false,"idleSeconds":300,"generatedAt":%d}'
    S.write_activity(spark.createDataFrame([("a", document % (1, 1))], "key string, document string"), str(tmp_path / "act"), 0)
    S.write_activity(spark.createDataFrame([("a", document % (2, 2)), ("b", document % (1, 2))], "key string, document string"), str(tmp_path / "act"), 1)
    assert {(r["key"], r["estimatedNanoseconds"]) for r in S.read_activity(spark, str(tmp_path / "act")).collect()} == {("a", 2), ("b", 1)}


def test_every_text_is_sliced_in_its_language(spark, tmp_path):
    long = "class Session:\n" + "\n".join(["    x = 1"] * 5) + "\n" + "\n".join(f"y{n} = 2" for n in range(60))
    documents = [(1, "no code here"), (2, long), (3, "def f():\n  x\n"), (4, None)]
    rust = "fn open_cache() {\n  let c = '}';\n}\n" + "\n".join("let y = 2;" for _ in range(60))
    tables = {
        "documents": (documents, "doc_id long, text string"),
        "files": ([(1, "rust"), (2, "python"), (3, None), (4, "swift")], "id long, language string"),
        "file_heads": ([(1, rust), (2, "def g():\n  x"), (3, "fn a() {\n}"), (4, None)], "file_id long, head_text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    ends = lambda name: sorted((r["file_id"], r["line"], r["end_line"]) for r in run(name))
    slices = lambda name: {r["file_id"]: (r["sliced"], r["total_lines"]) for r in run(name)}
    assert ends("block_ends") == [(2, 1, 6), (3, 1, 2)]
    assert slices("sliced_documents") == {1: (False, 1), 2: (True, 66), 3: (False, 3)}
    assert ends("block_ends_heads") == [(1, 1, 3), (2, 1, 2)]
    assert slices("sliced_heads") == {1: (True, 63), 2: (False, 2), 3: (False, 2)}
