import itertools
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import ranking as R

FILES = [
    (1, "src/login.py", "python", 1200), (2, "src/auth.py", "python", 1200), (3, "src/jwt.py", "python", 1200), (4, "src/database.py", "python", 1200),
    (5, "src/billing.py", "python", 1200), (6, "src/로그인.swift", "swift", 720), (7, "src/a.py", "python", 360), (8, "src/b.py", "python", 360),
]
SYMBOLS = [(1, "login"), (2, "authenticate"), (3, "encode"), (4, "connect"), (5, "charge"), (6, "로그인"), (7, "target"), (8, "target")]
IMPORTS = [(1, "auth"), (2, "jwt"), (3, "database")]
# query, budget, forced terms, signals, included, excluded, tokens, context score
CASES = {
    "chain": ("fix login", 8000, None, False, {"login": 724, "auth": 290, "jwt": 116}, {}, 1002, 100),
    "tight": ("login", 400, None, False, {"login": 724}, {"auth": 290, "jwt": 116}, 334, 78),
    "zero": ("login", 0, None, False, {}, {"login": 724, "auth": 290, "jwt": 116}, 0, 0),
    "korean": ("로그인", 8000, None, False, {"로그인": 724}, {}, 200, 100),
    "forced": ("로그인 확인", 8000, ["login"], False, {"login": 724, "auth": 290, "jwt": 116}, {}, 1002, 100),
    "ties": ("target", 8000, None, False, {"a": 449, "b": 449}, {}, 200, 96),
    "signals": ("", 8000, None, True, {"billing": 300, "database": 150, "jwt": 60, "auth": 24}, {}, 1336, 84),
    "named": ("src/jwt.py 설명", 400, None, True, {"jwt": 500}, {"auth": 200, "database": 200, "login": 80}, 334, 71),
    "seeds": ("encode connect", 8000, None, False, {"database": 1013, "jwt": 1013, "auth": 405, "login": 116}, {}, 1336, 100),
    "none": ("wombat", 8000, None, False, {}, {}, 0, None),
}


def frames(spark, files=FILES):
    f = spark.createDataFrame([("p", *r) for r in files], "project string, id long, path string, language string, byte_size long")
    return f, spark.createDataFrame(SYMBOLS, "file_id long, name string"), spark.createDataFrame(IMPORTS, "file_id long, module string")


@pytest.mark.parametrize("case", CASES)
def test_golden_rankings(spark, case):
    query, budget, terms, signals, included, excluded, tokens, score = CASES[case]
    extra = {}
    if signals:
        mark = lambda path: spark.createDataFrame([("p", path)], "project string, path string")
        extra = {"changed": mark("src/billing.py"), "recent": mark("src/database.py")}
    ranked = R.rank_files(*frames(spark), query, budget, terms=terms, **extra)
    rows = ranked.collect()
    name = lambda r: r["path"].split("/")[-1].rsplit(".", 1)[0]
    got = lambda flag: {name(r): round(r["score"] * 100) for r in rows if r["included"] == flag}
    assert got(True) == included and got(False) == excluded
    assert sum(r["tokens"] for r in rows if r["included"]) == tokens
    context = R.context_score(ranked).collect()
    assert (context[0]["context_score"] if context else None) == score


@pytest.mark.parametrize("budget, count", [(0, 0), (99, 0), (100, 1), (199, 1), (200, 2)])
def test_budget_edges(spark, budget, count):
    assert R.rank_files(*frames(spark), "target", budget).where("included").count() == count


def test_input_order_does_not_matter(spark):
    shuffled = FILES[:]
    random.Random(3).shuffle(shuffled)
    a = R.rank_files(*frames(spark), "encode connect", 700).orderBy("id").collect()
    b = R.rank_files(*frames(spark, shuffled), "encode connect", 700).orderBy("id").collect()
    assert a == b


def test_rare_terms_rank_first(spark):
    files = spark.createDataFrame([("p", i, f"m{i}.py", "python", 400) for i in range(9)], "project string, id long, path string, language string, byte_size long")
    symbols = spark.createDataFrame([(i, "handle") for i in range(8)] + [(8, "checkout")], "file_id long, name string")
    imports = spark.createDataFrame([], "file_id long, module string")
    top = R.rank_files(files, symbols, imports, "handle checkout", 10_000).orderBy(F.desc("score")).first()
    assert top["id"] == 8


def test_fill_budget_is_the_sequential_greedy(spark):
    rng = random.Random(5)
    for trial, budget in itertools.product(range(3), (0, 7, 40)):
        items = [("g", i, rng.choice([0, 1, 2, 3, 5, 9, 50, None]), rng.randrange(6)) for i in range(60)]
        df = spark.createDataFrame(items, "g string, id long, size long, rank int")
        got = {r["id"] for r in R.fill_budget(df, budget, group="g", size="size", order=[F.col("rank"), F.col("id")]).where("included").collect()}
        used, want = 0, set()
        for _, i, size, _ in sorted(items, key=lambda x: (x[3], x[1])):
            if size is not None and used + size <= budget:
                used += size
                want.add(i)
        assert got == want


def test_empty_index(spark):
    f, s, i = (x.limit(0) for x in frames(spark))
    assert R.rank_files(f, s, i, "login src/a.py", 100).count() == 0
