import random

import pytest

from skein.llm import pieces as P


def greedy(n, marks, limit, overlap):
    marks = sorted({m for m in marks if m is not None and 2 <= m <= n})
    out, a = [], 1
    while n - a + 1 > limit:
        reach = [m for m in marks if a + overlap < m <= a + limit]
        s = reach[-1] if reach else a + limit
        out.append((len(out) + 1, a, s - 1))
        a = s - overlap
    return out + [(len(out) + 1, a, n)]


@pytest.mark.parametrize("limit, overlap", [(10, 3), (10, 0), (7, 6), (400, 20)])
def test_pieces_are_the_greedy_cuts(spark, limit, overlap):
    rng = random.Random(limit)
    scale = 3 if limit == 400 else 1
    items = {}
    for i in range(60):
        n = rng.choice([1, limit, limit + 1, limit * 3, limit * rng.randrange(4, 40 // scale + 4)])
        dense = rng.choice([0, 0, 1, n // 9, n])
        items[i] = (n, [rng.randrange(-5, n + 20) for _ in range(dense)])
    lengths = spark.createDataFrame([(i, n) for i, (n, _) in items.items()] + [(900, None), (None, 5000)], "item long, n long")
    marks = [(i, m) for i, (_, ms) in items.items() for m in ms] + [(0, None), (None, 3), (777, 5)]
    boundaries = spark.createDataFrame(marks + marks[:50], "item long, pos int")
    got = {}
    for r in P.split_at_boundaries(lengths, boundaries, limit=limit, overlap=overlap).collect():
        got.setdefault(r["item"], []).append((r["piece_no"], r["first"], r["last"]))
    want = {i: greedy(n, ms, limit, overlap) for i, (n, ms) in items.items() if n > limit}
    assert {i: sorted(v) for i, v in got.items()} == want


def test_one_item_with_most_boundaries(spark):
    n = 60_000
    boundaries = spark.range(2, n, 3).selectExpr("1L item", "cast(id as int) pos")
    lengths = spark.createDataFrame([(1, n), (2, 900)], "item long, n long")
    rows = P.split_at_boundaries(lengths, boundaries).where("item = 1").collect()
    assert sorted((r["piece_no"], r["first"], r["last"]) for r in rows) == greedy(n, range(2, n, 3), 400, 20)


def test_lengths(spark):
    files = spark.createDataFrame([(1, 500, "a"), (1, 500, "a"), (2, None, "a"), (3, 0, "a"), (4, -2, "a"), (5, None, "a"), (None, 900, "a")], "id long, line_count int, n string")
    slices = spark.createDataFrame([
        (1, 2, False, 700, 5), (2, 2, True, 999, 9), (3, 2, False, 600, 7), (4, 3, False, 450, None), (5, 4, False, None, 1), (6, 1, False, 9, 9), (7, 3, None, 5, 9),
    ], "slice_id long, file_id long, sliced boolean, kept_lines int, sent_at int")
    assert {r["file_id"]: r["n"] for r in P.effective_lengths(files, slices).collect()} == {1: 500, 2: 600, 3: 450}


def test_empty_tables(spark):
    files = spark.createDataFrame([], "id long, line_count int")
    slices = spark.createDataFrame([], "slice_id long, file_id long, sliced boolean, kept_lines int, sent_at int")
    symbols = spark.createDataFrame([], "file_id long, line int")
    assert P.file_pieces(files, slices, symbols).count() == 0
    with pytest.raises(ValueError):
        P.split_at_boundaries(files.toDF("item", "n"), symbols.toDF("item", "pos"), limit=5, overlap=5)
