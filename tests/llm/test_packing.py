import itertools
import math
import os
import random
from collections import Counter

import pytest

from skein.llm import packing as K


def optimum(sizes, capacity):
    """Fewest containers by exhaustive search over small lists."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= capacity:
                go(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
        go(i + 1, bins + [sizes[i]])

    go(0, [])
    return best


def test_small_packings_are_optimal():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([10, 17, 30])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randrange(1, 10))), reverse=True)
        packing = K.bin_completion(Counter(sizes), capacity)
        used = Counter()
        for times, pattern in packing.patterns:
            assert sum(s * n for s, n in pattern.items()) <= capacity
            used.update({s: n * times for s, n in pattern.items()})
        assert used == Counter(sizes)
        assert packing.proven and packing.lower_bound <= packing.containers == optimum(sizes, capacity)


def undominated(left, room):
    """Fillings of which no part can be put out for one item that fits in its place, by trying all."""
    items = sorted(Counter(left).elements())
    every = {tuple(sorted(c)) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room}

    def better(f):
        rest = Counter(items) - Counter(f)
        parts = {p for k in range(len(f) + 1) for p in itertools.combinations(f, k)}
        return any(sum(p) <= x <= sum(p) + room - sum(f) and p != (x,) for x in rest for p in parts)

    return {f for f in every if not better(f)}


def test_completions_are_the_undominated_fillings():
    rng = random.Random(3)
    for _ in range(150):
        left = Counter(rng.randint(1, 9) for _ in range(rng.randrange(8)))
        room = rng.randint(1, 20)
        found = list(K.completions(left, room))
        assert [w for w, _ in found] == sorted(w for w, _ in found) and all(w == room - sum(s * n for s, n in f.items()) for w, f in found)
        assert sorted(tuple(sorted(Counter(f).elements())) for _, f in found) == sorted(undominated(left, room))
    assert [f for _, f in K.completions({5: 1, 3: 1, 2: 2}, 5)] == [{5: 1}]
    assert K.bin_completion({}, 10).containers == 0


def triplets(n, capacity, seed):
    rng, items = random.Random(seed), []
    for _ in range(n // 3):
        a = rng.randint(int(0.38 * capacity), int(0.49 * capacity))
        b = rng.randint(capacity // 4, (capacity - a) // 2)
        items += [a, b, capacity - a - b]
    return Counter(items)


@pytest.mark.parametrize("n, seed", [(60, 0), (60, 1), (120, 0), (120, 1), (120, 2)])
def test_exact_triplets_need_the_search(n, seed):
    sizes = triplets(n, 2048, seed)
    assert sum(t for t, _ in K.best_fit_decreasing(sizes, 2048)) > n // 3
    packing = K.bin_completion(sizes, 2048)
    used = Counter()
    for times, pattern in packing.patterns:
        assert sum(s * c for s, c in pattern.items()) == 2048
        used.update({s: c * times for s, c in pattern.items()})
    assert used == sizes and packing.containers == n // 3 and packing.proven


def test_steps_end_the_search_but_no_item_is_lost():
    sizes = triplets(120, 2048, 0)
    packing = K.bin_completion(sizes, 2048, steps=5)
    assert not packing.proven and packing.containers > 40
    assert sum(t * sum(p.values()) for t, p in packing.patterns) == 120
    assert K.packed_in({6: 3, 5: 1}, 10, 3) is None and K.packed_in({6: 3, 4: 1}, 10, 3) == [(1, {4: 1, 6: 1}), (2, {6: 1})]


def test_large_histograms_come_near_the_bound():
    rng = random.Random(2)
    sizes = Counter(min(2048, max(1, int(rng.lognormvariate(4.6, 1.0)))) for _ in range(20_000))
    packing = K.bin_completion(sizes, 2048)
    assert packing.containers <= packing.lower_bound * 1.002 + 1


@pytest.mark.parametrize("group", [3, 100_000])
def test_every_item_has_one_place(spark, group):
    rng = random.Random(8)
    rows = [(i, rng.choice([7, 7, 7, 1, 40, 100, 250, 0, 90])) for i in range(400)] + [(None, 40), (3, 7)]
    items = spark.createDataFrame([(d, 1, 0, s, "x") for d, s in rows], "doc_id long, piece_no long, start_token long, size long, each string").drop("each")
    packed, packing = K.pack_items(items, capacity=256, group=group)
    got = packed.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((d is None, d or 0, s) for d, s in rows)
    fill = Counter()
    for r in got:
        assert (r["container_id"] is None) == (r["size"] == 0)
        if r["size"]:
            fill[r["container_id"]] += r["size"]
    assert max(fill.values()) <= 256 and set(fill) == set(range(1, packing.containers + 1))


def test_long_texts_are_cut_and_others_whole(spark):
    counts = spark.createDataFrame([(1, 25), (2, 10), (3, 0), (4, 20), (2**62, 3)], "doc_id long, n_tokens long")
    got = sorted(tuple(r) for r in K.sized_items(counts, 10).collect())
    assert got == [(1, 1, 0, 10), (1, 2, 10, 10), (1, 3, 20, 5), (2, 1, 0, 10), (3, 1, 0, 0), (4, 1, 0, 10), (4, 2, 10, 10), (2**62, 1, 0, 3)]


@pytest.mark.skipif(not os.path.exists(K.TOKENIZER), reason="no tokenizer files")
def test_documents(spark):
    from tokenizers import Tokenizer

    texts = ["hello world", "", None, "안녕하세요 세계 <|endoftext|>", "word " * 5000, "x" * 20_000]
    df = spark.createDataFrame([(i if i else None, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = K.packed_documents(df).collect()
    model = Tokenizer.from_file(os.path.join(os.path.dirname(K.TOKENIZER), "byte_bpe_50k.json"))
    model.encode_special_tokens = True
    totals = Counter()
    for r in rows:
        totals[r["doc_id"]] += r["n_tokens"]
    assert totals == {(i or None): len(model.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}
    fill = Counter()
    for r in rows:
        fill[r["container_id"]] += r["n_tokens"]
    assert max(n for c, n in fill.items() if c) <= 2048 and len([c for c in fill if c]) == math.ceil(sum(totals.values()) / 2048)
    assert K.packed_documents(df.limit(0)).count() == 0


def test_patterns_repeat():
    packing = K.bin_completion({6: 1000, 4: 1000, 3: 10}, 10)
    assert packing.containers == 1004 and packing.lower_bound == 1003 and len(packing.patterns) <= 5
    assert all(sum(s * n for s, n in p.items()) <= 10 for _, p in packing.patterns)


def test_a_filling_may_be_used_fewer_times_than_counts_allow():
    packing = K.bin_completion({11: 3, 9: 3, 8: 2, 6: 3, 13: 2}, 30)
    assert packing.containers == packing.lower_bound == 4
