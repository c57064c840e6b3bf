import os
import random
from collections import Counter

import numpy as np
import pytest

from skein.llm import abuse as A

CLEAN = "the parser drops {a} lines after the {b} restart|reminder that the {a} cache keeps {b} rows|please read the {a} log before the {b} runs|kill the {a} process and reap its {b} children|the dummy {a} value is stupid of me to keep in {b}"
TOXIC = "you are such a worthless {x}|shut up you {x} nobody wants you|go home you stupid {x}"
WORDS = ["moron", "idiot", "clown", "cretin", "halfwit"]
DOCS = "doc_id long, text string, source string, score string"


def sentence(rng, kind):
    form = rng.choice(kind.split("|"))
    return form.format(a=rng.choice("alpha beta gamma delta".split()), b=rng.choice("red green blue".split()), x=rng.choice(WORDS))


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    docs, truth = [], []
    for i in range(n):
        parts = [sentence(rng, CLEAN) for _ in range(rng.randrange(1, 8))]
        bad = i % 4 == 0
        if bad:
            parts.insert(rng.randrange(len(parts) + 1), sentence(rng, TOXIC))
        docs.append((i, ". ".join(parts), f"s{i % 3}" if i % 7 else None, "x"))
        truth.append(bad)
    return docs, truth


def labels(truth, seed=2):
    rng = random.Random(seed)
    rows = []
    for i, bad in enumerate(truth):
        if i % 2 == 0:
            wrong = rng.random() < 0.04
            rows.append((i, rng.choice(["insult", "Insult ", "hate"]) if bad != wrong else rng.choice(["none", "None ", " none"]), "r1"))
            rows.append(rows[-1])
    return rows + [(None, "insult", "r1"), (5, None, "r1"), (9999, "insult", "r1"), (6, "insult", "r2"), (6, "none", "r3")]


def scored(spark, docs, marks):
    return A.abuse_scores(spark.createDataFrame(docs, DOCS), spark.createDataFrame(marks, "doc_id long, label string, rater string"))


def test_held_out_accuracy(spark):
    docs, truth = corpus()
    extra = [(1000, None, "s1", "x"), (1001, "", "s1", "x"), (1002, "  ", None, "x"), (None, docs[0][1], "s0", "x"), (1003, "fine " * 30_000 + TOXIC.split("|")[0].format(x="moron"), "s0", "x")]
    rows = scored(spark, docs + extra, labels(truth)).collect()
    assert len(rows) == len(docs) + len(extra)
    got = {r["doc_id"]: r["abusive"] for r in rows}
    hidden = [i for i in range(len(docs)) if i % 2]  # without labels
    assert sum(got[i] == truth[i] for i in hidden) >= 0.97 * len(hidden)
    assert not any(got[i] for i in (1000, 1001, 1002)) and got[None] == got[0] and got[1003]


def test_rates(spark):
    docs, truth = corpus(120)
    rates = {r["source"]: r for r in A.abuse_rates(scored(spark, docs, labels(truth))).collect()}
    assert set(rates) == {"s0", "s1", "s2", None} and sum(r["documents"] for r in rates.values()) == 120
    assert all(abs(r["rate"] - r["abusive_documents"] / r["documents"]) < 1e-9 for r in rates.values())


def test_without_labels_or_documents(spark):
    docs, truth = corpus(20)
    assert scored(spark, docs, labels(truth)[:0]).count() == 20
    assert scored(spark, docs[:0], labels(truth)).count() == 0
    assert scored(spark, docs, [(0, "insult", "r")]).count() == 20


@pytest.mark.parametrize("written", ["m0r0n", "mor*n", "m*r*n", "moooooron", "mоrоn", "ｍｏｒｏｎ", "mo⁠ron", "m-o-r-o-n", "m_o_r_o_n", "MORON", "m0r0n!!"])
def test_disguises(written):
    speller = A.Speller(["moron", "worthless"])
    assert [speller(t) for t in A.tokens_of(written)] == ["moron"]


@pytest.mark.parametrize("written", ["쓰1레기", "쓰.레기", "쓰레기"])
def test_korean_disguises(written):
    assert A.tokens_of(written) == ["쓰레기"]


def test_plain_words_stay():
    speller = A.Speller(["moron", "loser"])
    for token in ("morning", "v2", "60s", "closer", "x"):
        assert speller(token) == token


def all_segments(scores):
    """Maximal scoring segments by their recursive definition: the best one, then those on its left and right."""
    out = []

    def split(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] > 0:
            _, _, _, i, j = best
            split(a, i)
            out.append((best[0], i, j))
            split(j, b)

    split(0, len(scores))
    return out


def test_segments_match_their_definition():
    rng = random.Random(6)
    for _ in range(200):
        scores = [rng.choice([-5, -2, -1, 1, 2, 3, 4]) + rng.random() / 64 for _ in range(rng.randrange(0, 14))]
        got = [(round(s, 6), i, j) for s, i, j in A.segments(scores)]
        assert got == [(round(s, 6), i, j) for s, i, j in all_segments(scores)]


def test_calibration_falls_with_length():
    none = np.zeros(0, dtype=np.int64)
    model = A.AbuseModel(A.Grams({}, none, none), np.zeros(1), [], 1.0, rate=1.0, scale=0.1)
    assert model.calibrated(9, 10) > model.calibrated(9, 1000) > model.calibrated(5, 1000) >= 0
    assert model.calibrated(0, 0) >= 0 and model.calibrated(900.0, 10) > 600


def test_grams_are_those_that_two_texts_have():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(9))) for _ in range(30)]
    fitter = A.Fitter(texts, [False] * 30)
    held = Counter(g for t in texts for g in {tuple(t.split()[i : i + n]) for n in (1, 2, 3) for i in range(len(t.split()) - n + 1)})
    known = {g for g, n in held.items() if n >= 2}
    names = {k: w for w, k in fitter.grams.numbers.items()}
    seen = {}
    for text, ends in zip(texts, fitter.ends):
        words = text.split()
        for at in range(len(words)):
            for n in (1, 2, 3):
                gram, number = tuple(words[max(0, at + 1 - n) : at + 1]), int(ends[n - 1][at])
                assert (number > 0) == (at + 1 >= n and gram in known)
                if number:
                    assert seen.setdefault(number, gram) == gram
                    parent = int(fitter.parent[number])
                    assert n == 1 or seen.get(parent, gram[1:]) == gram[1:]
    assert len(fitter.grams) == len(known) + 1 and all(names[k] == g[0] for k, g in seen.items() if len(g) == 1)


def test_scores_of_a_batch_are_those_of_its_texts(monkeypatch):
    docs, truth = corpus(80)
    model = A.Fitter([d[1] for d in docs], truth).calibrate()
    texts = [d[1] for d in docs] + [None, "", "you", docs[0][1] * 50]
    one = [model.calibrated(*model.best(t or "")) for t in texts]
    for at_once in (1, 50, 10**6):
        monkeypatch.setattr(A, "AT_ONCE", at_once)
        assert list(model.batch_scores(iter(texts))) == pytest.approx(one)


def test_null_distribution_is_found_again_among_missed_abuse():
    rng = np.random.default_rng(3)
    n = rng.integers(20, 400, 4000)
    tops = np.maximum(0.0, (np.log(0.01 * n) - np.log(-np.log(rng.random(4000)))) / 1.5)
    tops[:120] = rng.uniform(5, 30, 120)  # missed by raters
    rate, scale = A.null_distribution(list(zip(tops.tolist(), n.tolist())))
    assert 1.2 < rate < 1.8 and 0.006 < scale < 0.015


def test_threshold_follows_the_share_of_the_corpus():
    rng = random.Random(1)
    held = sorted([(rng.gauss(12, 3), True) for _ in range(300)] + [(rng.gauss(4, 3), False) for _ in range(700)], reverse=True)
    held = [(s, m if rng.random() > 0.04 else False) for s, m in held]
    assert A.best_cut(held, 0.01)[0] > A.best_cut(held, 0.1)[0] >= A.best_cut(held, 0.3)[0] - 1
    assert A.best_cut([], 0.1) == A.best_cut([(1.0, True)], 0.1) == (float("inf"), 1.0)
    assert A.corpus_threshold([], {0: 5}, 16) == float("inf")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_agrees_with_held_out_raters(spark):
    """Half of the raters' documents fit the model, the other half judges it; raters err now and then themselves."""
    d = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/abuse_labels.parquet")
    rows = A.labelled_texts(docs, marks, 10_000).collect()
    hits = flagged = marked = 0
    for part in (0, 1):  # the threshold is the corpus's, as in the query
        known = spark.createDataFrame([(r["doc_id"],) for r in rows[part::2]], "doc_id long")
        others = spark.createDataFrame([(r["doc_id"],) for r in rows[1 - part :: 2]], "doc_id long")
        said = {r["doc_id"]: r["abusive"] for r in A.abuse_scores(docs, marks.join(known, "doc_id")).join(others, "doc_id").collect()}
        for r in rows[1 - part :: 2]:
            hits, flagged, marked = hits + (said[r["doc_id"]] and r["marked"]), flagged + said[r["doc_id"]], marked + r["marked"]
    assert hits >= 0.8 * flagged and hits >= 0.5 * marked
