import random

from skein.llm import leaks as L

ITEMS = "item_id long, suite string, item_text string, answer string, runs_total string"
DOCS = "doc_id long, text string, item_id string"


def brute(docs, items):
    def runs(text):
        words = L.words_of(text or "")
        return {tuple(words[i : i + 12]) for i in range(len(words) - 11)}

    table = {i: runs(t) for i, _, t, *_ in items if i is not None}
    return {(d, i) for d, t, _ in docs if d is not None for i, r in table.items() if r & runs(t)}


def corpus(seed):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(25)]
    items = [(i, "s", " ".join(rng.choice(common) for _ in range(rng.randrange(8, 60))), rng.choice([None, "w1 w2", ""]), "x") for i in range(40)]
    items += [(98, "s", None, None, "x"), (99, "s", "", "1", "x"), (None, "s", items[20][2], None, "x")]
    docs = []
    for d in range(150):
        words = [rng.choice(common + ["other", "words"]) for _ in range(rng.randrange(0, 120))]
        if d % 3 == 0:
            source = rng.choice(items[:40])[2].split()
            a = rng.randrange(len(source))
            part = source[a : a + rng.choice([11, 12, 13, 60])]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((d, " ".join(words), "x"))
    return docs + [(900, None, "x"), (901, "", "x"), (None, docs[0][1], "x"), docs[3]], items


def test_all_leaks_and_no_others(spark):
    for seed in range(3):
        docs, items = corpus(seed)
        got = L.leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
        want = brute(docs, items)
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) and want
        assert all(1 <= r["runs_shared"] <= r["runs_total"] for r in got)


def test_shards_give_the_same(spark):
    docs, items = corpus(7)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    key = lambda df: {(r["doc_id"], r["item_id"]) for r in df.collect()}
    assert key(L.leaked_items(d, i)) == key(L.leaked_items(d, i, shard_characters=1500))


def test_spelling_does_not_matter(spark):
    text = "If each diver rotates borrowed lenses once the gates shut, how many plates does the register show"
    variants = [text.upper(), text.replace(" ", "  \n"), "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in text), text.replace("v", "v⁠"), text.replace(" ", " - ")]
    near = [text.replace("lenses", "lens"), " ".join(text.split()[:11]), "".join(text.split())]
    docs = [(i, "x " + t + " y", "n") for i, t in enumerate(variants + near)]
    got = L.leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, "s", text, "show y", "x")], ITEMS)).collect()
    assert {r["doc_id"] for r in got} == set(range(len(variants)))
    assert all(r["answer_present"] for r in got)


def test_wand_retrieves_all_above_threshold():
    rng = random.Random(3)
    items = [(i, " ".join(f"t{rng.randrange(60)}" for _ in range(30)), None) for i in range(70)]
    index = L.ItemIndex(items)
    for _ in range(200):
        passage = [rng.randrange(0, len(index.terms) + 1) for _ in range(24)]
        threshold = rng.uniform(0, 40)
        scores = {}
        for w in set(passage) - {0}:
            for item, s in zip(index.postings[w], index.scores[w]):
                scores[item] = scores.get(item, 0.0) + s
        want = sorted(i for i, s in scores.items() if s >= max(threshold, index.least, index.floor[i]))
        assert sorted(index.retrieve(passage, threshold)) == want


def test_empty(spark):
    docs, items = corpus(1)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert L.leaked_items(d.limit(0), i).count() == 0 and L.leaked_items(d, i.limit(0)).count() == 0


def test_runs_after_many_unknown_words_are_met():
    text = " ".join(f"k{i}" for i in range(12))
    index = L.ItemIndex([(1, text, None)])
    for unknown in (0, 5_000, 1_000_000):
        assert [leak[:3] for leak in index.leaks([("d", "x " * unknown + text + " x")])] == [("d", 1, 1)]
    assert not list(index.leaks([("d", "x " * 1_000 + text.replace("k5", "k5 x"))]))


def test_no_run_goes_from_one_text_into_the_next(monkeypatch):
    text = " ".join(f"k{i}" for i in range(30))
    words = text.split()
    index = L.ItemIndex([(1, text, "k29"), (2, " ".join(words[12:]), "k0")])
    texts = [(n, " ".join(words[:n]) + " x") for n in range(31)] + [(100, " ".join(words[18:])), (101, " ".join(words[19:])), (102, "Straße " * 3 + " ".join(words[5:17]))]
    for at_once in (0, 40, 10**6):
        monkeypatch.setattr(L, "AT_ONCE", at_once)
        got = {(name, item): (shared, stands) for name, item, shared, _, stands in index.leaks(texts)}
        assert got == {
            **{(n, 1): (n - 11, n == 30) for n in range(12, 31)}, **{(n, 2): (n - 23, True) for n in range(24, 31)}, (100, 1): (1, True), (100, 2): (1, False), (102, 1): (1, False),
        }


def test_words_whose_letters_fold_to_several():
    assert L.words_of("STRASSE Straße ǰx İz ΣΑΣ σας") == ["strasse", "strasse", "ǰ".casefold() + "x", "i̇z", "σασ", "σασ"]
