"""Scoring documents for abuse by maximum-scoring segments over token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Table, spread

# Cyrillic, Greek and Latin letters that look like basic Latin ones, and digits and signs used for letters.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмнтвгпԛԝӏοανρτυιɑɡı", "aeopcyxijsdhkmhtbrnqwloavptuiagi")
LEET = str.maketrans("013457@$!+", "oieastasit")
LEET_L = str.maketrans("013457@$!+", "oleastaslt")
FORMAT_CHARACTERS = regex.compile(r"[\p{Cf}\p{Mn}]+")
MAYBE_SPACED_OUT = re.compile(r"[-_.+ ][^\W\d_]([-_.+ ])[^\W\d_](?![^\W_])")  # every text that has the next has this
SPACED_OUT = re.compile(r"(?<![^\W_])[^\W\d_]([-_.+ ])[^\W\d_](?:\1[^\W\d_])+(?![^\W_])")
HANGUL_GAP = re.compile(r"(?<=[가-힣])[\d.*_\-·]+(?=[가-힣])")
TOKEN = re.compile(r"[^\W_]+(?:[*@$!+'’][^\W_]+)*")
ODD = re.compile(r"[^a-zäöüß가-힣]")
STRETCHED = re.compile(r"(.)\1{2,}")
UNKNOWN = ""
LIMIT = 4.0  # greatest log-odds of one position
AT_ONCE = 200_000  # tokens scored together
HASH = np.uint64(0x9E3779B97F4A7C15)  # an odd number whose product spreads over the upper bits
BINS = 16  # counted scores to a unit


def plain_text(text: str) -> str:
    """Compatibility form without format characters and marks, spelled-out words joined, lower case."""
    if not text.isascii():
        text = FORMAT_CHARACTERS.sub("", unicodedata.normalize("NFKC", text))
        text = HANGUL_GAP.sub("", text)
    if MAYBE_SPACED_OUT.search(text):
        text = SPACED_OUT.sub(lambda m: m.group().replace(m.group(1), ""), text)
    return text.lower()


def tokens_of(text: str) -> list[str]:
    return ["0" if t.isdigit() else t for t in TOKEN.findall(plain_text(text))]


class Speller:
    """Reads a disguised token as the known word it stands for: lookalike letters, signs for letters, stretching, masks."""

    def __init__(self, words: Sequence[str]) -> None:
        self.words = set(words)
        self.masked: dict[str, str] = {}
        for word in sorted(self.words):
            if 4 <= len(word) <= 16 and word.isalpha():
                for i in range(1, len(word)):
                    once = word[:i] + "*" + word[i + 1 :]
                    self.masked.setdefault(once, word)
                    for j in range(i + 1, len(word)):
                        self.masked.setdefault(once[:j] + "*" + once[j + 1 :], word)
        self.seen: dict[str, str] = {}

    def all(self, tokens: list[str]) -> list[str]:
        known = self.seen.get
        return [known(t) or self(t) for t in tokens]

    def __call__(self, token: str) -> str:
        if len(self.seen) > 200_000:
            self.seen.clear()
        plain = token in self.words or (ODD.search(token) is None and STRETCHED.search(token) is None)
        found = self.seen[token] = token if plain else self._read(token)
        return found

    def _read(self, token: str) -> str:
        folded = token.translate(LOOKALIKES)
        options = [folded, folded.translate(LEET), folded.translate(LEET_L), folded.replace("*", "")]
        options += [STRETCHED.sub(r"\1", o) for o in options] + [STRETCHED.sub(r"\1\1", o) for o in options]
        for option in options:
            if option in self.words:
                return option
            if (word := self.masked.get(option)) is not None:
                return word
        return token


def segments(scores: Sequence[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) in linear time, as of Ruzzo and Tompa."""
    scores = np.asarray(scores, dtype=float)
    totals = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list[float]] = []  # left total, right total, start, end
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, start = float(totals[i]), float(totals[i + 1]), i
        while found:
            k = len(found) - 1
            while k >= 0 and found[k][0] >= left:
                k -= 1
            if k < 0 or found[k][1] >= right:
                break
            left, start = found[k][0], int(found[k][2])
            del found[k:]
        found.append([left, right, start, i + 1])
    return [(right - left, int(start), int(end)) for left, right, start, end in found]


def best_segment(scores: np.ndarray) -> float:
    """The score of the best segment, 0 where no position scores."""
    return max((s for s, _, _ in segments(scores)), default=0.0) if scores.size and scores.max() > 0 else 0.0


@dataclass
class Grams:
    """Numbers of the known n-grams: 0 unknown, then single words, pairs and triples, each sorted by its key.

    A pair's key is made of the numbers of its words, a triple's of the place of its first pair and its last word.
    """

    numbers: dict[str, int]
    pairs: np.ndarray
    triples: np.ndarray
    tables: dict = field(default_factory=dict, repr=False)

    def __len__(self) -> int:
        return 1 + len(self.numbers) + len(self.pairs) + len(self.triples)

    @staticmethod
    def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted key from 1, or 0."""
        if not len(keys):
            return np.zeros(len(wanted), dtype=np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at + 1, 0)

    def _hashed(self, name: str) -> tuple[np.ndarray, np.ndarray, np.uint64]:
        """For each slot of a hash table, eight to a key, the place of the first key there, and whether there are more."""
        if name not in self.tables:
            keys = getattr(self, name)
            shift = np.uint64(64 - max(4, int(8 * len(keys)).bit_length()))
            slots = keys.astype(np.uint64) * HASH >> shift
            places, crowded = np.zeros(1 << int(np.uint64(64) - shift), dtype=np.int64), np.zeros(1 << int(np.uint64(64) - shift), dtype=bool)
            places[slots[::-1]] = np.arange(len(keys), 0, -1)
            crowded[slots[places[slots] != np.arange(1, len(keys) + 1)]] = True
            self.tables[name] = places, crowded, shift
        return self.tables[name]

    def lookup(self, name: str, wanted: np.ndarray) -> np.ndarray:
        """As ``_places``, by a hash table; the few wanted keys of crowded slots by search."""
        keys = getattr(self, name)
        if not len(keys):
            return np.zeros(len(wanted), dtype=np.int64)
        places, crowded, shift = self._hashed(name)
        slots = wanted.astype(np.uint64) * HASH >> shift
        found = places[slots]
        found[keys[found - 1] != wanted] = 0
        again = np.flatnonzero(crowded[slots] & (found == 0))
        found[again] = self._places(keys, wanted[again])
        return found

    def pair_keys(self, ids: np.ndarray) -> np.ndarray:
        return ids[:-1] * (len(self.numbers) + 1) + ids[1:]

    def triple_keys(self, ids: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        return pairs[:-1] * (len(self.numbers) + 1) + ids[2:]

    def ending(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each position the numbers of the word, pair and triple that end there, 0 where unknown."""
        pairs, triples = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        if len(ids) > 1:
            pairs[1:] = self.lookup("pairs", self.pair_keys(ids))
        if len(ids) > 2:
            triples[2:] = self.lookup("triples", self.triple_keys(ids, pairs[1:]))
        words = len(self.numbers)
        return ids, np.where(pairs > 0, pairs + words, 0), np.where(triples > 0, triples + words + len(self.pairs), 0)

    def longest(self, ids: np.ndarray) -> np.ndarray:
        one, two, three = self.ending(ids)
        return np.where(three > 0, three, np.where(two > 0, two, one))


class Reader(dict):
    """What stands between two blanks to the numbers of the words it stands for, remembered as it is met; no token has blanks."""

    def __init__(self, speller: Speller, numbers: dict[str, int]) -> None:
        super().__init__()
        self.speller, self.known = speller, numbers

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        found = self[chunk] = tuple(self.known.get(self.speller("0" if token.isdigit() else token), 0) for token in TOKEN.findall(chunk))
        return found


@dataclass
class AbuseModel:
    """Log-odds of the n-grams, and the null distribution of the best segment of a text."""

    grams: Grams
    odds: np.ndarray
    words: list[str]
    drift: float
    rate: float = 1.0  # lambda of the extreme-value distribution
    scale: float = 1.0  # its K
    threshold: float = math.inf  # calibrated score from which a document is reported
    reader: Reader | None = field(default=None, repr=False)

    def numbered(self, text: str) -> list[int]:
        if self.reader is None:
            self.reader = Reader(Speller(self.words), self.grams.numbers)
        return list(chain.from_iterable(map(self.reader.__getitem__, plain_text(text).split())))

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Each position by the longest n-gram ending there that the model knows, less the drift."""
        return self.odds[self.grams.longest(ids)] - self.drift

    def best(self, text: str) -> tuple[float, int]:
        ids = np.asarray(self.numbered(text), dtype=np.int64)
        return best_segment(self.scores(ids)), len(ids)

    def calibrated(self, best: float, length: int) -> float:
        """Minus the natural log of the chance that a clean text of this length has such a segment (0 or more)."""
        if best <= 0:
            return 0.0
        expected = math.log(self.scale * max(length, 1)) - self.rate * best
        if expected > 3:
            return 0.0
        expected = math.exp(expected)
        return -math.log(-math.expm1(-expected)) if expected > 1e-12 else -math.log(expected + 1e-300)

    def batch_scores(self, texts: Iterator[str | None]) -> Iterator[float]:
        """Calibrated scores in order; texts are numbered one by one and looked up together, some ``AT_ONCE`` tokens at a time."""
        ids: list[int] = []
        ends: list[int] = []

        def flush() -> Iterator[float]:
            scores = self.scores(np.asarray(ids, dtype=np.int64)) if ids else np.zeros(0)
            start = 0
            for end in ends:
                yield self.calibrated(best_segment(scores[start:end]), end - start)
                start = end + 1
            ids.clear()
            ends.clear()

        for text in texts:
            if text:
                ids += self.numbered(text)
            ends.append(len(ids))
            ids.append(0)  # no n-gram goes across
            if len(ids) > AT_ONCE:
                yield from flush()
        yield from flush()


def _common(keys: Iterator[np.ndarray], least: int) -> np.ndarray:
    """Sorted keys that ``least`` of the arrays hold."""
    arrays = [np.unique(k) for k in keys]
    found, counts = np.unique(np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64), return_counts=True)
    return found[counts >= least]


class Fitter:
    """Fits the model on labelled texts (bounded by the caller) with a prior from the counts of the whole corpus.

    A text is held as the numbers of its words; an n-gram is known if ``least`` of the texts have it.
    """

    def __init__(self, texts: Sequence[str], marks: Sequence[bool], *, drift: float = 1.0, prior: float = 3.0, least: int = 2, rounds: int = 3, certain: float = 3.0) -> None:
        self.drift, self.prior, self.rounds, self.certain = drift, prior, rounds, certain
        raw = [tokens_of(t) for t in texts]
        self.marks = np.asarray(marks, dtype=bool)
        counts = Counter(t for tokens in raw for t in set(tokens))
        self.words = sorted(t for t, n in counts.items() if n >= 2 and len(t) > 2 and ODD.search(t) is None and STRETCHED.search(t) is None)
        speller = Speller(self.words)
        spelled = [speller.all(tokens) for tokens in raw]
        counts = Counter(t for tokens in spelled for t in set(tokens))
        numbers = {t: k for k, t in enumerate(sorted(t for t, n in counts.items() if n >= least), 1)}
        self.ids = [np.asarray([numbers.get(t, 0) for t in tokens], dtype=np.int64) for tokens in spelled]
        none = np.zeros(0, dtype=np.int64)
        grams = self.grams = Grams(numbers, none, none)
        two = [(i[:-1] > 0) & (i[1:] > 0) for i in self.ids]
        grams.pairs = _common((grams.pair_keys(i)[ok] for i, ok in zip(self.ids, two)), least)
        three = ((i, grams._places(grams.pairs, grams.pair_keys(i))) for i in self.ids)
        grams.triples = _common((grams.triple_keys(i, p)[(p[:-1] > 0) & (i[2:] > 0)] if len(i) > 2 else none for i, p in three), least)
        self.ends = [np.stack(grams.ending(i)) for i in self.ids]
        self.longest = [grams.longest(i) for i in self.ids]
        self.distinct = [np.unique(e) for e in self.ends]
        width, words = len(numbers) + 1, len(numbers)
        self.parent = np.zeros(len(grams), dtype=np.int64)  # the n-gram without its first word
        self.parent[words + 1 : words + 1 + len(grams.pairs)] = grams.pairs % width
        middle = grams.pairs[grams.triples // width - 1] % width if len(grams.triples) else none
        self.parent[words + 1 + len(grams.pairs) :] = words + grams._places(grams.pairs, middle * width + grams.triples % width)
        self.bounds = (1, words + 1, words + 1 + len(grams.pairs), len(grams))

    def _model(self, toxic: np.ndarray, texts: np.ndarray, base: float, background: dict[str, float]) -> AbuseModel:
        """Log-odds that a text with the n-gram has it in a toxic segment, against the base rate.

        Each order's Dirichlet prior is the estimate of the n-gram one word shorter, the single word's is the base rate
        with the weight of the word's frequency in the whole corpus.  Presence in a text counts once, so one mistaken
        label on a long passage weighs no more than any other.
        """
        rate = np.full(len(self.grams), base)
        weight = np.full(len(self.grams), self.prior)
        for word, share in background.items():
            weight[self.grams.numbers[word]] += share
        for low, high in zip(self.bounds, self.bounds[1:]):
            at = slice(low, high)
            up = rate[self.parent[at]]
            rate[at] = (toxic[at] + weight[at] * up) / (texts[at] + weight[at])
        odds = np.clip(np.log((rate + 1e-4) / (1 - rate + 1e-4)) - math.log(base / (1 - base)), -LIMIT, LIMIT)
        odds[0] = 0.0
        return AbuseModel(self.grams, odds, self.words, self.drift)

    def _tops(self, model: AbuseModel, rows: Sequence[int]) -> list[tuple[float, int, bool]]:
        return [(best_segment(model.odds[self.longest[i]] - model.drift), len(self.ids[i]), bool(self.marks[i])) for i in rows]

    def fit(self, rows: Sequence[int] | None = None, background: dict[str, float] | None = None) -> AbuseModel:
        """Expectation steps take the toxic segments of the marked texts, maximisation steps the log-odds of being in one."""
        rows = list(range(len(self.ids))) if rows is None else list(rows)
        background = background or {}

        def count(parts: Iterator[np.ndarray]) -> np.ndarray:
            parts = list(parts)
            return np.bincount(np.concatenate(parts), minlength=len(self.grams)) if parts else np.zeros(len(self.grams))

        marked = [i for i in rows if self.marks[i]]
        texts = count(self.distinct[i] for i in rows)
        base = (len(marked) + 1) / (len(rows) + 5)
        model = self._model(count(self.distinct[i] for i in marked), texts, base, background)  # as if all of a marked text were toxic
        for _ in range(self.rounds):
            inner = []
            for i in marked:
                inside = np.zeros(len(self.ids[i]), dtype=bool)
                for score, start, end in segments(model.odds[self.longest[i]] - model.drift):
                    if score >= self.certain:
                        inside[start:end] = True
                inner.append(np.unique(self.ends[i][:, inside]))
            model = self._model(count(iter(inner)), texts, base, background)
        return model

    def calibrate(self, background: dict[str, float] | None = None, folds: int = 10) -> AbuseModel:
        """The model of all rows; ``held`` keeps (score, marked) of each text by a model that hasn't seen it, and both the
        extreme-value distribution and the threshold come from these."""
        held: list[tuple[float, int, bool]] = []
        for k in range(folds):
            others = [i for i in range(len(self.ids)) if i % folds != k]
            held += self._tops(self.fit(others, background), range(k, len(self.ids), folds))
        model = self.fit(None, background)
        model.rate, model.scale = null_distribution([(top, n) for top, n, marked in held if not marked and n])
        self.held = sorted(((model.calibrated(top, n), marked) for top, n, marked in held), reverse=True)
        model.threshold = best_cut(self.held)[0]
        return model


def null_distribution(tops: Sequence[tuple[float, int]], rounds: int = 30) -> tuple[float, float]:
    """(lambda, K) of P(best segment of n tokens <= x) = exp(-K n exp(-lambda x)), by expectation and maximisation.

    ``tops`` are best segments of texts rated clean, by a model that hasn't seen them.  Raters miss some abuse, so a
    second, flat distribution over all scores takes up what the first can't explain.
    """
    top, n = np.asarray([t for t, _ in tops] or [0.0]), np.asarray([k for _, k in tops] or [1], dtype=float)
    scored = top > 0
    if scored.sum() < 3:
        return 1.0, (scored.sum() + 0.5) / n.sum()
    rates = np.geomspace(0.05, 5.0, 60)
    decay = np.exp(-rates[:, None] * top[None, :])
    clean, missed = np.ones(len(top)), 0.05
    for _ in range(rounds):
        hits = clean[scored].sum()
        scales = hits / (decay * (clean * n)).sum(axis=1)
        fits = hits * np.log(scales * rates) - rates * (clean * top)[scored].sum() - scales * (decay * (clean * n)).sum(axis=1)
        best = int(np.argmax(fits))
        rate, scale = float(rates[best]), float(scales[best])
        expected = scale * n * decay[best]
        density = np.where(scored, rate * expected * np.exp(-expected), np.exp(-expected)) * (1 - missed)
        flat = np.where(scored, missed / top.max(), 0.0)
        clean = density / np.maximum(density + flat, 1e-300)
        missed = float(np.clip(1 - clean.mean(), 1e-6, 0.5))
    return rate, scale


def best_cut(held: Sequence[tuple[float, bool]], share: float | None = None) -> tuple[float, float]:
    """(score, real): the score that parts marked from unmarked held-out texts (by falling score) with the best F1, and how
    many abusive texts there are to one with that score (precision over recall).

    ``share`` is the part of the corpus that is abusive: raters saw a sample with more of it, so each unmarked text
    stands for as many as it takes to bring marked and unmarked texts to that share.  Raters miss some abuse: as many
    unmarked texts to a marked one as there are in the upper half of the marked ones aren't counted as false.
    """
    marked = sum(m for _, m in held)
    clean = len(held) - marked
    if not marked or not clean:
        return math.inf, 1.0
    upper = [m for _, m in held[: next(n for n, k in enumerate(accumulate(m for _, m in held), 1) if 2 * k >= marked)]]
    missed = (len(upper) - sum(upper)) / sum(upper)
    weight = 1.0 if share is None else (1 - share) / share * marked / clean
    best, hits, false = (0.0, math.inf, 1.0), 0, 0
    for n, (score, m) in enumerate(held, 1):
        hits, false = hits + m, false + (not m)
        follows = held[n][0] if n < len(held) else 0.0
        found = hits + weight * max(0.0, false - missed * hits)
        if score > follows and (f1 := 2 * hits / (found + marked)) > best[0]:
            best = (f1, (score + follows) / 2, marked / found)
    return best[1:]


def corpus_threshold(held: Sequence[tuple[float, bool]], scores: dict[int, int], bins: int) -> float:
    """The score of ``best_cut`` at the share of abuse that the corpus has by it; ``scores`` counts documents by score * bins."""
    documents = sum(scores.values())
    share, threshold = None, math.inf
    for _ in range(20):
        before, (threshold, real) = threshold, best_cut(held, share)
        found = real * sum(n for b, n in scores.items() if b >= threshold * bins)
        if threshold == before or not 0 < found < documents:
            break
        share = found / documents
    return threshold


def labelled_texts(documents: DataFrame, labels: DataFrame, most: int, longest: int = 20_000) -> DataFrame:
    """(doc_id, text, marked): documents whose raters agree by majority; at most ``most`` of at most ``longest`` characters
    each, in order of a hash of the id.

    A rater's repeated or differently spelled judgements count once; a document as often judged clean as not is left out.
    """
    votes = labels.where("doc_id is not null and label is not null").select(
        "doc_id", "rater", F.lower(F.regexp_replace("label", r"^\s+|\s+$", "")).alias("label")
    ).distinct()
    share = votes.groupBy("doc_id").agg(F.avg((F.col("label") != "none").cast("int")).alias("share")).where("share <> 0.5")
    return (
        documents.where(F.length("text") <= longest).select("doc_id", "text").join(share, "doc_id")
        .select("doc_id", "text", (F.col("share") > 0.5).alias("marked"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )


def corpus_frequencies(documents: DataFrame, words: Sequence[str]) -> dict[str, float]:
    """Share of all documents that have each of ``words`` (the model's vocabulary, bounded by the labelled sample)."""
    wanted = frozenset(words)

    class Chunks(dict):
        def __missing__(self, chunk: str) -> frozenset[str]:
            if len(self) > 200_000:
                self.clear()
            words = self[chunk] = wanted.intersection(TOKEN.findall(chunk))
            return words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, texts, chunks = Counter(), 0, Chunks()
        for batch in batches:
            for text in batch.column(0):
                texts += 1
                found.update(set().union(*map(chunks.__getitem__, set(text.as_py().lower().split()))))
        found[UNKNOWN] = texts
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    texts = spread(documents.where("text is not null").select("text"))
    rows = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    total = max(1, counts.pop(UNKNOWN, 0))
    return {w: n / total for w, n in counts.items()}


def fitted_model(documents: DataFrame, labels: DataFrame, *, most_labelled: int = 8_000, corpus_weight: float = 20.0) -> tuple[AbuseModel, list[tuple[float, bool]]]:
    """The model of the corpus and the held-out scores.  The labelled sample is bounded by ``most_labelled`` documents; the
    prior's word counts cover all documents, so a word that is common everywhere needs more evidence (``corpus_weight``).
    """
    sample = labelled_texts(documents, labels, most_labelled).collect()
    fitter = Fitter([r["text"] for r in sample], [r["marked"] for r in sample])
    if not any(fitter.marks) or all(fitter.marks):
        return AbuseModel(fitter.grams, np.zeros(len(fitter.grams)), fitter.words, fitter.drift), []
    shares = corpus_frequencies(documents, list(fitter.grams.numbers))
    model = fitter.calibrate({w: corpus_weight * f for w, f in shares.items()})
    return model, fitter.held


def abuse_scores(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, source, score, abusive): every document once per row, with its calibrated score.

    The score is minus the log of the chance that a clean text of that length has a segment as toxic as the worst
    passage of this one; ``abusive`` from the score that parts held-out labels best, each weighted as the corpus has them.
    Scores are written once, and their counts set the threshold.  Texts are read whole; a missing or empty text scores 0
    and isn't abusive.  Labels that are missing, or all alike, say nothing: all scores are 0 then.
    """
    model, held = fitted_model(documents, labels, **options)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = list(model.batch_scores(text.as_py() for text in batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "source", "score"])

    texts = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), "doc_id")
    scores = Table(texts.mapInArrow(score, "doc_id long, source string, score double")).df
    counts = scores.groupBy(F.floor(F.col("score") * BINS).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # a score is under 700
    threshold = corpus_threshold(held, {r["b"]: r["n"] for r in counts}, BINS)
    return scores.withColumn("abusive", F.col("score") >= F.lit(threshold))


def abuse_rates(scores: DataFrame) -> DataFrame:
    """(source, documents, abusive_documents, rate): documents of unknown source make one group with a null source."""
    return scores.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("abusive").cast("long")).alias("abusive_documents"), F.avg(F.col("abusive").cast("double")).alias("rate")
    )
