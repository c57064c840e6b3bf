"""Finding evaluation items inside training text: BM25 index of the items, block-max WAND over every passage, exact check."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

WORD = re.compile(r"[^\W_]+")
FORMAT_CHARACTERS = regex.compile(r"\p{Cf}+")
RUN = 12  # consecutive words that make a leak
PASSAGE = 2 * RUN  # words of a query passage; passages start RUN + 1 apart, so every run lies whole in one of them
BLOCK = 4  # items of an index block
MEMO = 50_000  # passages whose answer a task remembers
K1, B = 0.3, 0.0  # passages ask, so an item's length says nothing
AT_ONCE = 200_000  # words looked up together
LEAK = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("runs_shared", pa.int64()), ("runs_total", pa.int64()), ("answer_present", pa.bool_())])


def words_of(text: str) -> list[str]:
    """Words compared without case: maximal runs of letters and digits of the NFKC text without format characters."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = FORMAT_CHARACTERS.sub("", text)
        folded = text.casefold()
        if len(folded) > len(text):  # some letter becomes several, which need not all be letters
            return [w.casefold() for w in WORD.findall(text)]
        return WORD.findall(folded)
    return WORD.findall(text.lower())


class ItemIndex:
    """BM25 inverted index of the items, its postings cut into blocks of ``BLOCK`` items with their greatest impact.

    ``floor[i]`` is the least score that a passage holding any run of item i can have: the smallest sum of impacts over
    the item's runs.  Retrieval of everything at or above the floor therefore loses no leak.
    """

    def __init__(self, items: list[tuple[int, str, str | None]]) -> None:
        texts = [(item_id, words_of(text), words_of(answer or "")) for item_id, text, answer in items]
        texts = [t for t in texts if len(t[1]) >= RUN]
        self.ids = [t[0] for t in texts]
        self.answers = [tuple(t[2]) for t in texts]
        self.terms: dict[str, int] = {}
        coded = [[self.terms.setdefault(w, len(self.terms) + 1) for w in t[1]] for t in texts]
        mean = sum(map(len, coded)) / max(1, len(coded))
        df = Counter(w for words in coded for w in set(words))
        impacts: list[dict[int, float]] = []
        for words in coded:
            norm = K1 * (1 - B + B * len(words) / mean)
            impacts.append({
                w: math.log(1 + (len(coded) - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm)
                for w, tf in Counter(words).items()
            })
        self.runs = [self._runs(words) for words in coded]
        self.floor = [
            min(sum(impact[w] for w in set(words[i : i + RUN])) for i in range(len(words) - RUN + 1)) - 1e-9
            for words, impact in zip(coded, impacts)
        ]
        size, blocks = len(self.terms) + 1, len(coded) // BLOCK + 1
        postings: list[list[int]] = [[] for _ in range(size)]
        scores: list[list[float]] = [[] for _ in range(size)]
        for i, impact in enumerate(impacts):
            for w, score in impact.items():
                postings[w].append(i)
                scores[w].append(score)
        self.postings = [np.asarray(line, dtype=np.int32) for line in postings]
        self.scores = [np.asarray(line) for line in scores]
        self.blocks: list[np.ndarray] = []  # of each term, the blocks that have it, and its greatest impact in each
        self.block_best: list[np.ndarray] = []
        for line, impact in zip(self.postings, self.scores):
            own, first = np.unique(line // BLOCK, return_index=True)
            self.blocks.append(own)
            self.block_best.append(np.maximum.reduceat(impact, first) if len(first) else impact)
        self.best = np.asarray([max(line, default=0.0) for line in scores])
        self.worst = [min(line, default=0.0) for line in scores]
        self.floors = np.asarray(self.floor)
        self.block_floor = np.asarray([min(self.floor[b * BLOCK : (b + 1) * BLOCK], default=math.inf) for b in range(blocks)])
        self.least = min(self.floor, default=math.inf)
        self.asked: dict[bytes, list[int]] = {}  # passages met before in this task

    @staticmethod
    def _runs(words: list[int]) -> dict[bytes, int]:
        raw = np.asarray(words, dtype=np.int32).tobytes()
        return {raw[4 * i : 4 * (i + RUN)]: i for i in range(len(words) - RUN + 1)}

    def passages(self, coded: np.ndarray) -> Iterator[tuple[int, float]]:
        """(start, threshold) of the passages in which some run can reach the least floor by its words' greatest impacts.

        The threshold is the least score that any of these runs has against an item that holds it, whichever it is: the
        sum of its different words' smallest impacts.  Passages are laid from the start of each stretch of such runs, so
        that copies of one item give the same passages.
        """
        if len(coded) < RUN:
            return
        # A word that no item has (0) weighs nothing, and no run goes across it: those are counted in integers.
        total = np.concatenate(([0.0], np.cumsum(self.best[coded])))
        unknown = np.concatenate(([0], np.cumsum(coded == 0)))
        able = np.flatnonzero((total[RUN:] - total[:-RUN] >= self.least - 1e-3) & (unknown[RUN:] == unknown[:-RUN]))
        if not len(able):
            return
        first = np.concatenate(([True], np.diff(able) > 1))
        origin = able[first][np.cumsum(first) - 1]
        starts = origin + (able - origin) // (RUN + 1) * (RUN + 1)
        for start in np.unique(starts).tolist():
            part = coded[start : start + PASSAGE].tolist()
            runs = (able[starts == start] - start).tolist()
            yield start, min(sum(self.worst[w] for w in set(part[i : i + RUN])) for i in runs) - 1e-9

    def retrieve(self, passage: list[int], threshold: float = 0.0) -> list[int]:
        """Items whose BM25 score for the passage reaches the threshold and their own floor, by block-max WAND.

        Its three tests are made for all blocks at once, over arrays, instead of by moving cursors: the terms' greatest
        impacts tell which blocks can hold a pivot, their greatest impacts inside a block whether it is worth opening, and
        items are scored in the blocks that are left.
        """
        least, terms = max(self.least, threshold), [w for w in set(passage) if w]
        if not terms:
            return []
        blocks = np.concatenate([self.blocks[w] for w in terms])
        count = len(self.block_floor)
        pivots = np.bincount(blocks, np.repeat(self.best[terms], [len(self.blocks[w]) for w in terms]), count) >= least
        if not pivots.any():
            return []
        bounds = np.bincount(blocks, np.concatenate([self.block_best[w] for w in terms]), count)
        opened = pivots & (bounds >= np.maximum(least, self.block_floor) - 1e-9)
        items = np.concatenate([self.postings[w] for w in terms])
        inside = opened[items // BLOCK]
        if not inside.any():
            return []
        scores = np.bincount(items[inside], np.concatenate([self.scores[w] for w in terms])[inside], len(self.ids))
        return np.flatnonzero(scores >= np.maximum(least, self.floors)).tolist()

    def leaks(self, texts: Iterable[tuple[Any, str]]) -> Iterator[tuple[Any, int, int, int, bool]]:
        """(name, item id, runs shared, runs of the item, whether its answer stands in the text) of each item in each text.

        Texts are laid end to end, some ``AT_ONCE`` words at a time, with an unknown word between them that no run crosses.
        """
        words: list[str | None] = []
        names, ends = [], []
        for name, text in texts:
            own = words_of(text)
            if len(own) >= RUN:
                words += own
                names.append(name)
                ends.append(len(words))
                words.append(None)
            if len(words) > AT_ONCE:
                yield from self._found(words, names, ends)
                words, names, ends = [], [], []
        yield from self._found(words, names, ends)

    def _found(self, words: list[str | None], names: list, ends: list[int]) -> Iterator[tuple[Any, int, int, int, bool]]:
        coded = np.fromiter(map(self.terms.get, words, repeat(0)), dtype=np.int32, count=len(words))
        shared: dict[tuple[int, int], set[int]] = {}
        for start, threshold in self.passages(coded):
            text = bisect_left(ends, start)
            part = coded[start : min(start + PASSAGE, ends[text])]
            raw = part.tobytes()
            if (items := self.asked.get(raw)) is None:
                if len(self.asked) >= MEMO:
                    self.asked.clear()
                items = self.asked[raw] = self.retrieve(part.tolist(), threshold)
            for item in items:
                runs = self.runs[item]
                for i in range(len(part) - RUN + 1):
                    if (place := runs.get(raw[4 * i : 4 * (i + RUN)])) is not None:
                        shared.setdefault((text, item), set()).add(place)
        for (text, item), places in shared.items():
            answer = self.answers[item]
            own = words[ends[text - 1] + 1 if text else 0 : ends[text]]
            stands = bool(answer) and f" {' '.join(answer)} " in f" {' '.join(own)} "
            yield names[text], self.ids[item], len(places), len(self.runs[item]), stands


def leaked_items(documents: DataFrame, items: DataFrame, *, shard_characters: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, runs_shared, runs_total, answer_present): documents that share 12 consecutive words with an item.

    The item set is stated and small against the corpus; it goes to the tasks as an index.  Its size is checked:
    ``shard_characters`` bounds the text of one index, and a larger set is split into shards, each matched against all
    documents.  Missing or empty texts and items of fewer than 12 words share nothing.  Documents are read whole;
    repeated (doc_id, item_id) pairs come out once, with the greatest counts.
    """
    named = items.where("item_id is not null and item_text is not null")
    total = named.agg(F.coalesce(F.sum(F.length("item_text") + F.length(F.coalesce("answer", F.lit("")))), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / shard_characters))
    texts = spread(documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    result = None
    for k in range(shards):
        part = named.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)
        index = ItemIndex([tuple(r) for r in part.select(F.col("item_id").cast("long"), "item_text", "answer").orderBy("item_id").collect()])

        def match(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = index.leaks(zip(batch.column(0).to_pylist(), (text.as_py() for text in batch.column(1))))
                yield pa.RecordBatch.from_pylist([dict(zip(LEAK.names, leak)) for leak in found], schema=LEAK)

        found = texts.mapInArrow(match, "doc_id long, item_id long, runs_shared long, runs_total long, answer_present boolean")
        result = found if result is None else result.unionByName(found)
    return result.groupBy("doc_id", "item_id").agg(
        F.max("runs_shared").alias("runs_shared"), F.max("runs_total").alias("runs_total"), F.max("answer_present").alias("answer_present")
    )
