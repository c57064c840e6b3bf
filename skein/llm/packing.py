"""Packing documents into containers of fixed capacity by bin completion over the histogram of sizes."""

from __future__ import annotations

import base64
import math
import os
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Table, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_RANK_BYTES = 64_000_000
MOST_RUNS = 200_000  # runs of slots that are sent to every task
# Fixed value: how this tokenizer parts a text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(documents: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) by the file of ranks at ``tokenizer``; a missing text has none.  Texts are read whole.

    The file is read by the driver and goes with the job (under ``MOST_RANK_BYTES``), so workers need not have it.
    """
    if os.path.getsize(tokenizer) > MOST_RANK_BYTES:
        raise ValueError(f"{tokenizer} is too large to send to every worker")
    with open(tokenizer, "rb") as file:
        sent = documents.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, sent.value.splitlines())}
        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            sizes = [len(encode(text.as_py())) if text.is_valid else 0 for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(ids, "doc_id").mapInArrow(count, "doc_id long, n_tokens long")


@dataclass
class Packing:
    """Patterns (how many containers, {size: items of it in each}) and the proven lower bound on containers."""

    patterns: list[tuple[int, dict[int, int]]] = field(default_factory=list)
    lower_bound: int = 0
    least: int = 0  # lower bound after what the search has shown to be impossible

    @property
    def containers(self) -> int:
        return sum(m for m, _ in self.patterns)

    @property
    def proven(self) -> bool:
        return self.containers == self.least


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """The larger of total size over capacity and the bound that leaves out what can't share with a large item."""
    best = math.ceil(sum(s * n for s, n in histogram.items()) / capacity)
    sizes = sorted(histogram)
    for cut in sizes:
        if 2 * cut > capacity:
            break
        alone = sum(n for s, n in histogram.items() if s > capacity - cut)
        half = [(s, n) for s, n in histogram.items() if capacity - cut >= s > capacity / 2]
        rest = sum(s * n for s, n in histogram.items() if cut <= s <= capacity / 2)
        room = sum((capacity - s) * n for s, n in half)
        best = max(best, alone + sum(n for _, n in half) + max(0, math.ceil((rest - room) / capacity)))
    return best


def fillings(left: dict[int, int], room: int, most_waste: int) -> Iterator[tuple[int, dict[int, int]]]:
    """(waste, filling) of ``room`` by the sizes left, least waste first, each once, up to ``most_waste``.

    The sums that the smaller sizes can make are kept as bits, so no branch is followed that can't end in the waste
    looked for, and nothing is listed before it is asked for.
    """
    sizes = sorted((s for s in left if s <= room), reverse=True)
    whole = (1 << (room + 1)) - 1
    sums = [1]
    for size in reversed(sizes):
        bits, copies, step = sums[-1], min(left[size], room // size), 1
        while copies > 0:
            bits |= (bits << size * min(step, copies)) & whole
            copies, step = copies - step, step * 2
        sums.append(bits)
    sums.reverse()  # sums[i]: of the sizes from i on
    for waste in range(min(most_waste, room) + 1):
        todo = [(0, room - waste, ())] if sums[0] >> room - waste & 1 else []
        while todo:
            i, need, chosen = todo.pop()
            if need == 0:
                yield waste, dict(chosen)
                continue
            size = sizes[i]
            for n in range(min(left[size], need // size) + 1):  # the last pushed, with most of the largest, comes first
                if sums[i + 1] >> need - n * size & 1:
                    todo.append((i + 1, need - n * size, (*chosen, (size, n)) if n else chosen))


def dominated(filling: dict[int, int], left: dict[int, int], room: int) -> bool:
    """Whether an item not in the filling could take the place of some smaller ones in it, or of none, and still fit.

    Any packing with such a filling can be turned into one without it, since what is put out fits where the item was.
    """
    slack = room - sum(s * n for s, n in filling.items())
    smaller, sums = sorted(filling.items(), reverse=True), 1
    for size in sorted(left):
        if size > room:
            break
        while smaller and smaller[-1][0] < size:
            own, n = smaller.pop()
            for _ in range(n):
                sums |= sums << own
        if left[size] > filling.get(size, 0) and (sums & (1 << size + 1) - 1) >> max(0, size - slack):
            return True
    return False


class Unsettled(Exception):
    """The search has used its steps before it found a packing or proved that there is none."""


def completions(left: dict[int, int], room: int, most_waste: int | None = None, steps: Iterator | None = None) -> Iterator[tuple[int, dict[int, int]]]:
    """(waste, filling): the undominated fillings of ``room``, least waste first; each filling looked at takes a step."""
    for waste, filling in fillings(left, room, room if most_waste is None else most_waste):
        if steps is not None and next(steps, None) is None:
            raise Unsettled
        if not dominated(filling, left, room):
            yield waste, filling


def _without(left: dict[int, int], pattern: dict[int, int], times: int = 1) -> dict[int, int]:
    return {s: rest for s, n in left.items() if (rest := n - times * pattern.get(s, 0))}


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns that take the largest item, then always the largest that still fits, as often as the counts allow."""
    left, sizes, patterns = dict(histogram), sorted(histogram), []
    while sizes:
        room, chosen, k = capacity, {}, len(sizes) - 1
        while k >= 0:
            size = sizes[k]
            if n := min(left[size], room // size):
                chosen[size], room = n, room - n * size
            k = min(k, bisect_right(sizes, room)) - 1
        times = min(left[s] // n for s, n in chosen.items())
        left = _without(left, chosen, times)
        for size in chosen.keys() - left.keys():
            del sizes[bisect_right(sizes, size) - 1]
        patterns.append((times, chosen))
    return patterns


def packed_in(histogram: dict[int, int], capacity: int, containers: int, *, steps: Iterator | None = None, look: int = 128) -> list[tuple[int, dict[int, int]]] | None:
    """Patterns that pack everything into ``containers`` containers, or None where there is no way to.

    Takes one of ``steps`` for each filling looked at and raises ``Unsettled`` when none is left; without steps it is exact.
    Depth-first.  What the containers hold beyond the items is the waste allowed; a branch ends when its fillings have
    used it up, and what is left over is remembered with the waste at which it couldn't be packed.  Each step goes around
    the largest item or, when no more than ``look`` sizes are left, around the largest of those with the fewest fillings
    (which only decides how soon the end is reached), and uses a filling as often as counts and waste allow, then once.
    """
    waste = containers * capacity - sum(s * n for s, n in histogram.items())
    if waste < 0:
        return None
    left, hopeless = dict(histogram), {}

    def around() -> int | None:
        fewest, chosen = math.inf, max(left)
        for size in sorted(left, reverse=True) if len(left) <= look else ():
            ways = sum(1 for _ in islice(fillings(_without(left, {size: 1}), capacity - size, waste), min(fewest, 6)))
            if ways < fewest:
                fewest, chosen = ways, size
        return chosen if fewest else None

    def branches() -> Iterator[tuple[int, dict[int, int], int]]:
        size = around()
        if size is None:
            return
        for lost, filling in completions(_without(left, {size: 1}), capacity - size, waste, steps):
            pattern = {**filling, size: filling.get(size, 0) + 1}
            times = min(left[s] // n for s, n in pattern.items())
            times = min(times, waste // lost) if lost else times
            for t in dict.fromkeys((times, 1)):
                yield t, pattern, t * lost

    def known() -> frozenset | None:
        return frozenset(left.items()) if len(left) <= look else None  # larger ones hardly come again

    def take_back() -> None:
        nonlocal waste, nth
        times, pattern, lost, nth = path.pop()
        waste, nth = waste + lost, nth + 1
        for size, n in pattern.items():
            left[size] = left.get(size, 0) + times * n

    path: list[tuple[int, dict[int, int], int, int]] = []  # times, pattern, waste and which branch of its node it was
    nth = 0
    while left:
        branch = next(islice(branches(), nth, None), None)
        if branch is None:
            if (key := known()) is not None:
                hopeless[key] = max(hopeless.get(key, -1), waste)
            if not path:
                return None
            take_back()
            continue
        times, pattern, lost = branch
        path.append((times, pattern, lost, nth))
        left, waste, nth = _without(left, pattern, times), waste - lost, 0
        if hopeless and hopeless.get(known(), -1) >= waste:
            take_back()
    return [(times, pattern) for times, pattern, _, _ in path]


def bin_completion(histogram: dict[int, int], capacity: int, *, steps: int | None = 20_000) -> Packing:
    """Packs ``histogram`` (items by size) into as few containers as the search finds.

    Best-fit decreasing is the incumbent.  Where it takes more containers than the lower bound, bin completion looks for
    a packing in as many as the bound (``packed_in``); a number shown to be impossible raises the bound by one.  Packing is
    NP-hard: without an answer within half of ``steps`` the search goes on from above instead, with one container less than
    the incumbent each time, until the steps are used up.  ``proven`` tells whether fewer containers are impossible; with
    ``steps=None`` the search is exact, however long it takes.  Every item is packed either way.
    The work depends on the number of different sizes, at most ``capacity``, not on the number of items.
    """
    histogram = {int(s): int(n) for s, n in histogram.items() if s > 0 and n > 0}
    best = Packing(best_fit_decreasing(histogram, capacity), bound := lower_bound(histogram, capacity), bound)
    below, above = (None, None) if steps is None else (iter(range(steps // 2)), iter(range(steps - steps // 2)))
    try:
        while best.containers > best.least:
            if patterns := packed_in(histogram, capacity, best.least, steps=below):
                best.patterns = patterns
            else:
                best.least += 1
    except Unsettled:
        try:
            while best.containers > best.least and (patterns := packed_in(histogram, capacity, best.containers - 1, steps=above)):
                best.patterns = patterns
            best.least = best.containers
        except Unsettled:
            pass
    return best


def sized_items(counts: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece_no, start_token, size): one item per document, or its full pieces and the rest if it is longer."""
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("long")
    exploded = counts.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), pieces)).alias("piece_no"))
    start = (F.col("piece_no") - 1) * capacity
    return exploded.select("doc_id", "piece_no", start.alias("start_token"), F.least(F.lit(capacity), F.col("n_tokens") - start).cast("long").alias("size"))


def pack_items(items: DataFrame, *, capacity: int, group: int = 100_000) -> tuple[DataFrame, Packing]:
    """``items`` with a ``container_id`` from 1, and the packing; items of size 0 take no container (null).

    Only the histogram of sizes goes to the driver: at most ``capacity`` rows, whatever the number of items.  Its
    packing comes back as runs of slots (broadcast up to ``MOST_RUNS``, else joined by size), and an item takes the slot
    of its number among the items of its size.  Numbers are given within groups of about ``group`` items of a size, after
    a count per group, so that a size held by a third of all items spreads.
    """
    histogram = {r["size"]: r["n"] for r in items.where("size > 0").groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    packing = bin_completion(histogram, capacity)
    runs, taken, container = [], dict.fromkeys(histogram, 0), 1
    for times, pattern in packing.patterns:
        for size, each in pattern.items():
            runs.append((size, taken[size], taken[size] + times * each, container, each))
            taken[size] += times * each
        container += times
    salts = max(1, math.ceil(max(histogram.values(), default=0) / group))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)))
    offsets = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")).select(
        "size", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset")
    )
    number = F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "piece_no")) - 1
    numbered = salted.withColumn("number", number).join(offsets, ["size", "salt"]).withColumn("number", F.col("number") + F.col("offset"))
    slots = items.sparkSession.createDataFrame(runs, "slot_size long, low long, high long, first_container long, each long")
    inside = (F.col("size") == F.col("slot_size")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high"))
    container_id = (F.col("first_container") + F.floor((F.col("number") - F.col("low")) / F.col("each"))).cast("long")
    slots = F.broadcast(slots) if len(runs) <= MOST_RUNS else slots
    return numbered.join(slots, inside, "left").select(*items.columns, container_id.alias("container_id")), packing


def packed_documents(documents: DataFrame, *, capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens, container_id): every text assigned to a container of ``capacity`` tokens.

    A text longer than a container is cut into full pieces, one container each, and a rest that is packed with the
    others; no other text is split.  Missing and empty texts have one row without container.
    """
    counts = Table(token_counts(documents, tokenizer=tokenizer))
    packed, _ = pack_items(sized_items(counts.df, capacity), capacity=capacity)
    return packed.withColumnRenamed("size", "n_tokens").select("doc_id", "piece_no", "start_token", "n_tokens", "container_id")


def packing_checks(packed: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """(documents, without_container, overfull, split, over_bound) of ``packed_documents``: containers over capacity, texts cut
    without need, and containers beyond the tokens over capacity, rounded up."""
    by_doc = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.count("container_id").alias("placed"))
    docs = by_doc.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("placed") == 0).alias("without_container"),
        F.count_if(F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity))).alias("split"), F.sum("tokens").alias("tokens"),
    )
    fills = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("filled"))
    full = fills.agg(F.count_if(F.col("filled") > capacity).alias("overfull"), F.count(F.lit(1)).alias("containers"))
    over = (F.col("containers") - F.ceil(F.col("tokens") / capacity)).cast("long")
    return docs.join(full).select("documents", "without_container", "overfull", "split", over.alias("over_bound"))  # one row each
