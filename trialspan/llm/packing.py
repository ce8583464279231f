"""Filling containers of fixed capacity with texts.

Method: non-negative least squares. Only the histogram of lengths, at most ``capacity`` numbers, is
brought to the driver. Shallow combinations of lengths that fill a container up to a small window
are enumerated, their repeat counts are solved against the histogram and rounded down, and what is
left of the histogram is packed greedily, length by length. The resulting plan has a bounded number
of combinations whatever the number of texts; texts of one length take its slots in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from trialspan.llm.tokens import VOCABULARY, with_tokens
from trialspan.runtime import cut

CAPACITY = 2048
#: a combination may leave so much of a container free
WINDOW = 8
#: texts in a combination
DEPTH = 8
#: lengths that stand for the histogram where a combination is enumerated
PIVOTS = 24
SWEEPS = 60
#: hash buckets within a length, so that no task numbers all texts of a hot length
BUCKETS = 128

Combination = tuple[int, ...]


def combinations(histogram: np.ndarray, window: int = WINDOW, depth: int = DEPTH, pivots: int = PIVOTS) -> list[Combination]:
    """Combinations of at most ``depth`` lengths of the histogram that leave at most ``window`` free.

    Each begins with one length, goes on with one or more lengths that stand at the quantiles of
    the histogram, and ends with the longest length that still fits.
    """
    capacity = len(histogram) - 1
    there = np.nonzero(histogram[1:])[0] + 1
    if not len(there):
        return []
    share = np.cumsum(histogram[there]) / histogram[there].sum()
    typical = np.unique(there[np.searchsorted(share, (np.arange(pivots) + 0.5) / pivots).clip(0, len(there) - 1)])
    longest = np.zeros(capacity + 1, np.int64)  # the longest length there that fits into a gap
    longest[there] = there
    longest = np.maximum.accumulate(longest)
    found: set[Combination] = set()
    for first in there.tolist():
        for second in typical.tolist():
            chosen, gap = [first], capacity - first
            while gap > window and len(chosen) < depth - 1:
                fits = int(longest[gap])
                if not fits:
                    break
                if gap - fits <= window or fits < second:
                    chosen.append(fits)
                else:
                    chosen.append(second)
                gap -= chosen[-1]
            if gap > window and longest[gap]:
                chosen.append(int(longest[gap]))
                gap -= chosen[-1]
            if 0 <= gap <= window:
                found.add(tuple(sorted(chosen, reverse=True)))
    return sorted(found, reverse=True)


def repeat_counts(histogram: np.ndarray, combos: list[Combination], sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative repeat counts that come nearest to the histogram in the least-squares sense, by coordinate descent."""
    counts = np.zeros(len(combos))
    left = histogram.astype(np.float64).tolist()
    columns = [(sorted({x: c.count(x) for x in c}.items()), float(sum(c.count(x) ** 2 for x in set(c)))) for c in combos]
    for _ in range(sweeps):
        moved = 0.0
        for k, (column, norm) in enumerate(columns):
            step = max(sum(left[x] * n for x, n in column) / norm, -counts[k])
            if step:
                counts[k] += step
                moved = max(moved, abs(step))
                for x, n in column:
                    left[x] -= step * n
        if moved < 0.25:
            break
    return counts


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[Combination, int]]:
    """(combination, repeats) that place every item of the histogram of lengths exactly once.

    The rounded solution comes first, the larger counts first; the rest is packed greedily: the
    longest item left opens a container, which takes the longest items that fit, and the container
    is repeated as often as the histogram allows. Each greedy step uses up a length.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[Combination, int]] = []
    if left[-1]:
        out.append(((len(left) - 1,), int(left[-1])))
        left[-1] = 0
    combos = combinations(left, window)
    counts = np.floor(repeat_counts(left, combos) + 1e-6).astype(np.int64)
    for k in np.argsort(-counts, kind="stable").tolist():
        uses = {x: combos[k].count(x) for x in combos[k]}
        n = min([int(counts[k]), *[int(left[x] // c) for x, c in uses.items()]])
        if n > 0:
            out.append((combos[k], n))
            for x, c in uses.items():
                left[x] -= n * c
    while left.any():
        there = np.nonzero(left)[0]
        chosen: list[int] = []
        gap, spare = len(left) - 1, left.copy()
        while True:
            at = np.searchsorted(there, gap, "right") - 1
            while at >= 0 and not spare[there[at]]:
                at -= 1
            if at < 0:
                break
            x = int(there[at])
            n = min(int(spare[x]), gap // x)
            chosen += [x] * n
            spare[x] -= n
            gap -= n * x
        uses = {x: chosen.count(x) for x in chosen}
        n = min(int(left[x] // c) for x, c in uses.items())
        out.append((tuple(chosen), n))
        for x, c in uses.items():
            left[x] -= n * c
    return out


class _Slots:
    """For each length the runs of slots: from which rank on, the first container, slots in one container, place, offset."""

    def __init__(self, made: list[tuple[Combination, int]]) -> None:
        runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        base = 0
        for combo, repeats in made:
            place = offset = 0
            for x in sorted(set(combo), reverse=True):
                n = combo.count(x)
                runs.setdefault(x, []).append((taken.get(x, 0), base, n, place, offset))
                taken[x] = taken.get(x, 0) + n * repeats
                place, offset = place + n, offset + n * x
            base += repeats
        self.containers = base
        self.runs = {x: np.array(r, np.int64) for x, r in runs.items()}

    def at(self, length: int, ranks: np.ndarray) -> np.ndarray:
        """(container, place, offset) of the items of one length with these ranks."""
        runs = self.runs[length]
        run = runs[np.searchsorted(runs[:, 0], ranks, "right") - 1]
        k = ranks - run[:, 0]
        return np.stack([run[:, 1] + k // run[:, 2], run[:, 3] + k % run[:, 2], run[:, 4] + (k % run[:, 2]) * length], axis=1)


_PLACED = "key long, part int, n_tokens int, first_token long, container long, place int, offset int"


def pack(sized: DataFrame, key: str, size: str, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """Container and place of every item: (key, part, n_tokens, first_token, container, place, offset).

    An item larger than ``capacity`` fills containers by itself with all its parts but the last,
    which is packed like other items; no other item is split. ``place`` and ``offset`` are the
    item's number and first token in its container, both from 0. Items without size (null, 0 or
    less) get one row with null container, place and offset. Repeated keys are packed each. Ties
    among items of one length are decided by hash and key. An empty table gives no rows.
    """
    whole = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    items = sized.select(F.col(key).cast("long").alias("key"), whole.alias("whole"))
    parts = F.expr(f"explode(sequence(0L, cast(greatest(ceil(whole / {capacity}D), 1) - 1 as long)))")
    items = items.select("key", "whole", parts.alias("part"))
    items = items.select("key", F.col("part").cast("int").alias("part"), (F.col("part") * capacity).alias("first_token"), F.least(F.col("whole") - F.col("part") * capacity, F.lit(capacity)).cast("int").alias("n_tokens"))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("key", "part"), F.lit(BUCKETS)).cast("int"))
    held = cut(items)
    counts = held.where("n_tokens > 0").groupBy("n_tokens", "bucket").agg(F.count("*").alias("n"))
    counts = cut(counts)
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[row.n_tokens] = row.n
    slots = _Slots(plan(histogram, window))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("n_tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    order = W.partitionBy("n_tokens", "bucket").orderBy(F.xxhash64("key"), "key", "part")
    ranked = held.where("n_tokens > 0").withColumn("nth", F.row_number().over(order) - 1).join(before, ["n_tokens", "bucket"])
    ranked = ranked.select("key", "part", "n_tokens", "first_token", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            out = np.zeros((len(length), 3), np.int64)
            for x in np.unique(length).tolist():
                mine = length == x
                out[mine] = slots.at(x, rank[mine])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(4)], pa.array(out[:, 0]), pa.array(out[:, 1].astype(np.int32)), pa.array(out[:, 2].astype(np.int32))],
                names=["key", "part", "n_tokens", "first_token", "container", "place", "offset"],
            )

    none = [F.lit(None).cast(t).alias(n) for n, t in (("container", "long"), ("place", "int"), ("offset", "int"))]
    without = held.where("n_tokens <= 0").select("key", "part", "n_tokens", "first_token", *none)
    return ranked.mapInArrow(place, _PLACED).union(without).withColumnRenamed("key", key)


def packed_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """The packing of the texts of documents, measured in tokens of a public vocabulary."""
    return pack(with_tokens(documents.select("doc_id", "text"), name="size", vocabulary=vocabulary), "doc_id", "size", capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers, tokens and the share of the containers' room that stays unused."""
    by = packed.where("container IS NOT NULL").agg(F.count("*").alias("n_items"), F.countDistinct("container").alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return by.withColumn("unused", F.when(F.col("n_containers") > 0, 1 - F.col("n_tokens") / (F.col("n_containers") * capacity)))
