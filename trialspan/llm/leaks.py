"""Evaluation passages in documents.

Method: greedy string tiling. Documents and items are joined on shared tokens, counted in stretches
of a document, which leaves no item out that could reach the share; for each pair that shares enough
the longest common runs are marked again and again with Karp-Rabin hashes until none is left, and
the tiles in the item's order must cover some of the item. An exact count of the words in common
and in order follows, over every stretch that begins at a shared word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialspan.llm.words import words_of

#: tiles are of so many words or more
TILE = 2
#: share of the item's words that must stand in the stretch
SHARE = 0.6
#: share that the tiles alone must cover. Where 0.6 of the words stand in order, neighbours among them make up
#: at least 0.2 of the item, wherever the other words were exchanged or left out: this loses no case.
TILED = 0.19
#: the stretch may be so many times as long as the item
STRETCH = 1.35
#: items whose shared words are counted together, entries of a table of their words, and code points of items that go along in one pass over the documents
BLOCK, TABLE, PASS = 500, 1 << 24, 64_000_000
#: items of a block whose lengths differ by no more are counted in windows of one length
ALIKE = 1.35
#: documents whose candidates are counted in order together, and candidates that are advanced together
TOGETHER, LANES = 500, 4000
#: words of documents that are listed together, and bytes of counts that are held at a time
LISTED, HELD = 50_000, 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all runs of n ids; empty if there are fewer."""
    spots = len(ids) - n + 1
    if spots <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(spots, np.uint64)
    for j in range(n):
        h = h * _BASE + ids[j : j + spots].astype(np.uint64) + np.uint64(1)
    return h ^ (h >> np.uint64(29))


def tiles(item: list[int], stretch: list[int], least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping maximal common runs (item at, stretch at, length), the longest first.

    Ties are marked from the left. Both sequences are short: an item and a stretch of its size.
    """
    found: list[tuple[int, int, int]] = []
    free_a, free_b = [True] * len(item), [True] * len(stretch)
    size = min(len(item), len(stretch))
    starts: dict[tuple, list[int]] = defaultdict(list)
    for i in range(len(item) - least + 1):
        starts[tuple(item[i : i + least])].append(i)
    seeds = [(i, j) for j in range(len(stretch) - least + 1) for i in starts.get(tuple(stretch[j : j + least]), ())]
    while seeds and size >= least:
        best: list[tuple[int, int, int]] = []
        longest, kept = least - 1, []
        for i, j in seeds:
            if not (free_a[i] and free_b[j]):
                continue
            if i and j and item[i - 1] == stretch[j - 1] and free_a[i - 1] and free_b[j - 1]:
                kept.append((i, j))  # within a run that is longer from its beginning
                continue
            k = 0
            while i + k < len(item) and j + k < len(stretch) and item[i + k] == stretch[j + k] and free_a[i + k] and free_b[j + k]:
                k += 1
            if k >= least:
                kept.append((i, j))
                if k > longest:
                    longest, best = k, []
                if k == longest:
                    best.append((i, j, k))
        for i, j, k in best:
            if all(free_a[i : i + k]) and all(free_b[j : j + k]):
                found.append((i, j, k))
                free_a[i : i + k] = free_b[j : j + k] = [False] * k
        seeds, size = kept, longest
    return found


def ordered_cover(found: list[tuple[int, int, int]]) -> int:
    """Words in the heaviest chain of tiles that stand in the same order on both sides."""
    chain = sorted(found)
    best = [0] * len(chain)
    for x, (i, j, k) in enumerate(chain):
        best[x] = k + max((best[y] for y in range(x) if chain[y][1] + chain[y][2] <= j and chain[y][0] + chain[y][2] <= i), default=0)
    return max(best, default=0)


def places_of(item: list[int]) -> dict[int, int]:
    """For each word id the places where the item has it, as bits."""
    where: dict[int, int] = {}
    for i, x in enumerate(item):
        where[x] = where.get(x, 0) | 1 << i
    return where


def common_in_order(size: int, places: list[int]) -> int:
    """Length of the longest common subsequence of an item of ``size`` words and a stretch, given as bits of places."""
    mask = row = (1 << size) - 1
    for x in places:
        hit = row & x
        row = (row + hit | row - hit) & mask
    return size - row.bit_count()


class _Alike(NamedTuple):
    """Items of a block that are of like lengths, with one length of window that holds a stretch of each."""

    first: int
    span: int
    #: words that each item needs, and for the n-th time that a word comes up in a window whether each item has it so often (the first row has nothing), packed to 64 bits
    need: np.ndarray
    table: np.ndarray


class _Block:
    """A block of items, the shortest first, as word ids, with how often each item has each word."""

    def __init__(self, keys: list[int], items: list[np.ndarray]) -> None:
        self.keys, self.items = keys, items
        self.own = np.unique(np.concatenate(items))
        self.row_of = np.full(int(self.own[-1]) + 2, len(self.own))
        self.row_of[self.own] = np.arange(len(self.own))
        size = np.array([len(i) for i in items])
        kind = next(t for t in (np.uint8, np.uint16, np.uint32) if size.max() <= np.iinfo(t).max)  # holds the words of an item
        counts = np.zeros((len(self.own) + 1, len(items)), kind)  # the last row is that of all other words
        for x, ids in enumerate(items):
            word, n = np.unique(ids, return_counts=True)
            counts[np.searchsorted(self.own, word), x] = n
        self.by_item = np.ascontiguousarray(counts.T)
        self.need = np.ceil(SHARE * size - 1e-9).astype(int)
        self.span = (STRETCH * size).astype(int) + 1
        self.step = int(self.span.max())
        # of each item's each word the places where the item has it, as bits of words of 64; found by item and row of ``counts``
        self.words = -(-int(size.max()) // 64)
        of = np.repeat(np.arange(len(items)), size)
        key = of * len(self.own) + np.searchsorted(self.own, np.concatenate(items))
        place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        self.pairs, at = np.unique(key, return_inverse=True)
        self.bits = np.zeros((self.words, len(self.pairs)), np.uint64)
        np.bitwise_or.at(self.bits, (place // 64, at), np.uint64(1) << (place % 64).astype(np.uint64))
        self.size = size
        self.most = counts.max(axis=1).astype(np.int64)  # how often any item has a word
        self.before = np.cumsum(self.most) - self.most  # rows of a table before those of a word
        word = np.repeat(np.arange(len(self.most)), self.most)
        nth = (np.arange(len(word)) - self.before[word] + 1).astype(kind)
        self.alike: list[_Alike] = []
        until = 0
        while (first := until) < len(items):
            until = int(np.searchsorted(size, ALIKE * size[first], side="right"))
            wide = -(-(until - first) // 8) * 8
            table, need = np.zeros((len(word) + 1, wide), kind), np.full(wide, np.iinfo(kind).max, kind)
            table[1:, : until - first] = counts[word, first:until] >= nth[:, None]
            need[: until - first] = self.need[first:until]
            self.alike.append(_Alike(first, int(self.span[until - 1]), need, table.view(np.uint64)))

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """For each word of a document its row of ``counts``."""
        return self.row_of.take(np.minimum(ids, len(self.row_of) - 1))

    def leaked(self, documents: list[np.ndarray]) -> Iterator[tuple[int, int, int, float, float]]:
        """(document, item, first word of the stretch, share tiled, share in common) of each item in each document.

        Words in common and in order are counted for all documents together: first from the first begin
        to the last end within a step, then from each begin of what is left.
        """
        some: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        part, listed = [], 0
        for doc, ids in enumerate(documents):
            part.append((doc, self.rows(ids)))
            listed += len(ids)
            if listed >= LISTED or doc + 1 == len(documents):
                some += self._candidates(part)
                part, listed = [], 0
        if not some:
            return
        whole = self._common([(x, words[first[0] : ends[-1]]) for _, x, words, first, ends, _ in some])
        some = [r for r, n in zip(some, whole.tolist(), strict=True) if n >= self.need[r[1]]]
        each = self._common([(x, words[j:e]) for _, x, words, first, ends, _ in some for j, e in zip(first.tolist(), ends.tolist(), strict=True)])
        best: dict[tuple[int, int], tuple[float, float, int]] = {}
        done = 0
        for doc, x, _, first, _, begins in some:
            common = each[done : done + len(first)]
            done += len(first)
            most = int(common.max())
            if most < self.need[x]:
                continue
            n, begin = int(self.size[x]), int(begins[int(common.argmax())])
            tiled = ordered_cover(tiles(self.items[x].tolist(), documents[doc][begin : begin + int(self.span[x])].tolist())) / n
            if tiled >= TILED:
                best[doc, x] = max(best.get((doc, x), (0.0, 0.0, 0)), (most / n, tiled, -begin))
        for (doc, x), (share, tiled, first) in best.items():
            yield doc, self.keys[x], -first, tiled, share

    def _candidates(self, part: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(document, item, words of it that the item has, first and end among these of each stretch, begins of the stretches) by steps of a document."""
        part = [(doc, rows) for doc, rows in part if np.count_nonzero(rows < len(self.own)) >= self.need[0]]
        if not part:
            return
        length = np.array([len(rows) for _, rows in part])
        rows = np.concatenate([rows for _, rows in part])
        start = np.cumsum(length) - length
        at, item = self._begins(rows, length)
        of = np.repeat(np.arange(len(part)), length)[at]
        at -= start[of]
        last = np.maximum(-(-(length - self.step) // self.step) - 1, 0)[of]
        step = np.minimum(at // self.step, last)
        order = np.lexsort((at, step, item, of))
        at, item, of, step = at[order], item[order], of[order], step[order]
        new = np.nonzero((np.diff(of) != 0) | (np.diff(item) != 0) | (np.diff(step) != 0))[0] + 1
        for begins, x, k in zip(np.split(at, new), item[[0, *new]].tolist() if len(at) else (), of[[0, *new]].tolist() if len(at) else (), strict=False):
            doc, own = part[k]
            ends = np.minimum(begins + self.span[x], len(own))
            words = own[begins[0] : ends[-1]]
            held = np.nonzero(self.by_item[x].take(words))[0]
            yield doc, x, words[held], np.searchsorted(held, begins - begins[0]), np.searchsorted(held, ends - begins[0]), begins

    def _common(self, lanes: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Length of the longest common subsequence of each item and some of its words, given as rows of ``counts``.

        ``common_in_order`` for all lanes together, the longest first; a carry goes on to the next word of 64 bits.
        """
        out = np.zeros(len(lanes), np.int64)
        length = np.array([len(w) for _, w in lanes], np.int64)
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(order), LANES):
            part = order[at : at + LANES]
            n, x = length[part], np.array([lanes[i][0] for i in part.tolist()])
            where = np.zeros((int(n[0]), len(part)), np.int64)
            lane = np.repeat(np.arange(len(part)), n)
            flat = np.concatenate([lanes[i][1] for i in part.tolist()])
            where[np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n), lane] = np.searchsorted(self.pairs, x[lane] * len(self.own) + flat)
            going = np.searchsorted(-n, -np.arange(len(where)), side="left").tolist()
            words = -(-int(self.size[x].max()) // 64)
            free = np.full((words, len(part)), ~np.uint64(0))
            for j, a in enumerate(going):
                carry = None
                for k in range(words):
                    row, hit = free[k, :a], self.bits[k].take(where[j, :a])
                    rest = row & ~hit
                    hit &= row
                    hit += row
                    over = hit < row
                    if carry is not None:
                        hit += carry
                        over |= hit < carry
                    if k + 1 < words:
                        carry = over.astype(np.uint64)
                    hit |= rest
                    free[k, :a] = hit
            size = self.size[x]
            for k in range(words):
                room = np.clip(size - 64 * k, 0, 64)
                mask = np.where(room == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(room, 63).astype(np.uint64)) - np.uint64(1))
                out[part] += room - np.bitwise_count(free[k] & mask)
        return out

    def _begins(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in some documents, one behind the other, and items of which a stretch may begin there.

        It may where the item has the word, and the window from there holds enough words of the item, each counted no
        more often than the item has it. A window's count is that of the window before without the word that has left
        it and with the word that has come, where the item has the one and the other so often as the window has. Eight items
        or so are added at once as the bytes of a word of 64 bits: sums may run over, but no count that is left does.
        """
        total, until = len(rows), np.cumsum(length)
        own = np.nonzero(rows < len(self.own))[0]
        apart = own + np.repeat(np.arange(len(length)) * self.step, length)[own]  # no window holds words of two documents
        key = rows[own] * (int(apart[-1]) + self.step + 1) + apart
        order = np.argsort(key)
        key, place = key[order], own[order]
        here, most, before = np.arange(len(key)), self.most[rows[place]], self.before[rows[place]]
        until = np.repeat(until, length)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for first, span, need, table in self.alike:
            back = np.searchsorted(key, key - span, side="right")  # the first of the same word in a window that ends with it
            rank = here - back + 1
            comes, leaves = np.zeros(total, np.int64), np.zeros(total, np.int64)
            comes[place] = np.where(rank <= most, before + rank, 0)
            rank = np.cumsum(np.bincount(back, minlength=len(key))) - here
            leaves[place] = np.where(rank <= most, before + rank, 0)
            ends = np.minimum(np.arange(total) + span, until) - 1
            so_far, size = np.zeros(table.shape[1], np.uint64), max(span, HELD // (8 * table.shape[1]))
            for a in range(0, total, size):
                b = min(a + size, total)
                come = table.take(comes[a : b + span], axis=0)
                np.cumsum(come, axis=0, out=come)
                gone = np.zeros((b - a + 1, table.shape[1]), np.uint64)
                np.cumsum(table.take(leaves[a:b], axis=0), axis=0, out=gone[1:])
                count = come.take(ends[a:b] - a, axis=0)
                count += so_far
                count -= gone[:-1]
                so_far += come[b - a - 1] - gone[-1]
                enough = (count.view(need.dtype) >= need).reshape(-1, 8)
                eight = np.flatnonzero(enough.view(np.uint64))
                which = np.flatnonzero(enough[eight])
                at, x = np.divmod(eight[which // 8] * 8 + which % 8, len(need))
                at, x = at + a, x + first
                held = self.by_item[x, np.minimum(rows[at], len(self.own) - 1)] > 0
                held &= rows[at] < len(self.own)
                found.append((at[held], x[held]))
        return np.concatenate([at for at, _ in found]), np.concatenate([x for _, x in found])


class _Items:
    """The items of a pass: one vocabulary, and blocks of items."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        new = self.vocabulary.setdefault
        listed = [(k, np.array([new(w, len(self.vocabulary) + 1) for w in words_of(t)], np.int64)) for k, t in rows]
        listed = sorted(((k, i) for k, i in listed if len(i) >= TILE), key=lambda x: len(x[1]))  # like lengths together
        parts, words = [], 0
        for one in listed:
            words += len(one[1])
            if not parts or len(parts[-1]) == BLOCK or (len(parts[-1]) + 1) * words > TABLE:
                parts.append([])
                words = len(one[1])
            parts[-1].append(one)
        self.blocks = [_Block([k for k, _ in part], [i for _, i in part]) for part in parts]

    def leaked(self, documents: list[list[str]]) -> Iterator[tuple[int, int, int, float, float]]:
        """(place of the document, item, first word, share tiled, share in common)."""
        known = self.vocabulary.get
        ids = [np.fromiter(map(known, words, repeat(0)), np.int64, len(words)) for words in documents]
        for block in self.blocks:
            yield from block.leaked(ids)


_FOUND = "doc_id long, item_id long, first_word int, tiled double, share double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()), ("tiled", pa.float64()), ("share", pa.float64())])


def _search(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _Items(sent.value)
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, TOGETHER):
                docs, texts = (batch.column(i).slice(at, TOGETHER).to_pylist() for i in (0, 1))
                rows += [(docs[i], *found) for i, *found in items.leaked([words_of(t) for t in texts])]
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in rows], schema=_SCHEMA)

    return run


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of a document and an item of which at least ``SHARE`` of the words stand in one stretch of it, in order.

    Columns doc_id, item_id, first_word (where the stretch begins, in words), tiled and share.
    The items are the stated query set: they go over all documents together, up to ``PASS`` code points
    in one pass, so what is sent to the executors is bounded; a text is split to words once a pass.
    Every document stands for itself, copies too. Null or empty texts and null ids on either side are in no pair,
    nor are items of fewer than ``TILE`` words; repeated item rows with one id are compared each, and a pair is stated once.
    """
    spark: SparkSession = documents.sparkSession
    lean = documents.select(F.col("doc_id"), F.col("text")).where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    query = items.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    found, going, size = [], [], 0

    def send() -> None:
        found.append(lean.mapInArrow(_search(spark.sparkContext.broadcast(list(going))), _FOUND))

    for row in query.orderBy("item_id").toLocalIterator():
        if going and size + len(row.text) > PASS:
            send()
            going, size = [], 0
        going.append((row.item_id, row.text))
        size += len(row.text)
    if going:
        send()
    if not found:
        return spark.createDataFrame([], _FOUND)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    best = F.max(F.struct("share", "tiled", (-F.col("first_word")).alias("back"))).alias("best")
    return pairs.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.back")).alias("first_word"), "best.tiled", "best.share")


def leak_report(pairs: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: in how many documents and sources it leaked; items that did not leak have zeros."""
    where = pairs.join(documents.select("doc_id", "source"), "doc_id")
    by = where.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.countDistinct("source").alias("n_sources"), F.max("share").alias("most"))
    return items.select("item_id", "item_set").join(by, "item_id", "left").na.fill(0, ["n_documents", "n_sources"])
