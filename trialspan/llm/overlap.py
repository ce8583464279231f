"""Sessions that stand, exactly or almost, on both sides of a train and evaluation split.

Method: exact candidates by the pigeonhole principle. The sequence in train is cut into segments of
``RUN`` trials, and any D + 1 + ``SPARE`` of them will do, D being the largest distance it can have to
any sequence within the share: d edits leave all but d of them as they are, moved by at most the
distance. The rarest are taken. Every distinct sequence is joined on equal segments with the windows of
the same length of the sequences in evaluation splits, without exception and whatever trials are edited.

A meeting counts if the lengths, the places and the counts of trials in ``CELLS`` cells allow the distance,
which is told in the join from what its rows carry; nothing else is shuffled. Pairs that share as many
segments as d edits must leave are kept, and those beyond the radius of their histogram bits are dropped:
the trials are hashed to ``BUCKETS`` buckets, and a bucket with c trials has its lowest min(c, 8)
bits set. One edit turns at most two of these bits, so sequences within distance d lie within
Hamming radius 2 d. What is left gets its edit distance computed exactly.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trialspan.runtime import cut

LEAST_TRIALS = 20
SHARE = 0.1
#: segments beyond those needed for one in common: two must be shared
SPARE = 1
#: trials of a segment, where the sequence has room for enough of them
RUN = 6
#: a segment of more sequences than this is spread over so many tasks
HOT, SALTS = 5000, 32
BUCKETS = 32
#: cells of the counts that a row of the join carries, a byte each
CELLS = 8
#: gains above this are hundredths
HUNDREDTHS_FROM = 1000.0

# Spellings of the splits.
SPLITS = {
    "train": "train", "training": "train",
    "validation": "validation", "valid": "validation", "val": "validation", "dev": "validation",
    "test": "test", "heldout": "test",
}


def split_name(raw: Column) -> Column:
    """``train``, ``validation`` or ``test`` of a split as written; null for any other value."""
    names = F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv])
    return F.element_at(names, F.lower(F.trim(raw)))


def whole_units(gain: np.ndarray, loss: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(gain, size of loss) of each trial in whole money units, packed into one integer.

    A trial's unit is told by its gain; where that is zero or missing, by the nearest earlier
    gain of the session, else by the nearest later one, else the loss is taken as it is. Missing
    and infinite amounts become one value of their own that equals itself.
    """
    n = len(gain)
    told = np.where(np.isfinite(gain) & (gain != 0), np.where(np.abs(gain) > HUNDREDTHS_FROM, 100, 1), 0)
    session = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.arange(n)
    back = np.maximum.accumulate(np.where(told > 0, at, -1))
    ahead = np.minimum.accumulate(np.where(told > 0, at, n)[::-1])[::-1]
    before = np.where((back >= 0) & (session[np.maximum(back, 0)] == session), told[np.maximum(back, 0)], 0)
    after = np.where((ahead < n) & (session[np.minimum(ahead, n - 1)] == session), told[np.minimum(ahead, n - 1)], 0) if n else told
    unit = np.where(before > 0, before, np.where(after > 0, after, 1))

    def whole(x: np.ndarray) -> np.ndarray:
        fine = np.isfinite(x) & (np.abs(x) < 1e8)
        return np.where(fine, np.floor(np.where(fine, x, 0) / unit + 0.5), 2**30).astype(np.int64)

    return (whole(gain) << 32) | whole(np.abs(loss))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit integers (finaliser of a public splitmix generator)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def most_edits(n: int) -> int:
    """The largest distance within the share that a sequence of ``n`` trials has to one as long or shorter."""
    return int(SHARE * n + 1e-9)


@cache
def edits_of(n: int) -> int:
    """The largest distance within the share that a sequence of ``n`` trials has to any, the longer ones included."""
    longest = n
    while longest + 1 - most_edits(longest + 1) <= n:
        longest += 1
    return most_edits(longest)


def parts_of(n: int) -> int:
    """How many segments of a sequence of ``n`` trials are joined."""
    return edits_of(n) + 1 + SPARE


@cache
def segments(n: int) -> tuple[int, np.ndarray]:
    """Length and starts of disjoint segments of a sequence of ``n`` trials, at least ``parts_of(n)``."""
    length = min(RUN, n // parts_of(n))
    return length, np.arange(n // length) * length


@cache
def window_lengths(n: int) -> list[int]:
    """Lengths of the segments of all sequences that one of ``n`` trials can be near to."""
    near = range(max(LEAST_TRIALS, n - most_edits(n)), n + edits_of(n) + 1)
    return sorted({segments(m)[0] for m in near})


def _run_keys(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of 48 bits, two bytes of a shuffled row less than 64, of the run of ``length`` trials from each place on."""
    item = _mixed(codes.view(np.uint64))
    spots = max(len(codes) - length + 1, 0)
    run = np.full(spots, length, np.uint64)
    for j in range(length):
        run = _mixed(run * np.uint64(31) + item[j : j + spots])
    return (run >> np.uint64(16)).view(np.int64)


def run_keys(codes: np.ndarray, starts: np.ndarray, windows: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(session, key, place) of the segments of each session, the ``parts_of`` rarest among those given, or of all windows that may equal a segment of another."""
    spots: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, n in enumerate(np.diff(starts).tolist()):
        for length in window_lengths(n) if windows else [segments(n)[0]]:
            spots.setdefault(length, []).append((i, np.arange(n - length + 1) if windows else segments(n)[1]))
    out = []
    for length, found in spots.items():
        session = np.repeat([i for i, _ in found], [len(p) for _, p in found])
        place = np.concatenate([p for _, p in found])
        key = _run_keys(codes, length)[starts[session] + place]
        if not windows:
            _, at, count = np.unique(key, return_inverse=True, return_counts=True)
            order = np.lexsort((count[at], session))
            sizes = [len(p) for _, p in found]
            rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            parts = np.repeat([parts_of(n) for n in np.diff(starts)[[i for i, _ in found]].tolist()], sizes)
            kept = np.sort(order[rank < parts])
            session, key, place = session[kept], key[kept], place[kept]
        out.append((session, key, place))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def histogram_bits(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sessions, BUCKETS / 8) words of 64 bits, 8 bits to a bucket of trials."""
    n = len(starts) - 1
    bucket = (_mixed(codes.view(np.uint64)) >> np.uint64(32)).astype(np.int64) % BUCKETS
    session = np.repeat(np.arange(n), np.diff(starts))
    counts = np.bincount(session * BUCKETS + bucket, minlength=n * BUCKETS)
    filled = ((1 << np.minimum(counts, 8)) - 1).astype(np.uint8)
    return filled.view(np.int64).reshape(n, BUCKETS // 8)


def cell_counts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each session a word of ``CELLS`` bytes: the trials of each cell, 255 at most. One edit changes two cells by one at most."""
    n = len(starts) - 1
    cell = (_mixed(codes.view(np.uint64)) >> np.uint64(40)).astype(np.int64) % CELLS
    counts = np.bincount(np.repeat(np.arange(n), np.diff(starts)) * CELLS + cell, minlength=n * CELLS)
    return np.minimum(counts, 255).astype(np.uint8).view(np.int64)


_CODED = "row_id long, side string, class binary, codes binary"
_SCHEMA = pa.schema([("row_id", pa.int64()), ("side", pa.string()), ("class", pa.binary()), ("codes", pa.binary())])


def _packed(codes: np.ndarray) -> bytes:
    """Trials compressed byte by byte: most bytes of an amount are zero."""
    return zlib.compress(np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gains, losses = batch.column("gain"), batch.column("loss")
        starts = gains.offsets.to_numpy().astype(np.int64)
        starts, base = starts - starts[0], int(starts[0])
        flat = [c.values.slice(base, int(starts[-1])).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in (gains, losses)]
        codes = whole_units(flat[0], flat[1], starts)
        raw = [codes[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_id"), batch.column("side"), pa.array([hashlib.md5(r).digest() for r in raw], pa.binary()), pa.array([_packed(codes[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary())],
            schema=_SCHEMA,
        )


def coded_sessions(manifest: DataFrame) -> DataFrame:
    """Rows of a split with at least ``LEAST_TRIALS`` trials, with class and compressed trials."""
    side = split_name(F.col("split"))
    chosen = manifest.where((F.size("trials") >= LEAST_TRIALS) & side.isNotNull() & F.col("row_id").isNotNull())
    flat = chosen.select("row_id", side.alias("side"), F.col("trials.gain").alias("gain"), F.col("trials.loss").alias("loss"))
    return flat.mapInArrow(_code, _CODED)


def edit_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences by bit-parallel columns; ``most`` + 1 stands for any larger one."""
    n, rest = len(a), len(b)
    if abs(n - rest) > most:
        return most + 1
    if not n or not rest:
        return n + rest
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    mask, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = mask, 0, n
    for x in b:
        eq = where.get(x, 0)
        vertical = eq | down
        level = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(level | up) & mask, up & level
        score += (rise & top > 0) - (fall & top > 0)
        rest -= 1
        if score - rest > most:
            return most + 1
        rise, fall = (rise << 1 | 1) & mask, fall << 1 & mask
        up, down = fall | ~(vertical | rise) & mask, rise & vertical
    return score if score <= most else most + 1


def _trials(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The trials of compressed sequences, and where each begins."""
    plain = [np.frombuffer(zlib.decompress(r), np.uint8).reshape(8, -1).T for r in raw]
    return np.concatenate([np.zeros((0, 8), np.uint8), *plain]).view(np.int64).ravel(), np.cumsum([0, *map(len, plain)])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (batch.column(c) for c in ("a", "b", "codes_a", "codes_b"))
        (p, at), (q, to) = _trials(x.to_pylist()), _trials(y.to_pylist())
        turned = np.bitwise_count((histogram_bits(p, at) ^ histogram_bits(q, to)).view(np.uint64)).sum(axis=1)
        most = [most_edits(n) for n in np.maximum(np.diff(at), np.diff(to)).tolist()]
        keep, far = [], []
        for i in np.nonzero(turned <= 2 * np.array(most, np.int64))[0].tolist():
            d = edit_distance(p[at[i] : at[i + 1]].tolist(), q[to[i] : to[i + 1]].tolist(), most[i])
            if d <= most[i]:
                keep.append(i)
                far.append(d)
        yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int32())), b.take(pa.array(keep, pa.int32())), pa.array(far, pa.int32())], names=["a", "b", "distance"])


_KEYED = "key long, id long, n int, place int, cells long"


def _keyed(windows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, starts = _trials(batch.column("codes").to_pylist())
            session, key, place = run_keys(codes, starts, windows)
            n, cells = np.diff(starts), cell_counts(codes, starts)
            columns = [pa.array(key), batch.column("id").take(pa.array(session, pa.int64())), pa.array(n[session], pa.int32()), pa.array(place, pa.int32()), pa.array(cells[session])]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "n", "place", "cells"])

    return run


def most_apart() -> Column:
    """The largest distance that sequences ``p`` and ``q`` may have, by the longer one."""
    return F.expr(f"cast(floor({SHARE} * greatest(p.n, q.n) + 1e-9) as int)")


def may_be_near() -> Column:
    """Whether an equal run leaves ``p`` and ``q`` room for the distance: trials put in or left out before it and behind it, and by the counts of the cells."""
    moved = F.expr("abs(p.place - q.place) + abs((q.n - q.place) - (p.n - p.place))")
    apart = F.expr(" + ".join(f"abs((shiftrightunsigned(p.cells, {8 * i}) & 255) - (shiftrightunsigned(q.cells, {8 * i}) & 255))" for i in range(CELLS)))
    return (moved <= most_apart()) & (apart <= 2 * most_apart())


def salted(p: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``salt``: a segment of more than ``HOT`` sequences of ``p`` is spread over ``SALTS`` tasks, for which the rows of ``q`` with it are repeated.

    There are no more such segments than one for ``HOT`` rows of ``p``; they are broadcast, so that no row is shuffled for them.
    """
    hot = F.broadcast(cut(p.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(F.col("key").alias("hot"))))
    p = p.join(hot, F.col("key") == F.col("hot"), "left").withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    spread = F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return p, q.join(hot, F.col("key") == F.col("hot"), "left").withColumn("salt", F.explode_outer(spread)).drop("hot")


def sequence_classes(coded: DataFrame) -> DataFrame:
    """The different sequences: id, class, compressed trials, and how many rows in train and in evaluation splits have them."""
    train = F.count(F.when(F.col("side") == "train", 1))
    classes = coded.groupBy("class").agg(train.alias("n_train"), (F.count("*") - train).alias("n_held"), F.first("codes").alias("codes"))
    return cut(classes.withColumn("id", F.monotonically_increasing_id()))


def candidates(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids of different sequences, a in train and b in an evaluation split, that share enough segments: all that are near, and few others."""
    p, q = salted(classes.where("n_train > 0").select("id", "codes").mapInArrow(_keyed(False), _KEYED), classes.where("n_held > 0").select("id", "codes").mapInArrow(_keyed(True), _KEYED))
    p, q = p.alias("p"), q.alias("q")
    met = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.salt") == F.col("q.salt")) & (F.col("p.id") != F.col("q.id")) & may_be_near())
    parts = F.udf(lambda n: parts_of(n), "int")
    by = met.groupBy(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("p.n").alias("n"), most_apart().alias("most")).agg(F.countDistinct("p.place").alias("shared"))
    return by.where(F.col("shared") > SPARE).where(F.col("shared") >= parts("n") - F.col("most")).select("a", "b")


def near_classes(classes: DataFrame) -> DataFrame:
    """Pairs (a, b, distance) of ids of different sequences, a in train and b in an evaluation split.

    Segments and windows are joined by their keys alone; trials are fetched for the pairs that share enough.
    """
    p, q = (classes.where(f"{n} > 0").select(F.col("id").alias(x), F.col("codes").alias(f"codes_{x}")) for x, n in (("a", "n_train"), ("b", "n_held")))
    return candidates(classes).join(p, "a").join(q, "b").select("a", "b", "codes_a", "codes_b").mapInArrow(_verify, "a long, b long, distance int")


def crossing_pairs(manifest: DataFrame) -> DataFrame:
    """All pairs of rows, one in train and one in validation or test, whose trials are the same or nearly so.

    Columns row_id_a < row_id_b, side (the evaluation split), train_row_id, held_row_id and
    distance in trials. Equal sequences are found as classes and only expanded at the end. Rows
    with null or fewer than 20 trials, or without a known split, are in no pair. A sequence of
    trials is compared as a whole, whatever its length.
    """
    coded = coded_sessions(manifest)  # coded twice rather than stored: the trials are most of the disk
    classes = sequence_classes(coded)
    near = near_classes(classes)
    members = coded.select("row_id", "side", "class").join(classes.where("n_train > 0 OR n_held > 0").select("class", "id"), "class")
    train = members.where("side = 'train'").select(F.col("row_id").alias("train_row_id"), F.col("id").alias("a"))
    held = members.where("side <> 'train'").select(F.col("row_id").alias("held_row_id"), "side", F.col("id").alias("b"))
    same = train.join(held, F.col("a") == F.col("b")).select("train_row_id", "held_row_id", "side", F.lit(0).alias("distance"))
    other = train.join(near, "a").join(held, "b").select("train_row_id", "held_row_id", "side", "distance")
    return same.union(other).select(
        F.least("train_row_id", "held_row_id").alias("row_id_a"), F.greatest("train_row_id", "held_row_id").alias("row_id_b"),
        "train_row_id", "held_row_id", "side", "distance",
    )


def overlap_by_row(manifest: DataFrame) -> DataFrame:
    """Every row of an evaluation split with enough trials: (row_id, class, distance, n_train_rows).

    ``class`` names its sequence, ``n_train_rows`` is the number of its links and ``distance`` the least of
    them, null where there is none. Copies are counted by class, not expanded to pairs.
    """
    coded = coded_sessions(manifest)  # coded twice rather than stored: the trials are most of the disk
    classes = sequence_classes(coded)
    links = near_classes(classes).join(classes.select(F.col("id").alias("a"), "n_train"), "a").select(F.col("b").alias("id"), "distance", "n_train")
    links = links.union(classes.where("n_train > 0 AND n_held > 0").select("id", F.lit(0).alias("distance"), "n_train"))
    by = links.groupBy("id").agg(F.min("distance").alias("distance"), F.sum("n_train").alias("n_train_rows"))
    told = classes.where("n_held > 0").join(by, "id", "left").select("class", "distance", F.coalesce("n_train_rows", F.lit(0)).alias("n_train_rows"))
    return coded.where("side <> 'train'").select("row_id", "class").join(told, "class").select("row_id", F.hex("class").alias("class"), "distance", "n_train_rows")


def overlap_report(manifest: DataFrame) -> DataFrame:
    """Per evaluation split and experiment: rows that also stand in train, and how many exactly.

    ``experiment`` is compared in one spelling (lower case, ``_`` between its parts). Rows with too few trials count as rows.
    """
    one = F.regexp_replace(F.lower(F.trim("experiment")), "[-\\s]+", "_")
    rows = manifest.select("row_id", split_name(F.col("split")).alias("side"), one.alias("experiment")).where("side <> 'train'")
    found = overlap_by_row(manifest).where("n_train_rows > 0").groupBy("row_id").agg(F.min("distance").alias("distance"), F.max("n_train_rows").alias("n_train_rows"))
    rows = rows.join(found, "row_id", "left")
    return rows.groupBy("side", "experiment").agg(
        F.count("*").alias("n_rows"), F.count("n_train_rows").alias("n_overlapping"),
        F.count(F.when(F.col("distance") == 0, 1)).alias("n_exact"), F.coalesce(F.sum("n_train_rows"), F.lit(0)).alias("n_train_rows"),
    )
