"""Pooled cross-validation of sequential models over all training sessions.

One parameter vector is fitted to the training sessions of each group and fold. All fits advance
together: a pass over the sessions evaluates every vector that any of them asks for, and each
task returns partial sums. Nothing is grouped, so a hot experiment is spread over all tasks;
the driver holds the vectors of the fits alone, groups times folds times starts.

PVL fits go by damped Fisher scoring: a pass gives totals, gradients and Fisher information of every
start that has not settled. Other models go by quasi-Newton descents over totals alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialspan.operators.cognitive import PROVENANCE, Descent, Sessions, hash_folds, member_hash, model, pvl_delta, pvl_scales, spread
from trialspan.runtime import cut

Fold = tuple[str, int]


#: values that are advanced together, so that they stay in the cache
LANES = 6000
#: logits up to this size have exponentials that can be kept from trial to trial
SAFE = 300.0
#: amounts below this size have finite utilities and products of slopes
HUGE = 1e60
#: sessions whose slopes are made together, and widths of blocks of vectors with their cost a lane
SESSIONS, WIDTHS = 1000, {32: 1.0, 16: 1.15, 8: 1.25, 4: 1.8, 2: 3.0, 1: 5.0}
#: partial sums of tasks, in rows, up to which they are added up on the driver
FEW = 200_000
#: rows and columns of the ten numbers of a symmetric matrix of four
UPPER = np.triu_indices(4)


def pvl_totals(vectors: np.ndarray, s: Sessions, rows: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """Totals over finite trials under the PVL model, (rows, vectors): row i is session ``rows[i]`` under ``vectors[fits[i]]``.

    ``vectors`` is (fits, vectors, 4). The same totals as of ``pvl_delta``: a trial without a valid deck changes nothing and is
    left out beforehand, a utility is computed once for each amount, and only the chosen deck's value and exponential change.
    Amounts and vectors must be finite.
    """
    valid = s.deck >= 0
    counts = valid.sum(axis=1)
    who, trial = np.nonzero(valid)
    place = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
    amounts, code = np.unique((s.gain - s.loss)[who, trial], return_inverse=True)
    codes, decks = np.zeros((2, int(counts.max(initial=0)), len(counts)), np.int64)
    codes[place, who], decks[place, who] = code, s.deck[who, trial]
    rate, curve, aversion, c = pvl_scales(np.moveaxis(vectors, -1, 0))
    size = np.abs(amounts)[None, :, None] ** curve[:, None, :]
    pull = c[:, None, :] * np.where(amounts[None, :, None] > 0, size, np.where(amounts[None, :, None] < 0, -aversion[:, None, :] * size, 0.0))
    calm = np.abs(pull).max(axis=2) < SAFE
    pull, k = pull.reshape(-1, vectors.shape[1]), vectors.shape[1]
    most = np.zeros((len(calm), len(counts)), bool)
    for f in range(len(calm)):
        np.logical_or.at(most[f], who, ~calm[f][code])
    out = np.full((len(rows), k), np.inf)
    wild = most[fits, rows]
    for kind in (False, True):
        own = np.nonzero((wild == kind) & (counts[rows] > 0))[0]
        own = own[np.argsort(-counts[rows[own]], kind="stable")]
        for at in range(0, len(own), max(1, LANES // k)):
            part = own[at : at + max(1, LANES // k)]
            n = counts[rows[part]]
            out[part] = _pvl_walk(pull, rate[fits[part]], codes[: n[0], rows[part]] + fits[part] * len(amounts), decks[: n[0], rows[part]], n, kind)
    return out


def _pvl_walk(pull: np.ndarray, rate: np.ndarray, codes: np.ndarray, decks: np.ndarray, counts: np.ndarray, wild: bool) -> np.ndarray:
    """Totals of sessions in order of their lengths, the longest first, (sessions, vectors); ``codes`` and ``decks`` are (trials, sessions)."""
    n, k = rate.shape
    logit, here = np.zeros((4, n, k)), np.arange(n)
    flat, grown = logit.reshape(4 * n, k), None if wild else np.ones((4, n, k))
    places = decks * n + here
    going = np.searchsorted(-counts, -np.arange(len(codes)), side="left")
    total = np.zeros((n, k))
    for j, a in enumerate(going.tolist()):
        place = places[j, :a]
        now, new = flat.take(place, axis=0), pull.take(codes[j, :a], axis=0)
        if wild:
            seen = logit[:, :a]
            top = seen.max(axis=0)
            total[:a] += np.log(np.exp(seen - top).sum(axis=0)) + top - now
        else:
            z = grown[0, :a] + grown[1, :a]
            z += grown[2, :a]
            z += grown[3, :a]
            np.log(z, out=z)
            z -= now
            total[:a] += z
        new -= now
        new *= rate[:a]
        new += now
        flat[place] = new
        if not wild:
            grown.reshape(4 * n, k)[place] = np.exp(new, out=new)
    return total


def _totals(name: str, vectors: np.ndarray, s: Sessions, rows: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """Totals of any model, (rows, vectors), as ``pvl_totals`` has them."""
    if name == "pvl" and np.isfinite(vectors).all() and np.abs(s.gain).max(initial=0) < 1e60 and np.abs(s.loss).max(initial=0) < 1e60:
        return pvl_totals(vectors, s, rows, fits)
    fn, out = model(name)[0], np.full((len(rows), vectors.shape[1]), np.inf)
    for f in np.unique(fits).tolist():
        own = np.nonzero(fits == f)[0]
        part, times = s.only(rows[own]), vectors.shape[1]
        # all vectors by all sessions in one walk: parameters are columns
        wide = Sessions(*[np.tile(x, (times, 1)) for x in (part.deck, part.gain, part.loss)], np.tile(part.lengths, times))
        with np.errstate(all="ignore"):
            nll = fn(np.repeat(vectors[f], len(own), axis=0).T[:, :, None], wide)
        fine = np.isfinite(nll)
        out[own] = np.where(fine.any(axis=1), np.where(fine, nll, 0.0).sum(axis=1), np.inf).reshape(times, -1).T
    return out


def _sums(rows: DataFrame, name: str, asked: dict[Fold, np.ndarray]) -> dict[Fold, np.ndarray]:
    """For each fold the total likelihood of its training sessions under each of its vectors, (folds) -> (vectors,)."""
    targets: dict[str, list[int]] = {}
    for group, fold in asked:
        targets.setdefault(group, []).append(fold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[Fold, np.ndarray] = {}
        for batch in batches:
            groups, folds = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            for group in set(groups):
                own = np.nonzero(groups == group)[0]
                s = Sessions.of(batch.column(2).take(pa.array(own)))
                wanted = targets.get(group, [])
                row, fit = np.nonzero(folds[own][:, None] != np.array(wanted, int))
                if len(row):
                    each = _totals(name, np.array([asked[group, f] for f in wanted]), s, row, fit)
                    for i in np.unique(fit).tolist():
                        sums[group, wanted[i]] = sums.get((group, wanted[i]), 0.0) + each[fit == i].sum(axis=0)
        at = [(g, f, i, float(x)) for (g, f), xs in sums.items() for i, x in enumerate(xs)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in at], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.float64()))], names=["g", "f", "i", "x"])

    out = {k: np.zeros(len(v)) for k, v in asked.items()}
    for r in rows.mapInArrow(run, "g string, f int, i int, x double").groupBy("g", "f", "i").agg(F.sum("x").alias("x")).toLocalIterator():
        out[r.g, r.f][r.i] = r.x
    return out


def pvl_slopes(vectors: np.ndarray, s: Sessions, groups: np.ndarray, owner: np.ndarray, rows: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Sums over sessions under the PVL model, (blocks, 15, vectors): the total over valid trials, its gradient, its Fisher information.

    ``vectors`` is (blocks, vectors, 4); session ``rows[i]`` is counted in block ``blocks[i]``, whose group is ``owner``, that
    of a session ``groups``. The gradient has the order of the parameters, the information that of ``UPPER``. Slopes are exact:
    they follow the recursion of the logits. A block with a session without valid decks is infinite. Amounts and vectors must be finite.
    """
    n, k = vectors.shape[:2]
    valid = s.deck >= 0
    counts = valid.sum(axis=1)
    who, trial = np.nonzero(valid)
    place = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
    nets, code = np.unique((s.gain - s.loss)[who, trial], return_inverse=True)
    pairs, code = np.unique(groups[who] * len(nets) + code, return_inverse=True)
    codes, decks = np.zeros((2, int(counts.max(initial=0)), len(counts)), np.int64)
    codes[place, who], decks[place, who] = code, s.deck[who, trial]
    # each block has a row for each amount of its group: the scaled utility and its slopes by curve and aversion
    first = np.searchsorted(pairs, owner * len(nets))
    size = np.searchsorted(pairs, (owner + 1) * len(nets)) - first
    shift = np.cumsum(size) - size - first
    of = np.repeat(np.arange(n), size)
    net = nets[pairs[np.arange(len(of)) - shift[of]] % len(nets)][:, None] if len(of) else np.zeros((0, 1))
    rate, curve, aversion, c = pvl_scales(np.moveaxis(vectors, -1, 0))
    log = np.log(np.where(net == 0, 1.0, np.abs(net)))
    power = np.where(net == 0, 0.0, np.exp(curve[of] * log) * c[of])
    pull = np.empty((len(of), 3, k))
    pull[:, 2] = np.where(net < 0, -power, 0.0)
    pull[:, 0] = np.where(net > 0, power, aversion[of] * pull[:, 2])
    pull[:, 1] = pull[:, 0] * log
    wild = np.bincount(of, (np.abs(pull[:, 0]) >= SAFE).any(axis=1), n)[blocks] > 0
    out = np.zeros((n, 15, k))
    for kind in (False, True):
        own = np.nonzero((wild == kind) & (counts[rows] > 0))[0]
        own = own[np.argsort(-counts[rows[own]], kind="stable")]
        for at in range(0, len(own), max(1, LANES // k)):
            part = own[at : at + max(1, LANES // k)]
            block, m = blocks[part], counts[rows[part]]
            each = _slopes_walk(pull, rate[block][:, None, :], codes[: m[0], rows[part]] + shift[block], decks[: m[0], rows[part]], m, kind)
            order = np.argsort(block, kind="stable")
            edges = np.nonzero(np.diff(block[order], prepend=-1))[0]
            out[block[order[edges]]] += np.add.reduceat(each[order], edges, axis=0)
    scale = np.stack([1 - c / 5, curve * (1 - curve / 2), aversion * (1 - aversion / 10), rate * (1 - rate)], axis=1)
    square = np.empty((n, 4, 4, k))
    square[:, UPPER[0], UPPER[1]] = square[:, UPPER[1], UPPER[0]] = out[:, 5:] * scale[:, UPPER[0]] * scale[:, UPPER[1]]
    order = np.array([3, 1, 2, 0])
    out[:, 1:5] = (out[:, 1:5] * scale)[:, order]
    out[:, 5:] = square[:, order][:, :, order][:, UPPER[0], UPPER[1]]
    out[np.unique(blocks[counts[rows] == 0]), 0] = np.inf
    return out


def _spill(info: np.ndarray, share: np.ndarray, x: np.ndarray, y: np.ndarray, t: np.ndarray) -> None:
    """Add the outer squares of ``x`` times their shares; ``y`` and ``t`` are space."""
    np.multiply(x, share[:, None], out=y)
    info[:, :4] += np.multiply(x, y[:, :1], out=t)
    info[:, 4:7] += np.multiply(x[:, 1:], y[:, 1:2], out=t[:, 1:])
    info[:, 7:9] += np.multiply(x[:, 2:], y[:, 2:3], out=t[:, 2:])
    info[:, 9] += np.multiply(x[:, 3], y[:, 3], out=t[:, 3])


def _slopes_walk(pull: np.ndarray, rate: np.ndarray, codes: np.ndarray, decks: np.ndarray, counts: np.ndarray, wild: bool) -> np.ndarray:
    """Totals, gradients and information of sessions in order of their lengths, the longest first, (sessions, 15, vectors).

    A deck has its logit and the logit's slopes by curve, aversion and rate; the slope by consistency is in proportion to the logit.
    They stay until the deck is chosen, so its part of the information is its summed probability times their outer square.
    Exponentials are relative to ``base``, which moves where they would leave the range (only ``wild`` ones can).
    """
    n, _, k = rate.shape
    slope, lifted, grown, share = np.zeros((4, n, 4, k)), np.zeros((4, n, 4, k)), np.ones((4, n, k)), np.zeros((4, n, k))
    slopes, lifts, growths, shares = slope.reshape(4 * n, 4, k), lifted.reshape(4 * n, 4, k), grown.reshape(4 * n, k), share.reshape(4 * n, k)
    total, gradient, info, base = np.zeros((n, k)), np.zeros((n, 4, k)), np.zeros((n, 10, k)), np.zeros((n, k))
    space, wide = np.empty((3, n, 4, k)), np.empty((4, n, k))
    pulled, (sums, logs) = np.empty((n, 3, k)), np.empty((2, n, k))
    places, less = decks * n + np.arange(n), 1 - rate[:, 0]
    going = np.searchsorted(-counts, -np.arange(len(codes)), side="left")

    def rebase(far: np.ndarray) -> None:
        base[far] = slope[:, far, 0].max(axis=0)
        grown[:, far] = np.exp(slope[:, far, 0] - base[far])
        lifted[:, far] = grown[:, far][:, :, None] * slope[:, far]

    for j, a in enumerate(going.tolist()):
        place, (x, g, t), d, z, v, i = places[j, :a], space[:, :a], pulled[:a], sums[:a], logs[:a], info[:a]
        np.take(slopes, place, axis=0, out=x, mode="clip")
        np.add(grown[0, :a], grown[1, :a], out=z)
        z += grown[2, :a]
        z += grown[3, :a]
        if wild and z.min() < np.exp(-SAFE):
            rebase(np.nonzero(z.min(axis=1) < np.exp(-SAFE))[0])
            np.sum(grown[:, :a], axis=0, out=z)
        np.log(z, out=v)
        v -= x[:, 0]
        if wild:
            v += base[:a]
        total[:a] += v
        np.divide(1.0, z, out=z)
        np.add(lifted[0, :a], lifted[1, :a], out=g)
        g += lifted[2, :a]
        g += lifted[3, :a]
        g *= z[:, None]
        share[:, :a] += np.multiply(grown[:, :a], z, out=wide[:, :a])
        i[:, :4] -= np.multiply(g, g[:, :1], out=t)
        i[:, 4:7] -= np.multiply(g[:, 1:], g[:, 1:2], out=t[:, 1:])
        i[:, 7:9] -= np.multiply(g[:, 2:], g[:, 2:3], out=t[:, 2:])
        i[:, 9] -= np.multiply(g[:, 3], g[:, 3], out=t[:, 3])
        g -= x
        gradient[:a] += g
        np.take(shares, place, axis=0, out=v, mode="clip")
        shares[place] = 0.0
        _spill(i, v, x, g, t)
        np.take(pull, codes[j, :a], axis=0, out=d, mode="clip")
        d -= x[:, :3]
        x[:, 3] *= less[:a]
        x[:, 3] += d[:, 0]
        d *= rate[:a]
        x[:, :3] += d
        slopes[place] = x
        np.subtract(x[:, 0], base[:a], out=v)
        if wild and v.max() > SAFE:
            rebase(np.nonzero(v.max(axis=1) > SAFE)[0])
            np.subtract(x[:, 0], base[:a], out=v)
        np.exp(v, out=v)
        growths[place] = v
        x *= v[:, None]
        lifts[place] = x
    for q in range(4):
        _spill(info, share[q], slope[q], space[1], space[2])
    return np.concatenate([total[:, None], gradient, info], axis=1)


def _rough_slopes(vectors: np.ndarray, s: Sessions) -> np.ndarray:
    """As ``pvl_slopes`` for all of ``s`` in one block, by differences of the plain model over finite trials: for amounts of any kind."""
    out = np.zeros((15, len(vectors)))
    for i, v in enumerate(vectors):
        h = 1e-4 * np.maximum(1.0, np.abs(v))
        with np.errstate(all="ignore"):
            here, *around = [pvl_delta(p, s) for p in (v, *(v + e for e in np.diag(h)), *(v - e for e in np.diag(h)))]
            by = np.array([(up - down) / (2 * step) for up, down, step in zip(around[:4], around[4:], h, strict=True)])
        fine = np.isfinite(here)
        by = np.where(fine & np.isfinite(by), np.clip(by, -1e100, 1e100), 0.0).reshape(4, -1)
        out[0, i] = np.where(fine, here, 0.0).sum() if fine.any(axis=1).all() else np.inf
        out[1:5, i], out[5:, i] = by.sum(axis=1), (by @ by.T)[UPPER]
    return out


def _asked_slopes(rows: DataFrame, folds: list[Fold], asked: dict[int, np.ndarray], tasks: int) -> dict[int, np.ndarray]:
    """For each fold, by its place in ``folds``, the sums of ``pvl_slopes`` of its training sessions under each of its vectors, (vectors, 15)."""
    cost = lambda w: WIDTHS[w] * sum(-(-len(v) // w) * w for v in asked.values())
    width = min(WIDTHS, key=cost)
    targets: dict[str, list[tuple[int, int, np.ndarray]]] = {}
    for at, vectors in asked.items():
        group, fold = folds[at]
        whole = np.concatenate([vectors, np.repeat(vectors[-1:], -len(vectors) % width, axis=0)]).reshape(-1, width, 4)
        targets.setdefault(group, []).append((at, fold, whole))
    names = [f"x{i}" for i in range(15)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            groups, fold_of = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            wanted = {g: i for i, g in enumerate(sorted(set(groups) & set(targets)))}
            number = np.array([wanted.get(g, -1) for g in groups], np.int64)
            order = np.argsort(number, kind="stable")
            order = order[number[order] >= 0]
            listed = list(wanted)
            for begin in range(0, len(order), SESSIONS):
                own = order[begin : begin + SESSIONS]
                s, number_of = Sessions.of(batch.column(2).take(pa.array(own))), number[own]
                odd = ~((np.abs(s.gain) < HUGE) & (np.abs(s.loss) < HUGE)).all(axis=1)
                blocks: list[np.ndarray] = []
                owner, fits, which, where = [], [], [], []
                for g in np.unique(number_of).tolist():
                    members = np.nonzero(number_of == g)[0]
                    for at, fold, whole in targets[listed[g]]:
                        train = members[fold_of[own[members]] != fold]
                        if len(rough := train[odd[train]]):
                            extra = _rough_slopes(whole.reshape(-1, 4), s.only(rough))
                            sums[at] = sums.get(at, 0.0) + extra.T
                        if len(train := train[~odd[train]]):
                            which += [len(blocks) + b for b in range(len(whole)) for _ in range(len(train))]
                            where += [train] * len(whole)
                            owner += [g] * len(whole)
                            fits += [at] * len(whole)
                            blocks += list(whole)
                if blocks:
                    calm = Sessions(np.where(odd[:, None], -1, s.deck), np.where(odd[:, None], 0.0, s.gain), np.where(odd[:, None], 0.0, s.loss), s.lengths)
                    each = np.moveaxis(pvl_slopes(np.array(blocks), calm, number_of, np.array(owner), np.concatenate(where), np.array(which)), 1, 2)
                    for at in set(fits):
                        sums[at] = sums.get(at, 0.0) + each[np.array(fits) == at].reshape(-1, 15)
        fit = np.repeat(np.array(list(sums), np.int32), [len(x) for x in sums.values()])
        vector = np.concatenate([np.arange(len(x)) for x in sums.values()]) if sums else np.zeros(0)
        values = np.concatenate(list(sums.values())) if sums else np.zeros((0, 15))
        yield pa.RecordBatch.from_arrays([pa.array(fit, pa.int32()), pa.array(vector, pa.int32()), *[pa.array(values[:, i]) for i in range(15)]], names=["f", "i", *names])

    out = {at: np.zeros((-(-len(v) // width) * width, 15)) for at, v in asked.items()}
    told = rows.mapInArrow(run, "f int, i int, " + ", ".join(f"{x} double" for x in names))
    if tasks * sum(len(x) for x in out.values()) > FEW:
        told = told.groupBy("f", "i").agg(*[F.sum(x).alias(x) for x in names])
    table = told.toArrow()
    fit, vector, values = table.column("f").to_numpy(), table.column("i").to_numpy(), np.stack([table.column(x).to_numpy() for x in names], axis=1)
    for at, x in out.items():
        np.add.at(x, vector[fit == at], values[fit == at])
    return {at: x[: len(asked[at])] for at, x in out.items()}


class Scoring:
    """Damped Fisher scoring of many starts at once: each proposes a place, and takes it where its total is lower.

    A start settles where a hardly damped step gains less than ``tolerance`` of the total, or five damped ones in a row do.
    """

    def __init__(self, starts: np.ndarray, tolerance: float = 1e-6) -> None:
        self.x, self.next, self.tolerance = starts.copy(), starts.copy(), tolerance
        n, k = starts.shape
        self.value, self.gradient, self.info = np.full(n, np.inf), np.zeros((n, k)), np.zeros((n, k, k))
        self.damping, self.hoped = np.full(n, 1e-3), np.ones(n)
        self.done, self.converged, self.slow = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, int)

    def take(self, at: np.ndarray, sums: np.ndarray) -> None:
        """Sums of ``pvl_slopes`` at the proposals of the starts ``at``, (starts, 15)."""
        value, fine, fresh = sums[:, 0], np.isfinite(sums).all(axis=1), np.isinf(self.value[at])
        with np.errstate(all="ignore"):
            gain = self.value[at] - value
            ratio = np.where(fresh, 1.0, gain / self.hoped[at])
        lower, slight = fine & (gain > 0), self.tolerance * np.maximum(1.0, np.abs(value))
        self.slow[at] = np.where(lower, np.where(gain <= slight, self.slow[at] + 1, 0), self.slow[at])
        settled = np.where(lower, (gain <= slight) & ((self.damping[at] <= 0.1) | (self.slow[at] >= 5)), fine & (np.abs(gain) <= 1e-3 * slight))
        change = np.select([fresh, ~lower, ratio > 0.5, ratio > 0.1], [1.0, 10.0, 0.1, 1.0], 4.0)
        self.damping[at] = np.maximum(self.damping[at] * change, 1e-7)
        settled |= ~fresh & (self.damping[at] > 1e8)
        self.converged[at] = settled
        self.done[at] = settled | (fresh & ~fine)
        new = at[lower]
        self.x[new], self.value[new], self.gradient[new] = self.next[new], value[lower], sums[lower, 1:5]
        self.info[new[:, None], UPPER[0], UPPER[1]] = self.info[new[:, None], UPPER[1], UPPER[0]] = sums[lower, 5:]
        self._propose(at[~self.done[at]])

    def _propose(self, at: np.ndarray) -> None:
        info, gradient, k = self.info[at], self.gradient[at], self.x.shape[1]
        own = np.einsum("nii->ni", info)
        ridge = self.damping[at, None] * own + 1e-9 * own.max(axis=1, initial=0, keepdims=True) + 1e-12
        step = -np.linalg.solve(info + ridge[:, :, None] * np.eye(k), gradient[:, :, None])[:, :, 0]
        step *= np.minimum(1.0, 3.0 / np.maximum(np.abs(step).max(axis=1, initial=0, keepdims=True), 1e-300))
        self.hoped[at] = np.maximum(-(gradient * step).sum(axis=1) - np.einsum("ni,nij,nj->n", step, info, step) / 2, 1e-300)
        self.next[at] = self.x[at] + step


def _pvl_fits(rows: DataFrame, folds: list[Fold], starts: int, steps: int, seed: int) -> dict[Fold, tuple[list[float] | None, float, bool]]:
    """``fits`` of the PVL model; only starts that have not settled are evaluated."""
    all_starts = Scoring(np.tile(np.random.default_rng(seed).normal(0, 1, (starts, 4)), (len(folds), 1)))
    tasks = rows.rdd.getNumPartitions()
    for _ in range(steps):
        going = np.nonzero(~all_starts.done)[0]
        if not len(going):
            break
        asked = {int(f): all_starts.next[going[going // starts == f]] for f in np.unique(going // starts)}
        told = _asked_slopes(rows, folds, asked, tasks)
        all_starts.take(going, np.concatenate([told[f] for f in asked]))
    out: dict[Fold, tuple[list[float] | None, float, bool]] = {}
    for i, f in enumerate(folds):
        at = i * starts + int(all_starts.value[i * starts : (i + 1) * starts].argmin())
        fine = np.isfinite(all_starts.value[at])
        out[f] = (all_starts.x[at].tolist(), float(all_starts.value[at]), bool(all_starts.converged[at])) if fine else (None, float("inf"), False)
    return out


def fits(rows: DataFrame, name: str, folds: list[Fold], starts: int, steps: int, seed: int) -> dict[Fold, tuple[list[float] | None, float, bool]]:
    """The best of ``starts`` descents for each fold, over all its training sessions. ``rows``: group, fold, trials."""
    _, k = model(name)
    if name == "pvl":
        return _pvl_fits(rows, folds, starts, steps, seed)
    live = {f: Descent(np.random.default_rng(seed).normal(0, 1, (starts, k))) for f in folds}
    for _ in range(steps):
        going = {f: d for f, d in live.items() if not d.done.all()}
        if not going:
            break
        for f, values in _sums(rows, name, {f: d.around() for f, d in going.items()}).items():
            live[f].take_gradient(values)
        for f, values in _sums(rows, name, {f: d.along() for f, d in going.items()}).items():
            live[f].take_step(values)
    return {f: d.best() for f, d in live.items()}


def pooled_folds(df: DataFrame, key: str, unit: str, trials: str, group: str, name: str, folds: int = 5, starts: int = 8, steps: int = 200, seed: int = 20260506, least_train: int = 2) -> DataFrame:
    """Cross-validation by units: for each group and fold one vector is fitted to all sessions of the other folds and evaluated on it.

    One row for each session: its provenance, fold, sizes, hashes of both sides' units, flags
    (``tiny_cohort``, ``low_train_warning``), fit and mean likelihood of its finite trials. Status:
    ``excluded_tiny_train``, ``fit_failed``, ``fit_not_converged``, ``eval_nonfinite`` or ``ok``. Only
    converged fits are evaluated. Sessions without a unit or group have no row.
    """
    fn, k = model(name)
    kept = [c for c in dict.fromkeys((key, *PROVENANCE, unit, group)) if c in df.columns]
    assigned = cut(spread(df.select(*kept, trials).join(hash_folds(df, unit, group, folds), [group, unit]), key))
    held = assigned.select(group, unit, "fold", "group_size").distinct().groupBy(group, "fold").agg(F.count("*").alias("n_held"), F.first("group_size").alias("group_size"), member_hash(F.col(unit)).alias("eval_members"))
    sizes = held.collect()
    wanted = [(r[group], r["fold"]) for r in sizes if r["group_size"] - r["n_held"] >= least_train]
    found = fits(assigned.select(F.col(group).cast("string"), "fold", trials), name, wanted, starts, steps, seed)
    spark = df.sparkSession
    table = spark.createDataFrame([(g, f, p, x, ok) for (g, f), (p, x, ok) in found.items()], f"`{group}` string, fold int, params array<double>, fit_nll double, success boolean")
    sides = held.select(group, "fold", "n_held", "eval_members")
    rows = assigned.join(F.broadcast(sides), [group, "fold"]).join(F.broadcast(table), [group, "fold"], "left")
    names = [c for c in rows.columns if c not in (trials, "params")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[float | None] = [None] * batch.num_rows
            params, success = batch.column("params").to_pylist(), batch.column("success").to_pylist()
            for p in {tuple(p) for p, ok in zip(params, success, strict=True) if p and ok}:
                own = [i for i, x in enumerate(params) if x and tuple(x) == p and success[i]]
                with np.errstate(all="ignore"):
                    nll = fn(np.array(p), Sessions.of(batch.column(trials).take(pa.array(own))))
                fine = np.isfinite(nll)
                for i, n, x in zip(own, fine.sum(axis=1), np.where(fine, nll, 0.0).sum(axis=1), strict=True):
                    out[i] = float(x / n) if n else None
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], batch.column("params"), pa.array(out, pa.float64())], names=[*names, "params", "eval_mean_nll"])

    done = rows.mapInArrow(evaluate, f"{fields}, params array<double>, eval_mean_nll double")
    train = F.col("group_size") - F.col("n_held")
    status = (
        F.when(train < least_train, "excluded_tiny_train").when(F.col("params").isNull(), "fit_failed").when(~F.col("success"), "fit_not_converged")
        .when(F.col("eval_mean_nll").isNull(), "eval_nonfinite").otherwise("ok")
    )
    flags = {"n_train": train, "tiny_cohort": F.col("group_size") < 25, "low_train_warning": train < max(8, 2 * k), "status": status, "model": F.lit(name), "metric": F.lit("pooled_unit_kfold")}
    return done.withColumns(flags)
