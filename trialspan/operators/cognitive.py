"""Sequential choice models: trial likelihoods, fits, holdouts and cross-validation.

All sessions of an Arrow batch are advanced together, trial by trial, as arrays of (sessions, decks).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

DECKS = {"A": 0, "B": 1, "C": 2, "D": 3}
_TRIALS = pa.list_(pa.struct([("deck", pa.string()), ("gain", pa.float64()), ("loss", pa.float64())]))


def _squash(x):
    """The sigmoid, held at 0 and 1 from 50 on; for numbers and arrays."""
    x = np.asarray(x, float)
    return np.where(np.abs(x) < 50, 1 / (1 + np.exp(-np.clip(x, -50, 50))), (x > 0).astype(float))


def _grow(x):
    """3 to the softplus of x, less one: a positive number."""
    x = np.asarray(x, float)
    return 3.0 ** np.where(x < 50, np.log1p(np.exp(np.minimum(x, 50))), x) - 1.0


@dataclass
class Sessions:
    """Trials of several sessions, padded: deck (-1 where invalid or past the end), gain, loss, each (sessions, trials)."""

    deck: np.ndarray
    gain: np.ndarray
    loss: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, trials: list | pa.Array) -> Sessions:
        """Sessions as lists of trials, or as an Arrow list of structs, whose values are laid out by their offsets."""
        if not isinstance(trials, pa.Array):
            trials = pa.array([None if t is None else list(t) for t in trials], _TRIALS)
        starts = trials.offsets.to_numpy().astype(np.int64)
        flat = trials.values.slice(starts[0], starts[-1] - starts[0])
        lengths = np.where(trials.is_valid().to_numpy(zero_copy_only=False), np.diff(starts), 0)
        row, at = np.repeat(np.arange(len(lengths)), np.diff(starts)), np.arange(len(flat)) - np.repeat(starts[:-1] - starts[0], np.diff(starts))
        shape = (len(lengths), int(lengths.max(initial=0)))
        deck, gain, loss = np.full(shape, -1), np.zeros(shape), np.zeros(shape)
        held = np.repeat(lengths > 0, np.diff(starts))
        row, at = row[held], at[held]
        columns = [pc.struct_field(flat, name) for name in ("deck", "gain", "loss")]
        deck[row, at] = pc.fill_null(pc.index_in(columns[0].cast(pa.string()), pa.array(list(DECKS))), -1).to_numpy(zero_copy_only=False)[held]
        for out, column in ((gain, columns[1]), (loss, columns[2])):
            out[row, at] = pc.fill_null(column.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)[held]
        return cls(deck, gain, loss, lengths)

    def only(self, rows: np.ndarray, trials: int | None = None) -> Sessions:
        return Sessions(self.deck[rows, :trials], self.gain[rows, :trials], self.loss[rows, :trials], np.minimum(self.lengths[rows], trials) if trials is not None else self.lengths[rows])


def _choose(values: np.ndarray, deck: np.ndarray) -> np.ndarray:
    """-log softmax of the chosen deck, NaN where the deck is invalid."""
    top = values.max(axis=1)
    z = top + np.log(np.exp(values - top[:, None]).sum(axis=1))
    return np.where(deck >= 0, z - values[np.arange(len(deck)), np.maximum(deck, 0)], np.nan)


def _walk(s: Sessions, value: Callable, update: Callable, state: dict[str, np.ndarray]) -> np.ndarray:
    out = np.full(s.deck.shape, np.nan)
    decks = np.arange(4)
    for j in range(s.deck.shape[1]):
        deck = s.deck[:, j]
        valid = deck >= 0
        out[:, j] = _choose(value(state), deck)
        chosen = (deck[:, None] == decks) & valid[:, None]
        new = update(state, chosen, s.gain[:, j][:, None], s.loss[:, j][:, None])
        state = {k: np.where(valid[:, None], new[k], v) for k, v in state.items()}  # invalid decks leave the state alone
    return out


def vse(p: np.ndarray, s: Sessions) -> np.ndarray:
    """Value plus sequential exploration: exploitation decays, exploration returns to its bonus."""
    theta, delta, alpha, phi, c = _squash(p[0]), _squash(p[1]), _squash(p[2]), 10 * np.tanh(p[3]), _grow(p[4])
    n = len(s.deck)

    def update(st, chosen, gain, loss):
        exploit = st["exploit"] * delta + np.where(chosen, np.abs(gain) ** theta - np.abs(loss) ** theta, 0.0)
        return {"exploit": exploit, "explore": np.where(chosen, 0.0, st["explore"] + alpha * (phi - st["explore"]))}

    return _walk(s, lambda st: (st["exploit"] + st["explore"]) * c, update, {"exploit": np.zeros((n, 4)), "explore": np.full((n, 4), phi)})


def orl(p: np.ndarray, s: Sessions) -> np.ndarray:
    """Outcome representation: expected value, expected frequency of wins, perseverance."""
    reward, punish, k, by_f, by_p = _squash(p[0]), _squash(p[1]), _grow(p[2]), p[3], p[4]
    n = len(s.deck)

    def update(st, chosen, gain, loss):
        net = gain - loss
        own, other = np.where(net >= 0, reward, punish), np.where(net >= 0, punish, reward)
        ev = np.where(chosen, st["ev"] + own * (net - st["ev"]), st["ev"])
        ef = np.where(chosen, st["ef"] + own * (np.sign(net) - st["ef"]), st["ef"] + other * (-np.sign(net) / 3 - st["ef"]))
        return {"ev": ev, "ef": ef, "ps": np.where(chosen, 1.0, st["ps"] / (1 + k))}

    return _walk(s, lambda st: st["ev"] + st["ef"] * by_f + st["ps"] * by_p, update, {x: np.zeros((n, 4)) for x in ("ev", "ef", "ps")})


def pvl_scales(p: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rate, curve, aversion and consistency of a PVL vector."""
    return _squash(p[0]), 2 * _squash(p[1]), 10 * _squash(p[2]), 5 * _squash(p[3])


def pvl_delta(p: np.ndarray, s: Sessions) -> np.ndarray:
    """Prospect valence with a delta rule."""
    rate, curve, aversion, c = pvl_scales(p)
    n = len(s.deck)

    def update(st, chosen, gain, loss):
        net = gain - loss
        size = np.abs(net) ** curve
        utility = np.where(net > 0, size, np.where(net < 0, -aversion * size, 0.0))
        return {"ev": np.where(chosen, st["ev"] + rate * (utility - st["ev"]), st["ev"])}

    return _walk(s, lambda st: st["ev"] * c, update, {"ev": np.zeros((n, 4))})


#: name -> (likelihood, number of parameters)
MODELS: dict[str, tuple[Callable[[np.ndarray, Sessions], np.ndarray], int]] = {"vse": (vse, 5), "orl": (orl, 5), "pvl": (pvl_delta, 4)}


def model(name: str) -> tuple[Callable[[np.ndarray, Sessions], np.ndarray], int]:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known are {', '.join(MODELS)}")
    return MODELS[name]


def pooled_total(nll: np.ndarray) -> float:
    """Sum over sessions, one a row, of their totals; infinite as soon as one session has no finite trial."""
    fine = np.isfinite(nll)
    return float(np.where(fine, nll, 0.0).sum()) if fine.any(axis=1).all() else float("inf")


def total(nll: np.ndarray) -> float:
    """Sum over finite trials, infinite if there is none."""
    fine = np.isfinite(nll)
    return float(nll[fine].sum()) if fine.any() else float("inf")


def trial_likelihoods(df: DataFrame, key: str, trials: str, name: str, params: list[float]) -> DataFrame:
    """(key, per_trial, total_nll): likelihoods of each trial at fixed parameters; invalid decks have NaN."""
    fn, k = model(name)
    p = np.array(params, float)
    if len(p) != k:
        raise ValueError(f"{name} has {k} parameters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Sessions.of(batch.column(1))
            with np.errstate(all="ignore"):
                nll = fn(p, s) / 1.0
            rows = [nll[i, :n].tolist() for i, n in enumerate(s.lengths)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64())), pa.array([total(np.array(r)) for r in rows], pa.float64())], names=[key, "per_trial", "total_nll"])

    return df.select(key, trials).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, per_trial array<double>, total_nll double")


def mean_likelihoods(df: DataFrame, key: str, trials: str, models: dict[str, list[float]]) -> DataFrame:
    """(key, one column for each model): mean likelihood of the finite trials under each model's fixed parameters, null where there are none.

    All models go over a session in one pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, out = Sessions.of(batch.column(1)), []
            for name, params in models.items():
                with np.errstate(all="ignore"):
                    nll = model(name)[0](np.array(params, float), s)
                fine = np.isfinite(nll)
                n = fine.sum(axis=1)
                out.append(pa.array([float(x / c) if c else None for x, c in zip(np.where(fine, nll, 0.0).sum(axis=1), n, strict=True)], pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=[key, *models])

    return df.select(key, trials).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, " + ", ".join(f"`{m}` double" for m in models))


def pvl_fold(trials: Column, rate: float, curve: float, aversion: float, c: float) -> Column:
    """The PVL recursion as one fold of built-in functions; equal to ``pvl_delta``, without Python."""
    state = F.struct(F.array(*[F.lit(0.0)] * 4).alias("ev"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        d = F.array_position(F.array(*[F.lit(x) for x in DECKS]), t["deck"])
        logits = F.transform(acc["ev"], lambda v: v * c)
        top = F.array_max(logits)
        z = top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
        net = F.coalesce(t["gain"], F.lit(0.0)) - F.coalesce(t["loss"], F.lit(0.0))
        size = F.pow(F.abs(net), F.lit(curve))
        u = F.when(net > 0, size).when(net < 0, -aversion * size).otherwise(0.0)
        ev = F.transform(acc["ev"], lambda v, i: F.when(i + 1 == d, v + rate * (u - v)).otherwise(v))
        nll = F.when(d > 0, z - F.element_at(logits, F.greatest(d, F.lit(1)).cast("int"))).otherwise(F.lit(float("nan")))
        return F.struct(F.when(d > 0, ev).otherwise(acc["ev"]).alias("ev"), F.concat(acc["out"], F.array(nll)).alias("out"))

    return F.aggregate(trials, state, step, lambda acc: acc["out"])


def minimise(f: Callable[[np.ndarray], float], start: np.ndarray, steps: int = 200, memory: int = 8, tolerance: float = 1e-6) -> tuple[np.ndarray, float, bool, int]:
    """Quasi-Newton descent with a limited memory and a backtracking line search; gradients by central differences."""

    def gradient(x: np.ndarray) -> np.ndarray:
        h = 1e-5 * np.maximum(1.0, np.abs(x))
        return np.array([(f(x + h * e) - f(x - h * e)) / (2 * h[i]) for i, e in enumerate(np.eye(len(x)))])

    x, value = start.astype(float), f(start)
    g = gradient(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for n in range(1, steps + 1):
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            alphas.append((s @ q) / (y @ s))
            q -= alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        step = -q if np.all(np.isfinite(q)) and q @ g > 0 else -g
        length = 1.0 if pairs else 1.0 / max(1.0, np.abs(g).sum())
        slope = step @ g
        for _ in range(30):
            new = f(x + length * step)
            if np.isfinite(new) and new <= value + 1e-4 * length * slope:
                break
            length /= 2
        else:
            return x, value, bool(np.abs(g).max() < 1e-3), n
        fresh = gradient(x + length * step)
        s, y = length * step, fresh - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = abs(value - new) <= tolerance * max(abs(value), abs(new), 1.0)
        x, value, g = x + s, new, fresh
        if done:
            return x, value, True, n
    return x, value, False, steps


def fit(name: str, s: Sessions, starts: int = 8, steps: int = 200, seed: int = 0) -> dict:
    """The best of several starts drawn from a standard normal: params, fun, success, nit."""
    fn, k = model(name)
    rng = np.random.default_rng(seed)
    best: tuple | None = None
    with np.errstate(all="ignore"):
        for _ in range(starts):
            found = minimise(lambda p: pooled_total(fn(p, s)), rng.normal(0, 1, k), steps)
            if best is None or (np.isfinite(found[1]) and found[1] < best[1]):
                best = found
    return {"params": best[0].tolist(), "fun": best[1], "success": best[2], "nit": best[3]}


class Descent:
    """Quasi-Newton descents of several starts at once: a step takes the values around each place, then those along each direction."""

    LENGTHS = np.array([1.0, 0.5, 0.25, 0.1, 0.03, 0.005])

    def __init__(self, starts: np.ndarray, tolerance: float = 1e-6) -> None:
        self.x, self.tolerance = starts, tolerance
        n, k = starts.shape
        self.value, self.gradient = np.full(n, np.inf), np.zeros((n, k))
        self.inverse = np.tile(np.eye(k), (n, 1, 1))
        self.done, self.converged, self.fresh = np.zeros(n, bool), np.zeros(n, bool), True
        self.nit = 0

    def around(self) -> np.ndarray:
        """The points of central differences about each start's place, the place itself first."""
        k = self.x.shape[1]
        self.h = 1e-4 * np.maximum(1.0, np.abs(self.x))
        offsets = np.concatenate([np.zeros((1, k)), np.eye(k), -np.eye(k)])
        return (self.x[:, None, :] + offsets[None] * self.h[:, None, :]).reshape(-1, k)

    def take_gradient(self, values: np.ndarray) -> None:
        n, k = self.x.shape
        values = values.reshape(n, 2 * k + 1)
        with np.errstate(all="ignore"):
            gradient = (values[:, 1 : k + 1] - values[:, k + 1 :]) / (2 * self.h)
        if not self.fresh:
            for i in np.nonzero(~self.done)[0]:
                y, s = gradient[i] - self.gradient[i], self.step[i]
                if s @ y > 1e-10 and np.isfinite(y).all():
                    rho, eye = 1 / (s @ y), np.eye(k)
                    self.inverse[i] = (eye - rho * np.outer(s, y)) @ self.inverse[i] @ (eye - rho * np.outer(y, s)) + rho * np.outer(s, s)
        self.value, self.gradient = values[:, 0], gradient
        self.done |= ~np.isfinite(values).all(axis=1)
        if self.fresh:
            self.inverse /= np.maximum(1.0, np.abs(np.nan_to_num(gradient)).sum(axis=1))[:, None, None]
        self.fresh = False

    def along(self) -> np.ndarray:
        self.direction = -np.einsum("nij,nj->ni", self.inverse, np.nan_to_num(self.gradient))
        return (self.x[:, None, :] + self.LENGTHS[None, :, None] * self.direction[:, None, :]).reshape(-1, self.x.shape[1])

    def take_step(self, values: np.ndarray) -> None:
        self.nit += 1
        values = np.where(np.isfinite(values), values, np.inf).reshape(len(self.x), -1)
        at, best = values.argmin(axis=1), values.min(axis=1)
        better = (best < self.value) & ~self.done
        self.step = np.where(better[:, None], self.LENGTHS[at][:, None] * self.direction, 0.0)
        small = np.abs(self.value - best) <= self.tolerance * np.maximum(1.0, np.abs(self.value))
        settled = ~self.done & (~better | small)
        self.converged |= settled & np.isfinite(self.value)
        self.x, self.value = self.x + self.step, np.where(better, best, self.value)
        self.done |= settled

    def best(self) -> tuple[list[float] | None, float, bool]:
        fine = np.where(np.isfinite(self.value), self.value, np.inf)
        i = int(fine.argmin())
        return (self.x[i].tolist(), float(fine[i]), bool(self.converged[i])) if np.isfinite(fine[i]) else (None, float("inf"), False)


def fit_each(name: str, s: Sessions, starts: int = 8, steps: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A fit for each session by itself, all of them and all their starts advanced together: parameters, totals, whether converged.

    A session without any valid trial has an infinite total.
    """
    fn, k = model(name)
    n = len(s.deck)
    d = Descent(np.tile(np.random.default_rng(seed).normal(0, 1, (starts, k)), (n, 1)))
    owner = np.repeat(np.arange(n), starts)

    def totals(points: np.ndarray, live: np.ndarray) -> np.ndarray:
        out, times = np.full(len(points), np.inf), len(points) // len(owner)
        asked = np.nonzero(np.repeat(live, times))[0]
        for part in np.array_split(asked, max(1, len(asked) // 20_000)):
            with np.errstate(all="ignore"):
                nll = fn(points[part].T[:, :, None], s.only(np.repeat(owner, times)[part]))
            fine = np.isfinite(nll)
            out[part] = np.where(fine.any(axis=1), np.where(fine, nll, 0.0).sum(axis=1), np.inf)
        return out

    for _ in range(steps):
        live = ~d.done
        if not live.any():
            break
        kept = d.value.copy(), d.gradient.copy()
        d.take_gradient(totals(d.around(), live))
        d.value[~live], d.gradient[~live] = kept[0][~live], kept[1][~live]
        d.take_step(totals(d.along(), ~d.done))
    values = d.value.reshape(n, starts)
    best = np.where(np.isfinite(values), values, np.inf).argmin(axis=1)
    at = np.arange(n) * starts + best
    return d.x[at], d.value[at], d.converged[at]


#: what is carried from a session to the rows of its fits
PROVENANCE = ("subject_id", "manifest", "experiment", "cohort", "igt_version", "deck_map")


def _kept(df: DataFrame, key: str, kept: tuple[str, ...]) -> tuple[list[str], str]:
    names = [key, *[c for c in kept if c in df.columns and c != key]]
    return names, ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in names)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores: fits take seconds for kilobytes, so partitions of the usual size would be few tasks."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.col(key))


def _rows(batch: pa.RecordBatch, names: list[str], more: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *[pa.array(x, t) for x, t in more.values()]], names=[*names, *more])


def fit_sessions(df: DataFrame, key: str, trials: str, name: str, starts: int = 8, steps: int = 200, seed: int = 0) -> DataFrame:
    """A fit for each session by itself, in its whole length, with the session's provenance.

    All sessions of an Arrow batch are fitted together. A session without any valid trial has
    status ``fit_failed`` and no parameters; others are ``ok`` or ``fit_not_converged``.
    """
    fn, _ = model(name)
    names, fields = _kept(df, key, PROVENANCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Sessions.of(batch.column(len(names)))
            x, fun, ok = fit_each(name, s, starts, steps, seed)
            with np.errstate(all="ignore"):
                nll = fn(x.T[:, :, None], s)
            held = np.isfinite(fun)
            yield _rows(batch, names, {
                "params": ([p.tolist() if h else None for p, h in zip(x, held, strict=True)], pa.list_(pa.float64())), "fun": ([float(v) if h else None for v, h in zip(fun, held, strict=True)], pa.float64()),
                "success": (ok & held, pa.bool_()), "n_trials": (s.lengths, pa.int32()), "per_trial": ([nll[i, :n].tolist() if h else None for i, (n, h) in enumerate(zip(s.lengths, held, strict=True))], pa.list_(pa.float64())),
                "status": (np.where(~held, "fit_failed", np.where(ok, "ok", "fit_not_converged")).tolist(), pa.string()),
            })

    out = spread(df.select(*names, trials), key).mapInArrow(run, f"{fields}, params array<double>, fun double, success boolean, n_trials int, per_trial array<double>, status string")
    return out.withColumns({"model": F.lit(name), "metric": F.lit("in_sample")})


def holdout(df: DataFrame, key: str, trials: str, name: str, fit_trials: int | None = None, fit_share: float | None = None, least_fit: int = 20, least_eval: int = 10, starts: int = 8, steps: int = 200, seed: int = 0) -> DataFrame:
    """Fit on the first trials of each session and evaluate on the rest, the state carried over.

    Exactly one of ``fit_trials`` and ``fit_share`` is given. Status: ``too_short`` where either
    side has too few trials, ``fit_failed``, ``fit_not_converged``, ``eval_nonfinite`` or ``ok``;
    only a converged fit is evaluated.
    """
    if (fit_trials is None) == (fit_share is None):
        raise ValueError("give either fit_trials or fit_share")
    fn, _ = model(name)
    names, fields = _kept(df, key, PROVENANCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Sessions.of(batch.column(len(names)))
            n = s.lengths
            cut = np.full(len(n), fit_trials) if fit_trials is not None else (fit_share * n).astype(int)
            long = (cut >= least_fit) & (n - cut >= least_eval)
            at = np.arange(s.deck.shape[1])
            head = Sessions(np.where(at < cut[:, None], s.deck, -1), s.gain, s.loss, np.minimum(n, cut))
            x, fun, ok = np.full((len(n), model(name)[1]), np.nan), np.full(len(n), np.inf), np.zeros(len(n), bool)
            if long.any():
                x[long], fun[long], ok[long] = fit_each(name, head.only(np.nonzero(long)[0]), starts, steps, seed)
            with np.errstate(all="ignore"):
                nll = fn(x.T[:, :, None], s)
            rest = np.isfinite(nll) & (at >= cut[:, None])
            held, told = np.isfinite(fun), np.where(rest, nll, 0.0).sum(axis=1)
            status = np.select([~long, ~held, ~ok, ~rest.any(axis=1)], ["too_short", "fit_failed", "fit_not_converged", "eval_nonfinite"], "ok")
            yield _rows(batch, names, {
                "fit_trials": (cut, pa.int32()), "n_eval": (n - cut, pa.int32()), "params": ([p.tolist() if h else None for p, h in zip(x, held, strict=True)], pa.list_(pa.float64())),
                "fit_nll": ([float(v) if h else None for v, h in zip(fun, held, strict=True)], pa.float64()),
                "eval_mean_nll": ([float(t / c) if z == "ok" else None for t, c, z in zip(told, rest.sum(axis=1), status, strict=True)], pa.float64()), "status": (status.tolist(), pa.string()),
            })

    out = spread(df.select(*names, trials), key).mapInArrow(run, f"{fields}, fit_trials int, n_eval int, params array<double>, fit_nll double, eval_mean_nll double, status string")
    return out.withColumns({"model": F.lit(name), "metric": F.lit("temporal_holdout")})


def hash_folds(df: DataFrame, unit: str, group: str, folds: int = 5) -> DataFrame:
    """(group, unit, fold, group_size): folds of the distinct units of each group, by rank of their hash modulo the number of folds.

    All rows of a unit share its fold; small groups have as many folds as units. Ranks are counted in
    4,096 hash buckets of a group and offset by the buckets before, so a hot group is no single task.
    """
    from pyspark.sql import Window as W

    units = df.select(group, unit).where(F.col(unit).isNotNull() & F.col(group).isNotNull()).distinct()
    hashed = units.withColumn("_h", F.sha2(F.col(unit).cast("string"), 256)).withColumn("_b", F.substring("_h", 1, 3))
    fill = hashed.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = fill.select(group, "_b", F.sum("_n").over(W.partitionBy(group)).alias("group_size"), (F.sum("_n").over(W.partitionBy(group).orderBy("_b")) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(W.partitionBy(group, "_b").orderBy("_h", unit)) - 1
    ranked = hashed.withColumn("_nth", nth).join(before, [group, "_b"])
    return ranked.select(group, unit, F.pmod(F.col("_nth") + F.col("_before"), F.least(F.lit(folds), F.col("group_size"))).cast("int").alias("fold"), "group_size")


def exact_folds(n: int, group: str, folds: int, seed: int) -> np.ndarray:
    """The fold of each of n members of a group by a numpy generator seeded with the seed and the group's checksum."""
    order = np.random.default_rng([seed, zlib.crc32(group.encode())]).permutation(n)
    out = np.empty(n, int)
    for f, part in enumerate(np.array_split(order, min(folds, n))):
        out[part] = f
    return out


def fold_status(train: Column, group_size: Column, k: int, least_train: int = 2) -> Column:
    """``excluded_tiny_train``, ``tiny_cohort``, ``low_train`` or ``ok`` of a fold, from its numbers of units."""
    return F.when(train < least_train, "excluded_tiny_train").when(group_size < 25, "tiny_cohort").when(train < max(8, 2 * k), "low_train").otherwise("ok")


def member_hash(unit: Column) -> Column:
    """An aggregate that names a set of distinct units whatever their order: sums of parts of their hashes, which combine before the shuffle."""
    part = lambda i: F.sum(F.conv(F.substring(F.md5(unit), i, 8), 16, 10).cast("long"))
    return F.concat_ws("-", *[part(i).cast("string") for i in (1, 9, 17, 25)])
