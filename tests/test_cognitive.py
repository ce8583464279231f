import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspan.operators import cognitive as C
from trialspan.operators.pooled import pooled_folds

RNG = np.random.default_rng(1)
SESSIONS = [[{"deck": str(RNG.choice(list("ABCDX"))), "gain": float(RNG.integers(0, 3)), "loss": float(RNG.integers(0, 4))} for _ in range(n)] for n in (30, 1, 0, 45)]


def plain_pvl(p, trials):
    rate, curve, aversion, c = C._squash(p[0]), 2 * C._squash(p[1]), 10 * C._squash(p[2]), 5 * C._squash(p[3])
    ev, out = [0.0] * 4, []
    for t in trials:
        d = "ABCD".find(t["deck"])
        if d < 0:
            out.append(float("nan"))
            continue
        z = sum(math.exp(c * v) for v in ev)
        out.append(-math.log(math.exp(c * ev[d]) / z))
        net = t["gain"] - t["loss"]
        u = net**curve if net > 0 else -aversion * abs(net) ** curve if net < 0 else 0.0
        ev[d] += rate * (u - ev[d])
    return out


def test_pvl_equals_the_plain_loop():
    p = np.array([0.1, -0.3, -1.0, -2.0])
    got = C.pvl_delta(p, C.Sessions.of(SESSIONS))
    for i, s in enumerate(SESSIONS):
        np.testing.assert_allclose(got[i, : len(s)], plain_pvl(p, s), rtol=1e-10)


@pytest.mark.parametrize("name", list(C.MODELS))
def test_batch_equals_single_and_first_trial_is_uniform(name):
    fn, k = C.model(name)
    p = np.linspace(-0.5, 0.4, k)
    got = fn(p, C.Sessions.of(SESSIONS))
    for i, s in enumerate(SESSIONS):
        if s:
            np.testing.assert_allclose(got[i, : len(s)], fn(p, C.Sessions.of([s]))[0], rtol=1e-12)
            first = next((j for j, t in enumerate(s) if t["deck"] in "ABCD"), None)
            assert first is None or got[i, first] == pytest.approx(math.log(4))
            assert all(math.isnan(got[i, j]) == (t["deck"] == "X") for j, t in enumerate(s))


def test_unknown_model_and_totals():
    with pytest.raises(ValueError):
        C.model("other")
    assert C.total(np.array([np.nan, 1.0, 2.0])) == 3.0 and C.total(np.array([np.nan])) == float("inf")


def test_fold_of_built_ins_equals_numpy(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SESSIONS)], "k int, trials array<struct<deck:string,gain:double,loss:double>>")
    p = [0.1, -0.3, -1.0, -2.0]
    s = [float(C._squash(x)) for x in p]
    a = {r.k: r.per_trial for r in C.trial_likelihoods(df, "k", "trials", "pvl", p).collect()}
    b = {r.k: r.x for r in df.select("k", C.pvl_fold(F.col("trials"), s[0], 2 * s[1], 10 * s[2], 5 * s[3]).alias("x")).collect()}
    for k in a:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-9)


def test_descent_finds_the_minimum():
    x, value, done, _ = C.minimise(lambda v: float(((v - np.array([1.0, -2.0])) ** 2 * np.array([1.0, 10.0])).sum()), np.zeros(2))
    assert done and value < 1e-6 and np.allclose(x, [1, -2], atol=1e-3)


FRAME = "k int, e string, trials array<struct<deck:string,gain:double,loss:double>>"


def test_holdout_and_folds(spark):
    df = spark.createDataFrame([(i, "e", SESSIONS[3]) for i in range(4)], FRAME)
    rows = C.holdout(df, "k", "trials", "pvl", fit_trials=30, starts=2, steps=60).collect()
    assert all(r.status == "ok" and r.eval_mean_nll > 0 for r in rows)
    assert all(r.eval_mean_nll is None for r in C.holdout(df, "k", "trials", "pvl", fit_trials=30, starts=1, steps=1).collect())
    assert {r.status for r in C.holdout(df, "k", "trials", "pvl", fit_trials=40, starts=1, steps=5).collect()} == {"too_short"}
    with pytest.raises(ValueError):
        C.holdout(df, "k", "trials", "pvl")
    folds = C.hash_folds(df, "k", "e", 5).collect()
    assert sorted(r.fold for r in folds) == [0, 1, 2, 3]
    assert sorted(np.bincount(C.exact_folds(11, "e", 5, 0)).tolist()) == [2, 2, 2, 2, 3]


def real_sessions(n, seed, m=60):
    rng = np.random.default_rng(seed)
    return [[{"deck": "ABCD"[int(rng.integers(0, 4) * rng.random() ** 0.5)], "gain": float(rng.integers(0, 3)), "loss": float(rng.integers(0, 4))} for _ in range(m)] for _ in range(n)]


@pytest.mark.parametrize("name", list(C.MODELS))
def test_fits_together_are_as_good_as_fits_one_by_one(name):
    sessions = real_sessions(3, 7)
    x, fun, ok = C.fit_each(name, C.Sessions.of([*sessions, [], None]), starts=6, steps=150)
    for i, s in enumerate(sessions):
        alone = C.fit(name, C.Sessions.of([s]), starts=6, steps=150)
        assert fun[i] <= alone["fun"] * 1.02 + 0.05 and fun[i] == pytest.approx(C.total(C.model(name)[0](x[i], C.Sessions.of([s]))))
    assert np.isinf(fun[3:]).all() and not ok[3:].any()


def test_fits_of_sessions_keep_provenance_and_state_failures(spark):
    rows = [(i, "e", s) for i, s in enumerate(real_sessions(3, 3))] + [(9, None, []), (10, "e", None), (11, "e", [{"deck": "X", "gain": 1.0, "loss": None}])]
    df = spark.createDataFrame([(*r, "s") for r in rows], FRAME.replace("e string", "experiment string") + ", subject_id string")
    got = {r.k: r for r in C.fit_sessions(df, "k", "trials", "orl", starts=2, steps=80).collect()}
    assert {k: r.status for k, r in got.items() if k > 2} == {9: "fit_failed", 10: "fit_failed", 11: "fit_failed"} and got[1].subject_id == "s" and len(got[1].per_trial) == 60
    assert C.fit_sessions(df.limit(0), "k", "trials", "orl").count() == 0


def test_pooled_totals_are_infinite_if_one_session_has_none():
    assert C.pooled_total(np.array([[1.0, np.nan], [np.nan, np.nan]])) == float("inf") and C.pooled_total(np.array([[1.0, np.nan], [2.0, 3.0]])) == 6.0


def test_pooled_folds_use_all_training_sessions(spark):
    sessions = real_sessions(12, 5, 30)
    rows = [(i, "e" if i < 10 else "small", f"u{i // 2}" if i < 10 else "one", s) for i, s in enumerate(sessions)]
    df = spark.createDataFrame(rows, "k int, experiment string, u string, trials array<struct<deck:string,gain:double,loss:double>>").repartition(3)
    out = pooled_folds(df, "k", "u", "trials", "experiment", "pvl", folds=5, starts=3, steps=80).collect()
    assert len(out) == 12 and {r.status for r in out if r.experiment == "small"} == {"excluded_tiny_train"}
    by = {}
    for r in out:
        if r.experiment == "e":
            by.setdefault(r.fold, []).append(r)
    assert len(by) == 5 and all(len({r.u for r in rs}) == 1 and len(rs) == 2 and rs[0].n_train == 4 and rs[0].low_train_warning for rs in by.values())
    for rs in by.values():
        train = C.Sessions.of([s for i, _, u, s in rows if i < 10 and u != rs[0].u])
        assert rs[0].fit_nll == pytest.approx(C.pooled_total(C.pvl_delta(np.array(rs[0].params), train)))
        assert rs[0].fit_nll <= C.fit("pvl", train, starts=3, steps=150, seed=20260506)["fun"] * 1.01
    assert pooled_folds(df.limit(0), "k", "u", "trials", "experiment", "pvl").count() == 0


def test_totals_of_many_vectors_equal_the_plain_model_and_cost_a_fraction():
    import time

    from trialspan.operators.pooled import pvl_totals

    rng = np.random.default_rng(3)
    listed = [[{"deck": str(rng.choice(list("ABCDX"))), "gain": float(rng.choice([0, 0.5, 1, 1.15, 90])), "loss": float(rng.choice([0, 0, 2.5, 12.5, 1250]) if i % 3 else rng.choice([0, 1.25]))} for _ in range(rng.integers(0, 90))] for i in range(300)]
    s = C.Sessions.of([*listed, [], [{"deck": "X", "gain": 1.0, "loss": 0.0}] * 3])
    vectors, (rows, fits) = rng.normal(0, 2, (4, 9, 4)), np.nonzero(np.arange(len(s.deck))[:, None] % 4 != np.arange(4))
    began = time.perf_counter()
    got = pvl_totals(vectors, s, rows, fits)
    middle = time.perf_counter()
    with np.errstate(all="ignore"):
        nll = [[C.pvl_delta(v, s) for v in vs] for vs in vectors]
    took = time.perf_counter() - middle
    want = np.array([[C.total(nll[f][v][r]) for v in range(9)] for r, f in zip(rows, fits, strict=True)])
    np.testing.assert_allclose(got, want, rtol=1e-9)
    assert np.isinf(got[rows >= 301]).all() and middle - began < took
