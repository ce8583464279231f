import numpy as np
import pytest

from trialspan.operators import cognitive as C
from trialspan.operators.pooled import UPPER, Scoring, _rough_slopes, pooled_folds, pvl_slopes
from trialspan.plans import likelihoods as L

TRIALS = "array<struct<deck:string,gain:double,loss:double>>"


def listed(n, seed, most=60, losses=(0, 0, 2.5, 12.5)):
    rng = np.random.default_rng(seed)
    return [[{"deck": "ABCD"[int(rng.integers(0, 4) * rng.random() ** 0.5)], "gain": float(rng.choice([0, 0.5, 1, 1.15])), "loss": float(rng.choice(losses))} for _ in range(rng.integers(20, most))] for _ in range(n)]


def plain(v, s):
    with np.errstate(all="ignore"):
        nll = C.pvl_delta(v, s)
    return np.where(np.isfinite(nll), nll, 0.0)


def test_slopes_equal_differences_of_the_plain_model_also_where_exponentials_leave_their_range():
    s = C.Sessions.of([*listed(9, 1), *listed(3, 2, losses=(0, 1250.0)), [{"deck": "X", "gain": 1.0, "loss": 0.0}, {"deck": "B", "gain": 2.0, "loss": 9.0}]])
    vectors = np.random.default_rng(4).normal(0, 1.5, (2, 3, 4))
    groups, rows = np.repeat([0, 1], [6, 7]), np.array([0, 2, 5, 6, 7, 8, 9, 10, 11, 12])
    blocks = (rows > 5).astype(int)
    got = pvl_slopes(vectors, s, groups, np.array([0, 1]), rows, blocks)
    for b in range(2):
        part = s.only(rows[blocks == b])
        for i, v in enumerate(vectors[b]):
            assert got[b, 0, i] == pytest.approx(plain(v, part).sum(), rel=1e-10)
            by = np.array([(plain(v + e, part).sum() - plain(v - e, part).sum()) / 2e-5 for e in np.eye(4) * 1e-5])
            np.testing.assert_allclose(got[b, 1:5, i], by, rtol=1e-4, atol=1e-4 * np.abs(by).max())


def test_information_is_the_mean_square_of_slopes_over_the_decks_that_could_be_chosen():
    s = C.Sessions.of(listed(2, 8, 25))
    v, want = np.array([0.3, -0.4, -1.0, -0.2]), np.zeros((4, 4))
    for row in range(2):
        for j in range(int(s.lengths[row])):
            each = [C.Sessions(np.where(np.arange(s.deck.shape[1]) == j, d, s.deck[row])[None, : j + 1], s.gain[[row], : j + 1], s.loss[[row], : j + 1], np.array([j + 1])) for d in range(4)]
            by = np.array([[(C.pvl_delta(v + e, x)[0, j] - C.pvl_delta(v - e, x)[0, j]) / 2e-5 for e in np.eye(4) * 1e-5] for x in each])
            want += np.einsum("d,di,dj->ij", np.exp([-C.pvl_delta(v, x)[0, j] for x in each]), by, by)
    got = pvl_slopes(v[None, None], s, np.zeros(2, int), np.zeros(1, int), np.arange(2), np.zeros(2, int))[0, 5:, 0]
    np.testing.assert_allclose(got, want[UPPER], rtol=1e-5, atol=1e-6 * np.abs(want).max())


def test_a_session_without_decks_makes_its_blocks_infinite_and_odd_amounts_go_by_differences():
    s = C.Sessions.of([*listed(2, 3), [{"deck": "X", "gain": 1.0, "loss": 0.0}]])
    got = pvl_slopes(np.zeros((2, 1, 4)), s, np.zeros(3, int), np.zeros(2, int), np.array([0, 2, 1]), np.array([0, 0, 1]))
    assert np.isinf(got[0, 0, 0]) and np.isfinite(got[1]).all()
    calm, v = C.Sessions.of(listed(4, 5)), np.random.default_rng(1).normal(0, 1, (2, 4))
    rough, exact = _rough_slopes(v, calm), pvl_slopes(v[None], calm, np.zeros(4, int), np.zeros(1, int), np.arange(4), np.zeros(4, int))[0]
    np.testing.assert_allclose(rough[:5], exact[:5], rtol=1e-4, atol=1e-3)
    odd = C.Sessions.of([[{"deck": "A", "gain": float("nan"), "loss": 0.0}, {"deck": "A", "gain": 1.0, "loss": 0.0}, {"deck": "B", "gain": 1e300, "loss": 0.0}], []])
    assert np.isinf(_rough_slopes(v, odd)[0]).all() and np.isfinite(_rough_slopes(v, odd.only(np.array([0])))).all()


def test_every_start_settles_at_a_place_without_slope():
    s = C.Sessions.of(listed(30, 11))
    d = Scoring(np.random.default_rng(0).normal(0, 1, (12, 4)))
    for _ in range(1000):
        at = np.nonzero(~d.done)[0]
        if len(at):
            n = len(s.deck)
            d.take(at, pvl_slopes(d.next[at][None], s, np.zeros(n, int), np.zeros(1, int), np.arange(n), np.zeros(n, int))[0].T)
    assert d.converged.all() and d.value.min() <= C.fit("pvl", s, starts=2, steps=60)["fun"] + 1e-3


def test_pooled_fits_with_odd_amounts_and_empty_sessions(spark):
    rows = [(i, "e", f"u{i}", x) for i, x in enumerate(listed(6, 21))] + [(6, "e", "u6", [{"deck": "A", "gain": 1e200, "loss": 0.0}, {"deck": "B", "gain": 1.0, "loss": 0.0}])]
    rows += [(10 + i, "f", f"u{i}", x) for i, x in enumerate([*listed(3, 22), []])]
    out = pooled_folds(spark.createDataFrame(rows, f"k int, experiment string, u string, trials {TRIALS}"), "k", "u", "trials", "experiment", "pvl", folds=7, starts=2, steps=12).collect()
    by = {r.k: r for r in out}
    assert all(np.isfinite(by[k].fit_nll) for k in range(7)) and np.isfinite(by[13].fit_nll) and by[13].eval_mean_nll is None
    assert {by[k].status for k in (10, 11, 12)} == {"fit_failed"}
    for k in range(7):
        train = C.Sessions.of([x for i, _, _, x in rows[:7] if i != k])
        assert by[k].fit_nll == pytest.approx(plain(np.array(by[k].params), train).sum())


def test_the_registered_pooled_fits_have_the_starts_and_steps_of_the_study(monkeypatch, spark, tmp_path):
    asked = {}
    monkeypatch.setattr(L, "_people", lambda *a: None)
    monkeypatch.setattr(L, "pooled_folds", lambda *a, **named: asked.update(named) or spark.createDataFrame([(1, "x")], "k int, deck_map string"))
    L.pooled_kfold_fit(spark, str(tmp_path))
    assert (asked["starts"], asked["steps"], asked["folds"]) == (32, 1000, 5)
