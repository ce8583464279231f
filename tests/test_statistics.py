import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspan.functions import numbers as N
from trialspan.operators import scores as S, statistics as X


@pytest.fixture(scope="module")
def deltas(spark):
    rng = random.Random(3)
    rows = [("c", f"p{i}", f"igt_{'abcdefg'[i % 7]}study{2000 + i % 7}", rng.gauss(-0.2, 1) + (i % 7) / 10) for i in range(160)]
    return spark.createDataFrame(rows, "contrast string, prompt_id string, experiment string, delta double")


def d_of(x):
    return x.mean() / x.std(ddof=1)


@pytest.mark.parametrize(("t", "df", "p"), [(2.0, 10, 0.036694), (0.0, 5, 0.5), (-2.0, 10, 0.963306), (1.0, 1, 0.25), (12.706205, 1, 0.025)])
def test_t_survival(t, df, p):
    assert N.t_survival(t, df) == pytest.approx(p, abs=1e-6)


def test_t_survival_is_nan_without_values():
    assert math.isnan(N.t_survival(None, 3)) and math.isnan(N.t_survival(1.0, 0)) and math.isnan(N.t_survival(float("nan"), 3))


def test_paired_summary(spark, deltas):
    x = np.array([r.delta for r in deltas.collect()])
    row = S.paired_summary(deltas, ["contrast"]).first()
    assert row.n == 160 and row.d == pytest.approx(d_of(x)) and row.t == pytest.approx(d_of(x) * math.sqrt(160)) and row.share_below == pytest.approx((x < 0).mean())
    one = S.paired_summary(deltas.limit(1), ["contrast"]).first()
    assert one.delta_sd == 0.0 and one.d is None


def test_leave_one_out_equals_recomputation(deltas):
    studied = S.study_column(deltas)
    rows = studied.toPandas()
    out = X.leave_one_out(X.cluster_moments(studied, ["contrast"], "study"), ["contrast"], "study").toPandas()
    assert len(out) == 7
    for r in out.itertuples():
        assert r.d_without == pytest.approx(d_of(rows[rows.study != r.study].delta), abs=1e-12)
        assert r.d_all == pytest.approx(d_of(rows.delta), abs=1e-12)


def test_exact_cluster_bootstrap_equals_the_plain_loop(deltas):
    studied = S.study_column(deltas)
    rows = studied.toPandas()
    groups = [g.delta.to_numpy() for _, g in rows.groupby("study")]
    rng, ds = random.Random(5), []
    for _ in range(300):
        ds.append(d_of(np.concatenate([groups[rng.randint(0, len(groups) - 1)] for _ in groups])))
    ds.sort()
    got = X.cluster_bootstrap(X.cluster_moments(studied, ["contrast"], "study"), ["contrast"], "study", 300, seed=5, draws="exact").first()
    assert got.low == pytest.approx(ds[int(0.025 * 300)], abs=1e-12) and got.high == pytest.approx(ds[int(0.975 * 300)], abs=1e-12)


def test_resampling_forms_agree_roughly(deltas):
    exact = X.exact_resampling(deltas, ["contrast"], 2000).first()
    hashed = X.session_bootstrap(deltas, ["contrast"], 2000).first()
    assert hashed.low == pytest.approx(exact.mean_low, abs=0.05) and hashed.high == pytest.approx(exact.mean_high, abs=0.05)
    assert X.sign_flip(deltas, ["contrast"], 2000).first().p == pytest.approx(exact.p_sign_flip, abs=0.05)


def test_latest_scores_and_missing_values(spark):
    rows = [("m", "p", "igt-A", None, 1.0, 3, 3, "2024-01-01"), ("m", "p", "igt-A", None, 2.0, 3, 3, "2024-02-01"), ("m", "q", None, None, float("nan"), 1, 1, "2024-01-01"), ("m", "r", None, None, float("inf"), 1, 1, "2024-01-01"), ("m", "s", None, "x", 0.5, None, None, None)]
    raw = spark.createDataFrame(rows, "model string, prompt_id string, experiment string, cohort string, nll double, n_answer_tokens int, n_answer_spans int, scored_at string")
    got = {r.prompt_id: (r.nll, r.experiment) for r in S.latest_scores(raw).collect()}
    assert got == {"p": (2.0, "igt_a"), "s": (0.5, "unknown")}
    assert S.latest_scores(raw.limit(0)).count() == 0


def test_softmax_and_mass(spark):
    xs = F.array(*[F.lit(x) for x in (1.0, 2.0, 1000.0)])
    row = spark.range(1).select(N.softmax(xs).alias("p"), N.logsumexp(xs).alias("z")).first()
    assert sum(row.p) == pytest.approx(1.0) and row.z == pytest.approx(1000.0)


def test_cells_and_verdicts(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0), ("y", 2.5), ("w", 1.0)], "k string, v double")
    assert {r.k: r.state for r in X.compare_cells(a, b, ["k"], "v").collect()} == {"x": "identical", "y": "different", "z": "left_only", "w": "right_only"}
    v = spark.createDataFrame([(-0.3, 0.01), (0.05, 0.9), (-0.3, 0.2)], "d double, p double").select(X.verdict(F.col("d"), F.col("p")).alias("v"))
    assert [r.v for r in v.collect()] == ["win", "equivalent", "inconclusive"]
