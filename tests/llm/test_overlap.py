import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from trialspan.llm import overlap as O

SCHEMA = "row_id long, trials array<struct<deck:string,gain:double,loss:double>>, split string, experiment string, blocks string, class string"
RNG = np.random.default_rng(4)


def session(n):
    return [("A", float(RNG.choice([50, 60, 70, 100, 120])), float(RNG.choice([0, 0, 25, 50, 150, 250, 1250]))) for _ in range(n)]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25), st.integers(0, 12))
def test_edit_distance(a, b, most):
    d = plain_distance(a, b)
    assert O.edit_distance(a, b, most) == (d if d <= most else most + 1)


def changed(s, n):
    s = list(s)
    for i in RNG.choice(len(s), n, replace=False):
        s[i] = ("B", s[i][1] + 5, s[i][2])
    return s


@pytest.fixture(scope="module")
def rows():
    base = [session(int(RNG.integers(20, 120))) for _ in range(25)]
    out = []
    for i, s in enumerate(base):
        out.append((len(out), s, "train"))
        near = changed(s, int(0.1 * len(s)))
        out.append((len(out), [(d, g * 100, -x * 100) for d, g, x in near], "Test "))
        out.append((len(out), [(d, g + 0.0004, x) for d, g, x in s[: -max(1, len(s) // 11)]], "dev"))
        out.append((len(out), changed(s, len(s) // 3), "heldout" if i % 2 else "train"))
    return out


def test_pairs_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "e", "b", "c") for r in rows], SCHEMA)
    got = {(r.row_id_a, r.row_id_b) for r in O.crossing_pairs(df).collect()}
    clean = []
    for i, s, split in rows:
        codes = O.whole_units(np.array([x[1] for x in s]), np.array([x[2] for x in s]), np.array([0, len(s)])).tolist()
        clean.append((i, codes, split.strip().lower() == "train"))
    want = set()
    for i, a, x in clean:
        for j, b, y in clean:
            if x and not y and len(a) >= 20 and len(b) >= 20 and plain_distance(a, b) <= 0.1 * max(len(a), len(b)):
                want.add((min(i, j), max(i, j)))
    assert got == want and len(want) >= 25


def test_histogram_bits_stay_within_twice_the_distance():
    for _ in range(50):
        s = [hash(x) for x in session(60)]
        t = list(s)
        for _ in range(5):
            t[RNG.integers(len(t))] = int(RNG.integers(10**6))
        bits = [O.histogram_bits(np.array(x, np.int64), np.array([0, len(x)]))[0] for x in (s, t)]
        assert sum((int(a) ^ int(b) & 0xFFFFFFFFFFFFFFFF).bit_count() if a >= 0 and b >= 0 else ((int(a) ^ int(b)) & 0xFFFFFFFFFFFFFFFF).bit_count() for a, b in zip(*bits, strict=True)) <= 2 * plain_distance(s, t)


def test_units_within_a_session():
    gain, loss = np.array([50.0, 6000.0, 0.0, np.nan, 55.0]), np.array([0.0, -12500.0, 2500.0, 0.0, np.inf])
    codes = O.whole_units(gain, loss, np.array([0, 5]))
    assert [(int(c) >> 32, int(c) & 0xFFFFFFFF) for c in codes] == [(50, 0), (60, 125), (0, 25), (2**30, 0), (55, 2**30)]


def test_odd_rows(spark):
    s, long = session(30), session(30) * 200
    rows = [(1, s, "train"), (2, s, "test"), (2, s, "test"), (None, s, "test"), (3, None, "test"), (4, [], "test"), (5, s[:19], "test"), (6, s, None), (7, s, "other"), (8, [None] * 25, "train"), (9, [(None, None, None)] * 25, "val"), (10, long, "train"), (11, long, "valid")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    got = sorted((r.row_id_a, r.row_id_b) for r in O.crossing_pairs(df).collect())
    assert got == [(1, 2), (1, 2), (8, 9), (10, 11)]
    report = O.overlap_report(df).collect()
    assert sum(r.n_overlapping for r in report) == 4
    empty = df.limit(0)
    assert O.crossing_pairs(empty).count() == 0 and O.overlap_report(empty).count() == 0


def test_hot_class(spark):
    s = session(40)
    df = spark.createDataFrame([(i, s, "train" if i % 2 else "test", "e", "b", "c") for i in range(60)], SCHEMA)
    assert O.crossing_pairs(df).count() == 900
    rows = O.overlap_by_row(df).collect()
    assert len(rows) == 30 and {(r.distance, r.n_train_rows) for r in rows} == {(0, 30)} and len({r["class"] for r in rows}) == 1


def test_a_segment_of_many_sequences_is_spread_without_loss(spark, monkeypatch):
    common = session(20)
    rows = [(i, common + session(40), "train" if i % 3 else "test") for i in range(60)]
    rows += [(100 + i, s[:-2] + session(2), "dev") for i, s, _ in rows[:20]]
    df = spark.createDataFrame([(*r, "e", "b", "c") for r in rows], SCHEMA)
    want = sorted((r.row_id_a, r.row_id_b) for r in O.crossing_pairs(df).collect())
    monkeypatch.setattr(O, "HOT", 3)
    assert want and sorted((r.row_id_a, r.row_id_b) for r in O.crossing_pairs(df).collect()) == want


def test_evenly_spread_edits_of_repetitive_sessions(spark):
    rng, out = np.random.default_rng(9), []
    for i in range(150):
        n = int(rng.integers(80, 150))
        s = [("A", float(g), float(x)) for g, x in zip(rng.choice([50, 100], n), rng.choice([0, 0, 0, 50], n))]
        near, edits = list(s), int(0.1 * n)
        for j in range(edits):
            near[(2 * j + 1) * n // (2 * edits)] = s[int(rng.integers(n))] if i % 2 else ("A", 75.0 + j, 1250.0)
        out += [(2 * i, s, "train"), (2 * i + 1, near, "test")]
    df = spark.createDataFrame([(*r, "e", "b", "c") for r in out], SCHEMA)
    got = {(r.row_id_a, r.row_id_b) for r in O.crossing_pairs(df).collect()}
    assert {(2 * i, 2 * i + 1) for i in range(150)} <= got


def test_a_held_session_has_few_windows_and_few_bytes(spark):
    """Each window of a held session is a row of the largest shuffle, and its trials are stored once."""
    codes = O.whole_units(*(np.array([x[i] for x in session(100)]) for i in (1, 2)), np.array([0, 100]))
    assert len(O.run_keys(codes, np.array([0, 100]), True)[0]) <= 100
    df = spark.createDataFrame([(1, session(100), "test", "e", "b", "c")], SCHEMA)
    assert len(O.coded_sessions(df).first().codes) < 400


def test_equal_runs_alone_make_no_candidates(spark):
    """Sessions of different trials that share stretches do not meet: their number would grow with the square of the sessions."""
    streak, rng = [("A", 50.0, 0.0)] * 24, np.random.default_rng(2)
    rows = [(i, [("A", float(g), float(x)) for g, x in rng.integers(0, 40, (76, 2))] + streak, "test" if i % 2 else "train", "e", "b", "c") for i in range(60)]
    assert O.candidates(O.sequence_classes(O.coded_sessions(spark.createDataFrame(rows, SCHEMA)))).count() == 0
