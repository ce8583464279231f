import json
import random
import hashlib

from pyspark.sql import functions as F

from trialspan.__main__ import main
from trialspan.operators import answers as A, prompts as P, scores as S, statistics as X
from trialspan.sources import readers, writers


def test_choice_cascade_over_fields_and_choices(spark):
    given = [
        ({"choice": " ", "text": "B>> etc"}, "B"), ({"generated_text": "You press <<C"}, "C"), ({"output": "x <<D>>. then"}, "D"), ({"response": " plain "}, "plain"), ({"choices": [{"text": "E >>"}]}, "E"),
        ({"choices": [" F "]}, "F"), ({"choices": []}, ""), ({"choices": [[1]]}, ""), ({}, ""), ({"choice": None, "choices": [{"choice": ""}]}, ""),
    ]
    df = spark.createDataFrame([(i, json.dumps(r), want) for i, (r, want) in enumerate(given)] + [(99, None, ""), (98, "no json", "")], "k int, r string, want string")
    assert all(r.c == r.want for r in df.select("want", A.choice_of(F.col("r")).alias("c")).collect())


def test_trial_rows_and_metrics(spark):
    df = spark.createDataFrame([(1, "a", "B", '{"choice":"B","logprob":-1}'), (2, "a", "B", '{"choice":" b"}'), (3, "b", None, '{"choice":"B"}'), (4, "b", "C", None)], "k int, e string, want string, r string")
    rows = A.trial_rows(df, "k", "want", "r")
    got = {r.k: r for r in rows.collect()}
    assert [got[k].correct for k in (1, 2, 3, 4)] == [True, False, None, False] and got[2].tolerant and got[1].logprob == -1.0 and not got[4].per_trial_ready
    m = {(r.level, r.e): r for r in A.trial_metrics(rows, "e").collect()}
    assert m["global", None].n_trials == 4 and m["global", None].n_scored == 3 and m["group", "a"].tolerant_accuracy == 1.0 and len(m) == 3
    report = writers.metrics_report(A.trial_metrics(rows, "e"), "e", rows.select("k", "want", "action"))
    assert report.count("| ---") >= 3 and "## Trial outcomes" in report
    assert A.trial_metrics(rows.limit(0), "e").where("level = 'group'").count() == 0


def test_session_likelihood_from_recorded_trials(spark):
    r = json.dumps({"per_trial_logprobs": [{"trial_index": 0, "target_text": "A", "target_token_logprobs": [-1.0, -0.5]}, {"trial_index": 1, "target_text": "B", "target_token_logprobs": [-0.3]}, {"trial_index": 2, "target_token_logprobs": []}]})
    df = spark.createDataFrame([("s", r), ("none", "{}"), ("null", None)], "k string, response string")
    one = A.session_nll(A.trial_logprobs(df, "k", "response"), "k").collect()
    assert len(one) == 1 and abs(one[0].nll - 0.6) < 1e-12 and one[0].n_answer_tokens == 3 and one[0].n_answer_spans == 3


def test_labels_of_known_subjects(spark):
    pool = [c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in "IOS"]
    for s in ("subject_1", "x"):
        want = random.Random(int(hashlib.sha256(s.encode()).hexdigest()[:16], 16)).sample(pool, 4)
        assert spark.createDataFrame([(s,)], "s string").select(P.seeded_labels("s").alias("l")).first().l == want


def test_full_prompt(spark):
    df = spark.createDataFrame([([("A", 100.0, -50.0)], ["K", "L", "M", "N"]), (None, ["K", "L", "M", "N"]), ([("A", 1.0, 0.0)], None)], "t array<struct<deck:string,gain:double,loss:double>>, l array<string>")
    got = [r.p for r in df.select(P.full_prompt(F.col("t"), F.col("l"), 2000, F.size("t"), "$").alias("p")).collect()]
    assert got[0].startswith("You see in front of you four decks of cards labeled K, L, M, and N.\nYou get a loan of 2000$ of play money.") and "for 1 trials." in got[0] and got[0].endswith("You press <<K>>. You win 100.0$ and lose 50.0$.") and got[2] is None


def test_lookups_and_remaps(spark):
    m = spark.createDataFrame([(1, "e", "a_7", "old", 1), (2, "e", "a_7", "new", 2), (3, "e", "b_7", "other", 3), (4, "e", "7", "whole", 4), (5, "e", "c_9", None, 5), (6, "e", None, "x", 6)], "row_id int, e string, s string, v string, t int")
    got = {r.id: (r.v, r.by) for r in S.alias_maps(m, "e", "s", "v", ["t"]).collect()}
    assert got == {"a_7": ("new", "id"), "b_7": ("other", "id"), "7": ("whole", "id"), "c_9": (None, "id"), "9": (None, "alias")}
    df = spark.createDataFrame([("a", "e1"), ("b", "e2"), (None, "e3")], "k string, experiment string")
    mapping = spark.createDataFrame([("a", "X"), ("a", "Y"), ("a", "Y"), ("b", "unknown"), ("b", None), (None, "Z")], "sid string, cohort string")
    assert {r.k: r.origin for r in S.remapped(df, mapping, "k", "sid", "p_").collect()} == {"a": "p_Y", "b": "e2", None: "e3"}
    assert [r.s for r in spark.createDataFrame([("igt_one2018_b",), ("igt_two",)], "e string").select(S.collapsed(F.col("e"), {"igt_one2018": "One 2018"}).alias("s")).collect()] == ["One 2018", "two"]


def test_replicates_as_vectors_equal_plain_loops(spark):
    import numpy as np

    rng = random.Random(3)
    rows = [("c" if i % 3 else "d", f"p{i % 40}", rng.gauss(-0.2, 1)) for i in range(90)] + [("c", None, 1.0), ("d", "p1", None)]
    df = spark.createDataFrame(rows, "contrast string, prompt_id string, delta double").repartition(5)
    got = {r.contrast: r for r in X.replicate_sums(df, ["contrast"], 50, 7, lambda x: (x % 5).astype(float)).collect()}
    for name in "cd":
        own = [(p, d) for c, p, d in rows if c == name and p and d is not None]
        ids = np.array([int(hashlib.md5(p.encode()).hexdigest()[:8], 16) for p, _ in own])
        w = (X.draws(ids, np.arange(50), 7) % 5).astype(float)
        np.testing.assert_allclose(got[name].w, w.sum(axis=0))
        np.testing.assert_allclose(got[name].s, np.array([d for _, d in own]) @ w)
    assert X.session_bootstrap(df.limit(0), ["contrast"], 10).count() == 0
    u = X.draws(np.arange(2000), np.arange(50), 1)
    assert abs((u & 1).mean() - 0.5) < 0.01 and abs(u.mean() / 2**32 - 0.5) < 0.01


def test_floor_checks_have_the_whole_alpha(spark):
    df = spark.createDataFrame([("below", float(-1 - i % 3)) for i in range(20)] + [("none", float(i % 2 * 2 - 1)) for i in range(20)], "contrast string, delta double")
    got = {r.contrast: (r.alpha, r.holds) for r in X.floor_checks(S.paired_summary(df, ["contrast"])).collect()}
    assert got == {"below": (0.05, True), "none": (0.05, False)}


def test_positional_join_refuses_lists_of_unequal_length(spark):
    import pytest
    from trialspan.operators.gates import GateError

    a, b = spark.createDataFrame([(0, "x"), (1, "y")], "pos int, a string"), spark.createDataFrame([(0, 1), (1, 2)], "pos int, b int")
    assert sorted((r.a, r.b) for r in readers.positional(a, b).collect()) == [("x", 1), ("y", 2)]
    with pytest.raises(GateError):
        readers.positional(a, b.limit(1))


def test_reports_archives_and_command_line(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.5), ("a", None)], "k string, v double")
    report = json.loads(writers.pretty_json(df, str(tmp_path / "r"), "k", {"p": "1"}))
    assert list(report["rows"]) == ["a", "b"] and report["created_at"].endswith("Z")
    writers.with_trials(df, df, str(tmp_path / "out"))
    spark.range(1).count()
    copy = writers.archive(str(tmp_path / "out"), "run1")
    assert spark.read.json(f"{copy}/trials").count() == 2
    rows = [(m, f"p{i}", "e", "c", float(i % 5) + (m == "b"), 3, 3) for i in range(30) for m in "ab"]
    spark.createDataFrame(rows, "model string, prompt_id string, experiment string, cohort string, nll double, n_answer_tokens int, n_answer_spans int").withColumn("scored_at", F.current_timestamp()).write.parquet(str(tmp_path / "scores"))
    main(["statistics", "--scores", str(tmp_path / "scores"), "--pair", "a", "b", "--replicates", "200", "--out", str(tmp_path / "stats")])
    one = spark.read.parquet(str(tmp_path / "stats")).first()
    assert one.n == 30 and one.delta_mean == -1.0 and one.low == -1.0
