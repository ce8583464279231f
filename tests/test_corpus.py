import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from trialspan.functions import text as T
from trialspan.operators import corpus as K, gates, masks, prompts as P, resume

TEXTS = st.text(alphabet="ab .\n<>中", max_size=120)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_marker_chunks_keep_the_text(text, limit):
    chunks = K.cut_at_markers(text, limit)
    assert "".join(chunks) == text and all(chunks)


def test_markers_are_not_cut():
    text = "aaaa bbbb <<one two three four five six>> cccc " * 5
    for c in K.cut_at_markers(text, 6):
        assert c.count("<<") == c.count(">>")


def test_budget_prefix_keeps_the_row_that_crosses(spark):
    df = spark.createDataFrame([(i, 3) for i in range(40)], "id int, n int")
    order = K.hash_order(F.col("id").cast("string"), "s")
    got = K.budget_prefix(df, order, "id", F.col("n"), 10).orderBy("position").collect()
    wanted = [r.id for r in df.withColumn("o", order).orderBy("o", "id").limit(4).collect()]
    assert [r.id for r in got] == wanted and [r.total_before for r in got] == [0, 3, 6, 9]
    assert K.budget_prefix(df, order, "id", F.col("n"), 0).count() == 40
    assert K.budget_prefix(df, order, "id", F.col("n"), 0, max_rows=7).count() == 7
    assert K.budget_prefix(df.limit(0), order, "id", F.col("n"), 10).count() == 0


def test_sentence_chunks(spark):
    text = " ".join(["x" * 8 + "."] * 5 + ["y" * 60 + "."] + ["z."])
    rows = K.sentence_chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, t string"), "t", 20, 40).collect()
    assert {r.i for r in rows} == {1}
    assert [len(r.chunk) for r in rows] == [29, 19, 61]


def test_filters(spark):
    df = spark.createDataFrame([("IGT_x", "a", 1), ("b", "Deck A here", 2), ("b", "   ", 3), (None, None, 4), ("b", "plain", 5)], "e string, t string, i int")
    reason = K.reject_reason([("task", K.of_task(F.col("e"), F.col("t"))), ("blank", K.blank(F.col("t")))])
    assert {r.i: r.r for r in df.select("i", reason.alias("r")).collect()} == {1: "task", 2: "task", 3: "blank", 4: "blank", 5: None}
    assert K.seeded_positions(5, 1) == random_positions(5, 1)


def random_positions(n, seed):
    out = list(range(n))
    random.Random(seed).shuffle(out)
    return out


@pytest.mark.parametrize(("value", "choice"), [("B>> and so on", "B"), ("I take <<C, no", "C"), ("so <<D>> it is", "D"), (" just A ", "just A"), (None, ""), ("x <<>>", "x <<>>")])
def test_choice(spark, value, choice):
    assert spark.createDataFrame([(value,)], "v string").select(T.choice_in(F.col("v")).alias("c")).first().c == choice


def test_prompts(spark):
    text = "intro\n<<A>> one\n<<B>> two\n<<C>> three"
    row = spark.createDataFrame([(text,)], "t string").select(P.tail_of_choices(F.col("t"), 2).alias("tail"), P.prediction_prompt(F.col("t")).alias("p"), P.last_choice(F.col("t")).alias("c"), P.spans(F.col("t")).alias("s"), P.scanned_spans(F.col("t")).alias("z")).first()
    assert row.tail == "intro\n[1 earlier choices omitted]\n<<B>> two\n<<C>> three" and row.p.endswith("two\n<<") and row.c == "C"
    assert [text[s.start_char : s.end_char] for s in row.s] == ["A", "B", "C"] == [s.target_text for s in row.z]
    labels = spark.createDataFrame([('{"A":"W","B":"X","C":"P","D":"U"}',), ('{"deck_labels_in_order":["K","L","M","N"]}',), ("{}",), (None,), ("broken",)], "m string").select(P.label_list(F.col("m")).alias("l")).collect()
    assert [r.l for r in labels] == [list("WXPU"), list("KLMN"), None, None, None]


def test_masks_and_batches(spark):
    rows = masks.answer_labels(spark.createDataFrame([(1, "go <<AB>> now"), (2, "no span"), (3, None)], "k int, t string"), "k", "t").orderBy("k").collect()
    assert [(r.k, r.n_tokens, r.n_spans, [x for x in r.labels if x >= 0]) for r in rows] == [(1, 5, 1, [2]), (2, 2, 0, [])]
    df = spark.createDataFrame([(i, list(range(1, i + 2))) for i in range(5)], "pos int, ids array<int>").withColumn("labels", F.col("ids"))
    out = masks.collate(df, "pos", "ids", "labels", 2, multiple=4).orderBy("pos").collect()
    assert [len(r.input_ids) for r in out] == [4, 4, 4, 4, 8] and out[0].labels == [1, -100, -100, -100] and out[0].attention_mask == [1, 0, 0, 0]


def test_gates(spark):
    df = spark.createDataFrame([("a", "x <<1>>"), ("a", "y"), (None, ""), ("b", None)], "k string, t string")
    row = gates.prompt_summary(df, "k", "t").first()
    assert row.asDict() == {"n_rows": 4, "n_keys": 2, "n_without_key": 1, "n_repeated_keys": 1, "n_without_text": 2, "n_without_marker": 1}
    assert gates.prompt_summary(df.limit(0), "k", "t").first().n_rows == 0
    with pytest.raises(gates.GateError):
        gates.require(gates.prompt_summary(df, "k", "t"), F.col("n_repeated_keys") == 0, "repeated keys")
    with pytest.raises(gates.GateError):
        gates.cardinality(df, 3, "rows")
    assert gates.drift({"a": 1, "b": 2}, {"a": 1, "c": 3}) == {"b": (2, None), "c": (None, 3)}


def test_resume(spark, tmp_path):
    work = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert sorted(str(r.k) for r in resume.to_do(work, spark.createDataFrame([(1,)], "k int"), ["k"]).collect()) == ["2", "None"]
    a, b = spark.createDataFrame([(1, "old"), (2, "a")], "k int, v string"), spark.createDataFrame([(1, "new")], "k int, v string")
    assert {r.k: r.v for r in resume.fused(a, b, ["k"]).collect()} == {1: "new", 2: "a"} == {r.k: r.v for r in resume.upsert(a, b, "k").collect()}
    made = []
    for _ in range(2):
        out = resume.compute_or_reuse(spark, str(tmp_path / "t"), lambda: made.append(1) or a)
        assert out.count() == 2
    assert len(made) == 1


def test_long_texts_are_collated_whole(spark, tmp_path):
    from trialspan.plans import corpora

    spark.createDataFrame([(1, "word " * 4999 + "words"), (2, "a few words")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    row = corpora.collated_batches(spark, str(tmp_path)).first()
    assert (row.n_rows, row.width, row.n_attended) == (2, 5000, 5003)
