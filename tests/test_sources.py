import json

import pytest
from pyspark.sql import functions as F

from trialspan.operators.gates import GateError
from trialspan.sources import readers as R, writers as K
from trialspan.streaming import scores as stream


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt_id":"x","nll":1.5}\n\n{"prompt_id":"y","nl')
    assert [r.prompt_id for r in R.sound_lines(spark, str(tmp_path / "a.jsonl"), R.SCORE).collect()] == ["x"]
    (tmp_path / "b.json").write_text(json.dumps([{"prompt_id": "x", "nll": 1}, {"prompt_id": "y", "nll": 2}]))
    (tmp_path / "c.json").write_text(json.dumps({"k": {"prompt_id": "z", "nll": 3}}))
    assert sorted(r.prompt_id for r in R.records(spark, str(tmp_path / "b.json"), "json", R.SCORE).collect()) == ["x", "y"]
    assert [r.nll for r in R.records(spark, str(tmp_path / "c.json"), "json", R.SCORE).collect()] == [3.0]
    assert R.partial_results(spark, str(tmp_path / "none.jsonl"), R.SCORE).count() == 0
    with pytest.raises(ValueError):
        R.records(spark, "x", "csv", R.SCORE)


def test_texts_prompts_and_lists(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert R.whole_texts(spark, str(tmp_path / "t.txt")).first().text == "one\ntwo"
    df = spark.createDataFrame([("1", "", "p <<A>>", None), ("2", None, None, "s <<B>>"), ("3", "no marker", "q <<C>>", None)], "prompt_id string, text string, prompt string, source_text string")
    assert sorted((r.prompt_id, r.text) for r in R.prompts(df).collect()) == [("1", "p <<A>>"), ("2", "s <<B>>")]
    ids = R.ordered_ids(spark.createDataFrame([(["b", "a"],)], "l array<string>"), "l")
    assert [(r.pos, r.prompt_id) for r in ids.collect()] == [(0, "b"), (1, "a")]
    with pytest.raises(GateError):
        R.positional(ids, spark.createDataFrame([(0, "x")], "pos int, v string"))
    (tmp_path / "env").write_text("# note\nexport A='1'\nB=2\n\nA=3\n")
    assert R.environment(str(tmp_path / "env")) == {"A": "1", "B": "2"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "é <<A>>"), (2, None)], "i int, t string")
    K.json_lines(df, str(tmp_path / "o"), files=1)
    assert "é <<A>>" in "".join(p.read_text() for p in (tmp_path / "o").glob("part-*"))
    assert K.content_hash(df).first() == K.content_hash(df.orderBy(F.desc("i"))).first() != K.content_hash(df.limit(1)).first()
    assert K.provenance(df, "t", {"a": "b"}).first().n_texts == 2
    assert K.markdown(df).splitlines()[0] == "| i | t |"
    with pytest.raises(ValueError):
        K.markdown(spark.range(9), most_rows=5)


def test_stream_appends_once(spark, tmp_path):
    schema = "model string, prompt_id string, nll double, scored_at timestamp"
    rows = [("m", "a", 1.0, "2024-01-01 00:00:00"), ("m", "a", 1.0, "2024-01-01 00:00:00"), ("m", "b", 2.0, "2024-01-02 00:00:00")]
    make = lambda r: spark.createDataFrame(r, "model string, prompt_id string, nll double, scored_at string").withColumn("scored_at", F.col("scored_at").cast("timestamp"))
    make(rows).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = stream.append_new(stream.score_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), ["model", "prompt_id"], str(tmp_path / "ck"))
        q.awaitTermination(60)
        make([("m", "b", 9.0, "2024-01-03 00:00:00"), ("m", "c", 3.0, "2024-01-03 00:00:00")]).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted((r.prompt_id, r.nll) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    means = stream.windowed_means(stream.score_stream(spark, str(tmp_path / "in"), schema))
    q = means.writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(r.n for r in spark.sql("SELECT * FROM means").collect()) >= 3
