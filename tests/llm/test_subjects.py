import random

import pytest
from pyspark.sql import functions as F

from trialspan.llm import subjects as S

MANIFEST = "row_id long, prompt_id string, subject_id string, node string, label string"
LINKS = "link_id long, sid_a string, sid_b string, kind string, status string"


def manifest(spark, ids):
    return spark.createDataFrame([(i, f"p{i}", s, "x", "y") for i, s in enumerate(ids)], MANIFEST)


def links(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], LINKS)


@pytest.mark.parametrize(
    ("written", "key"),
    [
        ("brastolen2018_0012", "brastolen2018#12"), ("IGT_Brastolen18–S12 (2)", "brastolen2018#12"), ("#０0１2 - brastolen2018", "brastolen2018#12"), ("vp12|igt_brastolen2018", "brastolen2018#12"),
        ("brastolen2018/sub-012/session-3", "brastolen2018#12"), ("brastolen2018_12_retest_r2", "brastolen2018#12"), (" brastolen2018.p12.t2\t", "brastolen2018#12"), ("brastolen2018x_0012", "brastolen2018x#12"),
        ("quenmar2016_hc_0007", "quenmar2016_hc#7"), ("Quenmar16–stim–VP007_visit2", "quenmar2016_stim#7"), ("12@quenmar2016 opi", "quenmar2016_opi#12"), ("no id at all", "?no id at all"), ("", None), (None, None),
    ],
)
def test_spellings(spark, written, key):
    assert spark.createDataFrame([(written,)], "s string").select(S.participant_key(F.col("s")).alias("k")).first().k == key


def test_components_equal_brute_force(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randint(0, 150)}", f"n{rng.randint(0, 150)}") for _ in range(130)] + [(f"c{i}", f"c{i + 1}") for i in range(60)] + [("hub", f"leaf{i}") for i in range(80)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    got = {r.node: r.label for r in S.frontier_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    ours, theirs = {}, {}
    for n in nodes:
        ours.setdefault(got[n], set()).add(n)
        theirs.setdefault(root(n), set()).add(n)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_pairs(spark):
    m = manifest(spark, ["a2011_001", "A11-S1", "b2012_5", "c2013_7", "d2014_1", None, "", "a2011_001"])
    ln = links(spark, [("a2011_1", "z2019_3", "k", "Confirmed"), ("Z19/3", "b2012_05", "k", "confirmed"), ("b2012_5", "c2013_7", "k", "rejected"), ("c2013_7", None, "k", "confirmed"), ("d2014_1", "d2014_01", "k", "confirmed"), ("c2013_7", "d2014_1", "k", None), ("b2012_5", "z2019_3", "k", "confirmed")])
    pairs = {(r.subject_id_a, r.subject_id_b) for r in S.same_participant_pairs(m, ln).collect()}
    assert pairs == {("A11-S1", "a2011_001"), ("A11-S1", "b2012_5"), ("a2011_001", "b2012_5")}


def test_empty_tables(spark):
    m, ln = manifest(spark, []), links(spark, [])
    assert S.same_participant_pairs(m, ln).count() == 0 and S.assign_splits(m, ln).count() == 0 and S.split_report(S.assign_splits(m, ln)).count() == 0
    assert S.same_participant_pairs(manifest(spark, ["a2011_1", "A2011_1"]), ln).count() == 1


def test_splits_keep_participants_together(spark):
    ids = [f"s20{10 + i % 9}_{i % 700}" for i in range(2100)] + ["hot2015_1"] * 900 + [None] * 20
    m = manifest(spark, ids).union(spark.createDataFrame([(9000, "p5", None, "x", "y"), (9001, None, None, None, None)], MANIFEST))
    got = S.assign_splits(m, links(spark, [("s2010_0", "s2011_1", "k", "confirmed")])).toPandas()
    assert len(got) == len(ids) + 2 and got.row_id.is_unique
    assert (got.groupby("participant").assigned_split.nunique() == 1).all()
    share = got.assigned_split.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["test"] - 0.1) < 0.01
    by = got.set_index("row_id")
    assert by.loc[9000, "participant"] == by.loc[5, "participant"] and by.loc[0, "participant"] == by.loc[1, "participant"]
