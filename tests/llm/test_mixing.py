import re

import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same, tables
from tickloom.llm import mixing
from tickloom.llm.common import word_count

SCHEMA = "doc_id long, text string, source string, size int, _mix_size long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, 9) for i, t, s in rows], SCHEMA)


def targets(sizes, cap=3):
    """Sources in order -> targets, by sharing the excess again and again."""
    total, weights = sum(sizes), [k % 3 + 1 for k in range(len(sizes))]
    full, out = set(), {}
    while True:
        left = total - sum(cap * sizes[k] for k in full)
        open_ = [k for k in range(len(sizes)) if k not in full]
        out = {k: cap * sizes[k] for k in full} | {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = [k for k in open_ if out[k] > cap * sizes[k]]
        if not over:
            return [out[k] for k in range(len(sizes))]
        full |= set(over)


def test_targets_and_taken(spark):
    rows = [(i, "w " * (i % 9 + 1), ["b", "a", None, "B", "é"][i % 5] if i % 3 else "hot") for i in range(200)]
    rows += [(500, None, "a"), (501, "", "b"), (502, " \t\n", None), (503, "x " * 20000, "empty-ish"), (None, "n n", "a"), (7, "same row", "a"), (7, "same row", "a")]
    plan = mixing.plan_mix(make(spark, rows), word_count(F.col("text")))
    got = plan.select("source", F.col("_mix_n").alias("n"), F.col("_mix_total").alias("s"), F.col("_mix_target").alias("t"), F.aggregate("_mix_copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken")).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, targets([sizes[s] for s in order])))
    for s in order:
        mine = [r for r in got if r.source == s]
        assert {r.s for r in mine} == {sizes[s]} and mine[0].t == pytest.approx(want[s])
        assert sum(r.taken for r in mine) == int(want[s] + 1e-9) and all(0 <= r.taken <= 3 * r.n for r in mine)


def test_positions_follow_schedules_and_order(spark):
    docs = make(spark, [(i, "w " * 10, "abc"[i % 3]) for i in range(300)])
    plan = mixing.plan_mix(docs, word_count(F.col("text")), whole=True)
    rows = plan.select("source", F.explode("_mix_copies").alias("c")).select("source", "c.position").collect()
    assert all(0 <= r.position <= 1 for r in rows)
    early = {s: sum(r.position < 0.5 for r in rows if r.source == s) / sum(r.source == s for r in rows) for s in "abc"}
    assert early["a"] > early["b"] > early["c"]
    ordered = mixing.training_order(plan, ["doc_id"])
    assert ordered.count() == len(rows) and [tuple(r) for r in ordered.collect()] == [tuple(r) for r in ordered.collect()]


@pytest.mark.parametrize("x", [0.0, 0.1, 0.5, 0.77, 1.0])
def test_inverse_demand(spark, x):
    phases = (1.5, 0.0, 0.5)
    t = spark.range(1).select(mixing.inverse_demand(F.lit(x), phases).alias("t")).first().t
    used = sum(p * max(0.0, min(1.0, t * 3 - k)) for k, p in enumerate(phases)) / sum(phases)
    assert used == pytest.approx(x)


def test_nothing_to_mix(spark):
    for rows in ([], [(1, None, None)], [(1, "", "a"), (2, "", "b")]):
        plan = mixing.plan_mix(make(spark, rows), word_count(F.col("text")))
        assert plan.count() == len(rows) and plan.filter(F.size("_mix_copies") > 0).count() == 0


def test_query_equals_oracle(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(mixing.op1_curriculum_mix(spark, sf), tables(sf), mixing.ORACLE)


def test_documents_without_a_word_have_no_copy(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, " \t", "a"), (4, "one two", "a"), (5, None, "b")], "doc_id long, text string, source string")
    plan = mixing.plan_mix(docs, mixing.word_count(docs.text), whole=True)
    assert {r.doc_id: len(r._mix_copies) for r in plan.collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0}
    assert [r.doc_id for r in mixing.training_order(plan, docs.columns).collect()] == [4]
