"""Every stage of the pipeline on its own input, against plain versions."""

import hashlib
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_jaccard import plain_groups
from tests.llm.test_mixing import targets
from tests.llm.test_repeats import brute
from tickloom.llm import mixing, toxicity
from tickloom.llm.common import stage, word_count

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        made = stage(function(spark, docs, SF), f"test-{name}")
        out.append((docs, made))
        docs = made
    return out


def frames(step):
    return tuple(df.toPandas().sort_values("doc_id", ignore_index=True) for df in step)


def test_columns(steps):
    assert all(tuple(made.columns) == corpus_pipeline.COLUMNS for _, made in steps[:-1])
    assert [dict(made.dtypes) for _, made in steps[:-1]] == [dict(steps[0][0].dtypes)] * 4


def test_toxic_ones_go(spark, steps):
    before, after = frames(steps[0])
    scored = toxicity.toxicity(steps[0][0], spark.read.parquet(f"{SF}/labels.parquet")).toPandas()
    assert set(after.doc_id) == set(scored[scored._score < toxicity.CUT].doc_id) and len(after) == len(set(after.doc_id))
    assert after.equals(before[before.doc_id.isin(after.doc_id)].reset_index(drop=True))


def test_one_of_each_group_stays(steps):
    before, after = frames(steps[1])
    first = before.doc_id[sorted(set(plain_groups(before.text.tolist())))]
    assert set(after.doc_id) == set(first) and after.equals(before[before.doc_id.isin(first)].reset_index(drop=True))


def test_later_copies_are_cut(steps):
    before, after = frames(steps[2])
    want = {d: (removed, sha) for d, _, removed, _, sha in brute(list(zip(before.doc_id.tolist(), before.text.tolist())), 200, later=True)}
    left = after.set_index("doc_id")
    for row in before.itertuples():
        removed, sha = want[row.doc_id]
        if removed < len(row.text.encode()):
            text = left.text[row.doc_id]
            assert removed or text == row.text
            assert removed == 0 or left.n_chars[row.doc_id] == len(text)
            if not removed or text.isascii():
                assert hashlib.sha256(text.encode()).hexdigest() == sha
        else:
            assert row.doc_id not in left.index


def test_mix_is_whole_documents_near_the_targets(steps):
    before, after = frames(steps[3])
    words = before.assign(n=[len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in before.text])
    sizes = words.groupby("source").n.sum()
    taken = after.merge(words[["doc_id", "n"]], on="doc_id").groupby("source").n.sum().reindex(sizes.index, fill_value=0)
    for source, goal in zip(sizes.index, targets(sizes.tolist())):
        assert abs(taken[source] - goal) <= words[words.source == source].n.max()
    assert after.doc_id.value_counts().max() <= 3
    same = after.drop_duplicates().merge(before, on=list(corpus_pipeline.COLUMNS))
    assert len(same) == after.doc_id.nunique()


def test_pieces_decode_to_the_texts(steps):
    before, after = frames(steps[4])
    want = sorted(zip(before.doc_id, (hashlib.sha256(t.encode()).hexdigest() for t in before.text)))
    assert sorted(zip(after.doc_id, after.decoded_sha256)) == want and (after.n_pieces > 0).all()


def test_run_is_its_stages(spark, steps):
    columns = ["place", "doc_id", "n_pieces", "pieces_crc32", "n_bytes", "decoded_sha256"]
    whole = corpus_pipeline.run(spark, SF).toPandas()[columns].sort_values(columns, ignore_index=True)
    pd.testing.assert_frame_equal(whole, steps[-1][1].toPandas()[columns].sort_values(columns, ignore_index=True))


def test_training_order_and_copies_come_through(spark):
    """Eight partitions that stay apart: the files' order is the order of positions, and copies differ."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        mixed = stage(corpus_pipeline.mix_sources(spark, docs, SF), "test-mix")
        out = corpus_pipeline.encode(spark, mixed, SF).toPandas().sort_values("place", ignore_index=True)
        plan = mixing.plan_mix(docs, word_count(F.col("text")), whole=True)
        want = plan.select("doc_id", F.explode("_mix_copies").alias("c"), "_mix_key").select("doc_id", "c.copy", "c.position", "_mix_key").toPandas()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = want.sort_values(["position", "_mix_key", "copy"], ignore_index=True)
    assert out.place.tolist() == list(range(len(want))) and out.doc_id.tolist() == want.doc_id.tolist()
    assert len({r.file for r in mixed.select(F.col("_metadata.file_name").alias("file")).collect()}) > 3
    copies = out[(out.n_pieces > 50) & out.duplicated("doc_id", keep=False)]
    assert len(copies) > 10 and copies.groupby("doc_id").pieces_crc32.nunique().eq(copies.groupby("doc_id").size()).all()
    assert copies.groupby("doc_id").decoded_sha256.nunique().eq(1).all()
    assert all(len(r.ids) == r.n_pieces for r in out.itertuples())


ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "x y z " * 5000, "en", "a", 30000), (3, "x y z " * 5000, "en", "a", 30000), (None, "some text of its own", "en", "b", 20), (None, "other text, also its own", "en", "b", 24), (5, "é" * 400, "fr", "b", 400)]


def test_odd_documents(spark):
    """Null, empty, long, repeated and equal rows, with columns whose names stages use themselves."""
    extra = ["_score", "part", "gram", "node", "root", "place", "ids", "size", "_mix", "copy", "m1", "n_bytes", "_m1", "fp"]
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    made = docs.withColumns({c: F.lit(f"own {c}") for c in extra})
    for name, function in corpus_pipeline.STAGES[:3]:
        made = stage(function(spark, made, SF), f"odd-{name}")
        assert set(corpus_pipeline.COLUMNS) <= set(made.columns)
    left = {(r.doc_id, r.text) for r in made.collect()}
    # Rows 1 and 2 have no word and are one group; the rows of doc_id 3 are equal; later copies within 3 are cut.
    assert {d for d, _ in left} == {1, 3, None, 5} and len(left) == 5
    mixed = corpus_pipeline.mix_sources(spark, made, SF)
    out = corpus_pipeline.encode(spark, mixed, SF).toPandas()
    assert set(out.doc_id.dropna()) <= {3, 5} and 1 not in set(out.doc_id) and len(out) > 0
    assert sorted(out.place) == list(range(len(out)))
    made = docs.filter("false")
    for _, function in corpus_pipeline.STAGES:
        made = function(spark, made, SF)
    assert made.count() == 0
