import random

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import common, simhash
from tickloom.llm.common import give_back, stage


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, radius):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if ((values[i] ^ values[j]) & (2**64 - 1)).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


def clustered(n, seed=0):
    """Chains of neighbours, dense clusters and loners, as signed longs."""
    rng, out = random.Random(seed), {0}
    while len(out) < n:
        v = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 12])):
            out.add(v)
            v ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                v ^= 1 << rng.randrange(64)
    return [x - (1 << 64) if x >> 63 else x for x in sorted(out)]


def test_components_of_links(spark):
    values = clustered(600)
    want = groups(values, 2)
    for block in (4096, 2):
        found = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 2, block)).collect()}
        label = [found.get(v, v) for v in values]
        assert pd.factorize(np.array(label))[0].tolist() == pd.factorize(np.array(want))[0].tolist()


def test_wider_radius_and_longer_keys(spark):
    values = clustered(400, 9)
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    want = pd.factorize(np.array(groups(values, 6)))[0].tolist()
    for agree in (2, 3, 4):
        found = {r.node: r.root for r in simhash.components(simhash.links(nodes, 6, agree=agree)).collect()}
        assert pd.factorize(np.array([found.get(v, v) for v in values]))[0].tolist() == want
    assert [simhash.blocks_to_agree(n, 6) for n in (10, 10**6, 10**8, 10**11)] == [2, 2, 4, 4]


def test_large_shard_route(spark):
    """All values share their upper half, so whole shard keys are hot; blocks of 8 cut them up."""
    rng = random.Random(5)
    values = sorted({rng.getrandbits(14) << 3 | rng.getrandbits(3) for _ in range(300)})
    found = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 2, 8)).collect()}
    label = [found.get(v, v) for v in values]
    assert pd.factorize(np.array(label))[0].tolist() == pd.factorize(np.array(groups(values, 2)))[0].tolist()


def test_tree_search():
    rng = random.Random(1)
    values = [rng.getrandbits(16) for _ in range(500)]
    tree = simhash.BKTree(values)
    for v in values[::7]:
        assert sorted(tree.near(v, 2)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 2]


def test_forest_has_no_cycles_and_links_all():
    values = [v & (2**64 - 1) for v in clustered(200, 3)]
    links = simhash.forest(values, values, 2)
    assert len(links) == len(values) - len(set(groups(values, 2)))


def test_path_graph(spark):
    edges = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r.root for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.filter("false")).count() == 0


def test_stars_need_no_round(spark, monkeypatch):
    """Links that are stars around their smallest nodes are told as such by one aggregation."""
    written = []
    monkeypatch.setattr(simhash, "stage", lambda df, label: written.append(label) or stage(df, label))
    stars = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") % 7 - 9).alias("b"))
    found = {r.node: r.root for r in simhash.components(stars).collect()}
    assert found == {i: i % 7 - 9 for i in range(1, 300)}
    assert written == ["cc", "cc-hub"]
    # One link between two stars: a round joins them, and the next aggregation tells that it is done.
    written.clear()
    joined = simhash.components(stars.unionByName(spark.createDataFrame([(8, 9)], "a long, b long")))
    assert {r.node: r.root for r in joined.collect()} == {i: -8 if i % 7 in (1, 2) else i % 7 - 9 for i in range(1, 300)} | {-7: -8}
    assert len(written) <= 10


def test_the_driver_gives_memory_back(spark, monkeypatch):
    assert give_back(spark).startswith("Trim native heap")
    calls = []
    monkeypatch.setattr(common, "give_back", calls.append)
    for _ in range(16):
        stage(spark.range(1), "few")
    assert len(calls) == 2


def test_texts(spark):
    base = "the quick brown fox jumps over the lazy dog again and again until night falls on the hill"
    texts = [base, base.upper(), base + "\n", None, "", " \t", "two words", "Two  Words", "x", "y" * 200_000, base * 400, "é ü ß", base, base]
    ids = [5, 3, 9, 10, 11, 12, 20, 21, 30, 31, 32, 40, 3, None]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, 2) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, fp string, root int, component_id int")
    got = simhash.near_duplicates(docs.select("doc_id", "text"), carry=("doc_id",)).collect()
    fps = [plain_fingerprint(t) for t in texts]
    want = groups(fps, 2)
    least = {g: min([i for i, w in zip(ids, want) if w == g and i is not None], default=None) for g in want}
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.fp & (2**64 - 1), r.component_id) for r in got) == sorted(((i is None, i or 0), f, least[g]) for i, f, g in zip(ids, fps, want))
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_equal_rows_are_one(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "e f g h"), (None, "e f g h")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_first(docs).collect()), key=str) == sorted([(1, "a b c d"), (None, "e f g h")], key=str)
    assert simhash.keep_first(docs.filter("false")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    fps = [plain_fingerprint(t) for t in docs.text]
    want = groups(fps, 2)
    least = pd.Series(docs.doc_id).groupby(want).min()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4_simhash_bktree(spark, sf).collect()}
    assert got == {d: (f"{f:016x}", least[g]) for d, f, g in zip(docs.doc_id, fps, want)}
