import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import jaccard, simhash
from tickloom.llm.common import stage


def shingle_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similar(one, two):
    return one == two or (len(one & two) > 0 and 5 * len(one & two) >= 4 * len(one | two))


def plain_groups(texts):
    """The first index of each text's group, by the similarities of all pairs that share a shingle."""
    sets, places, parent = [shingle_set(t) for t in texts], defaultdict(list), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in places[x]) if s else Counter(j for j in range(i) if not sets[j])
        for j, n in shared.items():
            if not s or 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for x in s:
            places[x].append(i)
    return [find(i) for i in range(len(texts))]


def edited(rng, n):
    """Texts and copies of them with words replaced, cut or put in, at similarities around 0.8."""
    word, out = lambda: "".join(rng.choices("abcdefghij", k=5)), []
    while len(out) < n:
        base = [word() for _ in range(rng.choice([4, 6, 30, 100, 300]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 1, 2, 8])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 35))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = [word()] * rng.choice([0, 1])
            out.append(" ".join(copy))
    return out


def kept(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs.repartition(5), "").collect()}


def test_edited_copies_go_and_others_stay(spark):
    texts = edited(random.Random(3), 400) + [None, "", " \t", "two words", "Two  Words", "x"]
    assert kept(spark, texts) == set(plain_groups(texts))


def test_documents_against_all_pairs(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").sort_values("doc_id", ignore_index=True)
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "").collect()}
    assert got == set(docs.doc_id[sorted(set(plain_groups(docs.text.tolist())))])


def test_parities_and_prefixes_lose_no_pair():
    texts = edited(random.Random(8), 300)
    rng = np.random.default_rng(1)
    for cells in (np.zeros(1 << jaccard.CELLS, np.uint8), rng.integers(0, 20, 1 << jaccard.CELLS).astype(np.uint8)):
        names = [jaccard.tokens_of(h, cells) for h in jaccard.shingle_hashes([t.encode() for t in texts], 5)]
        marks = list(zip(names, map(shingle_set, texts)))
        assert [len(h) for h, _ in marks] == [len(s) for _, s in marks]
        for i, (h, s) in enumerate(marks):
            for g, t in marks[:i]:
                if similar(s, t):
                    bits = np.frombuffer(jaccard.parities(h), np.uint8) ^ np.frombuffer(jaccard.parities(g), np.uint8)
                    assert jaccard.enough((len(h) + len(g) - int(np.bitwise_count(bits).sum())) / 2, len(h) + len(g))
                    common = np.intersect1d(h[: jaccard.prefix(len(h))], g[: jaccard.prefix(len(g))])
                    at = [int(np.searchsorted(x, common[0])) for x in (h, g)]
                    assert jaccard.possible(len(h), at[0], np.array([jaccard.parity_bits(h)]), len(g), at[1], np.array([jaccard.parity_bits(g)]))


def test_shingle_hashes_tell_shingles_apart():
    texts = ["", " ", "a", "A", "a b c d e", "A  b\tc d e", "a b c d e f", "x" * 40 + " b c d e", "x" * 41 + " b c d e", "0123456789abcdef b c d e", "0123456789abcdeg b c d e", "e d c b a", "b a", "a b", "é b c d e"]
    found = [h.tolist() for h in jaccard.shingle_hashes([t.encode() for t in texts], 5)]
    want = [shingle_set(t) for t in texts]
    assert [len(h) for h in found] == [len(w) for w in want]
    names = {}
    for h, w in zip(found, want):
        if len(w) == 1:
            assert names.setdefault(h[0], w) == w
    assert len(names) == len({frozenset(w) for w in want if len(w) == 1})
    alone = [next(jaccard.shingle_hashes([t.encode()], 5)).tolist() for t in texts]
    assert alone == found


def test_pairs_of_cells(monkeypatch):
    rng = np.random.default_rng(0)
    for turn in range(150):
        monkeypatch.setattr(jaccard, "WIDE", int(rng.integers(1, 12)))
        m = int(rng.integers(1, 80))
        token, node = np.sort(rng.integers(0, max(1, m // 10), m)), rng.permutation(m).astype(np.int64)
        root = node % int(rng.integers(1, 20)) if turn % 3 else node
        n = rng.integers(1, 40, m)
        place = rng.integers(0, 5, m) % n
        bits = rng.integers(-(2**63), 2**63, 3)[rng.integers(0, 3, m)] ^ (1 << rng.integers(0, 63, m))
        got = {x for b in jaccard.all_pairs(token, node, n << 32 | place, bits, root) for x in zip(*(c.to_pylist() for c in b.columns))}
        two = [(i, j) for i in range(m) for j in range(i) if token[i] == token[j] and root[i] != root[j]]
        assert got == {(min(node[i], node[j]), max(node[i], node[j]), n[i] + n[j]) for i, j in two if jaccard.possible(n[i], place[i], bits[i : i + 1], n[j], place[j], bits[j : j + 1])}


def test_large_group_of_neighbours(spark, monkeypatch):
    """One link a text leaves components apart, which the second step has to join."""
    monkeypatch.setattr(jaccard, "FIRST", 1)
    monkeypatch.setattr(jaccard, "NEXT", 1)
    monkeypatch.setattr(jaccard, "TURNS", 1)
    rng = random.Random(4)
    base, texts = [str(rng.random()) for _ in range(120)], []
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(120), 2):
            copy[at] = str(rng.random())
        texts.append(" ".join(copy))
    assert kept(spark, texts) == set(plain_groups(texts))


def test_texts_below_the_share_stay(spark):
    """Pairs of sf0.1 under 0.8 that differ in 5, 9 and 6 bits of three-word fingerprints."""
    ids = [2269, 2685, 2, 1700, 3, 402]
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").set_index("doc_id").text
    assert not any(similar(shingle_set(docs[a]), shingle_set(docs[b])) for a, b in zip(ids[::2], ids[1::2]))
    assert kept(spark, [docs[i] for i in ids]) == set(range(6))


def test_simhash_links_the_near_ones_by_itself(spark, monkeypatch):
    """Spanning links join what all pairs within the radius join; without the prefix filter, they alone let
    near copies go that are no exact ones, and nothing else."""
    texts = edited(random.Random(5), 300) + [None, "", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    marked = jaccard.marks(docs, 5, ("doc_id",)).filter("parities IS NOT NULL")
    sketches = stage(marked.select("node", "n", "parities").dropDuplicates(["node"]), "test-sketches")
    size = {r.node: r.n for r in sketches.collect()}
    node_of = {r.text: r.node for r in docs.select("text", F.xxhash64("text").alias("node")).collect()}
    mark = {node_of[t]: simhash.fingerprint(t.encode(), jaccard.MARKED) & (1 << 64) - 1 for t in texts if t and t.strip()}

    def near(a, b):
        return (mark[a] ^ mark[b]).bit_count() <= jaccard.RADIUS

    def groups(pairs):
        root = {x: {x} for x in mark}
        for a, b in pairs:
            if root[a] is not root[b]:
                root[a] |= root[b]
                for x in root[b]:
                    root[x] = root[a]
        return {frozenset(x) for x in root.values()}

    rows = jaccard.fingerprint_pairs(docs, sketches).collect()
    assert all(r.a < r.b and r.size == size[r.a] + size[r.b] for r in rows)
    assert groups((r.a, r.b) for r in rows) == groups((a, b) for a in mark for b in mark if a < b and near(a, b))
    monkeypatch.setattr(jaccard, "pairs_of", lambda met, pairs: spark.createDataFrame([], "a long, b long, size long"))
    gone = set(range(len(texts))) - kept(spark, texts)
    assert gone <= set(range(len(texts))) - set(plain_groups(texts))
    assert len({texts[i] for i in gone if texts[i] and texts[i] not in texts[:i]}) > 10
