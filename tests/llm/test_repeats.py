import collections
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import repeats

SCHEMA = "doc_id long, text string, lang string, n_removed int, gram long"


def brute(rows, width, later=False):
    """(doc_id, text) in any order -> removed byte masks."""
    texts = [(t or "").encode() for _, t in rows]
    count, first = collections.Counter(), {}
    for d in sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0)):
        for p in range(len(texts[d]) - width + 1):
            w = texts[d][p : p + width]
            count[w] += 1
            first.setdefault(w, (d, p))
    out = []
    for d, t in enumerate(texts):
        mask = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            w = t[p : p + width]
            if count[w] > 1 and (not later or first[w] != (d, p)):
                mask[p : p + width] = True
        kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
        out.append((rows[d][0], len(t), int(mask.sum()), int((np.diff(np.append(0, mask.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def make(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def digest(spark, rows, **options):
    return sorted(map(tuple, repeats.remove_repeats(make(spark, rows), digest=True, **options).collect()), key=str)


def sample(seed, n=24):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(90)) for _ in range(3)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randint(0, 60)
            parts.insert(rng.randint(0, 3), s[a : a + rng.randint(100, 500)])
        rows.append((i, " ".join(parts)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1][:150]), (n + 2, "z" * 900), (n + 3, "ab" * 300 + "ba" * 200), (n + 4, None), (n + 5, ""), (n + 6, "q" * 199), (n + 7, "q" * 200)]
    return rows


@pytest.mark.parametrize("later", [False, True])
@pytest.mark.parametrize("group", [repeats.GROUP, 1])
def test_against_brute_force(spark, later, group, monkeypatch):
    rows = sample(group)
    plain = repeats.repeated_spans
    monkeypatch.setattr(repeats, "repeated_spans", lambda docs, width, only: plain(docs, width, only, group))
    assert digest(spark, rows, later_only=later) == brute(rows, 200, later)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "r" * 50 + "s" * 300), (1, "r" * 50 + "s" * 300), (None, "t" * 10 + "uv" * 200), (None, "w" * 10 + "uv" * 200)]
    assert digest(spark, rows) == brute(rows, 200)


def test_rows_of_one_id_whose_short_hashes_clash(spark):
    """Texts of one size and one 32-bit hash, under one id or none: what repeats in one must not go from the other."""
    rng = random.Random(11)
    words = spark.range(200_000).selectExpr("lpad(cast(id * 7919 as string), 10, 'q') AS t", "hash(concat(lpad(cast(id * 7919 as string), 10, 'q'), repeat('x', 200), repeat('y', 200))) AS h")
    one, two = words.groupBy("h").agg(F.collect_list("t").alias("t")).filter("size(t) > 1").first().t[:2]
    tail = "x" * 200 + "y" * 200
    other = "".join(rng.choices("abcdefgh", k=400))
    rows = [(None, one + tail), (None, two + tail), (3, two[4:] + tail[:300] + "end"), (1, one + tail), (1, two + tail), (None, one + other)]
    assert digest(spark, rows) == brute(rows, 200)
    lone = [(None, one + other), (None, two + tail), (4, tail + "!")]
    assert digest(spark, lone) == brute(lone, 200)


def test_wide_groups_split_by_halves(spark, monkeypatch):
    """Many surroundings of one line, and copies of some: the halves must not lose or add a window."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    line = word(60)
    rows = [(i, word(rng.randint(0, 220)) + line + word(rng.randint(0, 220))) for i in range(60)]
    rows += [(100 + i, word(30) + rows[i][1][rng.randint(0, 60) :] + word(20)) for i in range(0, 60, 4)]
    plain = repeats.repeated_spans
    for later, group in ((False, 7), (True, 2)):
        monkeypatch.setattr(repeats, "repeated_spans", lambda docs, width, only, g=group: plain(docs, width, only, g))
        assert digest(spark, rows, later_only=later) == brute(rows, 200, later)


def test_long_text_over_chunks(spark, monkeypatch):
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh") for _ in range(1000))
    long = "".join(rng.choice("abcdefgh") for _ in range(2_300_000))
    at = 1_048_576 - 300
    rows = [(1, long[:at] + shared + long[at:]), (2, "x" + shared + "y"), (3, long[-5000:-4000])]
    got = {r[0]: r for r in digest(spark, rows)}
    assert got[1][2:4] == (2000, 2) and got[2][2:4] == (1000, 1) and got[3][2] == 1000


def test_columns_and_kept_text(spark):
    shared = "".join(random.Random(4).choices("éüßabc", k=300))
    rows = [(1, "aa" + shared), (2, "bb" + shared + "cc"), (3, "tail")]
    out = repeats.remove_repeats(make(spark, rows), later_only=True)
    assert out.columns == ["doc_id", "text", "lang", "gram", "n_removed", "n_spans"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: "aa" + shared, 2: "bbcc", 3: "tail"}


def test_empty_table(spark):
    assert digest(spark, []) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=12, max_size=40), min_size=1, max_size=6), st.integers(8, 12))
def test_suffix_ranks(bodies, width):
    data = np.frombuffer(b"".join(bodies), np.uint8)
    starts = np.arange(len(data) - width + 1)
    ranks = repeats.suffix_ranks(data, starts, width) if len(starts) else np.zeros(0)
    words = [data[s : s + width].tobytes() for s in starts]
    order = {w: i for i, w in enumerate(sorted(set(words)))}
    assert ranks.tolist() == [order[w] for w in words]
    later = repeats.previous_factors(np.asarray(ranks, np.int64), starts)
    seen: set = set()
    assert (later >= 0).tolist() == [w in seen or seen.add(w) is not None for w in words]
    assert all(words[s] == words[i] and s < i for i, s in enumerate(later.tolist()) if s >= 0)
    count = collections.Counter(words)
    assert set(np.flatnonzero(later >= 0)) | set(later[later >= 0]) == {i for i, w in enumerate(words) if count[w] > 1}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    assert sorted(map(tuple, repeats.op5_repeated_passages(spark, sf).collect()), key=str) == brute(list(zip(docs.doc_id.tolist(), docs.text.tolist())), 200)


@pytest.mark.parametrize("bits", [repeats.BITS, 4])
def test_ranks_where_numbers_share_64_bits_and_where_not(bits, monkeypatch):
    """Both ways of ranking, on bodies whose places beyond their last window have no rank."""
    monkeypatch.setattr(repeats, "BITS", bits)
    rng = random.Random(7)
    bodies = [bytes(rng.choices(b"ab\x00\xff", k=rng.randint(40, 90))) for _ in range(30)]
    bodies += [b[3:43] for b in bodies[:9]]
    data = np.frombuffer(b"".join(bodies), np.uint8)
    first = np.cumsum([0, *map(len, bodies)])
    starts = np.concatenate([f + np.arange(len(b) - 39) for f, b in zip(first, bodies)])
    words = [data[s : s + 40].tobytes() for s in starts]
    order = {w: i for i, w in enumerate(sorted(set(words)))}
    assert repeats.suffix_ranks(data, starts, 40).tolist() == [order[w] for w in words]
    assert repeats.ranks_by(1 << bits, np.zeros(0, np.uint64)).tolist() == []
