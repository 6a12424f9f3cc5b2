import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickloom.llm import bpe, token_files
from tickloom.llm.common import WordMemo, find_units, find_words

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  ", "a<|endoftext|>b <|startoftext|>", "It's we'll 'S 12ab", "ΑΣ Σ ΟΔΟΣ İstanbul", "é a ́", "x y z\x1c!\x1c!", "日本語 テスト", "#!?\x00\x01 \x85 ​", "<|endoftext", "😀😀 Ä", "ﬁ Ⅷ ²³ ½ ㎏", "A" * 5000, "word " * 20000, "NUL\0 NUL NUL\0\0"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want_of(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids or range(len(texts)), texts)], "doc_id long, text string, n_tokens int, ids string")


def test_counts_equal_the_library(spark, library):
    texts = ODD + ["same row"] * 2
    got = {r.doc_id: r for r in bpe.count_tokens(frame(spark, texts), PATH, limit=100).collect()}
    want = want_of(library, texts)
    assert [got[i].n_tokens for i in range(len(texts))] == [len(w) for w in want]
    assert all(got[i].over_limit == (len(want[i]) > 100) and got[i].n_bytes == len((texts[i] or "").encode()) for i in got)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_counts(text):
    merger = bpe._memo(PATH).work.__self__
    words = text.encode("utf-8", "ignore").split()
    want = Tokenizer.from_file(PATH) if not hasattr(test_any_text_counts, "t") else test_any_text_counts.t
    test_any_text_counts.t = want
    assert sum(map(merger.count, words)) == len(want.encode(text.encode("utf-8", "ignore").decode(), add_special_tokens=False).ids)


def test_ids_in_files(spark, library):
    texts = ODD + ["same row", "same row", "b", "a"]
    ids = [*range(len(ODD)), 50, 50, 40, None]
    rows = sorted(zip([-1 if i is None else i for i in ids], ids, [w + [token_files.END_ID] for w in want_of(library, texts)]), key=lambda r: r[0])
    tokens = token_files.write_tokens(frame(spark, texts, ids), PATH)
    start, want = 0, []
    for _, i, w in rows:
        want.append((i, start, len(w), w))
        start += len(w)
    got = sorted([(r.doc_id, r.start, r.n_tokens, list(r.ids)) for r in token_files.read_tokens(tokens).collect()], key=lambda r: r[1])
    assert got == want
    crc = {(r.doc_id, r.n_tokens): r.ids_crc32 for r in token_files.checksums(tokens).collect()}
    assert all(crc[i, n] == zlib.crc32(np.array(w, "<u4").tobytes()) for i, _, n, w in want)
    some = token_files.read_tokens(tokens, [3, 50])
    assert {r.doc_id for r in some.collect()} == {3, 50} and "PushedFilters: [In(doc_id" in some._jdf.queryExecution().executedPlan().toString()


def test_layout(spark):
    import glob

    import pyarrow.parquet as pq

    tokens = token_files.write_tokens(frame(spark, [f"some words {i}" for i in range(3000)]), PATH)
    files = [pq.ParquetFile(f) for f in glob.glob(tokens._staged_at.removeprefix("file:") + "/*.parquet")]
    assert files
    for f in files:
        g = f.metadata.row_group(0)
        cols = {g.column(k).path_in_schema: g.column(k) for k in range(g.num_columns)}
        ids = next(c for n, c in cols.items() if n.startswith("ids"))
        assert any("DICTIONARY" in e for e in ids.encodings) and "DELTA_BINARY_PACKED" in cols["n_tokens"].encodings
        assert cols["n_tokens"].has_offset_index and cols["doc_id"].has_column_index


def test_empty_table(spark):
    assert bpe.count_tokens(frame(spark, []), PATH).count() == 0
    assert token_files.read_tokens(token_files.write_tokens(frame(spark, []), PATH)).count() == 0


def test_memo_stays_bounded_and_exact():
    memo = WordMemo(lambda ws: [(np.ones(len(ws), np.int64), np.array([zlib.crc32(w) for w in ws], np.int64))], limit=500)
    rng = np.random.default_rng(0)
    for _ in range(60):
        texts = [b" ".join((b"w%d" if x % 5 else b"a-long-word-of-over-16-bytes-%d") % x for x in rng.zipf(1.3, 100).clip(1, 10**6).tolist()) for _ in range(4)]
        words = find_words(texts)
        slots = memo.slots(words)
        flat = [w for t in texts for w in t.split()]
        assert memo.tables[0].values[slots].tolist() == [zlib.crc32(w) for w in flat] and words.sizes.sum() == len(flat)
        assert len(memo) <= 500 + 400


@given(st.lists(st.binary(max_size=40), max_size=6))
def test_cutting(texts):
    words, units = find_words(texts), find_units(texts)
    assert [words.word(i) for i in range(len(words.starts))] == [w for t in texts for w in t.split()] and words.sizes.tolist() == [len(t.split()) for t in texts]
    assert [units.word(i) for i in range(len(units.starts))] == [u for t in texts for u in t.split(b" ")] and units.sizes.tolist() == [len(t.split(b" ")) for t in texts]


TAILS = ["Don't. DON'T.' 's! x's' 'S, A's'B.,", "Élan, ÉLAN!! naïve... ß$$$ Àñ×, ÷. 5% 3.14, ...", "J̌, ǰ. KK. é…. İ. ª. µ, ², x , \u0085! ;;", "<|ENDOFTEXT|> <|endoftext|>. a<|endoftext|>, <|x|>! |> <", "A\x00. \x1cB, b\x7f! _x_ __", "日本。, ДА, да! ΑΣ, İI."]


def test_case_and_closing_punctuation_are_worked_on_once(library):
    made = []
    encoder = token_files.LibraryEncoder(PATH)
    memo = WordMemo(lambda ws: (made.extend(ws), encoder.work(ws))[1])
    token_files.encode([b"Word word, WORD. word!! other"], memo)
    assert sorted(made) == [b"!!", b",", b".", b"other", b"word"]
    texts = [t or "" for t in [*ODD, *TAILS]]
    ids, sizes = token_files.encode([t.encode() for t in texts], memo)
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [w + [token_files.END_ID] for w in want_of(library, texts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aAbZ'stS.,!<|>_5 éÉß×÷̌̇İK²ªµ…"), st.characters(exclude_categories=["Cs"])), max_size=12), max_size=8))
def test_any_text_has_the_library_ids(library, texts):
    memo = token_files._memo(PATH)
    ids, sizes = token_files.encode([t.encode() for t in texts], memo)
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []
    assert got == [w + [token_files.END_ID] for w in want_of(library, texts)]
