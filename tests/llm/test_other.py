"""Media, quality, toxicity, pieces."""

import collections
import hashlib
import math
import pathlib
import urllib.parse
import weakref
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import common, media, pieces, quality, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "\n\n", "x" * 64, "x" * 63, "é" * 100_000, "one two three", "one two three", "a  b\tc\x00d ▁ ▁▁x 😀"]


def frame(spark, texts, **more):
    names = ["doc_id", "text", *more]
    rows = [(i, t, *more.values()) for i, t in enumerate(texts)]
    kinds = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in more.items())
    return spark.createDataFrame(rows, f"doc_id long, text string{', ' if more else ''}{kinds}").select(*names)


# --- media ---


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.binary(min_size=1, max_size=64))
def test_media_round_trip(n, seed):
    payload = (seed * 64)[:64] * n
    data = media.write_media(payload)
    found = media.probe(data)
    assert media.stored_bytes(data, found) == payload
    assert found["codec"] == "raw " and found["duration"] == found["decode_ticks"] == len(payload) and found["timescale"] == media.RATE
    assert found["sync"].tolist() == list(range(0, n, media.SYNC_EVERY))
    paths = [p for p, _, _ in media.walk(memoryview(data))]
    assert (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsz") in paths and paths[-1] == (b"mdat",)


def test_media_variable_sizes_wide_offsets_and_no_sync_table():
    import struct

    body = b"abcdefghij"
    tables = media.full_box(b"stsd", struct.pack(">I", 1), media.box(b"raw ", bytes(28))) + media.full_box(b"stts", struct.pack(">3I", 1, 3, 5)) + media.full_box(b"stsc", struct.pack(">I", 2), struct.pack(">6I", 1, 2, 1, 2, 1, 1)) + media.full_box(b"stsz", struct.pack(">2I", 0, 3), struct.pack(">3I", 2, 3, 5))
    build = lambda at: media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full_box(b"mdhd", struct.pack(">4I2H", 0, 0, 10, 15, 0, 0)), media.box(b"minf", media.box(b"stbl", tables, media.full_box(b"co64", struct.pack(">I2Q", 2, at, at + 7)))))))
    at = len(build(0)) + 8
    data = build(at) + media.box(b"mdat", body[:5] + b"--" + body[5:])
    found = media.probe(data)
    assert media.stored_bytes(data, found) == body and found["sync"].tolist() == [0, 1, 2] and found["duration"] == 15


def plain_boxes(data, path=()):
    """type path -> content, by a reader of its own."""
    out, at = {}, 0
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + size]
        out[(*path, kind)] = body
        if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
            out.update(plain_boxes(body, (*path, kind)))
        at += size
    return out


@pytest.mark.parametrize("n", [1, 5, 32, 33, 100])
def test_media_against_a_plain_reader(n):
    payload = bytes(range(256)) * 32
    payload = payload[: 64 * n] if 64 * n <= len(payload) else payload * 8
    payload = payload[: 64 * n]
    boxes = plain_boxes(data := media.write_media(payload))
    stbl = (b"moov", b"trak", b"mdia", b"minf", b"stbl")
    word = lambda kind, i: int.from_bytes(boxes[*stbl, kind][4 + 4 * i : 8 + 4 * i], "big")
    assert (word(b"stsz", 0), word(b"stsz", 1)) == (64, n) and boxes[*stbl, b"stsd"][12:16] == b"raw " and boxes[(b"mdat",)] == payload
    chunks = [word(b"stco", 1 + i) for i in range(word(b"stco", 0))]
    runs = [[word(b"stsc", 1 + 3 * r + i) for i in range(3)] for r in range(word(b"stsc", 0))]
    per = [next(r[1] for r in reversed(runs) if r[0] <= c + 1) for c in range(len(chunks))]
    samples = [(at + 64 * i, 64) for at, k in zip(chunks, per) for i in range(k)]
    found = media.probe(data)
    assert samples == list(zip(found["offsets"].tolist(), found["sizes"].tolist())) and b"".join(data[a : a + s] for a, s in samples) == payload


def nested(n):
    data = b""
    for _ in range(n):
        data = media.box(b"moov", data)
    return data


def test_hostile_media():
    good = media.write_media(bytes(range(64)) * 40)
    at = lambda kind: good.index(kind) + 4
    put = lambda where, value: good[:where] + value + good[where + len(value) :]
    bad = [
        nested(1500),
        put(at(b"stsz") + 8, b"\xff" * 4),
        put(at(b"stco") + 8, (len(good) - 100).to_bytes(4, "big")),
        put(at(b"stco") + 8, b"\0\0\0\4"),
        put(at(b"stsc") + 12, b"\xff" * 4),
        put(at(b"stts") + 8, b"\xff" * 4),
        put(at(b"stss") + 8, b"\0\0\xff\xff"),
        put(at(b"stco") + 4, b"\xff" * 4),
        good[:-1],
        b"\0\0\0\1moov",
    ]
    for data in bad:
        assert set(media._row(data)) == {"media_bytes", "media_sha256"}
    assert media._row(good)["payload_bytes"] == 2560


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 70), st.lists(st.tuples(st.integers(0, 900), st.integers(0, 255)), min_size=1, max_size=6))
def test_flipped_bytes_give_a_defined_row(n, flips):
    data = bytearray(media.write_media(bytes(64) * n))
    start = data.index(b"mdat") + 4
    data[start:] = b"P" * (len(data) - start)
    for where, value in flips:
        data[where % start] = value
    row = media._row(bytes(data))
    if "codec" in row:
        found = media.probe(bytes(data))
        assert set(media.stored_bytes(bytes(data), found)) <= {ord("P")} and row["payload_bytes"] <= 64 * n


def test_media_columns(spark):
    stored = media.to_media(frame(spark, TEXTS, media="clash"))
    got = {r.doc_id: r for r in media.probe_media(stored).collect()}
    for i, t in enumerate(TEXTS):
        payload = media.payload_of((t or "").encode())
        r = got[i]
        assert len(payload) % 64 == 0 and r.payload_bytes == len(payload) >= 64 and r.n_bytes == len((t or "").encode())
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.keyframes[0].length == 64 and len(r.keyframes) == -(-r.n_samples // 16)
    assert got[7].feature == got[8].feature and media.probe_media(stored.filter("false")).count() == 0
    broken = spark.createDataFrame([(1, 0, None), (2, 0, bytearray(b"junk")), (3, 0, bytearray(b"\0\0\0\x05free")), (4, 0, bytearray())], "doc_id long, n_bytes long, media binary")
    assert [r.codec for r in media.probe_media(broken).collect()] == [None] * 4


# --- quality ---


def plain_repeat(words):
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60))
def test_repeat_words(words):
    assert quality.repeat_words([w.encode() for w in words]) == plain_repeat(words)


def test_base_counts(spark):
    texts = [*TEXTS, "same\nsame\n\n \nsame ", "# * $ % & | < > plain", "w " * 300, "aé b\x0bc\x85d e"]
    got = {r.doc_id: r for r in quality.clean_lines(frame(spark, texts, kept="clash")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = __import__("re").findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
        repeat = plain_repeat(words)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), repeat)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(words) < 20 or 100 * repeat > 30 * len(words)) and not (r.base_failed and r.kept)
    assert quality.clean_lines(frame(spark, [])).count() == 0


def test_line_rules():
    prose = "This is a plain line of prose that says one thing, and then says another one too."
    rules = quality.Rules()
    judge = lambda text: quality.judge(text.encode(), rules)
    faults = {
        "navigation": ["home | about | contact | help", "Accueil · Produits · Contact · Aide", "Start / Über uns / Kontakt / Impressum", "Inicio › Ayuda › Contacto › Mapa", "a### b$$$ c%%% d&&&", "Read more »", "Lire la suite…", "Nächste Seite →", "PÁGINA ANTERIOR", "S’inscrire"],
        "punctuation": ["BUY NOW AND SAVE MONEY TODAY", "word " * 12, "one two " * 20],
        "boilerplate": ["All rights reserved.", "© 2020 Tous Droits RÉSERVÉS", "Alle Rechte vorbehalten.", "Todos los derechos reservados", "Siehe unsere Datenschutzerklärung.", "Consulte nuestra POLÍTICA DE PRIVACIDAD."],
        None: [prose, "Une phrase très courte.", "Er will sich morgen bei uns anmelden.", "Leer más libros es bueno.", "He said « no », and she said « yes ».", "and/or either/or", "All rights reserved. " + "more words, " * 30, "one two, " * 20, "日本語。 " + "語 と " * 25],
    }
    for want, lines in faults.items():
        for line in lines:
            assert quality.line_fault(line.encode(), line.encode().split(), rules) == want, line
    more = "Another line follows, which has different words in it; nobody would call it a menu."
    kept = judge("\n".join([prose, "All rights reserved.", more, "home | about | contact | help"]))
    assert kept[6] and kept[8] == f"{prose}\n{more}".encode()
    assert not judge("\n".join([prose] + [f"item{i} | item | item | item" for i in range(20)]))[6]


def plain_fault(line):
    """The rules once more, on characters and with loops."""
    words = __import__("re").findall(r"[^\x20\x09-\x0D]+", line)
    n, bars = len(words), line.count("|")
    for i, c in enumerate(line):
        bars += c in "·•›/" and not line[i - 1 : i].strip() and not line[i + 1 : i + 2].strip()
    caption = " ".join(line.lower().replace("’", "'").strip(" .:!…<>«»‹›←→").split())
    menu = (bars >= 3 and 5 * bars >= n) or sum(c in "#*$%&|<>" for c in line) >= max(3, 0.3 * n) or any(caption in k.split(", ") for k in quality.CAPTIONS.values())
    shout = n >= 5 and line == line.upper() and line != line.lower()
    stutter = n >= 12 and sum(a == b for a, b in zip(words, words[1:])) >= 0.6 * n
    notice = n <= 25 and any(__import__("re").search(k, line, __import__("re").I) for k in quality.NOTICES.values())
    return menu or shout or stutter or notice or (n >= 40 and not set(line) & set(".,;:!?…、。！，？"))


def test_quality_query_on_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = quality.op7_line_quality(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    verdicts = set()
    for r in got:
        text = docs[r.doc_id]
        count = lambda x: len(__import__("re").sub(r"[\x20\x09-\x0D]", "", x))
        lines = [x for x in text.split("\n") if count(x)]
        lost = sum(count(x) for x in lines if plain_fault(x))
        repeat = plain_repeat(__import__("re").findall(r"[^\x20\x09-\x0D]+", text))
        failed = r.n_words < 20 or 100 * repeat > 30 * r.n_words
        assert (r.word_chars, r.n_repeat_words, r.base_failed) == (count(text), repeat, failed)
        assert r.kept == (not failed and lost <= 0.5 * count(text)), r.doc_id
        verdicts.add((failed, r.kept))
    assert verdicts == {(True, False), (False, True), (False, False)}


# --- toxicity ---


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    words = np.array([f"word{i}" for i in range(300)] + ["the", "of", "and"])
    texts, labels = [], []
    for i in range(n):
        w = rng.choice(words, rng.integers(5, 80)).tolist()
        if i % 4 == 0:
            w.insert(int(rng.integers(len(w))), f"vilest{rng.choice(['', 'er', 'ing', 'ly'])}{rng.choice(['', '!', '.'])}")
        texts.append(" ".join(w).encode())
        labels.append(float(i % 4 == 0))
    return texts, np.array(labels, np.float32)


def test_classifier_learns_and_repeats():
    model = toxicity.train(*corpus(400))
    texts, labels = corpus(400, 1)
    score = toxicity.Scorer(model)(texts)
    assert ((score >= toxicity.CUT) == (labels == 1)).mean() > 0.97
    again = toxicity.Scorer(toxicity.train(*corpus(400)), limit=50)
    assert np.array_equal(np.concatenate([again(texts[i : i + 7]) for i in range(0, 400, 7)]) >= toxicity.CUT, score >= toxicity.CUT)


def test_scores_do_not_depend_on_batches_or_chunks(monkeypatch):
    model = toxicity.train(*corpus(100))
    texts = corpus(30, 2)[0] + [b"", b" ", b"vilest " * 3000]
    whole = toxicity.Scorer(model)(texts)
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    assert np.allclose(toxicity.Scorer(model)(texts), whole) and np.allclose(np.concatenate([toxicity.Scorer(model)([t]) for t in texts]), whole)
    rows, _ = toxicity.word_rows([b"vilest", b"xy", b"", b"..."])
    table = np.vstack([model.project(rows), np.zeros((1, toxicity.N_COLUMNS), np.float32)])
    assert toxicity.pool(table, np.array([0, 1, 4, 4, 4]), np.array([0])).shape == (1, 24)


def test_held_out_rows_are_not_learned_from(spark):
    docs = frame(spark, [f"text number {i}" for i in range(60)], lang="en")
    labels = spark.createDataFrame([(i, i % 2, None if i == 7 else i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    texts, y = toxicity.training_sample(docs, labels)
    ids = {int(t.split()[-1]) for t in texts}
    assert ids == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1 and i != 7} and len(y) == len(texts)
    assert len(toxicity.training_sample(docs, labels, per_class=5)[0]) == 10


def test_one_class_or_no_rows(spark):
    docs = frame(spark, TEXTS, _score="clash")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, labels)
    assert {r._score for r in out.collect()} == {0.0} and out.columns == ["doc_id", "text", "_score"]
    assert toxicity.toxicity(docs.filter("false"), labels.filter("false")).count() == 0


def test_held_out_accuracy(spark):
    import pandas as pd

    sf = "/root/testdata/sf0.01"
    got = toxicity.op9_conv_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all() and got.score.between(0, 1).all()
    out = got[got.held_out]
    assert ((out.predicted == 1) == (out.toxic == 1)).mean() > 0.9 and (out[out.toxic == 0].predicted == 0).mean() > 0.95


def test_thresholds():
    rng = np.random.default_rng(0)
    logits, labels = np.append(rng.normal(-3, 0.5, 50), rng.normal(3, 0.5, 50)), np.repeat([0, 1], 50)
    assert -1.5 < toxicity.threshold(logits, labels, 9.0, 0) < 1.5
    assert toxicity.threshold(logits[:50], labels[:50], 9.0, 0) == 9.0


# --- pieces ---


def test_pieces_are_lossless_and_repeat(spark):
    docs = frame(spark, TEXTS, ids="clash", decoded=3)
    encoded = pieces.encode_pieces(docs, MODEL, carry=("decoded",))
    rows = encoded.collect()
    assert [tuple(r) for r in rows] == [tuple(r) for r in encoded.collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    back = {r.doc_id: r for r in pieces.decode_pieces(encoded, MODEL).collect()}
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        assert back[r.doc_id].decoded == text and library.decode(list(r.ids)) == text
        assert back[r.doc_id].n_pieces == len(r.ids) and back[r.doc_id].pieces_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert {r.doc_id: r for r in pieces.round_trip(docs, MODEL).drop("ids").collect()} == back
    assert {r.doc_id: r.ids for r in pieces.round_trip(docs, MODEL).collect()} == {r.doc_id: r.ids for r in rows}
    assert pieces.encode_pieces(docs.filter("false"), MODEL).count() == 0 == pieces.round_trip(docs.filter("false"), MODEL).count()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=4), st.integers(0, 2**63))
def test_any_text_decodes(texts, seed):
    raw = [t.encode("utf-8", "ignore") for t in texts]
    lattice = pieces._lattice(MODEL)
    ids, sizes = lattice.sample(raw, np.arange(len(raw)).astype(np.uint64) + np.uint64(seed))
    assert lattice.spell(ids, sizes) == raw


def test_sampling_follows_path_weights():
    lattice = pieces.PieceLattice(MODEL, 0.3)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids_of = {library.id_to_piece(i): i for i in range(library.get_piece_size())}
    paths = {}

    def walk(i, path, weight):
        if i == len("▁king"):
            paths[tuple(path)] = math.exp(weight)
        for j in range(i + 1, len("▁king") + 1):
            if (k := ids_of.get("▁king"[i:j])) is not None:
                walk(j, [*path, k], weight + lattice.weights[k])

    walk(0, [], 0.0)
    n = 30_000
    ids, sizes = lattice.sample([b"king"] * n, np.arange(n).astype(np.uint64) * np.uint64(12345))
    ends = np.cumsum(sizes)
    seen = collections.Counter(tuple(ids[e - s : e].tolist()) for e, s in zip(ends, sizes))
    total = sum(paths.values())
    assert set(seen) <= set(paths) and len(paths) > 5
    for p, w in paths.items():
        assert abs(seen[p] / n - w / total) < 5 * math.sqrt(w / total / n) + 1e-3


def test_other_keys_sample_otherwise(spark):
    text = "several words that have many ways to be cut " * 200
    rows = pieces.encode_pieces(frame(spark, [text, text]), MODEL, theta=0.2).collect()
    assert rows[0].ids != rows[1].ids and len({len(r.ids) for r in rows}) >= 1


# --- what workers hold ---


class Keeping:
    """Refers to itself by way of a memo, as operators do."""

    def __init__(self):
        self.memo = common.WordMemo(self.work, 1000)

    def work(self, words):
        return []


def test_a_worker_frees_what_earlier_operators_held():
    one = weakref.ref(common.held(("one",), Keeping))
    assert common.held(("one",), Keeping) is one()
    two = weakref.ref(common.held(("two",), Keeping))
    assert one() is None and two() is not None
    uses = common.tidied(lambda batches: (common.held(("two",), Keeping) and b for b in batches))
    assert list(uses([1, 2])) == [1, 2] and two() is not None
    list(common.tidied(lambda batches: iter(batches))([1]))
    assert two() is None


def test_staged_tables_are_plain_files_whose_pages_are_verified(spark):
    staged = common.stage(spark.range(1000).coalesce(1), "plain")
    folder = pathlib.Path(urllib.parse.urlparse(staged._staged_at).path)
    (part,) = folder.glob("part-*")
    # Every file costs a process that sets its mode; one of checksums beside each would be another.
    assert not [p.name for p in folder.iterdir() if p.name.endswith(".crc")]
    assert staged.count() == 1000 and staged.agg(F.sum("id")).first()[0] == 499_500
    data = bytearray(part.read_bytes())
    data[len(data) // 2] ^= 1
    part.write_bytes(data)
    with pytest.raises(Exception, match="CRC checksum verification failed"):
        staged.agg(F.sum("id")).first()
