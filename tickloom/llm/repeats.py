"""Repeated passages by suffix order and longest previous factors.

A window is a string of ``width`` bytes. A window is repeated if it starts anywhere else, and a later
copy if it starts anywhere earlier (by doc_id, then by place). All repeated windows, or only later
copies, are removed from the texts; windows are judged on the input, never on what is left.

1. Every window picks an anchor: the place in it whose ``GRAM`` bytes have the least hash. Equal windows
   pick equal anchors, so a window can only be repeated where its anchor's bytes are. Windows next to each
   other mostly share an anchor; a run of them is one row: place, number of windows, hash of the anchor
   bytes, hash of all bytes that the run covers.
2. Anchors are counted (partial sums first, so a hot anchor is no hot task). Runs of an anchor seen once
   are done: unique. Runs of an anchor that is always covered by the same bytes are done: repeated.
3. What is left are anchors with several surroundings. One run of each different surrounding is fetched
   from its text, and runs of an anchor meet: their bytes are put one after another, suffixes are sorted
   by rank doubling up to ``width`` bytes, and in suffix order the previous and next smaller places within
   a stretch of common prefix ``width`` give each suffix an earlier match, the source of its longest
   previous factor. Suffixes with a source are later copies; with the sources, they are all that repeats.
   An anchor with over ``GROUP`` surroundings is split by what lies next to it, again and again: a window
   has the anchor in its left or in its right half, so windows of each half can only equal those that share
   the bytes on the other side. Of equal halves one goes on.
4. Spans are joined back to the texts.

Rows are told apart by doc_id, size and 128 bits of hashes of the text; equal rows are one.

Edge cases: null texts are empty; texts under ``width`` bytes have no windows; very long texts are cut
into overlapping chunks for step 1 only; rows that repeat (doc_id and text) are repeated windows of each
other, but are one document when only later copies go; null doc_ids come first; an empty table gives no
rows; ``remove_repeats`` carries columns of other names along (n_removed and n_spans are its own)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import raw_texts, ship, slices, stage, table, tidied, unstage

WIDTH, GRAM, GROUP = 200, 32, 500
#: Bytes of texts that step 1 works on at a time, and of runs that step 3 sorts at a time.
CHUNK, SORTED = 1 << 20, 1 << 18
#: Bytes that a suffix's first rank covers, and bits of a place in what is sorted at a time: 8 * FIRST + BITS and
#: 3 * BITS fit 64 bits.
FIRST, BITS = 5, 21
BASE = 0x9E3779B97F4A7C15 | 1
M64 = (1 << 64) - 1


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of substrings of one buffer: sums of byte values times powers, shifted back to place 0."""

    values = scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    up: np.ndarray = np.zeros(0, np.uint64)
    down: np.ndarray = np.zeros(0, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Rolling.up) < n:
            size = max(n, CHUNK + 4096)
            Rolling.up, Rolling.down = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)
        self.upto = np.zeros(n, np.uint64)
        np.cumsum(Rolling.values[data] * Rolling.up[: n - 1], out=self.upto[1:])

    def grams(self, k: int) -> np.ndarray:
        return (self.upto[k:] - self.upto[:-k]) * Rolling.down[: len(self.upto) - k]

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.upto[b] - self.upto[a]) * Rolling.down[a]


def window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w neighbours, from running minima within blocks of w."""
    n = len(keys) - w + 1
    padded = np.full(-(-len(keys) // w) * w, M64, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def chunks(texts: list[bytes], width: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, first byte, bytes): texts of a window at least, put together or cut (with an overlap) to CHUNK."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - width + 1), CHUNK - width):
            piece = text[at : at + CHUNK - 1]
            if size + len(piece) > CHUNK:
                yield held
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield held


def anchor_runs(pieces: list[tuple[int, int, bytes]], width: int) -> tuple[np.ndarray, ...]:
    """text, place of the first window, windows, anchor's place from there, hashes of anchor and run."""
    data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    sizes = np.array([len(p) for _, _, p in pieces], np.int64)
    first = np.cumsum(sizes) - sizes
    # A cut text's chunks overlap: a chunk answers for its first CHUNK - width windows.
    windows = np.minimum(sizes - width + 1, CHUNK - width)
    rolling = Rolling(data)
    grams = rolling.grams(GRAM)
    low = np.uint64(CHUNK - 1)
    keys = (scramble(grams) & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (window_minima(keys, width - GRAM + 1) & low).astype(np.int64)
    owner = np.repeat(np.arange(len(pieces)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + first[owner]
    mine = anchor[place]
    start = np.flatnonzero(np.append(True, (mine[1:] != mine[:-1]) | (owner[1:] != owner[:-1])))
    n = np.diff(np.append(start, len(mine)))
    at, a, who = place[start], mine[start], owner[start]
    texts, offsets = (np.array(x, np.int64) for x in (*zip(*((i, o) for i, o, _ in pieces)),))
    body = scramble(rolling.spans(at, at + n + width - 1) + ((n << 16) + (a - at)).astype(np.uint64))
    return texts[who], at - first[who] + offsets[who], n, a - at, scramble(grams[a]).view(np.int64), body.view(np.int64)


#: What tells rows apart.
KEY = ("doc_id", "m1", "m2", "n_bytes")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, text (null: empty) and the other columns of KEY."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("m1"), F.xxhash64(F.lit(1), "text").alias("m2"), F.octet_length("text").alias("n_bytes"))


def place() -> Column:
    """The order of runs: by doc_id, null first, then by text and place."""
    return F.struct(F.col("doc_id").isNotNull().alias("k"), *KEY, "at")


def runs_of(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text) -> KEY, at, windows, off, gram, body."""
    names = [*KEY, "at", "windows", "off", "gram", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2048):
                for pieces in chunks(raw_texts(part.column(1)), width):
                    who, at, n, off, gram, body = anchor_runs(pieces, width)
                    rows = pa.array(who)
                    yield pa.RecordBatch.from_arrays([*(part.column(i).take(rows) for i in (0, 2, 3, 4)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(off.astype(np.int16)), pa.array(gram), pa.array(body)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, m1 long, m2 long, n_bytes int, at int, windows short, off short, gram long, body long"
    return keyed(docs).mapInArrow(tidied(run), ddl)


def ranks_by(size: int, first: np.ndarray, *second: np.ndarray) -> np.ndarray:
    """Ranks of rows by one column, or by two of ranks below ``size``. Columns and the row's number share 64 bits
    where they fit, as numbers sort faster than their order is told."""
    if size > 1 << BITS:
        for column in second:
            first = first * np.uint64(size) + column
        return np.unique(first, return_inverse=True)[1]
    for column in (*second, np.arange(len(first), dtype=np.uint64)):
        first = first << np.uint64(BITS) | column
    first.sort()
    row = (first & np.uint64((1 << BITS) - 1)).view(np.int64)
    first >>= np.uint64(BITS)
    out = np.zeros(len(row), np.uint32)
    out[row[1:]] = np.cumsum(first[1:] != first[:-1], dtype=np.uint32)
    return out


def suffix_ranks(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Ranks, by their first ``width`` bytes, of the suffixes at ``starts``, which have that many bytes.
    Ranks of FIRST bytes are doubled until they cover the width, at the places where a suffix still has as many."""
    size, rank = len(data), np.zeros(len(data), np.uint64)
    ends = np.zeros(size, np.int64)
    ends[starts] = starts + width
    left = np.maximum.accumulate(ends) - np.arange(size)
    padded = np.concatenate([data, np.zeros(FIRST, np.uint8)])
    for j in range(FIRST):
        rank = (rank << np.uint64(8)) | padded[j : j + size]
    covered = FIRST
    rank = ranks_by(size, rank)
    while covered * 2 < width:
        at = np.flatnonzero(left >= covered * 2)
        rank[at] = ranks_by(size, rank[at].astype(np.uint64), rank[at + covered])
        covered *= 2
    return ranks_by(size, rank[starts].astype(np.uint64), rank[starts + (width - covered)]).astype(np.int64)


def previous_factors(ranks: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each suffix, one that starts at a smaller place and shares the ranked width with it (the source of
    a longest previous factor of that width or more), or -1. In suffix order a stretch of equal ranks has that
    common prefix; a source is a smaller place before the suffix in its stretch, or else one after it."""
    order = np.argsort(ranks, kind="stable")
    p, r = place[order], ranks[order]
    top = int(place.max()) + 1 if len(place) else 1
    least_first, least_last = np.minimum.accumulate(p - r * top), np.minimum.accumulate((p + r * top)[::-1])[::-1]
    before, after = least_first + r * top, least_last - r * top
    at_place = np.full(top, -1, np.int64)
    at_place[place] = np.arange(len(place))
    source = np.full(len(ranks), -1, np.int64)
    source[order] = np.where(before < p, at_place[np.minimum(before, top - 1)], np.where(after < p, at_place[np.minimum(after, top - 1)], -1))
    return source


def settle(bodies: list[bytes], windows: np.ndarray, order: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of the runs: is it repeated, is it a later copy. ``order`` ranks the runs by place."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = windows + width - 1
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(bodies)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    ranks = suffix_ranks(data, first[owner] + within, width)
    source = previous_factors(ranks, order[owner] * (int(windows.max()) + 1) + within)
    later = source >= 0
    repeated = later.copy()
    repeated[source[later]] = True
    return repeated, later


def stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


STRETCHES = "array<struct<a:int,b:int>>"
FOUND = pa.schema([("gram", pa.int64()), ("body", pa.int64()), ("found", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])


def _found(gram: list[int], body: list[int], found: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(body, pa.int64()), pa.array([[{"a": a, "b": b} for a, b in x] for x in found], FOUND.field("found").type)], schema=FOUND)


def settle_groups(parts: DataFrame, width: int, later_only: bool) -> DataFrame:
    """Runs of the same part meet, in batches of whole parts: (gram, body) -> stretches of windows."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        places = [(r[5] is not None, *r[5:]) for r in rows]
        rank = {x: i for i, x in enumerate(sorted(set(places)))}
        windows = np.array([len(r[4]) - width + 1 for r in rows], np.int64)
        repeated, later = settle([r[4] for r in rows], windows, np.array([rank[x] for x in places], np.int64), width)
        flags = np.split(later if later_only else repeated, np.cumsum(windows)[:-1])
        picked = [(r[1], r[2], [(a + r[3], b + r[3]) for a, b in s]) for r, f in zip(rows, flags, strict=True) if (s := stretches(f))]
        return _found(*map(list, zip(*picked))) if picked else _found([], [], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SORTED and row[0] != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield done(held)

    rows = parts.select("part", "gram", "body", "shift", "bytes", *KEY, "at")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(tidied(run), f"gram long, body long, found {STRETCHES}")


def halves(parts: DataFrame, width: int) -> DataFrame:
    """Each part's windows whose anchor has ``lo`` to ``hi`` bytes before it, as two parts of half that range;
    all of a part share the bytes around the anchor that all those windows have."""
    last = F.length("bytes") - F.lit(width)
    middle = F.expr("(lo + hi + 1) div 2").cast("int")
    both = F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), (middle - 1).alias("hi")))
    both = F.filter(both, lambda h: F.greatest(F.lit(0), F.col("off") - h["hi"]) <= F.least(last, F.col("off") - h["lo"]))
    rows = parts.withColumn("half", F.explode(both)).withColumns({"lo": F.col("half.lo"), "hi": F.col("half.hi")}).drop("half", "part")
    rows = rows.withColumns({"a": F.greatest(F.lit(0), F.col("off") - F.col("hi")), "b": F.least(last, F.col("off") - F.col("lo"))})
    rows = rows.withColumns({"bytes": F.substring("bytes", F.col("a") + 1, F.col("b") - F.col("a") + F.lit(width)), **{c: F.col(c) + F.col("a") for c in ("shift", "at")}, "off": F.col("off") - F.col("a")})
    shared = F.substring("bytes", F.col("off") - F.col("lo") + 1, F.lit(width) + F.col("lo") - F.col("hi"))
    return rows.withColumn("part", F.xxhash64("gram", "lo", "hi", shared)).drop("a", "b")


def settle_parts(bodies: DataFrame, width: int, later_only: bool, group: int) -> DataFrame:
    """(gram, body, off, KEY, at, bytes) -> (gram, body) and stretches of windows, one row or more a run."""
    parts = bodies.withColumns({"part": F.col("gram"), "lo": F.lit(0), "hi": F.lit(width - GRAM), "shift": F.lit(0), "off": F.col("off").cast("int")})
    out = None
    while True:
        # Tables of their own, so that joins can split the runs of a hot part.
        sizes = parts.filter("lo < hi").groupBy("part").count()
        large = stage(sizes.filter(F.col("count") > group).select(F.col("part").alias("_part")), "runs-large")
        if large.isEmpty():
            found = settle_groups(parts, width, later_only)
            return found if out is None else out.unionByName(found)
        marked = parts.join(large, F.col("part") == F.col("_part"), "left")
        found = settle_groups(marked.filter("_part IS NULL"), width, later_only)
        out = found if out is None else out.unionByName(found)
        split = stage(halves(marked.filter("_part IS NOT NULL").drop("_part"), width).withColumns({"same": F.xxhash64("bytes"), "p": place()}), "runs-halves")
        # Of the same bytes, all are repeated and all but the first are later copies; the first one goes on.
        met = split.groupBy("part", "same").agg(F.count("*").alias("n"), F.min("p").alias("least")).filter("n > 1")
        met = stage(met.select(F.col("part").alias("_part"), F.col("same").alias("_same"), "least"), "runs-same")
        split = split.join(met, (F.col("part") == F.col("_part")) & (F.col("same") == F.col("_same")), "left")
        windows = F.array(F.struct(F.col("shift").alias("a"), (F.col("shift") + F.length("bytes") - F.lit(width - 1)).alias("b")))
        copies = split.filter("p != least" if later_only else "least IS NOT NULL")
        out = out.unionByName(copies.select("gram", "body", windows.alias("found")))
        parts = stage(split.filter("least IS NULL OR p = least").drop("_part", "_same", "least", "same", "p"), "runs-firsts")


def repeated_spans(docs: DataFrame, width: int = WIDTH, later_only: bool = False, group: int = GROUP) -> DataFrame:
    """(doc_id, text) -> KEY and spans, the byte ranges to remove, for texts with any."""
    ship(docs.sparkSession)
    runs = stage(runs_of(docs, width), "runs")
    counted = runs.groupBy("gram").agg(F.count("*").alias("n"), F.min("body").alias("b0"), F.max("body").alias("b1"), *([F.min(place()).alias("least")] if later_only else []))
    again = counted.filter("n > 1").select(F.col("gram").alias("_gram"), (F.col("b0") == F.col("b1")).alias("same"), *(["least"] if later_only else []))
    # A table of its own, so that the join can split the runs of a hot anchor over tasks.
    again = stage(again, "runs-grams")
    seen = stage(runs.join(again, F.col("gram") == F.col("_gram")).drop("_gram"), "runs-again")
    unstage(runs)
    same = seen.filter("same")
    if later_only:
        same = same.filter(place() != F.col("least"))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("windows").cast("int").alias("b")))
    settled = same.select(*KEY, "at", whole.alias("found"))

    mixed = seen.filter(~F.col("same"))
    first = F.struct(F.col("doc_id").isNotNull().alias("k"), *KEY, "at", "windows", "off")
    kinds = mixed.groupBy("gram", "body").agg(F.count("*").alias("copies"), F.min(first).alias("p"))
    kinds = stage(kinds.select("gram", "body", "copies", *(F.col(f"p.{c}") for c in (*KEY, "at", "windows", "off"))), "runs-kinds")
    wanted = kinds.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "body", "at", "windows", "off")).alias("runs"))
    wanted = wanted.select(*(F.col(c).alias(f"_{c}") for c in KEY), "runs")
    fetched = keyed(docs).join(wanted, same_row()).select(*KEY, "text", F.explode("runs").alias("r"))
    body = F.substring(F.col("text").cast("binary"), F.col("r.at") + 1, F.col("r.windows") + F.lit(width - 1))
    # Rows that repeat give the same runs again; one of each stays.
    bodies = fetched.select("r.gram", "r.body", "r.at", "r.off", *KEY, body.alias("bytes")).dropDuplicates(["gram", "body"])
    found = settle_parts(stage(bodies, "runs-bodies"), width, later_only, group)
    found = stage(found.select(F.col("gram").alias("_g"), F.col("body").alias("_b"), "found"), "runs-found")
    named = kinds.select(F.col("gram").alias("_gram"), F.col("body").alias("_body"), "copies", place().alias("p"))
    told = stage(named.join(found, (F.col("_gram") == F.col("_g")) & (F.col("_body") == F.col("_b")), "left").drop("_g", "_b"), "runs-told")
    back = mixed.drop("same", "least").join(told, (F.col("gram") == F.col("_gram")) & (F.col("body") == F.col("_body")))
    full = (place() != F.col("p")) if later_only else (F.col("copies") > 1)
    mixed_found = back.select(*KEY, "at", F.when(full, whole).otherwise(F.col("found")).alias("found")).filter("found IS NOT NULL")

    span = F.transform("found", lambda s: F.struct((F.col("at") + s["a"]).alias("a"), (F.col("at") + s["b"] + F.lit(width - 1)).alias("b")))
    spans = settled.unionByName(mixed_found).select(*KEY, F.explode(span).alias("s"))
    # A set: rows that repeat give the same spans again.
    return stage(spans.groupBy(*KEY).agg(F.collect_set("s").alias("spans")), "runs-spans")


def same_row() -> Column:
    """The join of KEY with the same columns named with an underscore."""
    return F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("m1") == F.col("_m1")) & (F.col("m2") == F.col("_m2")) & (F.col("n_bytes") == F.col("_n_bytes"))


def cut(text: bytes, spans: list | None) -> tuple[bytes, int, int]:
    """What the spans leave of the text, the bytes that go, and the maximal runs that they are in."""
    if not spans:
        return text, 0, 0
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, [s["a"] for s in spans], 1)
    np.add.at(edge, [s["b"] for s in spans], -1)
    gone = np.cumsum(edge[:-1]) > 0
    n = int(np.count_nonzero(np.diff(np.append(0, gone.astype(np.int8))) == 1))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(np.count_nonzero(gone)), n


def whole_characters(kept: bytes) -> str:
    """Cut ends may split a character; its stray bytes go, as no text column can hold them."""
    return kept.decode("utf-8", "ignore")


def remove_repeats(docs: DataFrame, width: int = WIDTH, later_only: bool = False, digest: bool = False) -> DataFrame:
    """The columns of docs with the repeats cut out of text and n_removed, n_spans; with ``digest``
    (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of the exact bytes instead."""
    spans = repeated_spans(docs, width, later_only).toDF(*(f"_{c}" for c in KEY), "_spans")
    docs = docs.drop("n_removed", "n_spans")
    others = [] if digest else [c for c in docs.columns if c != "text"]
    kept = {f"_c{i}": c for i, c in enumerate(others)}
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id", *[F.col(c).alias(k) for k, c in kept.items()])
    rows = rows.withColumns({"m1": F.xxhash64("text"), "m2": F.xxhash64(F.lit(1), "text"), "n_bytes": F.octet_length("text")})
    joined = rows.join(spans, same_row(), "left").select("text", "_spans", "doc_id", *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                texts = raw_texts(part.column(0))
                done = [cut(t, s) for t, s in zip(texts, part.column(1).to_pylist(), strict=True)]
                removed, n = pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())
                if digest:
                    out = [part.column(2), pa.array(map(len, texts), pa.int64()), removed, n, pa.array([hashlib.sha256(d[0]).hexdigest() for d in done], pa.string())]
                else:
                    out = [*part.columns[3:], pa.array([whole_characters(d[0]) for d in done], pa.string()), removed, n]
                yield pa.RecordBatch.from_arrays(out, names)

    if digest:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        return joined.mapInArrow(tidied(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    names = [*kept, "text", "n_removed", "n_spans"]
    ddl = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in kept.items())
    out = joined.mapInArrow(tidied(run), f"{ddl}, text string, n_removed long, n_spans long")
    back = {c: k for k, c in kept.items()}
    return out.select(*[F.col(back.get(c, c)).alias(c) for c in docs.columns], "n_removed", "n_spans")


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)
