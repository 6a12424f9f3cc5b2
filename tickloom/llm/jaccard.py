"""Near copies by the exact Jaccard similarity of word shingles.

Texts link when their sets of shingles share SHARE or more of their union; components of links are the
groups. All pairs at SHARE are found, and no other links:

1. A text's shingles are put in one global order, common ones last, then by hash. Of two texts at SHARE, the
   first ``prefix`` shingles of each hold a common one (prefix filter), so texts only meet in the cells of
   those. Which shingles are common is told from a sample; that is a matter of speed alone, as the filter
   holds in any order that all texts use.
2. A pair of a cell is a candidate if sizes and places in the prefixes allow SHARE, and if the parities of
   the texts' hash counts, which bound the difference from below, do (64 of them in the cell, then 1,024). Candidates are settled on the texts.
3. SimHash comes first: fingerprints within ``RADIUS`` bits, found by BK-trees as op4 finds them, are
   candidates, and the links that hold on the texts join components. Cells are for the pairs at SHARE whose
   fingerprints lie further apart, as only texts of different components are candidates there.
4. A group of a million mutual neighbours must not cost their pairs: BK-trees give spanning links only; in
   cells, some neighbours are settled first (each text and its next ones by hash, ``FIRST`` of them a text,
   ``TURNS`` times over), then every pair of a cell whose texts are still in different components.

Edge cases: texts without a word (null, empty, blank) are equal to each other and to nothing else; texts
shorter than a shingle are one shingle; letter case (ASCII) and white space do not count; texts and shingles
are told apart by 64-bit hashes (57 bits in the prefixes, where a clash costs a candidate more)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import simhash
from tickloom.llm.common import MASKS, SHORT, Words, find_words, mix64, raw_texts, ship, slices, stage, tidied, unstage
from tickloom.llm.simhash import SEED, components

#: Least similarity of near copies, as a fraction.
SHARE = (4, 5)
#: Words of the shingles of a fingerprint, and the most bits in which the fingerprints of candidates differ.
MARKED, RADIUS = 3, 6
#: One of SAMPLE texts is looked through for common shingles, those that OFTEN of them have; MOST bounds the list.
SAMPLE, OFTEN, MOST = 32, 3, 1 << 18
#: Shingles' hashes fall into 2 ** CELLS cells; how common a cell is decides the order of the shingles in it.
CELLS = 22
PARITIES = 1024
#: Neighbours by hash of a row of a cell, and of these the ones of a text, that are settled first.
NEXT, FIRST = 4, 16
#: Rounds of these; each knows the components that the ones before have joined.
TURNS = 2
WORDLESS = 0
#: Odd multipliers of the words of a shingle.
STEP = 0x9E3779B97F4A7C15


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of every word; words of up to SHORT bytes at once, longer ones one by one."""
    eight = np.ndarray(len(words.data) - 7, "<u8", words.data, 0, (1,))
    at, n = words.starts, words.lengths
    one = eight[np.minimum(at, len(eight) - 1)] & MASKS[np.minimum(n, 8)]
    two = eight[np.minimum(at + 8, len(eight) - 1)] & MASKS[np.clip(n - 8, 0, 8)]
    out = mix64(mix64(one + n.astype(np.uint64) * np.uint64(STEP)) + two)
    for i in np.flatnonzero(n > SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(words.word(i), SEED)
    return out


def shingle_hashes(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's shingles of k words, in order."""
    words = find_words([t.lower() for t in texts])
    hashed, powers = word_hashes(words), [np.uint64(pow(STEP, j + 1, 1 << 64)) for j in range(k)]
    rows = np.zeros(len(hashed), np.uint64)
    for j in range(min(k, len(hashed))):
        rows[: len(rows) - j] += hashed[j:] * powers[j]
    rows = mix64(rows)
    ends = np.cumsum(words.sizes)
    for a, b in zip((ends - words.sizes).tolist(), ends.tolist()):
        if b - a >= k:
            yield np.unique(rows[a : b - k + 1])
        else:  # a text shorter than a shingle is one, an empty one has none
            yield mix64(np.array([int((hashed[a:b] * powers[: b - a]).sum()) if b > a else 0], np.uint64))[: b - a]


def prefix(n: int) -> int:
    """Of n shingles, how many can miss another text's before it falls below SHARE, and one more."""
    return n + 1 + -SHARE[0] * n // SHARE[1]


def parities(tokens: np.ndarray) -> bytes:
    return np.packbits(np.bincount((tokens & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1).tobytes()


def parity_bits(tokens: np.ndarray) -> int:
    """The same over 64 counts, as a signed long that fits the rows of cells."""
    return int(np.packbits(np.bincount((tokens >> np.uint64(10) & np.uint64(63)).astype(np.int64), minlength=64).astype(np.uint8) & 1).view(np.int64)[0])


def enough(shared, both):
    """Whether ``shared`` shingles reach SHARE for two texts that have ``both`` together."""
    return sum(SHARE) * shared >= SHARE[0] * both


def common_cells(docs: DataFrame, k: int) -> np.ndarray:
    """For each cell of hashes, how common (by powers of two) its most common shingle is in the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [np.zeros(0, np.uint64), *shingle_hashes(raw_texts(part.column(0)), k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    some = docs.select("text").filter(F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(SAMPLE)) == 0).dropDuplicates(["text"])
    counted = some.mapInArrow(tidied(run), "h long").groupBy("h").count().filter(F.col("count") >= OFTEN)
    top = counted.orderBy(F.desc("count"), "h").limit(MOST).toArrow()
    cells = np.zeros(1 << CELLS, np.uint8)
    at = top.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - CELLS)
    np.maximum.at(cells, at, np.log2(np.maximum(top.column("count").to_numpy(), 1)).astype(np.uint8) + 1)
    return cells


def tokens_of(h: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Names of shingles whose order is the global one: common ones last, then by hash."""
    common = cells[h >> np.uint64(64 - CELLS)].astype(np.uint64)
    return np.sort(common << np.uint64(57) | h & np.uint64((1 << 57) - 1))


def marks(docs: DataFrame, k: int, carry: tuple[str, ...]) -> DataFrame:
    """(text, carried columns) -> (carried columns, node, n, tokens, parities, bits): the last four are null
    where the task has given the same node's lately."""
    sent = docs.sparkSession.sparkContext.broadcast(common_cells(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                texts, nodes = raw_texts(part.column(0)), part.column(1).to_pylist()
                nodes = [node if t.strip(b" \t\n\v\f\r") else WORDLESS for t, node in zip(texts, nodes)]
                fresh = []
                for i, node in enumerate(nodes):
                    if node != WORDLESS and node not in given:
                        if len(given) > 1 << 16:
                            given.clear()
                        given.add(node)
                        fresh.append(i)
                rows = [(node, None, None, None, None) for node in nodes]
                for i, h in zip(fresh, shingle_hashes([texts[i] for i in fresh], k)):
                    put = tokens_of(h, sent.value)
                    rows[i] = (nodes[i], len(put), put[: prefix(len(put))].view(np.int64), parities(put), parity_bits(put))
                made = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *made], [*carry, "node", "n", "tokens", "parities", "bits"])

    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64())
    ddl = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select("text", F.xxhash64("text"), *carry).mapInArrow(tidied(run), f"{ddl}, node long, n int, tokens array<long>, parities binary, bits long")


def by_token(rows: DataFrame, columns: tuple[str, ...], done, ddl: str) -> DataFrame:
    """``done``, a generator of record batches, over the columns of whole cells: rows meet by the first
    column, and a cell may cross batches. One sort key is all, as Spark sorts a single long fastest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            other = np.flatnonzero(now[0] != now[0][-1])
            tail = int(other[-1]) + 1 if len(other) else 0
            if tail:
                yield from done(*(x[:tail] for x in now))
            held = [x[tail:] for x in now]
        if held is not None and len(held[0]):
            yield from done(*held)

    return rows.select(*columns).repartition(columns[0]).sortWithinPartitions(columns[0]).mapInArrow(tidied(run), ddl)


def cells(marked: DataFrame) -> DataFrame:
    """(token, node, spot, bits) of the tokens that several nodes have; a spot is n << 32 | place."""

    def several(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        o = np.lexsort((columns[1], columns[0]))
        token, node, spot, bits = (x[o] for x in columns)
        new = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
        token, node, spot, bits = token[new], node[new], spot[new], bits[new]
        same = token[1:] == token[:-1]
        keep = np.append(same, False) | np.append(False, same)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, node, spot, bits)], ["token", "node", "spot", "bits"])

    rows = marked.filter("tokens IS NOT NULL").select("node", "n", "bits", F.posexplode("tokens").alias("place", "token"))
    rows = rows.withColumn("spot", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("place").cast("long")))
    return by_token(rows, ("token", "node", "spot", "bits"), several, "token long, node long, spot long, bits long")


def possible(n1, place1, bits1, n2, place2, bits2):
    """Sizes, what can follow the two places, and the parities allow SHARE. It holds at the first token that
    two share."""
    near = enough(n1 + n2 - np.bitwise_count((bits1 ^ bits2).view(np.uint64)).astype(np.int64), 2 * (n1 + n2))
    return near & (SHARE[1] * np.minimum(n1, n2) >= SHARE[0] * np.maximum(n1, n2)) & enough(np.minimum(n1 - place1, n2 - place2), n1 + n2)


#: Rows of a cell from which on it is gone through by itself.
WIDE = 256


def _pairs(met: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(met[:, i]) for i in range(3)], ["a", "b", "size"])


def _pair_rows(node1: np.ndarray, node2: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.stack([np.minimum(node1, node2), np.maximum(node1, node2), size], 1)


def neighbours(token: np.ndarray, node: np.ndarray, spot: np.ndarray, bits: np.ndarray, root: np.ndarray, turn: int = 0) -> Iterator[pa.RecordBatch]:
    """Possible pairs of each row of a cell and the NEXT ones by a hash of the turn's own."""
    n, place = spot >> 32, spot & 0xFFFFFFFF
    o, found = np.lexsort((mix64((node ^ token).view(np.uint64) + np.uint64(turn)), token)), []
    for step in range(1, NEXT + 1):
        i, j = o[:-step], o[step:]
        ok = (token[i] == token[j]) & (root[i] != root[j]) & possible(n[i], place[i], bits[i], n[j], place[j], bits[j])
        found.append(_pair_rows(node[i[ok]], node[j[ok]], (n[i] + n[j])[ok]))
    yield _pairs(np.unique(np.concatenate(found), axis=0))


def wide_cell(node: np.ndarray, n: np.ndarray, place: np.ndarray, bits: np.ndarray, root: np.ndarray) -> Iterator[np.ndarray]:
    """Possible pairs of different roots in one cell, its rows in order of n. Rows of the largest component
    meet the others', never each other; of the others, only those of about the same size meet."""
    _, which, counts = np.unique(root, return_inverse=True, return_counts=True)
    main = np.flatnonzero(which == counts.argmax())
    rest = np.flatnonzero(which != counts.argmax())
    for side, same in ((main, False), (rest, True)):
        low = np.searchsorted(n[side], -(-SHARE[0] * n[rest] // SHARE[1]))
        high = np.arange(len(rest)) if same else np.searchsorted(n[side], SHARE[1] * n[rest] // SHARE[0], "right")
        for i, a, b in zip(rest.tolist(), low.tolist(), high.tolist()):
            j = side[a:b]
            j = j[(root[j] != root[i]) & possible(n[j], place[j], bits[j], n[i], place[i], bits[i])]
            if len(j):
                yield _pair_rows(node[j], np.full(len(j), node[i]), n[j] + n[i])


def all_pairs(token: np.ndarray, node: np.ndarray, spot: np.ndarray, bits: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Possible pairs of different roots within each cell, a bounded number at a time."""
    n, place = spot >> 32, spot & 0xFFFFFFFF
    o = np.lexsort((n, token))
    token, node, n, place, bits, root = (x[o] for x in (token, node, n, place, bits, root))
    edge = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    count = np.diff(np.append(edge, len(token)))
    mixed = np.minimum.reduceat(root, edge) != np.maximum.reduceat(root, edge)

    def found() -> Iterator[np.ndarray]:
        for a, c in zip(edge[mixed & (count > WIDE)].tolist(), count[mixed & (count > WIDE)].tolist()):
            yield from wide_cell(*(x[a : a + c] for x in (node, n, place, bits, root)))
        # Small cells at once: each row and the one ``step`` rows on, while that is of the cell and not too large.
        i, step = np.flatnonzero(np.repeat(mixed & (count <= WIDE), count)), 0
        while len(i):
            step += 1
            i = i[i + step < len(token)]
            i = i[(token[i] == token[i + step]) & (SHARE[1] * n[i] >= SHARE[0] * n[i + step])]
            j = i + step
            ok = (root[i] != root[j]) & possible(n[i], place[i], bits[i], n[j], place[j], bits[j])
            if ok.any():
                yield _pair_rows(node[i[ok]], node[j[ok]], (n[i] + n[j])[ok])

    held, size = [], 0
    for part in found():
        held.append(part)
        size += len(part)
        if size > 1 << 17:
            yield _pairs(np.unique(np.concatenate(held), axis=0))
            held, size = [], 0
    if size:
        yield _pairs(np.unique(np.concatenate(held), axis=0))


def pairs_of(met: DataFrame, pairs: Callable[..., Iterator[pa.RecordBatch]]) -> DataFrame:
    """(token, node, spot, bits, root) -> (a, b, size): distinct possible pairs of different roots."""
    return by_token(met, ("token", "node", "spot", "bits", "root"), pairs, "a long, b long, size long").distinct()


def alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b): those pairs whose parities allow SHARE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (3, 4))
            apart = np.bitwise_count(left ^ right).sum(1, dtype=np.int64)
            size = batch.column(2).to_numpy()
            keep = pa.array(enough((size - apart) / 2, size))
            yield batch.select(["a", "b"]).filter(keep)

    one, two = (sketches.select(F.col("node").alias(c), F.col("parities").alias(f"p{c}")) for c in ("a", "b"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "size", "pa", "pb")
    return rows.mapInArrow(tidied(run), "a long, b long")


def fingerprint_pairs(docs: DataFrame, sketches: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, size), staged: the pairs that SimHash links. One text, the least node, stands for a fingerprint:
    BK-trees link fingerprints, and a fingerprint's other texts are paired with that one."""
    found = simhash.fingerprints(docs.select("text", F.xxhash64("text").alias("node")), MARKED, ("node",)).distinct()
    marked = stage(found.join(sketches.select("node", "n"), "node").select("fp", "node", "n"), "jaccard-marked")
    first = stage(marked.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("f")).select("fp", "f.node", "f.n"), "jaccard-first")
    one, two = (first.select(F.col("fp").alias(c), F.col("node").alias(f"node_{c}"), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
    near = simhash.links(first.select("fp"), radius).distinct().join(one, "a").join(two, "b")
    same = marked.join(one, F.col("fp") == F.col("a")).filter("node != node_a").withColumnsRenamed({"node": "node_b", "n": "n_b"})
    pairs = [x.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), (F.col("n_a") + F.col("n_b")).cast("long").alias("size")) for x in (near, same)]
    out = stage(pairs[0].unionByName(pairs[1]), "jaccard-near")
    unstage(marked)
    unstage(first)
    return out


def settled(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(a, b), staged: those pairs whose texts are at SHARE. A text is hashed once, however many pairs it is in."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [h.tobytes() for h in shingle_hashes(raw_texts(part.column(1)), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["node", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                keep = []
                for one, two in zip(part.column(2), part.column(3)):
                    x, y = sorted((np.frombuffer(c.as_buffer(), np.uint64) for c in (one, two)), key=len)
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    keep.append(enough(int(np.count_nonzero(y[at] == x)), len(x) + len(y)))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "jaccard-wanted")
    texts = docs.select(F.xxhash64("text").alias("node"), "text").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    found = stage(texts.select("node", "text").mapInArrow(tidied(hashed), "node long, hashes binary"), "jaccard-hashes")
    one, two = (found.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}")) for c in ("a", "b"))
    rows = pairs.join(two, "b").join(one, "a").select("a", "b", "ha", "hb")
    out = stage(rows.mapInArrow(tidied(run), "a long, b long"), "jaccard-links")
    unstage(wanted)
    unstage(found)
    return out


def near_copies(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), k: int = 5) -> DataFrame:
    """(text, carried columns) -> (carried columns, node, root); root is the smallest node of the group."""
    ship(docs.sparkSession)
    marked = stage(marks(docs, k, carry), "jaccard")
    sketches = stage(marked.filter("parities IS NOT NULL").select("node", "n", "parities").dropDuplicates(["node"]), "jaccard-sketches")
    met = stage(cells(marked), "jaccard-cells")
    members = stage(marked.select(*carry, "node"), "jaccard-members")
    unstage(marked)
    near = fingerprint_pairs(docs, sketches)
    some = stage(alike(near, sketches), "jaccard-some")
    unstage(near)
    roots = roots_of(settled(docs, some, k))
    unstage(some)
    for turn in range(TURNS):
        some = alike(pairs_of(rooted(met, roots), partial(neighbours, turn=turn)), sketches)
        by_hash = Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b")
        some = stage(some.withColumn("_turn", F.row_number().over(by_hash)).filter(F.col("_turn") <= FIRST).select("a", "b"), "jaccard-some")
        roots = roots_of(settled(docs, some, k), roots)
        unstage(some)
    rest = stage(alike(pairs_of(rooted(met, roots), all_pairs), sketches), "jaccard-rest")
    unstage(met)
    unstage(sketches)
    roots = roots_of(settled(docs, rest, k), roots)
    unstage(rest)
    return rooted(members, roots).select(*carry, "node", "root")


def roots_of(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(a, b), staged: linked nodes that are not their group's smallest, and that one. The roots ``before`` stand
    for all links that led to them, and go then."""
    found = links if before is None else links.unionByName(before)
    roots = stage(components(found).select(F.col("node").alias("a"), F.col("root").alias("b")), "jaccard-roots")
    unstage(links)
    if before is not None:
        unstage(before)
    return roots


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows and root, the smallest node that links reach from theirs."""
    roots = roots.select(F.col("a").alias("_node"), F.col("b").alias("_root"))
    return rows.join(roots, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("_root", "node")).drop("_node", "_root")
