"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

A text is cut at spaces into units; a unit is its leading space (written U+2581 in pieces; the first unit
gets a dummy one) and what follows. The lattice of a unit has an edge for every vocabulary piece that
matches, and for a character that no piece covers an edge that stands for its byte pieces. The forward
pass sums the weights of all paths to each node; the backward pass draws an incoming edge at each node,
from the end, with random numbers that are a hash of the row key, the unit's place and the step, so that
the same row always gets the same segmentation. Forward passes are memoised by unit in a bounded memory;
the sampling of a batch runs over all its units at once.

The vocabulary file is of the merge type and has ranks instead of probabilities; a piece of rank r weighs
``(r + 2.7) ** -theta / log(vocabulary)``, as a Zipf law gives, and bytes weigh as the last rank does.

Decoding joins the pieces' bytes and drops the dummy space; a literal U+2581 in a text goes through its
bytes, so any text comes back byte by byte.

Edge cases: null and empty texts are the dummy space alone; runs of spaces are units of their own; null
row keys share one seed; repeated rows give repeated results; very long texts and very long units are
processed whole; an empty table gives no rows."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import Ragged, WordMemo, find_units, gather, held, mix64, raw_texts, ship, slices, sums, table, tidied

SPACE_MARK = "▁"
#: Codes from here on stand for characters without a piece.
RAW = 1 << 16
#: Sharpness of the piece weights; units whose lattices are built at a time.
THETA, UNITS = 0.5, 8192
M64 = (1 << 64) - 1


class PieceLattice:
    def __init__(self, path: str, theta: float):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.automaton = ahocorasick.Automaton()
        self.weights = np.zeros(n)
        self.byte_ids = np.zeros(256, np.int32)
        spelled: list[bytes] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            self.weights[i] = -theta * math.log(i + 2.7) - math.log(math.log(n))
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelled.append(b"")
            else:
                spelled.append(piece.replace(SPACE_MARK, " ").encode())
                if SPACE_MARK not in piece[1:]:
                    self.automaton.add_word(piece, i << 8 | len(piece))
        self.automaton.make_automaton()
        self.raw_weight = float(self.weights.min())
        self.spelling = Ragged(np.zeros(0, np.uint8))
        self.spelling.append(np.fromiter(map(len, spelled), np.int64, n), np.frombuffer(b"".join(spelled), np.uint8))
        self.raw_codes: dict[str, int] = {}
        self.raw_ids = Ragged(np.zeros(0, np.int32))
        self.memo = WordMemo(self.work, limit=150_000)

    def raw_code(self, char: str) -> int:
        code = self.raw_codes.get(char)
        if code is None:
            code = self.raw_codes[char] = RAW + len(self.raw_codes)
            ids = self.byte_ids[np.frombuffer(char.encode("utf-8", "surrogatepass"), np.uint8)]
            self.raw_ids.append(np.array([len(ids)]), ids)
        return code

    def work(self, units: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        parts = [self.forward(units[at : at + UNITS]) for at in range(0, len(units), UNITS)]
        return [tuple(np.concatenate(x) for x in zip(*same)) for same in zip(*parts)]

    def forward(self, units: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per unit: the edges into each node, then over the edges in order of nodes the running share
        of the node's weight, and code << 8 | characters."""
        texts = [SPACE_MARK + u.decode("utf-8") for u in units]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        start_of = np.cumsum(sizes) - sizes
        masked = whole
        if whole.count(SPACE_MARK) > len(texts):
            masked = "".join(SPACE_MARK + t[1:].replace(SPACE_MARK, "\0") for t in texts)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(masked)), np.int64).reshape(-1, 2)
        end, code, span = found[:, 0], found[:, 1] >> 8, found[:, 1] & 255
        covered = np.zeros(len(whole), bool)
        covered[end[span == 1]] = True
        bare = np.flatnonzero(~covered)
        weight = self.weights[code]
        if len(bare):
            raw = [whole[i] for i in bare.tolist()]
            end = np.concatenate([end, bare])
            code = np.concatenate([code, np.fromiter(map(self.raw_code, raw), np.int64, len(raw))])
            span = np.concatenate([span, np.ones(len(raw), np.int64)])
            weight = np.concatenate([weight, self.raw_weight * np.fromiter((len(c.encode("utf-8", "surrogatepass")) for c in raw), np.float64, len(raw))])
        order = np.argsort(end, kind="stable")
        end, code, span, weight = end[order], code[order], span[order], weight[order]
        local = np.arange(len(whole)) - np.repeat(start_of, sizes)
        depth = local[end]
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(int(sizes.max())))
        after = np.zeros(len(whole) + 1)  # log weight of all paths to the node after each character; the last cell is 0
        value = np.empty(len(end))
        source = np.where(span == depth + 1, len(whole), end - span)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(end)]):
            e = by_depth[a:b]
            v = value[e] = after[source[e]] + weight[e]
            node = end[e]
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            after[node[first]] = np.logaddexp.reduceat(v, first)
        share = np.exp(value - after[end])
        counts = np.bincount(end, minlength=len(whole))
        upto = np.cumsum(share)
        last = np.cumsum(counts) - 1
        base = np.repeat(np.append(0, upto[last[:-1]]), counts)
        running = upto - base
        running[last] = 1.0
        edges = sums(counts, sizes)
        return [(sizes, counts.astype(np.int32)), (edges, np.minimum(running, 1.0).astype(np.float32)), (edges, (code << 8 | span).astype(np.int32))]

    def sample(self, texts: list[bytes], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled ids of the texts, one after another, and how many each text has."""
        units = find_units(texts)
        n_units = units.sizes
        slots = self.memo.slots(units)
        nodes, shares, codes = self.memo.tables
        counts = nodes.values[: nodes.used]
        first_edge = np.cumsum(counts) - counts
        place = np.arange(len(slots)) - np.repeat(np.cumsum(n_units) - n_units, n_units)
        key = mix64(np.repeat(seeds, n_units) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        base = nodes.at[slots]
        at = nodes.at[slots + 1] - 1
        alive = np.arange(len(slots))
        picked: list[tuple[np.ndarray, np.ndarray]] = []
        n_codes = np.zeros(len(slots), np.int64)
        step = 0
        while len(alive):
            edge = first_edge[at]
            open_ = np.flatnonzero(counts[at] > 1)
            u = (mix64(key[alive[open_]] + np.uint64(step * 0xD1B54A32D192ED03 & M64)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            e = edge[open_]
            on = np.arange(len(open_))
            while len(on):  # a node has few edges, and the last one's running share is 1
                on = on[shares.values[e[on]] <= u[on]]
                e[on] += 1
            edge[open_] = e
            got = codes.values[edge]
            picked.append((alive, got >> 8))
            n_codes[alive] += 1
            at = at - (got & 255)
            on = at >= base[alive]
            alive, at, step = alive[on], at[on], step + 1
        first = np.cumsum(n_codes) - n_codes
        out = np.empty(int(n_codes.sum()), np.int64)
        for k, (unit, code) in enumerate(picked):
            out[first[unit] + n_codes[unit] - 1 - k] = code
        sizes = sums(n_codes, n_units)
        raw = np.flatnonzero(out >= RAW)
        if len(raw):
            ids, n = self.raw_ids.take(out[raw] - RAW)
            width = np.ones(len(out), np.int64)
            width[raw] = n
            sizes = sums(width, sizes)
            spread = np.repeat(out, width)
            spread[np.repeat(out >= RAW, width)] = ids
            out = spread
        return out.astype(np.int32), sizes

    def spell(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The texts that the ids decode to."""
        spelled, n = gather(self.spelling.at, self.spelling.values, ids)
        ends = np.cumsum(sums(n, sizes)).tolist()
        flat = spelled.tobytes()
        return [flat[a + 1 : b] for a, b in zip([0, *ends[:-1]], ends)]


def _lattice(path: str, theta: float = THETA) -> PieceLattice:
    """One for each Python worker, vocabulary and sharpness."""
    return held(("pieces", path, theta), lambda: PieceLattice(path, theta))


def _encoded(lattice: PieceLattice, texts: pa.Array, seeds: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return lattice.sample(raw_texts(texts), seeds.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _decoded(lattice: PieceLattice, ids: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
    """n_pieces, pieces_crc32 and the decoded texts."""
    words = memoryview(np.ascontiguousarray(ids).astype("<u4")).cast("B")
    bounds = (np.append(0, np.cumsum(sizes)) * 4).tolist()
    crc = [zlib.crc32(words[a:b]) for a, b in zip(bounds, bounds[1:])]
    return [pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(lattice.spell(ids, sizes), pa.binary()).cast(pa.string())]


def _keyed(docs: DataFrame, carry: tuple[str, ...], key: tuple[str, ...]) -> tuple[DataFrame, list[str], str]:
    """(text, seed, carried columns under names of our own), those names, and their part of the schema."""
    kept = ["doc_id", *carry]
    names = [f"c{i}" for i in range(len(kept))]
    ddl = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, kept))
    return docs.select("text", F.xxhash64(*key).alias("_seed"), *kept).toDF("text", "_seed", *names), names, ddl


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(ids))


def encode_pieces(docs: DataFrame, path: str, theta: float = THETA, carry: tuple[str, ...] = (), key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, text) -> (doc_id, carried columns, ids): one sampled segmentation, seeded by the row's ``key``."""
    ship(docs.sparkSession)
    rows, names, ddl = _keyed(docs, carry, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(path, theta)
        for batch in batches:
            for part in slices(batch, 256):
                ids, sizes = _encoded(lattice, part.column(0), part.column(1))
                yield pa.RecordBatch.from_arrays([*part.columns[2:], _lists(ids, sizes)], [*names, "ids"])

    return rows.mapInArrow(tidied(run), f"{ddl}, ids array<int>").toDF("doc_id", *carry, "ids")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, n_pieces, pieces_crc32, decoded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(path)
        for batch in batches:
            for part in slices(batch, 256):
                lists = part.column(1)
                at = lists.offsets.to_numpy().astype(np.int64)
                ids = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
                yield pa.RecordBatch.from_arrays([part.column(0), *_decoded(lattice, ids, np.diff(at))], ["doc_id", "n_pieces", "pieces_crc32", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(tidied(run), f"doc_id {kind}, n_pieces long, pieces_crc32 long, decoded string")


def round_trip(docs: DataFrame, path: str, theta: float = THETA, carry: tuple[str, ...] = (), key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, text) -> (doc_id, carried columns, ids, n_pieces, pieces_crc32, decoded): encode_pieces and
    decode_pieces in one worker (two chained functions would keep two workers a core)."""
    ship(docs.sparkSession)
    rows, names, ddl = _keyed(docs, carry, key)
    made = ["ids", "n_pieces", "pieces_crc32", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(path, theta)
        for batch in batches:
            for part in slices(batch, 256):
                ids, sizes = _encoded(lattice, part.column(0), part.column(1))
                yield pa.RecordBatch.from_arrays([*part.columns[2:], _lists(ids, sizes), *_decoded(lattice, ids, sizes)], [*names, *made])

    return rows.mapInArrow(tidied(run), f"{ddl}, ids array<int>, n_pieces long, pieces_crc32 long, decoded string").toDF("doc_id", *carry, *made)


def op6_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    back = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return back.select("doc_id", F.octet_length("decoded").cast("long").alias("n_bytes"), "n_pieces", "pieces_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))
