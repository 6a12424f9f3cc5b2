"""SimHash near-duplicates with BK-trees.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values have it. Two
fingerprints link when they differ in at most ``radius`` bits; components of links are the groups.

Finding the links: equal fingerprints are one node. A fingerprint is cut into radius + 2 blocks; two
within the radius agree on two blocks at least, so each pair of blocks is a shard key, and fingerprints
that share a key meet in one shard (for more fingerprints, three or four blocks of as many more). A shard is a BK-tree: children are keyed by their integer Hamming
distance to the parent, and a query follows only edges within the radius of its own distance. The trees
are not broadcast whole, as their size follows the corpus; a shard of more than ``block`` fingerprints is
cut into trees of at most ``block``, and only such a bounded tree is copied to the query blocks of its
shard. Each tree gives a spanning forest of its links, not all pairs, so a group of a million mutual
neighbours costs a million edges. Components follow by alternating large-star and small-star steps, with
every step's edges written to the shared folder.

Edge cases: null and empty texts have no words and fingerprint zero, linked like any other; shorter
texts than a shingle are one shingle; repeated rows fall together; null doc_ids are fingerprinted and
never the smallest of a group that has another id; an empty table gives no rows; other columns are not
read by the search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import raw_texts, ship, slices, stage, table, tidied, unstage

SEED = 42
#: Most fingerprints of one tree.
BLOCK = 4096


def shingle_bounds(words: list[bytes], k: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by spaces, and where each shingle of k words starts and ends in that."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = max(1, len(words) - k + 1)
    return b" ".join(words), starts[:n].tolist(), (ends[-n:] - 1).tolist()


def fingerprint(text: bytes, k: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line, starts, ends = shingle_bounds(words, k)
    hashed, seed = xxhash.xxh64_intdigest, SEED
    h = np.fromiter([hashed(line[a:b], seed) for a, b in zip(starts, ends)], np.uint64, len(starts))
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, k: int, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(text, carried columns) -> (carried columns, fp): the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = pa.array([fingerprint(x, k) for x in raw_texts(part.column(0))], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], fp], [*carry, "fp"])

    ddl = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select("text", *carry).mapInArrow(tidied(run), f"{ddl}, fp long")


class BKTree:
    """Nodes that are unsigned integers; the children of a node are keyed by their Hamming distance to it."""

    def __init__(self, values: list[int]):
        self.values, self.children = values, [{} for _ in values]
        for i in range(1, len(values)):
            at, v = 0, values[i]
            while True:
                step = self.children[at].setdefault((values[at] ^ v).bit_count(), i)
                if step == i:
                    break
                at = step

    def near(self, v: int, radius: int) -> Iterator[int]:
        """Nodes within the radius of v."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ v).bit_count()
            if d <= radius:
                yield at
            kids = self.children[at]
            if kids:
                stack += [kids[e] for e in range(max(0, d - radius), d + radius + 1) if e in kids]


def forest(tree: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join whatever the links between queries and tree join, without cycles. When the
    queries are the tree's own values, each is searched among those before it."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    searched, out = BKTree(tree), []
    for v in queries:
        for i in searched.near(v, radius):
            w = tree[i]
            if w != v and (a := find(v)) != (b := find(w)):
                parent[max(a, b)] = min(a, b)
                out.append((v, w))
    return out


def blocks_to_agree(n: int, radius: int) -> int:
    """How many blocks make a shard key: two at least, more for more fingerprints, so that a key is shared by
    chance by a few of them only. The links found do not depend on it."""
    agree = 2
    while agree < 4 and n >> (64 * agree // (radius + agree)) > 32:
        agree += 1
    return agree


def shard_keys(fp: Column, radius: int, agree: int) -> Column:
    """One key for each choice of ``agree`` of the radius + agree blocks of a fingerprint: fingerprints
    within the radius share one of them."""
    n = radius + agree
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(n)]
    width = max(b - a for a, b in zip(cuts, cuts[1:]))

    def packed(chosen: tuple[int, ...]) -> Column:
        out = blocks[chosen[0]]
        for i in chosen[1:]:
            out = F.shiftleft(out, width).bitwiseOR(blocks[i])
        return out

    return F.array(*[F.struct(F.lit(c).cast("int").alias("pair"), packed(chosen).alias("key")) for c, chosen in enumerate(combinations(range(n), agree))])


def links(nodes: DataFrame, radius: int, block: int = BLOCK, agree: int | None = None) -> DataFrame:
    """(fp), distinct -> (a, b): spanning links of the pairs within the radius."""
    agree = agree or blocks_to_agree(nodes.count(), radius)
    keyed = nodes.select("fp", F.explode(shard_keys(F.col("fp"), radius, agree)).alias("s")).select("fp", "s.pair", "s.key")
    sizes = keyed.groupBy("pair", "key").agg(F.count("*").alias("n")).filter("n > 1")
    large = stage(sizes.filter(F.col("n") > block), "simhash-large")
    small = keyed.join(large.select("pair", "key", F.lit(True).alias("is_large")), ["pair", "key"], "left").filter("is_large IS NULL")

    def run_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard; a shard has at most ``block`` of them and may cross batches."""
        held = None

        def done(rows: tuple) -> pa.RecordBatch:
            pair, key, fp = rows[0], rows[1], rows[2].view(np.uint64)
            cut = np.flatnonzero((np.diff(pair) != 0) | (np.diff(key) != 0)) + 1
            first, last = np.append(0, cut), np.append(cut, len(fp))
            pick = np.flatnonzero(last - first > 1)
            found = []
            for a, b in zip(first[pick].tolist(), last[pick].tolist()):
                values = fp[a:b].tolist()  # unsigned: bit_count() of a negative number is that of its absolute value
                if b - a == 2:
                    if (values[0] ^ values[1]).bit_count() <= radius:
                        found.append((values[0], values[1]))
                else:
                    found += forest(values, values, radius)
            pairs = np.array(found, np.uint64).view(np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            rows = tuple(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows))
            if len(rows[0]) == 0:
                continue
            other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            tail = int(other[-1]) + 1 if len(other) else 0
            if tail:
                yield done(tuple(x[:tail] for x in rows))
            held = tuple(x[tail:] for x in rows)
        if held is not None and len(held[0]):
            yield done(held)

    sorted_small = small.select("pair", "key", "fp").repartition("pair", "key").sortWithinPartitions("pair", "key")
    found = sorted_small.mapInArrow(tidied(run_small), "a long, b long")

    # Large shards: fingerprints are dealt into blocks; every block of queries meets every later tree.
    big = keyed.join(large, ["pair", "key"]).withColumn("parts", F.ceil(F.col("n") / F.lit(block // 2)).cast("long"))
    big = big.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")))
    as_tree = big.select("pair", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mine"))).alias("q"), F.col("mine").alias("t"), "fp", F.lit(True).alias("tree"))
    as_query = big.select("pair", "key", F.col("mine").alias("q"), F.explode(F.sequence(F.col("mine"), F.col("parts") - 1)).alias("t"), "fp", F.lit(False).alias("tree"))

    def run_large(keys: tuple, rows: pa.Table) -> pa.Table:
        fp, tree = rows.column("fp").to_numpy().view(np.uint64), rows.column("tree").to_numpy()
        pairs = np.array(forest(fp[tree].tolist(), fp[~tree].tolist(), radius), np.uint64).view(np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    met = as_tree.unionByName(as_query).groupBy("pair", "key", "q", "t").applyInArrow(run_large, "a long, b long")
    return found.unionByName(met)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): root is the smallest node that links reach. Alternates large-star
    and small-star until the edges are stars around their smallest nodes; the number of rounds follows the
    logarithm of the longest path."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def star(pairs: DataFrame, least: DataFrame, keep: Column) -> DataFrame:
        """Every u's smallest neighbour, or itself, becomes the hub of those v of u that ``keep`` names."""
        return pairs.join(least, "u").filter(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))

    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "cc")
    # No star around the smallest: a node with two smaller neighbours, or with a smaller and a larger one.
    smaller, larger = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
    bent = (smaller > 1) | ((smaller == 1) & (larger > 0))
    while True:
        pairs = both(edges)
        marked = stage(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), bent.alias("bent")), "cc-hub")
        if marked.filter("bent").isEmpty():
            unstage(marked)
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        large = star(pairs, marked.select("u", "m"), F.col("v") > F.col("u")).filter("a != b").distinct()
        unstaged = [edges, marked]
        edges = stage(large, "cc-large")
        for x in unstaged:
            unstage(x)
        down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = stage(down.groupBy("u").agg(F.min("v").alias("m")), "cc-hub")
        small = star(down, least, F.lit(True)).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        unstaged = [edges, least]
        edges = stage(small.filter("a != b").distinct(), "cc-small")
        for x in unstaged:
            unstage(x)


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 2, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, text, carried columns) -> (carried columns, fp, root, component_id); root is the smallest
    fingerprint of the group."""
    ship(docs.sparkSession)
    marked = stage(fingerprints(docs, k, carry), "simhash")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    joined = stage(components(links(nodes, radius)), "simhash-roots")
    roots = stage(nodes.join(joined, nodes.fp == joined.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "simhash-groups")
    # A table of its own, so that the join can split the members of a large group over tasks.
    least = stage(roots.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-least")
    named = stage(roots.join(least, "root").select(F.col("fp").alias("_fp"), "root", "component_id"), "simhash-named")
    return marked.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def keep_first(docs: DataFrame, find: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """One row of each group (root) that ``find`` gives: the smallest doc_id's (null ids last). Rows that share
    that id are told apart by hashes of all their columns; equal rows are one."""
    docs = docs.drop("_m1", "_m2")
    keys = {"_m1": F.xxhash64(*docs.columns), "_m2": F.xxhash64(F.lit(1), *docs.columns)}
    rows = docs.withColumns(keys)
    found = find(rows, carry=("doc_id", "_m1", "_m2"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_m1", "_m2")).alias("f"))
    first = stage(first.select("f._m1", "f._m2"), "simhash-first")
    return rows.join(first, ["_m1", "_m2"]).dropDuplicates(["_m1", "_m2"]).select(*docs.columns)


def op4_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
