"""What the operators share: reading tables, staging results, words, memoised per-word work."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import os
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space. ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Whether a finished query's shuffle files go at once; else they wait for the driver's garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where the shared folder is a local one, staged tables are written by Hadoop's plain local files: its usual ones keep
#: a file of checksums beside each, and without its native library every file costs the executor a process (chmod) that
#: shares all of its memory until it has a program of its own. The pages' checksums stand in for those of the files.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true"}
VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; one of our own only where none is configured."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
        at = sc._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation. The write's shuffle files, of no use then, go when it ends; the folder
    goes when the driver's JVM does."""
    spark = df.sparkSession
    at = f"{work_dir(spark)}/tickloom-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**PLAIN, **options).parquet(at)
    finally:
        spark.conf.set(CLEANUP, before)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    back = spark.read.schema(df.schema).options(**VERIFIED).parquet(at)
    back._staged_at = at
    if next(_writes) % 8 == 0:
        give_back(spark)
    return back


#: Counts the staged tables: the driver's memory is given back at the first of each eight.
_writes = itertools.count()


def give_back(spark: SparkSession) -> str:
    """Return to the system what the driver holds for nothing: garbage of its Python and of its JVM, and what the
    native allocator keeps for each of the JVM's hundreds of threads. The JVM's answer to the last, empty where it
    knows no such command."""
    gc.collect()
    _trim()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    with contextlib.suppress(Py4JError):
        # By reflection: the server's own class is not open to py4j, its interface is.
        named = jvm.java.lang.Class.forName
        types = gateway.new_array(jvm.java.lang.Class, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = named(kind)
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return named("javax.management.MBeanServerConnection").getMethod("invoke", types).invoke(server, args)
    return ""


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors where they would not find it by themselves."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    here = [os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")] if p]
    seen = os.path.join(os.getcwd(), "tickloom")
    if os.path.realpath(root) in here or os.path.isdir(seen) or getattr(spark.sparkContext, "_tickloom_shipped", False):
        return
    import shutil

    base = os.path.join(tempfile.mkdtemp(prefix="tickloom-"), "tickloom_pkg")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "tickloom"))
    spark.sparkContext._tickloom_shipped = True


def placed(docs: DataFrame, name: str) -> DataFrame:
    """The columns of a table read from files and ``name``: each row's number in the order of the files and of
    the rows in them, which is the order in which the table was written. Reading alone loses that order, as
    files are packed by size. A DataFrame that is no such table is written first."""
    try:
        marked = docs.select(*docs.columns, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        docs = stage(docs, "placed")
        marked = docs.select(*docs.columns, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # One row a file; files are numbered in the order of the partitions that wrote them.
    files = marked.groupBy("_file").agg(F.max("_row").alias("_last"))
    order = Window.orderBy(F.regexp_extract("_file", r"part-(\d+)", 1).cast("long"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    files = stage(files.select(F.col("_file").alias("_name"), F.coalesce(F.sum(F.col("_last") + 1).over(order), F.lit(0)).alias("_before")), "files")
    rows = marked.join(F.broadcast(files), F.col("_file") == F.col("_name"))
    return rows.select(*docs.columns, (F.col("_before") + F.col("_row")).alias(name))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def raw_texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 512):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _trim() -> None:
    """Let go of what an earlier operator holds, and give freed memory back to the system; allocators keep it
    otherwise, for as long as a worker lives."""
    if _held and not _asked:
        _let_go()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable) -> Callable:
    """The Arrow function ``run``, with freed memory returned now and then and at the end of a task."""

    def tidy_run(batches):
        _asked.clear()
        for k, out in enumerate(run(batches)):
            yield out
            if k % 8 == 7:
                _trim()
        _trim()

    return tidy_run


_held: dict = {}
#: The keys of ``held`` that the task at hand has asked for.
_asked: set = set()


def _let_go() -> None:
    """Free what is held. An operator and its memo refer to each other, so only a collection frees them."""
    _held.clear()
    gc.collect()


def held(key: tuple, make: Callable):
    """What a Python worker keeps between tasks under ``key``. Workers outlive operators, so one operator's
    keepings go when the next one comes, or when a task of an operator without any is done."""
    _asked.add(key)
    if key not in _held:
        if _held:
            _let_go()
            _trim()
        _held[key] = make()
    return _held[key]


#: Bytes of longer words that a memo holds before it forgets them.
HELD = 32 << 20
#: Longest word, in bytes, that the memo's table holds as two 64-bit numbers; longer ones go by a dict.
SHORT = 16
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: where each starts in ``data`` and how long it is; ``sizes``: words of each text."""

    data: bytes
    starts: np.ndarray
    lengths: np.ndarray
    sizes: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.lengths[i]]


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts, a space after each, and SHORT bytes more; the bytes without those; where texts end."""
    data = b" ".join([*texts, bytes(SHORT)])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return data, np.frombuffer(data, np.uint8)[: len(data) - SHORT], ends


def find_words(texts: list[bytes]) -> Words:
    """The runs between ASCII white space."""
    data, flat, ends = _joined(texts)
    blank = np.concatenate([[True], BLANK[flat]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts = edge[::2]
    return Words(data, starts, edge[1::2] - starts, np.diff(np.searchsorted(starts, ends), prepend=0))


def find_units(texts: list[bytes]) -> Words:
    """What single spaces part, empty units included."""
    data, flat, ends = _joined(texts)
    stops = np.flatnonzero(flat == 32)
    starts = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    return Words(data, starts, stops - starts, np.diff(np.searchsorted(stops, ends), prepend=0))


class WordMemo:
    """word -> slot, given on first sight; ``work(words)`` computes what each new word needs, as one or more
    tables (the values of each word one after another, and how many each word has).

    Words are looked up all at once: an open-addressing table in numpy compares the bytes themselves.
    Bounded: past ``limit`` words only those seen twice or more stay (at most half of the limit, the most
    frequent ones), and past HELD bytes of words longer than SHORT none of these stay, so the memory does not
    follow the corpus and every word stays exact."""

    def __init__(self, work: Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]], limit: int = 400_000):
        self.work, self.limit = work, limit
        self.tables: list[Ragged] = []
        self.long: dict[bytes, int] = {}
        self.n = self.held = 0
        self.keys = np.zeros((1 << 16, 3), np.uint64)
        self.seen = np.zeros(1 << 16, np.int64)
        self.table = np.full(1 << (2 * limit).bit_length(), -1, np.int32)

    def __len__(self) -> int:
        return self.n

    def slots(self, words: Words) -> np.ndarray:
        """The slots of the words; afterwards ``tables`` hold the work of every slot."""
        if self.n > self.limit or self.held > HELD:
            self._shrink()
        starts, lengths = words.starts, words.lengths
        out = np.empty(len(starts), np.int64)
        short = np.flatnonzero(lengths <= SHORT)
        at, n = starts[short], lengths[short]
        eight = np.ndarray(len(words.data) - 7, "<u8", words.data, 0, (1,))
        keys = np.stack([eight[at] & MASKS[np.minimum(n, 8)], eight[np.minimum(at + 8, len(eight) - 1)] & MASKS[np.clip(n - 8, 0, 8)], n.astype(np.uint64)], 1)
        found = self._find(keys)
        fresh: list[int] = []
        miss = np.flatnonzero(found < 0)
        if len(miss):
            k = keys[miss]
            order = np.lexsort((k[:, 0], k[:, 1], k[:, 2]))
            k = k[order]
            first = np.append(True, (k[1:] != k[:-1]).any(1))
            found[miss[order]] = self.n + np.cumsum(first) - 1
            self._add(k[first])
            fresh = short[miss[order[first]]].tolist()
        out[short] = found
        for i in np.flatnonzero(lengths > SHORT).tolist():
            word = words.word(i)
            slot = self.long.get(word)
            if slot is None:
                slot = self.long[word] = self.n
                self.held += len(word)
                self._hold(np.zeros((1, 3), np.uint64))
                fresh.append(i)
            out[i] = slot
        if fresh:
            made = self.work([words.word(i) for i in fresh])
            self.tables = self.tables or [Ragged(values) for _, values in made]
            for t, (sizes, values) in zip(self.tables, made, strict=True):
                t.append(sizes, values)
        self.seen[: self.n] += np.bincount(out, minlength=self.n)
        return out

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[:, 2] * np.uint64(0x165667B19E3779F9)
        return (mix64(mixed) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        at, left, wrap = self._hash(keys), np.arange(len(keys)), len(self.table) - 1
        while len(left):
            slot = self.table[at[left]]
            taken = slot >= 0
            left, slot = left[taken], slot[taken]
            same = (self.keys[slot] == keys[left]).all(1)
            out[left[same]] = slot[same]
            left = left[~same]
            at[left] = (at[left] + 1) & wrap
        return out

    def _hold(self, keys: np.ndarray) -> None:
        if self.n + len(keys) > len(self.keys):
            more = max(len(self.keys), len(keys))
            self.keys = np.concatenate([self.keys, np.zeros((more, 3), np.uint64)])
            self.seen = np.concatenate([self.seen, np.zeros(more, np.int64)])
        self.keys[self.n : self.n + len(keys)] = keys
        self.n += len(keys)

    def _add(self, keys: np.ndarray) -> None:
        """Place distinct new keys; slots follow in order."""
        first = self.n
        self._hold(keys)
        if self.n > len(self.table) * 0.7:
            self.table = np.full(2 * len(self.table), -1, np.int32)
            short = np.flatnonzero(self._is_short())
            self._place(self.keys[short], short)
        else:
            self._place(keys, np.arange(first, self.n))

    def _is_short(self) -> np.ndarray:
        out = np.ones(self.n, bool)
        out[list(self.long.values())] = False
        return out

    def _place(self, keys: np.ndarray, slots: np.ndarray) -> None:
        at, left, wrap = self._hash(keys), np.arange(len(keys)), len(self.table) - 1
        while len(left):
            free = left[self.table[at[left]] < 0]
            cell, pick = np.unique(at[free], return_index=True)
            self.table[cell] = slots[free[pick]]
            left = np.setdiff1d(left, free[pick], assume_unique=True)
            at[left] = (at[left] + 1) & wrap

    def _shrink(self) -> None:
        seen = self.seen[: self.n]
        if self.held > HELD:
            seen[list(self.long.values())] = 0
        keep = np.flatnonzero(seen >= 2)
        if len(keep) > self.limit // 2:
            keep = np.sort(keep[np.argsort(-seen[keep], kind="stable")[: self.limit // 2]])
        slot_of = np.full(self.n, -1, np.int64)
        slot_of[keep] = np.arange(len(keep))
        short = np.flatnonzero(self._is_short()[keep])
        kept = seen[keep] // 2
        self.keys[: len(keep)] = self.keys[keep]
        self.seen[:] = 0
        self.seen[: len(keep)] = kept
        self.n = len(keep)
        self.long = {w: int(slot_of[s]) for w, s in self.long.items() if slot_of[s] >= 0}
        self.held = sum(map(len, self.long))
        self.table[:] = -1
        self._place(self.keys[short], short)
        for t in self.tables:
            values, sizes = t.take(keep)
            t.clear()
            t.append(sizes, values)


class Ragged:
    """Rows of different lengths, one after another, in arrays that grow by doubling."""

    def __init__(self, like: np.ndarray):
        self.values = np.zeros((1 << 16, *like.shape[1:]), like.dtype)
        self.at = np.zeros(1 << 16, np.int64)
        self.clear()

    def clear(self) -> None:
        self.rows = self.used = 0

    def append(self, sizes: np.ndarray, values: np.ndarray) -> None:
        rows, used = self.rows + len(sizes), self.used + len(values)
        if rows + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(max(len(self.at), rows + 1), np.int64)])
        if used > len(self.values):
            more = max(len(self.values) // 2, used - len(self.values))
            self.values = np.concatenate([self.values, np.zeros((more, *self.values.shape[1:]), self.values.dtype)])
        self.at[self.rows + 1 : rows + 1] = self.used + np.cumsum(sizes)
        self.values[self.used : used] = values
        self.rows, self.used = rows, used

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The concatenated values of the rows, and how many each row gave."""
        return gather(self.at, self.values, rows)


def gather(at: np.ndarray, values: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated values of the slots, and how many each slot gave."""
    first, sizes = at[slots], at[slots + 1] - at[slots]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total, dtype=np.int64) + np.repeat(first - (ends - sizes), sizes)
    return values[index], sizes


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes; an empty run sums to 0."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]
