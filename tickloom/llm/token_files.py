"""Token files: Parquet list columns.

Documents are range-partitioned and sorted by doc_id, encoded, and written with one list column of ids.
Ids are dictionary-encoded (a page needs 16 bits an id at most for a vocabulary of this size); doc_id,
place and length columns are delta-encoded (format version 2 without a dictionary); row groups and pages
are small and carry indexes, so that readers can fetch some documents' tokens, or the lengths alone.
Every row holds its file part and its place in that part; places in the whole corpus follow from the
parts' totals, which are read from the length column only.

Edge cases: null and empty texts give the end id alone; rows with equal doc_id are ordered by a hash of
their text; null doc_ids come first; very long texts are one row; an empty table gives empty files."""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WordMemo, Words, find_words, gather, held, raw_texts, ship, slices, stage, sums, table, tidied

END_ID = 1
#: Words that the library gets at a time.
LINE = 200
#: Words of letters alone, in lower case (a-z and those up to U+00FF).
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
ALNUM, PUNCTUATION = (np.array([chr(i) in x for i in range(256)]) for x in (string.ascii_letters + string.digits, string.punctuation))
#: Row groups of 16 MB, pages of 64 KB with indexes; ids keep a dictionary, the other columns are delta-encoded.
LAYOUT = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "compression": "zstd",
}


class LibraryEncoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.last = np.zeros(self.library.get_vocab_size(), bool)
        self.last[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True

    def work(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Words go to the library by the line, which costs it half as much as one by one. Words of letters
        alone have one token with the end-of-word mark each; of others its offsets tell which word a token is of."""
        plain = np.fromiter((LETTERS(w) is not None for w in words), bool, len(words))
        sizes, values, rows = [], [], [np.flatnonzero(plain), np.flatnonzero(~plain)]
        for which, encode_line in zip(rows, (self._letters, self._any)):
            for at in range(0, len(which), LINE):
                n, ids = encode_line([words[i] for i in which[at : at + LINE].tolist()])
                sizes.append(n)
                values.append(ids)
        sizes, values, rows = (np.concatenate(x) for x in (sizes, values, rows))
        back = np.empty(len(rows), np.int64)
        back[rows] = np.arange(len(rows))
        values, sizes = gather(np.append(0, np.cumsum(sizes)), values, back)
        return [(sizes, values)]

    def _letters(self, line: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode_batch_fast([b" ".join(line).decode()], add_special_tokens=False)
        ids = np.array(found[0].ids, np.int32)
        sizes = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        if len(sizes) != len(line):
            return self._any(line)
        return sizes, ids

    def _any(self, line: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        line = [w.decode("utf-8", "replace") for w in line]
        found = self.library.encode(" ".join(line), add_special_tokens=False)
        ends = np.cumsum(np.fromiter(map(len, line), np.int64, len(line)) + 1)
        offsets = np.fromiter(chain.from_iterable(found.offsets), np.int64)[::2]
        return np.bincount(np.searchsorted(ends, offsets, "right"), minlength=len(line)), np.array(found.ids, np.int32)


def pieces(texts: list[bytes]) -> Words:
    """Words as the memo takes them: A-Z in lower case, and the ASCII punctuation that follows a word's last
    letter or digit as a word of its own. The vocabulary's rules give the same ids for them: it lowers letters one
    by one and parts letters and digits from punctuation. Words of characters past U+00FF (letters may compose)
    or from U+0080 to U+00BF, and words with ``<|`` (special strings) stay as they are."""
    words = find_words(texts)
    flat, starts = np.frombuffer(words.data, np.uint8), words.starts
    if not len(starts):
        return words
    stops = starts + words.lengths
    odd = np.flatnonzero((flat >= 0xC4) | (flat == 0xC2) | (flat == 60) & (np.append(flat[1:], 0) == 124))
    data = words.data.lower()
    asis = np.zeros(len(starts), bool)
    if len(odd):
        asis[np.searchsorted(starts, odd, "right") - 1] = True
        turn = np.zeros(len(flat), np.int8)
        turn[starts[asis]] = 1
        turn[stops[asis]] = -1
        data = np.where(np.cumsum(turn, dtype=np.int8) > 0, flat, np.frombuffer(data, np.uint8)).tobytes()
    ending = np.flatnonzero(PUNCTUATION[flat[stops - 1]] & ~asis)
    other = np.flatnonzero(~PUNCTUATION[flat])
    last = other[np.searchsorted(other, stops[ending]) - 1]
    before = flat[last]
    letter = ALNUM[before] | (before >= 0x80) & (before < 0xC0) & (before != 0x97) & (before != 0xB7)
    ok = letter & (last >= starts[ending])
    ending, last = ending[ok], last[ok]
    times = np.ones(len(starts), np.int64)
    times[ending] = 2
    at = np.cumsum(times) - times
    starts, stops = np.repeat(starts, times), np.repeat(stops, times)
    stops[at[ending]] = last + 1
    starts[at[ending] + 1] = last + 1
    return Words(data, starts, stops - starts, sums(times, words.sizes))


def _memo(path: str) -> WordMemo:
    """One for each Python worker and vocabulary: the library encodes each of ``pieces`` once, since no token of
    this vocabulary spans white space or the end of a word's letters."""
    return held(("library", path), lambda: WordMemo(LibraryEncoder(path).work, limit=1_000_000))


def encode(texts: list[bytes], memo: WordMemo) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts with END_ID after each, and how many each text has."""
    words = pieces(texts)
    slots = memo.slots(words)
    ids, per_word = memo.tables[0].take(slots) if len(slots) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    sizes = sums(per_word, words.sizes)
    out = np.full(len(ids) + len(texts), END_ID, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), sizes)] = ids
    return out, sizes + 1


def write_tokens(docs: DataFrame, path: str, to: str | None = None) -> DataFrame:
    """Encode (doc_id, text) by the vocabulary file ``path`` and write doc_id, part, place, n_tokens, ids to the
    folder ``to`` (which must not exist), or to a staged table that goes with the driver; gives the table as read back."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, place, part = _memo(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            for rows in slices(batch):
                ids, sizes = encode(raw_texts(rows.column(1)), memo)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(sizes), part, np.int64)), pa.array(place + ends - sizes), pa.array(sizes), lists], ["doc_id", "part", "place", "n_tokens", "ids"])
                place += int(ends[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text", tie.alias("_tie")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    encoded = ordered.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, part long, place long, n_tokens long, ids array<int>")
    if to is None:
        return stage(encoded, "tokens", **LAYOUT)
    encoded.write.options(**LAYOUT).parquet(to)
    return docs.sparkSession.read.schema(encoded.schema).parquet(to)


def starts(tokens: DataFrame) -> DataFrame:
    """part -> ids of all parts before it, from the length column alone; one row for each file part."""
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    return totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).cast("long").alias("before"))


def read_tokens(tokens: DataFrame, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids); with ``doc_ids`` only pages that may hold them are read."""
    found = tokens if doc_ids is None else tokens.filter(F.col("doc_id").isin(list(doc_ids)))
    return found.join(starts(tokens), F.col("part") == F.col("_part")).select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, part, place, n_tokens, ids) -> ids replaced by their crc32 as little-endian 32-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            ids = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            at = (lists.offsets.to_numpy() * 4).tolist()
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], ["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "part", "place", "n_tokens", "ids").mapInArrow(tidied(run), f"doc_id {kind}, part long, place long, n_tokens long, ids_crc32 long")


def op10_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokens = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    found = checksums(tokens).join(starts(tokens), F.col("part") == F.col("_part"))
    return found.select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
