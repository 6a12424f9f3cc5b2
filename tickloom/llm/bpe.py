"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as a linked list of byte symbols; a heap holds every adjacent pair that the vocabulary
ranks. The lowest-rank pair (leftmost first) is popped and merged until none is left; a word's count is
its initial symbols minus its merges. No identifier is looked up or emitted.

Counts are memoised by word in a bounded memory, since words repeat far more than texts do: no token of
this vocabulary spans white space.

Edge cases: null and empty texts have 0 tokens; special strings inside a text count as one token each,
as the library's default has it; very long texts are cut at white space only; repeated rows give repeated
results; an empty table gives no rows."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import WordMemo, find_words, held, raw_texts, ship, slices, sums, table, tidied

#: The lower-case ASCII form of the vocabulary's split pattern (white space never matches).
ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_alphabet() -> dict[int, str]:
    """Byte -> symbol: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class HeapMerger:
    """Counts the tokens of words with the merges of a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        if model.get("type") != "BPE" or not self.suffix or not spec.get("normalizer") or "Lowercase" not in json.dumps(spec["normalizer"]):
            raise ValueError(f"{path} is no lower-casing vocabulary with word ends, which the split by words needs")
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.marks = tuple({t[:2].encode() for t in special})
        self.alphabet = {b: c for b, c in byte_alphabet().items() if b < 128}
        library = Tokenizer.from_file(path)
        self.normal, self.pre = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.known: dict[str, int] = {}

    def merged(self, symbols: str) -> int:
        """Tokens of one pre-token, given as byte symbols."""
        got = self.known.get(symbols)
        if got is None:
            if len(symbols) > 64:
                return self._merge(symbols)
            if len(self.known) >= 200_000:
                self.known.clear()
            got = self.known[symbols] = self._merge(symbols)
        return got

    def _merge(self, symbols: str) -> int:
        ranks = self.ranks
        part = list(symbols)
        part[-1] += self.suffix
        n = len(part)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, pair) for i, pair in enumerate(zip(part, part[1:])) if (r := ranks.get(pair)) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or part[i] != pair[0] or part[j] != pair[1]:
                continue
            merges += 1
            part[i], part[j] = pair[0] + pair[1], ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get(p := (part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i, p))
            h = before[i]
            if h >= 0 and (r := ranks.get(p := (part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h, p))
        return n - merges

    def _plain(self, piece: str) -> int:
        if piece.isascii():
            return sum(self.merged(p.translate(self.alphabet)) for p in ASCII_SPLIT.findall(piece.lower()))
        return sum(self.merged(p) for p, _ in self.pre(self.normal(piece)))

    def count(self, word: bytes) -> int:
        """Tokens of a text without ASCII white space."""
        text = word.decode("utf-8", "replace")
        if self.special and any(m in word for m in self.marks):
            return len(self.special.findall(text)) + sum(map(self._plain, self.special.split(text)))
        return self._plain(text)

    def work(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.ones(len(words), np.int64), np.fromiter(map(self.count, words), np.int64, len(words)))]


def _memo(path: str) -> WordMemo:
    """One for each Python worker and vocabulary."""
    return held(("heap", path), lambda: WordMemo(HeapMerger(path).work))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, n_tokens, over_limit); ``path`` names the vocabulary file, of the
    kind that lower-cases and ends words (others raise ValueError, here and not in a worker)."""
    ship(docs.sparkSession)
    HeapMerger(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(path)
        for batch in batches:
            for part in slices(batch):
                texts = raw_texts(part.column(1))
                words = find_words(texts)
                slots = memo.slots(words)
                n = sums(memo.tables[0].values[slots], words.sizes) if len(slots) else np.zeros(len(texts), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op2_heap_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
