"""Toxicity: a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed rows for the whole word and for two prefixes of it (inflected
forms of a stem share those). Filters of widths 1, 2 and 3 run over the words, each filter's maximum over
the whole text is its feature, and a logistic layer weighs the features. Training uses a bounded sample of
labelled rows (``TRAIN_PER_CLASS`` of each class, chosen by hash among rows that are not held out); a
quarter of it is kept from the gradient and sets one threshold for each language, which is told from the
text's own function words. Scores are shifted so that a language's threshold becomes ``CUT``.

The label sample and the model are the only things that the driver holds; both have fixed sizes. Texts
are scored whole, in chunks of words, with each word's filter responses memoised in a bounded memory.

Edge cases: null and empty texts are scored as no words; labels that are null are not learned from, nor are
those of a doc_id that has both (rows that say the same count once); with
no labelled rows of both classes every score is 0; repeated rows give repeated results; an empty table
gives no rows. Labels, lang, source and doc_id are no inputs of a score."""

from __future__ import annotations

import math
import string
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WordMemo, Words, find_words, give_back, held, raw_texts, ship, slices, table, tidied

WIDTHS, FILTERS, DIM, BUCKETS = (1, 2, 3), 8, 16, 1 << 18
TRAIN_PER_CLASS, EPOCHS, BATCH, CUT = 2000, 12, 32, 0.7
#: Most bytes of the labelled texts that training takes.
TRAIN_BYTES = 64 << 20
#: Texts that an embedding row needs; how much more a clean text counts than a toxic one at a threshold.
MIN_TEXTS, CLEAN_WEIGHT = 3, 4
PAD, CHUNK = 3, 1 << 16
EDGES = string.punctuation + "…»«“”„‘’¡¿"
#: Function words that tell the language of a text; words shared by two of the languages are left out.
FUNCTION_WORDS = {
    "en": "the of and to is that it for was with by this from are be at",
    "fr": "le les des du et une est qui dans pour pas avec sur par",
    "de": "der die das und ist den von zu mit für nicht ein eine im",
    "es": "el los las por con se una no del y",
}
LANGUAGES = tuple(FUNCTION_WORDS)
LANGUAGE_OF = {w: i for i, k in enumerate(LANGUAGES) for w in FUNCTION_WORDS[k].split()}
#: Column slices of the projected table: one for each width and place in the window.
COLUMNS = {(w, j): slice(at * FILTERS, (at + 1) * FILTERS) for at, (w, j) in enumerate((w, j) for w in WIDTHS for j in range(w))}
N_COLUMNS = len(COLUMNS) * FILTERS


def word_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word (row 0 is zero), and the language that it is a function word of, or -1."""
    rows, language = np.zeros((len(words), 3), np.int64), np.full(len(words), -1, np.int64)
    for i, raw in enumerate(words):
        w = raw.decode("utf-8", "replace").lower().strip(EDGES)
        if not w:
            continue
        language[i] = LANGUAGE_OF.get(w, -1)
        rows[i, 0] = zlib.crc32(w.encode()) % (BUCKETS - 1) + 1
        if len(w) >= 4:
            rows[i, 1] = zlib.crc32(b"4" + w[:4].encode()) % (BUCKETS - 1) + 1
            rows[i, 2] = zlib.crc32(b"5" + w[:5].encode()) % (BUCKETS - 1) + 1
    return rows, language


def responses(projected: np.ndarray) -> np.ndarray:
    """Filter responses of the windows that start at each row but the last PAD - 1."""
    n = len(projected) - PAD + 1
    return np.concatenate([sum(projected[j : j + n, COLUMNS[w, j]] for j in range(w)) for w in WIDTHS], 1)


@dataclass
class Model:
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    thresholds: np.ndarray  # one for each language, then one for texts without function words

    def project(self, rows: np.ndarray) -> np.ndarray:
        return self.embedding[rows].astype(np.float32).sum(1) @ self.filters

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.weights + self.offset

    def scores(self, pooled: np.ndarray, language_counts: np.ndarray) -> np.ndarray:
        language = np.where(language_counts.sum(1) > 0, language_counts.argmax(1), len(LANGUAGES))
        shifted = self.logits(pooled) - self.thresholds[language] + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


def padded(slots: np.ndarray, sizes: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of the texts with PAD blanks after each text, and where each text starts."""
    ends = np.cumsum(sizes)
    out = np.full(len(slots) + PAD * len(sizes), blank, np.int64)
    out[np.arange(len(slots)) + PAD * np.repeat(np.arange(len(sizes)), sizes)] = slots
    return out, ends - sizes + PAD * np.arange(len(sizes))


def shut(found: np.ndarray, starts: np.ndarray, first: int = 0) -> None:
    """Take out the windows that would reach from a text's blanks into the next text; ``found`` begins with
    the window at row ``first``."""
    for back in range(1, PAD):
        at = starts[1:] - back - first
        found[at[(at >= 0) & (at < len(found))]] = -np.inf


def pool(table_of: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each filter's maximum over every text, a bounded chunk of words at a time. A text's last window is
    all blanks."""
    out = np.full((len(starts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
    usable = len(ids) - PAD + 1
    for a in range(0, usable, CHUNK):
        b = min(a + CHUNK, usable)
        found = responses(table_of[ids[a : b + PAD - 1]])
        shut(found, starts, a)
        first = int(np.searchsorted(starts, a, "right")) - 1
        last = int(np.searchsorted(starts, b, "left"))
        at = np.maximum(starts[first:last] - a, 0)
        out[first:last] = np.maximum(out[first:last], np.maximum.reduceat(found, at, axis=0))
    return out


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Model | None:
    """Fit on the sample; every fourth text sets thresholds only. None without both classes."""
    if not (0 < labels.sum() < len(labels)):
        return None
    rng = np.random.default_rng(seed)
    names: dict[bytes, int] = {}
    docs = [np.array([names.setdefault(w, len(names)) for w in t.split()], np.int64) for t in texts]
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    rows, language = word_rows(list(names))
    rows, language = np.vstack([rows, np.zeros((1, 3), np.int64)]), np.append(language, -1)
    blank = len(names)
    calibrate = np.arange(len(texts)) % 4 == 3 if len(texts) >= 40 else np.zeros(len(texts), bool)
    if not (0 < labels[~calibrate].sum() < (~calibrate).sum()):
        calibrate[:] = False

    learn = np.flatnonzero(~calibrate)
    used, compact = np.unique(rows, return_inverse=True)
    rows = compact.reshape(rows.shape)
    emb = rng.normal(0, 0.05, (len(used), DIM)).astype(np.float32)
    zero = int(np.searchsorted(used, 0))
    odds, often = row_odds(rows, docs, labels, learn, len(used))
    emb[:, 0] += 0.3 * np.clip(odds, -4, 4)
    emb[~often] = 0
    often[zero] = False
    emb[zero] = 0
    grown = np.full((len(used), 1), 0.1, np.float32)
    nf = len(WIDTHS) * FILTERS
    par = {"filters": rng.normal(0, 0.3, (DIM, N_COLUMNS)), "bias": np.full(nf, 0.05), "weights": rng.normal(0, 0.3, nf), "offset": np.zeros(1)}
    par = {k: v.astype(np.float32) for k, v in par.items()}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in par.items()}
    column = np.array([[COLUMNS[w, j].start + f if j < w else -1 for j in range(PAD)] for w in WIDTHS for f in range(FILTERS)])
    step = 0
    share = labels[learn].mean()
    for _ in range(EPOCHS * max(1, 1500 // len(learn))):
        order = rng.permutation(learn)
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            ids, starts = padded(np.concatenate([docs[i] for i in pick]), sizes[pick], blank)
            x = emb[rows[ids]].sum(1)
            found = responses(x @ par["filters"])
            shut(found, starts)
            best = np.maximum.reduceat(found, starts, axis=0)
            hidden = np.maximum(best + par["bias"], 0)
            y = labels[pick]
            p = 1 / (1 + np.exp(-np.clip(hidden @ par["weights"] + par["offset"], -30, 30)))
            d = ((p - y) * np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(pick)).astype(np.float32)
            grad = {"weights": hidden.T @ d + 1e-4 * par["weights"], "offset": d.sum(keepdims=True)}
            dh = d[:, None] * par["weights"] * (hidden > 0)
            grad["bias"] = dh.sum(0)
            owner = np.repeat(np.arange(len(pick)), np.diff(np.append(starts, len(found))))
            at_row, at_filter = np.nonzero(found == best[owner])
            _, once = np.unique(owner[at_row] * nf + at_filter, return_index=True)
            at_row, at_filter = at_row[once], at_filter[once]
            g = dh[owner[at_row], at_filter]
            live = g != 0
            at_row, at_filter, g = at_row[live], at_filter[live], g[live]
            dw, touched, moved = np.zeros_like(par["filters"]), [], []
            for j in range(PAD):
                c = column[at_filter, j]
                ok = c >= 0
                i, cj, gj = at_row[ok] + j, c[ok], g[ok]
                np.add.at(dw.T, cj, gj[:, None] * x[i])
                touched.append(rows[ids[i]].ravel())
                moved.append(np.repeat(gj[:, None] * par["filters"].T[cj], 3, axis=0))
            grad["filters"] = dw + 1e-5 * par["filters"]
            touched, moved = np.concatenate(touched), np.concatenate(moved)
            touched, moved = touched[often[touched]], moved[often[touched]]
            hit, inverse = np.unique(touched, return_inverse=True)
            de = np.zeros((len(hit), DIM), np.float32)
            np.add.at(de, inverse, moved)
            de += 1e-5 * emb[hit]
            grown[hit] += (de * de).mean(1, keepdims=True) * 100
            emb[hit] -= 0.5 * de / np.sqrt(grown[hit])
            step += 1
            for k, v in par.items():
                m, s = moments[k]
                m += 0.1 * (grad[k] - m)
                s += 0.001 * (grad[k] ** 2 - s)
                v -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    full = np.zeros((BUCKETS, DIM), np.float16)
    full[used] = emb
    model = Model(full, par["filters"], par["bias"], par["weights"], float(par["offset"][0]), np.zeros(len(LANGUAGES) + 1, np.float32))
    check = np.flatnonzero(calibrate) if calibrate.any() else learn
    ids, starts = padded(np.concatenate([docs[i] for i in check]), sizes[check], blank)
    table_of = emb[rows].sum(1) @ par["filters"]
    logits = model.logits(pool(table_of, ids, starts))
    counts = np.array([np.bincount(language[docs[i]][language[docs[i]] >= 0], minlength=len(LANGUAGES)) for i in check])
    told = np.where(counts.sum(1) > 0, counts.argmax(1), len(LANGUAGES))
    base = threshold(logits, labels[check], 0.0, 0)
    model.thresholds[:] = [threshold(logits[told == k], labels[check][told == k], base, 20) for k in range(len(LANGUAGES) + 1)]
    return model


def row_odds(rows: np.ndarray, docs: list[np.ndarray], labels: np.ndarray, learn: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log odds of the classes for each embedding row, and which rows enough texts have; the
    others stay zero, as do rows that training never saw."""
    seen = np.zeros((2, n))
    for i in learn.tolist():
        seen[int(labels[i]), np.unique(rows[docs[i]])] += 1
    totals = np.array([max(1, int((labels[learn] == c).sum())) for c in (0, 1)])
    rate = (seen + 0.5) / (totals[:, None] + 1)
    return np.log(rate[1] / rate[0]), seen.sum(0) >= MIN_TEXTS


def threshold(logits: np.ndarray, labels: np.ndarray, base: float, weight: float) -> float:
    """The middle of the gap that best parts the classes, clean texts weighing more, drawn to ``base`` as if that had ``weight`` texts."""
    toxic = int(labels.sum())
    if toxic == 0 or toxic == len(labels):
        return base
    order = np.argsort(logits, kind="stable")
    v, y = logits[order], labels[order]
    clean_below = np.append(0, np.cumsum(y == 0)) / (len(y) - toxic)
    toxic_above = np.append(toxic, toxic - np.cumsum(y == 1)) / toxic
    gain = CLEAN_WEIGHT * clean_below + toxic_above
    gap = np.append(np.append(v[0] - 2, v), v[-1] + 2)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    width = gap[best + 1] - gap[best]
    k = best[int(width.argmax())]
    middle = (gap[k] + gap[k + 1]) / 2
    n = min(toxic, len(labels) - toxic)
    return float((n * middle + weight * base) / (n + weight))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> tuple[list[bytes], np.ndarray]:
    """At most ``per_class`` labelled texts of each class, by hash of doc_id, none of them held out, and of
    these as many as have TRAIN_BYTES together, which bounds what the driver gets. Texts are whole."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("_toxic")).filter(F.col("_toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("_toxic").alias("_toxic"), F.max("_toxic").alias("_most")).filter("_toxic = _most").drop("_most")
    order = F.md5(F.col("doc_id").cast("string"))
    ids = [known.filter(F.col("_toxic") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    chosen = ids[0].unionByName(ids[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "_toxic", F.coalesce("text", F.lit("")).alias("_text")).orderBy(order, "doc_id", F.md5("_text")).limit(2 * per_class)
    upto = Window.orderBy(order, "doc_id", F.md5("_text")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_bytes", F.sum(F.octet_length("_text").cast("long")).over(upto)).filter(F.col("_bytes") <= TRAIN_BYTES).collect()
    return [r["_text"].encode("utf-8") for r in rows], np.array([r["_toxic"] for r in rows], np.float32)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of docs and _score (replaced where docs has one), by text alone."""
    ship(docs.sparkSession)
    docs = docs.drop("_score")
    if model is None:
        return docs.withColumn("_score", F.lit(0.0))
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, shared)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer(raw_texts(part.column(at))), pa.float64())], names)

    names = [f"c{i}" for i in range(len(docs.columns))] + ["_score"]
    ddl = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema)) + ", _score double"
    return docs.toDF(*names[:-1]).mapInArrow(tidied(run), ddl).toDF(*docs.columns, "_score")


class Scorer:
    """Scores texts with one model; what the filters make of a word is memoised."""

    def __init__(self, model: Model, limit: int = 150_000):
        self.model, self.memo = model, WordMemo(self.work, limit)

    def work(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        rows, language = word_rows(words)
        one = np.ones(len(words), np.int64)
        return [(one, self.model.project(rows)), (one, language)]

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        words = find_words(texts)
        sizes = words.sizes
        empty = Words(words.data, np.append(words.starts, 0), np.append(words.lengths, 0), sizes)
        slots = self.memo.slots(empty)
        ids, starts = padded(slots[:-1], sizes, int(slots[-1]))
        pooled = pool(self.memo.tables[0].values, ids, starts)
        owner = np.repeat(np.arange(len(texts)), sizes)
        language = self.memo.tables[1].values[slots[:-1]]
        told = language >= 0
        counts = np.bincount(owner[told] * len(LANGUAGES) + language[told], minlength=len(texts) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))
        return self.model.scores(pooled, counts)


def _scorer(name: str, shared) -> Scorer:
    """One for each Python worker and model."""
    return held(("toxicity", name), lambda: Scorer(shared.value))


def toxicity(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """The columns of docs and _score, by a model of the labels; the labelled texts are those of
    ``learn_from``, or of docs."""
    return score(docs, train(*training_sample(docs if learn_from is None else learn_from, labels)))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score under CUT."""
    give_back(docs.sparkSession)  # training is what takes most of the driver's Python
    return toxicity(docs, labels).filter(F.col("_score") < CUT).drop("_score")


def op9_conv_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))
