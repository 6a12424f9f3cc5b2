"""The corpus pipeline: toxicity, near-duplicates, repeated passages, source mixing, piece encoding.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last
return the columns of documents. Rows come out in training order: ``place`` numbers them.

Edge cases: null texts are empty; a document without a word is scored, is a near copy of any other such and
ends in the mix; null doc_ids are kept, and come last where the smallest doc_id stays; rows that are equal in
all columns are one after the second stage; an empty table gives empty results; columns beside those of
documents are carried along until the last stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import jaccard, mixing, pieces, repeats, simhash, toxicity
from tickloom.llm.common import placed, ship, stage, table, word_count

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under the cut. Scoring carries the row along, so that no join
    can lose or double one."""
    ship(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id. Texts link where they share
    0.8 or more of their five-word shingles: SimHash and BK-trees find candidates and an exact check settles
    them; pairs whose fingerprints lie too far apart come by a prefix filter, under the same check."""
    ship(spark)
    return simhash.keep_first(docs, jaccard.near_copies)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated passages are cut out of texts; a document stays unless nothing is left of
    it, and n_chars follows its text."""
    ship(spark)
    cut = repeats.remove_repeats(docs, later_only=True)
    kept = cut.filter((F.col("n_removed") == 0) | (F.length("text") > 0))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once for each time that the mix takes them; a source's documents are
    whole, so its words come within half a document of the target. Documents without a word (null, empty or blank
    text) train nothing: they have no copy and end here."""
    ship(spark)
    plan = mixing.plan_mix(docs, word_count(F.col("text")), whole=True)
    return mixing.training_order(plan, [c for c in docs.columns if not c.startswith("_mix")])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every row, and what decoding them gives back. ``place`` is the row's number in the
    training order, which the files of the stage before keep; it seeds the sampling with doc_id, so that copies
    of a document are cut in different ways."""
    import public_tokenizers

    rows = placed(docs.select("doc_id", "text"), "place")
    back = pieces.round_trip(rows, public_tokenizers.path("piece_bpe_32k.model"), carry=("place",), key=("doc_id", "place"))
    return back.select("place", "doc_id", "ids", "n_pieces", "pieces_crc32", F.octet_length("decoded").cast("long").alias("n_bytes"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeated_passages", drop_repeats),
    ("source_mix", mix_sources),
    ("pieces", encode),
]

#: Trained scores, fingerprints and sampled pieces have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
