"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a share of the word budget by weight, never more than ``max_repeats`` times its own
size; the excess goes to the other sources by weight. A source's weight schedule says how its demand is
spread over training time: the integral of the schedule is its cumulative demand, and inverting that
integral at a document's place in its source gives the document's training position. Sorting by
position, by range, is the order of training.

Everything is DataFrame work. A source may hold a third of all rows, so running sums are taken in two
levels: sums per (source, hash bucket), then within a bucket; no task sees a whole source.

Edge cases: a null source is a source of its own, last in order; a null text has size 0; documents of
size 0 have no copies, so they are planned but not in the training order; rows of one doc_id are ordered by
size and text, rows without one by text alone, so that reruns take the same ones; repeated rows are taken on
their own; an empty table gives an empty result; columns whose names begin with ``_mix`` are the operator's
own and are dropped from its input. Targets are worked out in one task, a row a source: sources are the
thousands of collections that a mix weighs, not hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import stage, table, word_count

#: Relative demand of each weight class in equal phases of training: light sources early, heavy ones late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
WEIGHTS = (1, 2, 3)
BUCKET_DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """(_mix_source, _mix_total) -> the same plus _mix_class, _mix_target. The fair level is found by
    filling sources in order of the level at which each is full: one row per source, no loop."""
    order = Window.orderBy(F.col("_mix_source").isNull(), F.col("_mix_source"))
    cls = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("_mix_class") + 1).cast("long")
    cap = F.col("_mix_total") * max_repeats
    fill = Window.orderBy("_mix_full", F.col("_mix_source").isNull(), F.col("_mix_source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("_mix_total").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    over = F.sum("_mix_weight").over(every) - F.coalesce(F.sum("_mix_weight").over(before), F.lit(0))
    level = left.cast("double") / over.cast("double")
    return (
        sizes.withColumn("_mix_class", cls)
        .withColumn("_mix_weight", weight)
        .withColumn("_mix_full", cap.cast("double") / F.col("_mix_weight").cast("double"))
        .withColumn("_mix_rank", F.row_number().over(fill))
        .withColumn("_mix_level", level)
        .withColumn("_mix_fits", F.when(F.col("_mix_level") <= F.col("_mix_full"), F.struct("_mix_rank", "_mix_level")))
        .withColumn("_mix_level", F.min("_mix_fits").over(every)["_mix_level"])
        .withColumn("_mix_target", F.least(cap.cast("double"), F.col("_mix_weight").cast("double") * F.col("_mix_level")))
        .select("_mix_source", "_mix_total", "_mix_class", "_mix_target")
    )


def inverse_demand(x: Column, phases: Sequence[float]) -> Column:
    """Training time in [0, 1] at which a share x of a source's demand has been used: the inverse of the
    integral of a schedule that is constant within equal phases."""
    total, used, out = float(sum(phases)), 0.0, None
    for weight in phases:
        share = weight / total
        if share > 0:
            part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.lit(used)) / F.lit(share)))
        else:
            part = F.when(x > F.lit(used), 1.0).otherwise(0.0)
        out = part if out is None else out + part
        used += share
    return out / F.lit(float(len(phases)))


def plan_mix(docs: DataFrame, size: Column, weights: Sequence[int] = WEIGHTS, max_repeats: int = 3, schedules: Sequence[Sequence[float]] = SCHEDULES, whole: bool = False, tie: Column | None = None) -> DataFrame:
    """The columns of ``docs`` and: size, source_size, target, and copies, an array of
    (copy, words, position) for each time that the mix takes the document. ``tie`` orders rows of one doc_id
    (the text's hash, unless given).

    whole=False cuts a source's last document at the target, so that taken words equal the target
    rounded down; whole=True takes a document if its middle lies below the target."""
    docs = docs.select(*[c for c in docs.columns if not c.startswith("_mix")])
    tie = F.md5(F.coalesce("text", F.lit(""))) if tie is None else tie
    rows = docs.withColumns({"_mix_size": size, "_mix_tie": tie, "_mix_s": F.coalesce("source", F.lit("")), "_mix_null": F.col("source").isNull()})
    rows = rows.withColumn("_mix_key", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.col("_mix_tie"))).withColumn("_mix_bucket", F.substring("_mix_key", 1, BUCKET_DIGITS))
    part = ["_mix_s", "_mix_null", "_mix_bucket"]
    buckets = stage(rows.groupBy(F.col("source").alias("_mix_source"), *part).agg(F.sum("_mix_size").alias("_mix_words")), "mix-buckets")
    targets = source_targets(buckets.groupBy("_mix_source").agg(F.sum("_mix_words").alias("_mix_total")), weights, max_repeats)
    upto = Window.partitionBy("_mix_source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("_mix_source", *part, F.coalesce(F.sum("_mix_words").over(upto), F.lit(0)).alias("_mix_offset"))
    t = targets.withColumnRenamed("_mix_source", "_mix_t")
    offsets = offsets.join(t, F.col("_mix_source").eqNullSafe(F.col("_mix_t"))).drop("_mix_t", "_mix_source")
    # Join and window share their keys, so texts are dealt once for both.
    joined = rows.join(offsets, part)
    within = Window.partitionBy(*part).orderBy("_mix_key", "_mix_size", "_mix_tie").rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("_mix_at", F.col("_mix_offset") + F.coalesce(F.sum("_mix_size").over(within), F.lit(0)))
    goal, n = F.floor("_mix_target"), F.col("_mix_size")

    def copy(k: Column) -> Column:
        begin = F.col("_mix_at") + k * F.col("_mix_total")
        words = F.when(2 * begin + n <= 2 * goal, n).otherwise(0) if whole else F.greatest(F.lit(0), F.least(n, goal - begin))
        x = (begin.cast("double") + words.cast("double") / F.lit(2.0)) / goal.cast("double")
        position = None
        for c, phases in enumerate(schedules):
            here = (F.col("_mix_class") % len(schedules)) == c
            position = F.when(here, inverse_demand(x, phases)) if position is None else position.when(here, inverse_demand(x, phases))
        return F.struct(k.cast("int").alias("copy"), words.cast("long").alias("words"), F.when(words > 0, position).alias("position"))

    copies = F.filter(F.transform(F.array(*[F.lit(k).cast("long") for k in range(max_repeats)]), copy), lambda c: c["words"] > 0)
    return joined.select(*docs.columns, n.alias("_mix_n"), F.col("_mix_total"), F.col("_mix_target"), "_mix_key", "_mix_tie", copies.alias("_mix_copies"))


def training_order(plan: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each copy that the mix takes, range-sorted by training position; documents of size 0 have none."""
    rows = plan.select(*columns, "_mix_key", "_mix_tie", F.explode("_mix_copies").alias("_mix_copy"))
    return rows.orderBy(F.col("_mix_copy.position"), "_mix_key", "_mix_tie", F.col("_mix_copy.copy")).select(*columns)


def op1_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("_size"), F.md5(F.coalesce("text", F.lit(""))).alias("_tie")), "mix-sizes")
    plan = plan_mix(sized, F.col("_size"), tie=F.col("_tie"))
    taken = F.aggregate("_mix_copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    first = F.array_min(F.transform("_mix_copies", lambda c: c["position"]))
    out = plan.select("doc_id", F.col("_mix_n").alias("size"), F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"), taken.alias("taken"), F.size("_mix_copies").cast("long").alias("copies"), first.alias("position"), "_mix_key", "_mix_tie")
    return out.orderBy(F.col("position").asc_nulls_last(), "_mix_key", "_mix_tie").drop("_mix_key", "_mix_tie")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(md5(CAST(doc_id AS VARCHAR)), md5(coalesce(text, ''))) AS k, md5(coalesce(text, '')) AS tie,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY (source IS NULL), source) - 1) % 3 AS cls FROM s),
f AS (SELECT *, cls + 1 AS w, CAST(3 * total AS DOUBLE) / CAST(cls + 1 AS DOUBLE) AS full_at FROM r),
g AS (SELECT *, row_number() OVER o AS rk,
        CAST((SELECT sum(total) FROM s) - coalesce(sum(3 * total) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST((SELECT sum(w) FROM f) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS lvl
      FROM f WINDOW o AS (ORDER BY full_at, (source IS NULL), source)),
h AS (SELECT source, total, cls, least(CAST(3 * total AS DOUBLE), CAST(w AS DOUBLE) * (SELECT arg_min(lvl, rk) FROM g WHERE lvl <= full_at)) AS target FROM g),
p AS (SELECT d.doc_id, d.size, h.total, h.cls, h.target, CAST(floor(h.target) AS BIGINT) AS goal,
        CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size, d.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
c AS (SELECT *, greatest(0, least(size, goal - place)) AS w0, greatest(0, least(size, goal - place - total)) AS w1,
             greatest(0, least(size, goal - place - 2 * total)) AS w2 FROM p),
x AS (SELECT *, (CAST(place AS DOUBLE) + CAST(w0 AS DOUBLE) / 2.0) / CAST(goal AS DOUBLE) AS x FROM c)
SELECT doc_id, size, total AS source_size, target, CAST(w0 + w1 + w2 AS BIGINT) AS taken,
  CAST((w0 > 0)::INT + (w1 > 0)::INT + (w2 > 0)::INT AS BIGINT) AS copies,
  CASE WHEN w0 <= 0 THEN NULL
    WHEN cls = 0 THEN (greatest(0.0, least(1.0, (x - 0.0::DOUBLE) / (1.5::DOUBLE / 3))) + greatest(0.0, least(1.0, (x - 1.5::DOUBLE / 3) / (1::DOUBLE / 3)))
                   + greatest(0.0, least(1.0, (x - (1.5::DOUBLE / 3 + 1::DOUBLE / 3)) / (0.5::DOUBLE / 3)))) / 3.0
    WHEN cls = 1 THEN (greatest(0.0, least(1.0, (x - 0.0::DOUBLE) / (1::DOUBLE / 3))) + greatest(0.0, least(1.0, (x - 1::DOUBLE / 3) / (1::DOUBLE / 3)))
                   + greatest(0.0, least(1.0, (x - (1::DOUBLE / 3 + 1::DOUBLE / 3)) / (1::DOUBLE / 3)))) / 3.0
    ELSE (greatest(0.0, least(1.0, (x - 0.0::DOUBLE) / (0.5::DOUBLE / 3))) + greatest(0.0, least(1.0, (x - 0.5::DOUBLE / 3) / (1::DOUBLE / 3)))
                   + greatest(0.0, least(1.0, (x - (0.5::DOUBLE / 3 + 1::DOUBLE / 3)) / (1.5::DOUBLE / 3)))) / 3.0 END AS position
FROM x
"""
