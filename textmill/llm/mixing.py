"""Mixing sources to target weights by capped water-filling; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import fresh, stage
from textmill.llm.stream_dedup import placed

WORD = r"[^\x20\x09-\x0D]+"
#: Share of a source's documents, by the first digits of their seeded hash, that are summed together.
BUCKET_DIGITS = 3


def source_targets(totals: DataFrame, epochs: float = 3.0) -> DataFrame:
    """totals(source, source_size) with target: all sizes shared by weight, none above epochs * source_size.

    Weights are 1, 2, 3, repeating, over the sources by code point, null last. The level of the
    water has a closed form: with sources ordered by cap / weight, the first k stand at their caps
    for the smallest k at which the level of the others is no higher than the next ratio.
    """
    ranked = totals.withColumn("weight", (1 + (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    free = F.col("level") <= F.col("cap") / F.col("weight")
    ranked = ranked.withColumn("water", F.max(F.when(free, F.col("level"))).over(every))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("water")))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def mix_sources(docs: DataFrame, epochs: float = 3.0, seed: int = 17, place: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, repeats, key) for every row of docs(doc_id, text, source).

    Each document is taken floor(target / source_size) times, and once more while the running size of
    its source's documents, in the order of a seeded hash, is nearer the rest of the target. So a
    source's taken words miss its target by half a document at most, and a rerun takes the same ones.
    The running sizes come from sums over 4,096 hash buckets of each source; only the one bucket in
    which a source's rest ends is ordered row by row. Null texts and texts without words have size 0;
    a null source is a source of its own; a source without words has target 0. Columns named in place tell
    rows apart that are equal in doc_id and size; they come with the result.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = stage(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            key.alias("key"),
            *place,
        ).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)),
        "sized",
    )
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    totals = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(totals, epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)))
    plan = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    plan = stage(plan.select("t.*", "bucket", "bucket_size", "start"), "mixplan")
    cut = plan.where("start < rest AND start + bucket_size > rest")
    meet = lambda p: F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket"))
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = ["d.doc_id", "d.source", "d.bucket", "d.key", "d.size", "source_size", "target", "whole", "rest", "start", *(f"d.{c}" for c in place)]
    near = sized.alias("d").join(cut.alias("p"), meet("p")).select(*columns)
    near = near.withColumn("run", F.col("start") + F.sum("size").over(order))
    near = near.withColumn("extra", (F.col("run") - F.col("size") / 2 <= F.col("rest")).cast("int"))
    far = plan.where("NOT (start < rest AND start + bucket_size > rest)")
    far = sized.alias("d").join(far.alias("p"), meet("p"))
    far = far.select(*columns, "bucket_size").withColumn("extra", ((F.col("start") + F.col("bucket_size") <= F.col("rest")) & (F.col("rest") > 0)).cast("int"))
    out = near.drop("run").unionByName(far.drop("bucket_size"))
    repeats = (F.col("whole") + F.col("extra")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", (repeats * F.col("size")).alias("taken"), repeats.alias("repeats"), "key", *place)


def mixed_documents(docs: DataFrame, epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; all columns stay.

    Documents without words carry no weight, so they are taken once. Each row is mixed for itself, rows
    with equal doc_id or none included; a frame that is no plain file scan is written to the shared folder first.
    """
    file, row, times, copy = (fresh(docs, c) for c in ("own_file", "own_row", "times", "copy"))
    rows = placed(docs, file, row)
    taken = mix_sources(rows.select("doc_id", "source", "text", file, row), epochs, seed, (file, row))
    often = F.when(F.col("size") > 0, F.col("repeats")).otherwise(1)
    often = taken.select(F.struct(file, row).alias(copy), often.alias(times)).where(F.col(times) > 0)
    repeated = rows.join(often, (F.col(file) == F.col(copy)[file]) & (F.col(row) == F.col(copy)[row]))
    return repeated.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long")))).select(*(rows[c] for c in docs.columns))
