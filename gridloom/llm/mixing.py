"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

#: Bits of a document's hash, and bits that each histogram level resolves.
HASH_BITS, LEVEL_BITS = 60, 12


def document_hash() -> F.Column:
    """A fixed 60-bit hash of id and text (null parts are left out)."""
    digest = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("text")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """A row per source: ``source_size``, ``target``.

    Sources in code-point order (null last) take the weights in turn. The level at
    which ``min(weight * level, max_repeats * size)`` sums to the total size is found
    from running sums over the sources ordered by where they reach their cap; the
    windows without a key see one row per source.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    by_cap = Window.partitionBy(F.lit(1)).orderBy("ratio", "rank")
    sources = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(rank))
        .withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("open_weight"))
        .withColumn("open", F.col("level") <= F.col("ratio"))
        .withColumn("water", F.min_by("level", F.when(F.col("open"), F.struct("ratio", "rank"))).over(every))
    )
    target = F.when(F.col("open"), F.col("weight") * F.col("water")).otherwise(F.col("cap").cast("double"))
    return sources.select("source", "source_size", target.alias("target"))


def mix_thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per source: whole ``copies`` of every document, and where what is taken once more ends:
    all documents whose hash, moved right by ``shift`` bits, is below ``bucket``, and ``extra`` of the
    ``rows`` in it.

    Level by level the sizes are summed by source and hash bucket; running sums over a
    source's 4096 buckets give the one in which the budget ends, and only the documents
    of that bucket are summed again by the next 12 bits, until it holds one hash value, as a rule
    one row. So many of its rows are taken that the sum comes nearest. No documents are sorted.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = written(
        targets.withColumn("copies", copies)
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumns({"bucket": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "held": F.lit(0).cast("long"), "rows": F.lit(0).cast("long"), "several": F.lit(True)}),
        "mix-state",
    )
    shift = HASH_BITS
    while shift:
        inside = sized.join(state.select(F.col("source").alias("s"), F.col("bucket").alias("b")), F.col("source").eqNullSafe(F.col("s"))).where(F.shiftright("hash", shift) == F.col("b"))
        shift -= LEVEL_BITS
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("next")).agg(F.sum("size").alias("held"), F.count("*").alias("rows"), (F.min("hash") < F.max("hash")).alias("several"))
        running = sums.withColumn("up_to", F.sum("held").over(Window.partitionBy("source").orderBy("next"))).select(F.col("source").alias("s"), "next", F.col("held").alias("n_held"), F.col("rows").alias("n_rows"), F.col("several").alias("n_several"), "up_to")
        over = (
            running.join(state.select("source", "rest", "below"), F.col("source").eqNullSafe(F.col("s")))
            .where(F.col("below") + F.col("up_to") > F.col("rest"))
            .groupBy("source")
            .agg(F.min(F.struct("next", (F.col("below") + F.col("up_to") - F.col("n_held")).alias("below"), F.col("n_held").alias("held"), F.col("n_rows").alias("rows"), F.col("n_several").alias("several"))).alias("at"))
            .select(F.col("source").alias("s"), "at")
        )
        state = written(
            state.join(over, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source",
                "source_size",
                "target",
                "copies",
                "rest",
                F.coalesce("at.next", F.shiftleft(F.col("bucket") + 1, LEVEL_BITS) - 1).alias("bucket"),
                F.coalesce("at.below", "below").alias("below"),
                F.coalesce("at.held", F.lit(0)).alias("held"),
                F.coalesce("at.rows", F.lit(0)).alias("rows"),
                F.coalesce("at.several", F.lit(False)).alias("several"),
            ),
            "mix-state",
        )
        if not state.agg(F.max("several")).first()[0]:
            break
    # rows of one hash are copies of one document, each as long as the others
    each = F.col("held") / F.when(F.col("held") > 0, F.col("rows"))
    extra = F.least(F.greatest(F.ceil((F.col("rest") - F.col("below")) / each - 0.5), F.lit(0)), F.col("rows"))
    return written(state.select("source", "source_size", "target", "copies", "bucket", F.lit(shift).alias("shift"), F.coalesce(extra, F.lit(0)).alias("extra"), "rows"), "mix-cuts")


def _with_copies(rows: DataFrame, cuts: DataFrame, max_repeats: int) -> DataFrame:
    """``rows`` (with ``source``, ``hash``) beside ``source_size``, ``target`` and ``copies``, how often each is taken.

    Where a source's last hash has several rows, these are numbered: within a task, from what the
    tasks before have, so that no task sees them all.
    """
    named = cuts.withColumnRenamed("source", "_s")
    joined = rows.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    place = F.call_function("shiftright", F.col("hash"), F.col("shift"))
    last = (place == F.col("bucket")) & (F.col("rows") > 1)
    if (cuts.agg(F.max("rows")).first()[0] or 0) > 1:
        some = written(joined.where(last).withColumn("_task", F.spark_partition_id()), "mix-last")
        before = Window.partitionBy("source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
        starts = some.groupBy("source", "_task").agg(F.count("*").alias("_n")).select(F.col("source").alias("_s"), F.col("_task").alias("_t"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        own = F.row_number().over(Window.partitionBy("source", "_task").orderBy("hash"))
        counted = some.withColumn("_own", own).join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_task") == F.col("_t")))
        numbered = counted.withColumn("_number", F.col("_own") + F.col("_before")).drop("_task", "_own", "_s", "_t", "_before")
        joined = joined.where(~last).withColumn("_number", F.lit(1).cast("long")).unionByName(numbered)
    else:
        joined = joined.withColumn("_number", F.lit(1).cast("long"))
    more = ((place < F.col("bucket")) | ((place == F.col("bucket")) & (F.col("_number") <= F.col("extra")))) & (F.col("copies") < max_repeats)
    return joined.withColumn("copies", (F.col("copies") + more.cast("long")).cast("long")).drop("bucket", "shift", "extra", "rows", "_number")


def _sized(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), document_hash().alias("hash")), "mix-sizes")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``doc_id``, ``source``, ``hash``, ``size``, ``source_size``, ``target``, ``copies``
    (how often the mix takes the document) and ``taken`` (its words in the mix), a row per
    input row.

    Null text has size 0; null is a source of its own, the last one. Rows that repeat both id
    and text have the same hash; where the mix ends among them, so many are taken once more as
    come nearest. Empty tables give empty results.
    """
    sized = _sized(docs)
    taken = _with_copies(sized, mix_thresholds(sized, source_targets(sized, weights, max_repeats)), max_repeats)
    return taken.select("doc_id", "source", "hash", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    Of rows that repeat both id and text some may be taken once more than others, null sources are
    one source and null texts, of size 0, are taken like others. Extra columns stay, whatever
    their names; an empty table gives an empty result.
    """
    sized = _sized(docs)
    cuts = mix_thresholds(sized, source_targets(sized, weights, max_repeats))
    rows = docs.select(F.struct("*").alias("row"), "source", document_hash().alias("hash"))
    taken = _with_copies(rows, cuts, max_repeats)
    return taken.withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
