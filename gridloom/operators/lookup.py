"""Lookups as joins. Every lookup keeps all rows of ``left`` and adds the columns it returns; a miss
leaves them null and sets ``<prefix>error`` to #N/A."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..names import spare
from ..values import NA, Value, num, number_text, text_of
from ..functions.texts import wildcard
from ..storage import ranged


def key_of(value: Value) -> Column:
    """What two cells share when a lookup holds them equal: the number, or the text without case."""
    if value.kind in ("number", "logical"):
        return value.column().cast("double")
    n = num(value)
    return F.coalesce(F.when(text_of(value) != "", F.concat(F.lit("n"), number_text(n))), F.concat(F.lit("s"), F.lower(text_of(value))))


def _firsts(table: DataFrame, key: Column, returns: list[str], position: str | None, last: bool) -> DataFrame:
    """``_key`` and ``_row``, a struct of what is returned, per key: the first (or last) by position,
    without one by the returned values in their order, as a table's rows have none of their own."""
    at = F.col(position) if position else F.struct(*returns)
    keyed = table.select(key.alias("_key"), F.struct(*returns).alias("_row"), at.alias("_at")).where(F.col("_key").isNotNull())
    pick = F.max_by if last else F.min_by
    return keyed.groupBy("_key").agg(pick("_row", "_at").alias("_row"))


def exact(left: DataFrame, wanted: Value, table: DataFrame, key: Value, returns: list[str], *, position: str | None = None, last: bool = False, prefix: str = "found_") -> DataFrame:
    """VLOOKUP and HLOOKUP with FALSE, MATCH 0, XLOOKUP and XMATCH 0 (``last``: search mode -1)."""
    want, at, hit = spare(left, "_want", "_key", "_hit")
    found = _firsts(table, key_of(key), returns, position, last)
    found = found.select(F.col("_key").alias(at), *[F.col("_row").getField(c).alias(prefix + c) for c in returns], F.lit(True).alias(hit))
    return left.withColumn(want, key_of(wanted)).join(found, F.col(want) == F.col(at), "left").withColumn(f"{prefix}error", F.when(F.col(hit).isNull(), NA)).drop(want, at, hit)


def exists(left: DataFrame, wanted: Value, table: DataFrame, key: Value, *, negate: bool = False) -> DataFrame:
    """COUNTIF(range, x) > 0, or with ``negate`` ISNA(MATCH(x, range, 0)), as a semi or anti join."""
    want, at = spare(left, "_want", "_key")
    keys = table.select(key_of(key).alias(at))
    return left.withColumn(want, key_of(wanted)).join(keys, F.col(want) == F.col(at), "left_anti" if negate else "left_semi").drop(want)


def nearest(left: DataFrame, wanted: Value, table: DataFrame, key: Value, returns: list[str], *, below: bool = True, position: str | None = None, prefix: str = "found_") -> DataFrame:
    """The row with the largest key up to the wanted number (``below``) or the least from it on: VLOOKUP
    with TRUE, LOOKUP, MATCH 1 and -1, XLOOKUP and XMATCH -1 and 1. Tables needn't be sorted.

    Both sides are dealt to ranges of keys together, and inside a range the last key seen in order
    is carried along; what comes in from the ranges before is at most one row each. Wanted
    numbers are first reduced to distinct ones.
    """
    sign = 1 if below else -1
    keys = _firsts(table, num(key), returns, position, False).select((F.col("_key") * sign).alias("_k"), "_row", F.lit(False).alias("_asks"))
    want = left.select((num(wanted) * sign).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    both = ranged(want.select("_k", F.lit(None).cast(dict(keys.dtypes)["_row"]).alias("_row"), F.lit(True).alias("_asks")).unionByName(keys), "_k")
    before = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    tops = both.groupBy("_range").agg(F.max_by("_row", F.when(~F.col("_asks"), F.col("_k"))).alias("_top"))
    carried = tops.select("_range", F.last("_top", ignorenulls=True).over(before).alias("_carry"))
    order = Window.partitionBy("_range").orderBy("_k", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_row", F.last("_row", ignorenulls=True).over(order)).where("_asks")
    asked, at, hit = spare(left, "_want", "_k", "_hit")
    found = seen.join(F.broadcast(carried), "_range", "left").select("_k", F.coalesce("_row", "_carry").alias("_row")).select(F.col("_k").alias(at), *[F.col("_row")[c].alias(prefix + c) for c in returns], F.col("_row").isNotNull().alias(hit))
    return left.withColumn(asked, num(wanted) * sign).join(found, F.col(asked) == F.col(at), "left").withColumn(f"{prefix}error", F.when(~F.coalesce(hit, F.lit(False)), NA)).drop(asked, at, hit)


#: Characters of a pattern's plain start by which it meets the texts that it can match.
_STARTS = 4


def patterns(left: DataFrame, wanted: Value, table: DataFrame, key: Value, returns: list[str], *, position: str, prefix: str = "found_") -> DataFrame:
    """XLOOKUP with wildcards: each distinct pattern against the texts, the first hit by position.

    Patterns meet the texts that share their plain start (up to ``_STARTS`` characters, in lower
    case) by an equi-join on it; only those that begin with a wildcard are held against every
    text.
    """
    want, hit = spare(left, "_want", "_hit")
    asks = left.select(text_of(wanted).alias("_want")).distinct()
    plain = F.substring(F.regexp_extract("_want", r"^[^*?]*", 0), 1, _STARTS)
    asks = asks.select("_want", F.lower(plain).alias("_start"), F.length(plain).alias("_size"))
    rows = table.select(text_of(key).alias("_text"), F.col(position).alias("_at"), F.struct(*returns).alias("_row"))
    matches = F.regexp_like(F.col("_text"), F.concat(F.lit("(?i)^"), wildcard(F.col("_want")), F.lit("$")))
    starts = rows.withColumn("_size", F.explode(F.sequence(F.lit(1), F.lit(_STARTS)))).withColumn("_start", F.lower(F.substring("_text", 1, F.col("_size")))).where(F.length("_text") >= F.col("_size"))
    begun = starts.join(asks.where("_size > 0"), ["_size", "_start"]).where(matches).select("_want", "_at", "_row")
    anywhere = rows.join(asks.where("_size = 0").select("_want"), matches).select("_want", "_at", "_row")
    found = begun.unionByName(anywhere).groupBy("_want").agg(F.min_by("_row", "_at").alias("_row")).select(F.col("_want").alias(want), *[F.col("_row")[c].alias(prefix + c) for c in returns], F.lit(True).alias(hit))
    return left.withColumn(want, text_of(wanted)).join(found, want, "left").withColumn(f"{prefix}error", F.when(F.col(hit).isNull(), NA)).drop(want, hit)


def at_position(left: DataFrame, place: Column, table: DataFrame, position: str, returns: list[str], *, prefix: str = "found_") -> DataFrame:
    """INDEX as a join on the position; 0 counts as 1."""
    asks, at, hit = spare(left, "_place", "_at", "_hit")
    rows = table.select(F.col(position).cast("long").alias(at), *[F.col(c).alias(prefix + c) for c in returns], F.lit(True).alias(hit))
    asked = left.withColumn(asks, F.when(place == 0, 1).otherwise(place).cast("long"))
    return asked.join(rows, F.col(asks) == F.col(at), "left").withColumn(f"{prefix}error", F.when(F.col(asks) < 0, "#VALUE!").when(F.col(hit).isNull(), "#REF!")).drop(asks, at, hit)


def grouped_onto(left: DataFrame, keys: list[str], table: DataFrame, table_keys: list[str], **totals: Value) -> DataFrame:
    """A column of SUMIFS, COUNTIFS or AVERAGEIFS whose criteria are cells of the same row: one
    aggregation by the keys and one join, in place of a scan for each row. ``totals`` are
    aggregate values; where a key has no row, sums and counts are 0."""
    names = spare(left, *[f"_k{i}" for i in range(len(keys))])
    summed = table.groupBy(*[F.col(k).alias(n) for n, k in zip(names, table_keys, strict=True)]).agg(*[v.column().alias(n) for n, v in totals.items()])
    on = [F.col(k) == F.col(n) for n, k in zip(names, keys, strict=True)]
    return left.join(summed, on, "left").drop(*names).fillna(0.0, subset=list(totals))
