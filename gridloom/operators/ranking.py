"""Order statistics over whole tables: ranges of values are ordered apart from each other and what
lies in the ranges before is added, so that no task sees all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..names import spare
from ..storage import ranged
from ..values import NUM, Value, num, result


def value_counts(df: DataFrame, value: Value, by: list[str] | None = None, weight: Column | None = None, parts: int | None = None) -> DataFrame:
    """``v`` and ``n``, with ``below`` (how many values of the table, or of the group ``by``, are smaller) and
    ``total`` (how many there are); a row per distinct value. A null group is one; a large one lies
    in several ranges, whose counts are carried from one to the next. A row counts ``weight`` times,
    once without; the ranges are ``parts`` or as many as the session shuffles to."""
    by = by or []
    groups = [f"_g{i}" for i in range(len(by))]
    counts = df.select(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], num(value).alias("v"), *([] if weight is None else [weight.alias("_w")])).where("v is not null").groupBy(*groups, "v").agg((F.count("*") if weight is None else F.sum("_w")).alias("n"))
    placed = ranged(counts, *groups, "v", parts=parts)
    whole = Window.partitionBy(*(groups or [F.lit(1)]))  # of one row a range
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range", *groups).agg(F.sum("n").alias("_n"))
    starts = starts.select(F.col("_range").alias("_at"), *[F.col(g).alias(f"_s{i}") for i, g in enumerate(groups)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_range", *groups).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_s{i}")) for i, g in enumerate(groups)], F.col("_range") == F.col("_at"))
    joined = placed.withColumn("_inside", inside).join(starts if by else F.broadcast(starts), same)
    return joined.select(*[F.col(g).alias(c) for c, g in zip(by, groups, strict=True)], "v", "n", (F.col("_before") + F.col("_inside")).alias("below"), "total")


def rank(df: DataFrame, value: Value, out: str, *, ascending: bool = False, average: bool = False, by: list[str] | None = None) -> DataFrame:
    """RANK, RANK.EQ and (``average``) RANK.AVG of every row, in the table or within groups ``by``; null
    where there is no number."""
    by = by or []
    key, v, *groups = spare(df, "_key", "_v", *[f"_by{i}" for i in range(len(by))])
    counts = value_counts(df, value, by)
    ahead = F.col("below") if ascending else F.col("total") - F.col("below") - F.col("n")
    place = counts.select(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], F.col("v").alias(v), (ahead + 1 + ((F.col("n") - 1) / 2 if average else 0)).cast("double").alias(out))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(by, groups, strict=True)], F.col(key) == F.col(v))
    return df.withColumn(key, num(value)).join(place, same, "left").drop(key, v, *groups)


def nth(df: DataFrame, value: Value, k: int, *, largest: bool = True) -> DataFrame:
    """LARGE and SMALL: one row ``value``; empty if there are fewer than k values."""
    numbers = df.select(num(value).alias("value")).where("value is not null")
    order = F.col("value").desc() if largest else F.col("value").asc()
    top = numbers.orderBy(order).limit(k)
    return top.agg(F.count("*").alias("n"), (F.min("value") if largest else F.max("value")).alias("value")).where(F.col("n") == k).select("value")


def _at_places(df: DataFrame, value: Value, places: Column) -> DataFrame:
    """``place``, ``value`` for 0-based places in the order of values; ``places`` may use ``total``."""
    counts = value_counts(df, value)
    asked = counts.agg(F.sum("n").alias("total")).select(F.explode(places).alias("place"))
    return counts.join(F.broadcast(asked), (F.col("place") >= F.col("below")) & (F.col("place") < F.col("below") + F.col("n"))).select("place", F.col("v").alias("value"))


def percentile_exc(df: DataFrame, value: Value, k: float) -> DataFrame:
    """PERCENTILE.EXC: one row ``value``; empty where it is undefined."""
    spot = F.lit(float(k)) * (F.col("total") + 1) - 1
    two = _at_places(df, value, F.array(F.floor(spot), F.ceil(spot)))
    share = df.select(F.count(num(value)).alias("total")).select((spot - F.floor(spot)).alias("share"))
    ends = two.distinct().agg(F.min_by("value", "place").alias("a"), F.max_by("value", "place").alias("b"))
    return ends.crossJoin(F.broadcast(share)).where("a is not null").select((F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("value"))


def percentiles(df: DataFrame, value: Value, shares: dict[str, float], by: list[str], *figures: Column) -> DataFrame:
    """``figures`` of each group ``by`` with PERCENTILE.INC of ``value`` as a column for each of ``shares``; null
    where a group has no number. A null group is one."""
    counts = value_counts(df, value, by)
    ends = []
    for i, share in enumerate(shares.values()):
        spot = F.lit(float(share)) * (F.col("total") - 1)
        for end, place in (("a", F.floor(spot)), ("b", F.ceil(spot))):
            ends.append(F.max(F.when((place >= F.col("below")) & (place < F.col("below") + F.col("n")), F.col("v"))).alias(f"_{end}{i}"))
    keys = spare(df, *[f"_by{i}" for i in range(len(by))])
    found = counts.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).agg(F.max("total").alias("total"), *ends)
    shown = []
    for i, (name, share) in enumerate(shares.items()):
        spot = F.lit(float(share)) * (F.col("total") - 1)
        part, a, b = spot - F.floor(spot), F.col(f"_a{i}"), F.col(f"_b{i}")
        shown.append(F.when(part == 0, a).otherwise((1 - part) * a + part * b).alias(name))
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)])
    return df.groupBy(*by).agg(*figures).join(found.select(*keys, *shown), same, "left").drop(*keys)


def trimmed_mean(df: DataFrame, value: Value, percent: float) -> DataFrame:
    """TRIMMEAN: the mean without floor(n * percent / 2) values at each end; one row ``value``."""
    counts = value_counts(df, value).withColumn("cut", F.floor(F.col("total") * percent / 2))
    last = F.least(F.col("below") + F.col("n"), F.col("total") - F.col("cut"))
    kept = F.greatest(last - F.greatest("below", "cut"), F.lit(0))
    return counts.agg((F.sum(F.col("v") * kept) / F.sum(kept)).alias("value"))


def mode(df: DataFrame, value: Value, position: str) -> DataFrame:
    """MODE: the most frequent value, of several the one that comes first; empty if all are unique."""
    counts = df.select(num(value).alias("v"), F.col(position).alias("_at")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("_at").alias("_at"))
    return counts.where("n > 1").orderBy(F.col("n").desc(), "_at").limit(1).select(F.col("v").alias("value"))


def frequency(df: DataFrame, value: Value, bins: list[float]) -> DataFrame:
    """FREQUENCY: ``bin`` (from 1; the last holds what exceeds all bins) and ``n``."""
    cuts = sorted(map(float, bins))
    bin_of = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < num(value))) + 1
    counted = df.where(num(value).isNotNull()).groupBy(bin_of.cast("int").alias("bin")).agg(F.count("*").alias("_n"))
    return df.sparkSession.range(1, len(cuts) + 2).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("_n", F.lit(0)).alias("n"))


def average_deviation(df: DataFrame, value: Value) -> DataFrame:
    """AVEDEV in two passes that both combine on the map side; one row ``value``."""
    numbers = df.select(num(value).alias("x")).where("x is not null")
    mean = numbers.agg(F.avg("x").alias("m"))
    return numbers.crossJoin(F.broadcast(mean)).agg(F.avg(F.abs(F.col("x") - F.col("m"))).alias("value"))


def standardized(df: DataFrame, value: Value, out: str, by: list[str]) -> DataFrame:
    """STANDARDIZE against mean and sample deviation of each group, by a join of the groups' figures. Rows
    whose group is null are a group."""
    mean, deviation, *keys = spare(df, "_m", "_s", *[f"_by{i}" for i in range(len(by))])
    figures = df.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).agg(F.avg(num(value)).alias(mean), F.stddev_samp(num(value)).alias(deviation))
    joined = df.join(figures, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)]))
    m, s = F.col(mean), F.col(deviation)
    z = result("number", (num(value) - m) / F.when(s > 0, s), (s <= 0, NUM))
    return joined.withColumn(out, z.column()).drop(mean, deviation, *keys)
