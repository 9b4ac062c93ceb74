"""One query per family of functions and operators, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import call, over
from ..functions.dates import to_serial
from ..functions.maths import add, compare, divide, join_text, multiply, negate, power, subtotal, subtract
from ..functions.statistics import average_if, average_ifs, count_if, count_ifs, max_ifs, min_ifs, sum_if, sum_ifs
from ..functions.registry import register_function, register_names
from ..operators import formats, grid, lookup, ranking, references, rule_tables
from ..sources import workbooks
from ..values import Value, array, number, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(v: Value | Column, digits: int = 6) -> Column:
    c = v.column() if isinstance(v, Value) else v
    return F.round(c, digits) + 0.0  # no negative zero


def serial(name: str) -> Value:
    return Value("number", to_serial(F.to_date(name)))


@query
def sumifs_by_segment(spark, d):
    """The flagship: VLOOKUP of each order's segment, then SUMIFS of its price by segment."""
    orders, customer = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    seen = lookup.exact(orders, number("o_custkey"), customer, number("c_custkey"), ["c_mktsegment"])
    return seen.groupBy(F.col("found_c_mktsegment").alias("segment")).agg(rounded(sum_if(number("o_totalprice"), ">0"), 2).alias("total"), count_if(number("o_totalprice"), ">100000").column().alias("large"))


@query
def conditional_aggregates(spark, d):
    """SUMIFS and its kin with literal criteria, by return flag."""
    q, p, s = number("l_quantity"), number("l_extendedprice"), text("l_linestatus")
    return (
        table(spark, d, "lineitem")
        .groupBy("l_returnflag")
        .agg(
            rounded(sum_ifs(p, q, ">=25", s, "O"), 2).alias("sumifs"),
            rounded(average_ifs(p, q, "<10"), 4).alias("averageifs"),
            rounded(average_if(q, "<>7"), 6).alias("averageif"),
            count_ifs(q, ">10", s, "f").column().alias("countifs"),
            count_if(s, "?").column().alias("countif"),
            max_ifs(p, q, 1).column().alias("maxifs"),
            min_ifs(p, q, ">49").column().alias("minifs"),
        )
    )


@query
def criteria_wildcards(spark, d):
    return (
        table(spark, d, "part")
        .groupBy("p_brand")
        .agg(count_if(text("p_type"), "*a*").column().alias("with_a"), count_if(text("p_type"), "<>*a*").column().alias("without_a"), rounded(sum_if(text("p_name"), "p*", number("p_retailprice")), 2).alias("total"))
    )


@query
def plain_aggregates(spark, d):
    x = number("l_quantity")
    names = {"SUM": 4, "AVERAGE": 8, "MIN": 4, "MAX": 4, "COUNT": 0, "SUMSQ": 2, "STDEV.S": 6, "STDEV.P": 6, "VAR.S": 5, "VAR.P": 5, "MEDIAN": 6, "DEVSQ": 2, "GEOMEAN": 6, "HARMEAN": 6, "COUNTA": 0, "COUNTBLANK": 0, "AVERAGEA": 8, "MAXA": 4, "MINA": 4}
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[rounded(over(n, x), k).alias(n.lower().replace(".", "_")) for n, k in names.items()])


@query
def numbered_aggregates(spark, d):
    x = number("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(*[rounded(subtotal(n, x), 4).alias(f"s{n}") for n in (1, 2, 3, 4, 5, 7, 8, 9, 110, 111)])


@query
def shape_statistics(spark, d):
    x = number("l_extendedprice")
    figures = [rounded(over("SKEW", x), 5).alias("skew"), rounded(over("KURT", x), 5).alias("kurt")]
    out = ranking.percentiles(table(spark, d, "lineitem"), x, {"p90": 0.9, "q1": 0.25}, ["l_returnflag"], *figures)
    return out.select("l_returnflag", "skew", "kurt", *[rounded(F.col(c), 4).alias(c) for c in ("p90", "q1")])


@query
def regression(spark, d):
    y, x = number("l_extendedprice"), number("l_quantity")
    names = ["SLOPE", "INTERCEPT", "RSQ", "CORREL", "COVARIANCE.P", "COVARIANCE.S", "SUMX2MY2", "SUMX2PY2", "SUMXMY2", "SUMPRODUCT"]
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[rounded(over(n, y, x), 3).alias(n.lower().replace(".", "_")) for n in names], rounded(over("FORECAST", 30, y, x), 3).alias("forecast"))


@query
def vlookup_exact(spark, d):
    """lineitem to part, two columns by one join."""
    items, part = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), table(spark, d, "part")
    return lookup.exact(items, number("l_partkey"), part, number("p_partkey"), ["p_brand", "p_size"]).select("l_orderkey", "l_linenumber", F.col("found_p_brand").alias("brand"), F.col("found_p_size").alias("size"), F.col("found_error").alias("error"))


@query
def xlookup_last(spark, d):
    """The last order of each customer, customers without one included."""
    customer, orders = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")
    return lookup.exact(customer, number("c_custkey"), orders, number("o_custkey"), ["o_totalprice"], position="o_orderkey", last=True).select("c_custkey", F.col("found_o_totalprice").alias("price"), F.col("found_error").alias("error"))


@query
def lookup_approximate(spark, d):
    """Bands of account balances: the largest band up to the balance."""
    bands = spark.range(0, 11).select((F.col("id") * 1000 - 500).cast("double").alias("start"), F.concat(F.lit("band "), F.col("id")).alias("band"))
    customer = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return lookup.nearest(customer, number("c_acctbal"), bands, number("start"), ["band"]).select("c_custkey", F.col("found_band").alias("band"), F.col("found_error").alias("error"))


@query
def match_next(spark, d):
    """The least order price from each customer's balance on."""
    customer, orders = table(spark, d, "customer").select("c_custkey", "c_acctbal"), table(spark, d, "orders").select("o_totalprice")
    return lookup.nearest(customer, number("c_acctbal"), orders.distinct(), number("o_totalprice"), ["o_totalprice"], below=False).select("c_custkey", F.col("found_o_totalprice").alias("price"))


@query
def xlookup_wildcard(spark, d):
    asks = spark.range(1, 6).select("id", F.concat(F.lit("*"), F.col("id"), F.lit("?")).alias("pattern"))
    found = lookup.patterns(asks, text("pattern"), table(spark, d, "supplier"), text("s_name"), ["s_suppkey"], position="s_suppkey")
    return found.select("id", F.col("found_s_suppkey").alias("supplier"), F.col("found_error").alias("error"))


@query
def index_match(spark, d):
    nation = table(spark, d, "nation")
    asked = spark.range(0, 30).select(F.col("id").cast("int").alias("k"))
    return lookup.at_position(asked, F.col("k"), nation.withColumn("at", F.col("n_nationkey") + 1), "at", ["n_name"]).select("k", F.col("found_n_name").alias("name"), F.col("found_error").alias("error"))


@query
def countif_exists(spark, d):
    customer, orders = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey")
    some = lookup.exists(customer, number("c_custkey"), orders, number("o_custkey")).withColumn("has", F.lit(True))
    none = lookup.exists(customer, number("c_custkey"), orders, number("o_custkey"), negate=True).withColumn("has", F.lit(False))
    return some.unionByName(none)


@query
def sumifs_per_row(spark, d):
    """A column of SUMIFS and COUNTIFS with the row's own cell as the criterion."""
    customer, orders = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")
    out = lookup.grouped_onto(customer, ["c_custkey"], orders, ["o_custkey"], total=over("SUM", number("o_totalprice")), orders=over("COUNT", number("o_totalprice")))
    return out.select("c_custkey", rounded(F.col("total"), 2).alias("total"), "orders")


@query
def rank_table(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    ranked = ranking.rank(ranking.rank(customer, number("c_acctbal"), "rank"), number("c_acctbal"), "rank_avg", average=True, ascending=True)
    return ranked.select("c_custkey", "rank", "rank_avg")


@query
def rank_in_group(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return ranking.rank(part, number("p_size"), "rank", average=True, by=["p_brand"]).select("p_partkey", "rank")


@query
def large_small(spark, d):
    orders, v = table(spark, d, "orders"), number("o_totalprice")
    return ranking.nth(orders, v, 10).withColumn("which", F.lit("large")).unionByName(ranking.nth(orders, v, 10, largest=False).withColumn("which", F.lit("small")))


@query
def percentile_exclusive(spark, d):
    return ranking.percentile_exc(table(spark, d, "orders"), number("o_totalprice"), 0.3).select(rounded(F.col("value"), 4).alias("value"))


@query
def trimmed_mean(spark, d):
    return ranking.trimmed_mean(table(spark, d, "orders"), number("o_totalprice"), 0.2).select(rounded(F.col("value"), 4).alias("value"))


@query
def mode_first_seen(spark, d):
    return ranking.mode(table(spark, d, "part"), number("p_size"), "p_partkey")


@query
def frequency_bins(spark, d):
    return ranking.frequency(table(spark, d, "lineitem"), number("l_quantity"), [10, 20, 30, 40])


@query
def average_deviation(spark, d):
    return ranking.average_deviation(table(spark, d, "lineitem"), number("l_quantity")).select(rounded(F.col("value"), 6).alias("value"))


@query
def standardized(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return ranking.standardized(part, number("p_retailprice"), "z", ["p_brand"]).select("p_partkey", rounded(F.col("z"), 6).alias("z"))


@query
def operators_arithmetic(spark, d):
    q, p, t = number("l_quantity"), number("l_extendedprice"), number("l_tax")
    ratio = divide(p, t)
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        rounded(add(multiply(q, 2), negate(t)), 6).alias("sum"),
        rounded(subtract(p, q), 4).alias("difference"),
        rounded(power(q, 2), 4).alias("square"),
        rounded(ratio, 4).alias("ratio"),
        ratio.error().alias("error"),
        compare(q, ">=", 25).column().alias("many"),
        join_text(text("l_returnflag"), text("l_linestatus")).column().alias("flags"),
        join_text(q, "x").column().alias("label"),
    )


def _per_row(df: DataFrame, keys: list[str], built: dict[str, Value], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[rounded(v, digits).alias(n) if v.kind == "number" else v.column().alias(n) for n, v in built.items()])


@query
def rounding(spark, d):
    x, q = number("c_acctbal"), number("c_acctbal")
    built = {
        "round": call("ROUND", x, 1), "roundup": call("ROUNDUP", x, 0), "rounddown": call("ROUNDDOWN", x, 0), "trunc": call("TRUNC", x, 1), "int": call("INT", x),
        "ceiling": call("CEILING.PRECISE", x, 5), "floor": call("FLOOR.MATH", x, 5), "even": call("EVEN", x), "odd": call("ODD", x), "mround": call("MROUND", call("ABS", q), 25),
        "mod": call("MOD", x, 7), "quotient": call("QUOTIENT", x, 7), "sign": call("SIGN", x), "abs": call("ABS", x),
    }
    return _per_row(table(spark, d, "customer"), ["c_custkey"], built, 4)


@query
def elementary(spark, d):
    x = number("l_discount")
    built = {n.lower(): call(n, x) for n in ("SIN", "COS", "TAN", "ASIN", "ACOS", "ATAN", "SINH", "COSH", "TANH", "EXP", "SQRT", "SQRTPI", "RADIANS", "DEGREES", "SEC", "ACOT")}
    built |= {"ln": call("LN", number("l_quantity")), "log10": call("LOG10", number("l_quantity")), "log2": call("LOG", number("l_quantity"), 2), "atan2": call("ATAN2", number("l_quantity"), x), "cot": call("COT", number("l_quantity")), "csc": call("CSC", number("l_quantity"))}
    return _per_row(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], built, 8)


@query
def combinatorics(spark, d):
    n, k = number("p_size"), number(F.col("p_size") % 7)
    built = {
        "fact": call("FACT", k), "factdouble": call("FACTDOUBLE", k), "combin": call("COMBIN", n, k), "combina": call("COMBINA", k, 3), "permut": call("PERMUT", call("CEILING.PRECISE", n, 7), k),
        "gcd": call("GCD", n, 36), "lcm": call("LCM", n, 12), "base": call("BASE", n, 2, 6), "roman": call("ROMAN", n), "arabic": call("ARABIC", call("ROMAN", n)),
        "decimal": call("DECIMAL", call("BASE", n, 2), 2), "multinomial": call("MULTINOMIAL", k, 2, 1), "iseven": call("ISEVEN", n), "isodd": call("ISODD", n), "letters": call("ADDRESS", 1, n, 4),
    }
    return _per_row(table(spark, d, "part"), ["p_partkey"], built, 0)


@query
def text_functions(spark, d):
    s, n = text("p_name"), text("p_type")
    built = {
        "left": call("LEFT", s, 3), "right": call("RIGHT", s, 4), "mid": call("MID", s, 2, 3), "len": call("LEN", s), "upper": call("UPPER", s), "lower": call("LOWER", n), "trim": call("TRIM", s),
        "replace": call("REPLACE", s, 1, 2, "<>"), "substitute": call("SUBSTITUTE", s, "a", "@"), "second": call("SUBSTITUTE", s, "a", "@", 2), "rept": call("REPT", call("LEFT", s, 1), 3), "exact": call("EXACT", s, call("LOWER", s)),
        "code": call("CODE", s), "concat": call("CONCAT", s, "-", number("p_size")), "join": call("TEXTJOIN", ",", True, s, "", n), "find": call("IFERROR", call("FIND", "a", s), 0), "search": call("IFERROR", call("SEARCH", "A?", s), 0), "proper": call("PROPER", s),
    }
    return _per_row(table(spark, d, "part"), ["p_partkey"], built, 0)


@query
def text_numbers(spark, d):
    x = number("c_acctbal")
    built = {"dollar": call("DOLLAR", x), "fixed": call("FIXED", x, 1), "plain": call("FIXED", x, 2, True), "shown": call("VALUETOTEXT", x), "value": call("VALUE", call("VALUETOTEXT", x)), "numbervalue": call("NUMBERVALUE", call("FIXED", x, 2)), "before": call("TEXTBEFORE", text("c_name"), "#"), "after": call("TEXTAFTER", text("c_name"), "#")}
    df = table(spark, d, "customer")
    return _per_row(df, ["c_custkey"], built, 4).withColumn("before", F.coalesce("before", F.lit("#N/A"))).withColumn("after", F.coalesce("after", F.lit("#N/A")))


@query
def text_urls(spark, d):
    return table(spark, d, "pages").select("page_id", call("ENCODEURL", text("url")).column().alias("encoded"), call("LEN", text("html")).column().alias("length"))


@query
def conditions(spark, d):
    q, t = number("l_quantity"), number("l_tax")
    built = {
        "if": call("IF", compare(q, ">", 25), "many", "few"), "and": call("AND", compare(q, ">", 10), compare(t, "<", 0.05)), "or": call("OR", compare(q, ">", 45), compare(t, "=", 0)), "not": call("NOT", t), "xor": call("XOR", compare(q, ">", 10), compare(t, "<", 0.05)),
        "ifs": call("IFS", compare(q, "<", 10), "low", compare(q, "<", 30), "middle", True, "high"), "switch": call("SWITCH", text("l_returnflag"), "a", "first", "N", "second", "other"), "iferror": call("IFERROR", divide(q, t), -1), "choose": call("CHOOSE", number("l_linenumber"), 10, 20, 30, 40, 50, 60, 70),
    }
    return _per_row(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], built, 4)


@query
def logical_aggregates(spark, d):
    q = number("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(over("AND", compare(q, ">", 5)).column().alias("all"), over("OR", compare(q, ">", 45)).column().alias("any"), over("XOR", compare(q, ">", 25)).column().alias("odd"))


@query
def information(spark, d):
    ratio = divide(number("l_quantity"), number("l_tax"))
    built = {"iserror": call("ISERROR", ratio), "isna": call("ISNA", ratio), "iserr": call("ISERR", ratio), "type": call("TYPE", ratio), "kind": call("IFERROR", call("ERROR.TYPE", ratio), 0), "isnumber": call("ISNUMBER", number("l_tax")), "istext": call("ISTEXT", text("l_returnflag")), "n": call("N", number("l_tax"))}
    return _per_row(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], built, 4)


@query
def dates(spark, d):
    s = number("s")
    built = {
        "serial": s, "year": call("YEAR", s), "month": call("MONTH", s), "day": call("DAY", s), "weekday": call("WEEKDAY", s), "weekday2": call("WEEKDAY", s, 2), "weeknum": call("WEEKNUM", s), "isoweek": call("ISOWEEKNUM", s),
        "edate": call("EDATE", s, 1), "eomonth": call("EOMONTH", s, 0), "date": call("DATE", number("y"), number("m"), 1), "days": call("DAYS", s, 36526), "days360": call("DAYS360", 36526, s), "yearfrac": call("YEARFRAC", 36526, s, 3), "months": call("DATEDIF", 30000, s, "M"),
    }
    days = table(spark, d, "orders").select("o_orderkey", serial("o_orderdate").c.alias("s"))
    # parts that others build on are columns of a step before
    return _per_row(days.select("*", call("YEAR", s).column().alias("y"), call("MONTH", s).column().alias("m")), ["o_orderkey"], built, 6)


@query
def working_days(spark, d):
    s = serial("o_orderdate")
    end = Value("number", s.c + 30)
    return _per_row(table(spark, d, "orders"), ["o_orderkey"], {"networkdays": call("NETWORKDAYS", s, end), "friday": call("NETWORKDAYS.INTL", s, end, 16), "workday": call("WORKDAY", s, 10)}, 0)


@query
def clock(spark, d):
    seconds = F.unix_timestamp("ts") % 86400
    n = Value("number", seconds / 86400.0 + 1e-7)
    return _per_row(table(spark, d, "events"), ["event_id"], {"hour": call("HOUR", n), "minute": call("MINUTE", n), "second": call("SECOND", n), "time": call("TIME", call("HOUR", n), call("MINUTE", n), 0)}, 8)


@query
def annuities(spark, d):
    r, n, p = number(F.col("l_discount") + 0.01), number(F.col("l_linenumber") + 5), number("l_extendedprice")
    built = {"pmt": call("PMT", r, n, p), "fv": call("FV", r, n, 100, p), "pv": call("PV", r, n, 100), "nper": call("NPER", r, Value("number", -(p.c * 0.5)), p), "ipmt": call("IPMT", r, 2, n, p), "ppmt": call("PPMT", r, 2, n, p), "effect": call("EFFECT", r, 4), "nominal": call("NOMINAL", r, 4), "npv": call("NPV", r, p, p, 5)}
    return _per_row(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], built, 4)


@query
def rates(spark, d):
    """RATE, IRR and MIRR of loans and flows that follow the parts' prices."""
    p, n = number("p_retailprice"), number(F.col("p_size") + 2)
    pay = Value("number", -(p.c / n.c) * 1.2)
    flows = array(F.array(-p.c, *[p.c * 0.3] * 5))
    return table(spark, d, "part").select("p_partkey", rounded(call("RATE", n, pay, p), 6).alias("rate"), rounded(call("IRR", flows), 8).alias("irr"), rounded(call("MIRR", flows, 0.05, 0.06), 8).alias("mirr"))


@query
def depreciation(spark, d):
    c = number("p_retailprice")
    s = Value("number", c.c / 10)
    built = {"sln": call("SLN", c, s, 10), "syd": call("SYD", c, s, 10, 3), "ddb": call("DDB", c, s, 10, 1), "ddb3": call("DDB", c, s, 10, 3), "db": call("DB", c, s, 10, 1), "dollarde": call("DOLLARDE", c, 8), "dollarfr": call("DOLLARFR", c, 8)}
    return _per_row(table(spark, d, "part"), ["p_partkey"], built, 4)


@query
def cumulative_loans(spark, d):
    r, n, p = number(F.col("l_discount") + 0.01), number(F.col("l_linenumber") + 5), number("l_extendedprice")
    return _per_row(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"interest": call("CUMIPMT", r, n, p, 1, 3, 0), "principal": call("CUMPRINC", r, n, p, 1, 3, 0)}, 4)


@query
def distributions(spark, d):
    x = number(F.col("l_discount") * 20 - 1)
    k = number("l_linenumber")
    built = {
        "density": call("NORM.S.DIST", x, False), "norm": call("NORM.DIST", x, 0.5, 2, False), "poisson": call("POISSON.DIST", k, 3, False), "binom": call("BINOM.DIST", k, 10, 0.3, False), "weibull": call("WEIBULL.DIST", k, 2, 3, True),
        "expon": call("EXPON.DIST", k, 0.5, True), "fisher": call("FISHER", number("l_discount")), "fisherinv": call("FISHERINV", x), "lognorm": call("LOGNORM.DIST", k, 1, 2, False), "standard": call("STANDARDIZE", k, 3, 2),
    }
    return _per_row(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], built, 8)


@query
def normal_approximations(spark, d):
    """Published polynomials: the distribution, its quantile, and a confidence interval."""
    x = number(F.col("l_discount") * 20 - 1)
    dist = call("NORM.S.DIST", x, True)
    built = {"dist": rounded(dist, 5), "back": rounded(call("NORM.S.INV", dist), 2), "scaled": rounded(call("NORM.INV", dist, 10, 2), 2), "confidence": rounded(call("CONFIDENCE.NORM", 0.05, number("l_quantity"), 4), 1)}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in built.items()])


@query
def arrays(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity")))["l_quantity"].alias("a"))
    a = array("a")
    built = {"sorted": call("SORT", a, 1, -1), "unique": call("UNIQUE", a), "large": call("FILTER", a, Value("array", F.transform("a", lambda x: x > 25)), 0)}
    shown = {n: call("ARRAYTOTEXT", Value("array", F.transform(v.column(), lambda x: x.cast("long").cast("string")))).column().alias(n) for n, v in built.items()}
    return items.select("l_orderkey", *shown.values(), rounded(call("PERCENTILE", a, 0.5), 4).alias("median"), call("LARGE", a, 1).column().alias("largest"), rounded(call("SUMPRODUCT", a, a), 2).alias("squares"), call("MATCH", 1, Value("array", F.array_sort("a")), -1).column().alias("at"))


@query
def split_text(spark, d):
    parts = call("TEXTSPLIT", text("p_name"), " ")
    return table(spark, d, "part").select("p_partkey", F.size(parts.c).alias("n"), F.element_at(parts.c, 1).alias("first"), F.element_at(parts.c, -1).alias("last"))


@query
def grid_recalculation(spark, d):
    """Orders as cells; a column of ratios against the total of another column, and a sum of it."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey"), F.col("o_totalprice"))
    cells = grid.from_table(orders, "Orders", F.col("o_orderkey") + 1, ["o_totalprice"])
    top = orders.agg(F.max("o_orderkey")).first()[0] + 1
    share = grid.Template("Orders", (1, top), (2, 2), {"price": grid.Cell(0, -1), "total": grid.Range(None, 1, None, 1, lambda v: over("SUM", v))}, lambda price, total: divide(price, total))
    check = grid.Template("Orders", (1, 1), (3, 3), {"all": grid.Range(None, 2, None, 2, lambda v: over("SUM", v))}, lambda all: call("ROUND", all, 9))
    out = grid.recalculated(cells, [check, share])
    return out.where("col > 1").select("row", "col", F.round(F.col("v.n"), 10).alias("n"))


def _order_cells(spark, d) -> tuple[DataFrame, int]:
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return grid.from_table(orders, "Orders", F.col("o_orderkey") + 1, ["o_totalprice"]), orders.agg(F.max("o_orderkey")).first()[0] + 1


@query
def running_ranges(spark, d):
    """Prices filled down with SUM(A$1:A5), AVERAGE(A3:A5), MIN over 100 rows and MAX over the next 50."""
    cells, top = _order_cells(spark, d)
    moving = [grid.Sliding("SUM", (-1, -1), last=0, start=1), grid.Sliding("AVERAGE", (-2, -2), first=-2, last=0), grid.Sliding("MIN", (-3, -3), first=-99, last=0), grid.Sliding("MAX", (-4, -4), first=0, last=49)]
    filled = [grid.Template("Orders", (1 - min(0, m.first or 0), top), (i, i), {"x": m}, lambda x: x) for i, m in enumerate(moving, 2)]
    return grid.recalculated(cells, filled).where("col > 1").select("row", "col", F.round("v.n", 4).alias("n"))


@query
def running_balance(spark, d):
    """A balance that reads the one above: =B1*(1-D$1)+A2."""
    cells, top = _order_cells(spark, d)
    rate = spark.range(1).select(F.lit("Orders").alias("sheet"), F.lit(1).alias("row"), F.lit(4).alias("col"), grid.infer(F.lit("0.3")).alias("v"))
    up, price, share = grid.Cell(-1, 0), grid.Cell(0, -1), grid.Cell(1, 4, fixed=True)
    balance = grid.Template("Orders", (1, top), (2, 2), {"up": up, "price": price, "share": share}, lambda up, price, share: add(multiply(up, subtract(1, share)), price))
    return grid.recalculated(cells.unionByName(rate), [balance]).where("col = 2").select("row", F.round("v.n", 2).alias("n"))


@query
def merged_areas(spark, d):
    """What references to order lines read where blocks of lines, of mixed sizes, are merged."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    one = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    cells = one.select(F.lit("L").alias("sheet"), (F.col("l_orderkey") + 1).cast("int").alias("row"), F.col("l_linenumber").cast("int").alias("col"), grid.number_cell(F.col("q")).alias("v"))
    orders = table(spark, d, "orders").where("o_orderkey % 100 = 7").select("o_orderkey")
    first = (F.col("o_orderkey") + 1).cast("int")
    merges = orders.select(F.lit("L").alias("sheet"), first.alias("r1"), F.lit(1).alias("c1"), (first + F.pmod(F.col("o_orderkey"), F.lit(7)) * 10).cast("int").alias("r2"), F.lit(3).alias("c2"))
    return grid.shown_at(cells, cells, merges).select("row", "col", F.col("v.n").alias("n"))


@query
def workbook_round_trip(spark, d):
    """Nations and customers written as the sheets of a workbook, and read back by a task a sheet."""
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    cells = grid.from_table(nation, "Nations", F.col("n_nationkey") + 1, ["n_name", "n_regionkey"]).unionByName(grid.from_table(customer, "Customers", F.col("c_custkey") + 1, ["c_name", "c_acctbal", "c_mktsegment"]))
    path = f"{storage.shared_dir(spark)}/workbook-{uuid.uuid4().hex}.xlsx"
    workbooks.write_workbook(cells, path, ["Nations", "Customers"])
    return spark.read.format("xlsx").load(path).select("sheet", "row", "col", F.col("v.n").alias("n"), F.col("v.s").alias("s"))


@query
def shared_string_numbers(spark, d):
    """Names of parts numbered as they are first seen, in the order of the key."""
    return workbooks.shared_string_table(table(spark, d, "part"), "p_name", ["p_partkey"])


@query
def grid_edits(spark, d):
    cells = grid.from_table(table(spark, d, "nation"), "Nations", F.col("n_nationkey") + 1, ["n_regionkey", "n_name"])
    edits = spark.range(1, 4).select(F.lit("Nations").alias("sheet"), F.col("id").cast("int").alias("row"), F.lit(1).alias("col"), grid.infer(F.concat((F.col("id") * 10).cast("string"), F.lit(""))).alias("v"), F.col("id").alias("version"))
    doubled = grid.Template("Nations", (1, 25), (3, 3), {"x": grid.Cell(0, -2)}, lambda x: multiply(x, 2))
    out = grid.edited(grid.recalculated(cells, [doubled]), [doubled], edits)
    return out.where("col <> 2").select("row", "col", F.col("v.n").alias("n"))


@query
def format_top(spark, d):
    part, v = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), number("p_retailprice")
    out = formats.top(part, v, "top", 5, by=["p_brand"])
    out = formats.against_average(out, v, "above", by=["p_brand"])
    return out.select("p_partkey", "top", "above", formats.cell_is(v, "between", 1000.0, 1200.0).alias("between"))


@query
def format_scales(spark, d):
    customer, v = table(spark, d, "customer").select("c_custkey", "c_acctbal"), number("c_acctbal")
    out = formats.icon_set(formats.data_bar(formats.color_scale(customer, v, "color", ["FF0000", "00FF00"]), v, "bar"), v, "icon", [0, 33, 67])
    return out.select("c_custkey", "color", rounded(F.col("bar"), 6).alias("bar"), F.col("icon").cast("int").alias("icon"))


@query
def format_rules(spark, d):
    """Ten rules as a table, on the balances, nations and segments of customers."""
    customer = table(spark, d, "customer")
    cells = grid.from_table(customer, "C", F.col("c_custkey") + 1, ["c_acctbal", "c_nationkey", "c_mktsegment"])
    last = customer.agg(F.max("c_custkey")).first()[0] + 1
    stops = lambda *given: [{"kind": k, "value": v, "over": False} for k, v in given]
    given = [
        {"rule": "a", "kind": "cellIs", "operator": "lessThan", "v1": "0", "stop_if_true": True},
        {"rule": "b", "kind": "cellIs", "operator": "between", "v1": "1000", "v2": "2000"},
        {"rule": "c", "kind": "top10", "rank": 25},
        {"rule": "d", "kind": "top10", "rank": 10, "percent": True, "bottom": True},
        {"rule": "e", "kind": "aboveAverage"},
        {"rule": "f", "kind": "containsText", "v1": "BUILD", "col": 3},
        {"rule": "g", "kind": "beginsWith", "v1": "A", "col": 3},
        {"rule": "h", "kind": "colorScale", "stops": stops(("min", None), ("max", None)), "colors": ["FF0000", "00FF00"]},
        {"rule": "i", "kind": "dataBar", "stops": stops(("percentile", 10.0), ("max", None))},
        {"rule": "j", "kind": "iconSet", "stops": stops(("percent", 0.0), ("percent", 33.0), ("percent", 67.0)), "col": 2},
    ]
    names = [c.split()[0] for c in rule_tables.RULES.split(", ")]
    rules = spark.createDataFrame([tuple({"priority": i, "style": r["rule"]}.get(n, r.get(n)) for n in names) for i, r in enumerate(given)], rule_tables.RULES)
    targets = spark.createDataFrame([(r["rule"], "C", 1, r.get("col", 1), last, r.get("col", 1)) for r in given], rule_tables.TARGETS)
    out = rule_tables.formatted(cells, rules, targets).select("row", "col", F.explode("formats").alias("f"))
    return out.select("row", "col", "f.rule", "f.color", F.round("f.bar", 6).alias("bar"), "f.icon")


@query
def chart_figures(spark, d):
    customer = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.sum("c_acctbal").alias("value"))
    out = formats.shares(customer, ["c_mktsegment"]).join(formats.extents(customer, ["c_mktsegment"]), "c_mktsegment")
    return out.select("c_mktsegment", "c_nationkey", *[rounded(F.col(c), 6).alias(c) for c in ("share", "low", "high")])


@query
def further_rounding(spark, d):
    x, size = number("c_acctbal"), call("ABS", number("c_acctbal"))
    built = {
        "power": call("POWER", x, 2), "ceiling": call("CEILING", x, 5), "ceiling_math": call("CEILING.MATH", x, 5, 1), "floor": call("FLOOR", size, 5), "floor_precise": call("FLOOR.PRECISE", x, -5),
        "seriessum": call("SERIESSUM", number(F.col("c_acctbal") / 1000), 1, 2, [1, 0.5, 0.25]), "circle": multiply(call("PI"), x), "product": call("PRODUCT", x, 2, 3), "average": call("AGGREGATE", 1, 6, x, 10),
    }
    return _per_row(table(spark, d, "customer"), ["c_custkey"], built, 4)


@query
def random_numbers(spark, d):
    """Volatile functions by the ranges that their values have."""
    drawn, die = call("RAND").column(), call("RANDBETWEEN", 1, number("p_size")).column()
    now, today = call("NOW").column(), call("TODAY").column()
    ranges = {"rand": (drawn >= 0) & (drawn < 1), "between": (die >= 1) & (die <= F.col("p_size")) & (die == F.floor(die)), "now": (now - today >= 0) & (now - today < 1), "today": today == to_serial(F.current_date())}
    return table(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in ranges.items()])


@query
def constants(spark, d):
    """What doesn't depend on a table's rows, or only on what kind of value they hold."""
    n, s = number("n_regionkey"), text("n_name")
    missing = call("NA")
    built = {
        "true": call("TRUE"), "false": call("FALSE"), "ifna": call("IFNA", missing, n), "kept": call("IFNA", n, -1), "row": call("ROW"), "rows": call("ROWS", n), "column": call("COLUMN"), "columns": call("COLUMNS", n),
        "areas": call("AREAS", n, s), "sheet": call("SHEET"), "sheets": call("SHEETS"), "cell": call("CELL", "address", n), "info": call("INFO", "release"), "t": call("T", s), "t_of_number": call("T", n),
        "isref": call("ISREF", n), "isformula": call("ISFORMULA", n), "isblank": call("ISBLANK", text(F.nullif("n_name", F.lit("CHINA")))), "islogical": call("ISLOGICAL", compare(n, ">", 1)), "isnontext": call("ISNONTEXT", n), "text_isnontext": call("ISNONTEXT", s),
    }
    errors = {"na": missing, "formulatext": call("FORMULATEXT", n), "row_of": call("ROW", n)}
    return _per_row(table(spark, d, "nation"), ["n_nationkey"], built, 0).join(table(spark, d, "nation").select("n_nationkey", *[v.error().alias(k) for k, v in errors.items()]), "n_nationkey")


@query
def text_codes(spark, d):
    s, n = text("p_name"), number("p_size")
    built = {
        "concatenate": call("CONCATENATE", s, "-", n), "text": call("TEXT", n, "0"), "char": call("CHAR", number(F.col("p_size") % 26 + 65)), "clean": call("CLEAN", text(F.concat(F.lit("\t"), "p_name", F.lit("\n")))),
        "unicode": call("UNICODE", s), "unichar": call("UNICHAR", number(F.col("p_size") + 944)),
    }
    return _per_row(table(spark, d, "part"), ["p_partkey"], built, 0)


@query
def text_dates(spark, d):
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    clock = F.concat(k % 12 + 1, F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.when(k % 2 == 0, " PM").otherwise(" AM"))
    built = {"datevalue": call("DATEVALUE", text(F.date_format(day, "yyyy-MM-dd"))), "slashes": call("DATEVALUE", text(F.date_format(day, "M/d/yyyy"))), "timevalue": call("TIMEVALUE", text(clock)), "workday": call("WORKDAY.INTL", serial("o_orderdate"), 10, 11)}
    return _per_row(table(spark, d, "orders"), ["o_orderkey"], built, 8)


@query
def row_lookups(spark, d):
    """Lookups in a small array of each row; it has one, two or three columns."""
    x, k = F.col("c_acctbal"), number(F.col("c_nationkey") % 3 + 1)
    one, two, three = (F.lit(float(i)) for i in (1, 2, 3))
    wide, tall = array(F.array(one, two, three, x, x * 2, x * 3)), array(F.array(one, x, two, x * 2, three, x * 3))
    built = {
        "hlookup": call("HLOOKUP", k, wide, 2, False, columns=3), "vlookup": call("VLOOKUP", k, tall, 2, False, columns=2), "index": call("INDEX", wide, 2, k, columns=3),
        "xmatch": call("XMATCH", k, [3, 1, 2]), "smaller": call("XMATCH", 2.5, array(F.array(one, two, three)), -1), "larger": call("XMATCH", 2.5, array(F.array(one, two, three)), 1),
        "transposed": call("ARRAYTOTEXT", call("TRANSPOSE", array(F.array(F.lit("a"), F.col("c_mktsegment"))))), "sortby": call("ARRAYTOTEXT", call("SORTBY", array(F.array(*map(F.lit, "abc"))), array(F.array(k.c, F.lit(2.5), F.lit(1.0))))),
    }
    return _per_row(table(spark, d, "customer"), ["c_custkey"], built, 4)


@query
def further_statistics(spark, d):
    y, x = number("l_extendedprice"), number("l_quantity")
    names = {"STDEV": 6, "STDEVP": 6, "VAR": 5, "VARP": 5}
    figures = [rounded(over(n, x), k).alias(n.lower()) for n, k in names.items()]
    total = rounded(over("AGGREGATE", 9, 6, x), 4).alias("total")
    out = ranking.percentiles(table(spark, d, "lineitem"), y, {"p30": 0.3, "q3": 0.75}, ["l_returnflag"], *figures, total)
    return out.select("l_returnflag", *map(str.lower, names), *[rounded(F.col(c), 4).alias(c) for c in ("p30", "q3")], "total")


@query
def forecasts(spark, d):
    """A line through three points of each row, and quantiles of a normal distribution around one."""
    q, t = F.col("l_quantity"), F.col("l_tax") * 100
    known = array(F.array(q, q + t, q + 2 * t + 3))
    built = {"linear": call("FORECAST.LINEAR", 5, known, [1, 2, 3]), "middle": call("NORM.INV", 0.5, number("l_quantity"), 2), "upper": call("NORM.INV", 0.975, number("l_quantity"), 2)}
    return _per_row(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], built, 4)


@query
def format_stops(spark, d):
    """Scales whose stops are percentiles, numbers and percents, and rules by priority."""
    customer, v = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), number("c_acctbal")
    out = formats.color_scale(customer, v, "color", ["F8696B", "FFEB84", "63BE7B"], ["c_mktsegment"], [("min", None), ("percentile", 50), ("max", None)])
    out = formats.data_bar(out, v, "bar", stops=[("num", 0), ("percent", 90)])
    out = formats.icon_set(out, v, "icon", stops=[("percent", 0), ("percentile", 33), ("percentile", 67, False)])
    rules = [formats.Rule("red", formats.cell_is(v, "lessThan", 0.0), 2), formats.Rule("bold", formats.expression(compare(v, ">", 5000)), 1, True), formats.Rule("blue", formats.cell_is(v, "greaterThan", 4000.0), 3), formats.Rule("plain", formats.cell_is(v, "greaterThan", 3000.0))]
    return formats.applied(out, rules, "styles").select("c_custkey", "color", rounded(F.col("bar"), 6).alias("bar"), F.col("icon").cast("int").alias("icon"), F.array_join("styles", ",").alias("styles"))


@query
def formula_references(spark, d):
    """What formulas of customers' rows read: a cell, a range of another sheet and a growing range."""
    row = (F.col("c_custkey") + 1).cast("int")
    text_ = F.concat(F.lit("VLOOKUP(B"), row.cast("string"), F.lit(",'Na''tions'!$A$1:C25,2)&\"A1\"&SUM(C$1:C"), row.cast("string"), F.lit(")+LOG10(2)"))
    formulas = table(spark, d, "customer").select(F.lit("Customers").alias("sheet"), row.alias("row"), F.lit(4).alias("col"), text_.alias("formula"))
    return references.edges(formulas)


@query
def dependents(spark, d):
    """Orders that depend on order 3 where each row reads the row of half its number."""
    row = (F.col("o_orderkey") + 1).cast("int")
    half = F.floor(row / 2).cast("int")
    cell_ = table(spark, d, "orders").select(F.lit("O").alias("sheet"), row.alias("row"), F.lit(1).alias("col"), half.alias("half")).where("half > 0")
    edges = cell_.select("sheet", "row", "col", F.col("sheet").alias("src_sheet"), F.col("half").alias("r1"), F.lit(1).alias("c1"), F.col("half").alias("r2"), F.lit(1).alias("c2"))
    changed = spark.range(1).select(F.lit("O").alias("sheet"), F.lit(3).alias("row"), F.lit(1).alias("col"))
    return grid.reached(edges, changed).select("row", "col")


@query
def chart_axes(spark, d):
    """Points of charts from arrays of unequal length, and the ticks of their axes."""
    customer = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.sum("c_acctbal").alias("value"))
    charts = customer.groupBy("c_mktsegment").agg(F.array_sort(F.collect_list(F.struct("c_nationkey", "value"))).alias("p"))
    arrays_ = charts.select("c_mktsegment", F.slice(F.col("p.c_nationkey"), 1, 10).cast("array<string>").alias("names"), F.slice(F.col("p.value"), 1, 12).alias("values"))
    points = formats.series(arrays_, ["c_mktsegment"], "names", "values")
    ticks = formats.axis_ticks(formats.extents(points, ["c_mktsegment"]), ["c_mktsegment"], 4)
    return points.select("c_mktsegment", F.lit("point").alias("kind"), F.col("point").alias("i"), F.col("category").alias("text"), rounded(F.col("value"), 2).alias("value")).unionByName(
        ticks.select("c_mktsegment", F.lit("tick").alias("kind"), F.col("tick").alias("i"), F.regexp_extract("label", "[KM]?$", 0).alias("text"), rounded(F.col("value"), 2).alias("value"))
    )


@query
def text_rules(spark, d):
    """Text rules of conditional formats, and tints of a colour, by part."""
    name = text("p_name")
    rules = {k: formats.text_is(name, rule, part) for k, (rule, part) in {"has": ("containsText", "er"), "lacks": ("notContainsText", "er"), "begins": ("beginsWith", "b"), "ends": ("endsWith", "n")}.items()}
    tint = F.col("p_size") / 50.0 - 0.5
    return table(spark, d, "part").select("p_partkey", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in rules.items()], formats.tinted(F.lit("4080C0"), tint).alias("tinted"))


@query
def custom_functions(spark, d):
    """Functions of one's own, over a row and over a table, one by a name in another language."""
    register_function("markup", lambda price, share: multiply(price, add(1, share)), over=lambda price: over("AVERAGE", multiply(price, 2)))
    register_names({"AUFSCHLAG": "MARKUP", "RUNDEN": "ROUND"})
    part, price = table(spark, d, "part"), number("p_retailprice")
    means = part.groupBy("p_brand").agg(rounded(over("Markup", price), 4).alias("mean"))
    return part.select("p_partkey", "p_brand", rounded(call("runden", call("aufschlag", price, 0.25), 1), 1).alias("marked")).join(means, "p_brand").select("p_partkey", "marked", "mean")
