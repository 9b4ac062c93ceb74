"""A part of the library's queries against their SQL at the smallest size."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gridloom.operators import formats, lookup, ranking
from gridloom.plans.oracle import ORACLE_SQL
from gridloom.plans.queries import QUERIES
from gridloom.values import number

D = "/root/testdata/sf0.001"
NAMES = ["sumifs_by_segment", "conditional_aggregates", "plain_aggregates", "vlookup_exact", "lookup_approximate", "match_next", "xlookup_wildcard", "index_match", "sumifs_per_row", "rank_table", "trimmed_mean", "frequency_bins", "operators_arithmetic", "text_numbers", "dates", "conditions", "grid_recalculation", "grid_edits", "format_top", "arrays", "further_rounding", "random_numbers", "constants", "text_codes", "text_dates", "row_lookups", "further_statistics", "forecasts", "format_scales", "format_stops", "running_ranges", "running_balance", "merged_areas", "workbook_round_trip", "shared_string_numbers", "format_rules", "rates", "normal_approximations", "formula_references", "dependents", "chart_axes", "text_rules", "custom_functions", "annuities"]


def shown(value):
    """One form for null and for numbers, which pandas reads as floats beside nulls."""
    if isinstance(value, str | bool):
        return value
    return None if pd.isna(value) else float(value)


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    got = QUERIES[name](spark, D).toPandas()
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    want = con.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(repr([shown(v) for v in r]) for r in x[columns].itertuples(index=False, name=None)) for x in (got, want)]
    assert rows[0] == rows[1]


def test_exact_takes_the_first_of_equal_keys(spark):
    left = spark.createDataFrame([(1,), (2,)], "k long")
    right = spark.createDataFrame([(1, "b", 2), (1, "a", 5), (3, "c", 1)], "k long, v string, at long")
    get = lambda **more: sorted((r.k, r.found_v) for r in lookup.exact(left, number("k"), right, number("k"), ["v"], **more).collect())
    assert get() == [(1, "a"), (2, None)]
    assert get(position="at") == [(1, "b"), (2, None)] and get(position="at", last=True) == [(1, "a"), (2, None)]


def test_scales_of_few_values(spark):
    """Equal outer stops, a formula's stop, no rules and an empty table."""
    rows = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "k long, v double")
    v = number("v")
    get = lambda df, c: {r.k: r[c] for r in df.collect()}
    assert get(formats.color_scale(rows.where("v is not null"), v, "c", ["000000", "0000FF"]), "c") == {1: "0000FF", 2: "0000FF"}
    assert get(formats.data_bar(rows.where("k < 3"), v, "c"), "c") == {1: 100.0, 2: 100.0}
    assert get(formats.icon_set(rows.where("k < 3"), v, "c", stops=[("num", 0), ("formula", F.col("k") + 3.5)]), "c") == {1: 1, 2: 0}
    assert formats.color_scale(rows.where("false"), v, "c", ["000000", "0000FF"], stops=[("percentile", 10), ("max", None)]).count() == 0
    assert get(formats.applied(rows, [], "c"), "c") == {1: [], 2: [], 3: []}


def test_formats_of_a_null_group(spark):
    rows = spark.createDataFrame([(1, None, 1.0), (2, None, 3.0), (3, "a", 7.0), (4, "a", 2.0)], "k long, g string, v double")
    v = number("v")
    get = lambda df: {r.k: r.c for r in df.collect()}
    assert get(formats.top(rows, v, "c", 1, by=["g"])) == {1: False, 2: True, 3: True, 4: False}
    assert get(formats.against_average(rows, v, "c", by=["g"])) == {1: False, 2: True, 3: True, 4: False}
    assert get(formats.icon_set(rows, v, "c", by=["g"], stops=[("min", None), ("percentile", 100)])) == {1: 0, 2: 1, 3: 1, 4: 0}


def test_percentiles_of_ranges(spark):
    """Groups (a null one too) against Spark's own, without an aggregate that holds a group's values at once."""
    rows = [("a", float(k * k % 97)) for k in range(200)] + [(None, 3.0), (None, 5.0), ("b", 1.5), ("c", 2.0), ("c", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = {"low": 0.0, "q1": 0.25, "p30": 0.3, "top": 1.0}
    got = ranking.percentiles(df, number("x"), shares, ["g"], F.count("*").alias("n"))
    want = df.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile("x", F.lit(p)).alias(c) for c, p in shares.items()])
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    for name in ("shape_statistics", "further_statistics"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan
