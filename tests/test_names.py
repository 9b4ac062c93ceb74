"""Columns of a user's own with the names that operators use inside, and null groups."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import formats, lookup, ranking
from gridloom.values import number, text

OWN = ["_key", "_want", "_hit", "_v", "_edge", "_mean", "_m", "_s", "_low", "_high", "_stop0", "_total", "_place", "_at", "_k", "_k0", "_by0", "_row"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(1, None, 1.0, "ab"), (2, None, 3.0, "b"), (3, "a", 7.0, "abc"), (4, "a", 2.0, None)], "k long, g string, x double, s string")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(OWN)]).cache()


def test_own_columns_stay(rows, spark):
    v = number("x")
    table = spark.createDataFrame([(1.0, "one", 1), (3.0, "three", 2)], "n double, name string, p long")
    found = {
        "exact": (lookup.exact(rows, v, table, number("n"), ["name"]), "found_name", {1: "one", 2: "three", 3: None, 4: None}),
        "exists": (lookup.exists(rows, v, table, number("n")), "x", {1: 1.0, 2: 3.0}),
        "nearest": (lookup.nearest(rows, v, table, number("n"), ["name"]), "found_name", {1: "one", 2: "three", 3: "three", 4: "one"}),
        "patterns": (lookup.patterns(rows, text("s"), table, text("name"), ["p"], position="p"), "found_p", {1: None, 2: None, 3: None, 4: None}),
        "at": (lookup.at_position(rows, F.col("k"), table, "p", ["name"]), "found_name", {1: "one", 2: "three", 3: None, 4: None}),
        "grouped": (lookup.grouped_onto(rows, ["x"], table, ["n"], total=number(F.sum("p"))), "total", {1: 1.0, 2: 2.0, 3: 0.0, 4: 0.0}),
        "rank": (ranking.rank(rows, v, "out"), "out", {1: 4.0, 2: 2.0, 3: 1.0, 4: 3.0}),
        "top": (formats.top(rows, v, "out", 1), "out", {1: False, 2: False, 3: True, 4: False}),
        "bottom": (formats.top(rows, v, "out", 50, percent=True, bottom=True), "out", {1: True, 2: False, 3: False, 4: True}),
        "top by": (formats.top(rows, v, "out", 1, by=["g"]), "out", {1: False, 2: True, 3: True, 4: False}),
        "average": (formats.against_average(rows, v, "out", by=["g"]), "out", {1: False, 2: True, 3: True, 4: False}),
        "bar": (formats.data_bar(rows, v, "out"), "out", {1: 0.0, 2: 100 / 3, 3: 100.0, 4: 100 / 6}),
        "icon": (formats.icon_set(rows, v, "out", stops=[("min", None), ("percentile", 100)], by=["g"]), "out", {1: 0, 2: 1, 3: 1, 4: 0}),
        "scale": (formats.color_scale(rows, v, "out", ["000000", "0000FF"], by=["g"]), "out", {1: "000000", 2: "0000FF", 3: "0000FF", 4: "000000"}),
        "share": (formats.shares(rows.withColumn("value", F.col("x")), ["g"]), "share", {1: 0.25, 2: 0.75, 3: 7 / 9, 4: 2 / 9}),
        "standard": (ranking.standardized(rows, v, "out", ["g"]), "out", {1: -(0.5**0.5), 2: 0.5**0.5, 3: 0.5**0.5, 4: -(0.5**0.5)}),
    }
    for name, (df, column, want) in found.items():
        got = {r.k: r for r in df.collect()}
        assert got.keys() == want.keys(), name
        for k, r in got.items():
            assert [r[c] for c in OWN] == list(range(len(OWN))), name
            assert r[column] == (pytest.approx(want[k]) if isinstance(want[k], float) else want[k]), (name, k)


def test_patterns_by_start(spark):
    texts = ["alpha", "ALPHABET", "beta", "al", "İab", "İabcdef", "", "a.c", "abc"]
    asks = ["al*", "AL?HA", "*a", "?eta", "beta", "İab*", "a.c", "", "alphabet?", "*"]
    table = spark.createDataFrame(list(enumerate(texts)), "p long, t string")
    left = spark.createDataFrame([(a,) for a in asks], "a string")
    got = {r.a: r.found_t for r in lookup.patterns(left, text("a"), table, text("t"), ["t"], position="p").collect()}
    assert got == {"al*": "alpha", "AL?HA": "alpha", "*a": "alpha", "?eta": "beta", "beta": "beta", "İab*": "İab", "a.c": "a.c", "": "", "alphabet?": None, "*": "alpha"}
