"""Rules and targets as tables against a loop over every cell of every target."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom import values
from gridloom.operators import grid, ranking, rule_tables

EMPTY = dict.fromkeys(("priority", "style", "operator", "v1", "v2", "rank", "colors", "stops"))


def rule(name, kind, **more):
    return EMPTY | {"rule": name, "kind": kind, "style": name, "stop_if_true": False, "percent": False, "bottom": False, "below": False, "equal": False} | more


def stops(*given):
    return [{"kind": k, "value": v, "over": over} for k, v, over in given]


RULES = [
    rule("r01", "cellIs", operator="greaterThan", v1="3", priority=5),
    rule("r02", "cellIs", operator="between", v1="-2", v2="2", priority=4),
    rule("r03", "cellIs", operator="equal", v1="text", priority=3, stop_if_true=True),
    rule("r04", "containsText", v1="ex", priority=9),
    rule("r05", "notContainsText", v1="ex"),
    rule("r06", "top10", rank=3, priority=1),
    rule("r07", "top10", rank=40, percent=True, bottom=True, priority=2),
    rule("r08", "aboveAverage", priority=6),
    rule("r09", "aboveAverage", below=True, equal=True, priority=6),
    rule("r10", "colorScale", colors=["FF0000", "FFFF00", "00FF00"], stops=stops(("min", None, False), ("percentile", 50.0, False), ("max", None, False)), priority=7),
    rule("r11", "colorScale", colors=["000000", "0000FF"], stops=stops(("num", 0.0, False), ("percent", 80.0, False)), priority=8),
    rule("r12", "dataBar", stops=stops(("percentile", 10.0, False), ("max", None, False)), priority=10),
    rule("r13", "iconSet", stops=stops(("percent", 0.0, False), ("percent", 33.0, True), ("percentile", 67.0, False)), priority=11),
    rule("r14", "expression", v1="TRUE", priority=12),
    rule("r15", "expression", v1="A1>2", priority=12),
    rule("r16", "beginsWith", v1="t", priority=13),
    rule("r17", "top10", rank=1000, priority=14),
]


def number(v):
    if v is None:
        return 0.0
    try:
        return float(v) if v != "" else 0.0
    except ValueError:
        return None


def by_hand(values, rules, targets):
    out = {}
    for r in rules:
        places = {(s, i, j) for n, s, a, b, c, d in targets if n == r["rule"] for i in range(a, c + 1) for j in range(b, d + 1)}
        xs = sorted(x for x in (number(values.get(p)) for p in places) if x is not None)
        place = lambda p: xs[min(max(math.ceil((len(xs) - 1) * p / 100), 0), len(xs) - 1)]
        at = [xs[0] if s["kind"] == "min" else xs[-1] if s["kind"] == "max" else xs[0] + (xs[-1] - xs[0]) * s["value"] / 100 if s["kind"] == "percent" else place(s["value"]) if s["kind"] == "percentile" else s["value"] for s in r["stops"] or []]
        for p in places & values.keys():
            v = values[p]
            x, s, found = number(v), str(int(v)) if isinstance(v, float) and v == int(v) else str(v), {"color": None, "bar": None, "icon": None}
            k, ok = r["kind"], False
            a, b = number(r["v1"]), number(r["v2"])
            if k == "cellIs":
                n = x is not None and a is not None
                ok = {"greaterThan": n and x > a, "between": n and a <= x <= b, "equal": x == a if n else s == r["v1"]}[r["operator"]]
            elif k == "top10":
                count = min(max(math.ceil(len(xs) * r["rank"] / 100) if r["percent"] else r["rank"], 1), len(xs))
                ok = x is not None and (x <= xs[count - 1] if r["bottom"] else x >= xs[-count])
            elif k == "aboveAverage":
                mean = sum(xs) / len(xs)
                ok = x is not None and (x < mean if r["below"] else x > mean) or (r["equal"] and x == mean)
            elif k == "expression":
                ok = r["v1"] == "TRUE"
            elif k in ("containsText", "notContainsText"):
                ok = (r["v1"] in s) == (k == "containsText")
            elif k == "beginsWith":
                ok = s.startswith(r["v1"])
            elif x is not None:
                share = lambda lo, hi: min(1, max(0, (x - lo) / (hi - lo))) if hi != lo else 1.0
                mix = lambda c, d, t: "".join(f"{math.floor(int(c[i : i + 2], 16) + t * (int(d[i : i + 2], 16) - int(c[i : i + 2], 16)) + 0.5):02X}" for i in (0, 2, 4))
                ok = True
                if k == "colorScale":
                    c = r["colors"]
                    found["color"] = c[-1] if at[0] == at[-1] else mix(c[0], c[1], share(at[0], at[-1])) if len(c) == 2 else mix(c[0], c[1], share(at[0], at[1])) if x <= at[1] else mix(c[1], c[2], share(at[1], at[2]))
                elif k == "dataBar":
                    found["bar"] = share(at[0], at[-1]) * 100
                else:
                    found["icon"] = max([0] + [i for i, (t, z) in enumerate(zip(r["stops"], at, strict=True)) if (x > z if t["over"] else x >= z)])
            if ok:
                out.setdefault(p, []).append((math.inf if r["priority"] is None else r["priority"], r["rule"], r["stop_if_true"], found))
    for p, found in out.items():
        found.sort(key=lambda f: f[:2])
        stop = next((i for i, f in enumerate(found) if f[2]), len(found))
        out[p] = [(f[1], f[3]["color"], f[3]["bar"], f[3]["icon"]) for f in found[: stop + 1]]
    return out


@pytest.mark.parametrize("ranges", [256, 2])
def test_rules(spark, monkeypatch, ranges):
    monkeypatch.setattr(rule_tables, "RANGES", ranges)
    rng = random.Random(5)
    values = {("S", r, c): rng.choice([float(rng.randrange(-9, 9)), 0.5, "text", "next", "7"]) for r in range(1, 40) for c in range(1, 6) if rng.random() < 0.6}
    values |= {("T", 1, 1): 4.0}
    targets = [(r["rule"], "S", a, b, a + rng.randrange(12), b + rng.randrange(3)) for r in RULES for a, b in [(rng.randrange(1, 25), rng.randrange(1, 4)) for _ in range(2)]]
    targets += [("r01", "T", 1, 1, 1, 1), ("none", "S", 1, 1, 9, 9)]
    cells = spark.createDataFrame([(*p, ("n", v, None, None, None) if isinstance(v, float) else ("s", None, v, None, None)) for p, v in values.items()], grid.CELLS)
    names = [c.split()[0] for c in rule_tables.RULES.split(", ")]
    rules = spark.createDataFrame([tuple(r[n] for n in names) for r in RULES], rule_tables.RULES)
    out = rule_tables.formatted(cells, rules, spark.createDataFrame(targets, rule_tables.TARGETS)).collect()
    got = {(r.sheet, r.row, r.col): [(f.rule, f.color, f.bar and round(f.bar, 9), f.icon) for f in r.formats] for r in out}
    want = {p: [(a, c, b and round(b, 9), i) for a, c, b, i in found] for p, found in by_hand(values, RULES, targets).items()}
    assert got == want
    assert rule_tables.formatted(cells.limit(0), rules, spark.createDataFrame(targets, rule_tables.TARGETS)).count() == 0
    assert rule_tables.formatted(cells, rules.limit(0), spark.createDataFrame([], rule_tables.TARGETS)).count() == 0


def test_covered():
    rng = random.Random(7)
    for _ in range(50):
        areas = [{"sheet": rng.choice("ST"), "r1": a, "c1": b, "r2": a + rng.randrange(-1, 6), "c2": b + rng.randrange(6)} for a, b in [(rng.randrange(9), rng.randrange(9)) for _ in range(5)]]
        assert rule_tables.covered(areas) == len({(x["sheet"], r, c) for x in areas for r in range(x["r1"], x["r2"] + 1) for c in range(x["c1"], x["c2"] + 1)})
    assert rule_tables.covered([{"sheet": "S", "r1": 1, "c1": 1, "r2": 2**31 - 2, "c2": 2}]) == 2 * (2**31 - 2)


def test_weighted_places_in_two_ranges(spark):
    rows = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", 1.0, 2), ("b", 5.0, 4)], "rule string, x double, n int")
    got = {tuple(r) for r in ranking.value_counts(rows, values.number("x"), ["rule"], F.col("n"), 2).collect()}
    assert got == {("a", 1.0, 5, 0, 6), ("a", 2.0, 1, 5, 6), ("b", 5.0, 4, 0, 4)}
