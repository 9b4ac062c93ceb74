"""Dates as serial numbers: day 0 is 1899-12-31 and day 60 is the 29 February 1900 that never was."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import NUM, VALUE, Value, finite, let, num, num0, result, text_of
from .registry import row

_C = "date"
_EPOCH, _GHOST = "1899-12-31", 60


def to_serial(day: Column) -> Column:
    """Serial of a date column."""
    days = F.date_diff(day, F.lit(_EPOCH).cast("date"))
    return (days + (days >= _GHOST).cast("int")).cast("double")


def from_serial(n: Column) -> Column:
    """Date of a serial; null below 0. The day that never was is 1 March here."""
    day = F.floor(n)
    return F.when(day >= 0, F.date_add(F.lit(_EPOCH).cast("date"), (day - (day > _GHOST).cast("int")).cast("int")))


def _year(n: Column) -> Column:
    return F.year(from_serial(n))


def _month(n: Column) -> Column:
    return F.when(F.floor(n) == _GHOST, 2).otherwise(F.month(from_serial(n)))


def _day(n: Column) -> Column:
    return F.when(F.floor(n) == _GHOST, 29).otherwise(F.dayofmonth(from_serial(n)))


def _whole(v: Value) -> Column:
    """Towards zero; null beyond 32 bits."""
    return finite(v).try_cast("int")


def serial_of(y: Column, m: Column, d: Column) -> Column:
    """Serial of year, month and day, any of which may overflow."""
    first = F.add_months(F.make_date(F.when((y >= 0) & (y <= 1899), y + 1900).otherwise(y), F.lit(1), F.lit(1)), m - 1)
    return F.when((y.isin(0, 1900)) & (m == 2) & (d == 29), F.lit(60.0)).otherwise(to_serial(F.date_add(first, d - 1)))


@row("DATE", category=_C, args="year, month, day")
def date(year, month, day):
    y, m, d = _whole(year), _whole(month), _whole(day)
    bad = y.isNull() | m.isNull() | d.isNull() | (y < 0) | (y > 9999)
    return result("number", serial_of(F.when(~bad, y), m, d), (bad, VALUE))


def _part(name, f, args="serial_number"):
    @row(name, category=_C, args=args)
    def build(v):
        n = finite(v)
        return result("number", f(n).cast("double"), (n.isNull() | (n < 0), VALUE))


def _clock(n: Column, per_day: int, wrap: int) -> Column:
    return F.floor((n - F.floor(n)) * per_day) % wrap


_part("YEAR", _year)
_part("MONTH", _month)
_part("DAY", _day)
_part("HOUR", lambda n: _clock(n, 24, 24))
_part("MINUTE", lambda n: _clock(n, 1440, 60))
_part("SECOND", lambda n: _clock(n, 86400, 60))
_part("ISOWEEKNUM", lambda n: F.weekofyear(from_serial(n)), "date")


@row("TODAY", category=_C, args="")
def today():
    return Value("number", to_serial(F.current_date()))


@row("NOW", category=_C, args="")
def now():
    t = F.current_timestamp()
    return Value("number", to_serial(F.to_date(t)) + (F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))) / 86400.0)


@row("TIME", category=_C, args="hour, minute, second")
def time(h, m, s):
    total = num0(h) * 3600 + num0(m) * 60 + num0(s)
    return result("number", (total % 86400) / 86400, (total < 0, NUM))


def _two(start: Value, end: Value):
    a, b = finite(start), finite(end)
    return a, b, (a.isNull() | b.isNull() | (a < 0) | (b < 0), VALUE)


@row("DATEDIF", category=_C, args="start_date, end_date, unit")
def datedif(start, end, unit):
    a, b, bad = _two(start, end)
    u = F.upper(text_of(unit))
    out = let(F.struct(a.alias("a"), b.alias("b")), lambda p: _apart(p["a"], p["b"], u))
    return result("number", out, bad, (a > b, NUM), (out.isNull(), NUM))


def _apart(a: Column, b: Column, u: Column) -> Column:
    short = (_day(b) < _day(a)).cast("int")
    months = (_year(b) - _year(a)) * 12 + _month(b) - _month(a) - short
    before = F.dayofmonth(F.last_day(F.add_months(from_serial(b), -1)))
    rest = _day(b) - _day(a)
    this_year = serial_of(_year(b), _month(a), _day(a))
    last_year = serial_of(_year(b) - 1, _month(a), _day(a))
    out = (
        F.when(u == "Y", F.floor(months / 12))
        .when(u == "M", months)
        .when(u == "D", F.floor(b) - F.floor(a))
        .when(u == "MD", F.when(rest < 0, rest + before).otherwise(rest))
        .when(u == "YM", F.pmod(months, F.lit(12)))
        .when(u == "YD", F.when(this_year > F.floor(b), F.floor(b) - last_year).otherwise(F.floor(b) - this_year))
    )
    return out.cast("double")


@row("DATEVALUE", category=_C, args="date_text")
def datevalue(v):
    s = F.trim(text_of(v))
    day = F.coalesce(*[F.to_date(F.try_to_timestamp(F.regexp_replace(s, r"[T ].*$", ""), F.lit(f))) for f in ("yyyy-M-d", "M/d/yyyy", "yyyy/M/d")])
    return result("number", to_serial(day), (day.isNull(), VALUE))


@row("TIMEVALUE", category=_C, args="time_text")
def timevalue(v):
    s = F.upper(F.trim(text_of(v)))
    pattern = r"^(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s*(AM|PM))?$"
    part = lambda i: F.coalesce(F.regexp_extract(s, pattern, i).try_cast("int"), F.lit(0))
    half = F.regexp_extract(s, pattern, 4)
    hour = F.when((half == "PM") & (part(1) < 12), part(1) + 12).when((half == "AM") & (part(1) == 12), 0).otherwise(part(1))
    return result("number", (hour * 3600 + part(2) * 60 + part(3)) / 86400.0, (~s.rlike(pattern), VALUE))


@row("DAYS", category=_C, args="end_date, start_date")
def days(end, start):
    a, b = finite(start), finite(end)
    return result("number", (F.floor(b) - F.floor(a)).cast("double"), (a.isNull() | b.isNull(), VALUE))


def _days360(a: Column, b: Column, european) -> Column:
    d1, d2 = _day(a), _day(b)
    first = F.least(d1, F.lit(30))
    last = F.when(european | (d1 >= 30), F.least(d2, F.lit(30))).otherwise(d2)
    return (_year(b) - _year(a)) * 360 + (_month(b) - _month(a)) * 30 + last - first


@row("DAYS360", category=_C, args="start_date, end_date, [method]")
def days360(start, end, method=None):
    a, b, bad = _two(start, end)
    return result("number", _days360(a, b, F.lit(False) if method is None else num0(method) != 0).cast("double"), bad)


def _moved(name, last: bool):
    @row(name, category=_C, args="start_date, months")
    def build(start, months):
        n, m = finite(start), _whole(months)
        day = F.add_months(from_serial(n), m)
        return result("number", to_serial(F.last_day(day) if last else day), (n.isNull() | m.isNull() | (n < 0), VALUE))


_moved("EDATE", False)
_moved("EOMONTH", True)


@row("WEEKDAY", category=_C, args="serial_number, [return_type]")
def weekday(v, kind=None):
    n, k = finite(v), F.lit(1.0) if kind is None else num0(kind)
    sunday = F.dayofweek(from_serial(n)) - 1
    out = F.when(k == 1, sunday + 1).when(k == 2, F.pmod(sunday - 1, F.lit(7)) + 1).when(k == 3, F.pmod(sunday - 1, F.lit(7)))
    return result("number", out.cast("double"), (n.isNull() | (n < 0), VALUE), (out.isNull(), NUM))


@row("WEEKNUM", category=_C, args="serial_number, [return_type]")
def weeknum(v, kind=None):
    n = finite(v)
    day = from_serial(n)
    lead = F.dayofweek(F.trunc(day, "year")) - 1
    if kind is not None:
        lead = F.when(num0(kind) == 2, F.pmod(lead - 1, F.lit(7))).otherwise(lead)
    return result("number", (F.floor((F.dayofyear(day) - 1 + lead) / 7) + 1).cast("double"), (n.isNull() | (n < 0), VALUE))


@row("YEARFRAC", category=_C, args="start_date, end_date, [basis]")
def yearfrac(start, end, basis=None):
    x, y, bad = _two(start, end)
    k = F.lit(0.0) if basis is None else num0(basis)
    out = let(F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")), lambda p: _year_share(p["a"], p["b"], k))
    return result("number", out, bad, (out.isNull(), NUM))


def _year_share(a: Column, b: Column, k: Column) -> Column:
    apart = F.floor(b) - F.floor(a)
    years = _year(b) - _year(a) + 1
    in_years = F.date_diff(F.make_date(_year(b) + 1, F.lit(1), F.lit(1)), F.make_date(_year(a), F.lit(1), F.lit(1)))
    out = (
        F.when(k == 0, _days360(a, b, F.lit(False)) / 360)
        .when(k == 1, apart / (in_years / years))
        .when(k == 2, apart / 360)
        .when(k == 3, apart / 365)
        .when(k == 4, _days360(a, b, F.lit(True)) / 360)
    )
    return out.cast("double")


#: Days off by weekend code, Sunday as 0 (fixed values).
_WEEKENDS = {1: (0, 6), 2: (0, 1), 3: (1, 2), 4: (2, 3), 5: (3, 4), 6: (4, 5), 7: (5, 6), 11: (0,), 12: (1,), 13: (2,), 14: (3,), 15: (4,), 16: (5,), 17: (6,)}


def _mask(weekend: Value | None) -> Column:
    """Seven characters from Sunday on, 1 for a day off."""
    usual = "1000001"
    if weekend is None:
        return F.lit(usual)
    shown = {k: "".join("1" if d in days else "0" for d in range(7)) for k, days in _WEEKENDS.items()}
    codes = F.create_map(*[F.lit(x) for k, m in shown.items() for x in (k, m)])
    code = codes[F.coalesce(num(weekend).cast("int"), F.lit(0))]
    if weekend.kind == "number":
        return F.coalesce(code, F.lit(usual))
    s = text_of(weekend)
    return F.when(F.length(s) == 7, F.concat(F.substring(s, 7, 1), F.substring(s, 1, 6))).otherwise(F.coalesce(code, F.lit(usual)))


def _weekday_of(n: Column) -> Column:
    return F.dayofweek(from_serial(n)) - 1


def _work_before(n: Column, mask: Column) -> Column:
    """Working days among the serials from 0 to before n: whole weeks and the rest of one."""
    per_week = 7 - F.regexp_count(mask, F.lit("1"))
    week = F.concat(mask, mask)
    start = _weekday_of(F.lit(0.0))
    rest = F.substring(week, start + 1, F.pmod(n, F.lit(7)).cast("int"))
    return F.floor(n / 7) * per_week + F.length(rest) - F.regexp_count(rest, F.lit("1"))


def _network(start, end, weekend, holiday):
    """A closed form: week arithmetic instead of a walk over the days. Day 60 repeats the weekday
    of day 61, which is added where the span holds it."""
    a, b = finite(start), finite(end)
    low, high = F.floor(F.least(a, b)), F.floor(F.greatest(a, b))
    mask = _mask(weekend)
    real = lambda n: n - (n > 60).cast("long")
    off = lambda n: F.substring(mask, _weekday_of(n) + 1, 1) == "1"
    ghost = ((low <= 60) & (high >= 60) & ~off(F.lit(60.0))).cast("long")
    n = _work_before(F.greatest(real(high), F.lit(-1)) + 1 - ((high == 60)).cast("long"), mask) - _work_before(F.greatest(real(low), F.lit(0)) , mask) + ghost
    if holiday is not None:
        h = finite(holiday)
        n = n - F.coalesce((F.floor(h) >= low) & (F.floor(h) <= high) & ~off(h), F.lit(False)).cast("long")
    return result("number", (F.when(a <= b, 1).otherwise(-1) * n).cast("double"), (a.isNull() | b.isNull(), VALUE))


row("NETWORKDAYS", category=_C, args="start_date, end_date, [holidays]")(lambda start, end, holidays=None: _network(start, end, None, None))


@row("NETWORKDAYS.INTL", category=_C, args="start_date, end_date, [weekend], [holidays]")
def networkdays_intl(start, end, weekend=None, holidays=None):
    return _network(start, end, weekend, holidays)


def _step(start, count, weekend, holiday):
    """Day by day within the weeks that the count surely spans."""
    a, n = F.floor(finite(start)), _whole(count)
    mask = _mask(weekend)
    per_week = F.greatest(7 - F.regexp_count(mask, F.lit("1")), F.lit(1))
    reach = F.ceil(F.abs(n) / per_week) * 7 + 14
    step = F.when(n > 0, 1).otherwise(-1)
    days = F.transform(F.sequence(F.lit(1), F.coalesce(reach.cast("int"), F.lit(1))), lambda i: a + i * step)
    worked = F.filter(days, lambda d: (F.substring(mask, _weekday_of(d) + 1, 1) != "1") & ((d != F.floor(finite(holiday))) if holiday is not None else F.lit(True)))
    out = F.when(n == 0, a).otherwise(F.try_element_at(worked, F.when(n == 0, 1).otherwise(F.abs(n))))
    return result("number", out.cast("double"), (a.isNull() | n.isNull() | out.isNull() | (out < 0), VALUE))


row("WORKDAY", category=_C, args="start_date, days, [holidays]")(lambda start, count, holidays=None: _step(start, count, None, None))


@row("WORKDAY.INTL", category=_C, args="start_date, days, [weekend], [holidays]")
def workday_intl(start, count, weekend=None, holidays=None):
    return _step(start, count, weekend, holidays)
