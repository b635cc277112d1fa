"""Date and time functions over date and timestamp columns, with serial numbers where a number is due."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import FUNCTIONS, Cell, bad, day, function, guarded, merged, number
from .math import truncated

BASE = "1899-12-30"


def serial(d: Column) -> Column:
    """Day number: 1 is 1900-01-01, with the fictitious 1900-02-29 as 60."""
    n = F.datediff(d, F.lit(BASE).cast("date"))
    return F.when(n <= 60, n - 1).otherwise(n).cast("double")


def from_serial(n: Column) -> Column:
    k = F.floor(n).cast("int")
    return F.date_add(F.lit(BASE).cast("date"), F.when(k < 60, k + 1).otherwise(k))


@function("SERIAL", "v")
def serial_of(x):
    """Serial number of a date or timestamp, the time of day as its fraction."""
    t = x.cast("timestamp")
    seconds = (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / 86400
    return F.when(F.typeof(x) == "date", serial(x.cast("date"))).otherwise(serial(x.cast("date")) + seconds)


@function("FROMSERIAL", "n")
def serial_date(n):
    return guarded(from_serial(n), bad(((n < 0) | (n >= 2958466), "#NUM!")))


@function("DATE", "n n n")
def date(y, m, d):
    """Months and days roll over; years below 1900 count from 1900."""
    year = F.when(truncated(y) < 1900, truncated(y) + 1900).otherwise(truncated(y))
    months = ((year - 1900) * 12 + truncated(m) - 1).cast("int")
    wrong = (truncated(y) < 0) | (year > 9999) | (months < 0) | (months > 97199)
    first = F.add_months(F.lit("1900-01-01").cast("date"), F.when(wrong, 0).otherwise(months))
    return guarded(F.date_add(first, (truncated(d) - 1).cast("int")), bad((wrong, "#NUM!")))


function("TODAY")(lambda: F.current_date())
function("NOW")(lambda: F.current_timestamp())
function("YEAR", "d")(lambda d: F.year(d).cast("double"))
function("MONTH", "d")(lambda d: F.month(d).cast("double"))
function("DAY", "d")(lambda d: F.dayofmonth(d).cast("double"))


def _clock(name: str, f) -> None:
    @function(name, "v")
    def body(x):
        """A timestamp, or a serial number rounded to seconds."""
        seconds = F.when(F.typeof(x).isin("timestamp", "timestamp_ntz"), F.hour(x.cast("timestamp")) * 3600 + F.minute(x.cast("timestamp")) * 60 + F.second(x.cast("timestamp")))
        return f(seconds).cast("double")

    def call(x):
        if isinstance(x, (int, float)):
            return Cell(f(F.lit(round((x % 1) * 86400) % 86400)).cast("double"))
        return body(x)

    FUNCTIONS[name] = call


_clock("HOUR", lambda s: F.floor(s / 3600))
_clock("MINUTE", lambda s: F.floor(s / 60) % 60)
_clock("SECOND", lambda s: s % 60)


@function("TIME", "n n n")
def time(h, m, s):
    total = truncated(h) * 3600 + truncated(m) * 60 + truncated(s)
    return guarded((total % 86400) / 86400, bad((total < 0, "#NUM!")))


@function("DATEVALUE", "t")
def datevalue(s):
    formats = ("yyyy-M-d", "M/d/yyyy", "d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyy/M/d")
    found = F.coalesce(*[F.call_function("try_to_date", F.trim(s), F.lit(f)) for f in formats])
    return guarded(serial(found), bad((found.isNull(), "#VALUE!")))


@function("TIMEVALUE", "t")
def timevalue(s):
    formats = ("H:mm", "H:mm:ss", "h:mm a", "h:mm:ss a")
    found = F.coalesce(*[F.call_function("try_to_timestamp", F.trim(s), F.lit(f)) for f in formats])
    return guarded((F.hour(found) * 3600 + F.minute(found) * 60 + F.second(found)) / 86400, bad((found.isNull(), "#VALUE!")))


@function("DAYS", "d d")
def days(end, start):
    return F.datediff(end, start).cast("double")


@function("EDATE", "d n")
def edate(d, months):
    return F.add_months(d, truncated(months).cast("int"))


@function("EOMONTH", "d n")
def eomonth(d, months):
    return F.last_day(F.add_months(d, truncated(months).cast("int")))


def full_months(a: Column, b: Column) -> Column:
    """Whole months from a to b, b not before a; a month is whole when the day of the month is reached."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - (F.dayofmonth(b) < F.dayofmonth(a)).cast("int")


def datedif(start, end, unit: str) -> Cell:
    a, b = day(start), day(end)
    x, y = a.value, b.value
    months = full_months(x, y)
    # The last monthly turn before the end, and the last yearly one, for what is left over.
    turn = F.when(F.dayofmonth(y) >= F.dayofmonth(x), F.datediff(y, F.date_add(F.trunc(y, "month"), F.dayofmonth(x) - 1))).otherwise(F.datediff(y, F.date_add(F.trunc(F.add_months(y, -1), "month"), F.dayofmonth(x) - 1)))
    found = {
        "Y": F.floor(months / 12),
        "M": months,
        "D": F.datediff(y, x),
        "MD": turn,
        "YM": months % 12,
        "YD": F.datediff(y, F.add_months(x, (F.floor(months / 12) * 12).cast("int"))),
    }.get(unit.upper())
    if found is None:
        return Cell(F.lit(None).cast("double"), F.lit("#NUM!"))
    return guarded(found.cast("double"), merged(a.error, b.error, bad((x > y, "#NUM!"))))


FUNCTIONS["DATEDIF"] = datedif


def days_360(a: Column, b: Column, european: Column) -> Column:
    d1, d2 = F.dayofmonth(a), F.dayofmonth(b)
    last1 = a == F.last_day(a)
    feb1 = last1 & (F.month(a) == 2)
    feb2 = (b == F.last_day(b)) & (F.month(b) == 2)
    e1, e2 = F.least(d1, F.lit(30)), F.least(d2, F.lit(30))
    u2 = F.when(feb1 & feb2, 30).otherwise(d2)
    u1 = F.when(feb1, 30).otherwise(d1)
    u2 = F.when((u2 == 31) & (u1 >= 30), 30).otherwise(u2)
    u1 = F.when(u1 == 31, 30).otherwise(u1)
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return (months * 30 + F.when(european, e2 - e1).otherwise(u2 - u1)).cast("double")


@function("DAYS360", "d d l=false", bound=True)
def days360(a, b, european):
    """US method: a start on the 31st counts as the 30th; an end on the 31st too if the start is the 30th or later, else it is the next 1st."""
    d1 = F.when(F.dayofmonth(a) == 31, 30).when((a == F.last_day(a)) & (F.month(a) == 2), 30).otherwise(F.dayofmonth(a))
    d2 = F.when((F.dayofmonth(b) == 31) & (d1 >= 30), 30).otherwise(F.dayofmonth(b))
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    us = (months * 30 + d2 - d1).cast("double")
    return F.when(european, days_360(a, b, F.lit(True))).otherwise(us)


def leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def year_fraction(x: Column, y: Column, basis: Column) -> Column:
    """Day count fraction between two dates, in order, by basis 0 to 4."""
    a, b = F.least(x, y), F.greatest(x, y)
    actual = F.datediff(b, a)
    within = b <= F.add_months(a, 12)
    feb29 = lambda d: F.make_date(F.year(d), F.lit(2), F.lit(28))
    has_leap = (leap(F.year(a)) & (a <= F.date_add(feb29(a), 1))) | (leap(F.year(b)) & (b > feb29(b)))
    average = F.datediff(F.make_date(F.year(b) + 1, F.lit(1), F.lit(1)), F.make_date(F.year(a), F.lit(1), F.lit(1))) / (F.year(b) - F.year(a) + 1)
    year = F.when(within, F.when(has_leap, 366).otherwise(365)).otherwise(average)
    return F.when(basis == 1, actual / year).when(basis == 2, actual / 360).when(basis == 3, actual / 365).when(basis == 4, days_360(a, b, F.lit(True)) / 360).otherwise(days_360(a, b, F.lit(False)) / 360)


@function("YEARFRAC", "d d n=0", bound=True)
def yearfrac(a, b, basis):
    k = truncated(basis)
    return guarded(year_fraction(a, b, k), bad(((k < 0) | (k > 4), "#NUM!")))


#: Weekday types and the weekday (Monday 0) that is their first.
FIRST_DAY = {1: 6, 2: 0, 11: 0, 12: 1, 13: 2, 14: 3, 15: 4, 16: 5, 17: 6}


def _first(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in FIRST_DAY.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


@function("WEEKDAY", "d n=1", bound=True)
def weekday(d, kind):
    """Type 3 counts Monday as 0."""
    k = truncated(kind)
    out = F.when(k == 3, F.weekday(d)).otherwise(F.pmod(F.weekday(d) - _first(k), F.lit(7)) + 1).cast("double")
    return guarded(out, bad((out.isNull() & d.isNotNull(), "#NUM!")))


@function("WEEKNUM", "d n=1", bound=True)
def weeknum(d, kind):
    k = truncated(kind)
    january = F.trunc(d, "year")
    lead = F.pmod(F.weekday(january) - _first(k), F.lit(7))
    out = F.when(k == 21, F.weekofyear(d)).otherwise(F.floor((F.dayofyear(d) - 1 + lead) / 7) + 1).cast("double")
    return guarded(out, bad((out.isNull() & d.isNotNull(), "#NUM!")))


function("ISOWEEKNUM", "d")(lambda d: F.weekofyear(d).cast("double"))

#: Weekend numbers and their days (Monday 0).
WEEKENDS = {1: (5, 6), 2: (6, 0), 3: (0, 1), 4: (1, 2), 5: (2, 3), 6: (3, 4), 7: (4, 5)} | {11 + i: ((6 + i) % 7,) for i in range(7)}


def weekend_days(weekend: int | str) -> tuple[int, ...]:
    if isinstance(weekend, str):
        return tuple(i for i, c in enumerate(weekend) if c == "1")
    return WEEKENDS[int(weekend)]


def _is_work(d: Column, off: tuple[int, ...], holidays: Column) -> Column:
    return ~F.weekday(d).isin(*off) & ~F.array_contains(holidays, d) if off else ~F.array_contains(holidays, d)


def _days(holidays: Sequence | Column) -> Column:
    if isinstance(holidays, Column):
        return holidays
    return F.array(*[F.lit(str(h)).cast("date") for h in holidays]) if holidays else F.array().cast("array<date>")


def work_days_upto(d: Column, off: tuple[int, ...]) -> Column:
    """Working days from a Monday far back to the day ``d``, d included, in closed form."""
    n = F.datediff(d, F.lit("1899-12-25").cast("date")) + 1
    weeks, rest = F.floor(n / 7), n % 7
    extra = sum(((rest > i).cast("int") for i in range(7) if i not in off), F.lit(0))
    return weeks * (7 - len(off)) + extra


def networkdays_intl(start, end, weekend: int | str = 1, holidays: Sequence | Column = ()) -> Cell:
    """Working days of the closed interval, negative if it runs backwards; ``holidays``: dates or an array column."""
    a, b = day(start), day(end)
    off, free = weekend_days(weekend), _days(holidays)
    if len(off) == 7:
        return Cell(F.lit(0.0) if isinstance(weekend, str) else F.lit(None), merged(a.error, b.error))
    lo, hi = F.least(a.value, b.value), F.greatest(a.value, b.value)
    count = work_days_upto(hi, off) - work_days_upto(F.date_sub(lo, 1), off)
    taken = F.size(F.filter(F.array_distinct(free), lambda h: h.between(lo, hi) & (~F.weekday(h).isin(*off) if off else F.lit(True))))
    return guarded(((count - taken) * F.when(a.value > b.value, -1).otherwise(1)).cast("double"), merged(a.error, b.error))


def workday_intl(start, n, weekend: int | str = 1, holidays: Sequence | Column = ()) -> Cell:
    """The working day ``n`` working days after (before) ``start``, from a sequence of dates as long as n can need."""
    a, k = day(start), number(n)
    off, free = weekend_days(weekend), _days(holidays)
    if len(off) == 7:
        return Cell(F.lit(None).cast("date"), F.lit("#VALUE!"))
    steps = truncated(k.value).cast("int")
    reach = (F.ceil((F.abs(steps) + F.size(free)) / (7 - len(off))) * 7 + 14).cast("int")
    way = F.signum(steps).cast("int")
    span = F.transform(F.sequence(F.lit(1), reach), lambda i: F.date_add(a.value, i * way))
    found = F.try_element_at(F.filter(span, lambda d: _is_work(d, off, free)), F.greatest(F.abs(steps), F.lit(1)))
    return guarded(F.when(steps == 0, a.value).otherwise(found), merged(a.error, k.error))


FUNCTIONS["NETWORKDAYS.INTL"] = networkdays_intl
FUNCTIONS["WORKDAY.INTL"] = workday_intl
FUNCTIONS["NETWORKDAYS"] = lambda start, end, holidays=(): networkdays_intl(start, end, 1, holidays)
FUNCTIONS["WORKDAY"] = lambda start, n, holidays=(): workday_intl(start, n, 1, holidays)

