"""Aggregates: expressions for ``agg`` and ``groupBy().agg``, each a ``Cell``.

Columns are typed: blanks are nulls and are skipped, as are texts and logicals in a column
that isn't numeric. Error cells go in as ``Cell``s, and any of them is the result. Everything
here has a partial form, so groups are combined before the shuffle, and MEDIAN and the inclusive
percentiles keep a group's distinct values with their counts. The exceptions gather a group's values in
one array: AVEDEV, MODE, TRIMMEAN, LARGE, SMALL, the exclusive percentiles, NPV, IRR, XIRR and MIRR. For groups
beyond a task's memory use ``operators.grouping.order_statistics`` and ``present_values``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import Cell, bad, cell, guarded, let, merged
from .special import batched, f_cdf, gammainc, normal_cdf, t_tail
from .text import wildcard

AGGREGATES: dict[str, Callable[..., Cell]] = {}


def aggregate(*names: str):
    def decorate(f):
        for n in names:
            AGGREGATES[n] = f
        return f

    return decorate


def numbers(x) -> tuple[Column, Column | None]:
    """The numbers of a column: those of a numeric column, none of a text or logical one; and its first error."""
    c = cell(x)
    v = F.when(F.typeof(c.value).isin("string", "boolean"), F.lit(None)).otherwise(c.value.try_cast("double"))
    return v, None if c.error is None else F.min(c.error)


def everything(x) -> tuple[Column, Column | None]:
    """The A variants: logicals as 1 and 0, texts as 0, blanks skipped."""
    c = cell(x)
    kind = F.typeof(c.value)
    v = F.when(c.value.isNotNull(), F.when(kind == "string", 0.0).otherwise(c.value.try_cast("double")))
    return v, None if c.error is None else F.min(c.error)


def _one(f, *rules, take=numbers):
    """An aggregate of one column; rules make (condition, code) from the values and their count."""

    def call(x) -> Cell:
        v, error = take(x)
        n = F.count(v)
        return guarded(f(v, n), merged(error, bad(*[(r(v, n), code) for r, code in rules]) if rules else None))

    return call


EMPTY = (lambda v, n: n == 0, "#DIV/0!")
SINGLE = (lambda v, n: n < 2, "#DIV/0!")
NONE = (lambda v, n: n == 0, "#NUM!")


def mean(v: Column, n: Column) -> Column:
    return F.try_divide(F.sum(v), n)


AGGREGATES |= {
    "SUM": _one(lambda v, n: F.coalesce(F.sum(v), F.lit(0.0))),
    "SUMSQ": _one(lambda v, n: F.coalesce(F.sum(v * v), F.lit(0.0))),
    "PRODUCT": _one(lambda v, n: F.coalesce(F.product(v), F.lit(0.0))),
    "COUNT": _one(lambda v, n: n.cast("double")),
    "MIN": _one(lambda v, n: F.coalesce(F.min(v), F.lit(0.0))),
    "MAX": _one(lambda v, n: F.coalesce(F.max(v), F.lit(0.0))),
    "AVERAGE": _one(lambda v, n: F.avg(v), EMPTY),
    "VAR.S": _one(lambda v, n: F.var_samp(v), SINGLE),
    "VAR.P": _one(lambda v, n: F.var_pop(v), EMPTY),
    "STDEV.S": _one(lambda v, n: F.stddev_samp(v), SINGLE),
    "STDEV.P": _one(lambda v, n: F.stddev_pop(v), EMPTY),
    "DEVSQ": _one(lambda v, n: F.var_pop(v) * n, NONE),
    "MEDIAN": _one(lambda v, n: F.median(v), NONE),
    "GEOMEAN": _one(lambda v, n: F.exp(F.avg(F.ln(v))), (lambda v, n: (n == 0) | (F.min(v) <= 0), "#NUM!")),
    "HARMEAN": _one(lambda v, n: F.try_divide(n, F.sum(F.try_divide(F.lit(1.0), v))), (lambda v, n: (n == 0) | (F.min(v) <= 0), "#NUM!")),
    "SKEW": _one(lambda v, n: F.skewness(v) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)), (lambda v, n: (n < 3) | (F.var_pop(v) == 0), "#DIV/0!")),
    "SKEW.P": _one(lambda v, n: F.skewness(v), (lambda v, n: (n < 3) | (F.var_pop(v) == 0), "#DIV/0!")),
    "KURT": _one(lambda v, n: ((n + 1) * F.kurtosis(v) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)), (lambda v, n: (n < 4) | (F.var_pop(v) == 0), "#DIV/0!")),
    "AVERAGEA": _one(lambda v, n: F.avg(v), EMPTY, take=everything),
    "MINA": _one(lambda v, n: F.coalesce(F.min(v), F.lit(0.0)), take=everything),
    "MAXA": _one(lambda v, n: F.coalesce(F.max(v), F.lit(0.0)), take=everything),
    "VARA": _one(lambda v, n: F.var_samp(v), SINGLE, take=everything),
    "VARPA": _one(lambda v, n: F.var_pop(v), EMPTY, take=everything),
    "STDEVA": _one(lambda v, n: F.stddev_samp(v), SINGLE, take=everything),
    "STDEVPA": _one(lambda v, n: F.stddev_pop(v), EMPTY, take=everything),
}
for _old, _new in {"VAR": "VAR.S", "VARP": "VAR.P", "STDEV": "STDEV.S", "STDEVP": "STDEV.P"}.items():
    AGGREGATES[_old] = AGGREGATES[_new]


@aggregate("COUNTA")
def counta(x) -> Cell:
    """Everything but blanks; errors and empty texts count."""
    c = cell(x)
    here = c.value.isNotNull() if c.error is None else c.value.isNotNull() | c.error.isNotNull()
    return Cell(F.count_if(here).cast("double"))


@aggregate("COUNTBLANK")
def countblank(x) -> Cell:
    c = cell(x)
    blank = c.value.isNull() if c.error is None else c.value.isNull() & c.error.isNull()
    return Cell(F.count_if(blank | F.coalesce(c.value.cast("string") == "", F.lit(False))).cast("double"))


def histogram(v: Column) -> Column:
    """The group's values in order, as an array; blanks left out."""
    return F.sort_array(F.collect_list(v))


@aggregate("AVEDEV")
def avedev(x) -> Cell:
    v, error = numbers(x)
    out = let(F.collect_list(v), lambda a: let(F.aggregate(a, F.lit(0.0), lambda s, y: s + y) / F.nullif(F.size(a), F.lit(0)), lambda m: F.aggregate(a, F.lit(0.0), lambda s, y: s + F.abs(y - m)) / F.nullif(F.size(a), F.lit(0))))
    return guarded(out, merged(error, bad((F.count(v) == 0, "#NUM!"))))


@aggregate("PERCENTILE", "PERCENTILE.INC")
def percentile(x, k) -> Cell:
    v, error = numbers(x)
    wrong = F.lit(not 0 <= k <= 1)
    return guarded(F.percentile(v, F.lit(min(max(float(k), 0.0), 1.0))), merged(error, bad((wrong | (F.count(v) == 0), "#NUM!"))))


@aggregate("PERCENTILE.EXC")
def percentile_exc(x, k) -> Cell:
    """Rank k (n + 1), between 1 and n: the inclusive percentile of rank - 1 over n - 1 steps."""
    v, error = numbers(x)
    a = histogram(v)

    def pick(s):
        n = F.size(s)
        r = F.lit(float(k)) * (n + 1)
        low = F.floor(r).cast("int")
        return F.when((r >= 1) & (r <= n), F.get(s, low - 1) + (r - low) * (F.coalesce(F.get(s, low), F.get(s, low - 1)) - F.get(s, low - 1)))

    out = let(a, pick)
    return guarded(out, merged(error, bad((out.isNull(), "#NUM!"))))


AGGREGATES["QUARTILE"] = AGGREGATES["QUARTILE.INC"] = lambda x, q: percentile(x, int(q) / 4)
AGGREGATES["QUARTILE.EXC"] = lambda x, q: percentile_exc(x, int(q) / 4)


def _ranked(names: tuple[str, ...], largest: bool) -> None:
    @aggregate(*names)
    def nth(x, k) -> Cell:
        v, error = numbers(x)
        out = F.get(F.sort_array(F.collect_list(v), asc=not largest), F.lit(int(k) - 1))
        return guarded(out, merged(error, bad((out.isNull(), "#NUM!"))))


_ranked(("LARGE",), True)
_ranked(("SMALL",), False)


@aggregate("TRIMMEAN")
def trimmean(x, share) -> Cell:
    """Without the outer ``share`` of the values, as many at either end, rounded down to an even number."""
    v, error = numbers(x)

    def trimmed(s):
        cut = (F.floor(F.size(s) * F.lit(float(share)) / 2)).cast("int")
        kept = F.slice(s, cut + 1, F.greatest(F.size(s) - 2 * cut, F.lit(0)))
        return F.aggregate(kept, F.lit(0.0), lambda a, y: a + y) / F.nullif(F.size(kept), F.lit(0))

    return guarded(let(histogram(v), trimmed), merged(error, bad((F.count(v) == 0, "#NUM!"))))


@aggregate("MODE", "MODE.SNGL")
def mode(x) -> Cell:
    """The commonest value, the smallest of equally common ones; no value twice is #N/A."""
    v, error = numbers(x)

    def common(s):
        start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("run"), F.lit(None).cast("double").alias("best"), F.lit(1).alias("most"))

        def step(a, y):
            run = F.when(a["last"] == y, a["run"] + 1).otherwise(1)
            better = run > a["most"]
            return F.struct(y.alias("last"), run.alias("run"), F.when(better, y).otherwise(a["best"]).alias("best"), F.greatest(run, a["most"]).alias("most"))

        return F.aggregate(s, start, step, lambda a: a["best"])

    out = let(histogram(v), common)
    return guarded(out, merged(error, bad((out.isNull(), "#N/A"))))


# ---- two columns -----------------------------------------------------------------------------
def both(x, y) -> tuple[Column, Column, Column | None]:
    """Numbers of rows where both columns have one."""
    a, e = numbers(x)
    b, g = numbers(y)
    ok = a.isNotNull() & b.isNotNull()
    return F.when(ok, a), F.when(ok, b), merged(e, g)


def _two(f, *rules):
    def call(x, y) -> Cell:
        a, b, error = both(x, y)
        n = F.count(a)
        return guarded(f(a, b, n), merged(error, bad(*[(r(a, b, n), code) for r, code in rules]) if rules else None))

    return call


FLAT = (lambda a, b, n: (n < 2) | (F.var_pop(a) == 0) | (F.var_pop(b) == 0), "#DIV/0!")
FLAT_X = (lambda y, x, n: (n < 2) | (F.var_pop(x) == 0), "#DIV/0!")
AGGREGATES |= {
    "SUMPRODUCT": lambda *xs: (lambda parts: Cell(F.coalesce(F.sum(_times([F.coalesce(v, F.lit(0.0)) for v, _ in parts])), F.lit(0.0)), merged(*[e for _, e in parts])))([numbers(x) for x in xs]),
    "SUMXMY2": _two(lambda x, y, n: F.coalesce(F.sum((x - y) * (x - y)), F.lit(0.0))),
    "SUMX2MY2": _two(lambda x, y, n: F.coalesce(F.sum(x * x - y * y), F.lit(0.0))),
    "SUMX2PY2": _two(lambda x, y, n: F.coalesce(F.sum(x * x + y * y), F.lit(0.0))),
    "CORREL": _two(lambda x, y, n: F.corr(x, y), FLAT),
    "COVARIANCE.P": _two(lambda x, y, n: F.covar_pop(x, y), (lambda a, b, n: n == 0, "#DIV/0!")),
    "COVARIANCE.S": _two(lambda x, y, n: F.covar_samp(x, y), (lambda a, b, n: n < 2, "#DIV/0!")),
    "SLOPE": _two(lambda y, x, n: F.regr_slope(y, x), FLAT_X),
    "INTERCEPT": _two(lambda y, x, n: F.regr_intercept(y, x), FLAT_X),
    "RSQ": _two(lambda y, x, n: F.regr_r2(y, x), FLAT),
    "STEYX": _two(lambda y, x, n: F.sqrt(F.greatest(F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), 2) / F.nullif(F.regr_sxx(y, x), F.lit(0.0)), F.lit(0.0)) / F.nullif(n - 2, F.lit(0))), (lambda y, x, n: (n < 3) | (F.var_pop(x) == 0), "#DIV/0!")),
    "LINEST": _two(lambda y, x, n: F.regr_slope(y, x), FLAT_X),
    "LOGEST": _two(lambda y, x, n: F.exp(F.regr_slope(F.ln(y), x)), FLAT_X, (lambda y, x, n: F.min(y) <= 0, "#NUM!")),
}
AGGREGATES["PEARSON"] = AGGREGATES["CORREL"]
AGGREGATES["COVAR"] = AGGREGATES["COVARIANCE.P"]


def _times(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out * c
    return out


@aggregate("FORECAST", "FORECAST.LINEAR")
def forecast(at, y, x) -> Cell:
    a, b, error = both(y, x)
    return guarded(F.regr_intercept(a, b) + F.regr_slope(a, b) * F.lit(float(at)), merged(error, bad((FLAT_X[0](a, b, F.count(a)), "#DIV/0!"))))


@aggregate("TREND")
def trend(y, x, at, const=True) -> Cell:
    if const:
        return forecast(at, y, x)
    a, b, error = both(y, x)
    return guarded(F.try_divide(F.sum(a * b), F.sum(b * b)) * F.lit(float(at)), error)


@aggregate("GROWTH")
def growth(y, x, at) -> Cell:
    a, b, error = both(y, x)
    line = F.regr_intercept(F.ln(a), b) + F.regr_slope(F.ln(a), b) * F.lit(float(at))
    return guarded(F.exp(line), merged(error, bad((F.min(a) <= 0, "#NUM!"), (FLAT_X[0](a, b, F.count(a)), "#DIV/0!"))))


@aggregate("PROB")
def prob(x, p, low, high=None) -> Cell:
    a, b, error = both(x, p)
    inside = (a == low) if high is None else a.between(low, high)
    return guarded(F.coalesce(F.sum(F.when(inside, b)), F.lit(0.0)), merged(error, bad((F.abs(F.sum(b) - 1) > 1e-7, "#NUM!"), ((F.min(b) < 0) | (F.max(b) > 1), "#NUM!"))))


@aggregate("PERCENTOF")
def percentof(subset, whole) -> Cell:
    a, e = numbers(subset)
    b, g = numbers(whole)
    return guarded(F.try_divide(F.coalesce(F.sum(a), F.lit(0.0)), F.sum(b)), merged(e, g, bad((F.coalesce(F.sum(b), F.lit(0.0)) == 0, "#DIV/0!"))))


# ---- tests -----------------------------------------------------------------------------------
@aggregate("CHISQ.TEST", "CHITEST")
def chisq_test(observed, expected, df) -> Cell:
    """``df``: (rows - 1)(columns - 1) of the table whose cells are the rows here."""
    o, e, error = both(observed, expected)
    statistic = F.sum(F.try_divide((o - e) * (o - e), e))
    return guarded(1 - batched(gammainc, statistic / 2, F.lit(df / 2)), error)


@aggregate("F.TEST", "FTEST")
def f_test(x, y) -> Cell:
    a, e = numbers(x)
    b, g = numbers(y)
    va, vb = F.var_samp(a), F.var_samp(b)
    one = batched(f_cdf, F.try_divide(va, vb), F.count(a) - 1, F.count(b) - 1)
    return guarded(2 * F.least(one, 1 - one), merged(e, g, bad(((F.count(a) < 2) | (F.count(b) < 2), "#DIV/0!"))))


@aggregate("T.TEST", "TTEST")
def t_test(x, y, tails, kind) -> Cell:
    """kind 1 paired, 2 equal variances, 3 unequal ones."""
    if kind == 1:
        a, b, error = both(x, y)
        n = F.count(a)
        t, df = F.avg(a - b) / (F.stddev_samp(a - b) / F.sqrt(n)), n - 1
    else:
        a, e = numbers(x)
        b, g = numbers(y)
        error = merged(e, g)
        na, nb, va, vb = F.count(a), F.count(b), F.var_samp(a), F.var_samp(b)
        if kind == 2:
            pooled = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
            t, df = (F.avg(a) - F.avg(b)) / F.sqrt(pooled * (1 / na + 1 / nb)), na + nb - 2
        else:
            sa, sb = va / na, vb / nb
            t = (F.avg(a) - F.avg(b)) / F.sqrt(sa + sb)
            df = F.pow(sa + sb, 2) / (F.pow(sa, 2) / (na - 1) + F.pow(sb, 2) / (nb - 1))
    p = batched(t_tail, F.abs(t), df)
    return guarded(p if tails == 2 else p / 2, error)


@aggregate("Z.TEST", "ZTEST")
def z_test(x, mu, sigma=None) -> Cell:
    v, error = numbers(x)
    s = F.stddev_samp(v) if sigma is None else F.lit(float(sigma))
    return guarded(1 - normal_cdf((F.avg(v) - float(mu)) / (s / F.sqrt(F.count(v)))), merged(error, bad((F.count(v) < 2, "#DIV/0!"))))


# ---- cash flows, in the order of a column ------------------------------------------------------
def ordered(order, *values) -> Column:
    """The values as an array of structs in the order of ``order``."""
    rows = F.collect_list(F.struct(order.alias("o"), *[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.array_sort(rows)


def discounted(flows: Column, rate: Column, start: int) -> Column:
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(float(start)).alias("i"))
    return F.aggregate(flows, zero, lambda a, f: F.struct((a["s"] + f["v0"] / F.pow(1 + rate, a["i"])).alias("s"), (a["i"] + 1).alias("i")), lambda a: a["s"])


@aggregate("NPV")
def npv(rate, x, order) -> Cell:
    v, error = numbers(x)
    return guarded(discounted(F.filter(ordered(order, v), lambda f: f["v0"].isNotNull()), F.lit(float(rate)), 1), error)


def newton(value, slope, guess: float, steps: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(float(guess)), lambda r, _: F.greatest(r - F.coalesce(F.try_divide(value(r), slope(r)), F.lit(0.0)), F.lit(-0.999999)))


def rooted(flows: Column, value, slope, guess: float, steps: int, error) -> Cell:
    def solve(f):
        r = newton(lambda x: value(f, x), lambda x: slope(f, x), guess, steps)
        signs = F.exists(f, lambda y: y["v0"] > 0) & F.exists(f, lambda y: y["v0"] < 0)
        return let(r, lambda x: F.struct(x.alias("r"), bad((~signs | F.isnan(x) | (F.abs(value(f, x)) > 1e-6 * F.aggregate(f, F.lit(1.0), lambda a, y: a + F.abs(y["v0"]))), "#NUM!")).alias("e")))

    both_ = let(flows, solve)
    return guarded(both_["r"], merged(error, both_["e"]))


@aggregate("IRR")
def irr(x, order, guess: float = 0.1) -> Cell:
    """Newton's method on the flows of a group in their order; a group's flows are one array."""
    v, error = numbers(x)
    zero = lambda: F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("i"))
    value = lambda f, r: discounted(f, r, 0)
    slope = lambda f, r: F.aggregate(f, zero(), lambda a, y: F.struct((a["s"] - a["i"] * y["v0"] / F.pow(1 + r, a["i"] + 1)).alias("s"), (a["i"] + 1).alias("i")), lambda a: a["s"])
    return rooted(F.filter(ordered(order, v), lambda f: f["v0"].isNotNull()), value, slope, guess, 40, error)


def dated(x, date) -> Column:
    v, error = numbers(x)
    return F.filter(ordered(date, v), lambda f: f["v0"].isNotNull()), error


def _at(f, r, power_shift=0.0):
    start = F.get(f, 0)["o"]
    return lambda a, y: a + y["v0"] / F.pow(1 + r, F.datediff(y["o"], start) / 365.0 + power_shift)


@aggregate("XNPV")
def xnpv(rate, x, date) -> Cell:
    """Discounted to a fixed day and moved from there to the first one, so that it has a partial form."""
    v, error = numbers(x)
    years = lambda d: F.datediff(d, F.lit("2000-01-01").cast("date")) / 365.0
    first = F.min(F.when(v.isNotNull(), date))
    out = F.sum(v * F.pow(F.lit(1.0 + rate), -years(date))) * F.pow(F.lit(1.0 + rate), years(first))
    return guarded(F.coalesce(out, F.lit(0.0)), error)


@aggregate("XIRR")
def xirr(x, date, guess: float = 0.1) -> Cell:
    flows, error = dated(x, date)
    value = lambda f, r: F.aggregate(f, F.lit(0.0), _at(f, r))
    slope = lambda f, r: F.aggregate(f, F.lit(0.0), lambda a, y: a - y["v0"] * F.datediff(y["o"], F.get(f, 0)["o"]) / 365.0 / F.pow(1 + r, F.datediff(y["o"], F.get(f, 0)["o"]) / 365.0 + 1))
    return rooted(flows, value, slope, guess, 60, error)


@aggregate("MIRR")
def mirr(x, order, finance: float, reinvest: float) -> Cell:
    v, error = numbers(x)

    def solve(f):
        n = F.size(f)
        gains = discounted(F.transform(f, lambda y: F.struct(F.greatest(y["v0"], F.lit(0.0)).alias("v0"))), F.lit(float(reinvest)), 1)
        costs = discounted(F.transform(f, lambda y: F.struct(F.least(y["v0"], F.lit(0.0)).alias("v0"))), F.lit(float(finance)), 1)
        return F.pow(F.try_divide(-gains * F.pow(F.lit(1.0 + reinvest), n), costs * (1 + finance)), F.try_divide(F.lit(1.0), n - 1)) - 1

    out = let(F.filter(ordered(order, v), lambda f: f["v0"].isNotNull()), solve)
    return guarded(out, merged(error, bad((out.isNull() | F.isnan(out), "#DIV/0!"))))


@aggregate("FVSCHEDULE")
def fvschedule(principal, rates) -> Cell:
    v, error = numbers(rates)
    return guarded(F.lit(float(principal)) * F.coalesce(F.product(1 + v), F.lit(1.0)), error)


# ---- texts in order ----------------------------------------------------------------------------
def textjoin(delimiter: str, x, order, skip_empty: bool = True) -> Column:
    """A column's texts in the order of another, joined."""
    kept = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(cell(x).value.cast("string"), F.lit("")).alias("v")))), lambda s: s["v"])
    return F.array_join(F.filter(kept, lambda s: s != "") if skip_empty else kept, delimiter)


# ---- criteria ----------------------------------------------------------------------------------
OPERATORS = ("<=", ">=", "<>", "<", ">", "=")


def criterion(x: Column, rule) -> Column:
    """Whether a cell meets a criterion, never null.

    A number, or a text with an operator before a number, compares numbers (logicals as 1 and
    0); text and blanks never match it, not even "<>5". "" and "=" mean blank, "<>" means not
    blank. Other texts match whole cells without case, with * and ? (~ takes them literally);
    "<>text" is its opposite; < and > match no text.
    """
    numeric = F.when(F.typeof(x) == "string", F.lit(None)).otherwise(x.try_cast("double"))
    if isinstance(rule, bool):
        return F.coalesce((F.typeof(x) == "boolean") & (x.cast("string") == str(rule).lower()), F.lit(False))
    if rule is None or rule in ("", "="):
        return x.isNull()
    if rule == "<>":
        return x.isNotNull()
    op, value = "=", rule
    if isinstance(rule, str):
        op = next((o for o in OPERATORS if rule.startswith(o)), "=")
        value = rule[len(op) :] if rule.startswith(op) else rule
        try:
            value = float(value)
        except ValueError:
            pass
    if isinstance(value, (int, float)):
        v = F.lit(float(value))
        found = {"=": numeric == v, "<>": numeric != v, "<": numeric < v, "<=": numeric <= v, ">": numeric > v, ">=": numeric >= v}[op]
        return F.coalesce(found, F.lit(False))
    if op not in ("=", "<>"):
        return F.lit(False)
    text = F.when(F.typeof(x) == "string", x.cast("string"))
    if any(c in value for c in "*?~"):
        same = F.rlike(text, F.concat(F.lit("(?is)^(?:"), wildcard(F.lit(value)), F.lit(")$")))
    else:
        same = F.lower(text) == value.lower()
    return F.coalesce(~same if op == "<>" else same, F.lit(op == "<>"))


def all_of(*pairs) -> Column:
    """Conjunction of (column, criterion) pairs given one after the other."""
    out = F.lit(True)
    for x, rule in zip(pairs[::2], pairs[1::2]):
        out = out & criterion(cell(x).value, rule)
    return out


def _errors(*xs) -> Column | None:
    return merged(*[F.min(c.error) for c in map(cell, xs) if c.error is not None])


AGGREGATES |= {
    "COUNTIFS": lambda *p: Cell(F.count_if(all_of(*p)).cast("double"), _errors(*p[::2])),
    "SUMIFS": lambda v, *p: guarded(F.coalesce(F.sum(F.when(all_of(*p), numbers(v)[0])), F.lit(0.0)), _errors(v, *p[::2])),
    "AVERAGEIFS": lambda v, *p: guarded(F.avg(F.when(all_of(*p), numbers(v)[0])), merged(_errors(v, *p[::2]), bad((F.count(F.when(all_of(*p), numbers(v)[0])) == 0, "#DIV/0!")))),
    "MINIFS": lambda v, *p: guarded(F.coalesce(F.min(F.when(all_of(*p), numbers(v)[0])), F.lit(0.0)), _errors(v, *p[::2])),
    "MAXIFS": lambda v, *p: guarded(F.coalesce(F.max(F.when(all_of(*p), numbers(v)[0])), F.lit(0.0)), _errors(v, *p[::2])),
}
AGGREGATES["COUNTIF"] = lambda x, rule: AGGREGATES["COUNTIFS"](x, rule)
AGGREGATES["SUMIF"] = lambda x, rule, v=None: AGGREGATES["SUMIFS"](x if v is None else v, x, rule)
AGGREGATES["AVERAGEIF"] = lambda x, rule, v=None: AGGREGATES["AVERAGEIFS"](x if v is None else v, x, rule)

#: Function numbers of SUBTOTAL (also plus 100) and AGGREGATE.
NUMBERED = {1: "AVERAGE", 2: "COUNT", 3: "COUNTA", 4: "MAX", 5: "MIN", 6: "PRODUCT", 7: "STDEV.S", 8: "STDEV.P", 9: "SUM", 10: "VAR.S", 11: "VAR.P", 12: "MEDIAN", 13: "MODE.SNGL", 14: "LARGE", 15: "SMALL", 16: "PERCENTILE.INC", 17: "QUARTILE.INC", 18: "PERCENTILE.EXC", 19: "QUARTILE.EXC"}


@aggregate("SUBTOTAL")
def subtotal(number: int, x) -> Cell:
    k = number - 100 if number > 100 else number
    if not 1 <= k <= 11:
        return Cell(F.lit(None).cast("double"), F.lit("#VALUE!"))
    return AGGREGATES[NUMBERED[k]](x)


@aggregate("AGGREGATE")
def aggregate_(number: int, options: int, x, *k) -> Cell:
    """Options 2, 3, 6 and 7 leave error cells out; there are no hidden or nested cells in a table."""
    c = cell(x)
    if options in (2, 3, 6, 7):
        c = Cell(c.value if c.error is None else F.when(c.error.isNull(), c.value))
    return AGGREGATES[NUMBERED[number]](c, *k)


class Aggregates:
    """``agg.SUM(x)``, ``agg.STDEV_S(x)`` or ``agg["STDEV.S"](x)``."""

    def __getitem__(self, name: str) -> Callable[..., Cell]:
        return AGGREGATES[name.upper()]

    def __getattr__(self, name: str) -> Callable[..., Cell]:
        for n in (name.upper(), name.upper().replace("_", ".")):
            if n in AGGREGATES:
                return AGGREGATES[n]
        raise AttributeError(name)


agg = Aggregates()
