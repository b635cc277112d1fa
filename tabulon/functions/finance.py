"""Annuities, depreciation, bills and bonds, as expressions over rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import bad, finite, guarded, held, judged, let
from .core import function as _function
from .dates import days_360, year_fraction
from .math import running, truncated

function = partial(_function, bound=True)
#: Over literals and a single column the formula is small enough for a plain expression, which Spark folds and compiles.
annuity = partial(_function, bound=2)


def growth(rate: Column, n: Column) -> Column:
    return F.pow(1 + rate, n)


def annuity_fv(rate, nper, pmt, pv, due):
    g = growth(rate, nper)
    return F.when(rate == 0, -(pv + pmt * nper)).otherwise(-(pv * g + pmt * (1 + rate * due) * F.try_divide(g - 1, rate)))


def annuity_pmt(rate, nper, pv, fv, due):
    g = growth(rate, nper)
    return F.when(rate == 0, -F.try_divide(pv + fv, nper)).otherwise(-F.try_divide((pv * g + fv) * rate, (1 + rate * due) * (g - 1)))


def interest(rate, per, nper, pv, fv, due):
    """Interest part of payment ``per``: that of the balance after the payments before it."""
    pmt = annuity_pmt(rate, nper, pv, fv, due)
    balance = annuity_fv(rate, per - 1, pmt, pv, due)
    return F.when((due == 1) & (per == 1), 0.0).when(due == 1, F.try_divide(balance * rate, 1 + rate)).otherwise(balance * rate)


@annuity("FV", "n n n n=0 n=0")
def fv(rate, nper, pmt, pv, due):
    return finite(annuity_fv(rate, nper, pmt, pv, due))


@annuity("PV", "n n n n=0 n=0")
def pv(rate, nper, pmt, future, due):
    g = growth(rate, nper)
    return finite(F.when(rate == 0, -(future + pmt * nper)).otherwise(-F.try_divide(future + pmt * (1 + rate * due) * F.try_divide(g - 1, rate), g)))


@annuity("PMT", "n n n n=0 n=0")
def pmt(rate, nper, present, future, due):
    return finite(annuity_pmt(rate, nper, present, future, due), (nper == 0, "#NUM!"))


@annuity("IPMT", "n n n n n=0 n=0")
def ipmt(rate, per, nper, present, future, due):
    return finite(interest(rate, per, nper, present, future, due), ((per < 1) | (per > nper), "#NUM!"))


@annuity("PPMT", "n n n n n=0 n=0")
def ppmt(rate, per, nper, present, future, due):
    return finite(annuity_pmt(rate, nper, present, future, due) - interest(rate, per, nper, present, future, due), ((per < 1) | (per > nper), "#NUM!"))


def _cumulative(name: str, principal: bool) -> None:
    @function(name, "n n n n n n")
    def body(rate, nper, present, start, end, due):
        a, b = F.ceil(start), F.floor(end)
        zero = F.lit(0.0)
        part = lambda i: (annuity_pmt(rate, nper, present, zero, due) - interest(rate, i, nper, present, zero, due)) if principal else interest(rate, i, nper, present, zero, due)
        wrong = (rate <= 0) | (nper <= 0) | (present <= 0) | (a < 1) | (b < a) | (b > nper) | ~due.isin(0.0, 1.0)
        return finite(F.when(~wrong, running(a, b, 1, 0.0, lambda s, i: s + part(i))), (wrong, "#NUM!"))


_cumulative("CUMIPMT", False)
_cumulative("CUMPRINC", True)


@annuity("NPER", "n n n n=0 n=0")
def nper(rate, payment, present, future, due):
    p = payment * (1 + rate * due)
    return finite(F.when(rate == 0, -F.try_divide(present + future, payment)).otherwise(F.try_divide(F.ln(F.try_divide(p - future * rate, p + present * rate)), F.ln(1 + rate))))


@function("RATE", "n n n n=0 n=0 n=0.1")
def rate_(n, payment, present, future, due, guess):
    """Newton steps with a central difference, 40 at most; no solution is #NUM!."""

    def value(r):
        return F.when(F.abs(r) < 1e-10, present + payment * n + future).otherwise(present * growth(r, n) + payment * (1 + r * due) * F.try_divide(growth(r, n) - 1, r) + future)

    def step(r, _):
        h = 1e-6
        slope = (value(r + h) - value(r - h)) / (2 * h)
        return F.greatest(r - F.coalesce(F.try_divide(value(r), slope), F.lit(0.0)), F.lit(-0.99))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(40)), guess, step)
    return _solved(found, value, present, future)


def _solved(found, value, present, future):
    wrong = lambda r: (F.abs(value(r)) > 1e-6 * (1 + F.abs(present) + F.abs(future))) | F.isnan(r)
    return held(let(found, lambda r: judged(r, bad((wrong(r), "#NUM!")))))


annuity("ISPMT", "n n n n")(lambda rate, per, n, present: finite(present * rate * (F.try_divide(per, n) - 1), (n == 0, "#DIV/0!")))


@annuity("EFFECT", "n n")
def effect(rate, periods):
    k = truncated(periods)
    return finite(F.pow(1 + F.try_divide(rate, k), k) - 1, ((rate <= 0) | (k < 1), "#NUM!"))


@annuity("NOMINAL", "n n")
def nominal(rate, periods):
    k = truncated(periods)
    return finite((F.pow(1 + rate, F.try_divide(F.lit(1.0), k)) - 1) * k, ((rate <= 0) | (k < 1), "#NUM!"))


@annuity("RRI", "n n n")
def rri(n, present, future):
    return finite(F.pow(F.try_divide(future, present), F.try_divide(F.lit(1.0), n)) - 1, ((n <= 0) | (present == 0), "#NUM!"))


@annuity("PDURATION", "n n n")
def pduration(rate, present, future):
    return finite((F.ln(future) - F.ln(present)) / F.ln(1 + rate), ((rate <= 0) | (present <= 0) | (future <= 0), "#NUM!"))


def _dollar(name: str, to_decimal: bool) -> None:
    @function(name, "n n")
    def body(x, fraction):
        f = truncated(fraction)
        places = F.pow(F.lit(10.0), F.ceil(F.log10(F.greatest(f, F.lit(1.0)))))
        whole = truncated(x)
        part = x - whole
        out = whole + (part * F.try_divide(places, f) if to_decimal else part * f / places)
        return finite(out, (fraction < 0, "#NUM!"), (f < 1, "#DIV/0!"))


_dollar("DOLLARDE", True)
_dollar("DOLLARFR", False)

function("SLN", "n n n")(lambda cost, salvage, life: finite(F.try_divide(cost - salvage, life), (life == 0, "#DIV/0!")))


@function("SYD", "n n n n")
def syd(cost, salvage, life, per):
    return finite(F.try_divide((cost - salvage) * (life - per + 1) * 2, life * (life + 1)), ((life <= 0) | (per < 1) | (per > life), "#NUM!"))


@function("DB", "n n n n n=12")
def db(cost, salvage, life, period, month):
    """Fixed declining balance, the rate rounded to three digits; the first and last year are partial."""
    p, m = truncated(period), truncated(month)
    rate = F.when(cost == 0, 0.0).otherwise(F.floor((1 - F.pow(F.try_divide(salvage, cost), F.try_divide(F.lit(1.0), life))) * 1000 + 0.5) / 1000)
    first = cost * rate * m / 12
    later = (cost - first) * F.pow(1 - rate, p - 2) * rate * F.when(p == life + 1, (12 - m) / 12).otherwise(1.0)
    wrong = (cost < 0) | (salvage < 0) | (life <= 0) | (p < 1) | (m < 1) | (m > 12) | (p > life + F.when(m < 12, 1).otherwise(0))
    return finite(F.when(p >= 2, later).otherwise(first), (wrong, "#NUM!"))


@function("DDB", "n n n n n=2")
def ddb(cost, salvage, life, period, factor):
    """The book value falls by a constant factor a period until it meets the salvage value."""
    p = truncated(period)
    rate = F.least(F.try_divide(factor, life), F.lit(1.0))
    book = F.greatest(cost * F.pow(1 - rate, p - 1), F.least(cost, salvage))
    wrong = (cost < 0) | (salvage < 0) | (life <= 0) | (p < 1) | (p > life) | (factor <= 0)
    return finite(F.greatest(F.least(book * rate, book - salvage), F.lit(0.0)), (wrong, "#NUM!"))


@function("VDB", "n n n n n n=2 l=false")
def vdb(cost, salvage, life, begin, end, factor, no_switch):
    """Declining balance over an interval; turns to straight line where that writes off more."""
    start = F.struct(cost.alias("book"), F.lit(0.0).alias("sum"))

    def step(a, i):
        left = life - (i - 1)
        declining = F.least(a["book"] * F.least(F.try_divide(factor, life), F.lit(1.0)), F.greatest(a["book"] - salvage, F.lit(0.0)))
        straight = F.when(left > 0, F.try_divide(F.greatest(a["book"] - salvage, F.lit(0.0)), F.greatest(left, F.lit(1.0)))).otherwise(0.0)
        now = F.when(no_switch, declining).otherwise(F.greatest(declining, straight))
        share = F.greatest(F.least(end, i) - F.greatest(begin, i - 1), F.lit(0.0))
        return F.struct((a["book"] - now).alias("book"), (a["sum"] + now * share).alias("sum"))

    last = F.greatest(F.ceil(end), F.lit(1)).cast("int")
    wrong = (cost < 0) | (salvage < 0) | (life <= 0) | (begin < 0) | (end < begin) | (end > life) | (factor <= 0)
    return finite(F.aggregate(F.sequence(F.lit(1), last), start, lambda a, i: step(a, i.cast("double")), lambda a: a["sum"]), (wrong, "#NUM!"))


@function("AMORLINC", "n d d n n n n=0")
def amorlinc(cost, bought, first, salvage, period, rate, basis):
    p = truncated(period)
    opening = cost * rate * year_fraction(bought, first, basis)
    per = cost * rate
    before = F.when(p == 0, 0.0).otherwise(opening + (p - 1) * per)
    now = F.when(p == 0, opening).otherwise(per)
    return finite(F.greatest(F.least(now, cost - salvage - before), F.lit(0.0)), ((cost <= 0) | (salvage < 0) | (salvage >= cost) | (rate <= 0) | (p < 0) | (bought >= first) | (basis == 2), "#NUM!"))


@function("AMORDEGRC", "n d d n n n n=0")
def amordegrc(cost, bought, first, salvage, period, rate, basis):
    """The coefficient rises with the life; the last two periods halve, then take what is left."""
    life = F.try_divide(F.lit(1.0), rate)
    factor = F.when((life >= 3) & (life <= 4), 1.5).when((life >= 5) & (life <= 6), 2.0).when(life > 6, 2.5).otherwise(1.0)
    r = rate * factor
    p = truncated(period)
    half = lambda x: F.floor(x + 0.5).cast("double")
    opening = half(year_fraction(bought, first, basis) * r * cost)
    start = F.struct((cost - opening).alias("book"), (cost - opening - salvage).alias("rest"), opening.alias("now"), F.lit(False).alias("over"))

    def step(a, i):
        now = half(r * a["book"])
        rest = a["rest"] - now
        short = rest < 0
        last = F.when(p - i + 1 <= 1, half(a["book"] * 0.5)).otherwise(0.0)
        got = F.when(a["over"], 0.0).when(short, last).otherwise(now)
        return F.struct((a["book"] - got).alias("book"), rest.alias("rest"), got.alias("now"), (a["over"] | short).alias("over"))

    steps = F.when(p >= 1, F.sequence(F.lit(1), p.cast("int"))).otherwise(F.array().cast("array<int>"))
    return finite(F.aggregate(steps, start, step, lambda a: a["now"]), ((cost <= 0) | (salvage < 0) | (salvage >= cost) | (rate <= 0) | (p < 0) | (bought >= first) | (basis == 2), "#NUM!"))


def _discounted(name: str, f, *wrong) -> None:
    @function(name, "d d n n n=0")
    def body(settlement, maturity, a, b, basis):
        t = year_fraction(settlement, maturity, basis)
        return finite(f(a, b, t), ((settlement >= maturity) | (a <= 0) | (b <= 0) | (basis < 0) | (basis > 4), "#NUM!"))


_discounted("DISC", lambda price, redemption, t: F.try_divide(redemption - price, redemption * t))
_discounted("INTRATE", lambda paid, redemption, t: F.try_divide(redemption - paid, paid * t))
_discounted("RECEIVED", lambda paid, discount, t: F.try_divide(paid, 1 - discount * t))
_discounted("PRICEDISC", lambda discount, redemption, t: redemption - discount * redemption * t)
_discounted("YIELDDISC", lambda price, redemption, t: F.try_divide(redemption - price, price * t))


@function("PRICEMAT", "d d d n n n=0")
def pricemat(settlement, maturity, issue, rate, yld, basis):
    a, b, c = year_fraction(issue, maturity, basis), year_fraction(settlement, maturity, basis), year_fraction(issue, settlement, basis)
    return finite(100 * ((1 + a * rate) / (1 + b * yld) - c * rate), ((settlement >= maturity) | (rate < 0) | (yld < 0), "#NUM!"))


@function("YIELDMAT", "d d d n n n=0")
def yieldmat(settlement, maturity, issue, rate, price, basis):
    a, b, c = year_fraction(issue, maturity, basis), year_fraction(settlement, maturity, basis), year_fraction(issue, settlement, basis)
    return finite(F.try_divide(F.try_divide(1 + a * rate, price / 100 + c * rate) - 1, b), ((settlement >= maturity) | (rate < 0) | (price <= 0), "#NUM!"))


@function("ACCRINTM", "d d n n=1000 n=0")
def accrintm(issue, settlement, rate, par, basis):
    return finite(par * rate * year_fraction(issue, settlement, basis), ((rate <= 0) | (par <= 0) | (issue >= settlement), "#NUM!"))


def _bill(name: str, f) -> None:
    @function(name, "d d n")
    def body(settlement, maturity, x):
        n = F.datediff(maturity, settlement).cast("double")
        return finite(f(x, n), ((n <= 0) | (n > 365) | (x <= 0), "#NUM!"))


_bill("TBILLEQ", lambda discount, n: F.try_divide(365 * discount, 360 - discount * n))
_bill("TBILLPRICE", lambda discount, n: 100 * (1 - discount * n / 360))
_bill("TBILLYIELD", lambda price, n: F.try_divide((100 - price) * 360, price * n))


# Coupons: dates step back from maturity by 12 / frequency months.
def coupon_number(settlement: Column, maturity: Column, frequency: Column) -> Column:
    """Coupons payable after settlement, up to maturity."""
    months = (F.year(maturity) - F.year(settlement)) * 12 + F.month(maturity) - F.month(settlement)
    step = F.try_divide(F.lit(12.0), frequency)
    whole = F.greatest(F.floor(F.try_divide(months.cast("double"), step)), F.lit(0)).cast("int")
    return let(whole, lambda n: n + (F.add_months(maturity, (-n * step).cast("int")) > settlement).cast("int"))


def day_count(a: Column, b: Column, basis: Column) -> Column:
    return F.when(basis == 4, days_360(a, b, F.lit(True))).when(basis == 0, days_360(a, b, F.lit(False))).otherwise(F.datediff(b, a).cast("double"))


def bond_terms(settlement, maturity, frequency, basis) -> Column:
    """Struct of n (coupons to come), the coupon dates before and after settlement, e (days of the
    period), a (days since the last coupon) and dsc (days to the next)."""

    def coupon(n: Column, ahead: int) -> Column:
        d = F.add_months(maturity, (-(n - ahead) * F.try_divide(F.lit(12.0), frequency)).cast("int"))
        return F.when(maturity == F.last_day(maturity), F.last_day(d)).otherwise(d)

    def counted(x: Column) -> Column:
        actual = F.datediff(x["next"], x["last"]).cast("double")
        e = F.when(basis == 1, actual).when(basis == 3, 365 / frequency).otherwise(360 / frequency)
        return F.struct(x["n"].alias("n"), x["last"].alias("last"), x["next"].alias("next"), e.alias("e"), day_count(x["last"], settlement, basis).alias("a"))

    def finished(x: Column) -> Column:
        # What is left of the period on 30/360 bases, else the actual days.
        dsc = F.when(basis.isin(0.0, 4.0), x["e"] - x["a"]).otherwise(F.datediff(x["next"], settlement).cast("double"))
        return F.struct(*[x[k].alias(k) for k in ("n", "last", "next", "e", "a")], dsc.alias("dsc"))

    dates = let(coupon_number(settlement, maturity, frequency), lambda n: F.struct(n.alias("n"), coupon(n, 0).alias("last"), coupon(n, 1).alias("next")))
    return let(let(dates, counted), finished)


def _bad_coupon(settlement, maturity, frequency, basis):
    return ((settlement >= maturity) | ~frequency.isin(1.0, 2.0, 4.0) | (basis < 0) | (basis > 4), "#NUM!")


def _coupon(name: str, f) -> None:
    @function(name, "d d n n=0")
    def body(settlement, maturity, frequency, basis):
        k, b = truncated(frequency), truncated(basis)
        return guarded(f(settlement, maturity, F.when(k.isin(1.0, 2.0, 4.0), k), b), bad(_bad_coupon(settlement, maturity, k, b)))


_coupon("COUPNUM", lambda s, m, k, b: coupon_number(s, m, k).cast("double"))
_coupon("COUPPCD", lambda *x: bond_terms(*x)["last"])
_coupon("COUPNCD", lambda *x: bond_terms(*x)["next"])
_coupon("COUPDAYBS", lambda *x: bond_terms(*x)["a"])
_coupon("COUPDAYS", lambda *x: bond_terms(*x)["e"])
_coupon("COUPDAYSNC", lambda *x: bond_terms(*x)["dsc"])


def coupons_value(c, g, t, n) -> Column:
    """Present value of ``n`` coupons ``c``, the first after ``t`` periods of rate ``g``: a geometric sum in closed form."""
    log = F.log1p(g)
    return c * F.when(g == 0, n.cast("double")).otherwise(F.exp(-t * log) * -F.expm1(-n * log) * F.try_divide(1 + g, g))


def bond_price(s, m, rate, yld, redemption, k, b) -> Column:
    """Clean price per 100: discounted coupons and redemption less accrued interest."""

    def price(x):
        n, e, dsc, a = x["n"], x["e"], x["dsc"], x["a"]
        c = 100 * rate / k
        t = dsc / e
        y = 1 + yld / k
        single = (redemption + c) / (1 + t * yld / k) - c * a / e
        coupons = coupons_value(c, yld / k, t, n)
        return F.when(n == 1, single).otherwise(redemption / F.pow(y, n - 1 + t) + coupons - c * a / e)

    return let(bond_terms(s, m, k, b), price)


@function("PRICE", "d d n n n n n=0")
def price(s, m, rate, yld, redemption, frequency, basis):
    k, b = truncated(frequency), truncated(basis)
    return finite(bond_price(s, m, rate, yld, redemption, F.when(k.isin(1.0, 2.0, 4.0), k), b), _bad_coupon(s, m, k, b), ((rate < 0) | (yld < 0) | (redemption <= 0), "#NUM!"))


@function("YIELD", "d d n n n n n=0")
def yield_(s, m, rate, target, redemption, frequency, basis):
    """Bisection of PRICE between -99 % and 1000 %, to 2^-50 of that range."""
    k, b = truncated(frequency), truncated(basis)
    kk = F.when(k.isin(1.0, 2.0, 4.0), k)

    def solve(x):
        # Everything that doesn't depend on the yield is computed once, before the search.
        known = F.struct(x["n"].alias("n"), kk.alias("k"), (100 * rate / kk).alias("c"), (x["dsc"] / x["e"]).alias("t"), (100 * rate / kk * x["a"] / x["e"] + target).alias("dirty"), redemption.alias("redemption"))
        return let(known, search)

    def search(z):
        n, c, t, redeemed = z["n"], z["c"], z["t"], z["redemption"]

        def value(g):
            many = redeemed * F.exp(-(n - 1 + t) * F.log1p(g)) + coupons_value(c, g, t, n)
            return F.when(n == 1, (redeemed + c) / (1 + t * g)).otherwise(many)

        def step(r, _):
            def halve(mid):
                return let(value(mid / z["k"]) > z["dirty"], lambda over: F.struct(F.when(over, mid).otherwise(r["lo"]).alias("lo"), F.when(over, r["hi"]).otherwise(mid).alias("hi")))

            return let((r["lo"] + r["hi"]) / 2, halve)

        start = F.struct(F.lit(-0.99).alias("lo"), F.lit(10.0).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(50)), start, step, lambda r: (r["lo"] + r["hi"]) / 2)

    return finite(let(bond_terms(s, m, kk, b), solve), _bad_coupon(s, m, k, b), ((rate < 0) | (target <= 0) | (redemption <= 0), "#NUM!"))


def _duration(name: str, modified: bool) -> None:
    @function(name, "d d n n n n=0")
    def body(s, m, rate, yld, frequency, basis):
        k, b = truncated(frequency), truncated(basis)
        kk = F.when(k.isin(1.0, 2.0, 4.0), k)

        def weigh(x):
            t = x["dsc"] / x["e"]
            c, y = 100 * rate / kk, 1 + yld / kk
            zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("tv"))

            def step(acc, i):
                v = (c + F.when(i == x["n"], 100.0).otherwise(0.0)) / F.pow(y, i - 1 + t)
                return F.struct((acc["v"] + v).alias("v"), (acc["tv"] + v * (i - 1 + t)).alias("tv"))

            d = F.aggregate(F.sequence(F.lit(1), F.greatest(x["n"], F.lit(1))), zero, step, lambda acc: acc["tv"] / acc["v"] / kk)
            return d / y if modified else d

        return finite(let(bond_terms(s, m, kk, b), weigh), _bad_coupon(s, m, k, b), ((rate < 0) | (yld < 0), "#NUM!"))


_duration("DURATION", False)
_duration("MDURATION", True)


@function("ACCRINT", "d d d n n n n=0 l=true")
def accrint(issue, first, settlement, rate, par, frequency, basis, from_issue):
    """Interest of the coupon periods from issue (or from the first coupon) to settlement."""
    start = F.when(from_issue | (settlement <= first), issue).otherwise(first)
    return finite(par * rate * year_fraction(start, settlement, truncated(basis)), ((rate <= 0) | (par <= 0) | (issue >= settlement) | ~truncated(frequency).isin(1.0, 2.0, 4.0), "#NUM!"))


# Bonds with an odd last period: interest counted in fractions of a regular period.
def _odd_last(last, s, m, k, b):
    unit = F.try_divide(F.lit(1.0), k)
    return year_fraction(last, m, b) / unit, year_fraction(s, m, b) / unit, year_fraction(last, s, b) / unit


@function("ODDLPRICE", "d d d n n n n n=0")
def oddlprice(s, m, last, rate, yld, redemption, frequency, basis):
    k, b = truncated(frequency), truncated(basis)
    dc, dsc, a = _odd_last(last, s, m, k, b)
    c = 100 * rate / k
    return finite((redemption + dc * c) / (1 + dsc * yld / k) - a * c, ((last >= s) | (s >= m) | ~k.isin(1.0, 2.0, 4.0), "#NUM!"))


@function("ODDLYIELD", "d d d n n n n n=0")
def oddlyield(s, m, last, rate, price_, redemption, frequency, basis):
    k, b = truncated(frequency), truncated(basis)
    dc, dsc, a = _odd_last(last, s, m, k, b)
    c = 100 * rate / k
    return finite(((redemption + dc * c) / (price_ + a * c) - 1) * k / dsc, ((last >= s) | (s >= m) | ~k.isin(1.0, 2.0, 4.0), "#NUM!"))


def odd_first_value(s, m, issue, first, rate, yld, redemption, k, b) -> Column:
    """Regular coupons from ``first`` on, the first one in proportion to its odd period."""
    unit = 1 / k
    dfc, dsc, a = year_fraction(issue, first, b) / unit, year_fraction(s, first, b) / unit, year_fraction(issue, s, b) / unit
    n = coupon_number(first, m, k)
    c, y = 100 * rate / k, 1 + yld / k
    later = coupons_value(c, yld / k, dsc + 1, n)
    return redemption / F.pow(y, n + dsc) + c * dfc / F.pow(y, dsc) + F.when(n >= 1, later).otherwise(0.0) - c * a


@function("ODDFPRICE", "d d d d n n n n n=0")
def oddfprice(s, m, issue, first, rate, yld, redemption, frequency, basis):
    k, b = truncated(frequency), truncated(basis)
    return finite(odd_first_value(s, m, issue, first, rate, yld, redemption, F.when(k.isin(1.0, 2.0, 4.0), k), b), ((issue >= s) | (s >= first) | (first >= m) | ~k.isin(1.0, 2.0, 4.0), "#NUM!"))


@function("ODDFYIELD", "d d d d n n n n n=0")
def oddfyield(s, m, issue, first, rate, target, redemption, frequency, basis):
    k, b = truncated(frequency), truncated(basis)
    kk = F.when(k.isin(1.0, 2.0, 4.0), k)
    start = F.struct(F.lit(-0.99).alias("lo"), F.lit(10.0).alias("hi"))

    def step(r, _):
        mid = (r["lo"] + r["hi"]) / 2
        over = odd_first_value(s, m, issue, first, rate, mid, redemption, kk, b) > target
        return F.struct(F.when(over, mid).otherwise(r["lo"]).alias("lo"), F.when(over, r["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(50)), start, step, lambda r: (r["lo"] + r["hi"]) / 2)
    return finite(found, ((issue >= s) | (s >= first) | (first >= m) | (target <= 0) | ~k.isin(1.0, 2.0, 4.0), "#NUM!"))
