"""Arithmetic, rounding, integer, trigonometric, bit and radix functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import FUNCTIONS, Cell, bad, finite, function, guarded, held, judged, let, product, text

HALF_TURN = math.pi


def simple(name: str, f, *rules) -> None:
    """A function of one number; ``rules`` make (condition, code) from it."""
    function(name, "n")(lambda x: finite(f(x), *[(c(x), code) for c, code in rules]))


def sign(x: Column) -> Column:
    return F.signum(x)


def truncated(x: Column) -> Column:
    """Towards zero, as a double."""
    return F.signum(x) * F.floor(F.abs(x)).cast("double")


def scaled(x: Column, d: Column, how) -> Column:
    p = F.pow(F.lit(10.0), truncated(d))
    return F.signum(x) * how(F.abs(x) * p) / p


simple("ABS", F.abs)
simple("INT", lambda x: F.floor(x).cast("double"))
simple("SIGN", F.signum)
simple("SQRT", F.sqrt, (lambda x: x < 0, "#NUM!"))
simple("SQRTPI", lambda x: F.sqrt(x * math.pi), (lambda x: x < 0, "#NUM!"))
simple("EXP", F.exp)
simple("LN", F.ln, (lambda x: x <= 0, "#NUM!"))
simple("LOG10", F.log10, (lambda x: x <= 0, "#NUM!"))
simple("SIN", F.sin)
simple("COS", F.cos)
simple("TAN", F.tan)
simple("SEC", lambda x: F.try_divide(F.lit(1.0), F.cos(x)), (lambda x: F.cos(x) == 0, "#DIV/0!"))
simple("CSC", lambda x: F.try_divide(F.lit(1.0), F.sin(x)), (lambda x: F.sin(x) == 0, "#DIV/0!"))
simple("COT", lambda x: F.try_divide(F.lit(1.0), F.tan(x)), (lambda x: F.tan(x) == 0, "#DIV/0!"))
simple("ASIN", F.asin, (lambda x: F.abs(x) > 1, "#NUM!"))
simple("ACOS", F.acos, (lambda x: F.abs(x) > 1, "#NUM!"))
simple("ATAN", F.atan)
simple("ACOT", lambda x: F.atan2(F.lit(1.0), x))
simple("SINH", F.sinh)
simple("COSH", F.cosh)
simple("TANH", F.tanh)
simple("SECH", lambda x: 1 / F.cosh(x))
simple("CSCH", lambda x: F.try_divide(F.lit(1.0), F.sinh(x)), (lambda x: x == 0, "#DIV/0!"))
simple("COTH", lambda x: F.try_divide(F.lit(1.0), F.tanh(x)), (lambda x: x == 0, "#DIV/0!"))
simple("ASINH", F.asinh)
simple("ACOSH", F.acosh, (lambda x: x < 1, "#NUM!"))
simple("ATANH", F.atanh, (lambda x: F.abs(x) >= 1, "#NUM!"))
simple("ACOTH", lambda x: 0.5 * F.ln(F.try_divide(x + 1, x - 1)), (lambda x: F.abs(x) <= 1, "#NUM!"))
simple("DEGREES", F.degrees)
simple("RADIANS", F.radians)
simple("EVEN", lambda x: F.signum(x) * F.ceil(F.abs(x) / 2).cast("double") * 2)
simple("ODD", lambda x: F.when(x == 0, 1.0).otherwise(F.signum(x) * (F.ceil((F.abs(x) - 1) / 2).cast("double") * 2 + 1)))


@function("ISEVEN", "n")
def iseven(x):
    return F.abs(truncated(x)) % 2 == 0


@function("ISODD", "n")
def isodd(x):
    return F.abs(truncated(x)) % 2 == 1


@function("ROUND", "n n")
def round_(x, d):
    """Half away from zero, after scaling in binary floating point."""
    return finite(scaled(x, d, lambda v: F.floor(v + 0.5)))


@function("ROUNDUP", "n n")
def roundup(x, d):
    return finite(scaled(x, d, F.ceil))


@function("ROUNDDOWN", "n n")
def rounddown(x, d):
    return finite(scaled(x, d, F.floor))


@function("TRUNC", "n n=0")
def trunc(x, d):
    return finite(scaled(x, d, F.floor))


def multiple(x: Column, s: Column, up: Column | bool) -> Column:
    q = F.try_divide(x, s)
    up = F.lit(up) if isinstance(up, bool) else up
    return F.when(s == 0, 0.0).otherwise(F.when(up, F.ceil(q)).otherwise(F.floor(q)).cast("double") * s)


@function("CEILING", "n n")
def ceiling(x, s):
    return finite(multiple(x, s, True), ((x > 0) & (s < 0), "#NUM!"), (s == 0, "#DIV/0!"))


@function("FLOOR", "n n")
def floor(x, s):
    return finite(multiple(x, s, False), ((x > 0) & (s < 0), "#NUM!"), (s == 0, "#DIV/0!"))


@function("CEILING.MATH", "n n=1 n=0")
def ceiling_math(x, s, mode):
    return finite(multiple(x, F.abs(s), (x >= 0) | (mode == 0)))


@function("FLOOR.MATH", "n n=1 n=0")
def floor_math(x, s, mode):
    return finite(multiple(x, F.abs(s), (x < 0) & (mode != 0)))


@function("CEILING.PRECISE", "n n=1", "ISO.CEILING")
def ceiling_precise(x, s):
    return finite(multiple(x, F.abs(s), True))


@function("FLOOR.PRECISE", "n n=1")
def floor_precise(x, s):
    return finite(multiple(x, F.abs(s), False))


@function("MROUND", "n n")
def mround(x, m):
    q = F.try_divide(x, m)
    return finite(F.when(m == 0, 0.0).otherwise(F.signum(q) * F.floor(F.abs(q) + 0.5) * m), (x * m < 0, "#NUM!"))


@function("QUOTIENT", "n n")
def quotient(n, d):
    return finite(truncated(F.try_divide(n, d)), (d == 0, "#DIV/0!"))


@function("MOD", "n n")
def mod(n, d):
    """The sign follows the divisor."""
    return finite(n - d * F.floor(F.try_divide(n, d)), (d == 0, "#DIV/0!"))


@function("POWER", "n n")
def power(b, e):
    return finite(F.pow(b, e), ((b == 0) & (e == 0), "#NUM!"), ((b == 0) & (e < 0), "#DIV/0!"))


@function("LOG", "n n=10")
def log(x, b):
    return finite(F.try_divide(F.ln(x), F.ln(b)), ((x <= 0) | (b <= 0) | (b == 1), "#NUM!"))


@function("ATAN2", "n n")
def atan2(x, y):
    """The abscissa comes first."""
    return finite(F.atan2(y, x), ((x == 0) & (y == 0), "#DIV/0!"))


@function("PI")
def pi():
    return F.lit(math.pi)


def running(lo: Column, hi: Column, step: Column | int, start: float, f) -> Column:
    """Folds f over lo, lo + step ... hi."""
    step = F.lit(step) if isinstance(step, int) else step
    span = F.when((hi - lo) * F.signum(step) >= 0, F.sequence(lo.cast("long"), hi.cast("long"), step.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(span, F.lit(start), lambda a, i: f(a, i.cast("double")))


def factorial(n: Column) -> Column:
    return running(F.lit(2), n, 1, 1.0, lambda a, i: a * i)


def choose(n: Column, k: Column) -> Column:
    k = F.least(k, n - k)
    return F.floor(running(F.lit(1), k, 1, 1.0, lambda a, i: a * (n - k + i) / i) + 0.5).cast("double")


LIMIT = 1e6


@function("FACT", "n")
def fact(n):
    t = truncated(n)
    return finite(factorial(F.least(t, F.lit(171.0))), ((t < 0) | (t > 170), "#NUM!"))


@function("FACTDOUBLE", "n")
def factdouble(n):
    t = F.least(truncated(n), F.lit(301.0))
    return finite(F.when(t <= 0, 1.0).otherwise(running(t, F.lit(1), -2, 1.0, lambda a, i: a * i)), (t < -1, "#NUM!"))


@function("COMBIN", "n n")
def combin(n, k):
    n, k = truncated(n), truncated(k)
    wrong = (n < 0) | (k < 0) | (k > n) | (n > LIMIT)
    return finite(F.when(~wrong, choose(n, k)), (wrong, "#NUM!"))


@function("COMBINA", "n n")
def combina(n, k):
    n, k = truncated(n), truncated(k)
    wrong = (n < 0) | (k < 0) | ((n == 0) & (k > 0)) | (n + k > LIMIT)
    return finite(F.when(~wrong, F.when(k == 0, 1.0).otherwise(choose(n + k - 1, k))), (wrong, "#NUM!"))


@function("PERMUT", "n n")
def permut(n, k):
    n, k = truncated(n), truncated(k)
    wrong = (n < 0) | (k < 0) | (k > n) | (k > LIMIT)
    return finite(F.when(~wrong, running(n - k + 1, n, 1, 1.0, lambda a, i: a * i)), (wrong, "#NUM!"))


@function("PERMUTATIONA", "n n")
def permutationa(n, k):
    n, k = truncated(n), truncated(k)
    return finite(F.pow(n, k), ((n < 0) | (k < 0), "#NUM!"))


@function("MULTINOMIAL", "*n")
def multinomial(ns):
    ns = [truncated(n) for n in ns]
    wrong = F.lit(False)
    for n in ns:
        wrong = wrong | (n < 0)
    total = sum(ns[1:], ns[0])
    return finite(F.when(~wrong, F.floor(factorial(total) / product([factorial(n) for n in ns]) + 0.5).cast("double")), (wrong | (total > 170), "#NUM!"))


@function("SERIESSUM", "n n n *n")
def seriessum(x, n, m, coefficients):
    total = F.lit(0.0)
    for i, c in enumerate(coefficients):
        total = total + c * F.pow(x, n + i * m)
    return finite(total)


@function("GCD", "*n")
def gcd(ns):
    """Euclid's steps as a fold: 80 suffice below 2^53."""
    return _fold_pairs(ns, lambda a, b: _gcd(a, b))


@function("LCM", "*n")
def lcm(ns):
    return _fold_pairs(ns, lambda a, b: F.when((a == 0) | (b == 0), 0.0).otherwise(F.try_divide(a, _gcd(a, b)) * b))


def _gcd(a: Column, b: Column) -> Column:
    start = F.struct(a.alias("a"), b.alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, 0.0).otherwise(s["a"] % s["b"]).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, step, lambda s: s["a"])


def _fold_pairs(ns: list[Column], f) -> Cell:
    ns = [truncated(n) for n in ns]
    wrong = F.lit(False)
    out = ns[0]
    for n in ns:
        wrong = wrong | (n < 0) | (n >= 2.0**53)
    for n in ns[1:]:
        out = f(out, n)
    return finite(out, (wrong, "#NUM!"))


def _bits(name: str, f) -> None:
    @function(name, "n n")
    def body(a, b):
        top = 2.0**48
        wrong = (a < 0) | (b < 0) | (a >= top) | (b >= top) | (a != F.floor(a)) | (b != F.floor(b))
        return guarded(f(a.cast("long"), b.cast("long")).cast("double"), bad((wrong, "#NUM!")))


_bits("BITAND", lambda a, b: a.bitwiseAND(b))
_bits("BITOR", lambda a, b: a.bitwiseOR(b))
_bits("BITXOR", lambda a, b: a.bitwiseXOR(b))


def _shift(name: str, way: int) -> None:
    @function(name, "n n")
    def body(x, n):
        n = truncated(n) * way
        out = F.when(n >= 0, x * F.pow(F.lit(2.0), n)).otherwise(F.floor(x * F.pow(F.lit(2.0), n)).cast("double"))
        wrong = (x < 0) | (x >= 2.0**48) | (x != F.floor(x)) | (F.abs(n) > 53) | (out >= 2.0**48)
        return guarded(out, bad((wrong, "#NUM!")))


_shift("BITLSHIFT", 1)
_shift("BITRSHIFT", -1)


@function("DELTA", "n n=0")
def delta(a, b):
    return (a == b).cast("double")


@function("GESTEP", "n n=0")
def gestep(x, s):
    return (x >= s).cast("double")


DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def from_radix(s: Column, radix: Column) -> Column:
    """Value of the digits of ``s``; null where one isn't below the radix."""
    digits = F.split(F.upper(s), "")
    place = lambda c: (F.instr(F.lit(DIGITS), c) - 1).cast("double")
    return F.aggregate(F.transform(F.filter(digits, lambda c: c != ""), lambda c: F.when((F.length(c) == 1) & F.contains(F.lit(DIGITS), c), F.instr(F.lit(DIGITS), c) - 1)), F.lit(0.0), lambda a, d: F.when((d >= 0) & (d < radix), a * radix + d.cast("double")))


def to_radix(n: Column, radix: Column | int) -> Column:
    return F.call_function("conv", n.cast("long").cast("string"), F.lit(10), F.lit(radix) if isinstance(radix, int) else radix.cast("int"))


@function("DECIMAL", "t n")
def decimal(s, radix):
    r = truncated(radix)
    return finite(from_radix(F.trim(s), r), ((r < 2) | (r > 36), "#NUM!"))


@function("BASE", "n n n=0")
def base(n, radix, width):
    n, r = F.floor(n), truncated(radix)
    digits = to_radix(n, F.least(F.greatest(r, F.lit(2)), F.lit(36)))
    return guarded(F.lpad(digits, F.greatest(width.cast("int"), F.length(digits)), "0"), bad(((n < 0) | (n >= 2.0**53) | (r < 2) | (r > 36) | (width < 0) | (width > 255), "#NUM!")))


#: The numerals, and for each looser form the further subtractive pairs.
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
ROMAN_FORMS = {
    1: [(950, "LM"), (450, "LD"), (95, "VC"), (45, "VL")],
    2: [(990, "XM"), (490, "XD"), (99, "IC"), (49, "IL")],
    3: [(995, "VM"), (495, "VD")],
    4: [(999, "IM"), (499, "ID")],
}


@function("ROMAN", "n n=0")
def roman(n, form):
    n, form = F.floor(n).cast("int"), F.floor(form).cast("int")
    pairs = sorted([(v, s, 0) for v, s in ROMAN] + [(v, s, f) for f, more in ROMAN_FORMS.items() for v, s in more], reverse=True)
    table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s"), F.lit(f).alias("f")) for v, s, f in pairs])
    start = F.struct(n.alias("left"), F.lit("").alias("out"))

    def step(a, x):
        k = F.when(x["f"] <= form, F.floor(a["left"] / x["v"])).otherwise(0).cast("int")
        return F.struct((a["left"] - k * x["v"]).alias("left"), F.concat(a["out"], F.repeat(x["s"], k)).alias("out"))

    return guarded(F.aggregate(table, start, step, lambda a: a["out"]), bad(((n < 0) | (n > 3999) | (form < 0) | (form > 4), "#VALUE!")))


@function("ARABIC", "t")
def arabic(s):
    """Each numeral counts against the next larger one."""
    clean = F.upper(F.trim(s))
    minus = F.startswith(clean, F.lit("-"))
    body = F.when(minus, F.substr(clean, F.lit(2))).otherwise(clean)
    values = F.create_map(*[x for v, c in ROMAN if len(c) == 1 for x in (F.lit(c), F.lit(v))])
    digits = F.transform(F.filter(F.split(F.reverse(body), ""), lambda c: c != ""), lambda c: F.try_element_at(values, c))
    start = F.struct(F.lit(0).alias("last"), F.lit(0).alias("sum"))
    total = F.aggregate(digits, start, lambda a, d: F.struct(d.alias("last"), F.when(d < a["last"], a["sum"] - d).otherwise(a["sum"] + d).alias("sum")), lambda a: a["sum"].cast("double"))
    return held(let(total, lambda n: judged(F.when(minus, -n).otherwise(n), bad((n.isNull(), "#VALUE!")))))


@function("RAND", "n=")
def rand(seed=None):
    return F.rand(None if seed is None else 0)


@function("RANDBETWEEN", "n n")
def randbetween(lo, hi):
    a, b = F.ceil(lo), F.floor(hi)
    return guarded(F.floor(F.rand() * (b - a + 1)).cast("double") + a, bad((a > b, "#NUM!")))


#: Infix and prefix operators by their sign.
@function("+", "n n")
def add(a, b):
    return finite(a + b)


@function("-", "n n=")
def subtract(a, b=None):
    return finite(-a if b is None else a - b)


@function("*", "n n")
def multiply(a, b):
    return finite(a * b)


@function("/", "n n")
def divide(a, b):
    return finite(F.try_divide(a, b), (b == 0, "#DIV/0!"))


@function("%", "n")
def percent(a):
    return finite(a / 100)


FUNCTIONS["^"] = FUNCTIONS["POWER"]


@function("&", "t t")
def join(a, b):
    return F.concat(a, b)


def _compare(name: str, f) -> None:
    """Typed columns of one kind; text without case, a blank equal to the other side's empty value."""

    @function(name, "v v")
    def body(a, b):
        number = F.typeof(a).isin("double", "float", "int", "bigint")
        return F.when(number, f(F.coalesce(a.try_cast("double"), F.lit(0.0)), F.coalesce(b.try_cast("double"), F.lit(0.0)))).otherwise(f(F.lower(text(a).value), F.lower(text(b).value)))


for _name, _f in {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}.items():
    _compare(_name, _f)
