"""Radix conversions, complex numbers and units."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import Cell, bad, guarded, held, judged, let
from .core import function as _function
from .math import to_radix, truncated

function = partial(_function, bound=True)

#: radix: digits of a number, and the power of two at which its sign turns.
RADIX = {"BIN": (2, 10, 9), "OCT": (8, 10, 29), "HEX": (16, 10, 39)}


def _read(kind: str, s: Column) -> Column:
    """Value by two's complement; null where the text is wrong."""
    radix, digits, sign = RADIX[kind]
    some = {2: "01", 8: "0-7", 16: "0-9A-Fa-f"}[radix]
    read = lambda t: F.when(t.rlike(rf"\A[{some}]{{1,{digits}}}\z"), F.call_function("conv", t, F.lit(radix), F.lit(10)).cast("double")).when(t == "", 0.0)
    return let(let(F.trim(s), read), lambda v: F.when(v >= 2.0**sign, v - 2.0 ** (sign + 1)).otherwise(v))


def _write(kind: str, n: Column, places: Column | None) -> Cell:
    radix, digits, sign = RADIX[kind]
    shown = to_radix(F.when(n < 0, n + 2.0 ** (sign + 1)).otherwise(n), radix)
    rules = [((n < -(2.0**sign)) | (n >= 2.0**sign), "#NUM!")]
    if places is not None:
        k = truncated(places).cast("int")
        rules.append(((k < 1) | (k > 10) | ((n >= 0) & (F.length(shown) > k)), "#NUM!"))
        shown = F.when(n < 0, shown).otherwise(F.lpad(shown, F.greatest(k, F.length(shown)), "0"))
    return guarded(shown, bad(*rules))


def _conversions() -> None:
    for kind in RADIX:

        @function(f"{kind}2DEC", "t")
        def to_decimal(s, kind=kind):
            return held(let(_read(kind, s), lambda v: judged(v, bad((v.isNull(), "#NUM!")))))

        @function(f"DEC2{kind}", "n n=")
        def from_decimal(n, places=None, kind=kind):
            return _write(kind, truncated(n), places)

        for other in RADIX:
            if other != kind:

                @function(f"{kind}2{other}", "t n=")
                def between(s, places=None, kind=kind, other=other):
                    def written(v):
                        out = _write(other, v, places)
                        return judged(out.value, F.coalesce(bad((v.isNull(), "#NUM!")), out.error))

                    return held(let(_read(kind, s), written))


_conversions()

NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def parsed(z: Column) -> Column:
    """Struct of re, im and the suffix of a text ``a+bi``; nulls where it isn't one."""
    return let(F.trim(z), _parsed)


def _parsed(s: Column) -> Column:
    suffix = F.when(F.endswith(s, F.lit("j")), "j").otherwise("i")
    real_only = s.rlike(rf"^{NUMBER}$")
    imaginary = F.regexp_extract(s, rf"^({NUMBER})?([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)?)[ij]$", 2)
    whole = s.rlike(rf"^(?:{NUMBER})?[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)?[ij]$")
    only = s.rlike(rf"^(?:{NUMBER}|[+-]?)[ij]$")

    def split(x):
        im_text = x["im"]
        im = F.when(im_text.isin("", "+"), 1.0).when(im_text == "-", -1.0).otherwise(im_text.try_cast("double"))
        re_text = F.left(s, F.length(s) - F.length(im_text) - 1)
        re = F.when(x["only"] | (re_text == ""), 0.0).otherwise(re_text.try_cast("double"))
        return F.when(whole & (x["only"] | (im_text != "") & im_text.rlike("^[+-]")), F.struct(re.alias("re"), im.alias("im"), suffix.alias("suffix")))

    parts = let(only, lambda o: F.struct(o.alias("only"), F.when(o, F.regexp_replace(s, "[ij]$", "")).otherwise(imaginary).alias("im")))
    return F.when(real_only, F.struct(s.try_cast("double").alias("re"), F.lit(0.0).alias("im"), F.lit("").alias("suffix"))).otherwise(let(parts, split))


def _digits(x: Column) -> Column:
    """Shortest form of 15 significant digits."""
    def scale(v):
        return F.when(v == 0, 0.0).otherwise(14 - F.floor(F.log10(F.abs(v))))

    def rounded(v):
        return let(scale(v), lambda k: F.when(F.abs(k) > 300, v).otherwise(let(F.pow(F.lit(10.0), k), lambda p: F.floor(v * p + 0.5) / p)))

    def written(v):
        whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
        return F.when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))

    return let(let(x, rounded), written)


def shown(re: Column, im: Column, suffix: Column) -> Column:
    def joined(c):
        re, im = c["re"], c["im"]
        part = F.when(im == 1, "").when(im == -1, "-").otherwise(_digits(im))
        tail = F.concat(part, F.when(c["suffix"] == "", "i").otherwise(c["suffix"]))
        return F.when(im == 0, _digits(re)).when(re == 0, tail).otherwise(F.concat(_digits(re), F.when(im > 0, "+").otherwise(""), tail))

    return let(F.struct(re.alias("re"), im.alias("im"), suffix.alias("suffix")), joined)


def _number(name: str, f, *rules) -> None:
    @function(name, "t")
    def body(z):
        return held(let(parsed(z), lambda c: judged(f(c["re"], c["im"]), bad((c["re"].isNull(), "#NUM!"), *[(r(c["re"], c["im"]), code) for r, code in rules]))))


def _complex(name: str, f, *rules) -> None:
    """A complex function: f(re, im) gives (re, im)."""

    @function(name, "t")
    def body(z):
        def inside(c):
            re, im = f(c["re"], c["im"])
            return judged(shown(re, im, c["suffix"]), bad((c["re"].isNull(), "#NUM!"), *[(r(c["re"], c["im"]), code) for r, code in rules]))

        return held(let(parsed(z), inside), "t")


def times(a, b):
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def over(a, b):
    n = b[0] * b[0] + b[1] * b[1]
    return F.try_divide(a[0] * b[0] + a[1] * b[1], n), F.try_divide(a[1] * b[0] - a[0] * b[1], n)


size = lambda x, y: F.hypot(x, y)
angle = lambda x, y: F.atan2(y, x)
zero = lambda x, y: (x == 0) & (y == 0)
cosine = lambda x, y: (F.cos(x) * F.cosh(y), -F.sin(x) * F.sinh(y))
sine = lambda x, y: (F.sin(x) * F.cosh(y), F.cos(x) * F.sinh(y))
cosine_h = lambda x, y: (F.cosh(x) * F.cos(y), F.sinh(x) * F.sin(y))
sine_h = lambda x, y: (F.sinh(x) * F.cos(y), F.cosh(x) * F.sin(y))
logarithm = lambda k: lambda x, y: (F.ln(size(x, y)) / k, angle(x, y) / k)


def _inverse(f):
    return lambda x, y: over((F.lit(1.0), F.lit(0.0)), f(x, y))


_number("IMABS", size)
_number("IMARGUMENT", angle, (zero, "#DIV/0!"))
_number("IMREAL", lambda x, y: x)
_number("IMAGINARY", lambda x, y: y)
_complex("IMCONJUGATE", lambda x, y: (x, -y))
_complex("IMEXP", lambda x, y: (F.exp(x) * F.cos(y), F.exp(x) * F.sin(y)))
_complex("IMLN", logarithm(1.0), (zero, "#NUM!"))
_complex("IMLOG10", logarithm(math.log(10)), (zero, "#NUM!"))
_complex("IMLOG2", logarithm(math.log(2)), (zero, "#NUM!"))
_complex("IMSQRT", lambda x, y: (F.sqrt(size(x, y)) * F.cos(angle(x, y) / 2), F.sqrt(size(x, y)) * F.sin(angle(x, y) / 2)))
_complex("IMCOS", cosine)
_complex("IMSIN", sine)
_complex("IMCOSH", cosine_h)
_complex("IMSINH", sine_h)
_complex("IMSEC", _inverse(cosine))
_complex("IMSECH", _inverse(cosine_h))
_complex("IMCSC", _inverse(sine), (zero, "#NUM!"))
_complex("IMCSCH", _inverse(sine_h), (zero, "#NUM!"))
_complex("IMTAN", lambda x, y: over(sine(x, y), cosine(x, y)))
_complex("IMCOT", lambda x, y: over(cosine(x, y), sine(x, y)), (zero, "#NUM!"))


@function("COMPLEX", "n n t=i")
def complex_(re, im, suffix):
    return held(judged(shown(re, im, suffix), bad((~suffix.isin("i", "j"), "#VALUE!"))), "t")


def _pair(name: str, f, *rules) -> None:
    @function(name, "t t")
    def body(a, b):
        def inside(x):
            p, q = x["a"], x["b"]
            re, im = f((p["re"], p["im"]), (q["re"], q["im"]))
            mixed = (p["suffix"] != "") & (q["suffix"] != "") & (p["suffix"] != q["suffix"])
            suffix = F.when(p["suffix"] != "", p["suffix"]).otherwise(q["suffix"])
            return judged(shown(re, im, suffix), bad((p["re"].isNull() | q["re"].isNull(), "#NUM!"), (mixed, "#VALUE!"), *[(r(q["re"], q["im"]), c) for r, c in rules]))

        return held(let(F.struct(parsed(a).alias("a"), parsed(b).alias("b")), inside), "t")


_pair("IMSUB", lambda a, b: (a[0] - b[0], a[1] - b[1]))
_pair("IMDIV", over, (zero, "#NUM!"))


def _folded(name: str, start: tuple[float, float], f) -> None:
    @function(name, "*t")
    def body(zs):
        first = F.struct(F.lit(start[0]).alias("re"), F.lit(start[1]).alias("im"), F.lit("").alias("suffix"), F.lit(False).alias("mixed"))

        def step(a, z):
            re, im = f((a["re"], a["im"]), (z["re"], z["im"]))
            mixed = a["mixed"] | ((a["suffix"] != "") & (z["suffix"] != "") & (a["suffix"] != z["suffix"]))
            return F.struct(re.alias("re"), im.alias("im"), F.when(a["suffix"] != "", a["suffix"]).otherwise(z["suffix"]).alias("suffix"), mixed.alias("mixed"))

        total = F.aggregate(F.transform(F.array(*zs), parsed), first, step)
        return held(let(total, lambda t: judged(shown(t["re"], t["im"], t["suffix"]), bad((t["re"].isNull(), "#NUM!"), (t["mixed"], "#VALUE!")))), "t")


_folded("IMSUM", (0.0, 0.0), lambda a, b: (a[0] + b[0], a[1] + b[1]))
_folded("IMPRODUCT", (1.0, 0.0), times)


@function("IMPOWER", "t n")
def impower(z, n):
    def inside(c):
        r, t = F.pow(size(c["re"], c["im"]), n), angle(c["re"], c["im"]) * n
        return judged(shown(r * F.cos(t), r * F.sin(t), c["suffix"]), bad((c["re"].isNull(), "#NUM!"), (zero(c["re"], c["im"]) & (n <= 0), "#NUM!")))

    return held(let(parsed(z), inside), "t")


#: Units by dimension, each with its size in the dimension's base unit.
UNITS = {
    "mass": {"g": 1.0, "kg": 1000.0, "mg": 0.001, "lbm": 453.59237, "ozm": 28.349523125, "u": 1.660538782e-24, "grain": 0.06479891, "stone": 6350.29318, "ton": 907184.74, "sg": 14593.902937},
    "length": {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "um": 1e-6, "nm": 1e-9, "mi": 1609.344, "Nmi": 1852.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "ang": 1e-10, "ell": 1.143, "ly": 9.4607304725808e15, "pica": 0.0254 / 6},
    "time": {"sec": 1.0, "s": 1.0, "mn": 60.0, "min": 60.0, "hr": 3600.0, "day": 86400.0, "d": 86400.0, "yr": 31557600.0},
    "pressure": {"Pa": 1.0, "p": 1.0, "atm": 101325.0, "at": 101325.0, "mmHg": 133.322, "psi": 6894.757293168361, "Torr": 101325.0 / 760},
    "force": {"N": 1.0, "dyn": 1e-5, "dy": 1e-5, "lbf": 4.4482216152605, "pond": 0.00980665},
    "energy": {"J": 1.0, "e": 1e-7, "c": 4.184, "cal": 4.1868, "eV": 1.602176487e-19, "HPh": 2684519.537696173, "Wh": 3600.0, "flb": 1.3558179483314004, "BTU": 1055.05585262, "kWh": 3600000.0},
    "power": {"W": 1.0, "kW": 1000.0, "HP": 745.6998715822702, "PS": 735.49875},
    "magnetism": {"T": 1.0, "ga": 1e-4},
    "volume": {"l": 1.0, "L": 1.0, "lt": 1.0, "ml": 0.001, "tsp": 0.00492892159375, "tbs": 0.01478676478125, "oz": 0.0295735295625, "cup": 0.2365882365, "pt": 0.473176473, "qt": 0.946352946, "gal": 3.785411784, "m3": 1000.0, "ft3": 28.316846592, "in3": 0.016387064},
    "area": {"m2": 1.0, "ha": 10000.0, "ar": 100.0, "ft2": 0.09290304, "in2": 0.00064516, "mi2": 2589988.110336, "yd2": 0.83612736, "us_acre": 4046.872609874252, "uk_acre": 4046.8564224, "Morgen": 2500.0},
    "information": {"bit": 1.0, "byte": 8.0, "kbyte": 8000.0, "Mbyte": 8e6},
    "speed": {"m/s": 1.0, "m/h": 1 / 3600, "mph": 0.44704, "kn": 1852 / 3600},
}
#: Temperatures as (scale, offset) to kelvin.
TEMPERATURES = {"C": (1.0, 273.15), "cel": (1.0, 273.15), "F": (5 / 9, 459.67 * 5 / 9), "fah": (5 / 9, 459.67 * 5 / 9), "K": (1.0, 0.0), "kel": (1.0, 0.0), "Rank": (5 / 9, 0.0), "Reau": (1.25, 273.15)}


def _unit(name: Column) -> Column:
    rows = [(u, d, f, 0.0) for d, us in UNITS.items() for u, f in us.items()] + [(u, "temperature", f, o) for u, (f, o) in TEMPERATURES.items()]
    table = F.create_map(*[x for u, d, f, o in rows for x in (F.lit(u), F.struct(F.lit(d).alias("d"), F.lit(f).alias("f"), F.lit(o).alias("o")))])
    return F.try_element_at(table, name)


@function("CONVERT", "n t t")
def convert(x, a, b):
    def inside(u):
        p, q = u["p"], u["q"]
        return judged((x * p["f"] + p["o"] - q["o"]) / q["f"], bad((p["d"].isNull() | q["d"].isNull() | (p["d"] != q["d"]), "#N/A")))

    return held(let(F.struct(_unit(a).alias("p"), _unit(b).alias("q")), inside))


#: Units of each currency to one euro, and its decimals.
EURO = {"EUR": (1.0, 2), "BEF": (40.3399, 0), "LUF": (40.3399, 0), "DEM": (1.95583, 2), "ESP": (166.386, 0), "FRF": (6.55957, 2), "IEP": (0.787564, 2), "ITL": (1936.27, 0), "NLG": (2.20371, 2), "ATS": (13.7603, 2), "PTE": (200.482, 0), "FIM": (5.94573, 2), "GRD": (340.75, 0), "SIT": (239.64, 2)}


@function("EUROCONVERT", "n t t l=false n=0")
def euroconvert(x, a, b, full, triangulation):
    """Through the euro; rounded to the target's decimals unless ``full``."""
    table = F.create_map(*[v for k, (r, d) in EURO.items() for v in (F.lit(k), F.struct(F.lit(r).alias("r"), F.lit(d).alias("d")))])

    def inside(u):
        euro = x / u["p"]["r"]
        p10 = F.pow(F.lit(10.0), triangulation)
        euro = F.when(triangulation >= 3, F.signum(euro) * F.floor(F.abs(euro) * p10 + 0.5) / p10).otherwise(euro)
        v = F.when(a == b, x).otherwise(euro * u["q"]["r"])
        s = F.pow(F.lit(10.0), u["q"]["d"])
        return judged(F.when(full, v).otherwise(F.signum(v) * F.floor(F.abs(v) * s + 0.5) / s), bad((u["p"]["r"].isNull() | u["q"]["r"].isNull() | ((triangulation != 0) & (triangulation < 3)), "#VALUE!")))

    return held(let(F.struct(F.try_element_at(table, F.upper(a)).alias("p"), F.try_element_at(table, F.upper(b)).alias("q")), inside))
