"""Logical, error and information functions, lambdas over arrays, and the inert platform functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import ERROR_TYPES, FUNCTIONS, Cell, bad, cell, function, guarded, held, judged, let, logical, merged, number, text

function("TRUE")(lambda: F.lit(True))
function("FALSE")(lambda: F.lit(False))
function("NOT", "l")(lambda x: ~x)


@function("AND", "*l")
def and_(xs):
    out = F.lit(True)
    for x in xs:
        out = out & x
    return out


@function("OR", "*l")
def or_(xs):
    out = F.lit(False)
    for x in xs:
        out = out | x
    return out


@function("XOR", "*l")
def xor(xs):
    return sum((x.cast("int") for x in xs), F.lit(0)) % 2 == 1


def chosen(pairs: list[tuple[Column, Cell]], other: Cell) -> Cell:
    """The cell of the first true condition: the errors of the others are dropped."""
    value, error = other.value, other.error if other.error is not None else F.lit(None).cast("string")
    any_error = other.error is not None
    for condition, c in reversed(pairs):
        value = F.when(condition, c.value).otherwise(value)
        error = F.when(condition, F.lit(None).cast("string") if c.error is None else c.error).otherwise(error)
        any_error = any_error or c.error is not None
    return Cell(value, error if any_error else None)


def if_(condition, then, otherwise=False) -> Cell:
    c = logical(condition)
    out = chosen([(c.value, cell(then))], cell(otherwise))
    return guarded(out.value, merged(c.error, out.error)) if c.error is not None else out


def ifs(*args) -> Cell:
    conditions = [logical(x) for x in args[::2]]
    out = chosen([(c.value, cell(v)) for c, v in zip(conditions, args[1::2])], Cell(F.lit(None), F.lit("#N/A")))
    return guarded(out.value, merged(*[c.error for c in conditions], out.error))


def switch(x, *args) -> Cell:
    c = cell(x)
    other = cell(args[-1]) if len(args) % 2 else Cell(F.lit(None), F.lit("#N/A"))
    out = chosen([(c.value.eqNullSafe(cell(v).value), cell(r)) for v, r in zip(args[::2], args[1::2])], other)
    return guarded(out.value, merged(c.error, out.error))


def choose(index, *values) -> Cell:
    i = number(index)

    def picked(w: Column) -> Column:
        k = F.floor(w["value"])
        out = chosen([(k == n, cell(v)) for n, v in enumerate(values, 1)], Cell(F.lit(None), F.lit("#VALUE!")))
        return judged(out.value, merged(w["error"], out.error))

    return held(let(i.struct() if i.whole is None else i.whole, picked))


def _replaced(c: Cell, condition: Column | None, fallback) -> Cell:
    return c if condition is None else chosen([(F.coalesce(condition, F.lit(False)), cell(fallback))], c)


def iferror(value, fallback) -> Cell:
    c, f = cell(value), cell(fallback)
    if c.whole is not None and f.error is None:
        return Cell(let(c.whole, lambda w: F.when(w["error"].isNotNull(), f.value).otherwise(w["value"])))
    return _replaced(c, None if c.error is None else c.error.isNotNull(), f)


def ifna(value, fallback) -> Cell:
    c = cell(value)
    return _replaced(c, None if c.error is None else c.error == "#N/A", fallback)


FUNCTIONS |= {"IF": if_, "IFS": ifs, "SWITCH": switch, "CHOOSE": choose, "IFERROR": iferror, "IFNA": ifna}


def _test(name: str, f) -> None:
    def call(x) -> Cell:
        c = cell(x)
        e = F.lit(None).cast("string") if c.error is None else c.error
        return Cell(F.coalesce(f(c.value, e), F.lit(False)))

    FUNCTIONS[name] = call


NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint")
_test("ISERROR", lambda v, e: e.isNotNull())
_test("ISERR", lambda v, e: e.isNotNull() & (e != "#N/A"))
_test("ISNA", lambda v, e: e == "#N/A")
_test("ISBLANK", lambda v, e: v.isNull() & e.isNull())
_test("ISNUMBER", lambda v, e: e.isNull() & v.isNotNull() & (F.typeof(v).isin(*NUMBERS) | F.startswith(F.typeof(v), F.lit("decimal"))))
_test("ISTEXT", lambda v, e: e.isNull() & v.isNotNull() & (F.typeof(v) == "string"))
_test("ISLOGICAL", lambda v, e: e.isNull() & v.isNotNull() & (F.typeof(v) == "boolean"))
_test("ISNONTEXT", lambda v, e: ~(e.isNull() & v.isNotNull() & (F.typeof(v) == "string")))
FUNCTIONS["ISREF"] = lambda x: Cell(F.lit(isinstance(x, Column)))
FUNCTIONS["ISOMITTED"] = lambda x=None: Cell(F.lit(x is None))
FUNCTIONS["NA"] = lambda: Cell(F.lit(None), F.lit("#N/A"))


def type_(x) -> Cell:
    c = cell(x)
    kind = F.typeof(c.value)
    code = F.when(F.startswith(kind, F.lit("array")), 64.0).when(kind == "string", 2.0).when(kind == "boolean", 4.0).otherwise(1.0)
    code = F.when(c.value.isNull() & (kind == "void"), 1.0).otherwise(code)
    return Cell(code if c.error is None else F.when(c.error.isNotNull(), 16.0).otherwise(code))


def error_type(x) -> Cell:
    c = cell(x)
    if c.error is None:
        return Cell(F.lit(None).cast("double"), F.lit("#N/A"))
    codes = F.create_map(*[F.lit(x) for k, v in ERROR_TYPES.items() for x in (k, float(v))])
    return held(let(F.try_element_at(codes, c.error), lambda code: judged(code, bad((code.isNull(), "#N/A")))))


FUNCTIONS |= {"TYPE": type_, "ERROR.TYPE": error_type}
#: Fixed values of the environment.
INFO = {"directory": "/", "numfile": "1", "origin": "$A:$A$1", "osversion": "Spark", "recalc": "Automatic", "release": "16.0", "system": "pcdos"}
FUNCTIONS["INFO"] = lambda kind: Cell(F.lit(INFO.get(kind.lower())), None if kind.lower() in INFO else F.lit("#VALUE!"))


# Lambdas: Python functions from columns to columns, over arrays.
def lambda_(f: Callable[..., Column]) -> Callable[..., Cell]:
    """A named function of columns; its arguments may be cells."""

    def call(*args) -> Cell:
        cells = [cell(a) for a in args]
        out = f(*[c.value for c in cells])
        out = out if isinstance(out, Cell) else Cell(out)
        return guarded(out.value, merged(*[c.error for c in cells], out.error))

    return call


def let_(*args) -> Cell:
    """LET(value, body) or LET(v1, v2, ..., body): each value is evaluated once and handed to ``body`` in order."""
    *values, body = args
    cells = [cell(v) for v in values]

    def nest(i: int, held: list[Column]) -> Column:
        return body(*held) if i == len(cells) else let(cells[i].value, lambda x: nest(i + 1, [*held, x]))

    return guarded(nest(0, []), merged(*[c.error for c in cells]))


def scan(start, array: Column, f) -> Cell:
    """All intermediate results of a fold, as an array."""
    c = cell(start)
    seed = F.array(c.value)
    steps = F.aggregate(array, seed, lambda acc, x: F.concat(acc, F.array(f(F.element_at(acc, -1), x))))
    return guarded(F.slice(steps, F.lit(2), F.greatest(F.size(steps) - 1, F.lit(0))), c.error)


FUNCTIONS |= {
    "LAMBDA": lambda_,
    "LET": let_,
    "MAP": lambda *a: Cell(F.transform(a[0], a[-1]) if len(a) == 2 else F.zip_with(*a)),
    "REDUCE": lambda start, array, f: guarded(F.aggregate(array, cell(start).value, f), cell(start).error),
    "SCAN": scan,
    "BYROW": lambda columns, f: Cell(f(F.array(*columns))),
    "MAKEARRAY": lambda rows, columns, f: Cell(F.transform(F.sequence(F.lit(1), F.lit(rows)), lambda r: F.transform(F.sequence(F.lit(1), F.lit(columns)), lambda c: f(r, c)))),
}


def _inert(name: str, code: str) -> None:
    FUNCTIONS[name] = lambda *_: Cell(F.lit(None).cast("string"), F.lit(code))


#: Functions that need a platform, and what they give without one.
for _code, _names in {"#VALUE!": ("CALL", "REGISTER.ID"), "#N/A": ("COPILOT", "RTD", "STOCKHISTORY", "CUBEVALUE", "CUBEMEMBERPROPERTY"), "#FIELD!": ("FIELDVALUE",), "#BLOCKED!": ("PY",)}.items():
    for _name in _names:
        _inert(_name, _code)
for _name in ("CUBEKPIMEMBER", "CUBEMEMBER", "CUBERANKEDMEMBER", "CUBESET"):
    FUNCTIONS[_name] = lambda connection, expression, *rest: text(rest[-1] if rest else expression)
function("CUBESETCOUNT", "t")(lambda s: F.when(s == "", 0.0).otherwise(1.0))
function("GETPIVOTDATA", "t v *v")(lambda field, anchor, rest: anchor)


@function("ADDRESS", "n n n=1 l=true t=")
def address(row, column, kind, a1, sheet=None):
    r, c, k = F.floor(row).cast("int"), F.floor(column).cast("int"), F.floor(kind).cast("int")
    letter = lambda i: F.call_function("char", i + 65)
    one, two = c - 1, F.floor((c - 27) / 26).cast("int")
    letters = F.when(c <= 26, letter(one)).when(c <= 702, F.concat(letter(two), letter((c - 1) % 26))).otherwise(F.concat(letter(F.floor((c - 703) / 676).cast("int")), letter(F.floor((c - 703) / 26).cast("int") % 26), letter((c - 1) % 26)))
    n = r.cast("string")
    plain = F.concat(F.when(k.isin(1, 3), "$").otherwise(""), letters, F.when(k.isin(1, 2), "$").otherwise(""), n)
    rc = F.concat(F.when(k.isin(1, 2), F.concat(F.lit("R"), n)).otherwise(F.concat(F.lit("R["), n, F.lit("]"))), F.when(k.isin(1, 3), F.concat(F.lit("C"), c.cast("string"))).otherwise(F.concat(F.lit("C["), c.cast("string"), F.lit("]"))))
    out = F.when(a1, plain).otherwise(rc)
    if sheet is not None:
        out = F.concat(F.when(sheet.rlike(r"^\w+$"), sheet).otherwise(F.concat(F.lit("'"), F.replace(sheet, F.lit("'"), F.lit("''")), F.lit("'"))), F.lit("!"), out)
    wrong = (r < 1) | (c < 1) | (r > 1048576) | (c > 16384) | ~k.isin(1, 2, 3, 4)
    return guarded(out, bad((wrong, "#VALUE!")))


