"""Worksheet values as columns: a value, and beside it an error code or null.

Functions take columns, literals or other functions' results and return a ``Cell``. A blank is
a null value without an error; an error is a null value with its code. Errors pass through
every function, the leftmost first. All of it stays in Catalyst expressions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error codes in the order of ERROR.TYPE.
ERROR_TYPES = {"#NULL!": 1, "#DIV/0!": 2, "#VALUE!": 3, "#REF!": 4, "#NAME?": 5, "#NUM!": 6, "#N/A": 7, "#GETTING_DATA": 8, "#SPILL!": 9, "#CONNECT!": 10, "#BLOCKED!": 11, "#UNKNOWN!": 12, "#FIELD!": 13, "#CALC!": 14}
EPOCH = dt.date(1899, 12, 30)


@dataclass(frozen=True)
class Cell:
    """``value`` is null where ``error`` isn't; ``error`` is None where none can arise."""

    value: Column
    error: Column | None = None
    #: "n" for a function's number and "t" for its text, which need no coercion.
    kind: str = ""
    #: The struct of both that a nested call evaluates once, if there is one.
    whole: Column | None = None

    def alias(self, name: str) -> Column:
        return self.value.alias(name)

    def shown(self) -> Column:
        """Text of the value, or the error's code."""
        if self.whole is not None:
            return let(self.whole, lambda w: F.coalesce(w["error"], as_text(w["value"])))
        text = let(self.value, as_text)
        return text if self.error is None else F.coalesce(self.error, text)

    def struct(self) -> Column:
        return F.struct(self.value.alias("value"), (F.lit(None).cast("string") if self.error is None else self.error).alias("error"))


#: Not empty while the body of a function with bound arguments runs: its value is bound too.
_LARGE: list[str] = []
FUNCTIONS: dict[str, Callable[..., Cell]] = {}


def cell(x) -> Cell:
    if isinstance(x, Cell):
        return x
    if isinstance(x, Column):
        return Cell(x)
    return Cell(F.lit(float(x) if isinstance(x, int) and not isinstance(x, bool) else x))


def bad(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule whose condition holds, else null."""
    out = None
    for condition, code in rules:
        out = F.when(condition, code) if out is None else out.when(condition, code)
    return out


def merged(*errors: Column | None) -> Column | None:
    some = [e for e in errors if e is not None]
    return None if not some else some[0] if len(some) == 1 else F.coalesce(*some)


def guarded(value: Column, error: Column | None, kind: str = "") -> Cell:
    return Cell(value, kind=kind) if error is None else Cell(F.when(error.isNull(), value), error, kind)


def judged(value: Column, error: Column) -> Column:
    """The struct of a value and its error, each mentioned once."""
    return let(error, lambda e: F.struct(F.when(e.isNull(), value).alias("value"), e.alias("error")))


def held(whole: Column, kind: str = "") -> Cell:
    """The cell of a ``judged`` struct: calls over it mention the struct once, not its value and its error apart."""
    return Cell(whole["value"], whole["error"], kind, whole)


def finite(value: Column, *rules: tuple[Column, str]) -> Cell:
    """A number that is an error by ``rules``, or #NUM! where it isn't finite or doesn't exist."""
    if _LARGE:
        return held(let(value, lambda v: judged(v, bad(*rules, (v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "#NUM!")))), "n")
    # Only of a finite number is the product with 0 equal to 0: one mention of the value instead of three.
    return guarded(value, bad(*rules, (~F.coalesce(value * 0.0 == 0.0, F.lit(False)), "#NUM!")), "n")


def as_text(x: Column) -> Column:
    """Whole numbers without decimals, logicals in capitals, other values as Spark writes them."""
    s = x.cast("string")
    number = F.typeof(x).isin("double", "float")
    logical = F.typeof(x) == "boolean"
    return F.when(logical, F.upper(s)).when(number, F.regexp_replace(F.regexp_replace(s, r"\.0$", ""), "^-0$", "0")).otherwise(s)


def number(x) -> Cell:
    """Blank is 0, logicals 1 or 0, text its number or #VALUE!."""
    if isinstance(x, (int, float)):
        return Cell(F.lit(float(x)))
    c = cell(x)
    if c.kind == "n":
        return c
    v = c.value.try_cast("double")
    # Of a double this compares a term with itself, which the optimizer folds, and with it the error.
    wrong = F.when(c.value.isNotNull() != v.isNotNull(), "#VALUE!")
    error = merged(c.error, wrong)
    return Cell(F.when(error.isNull(), F.coalesce(v, F.lit(0.0))), error)


def plain(x) -> Cell:
    """A number whose column is known to be numeric and without blanks: no checks."""
    if isinstance(x, (int, float)):
        return Cell(F.lit(float(x)))
    c = cell(x)
    return Cell(c.value.cast("double"), c.error)


def text(x) -> Cell:
    """Blank is the empty text."""
    if isinstance(x, str):
        return Cell(F.lit(x))
    c = cell(x)
    s = F.coalesce(c.value if c.kind == "t" else as_text(c.value), F.lit(""))
    return Cell(s if c.error is None else F.when(c.error.isNull(), s), c.error)


def logical(x) -> Cell:
    """Blank is false, numbers are true unless 0, other text is #VALUE!."""
    if isinstance(x, bool):
        return Cell(F.lit(x))
    c = cell(x)
    v = c.value.try_cast("boolean")
    error = merged(c.error, F.when(c.value.isNotNull() & v.isNull(), "#VALUE!"))
    return Cell(F.when(error.isNull(), F.coalesce(v, F.lit(False))), error)


def day(x) -> Cell:
    """A date: date and timestamp columns, or Python dates."""
    if isinstance(x, (dt.date, dt.datetime)):
        return Cell(F.lit(x).cast("date"))
    c = cell(x)
    error = merged(c.error, F.when(c.value.isNull(), "#VALUE!"))
    return Cell(c.value.cast("date"), error)


COERCE = {"n": number, "p": plain, "t": text, "l": logical, "d": day, "v": cell}


def function(name: str, kinds: str = "", *aliases: str, bound: bool | int = False, direct: bool = False):
    """Registers a worksheet function.

    ``kinds`` lists its arguments: n number, p number without checks, t text, l logical, d date,
    v any value; ``n=0`` gives a default, ``n=`` an optional argument that may be None, ``*n``
    takes the rest as a list. The body gets plain columns and returns a Column or a Cell.
    ``bound``: the arguments are evaluated once and the body mentions them as variables, which
    keeps expressions small where a body uses its arguments many times; ``bound=2`` does so only
    for calls with two columns or more. So are the arguments of
    any function if one is a function's result itself, unless it is ``direct``, as those with an
    Arrow UDF must be. Calls on plain columns stay plain expressions, which Spark compiles.
    """
    spec = kinds.split()

    def decorate(body):
        @wraps(body)
        def call(*args):
            given = _given(name, spec, args)
            some = bound is True or bound and sum(isinstance(a, (Cell, Column)) for a in args) >= bound
            if direct or not (some or any(isinstance(g, Cell) and g.error is not None for _, gs in given for g in (gs if isinstance(gs, list) else [gs]))):
                return _applied(body, given)
            return _bound(body, given)

        for n in (name, *aliases):
            if n in FUNCTIONS:
                raise ValueError(f"{n} is registered twice")
            FUNCTIONS[n] = call
        return call

    return decorate


def _given(name: str, spec: list[str], args: tuple) -> list[tuple[str, object]]:
    """(kind, argument) of each parameter; a list for those that take the rest, None for an omitted one."""
    out, rest = [], list(args)
    for k in spec:
        kind, _, default = k.partition("=")
        if kind[0] == "*":
            out.append((kind[1], rest))
            rest = []
        elif rest:
            out.append((kind, rest.pop(0)))
        elif "=" not in k:
            raise TypeError(f"{name} needs {sum('=' not in x and x[0] != '*' for x in spec)} arguments")
        else:
            out.append((kind, None if default == "" else default == "true" if kind == "l" else default if kind == "t" else float(default)))
    if rest:
        raise TypeError(f"{name} takes {len(spec)} arguments")
    return out


def _applied(body, given) -> Cell:
    values, errors = [], []
    for kind, g in given:
        if g is None:
            values.append(None)
            continue
        cells = [COERCE[kind](a) for a in (g if isinstance(g, list) else [g])]
        errors += [x.error for x in cells]
        values.append([x.value for x in cells] if isinstance(g, list) else cells[0].value)
    out = body(*values)
    out = out if isinstance(out, Cell) else Cell(out)
    error = merged(*errors)
    if error is None:
        return out
    if out.whole is not None:
        return held(F.when(error.isNull(), out.whole).otherwise(F.struct(F.lit(None).alias("value"), error.alias("error"))), out.kind)
    # The body's own error has left its value null already.
    return Cell(F.when(error.isNull(), out.value), merged(error, out.error), out.kind)


def _bound(body, given) -> Cell:
    """The call over arguments that are held once, each as the struct of its value and error. Numbers and texts of Python stay
    literals, so that what depends on them only is folded."""
    parts, shape = [], []
    for kind, g in given:
        cells = [] if g is None else [a if isinstance(a, (int, float, str)) else cell(a) for a in (g if isinstance(g, list) else [g])]
        shape.append((kind, None if g is None else [(len(parts) + i, x) for i, x in enumerate(cells)], isinstance(g, list)))
        parts += [F.lit(0) if not isinstance(x, Cell) else x.struct() if x.whole is None else x.whole for x in cells]
    kinds: list[str] = []

    def inside(x: Column) -> Column:
        again = []
        for kind, cells, many in shape:
            here = None if cells is None else [Cell(x[f"a{i}"]["value"], None if c.error is None else x[f"a{i}"]["error"], c.kind) if isinstance(c, Cell) else c for i, c in cells]
            again.append((kind, here if many or here is None else here[0]))
        _LARGE.append("")
        try:
            out = _applied(body, again)
        finally:
            _LARGE.pop()
        kinds.append(out.kind)
        return out.struct() if out.whole is None else out.whole

    whole = let(F.struct(*[h.alias(f"a{i}") for i, h in enumerate(parts)]), inside) if parts else inside(F.struct())
    return Cell(whole["value"], whole["error"], kinds[0], whole)


class Functions:
    """``fn.ROUND(x, 2)``, ``fn.NORM_S_DIST(z, True)`` or ``fn["NORM.S.DIST"](z, True)``."""

    def __getitem__(self, name: str) -> Callable[..., Cell]:
        return FUNCTIONS[name.upper()]

    def __getattr__(self, name: str) -> Callable[..., Cell]:
        for n in (name.upper(), name.upper().replace("_", ".")):
            if n in FUNCTIONS:
                return FUNCTIONS[n]
        raise AttributeError(name)

    def __dir__(self):
        return sorted(n.replace(".", "_") for n in FUNCTIONS)


fn = Functions()


def product(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, columns)


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``, which may mention it often."""
    return F.transform(F.array(value), body)[0]
