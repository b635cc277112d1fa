"""Deferred column expressions: a table of queries can be read without a running session."""

from __future__ import annotations

import operator


class Lazy:
    """Records what is done to it; ``resolve`` does it."""

    def __init__(self, make):
        self._make = make

    def __call__(self, *args):
        return Lazy(lambda: resolve(self)(*map(resolve, args)))

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        return Lazy(lambda: getattr(resolve(self), name))

    def __getitem__(self, key):
        return Lazy(lambda: resolve(self)[key])

    def __neg__(self):
        return Lazy(lambda: -resolve(self))


def _infix(f):
    return lambda a, b: Lazy(lambda: f(resolve(a), resolve(b)))


for _name in ("add", "sub", "mul", "truediv", "mod", "and_", "or_", "lt", "le", "gt", "ge", "eq", "ne"):
    _f, _bare = getattr(operator, _name), _name.rstrip("_")
    setattr(Lazy, f"__{_bare}__", _infix(_f))
    if _bare in ("add", "sub", "mul", "truediv"):
        setattr(Lazy, f"__r{_bare}__", (lambda f: lambda b, a: Lazy(lambda: f(resolve(a), resolve(b))))(_f))


def resolve(x):
    return x._make() if isinstance(x, Lazy) else x


def _module(path: str, attribute: str | None = None) -> Lazy:
    def make():
        import importlib

        m = importlib.import_module(path)
        return getattr(m, attribute) if attribute else m

    return Lazy(make)


F = _module("pyspark.sql.functions")
fn = _module("tabulon.functions", "fn")
agg = _module("tabulon.functions", "agg")
c = F.col
