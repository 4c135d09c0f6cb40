"""Formulas that can be evaluated over Spark columns or written out as SQL text.

A formula takes a program and expressions and returns expressions. ``SparkProgram`` keeps each ``let`` as a
column of a DataFrame, so a value used many times is computed once; ``SqlProgram`` nests one SELECT for each. The second serves to state
a query's plain SQL next to its DataFrame form.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Names of intermediate columns in an expression's text.
_LETS = re.compile(r"\b_v[0-9]+\b")


class Sql:
    """An SQL expression in the dialect of the oracle engine."""

    def __init__(self, text: str):
        self.text = text

    def __str__(self) -> str:
        return self.text

    def _op(self, op: str, other, swap: bool = False) -> Sql:
        a, b = (text(other), self.text) if swap else (self.text, text(other))
        return Sql(f"({a} {op} {b})")

    __add__ = lambda s, o: s._op("+", o)
    __radd__ = lambda s, o: s._op("+", o, True)
    __sub__ = lambda s, o: s._op("-", o)
    __rsub__ = lambda s, o: s._op("-", o, True)
    __mul__ = lambda s, o: s._op("*", o)
    __rmul__ = lambda s, o: s._op("*", o, True)
    __truediv__ = lambda s, o: s._op("/", o)
    __rtruediv__ = lambda s, o: s._op("/", o, True)
    __mod__ = lambda s, o: s._op("%", o)
    __and__ = lambda s, o: s._op("AND", o)
    __or__ = lambda s, o: s._op("OR", o)
    __lt__ = lambda s, o: s._op("<", o)
    __le__ = lambda s, o: s._op("<=", o)
    __gt__ = lambda s, o: s._op(">", o)
    __ge__ = lambda s, o: s._op(">=", o)
    __eq__ = lambda s, o: s._op("=", o)
    __ne__ = lambda s, o: s._op("<>", o)
    __neg__ = lambda s: Sql(f"(-{s.text})")
    __invert__ = lambda s: Sql(f"(NOT {s.text})")
    __hash__ = object.__hash__


def text(x) -> str:
    if isinstance(x, Sql):
        return x.text
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, float):
        return f"CAST({x!r} AS DOUBLE)"
    return f"({x})" if x < 0 else str(x)


def _is_sql(*xs) -> bool:
    return any(isinstance(x, Sql) for x in xs)


def _call(name: str, spark, *xs):
    return Sql(f"{name}({', '.join(map(text, xs))})") if _is_sql(*xs) else spark(*[x if isinstance(x, Column) else F.lit(x) for x in xs])


def where(condition, yes, no):
    if _is_sql(condition, yes, no):
        return Sql(f"(CASE WHEN {text(condition)} THEN {text(yes)}{'' if no is None else f' ELSE {text(no)}'} END)")
    return F.when(condition, yes).otherwise(no)


def sqrt(x):
    return _call("sqrt", F.sqrt, x)


def exp(x):
    return _call("exp", F.exp, x)


def log(x):
    return _call("ln", F.log, x)


def sin(x):
    return _call("sin", F.sin, x)


def cos(x):
    return _call("cos", F.cos, x)


def tan(x):
    return _call("tan", F.tan, x)


def acos(x):
    return _call("acos", F.acos, x)


def power(x, y):
    return _call("pow", F.pow, x, y)


def absolute(x):
    return _call("abs", F.abs, x)


def least(*xs):
    return _call("least", F.least, *xs)


def greatest(*xs):
    return _call("greatest", F.greatest, *xs)


def sign(x):
    """1 for zero and above, -1 below."""
    return where(x >= 0, 1.0, -1.0)


def _cast(x, sql: str, spark: str, plain):
    if _is_sql(x):
        return Sql(f"CAST({text(x)} AS {sql})")
    return x.cast(spark) if isinstance(x, Column) else plain(x)


def double(x):
    return _cast(x, "DOUBLE", "double", float)


def long(x):
    return _cast(x, "BIGINT", "long", int)


def integer(x):
    return _cast(x, "INTEGER", "int", int)


def rounded(x, digits: int = 6):
    """Rounded by plain arithmetic, alike in every engine; the odd half keeps decimal ties away from the border."""
    scale = float(10**digits)
    return double(_call("floor", F.floor, x * scale + 0.500131)) / scale


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def shl(x, n):
    """Left shift of a 64-bit integer."""
    if _is_sql(x, n):
        return Sql(f"({text(x) if isinstance(x, Sql) else f'CAST({x} AS BIGINT)'} << {text(n)})")
    if isinstance(x, int) and isinstance(n, int):
        return x << n
    return F.call_function("shiftleft", x if isinstance(x, Column) else F.lit(x).cast("long"), _column(n))


def shr(x, n):
    """Unsigned right shift of a 64-bit integer (the oracle engine needs a clear sign bit)."""
    if _is_sql(x, n):
        return Sql(f"({text(x)} >> {text(n)})")
    if isinstance(x, int) and isinstance(n, int):
        return x >> n
    return F.call_function("shiftrightunsigned", x if isinstance(x, Column) else F.lit(x).cast("long"), _column(n))


def _bits(x, y, sql: str, spark: str, plain):
    if _is_sql(x, y):
        return Sql(sql.format(text(x), text(y)))
    if isinstance(x, int) and isinstance(y, int):
        return plain(x, y)
    return getattr(_column(x), spark)(_column(y))


def band(x, y):
    return _bits(x, y, "({} & {})", "bitwiseAND", lambda a, b: a & b)


def bor(x, y):
    return _bits(x, y, "({} | {})", "bitwiseOR", lambda a, b: a | b)


def bxor(x, y):
    return _bits(x, y, "xor({}, {})", "bitwiseXOR", lambda a, b: a ^ b)


def bit_count(x):
    return Sql(f"CAST(bit_count({text(x)}) AS INTEGER)") if _is_sql(x) else F.bit_count(x)


def div(x, n):
    """Integer quotient of non-negative integers."""
    if _is_sql(x, n):
        return Sql(f"({text(x)} // {text(n)})")
    return F.call_function("div", x, n if isinstance(n, Column) else F.lit(n))


def minmod(*xs):
    """The value of least magnitude if all have one sign, else 0."""
    low, high = least(*xs), greatest(*xs)
    return where(low > 0, low, where(high < 0, high, 0.0))


class SparkProgram:
    """Collects intermediate columns over a DataFrame: those that don't need each other are added together, so the plan is as deep as the formula and not as long."""

    def __init__(self, df: DataFrame):
        self.df, self.depth, self.layers = df, {}, []

    def col(self, name: str) -> Column:
        return F.col(name)

    def let(self, value) -> Column:
        value = value if isinstance(value, Column) else F.lit(value)
        name = f"_v{len(self.depth) + 1}"
        self.depth[name] = depth = max((self.depth[n] + 1 for n in set(_LETS.findall(str(value)))), default=0)
        if depth == len(self.layers):
            self.layers.append([])
        self.layers[depth].append(value.alias(name))
        return F.col(name)

    def select(self, **columns) -> DataFrame:
        df = self.df
        for layer in self.layers:
            df = df.select("*", *layer)
        return df.select(*[(c if isinstance(c, Column) else F.lit(c)).alias(k) for k, c in columns.items()])


class SqlProgram:
    """The same as nested SELECTs."""

    def __init__(self, source: str):
        self.source, self.count = source, 0

    def col(self, name: str) -> Sql:
        return Sql(name)

    def let(self, value) -> Sql:
        self.count += 1
        name = f"_v{self.count}"
        self.source = f"(SELECT *, {text(value)} AS {name} FROM {self.source})"
        return Sql(name)

    def select(self, **columns) -> str:
        return f"SELECT {', '.join(f'{text(c)} AS {k}' for k, c in columns.items())} FROM {self.source}"
