"""Arithmetic, vector arithmetic and distances as Column builders; everything stays in the JVM.

A distance between a column and a literal vector of at most ``UNROLL`` dimensions becomes one arithmetic expression
over ``v[i]``, which whole-stage code generation fuses; wider or column-to-column ones use higher-order functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNROLL = 64
EARTH_RADIUS = 6_371_000.0
Vector = Column | str | Sequence[float]


def number(x: complex | float) -> Column:
    """A literal; complex numbers are structs of re and im."""
    return F.struct(F.lit(x.real).alias("re"), F.lit(x.imag).alias("im")) if isinstance(x, complex) else F.lit(x)


def vector(v: Vector, kind: str = "double") -> Column:
    if isinstance(v, str):
        return F.col(v)
    if isinstance(v, Column):
        return v
    return F.array(*(number(x) if isinstance(x, complex) else F.lit(x).cast("boolean" if isinstance(x, bool) else kind) for x in v))


def _tree(terms: list[Column]) -> Column:
    """Their sum; a balanced tree keeps the expression shallow."""
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def literal(x: float) -> str:
    """A double in SQL text."""
    return f"{float(x)!r}D" if math.isfinite(x) else f"double('{'NaN' if x != x else 'Infinity' if x > 0 else '-Infinity'}')"


def _written(terms: list[str]) -> str:
    while len(terms) > 1:
        terms = [f"({terms[i]} + {terms[i + 1]})" if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def _pairs(a: Vector, b: Vector, term: Callable[[Column, Column], Column], sql: str | None = None) -> Column:
    """Sum of ``term`` over the components of two vectors, as doubles. ``sql``: the term of {x} and {y} as text, for a named
    column and a literal vector; one text is analysed faster than a tree that is built node by node."""
    if sql and isinstance(a, str) and not isinstance(b, Column | str) and 0 < len(b) <= UNROLL:
        name = "`" + a.replace("`", "``") + "`"
        return F.expr(_written(["(" + sql.format(x=f"double(get({name}, {i}))", y=literal(y)) + ")" for i, y in enumerate(b)]))
    fixed = next((x for x in (b, a) if not isinstance(x, Column | str)), None)
    if fixed is not None and len(fixed) <= UNROLL:
        other = vector(a if fixed is b else b)
        lit = [F.lit(float(x)) for x in fixed]
        return _tree([term(F.get(other, F.lit(i)).cast("double"), x) if fixed is b else term(x, F.get(other, F.lit(i)).cast("double")) for i, x in enumerate(lit)])
    zipped = F.zip_with(vector(a), vector(b), lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(zipped, F.lit(0.0), lambda s, x: s + x)


def _over(a: Column, b: Column) -> Column:
    """IEEE division: no error and no null on a zero divisor."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(math.nan)).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def manhattan(a: Vector, b: Vector) -> Column:
    return _pairs(a, b, lambda x, y: F.abs(x - y), "abs({x} - {y})")


def squaredeuclidean(a: Vector, b: Vector) -> Column:
    return _pairs(a, b, lambda x, y: (x - y) * (x - y), "({x} - {y}) * ({x} - {y})")


def euclidean(a: Vector, b: Vector) -> Column:
    return F.sqrt(squaredeuclidean(a, b))


def hamming(a: Vector, b: Vector) -> Column:
    return _pairs(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0), "if({x} != {y}, 1D, 0D)")


def innerproduct(a: Vector, b: Vector) -> Column:
    return _pairs(a, b, lambda x, y: x * y, "{x} * {y}")


def norm2(a: Vector, dim: int | None = None) -> Column:
    """``dim``: the number of components, if it is known; few are written out, so that code generation fuses them."""
    if not isinstance(a, Column | str):
        return F.lit(math.sqrt(sum(float(x) ** 2 for x in a)))
    if dim is not None and dim <= UNROLL:
        if isinstance(a, str):
            return F.sqrt(_pairs(a, [0.0] * dim, lambda x, y: x * x, "{x} * {x}"))
        x = [F.get(vector(a), F.lit(i)).cast("double") for i in range(dim)]
        return F.sqrt(_tree([v * v for v in x]))
    return F.sqrt(F.aggregate(vector(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Vector, b: Vector) -> Column:
    dims = [len(x) for x in (a, b) if not isinstance(x, Column | str)]
    dim = dims[0] if dims else None
    return F.lit(1.0) - _over(innerproduct(a, b), norm2(a, dim) * norm2(b, dim))


def chisquared(a: Vector, b: Vector) -> Column:
    return _pairs(a, b, lambda x, y: _over((y - x) * (y - x), y + x))


def haversine(a: Vector, b: Vector) -> Column:
    """Great-circle metres between (latitude, longitude) pairs in degrees."""
    p, q = vector(a), vector(b)
    la, lb = (F.radians(F.get(v, F.lit(0)).cast("double")) for v in (p, q))
    dlat, dlon = la - lb, F.radians(F.get(p, F.lit(1)).cast("double") - F.get(q, F.lit(1)).cast("double"))
    h = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(la) * F.cos(lb) * F.pow(F.sin(dlon / 2), F.lit(2))
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def hyperplane(a: Vector, normal: Vector, bias: float | Column) -> Column:
    return _over(innerproduct(a, normal) + (bias if isinstance(bias, Column) else F.lit(float(bias))), norm2(normal))


def manhattanw(a: Vector, b: Vector, weights: Sequence[float]) -> Column:
    if not isinstance(b, Column | str) and len(b) <= UNROLL:
        p = vector(a)
        return sum((F.lit(float(w)) * F.abs(F.get(p, F.lit(i)).cast("double") - F.lit(float(y))) for i, (w, y) in enumerate(zip(weights, b, strict=True))), F.lit(0.0))
    both = F.zip_with(vector(a), vector(b), lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(F.zip_with(both, vector(weights), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)


def complex_manhattan(a: Vector, b: Vector) -> Column:
    both = F.zip_with(vector(a), vector(b), lambda x, y: modulus(complex_sub(x, y)))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def complex_squaredeuclidean(a: Vector, b: Vector) -> Column:
    both = F.zip_with(vector(a), vector(b), lambda x, y: F.pow(x["re"].cast("double") - y["re"], F.lit(2.0)) + F.pow(x["im"].cast("double") - y["im"], F.lit(2.0)))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def complex_euclidean(a: Vector, b: Vector) -> Column:
    return F.sqrt(complex_squaredeuclidean(a, b))


def complex_dot(a: Vector, b: Vector) -> Column:
    """Sum of the products of ``a`` with the conjugates of ``b``."""
    products = F.zip_with(vector(a), vector(b), lambda x, y: complex_mul(x, conjugate(y)))
    total = lambda k: F.aggregate(F.transform(products, lambda x: x[k]), F.lit(0.0), lambda s, x: s + x)
    return _pair(total("re"), total("im"))


def complex_innerproduct(a: Vector, b: Vector) -> Column:
    """The modulus of the product; of vectors of doubles, 1 minus it, as the inventory has it."""
    return modulus(complex_dot(a, b))


def complex_innerproduct64(a: Vector, b: Vector) -> Column:
    return F.lit(1.0) - modulus(complex_dot(a, b))


def _pair(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def complex_add(a: Column, b: Column) -> Column:
    return _pair(a["re"] + b["re"], a["im"] + b["im"])


def complex_sub(a: Column, b: Column) -> Column:
    return _pair(a["re"].cast("double") - b["re"], a["im"].cast("double") - b["im"])


def complex_mul(a: Column, b: Column) -> Column:
    x, y, u, v = (c.cast("double") for c in (a["re"], a["im"], b["re"], b["im"]))
    return _pair(x * u - y * v, x * v + y * u)


def complex_div(a: Column, b: Column) -> Column:
    return complex_mul(a, inverse(b))


def conjugate(a: Column) -> Column:
    return _pair(a["re"].cast("double"), -a["im"].cast("double"))


def inverse(a: Column) -> Column:
    size = a["re"].cast("double") * a["re"] + a["im"].cast("double") * a["im"]
    return _pair(_over(a["re"].cast("double"), size), _over(-a["im"].cast("double"), size))


def modulus(a: Column) -> Column:
    return F.sqrt(a["re"].cast("double") * a["re"] + a["im"].cast("double") * a["im"])


def add(a: Column, b: Column) -> Column:
    return a + b


def sub(a: Column, b: Column) -> Column:
    return a - b


def mul(a: Column, b: Column) -> Column:
    return a * b


def div(a: Column, b: Column) -> Column:
    """IEEE division of real numbers; see ``intdiv`` for integers."""
    return _over(a.cast("double"), b.cast("double"))


def intdiv(a: Column, b: Column) -> Column:
    """Truncating integer division; null on a zero divisor."""
    return F.call_function("div", a, F.nullif(b, F.lit(0))).cast("long")


def larger(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def smaller(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def vadd(a: Vector, b: Vector) -> Column:
    return F.zip_with(vector(a), vector(b), lambda x, y: x + y)


def vsub(a: Vector, b: Vector) -> Column:
    return F.zip_with(vector(a), vector(b), lambda x, y: x - y)


def vmul(a: Vector, scalar: Column) -> Column:
    return F.transform(vector(a), lambda x: x * scalar)


def vmax(a: Vector, b: Vector) -> Column:
    return F.zip_with(vector(a), vector(b), lambda x, y: F.greatest(x, y))


def vmin(a: Vector, b: Vector) -> Column:
    return F.zip_with(vector(a), vector(b), lambda x, y: F.least(x, y))


def vsum(a: Vector) -> Column:
    return F.aggregate(vector(a), F.lit(0.0), lambda s, x: s + x.cast("double"))


def vdiv(a: Vector, b: Vector) -> Column:
    return F.zip_with(vector(a), vector(b), lambda x, y: _over(x.cast("double"), y.cast("double")))


def vtimes(a: Vector, b: Vector) -> Column:
    return F.zip_with(vector(a), vector(b), lambda x, y: x * y)


def lp(a: Vector, b: Vector, p: float | Column) -> Column:
    """Minkowski distance of order ``p``."""
    p = p if isinstance(p, Column) else F.lit(float(p))
    return F.pow(_pairs(a, b, lambda x, y: F.pow(F.abs(x - y), p)), F.lit(1.0) / p)


def part(a: Vector, start: int | Column, length: int | Column) -> Column:
    """``length`` components from ``start``, counted from 0."""
    start = start if isinstance(start, Column) else F.lit(start)
    return F.slice(vector(a), start + 1, length)


def each(f: Callable[..., Column]) -> Callable[..., Column]:
    """A scalar function applied to every component."""
    return lambda a, *more: F.transform(vector(a), lambda x: f(x, *more))


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b if isinstance(b, Column) else F.lit(float(b)))


def ln(a: Column) -> Column:
    """Logarithm; of 0 minus infinity, of negative numbers NaN."""
    x = a.cast("double")
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-math.inf)).otherwise(F.when(x.isNotNull(), F.lit(math.nan)))


def sqrt(a: Column) -> Column:
    return F.sqrt(a.cast("double"))


#: A function's overloads: the kinds of its arguments and the builder. ``num`` is int or real; a vector has ``[]``.
Overloads = list[tuple[tuple[str, ...], Callable[..., Column]]]
REGISTRY: dict[str, Overloads] = {}


def define(name: str, *overloads: tuple[tuple[str, ...], Callable[..., Column]]) -> None:
    """Add a function, or overloads of one."""
    REGISTRY.setdefault(name.lower(), []).extend(overloads)


_N, _V, _C, _CV, _B = "num", "num[]", "complex", "complex[]", "bool[]"
define("add", ((_N, _N), add), ((_V, _V), vadd), ((_C, _C), complex_add))
define("sub", ((_N, _N), sub), ((_V, _V), vsub), ((_C, _C), complex_sub))
define("mul", ((_N, _N), mul), ((_V, _N), vmul), ((_V, _V), vtimes), ((_C, _C), complex_mul))
define("intdiv", (("int", "int"), intdiv))
define("div", (("int", "int"), intdiv), ((_N, _N), div), ((_V, _V), vdiv), ((_C, _C), complex_div))
define("max", ((_N, _N), larger))
define("min", ((_N, _N), smaller))
for _name, _made in {"vadd": vadd, "vsub": vsub, "vmax": vmax, "vmin": vmin}.items():
    define(_name, ((_V, _V), _made))
define("vmul", ((_V, _N), vmul))
define("vsum", ((_V,), vsum))
define("norm2", ((_V,), norm2))
define("dot", ((_V, _V), innerproduct), ((_CV, _CV), complex_dot))
define("lp", ((_V, _V, _N), lp))
define("slice", ((_V, "int", "int"), part), ((_CV, "int", "int"), part), ((_B, "int", "int"), part))
for _name, _made in {"abs": F.abs, "sqrt": sqrt, "exp": F.exp, "ln": ln, "sin": F.sin, "cos": F.cos, "tan": F.tan, "atan": F.atan}.items():
    define(_name, ((_N,), _made), ((_V,), each(_made)))
define("abs", ((_C,), modulus))
define("pow", ((_N, _N), power), ((_V, _N), each(power)))
define("inverse", ((_C,), inverse))
define("conjugate", ((_C,), conjugate), ((_CV,), each(conjugate)))
define("manhattan", ((_V, _V), manhattan), ((_CV, _CV), complex_manhattan))
define("euclidean", ((_V, _V), euclidean), ((_CV, _CV), complex_euclidean))
define("squaredeuclidean", ((_V, _V), squaredeuclidean), ((_CV, _CV), complex_squaredeuclidean))
define("hamming", ((_V, _V), hamming), ((_B, _B), hamming))
define("cosine", ((_V, _V), cosine))
define("chisquared", ((_V, _V), chisquared))
define("innerproduct", ((_V, _V), innerproduct), (("complex32[]", "complex32[]"), complex_innerproduct), ((_CV, _CV), complex_innerproduct64))
define("haversine", ((_V, _V), haversine))
define("hyperplane", ((_V, _V, _N), hyperplane))
define("manhattanw", ((_V, _V, _V), manhattanw))

#: Other names of distances (fixed values).
DISTANCE_ALIASES = {"L1": "manhattan", "L2": "euclidean", "L2SQUARED": "squaredeuclidean", "CHI2": "chisquared", "IP": "innerproduct", "DOTP": "innerproduct"}


def kind_of(t: T.DataType) -> str:
    """The kind of a column type as signatures name it."""
    if isinstance(t, T.ArrayType):
        return kind_of(t.elementType) + "[]"
    if isinstance(t, T.StructType):
        return "complex32" if t and isinstance(t[0].dataType, T.FloatType) else "complex64"
    if isinstance(t, T.FloatType | T.DoubleType | T.DecimalType):
        return "real"
    if isinstance(t, T.IntegralType):
        return "int"
    return {"boolean": "bool"}.get(t.typeName(), t.typeName())


def literal_kind(x: Any, other: str = "") -> str:
    """The kind of a Python value; a list or complex number takes the width of the argument beside it."""
    if isinstance(x, list | tuple):
        return (literal_kind(x[0], other.removesuffix("[]")) if len(x) else "real") + "[]"
    if isinstance(x, complex):
        return other if other.startswith("complex") else "complex64"
    return "bool" if isinstance(x, bool) else "int" if isinstance(x, int) else "real" if isinstance(x, float) else "string"


def _fits(kind: str, wanted: str) -> bool:
    scalar, plain = kind.removesuffix("[]"), wanted.removesuffix("[]")
    if kind.endswith("[]") != wanted.endswith("[]"):
        return False
    return scalar == plain or plain == "num" and scalar in ("int", "real") or plain == "complex" and scalar.startswith("complex")


def overloads(name: str) -> Overloads:
    found = REGISTRY.get(DISTANCE_ALIASES.get(name.upper(), name.lower()))
    if found is None:
        raise ValueError(f"no function {name}")
    return found


def resolve(name: str, kinds: list[str]) -> Callable[..., Column]:
    """The builder of the first overload that takes arguments of these kinds."""
    for wanted, made in overloads(name):
        if len(wanted) == len(kinds) and all(map(_fits, kinds, wanted)):
            return made
    raise ValueError(f"no function {name}({', '.join(kinds)})")


def lookup(name: str) -> Callable[..., Column]:
    """The builder of a function's first overload, which for distances is that of real vectors."""
    return overloads(name)[0][1]


#: Functions for SQL text: arguments, result and body.
_ARRAYS = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
_TOTAL = "aggregate(zip_with(a, b, (x, y) -> {}), 0D, (s, x) -> s + x)"
_SIZE = "sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))"
_PART = "coalesce(try_divide({0}, {1}), if({1} = 0D, double('NaN'), NULL))"  # NaN on a zero divisor, NULL on NULL
SQL_FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "manhattan": (_ARRAYS, "DOUBLE", _TOTAL.format("abs(x - y)")),
    "squaredeuclidean": (_ARRAYS, "DOUBLE", _TOTAL.format("(x - y) * (x - y)")),
    "euclidean": (_ARRAYS, "DOUBLE", f"sqrt({_TOTAL.format('(x - y) * (x - y)')})"),
    "hamming": (_ARRAYS, "DOUBLE", _TOTAL.format("if(x != y, 1D, 0D)")),
    "innerproduct": (_ARRAYS, "DOUBLE", _TOTAL.format("x * y")),
    "cosine": (_ARRAYS, "DOUBLE", f"1D - {_PART.format(_TOTAL.format('x * y'), _SIZE.format('a') + ' * ' + _SIZE.format('b'))}"),
    "chisquared": (_ARRAYS, "DOUBLE", _TOTAL.format("if(x + y = 0, double('NaN'), (y - x) * (y - x) / (x + y))")),
    "hyperplane": (_ARRAYS + ", bias DOUBLE", "DOUBLE", _PART.format(f"{_TOTAL.format('x * y')} + bias", _SIZE.format("b"))),
    "manhattanw": (_ARRAYS + ", w ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(zip_with(a, b, (x, y) -> abs(x - y)), w, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "haversine": (_ARRAYS, "DOUBLE", f"2 * {EARTH_RADIUS}D * asin(least(1D, sqrt(pow(sin((radians(a[0]) - radians(b[0])) / 2), 2) + cos(radians(a[0])) * cos(radians(b[0])) * pow(sin(radians(a[1] - b[1]) / 2), 2))))"),
    "vadd": (_ARRAYS, "ARRAY<DOUBLE>", "zip_with(a, b, (x, y) -> x + y)"),
    "vsub": (_ARRAYS, "ARRAY<DOUBLE>", "zip_with(a, b, (x, y) -> x - y)"),
    "vmax": (_ARRAYS, "ARRAY<DOUBLE>", "zip_with(a, b, (x, y) -> greatest(x, y))"),
    "vmin": (_ARRAYS, "ARRAY<DOUBLE>", "zip_with(a, b, (x, y) -> least(x, y))"),
    "vmul": ("a ARRAY<DOUBLE>, k DOUBLE", "ARRAY<DOUBLE>", "transform(a, x -> x * k)"),
    "vsum": ("a ARRAY<DOUBLE>", "DOUBLE", "aggregate(a, 0D, (s, x) -> s + x)"),
    "norm2": ("a ARRAY<DOUBLE>", "DOUBLE", _SIZE.format("a")),
}


def register_sql(spark: SparkSession) -> None:
    """Make the vector functions known to SQL text; their bodies are SQL, so the optimiser sees through them."""
    for name, (arguments, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
