"""Tail probabilities as plain columns, and the same as SQL.

Both sums run over fixed nodes, so any SQL engine can follow them.  The argument is bound once, as a variable, and the nodes
are a literal array: the code that Spark generates does not grow with either, however long the argument is.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this, the error function is summed as a series; beyond, the tail as an integral over angles.
SERIES_TO = 1.5
TERMS, ANGLES, NODES = 24, 24, 40


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(nodes: list, term: Callable[[Column, Column], Column]) -> Column:
    """Folds a literal array: of numbers, or of (u, w)."""
    literal = lambda n: F.struct(F.lit(n[0]).alias("u"), F.lit(n[1]).alias("w")) if isinstance(n, tuple) else F.lit(n)
    return F.aggregate(F.array(*[literal(n) for n in nodes]), F.lit(0.0), term)


def _series() -> list[float]:
    """Coefficients of erf(z / sqrt(2)) / z in z * z, the highest power first."""
    return [(-1) ** n / (2.0**n * math.factorial(n) * (2 * n + 1)) * math.sqrt(2.0 / math.pi) for n in reversed(range(TERMS))]


def normal_two_sided(z: Column) -> Column:
    """P(|Z| > |z|): 2 / pi times the integral of exp(-z * z / (2 sin^2)) over a right angle, by midpoints."""
    angles = [(k + 0.5) * math.pi / (2 * ANGLES) for k in range(ANGLES)]
    near = lambda x: 1.0 - x * _sum(_series(), lambda out, c: out * x * x + c)
    far = lambda x: _sum([-0.5 / math.sin(a) ** 2 for a in angles], lambda out, c: out + F.exp(x * x * c)) / ANGLES
    return _bound(F.abs(z), lambda x: F.when(x < SERIES_TO, near(x)).otherwise(far(x)))


def _number(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def normal_sql(z: str) -> str:
    """normal_two_sided of an SQL expression."""
    x = f"abs({z})"
    poly = "0e0"
    for n in reversed(range(TERMS)):
        poly = f"({poly} * pow({x}, 2) + {_number((-1) ** n / (2.0**n * math.factorial(n) * (2 * n + 1)))})"
    angles = [(k + 0.5) * math.pi / (2 * ANGLES) for k in range(ANGLES)]
    tail = " + ".join(f"exp(pow({x}, 2) * {_number(-0.5 / math.sin(a) ** 2)})" for a in angles)
    return f"CASE WHEN {x} < {SERIES_TO}e0 THEN 1 - {poly} * {x} * {_number(math.sqrt(2.0 / math.pi))} ELSE ({tail}) / {ANGLES} END"


def _nodes() -> list[tuple[float, float]]:
    """Nodes and weights on 0..1 of the integral over u = w ** 4, which is smooth at 0 for any freedom above a half."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    x, w = (x + 1) / 2, w / 2
    return [(float(a**4), float(b * 4 * a**3)) for a, b in zip(x, w, strict=True)]


def _log_gamma(x: Column) -> Column:
    """Stirling's series, eight steps further on."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y) + 1.0 / (1260.0 * F.pow(y, F.lit(5.0)))
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return series - F.log(product)


def student_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| > |t|) with ``dof`` degrees of freedom: an integral of sin ** (dof - 1) from 0 to the angle of sqrt(dof) / t."""
    angle = lambda x: F.when(x["t"] == 0, math.pi / 2).otherwise(F.atan(F.sqrt(x["dof"]) / F.abs(x["t"])))
    front = lambda d: F.exp(_bound((d + 1.0) / 2.0, _log_gamma) - _bound(d / 2.0, _log_gamma)) * (2.0 / math.sqrt(math.pi))
    total = lambda x: _sum(_nodes(), lambda out, n: out + n["w"] * F.pow(F.sin(x["angle"] * n["u"]), x["dof"] - 1.0))
    both = _bound(F.struct(t.alias("t"), dof.alias("dof")), lambda x: F.struct(angle(x).alias("angle"), x["dof"].alias("dof"), x["t"].isNull().alias("none")))
    return _bound(both, lambda x: F.when((x["dof"] > 0) & ~x["none"], front(x["dof"]) * x["angle"] * total(x)))


def student_sql(t: str, dof: str) -> str:
    """student_two_sided of SQL columns."""
    angle = f"atan2(sqrt({dof}), abs({t}))"
    total = " + ".join(f"{_number(w)} * pow(sin({angle} * {_number(u)}), {dof} - 1)" for u, w in _nodes())
    return f"exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2)) * {_number(2.0 / math.sqrt(math.pi))} * {angle} * ({total})"
