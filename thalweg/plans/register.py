"""Where queries are entered, with their SQL, and how floats are rounded for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Decimals that floats are rounded to for comparison.
PLACES = 4


def _off_ties(sql: str) -> str:
    """``round(x, n)`` as ``round(x + TIE, n)``."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 0, start + 6
        while depth or sql[end] not in ",)":
            depth += (sql[end] == "(") - (sql[end] == ")")
            end += 1
        out += f"{sql[at:start]}round({_off_ties(sql[start + 6 : end])} + {TIE}e0"
        at = end
    return (out + sql[at:]).replace("e-06e0", "e-06")


def query(sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (f"WITH RECURSIVE {', '.join(c.removeprefix('RECURSIVE ') for c in ctes)} " if ctes else "") + _off_ties(sql)
        return f

    return add


#: Added before rounding on both sides, so that exact decimal ties do not hang on the last bit of a sum.
TIE = 3.14159e-6


def rd(x: Column | str, places: int = PLACES) -> Column:
    return F.round(col(x) + F.lit(TIE), places)


def rounded(df: DataFrame, *names: str, places: int = PLACES) -> DataFrame:
    return df.withColumns({n: rd(n, places) for n in names})
