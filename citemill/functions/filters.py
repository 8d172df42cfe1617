"""Metadata filters: nested dicts compiled to one boolean Column.

A filter maps fields to a bare value (equality) or to ``{"$op": value}``, and
combines filters under ``$and`` / ``$or``. The columns it names are flat, so a
compiled filter reaches the parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}
_COMBINE = {"$and": lambda a, b: a & b, "$or": lambda a, b: a | b}


def normalize_filter(where: dict | None) -> dict | None:
    """Several plain fields become one ``$and``; nothing becomes None."""
    if not where:
        return None
    plain = not any(key.startswith("$") for key in where)
    if plain and len(where) > 1:
        return {"$and": [{field: cond} for field, cond in where.items()]}
    return where


def compile_filter(where: dict | None, columns: Iterable[str]) -> Column | None:
    """One predicate for ``where``; None when there is nothing to filter.

    An unknown field or operator, or a logical key mixed with fields, raises
    ``ValueError``.
    """
    normal = normalize_filter(where)
    return None if normal is None else _predicate(normal, set(columns))


def _predicate(where: dict, columns: set[str]) -> Column:
    if len(where) != 1:
        raise ValueError(f"a filter needs exactly one key here: {sorted(where)}")
    (key, cond), = where.items()
    if key in _COMBINE:
        if not isinstance(cond, (list, tuple)) or not cond:
            raise ValueError(f"{key} needs a list of filters")
        parts = [_predicate(normalize_filter(part) or {}, columns) for part in cond]
        return reduce(_COMBINE[key], parts)
    if key.startswith("$"):
        raise ValueError(f"unknown logical operator {key}")
    if key not in columns:
        raise ValueError(f"unknown filter field {key}")
    return _compare(F.col(key), cond)


def _compare(column: Column, cond: Any) -> Column:
    if not isinstance(cond, dict):
        return column == F.lit(cond)
    if not cond or any(op not in _COMPARE for op in cond):
        raise ValueError(f"unknown comparison {sorted(cond)}")
    return reduce(lambda a, b: a & b, [_COMPARE[op](column, v) for op, v in cond.items()])


def request_filter(company: str | None = None, year: str | int | None = None) -> dict | None:
    """Filter of a request form: upper-case ticker and whole-number year.

    Blank fields and year 0 are left out; a year that is no number raises
    ``ValueError``.
    """
    where: dict[str, dict] = {}
    ticker = (company or "").strip().upper()
    if ticker:
        where["ticker"] = {"$eq": ticker}
    if str(year or "").strip():
        number = int(str(year).strip())
        if number:
            where["fiscal_year"] = {"$eq": number}
    return where or None


def among(column: Column, values: list) -> Column:
    """``column`` is one of ``values``, as tests of ten each: longer lists reach a
    parquet scan only as a range, which its bloom filters cannot check."""
    tests = [column.isin(values[i : i + 10]) for i in range(0, len(values), 10)]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
