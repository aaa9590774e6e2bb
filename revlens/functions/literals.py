"""Large constant expressions, built with one JVM call each.

Lexicons, keyword positions and weight tables enter the plan as array / map /
struct literals (Catalyst folds them to constants). Built element by element
with ``F.lit`` every element costs a Python-to-JVM round trip -- thousands per
query, seconds of driver time before any task starts. Here a constant is
rendered as SQL literal text and parsed once by Spark. Strings that plain SQL
quoting cannot carry verbatim (a quote or a backslash) fall back to the
element-wise form, so the result is the same either way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class _Unquotable(ValueError):
    pass


def _sql(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, str):
        if "'" in v or "\\" in v:
            raise _Unquotable(v)
        return "'" + v + "'"
    if isinstance(v, dict):
        if not v:
            raise _Unquotable("empty map")
        return "map(" + ", ".join(f"{_sql(k)}, {_sql(x)}" for k, x in v.items()) + ")"
    if isinstance(v, (list, tuple)):
        if not v:
            raise _Unquotable("empty array")
        return "array(" + ", ".join(_sql(x) for x in v) + ")"
    raise TypeError(f"no literal form for {type(v).__name__}")


def _elementwise(v) -> Column:
    if isinstance(v, dict):
        return F.create_map(*[c for k, x in v.items() for c in (_elementwise(k), _elementwise(x))])
    if isinstance(v, (list, tuple)):
        return F.array(*[_elementwise(x) for x in v])
    return F.lit(v)


def const(value, empty_type: str | None = None) -> Column:
    """A constant array / map (nested lists, dicts, str, int, bool) as one
    literal expression. ``empty_type`` (e.g. ``'array<string>'``) types an
    empty value."""
    if isinstance(value, (list, tuple, dict)) and not value:
        if empty_type is None:
            raise ValueError("an empty constant needs empty_type")
        base = F.create_map() if isinstance(value, dict) else F.array()
        return base.cast(empty_type)
    try:
        return F.expr(_sql(value))
    except _Unquotable:
        return _elementwise(value)


def struct_array(rows: list[tuple], names: tuple[str, ...], empty_type: str | None = None) -> Column:
    """``array<struct<names...>>`` constant from tuples of str / int."""
    if not rows:
        if empty_type is None:
            raise ValueError("an empty constant needs empty_type")
        return F.array().cast(empty_type)
    try:
        body = ", ".join("named_struct(" + ", ".join(f"'{n}', {_sql(x)}" for n, x in zip(names, r)) + ")"
                         for r in rows)
        return F.expr(f"array({body})")
    except _Unquotable:
        return F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r)]) for r in rows])


def sql_literal(value) -> str | None:
    """SQL text of a constant, or None when plain quoting cannot carry it."""
    try:
        return _sql(value)
    except _Unquotable:
        return None
