"""First-match classification from an ordered rule list.

Rules are data: a list of ``(condition, value)`` pairs evaluated top to bottom, the
first true condition wins, NULL conditions fall through (SQL CASE). The result is one
``CASE WHEN`` expression, evaluated once per row inside generated code.

The same rules can tell which of their arms fired: inside ``tracing_arms()`` a waterfall gives the arm's
name instead of its value: "1", "2", ... and "else", and for an arm whose value is itself a waterfall the
names of both, as in "2.1" or "else.3".
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: While arms are traced: the arm names of every waterfall built so far, with the column itself to keep its id alive.
_TRACE: ContextVar[dict[int, tuple[Column, list[str]]] | None] = ContextVar("arms", default=None)


def _v(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _case(rules: Sequence[tuple[Column, Any]], default: Any) -> Column:
    if not rules:
        return _v(default)
    cond, val = rules[0]
    out = F.when(cond, _v(val))
    for cond, val in rules[1:]:
        out = out.when(cond, _v(val))
    return out.otherwise(_v(default)) if default is not None else out


def waterfall(rules: Sequence[tuple[Column, Any]], default: Any = None) -> Column:
    trace = _TRACE.get()
    if trace is None:
        return _case(rules, default)
    names: list[str] = []

    def arm(name: str, value: Any) -> Column:
        inner = trace.get(id(value))
        names.extend([name] if inner is None else [f"{name}.{x}" for x in inner[1]])
        return F.lit(name) if inner is None else F.concat(F.lit(f"{name}."), inner[0])

    cases = [(cond, arm(str(i), value)) for i, (cond, value) in enumerate(rules, 1)]
    out = _case(cases, arm("else", default))
    trace[id(out)] = (out, names)
    return out


@contextmanager
def tracing_arms() -> Iterator[dict[int, tuple[Column, list[str]]]]:
    """Waterfalls built inside give arm names; the yielded table has each one's names under its ``id``."""
    token = _TRACE.set({})
    try:
        yield _TRACE.get()
    finally:
        _TRACE.reset(token)
