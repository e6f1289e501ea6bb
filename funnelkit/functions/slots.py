"""H: row-wise operators over numbered slot columns (x1, x2, x3), and I3."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from funnelkit.functions.columns import ColumnOrName, _c


def slot_coalesce(first: Sequence[ColumnOrName], second: Sequence[ColumnOrName]) -> list[Column]:
    """H1: slot-by-slot preference of one stage's slots over the other's."""
    return [F.coalesce(_c(a), _c(b)) for a, b in zip(first, second, strict=True)]


def slot_min(cols: Sequence[ColumnOrName]) -> Column:
    """H2: smallest filled slot, NULL when every slot is empty (``least`` skips NULL)."""
    return F.least(*[_c(c) for c in cols]) if len(cols) > 1 else _c(cols[0])


def slot_max(cols: Sequence[ColumnOrName]) -> Column:
    """H3: largest filled slot, NULL when every slot is empty."""
    return F.greatest(*[_c(c) for c in cols]) if len(cols) > 1 else _c(cols[0])


def slot_min_sentinel(cols: Sequence[ColumnOrName], sentinel, leak: bool = True) -> Column:
    """H4: minimum with empty slots read as ``sentinel``. With ``leak=True`` (the
    reference's behaviour, trap T10) an all-empty row yields the sentinel itself;
    ``leak=False`` returns NULL for it instead."""
    m = F.least(*[F.coalesce(_c(c), F.lit(sentinel)) for c in cols])
    if leak:
        return m
    return F.when(F.coalesce(*[_c(c) for c in cols]).isNotNull(), m)


def slot_count_leading(cols: Sequence[ColumnOrName]) -> Column:
    """H5: how many slots are filled consecutively from the first (trap T14: slot 1
    empty and slot 2 filled counts 0)."""
    # Build the first-match chain longest run first.
    chain = None
    for i in range(len(cols), 0, -1):
        cond = None
        for c in cols[:i]:
            t = _c(c).isNotNull()
            cond = t if cond is None else (cond & t)
        chain = F.when(cond, F.lit(i)) if chain is None else chain.when(cond, F.lit(i))
    return chain.otherwise(F.lit(0))


def null_safe_sum(guard: ColumnOrName, *terms: ColumnOrName) -> Column:
    """Sum of the terms with NULL read as 0, but NULL when ``guard`` is NULL."""
    total = None
    for t in terms:
        v = F.coalesce(_c(t), F.lit(0))
        total = v if total is None else total + v
    return F.when(_c(guard).isNotNull(), total)
