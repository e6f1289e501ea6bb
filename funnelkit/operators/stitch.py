"""C4: the funnel stitch, a full outer join of two stages on their linking id.

Both inputs must carry disjoint column names (see ``prefixed``). Rows are kept from
both sides; the ids are then coalesced by the caller with the preference each output
column needs (F1/F2).

Two plans with the same result:

``stitch`` is one full outer join. NULL link ids are the common case (a late-stage
row that never had an early stage) and an outer join hashes every NULL key to one
shuffle partition, so the join runs on a salted key: NULL keys are replaced by a
deterministic hash of the row and a ``key IS NOT NULL`` term keeps them unmatched.
Its limit: AQE does not split a skewed partition of a full outer join, so a hot
non-NULL link id stays in one task.

``stitch_split`` (used by the mart) is the exact split
``(late LEFT JOIN early) UNION ALL (early LEFT ANTI JOIN distinct late keys)``.
Both joins stream their left side and can have a skewed left partition split by AQE;
the anti join's right side is de-duplicated with map-side partial aggregation, so a
hot id arrives as one row; NULL keys are salted on the streamed sides and filtered
from the build sides (a NULL never matches). Early-only predicates can also reach
the early scan in the anti branch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.functions.columns import match_key, salted_key
from funnelkit.operators.enrich import Lookup, join_lookups


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """All columns renamed with ``prefix`` (except ``keep``), in one projection."""
    return df.toDF(*[c if c in keep else prefix + c for c in df.columns])


def stitch(
    late: DataFrame,
    early: DataFrame,
    late_key: str,
    early_key: str,
    salt: bool = True,
    late_salt: Sequence[str] = (),
    early_salt: Sequence[str] = (),
) -> DataFrame:
    """Full outer join ``late`` x ``early`` on ``late_key = early_key``."""
    if not salt:
        return late.join(early, F.col(late_key) == F.col(early_key), "full")
    lk, ek = "__stitch_lk", "__stitch_ek"
    l2 = late.withColumn(lk, salted_key(late, late_key, *(late_salt or late.columns)))
    e2 = early.withColumn(ek, salted_key(early, early_key, *(early_salt or early.columns)))
    cond = (F.col(lk) == F.col(ek)) & F.col(late_key).isNotNull() & F.col(early_key).isNotNull()
    return l2.join(e2, cond, "full").drop(lk, ek)


def stitch_branches(
    late: DataFrame,
    early: DataFrame,
    late_key: str,
    early_key: str,
    late_salt: Sequence[str] = (),
    early_salt: Sequence[str] = (),
    late_keys: DataFrame | None = None,
    lookups: Sequence[Lookup] = (),
) -> tuple[DataFrame, DataFrame]:
    """The two parts of ``stitch_split``: late rows with the early row they link to, if any, and
    the early rows that no late row links to.

    ``late_keys`` gives the late stage whose keys count where ``late`` itself has been filtered:
    an early row is early-only if no late row at all has its key. ``lookups`` are left joins on
    ``early_key``: the rows are partitioned by it here, so only the lookups' sides are shuffled."""
    lk, ek, dk, ei = "__stitch_lk", "__stitch_ek", "__stitch_dk", "__stitch_ei"
    l2 = late.withColumn(lk, salted_key(late, late_key, *(late_salt or late.columns)))
    # Both branches take the early stage with all its rows, so that Spark computes and shuffles it once: a filter on the link
    # id would reach the scan of one branch alone. The second comparison tells an unlinked row's salt from an id.
    e2 = early.withColumn(ek, salted_key(early, early_key, *(early_salt or early.columns)))
    linked = F.coalesce(match_key(late, late, late_key, late_key) == F.col(ei), F.lit(False))
    e_all = e2.withColumn(ei, match_key(late, early, late_key, early_key)).withColumn(ek, match_key(late, e2, late_key, ek))
    matched = l2.join(e_all, (F.col(lk) == F.col(ek)) & F.col(late_key).isNotNull() & linked, "left").drop(ei)
    matched = join_lookups(
        matched, lk, lookups, [match_key(late, x.dim, late_key, x.dim_key) for x in lookups], F.col(early_key).isNotNull()
    ).drop(lk, ek)

    source = late if late_keys is None else late_keys
    keys = source.where(F.col(late_key).isNotNull()).select(match_key(early, source, early_key, late_key).alias(dk)).distinct()
    early_only = e2.join(keys, (F.col(ek) == F.col(dk)) & F.col(early_key).isNotNull(), "left_anti")
    early_only = join_lookups(
        early_only, ek, lookups, [match_key(early, x.dim, early_key, x.dim_key) for x in lookups], F.col(early_key).isNotNull()
    ).drop(ek)
    return matched, early_only


def stitch_split(late: DataFrame, early: DataFrame, late_key: str, early_key: str, **options) -> DataFrame:
    """Same rows as ``stitch``: matched and late-only rows from a left join, early-only
    rows from a left anti join against the distinct late keys (``stitch_branches``)."""
    matched, early_only = stitch_branches(late, early, late_key, early_key, **options)
    return matched.unionByName(early_only, allowMissingColumns=True)
