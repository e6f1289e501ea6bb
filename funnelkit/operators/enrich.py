"""Enrichment by left joins, membership flags and the fan-out guard.

Every enrichment is a left join that must not change the row count, which holds only
when the right side is unique on its key. The reference never checks this; here
``key_violations`` reports duplicate keys and ``enrich_left(..., unique=True)``
de-duplicates nothing silently: it is the caller's contract, checked by the report.

Broadcast: no join here carries a broadcast hint. Spark's planner broadcasts a side
only when its measured size is under ``spark.sql.autoBroadcastJoinThreshold`` (scan
statistics) or, with AQE, when the shuffled size at runtime is under the adaptive
threshold; anything larger stays a sort-merge join. Dimensions that stay small are
broadcast by that check, facts at the spine's grain are not.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.functions.columns import ColumnOrName, _c, key_type, match_key, salted_key


def enrich_left(
    df: DataFrame,
    dim: DataFrame,
    key: ColumnOrName,
    dim_key: str,
    columns: Sequence[str] | dict[str, str] | None = None,
    spread_nulls: bool = False,
    salt_cols: Sequence[str] = (),
) -> DataFrame:
    """``df LEFT JOIN dim ON key = dim.dim_key``; ``key`` may be any column
    expression of ``df`` (e.g. a coalesce of two stages' ids, C5/C8).

    ``columns`` picks dim columns (dict: output -> dim column). With ``spread_nulls``
    NULL keys are salted (deterministic hash of ``salt_cols``) so they do not all land
    in one shuffle partition; they still never match.
    """
    sel = columns if isinstance(columns, dict) else {c: c for c in (columns or [c for c in dim.columns if c != dim_key])}
    rk = "__rk"
    k = _c(key)
    if spread_nulls:
        lk = "__lk"
        kind = key_type(df, key)
        left = df.withColumn(lk, salted_key(df, k, *(salt_cols or df.columns), kind=kind))
        right = dim.select(match_key(df, dim, k, dim_key, kind).alias(rk), *[F.col(src).alias(out) for out, src in sel.items()])
        out = left.join(right, (F.col(lk) == F.col(rk)) & k.isNotNull(), "left")
        return out.drop(lk, rk)
    right = dim.select(F.col(dim_key).alias(rk), *[F.col(src).alias(out) for out, src in sel.items()])
    return df.join(right, k == F.col(rk), "left").drop(rk)


@dataclass(frozen=True)
class Step:
    """One link of an enrichment chain: join ``dim`` on ``key`` (a column of the
    frame built so far, possibly produced by an earlier step) = ``dim_key``."""

    dim: DataFrame
    key: ColumnOrName
    dim_key: str
    columns: Sequence[str] | dict[str, str] | None = None


def enrich_chain(df: DataFrame, steps: Sequence[Step], spread_nulls: bool = True) -> DataFrame:
    """Successive left joins, each keyed by an output of the previous one. A link that found
    nothing gives a NULL key to the next, so NULL keys are spread over all tasks."""
    out = df
    for s in steps:
        out = enrich_left(out, s.dim, s.key, s.dim_key, s.columns, spread_nulls, df.columns)
    return out


def flag_member(
    df: DataFrame, keys: DataFrame, key: ColumnOrName, keys_col: str, name: str, spread_nulls: bool = True
) -> DataFrame:
    """0/1 column ``name``: does ``key`` occur in ``keys[keys_col]``?

    The key list is de-duplicated first (an aggregation with map-side combine), so a
    repeated key can never multiply rows. NULL keys are spread and never match.
    """
    marks = keys.select(keys_col).where(F.col(keys_col).isNotNull()).distinct().withColumn("__mark", F.lit(1))
    out = enrich_left(df, marks, key, keys_col, {"__mark": "__mark"}, spread_nulls)
    return out.withColumn(name, F.coalesce(F.col("__mark"), F.lit(0))).drop("__mark")


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys occurring more than once (with their count). An empty result proves
    the table is safe to enrich with."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)



@dataclass(frozen=True)
class Lookup:
    """One right side of a key group: ``dim`` keyed by ``dim_key``; ``columns`` maps
    output name -> dim column. ``member`` turns it into a 0/1 membership flag (C9)
    named by the single output of ``columns``.

    ``guard`` watches the fan-out (C10) where the join happens, without reading ``dim`` again:
    its rows are reduced to one per key with their number, an aggregation on the key the join
    shuffles by anyway. ``"count"`` adds the number as column ``fan_<role>`` and keeps one row;
    ``"raise"`` stops the run when a row meets a key that occurs more than once.
    """

    dim: DataFrame
    dim_key: str
    columns: dict[str, str]
    member: bool = False
    role: str = ""
    guard: str | None = None


def _right_side(lookup: Lookup, key: Column, name: str) -> DataFrame:
    """``dim`` with its key as ``name`` and its columns under their output names."""
    if lookup.member:
        ((out, _src),) = lookup.columns.items()
        right = lookup.dim.select(key.alias(name)).where(F.col(name).isNotNull()).distinct()
        return right.select(name, F.lit(1).alias(out))
    right = lookup.dim.select(key.alias(name), *[F.col(src).alias(out) for out, src in lookup.columns.items()])
    if lookup.guard is None:
        return right
    one = right.where(F.col(name).isNotNull()).groupBy(name).agg(
        F.count(F.lit(1)).alias(f"fan_{lookup.role}"), F.min(F.struct(*lookup.columns)).alias("__one")
    )
    return one.select(name, f"fan_{lookup.role}", *[F.col("__one").getField(out).alias(out) for out in lookup.columns])


def join_lookups(df: DataFrame, key: str, lookups: Sequence[Lookup], dim_keys: Sequence[Column], present: Column | None = None) -> DataFrame:
    """Left joins of ``lookups`` on column ``key``; ``dim_keys`` are their keys in its type. Rows for which
    ``present`` does not hold match nothing."""
    members, helpers = [], []
    for i, (lookup, dim_key) in enumerate(zip(lookups, dim_keys)):
        name = f"__rk{i}"
        cond = F.col(key) == F.col(name)
        df = df.join(_right_side(lookup, dim_key, name), cond if present is None else cond & present, "left")
        helpers.append(name)
        if lookup.member:
            members += lookup.columns
        elif lookup.guard == "raise":
            fan = F.col(f"fan_{lookup.role}")
            message = F.concat(F.lit(f"{lookup.role}.{lookup.dim_key} occurs more than once: "), F.col(name).cast("string"))
            df = df.where(F.when(fan > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
            helpers.append(f"fan_{lookup.role}")
    df = df.drop(*helpers)
    if members:
        df = df.withColumns({m: F.coalesce(F.col(m), F.lit(0)) for m in members})
    return df


def without_lookups(df: DataFrame, lookups: Sequence[Lookup]) -> DataFrame:
    """``df`` with the columns the lookups would give rows that match nothing."""
    empty = {}
    for lookup in lookups:
        for out, src in lookup.columns.items():
            empty[out] = F.lit(0) if lookup.member else F.lit(None).cast(lookup.dim.schema[src].dataType)
        if lookup.guard == "count" and not lookup.member:
            empty[f"fan_{lookup.role}"] = F.lit(None).cast("long")
    return df.withColumns(empty)


def enrich_group(
    df: DataFrame,
    key: ColumnOrName,
    lookups: Sequence[Lookup],
    spread_nulls: bool = True,
    salt_cols: Sequence[str] = (),
) -> DataFrame:
    """Several left joins on the same key, computed once as a column.

    Joins on one key are consecutive, so after the first sort-merge join the frame is
    already hash-partitioned on that column and later joins on it shuffle only their
    right side (grouping by key, survey section 4). NULL keys are salted so they do
    not collapse into one partition; a separate non-NULL marker keeps them unmatched.
    Without ``spread_nulls`` the key stays as it is, and frames bucketed on it are
    joined without a shuffle.

    A hot key of a group with several lookups is split by AQE only with
    ``spark.sql.adaptive.forceOptimizeSkewedJoin`` (set by ``build_session``): splitting the
    first join takes the later ones their shared partitioning.
    """
    k = _c(key)
    kc, kv = "__gk", "__gkv"
    if not spread_nulls:
        return join_lookups(df.select("*", k.alias(kc)), kc, lookups, [F.col(lk.dim_key) for lk in lookups]).drop(kc)
    kind = key_type(df, key)
    out = df.select("*", salted_key(df, k, *(salt_cols or df.columns), kind=kind).alias(kc), k.isNotNull().alias(kv))
    keys = [match_key(df, lk.dim, k, lk.dim_key, kind) for lk in lookups]
    return join_lookups(out, kc, lookups, keys, F.col(kv)).drop(kc, kv)


def enrich_colocated(df: DataFrame, key: str, lookups: Sequence[Lookup]) -> DataFrame:
    """``enrich_group`` for a frame that is stored bucketed (or storage-partitioned) on the plain column ``key``,
    as its lookups are on theirs: no side is shuffled.

    Salting would give the key another value than the one the rows are laid out by. The rows whose
    key is NULL are split off instead, get the columns of rows without a match, and are united
    with the joined ones. Both parts are scans with a pushed-down NULL test, so use it directly on
    a stored table, not on a frame that is costly to compute twice.
    """
    keyed = df.where(F.col(key).isNotNull())
    joined = enrich_group(keyed, key, lookups, spread_nulls=False)
    return joined.unionByName(without_lookups(df.where(F.col(key).isNull()), lookups))
