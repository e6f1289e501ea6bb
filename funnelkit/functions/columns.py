"""Scalar column helpers: null defaults, sentinels, list tests, join keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def default_zero(col: ColumnOrName) -> Column:
    """NULL indicator -> 0."""
    return F.coalesce(_c(col), F.lit(0))


def flag(cond: Column) -> Column:
    """0/1 integer indicator of a predicate; NULL counts as 0 (a CASE falls through)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def is_missing(col: ColumnOrName, *sentinels) -> Column:
    """The value is NULL or one of the sentinel values that stand for 'none'."""
    c = _c(col)
    return c.isNull() | c.isin(*sentinels) if sentinels else c.isNull()


def not_in_list(col: ColumnOrName, values: Iterable) -> Column:
    """SQL ``NOT IN`` with three-valued logic (NULL input gives NULL, which a
    ``when`` treats as false)."""
    return ~_c(col).isin(*list(values))


def key_type(df: DataFrame, key: ColumnOrName) -> T.DataType:
    if isinstance(key, str) and key in df.columns:
        return df.schema[key].dataType
    return df.select(_c(key).alias("k")).schema["k"].dataType


def salted_key(df: DataFrame, key: ColumnOrName, *salt_cols: ColumnOrName, kind: T.DataType | None = None) -> Column:
    """Join key of ``df`` whose NULLs are spread over 64-bit values instead of one.

    An outer join sends every NULL key to the same shuffle partition; when NULL keys
    are a large share of a side (rows of one stage that never reached the other) that
    partition holds them all. The salt is a deterministic hash of other columns of the
    row, so a re-run task routes every row to the same partition. Callers must keep a
    ``key IS NOT NULL`` term in the join condition so a salted value can never match.
    Whole-number keys stay numbers and string keys strings: a key that is not NULL is
    shuffled as it is.
    """
    k = _c(key)
    salt = F.xxhash64(*[_c(s) for s in salt_cols])
    kind = kind or key_type(df, key)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(k, salt)
    if isinstance(kind, T.StringType):
        return F.coalesce(k, salt.cast("string"))
    return F.coalesce(k.cast("string"), salt.cast("string"))


def match_key(df: DataFrame, dim: DataFrame, key: ColumnOrName, dim_key: ColumnOrName, kind: T.DataType | None = None) -> Column:
    """``dim_key`` in the type that ``salted_key(df, key)`` has, without a cast where the types agree."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    left, right = kind or key_type(df, key), key_type(dim, dim_key)
    if (isinstance(left, whole) and isinstance(right, whole)) or (isinstance(left, T.StringType) and isinstance(right, T.StringType)):
        return _c(dim_key)
    if isinstance(left, whole):
        raise TypeError(f"a key of type {left.simpleString()} cannot meet one of type {right.simpleString()}")
    return _c(dim_key).cast("string")
