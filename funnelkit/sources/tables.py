"""A1 ``read_source``: parquet / catalog reads with a declared schema.

Reading with a declared schema skips footer-based inference on every file at scale and
makes type drift an error instead of a silent change. Column pruning and predicate
pushdown are Catalyst's: callers select and filter on the returned DataFrame and the
parquet scan receives ``ReadSchema`` / ``PushedFilters``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FIXTURE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_TS = T.TimestampNTZType()

# Declared schemas of the fixture tables the operators read.
FIXTURE_SCHEMAS: dict[str, T.StructType] = {
    "region": T.StructType([
        T.StructField("r_regionkey", T.IntegerType()),
        T.StructField("r_name", T.StringType()),
    ]),
    "nation": T.StructType([
        T.StructField("n_nationkey", T.IntegerType()),
        T.StructField("n_name", T.StringType()),
        T.StructField("n_regionkey", T.IntegerType()),
    ]),
    "customer": T.StructType([
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]),
    "orders": T.StructType([
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", _TS),
        T.StructField("o_orderpriority", T.StringType()),
    ]),
    "lineitem": T.StructType([
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_partkey", T.LongType()),
        T.StructField("l_suppkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()),
        T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_discount", T.DoubleType()),
        T.StructField("l_tax", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()),
        T.StructField("l_linestatus", T.StringType()),
        T.StructField("l_shipdate", _TS),
    ]),
    "events": T.StructType([
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", _TS),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]),
}


def read_source(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    columns: list[str] | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Read one source. ``path`` is a file/folder path or, with ``fmt='table'``, a
    catalog table name (bucketed catalog tables keep their bucketing for joins)."""
    if fmt == "table":
        df = spark.table(path)
    else:
        reader = spark.read.format(fmt)
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.load(path)
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read one fixture table from ``{sf_dir}/{name}.parquet``."""
    return read_source(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", FIXTURE_SCHEMAS.get(name), columns)
