"""Helpers shared by the operators: table access, shared intermediate tables, row selection."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the only white space the operators know: space and U+0009 to U+000D.
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh scratch folder only where it
    is unset and the master is local (a test run)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="funnelkit-shared-"))
        d = context.getCheckpointDir()
    return d


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a later failure rereads the table instead of recomputing ``df``,
    and values that depend on partition numbers (row ids) stay as written.
    """
    path = f"{shared_dir(spark)}/funnelkit-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """The two columns every operator reads; a null text counts as empty."""
    return [
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ]


def parts_of(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have about ``size`` bytes (a longer text is a batch of
    its own), so that what a task unpacks at a time is bounded by bytes, not by rows."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _hashes(kind: T.DataType) -> bool:
    """Can Spark hash a value of this type? Maps and variants it cannot, wherever they are inside."""
    if isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.ArrayType):
        return _hashes(kind.elementType)
    return all(_hashes(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else True


def row_key(docs: DataFrame) -> list[Column]:
    """128-bit key of a whole row: rows with equal keys are equal in every column. The hash passes
    over nulls, so where they are is hashed too. Columns with maps or variants are hashed as JSON; maps that
    differ in the order of their entries only count as different."""
    cols = [F.col(f"`{f.name}`") for f in docs.schema.fields]
    cols = [c if _hashes(f.dataType) else F.to_json(c) for c, f in zip(cols, docs.schema.fields)]
    cols += [c.isNull() for c in cols]
    return [
        F.xxhash64(*cols).alias("__key_a"),
        F.xxhash64(F.lit(7919), *cols, F.lit(104729)).alias("__key_b"),
    ]


#: Names of the two halves of a row's key.
KEY = ("__key_a", "__key_b")


def repeat_rows(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` with each distinct row emitted as often as ``plan`` says.

    ``plan`` has ``__key_a, __key_b`` (of ``row_key``) and ``__at``, an array with one
    element per wanted copy, at most one row a key; rows without a plan row go. Rows equal in
    every column are interchangeable, so one of them stands for all. Returns the
    columns of ``docs`` and ``__at``, one row per array element.
    """
    keyed = docs.select(*row_key(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    one = Window.partitionBy("__key_a", "__key_b").orderBy("__key_a")
    kept = (
        keyed.join(plan, ["__key_a", "__key_b"])
        .withColumn("__n", F.row_number().over(one))
        .filter("__n = 1")
        .select("__row", F.explode("__at").alias("__at"))
    )
    return kept.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns], "__at")
