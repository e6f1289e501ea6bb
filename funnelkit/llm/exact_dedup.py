"""Operator 1: exact dedup over content-defined chunk recipes (DataFrame functions only).

A text is normalised (each run of ASCII white space becomes one space) and cut where its
own content says so, so an unchanged passage gives the same chunks wherever it stands. Every
chunk gets a 128-bit identifier. The distinct (identifier, chunk) pairs are then grouped by
identifier: no identifier may stand for two different chunks, else all identifiers are
drawn again with another salt. After that check, two texts are equal exactly if their
ordered identifier lists (recipes) are, and only recipes are shuffled and compared. The
text itself moves once, as distinct chunks combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm.common import KEY, WHITE, id_and_text, materialize, repeat_rows, row_key

MIN_CHUNK = 128
MAX_CHUNK = 2048


def boundary_class(modulus: int, rest: int) -> str:
    """Regex class of the Latin-1 characters with the given rest; by rule, so that a boundary
    depends on nothing but the characters around it. (Java tests such a class with one
    bitmap lookup; texts without Latin-1 letters are cut at the largest chunk size.)"""
    return "[" + "".join(f"\\x{c:02x}" for c in range(0x21, 0x100) if c % modulus == rest) + "]"


def chunk_pattern(min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> str:
    """A chunk ends after a space that stands between two characters of fixed classes, but
    has ``min_chunk`` to ``max_chunk`` characters (the last one of a text may be shorter)."""
    cut = f"{boundary_class(16, 4)} (?={boundary_class(8, 1)})"
    return f"(?s).{{{min_chunk},{max_chunk - 2}}}?{cut}|.{{1,{max_chunk}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE + "+", " ")


def chunks_of(norm: Column, pattern: str) -> Column:
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def chunk_ids(chunk: Column, salt: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * salt), chunk), F.xxhash64(F.lit(2 * salt + 1), chunk)]


def chunk_dictionary(docs: DataFrame, text_col: str, pattern: str, salt: int) -> DataFrame:
    """Distinct chunks with their identifier (id_a, id_b); combined before the shuffle."""
    chunks = docs.select(F.explode(chunks_of(normalised(F.col(text_col)), pattern)).alias("chunk"))
    a, b = chunk_ids(F.col("chunk"), salt)
    return chunks.select(a.alias("id_a"), b.alias("id_b"), "chunk").distinct()


def clashes(dictionary: DataFrame) -> int:
    """Identifiers that stand for more than one chunk."""
    return dictionary.groupBy("id_a", "id_b").count().filter("count > 1").count()


def exact_dedup(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chunk: int = MIN_CHUNK,
    max_chunk: int = MAX_CHUNK,
    keys: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks and with ``keys`` the
    row's key (``row_key``, which reads all columns).

    Null and empty texts are equal to each other (an empty recipe). The row with the
    smallest doc_id of a group stays, null ids last; of rows with that same doc_id exactly one
    stays. keep_id is null only if all ids of the group are. An empty table gives an
    empty result. Columns other than the id and the text do not matter.
    """
    pattern = chunk_pattern(min_chunk, max_chunk)
    key = KEY if keys else ()
    salt = 0
    while clashes(chunk_dictionary(docs, text_col, pattern, salt)):
        salt += 1
    a = F.transform("chunks", lambda c: chunk_ids(c, salt)[0])
    b = F.transform("chunks", lambda c: chunk_ids(c, salt)[1])
    recipes = materialize(
        spark,
        docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"), *(row_key(docs) if keys else []))
        .select("doc_id", *key, F.sha2("norm", 256).alias("text_sha256"), chunks_of(F.col("norm"), pattern).alias("chunks"))
        .select(
            F.monotonically_increasing_id().alias("row_id"), "doc_id", *key, "text_sha256",
            F.concat(a, b).alias("recipe"),
        ),
        "recipes",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id"))
    # Only recipes that occur more than once are joined, from a table: then both sides of the
    # join are plain exchanges, which Spark can split where one recipe is very frequent.
    groups = recipes.groupBy("recipe").agg(first.alias("first"), F.count("*").alias("group_size"))
    groups = materialize(spark, groups.filter("group_size > 1"), "groups")
    return recipes.join(groups, "recipe", "left").select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("row_id") == F.col("first.row_id"), F.lit(True)).alias("kept"),
        "text_sha256",
        F.expr("CAST(size(recipe) / 2 AS INT)").alias("n_chunks"),
        *key,
    )


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    plan = exact_dedup(spark, docs, keys=True, **options).filter("kept").select(
        "__key_a", "__key_b", F.array(F.lit(1)).alias("__at")
    )
    return repeat_rows(docs, plan).drop("__at")
