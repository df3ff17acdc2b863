"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corrmail.operators.graph import checkpointed, shared_folder

__all__ = ["SPACE", "WORD", "checkpointed", "chunk_count", "chunk_of", "hot_join", "materialize", "prefix_sum", "shuffle_partitions"]

#: The white space that separates words, and what a word is made of.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunk_count(spark: SparkSession, rows: int, rows_per_chunk: int = 1_000_000) -> int:
    """How many pieces a global order is cut into: follows the cluster, and the rows beyond a million a piece."""
    return 4 * shuffle_partitions(spark) + rows // rows_per_chunk


def chunk_of(chunks: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(chunks)).cast("int")


def prefix_sum(df: DataFrame, groups: list[str], chunk: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """``out`` is the sum of ``value`` over earlier rows of the same group, in the order (chunk, order).

    Two levels: sums per (group, chunk) get their running total, and rows add what precedes them in their chunk.
    A group of any size is spread over the chunks; no task holds more than one chunk of it.
    """
    base, inner = f"{out}_base", f"{out}_inner"
    keys = [*groups, chunk]
    before = Window.partitionBy(*groups).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.sum(value).alias(base))
    sums = sums.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)).cast("long"))
    sums = sums.select(*[F.col(k).alias(f"{out}_{k}") for k in keys], base)
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn(inner, F.coalesce(F.sum(value).over(own), F.lit(0)).cast("long"))
    on = [F.col(k).eqNullSafe(F.col(f"{out}_{k}")) for k in keys]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    joined = rows.join(sums, cond, "left").withColumn(out, F.col(base) + F.col(inner))
    return joined.drop(base, inner, *[f"{out}_{k}" for k in keys])


def hot_join(rows: DataFrame, small: DataFrame, keys: list[str], size: str, most: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``small``, which has one row for each value of ``keys`` and its number of rows in ``size``.

    A key with more than 1 / ``most`` of all rows would be one large task; there are fewer than ``most`` such keys
    whatever the size of the table, so these go to every task and only the rows of all other keys are shuffled.
    Null keys match null keys.
    """
    total = small.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    small = materialize(small.withColumn("_hot", F.col(size) * most > total), "groups").drop(size)
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    others = [c for c in small.columns if c not in (*keys, "_hot")]

    def meet(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return a.join(b, on, how)

    hot = F.broadcast(small.filter("_hot").select(*names, *others))
    flags = F.broadcast(small.filter("_hot").select(*names))
    columns = [*rows.columns, *others]
    light = meet(meet(rows, flags, "left_anti"), small.filter("not _hot").select(*names, *others), "inner")
    return meet(rows, hot, "inner").select(*columns).unionByName(light.select(*columns))
