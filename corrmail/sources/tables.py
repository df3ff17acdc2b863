"""Stored tables with keys: a change rewrites only the buckets that it touches.

A bucket is a folder of Parquet files.  Changes replace whole folders (dynamic partition overwrite), so a change that
runs twice leaves the same rows, and its cost follows the buckets it touches, not the table.  Each bucket holds a row
that marks it, so that a bucket whose last row is deleted is rewritten too.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

BUCKET, LIVE = "_bucket", "_live"
#: Folders that ranges of the same keys are dealt to: a table of any length has few, so a change of all of it writes few files.
FOLDERS = 256


def hashed(*keys: str, buckets: int = 64) -> Column:
    """Rows spread evenly: for keys that change anywhere."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")


def ranged(number: str, *keys: str, size: int = 1 << 20) -> Column:
    """One bucket for ``size`` successive numbers of the same ``keys``: for tables that grow at their end.

    Beyond ``FOLDERS`` ranges the buckets are used again, so each holds several ranges of a long table.
    """
    return F.concat_ws("-", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.pmod(F.floor(F.col(number) / size), F.lit(FOLDERS)).cast("string"))


class KeyedTable:
    """Rows with unique ``keys`` below ``path``; ``bucket`` is computed from the keys alone."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str], bucket: Column | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), tuple(keys)
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.bucket = hashed(*self.keys) if bucket is None else bucket

    def _stored(self) -> DataFrame:
        full = StructType(list(self.schema.fields)).add(LIVE, "boolean").add(BUCKET, "string")
        try:
            return self.spark.read.schema(full).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], full)

    def read(self) -> DataFrame:
        return self._stored().filter(LIVE).select(*self.schema.names)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.coalesce(self.bucket, F.lit("none")))

    def _buckets(self, rows: DataFrame) -> list[str]:
        """The buckets that ``rows`` touch: at most as many as the table has folders, plus new ones."""
        return [r[0] for r in self._placed(rows).select(BUCKET).distinct().collect()]

    def touched(self, rows: DataFrame, buckets: list[str] | None = None) -> DataFrame:
        """Stored rows of the buckets that hold the keys of ``rows``; no other folder is read."""
        buckets = self._buckets(rows) if buckets is None else buckets
        return self._stored().filter(F.col(BUCKET).isin(buckets) if buckets else F.lit(False)).filter(LIVE)

    def matching(self, keys: DataFrame) -> DataFrame:
        """Stored rows with one of ``keys``."""
        return self._semi(self.touched(keys), self._placed(keys), "left_semi").select(*self.schema.names)

    def _semi(self, rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        names = [*self.keys, BUCKET]
        right = keys.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)])
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)])
        return rows.join(right, on, how)

    def _write(self, rows: DataFrame, buckets: list[str]) -> None:
        """Each bucket is written by one task (a large one by several), so files are as many as buckets."""
        marks = self.spark.createDataFrame([(b, False) for b in buckets], f"{BUCKET} string, {LIVE} boolean")
        rows = rows.select(*self.schema.names, BUCKET, F.lit(True).alias(LIVE)).unionByName(marks, allowMissingColumns=True)
        rows.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def _latest(self, rows: DataFrame, order: Sequence[str]) -> DataFrame:
        if not order:
            return rows.dropDuplicates(list(self.keys))
        last = Window.partitionBy(*self.keys).orderBy(*[F.col(c).desc() for c in order])
        return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")

    def upsert(self, rows: DataFrame, only: Sequence[str] | None = None, order: Sequence[str] = ()) -> None:
        """Rows with new keys are added; of known keys the columns ``only`` (all by default) take the new values.

        Of several rows with one key the last by ``order`` counts.  Columns that ``rows`` does not have stay as they
        are, or null for new keys.
        """
        rows = self._placed(self._latest(rows, order))
        buckets = self._buckets(rows)
        if not buckets:
            return
        change = [c for c in (only or rows.columns) if c in rows.columns and c in self.schema.names and c not in self.keys]
        new = rows.select(BUCKET, F.lit(True).alias("_new"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], *[F.col(c).alias(f"_v_{c}") for c in self.schema.names if c in rows.columns and c not in self.keys])
        new = new.withColumnRenamed(BUCKET, "_b")
        on = reduce(lambda x, y: x & y, [F.col(BUCKET) == F.col("_b"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]])
        both = self.touched(rows, buckets).join(new, on, "full")
        known, fresh = F.coalesce(F.col(LIVE), F.lit(False)), F.coalesce(F.col("_new"), F.lit(False))

        def value(c: str) -> Column:
            if c in self.keys:
                return F.when(known, F.col(c)).otherwise(F.col(f"_k{self.keys.index(c)}"))
            if f"_v_{c}" not in new.columns:
                return F.col(c)
            return F.when(fresh & (~known | F.lit(c in change)), F.col(f"_v_{c}")).otherwise(F.col(c))

        out = both.select(*[value(c).cast(self.schema[c].dataType).alias(c) for c in self.schema.names], F.coalesce(BUCKET, "_b").alias(BUCKET))
        self._write(out, buckets)

    def insert_new(self, rows: DataFrame) -> None:
        """Rows whose keys are not stored yet are added; the others stay as they are."""
        self.upsert(rows, only=[self.keys[0]])

    def update(self, keys: DataFrame, **values: Column) -> None:
        """Set columns of the stored rows that have one of ``keys``; values may use their old columns."""
        self._rewrite(keys, lambda rows, hit: rows.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in self.schema.names], BUCKET))

    def delete(self, keys: DataFrame) -> None:
        """Remove the stored rows that have one of ``keys``."""
        self._rewrite(keys, lambda rows, hit: rows.filter(~hit))

    def _rewrite(self, keys: DataFrame, change) -> None:
        buckets = self._buckets(keys)
        if not buckets:
            return
        names = [*self.keys, BUCKET]
        right = self._placed(keys).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], F.lit(True).alias("_hit")).distinct()
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)])
        rows = self.touched(keys, buckets).join(right, on, "left")
        self._write(change(rows, F.coalesce("_hit", F.lit(False))), buckets)

    def delete_where(self, holds: Column) -> None:
        """Remove rows by a condition; only buckets that hold such rows are rewritten."""
        self.delete(self.read().filter(holds).select(*self.keys))


def clear_analysis(spark: SparkSession, account_id: int, links: dict[KeyedTable, tuple[KeyedTable, str, str]]) -> None:
    """Delete rows that belong to an account through others: {table: (its parent, its column, the parent's column)}.

    Children go first, then parents; parents are those whose ``account_id`` is the account's.
    """
    parents = []
    for table, (parent, column, target) in links.items():
        owned = parent.read().filter(F.col("account_id") == account_id).select(F.col(target).alias(column)).distinct()
        table.delete(table.read().join(owned, column, "left_semi").select(*table.keys))
        if parent not in parents:
            parents.append(parent)
    for parent in parents:
        parent.delete_where(F.col("account_id") == account_id)


def setting_table(spark: SparkSession, path: str) -> KeyedTable:
    """Settings by name."""
    return KeyedTable(spark, path, "key string, value string", ("key",), hashed("key", buckets=1))


def setting(table: KeyedTable, key: str, default: str = "") -> str:
    row = table.matching(table.spark.createDataFrame([(key,)], "key string")).first()
    return default if row is None else row.value


def set_setting(table: KeyedTable, key: str, value: str) -> None:
    table.upsert(table.spark.createDataFrame([(key, value)], "key string, value string"))
