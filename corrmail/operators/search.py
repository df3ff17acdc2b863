"""Substring search over stored posting lists: only rows that hold all trigrams of the words asked for are looked at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM, BUCKETS = 3, 64


def row_text(columns: Sequence[str]) -> Column:
    """What a search looks through: the lower-cased values of a row, a space between them; nulls are left out."""
    return F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))


def grams(text: Column, n: int = GRAM) -> Column:
    """The distinct runs of ``n`` characters; linear in the text, as whole arrays are laid beside each other."""
    letters = F.filter(F.split(text, ""), lambda x: x != "")
    beside = F.arrays_zip(*[F.slice(letters, k + 1, F.greatest(F.size(letters), F.lit(1))).alias(f"c{k}") for k in range(n)])
    joined = F.transform(beside, lambda x: F.concat(*[x[f"c{k}"] for k in range(n)]))
    return F.array_distinct(F.filter(joined, lambda x: x.isNotNull()))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """Posting lists (gram, key) of rows, in folders by a hash of the gram."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: Sequence[str]):
        self.spark, self.path, self.key, self.columns = spark, path, key, tuple(columns)

    def write(self, rows: DataFrame, mode: str = "overwrite") -> None:
        """Index ``rows``; ``append`` adds rows with new keys.  Each gram of a row is one posting, however often it occurs."""
        postings = rows.select(self.key, F.explode(grams(row_text(self.columns))).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
        # a bucket is written by as many tasks as rows deal it to, each sorted, so that a gram is in few row groups
        dealt = postings.repartition("bucket", F.pmod(F.xxhash64(self.key), F.lit(4))).sortWithinPartitions("bucket", "gram", self.key)
        dealt.write.mode(mode).partitionBy("bucket").parquet(self.path)

    def candidates(self, words: str) -> DataFrame | None:
        """Keys of rows that hold all grams of ``words``; none if the words are too short to have one."""
        wanted = self.spark.range(1).select(grams(F.lower(F.lit(words))).alias("g"), F.transform("g", _bucket).alias("b")).first()
        if not wanted.g:
            return None
        postings = self.spark.read.parquet(self.path).filter(F.col("bucket").isin(sorted(set(wanted.b))) & F.col("gram").isin(wanted.g))
        return postings.groupBy(self.key).agg(F.count("*").alias("met")).filter(F.col("met") == len(wanted.g)).select(self.key)

    def search(self, rows: DataFrame, words: str) -> DataFrame:
        """Rows that have ``words`` in their text, as a scan of all would find them; blank words find all."""
        if not words:
            return rows
        keys = self.candidates(words)
        some = rows if keys is None else rows.join(keys, self.key, "left_semi")
        return some.filter(F.contains(row_text(self.columns), F.lower(F.lit(words))))
