"""Line deduplication by overlapping three-line windows (operator 8).

Every three lines in a row are hashed (128 bits).  A window that occurs more than once in the table is removed
everywhere but at its first place (smaller doc_id, then smaller line), and the lines of removed windows merge.

Lines are what newlines separate; blank lines count.  A text of fewer than three lines has no window and stays; a
null text is one empty line.  A null doc_id comes first.  Rows that repeat a doc_id are documents of their own, in the
order of a hash of their texts; of rows that repeat in full, one counts as the first.  Columns besides doc_id and text
are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def repeated_windows(rows: DataFrame, size: int = 3) -> DataFrame:
    """(row, starts): first lines of the windows of each document that occurred earlier."""
    lines = F.split("text", "\n")
    rows = rows.select(F.struct("doc_id", F.xxhash64("text").alias("hash"), "row").alias("doc"), lines.alias("lines")).filter(F.size("lines") >= size)
    window = lambda i: F.slice("lines", i, size)
    hashed = F.transform(F.sequence(F.lit(1), F.size("lines") - size + 1), lambda i: F.struct(i.alias("i"), F.xxhash64(window(i)).alias("h1"), F.xxhash64(F.lit(1), window(i)).alias("h2")))
    windows = rows.select("doc", F.inline(hashed))
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "i")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = windows.join(first, ["h1", "h2"]).filter(~F.struct("doc", "i").eqNullSafe(F.col("first")))  # a common window is split as a skewed join
    return again.groupBy("doc.row").agg(F.collect_set("i").alias("starts"))


def drop_repeated_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of every row, the text without repeated windows."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = materialize(given.withColumn("row", F.monotonically_increasing_id()), "lines")
    joined = rows.join(repeated_windows(rows, size), "row", "left").select("doc_id", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, gone = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = (text or "").split("\n")
                covered = {i - 1 + k for i in found or () for k in range(size)}
                texts.append("\n".join(x for k, x in enumerate(lines) if k not in covered) if covered else text or "")
                totals.append(len(lines))
                gone.append(len(covered))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_lines", "n_removed"])

    return joined.mapInArrow(run, "doc_id long, text string, n_lines long, n_removed long")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
