"""Best-fit packing of token sequences (operator 1).

The plan depends on the histogram of lengths alone, which has at most ``capacity`` rows, so best fit runs over
length classes on the driver and gives what it would give item by item.  Items then find their place by their rank
within their length; ranks come from a two-level prefix sum, so no length class is held by one task.

Documents longer than ``capacity`` are cut into full pieces and a shorter last one.  Null text counts as empty and
holds the end id alone.  Repeated rows are packed as often as they occur.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_count, chunk_of, checkpointed, prefix_sum
from .tokens import encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every text, with an end id behind it; ``keep_ids`` adds the ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, False)
        for batch in batches:
            doc_ids = batch.column(0)
            for first, ids, counts in enc.encode(batch.column(1)):
                rows: list[list] = [[], [], [], [], [], []]
                ends = np.cumsum(counts)
                ids = ids.astype("<u4")
                for k, (lo, hi) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                    doc = np.append(ids[lo:hi], np.uint32(end_id)).tobytes()
                    for piece, at in enumerate(range(0, len(doc), 4 * capacity)):
                        raw = doc[at : at + 4 * capacity]
                        for column, x in zip(rows, (first + k, piece, at // 4, len(raw) // 4, zlib.crc32(raw), raw if keep_ids else None)):
                            column.append(x)
                arrays = [doc_ids.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays, names = [*arrays, pa.array(rows[5], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES + ", ids binary" * keep_ids)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, items, first bin, items a bin, offset of the first) for all items of each length.

    Lengths above a third of the capacity go first, longest first, each with the longest that still fits beside it:
    no bin can hold three.  Shorter ones then fill the tightest gap that takes them, longest first.
    """
    left, rank, bins = dict(counts), dict.fromkeys(counts, 0), 0
    plan: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []

    def put(length: int, items: int, first: int, per_bin: int, offset: int) -> None:
        plan.append((length, rank[length], items, first, per_bin, offset))
        rank[length] += items
        left[length] -= items

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((first, n))

    large = sorted(x for x in counts if 3 * x > capacity)
    for length in reversed(large):
        while n := left[length]:
            at = bisect_right(large, min(length, capacity - length)) - 1
            while at >= 0 and (not left[large[at]] or large[at] == length and n == 1):
                at -= 1
            mate = large[at] if at >= 0 else None
            if mate == length:
                pairs = n // 2
                put(length, 2 * pairs, bins, 2, 0)
                leave(capacity - 2 * length, bins, pairs)
                bins += pairs
            else:
                pairs = min(n, left[mate]) if mate else n
                put(length, pairs, bins, 1, 0)
                if mate:
                    put(mate, pairs, bins, 1, length)
                leave(capacity - length - (mate or 0), bins, pairs)
                bins += pairs
    for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while n := left[length]:
            at = bisect_left(open_gaps, length)
            if at == len(open_gaps):
                new = -(-n // (capacity // length))
                leave(capacity, bins, new)
                bins += new
                continue
            gap = open_gaps[at]
            first, some = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], open_gaps[at]
            each = min(gap // length, n)
            used = min(some, n // each)
            put(length, used * each, first, each, capacity - gap)
            leave(gap, first + used, some - used)
            leave(gap - each * length, first, used)
    return plan


def pack(items: DataFrame, length: str = "length", order: list[str] | None = None, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to items of 1 to ``capacity`` tokens.  ``order`` names columns that tell items apart."""
    spark, order = items.sparkSession, order or ["doc_id", "piece"]
    if capacity >= 1 << 15:
        raise ValueError("capacity must be below 32768: a length and a rank share one sort key")
    tally = items.groupBy(length).count().collect()  # at most `capacity` rows, whatever the input
    counts = {int(r[0]): int(r[1]) for r in tally}
    plan = sorted(best_fit_plan(counts, capacity))
    chunks = chunk_count(spark, sum(counts.values()))
    keyed = items.withColumn("_chunk", chunk_of(chunks, *[F.col(c) for c in order]))
    ranked = prefix_sum(keyed, [length], "_chunk", [F.col(c) for c in order], F.lit(1), "_rank").drop("_chunk")
    names = items.columns
    starts = np.array([[s, r] for s, r, *_ in plan], np.int64).reshape(-1, 2)
    table = np.array([x[1:] for x in plan], np.int64).reshape(-1, 5)
    shift = 1 << 48

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = starts[:, 0] * shift + starts[:, 1]
        for batch in batches:
            size = batch.column(length).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            row = table[np.searchsorted(keys, size * shift + rank, "right") - 1]
            nth = rank - row[:, 0]
            extra = [pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * size)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *extra], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in items.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that kept their ids: (sequence_id, ids binary, n_tokens)."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    joined = F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))")
    return parts.select("sequence_id", joined.alias("ids"), "n_tokens")


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return pack(checkpointed(token_pieces(docs, tokenizer, capacity, end_id)), capacity=capacity)
