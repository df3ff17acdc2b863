"""Exact deduplication through counting quotient filters (operator 9).

Each partition builds a counting quotient filter of its texts' fingerprints.  The filters are cut by quotient, cuts
of equal quotients meet in one task and merge without loss, as their remainders are sorted.  Fingerprints counted
more than once route their texts to verification, which groups by the bytes themselves.  The route is a bit map of
the repeated fingerprints that every task gets: only texts that it lets through are shuffled.

Texts are equal when identical after lower-casing A to Z; null counts as empty.  The row with the largest doc_id
stays.  Rows that repeat a doc_id with an equal text share its verdict; a null doc_id loses to any other.
Columns besides doc_id and text are kept as they are, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions


def build_filter(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit fingerprints (quotient above remainder) and how often each occurs."""
    return np.unique(fingerprints.astype(np.uint64), return_counts=True)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two filters side by side: each one's remainders are sorted within a quotient, so their places are known."""
    at = np.searchsorted(a[0], b[0], "right") + np.arange(len(b[0]))
    own = np.ones(len(a[0]) + len(b[0]), bool)
    own[at] = False
    values, counts = np.empty(len(own), np.uint64), np.empty(len(own), np.int64)
    for out, x, y in ((values, a[0], b[0]), (counts, a[1], b[1])):
        out[own], out[at] = x, y
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    return values[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def merge_filters(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One filter with the counts of all, merged two by two."""
    filters = list(filters) or [(np.empty(0, np.uint64), np.empty(0, np.int64))]
    while len(filters) > 1:
        filters = [_merged(*filters[k : k + 2]) if k + 1 < len(filters) else filters[k] for k in range(0, len(filters), 2)]
    return filters[0]


def dump_filter(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Runs by quotient (upper 32 bits): quotients, run lengths, sorted remainders, counters of those above one."""
    quotients, lengths = np.unique((values >> np.uint64(32)).astype(np.uint32), return_counts=True)
    many = np.flatnonzero(counts > 1)
    head = np.array([len(quotients), len(values), len(many)], np.uint32)
    parts = (head, quotients, lengths, values & np.uint64(0xFFFFFFFF), many, counts[many])
    return b"".join(x.astype("<u4").tobytes() for x in parts)


def load_filter(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    words = np.frombuffer(raw, "<u4")
    n_q, n, n_many = words[:3].tolist()
    quotients, lengths, remainders, many, more = np.split(words[3:], np.cumsum([n_q, n_q, n, n_many]))
    counts = np.ones(n, np.int64)
    counts[many] = more
    return np.repeat(quotients.astype(np.uint64) << np.uint64(32), lengths) | remainders, counts


def _normalised(column: pa.Array) -> list[bytes]:
    return [(x or b"").lower() for x in column.cast(pa.binary()).to_pylist()]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_sha256) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _normalised(batch.column(1))
            fp = pa.array([_signed(xxhash.xxh3_64_intdigest(t)) for t in texts], pa.int64())
            sha = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp, sha], names=["doc_id", "fp", "text_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long, text_sha256 string")


def repeated_fingerprints(keyed: DataFrame) -> DataFrame:
    """(fp, copies) of fingerprints that occur more than once in ``keyed``."""
    bits = min(20, (4 * shuffle_partitions(keyed.sparkSession) - 1).bit_length())
    shift = np.uint64(64 - bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [build_filter(b.column(0).to_numpy().view(np.uint64)) for b in batches]
        values, counts = merge_filters(filters)
        blocks = (values >> shift).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(values) else np.empty(0, np.int64)
        ends = np.append(cuts[1:], len(values)).astype(np.int64)
        dumps = [dump_filter(values[a:b], counts[a:b]) for a, b in zip(cuts.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(blocks[cuts], pa.int64()), pa.array(dumps, pa.binary())], names=["block", "filter"])

    def merge(table: pa.Table) -> pa.Table:
        values, counts = merge_filters([load_filter(x) for x in table.column("filter").to_pylist()])
        many = counts > 1
        return pa.table({"fp": pa.array(values[many].view(np.int64)), "copies": pa.array(counts[many], pa.int64())})

    filters = keyed.select("fp").mapInArrow(build, "block long, filter binary")
    return filters.groupBy("block").applyInArrow(merge, "fp long, copies long")


def _bits(fp: np.ndarray, size: int) -> np.ndarray:
    """Two places of each fingerprint in a bit map of ``size`` bits, a power of two."""
    fp, mask = fp.view(np.uint64), np.uint64(size - 1)
    return np.stack([fp & mask, (fp * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)) & mask])


def routing_map(repeated: DataFrame, most: int = 1 << 28) -> np.ndarray:
    """A bit map of the repeated fingerprints, 16 bits for each up to ``most`` bits (32 MB) in all.

    A full map lets more texts through to the exact check; it never holds one back.
    """
    size = min(most, 1 << max(13, (16 * repeated.count()).bit_length()))
    block = min(size, 1 << 20)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.unique(_bits(batch.column(0).to_numpy(), size)).astype(np.int64)
            for k in np.unique(at // block).tolist():
                found.setdefault(k, np.zeros(block, bool))[at[at // block == k] % block] = True
        out = [np.packbits(x, bitorder="little").tobytes() for x in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(out, pa.binary())], names=["block", "bits"])

    def join(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    rows = repeated.select("fp").mapInArrow(mark, "block long, bits binary").groupBy("block").applyInArrow(join, "block long, bits binary").collect()  # `most` bits at most
    found = np.zeros(size // 8, np.uint8)
    for r in rows:
        found[r["block"] * block // 8 : (r["block"] + 1) * block // 8] = np.frombuffer(r["bits"], np.uint8)
    return found


def _let_through(texts: list[bytes], route: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, whether the map has it) of each text."""
    fp = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64)
    at = _bits(fp, 8 * len(route))
    return fp.view(np.int64), (route[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(0)


def verified_groups(docs: DataFrame, repeated: DataFrame, route: np.ndarray) -> DataFrame:
    """Groups of byte-equal texts among the texts whose fingerprint repeats: (sha, keep_id, group_size).

    Copies within an Arrow batch meet before the shuffle, so a group of any size sends few rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met: dict[bytes, list] = {}
            texts = _normalised(batch.column(1))
            _, through = _let_through(texts, route)
            ids = batch.column(0).to_pylist()
            for k in np.flatnonzero(through).tolist():
                row, doc_id = met.setdefault(texts[k], [None, 0]), ids[k]
                row[0] = doc_id if row[0] is None else row[0] if doc_id is None else max(row[0], doc_id)
                row[1] += 1
            ids, sizes = zip(*met.values()) if met else ((), ())
            fp, _ = _let_through(list(met), route)
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(met, pa.binary()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], names=["fp", "bytes", "doc_id", "n"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "fp long, bytes binary, doc_id long, n long")
    routed = texts.join(repeated.select("fp"), "fp", "left_semi")
    groups = routed.groupBy("fp", "bytes").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return groups.filter("group_size > 1").select(F.sha2("bytes", 256).alias("sha"), "keep_id", "group_size")


def _found(docs: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(fingerprints of all rows, groups of equal texts, bit map of repeated fingerprints)."""
    keyed = checkpointed(fingerprints(docs))
    repeated = checkpointed(repeated_fingerprints(keyed))
    route = routing_map(repeated)
    return keyed, checkpointed(verified_groups(docs, repeated, route)), route


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    keyed, groups, _ = _found(docs)
    found = keyed.join(groups, keyed.text_sha256 == groups.sha, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, that of the largest doc_id, then of the least columns; all columns stay.

    Rows whose fingerprint does not repeat stay where they are; only the others meet the groups.
    """
    _, groups, route = _found(docs)

    def side(repeats: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, through = _let_through(_normalised(batch.column(1)), route)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(through == repeats))], names=["row"])

        given = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
        return given.mapInArrow(run, given.select("row").schema)

    low = F.translate(F.coalesce(F.col("row.text").cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    rows = side(True).withColumn("sha", F.sha2(low.cast("binary"), 256)).join(groups.withColumn("many", F.lit(True)), "sha", "left")
    one = rows.filter(F.col("many") & F.col("row.doc_id").cast("long").eqNullSafe(F.col("keep_id"))).groupBy("sha").agg(F.min("row").alias("row"))
    return side(False).select("row.*").unionByName(rows.filter("many is null").select("row.*")).unionByName(one.select("row.*"))
