"""N-gram Jaccard join by chosen paths (operator 3).

Each text is the set of its five-word shingles, embedded as a set of tokens: the pairs of place and value of a minhash
signature, of which two texts share a part as large as their similarity.  A run starts with all sets in one bucket.
A hash of the bucket samples tokens, each with probability 1 / (threshold * tokens), and a set goes on to a new bucket
for every sampled token that it has: to 1 / threshold buckets on average, sometimes to several or none.  Buckets that
stay large are split again in the same way, small ones are compared exhaustively, and runs repeat until a pair at the
threshold is missed with less than the allowed probability.  A bucket that hardly shrinks holds sets that are alike;
it is compared in pairs of blocks.

Pairs never leave a task.  A bucket knows the other buckets of its sets, counts a link only if no bucket of a smaller
number holds both sets, and returns for each set its number of links and the smallest linked set.  Classes are the
connected components.  Texts with equal shingle sets are one set with a multiplicity.

Words are runs without ASCII white space.  A text of one to four words is one shingle; a text without words (or a
null) has no links.  A row without doc_id is not compared: it has no class.  Rows that repeat a doc_id count as
copies if their texts are alike, and else get the smallest class and the most links of their texts.  ``drop_similar``
goes by rows instead, compares rows without doc_id too, and keeps all columns, whatever their names.  An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrmail.operators.graph import components

from .common import checkpointed, materialize

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all texts, one after the other, and how many each text has (with repeats)."""
    words = pc.ascii_split_whitespace(texts)
    flat = words.flatten()
    coded = flat.dictionary_encode()
    values = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    bounds = np.append(0, np.cumsum(full))[np.append(0, np.cumsum(words.value_lengths().to_numpy()))]
    h = values[coded.indices.to_numpy()[full]] if len(values) else np.empty(0, np.uint64)
    n = np.diff(bounds)
    count = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    first = np.repeat(bounds[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    last = np.repeat(bounds[1:], count)
    out = np.zeros(len(first), np.uint64)
    for k in range(width):
        at = first + k
        out = _mixed(out + np.where(at < last, h[np.minimum(at, max(len(h) - 1, 0))], np.uint64(k + 1)))
    return out, count


def _slices(texts: pa.Array, most_bytes: int = 16 << 20) -> Iterator[tuple[int, pa.Array]]:
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) if len(texts) else np.empty(0, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right")))
        yield at, texts.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


def signatures(docs: DataFrame, width: int, places: int) -> DataFrame:
    """(doc_id, set_key, sig) of every row that has words and a doc_id."""
    seeds = _mixed(np.arange(1, places + 1, dtype=np.uint64))
    xors, odds = seeds.astype(np.uint32), (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch.column(1)):
                hashes, count = shingle_hashes(texts, width)
                some = np.flatnonzero(count)
                ends = np.cumsum(count)
                starts = (ends - count)[some]
                low = hashes.astype(np.uint32)
                sig = np.empty((len(some), places), np.uint32)
                for k in range(places if len(some) else 0):
                    sig[:, k] = np.minimum.reduceat((low ^ xors[k]) * odds[k], starts)
                keys = [hashlib.md5(np.unique(hashes[a:b]).tobytes()).digest() for a, b in zip(starts.tolist(), ends[some].tolist())]
                rows = [batch.column(0).take(pa.array(at + some)), pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "set_key", "sig"])

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null")
    return given.mapInArrow(run, "doc_id long, set_key binary, sig binary")


def children(sets: DataFrame, threshold: float) -> DataFrame:
    """(rep, bucket, parent): the buckets that sets of (rep, sig, node, parent) reach from their node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1).astype(np.uint64)
            tokens = _mixed(sig + (np.arange(1, sig.shape[1] + 1, dtype=np.uint64) << np.uint64(32)))
            most = np.uint64(2**64 / (threshold * sig.shape[1]))
            lists = batch.column(2)
            rows = np.repeat(np.arange(len(sig)), lists.value_lengths().to_numpy())
            nodes = _mixed(lists.flatten().to_numpy().view(np.uint64))
            for lo in range(0, len(rows), 1 << 14):
                drawn = _mixed(tokens[rows[lo : lo + (1 << 14)]] ^ nodes[lo : lo + (1 << 14), None])
                i, k = np.nonzero(drawn < most)
                at = pa.array(rows[lo + i])
                out = [batch.column(0).take(at), pa.array(_mixed(drawn[i, k]).view(np.int64)), batch.column(3).take(at)]
                yield pa.RecordBatch.from_arrays(out, names=["rep", "bucket", "parent"])

    return sets.select("rep", "sig", "nodes", "parent").mapInArrow(run, "rep long, bucket long, parent long")


def buckets(sets: DataFrame, runs: range, depth: int, small: int, shrink: float, threshold: float) -> tuple[DataFrame, int]:
    """(rep, bucket, n) for every set that shares a final bucket, and the largest depth of a bucket."""
    roots = F.array(*[F.lit(r + 1).cast("long") for r in runs])
    rest = sets.select("rep", "sig", roots.alias("nodes"), F.lit(None).cast("long").alias("parent"))
    done: list[DataFrame] = []
    for level in range(depth):
        at = checkpointed(children(rest, threshold))
        sizes = at.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        sizes = checkpointed(sizes)  # read apart from its shuffle, so that a join with large buckets can be split
        at = checkpointed(at.join(sizes, "bucket"))
        stops = (F.col("n") <= small) | (F.col("n") > shrink * F.col("parent")) | F.lit(level + 1 == depth)
        stops = F.coalesce(stops, F.lit(False))
        done.append(at.filter(stops).select("rep", "bucket", "n"))
        rest = at.filter(~stops)
        if rest.isEmpty():
            return reduce(DataFrame.union, done), level + 1
        rest = rest.join(sets.select("rep", "sig"), "rep").select("rep", "sig", F.array("bucket").alias("nodes"), F.col("n").alias("parent"))
    return reduce(DataFrame.union, done), depth


def reached(threshold: float, places: int, depth: int) -> float:
    """The probability that a pair at the threshold stays together in some branch of one run down to ``depth``."""
    q = 1.0
    for _ in range(depth):
        q = 1 - (1 - q / (threshold * places)) ** (threshold * places)
    return q


def _linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix: which sets are at least ``threshold`` alike (exact)."""
    m, sizes = len(sets), np.array([len(x) for x in sets], np.float64)
    owner = np.repeat(np.arange(m), sizes.astype(np.int64))
    ids, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    place = np.cumsum(shared) - 1
    use = shared[at]
    at, owner = place[at[use]], owner[use]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common = np.zeros((m, m), np.float32)
    step = max(256, (1 << 22) // m)
    n = int(shared.sum())
    for a in range(0, n, step):
        lo, hi = np.searchsorted(at, [a, a + step])
        grid = np.zeros((min(step, n - a), m), np.float32)
        grid[at[lo:hi] - a, owner[lo:hi]] = 1
        common += grid.T @ grid
    either = sizes[:, None] + sizes[None, :] - common
    return common >= threshold * either - 1e-9


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal keys, from batches that are sorted by them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns], np.zeros(batch.num_rows - 1, bool))
        if rest and any(rest[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, columns)):
            yield pa.Table.from_batches(rest)
            rest = []
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rest.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(rest)
                rest = []
    if rest:
        yield pa.Table.from_batches(rest)


KEYS = ["bucket", "b1", "b2"]


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows of a bucket of ``n`` sets once for each pair of blocks they belong to, in the order of the pairs."""
    n_blocks = F.ceil(F.col("n") / block)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), n_blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
    rows = rows.withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other")).drop("other")
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS)


def promising(found: DataFrame, sets: DataFrame, block: int, least: float) -> DataFrame:
    """The rows of ``found`` whose signature agrees in ``least`` of its places with another one of the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, KEYS):
            m = table.num_rows
            if m < 2:
                continue
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(m, -1)
            need = least * sig.shape[1]
            if m == 2:
                near = np.full(2, (sig[0] == sig[1]).sum() >= need)
            else:
                near = np.zeros(m, bool)
                for k in range(m - 1):
                    hit = (sig[k + 1 :] == sig[k]).sum(1) >= need
                    near[k + 1 :] |= hit
                    near[k] |= hit.any()
            if near.any():
                yield from table.select(["rep", "bucket"]).filter(pa.array(near)).combine_chunks().to_batches()

    rows = _in_blocks(found.join(sets.select("rep", "sig"), "rep"), block)
    return rows.mapInArrow(run, "rep long, bucket long").distinct()


def links(found: DataFrame, sets: DataFrame, docs: DataFrame, width: int, threshold: float, block: int) -> DataFrame:
    """(rep, root, n_links): links of each set that its buckets count, and the smallest set linked with it there.

    Buckets with the same sets are compared once.  Only texts that a signature calls promising are hashed again.
    """
    sizes = found.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"))
    first = sizes.groupBy("n", "who").agg(F.min("bucket").alias("bucket")).select("n", "bucket")
    seen = found.groupBy("rep").agg(F.collect_list("bucket").alias("seen"))  # about 1 / threshold for each run
    todo = found.join(first, "bucket").groupBy("rep").agg(F.collect_list(F.struct("bucket", "n")).alias("todo"))
    reps = todo.join(seen, "rep").join(sets.select("rep", "set_key", "copies", "first"), "rep")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch.column(0)):
                hashes, count = shingle_hashes(texts, width)
                raws = [np.unique(x).tobytes() for x in np.split(hashes, np.cumsum(count)[:-1])]
                part = batch.slice(at, len(raws))
                same = pa.array([hashlib.md5(x).digest() == k for x, k in zip(raws, part.column(1).to_pylist())])
                columns = [part.column(k) for k in range(2, 6)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(raws, pa.binary())], names=["rep", "copies", "seen", "todo", "set"]).filter(same)

    texts = docs.select(F.col("doc_id").cast("long").alias("first"), F.col("text").cast("string").alias("text"))
    pairs = "array<struct<bucket: bigint, n: bigint>>"
    full = texts.join(reps, "first").select("text", "set_key", "rep", "copies", "seen", "todo").mapInArrow(hashed, f"rep long, copies long, seen array<bigint>, todo {pairs}, set binary")
    rows = _in_blocks(full.select("rep", "copies", "seen", "set", F.inline("todo")), block)

    def compare(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        rep, order = np.unique(table.column("rep").to_numpy(), return_index=True)
        m, bucket = len(rep), table.column("bucket")[0].as_py()
        if m < 2:
            return None
        copies, own = (table.column(c).to_numpy()[order] for c in ("copies", "own"))
        raw = table.column("set").to_pylist()
        linked = _linked([np.frombuffer(raw[k], np.uint64) for k in order], threshold)
        i, j = np.nonzero(np.triu(linked, 1))
        if table.column("b1")[0].as_py() != table.column("b2")[0].as_py():
            use = own[i] != own[j]
            i, j = i[use], j[use]
        lists = table.column("seen").combine_chunks().take(pa.array(order))
        other, owner = lists.flatten().to_numpy(), np.repeat(np.arange(m), lists.value_lengths().to_numpy())
        owner, other = owner[other < bucket], other[other < bucket]
        values, at, n = np.unique(other, return_inverse=True, return_counts=True)
        for k in np.flatnonzero(n > 1).tolist():  # what a bucket of a smaller number has counted
            here = np.zeros(m, bool)
            here[owner[at == k]] = True
            use = ~(here[i] & here[j])
            i, j = i[use], j[use]
        if not len(i):
            return None
        counts = np.bincount(i, copies[j], m) + np.bincount(j, copies[i], m)
        root = np.arange(m)
        while True:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = np.flatnonzero(counts)
        return rep[some], rep[root[some]], counts[some].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for table in _groups(batches, KEYS):
            if (got := compare(table)) is not None:
                out.append(got)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["rep", "root", "n_links"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["rep", "root", "n_links"])

    return rows.mapInArrow(run, "rep long, root long, n_links long")


def similar_classes(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.99, places: int = 64, runs: int = 10, depth: int = 6, small: int = 512, shrink: float = 0.5) -> DataFrame:
    """(doc_id, class_id, n_links) of every row.  class_id: smallest doc_id of the class; n_links: other rows at least ``threshold`` alike."""
    keyed = materialize(signatures(docs, width, places), "signatures")
    grouped = keyed.groupBy("set_key", "sig").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    sets = checkpointed(grouped.withColumn("rep", F.monotonically_increasing_id()))  # sets can share a doc_id
    found, missed, done = [], 1.0, 0
    while missed > 1 - recall:
        some, deepest = buckets(sets, range(done, done + runs), depth, small, shrink, threshold)
        found.append(some)
        missed *= (1 - reached(threshold, places, deepest)) ** runs
        done += runs
    least = threshold - 5 * (threshold * (1 - threshold) / places) ** 0.5  # five standard deviations of the agreement
    found = checkpointed(promising(reduce(DataFrame.union, found), sets, small, least))
    linked = checkpointed(links(found, sets, docs, width, threshold, small))
    labels = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("rep").agg(F.sum("n_links").alias("far"))
    each = sets.join(counts, "rep", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    each = checkpointed(each.withColumn("label", F.coalesce("label", "rep")))
    smallest = checkpointed(each.groupBy("label").agg(F.min("first").alias("class")))
    each = each.join(smallest, "label").select("set_key", "class", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("links"))
    member = keyed.select("doc_id", "set_key").distinct().join(each, "set_key").select(F.col("doc_id").alias("id"), "class", "links")
    member = member.groupBy("id").agg(F.min("class").alias("class"), F.max("links").alias("links"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = ids.join(member, ids.doc_id == member.id, "left")
    return out.select("doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def drop_similar(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest doc_id (no doc_id comes last); all columns stay."""
    rows = materialize(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("rid")), "rows")
    given = rows.select(F.col("rid").alias("doc_id"), F.col("row.text").alias("text"))
    members = similar_classes(given, **options).filter("n_links > 0").select(F.col("doc_id").alias("rid"), "class_id")
    ranked = members.join(rows.select("rid", F.col("row.doc_id").cast("long").alias("doc_id")), "rid")
    ranked = checkpointed(ranked.select("rid", "class_id", F.struct(F.col("doc_id").isNull(), "doc_id", "rid").alias("place")))
    stays = ranked.groupBy("class_id").agg(F.min("place").alias("best")).select("best.rid")
    gone = ranked.select("rid").join(stays, "rid", "left_anti")
    return rows.join(gone, "rid", "left_anti").select("row.*")
