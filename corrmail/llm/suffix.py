"""Suffix-array deduplication of long repeated byte strings (operator 2).

A string of ``length`` bytes that starts earlier too (smaller doc_id, or earlier in the same document) is removed.
Every window of that length picks the smallest of its k-mers by hash, its anchor, so equal windows have equal
anchors and only about one suffix in 35 enters the index: the one at an anchor, with the bytes before it that the
anchor's windows reach.  Anchors met once are dropped by counts that meet per shard of the hash range.

Each shard keeps a logarithmic family of suffix arrays: the records of a new batch of documents are sorted, scanned
against the arrays of the levels (an equal record is a repeat; the earlier one stays), and arrays of equal size
merge.  Records that share an anchor but differ somewhere are then compared window by window.  All comparisons are
of bytes, so the result is exact.

An anchor met very often is hot.  Each batch expands the windows of its distinct hot records, keeps the first place of
each and deals them by 128 bits of their hash instead of by the anchor, so no task holds all contexts of one anchor
and a window that all documents share comes once from each batch.  Only these comparisons are of hashes.

Null text is empty.  A null doc_id comes first.  Rows that repeat a doc_id follow each other in the order of their
bytes.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bytes of a repeat, of an anchor, and of what may stand before and after an anchor's start.
LENGTH, KMER = 100, 32
BEFORE = LENGTH - KMER
#: A record: anchor hash, bytes from the anchor on, bytes before it backwards, how many of both, plus one.
WIDTH = 8 + LENGTH + BEFORE + 2
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PLACE = np.dtype([("doc", "<i8"), ("nth", "<u4"), ("low", "<i8"), ("most", "u1"), ("least", "u1")])
#: A packed window of a hot anchor: 128 bits of its hash, place.
_HOT = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("nth", "<u4"), ("low", "<i8")])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64))


def _slice_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-mer, place of each window's anchor) in a slice of under 2**23 bytes."""
    h, m = _BYTE[data], 1
    while m < KMER:
        h = _mixed(h[:-m] * np.uint64(2 * m + 1) + (h[m:] ^ (h[m:] >> np.uint64(29))) * _M2)
        m *= 2
    low = np.uint64((1 << 23) - 1)
    best, m, width = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, BEFORE + 1
    while 2 * m <= width:
        best = np.minimum(best[:-m], best[m:])
        m *= 2
    if m < width:
        best = np.minimum(best[: len(best) - (width - m)], best[width - m :])
    return h, (best & low).astype(np.int64)


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, document number, anchor, first window, last window) of all documents in ``data``, slice by slice."""
    at, n_docs = 0, len(starts)
    while at < n_docs:
        to = at + 1
        while to < n_docs and ends[to] - starts[at] <= most:
            to += 1
        for lo in range(int(starts[at]), max(int(starts[at]) + 1, int(ends[to - 1]) - LENGTH + 1), most):
            hi = min(int(ends[to - 1]), lo + most + LENGTH - 1)
            if hi - lo < LENGTH:
                continue
            h, place = _slice_anchors(data[lo:hi])
            doc = np.searchsorted(ends[at:to], np.arange(lo, lo + len(place)), "right") + at
            good = np.flatnonzero(np.arange(lo, lo + len(place)) + LENGTH <= ends[doc])
            if not len(good):
                continue
            p, d = place[good], doc[good]
            first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1]) | (np.diff(good) != 1)]))
            last = np.append(first[1:], len(good)) - 1
            yield h[p[first]], d[first], p[first] + lo, good[first] + lo, good[last] + lo
        at = to


def _batch(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """All bytes of a batch of documents in a fixed order, where each starts and ends, and its doc_id for comparisons."""
    table = table.set_column(table.column_names.index("text"), "text", pc.fill_null(table.column("text"), b"")).combine_chunks()
    table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))
    data = np.frombuffer(b"".join(table.column("text").to_pylist()), np.uint8)
    ends = np.cumsum(pc.binary_length(table.column("text")).to_numpy().astype(np.int64))
    starts = np.append(0, ends[:-1]).astype(np.int64)[: len(ends)]
    ids = pc.fill_null(table.column("doc_id"), np.iinfo(np.int64).min).to_numpy()
    return data, starts, ends, ids, table


def _records(data: np.ndarray, got: tuple[np.ndarray, ...]) -> np.ndarray:
    """The index records of anchors, as rows of WIDTH bytes."""
    h, _, p, lo, hi = got
    out = np.zeros((len(h), WIDTH), np.uint8)
    out[:, :8] = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    n_after, n_before = hi + LENGTH - p, p - lo
    k = np.arange(LENGTH)
    out[:, 8 : 8 + LENGTH] = np.where(k < n_after[:, None], data[np.minimum(p[:, None] + k, len(data) - 1)], 0)
    k = np.arange(BEFORE)
    out[:, 8 + LENGTH : 8 + LENGTH + BEFORE] = np.where(k < n_before[:, None], data[np.maximum(p[:, None] - 1 - k, 0)], 0)
    out[:, -2], out[:, -1] = n_before + 1, n_after + 1
    return out


def _keys(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").reshape(-1)


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array ``some``."""
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values if len(some) else np.zeros(len(values), bool)


def _earlier(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether places ``a`` come before places ``b``."""
    return (a["doc"] < b["doc"]) | (a["doc"] == b["doc"]) & ((a["nth"] < b["nth"]) | (a["nth"] == b["nth"]) & (a["low"] < b["low"]))


@dataclass
class SuffixFamily:
    """Levels of sorted suffix records with the first place of each; ``repeats`` gathers all other places."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # keys, places, batch numbers
    repeats: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def add(self, rows: np.ndarray, places: np.ndarray, batch: int) -> None:
        keys = _keys(rows)
        order = np.lexsort((places["low"], places["nth"], places["doc"]))
        keys, places = keys[order], places[order]
        keys, first = np.unique(keys, return_index=True)
        rest = np.ones(len(places), bool)
        rest[first] = False
        batches = np.full(len(places), batch, np.int64)
        self.repeats.append((places[rest], batches[rest]))
        places, batches = places[first], batches[first]
        for level_keys, level_places, level_batches in self.levels:
            at = np.minimum(np.searchsorted(level_keys, keys), len(level_keys) - 1)
            met = np.flatnonzero(level_keys[at] == keys)
            there = at[met]
            old = _earlier(level_places[there], places[met])
            self.repeats.append((places[met[old]], batches[met[old]]))
            new, there = met[~old], there[~old]
            self.repeats.append((level_places[there].copy(), level_batches[there].copy()))
            level_places[there], level_batches[there] = places[new], batches[new]
            keep = np.ones(len(keys), bool)
            keep[met] = False
            keys, places, batches = keys[keep], places[keep], batches[keep]
        if len(keys):
            self.levels.append((keys, places, batches))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            self._merge()

    def _merge(self) -> None:
        a, b = self.levels.pop(), self.levels.pop()
        keys = np.concatenate([b[0], a[0]])
        order = np.argsort(keys, kind="stable")
        self.levels.append((keys[order], np.concatenate([b[1], a[1]])[order], np.concatenate([b[2], a[2]])[order]))

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One array of all distinct records."""
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0] if self.levels else (np.empty(0, f"S{WIDTH}"), np.empty(0, _PLACE), np.empty(0, np.int64))


#: For a window that starts ``o`` bytes before the anchor: which record bytes it has.
_COLUMNS = np.array([[8 + LENGTH + o - 1 - t if t < o else 8 + t - o for t in range(LENGTH)] for o in range(BEFORE + 1)])


def _windows(places: np.ndarray, at: np.ndarray, first: int = 0, last: int = BEFORE) -> tuple[np.ndarray, np.ndarray]:
    """(record, bytes before the anchor) of the windows of records ``at`` that start ``first`` to ``last`` bytes before it."""
    low = np.maximum(places["least"][at].astype(np.int64), first)
    count = np.maximum(np.minimum(places["most"][at].astype(np.int64), last) - low + 1, 0)
    return np.repeat(at, count), np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())


def _window_keys(rows: np.ndarray, rec: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Anchor hash, place in the record and bytes of each window."""
    text = np.empty((len(rec), 10 + LENGTH), np.uint8)
    text[:, :8], text[:, 8], text[:, -1] = rows[rec, :8], o, 1
    text[:, 9:-1] = rows[rec[:, None], _COLUMNS[o]]
    return _keys(text)


def hot_windows(rows: np.ndarray, places: np.ndarray, most: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(packed windows, whether an earlier record of the chunk has it) of all windows of the records, chunk by chunk."""
    for at in range(0, len(rows), most):
        rec, o = _windows(places, np.arange(at, min(at + most, len(rows))))
        out = np.empty(len(rec), _HOT)
        out["doc"], out["nth"], out["low"] = places["doc"][rec], places["nth"][rec], places["low"][rec] + places["most"][rec] - o
        text, same = np.unique(_window_keys(rows, rec, o), return_inverse=True)
        hashed = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in text.tolist()), "<u8").reshape(-1, 2)
        out["a"], out["b"] = hashed[same, 0], hashed[same, 1]
        yield out, later_windows(out)


def later_windows(windows: np.ndarray) -> np.ndarray:
    """Whether an earlier place in ``windows`` has the same window."""
    order = np.lexsort([windows[k] for k in ("low", "nth", "doc", "b", "a")])
    again = np.zeros(len(windows), bool)
    x = windows[order]
    again[order[1:]] = (x["a"][1:] == x["a"][:-1]) & (x["b"][1:] == x["b"][:-1])
    return again


def window_repeats(keys: np.ndarray, places: np.ndarray, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """(record, window start) of the windows of distinct records that an earlier record with the same anchor has too."""
    rows = keys.view(np.uint8).reshape(-1, WIDTH)
    hashes = np.ascontiguousarray(rows[:, :8]).view(">u8").reshape(-1)
    cuts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.empty(0, np.int64)
    sizes = np.diff(np.append(cuts, len(hashes)))
    several = np.repeat(sizes > 1, sizes)
    at = np.flatnonzero(several)
    count = (places["most"][at].astype(np.int64) - places["least"][at] + 1) if len(at) else np.empty(0, np.int64)
    group = np.repeat(np.arange(len(sizes)), sizes)[at]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    lo, total = 0, np.cumsum(count)
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        hi = int(np.searchsorted(group, group[hi - 1], "right"))
        step = max(1, most // (hi - lo))  # equal windows start equally far before the anchor
        for first in range(0, BEFORE + 1, step):
            rec, o = _windows(places, at[lo:hi], first, first + step - 1)
            start = places["low"][rec] + places["most"][rec] - o
            _, same = np.unique(_window_keys(rows, rec, o), return_inverse=True)
            order = np.lexsort((start, places["nth"][rec], places["doc"][rec], same))
            again = order[1:][same[order[1:]] == same[order[:-1]]]
            found.append((rec[again], start[again]))
        lo = hi
    return tuple(np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))


def _packed_spans(batch: np.ndarray, nth: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(batch, its spans as packed numbers)."""
    spans = np.column_stack([nth.astype(np.int64), low, high])
    order = np.argsort(batch, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(batch[order]) != 0)).tolist() if len(order) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
        yield int(batch[order[lo]]), spans[order[lo:hi]].tobytes()


def _high(places: np.ndarray) -> np.ndarray:
    return places["low"] + places["most"].astype(np.int64) - places["least"] + LENGTH


def repeated_spans(docs: DataFrame, batch_bytes: int = 2 << 20, shard_bytes: int = 8 << 20, hot: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(documents dealt into batches, (batch, spans) with the covered spans of each batch as packed numbers).

    Anchors that occur more than ``hot`` times are hot.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches, n_shards = max(1, -(-total // batch_bytes)), max(1, -(-total // shard_bytes))
    texts = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)))

    def shards(hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(n_shards)).astype(np.int64)

    def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0)) if len(order) else []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(order)) if len(order) else []):
            yield int(shard[order[lo]]), order[lo:hi]

    def collect(table: pa.Table) -> pa.Table:
        data, starts, ends, _, table = _batch(table)
        got = [x[0] for x in anchors(data, starts, ends)]
        hashes, counts = np.unique(np.concatenate(got), return_counts=True) if got else (np.empty(0, np.uint64), np.empty(0, np.int64))
        out = [(s, hashes[k].tobytes(), np.minimum(counts[k], 65535).astype("<u2").tobytes()) for s, k in by_shard(shards(hashes))]
        s, h, m = zip(*out) if out else ((), (), ())
        batch = table.column("batch")[0].as_py()
        return pa.table({"shard": pa.array(s, pa.int64()), "batch": pa.array([batch] * len(out), pa.int64()), "hashes": pa.array(h, pa.binary()), "many": pa.array(m, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        many = np.frombuffer(b"".join(table.column("many").to_pylist()), "<u2")
        values, at = np.unique(np.concatenate(blobs), return_inverse=True)
        total = np.bincount(at, many, len(values))
        parts = np.split(total[at], np.cumsum([len(b) for b in blobs])[:-1])
        found = [pa.array([b[use(x)].tobytes() for b, x in zip(blobs, parts)], pa.binary()) for use in (lambda x: (x > 1) & (x <= hot), lambda x: x > max(hot, 1))]
        return pa.table({"batch": table.column("batch"), "hashes": found[0], "hot": found[1]})

    def extract(table: pa.Table, flags: pa.Table) -> pa.Table:
        out: list[tuple] = []
        batch = None
        if table.num_rows and flags.num_rows:
            batch = table.column("batch")[0].as_py()
            cold, often = (np.sort(np.frombuffer(b"".join(flags.column(c).to_pylist()), np.uint64)) for c in ("hashes", "hot"))
            data, starts, ends, ids, _ = _batch(table)
            parts: dict[tuple[int, bool], list[bytes]] = {}
            spans: list[bytes] = []
            for got in anchors(data, starts, ends) if len(cold) + len(often) else ():
                is_hot = _among(got[0], often)
                use = is_hot | _among(got[0], cold)
                got, is_hot = tuple(x[use] for x in got), is_hot[use]
                _, doc, p, lo, hi = got
                place = np.zeros(len(doc), _PLACE)
                place["doc"], place["nth"], place["low"], place["most"], place["least"] = ids[doc], doc, lo - starts[doc], p - lo, p - hi
                rows = _records(data, got)
                _, first = np.unique(_keys(rows), return_index=True)  # anchors come in the order of their places
                rest = np.ones(len(doc), bool)
                rest[first] = False
                spans += [x for _, x in _packed_spans(np.full(rest.sum(), batch), place["nth"][rest], place["low"][rest], _high(place[rest]))]
                first.sort()
                rows, place, is_hot, dealt = rows[first], place[first], is_hot[first], got[0][first]
                for windows, again in hot_windows(rows[is_hot], place[is_hot]):
                    low = windows["low"][again]
                    spans += [x for _, x in _packed_spans(np.full(len(low), batch), windows["nth"][again], low, low + LENGTH)]
                    windows = windows[~again]
                    for s, k in by_shard(shards(windows["a"])):
                        parts.setdefault((s, True), []).append(windows[k].tobytes())
                rows = np.concatenate([rows, place.view(np.uint8).reshape(len(place), _PLACE.itemsize)], axis=1)  # a slice may have no repeated anchor
                some = np.flatnonzero(~is_hot)
                for s, k in by_shard(shards(dealt[some])):
                    parts.setdefault((s, False), []).append(rows[some[k]].tobytes())
            out = [(s, kind, zstandard.compress(b"".join(x), 1), None) for (s, kind), x in parts.items()]
            if spans:
                out.append((batch % n_shards, None, None, b"".join(spans)))
        columns = list(zip(*out)) if out else [()] * 4
        kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        s, h, r, x = (pa.array(c, k) for c, k in zip(columns, kinds))
        return pa.table({"shard": s, "batch": pa.array([batch] * len(out), pa.int64()), "hot": h, "records": r, "spans": x})

    def index(table: pa.Table) -> pa.Table:
        family, windows, batch_of = SuffixFamily(), [], []
        order = np.argsort(table.column("batch").to_numpy(), kind="stable").tolist()
        blobs, batches, kinds = table.column("records"), table.column("batch"), table.column("hot").to_pylist()
        out = [(b, x) for b, x in zip(batches.to_pylist(), table.column("spans").to_pylist()) if x is not None]
        for k in order:
            raw = zstandard.decompress(blobs[k].as_py()) if kinds[k] is not None else b""
            if kinds[k]:
                windows.append(np.frombuffer(raw, _HOT))
                batch_of.append(np.full(len(windows[-1]), batches[k].as_py()))
            elif raw:
                rows = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH + _PLACE.itemsize)
                places = np.ascontiguousarray(rows[:, WIDTH:]).view(_PLACE).reshape(-1)
                family.add(rows[:, :WIDTH], places, batches[k].as_py())
        if windows:
            hot, of = np.concatenate(windows), np.concatenate(batch_of)
            again = later_windows(hot)
            out += _packed_spans(of[again], hot["nth"][again], hot["low"][again], hot["low"][again] + LENGTH)
        if family.repeats:
            places, of = (np.concatenate(x) for x in zip(*family.repeats))
            out += _packed_spans(of, places["nth"], places["low"], _high(places))
        keys, places, of = family.close()
        if len(keys):
            rec, start = window_repeats(keys, places)
            out += _packed_spans(of[rec], places["nth"][rec], start, start + LENGTH)
        b, x = zip(*out) if out else ((), ())
        return pa.table({"batch": pa.array(b, pa.int64()), "spans": pa.array(x, pa.binary())})

    met = texts.groupBy("batch").applyInArrow(collect, "shard long, batch long, hashes binary, many binary")
    flags = met.groupBy("shard").applyInArrow(count, "batch long, hashes binary, hot binary")
    records = texts.groupBy("batch").cogroup(flags.groupBy("batch")).applyInArrow(extract, "shard long, batch long, hot boolean, records binary, spans binary")
    return texts, records.groupBy("shard").applyInArrow(index, "batch long, spans binary")


def drop_repeats(docs: DataFrame, keep_text: bool = False, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; ``keep_text`` adds the remaining bytes."""
    texts, spans = repeated_spans(docs, **options)

    def rebuild(table: pa.Table, found: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text]
        columns: list[list] = [[], [], [], [], [], []]
        if table.num_rows:
            data, starts, ends, _, table = _batch(table)
            edge = np.zeros(len(data) + 1, np.int32)
            if found.num_rows:
                x = np.frombuffer(b"".join(found.column("spans").to_pylist()), np.int64).reshape(-1, 3)
                np.add.at(edge, x[:, 1] + starts[x[:, 0]], 1)
                np.add.at(edge, x[:, 2] + starts[x[:, 0]], -1)
            covered = np.cumsum(edge[:-1]) > 0
            for doc_id, lo, hi in zip(table.column("doc_id").to_pylist(), starts.tolist(), ends.tolist()):
                gone = covered[lo:hi]
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = data[lo:hi][~gone].tobytes()
                for c, v in zip(columns, (doc_id, hi - lo, int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept)):
                    c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return texts.groupBy("batch").cogroup(spans.groupBy("batch")).applyInArrow(rebuild, schema)
