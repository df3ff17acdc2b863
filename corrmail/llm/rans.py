"""Token ids in files coded by a static range asymmetric numeral system (operator 4).

One frequency table serves all files.  A file row holds a frame of whole documents in ascending doc_id order, coded
apart from all others: up to ``LANES`` interleaved states take the tokens in turn (fewer in a short frame; the header
has their number), and every ``STEPS`` turns a checkpoint
keeps the states and the place in the words, so parts of a frame decode independently.  Two checksums guard a frame,
one of its bytes and one of its ids.  Frames are written as Parquet rows, so any store that Spark reaches holds them.

Frame (little-endian): magic, 8 header numbers, document ids (and which are null), token counts, checkpoints, words, crc32.
Null text is empty and has the end id alone.  Repeated rows are written as often as they occur.  A null doc_id sorts
first.  An empty table gives an empty file.  Ids take 16 bits before they are coded if the vocabulary allows it, else 32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, shuffle_partitions
from .tokens import encoder

#: Fixed values of the format.
MAGIC, BITS, LOW = b"RNS1", 20, 1 << 31
LANES, STEPS, FRAME_TOKENS = 2048, 64, 1 << 18
_HEAD = struct.Struct("<4s8I")


@dataclass(frozen=True)
class Table:
    """Frequencies that sum to 2**BITS; ids that never occur have none."""

    freq: np.ndarray

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.freq) - self.freq

    @property
    def symbol(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)


def frequency_table(counts: dict[int, int], vocabulary: int) -> Table:
    """Scale counts to 2**BITS, at least one for each id that occurs."""
    raw = np.zeros(vocabulary, np.int64)
    raw[list(counts)] = list(counts.values())
    total = max(1, int(raw.sum()))
    freq = np.where(raw > 0, np.maximum(1, (raw.astype(np.float64) * (1 << BITS) / total).astype(np.int64)), 0)
    rest = (1 << BITS) - int(freq.sum())
    if raw.sum() == 0:
        freq[0] = 1 << BITS
    elif rest > 0:
        freq[int(np.argmax(freq))] += rest
    else:
        for k in np.argsort(-freq, kind="stable").tolist():
            take = min(-rest, int(freq[k]) // 2)
            freq[k] -= take
            rest += take
            if rest == 0:
                break
    return Table(freq)


def lanes_for(n_ids: int) -> int:
    """A power of two, so that the states of a short frame do not outweigh its words."""
    return min(LANES, max(4, 1 << (n_ids // 512).bit_length()))


def id_kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encode_ids(ids: np.ndarray, freq: np.ndarray, start: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states at each checkpoint, words before it, words); lanes code backwards so that decoding runs forwards."""
    steps = -(-len(ids) // lanes)
    f = np.ones((steps, lanes), np.uint64)
    c = np.zeros((steps, lanes), np.uint64)
    f.reshape(-1)[: len(ids)] = freq[ids]
    c.reshape(-1)[: len(ids)] = start[ids]
    x = np.full(lanes, LOW, np.uint64)
    bits, half, room = np.uint64(BITS), np.uint64(32), np.uint64(43)
    words: list[np.ndarray] = []
    states = np.empty((-(-steps // STEPS), lanes), np.uint64)
    for t in range(steps - 1, -1, -1):
        n = min(lanes, len(ids) - t * lanes)
        y, fs = x[:n], f[t, :n]
        full = y >= (fs << room)
        words.append(y[full].astype(np.uint32))
        y = np.where(full, y >> half, y)
        q = y // fs
        x[:n] = (q << bits) + (y - q * fs) + c[t, :n]
        if t % STEPS == 0:
            states[t // STEPS] = x
    words.reverse()
    before = np.append(0, np.cumsum([len(w) for w in words]))[:steps:STEPS] if steps else np.empty(0, np.int64)
    return states, before.astype(np.uint32), np.concatenate(words) if words else np.empty(0, np.uint32)


def decode_part(part: int, n_ids: int, states: np.ndarray, before: np.ndarray, words: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids from checkpoint ``part`` up to the next one; needs nothing of the other parts."""
    freq, start, symbol = table
    lanes = states.shape[1]
    x, at = states[part].copy(), int(before[part])
    first, last = part * STEPS * lanes, min(n_ids, (part + 1) * STEPS * lanes)
    out = np.empty(last - first, np.uint32)
    bits, half, mask, low = np.uint64(BITS), np.uint64(32), np.uint64((1 << BITS) - 1), np.uint64(LOW)
    for lo in range(0, len(out), lanes):
        n = min(lanes, len(out) - lo)
        y = x[:n]
        slot = y & mask
        ids = symbol[slot]
        y = freq[ids] * (y >> bits) + slot - start[ids]
        need = np.flatnonzero(y < low)
        y[need] = (y[need] << half) | words[at : at + len(need)]
        at += len(need)
        x[:n] = y
        out[lo : lo + n] = ids
    return out


def dump_frame(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    states, before, words = encode_ids(ids, freq, start, lanes_for(len(ids)))
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(states), len(words), states.shape[1], STEPS, BITS, zlib.crc32(ids.astype("<u4").tobytes()))
    known = np.array([x is not None for x in doc_ids], np.uint8)
    parts = (np.array([x or 0 for x in doc_ids], "<i8"), known, np.array(counts, "<u4"), states.astype("<u8"), before.astype("<u4"), words.astype("<u4"))
    body = head + b"".join(x.tobytes() for x in parts)
    return body + struct.pack("<I", zlib.crc32(body))


def open_frame(raw: bytes) -> tuple[list[int | None], np.ndarray, int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, tokens of each, all tokens, crc32 of the ids, states, words before, words) of an undamaged frame."""
    magic, n_docs, n_ids, n_parts, n_words, lanes, steps, bits, crc = _HEAD.unpack_from(raw)
    if (magic, steps, bits) != (MAGIC, STEPS, BITS) or struct.unpack("<I", raw[-4:])[0] != zlib.crc32(raw[:-4]):
        raise ValueError("damaged frame")
    at, arrays = _HEAD.size, []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u8", n_parts * lanes), ("<u4", n_parts), ("<u4", n_words)):
        arrays.append(np.frombuffer(raw, kind, n, at))
        at += arrays[-1].nbytes
    doc_ids, known, counts, states, before, words = arrays
    doc_ids = [x if k else None for x, k in zip(doc_ids.tolist(), known.tolist())]
    return doc_ids, counts.astype(np.int64), n_ids, crc, states.reshape(n_parts, lanes), before, words


def load_frame(raw: bytes, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, tokens of each, all ids); raises ValueError if a checksum differs."""
    doc_ids, counts, n_ids, crc, states, before, words = open_frame(raw)
    parts = [decode_part(k, n_ids, states, before, words, table) for k in range(len(states))]
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("ids do not match their checksum")
    return doc_ids, counts, ids


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """(doc_id, n_tokens, ids as numbers of ``id_kind``) of every row, the end id included."""
    kind = id_kind(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, True)
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            for at, ids, counts in enc.encode(batch.column(1)):
                if len(ids) and ids.max() >= vocabulary:
                    raise ValueError("an id is beyond the vocabulary")
                ids = ids.astype(kind, copy=False)
                raw, ends = ids.tobytes(), np.cumsum(counts) * ids.itemsize
                rows = [raw[a:b] + end for a, b in zip((ends - counts * ids.itemsize).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), pa.array(counts + 1), pa.array(rows, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def count_ids(tokens: DataFrame, vocabulary: int) -> dict[int, int]:
    """How often each id occurs: at most one row an id comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), id_kind(vocabulary)), minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {int(r[0]): int(r[1]) for r in rows}


def write_frames(tokens: DataFrame, table: Table, partitions: int | None = None) -> DataFrame:
    """Write frames in ascending doc_id order; the frame table read back: (part, frame, n_tokens, data)."""
    freq, start = table.freq.astype(np.uint64), table.start.astype(np.uint64)
    kind = np.dtype(id_kind(len(table.freq)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, frame = TaskContext.get().partitionId(), 0
        docs: list = []
        raws: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(raws), kind)
            data = dump_frame(docs, [len(x) // kind.itemsize for x in raws], ids, freq, start)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "frame": pa.array([frame], pa.int32()), "n_tokens": pa.array([len(ids)], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(doc_id)
                raws.append(raw)
                size += len(raw) // kind.itemsize
                if size >= FRAME_TOKENS:
                    yield flush()
                    docs, raws, size, frame = [], [], 0, frame + 1
        if docs:
            yield flush()

    ordered = tokens.select("doc_id", "ids").repartitionByRange(partitions or shuffle_partitions(tokens.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(run, "part int, frame int, n_tokens long, data binary"), "frames")


def read_frames(frames: DataFrame, table: Table, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; ``keep_ids`` adds the ids (32-bit)."""
    freq, start, symbol = table.freq.astype(np.uint64), table.start.astype(np.uint64), table.symbol

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, frame, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                doc_ids, counts, ids = load_frame(raw, (freq, start, symbol))
                raws, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                each = [raws[4 * a : 4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist())]
                n = len(doc_ids)
                columns = {"part": pa.array([part] * n, pa.int32()), "frame": pa.array([frame] * n, pa.int32()), "doc_id": pa.array(doc_ids, pa.int64()), "at": pa.array(ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64())}
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(each, pa.binary())} if keep_ids else {}))

    docs = frames.select("part", "frame", "data").mapInArrow(run, "part int, frame int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    parts = frames.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    starts = frames.select("part", "frame", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)).alias("inner")).join(parts, "part")
    starts = starts.select("part", "frame", (F.col("base") + F.col("inner")).alias("base"))
    out = docs.join(starts, ["part", "frame"]).withColumn("start", F.col("base") + F.col("at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def read_parts(frames: DataFrame, table: Table) -> DataFrame:
    """(part, frame, checkpoint, first, ids as 32-bit numbers): every stretch between two checkpoints, decoded apart."""
    decode = table.freq.astype(np.uint64), table.start.astype(np.uint64), table.symbol

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, out = [], []
            for raw, k in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                _, _, n_ids, _, states, before, words = open_frame(raw)
                first.append(k * STEPS * states.shape[1])
                out.append(decode_part(k, n_ids, states, before, words, decode).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(first, pa.int64()), pa.array(out, pa.binary())], names=["part", "frame", "checkpoint", "first", "ids"])

    n_parts = F.expr("cast(conv(hex(reverse(substring(data, 13, 4))), 16, 10) as int)")  # third number of the header
    each = frames.select("part", "frame", "data", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("checkpoint"))
    return each.repartition("part", "frame", "checkpoint").mapInArrow(run, "part int, frame int, checkpoint int, first long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 2) -> DataFrame:
    """Encode every text, write the frames, read them back."""
    tokens = materialize(tokenized(docs, tokenizer, end_id, vocabulary), "tokens")
    table = frequency_table(count_ids(tokens, vocabulary), vocabulary)
    return read_frames(write_frames(tokens, table), table)
