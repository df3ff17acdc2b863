"""Byte-level BPE by the ranks of a vocabulary: a transducer that is determinised as it meets text, and a streaming decoder.

A sequence of tokens is what the merges make of its bytes if and only if that holds for each two neighbours, so the
merges compile into a transducer: it is in a token of the vocabulary's trie, remembers the token before, and may end
the token wherever both go together.  Its subsets of such places are made when text first leads there, and kept.  A
token is emitted as soon as all places of the subset agree on it; no place lives longer than the longest token, which
bounds how far the transducer looks ahead.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ChunkEncoder

#: Ids decoded and pieces encoded at a time; places of a subtree that are looked through for a token that may follow.
BLOCK, GROUP, LOOK = 1 << 16, 1 << 14, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A base64 token and its rank in each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def by_rank(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


class Vocabulary:
    """Tokens, their ranks, and the two parts that a merge makes each of.

    Ranks are those of training: a token ranks after its parts.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = by_rank(ranks)
        self.parts: dict[int, tuple[int, int]] = {}
        #: Tokens that no merges lead to; they stand only for a whole piece.
        self.alone: dict[bytes, int] = {}
        self._agree: dict[int, bool] = {}
        self._edges: tuple[dict[int, list], dict[int, list]] = {}, {}
        for rank, token in enumerate(self.tokens):
            if len(token) > 1:
                found = self._split(token, rank)
                if found:
                    self.parts[rank] = found
                else:
                    self.alone[token] = rank
        self._edges = {}, {}

    def _split(self, token: bytes, rank: int) -> tuple[int, int] | None:
        for k in range(1, len(token)):
            a, b = self.ranks.get(token[:k], rank), self.ranks.get(token[k:], rank)
            if a < rank and b < rank and token[:k] not in self.alone and token[k:] not in self.alone and self._meet(self._edge(a, 1), self._edge(b, 0), rank):
                return a, b
        return None

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at the left (0) or right (1) end of ``token`` while it is made, each with the rank that ends it."""
        out = self._edges[side].get(token)
        if out is None:
            out, until, at = [], float("inf"), token
            while True:
                out.append((self.tokens[at], until))
                if at not in self.parts:
                    break
                until, at = at, self.parts[at][side]
            out.reverse()
            if len(self._edges[side]) >= 20_000:
                self._edges[side].clear()
            self._edges[side][token] = out
        return out

    def agree(self, left: int, right: int) -> bool:
        """The merges leave ``left`` and ``right`` as they are when they stand side by side."""
        key = left << 32 | right
        known = self._agree.get(key)
        if known is None:
            if len(self._agree) >= 200_000:
                self._agree.clear()
            known = self._agree[key] = self._meet(self._edge(left, 1), self._edge(right, 0))
        return known

    def _meet(self, lefts: list[tuple[bytes, float]], rights: list[tuple[bytes, float]], below: float = float("inf")) -> bool:
        """No merge of a rank under ``below`` joins what stands at the right end of one and the left end of the other."""
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = lefts[i], rights[j]
            rank = self.ranks.get(a + b)
            if rank is not None and rank < below and rank < a_until and rank <= b_until:
                return False  # this merge comes before the one that ends either; of equal ranks the left one is first
            if a_until <= b_until:
                i += 1
            else:
                j += 1
            if i == len(lefts) or j == len(rights):
                return True


class Transducer:
    """Tokens of pieces of bytes.

    A state is a subset: (token before, place in the trie, tokens not yet emitted) of each way that is still open, the
    longest open token first, the token that ends last.  A step leads from a state by a byte to a state, and emits
    tokens.  Steps lie in a hash table, so that many pieces go forward together; at most ``keep`` states are
    remembered, then it starts to build them anew.
    """

    def __init__(self, vocabulary: Vocabulary, keep: int = 250_000):
        self.vocabulary, self.keep = vocabulary, keep
        self.trie: dict[int, int] = {}  # place * 256 + byte: next place; the root is 0
        self.token_at = [-1]
        self.below: list[list[int]] = [[]]  # the places after a place
        for rank, token in enumerate(vocabulary.tokens):
            if not token or token in vocabulary.alone:
                continue
            place = 0
            for byte in token:
                key = place * 256 + byte
                to = self.trie.get(key, 0)
                if not to:
                    to = self.trie[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.below.append([])
                    self.below[place].append(to)
                place = to
            self.token_at[place] = rank
        self.size = [1] * len(self.below)  # places of each subtree; a place comes after those that lead to it
        for place in range(len(self.below) - 1, -1, -1):
            self.size[place] += sum(self.size[to] for to in self.below[place])
        self._reset()

    def _reset(self) -> None:
        start = array("i", [0, 0, 0]).tobytes()
        self.ways, self.ids, self.ends = [start], {start: 0}, {}
        #: Tokens that steps and ends of states emit: each sequence once, one after the other.
        self.emitted: dict[tuple[int, ...], int] = {(): 0}
        self.flat, self.bounds = _Numbers(), _Numbers([0, 0])
        self.final = _Numbers([0])
        self.steps = _Steps()

    def _sequence(self, tokens: tuple[int, ...]) -> int:
        known = self.emitted.get(tokens)
        if known is None:
            known = self.emitted[tokens] = len(self.emitted)
            for t in tokens:
                self.flat.add(t)
            self.bounds.add(self.flat.size)
        return known

    def _open(self, before: int, place: int) -> bool:
        """Some token that goes on from ``place`` may follow ``before``; large subtrees are taken as if they had one."""
        if not self.below[place]:
            return False
        if before < 0 or self.size[place] > LOOK:
            return True
        key = before << 32 | place
        known = self.ends.get(key)
        if known is None:
            known = any((self.token_at[to] >= 0 and self.vocabulary.agree(before, self.token_at[to])) or self._open(before, to) for to in self.below[place])
            if len(self.ends) >= 200_000:
                self.ends.clear()
            self.ends[key] = known
        return known

    def _build(self, state: int, byte: int) -> None:
        """Add the step from ``state`` by ``byte``."""
        ways, root = [], None
        packed, at = array("i", self.ways[state]), 0
        while at < len(packed):
            before, place, n = packed[at] - 1, packed[at + 1], packed[at + 2]
            held = tuple(packed[at + 3 : at + 3 + n])
            at += 3 + n
            to = self.trie.get(place * 256 + byte)
            if to is None:
                continue
            token = self.token_at[to]
            if root is None and token >= 0 and (before < 0 or self.vocabulary.agree(before, token)):
                root = (token, 0, (*held, token))
            if self._open(before, to):
                ways.append((before, to, held))
        if root is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        ways.append(root)
        first, n = ways[0][2], 0
        if first:  # tokens that all ways agree on leave
            first, last = min(w[2] for w in ways), max(w[2] for w in ways)
            while n < len(first) and n < len(last) and first[n] == last[n]:
                n += 1
        packed = array("i")
        for before, place, held in ways:
            packed.extend((before + 1, place, len(held) - n, *held[n:]))
        key = packed.tobytes()
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.ways)
            self.ways.append(key)
            self.final.add(self._sequence(root[2][n:]))
        self.steps.add(state << 8 | byte, to, self._sequence(first[:n]))

    def stream(self, piece: bytes) -> Iterator[tuple[int, ...]]:
        """The tokens that are known after each byte, and at the end the rest."""
        state = 0
        for byte in piece:
            at = int(self.steps.find(np.array([state << 8 | byte]))[0])
            if at < 0:
                self._build(state, byte)
                at = self.steps.count - 1
            state = int(self.steps.to[at])
            yield self._tokens(int(self.steps.out[at]))
        yield self._tokens(int(self.final.all()[state]))

    def _tokens(self, sequence: int) -> tuple[int, ...]:
        return tuple(self.flat.all()[self.bounds.all()[sequence] : self.bounds.all()[sequence + 1]].tolist())

    def encode(self, piece: bytes) -> list[int]:
        return self.encode_all([piece])[0].tolist()

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has; all pieces go forward byte by byte together."""
        if len(self.ways) >= self.keep:
            self._reset()
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-lens, kind="stable")
        sizes, data = lens[order], np.frombuffer(b"".join(pieces), np.uint8)
        starts = (np.cumsum(lens) - lens)[order]
        most = int(sizes[0]) if len(sizes) else 0
        live = np.searchsorted(-sizes, -np.arange(most), "left")  # pieces longer than k come first
        begin = np.concatenate([[0], np.cumsum(live)])
        out = np.empty(int(begin[-1]), np.int32)  # what each step emits, step by step
        state = np.zeros(len(pieces), np.int64)
        for k in range(most):
            n = int(live[k])
            key = state[:n] << 8 | data[starts[:n] + k]
            at = self.steps.find(key)
            if at.min() < 0:
                for missing in np.unique(key[at < 0]).tolist():
                    self._build(missing >> 8, missing & 255)
                at = self.steps.find(key)
            state[:n] = self.steps.to[at]
            out[begin[k] : begin[k + 1]] = self.steps.out[at]
        # the sequences of a piece in order: its steps, then what is left in its last state
        back = np.empty(len(pieces), np.int64)
        back[order] = np.arange(len(pieces))
        many = lens + 1
        ends = np.cumsum(many)
        which = np.repeat(np.arange(len(pieces)), many)
        k = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - many, many)
        last = np.zeros(len(k), bool)
        last[ends - 1] = True
        sequence = np.empty(len(k), np.int64)
        sequence[last] = self.final.all()[state[back]]
        step = ~last
        sequence[step] = out[begin[k[step]] + back[which[step]]]
        some = np.flatnonzero(sequence)  # most steps emit nothing
        bounds, flat = self.bounds.all(), self.flat.all()
        first, n = bounds[sequence[some]], bounds[sequence[some] + 1] - bounds[sequence[some]]
        total = np.cumsum(n)
        ids = flat[np.repeat(first - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)]
        counts = np.bincount(which[some], weights=n, minlength=len(pieces)).astype(np.int64)
        if self.vocabulary.alone:
            lone = [(k, self.vocabulary.alone[x]) for k, x in enumerate(pieces) if x in self.vocabulary.alone]
            if lone:
                ids, counts = _replaced(ids, counts, lone)
        return ids, counts


def _replaced(ids: np.ndarray, counts: np.ndarray, lone: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for k, token in lone:
        parts[k] = np.array([token], ids.dtype)
    return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


class _Numbers:
    """A numpy array that grows."""

    def __init__(self, first: list[int] = ()):
        self.data, self.size = np.zeros(max(1024, len(first)), np.int64), len(first)
        self.data[: self.size] = first

    def add(self, x: int) -> None:
        if self.size == len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.size] = x
        self.size += 1

    def all(self) -> np.ndarray:
        return self.data[: self.size]


class _Steps:
    """(state, byte) to the number of a step: open addressing, looked up for many keys at a time."""

    def __init__(self, bits: int = 16):
        self.bits, self.count = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.slots = np.zeros(1 << bits, np.int32)
        self.to, self.out = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The step of each key, -1 where there is none."""
        mask = len(self.keys) - 1
        slot = self._home(keys)
        met = self.keys[slot]
        out = np.where(met == keys, self.slots[slot], -1)
        left = np.flatnonzero((met != keys) & (met >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            met = self.keys[slot[left]]
            hit = met == keys[left]
            out[left[hit]] = self.slots[slot[left[hit]]]
            left = left[~hit & (met >= 0)]
        return out

    def add(self, key: int, to: int, out: int) -> None:
        if 2 * self.count >= len(self.keys):
            self._grow()
        self._place(key, self.count)
        self.to[self.count], self.out[self.count] = to, out
        self.count += 1

    def _place(self, key: int, step: int) -> None:
        mask = len(self.keys) - 1
        slot = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while self.keys[slot] >= 0:
            slot = (slot + 1) & mask
        self.keys[slot], self.slots[slot] = key, step

    def _grow(self) -> None:
        old = np.flatnonzero(self.keys >= 0)
        keys, steps = self.keys[old].tolist(), self.slots[old].tolist()
        self.bits += 1
        self.keys, self.slots = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        self.to, self.out = np.resize(self.to, 1 << self.bits), np.resize(self.out, 1 << self.bits)
        for key, step in zip(keys, steps):
            self._place(key, step)


class PieceEncoder(ChunkEncoder):
    """Ids of texts: each match of ``pattern`` goes through the transducer, once for each distinct chunk of a slice."""

    def __init__(self, path: str, pattern: str, keep: int = 250_000):
        import regex

        self.model = Transducer(Vocabulary(read_ranks(path)), keep)
        self.pattern = regex.compile(pattern)
        self.spaced = True
        self.kind = "<u2" if len(self.model.vocabulary.tokens) <= 65536 else "<u4"

    def whole(self, text: str) -> np.ndarray:
        pieces = self.pattern.findall(text)
        return self._ids(pieces, np.array([len(pieces)]))[0]

    def _ids(self, pieces: list[str], per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces; how many each run of ``per`` pieces has."""
        parts = [self.model.encode_all([p.encode() for p in pieces[k : k + GROUP]]) for k in range(0, max(len(pieces), 1), GROUP)]
        ids, counts = (np.concatenate(x) for x in zip(*parts))
        ends = np.append(0, np.cumsum(counts))[np.cumsum(per)]
        return ids.astype(self.kind), np.diff(ends, prepend=0)

    def _lookup(self, words: list[str]) -> list[bytes]:
        """Ids of distinct chunks; a leading NUL marks the head of a text, which no space precedes."""
        pieces: list[str] = []
        per = np.ones(len(words), np.int64)
        # letters alone are one piece: what these engines call a letter is one for the pattern too
        alone = pc.match_substring_regex(pa.array(words, pa.string()), r"^\p{L}+$").to_numpy(zero_copy_only=False)
        for k, (word, one) in enumerate(zip(words, alone.tolist())):
            if one:
                pieces.append(" " + word)
            else:
                found = self.pattern.findall(word[1:] if word[:1] == "\0" else " " + word)
                pieces += found
                per[k] = len(found)
        ids, counts = self._ids(pieces, per)
        raw, ends = ids.tobytes(), (np.cumsum(counts) * ids.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _utf8_table() -> np.ndarray:
    """[state, byte]: the next state, plus 16 where the byte does not belong there.

    State 0 is between characters; 1, 2, 3 wait for so many more bytes; 4 and 5 follow E0 and ED, 6 and 7 follow F0 and
    F4, whose next byte has a narrower range.  After a wrong byte the machine starts again, with that byte if it can.
    """
    start = np.full(256, 16, np.uint8)
    start[:0x80] = 0
    for lead, state in ((range(0xC2, 0xE0), 1), (range(0xE1, 0xF0), 2), (range(0xF1, 0xF4), 3), ([0xE0], 4), ([0xED], 5), ([0xF0], 6), ([0xF4], 7)):
        start[list(lead)] = state
    table = np.tile(start | 16, (8, 1)).astype(np.uint8)
    table[0] = start
    for state, low, high, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        table[state, low : high + 1] = to
    return table


class Decoder:
    """Bytes of ids as they come in: whole characters go out, the bytes of one that has only begun wait."""

    def __init__(self, table: DecodeTable):
        self.table, self.state, self.held, self.valid = table, 0, b"", True

    def feed(self, ids: np.ndarray) -> bytes:
        after = self.table.after
        if self.state == 0 and not after[ids, 0].any():
            return b"".join([self.table.tokens[k] for k in ids.tolist()])
        at, state = 0, self.state
        breaks = np.flatnonzero(after[ids, 0])
        while at < len(ids):
            if state == 0:  # tokens of whole characters leave the state as it is
                k = int(np.searchsorted(breaks, at))
                if k == len(breaks):
                    break
                at = int(breaks[k])
            step = int(after[ids[at], state])
            self.valid &= step < 16
            state = step & 15
            at += 1
        self.state = state
        data = self.held + b"".join([self.table.tokens[k] for k in ids.tolist()])
        wait = 0
        if state:  # back to the byte that begins the open character
            wait = 1
            while data[-wait] & 0xC0 == 0x80:
                wait += 1
        self.held = data[len(data) - wait :]
        return data[: len(data) - wait]

    def finish(self) -> bytes:
        """What waits for bytes that never came."""
        out, self.valid = self.held, self.valid and self.state == 0
        self.held, self.state = b"", 0
        return out


class DecodeTable:
    """What each token does to each state of the UTF-8 machine (16 is added where it meets a wrong byte)."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        machine = _utf8_table()
        self.after = np.tile(np.arange(8, dtype=np.uint8), (len(tokens), 1))
        lengths = np.array([len(t) for t in tokens], np.int64)
        some = np.arange(len(tokens))
        for k in range(int(lengths.max(initial=0))):
            some = some[lengths[some] > k]
            byte = np.array([tokens[t][k] for t in some.tolist()], np.int64)
            was = self.after[some]
            self.after[some] = machine[was & 15, byte[:, None]] | (was & 16)


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> PieceEncoder:
    return PieceEncoder(path, pattern)


@lru_cache(maxsize=2)
def _decode_table(path: str) -> DecodeTable:
    return DecodeTable(by_rank(read_ranks(path)))


def _encode(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_tokens, ids)."""
    enc = _encoder(ranks, pattern)
    for batch in batches:
        for at, ids, counts in enc.encode(batch.column(1), most_bytes=4 << 20):
            raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
            rows = [raw[a:b] for a, b in zip((ends - 4 * counts).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), pa.array(counts), pa.array(rows, pa.binary())], names=["doc_id", "n_tokens", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_tokens, ids) with the bytes of the ids, and whether they are whole UTF-8."""
    table = _decode_table(ranks)
    for batch in batches:
        out, valid = [], []
        for raw in batch.column(2).to_pylist():
            ids, decoder = np.frombuffer(raw or b"", "<u4"), Decoder(table)
            out.append(b"".join([*(decoder.feed(ids[k : k + BLOCK]) for k in range(0, len(ids), BLOCK)), decoder.finish()]))
            valid.append(decoder.valid)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()), pa.array(valid)], names=["doc_id", "n_tokens", "ids", "decoded", "valid"])


IDS, BYTES = "doc_id long, n_tokens long, ids binary", "doc_id long, n_tokens long, ids binary, decoded binary, valid boolean"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encoded(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of (doc_id, text); ids are little-endian unsigned 32-bit numbers.

    A null text is empty and has no tokens.  Rows are kept as they are: ids may repeat or be null, other columns are
    not read.  Texts of any length go through whole; the file of ranks is read in each Python worker by its path.
    """
    return _texts(docs).mapInArrow(lambda batches: _encode(batches, ranks, pattern), IDS)


def decoded(tokens: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded, valid): the bytes of ``ids`` and whether they are whole UTF-8; null ids are none."""
    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(lambda batches: _decode(batches, ranks), BYTES)


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded again.

    Both run in one Python worker, as two would each keep the encoder's states.
    """
    rows = _texts(docs).mapInArrow(lambda batches: _decode(_encode(batches, ranks, pattern), ranks), BYTES)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
