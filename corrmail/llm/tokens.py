"""Token ids of whole texts with the ``tokenizers`` library, computed once per distinct space-separated chunk.

Both vocabularies used here split a text before BPE, and a lone space between two chunks is always such a split
point.  So ids of a text are the ids of its chunks, one after the other: Arrow splits a slice of the texts and
numbers its distinct chunks, only chunks that the task has not met yet go to the library, and numpy lays the ids
out again.  Texts in which the rule does not hold go to the library whole.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANK = r"[\t-\r\x1c-\x20\x85\x{a0}\p{Z}]"
#: White space next to a space, or a space at an end, may be part of a longer pre-token; NUL marks heads below.
_ODD = rf"{_BLANK} | {_BLANK}|^ | $|\x00"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies use for each byte: printable bytes stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(other)) for b in range(256)}


_LETTERS = _byte_letters()


class ChunkEncoder:
    """``spaced``: the vocabulary is byte level and keeps the space before a word; else white space is dropped."""

    def __init__(self, path: str, spaced: bool, keep: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.keep = spaced, keep
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        if spaced:  # a byte-level token has one letter for each of its bytes
            self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.n_bytes[i] = len(token)
        else:  # the last token of each pre-token says so
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for token, i in self.tokenizer.get_vocab().items():
                self.ends[i] = token.endswith("</w>")
        self.seen: dict[str, bytes] = {}
        self.points: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)

    def _word(self, word: str) -> bytes:
        """Ids of a chunk of letters alone: it is one pre-token, so it goes to the model itself."""
        text = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(_LETTERS[32] + text if self.spaced else text)]).tobytes()

    def _is_word(self, chunk: str) -> bool:
        if not chunk.isalpha():
            return False
        return self.spaced or chunk.isascii() and chunk.islower() or chunk == chunk.lower() and unicodedata.is_normalized("NFC", chunk)

    def _chunks(self, chunks: list[str], many: int = 200) -> list[bytes]:
        """Ids of each chunk; of those that are not plain words, many go to the library as one string."""
        out: list = [self._word(c) if self._is_word(c) else None for c in chunks]
        rest = [k for k, x in enumerate(out) if x is None]
        for at in range(0, len(rest), many):
            some = rest[at : at + many]
            for k, ids in zip(some, self._joined([chunks[k] for k in some])):
                out[k] = ids
        return out

    def _joined(self, some: list[str]) -> list[bytes]:
        words = self.spaced or all(map(str.isalpha, some))
        joined = " " + " ".join(some) if words else self.mark.join(some)
        if joined.count(self.mark) == (0 if words else len(some) - 1):
            ids = self.whole(joined)
            if self.spaced:
                ends = np.cumsum([len(c.encode()) + 1 for c in some])
                ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends, "left") + 1
                starts = np.append(0, ends[:-1])
            elif words:
                ends = np.flatnonzero(self.ends[ids]) + 1
                starts = np.append(0, ends[:-1])
            else:
                ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
                starts = np.append(0, ends[:-1] + 1)
            if len(ends) == len(some):
                raw, size = ids.tobytes(), ids.itemsize
                return [raw[a:b] for a, b in zip((starts * size).tolist(), (ends * size).tolist())]
        return [self.whole(" " + c if self.spaced else c).tobytes() for c in some]

    def _lookup(self, words: list[str]) -> list[bytes]:
        """Ids of distinct chunks.  In a byte-level vocabulary a leading NUL marks the head of a text: no space precedes it.

        A comma or full stop after a small letter is a pre-token of its own, so the chunk before it is looked up.
        """
        tails = [w[-1:] if w[-1:] in (",", ".") and w[-2:-1].islower() and w[-2].isalpha() else "" for w in words]
        stems = [w[:-1] if t else w for w, t in zip(words, tails)]
        seen = self.seen
        need = {w for w in stems if w not in seen}
        if need:
            if len(seen) + len(need) > self.keep:
                met = set(stems)
                self.seen = seen = {w: x for w, x in seen.items() if w in met}
            heads = [w for w in need if self.spaced and w[:1] == "\0"]
            need.difference_update(heads)
            rest = list(need)
            seen.update(zip(rest, self._chunks(rest)))
            seen.update((w, self.whole(w[1:]).tobytes()) for w in heads)
        return [seen[w] + self._point(t) if t else seen[w] for w, t in zip(stems, tails)]

    def _point(self, mark: str) -> bytes:
        if mark not in self.points:
            self.points[mark] = self.whole(mark).tobytes()
        return self.points[mark]

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        odd = {}
        if self.spaced:
            for k in np.flatnonzero(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)).tolist():
                odd[k] = self.whole(texts[k].as_py())
            if odd:
                mask = np.zeros(len(texts), bool)
                mask[list(odd)] = True
                texts = pc.if_else(pa.array(mask), pa.scalar("", texts.type), texts)
            texts = pc.binary_join_element_wise(pa.scalar("\0", texts.type), texts, pa.scalar("", texts.type))
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        ids = self._lookup(coded.dictionary.to_pylist())
        size = np.dtype(self.kind).itemsize
        flat = np.frombuffer(b"".join(ids), self.kind)
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) // size
        first = np.cumsum(lens) - lens
        bounds = np.append(0, np.cumsum(parts.value_lengths().to_numpy()))
        total = np.append(0, np.cumsum(lens[index]))
        counts = total[bounds[1:]] - total[bounds[:-1]]
        out = np.empty(int(total[-1]), self.kind)
        for a in range(0, len(index), 1 << 18):
            at = index[a : a + (1 << 18)]
            n = lens[at]
            lo, hi = total[a], total[a + len(at)]
            out[lo:hi] = flat[np.repeat(first[at] - total[a : a + len(at)], n) + np.arange(lo, hi)]
        if odd:
            pieces = [odd.get(k, x) for k, x in enumerate(np.split(out, np.cumsum(counts)[:-1]))]
            out, counts = np.concatenate(pieces), np.array([len(x) for x in pieces], np.int64)
        return out, counts

    def encode(self, texts: pa.Array, most_bytes: int = 16 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Slices of ``texts`` (null is empty): index of the first text, all ids, number of ids of each text."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield (at, *self._slice(texts.slice(at, to - at)))
            at = to
        pa.default_memory_pool().release_unused()


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> ChunkEncoder:
    """One encoder a worker process; the file is read there, by its path."""
    return ChunkEncoder(path, spaced)
