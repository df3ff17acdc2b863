"""Byte-level BPE, vector codes and source divergence against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from corrmail.llm import bpe, divergence, vectors
from corrmail.llm.common import hot_join
from corrmail.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_tokens string, ids int, term string, p int, value string"
RANKS = "byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(tokenizer_path(RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def transducer():
    return bpe.Transducer(bpe.Vocabulary(bpe.read_ranks(tokenizer_path(RANKS))))


def merged(ranks, piece):
    """Lowest rank first, leftmost first, one pair at a time."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return parts
        k = min(pairs)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def made_up(rng, alphabet=b"abcd", merges=60):
    """A vocabulary as training would leave it: a token is two that can stand side by side."""
    ranks = {bytes([b]): k for k, b in enumerate(alphabet)}
    while len(ranks) < len(alphabet) + merges:
        a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
        if a + b not in ranks and len(a + b) < 12 and merged(ranks, a + b) == [a, b]:
            ranks[a + b] = len(ranks)
    return ranks


def test_transducer_equals_merges_on_small_vocabularies():
    for seed in range(40):
        rng = random.Random(seed)
        ranks = made_up(rng)
        if seed % 4 == 0:  # a token that no merges lead to is met only as a whole piece
            lone = next(p for p in map(bytes, product(b"abcd", repeat=4)) if p not in ranks and len(merged(ranks, p)) > 2)
            ranks[lone] = len(ranks)
        vocabulary = bpe.Vocabulary(ranks)
        assert list(vocabulary.alone) == ([lone] if seed % 4 == 0 else [])
        model = bpe.Transducer(vocabulary, keep=50 if seed % 2 else 100_000)
        plain = {t: r for t, r in ranks.items() if t not in vocabulary.alone}
        for _ in range(150):
            piece = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 25)))
            assert model.encode(piece) == [ranks[t] for t in ([piece] if piece in vocabulary.alone else merged(plain, piece))]
        for piece in vocabulary.alone:
            assert model.encode(piece) == [ranks[piece]]


def test_transducer_equals_library(transducer, library):
    rng = random.Random(3)
    tokens = transducer.vocabulary.tokens
    for _ in range(4000):
        kind = rng.random()
        if kind < 0.4:
            piece = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 5)))
        elif kind < 0.8:
            piece = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 20)))
        else:
            piece = bytes([rng.choice(b"a =-\xe3\x80\n")]) * rng.randrange(1, 300)
        assert transducer.encode(piece) == library._core_bpe.encode_single_piece(piece)


def test_tokens_leave_after_bounded_lookahead(transducer):
    longest = max(map(len, transducer.vocabulary.tokens))
    piece = b"".join(bytes([97 + k * k % 26]) for k in range(1000))
    read = written = 0
    for step in transducer.stream(piece):
        written += sum(len(transducer.vocabulary.tokens[t]) for t in step)
        read += 1
        if read <= len(piece):
            assert read - written <= 2 * longest
    assert written == len(piece)


def test_texts_equal_library(library):
    import public_tokenizers

    texts = ["a   b", "x \n y", " lead", "trail ", "don't  <|endoftext|> x", "e ́a", "A\tB  C", " ", "", "\n", "a\0b c", "İ, ΑΣ Σ.", "a\x85 b\x1c c", "1,2. 3,", None]
    texts += ["日本語 テキスト é ü " * 10, "x" * 30_000, " ".join(f"{k * 2654435761 % 2**32:x}" for k in range(3000)), "👍🏽" * 50]
    enc = bpe.PieceEncoder(tokenizer_path(RANKS), public_tokenizers.PATTERN, keep=50)
    for _ in range(2):
        got = []
        for _, ids, counts in enc.encode(pa.array(texts), most_bytes=200):
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [library.encode_ordinary(t or "") for t in texts]


def test_streaming_decoder(library):
    table = bpe.DecodeTable(bpe.by_rank(bpe.read_ranks(tokenizer_path(RANKS))))
    text = "日本語é👍🏽 テキスト" * 3
    ids = np.array(library.encode_ordinary(text))
    decoder = bpe.Decoder(table)
    parts = [decoder.feed(ids[k : k + 1]) for k in range(len(ids))]
    assert "".join(x.decode() for x in parts) == text and decoder.finish() == b"" and decoder.valid
    rng = random.Random(4)
    for _ in range(1500):
        ids = np.array([rng.randrange(len(table.tokens)) for _ in range(rng.randrange(0, 12))], np.int64)
        cut, decoder = rng.randrange(0, len(ids) + 1), bpe.Decoder(table)
        out = decoder.feed(ids[:cut]) + decoder.feed(ids[cut:]) + decoder.finish()
        whole = b"".join(table.tokens[k] for k in ids)
        assert out == whole
        try:
            whole.decode()
            assert decoder.valid
        except UnicodeDecodeError:
            assert not decoder.valid


def test_round_trip_rows(spark, library):
    import public_tokenizers

    texts = ["one two two", "", None, "one two two", "日本語 " * 400, "w " * 60_000]
    rows = [(k if k != 3 else None, t, "x", "y", "clash", 1, "t", 2, "v") for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0]], DOCS)
    got = bpe.round_trip(docs, tokenizer_path(RANKS), public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def digest(doc_id, text):
        ids = library.encode_ordinary(text or "")
        return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert Counter(map(tuple, got.collect())) == Counter(digest(r[0], r[1]) for r in [*rows, rows[0]])
    two = bpe.decoded(bpe.encoded(docs, tokenizer_path(RANKS), public_tokenizers.PATTERN), tokenizer_path(RANKS)).collect()
    assert Counter((r.doc_id, bytes(r.decoded), r.valid) for r in two) == Counter((r[0], (r[1] or "").encode(), True) for r in [*rows, rows[0]])
    assert bpe.round_trip(docs.filter("false"), tokenizer_path(RANKS), public_tokenizers.PATTERN).count() == 0


def test_ball_tree_equals_scan():
    rng = np.random.default_rng(2)
    for n, width, span in product((1, 2, 5, 64), (1, 4, 7), (1, 3, 60, 1 << 25)):
        entries = rng.integers(-span, span + 1, (n, width))
        entries[n // 2 :: 3] = entries[0]  # ties
        points = np.concatenate([rng.integers(-2 * span, 2 * span + 1, (300, width)), entries])
        distance = ((points[:, None] - entries) ** 2).sum(-1)
        code, best = vectors.BallTree(entries).nearest(points)
        assert (code == distance.argmin(1)).all() and (best == distance.min(1)).all()


def test_ball_tree_leaves_balls_out():
    rng = np.random.default_rng(3)
    entries = np.concatenate([rng.integers(-5, 6, (8, 4)) + 1000 * c for c in range(8)])
    tree, compared = vectors.BallTree(entries), []
    leaf = tree._leaf
    tree._leaf = lambda rows, who, *rest: (compared.append(len(rows) * len(who)), leaf(rows, who, *rest))
    tree.nearest(np.repeat(entries, 10, 0))
    assert sum(compared) < 640 * 64 / 4


def codes_by_scan(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    values = [[math.floor(256 * x) for x in r[1]] for r in kept]
    width = len(values[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in values]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            met = {}
            for c in cut:
                met.setdefault(nearest(p, c[p])[1], []).append(c[p])
            new.append([tuple(sum(col) // len(met[k]) for col in zip(*met[k])) if k in met else e for k, e in enumerate(book[p])])
        book = new
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    error, total = [sum(d for d, _ in f) for f in found], Counter()
    for r, e in zip(kept, error):
        total[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for part in book for e in part for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for _, k in f), e, total[r[2]], digest) for r, f, e in zip(kept, found, error)]


VECTORS = "vec_id long, embedding array<float>, label int, error string, code int, size int"


@pytest.mark.parametrize("n", [3, 400])
def test_vector_codes_equal_scan(spark, n):
    rng = random.Random(n)
    rows = []
    for k in range(n):
        centre = rng.randrange(5) / 4 - 0.5
        rows.append((k * 7 % 1000, [np.float32(centre + rng.uniform(-0.2, 0.2)).item() for _ in range(32)], None if k % 9 == 0 else (1 if k % 3 else k % 5), "e", 1, 2))
    rows += [rows[0], rows[-1], (None, rows[1][1], 2, "e", 1, 2)]
    bad = [(1, None, 1), (2, [None] + [0.0] * 31, 1), (3, [float("nan")] * 32, 1), (4, [0.5] * 31 + [float("-inf")], None)]
    rows += [(*r, "e", 1, 2) for r in bad]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = vectors.coded_with_errors(table)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(codes_by_scan(rows))


def test_vector_codes_edges(spark):
    table = spark.createDataFrame([(1, None, 1, "e", 1, 2)], VECTORS)
    assert vectors.coded_with_errors(table).count() == 0
    empty = spark.createDataFrame([(1, [], 1, "e", 1, 2)], VECTORS)
    assert [r[1:4] for r in vectors.coded_with_errors(empty).collect()] == [("00" * 16, 0, 0)]
    with pytest.raises(ValueError, match="equal parts"):
        vectors.coded_with_errors(spark.createDataFrame([(1, [0.5] * 17, 1, "e", 1, 2)], VECTORS))
    codes, book = vectors.product_codes(spark.createDataFrame([(k, [k / 8] * 16, 1, "e", 1, 2) for k in range(5)], VECTORS))
    assert {r.vec_id: r.vector[0] for r in vectors.decoded(codes, book).collect()} == {k: k / 8 for k in range(5)}


def test_hot_join_equals_join(spark):
    rows = [(k, "hot" if k % 3 else None if k % 2 else f"k{k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string")
    small = df.groupBy("k").count()
    want = Counter(x for _, x in rows)
    got = hot_join(df, small.withColumn("n", small["count"]), ["k"], "count").collect()
    assert Counter((r.id, r.k, r.n) for r in got) == Counter((i, x, want[x]) for i, x in rows)


def divergence_by_scan(rows):
    """Straight from the definition, with whole numbers of any size."""
    letters = lambda c: c.isascii() and c.isalpha() or ord(c) > 127
    counts, docs, groups = {}, Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = "".join((chr(ord(c) + 32) if "A" <= c <= "Z" else c) if letters(c) else " " for c in text or "").split(" ")
        found = Counter(w for w in words if w)
        counts.setdefault((lang, source), Counter()).update(found)
        docs.update((lang, w) for w in found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= 3]
        sources = [s for x, s in groups if x == lang]
        own = {s: {w: counts[lang, s][w] for w in kept} for s in sources}
        whole = {w: sum(own[s][w] for s in sources) for w in kept}

        def shares(c):
            return {w: 1 + 1_000_000_000 * (n + 1) // (sum(c.values()) + len(kept)) for w, n in c.items()}

        p, q = {s: shares(own[s]) for s in sources}, shares(whole)
        gap = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(o, sum(gap(p[s][w], p[o][w]) for w in kept)) for o in sources if o != s]
            terms = [(w, gap(p[s][w], q[w])) for w in kept if own[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return out


@pytest.mark.parametrize(("heavy", "block", "bucket", "held"), [(4, 128, 50_000, 300_000), (10**9, 3, 40, 50), (1, 3, 40, 50), (3, 2, 1000, 7)])
def test_divergence_equals_scan(spark, monkeypatch, heavy, block, bucket, held):
    for name, value in (("BLOCK", block), ("BUCKET", bucket), ("TILE", 16)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(8)
    rows = []
    for k in range(260):
        words = [f"W{rng.choice('abcdefgh')}{rng.choice('éxyz')}{'日' * rng.randrange(2)}" if rng.random() < 0.7 else rng.choice(["the", "THE", "o'clock", "x1y"]) for _ in range(rng.randrange(0, 40))]
        rows.append((k, rng.choice([" ", "-", "\n"]).join(words), rng.choice(["en", "en", "de", None]), rng.choice([None, "", "a", "b", "c", "É", "z", "z", "z", "z"]), "n", 1, "t", 2, "v"))
    rows += [rows[0], (900, None, "fr", "none", "n", 1, "t", 2, "v"), (901, "", "fr", "other", "n", 1, "t", 2, "v"), (902, "lone words", "xx", "one", "n", 1, "t", 2, "v")]
    rows += [(None, " ".join(f"kind{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(600)), "long", s, "n", 1, "t", 2, "v") for s in ("a", "a", "a", "b")]
    monkeypatch.setattr(divergence, "HELD", held)
    got = divergence.divergence(spark.createDataFrame(rows, DOCS).repartition(5), heavy)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(divergence_by_scan(rows))


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_are_exact_for_large_counts():
    n, total, kinds = np.array([0, 10**6, 10**15 - 7]), np.array([10**15] * 3), np.array([7, 123, 10**9])
    assert divergence.shares(n, total, kinds).tolist() == [1 + 10**9 * (a + 1) // (b + c) for a, b, c in zip(n.tolist(), total.tolist(), kinds.tolist())]
