from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corrmail.llm import exact, jaccard, linededup, mixing, packing, pages, quality, rans, suffix, tokens, toxicity
from corrmail.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch string, size string, _row int, n_words int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n, kinds=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(kinds)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


def corpus():
    base = prose(1, 120)
    words = base.split()
    near = words[:60] + ["changed"] + words[61:]
    passage = prose(9, 60)
    texts = [base, base, " ".join(near), base.upper(), None, "", "   ", "one two", "one two", prose(2, 30) + " " + passage + " " + prose(3, 30), passage, prose(4, 5000, 50_000)]
    texts += ["a\nb\nc\nd", "x\na\nb\nc", "a\nb\nc", "\n\n\n\n", "### *** $$$ " * 40, "SHOUT!! " * 80, "same same " * 60, "日本語 テキスト é ü " * 10]
    rows = [(k, t, "en", None if k % 7 == 0 else f"s{k % 3}", 0, "b", "s", 5, 6) for k, t in enumerate(texts)]
    return rows + [rows[0], (None, "no id here at all", "en", "s1", 0, "b", "s", 5, 6)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_chunk_encoder_equals_library():
    from tokenizers import Tokenizer

    texts = ["a   b", "x \n y", " lead", "trail ", "a  b", "don't  <|endoftext|> x", "e ́a", "A\tB  C", " ", "", "\n", "a\0b c", "İ, ΑΣ Σ.", "abcİ, x", "a\u0085 b", prose(5, 500), None, "1,2. 3,"]
    for name, spaced in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        path = tokenizer_path(name)
        enc, plain = tokens.ChunkEncoder(path, spaced, keep=50), Tokenizer.from_file(path)
        for _ in range(2):
            got = []
            for _, ids, counts in enc.encode(pa.array(texts), most_bytes=200):
                got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
            assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    rows = packing.packed_documents(docs, path, capacity=64).collect()
    t = Tokenizer.from_file(path)
    expected = []
    for doc_id, text, *_ in corpus():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], "<u4")
            expected.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, expected)) == sorted(key(tuple(r)[:5]) for r in rows)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.05 * sum(r.length for r in rows) / 64 + 2
    kept = packing.pack(packing.token_pieces(docs, path, 64, keep_ids=True), capacity=64)
    assert packing.sequences(kept).filter("length(ids) != 4 * n_tokens").count() == 0
    assert packing.packed_documents(empty, path).count() == 0


def test_best_fit_plan_places_every_item_once():
    rng = random.Random(0)
    counts = {s: rng.randrange(1, 30) for s in rng.sample(range(1, 101), 60)}
    fill, seen = {}, {s: 0 for s in counts}
    for size, rank, items, first, each, offset in packing.best_fit_plan(counts, 100):
        assert rank == seen[size]
        seen[size] += items
        for k in range(items):
            at = offset + k % each * size
            fill.setdefault(first + k // each, []).append((at, at + size))
    assert seen == counts
    for spans in fill.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 100 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    gaps: list[int] = []
    bins = 0
    for size in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        at = bisect_left(gaps, size)
        bins += at == len(gaps)
        left = (100 if at == len(gaps) else gaps.pop(at)) - size
        if left:
            insort(gaps, left)
    assert len(fill) <= bins  # best fit, item by item


def brute_repeats(rows, length=100):
    seen, out = set(), []
    for doc_id, raw in sorted(((r[0], (r[1] or "").encode()) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        covered = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if w in seen:
                covered[k : k + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for k in range(len(raw)) if covered[k] and not (k and covered[k - 1]))
        out.append((doc_id, len(raw), sum(covered), runs, hashlib.sha256(bytes(b for b, c in zip(raw, covered) if not c)).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(spark, docs, empty):
    rows = [*corpus(), (100, "ab" * 300, *[None] * 7), (101, "x" + "ab" * 200, *[None] * 7), (102, prose(1, 120)[37:400] + prose(7, 50), *[None] * 7)]
    got = suffix.drop_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows)
    assert suffix.drop_repeats(empty).count() == 0


def test_suffix_dedup_of_a_slice_without_repeats(spark):
    long = np.random.default_rng(3).integers(97, 123, 1 << 20, dtype=np.uint8).tobytes().decode()
    rows = [(0, "ab" + prose(5, 60)), (1, long), (2, prose(5, 60) + "cd")]
    got = {r.doc_id: r for r in suffix.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    same = len(prose(5, 60))
    assert [(got[k].n_bytes, got[k].n_removed, got[k].n_spans) for k in range(3)] == [(same + 2, 0, 0), (len(long), 0, 0), (same + 2, same, 1)]


def test_suffix_dedup_of_hot_anchors(spark):
    passage = prose(21, 60)
    rows = [(k, f"{prose(300 + k, 12)} {passage} {prose(900 + k % 40, 12)}", *[None] * 7) for k in range(120)]
    rows += [(500 + k, f"{passage[:150]} {prose(k, 30)}", *[None] * 7) for k in range(30)] + [(600, "ab" * 300, *[None] * 7)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for hot in (1, 20, 100):
        got = suffix.drop_repeats(df, batch_bytes=8 << 10, shard_bytes=16 << 10, hot=hot).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows)


def test_window_repeats_of_one_anchor_are_bounded():
    n = 4000
    rows = np.random.default_rng(0).integers(0, 256, (n, suffix.WIDTH), dtype=np.uint8)
    rows[:, :8], rows[:, -1], rows[:10, 8:-2] = 7, 1, rows[0, 8:-2]
    rows[:, -2] = np.arange(n) % 50 + 1
    places = np.zeros(n, suffix._PLACE)
    places["doc"], places["most"] = np.arange(n), suffix.BEFORE
    tracemalloc.start()
    try:
        rec, start = suffix.window_repeats(suffix._keys(rows), places, most=1 << 13)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(set(rec.tolist())) == list(range(1, 10)) and len(rec) == 9 * (suffix.BEFORE + 1)
    assert peak < 40 << 20  # all windows at once: over 250 MB


def test_suffix_family_over_many_batches():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(130)) for _ in range(12)] + ["a" * 300]
    rows = [(k, rng.choice(texts) + rng.choice(texts)[:80]) for k in range(60)]
    family, raws = suffix.SuffixFamily(), {k: t.encode() for k, t in rows}
    order = list(raws)
    rng.shuffle(order)
    found = {k: np.zeros(len(t), bool) for k, t in raws.items()}
    for batch, k in enumerate(order):
        data = np.frombuffer(raws[k], np.uint8)
        for got in suffix.anchors(data, np.array([0]), np.array([len(data)]), most=64):
            _, doc, p, lo, hi = got
            place = np.zeros(len(doc), suffix._PLACE)
            place["doc"], place["low"], place["most"], place["least"] = k, lo, p - lo, p - hi
            family.add(suffix._records(data, got), place, batch)
    keys, places, _ = family.close()
    for some, _ in family.repeats:
        for x in some:
            found[int(x["doc"])][x["low"] : int(x["low"]) + int(x["most"]) - int(x["least"]) + 100] = True
    for rec, start in zip(*suffix.window_repeats(keys, places, most=50)):
        found[int(places["doc"][rec])][start : start + 100] = True
    assert {k: int(v.sum()) for k, v in found.items()} == {r[0]: r[2] for r in brute_repeats(rows)}


def brute_classes(rows):
    def shingles(t):
        w = WORDS.findall(t or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    links, parent = {i: 0 for i, _ in sets}, {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += i != j
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: (root(i), links[i]) for i, _ in sets}


def test_jaccard(spark, docs, empty):
    rng = random.Random(5)
    base, rows = prose(11, 200).split(), corpus()
    for k in range(60):  # a group of near copies that are not all alike
        w = list(base)
        for at in rng.sample(range(200), rng.randrange(0, 6)):
            w[at] = f"z{rng.randrange(9999)}"
        rows.append((1000 + k, " ".join(w), *[None] * 7))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for options in ({}, {"small": 16}):  # small blocks: deeper paths and pairs of blocks
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar_classes(df, **options).collect()}
        expected = brute_classes(rows)
        assert got.pop(None) == (None, 0)
        assert {k: v for k, v in got.items()} == {k: v if k else (v[0], got[0][1]) for k, v in expected.items()}
    kept = {r.doc_id for r in jaccard.drop_similar(docs).select("doc_id").collect()}
    assert 1 not in kept and 2 not in kept and {0, 4, 5, 11, None} <= kept
    assert jaccard.drop_similar(docs).columns == docs.columns
    assert jaccard.similar_classes(empty).count() == 0


def test_drop_similar_goes_by_rows(spark):
    a, b = prose(41, 200), prose(42, 200)
    rows = [(1, a), (5, a + " x"), (5, "quite another text " + b), (5, a), (None, a), (None, b[:400]), (None, b[:400]), (7, None), (7, ""), (8, "w")]
    df = spark.createDataFrame([(*r, *[None] * 7) for r in rows], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in jaccard.drop_similar(df).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[5], *rows[7:]], key=str)


def test_jaccard_recall(spark):
    rng, rows = random.Random(17), []
    for k in range(150):
        base = prose(5000 + k, 150, 5000).split()
        for n in range(3):
            w = list(base)
            for at in rng.sample(range(150), n * rng.randrange(1, 5)):
                w[at] = f"q{rng.randrange(10**6)}"
            rows.append((3 * k + n, " ".join(w)))
    expected = brute_classes(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar_classes(df, small=8).collect()}
    links = sum(v[1] for v in expected.values())
    assert links > 300 and sum(min(got[k][1], v[1]) for k, v in expected.items()) >= 0.97 * links and all(got[k][1] <= v[1] for k, v in expected.items())


def test_jaccard_of_a_doc_id_with_several_texts(spark):
    a, b = prose(31, 200), prose(32, 200)
    rows = [(50, a), (50, b), (51, a + " x"), (52, b + " y"), (53, "z " + b), (54, prose(33, 90))]
    df = spark.createDataFrame([(*r, *[None] * 7) for r in rows], SCHEMA).repartition(3)
    got = {tuple(r) for r in jaccard.similar_classes(df).collect()}
    assert got == {(50, 50, 2), (51, 50, 1), (52, 50, 2), (53, 50, 2), (54, 54, 0)}


def test_rans(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t, at, expected = Tokenizer.from_file(path), 0, []
    for doc_id, text, *_ in sorted(corpus(), key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = rans.round_trip(docs, path, 50257).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(expected, key=str)
    assert rans.round_trip(empty, path, 50257).count() == 0


def test_rans_frames():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.zipf(1.3, 400_000), 50_000).astype("<u2")
    table = rans.frequency_table(dict(enumerate(np.bincount(ids).tolist())) | {0: 0}, 50257)
    table = rans.frequency_table({k: v for k, v in enumerate(np.bincount(ids).tolist()) if v}, 50257)
    freq, start = table.freq.astype(np.uint64), table.start.astype(np.uint64)
    assert table.freq.sum() == 1 << rans.BITS
    raw = rans.dump_frame([1, None], [len(ids) - 5, 5], ids, freq, start)
    assert len(raw) < ids.nbytes
    decode = (freq, start, table.symbol)
    docs, counts, back = rans.load_frame(raw, decode)
    assert docs == [1, None] and counts.tolist() == [len(ids) - 5, 5] and (back == ids).all()
    states, before, words = rans.encode_ids(ids, freq, start, rans.LANES)
    some = rans.LANES * rans.STEPS
    assert (rans.decode_part(1, len(ids), states, before, words, decode) == ids[some : 2 * some]).all()
    with pytest.raises(ValueError):
        rans.load_frame(raw[:-9] + b"x" + raw[-8:], decode)
    for n in (0, 1, 5, 3000):
        raw = rans.dump_frame([7] if n else [], [n] if n else [], ids[:n], freq, start)
        assert (rans.load_frame(raw, decode)[2] == ids[:n]).all() and len(raw) < 150 + 3 * n


def test_parts_of_frames_with_ids_beyond_16_bits(spark):
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 90_000, n).astype("<u4") for n in (0, 5, 400_000, 70_000, 3)]
    tokens = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(docs)], "doc_id long, ids binary")
    table = rans.frequency_table(rans.count_ids(tokens, 90_000), 90_000)
    frames = rans.write_frames(tokens, table, 2)
    back = {r.doc_id: np.frombuffer(r.ids, "<u4") for r in rans.read_frames(frames, table, keep_ids=True).collect()}
    assert all((back[k] == x).all() for k, x in enumerate(docs))
    parts = sorted(rans.read_parts(frames, table).collect())
    assert len(parts) > 4 and (np.frombuffer(b"".join(r.ids for r in parts), "<u4") == np.concatenate(docs)).all()


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    targets, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return targets | {s: left * weight[s] / total for s in open_}
        for s in over:
            targets[s] = 3.0 * sizes[s]
        left -= sum(3.0 * sizes[s] for s in over)
        open_ -= over
    return targets


def test_mixing(spark, docs, empty):
    rng = random.Random(2)
    rows = corpus() + [(200 + k, prose(k, rng.randrange(0, 400)), "en", rng.choice(["a", "b", "s1", "é", None]), 0, "b", "s", 1, 2) for k in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, block=16, slots=256).collect()
    size = lambda t: len(WORDS.findall(t or ""))
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows)
    sizes, by_doc = {}, {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
        by_doc[r[0]] = r[3]
    targets, taken = brute_targets(sizes), {}
    for r in got:
        s = by_doc[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s]) and r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in targets.items():
        assert taken.get(s, 0) == round(t)
    again = mixing.mix(df.repartition(7), block=16, slots=256).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in got)
    mixed = mixing.mixed_documents(df, block=16, slots=256)
    assert mixed.columns == df.columns
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + size(r.text)
        assert r.n_chars == len(r.text)
    expected = {}
    for r in got:
        expected[r.doc_id] = expected.get(r.doc_id, 0) + r.taken
    assert words == {k: v for k, v in expected.items() if v}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0 and mixing.mixed_blocks(empty).count() == 0
    blocks = mixing.mixed_blocks(df, block=16, slots=256).collect()
    assert sum(taken.values()) == sum(r.words for r in blocks) and all(size(r.text) == r.words for r in blocks)
    assert len({(r.shard, r.slot) for r in blocks}) == len(blocks) and max(r.slot for r in blocks) == 255


def test_mixing_of_small_sources_at_default_options(spark):
    rows = [(1, prose(1, 130), "a"), (2, prose(2, 10), "d")] + [(10 + k, prose(k, 2000), "bc"[k % 2]) for k in range(20)] + [(100 + k, prose(k, 60), f"e{k:02}") for k in range(40)]
    for some in (rows, rows[22:]):
        df = spark.createDataFrame([(i, t, "en", s, *[None] * 5) for i, t, s in some], SCHEMA)
        sizes = {}
        for _, t, s in some:
            sizes[s] = sizes.get(s, 0) + len(t.split())
        targets, taken = brute_targets(sizes), {}
        source = {i: s for i, _, s in some}
        for r in mixing.mix(df).collect():
            taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
            assert r.taken <= 3 * r["size"]
        assert all(abs(taken[s] - t) <= 0.500001 for s, t in targets.items())


def test_index_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()
        got = [r.p for r in got]
        assert sorted(got) == list(range(n))
        if n == 1000:
            assert sum(x == k for k, x in enumerate(got)) < 10 and abs(np.corrcoef(got, np.arange(n))[0, 1]) < 0.1


def test_shard_counts_are_near_their_expectation_but_not_equal(spark):
    sources = spark.createDataFrame([("a", 0, 40_000, 30_000.0, 1.0), ("b", 1, 20_000, 30_000.0, 1.0)], "source string, sid int, source_size long, target double, total double")
    rows = mixing.slot_plan(sources, 10, 100, 7).groupBy("shard").agg(F.sum((F.col("sid") == 0).cast("int")).alias("a"), F.count("*").alias("n")).collect()
    assert len(rows) == 60 and all(r.n == 100 for r in rows) and sum(r.a for r in rows) == 3000
    assert 3 < np.std([r.a for r in rows]) < 8  # 5 for independent draws


def test_clashing_columns_survive_every_stage(spark):
    import corpus_pipeline

    names = ["size", "_row", "words", "pass", "parts", "passes", "row", "sha", "many", "_gone", "keep_id", "class_id", "sid", "block", "taken"]
    texts = [prose(k, 60 + k) for k in range(12)]
    rows = [(k, texts[k % 10], "en", "s", 1, *[f"{c}{k}" for c in names]) for k in range(12)] + [(3, "other words " + texts[11], "en", "s", 1, *[f"{c}x" for c in names]), (None, texts[2], "en", None, 1, *[None] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    known = {tuple(r[5:]) for r in rows}
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "").collect()
        assert out and out[0].__fields__ == docs.columns and {tuple(r[5:]) for r in out} <= known


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for doc_id, text, *_ in corpus():
        t = text or ""
        w = WORDS.findall(t)
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        at, covered = {}, set()
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k : k + 8]), []).append(k)
        for places in at.values():
            if len(places) > 1:
                covered.update(k + j for k in places for j in range(8))
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert got[0].kept and got[11].kept and not got[16].kept and not got[17].kept
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 0").count() == 2
    assert quality.quality(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_weak_supervision_finds_bad_documents():
    share, rates = quality.estimate([((1, 1, 1), 900), ((0, 0, 1), 60), ((0, None, 0), 40), ((1, 0, 1), 3)])
    assert quality.posterior((1, 1, 1), share, rates) > 0.9 and quality.posterior((0, 0, 1), share, rates) < 0.5
    assert quality.estimate([])[1] == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>Menu</li></ul></nav><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p><b>First  part<br><p>Second <i>pa</i>rt</p><div class="comments">Nice!</div><form>Mail</form></article><aside>Side</aside><footer>End</footer></body></html>"""


def test_pages(spark):
    bare = lambda own: f"<html><body><div>Site name</div><p>{own}</p><div>All rights</div></body></html>"
    rows = [(1, "http://a.example/x", PAGE), (2, "http://b.example/1", bare("One")), (3, "http://b.example/2?q=1", bare("Two")), (4, "http://c.example/", bare("Alone")), (5, None, None), (6, "x", "")]
    got = {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & line\nFirst part\nSecond part" and got[1].n_chars == len(got[1].text)
    assert got[4].text == "Site name\nAlone\nAll rights" and got[5].text == "" and got[6].text == ""
    together = spark.createDataFrame(rows[1:3], "page_id long, url string, html string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert {r.page_id: r.text for r in pages.main_text(together).collect()} == {2: "One", 3: "Two"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert pages.shared_lines(list("abcab"), list("xabay")) == {0, 1, 3}


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 14))] for _ in range(2))
        for most in (1 << 29, 6):
            at = sorted(pages.shared_lines(a, b, most))
            rest = iter(b)
            assert len(at) == brute_lcs(a, b) and all(a[k] in rest for k in at)
    assert pages.shared_lines(["x", "a"], ["a", "x", "a"]) == {0, 1}


def test_class_names_do_not_empty_a_page(spark):
    html = "<body><div class='{}'><article><div class='entry-header'><h1>Head</h1></div><p>Text.</p></article></div><div class='main-nav'>Menu</div><p>Beside {}</p></body>"
    names = ["content no-sidebar", "layout-with-sidebar", "sidebar", "page"]
    rows = [(k, f"http://{host}.example/{k}", html.format(c, "xy"[k % 2]), "u", c) for k, c in enumerate(names) for host in "ab"] + [(9, "http://c.example/", html.format("x", "z"), None, None), (8, "http://d.example/", "<div class='ad'>All</div>", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, row string")
    got = {(r.page_id, r.url[7]): r.text for r in pages.main_text(df).collect()}
    assert got[0, "a"] == "Head\nText.\nBeside x" and got[1, "b"] == "Head\nText.\nBeside y"  # neighbours lack the last line
    assert got[2, "a"] == "Beside x" and got[9, "c"] == "Head\nText." and got[8, "d"] == "All"


def test_pages_of_any_size_and_repeated_rows(spark):
    many = "".join(f"<p>line {k % 50}</p>" for k in range(20_000))
    rows = [(1, "http://a.example/1", many), (1, "http://a.example/1", many), (2, "http://a.example/2", many.replace("line 7<", "other<")), (None, None, "<p>x"), (None, None, "<p>x"), (3, "http://a.example/3", "<" * 5000), (4, "", "&amp;&#20013;&nope;")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = [tuple(r) for r in pages.main_text(df).collect()]
    by = {i: t for i, _, t, _ in got}
    assert len(got) == 7 and sum(i == 1 for i, *_ in got) == 2 and len({t for i, _, t, _ in got if i == 1}) == 1
    assert set(by[1].split("\n")) == {"line 7"} and by[1].count("\n") == 399 and by[4] == "&中&nope;"


def test_pages_next_to_copies_and_cuts(spark):
    bare = lambda own: f"<html><body><div>Site name</div><p>{own}</p><div>All rights</div></body></html>"
    names = ["alpha", "beta", "beta", "beta", "gamma", "delta", "delta", "epsilon", "zeta", "eta", "eta", "theta"]
    rows = [(k, f"http://b.example/{k // 2:02}?q={k}", bare(f"{name} seen {k} times")) for k, name in enumerate(names)]
    rows += [(50 + k, f"http://c.example/{k}", bare("same")) for k in range(9)] + [(90, "http://d.example/", bare("same"))]
    expected = {k: f"{name} seen {k} times" for k, name in enumerate(names)} | {k: "Site name\nsame\nAll rights" for k in (*range(50, 59), 90)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    try:
        for n in ("1", "4", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r.page_id: r.text for r in pages.main_text(df).collect()} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def brute_lines(rows):
    """By row: (text, lines, removed) in the order (doc_id, hash of the text, place) that the caller has put them in."""
    seen, out = set(), []
    for k, (_, text) in enumerate(rows):
        lines, gone = (text or "").split("\n"), set()
        for i in range(len(lines) - 2):
            key = tuple(lines[i : i + 3])
            if key in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(key)
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return out


def test_line_dedup(spark, docs, empty):
    hashes = {r[0]: r[1] for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).distinct().select("t", F.xxhash64("t")).collect()}
    ordered = sorted(((r[0], r[1]) for r in corpus()), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""]))
    expected = sorted(((i, *x) for (i, _), x in zip(ordered, brute_lines(ordered))), key=str)
    got = sorted((tuple(r) for r in linededup.drop_repeated_lines(docs).collect()), key=str)
    assert got == expected and (14, "", 3, 3) in got
    assert linededup.drop_repeated_lines(empty).count() == 0


def test_line_dedup_of_a_doc_id_with_several_texts(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "a\nb\nc\nz"), (2, "keep1\nkeep2\nkeep3\nkeep4"), (2, "s"), (None, "q\nr\ns\nt"), (3, "q\nr\ns"), (4, "u\nu\nu\nu"), (4, "u\nu\nu\nu"), (5, "x\n" * 6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = {r[0]: r[1] for r in df.select("text", F.xxhash64("text")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    expected = sorted(((i, *x) for (i, _), x in zip(ordered, brute_lines(ordered))), key=str)
    assert sorted((tuple(r) for r in linededup.drop_repeated_lines(df).collect()), key=str) == expected
    assert {(2, rows[2][1], 4, 0), (2, "s", 1, 0), (2, "z", 4, 3), (4, "u", 4, 3), (4, "", 4, 4), (5, "x\n", 6001, 5999)} <= set(expected)


def test_exact_dedup(docs, empty):
    low = lambda t: (t or "").encode().lower()
    groups = {}
    for r in corpus():
        groups.setdefault(low(r[1]), []).append(r[0])
    expected = []
    for r in corpus():
        ids = groups[low(r[1])]
        keep = max((x for x in ids if x is not None), default=None)
        expected.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(low(r[1])).hexdigest()))
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in exact.exact_groups(docs).collect())
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (0, 1)").count() == 0 and kept.filter("doc_id = 3").count() == 1
    assert exact.exact_groups(empty).count() == 0


def test_drop_copies_decides_by_row(spark):
    full = [(1, "same"), (7, "Same"), (7, "Same"), (3, "alpha"), (3, "only here"), (9, "ALPHA"), (None, "none"), (None, "none"), (None, "alpha"), (4, None), (5, "")]
    df = spark.createDataFrame([(*r, *[None] * 7) for r in full], SCHEMA).repartition(4)
    got = sorted(((r.doc_id, r.text) for r in exact.drop_copies(df).collect()), key=str)
    assert got == sorted([(7, "Same"), (3, "only here"), (9, "ALPHA"), (None, "none"), (5, "")], key=str)


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(4)]
    parts[1][:50] = parts[0][:50]
    parts[2][:9] = parts[2][10]
    loaded = [exact.load_filter(exact.dump_filter(*exact.build_filter(p))) for p in parts]
    values, counts = exact.merge_filters(loaded)
    expected = np.unique(np.concatenate(parts), return_counts=True)
    assert (values == expected[0]).all() and (counts == expected[1]).all()


def test_toxicity(spark, empty):
    rng, rows, labels = random.Random(4), [], []
    for k in range(400):
        words, bad = prose(k, 150, 3000).split(), int(k % 5 == 0)
        for _ in range(4 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grumbleface", "stinkbucket", "wretchling"]))
        rows.append((k, " ".join(words), "en", "s", 0, "b", "s", 1, 2))
        labels.append((k, bad))
    docs = spark.createDataFrame([*rows, (900, None, *[None] * 7), (901, "", *[None] * 7)], SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known, contexts=4).collect()}
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out == (k in held) for k in range(400))
    right = sum(got[k].predicted == labels[k][1] for k in held)
    assert right >= 0.9 * len(held)
    assert toxicity.toxicity(empty, known).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, known.limit(0)).collect()} == {0.0}


def test_toxicity_of_odd_rows(spark):
    rng, rows = random.Random(9), []
    for k in range(300):
        words = prose(k, 60, 3000).split() + ["grumbleface stinkbucket"] * (2 * (k % 4 == 0))
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
    odd = [(None, rows[0][1]), (None, None), (0, rows[0][1]), (500, "x" * 200_000), (501, "grumbleface" * 3000), (502, "a " * 100_000), (503, "\u4e2d" * 9000)]
    docs = spark.createDataFrame([(*r, "t", 0.5) for r in rows + odd], "doc_id long, text string, toxic string, score double").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 4 == 0), "z", 2.0) for k in range(300)] + [(None, 1, "z", 1.0), (3, None, "z", 1.0)], "doc_id long, toxic int, text string, score double")
    got = [(r.doc_id, r.held_out, r.score, r.predicted) for r in toxicity.toxicity(docs, labels, contexts=3).collect()]
    assert len(got) == 307 and all(s is not None and 0 <= s <= 1 and p == int(s >= 0.3) for _, _, s, p in got)
    twice = [x for x in got if x[0] == 0]
    assert len(twice) == 2 and twice[0] == twice[1] and not any(h for i, h, *_ in got if i is None)
    held = [(s, k % 4 == 0) for k, h, s, _ in got if h and k is not None and k < 300]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum((a > b) + 0.5 * (a == b) for a in bad for b in good) >= 0.9 * len(bad) * len(good)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(corpus(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, str(tmp_path)).transform(lambda x: spark.createDataFrame(x.collect(), x.schema))
        if k < 4:
            assert docs.columns == before.columns
        if k == 2:
            ids = [r.doc_id for r in docs.collect()]
            assert len(set(ids)) == len(ids) and 11 in ids and {0, 1, 2, 3} & set(ids) == {1}
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)
    assert docs.select(F.sum("length")).first()[0] > 0
