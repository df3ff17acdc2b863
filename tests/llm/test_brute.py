"""The whole pipeline, stage by stage on its own input, and the features of op10, against brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from test_operators import WORDS, brute_classes, brute_targets, prose

from corrmail.llm import quality, toxicity
from corrmail.llm.queries import tokenizer_path

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    """Good documents, copies, near copies, documents that the base rules reject, short and empty ones, a long one."""
    rng = random.Random(11)
    out = []
    for k in range(90):
        out.append(prose(1000 + k, rng.randrange(40, 200), 5000))
    for k in range(0, 30, 3):
        out += [out[k], out[k].upper()]
        words = out[k + 1].split()
        out.append(" ".join([*words[: len(words) // 2], "changed", *words[len(words) // 2 :]]))
    out += ["same same " * 60, "too short", "", "   ", None, "### *** $$$ " * 40, prose(7, 9000, 20_000), out[0] + "\n"]
    return out


def base_failed(text):
    words = WORDS.findall(text or "")
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(8)}
    return len(words) < 20 or 100 * len(covered) > 30 * len(words)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_equals_brute_force(spark, tmp_path, empty):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = [] if empty else [(k, t, "en", None if k % 11 == 0 else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts())]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, str(tmp_path))
        found.write.parquet(str(tmp_path / f"stage{k}"))  # as the pipeline is run
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append([tuple(r) for r in docs.collect()])
    good, exact, near, mixed, packed = seen
    if empty:
        assert seen == [[]] * 5
        return

    # quality rules: what the base rejects goes; the verdict on the others is that of op6, which leaves good ones alone
    verdict = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert sorted(good) == sorted(r for r in rows if verdict[r[0]])
    assert not [r for r in good if base_failed(r[1])]
    assert {r[0] for r in rows if r[0] < 90} <= {r[0] for r in good}

    # exact copies: the largest doc_id of equal texts
    last = {lowered(r[1]): r for r in sorted(good)}
    assert sorted(exact) == sorted(last.values())

    # similar texts: the smallest doc_id of each class
    classes = brute_classes(exact)
    assert sorted(near) == sorted(r for r in exact if classes[r[0]][0] == r[0])
    assert len(near) < len(exact) < len(good)

    # the mix: targets by source, whole words in their order, at most three passes
    size = lambda t: len(WORDS.findall(t or ""))
    sizes, taken, of = Counter(), Counter(), {r[0]: r for r in near}
    for r in near:
        sizes[r[3]] += size(r[1])
    each = Counter()
    for doc_id, text, lang, source, n_chars in mixed:
        before = of[doc_id]
        assert (lang, source, n_chars) == (before[2], before[3], len(text))
        left = iter(WORDS.findall(before[1]))
        assert all(w in left for w in WORDS.findall(text))  # in the order of the document
        taken[source] += size(text)
        each[doc_id] += size(text)
    assert all(n <= 3 * size(of[d][1]) for d, n in each.items())
    assert {s: taken[s] for s in sizes} == {s: round(t) for s, t in brute_targets(sizes).items()}

    # packing: pieces of all ids, sequences without gaps
    ids_of = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode
    want = Counter()
    for r in mixed:
        ids = [*ids_of(r[1], add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            want[r[0], piece, at, zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())] += 1
    names = docs.columns
    rows = [dict(zip(names, r)) for r in packed]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_window_features_equal_brute_force(spark):
    rng = random.Random(5)
    ordinary, toxic = prose(1, 800).encode(), (prose(1, 800) + " you utter moron scum idiot " * 20).encode()
    some = [prose(k, rng.randrange(0, 120)) + (" you utter moron " if k % 3 == 0 else "") for k in range(30)] + ["", None, "日本語 テキスト " * 40, "x" * 1000, "a  b\tc\n" * 9]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in toxicity.window_features(docs, ordinary, toxic, 16, 3).collect()}

    def packed(raw, data):
        book = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=3, dict_data=book, write_content_size=False).compress(data))

    for k, text in enumerate(some):
        words = [x[i : i + 64] for x in (text or "").encode().split() for i in range(0, len(x), 64)]
        windows = [b" ".join(words[i : i + 16]) for i in range(0, len(words), 16)]
        d = [packed(ordinary, w) - packed(toxic, w) for w in windows]
        if not d:
            assert got[k] == (0.0,) * 6
            continue
        top = sorted(d)[-3:]
        far = sum(x >= 3 for x in d)
        assert got[k] == pytest.approx((top[-1], sum(top) / len(top), sum(d) / len(d), far / len(d), far / len(d) ** 0.5, np.log1p(len(d))))
