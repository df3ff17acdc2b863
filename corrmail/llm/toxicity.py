"""Toxicity by compression distance (operator 10).

Two zstandard dictionaries are trained on labelled text.  The ordinary one is trained on windows of ordinary text.
Toxic documents are ordinary text for the most part, so the toxic one is trained on their telling words: those that
are, or begin with, a piece that toxic text has in many different contexts and ordinary text in few.  A window of
words that the toxic dictionary (behind the ordinary one) compresses better resembles toxic text; a document's score
comes from the differences of its windows, calibrated by a logistic model.

Labels of rows whose crc32 (of the doc_id as text) leaves 2 when divided by 4 are never read.  Of the rest, remainder
3 calibrates and the others train the dictionaries.  Both use at most ``most_labelled`` rows of a kind, the first by
a hash, and a dictionary is trained on about a hundred times its size.  Scores cover all windows of all texts; words
of more than 64 bytes are cut, so a text without spaces has windows like any other.  Null and empty texts have no
windows and get the score of no evidence.  Without labels of both kinds every score is 0.  Repeated rows are scored
alike, rows without doc_id too (they are never held out).  Columns besides doc_id, text and toxic are ignored.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Fixed value: scores from here on predict toxic.
THRESHOLD = 0.3
FEATURES = ("best", "best3", "mean", "share", "some", "size")


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def sample_labels(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows (doc_id, toxic), the first by a hash; a doc_id with both labels counts as toxic."""
    rows = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _worded(labelled: DataFrame) -> DataFrame:
    """(toxic, doc_id, pos, w, before, pieces): the words of labelled text, and what each is or begins with."""
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))
    rows = labelled.select("toxic", "doc_id", words.alias("words"))
    rows = rows.select("toxic", "doc_id", F.posexplode(F.expr("transform(words, (w, i) -> struct(w, get(words, i - 1) as before))")).alias("pos", "x"))
    pieces = F.array_distinct(F.array(F.col("x.w"), *[F.substring("x.w", 1, n) for n in (4, 5, 6)]))
    return rows.select("toxic", "doc_id", "pos", "x.w", "x.before", F.filter(pieces, lambda p: F.length(p) >= 4).alias("pieces"))


def telling_pieces(worded: DataFrame, lift: float, contexts: int) -> DataFrame:
    """(piece) of words and word beginnings that toxic text has after many different words and ordinary text after few.

    Different preceding words are counted by 64 bits of their hashes, so copies of a text do not add up and the
    partial aggregates stay small.
    """
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(before), 64) as int))")
    rows = worded.select("toxic", bit.alias("bit"), F.explode("pieces").alias("piece"))
    seen = rows.groupBy("piece").agg(*[F.bit_count(F.bit_or(F.when(F.col("toxic") == k, F.col("bit")))).alias(f"n{k}") for k in (0, 1)])
    count = lambda c: -64 * F.log(1 - F.least(F.coalesce(F.col(c), F.lit(0)), F.lit(63)) / 64)
    seen = seen.withColumn("toxic", count("n1")).withColumn("ordinary", count("n0"))
    return seen.filter((F.col("toxic") >= contexts) & (F.col("toxic") >= lift * (F.col("ordinary") + 0.5))).select("piece")


def _sample(texts: DataFrame, most: int) -> list[bytes]:
    """At most ``most`` of the texts (w), each of at most 1000 characters, the first by a hash: what a dictionary is trained on."""
    rows = texts.select(F.substring("w", 1, 1000).alias("w")).filter("octet_length(w) >= 8")
    return [r[0].encode() for r in rows.orderBy(F.xxhash64("w"), "w").limit(most).collect()]


def telling_text(worded: DataFrame, pieces: DataFrame, size: int) -> list[bytes]:
    """The telling words of toxic documents, four to a sample, for a dictionary of ``size`` bytes."""
    rows = worded.filter("toxic = 1").select("doc_id", "pos", "w", F.explode("pieces").alias("piece")).join(pieces, "piece", "left_semi")
    lines = rows.select("doc_id", "pos", "w").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("x"))
    cut = F.transform(F.sequence(F.lit(0), F.expr("(size(x) - 1) div 4")), lambda i: F.array_join(F.slice(F.col("x.w"), i * 4 + 1, 4), " "))
    return _sample(lines.select(F.explode(cut).alias("w")), 4 * size)


def ordinary_text(labelled: DataFrame, size: int, words: int) -> list[bytes]:
    """Windows of ordinary documents, for a dictionary of ``size`` bytes."""
    text = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))
    rows = labelled.filter("toxic = 0").select(text.alias("words")).filter("size(words) > 0")
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"(size(words) - 1) div {words}")), lambda i: F.array_join(F.slice("words", i * words + 1, words), " "))
    return _sample(rows.select(F.explode(cut).alias("w")), size)


def trained(samples: list[bytes], size: int, k: int, d: int, level: int) -> bytes:
    """A zstandard dictionary trained on the samples; they themselves where they are too few for training."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d, level=level).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(samples)[-size:]


def _cut(text: bytes, words: int, longest: int = 64) -> list[bytes]:
    """Windows of so many words; longer words count as several."""
    w = text.split()
    if len(text) > longest and max(map(len, w), default=0) > longest:
        w = [x[i : i + longest] for x in w for i in range(0, len(x), longest)]
    return [b" ".join(w[i : i + words]) for i in range(0, len(w), words)]


def _differences(ordinary: bytes, toxic: bytes, words: int, level: int) -> Callable[[bytes], tuple[list[bytes], np.ndarray]]:
    """A function from a text to its windows and how many bytes the toxic dictionary saves on each."""
    packers = []
    for raw in (ordinary, toxic):
        book = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        book.precompute_compress(level=level)
        packers.append(zstandard.ZstdCompressor(level=level, dict_data=book, write_content_size=False))
    plain, other = (p.compress for p in packers)

    def run(text: bytes) -> tuple[list[bytes], np.ndarray]:
        windows = _cut(text, words)
        return windows, np.array([len(plain(x)) - len(other(x)) for x in windows], float)

    return run


def misleading_text(labelled: DataFrame, ordinary: bytes, toxic: bytes, words: int, level: int, size: int) -> bytes:
    """Windows of ordinary text that the toxic dictionary saves most on: both dictionaries must know them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = _differences(ordinary, toxic, words, level)
        for batch in batches:
            rows: dict[bytes, float] = {}
            for text in batch.column(0).cast(pa.binary()):
                for w, d in zip(*measure(text.as_py() or b"")):
                    if d >= 3:
                        rows[w] = d
            yield pa.RecordBatch.from_pydict({"w": pa.array(list(rows), pa.binary()), "d": pa.array(list(rows.values()), pa.float64())})

    found = labelled.filter("toxic = 0").select("text").mapInArrow(run, "w binary, d double")
    got = found.groupBy("w").agg(F.max("d").alias("d")).orderBy(F.desc("d"), F.xxhash64("w")).limit(size // 48 + 1).collect()
    return b" ".join(bytes(r[0]) for r in reversed(got))[-size:]


def window_features(docs: DataFrame, ordinary: bytes, toxic: bytes, words: int, level: int) -> DataFrame:
    """(doc_id, FEATURES) of every row, from the compression differences of all its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = _differences(ordinary, toxic, words, level)
        for batch in batches:
            rows = np.zeros((batch.num_rows, len(FEATURES)))
            for k, text in enumerate(batch.column(1).cast(pa.binary())):
                _, d = measure(text.as_py() or b"")
                if len(d):
                    top = np.sort(d)[-3:]
                    rows[k] = top[-1], top.mean(), d.mean(), (d >= 3).mean(), (d >= 3).sum() / len(d) ** 0.5, np.log1p(len(d))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T.copy())], names=["doc_id", *FEATURES])

    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model, the constant first."""
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(len(w))
        step = np.linalg.solve(hess, z.T @ (y - p) - ridge * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    slopes = w[1:] / scale
    return np.append(w[0] - slopes @ mean, slopes)


def toxicity(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, words: int = 16, size: int = 1 << 14, lift: float = 4.0, contexts: int = 6, level: int = 3, rounds: int = 2, telling_size: int = 1 << 11) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select("doc_id", "toxic").filter(fold() != 2)
    train = known.filter(fold() != 3)
    kinds = [sample_labels(train.filter(F.col("toxic") == k), most_labelled) for k in (0, 1)]
    chosen = F.broadcast(kinds[0].union(kinds[1]))  # at most 2 * most_labelled rows of two numbers
    labelled = materialize(docs.join(chosen, "doc_id"), "labelled")
    base = trained(ordinary_text(labelled, size, words), size, 64, 8, level)
    worded = _worded(labelled)
    telling = telling_text(worded, telling_pieces(worded, lift, contexts), telling_size)
    tail = b" " + trained(telling, telling_size, 16, 6, level)
    base = base or b" " * 8  # a dictionary has at least eight bytes
    for _ in range(rounds if telling else 0):
        base += b" " + misleading_text(labelled, base, base + tail, words, level, size)
    scored = materialize(window_features(docs, base, base + tail, words, level), "windows")
    held = F.broadcast(sample_labels(known.filter(fold() == 3), most_labelled))
    rows = scored.join(held, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*FEATURES, "toxic")).alias("x")).select("x.*")
    rows = rows.orderBy(*FEATURES, "toxic").collect()  # at most `most_labelled`
    y = np.array([r["toxic"] for r in rows], float)
    held_out = F.coalesce(fold() == 2, F.lit(False))
    if not telling or len(set(y.tolist())) < 2:
        score = F.lit(0.0)
    else:
        weights = fit_logistic(np.array([tuple(r)[:-1] for r in rows], float), y)
        logit = F.lit(float(weights[0]))
        for name, w in zip(FEATURES, weights[1:]):
            logit = logit + F.col(name) * float(w)
        score = 1 / (1 + F.exp(-logit))
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
