"""Product codes of vectors: exact nearest codebook entries by ball trees, codebooks refined on Spark.

All arithmetic is on integers.  A part position's entries form a ball tree; a search visits a ball unless its distance,
rounded so that no entry of equal distance is missed, is beyond the best so far, and entries are compared by integer
squared distance, ties to the lower index.  Codebooks have at most ``ENTRIES`` entries of each part, so they are small
enough to go to every task whatever the size of the table; the vectors stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256

#: Entries of a leaf, and how far bounds are moved outwards: far above the error of float64, far below any distance.
LEAF, SLACK = 4, 1e-9


class BallTree:
    """Entries (rows of integers) in balls around integer centres."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        #: (centre, radius, rows of a leaf or None, the two balls inside)
        self.balls: list[tuple[np.ndarray, float, np.ndarray | None, tuple[int, ...]]] = []
        if len(entries):
            self._build(np.arange(len(entries)))

    def _build(self, rows: np.ndarray) -> int:
        points = self.entries[rows]
        centre = points.sum(0) // len(rows)
        away = square_distance(points, centre)
        at = len(self.balls)
        self.balls.append((centre, _up(np.sqrt(away.max())), rows, ()))
        if len(rows) > LEAF and away.max() > 0:
            # two far entries divide the ball
            a = square_distance(points, points[int(away.argmax())])
            b = square_distance(points, points[int(a.argmax())])
            order = np.argsort(a - b, kind="stable")
            half = len(rows) // 2
            inside = (self._build(np.sort(rows[order[:half]])), self._build(np.sort(rows[order[half:]])))
            self.balls[at] = (*self.balls[at][:2], None, inside)
        return at

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row of ``points``."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        code = np.full(len(points), len(self.entries), np.int64)
        if not len(points):
            return code, best
        self._descend(0, np.arange(len(points)), points, best, code)
        self._visit(0, np.arange(len(points)), points, best, code)
        return code, best

    def _leaf(self, rows: np.ndarray, who: np.ndarray, points: np.ndarray, best: np.ndarray, code: np.ndarray) -> None:
        some = points[who]
        for k in rows.tolist():
            d = square_distance(some, self.entries[k])
            wins = (d < best[who]) | ((d == best[who]) & (k < code[who]))
            best[who[wins]], code[who[wins]] = d[wins], k

    def _descend(self, ball: int, who: np.ndarray, points: np.ndarray, best: np.ndarray, code: np.ndarray) -> None:
        """First guesses: each point goes down to the ball whose centre is nearer."""
        rows, inside = self.balls[ball][2:]
        if rows is not None:
            self._leaf(rows, who, points, best, code)
            return
        left, right = (square_distance(points[who], self.balls[k][0]) for k in inside)
        for k, some in zip(inside, (who[left <= right], who[left > right])):
            if len(some):
                self._descend(k, some, points, best, code)

    def _visit(self, ball: int, who: np.ndarray, points: np.ndarray, best: np.ndarray, code: np.ndarray) -> None:
        centre, radius, rows, inside = self.balls[ball]
        near = _down(np.sqrt(square_distance(points[who], centre)))
        who = who[near <= _up(np.sqrt(best[who])) + radius]  # an entry as far as the best may have a lower index
        if not len(who):
            return
        if rows is not None:
            self._leaf(rows, who, points, best, code)
        for k in inside:
            self._visit(k, who, points, best, code)


def square_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK) + SLACK


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK) - SLACK


def usable(column: str) -> F.Column:
    """Not null, and no component is null, infinite or not a number."""
    c = F.col(column).cast("array<double>")
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & fine


def _most(dim: int) -> int:
    """The largest size of a component for which all distances of a vector stay below 2**62."""
    return int((2.0**60 / max(dim, 1)) ** 0.5)


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """[row, component]: floor(256 * x)."""
    values = np.floor(pc.list_flatten(column).to_numpy(zero_copy_only=False) * float(SCALE))
    if len(values) != len(column) * dim or not (pc.list_value_length(column).to_numpy(zero_copy_only=False) == dim).all():
        raise ValueError(f"vectors of other lengths than {dim}")
    if np.abs(values).max(initial=0) > _most(dim):
        raise ValueError(f"a component is beyond {_most(dim) / SCALE:g}: squared distances do not fit 64 bits")
    return values.astype(np.int64).reshape(len(column), dim)


def first_codebook(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """[part, entry, component]: the vectors of the smallest ids, cut into parts; empty if there are no vectors."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    dim = len(rows[0].vector)
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    found = integers(pa.array([r.vector for r in rows], pa.list_(pa.float64())), dim)
    return found.reshape(len(found), parts, dim // parts).swapaxes(0, 1)


def _cut(batch: pa.RecordBatch, codebook: np.ndarray) -> np.ndarray:
    parts, _, width = codebook.shape
    return integers(batch.column(batch.schema.get_field_index("vector")), parts * width).reshape(batch.num_rows, parts, width)


def refined(vectors: DataFrame, codebook: np.ndarray) -> np.ndarray:
    """Each entry becomes the floor of the mean of the parts that are nearest to it; the others stay."""
    parts, entries, width = codebook.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(codebook[p]) for p in range(parts)]
        total = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            values = _cut(batch, codebook)
            for p in range(parts):
                code = trees[p].nearest(values[:, p])[0]
                order = np.argsort(code, kind="stable")
                met, first, n = np.unique(code[order], return_index=True, return_counts=True)
                if len(met):
                    total[met + p * entries, :-1] += np.add.reduceat(values[order, p], first)
                    total[met + p * entries, -1] += n
        used = np.flatnonzero(total[:, -1])
        flat = pa.array(total[used, :-1].reshape(-1))
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used, -1]), sums], names=["slot", "n", "sums"])

    partial = vectors.select("vector").mapInArrow(run, "slot long, n long, sums array<long>")
    wide = partial.select("slot", "n", *[F.col("sums")[k].cast("decimal(38,0)").alias(f"s{k}") for k in range(width)])
    rows = wide.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)]).collect()
    new = codebook.reshape(parts * entries, width).copy()
    for r in rows:  # one row an entry
        new[r.slot] = [int(r[f"s{k}"]) // r.n for k in range(width)]
    return new.reshape(codebook.shape)


def _coded_schema(vectors: DataFrame) -> str:
    return f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, code string, error long"


def coded(vectors: DataFrame, codebook: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): two hexadecimal digits a part, and the squared distances of all parts."""
    parts = codebook.shape[0]
    digits = np.array([f"{k:02x}" for k in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(codebook[p]) for p in range(parts)]
        for batch in batches:
            values = _cut(batch, codebook)
            codes, error = np.empty((len(values), parts), np.int64), np.zeros(len(values), np.int64)
            for p in range(parts):
                codes[:, p], d = trees[p].nearest(values[:, p])
                error += d
            text = ["".join(row) for row in digits[codes].tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "vector").mapInArrow(run, _coded_schema(vectors))


def codebook_text(codebook: np.ndarray) -> str:
    return ",".join(map(str, codebook.reshape(-1).tolist()))


def product_codes(table: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The codes of all usable vectors of (vec_id, ``vector``, label), written to the shared folder, and the codebook.

    Vectors that are null or hold a null, infinite or undefined component are dropped.  Rows may repeat; each is coded,
    and repeated rows make repeated first entries, of which the lowest index is used.  A null vec_id comes last in the
    order of ids.  Fewer vectors than entries make a smaller codebook, no vectors an empty result.  All vectors must
    have one length, a multiple of the number of parts (0 also is: all distances are 0); another one, or components so
    large that squared distances leave 64 bits, raise an error.  Other columns are not read.
    """
    # cast first: a nullable element of another kind is still read as a number
    vectors = table.filter(usable(vector)).select(F.col("vec_id").cast("long"), "label", F.col(vector).cast("array<double>").alias("vector"))
    codebook = first_codebook(vectors)
    if not codebook.shape[1]:
        return table.sparkSession.createDataFrame([], _coded_schema(vectors)), codebook
    for _ in range(rounds):
        codebook = refined(vectors, codebook)
    return materialize(coded(vectors, codebook), "codes"), codebook


def decoded(codes: DataFrame, codebook: np.ndarray) -> DataFrame:
    """(vec_id, vector): the entries that the codes name, put together and scaled back."""
    parts, _, width = codebook.shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            index = np.array([[int(c[2 * p : 2 * p + 2], 16) for p in range(parts)] for c in f["code"]], np.int64).reshape(-1, parts)
            whole = codebook[np.arange(parts), index].reshape(len(f), parts * width) / SCALE
            yield pd.DataFrame({"vec_id": f["vec_id"], "vector": list(whole)})

    return codes.select("vec_id", "code").mapInPandas(run, "vec_id long, vector array<double>")


def coded_with_errors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector; see ``product_codes``."""
    codes, codebook = product_codes(table, vector)
    digest = hashlib.sha256(codebook_text(codebook).encode()).hexdigest()
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    out = hot_join(codes, sums, ["label"], "rows")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
