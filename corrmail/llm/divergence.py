"""How far the sources of a language are apart in their words: exact integer divergences between all pairs of sources.

Counts of (lang, source, term) are added up in the tasks that read the texts.  For pairs of sources the terms divide
into heavy ones, which many sources have, and light ones.  Heavy terms become dense tiles of numpy (terms by sources).
Light terms start from the value of a term that neither source has, to which each source's own terms are added by
how often each number of occurrences is met, and each pair of sources that share a term corrects its share; so the
work follows the postings.  Both partial sums are whole numbers and are added up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunk_of, hot_join, materialize

#: A kept term is in so many documents of its language; what shares are counted in; ranks of terms.
LEAST_DOCS, SHARE, TOP = 3, 1_000_000_000, 200

#: A term is heavy if one in so many of its language's sources has it; sources of a block; rows of a bucket of terms; terms of a tile.
HEAVY, BLOCK, BUCKET, TILE = 4, 128, 50_000, 512

#: Entries that a task collects before it hands them on.
HELD = 300_000

#: Bytes of terms: capital letters become small, all other ASCII characters but letters part terms.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Terms in order; a part between ASCII blanks never cuts a character, as the blanks stand for single bytes."""
    return [t for t in text.encode().translate(_FOLD).split(b" ") if t]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of (lang, source, text): occurrences, and documents that hold the term.

    Each task adds up what it reads and hands the sums on when it holds ``HELD`` of them.  Rows of one term of a
    language stay in one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in held.items():
                words, n = list(found), len(found)
                both = np.array(list(found.values()), np.int64).reshape(n, 2)
                names = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string())]
                yield pa.RecordBatch.from_arrays([*names, pa.array(words, pa.binary()).cast(pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(column.to_pylist() for column in batch.columns)):
                found = held.setdefault((lang, source), {})
                before = len(found)
                for word, n in Counter(terms_of(text)).items():
                    entry = found.get(word)
                    if entry is None:
                        found[word] = [n, 1]
                    else:
                        entry[0] += n
                        entry[1] += 1
                size += len(found) - before
                if size >= HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / (total + kinds)), exact for any counts."""
    wide = (count + 1).cast("decimal(28,0)") * F.lit(SHARE).cast("decimal(10,0)")
    return F.lit(1) + _div(wide, (total + kinds).cast("decimal(28,0)"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def shares(n: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The same in numpy, three digits at a time: numbers stay below 2**63 for counts up to 10**15."""
    whole, out = total + kinds, 0
    rest = n + 1
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _dense(left: pd.DataFrame, right: pd.DataFrame, p0: np.ndarray, q0: np.ndarray) -> np.ndarray:
    """[left source, right source]: what heavy terms differ by from terms that neither source has."""
    out = np.zeros((len(p0), len(q0)), np.int64)
    none = f(p0[:, None], q0)
    terms = pd.unique(pd.concat([left.term, right.term]))
    index = pd.Series(np.arange(len(terms)), terms)
    a, b = index[left.term].to_numpy(), index[right.term].to_numpy()
    for at in range(0, len(terms), TILE):
        n = min(TILE, len(terms) - at)
        p, q = np.tile(p0, (n, 1)), np.tile(q0, (n, 1))
        here = (a >= at) & (a < at + n)
        p[a[here] - at, left.k.to_numpy()[here]] = left.p.to_numpy()[here]
        here = (b >= at) & (b < at + n)
        q[b[here] - at, right.k.to_numpy()[here]] = right.p.to_numpy()[here]
        for k in range(len(p0)):
            out[k] += f(p[:, k, None], q).sum(0) - n * none[k]
    return out


def _met(side: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, share, number of terms): equal counts of a source have equal shares."""
    found = side.groupby(["k", "p"]).size().reset_index(name="n")
    return found.k.to_numpy(np.int64), found.p.to_numpy(np.int64), found.n.to_numpy(np.int64)


def _sparse(left: pd.DataFrame, right: pd.DataFrame, p0: np.ndarray, q0: np.ndarray) -> np.ndarray:
    """[left source, right source]: what light terms differ by from terms that neither source has."""
    out = np.zeros((len(p0), len(q0)), np.int64)
    none = f(p0[:, None], q0)
    k, p, n = _met(left)
    for at in range(0, len(k), TILE):
        here = slice(at, at + TILE)
        np.add.at(out, k[here], n[here, None] * (f(p[here, None], q0) - none[k[here]]))
    k, q, n = _met(right)
    for at in range(0, len(k), TILE):
        here = slice(at, at + TILE)
        np.add.at(out.T, k[here], n[here, None] * (f(p0, q[here, None]) - none.T[k[here]]))
    # pairs of sources that share a term: postings of the right side, repeated for each posting of the left
    right = right.sort_values("term", kind="stable")
    terms = right.term.to_numpy()
    for at in range(0, len(left), 1 << 14):
        some = left.iloc[at : at + (1 << 14)]
        first, last = (np.searchsorted(terms, some.term.to_numpy(), side) for side in ("left", "right"))
        n = last - first
        a = np.repeat(np.arange(len(some)), n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        i, p = some.k.to_numpy()[a], some.p.to_numpy()[a]
        j, q = right.k.to_numpy()[b], right.p.to_numpy()[b]
        np.add.at(out, (i, j), f(p, q) - f(p, q0[j]) - f(p0[i], q) + none[i, j])
    return out


def pair_sums(kept: DataFrame, groups: DataFrame, rows: int, sources: int) -> DataFrame:
    """(lang, source, item, value) of every two different sources of a language.

    ``kept``: (lang, source, term, p, heavy) of kept terms that the source has; ``groups``: (lang, source, total, kinds).  Sources are dealt to blocks and terms to buckets by hash; a task holds one bucket for two blocks.
    """
    blocks, buckets = 1 + sources // BLOCK, 1 + rows // BUCKET
    block = chunk_of(blocks, F.col("lang"), F.col("source"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))

    def tiles(df: DataFrame) -> DataFrame:
        """Each row for the tiles in which its block is on the left (side 0) or the right (side 1)."""
        left = df.withColumn("side", F.lit(0)).withColumn("i", block).withColumn("j", F.explode(every))
        right = df.withColumn("side", F.lit(1)).withColumn("j", block).withColumn("i", F.explode(every))
        return left.unionByName(right)

    keys = ["lang", "i", "j", "bucket"]
    terms = tiles(kept.select("lang", "source", "p", "heavy", "term", chunk_of(buckets, F.col("term")).alias("bucket")))
    ends = tiles(groups.select("lang", "source", "total", "kinds")).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))

    def run(key: tuple, found: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for side in (0, 1):
            group = ends[ends.side == side].sort_values("source", kind="stable")
            part = found[found.side == side]
            part = part.assign(k=pd.Series(np.arange(len(group)), group.source.to_numpy()).reindex(part.source).to_numpy())
            total, kinds = group.total.to_numpy(np.int64), group.kinds.to_numpy(np.int64)
            empty = shares(np.zeros(len(group), np.int64), total, np.maximum(kinds, 1))
            sides.append((group, part, empty))
        (left, a, p0), (right, b, q0) = sides
        value = _dense(a[a.heavy], b[b.heavy], p0, q0) + _sparse(a[~a.heavy], b[~b.heavy], p0, q0)
        if key[3] == 0 and len(left):  # once a pair: all terms as if neither source had them
            value += left.kinds.to_numpy(np.int64)[:, None] * f(p0[:, None], q0)
        names, items = np.repeat(left.source.to_numpy(), len(right)), np.tile(right.source.to_numpy(), len(left))
        out = pd.DataFrame({"lang": key[0], "source": names, "item": items, "value": value.reshape(-1)})
        return out[out.source != out["item"]]

    sums = terms.groupBy(*keys).cogroup(ends.groupBy(*keys)).applyInPandas(run, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) that occurs in ``docs``.

    Part ``pair``: all other sources of the language by how far this source's shares of terms are from theirs; part
    ``term``: the terms with the largest excess over the language, at most ``TOP``.  Equal values go by the item's
    UTF-8 bytes.  Null texts, languages and sources are ''; a language that keeps no term has pairs of value 0; a
    single source has no pair; an empty table gives no rows.  Repeated rows are documents of their own.
    """
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    docs = docs.select(*names)
    same = Window.partitionBy("lang", "term")  # as the counts are dealt: no further shuffle
    postings = term_counts(docs).select("lang", "source", "term", "n", F.sum("docs").over(same).alias("docs"), F.sum("n").over(same).alias("all_n"), F.count("*").over(same).alias("in_sources"))
    postings = materialize(postings.filter(F.col("docs") >= LEAST_DOCS).drop("docs"), "postings")
    groups = materialize(docs.select("lang", "source").distinct(), "sources")

    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    kinds = postings.groupBy("lang", "term").agg(F.first("all_n").alias("n")).groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("n").alias("lang_total"))
    langs = sources.join(kinds, "lang", "left").fillna(0, ["kinds", "lang_total"])

    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    groups = materialize(groups.join(totals, ["lang", "source"], "left").fillna(0, ["total", "rows"]), "totals")
    groups = materialize(hot_join(groups, langs.withColumn("_n", F.col("sources")), ["lang"], "_n"), "groups")

    kept = hot_join(postings, groups, ["lang", "source"], "rows")
    p, q = share(F.col("n"), F.col("total"), F.col("kinds")), share(F.col("all_n"), F.col("lang_total"), F.col("kinds"))
    kept = materialize(kept.select("lang", "source", "term", p.alias("p"), q.alias("q"), (F.col("in_sources") * heavy >= F.col("sources")).alias("heavy")), "shares")

    per = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    top = kept.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    top = top.withColumn("rank", F.row_number().over(per)).filter(F.col("rank") <= TOP)
    size = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("sources"), F.lit(0))).first()
    pairs = pair_sums(kept, groups, size[0], size[1])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(per))
    return pairs.unionByName(top).select("lang", "source", "part", "item", "value", F.col("rank").cast("int"))
