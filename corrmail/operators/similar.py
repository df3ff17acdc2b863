"""Pairs of similar subjects within a key, without comparing all of them.

Two sets of letters of which the Jaccard similarity is at least t, in any one order of letters, share one of the first
n - ceil(t n) + 1 of each set of n.  The order is by code point from the highest, which needs no count of the letters
and puts rare ones first (ideographs before Latin letters, z before a).  Sets meet on these letters only, where their
sizes and the places of the letter still allow the similarity; a map of 64 bits then bounds the letters that only one
has, and what is left is counted exactly.  Subjects with the same letters are one set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corrmail.functions.text import letter_jaccard, letters_of
from corrmail.operators.graph import checkpointed

#: Sets of a key that one row of ``best_similar`` holds, and shares to which the asked sets of a key are dealt.
BLOCK, SHARES = 64, 8


def _sized(sets: DataFrame) -> DataFrame:
    """Rows with (letters) that are not empty, with their size ``n`` and a map of 64 ``bits``."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    bits = F.aggregate("letters", F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(bit(x)))
    return sets.filter("size(letters) > 0").withColumn("n", F.size("letters")).withColumn("bits", bits)


def _marked(sets: DataFrame, least: float) -> DataFrame:
    """Rows with (letters) once for each of their first letters: ``token``, its place ``at``, the size and the bits."""
    rows = _sized(sets)
    first = F.slice(F.reverse("letters"), F.lit(1), F.col("n") - F.ceil(least * F.col("n") - 1e-9).cast("int") + 1)
    return rows.select("*", F.posexplode(first).alias("at", "token"))


def _few(x: Column) -> Column:
    return F.array_sort(letters_of(x))


def candidates(asked: DataFrame, given: DataFrame, key: str, least: float) -> DataFrame:
    """(key, a, b): pairs of sets of letters in (key, letters) that the bounds do not rule out."""
    left = _marked(asked, least).select(key, "token", F.col("letters").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"), F.col("at").alias("ia"))
    right = _marked(given, least).select(key, "token", F.col("letters").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"), F.col("at").alias("ib"))
    need = least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-9
    most = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))  # with this letter and those behind it
    apart = F.bit_count(F.col("ba").bitwiseXOR(F.col("bb"))) <= (1 - least) / (1 + least) * (F.col("na") + F.col("nb")) + 1e-9
    sizes = (F.col("na") >= least * F.col("nb") - 1e-9) & (F.col("nb") >= least * F.col("na") - 1e-9)
    return left.join(right, [key, "token"]).filter(sizes & apart & (most >= need)).select(key, "a", "b").distinct()


def similar_subjects(asked: DataFrame, given: DataFrame, key: str = "email", least: float = 0.6) -> DataFrame:
    """(key, s1, s2): subjects of ``asked`` (key, s1) and ``given`` (key, s2) that are equal or similar; none is blank.

    Subjects are normalized.  The result has one row a pair of different subjects.
    """
    asked = asked.select(key, "s1").distinct().withColumn("letters", _few(F.col("s1")))
    given = given.select(key, "s2").distinct().withColumn("letters", _few(F.col("s2")))
    pairs = candidates(asked.select(key, "letters").distinct(), given.select(key, "letters").distinct(), key, least)
    good = pairs.filter(letter_jaccard(F.col("a"), F.col("b")) >= least)
    found = good.join(asked.select(key, "s1", F.col("letters").alias("a")), [key, "a"]).join(given.select(key, "s2", F.col("letters").alias("b")), [key, "b"]).select(key, "s1", "s2")
    equal = asked.select(key, "s1").join(given.select(key, F.col("s2").alias("s1"), "s2"), [key, "s1"]).select(key, "s1", "s2")
    return found.union(equal).distinct()


def best_similar(asked: DataFrame, given: DataFrame, key: str = "email", least: float = 0.6, met: list[int] | None = None) -> DataFrame:
    """(key, s1, weight): the greatest weight of the subjects of ``given`` (key, s2, weight) that are equal or similar
    to each of ``asked`` (key, s1); subjects without one have no row.

    The sets of a key are met from the greatest weight down, in rounds of fourfold size, and a set that has found one
    is done: where many are similar, the sets compared grow with the subjects and not with their pairs, which are never
    made.  A set without any is compared with all of its key.  Of a set asked in a round, the number of sets that it
    may be compared with goes to ``met``.
    """
    asked = checkpointed(asked.select(key, "s1").distinct().withColumn("letters", _few(F.col("s1"))))
    given = checkpointed(given.groupBy(key, "s2").agg(F.max("weight").alias("weight")).withColumn("letters", _few(F.col("s2"))))
    equal = asked.join(given.select(key, F.col("s2").alias("s1"), "weight"), [key, "s1"]).select(key, "s1", "weight")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "letters")) - 1
    sets = _sized(given.groupBy(key, "letters").agg(F.max("weight").alias("weight"))).withColumn("nth", F.floor(rank / BLOCK))
    level = F.floor((F.length(F.bin(3 * F.col("nth") + 1)) - 1) / 2)  # 1, 4, 16, ... blocks
    entry = F.struct(F.col("weight"), F.col("n"), F.col("bits"), F.col("letters"))
    blocks = sets.groupBy(key, "nth").agg(F.sort_array(F.collect_list(entry), asc=False).alias("block"))
    blocks = checkpointed(blocks.withColumn("level", level))
    last = blocks.agg(F.max("level")).first()[0]
    dealt = F.pmod(F.xxhash64("letters"), F.lit(SHARES))
    known = given.filter("size(letters) > 0").groupBy(key, "letters").agg(F.max("weight").alias("known"))  # other subjects of the same letters too
    left = _sized(asked.select(key, "letters").distinct()).join(known, [key, "letters"], "left").withColumn("part", dealt)
    n, need = F.col("n"), least / (1 + least)

    def similar(x: Column) -> Column:
        apart = F.bit_count(F.col("bits").bitwiseXOR(x["bits"])) <= (1 - 2 * need) * (n + x["n"]) + 1e-9
        sizes = (n >= least * x["n"] - 1e-9) & (x["n"] >= least * n - 1e-9)
        return sizes & apart & (letter_jaccard(F.col("letters"), x["letters"]) >= least)

    found = equal.union(asked.join(known, [key, "letters"]).select(key, "s1", F.col("known").alias("weight")))
    shares = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for k in range(0 if last is None else last + 1):
        some = blocks.filter(F.col("level") == k).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).withColumn("part", F.col("part").cast("long"))
        pairs = left.repartition(shares, key, "part").join(some, [key, "part"]).filter(F.col("known").isNull() | (F.col("known") < F.col("block")[0]["weight"]))
        hit = F.get(F.filter("block", similar), F.lit(0))["weight"]  # the greatest comes first
        tried = pairs.select(key, "part", "letters", "n", "bits", "known", F.size("block").alias("size"), hit.alias("hit"))
        tried = checkpointed(tried.groupBy(key, "part", "letters", "n", "bits", "known").agg(F.max("hit").alias("hit"), F.sum("size").alias("size")))
        if met is not None:
            met.append(tried.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
        hits = tried.filter("hit is not null").select(key, "letters", F.col("hit").alias("weight"))
        found = found.union(asked.join(hits, [key, "letters"]).select(key, "s1", "weight"))
        left = tried.filter("hit is null").drop("hit", "size")
        if left.isEmpty():
            break
    return found.groupBy(key, "s1").agg(F.max("weight").alias("weight"))
