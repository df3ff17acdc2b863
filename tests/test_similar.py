"""Similar subjects within a person against comparing all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corrmail.operators import similar

SUBJECTS = "email string, s string"


def letters(s):
    return {c for c in s if c != " "}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def some_subjects(rng, n, alphabet):
    out = []
    for _ in range(n):
        base = rng.choice(out)[1] if out and rng.random() < 0.4 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 14)))
        if rng.random() < 0.5:
            base = base[: rng.randrange(1, len(base) + 1)].strip() or "x"
        out.append((rng.choice(["p", "p", "q"]), base))
    return out


def test_pairs_equal_all_pairs_and_few_are_compared(spark):
    rng = random.Random(7)
    alphabet = "保研自荐某大学计算机专业申请夏令营材料补充面试通知欢迎报名abcdefg 数学物理化学生物医药法律经济管理历史哲学文艺体育"
    a, b = some_subjects(rng, 250, alphabet), some_subjects(rng, 250, alphabet)
    b += a[:10] + [("p", "。"), ("q", "!")]
    a += [("p", "。"), ("r", "only here")]
    normal = lambda rows: [(e, " ".join(s.split()).lower()) for e, s in rows]
    a, b = [x for x in normal(a) if x[1]], [x for x in normal(b) if x[1]]
    asked = spark.createDataFrame(a, SUBJECTS).withColumnRenamed("s", "s1")
    given = spark.createDataFrame(b, SUBJECTS).withColumnRenamed("s", "s2")
    from corrmail.functions.text import normalize_subject

    asked, given = asked.withColumn("s1", normalize_subject("s1")).filter("s1 != ''"), given.withColumn("s2", normalize_subject("s2")).filter("s2 != ''")
    left, right = {tuple(r) for r in asked.collect()}, {tuple(r) for r in given.collect()}
    for least in (0.6, 0.8):
        want = {(e, s, t) for e, s in left for f, t in right if e == f and (s == t or jaccard(letters(s), letters(t)) >= least)}
        got = [tuple(r) for r in similar.similar_subjects(asked, given, "email", least).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    sets = lambda df, c: df.select("email", similar._few(F.col(c)).alias("letters")).distinct()
    one, two = sets(asked, "s1"), sets(given, "s2")
    compared = similar.candidates(one, two, "email", 0.6).count()
    every = one.withColumnRenamed("letters", "l1").join(two, "email").count()
    assert compared < every / 10


def test_no_subjects(spark):
    none = spark.createDataFrame([], SUBJECTS)
    assert similar.similar_subjects(none.withColumnRenamed("s", "s1"), none.withColumnRenamed("s", "s2")).count() == 0


def test_best_weights_equal_all_pairs_and_few_are_compared(spark):
    rng = random.Random(3)
    subjects = ["".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(30)).strip() for _ in range(1200)]
    subjects += ["".join(rng.choice("数学物理化学生物") for _ in range(3)) for _ in range(40)]
    turned = [s[::-1] for s in subjects[:60]]  # the same letters, another subject
    a = [("q" if rng.random() < 0.1 else "p", s) for s in subjects[::2] + subjects[:50] + turned]
    b = [("q" if rng.random() < 0.1 else "p", s, rng.randrange(100)) for s in subjects[1::2] + subjects[:50]]
    best, every = {}, 0
    for e, s in set(a):
        same = [(t, w) for f, t, w in b if e == f]
        every += len(same)
        hits = [w for t, w in same if s == t or jaccard(letters(s), letters(t)) >= 0.6]
        if hits:
            best[e, s] = max(hits)
    asked = spark.createDataFrame(a, SUBJECTS).withColumnRenamed("s", "s1")
    given = spark.createDataFrame(b, "email string, s2 string, weight int")
    met = []
    got = {(r.email, r.s1): r.weight for r in similar.best_similar(asked, given, met=met).collect()}
    assert got == best and len(met) > 1
    assert sum(met) < every / 3
    none = given.limit(0)
    assert similar.best_similar(asked, none).count() == 0 and similar.best_similar(asked.limit(0), given).count() == 0
