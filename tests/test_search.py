from __future__ import annotations

import random

from pyspark.sql import functions as F

from corrmail.operators.search import TextIndex, grams, row_text


def test_grams(spark):
    texts = ["", "ab", "abc", "ababab", "日本語テ", "a👍b👍"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(grams(F.col("t"))).collect()]
    assert [sorted(g) for g in got] == [sorted({t[k : k + 3] for k in range(len(t) - 2)}) for t in texts]


def test_search_equals_scan_and_looks_at_few_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, " ".join("".join(rng.choice("abcdeé日X") for _ in range(5)) for _ in range(6)) if k % 9 else None, k % 4) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, text string, n int")
    index = TextIndex(spark, str(tmp_path / "postings"), "id", ("id", "text", "n"))
    index.write(df.filter("id < 300"))
    index.write(df.filter("id >= 300"), mode="append")
    for words in ("", "a", "AB", "abc", "Xab", "éb", "日x", "abcde", "e a", "17 ", "nothing here"):
        want = sorted(r.id for r in df.filter(F.contains(row_text(index.columns), F.lit(words.lower()))).collect())
        assert sorted(r.id for r in index.search(df, words).collect()) == want
    hit = rows[10][1][3:9]
    assert index.candidates(hit).count() <= 20
    plan = index.candidates("abcd")._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "gram" in plan.split("PushedFilters")[1].split("]")[0]
