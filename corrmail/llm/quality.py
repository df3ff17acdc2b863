"""Quality rules as weak supervision (operator 6), with DataFrame functions only.

Each rule votes good, bad or abstains.  Expectation-maximisation over the counts of vote patterns (at most three to
the number of rules, whatever the input) estimates how often each rule is right on good and on bad documents and
how common bad ones are.  A document's posterior probability of being good replaces the demand that all rules pass.

Words are runs without ASCII white space.  Null text has no words.  Repeated rows are scored alike.  An empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, materialize

#: Fixed values of the base rules: fewest words; words a repeated window has; largest share of repeated words.
FEWEST_WORDS = 20
WINDOW = 8
MOST_REPEATED = 0.3
#: A rule is trusted to call few good documents bad; without this bound a second kind of bad ones joins the good.
MOST_WRONG = 0.005

#: name: (what is measured, good up to, bad above); between the two a rule abstains.
RULES: dict[str, tuple[str, float, float]] = {
    "symbols": ("n_symbols / n_words", 0.02, 0.1),
    "repeats": ("n_repeat_words / n_words", 0.15, 0.25),
    "same_lines": ("n_dup_lines / n_lines", 0.3, 0.6),
    "capitals": ("n_upper / n_letters", 0.15, 0.4),
    "exclaims": ("n_exclaims / n_words", 0.05, 0.3),
    "stutters": ("n_stutters / n_words", 0.02, 0.2),
    "marks": ("1 - n_alnum / word_chars", 0.12, 0.3),
    "word_length": ("abs(word_chars / n_words - 6)", 3.0, 6.0),
}


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts and those of the other rules, all over whole texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("_text", text).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    n = F.size("_words")
    df = df.withColumn("n_words", n.cast("long"))
    hashes = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))
    df = df.withColumn("_windows", F.when(n >= WINDOW, hashes))
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_placed", F.when(again, placed))
    size = F.size("_placed")
    twice = F.filter(
        F.transform("_placed", lambda p, k: F.when(((k > 0) & (F.get("_placed", k - 1).h == p.h)) | ((k + 1 < size) & (F.get("_placed", k + 1).h == p.h)), p.i)),
        lambda x: x.isNotNull(),
    )
    df = df.withColumn("_twice", F.array_sort(twice))
    step = F.transform("_twice", lambda p, k: F.when(k + 1 < F.size("_twice"), F.least(F.get("_twice", k + 1) - p, F.lit(WINDOW))).otherwise(WINDOW))
    repeated = F.coalesce(F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counted = lambda pattern: F.regexp_count("_text", F.lit(pattern)).cast("long")
    df = (
        df.withColumn("word_chars", F.length("_text").cast("long") - counted(SPACE))
        .withColumn("n_symbols", counted(r"[#*$%&|<>]"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", repeated)
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_stutters", F.size(F.filter("_words", lambda w, i: (i > 0) & (F.get("_words", i - 1) == w))).cast("long"))
        .withColumn("n_upper", counted(r"\p{Lu}"))
        .withColumn("n_letters", counted(r"\p{L}"))
        .withColumn("n_alnum", counted(r"[\p{L}\p{N}]"))
        .withColumn("n_exclaims", counted("!"))
    )
    return df.drop("_text", "_words", "_windows", "_placed", "_twice", "_lines")


def votes() -> dict[str, Column]:
    """1 good, 0 bad, null abstains."""
    found = {}
    for name, (measure, good, bad) in RULES.items():
        for divisor in ("n_words", "n_lines", "n_letters", "word_chars"):
            measure = measure.replace(f"/ {divisor}", f"/ nullif({divisor}, 0)")
        x = F.expr(measure)
        found[name] = F.when(x <= good, 1).when(x > bad, 0)
    return found


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 50) -> tuple[float, list[tuple[float, float]]]:
    """(share of good, [(P(votes bad | good), P(votes bad | bad)) of each rule]) from counted vote patterns."""
    n_rules = len(patterns[0][0]) if patterns else 0
    share, rates = 0.9, [(0.02, 0.4)] * n_rules
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good = 0.0
        tally = [[0.0, 0.0, 0.0, 0.0] for _ in range(n_rules)]  # good: votes, bad votes; bad: votes, bad votes
        for pattern, n in patterns:
            p = posterior(pattern, share, rates)
            good += n * p
            for t, v in zip(tally, pattern):
                if v is not None:
                    t[0] += n * p
                    t[2] += n * (1 - p)
                    if v == 0:
                        t[1] += n * p
                        t[3] += n * (1 - p)
        share = min(0.99, max(0.5, (good + 9) / (total + 10)))
        rates = []
        for a, b, c, d in tally:  # smoothed; bad documents get more bad votes than good ones
            on_good = min(MOST_WRONG, (b + 0.2) / (a + 10))
            rates.append((on_good, max(2 * on_good, (d + 2) / (c + 10))))
    return share, rates


def posterior(pattern: tuple[int | None, ...], share: float, rates: list[tuple[float, float]]) -> float:
    logit = math.log(share / (1 - share))
    for v, (g, b) in zip(pattern, rates):
        if v is not None:
            logit += math.log(g / b) if v == 0 else math.log((1 - g) / (1 - b))
    return 1 / (1 + math.exp(-logit))


def scored(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``p_good`` and ``kept``; ``text`` is not needed afterwards."""
    rows = materialize(docs, "quality")
    rule_votes = votes()
    base_failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > round(100 * MOST_REPEATED) * F.col("n_words"))
    counted = rows.select(*[v.alias(k) for k, v in rule_votes.items()]).groupBy(*rule_votes).count().collect()  # at most 3 ** rules rows
    share, rates = estimate([(tuple(r)[:-1], r["count"]) for r in sorted(counted, key=str)])
    logit = F.lit(math.log(share / (1 - share)))
    for v, (g, b) in zip(rule_votes.values(), rates):
        logit = logit + F.when(v == 0, math.log(g / b)).when(v == 1, math.log((1 - g) / (1 - b))).otherwise(0.0)
    out = rows.withColumn("base_failed", base_failed).withColumn("p_good", 1 / (1 + F.exp(-logit)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base counts, base_failed, kept, p_good) of every row."""
    out = scored(with_features(docs.select("doc_id", "text")).drop("text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    renamed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    return scored(with_features(renamed).drop("text")).filter("kept").select("row.*")
