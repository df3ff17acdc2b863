"""Reply classification by word lists: intent, evidence, what to do next."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrmail.functions import lexicon as L
from corrmail.functions.text import contains_any, evidence, new_content, stripped


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def action_of(intent: Column, my_status: Column) -> Column:
    """The action for an intent's code, which depends on whether the owner has replied."""
    done = _lookup({k: v[0] for k, v in L.INTENT_ACTIONS.items()}, intent)
    open_ = _lookup({k: v[1] for k, v in L.INTENT_ACTIONS.items()}, intent)
    return F.when(my_status == L.REPLIED, done).otherwise(open_)


def _chosen(text: Column, intents: tuple, confidence: float, other: str, other_confidence: float) -> Column:
    pair = lambda code, sure: F.struct(F.lit(code).alias("intent"), F.lit(sure).alias("confidence"))
    found = None
    for words, code in intents:
        holds = contains_any(text, words)
        found = F.when(holds, pair(code, confidence)) if found is None else found.when(holds, pair(code, confidence))
    last = pair(other, other_confidence)
    return last if found is None else found.otherwise(last)


def classify(rows: DataFrame, body: str = "reply_body", status: str = "status", my_status: str = "my_status", rules: L.ReplyRules | None = None) -> DataFrame:
    """Add ``rule_*`` columns: summary, evidence, intent and action (codes), next step, confidence."""
    rules = rules or L.ReplyRules()
    whole = F.coalesce(F.col(body), F.lit(""))
    df = rows.withColumn("_new", new_content(whole))
    text = F.when(F.col("_new") != "", F.col("_new")).otherwise(whole)
    df = df.withColumn("_text", text)
    text = F.col("_text")
    has = lambda words: contains_any(text, words)
    read = (
        F.when(has(rules.negative), _chosen(text, rules.negative_intents, 0.7, "REJECTED", 0.7))
        .when(has(rules.positive), _chosen(text, rules.positive_intents, 0.7, "POLITE_NO_INTENT", 0.5))
        .when(has(rules.uncertain), _chosen(text, rules.uncertain_intents, 0.5, "POLITE_NO_INTENT", 0.5))
        .otherwise(F.struct(F.lit("POLITE_NO_INTENT").alias("intent"), F.lit(0.4).alias("confidence")))
    )
    df = df.withColumn("_read", read)
    kind = F.when(F.col(status) == L.NO, L.NO).when(F.col(status) == L.UNSURE, L.UNSURE).when(stripped(whole) == "", "blank")
    fixed = lambda k: _lookup({name: v[k] for name, v in L.FIXED_RESULTS.items()}, kind)
    given = kind.isNotNull()
    action = action_of(F.col("_read.intent"), F.col(my_status))
    summary = F.substring(F.when(F.col("_new") != "", F.col("_new")).otherwise(text), 1, 300)
    words = (*rules.positive, *rules.uncertain, *rules.negative)
    return (
        df.withColumn("rule_summary", F.when(given, fixed(0)).otherwise(summary))
        .withColumn("rule_evidence", F.when(given, F.array().cast("array<string>")).otherwise(evidence(text, words)))
        .withColumn("rule_intent", F.when(given, fixed(1)).otherwise(F.col("_read.intent")))
        .withColumn("rule_action", F.when(given, fixed(2)).otherwise(action))
        .withColumn("rule_next_step", F.when(given, fixed(3)).otherwise(_lookup(L.NEXT_STEPS, action)))
        .withColumn("rule_confidence", F.when(given, fixed(4)).otherwise(F.col("_read.confidence")))
        .drop("_new", "_text", "_read")
    )
