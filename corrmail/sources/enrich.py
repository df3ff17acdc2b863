"""Optional analysis of replies by an outside model: a function that users supply, applied in batches.

A text that the model fails on costs that text alone: a batch that fails is halved until the text stands alone, which
is then tried a bounded number of times.  The more texts failed of late, the smaller the batches, so a model that fails
often is not asked again and again for the texts beside.  Answers are kept by the hash of the text that was asked, so a
later run asks only for texts that have no answer yet, and repeated texts are asked once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrmail.functions import lexicon as L
from corrmail.functions.privacy import prepared
from corrmail.operators.graph import stored
from corrmail.sources.tables import KeyedTable, hashed

RESULT = "reply_summary string, evidence_sentences array<string>, admission_intent string, action_required string, recommended_next_step string, actual_responder_role string, confidence double, ambiguity_reason string"
ANSWERS = "text_hash string, answer string, error string, tries long"
TRIES, BATCH = 3, 32
#: What an older batch counts for beside the next one, when the share of failures is reckoned.
FADING = 0.95


def ask(model: Callable[[pd.Series], pd.Series], texts: pd.Series, tries: int = TRIES) -> list[tuple[str | None, str | None, int]]:
    """(answer, error, calls that the text was alone in) of each text; no exception of the model leaves it."""
    if not len(texts):
        return []
    for left in range(tries if len(texts) == 1 else 1, 0, -1):
        try:
            got = list(model(texts.reset_index(drop=True)))
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} answers to {len(texts)} texts")
            return [(None if pd.isna(x) else str(x), None, 1) for x in got]
        except Exception as e:  # whatever a user's model raises
            if len(texts) == 1 and left == 1:
                return [(None, f"{type(e).__name__}: {e}"[:500], tries)]
    half = len(texts) // 2
    return ask(model, texts.iloc[:half], tries) + ask(model, texts.iloc[half:], tries)


def answers_of(texts: DataFrame, model: Callable[[pd.Series], pd.Series], batch: int = BATCH, tries: int = TRIES) -> DataFrame:
    """(text_hash, answer, error, tries) of the distinct texts in (text), asked for in batches of at most ``batch``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, seen, failed = batch, 0.0, 0.0
        for f in frames:
            at, rows = 0, []
            while at < len(f):
                got = ask(model, f["text"].iloc[at : at + size], tries)
                rows += got
                at += size
                seen, failed = seen * FADING + len(got), failed * FADING + sum(error is not None for _, error, _ in got)
                size = batch if failed * batch <= 0.7 * seen else max(1, int(0.7 * seen / failed))  # about every other batch fails (ln 2)
            said = pd.DataFrame(rows, columns=["answer", "error", "tries"])
            said.insert(0, "text_hash", f["text_hash"].to_numpy())
            yield said

    asked = texts.select(F.sha2("text", 256).alias("text_hash"), "text").dropDuplicates(["text_hash"])
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # so many, as the work is the model's: few bytes are not merged into few tasks
    return asked.repartition(tasks, "text").mapInPandas(run, ANSWERS)  # by the hash again would be left out as done


def answer_table(spark, path: str) -> KeyedTable:
    """Stored answers by the hash of the text."""
    return KeyedTable(spark, path, ANSWERS, ("text_hash",), hashed("text_hash", buckets=64))


def analyze_with_model(bundles: DataFrame, model: Callable[[pd.Series], pd.Series], keep: tuple[str, ...] = (), answers: KeyedTable | None = None, tries: int = TRIES) -> DataFrame:
    """(email, summary, evidence, intent, action, step, responder, confidence) from a model's JSON answers.

    ``bundles`` has (email, bundle); texts are masked and cut before the model sees them.  Answers that are not
    valid JSON, and texts that the model fails on, give no row; unknown labels become the uncertain one.  With
    ``answers`` the model is asked only for texts that have none there, and what it says is stored; a text that
    failed is asked again.
    """
    asked = bundles.select("email", prepared("bundle", keep).alias("text")).withColumn("text_hash", F.sha2("text", 256))
    if answers is None:
        said = answers_of(asked, model, tries=tries)
    else:
        asked = stored(asked)  # masked once; read six times
        known = answers.matching(asked.select("text_hash").distinct()).filter("error is null")
        said = answers_of(asked.join(known.select("text_hash"), "text_hash", "left_anti"), model, tries=tries)
        answers.upsert(stored(said))  # an upsert reads its rows twice; the model is asked once
        said = answers.matching(asked.select("text_hash").distinct())
    got = asked.select("email", "text_hash").join(said, "text_hash").select("email", F.from_json("answer", RESULT).alias("r")).filter("r.confidence is not null")
    known_label = lambda c, table, other: F.when(F.col(c).isin(*table.values()), F.col(c)).otherwise(other)
    return got.select(
        "email",
        F.coalesce("r.reply_summary", F.lit("")).alias("summary"),
        F.array_join(F.coalesce("r.evidence_sentences", F.array().cast("array<string>")), "|").alias("evidence"),
        known_label("r.admission_intent", L.INTENTS, L.INTENTS["UNCERTAIN"]).alias("intent"),
        known_label("r.action_required", L.ACTIONS, L.ACTIONS["UNCERTAIN"]).alias("action"),
        F.coalesce("r.recommended_next_step", F.lit("")).alias("step"),
        F.coalesce("r.actual_responder_role", F.lit("")).alias("responder"),
        F.col("r.confidence").alias("confidence"),
    )
