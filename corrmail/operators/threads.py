"""Threads: messages connected by replies, references, or a subject shared with a common address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corrmail.functions.privacy import EMAIL
from corrmail.operators.graph import changed_labels, spanning_forest

METHODS = ("in_reply_to", "references", "subject")


def addresses(sender: Column, *texts: Column) -> Column:
    """Distinct lower-case addresses of the sender and in the recipient texts."""
    found = [F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(EMAIL), F.lit(0)) for t in texts]
    return F.filter(F.array_distinct(F.concat(F.array(F.lower(F.trim(F.coalesce(sender, F.lit(""))))), *found)), lambda x: x != "")


def message_ids(messages: DataFrame) -> DataFrame:
    """(message_id, target): of messages that share an id, the latest one stands for it."""
    known = messages.filter(F.coalesce(F.trim("message_id"), F.lit("")) != "")
    return known.groupBy(F.trim("message_id").alias("message_id")).agg(F.max_by("id", F.struct("date", "id")).alias("target"))


def _cited(messages: DataFrame) -> DataFrame:
    """(id, date, message_id, method, slot) of what each message answers (slot 0) and refers to (1, 2, ...)."""
    replies = messages.select("id", "date", F.trim("in_reply_to").alias("message_id"), F.lit(METHODS[0]).alias("method"), F.lit(0).cast("long").alias("slot"))
    some = F.coalesce("references", F.array().cast("array<string>"))
    references = messages.select("id", "date", F.posexplode(some).alias("slot", "message_id")).select("id", "date", "message_id", F.lit(METHODS[1]).alias("method"), (F.col("slot") + 1).cast("long").alias("slot"))
    return replies.union(references).filter("message_id != ''")


def _addressed(messages: DataFrame, owner: str | None) -> DataFrame:
    """(id, date, subject_normalized, address): each address of a message that has a subject."""
    shared = addresses(F.col("from_email"), F.col("to_text"), F.col("cc_text"))
    rows = messages.filter("subject_normalized != ''").select("id", "date", "subject_normalized", F.explode(shared).alias("address"))
    return rows.filter(F.col("address") != owner.lower()) if owner else rows


def _at(date: str, number: str, n: int) -> list[Column]:
    return [F.coalesce(F.col(date), F.lit("")).alias(f"d{n}"), F.col(number).cast("long").alias(f"i{n}")]


def thread_edges(messages: DataFrame, owner: str | None = None, use_subject: bool = True) -> DataFrame:
    """(a, b, method, weight).  ``owner``: an address that does not count as shared.

    Messages with one subject and one address form a star around the first of them: the components are those of
    all pairs, and so is the least spanning forest, but the number of edges is linear.  Weights order the edges:
    answers and references message by message, then subjects, then pairs of a subject, each by date and id.
    """
    none = lambda n: [F.lit("").alias(f"d{n}"), F.lit(0).cast("long").alias(f"i{n}")]
    cited = _cited(messages).join(message_ids(messages), "message_id").filter("id != target")
    weight = F.struct(F.lit(0).alias("phase"), *_at("date", "id", 1), F.lit("").alias("d2"), F.col("slot").alias("i2"), *none(3))
    edges = cited.select(F.col("id").alias("a"), F.col("target").alias("b"), "method", weight.alias("weight"))
    if use_subject:
        rows = _addressed(messages, owner)
        key = F.struct(F.coalesce("date", F.lit("")).alias("date"), "id")
        first = rows.groupBy("subject_normalized", "address").agg(F.min(key).alias("hub"), F.count("*").alias("n")).filter("n > 1")
        subject = rows.groupBy("subject_normalized").agg(F.min(key).alias("first"))
        star = rows.join(first, ["subject_normalized", "address"]).filter("id != hub.id").join(subject, "subject_normalized")
        weight = F.struct(F.lit(1).alias("phase"), *_at("first.date", "first.id", 1), *_at("hub.date", "hub.id", 2), *_at("date", "id", 3))
        edges = edges.union(star.select(F.col("hub.id").alias("a"), F.col("id").alias("b"), F.lit(METHODS[2]).alias("method"), weight.alias("weight")))
    return edges


def build_threads(messages: DataFrame, owner: str | None = None, use_subject: bool = True) -> DataFrame:
    """(id, thread_id, match_method): thread_id is the smallest message id; a message alone is its own thread.

    match_method is the kind of the first union that took the message: only edges count that joined two threads when
    they were met, in the order of ``thread_edges``.  It is empty for a message alone.
    """
    forest, labels = spanning_forest(thread_edges(messages, owner, use_subject))
    ends = forest.select(F.explode(F.array("a", "b")).alias("id"), "method", "weight")
    first = ends.groupBy("id").agg(F.min_by("method", "weight").alias("match_method"))
    out = messages.select("id").join(labels, "id", "left").join(first, "id", "left")
    return out.select("id", F.coalesce("label", "id").alias("thread_id"), F.coalesce("match_method", F.lit("")).alias("match_method"))


def arriving_edges(stored: DataFrame, new: DataFrame, owner: str | None = None, use_subject: bool = True) -> DataFrame:
    """(a, b): the edges that ``new`` messages make among themselves and with ``stored`` ones.

    A new message may answer a stored one, be what a stored one has answered, or share subject and address with one.
    """
    every = lambda f: (f(stored), f(new))
    (old_ids, new_ids), (old_cited, new_cited) = every(message_ids), every(_cited)
    pairs = [(new_cited, new_ids), (new_cited, old_ids), (old_cited, new_ids)]
    edges = None
    for cited, ids in pairs:
        found = cited.join(ids, "message_id").select(F.col("id").alias("a"), F.col("target").alias("b"))
        edges = found if edges is None else edges.union(found)
    if use_subject:
        group = ["subject_normalized", "address"]
        rows = _addressed(new, owner).select("id", *group)
        met = _addressed(stored, owner).join(rows.select(*group).distinct(), group, "left_semi")
        hubs = rows.union(met.groupBy(*group).agg(F.min("id").alias("id")).select("id", *group)).groupBy(*group).agg(F.min("id").alias("hub"))
        spokes = rows.union(met.groupBy(*group).agg(F.min("id").alias("id")).select("id", *group))
        edges = edges.union(spokes.join(hubs, group).select(F.col("id").alias("a"), F.col("hub").alias("b")))
    return edges.filter("a != b")


def extended_threads(threads: DataFrame, stored: DataFrame, new: DataFrame, owner: str | None = None, use_subject: bool = True) -> DataFrame:
    """(id, thread_id) of new messages, and of stored ones whose thread changes, when ``new`` arrives.

    ``threads`` (id, thread_id) are those of ``stored``; threads that no new message touches are left alone.  Equal to
    ``build_threads`` over all as long as message ids differ (a later message takes a repeated id over only there).
    """
    labels = threads.select("id", F.col("thread_id").alias("label"))
    changed = changed_labels(labels, arriving_edges(stored, new, owner, use_subject))
    alone = new.select("id").join(changed.select("id"), "id", "left_anti").select("id", F.col("id").alias("label"))
    return changed.unionByName(alone).select("id", F.col("label").alias("thread_id"))


def thread_summary(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """(thread_id, subject of the first message, n_messages, first_date, last_date)."""
    rows = messages.join(threads, "id")
    key = F.struct("date", "id")
    return rows.groupBy("thread_id").agg(F.min_by("subject_normalized", key).alias("subject"), F.count("*").alias("n_messages"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def thread_messages(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """Messages with their thread and their place in it."""
    place = F.row_number().over(Window.partitionBy("thread_id").orderBy("date", "id"))
    return messages.join(threads, "id").withColumn("place", place)
