"""Who really replied, and whether the owner has answered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corrmail.functions import lexicon as L
from corrmail.functions.text import is_own_reply, normalize_subject
from corrmail.operators.entities import recipients
from corrmail.operators.graph import checkpointed
from corrmail.operators.similar import best_similar

SIMILAR = 0.6
REASONS = ("thread", "in_reply_to", "references", "subject")


def sent_to(people: DataFrame, links: DataFrame, messages: DataFrame) -> DataFrame:
    """(email, id, message_id, subject): linked messages; for people without any, all sent messages that name their address."""
    sent = messages.filter("is_sent_by_me").select("id", "message_id", "subject", "to_text")
    linked = links.select("email", "id").distinct().join(sent, "id")
    rest = people.select("email").join(links.select("email"), "email", "left_anti")
    named = sent.withColumn("email", F.explode(F.array_distinct(recipients(F.col("to_text"))))).join(rest, "email", "left_semi")
    return linked.unionByName(named).drop("to_text")


def detect_replies(people: DataFrame, sent: DataFrame, messages: DataFrame, threads: DataFrame | None = None, addresses: DataFrame | None = None, own: bool = True) -> DataFrame:
    """(email, id, reason, is_auto) of received messages that answer somebody's outreach.

    ``addresses`` (email, address) lists more addresses of a person; with ``since`` (date, id), only messages after
    that one count by the address.  With ``threads`` (id, thread_id), messages in a thread of a sent one count
    whatever their sender.  Automatic replies are reported but are not replies.  Without ``own``, only
    ``addresses`` count.
    """
    at = F.struct(F.coalesce("date", F.lit("")).alias("date"), "id")
    known = people.select("email", F.col("email").alias("address"), F.lit(None).cast("struct<date: string, id: long>").alias("since"))
    if addresses is not None:
        since = F.col("since") if "since" in addresses.columns else F.lit(None).cast("struct<date: string, id: long>").alias("since")
        more = addresses.select("email", "address", since)
        known = known.unionByName(more) if own else more
    received = messages.filter("not is_sent_by_me and not is_bounce")
    by_address = known.join(received.withColumn("address", F.lower("from_email")), "address").filter(F.col("since").isNull() | (at > F.col("since")))
    by_address = by_address.drop("address", "since").dropDuplicates(["email", "id"]).withColumn("mate", F.lit(False))
    if threads is not None:
        mates = sent.select("email", "id").join(threads, "id").select("email", "thread_id").distinct()
        in_thread = received.join(threads.select("id", "thread_id"), "id").join(mates, "thread_id").drop("thread_id").withColumn("mate", F.lit(True))
        both = by_address.unionByName(in_thread.select(by_address.columns))
        flags = both.groupBy("email", "id").agg(F.max("mate").alias("mate"))
        by_address = flags.join(received, "id")
    ids = sent.filter("message_id != ''").select("email", F.col("message_id").alias("sent_id")).distinct()
    direct = by_address.join(ids, (by_address.email == ids.email) & (F.trim(by_address.in_reply_to) == ids.sent_id), "left_semi").select("email", "id", F.lit(2).alias("rank"))
    cited = by_address.select("email", "id", F.explode("references").alias("sent_id")).join(ids, ["email", "sent_id"], "left_semi").select("email", "id", F.lit(3).alias("rank"))
    asked = by_address.select("email", "id", normalize_subject("subject").alias("s1")).filter("s1 != ''")
    given = sent.select("email", normalize_subject("subject").alias("s2")).filter("s2 != ''")
    alike = best_similar(asked, given.withColumn("weight", F.lit(0)), "email", SIMILAR).select("email", "s1")
    close = asked.join(alike, ["email", "s1"]).select("email", "id", F.lit(4).alias("rank"))
    mate = by_address.filter("mate").select("email", "id", F.lit(1).alias("rank"))
    ranked = mate.union(direct).union(cited).union(close).groupBy("email", "id").agg(F.min("rank").alias("rank"))
    auto = received.select("id", "is_auto_reply")
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("rank"))
    related = ranked.join(auto, "id").select("email", "id", reason.alias("reason"), F.col("is_auto_reply").alias("is_auto"))
    unrelated = by_address.filter("is_auto_reply").select("email", "id", F.lit("").alias("reason"), F.lit(True).alias("is_auto")).join(related.select("email", "id"), ["email", "id"], "left_anti")
    return related.unionByName(unrelated)


def other_addresses(replies: DataFrame, messages: DataFrame) -> DataFrame:
    """(email, address, since) of senders who answered for somebody from another address, with their first such message."""
    at = F.struct(F.coalesce("date", F.lit("")).alias("date"), "id")
    rows = replies.filter("not is_auto").join(messages.select("id", at.alias("at"), F.lower("from_email").alias("address")), "id")
    return rows.filter("address != email and address != ''").groupBy("email", "address").agg(F.min("at").alias("since"))


def detect_with_addresses(people: DataFrame, sent: DataFrame, messages: DataFrame, threads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The replies, and the addresses (email, address, since) that people were found to answer from.

    An address that answers within a thread belongs to the person from that message on: what it sends later counts by
    address too.  Such messages come from these addresses and are later, so they tell no further address and no earlier
    start: one pass over them is enough.
    """
    columns = ["email", "id", "reason", "is_auto"]
    found = checkpointed(detect_replies(people, sent, messages, threads).select(*columns))
    known = checkpointed(other_addresses(found, messages))
    if known.isEmpty():
        return found, known
    some = people.join(known.select("email").distinct(), "email", "left_semi")
    mine = sent.join(some.select("email"), "email", "left_semi")
    more = detect_replies(some, mine, messages, None, known, own=False).select(*columns)
    rank = F.when(F.col("reason") == "", len(REASONS)).otherwise(F.array_position(F.array(*[F.lit(r) for r in REASONS]), "reason") - 1)
    best = found.unionByName(more).groupBy("email", "id").agg(F.min_by(F.struct("reason", "is_auto"), rank).alias("r"))
    return checkpointed(best.select("email", "id", "r.reason", "r.is_auto")), known


def all_addresses(people: DataFrame, addresses: DataFrame) -> DataFrame:
    """(email, seq, address): a person's own address first, then those found, in the order of their first messages."""
    nth = F.row_number().over(Window.partitionBy("email").orderBy("since", "address"))
    found = addresses.select("email", nth.cast("long").alias("seq"), "address")
    return people.select("email", F.lit(0).cast("long").alias("seq"), F.col("email").alias("address")).unionByName(found)


def reply_status(people: DataFrame, sent: DataFrame, replies: DataFrame, messages: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(email, status, n_replies and the first reply's id, date, sender and body)."""
    real = replies.filter("not is_auto").join(messages, "id")
    key = F.struct("date", "id")
    sender = F.coalesce(F.when(F.col("from_name") != "", F.col("from_name")), F.col("from_email"))
    sums = real.groupBy("email").agg(F.count("*").alias("n_replies"), F.min_by(F.struct("id", "date", sender.alias("sender"), "body_text"), key).alias("first"))
    own = sent.groupBy("email").agg(F.max(is_own_reply("subject")).alias("own"))
    rows = people.select("email").join(sums, "email", "left").join(own, "email", "left")
    blank = F.trim(F.coalesce("first.body_text", F.lit(""))) == ""
    status = F.when(F.col("n_replies").isNotNull(), F.when(blank, L.UNSURE).otherwise(L.YES)).when(F.coalesce("own", F.lit(False)), L.UNSURE).otherwise(L.NO)
    rows = rows.withColumn("status", status)
    if overrides is not None:
        forced = overrides.select("email", F.col("value").alias("forced"))
        rows = rows.join(forced, "email", "left").withColumn("status", F.coalesce("forced", "status"))
    return rows.select("email", "status", F.coalesce("n_replies", F.lit(0)).cast("long").alias("n_replies"), F.col("first.id").alias("reply_id"), F.coalesce("first.date", F.lit("")).alias("reply_time"), F.coalesce("first.sender", F.lit("")).alias("responder"), F.coalesce("first.body_text", F.lit("")).alias("reply_body"))


def unanswered(replies: DataFrame, messages: DataFrame) -> DataFrame:
    """(email, id, date) of replies that no later sent message answers.

    An answer names the reply's id, or goes to the person under a similar subject.  Each way is an equi-join; what
    no join finds is left.
    """
    real = replies.filter("not is_auto").select("email", "id").join(messages.select("id", "message_id", "date", "subject"), "id")
    sent = messages.filter("is_sent_by_me").select(F.col("date").alias("sent_date"), F.trim("in_reply_to").alias("irt"), "references", recipients(F.col("to_text")).alias("to"), F.col("subject").alias("sent_subject"))
    later = ~((F.col("date") != "") & (F.col("sent_date") != "") & (F.col("sent_date") <= F.col("date")))
    named = sent.select("sent_date", F.explode(F.array_distinct(F.concat(F.array("irt"), F.coalesce("references", F.array().cast("array<string>"))))).alias("message_id")).filter("message_id != ''")
    by_id = real.join(named, "message_id").filter(later).select("email", "id")
    # only the latest message to a person under a subject matters, and only distinct subjects are compared
    undated = F.max(F.col("sent_date") == "").alias("undated")
    to_person = sent.select("sent_date", F.explode(F.array_distinct("to")).alias("email"), normalize_subject("sent_subject").alias("s2")).filter("s2 != ''")
    to_person = to_person.groupBy("email", "s2").agg(F.max("sent_date").alias("sent_date"), undated)
    to_person = to_person.select("email", "s2", F.struct("undated", "sent_date").alias("weight"))  # an undated one answers whatever it is
    asked = real.withColumn("s1", normalize_subject("subject")).filter("s1 != ''")
    alike = best_similar(asked, to_person, "email", SIMILAR).select("email", "s1", "weight.*")
    by_subject = asked.join(alike, ["email", "s1"]).filter(later | F.col("undated")).select("email", "id")
    answered = by_id.union(by_subject).distinct()
    return real.join(answered, ["email", "id"], "left_anti").select("email", "id", "date")


def my_reply_status(people: DataFrame, replies: DataFrame, messages: DataFrame) -> DataFrame:
    """(email, my_status, open_id): the first reply that is not answered, if any."""
    some = replies.filter("not is_auto").select("email").distinct().withColumn("has", F.lit(True))
    left = unanswered(replies, messages).groupBy("email").agg(F.min_by("id", F.struct("date", "id")).alias("open_id"))
    rows = people.select("email").join(some, "email", "left").join(left, "email", "left")
    status = F.when(F.col("has").isNull(), L.NO_NEED).when(F.col("open_id").isNull(), L.REPLIED).otherwise(L.NOT_REPLIED)
    return rows.select("email", status.alias("my_status"), "open_id")
