"""Messages made from a table of conversations (conv_id, turn, role, text), for data that holds no mail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corrmail.functions.text import normalize_subject

OWNER = "me@local.edu"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def conversations_as_messages(conversations: DataFrame) -> DataFrame:
    """User turns are sent by the owner, assistant turns received, system turns are notifications.

    A conversation is one exchange with ``p<conv % 40>@d<conv % 8>.edu.cn``; each turn answers the one before it.
    """
    own = F.col("role") == "user"
    person = F.concat(F.lit("p"), (F.col("conv_id") % 40).cast("string"), F.lit("@d"), (F.col("conv_id") % 8).cast("string"), F.lit(".edu.cn"))
    me = F.lit(OWNER)
    name = lambda turn: F.concat(F.lit("<c"), F.col("conv_id").cast("string"), F.lit(".t"), turn.cast("string"), F.lit("@x>"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.concat(F.lit("2024-"), two((F.col("conv_id") / 28).cast("long") % 12 + 1), F.lit("-"), two(F.col("conv_id") % 28 + 1))
    clock = F.concat(F.lit("T"), two((F.col("turn") / 60).cast("long") % 24), F.lit(":"), two(F.col("turn") % 60), F.lit(":00+00:00"))
    text = F.coalesce("text", F.lit(""))
    first = F.first_value(F.substring(text, 1, 40)).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = conversations.withColumn("_first", first).withColumn("subject", F.concat(F.when(F.col("turn") > 0, "Re: ").otherwise(""), F.col("_first")))
    person_to = F.concat(F.lit("<"), person, F.lit(">"))
    return df.select(
        (F.col("conv_id") * 100 + F.col("turn") + 1).cast("long").alias("id"),
        name(F.col("turn")).alias("message_id"),
        F.when(F.col("turn") > 0, name(F.col("turn") - 1)).otherwise("").alias("in_reply_to"),
        F.array().cast("array<string>").alias("references"),
        F.concat(day, clock).alias("date"),
        "subject",
        normalize_subject("subject").alias("subject_normalized"),
        F.when(own, me).otherwise(person).alias("from_email"),
        F.lit("").alias("from_name"),
        F.when(own, person_to).otherwise(F.concat(F.lit("<"), me, F.lit(">"))).alias("to_text"),
        F.lit("").alias("cc_text"),
        text.alias("body_text"),
        F.lit(False).alias("has_attachments"),
        F.lit("").alias("attachment_names"),
        own.alias("is_sent_by_me"),
        F.lit(False).alias("is_auto_reply"),
        F.lit(False).alias("is_bounce"),
        (F.col("role") == "system").alias("is_system_notification"),
    )


def conversations_as_files(conversations: DataFrame) -> DataFrame:
    """The same exchange as message files (path, content), for data that holds no mail.

    The message number decides what a file shows: encoded headers, plain text, html or both, attachments, references
    with or without a named predecessor, automatic answers, bounces, dates that cannot be read.
    """
    rows = conversations_as_messages(conversations).withColumn("turn", F.pmod(F.col("id") - 1, F.lit(100))).withColumn("conv", F.expr("(id - 1) div 100"))
    k, own, line = F.col("id"), F.col("is_sent_by_me"), F.lit("\r\n")
    coded = lambda c: F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"\s", "")
    person = F.when(own, F.substring_index(F.regexp_replace("to_text", "[<>]", ""), ",", 1)).otherwise(F.col("from_email"))
    number = F.substring_index(person, "@", 1)
    bounced = ~own & (k % 13 == 0)
    sender = F.when(own, F.lit(f"Me <{OWNER}>")).when(bounced, F.concat(F.lit("Mail <mailer-daemon@"), F.substring_index(person, "@", -1), F.lit(">")))
    sender = sender.when(F.col("is_system_notification"), F.concat(F.lit("noreply@"), F.substring_index(person, "@", -1)))
    sender = sender.otherwise(F.concat(F.lit("=?utf-8?B?"), coded(F.concat(F.lit("王 "), number)), F.lit("?= <"), F.upper(person), F.lit(">")))
    to = F.when(own, F.concat(F.lit('"Prof. '), number, F.lit('" <'), person, F.lit(">"))).otherwise(F.lit(f"<{OWNER}>, Other <other@x.org>"))
    name = lambda n: F.concat(F.lit("<c"), F.col("conv").cast("string"), F.lit(".t"), n.cast("string"), F.lit("@x>"))
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.substring("date", 6, 2).cast("int"))
    date = F.when(k % 9 == 0, F.lit("some day")).otherwise(F.concat(F.substring("date", 9, 2), F.lit(" "), month, F.lit(" 2024 "), F.substring("date", 12, 8), F.lit(" +0800")))
    header = lambda label, value: F.concat(F.lit(label), F.lit(": "), value, line)
    head = F.concat(
        header("Message-ID", F.col("message_id")),
        header("Subject", F.concat(F.lit("=?utf-8?B?"), coded(F.col("subject")), F.lit("?="))),
        header("From", sender),
        header("To", to),
        header("Date", date),
        F.when((F.col("turn") > 0) & (k % 2 == 0), header("In-Reply-To", F.col("in_reply_to"))).otherwise(""),
        F.when(F.col("turn") > 1, header("References", F.concat(name(F.col("turn") - 2), F.lit(" "), name(F.col("turn") - 1)))).when(F.col("turn") == 1, header("References", name(F.col("turn") - 1))).otherwise(""),
        F.when(k % 11 == 0, header("Auto-Submitted", F.lit("auto-replied"))).otherwise(""),
        header("MIME-Version", F.lit("1.0")),
    )
    part = lambda kind, body: F.concat(header("Content-Type", F.lit(f"text/{kind}; charset=utf-8")), header("Content-Transfer-Encoding", F.lit("base64")), line, coded(body), line)
    page = F.concat(F.lit("<html><script>var a='<p>';</script><body><div>Hello "), k.cast("string"), F.lit("<br>Bye &amp; co</div></body></html>"))
    several = lambda kind, *parts: F.concat(header("Content-Type", F.lit(f'multipart/{kind}; boundary="=_b"')), line, *[F.concat(F.lit("--=_b"), line, x) for x in parts], F.lit("--=_b--"), line)
    file = F.concat(F.when(k % 8 == 3, "resume").otherwise("a"), k.cast("string"), F.lit(".pdf"))
    attached = F.concat(header("Content-Type", F.lit("application/pdf")), header("Content-Disposition", F.concat(F.lit('attachment; filename="'), file, F.lit('"'))), header("Content-Transfer-Encoding", F.lit("base64")), line, F.lit("AAAA"), line)
    plain = part("plain", F.col("body_text"))
    content = F.when(k % 4 == 0, plain).when(k % 4 == 1, several("alternative", plain, part("html", page))).when(k % 4 == 2, part("html", page)).otherwise(several("mixed", plain, attached))
    path = F.concat(F.lit("c"), F.col("conv").cast("string"), F.lit("/t"), F.col("turn").cast("string"), F.lit(".eml"))
    return rows.select(path.alias("path"), F.encode(F.concat(head, content), "UTF-8").alias("content"))
