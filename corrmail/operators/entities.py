"""Correspondents: whom outreach mail went to, with name, institution and counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corrmail.functions import lexicon as L
from corrmail.functions.text import contains_any, normalize_email
from corrmail.operators.graph import checkpointed, components

#: Salutations that name somebody, and texts of review reasons.
SALUTATIONS = (r"(?U)尊敬的\s*(\w{1,4})\s*(教授|老师|导师|研究员|博导)", r"(?U)(\w{1,4})\s*(教授|老师|导师|研究员|博导)\s*(?:您好|你好)")
#: A quoted name in a list of addresses; it may hold separators.
QUOTED = r'"(?:[^"\\]|\\.)*"'
#: Rows of a table of domains that go to every task; a longer one is joined without that.
FEW_DOMAINS = 100_000
#: Characters of a body that are looked at.
READ = 800
NO_NAME, NO_INSTITUTION = "无法确认导师姓名", "无法确认所属单位"
SAME_PLACE, OTHER_PLACE = "同姓名同单位，可能是同一导师使用多个邮箱", "同姓名但不同单位，可能是不同导师"


def recipients(to_text: Column) -> Column:
    """Addresses in angle brackets; only if there are none, bare ones between separators.  Quoted names are passed over."""
    text = F.regexp_replace(F.coalesce(to_text, F.lit("")), QUOTED, '""')
    bracketed = F.transform(F.regexp_extract_all(text, F.lit("<([^>]+)>"), F.lit(1)), lambda x: F.lower(F.trim(x)))
    bare = F.transform(F.split(text, "[;,]"), lambda x: F.lower(F.regexp_extract(x, r"(?U)[\w.+-]+@[\w.+-]+", 0)))
    return F.when(F.size(bracketed) > 0, bracketed).otherwise(F.filter(bare, lambda x: x != ""))


def institution_of_domain(rows: DataFrame, email: str = "email", out: str = "institution", domains: dict[str, str] | None = None) -> DataFrame:
    """Add the institution of an address: its domain or the domain's longest listed suffix, else a label of the domain.

    The list is a small dimension table (one row a domain) that joins on all suffixes of the address' domain.
    """
    listed = L.DOMAINS if domains is None else domains
    small = F.broadcast if len(listed) <= FEW_DOMAINS else (lambda df: df)
    spark = rows.sparkSession
    table = spark.createDataFrame(sorted(listed.items()) or [("", "")], "suffix string, place string")
    heads: dict[str, str] = {}
    for d, place in listed.items():
        heads.setdefault(d.split(".")[0], place)
    head_table = spark.createDataFrame(sorted(heads.items()) or [("", "")], "head string, head_place string")
    keys = rows.select(email).distinct().withColumn("domain", F.element_at(F.split(F.lower(F.trim(email)), "@"), -1))
    labels = F.split("domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    best = keys.select(email, F.explode(suffixes).alias("suffix")).join(small(table), "suffix").groupBy(email).agg(F.max_by("place", F.length("suffix")).alias("place"))
    label = F.element_at(F.split(F.replace("domain", F.lit(".edu.cn"), F.lit("")), r"\."), -1)
    found = keys.join(best, email, "left").withColumn("head", label).join(small(head_table), "head", "left")
    fallback = F.when(F.col("domain").contains(".edu.cn"), F.coalesce("head_place", F.upper("head"))).when(F.col("domain").contains(".ac.cn") | F.col("domain").contains(".cas.cn"), L.ACADEMY).otherwise("")
    return rows.join(found.select(email, F.coalesce("place", fallback).alias(out)), email, "left")


def institution_in_text(text: Column, stop_words: Sequence[str] = L.INSTITUTION_STOP_WORDS) -> Column:
    """The first institution that a text names and does not say of its own author; empty if none."""
    clean = reduce(lambda t, p: F.regexp_replace(t, p, ""), L.INSTITUTION_SELF, F.coalesce(text, F.lit("")))
    prefix = "^(?:(?:" + "|".join(L.INSTITUTION_PREFIXES) + r")\s*)+"
    names = F.concat(*[F.regexp_extract_all(clean, F.lit(p), F.lit(0)) for p in L.INSTITUTION_PATTERNS])
    names = F.transform(names, lambda x: F.regexp_replace(x, prefix, ""))
    kinds = ("大学", "学院", "研究所", "研究院")
    good = F.filter(names, lambda x: ~contains_any(x, stop_words) & (F.length(x) >= 4) & contains_any(x, kinds))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def name_in_recipients(to_text: Column, email: Column) -> Column:
    """The name before the address in a recipient list; null if there is none."""
    parts = F.regexp_extract_all(F.coalesce(to_text, F.lit("")), F.lit(rf'(?:{QUOTED}|[^,;"]|")+?(?=[,;]|$)'), F.lit(0))
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(x, rf"^[,;]?\s*({QUOTED}|[^<]*)\s*<", 1)), "^[\"']+|[\"']+$", ""), r'\\(["\\])', "$1")
    entries = F.transform(parts, lambda x: F.struct(F.lower(F.regexp_extract(F.regexp_replace(x, QUOTED, '""'), "<([^>]+)>", 1)).alias("a"), bare(x).alias("n")))
    named = F.filter(entries, lambda e: (F.trim(e.a) == email) & (F.trim(e.n) != "") & ~e.n.rlike(r"(?U)^[\w.+-]+@"))
    return F.trim(F.get(named, F.lit(0)).n)


def name_in_salutation(body: Column) -> Column:
    start = F.substring(F.coalesce(body, F.lit("")), 1, 500)
    hits = [F.concat(F.regexp_extract(start, p, 1), F.regexp_extract(start, p, 2)) for p in SALUTATIONS]
    return F.coalesce(*[F.when(h != "", h) for h in hits])


def contacts_by_recipient(messages: DataFrame) -> DataFrame:
    """Sent outreach messages, one row for each recipient of each (a recipient named twice counts twice)."""
    sent = messages.filter("is_contact and is_sent_by_me")
    return sent.withColumn("email", F.explode(recipients(F.col("to_text"))))


def correspondents(contacts: DataFrame, domains: dict[str, str] | None = None) -> DataFrame:
    """One row per recipient: name, institution, dates, count, confidence and reasons to review."""
    key = F.struct("date", "id")
    to_name, greeting = name_in_recipients(F.col("to_text"), F.col("email")), name_in_salutation(F.col("body_text"))
    text = F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.substring(F.coalesce("body_text", F.lit("")), 1, READ))
    rows = contacts.select("email", "id", F.coalesce("date", F.lit("")).alias("date"), to_name.alias("n1"), greeting.alias("n2"), institution_in_text(text).alias("place"))
    first_of = lambda c, holds: F.min_by(c, F.when(holds, key))
    sums = rows.groupBy("email").agg(
        F.coalesce(first_of("n1", F.col("n1").isNotNull()), first_of("n2", F.col("n2").isNotNull())).alias("found_name"),
        first_of("place", F.col("place") != "").alias("text_place"),
        F.coalesce(F.min(F.when(F.col("date") != "", F.col("date"))), F.lit("")).alias("first_sent_at"),
        F.max("date").alias("last_sent_at"),
        F.count("*").alias("send_count"),
    )
    named = institution_of_domain(sums, "email", "domain_place", domains)
    place = F.coalesce(F.when(F.col("domain_place") != "", F.col("domain_place")), F.col("text_place"), F.lit(""))
    reasons = F.array_compact(F.array(F.when(F.col("found_name").isNull(), NO_NAME), F.when(place == "", NO_INSTITUTION)))
    return named.select(
        "email",
        F.coalesce("found_name", F.substring_index("email", "@", 1)).alias("name"),
        place.alias("institution"),
        "first_sent_at",
        "last_sent_at",
        "send_count",
        F.when(F.size(reasons) > 0, 0.5).otherwise(0.8).alias("confidence"),
        (F.size(reasons) > 0).alias("needs_review"),
        reasons.alias("review_reasons"),
    )


def message_roles(contacts: DataFrame) -> DataFrame:
    """(email, id, role): the first message to a correspondent, follow-ups, supplements and answers."""
    nth = F.row_number().over(Window.partitionBy("email").orderBy("date", "id"))
    subject = F.lower(F.coalesce("subject", F.lit("")))
    more = subject.contains("补充") | F.lower(F.substring(F.coalesce("body_text", F.lit("")), 1, 200)).contains("补充")
    role = F.when(more, L.ROLES["supplement"]).when(nth == 1, L.ROLES["first"]).when(subject.contains("re:"), L.ROLES["reply"]).otherwise(L.ROLES["followup"])
    return contacts.select("email", "id", role.alias("role"))


def merge_aliases(links: DataFrame, aliases: DataFrame) -> DataFrame:
    """``links`` (email, ...) with each alias replaced by its primary address, over chains of aliases.

    ``aliases`` has (email, alias_email).  Of addresses that are connected, the one that is nobody's alias stands for
    all; where none is or several are, the first of them by name.
    """
    pairs = aliases.select(normalize_email("email").alias("b"), normalize_email("alias_email").alias("a")).filter("a != '' and b != '' and a != b").distinct()
    pairs = checkpointed(pairs)
    labels = components(pairs)
    tops = pairs.select(F.col("b").alias("id")).distinct().join(pairs.select(F.col("a").alias("id")), "id", "left_anti")
    chosen = labels.join(tops, "id").groupBy("label").agg(F.min("id").alias("top"))
    target = labels.join(chosen, "label", "left").select(F.col("id").alias("_alias"), F.coalesce("top", "label").alias("_primary"))
    joined = links.join(target, links.email == F.col("_alias"), "left")
    return joined.withColumn("email", F.coalesce("_primary", "email")).drop("_alias", "_primary")


def duplicate_names(people: DataFrame) -> DataFrame:
    """(name, n, emails, reason) of names that several correspondents have."""
    groups = people.filter("name != ''").groupBy("name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("email")).alias("emails"), F.array_sort(F.collect_set(F.coalesce("institution", F.lit("")))).alias("places"))
    one_place = (F.size("places") == 1) & (F.get("places", F.lit(0)) != "")
    return groups.filter("n > 1").select("name", "n", "emails", F.when(one_place, SAME_PLACE).otherwise(OTHER_PLACE).alias("reason"))


def merge_two(people: DataFrame, links: DataFrame, keep: str, remove: str) -> tuple[DataFrame, DataFrame]:
    """(people, links) after ``remove`` has become part of ``keep``: its links move, and the count of ``keep`` follows them."""
    moved = links.withColumn("email", F.when(F.col("email") == remove, keep).otherwise(F.col("email")))
    count = moved.filter(F.col("email") == keep).agg(F.count("*").alias("_sent"))
    rest = people.filter(F.col("email") != remove).join(F.broadcast(count))  # one row
    sent = F.when(F.col("email") == keep, F.col("_sent")).otherwise(F.col("send_count"))
    return rest.withColumn("send_count", sent).drop("_sent"), moved
