"""The summary table per correspondent, statistics over it, overrides and review."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corrmail.functions import lexicon as L
from corrmail.operators.graph import checkpointed

OVERRIDABLE = ("name", "institution", "status", "reply_summary", "admission_intent", "my_reply_status", "action_required")
BUCKETS = ("positive_intent", "welcome_apply", "suggest_camp", "willing_to_talk", "quota_uncertain", "polite_no_intent", "negative")
SURE_ENOUGH = 0.5


def _label(table: dict[str, str], code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), code)


def latest_analysis(log: DataFrame, key: str = "email", order: tuple[str, ...] = ("created_at", "seq")) -> DataFrame:
    """The last row of each key by ``order``: an aggregate, no sort of the log."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return last.select(key, "row.*")


def override_pivot(log: DataFrame, fields: tuple[str, ...] = OVERRIDABLE, newest: bool = True, key: str = "email", order: tuple[str, ...] = ("created_at", "seq")) -> DataFrame:
    """One row per key, one column per field: the newest (or oldest) value of a log (key, field, value, order)."""
    pick = F.max_by if newest else F.min_by
    when = lambda f: F.when(F.col("field") == f, F.struct(*order))
    return log.groupBy(key).agg(*[pick("value", when(f)).alias(f) for f in fields])


def merged_table(people: DataFrame, status: DataFrame, my_status: DataFrame, ruled: DataFrame, analyses: DataFrame | None = None, overrides: DataFrame | None = None, emails: DataFrame | None = None, excluded: DataFrame | None = None, index: bool = True) -> DataFrame:
    """The 19 columns of each correspondent, ordered by name in ``index``.

    A model's analysis replaces the rules' where it is surer.  Overrides (from ``override_pivot``) come last.
    """
    shown = ["email", "rule_summary", "rule_evidence", "rule_intent", "rule_action", "rule_next_step", "rule_confidence"]
    rows = people.join(status, "email").join(my_status.select("email", "my_status"), "email").join(ruled.select(shown), "email")
    rows = rows.withColumn("intent", _label(L.INTENTS, F.col("rule_intent"))).withColumn("action", _label(L.ACTIONS, F.col("rule_action")))
    rows = rows.withColumnsRenamed({"rule_summary": "summary", "rule_evidence": "proof", "rule_next_step": "step", "rule_confidence": "sure"})
    if analyses is not None:
        model = analyses.select("email", *[F.col(c).alias(f"ai_{c}") for c in ("summary", "evidence", "intent", "action", "step", "responder", "confidence")])
        rows = rows.join(model, "email", "left")
        better = F.coalesce(F.col("ai_confidence") > F.col("sure"), F.lit(False))
        valid = lambda c, table: F.col(c).isin(*table.values())
        rows = (
            rows.withColumn("summary", F.when(better, F.col("ai_summary")).otherwise(F.col("summary")))
            .withColumn("proof", F.when(better, F.split("ai_evidence", r"\|")).otherwise(F.col("proof")))
            .withColumn("intent", F.when(better & valid("ai_intent", L.INTENTS), F.col("ai_intent")).otherwise(F.col("intent")))
            .withColumn("action", F.when(better & valid("ai_action", L.ACTIONS), F.col("ai_action")).otherwise(F.col("action")))
            .withColumn("step", F.when(better, F.col("ai_step")).otherwise(F.col("step")))
            .withColumn("responder", F.when(better & (F.col("ai_responder") != ""), F.col("ai_responder")).otherwise(F.col("responder")))
            .withColumn("sure", F.when(better, F.col("ai_confidence")).otherwise(F.col("sure")))
        )
    if excluded is not None:
        rows = rows.join(excluded.select("email"), "email", "left_anti")
    if emails is None:
        rows = rows.withColumn("emails", F.col("email"))
    else:
        own = emails.groupBy("email").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "address"))), lambda x: x.address), "; ").alias("emails"))
        rows = rows.join(own, "email", "left").withColumn("emails", F.coalesce("emails", "email"))
    got = F.when(F.col("n_replies") > 0, F.concat(F.lit("，收到 "), F.col("n_replies").cast("string"), F.lit(" 封回复"))).otherwise("")
    rows = rows.withColumn("correspondence", F.concat(F.lit("发送 "), F.col("send_count").cast("string"), F.lit(" 封"), got))
    final = {"name": "name", "institution": "institution", "status": "status", "reply_summary": "summary", "admission_intent": "intent", "my_reply_status": "my_status", "action_required": "action"}
    if overrides is not None:
        rows = rows.join(overrides.select("email", *[F.col(f).alias(f"new_{f}") for f in OVERRIDABLE]), "email", "left")
        for f, c in final.items():
            rows = rows.withColumn(c, F.coalesce(f"new_{f}", c))
    doubt = F.col("needs_review") | (F.col("sure") < SURE_ENOUGH)
    out = rows.select(
        "email", "name", "institution", "emails", "first_sent_at", "last_sent_at", "send_count", "correspondence",
        F.col("status").alias("has_real_reply"), "reply_time", "responder", F.col("summary").alias("reply_summary"),
        F.array_join("proof", "; ").alias("evidence"), F.col("intent").alias("admission_intent"), F.col("my_status").alias("my_reply_status"),
        F.col("action").alias("action_required"), F.col("step").alias("recommended_next_step"), F.col("sure").alias("confidence"), doubt.alias("needs_review"),
    )
    return with_index(out) if index else out


def with_index(rows: DataFrame) -> DataFrame:
    """Number rows by (name, email) from 1."""
    return numbered(rows, ["name", "email"])


def numbered(rows: DataFrame, order: list[str], out: str = "index") -> DataFrame:
    """Number rows in an order from 1 without one sort of all: ranges are numbered and add what precedes them."""
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = checkpointed(ranged)
    starts = ranged.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_before"))
    return ranged.withColumn("_nth", inner).join(starts, "_part").withColumn(out, (F.col("_before") + F.col("_nth")).cast("long")).select(out, *rows.columns)


def statistics(merged: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """One row of counters; ``messages`` fills the counts of mail, which are 0 without it."""
    intent_bucket = {L.INTENTS[k]: v[2] for k, v in L.INTENT_ACTIONS.items() if v[2]}
    count = lambda holds: F.count_if(holds).cast("long")
    bucket = _label(intent_bucket, F.col("admission_intent"))
    sums = [
        F.count("*").cast("long").alias("correspondent_count"),
        count(F.col("has_real_reply") == L.YES).alias("replied_count"),
        count(~F.col("has_real_reply").isin(L.YES, L.NO)).alias("uncertain_count"),
        count(F.col("has_real_reply") == L.NO).alias("no_reply_count"),
        *[count(F.coalesce(bucket == b, F.lit(False))).alias(f"{b}_count") for b in BUCKETS],
        count(F.col("action_required") == L.ACTIONS["REPLY_NOW"]).alias("need_reply_now_count"),
        count(F.col("action_required") == L.ACTIONS["CONSIDER_FOLLOWUP"]).alias("suggest_followup_count"),
        count(F.col("needs_review")).alias("needs_review_count"),
    ]
    out = merged.agg(*sums)
    rate = F.coalesce(F.bround(F.try_divide(F.col("replied_count") * 100.0, F.col("correspondent_count")), 1), F.lit(0.0))
    total = F.col("replied_count") + F.col("no_reply_count") + F.col("uncertain_count")
    out = out.withColumn("reply_rate", rate).withColumn("consistency_valid", total == F.col("correspondent_count"))
    wrong = F.concat(F.lit("数据一致性错误: "), total.cast("string"), F.lit(" / "), F.col("correspondent_count").cast("string"))
    out = out.withColumn("consistency", F.when(F.col("consistency_valid"), "通过").otherwise(wrong))
    names = ("total_related_emails", "sent_emails", "received_reply_emails", "auto_reply_count", "bounce_count")
    if messages is None:
        return out.select(*[F.lit(0).cast("long").alias(n) for n in names], *out.columns)
    mail = messages.agg(
        F.count("*").cast("long").alias(names[0]),
        count(F.col("is_sent_by_me")).alias(names[1]),
        count(~F.col("is_sent_by_me") & ~F.col("is_auto_reply") & ~F.col("is_bounce")).alias(names[2]),
        count(F.col("is_auto_reply")).alias(names[3]),
        count(F.col("is_bounce")).alias(names[4]),
    )
    return mail.join(out, F.lit(True))  # one row each


def labelled_statistics(stats: DataFrame) -> DataFrame:
    """(label, value): the counters as rows."""
    pairs = F.array(*[F.struct(F.lit(label).alias("label"), F.col(c).cast("string").alias("value")) for c, label in L.STAT_LABELS.items()])
    return stats.select(F.inline(pairs))


#: The columns of the table on screen and their names there.
DISPLAYED = {
    "index": "序号",
    "name": "导师姓名",
    "institution": "学校/单位",
    "emails": "邮箱",
    "send_count": "发送次数",
    "has_real_reply": "回复状态",
    "reply_time": "回复时间",
    "reply_summary": "回复摘要",
    "admission_intent": "招生意向",
    "my_reply_status": "我是否回复",
    "action_required": "建议行动",
    "confidence": "置信度",
    "needs_review": "需要复核",
}


def display_table(merged: DataFrame) -> DataFrame:
    """The 13 columns that are shown, under their names on screen."""
    return merged.select(*[F.col(c).alias(name) for c, name in DISPLAYED.items()])


def preview(frame: DataFrame, order: str, most: int = 10) -> DataFrame:
    """The first rows of an export."""
    return frame.orderBy(order).limit(most)


def search(rows: DataFrame, query: str, status: str | None = None) -> DataFrame:
    """Rows that have ``query`` in any column, optionally of one status."""
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns]))
    found = rows.filter(text.contains(query.lower())) if query else rows
    return found.filter(F.col("has_real_reply") == status) if status else found


def review_queue(merged: DataFrame) -> DataFrame:
    """(email, why): rows to look at, once for each reason."""
    no_name = (F.col("name") == "") | F.col("name").contains("@")
    same = merged.filter("name != ''").groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name")
    kinds = F.array_compact(F.array(F.when(F.col("needs_review"), "flagged"), F.when(F.col("confidence") < SURE_ENOUGH, "low_confidence"), F.when(no_name, "no_name")))
    rows = merged.select("email", F.explode(kinds).alias("why"))
    return rows.union(merged.join(same, "name", "left_semi").select("email", F.lit("same_name").alias("why")))


def changed_fields(before: DataFrame, after: DataFrame, fields: tuple[str, ...], key: str = "email") -> DataFrame:
    """(key, field, old_value, new_value) of cells that an edited table changes."""
    new = after.select(key, *[F.col(f).cast("string").alias(f"new_{f}") for f in fields])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old_value"), F.col(f"new_{f}").alias("new_value")) for f in fields])
    rows = before.join(new, key).select(key, F.inline(cells))
    return rows.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def reply_bundle(replies: DataFrame, messages: DataFrame) -> DataFrame:
    """(email, bundle): the non-blank bodies of somebody's replies in the order of their dates."""
    rows = replies.filter("not is_auto").join(messages.select("id", "date", "body_text"), "id").filter("trim(coalesce(body_text, '')) != ''")
    ordered = F.array_sort(F.collect_list(F.struct("date", "id", "body_text")))
    return rows.groupBy("email").agg(F.array_join(F.transform(ordered, lambda x: x.body_text), "\n---\n").alias("bundle"))


def evidence_listing(links: DataFrame, messages: DataFrame, preview: int = 500) -> DataFrame:
    """Messages of each correspondent with role and the start of the body."""
    return links.join(messages, "id").select("email", "id", "role", "date", "subject", "from_email", F.substring(F.coalesce("body_text", F.lit("")), 1, preview).alias("preview"))
