"""Outreach scoring: which messages contact somebody new, how sure that is and why."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrmail.functions import lexicon as L
from corrmail.functions import text as T

#: Patterns of outreach subjects, ranks and introductions; weights and bounds of the score.
SUBJECT_PATTERN = r"【?硕士?保研自荐】?.{0,10}(大学|学院|研究).{0,10}(专业|方向|工程|科学)"
RANK_PATTERN = r"(?U)(专业前|排名|前)\s*[\d.]+[%％]?|排名\s*\d+\s*/\s*\d+"
INTRO_PATTERNS = (r"我是.{0,20}(大学|学院|专业)", r"(本科|在读).{0,10}(学生|同学)", r"(?U)(成绩|绩点|GPA).{0,10}[\d.]", r"自荐|自我介绍|个人简介")
SURE, POSSIBLE, NO_REVIEW = 0.4, 0.2, 0.6


def score_contacts(messages: DataFrame, subject_words: Sequence[str] = L.SUBJECT_KEYWORDS, body_words: Sequence[str] = L.BODY_KEYWORDS, domains: Sequence[str] = L.ACADEMIC_DOMAINS) -> DataFrame:
    """Add ``is_contact``, ``contact_confidence``, ``contact_review`` and ``contact_reasons``.

    Each sign adds its weight, in a fixed order, so equal messages get equal sums to the last bit.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    subject, normal, body = text("subject"), text("subject_normalized"), text("body_text")
    in_subject = F.array_compact(F.array(*[F.when(F.lower(subject).contains(w.lower()) | F.lower(normal).contains(w.lower()), F.lit(w)) for w in subject_words]))
    in_body = T.found_words(F.lower(F.substring(body, 1, 1000)), body_words)
    intro, rank = F.substring(body, 1, 800), F.substring(body, 1, 500)
    names = F.lower(text("attachment_names"))
    resume = flag("has_attachments") & T.contains_any(names, L.RESUME_WORDS)
    introduces = F.lit(False)
    for p in INTRO_PATTERNS:
        introduces = introduces | intro.rlike(p)
    first3 = lambda label, words: F.concat(F.lit(label), F.array_join(F.slice(words, 1, 3), ", "))
    weight = lambda n, each, most: F.least(n * F.lit(each), F.lit(most))
    signs: list[tuple[Column, Column | float, Column | str]] = [
        (F.size(in_subject) > 0, weight(F.size(in_subject), 0.15, 0.45), first3("主题包含关键词: ", in_subject)),
        (subject.rlike(SUBJECT_PATTERN), 0.3, "主题匹配典型套磁格式"),
        (subject.rlike(RANK_PATTERN) | rank.rlike(RANK_PATTERN), 0.1, "包含专业排名信息"),
        (F.size(in_body) > 0, weight(F.size(in_body), 0.08, 0.3), first3("正文包含关键词: ", in_body)),
        (introduces, 0.08, "正文包含身份介绍"),
        (resume, 0.15, "附件包含简历"),
        (flag("has_attachments") & ~resume & (names != ""), 0.05, "包含附件"),
        (flag("is_sent_by_me") & T.is_academic("to_text", domains), 0.1, "发送至学术机构邮箱"),
        (flag("is_sent_by_me"), 0.05, "由当前用户发送"),
    ]
    score, reasons = F.lit(0.0), []
    for holds, points, reason in signs:
        score = score + F.when(holds, F.lit(points) if isinstance(points, float) else points).otherwise(0.0)
        reasons.append(F.when(holds, F.lit(reason) if isinstance(reason, str) else reason))
    bounce, auto, system = flag("is_bounce"), flag("is_auto_reply"), flag("is_system_notification")
    score = F.when(bounce, 0.0).when(auto, score * 0.3).when(system, score * 0.5).otherwise(score)
    less = F.when(auto, "自动回复（降低置信度）").when(system, "系统通知（降低置信度）")
    scored = messages.withColumn("_score", score).withColumn("_reasons", F.when(bounce, F.array(F.lit("退信"))).otherwise(F.array_compact(F.array(*reasons, less))))
    s = F.col("_score")
    doubtful = (s >= POSSIBLE) & (s < SURE)
    out = scored.withColumn("is_contact", s >= POSSIBLE).withColumn("contact_confidence", F.least(s, F.lit(1.0)))
    out = out.withColumn("contact_review", F.col("is_contact") & (s < NO_REVIEW))
    out = out.withColumn("contact_reasons", F.when(doubtful, F.array_append("_reasons", F.lit("低置信度，需人工确认"))).otherwise(F.col("_reasons")))
    return out.drop("_score", "_reasons")
