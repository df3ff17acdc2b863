from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corrmail.functions import privacy, text
from corrmail.operators import entities, folders
from corrmail.sources import mailbox


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in row.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("subject", "normal"),
    [
        ("Re: Hello", "hello"),
        ("RE: Re: 回复：转发: Hello  World ", "hello world"),
        ("【Re: x】", "re: x"),
        ("Ｈｉ　there", "hi there"),
        ("(topic) - ", "topic"),
        ("", ""),
        (None, ""),
    ],
)
def test_normalize_subject(spark, subject, normal):
    assert value(spark, text.normalize_subject("s"), s=subject) == normal


def test_prefixes(spark):
    assert value(spark, text.has_reply_prefix("s"), s="回复：x") is True
    assert value(spark, text.has_reply_prefix("s"), s="Report: x") is False
    assert value(spark, text.has_forward_prefix("s"), s="fw: x") is False
    assert value(spark, text.has_forward_prefix("s"), s="FW: x") is True
    assert value(spark, text.subject_prefix("s"), s="Re: topic") == "Re: "


def test_similarity(spark):
    assert value(spark, text.subjects_similar("a", "b"), a="Re: 研究计划", b="研究计划") is True
    assert value(spark, text.subjects_similar("a", "b"), a="", b="") is False
    assert value(spark, text.subjects_similar("a", "b", 0.6), a="abcdef", b="uvwxyz") is False


@pytest.mark.parametrize(
    ("body", "new", "quoted"),
    [
        ("new text\n> old", "new text", "> old"),
        ("好的\n--- 原始邮件 ---\nold", "好的", "--- 原始邮件 ---\nold"),
        ("a\nFrom: x\nb", "a", "From: x\nb"),
        ("> only", "", "> only"),
        ("plain", "plain", ""),
        (None, "", ""),
    ],
)
def test_quotes(spark, body, new, quoted):
    assert value(spark, text.new_content("b"), b=body) == new
    assert value(spark, text.quoted_content("b"), b=body) == quoted


def test_evidence_keeps_order_and_count(spark):
    body = "欢迎报名甲。无关的句子！欢迎报名乙；欢迎报名丙. 欢迎报名丁\n欢迎报名戊。欢迎报名己"
    assert value(spark, text.evidence("b", ["欢迎报名"]), b=body) == [f"欢迎报名{x}" for x in "甲乙丙丁戊"]


def test_guards(spark):
    for raw, safe in (("=SUM(A1)", "'=SUM(A1)"), ("+1", "'+1"), ("-1", "'-1"), ("@x", "'@x"), ("x", "x")):
        assert value(spark, text.formula_guard("s"), s=raw) == safe


def test_masks(spark):
    assert value(spark, privacy.mask_phone("s"), s="call 13812345678 now") == "call ***手机号*** now"
    assert value(spark, privacy.mask_national_id("s"), s="id 11010119900101123X.") == "id ***身份证号***."
    assert value(spark, privacy.mask_emails("s", ["me@x.cn"]), s="a long.name@x.cn, ab@y.org and Me@x.cn") == "a l***@x.cn, ***@y.org and Me@x.cn"
    assert value(spark, privacy.mask_emails("s"), s="none") == "none"
    assert value(spark, privacy.warnings("s"), s="13812345678 a@b.cn c@d.cn") == ["包含手机号码", "包含 2 个邮箱地址"]
    cut = value(spark, privacy.prepared("s", most=5), s="abcdefgh")
    assert cut.startswith("abcde\n") and len(cut) > 5


def test_letters_and_numbers_of_an_address(spark):
    """Letters and numbers of any kind belong to an address, marks and joiners end it; a mask in front does not hide it."""
    for raw, safe in (("e\u0301lan.x@m.cn", "e\u0301l***@m.cn"), ("①②③④@m.cn", "①***@m.cn"), ("x²y@m.cn", "x***@m.cn"), ("a‿bcd@m.cn", "a‿b***@m.cn"), ("***地址***04@m.cn", "***地址******@m.cn")):
        assert value(spark, privacy.mask_emails("s"), s=raw) == safe
    assert value(spark, privacy.warnings("s"), s="½@m.cn \u0301@m.cn") == ["包含 1 个邮箱地址"]


def test_folders(spark):
    kind = lambda name, flags: value(spark, folders.folder_type(F.col("n"), F.col("f")), n=name, f=flags)
    assert kind("whatever", ["\\HasNoChildren", "\\Junk"]) == "spam"
    assert kind("Presentations", []) == "sent"
    assert kind("收件箱", []) == "inbox"
    assert kind("work", []) == "other"


def test_recipients(spark):
    assert value(spark, entities.recipients(F.col("t")), t="A <A@x.cn>; b@y.cn") == ["a@x.cn"]
    assert value(spark, entities.recipients(F.col("t")), t="b@y.cn, C@z.cn") == ["b@y.cn", "c@z.cn"]
    assert value(spark, entities.recipients(F.col("t")), t=None) == []


def test_names_and_institutions(spark):
    assert value(spark, entities.name_in_recipients(F.col("t"), F.lit("a@x.cn")), t='"Wang" <A@x.cn>; <b@y.cn>') == "Wang"
    assert value(spark, entities.name_in_salutation(F.col("b")), b="尊敬的王教授：您好") == "王教授"
    assert value(spark, entities.institution_in_text(F.col("t")), t="我是某某大学的学生，想申请东方大学的课题") in ("东方大学", "申请东方大学")
    rows = spark.createDataFrame([("a@cs.zju.edu.cn",), ("b@zzz.edu.cn",), ("c@ict.ac.cn",), ("d@x.com",)], "email string")
    got = {r.email: r.institution for r in entities.institution_of_domain(rows).collect()}
    assert got == {"a@cs.zju.edu.cn": "浙江大学", "b@zzz.edu.cn": "ZZZ", "c@ict.ac.cn": "中国科学院", "d@x.com": ""}


def test_folder_names_round_trip():
    for name in ("INBOX", "已发送", "A&B", "草稿箱/sub"):
        assert mailbox.decode_folder_name(mailbox.encode_folder_name(name)) == name
    assert mailbox.encode_folder_name("A&B") == "A&-B"


def test_protocol_lines(spark):
    got = value(spark, mailbox.list_line(F.col("l")), l='(\\HasNoChildren \\Sent) "/" "Sent Messages"')
    assert got.name == "Sent Messages" and got.flags == ["\\HasNoChildren", "\\Sent"]
    got = value(spark, mailbox.folder_status(F.col("l")), l='"INBOX" (MESSAGES 12 UIDNEXT 99 UIDVALIDITY 7)')
    assert (got.messages, got.uidvalidity, got.uidnext) == (12, 7, 99)


def test_log_lines_hide_secrets():
    import logging

    from corrmail.functions.privacy import Redacted

    record = logging.LogRecord("x", 20, "f", 1, "Password: x1 TOKEN=%s sk-ABCDEFGHIJKL 13812345678", ("y2",), None)
    Redacted().filter(record)
    assert record.getMessage() == "Password=***REDACTED*** TOKEN=***REDACTED*** ***API_KEY*** ***PHONE***"
