from __future__ import annotations

from email.header import Header
from email.message import EmailMessage

from corrmail.sources import mailbox, mime
from corrmail.streaming import sync

OWNER = "student@mail.cn"


def message(subject="Topic", body="text", sender="Wang <wang@uni.edu.cn>", to=f"Me <{OWNER}>", headers=None, html=None, files=()):
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Message-ID"], m["Date"] = subject, sender, to, "<1@x>", "Mon, 06 May 2024 10:00:00 +0800"
    for k, v in (headers or {}).items():
        m[k] = v
    m.set_content(body)
    if html:
        m.add_alternative(html, subtype="html")
    for name in files:
        m.add_attachment(b"x", maintype="application", subtype="pdf", filename=name)
    return m.as_bytes()


def test_fields():
    got = mime.parse_message(message("Re: 你好", "正文", headers={"References": "<a@x>  <b@x>", "In-Reply-To": "<a@x>"}))
    assert (got["subject"], got["from_email"], got["from_name"], got["date"]) == ("Re: 你好", "wang@uni.edu.cn", "Wang", "2024-05-06T10:00:00+08:00")
    assert got["references"] == ["<a@x>", "<b@x>"] and got["in_reply_to"] == "<a@x>" and got["body_text"].strip() == "正文"


def test_gbk_and_html():
    raw = b"Subject: " + Header("中文主题", "gbk").encode().encode() + b"\nFrom: a@b.cn\nContent-Type: text/html; charset=gbk\n\n" + "<p>你好</p><script>x</script>".encode("gbk")
    got = mime.parse_message(raw)
    assert got["subject"] == "中文主题" and got["body_text"] == "你好"


def test_flags_and_attachments():
    assert mime.parse_message(message(headers={"Auto-Submitted": "auto-replied"}))["is_auto_reply"]
    assert mime.parse_message(message("自动回复：外出"))["is_auto_reply"]
    assert mime.parse_message(message(sender="Mail <mailer-daemon@x.cn>"))["is_bounce"]
    assert mime.parse_message(message(sender="noreply@x.cn"))["is_system_notification"]
    plain = mime.parse_message(message())
    assert not (plain["is_auto_reply"] or plain["is_bounce"] or plain["is_system_notification"])
    assert [x["name"] for x in mime.parse_message(message(files=["cv.pdf"]))["attachments"]] == ["cv.pdf"]
    assert mime.date_text("not a date") == "not a date"


def test_sync_is_incremental_and_keeps_bad_files(spark, tmp_path):
    landing, table, errors, state = (str(tmp_path / x) for x in ("in", "table", "errors", "state"))
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.eml").write_bytes(message(f"s{k}"))
    run = lambda: sync.sync_folder(spark, landing, table, errors, state, OWNER).awaitTermination()
    run()
    assert spark.read.parquet(table).count() == 3
    (tmp_path / "in" / "3.eml").write_bytes(message("s3", sender=f"Me <{OWNER}>"))
    run()
    run()
    rows = spark.read.parquet(table)
    assert rows.count() == 4 and rows.filter("is_sent_by_me").count() == 1
    again = sync.stored(spark, table).limit(4)
    for _ in range(2):  # a batch that runs again replaces what it wrote
        sync.store_batch(again, str(tmp_path / "again"), "1-1", 3)
    assert sync.stored(spark, str(tmp_path / "again")).count() == 4


def test_new_rows_and_epochs(spark):
    state = spark.createDataFrame([(1, 1, 7, 5), (1, 2, 7, 5)], "account_id long, folder_id long, uidvalidity long, last_sync_uid long")
    rows = spark.createDataFrame([(1, 1, 7, 5), (1, 1, 7, 6), (1, 1, 7, 6), (1, 2, 8, 1), (1, 3, 1, 1)], "account_id long, folder_id long, uidvalidity long, uid long")
    fresh = sync.new_rows(rows, state)
    assert sorted(map(tuple, fresh.collect())) == [(1, 1, 7, 6), (1, 2, 8, 1), (1, 3, 1, 1)]
    after = sync.next_state(fresh, state)
    assert sorted(map(tuple, after.collect())) == [(1, 1, 7, 6), (1, 2, 8, 1), (1, 3, 1, 1)]
    assert sync.current_rows(rows, after).count() == 5
    two = spark.createDataFrame([(1, 1, 7, 501), (1, 1, 8, 1), (1, 1, 8, 2)], "account_id long, folder_id long, uidvalidity long, uid long")
    assert [tuple(r) for r in sync.next_state(two, state.filter("folder_id = 1")).collect()] == [(1, 1, 8, 2)]


def test_mbox_and_aliases(spark, tmp_path):
    one = message("first", "body\n>From here")
    (tmp_path / "a.mbox").write_bytes(b"From a@b Mon\n" + one + b"\nFrom c@d Tue\n" + message("second") + b"\n")
    got = mime.parse_messages(mailbox.read_mbox(spark, str(tmp_path / "a.mbox"))).select("subject").collect()
    assert sorted(r[0] for r in got) == ["first", "second"]
    (tmp_path / "alias.csv").write_text("﻿teacher_name,institution,email,alias_email,notes\nW,U,a@x.cn,b@y.cn,\n", encoding="utf-8")
    row = mailbox.read_aliases(spark, str(tmp_path / "alias.csv")).first()
    assert (row.teacher_name, row.alias_email) == ("W", "b@y.cn")


def test_sync_of_several_folders_keeps_a_log(spark, tmp_path):
    landings = {}
    for folder in (1, 2, 3):
        (tmp_path / f"in{folder}").mkdir()
        for k in range(folder):
            (tmp_path / f"in{folder}" / f"{k}.eml").write_bytes(message(f"s{k}"))
        landings[folder] = str(tmp_path / f"in{folder}")
    got = sync.sync_folders(spark, landings, str(tmp_path / "base"), OWNER)
    assert (got["status"], got["folders"], got["stored"], got["errors"]) == ("completed", 3, 6, 0)
    assert sync.sync_folders(spark, landings, str(tmp_path / "base"), OWNER)["stored"] == 0
    calls = iter([False, True])
    assert sync.sync_folders(spark, landings, str(tmp_path / "base"), OWNER, cancelled=lambda: next(calls))["status"] == "cancelled"
    runs = spark.read.parquet(str(tmp_path / "base" / "runs"))
    assert runs.count() == 3 and {r.status for r in runs.collect()} == {"completed", "cancelled"}


def test_names_with_separators_come_back(spark):
    from pyspark.sql import functions as F

    from corrmail.operators.entities import name_in_recipients, recipients

    raw = message("x").replace(b"Subject:", b'To: "Wang; Li, Jr." <W@pku.edu.cn>, plain@x.org, "A \\"B\\" <C>" <ab@x.org>, Prof. Q <q@x.org>\nSubject:', 1)
    parsed = mime.parse_messages(spark.createDataFrame([("p", bytearray(raw))], "path string, content binary"))
    row = mime.as_messages(parsed, OWNER).select("to_text", recipients(F.col("to_text")).alias("r"), *[name_in_recipients(F.col("to_text"), F.lit(a)).alias(a[:2]) for a in ("w@pku.edu.cn", "ab@x.org", "q@x.org")]).first()
    assert row.r == ["w@pku.edu.cn", "plain@x.org", "ab@x.org", "q@x.org"]
    assert (row["w@"], row["ab"], row["q@"]) == ("Wang; Li, Jr.", 'A "B" <C>', "Prof. Q")
