"""Queries over message files made from the driver's conversations, and over what an analysis is given besides messages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrmail.functions import lexicon as L
from corrmail.functions import privacy, text
from corrmail.operators import contacts, entities, folders, merge, replies, rules, threads
from corrmail.plans.analysis import analyze
from corrmail.plans.queries import BODY_WORDS, OPTIONS, RULES, SUBJECT_WORDS, _analysis, _messages, _table
from corrmail.operators.graph import checkpointed, shared_folder
from corrmail.operators.search import TextIndex
from corrmail.sources import archive, document, enrich, mailbox, mime, sinks
from corrmail.sources.adapters import MONTHS, OWNER, conversations_as_files
from corrmail.sources.tables import KeyedTable, clear_analysis, ranged
from corrmail.streaming import state


def _mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed message files, numbered by the message id (conversation and turn)."""
    parsed = mime.parse_messages(conversations_as_files(_table(spark, sf_dir, "conversations")))
    number = lambda k: F.regexp_extract("message_id", r"^<c(\d+)\.t(\d+)@x>$", k).cast("long")
    return mime.as_messages(parsed, OWNER).withColumn("id", number(1) * 100 + number(2) + 1)


def mail_headers(spark, sf_dir):
    return _mail(spark, sf_dir).select("id", "message_id", "in_reply_to", F.array_join("references", ",").alias("refs"), "date", "subject", "from_email", "from_name", "to_text", "cc_text")


def mail_bodies(spark, sf_dir):
    return _mail(spark, sf_dir).select("id", F.sha2(F.col("body_text").cast("binary"), 256).alias("body_hash"), "body_html_text", "has_attachments", "attachment_names", "attachment_types", "content_hash")


def mail_flags(spark, sf_dir):
    return _mail(spark, sf_dir).select("id", "is_sent_by_me", "is_auto_reply", "is_bounce", "is_system_notification")


def mail_contact_score(spark, sf_dir):
    rows = contacts.score_contacts(_mail(spark, sf_dir), SUBJECT_WORDS, BODY_WORDS)
    return rows.select("id", "is_contact", F.round("contact_confidence", 9).alias("confidence"))


def mail_threads(spark, sf_dir):
    return threads.build_threads(checkpointed(_mail(spark, sf_dir)), use_subject=False).select("id", "thread_id")


def thread_of_message(spark, sf_dir):
    rows = _mail(spark, sf_dir)
    tree = threads.build_threads(rows, use_subject=False)
    wanted = rows.filter("id % 10 = 3").select("message_id", "id")
    return wanted.join(tree, "id").select("message_id", "thread_id")


def _outreach(mail: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    links = mail.filter("is_sent_by_me").select(F.explode(entities.recipients(F.col("to_text"))).alias("email"), "id")
    people = links.select("email").distinct()
    return people, links, replies.sent_to(people, links, mail)


def mail_thread_replies(spark, sf_dir):
    mail = checkpointed(_mail(spark, sf_dir))
    people, _, sent = _outreach(mail)
    tree = threads.build_threads(mail, use_subject=False)
    return replies.detect_replies(people, sent, mail, tree).filter("reason = 'thread'").select("email", "id", "is_auto")


def mail_reference_replies(spark, sf_dir):
    mail = _mail(spark, sf_dir)
    people, _, sent = _outreach(mail)
    found = replies.detect_replies(people, sent, mail)
    return found.filter("reason in ('in_reply_to', 'references')").select("email", "id", "reason", "is_auto")


def mail_other_addresses(spark, sf_dir):
    mail = checkpointed(_mail(spark, sf_dir))
    people, _, sent = _outreach(mail)
    tree = threads.build_threads(mail, use_subject=False)
    return replies.other_addresses(replies.detect_replies(people, sent, mail, tree), mail).select("email", "address")


def mail_joined_addresses(spark, sf_dir):
    """The addresses of each person, and how many messages answer for them once all addresses are known."""
    mail = checkpointed(_mail(spark, sf_dir))  # each round reads it
    people, _, sent = _outreach(mail)
    found, known = replies.detect_with_addresses(people, sent, mail, threads.build_threads(mail, use_subject=False))
    every = replies.all_addresses(people, known).groupBy("email").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "address"))), lambda x: x.address), "; ").alias("emails"))
    return every.join(found.filter("not is_auto").groupBy("email").agg(F.count("*").alias("n_replies")), "email", "left").fillna(0, ["n_replies"])


def mail_match_methods(spark, sf_dir):
    return threads.build_threads(_mail(spark, sf_dir), use_subject=False).select("id", "match_method")


def arriving_threads(spark, sf_dir):
    """Threads of two thirds of the mail, extended when the last third arrives."""
    mail = checkpointed(_mail(spark, sf_dir))
    stored, new = mail.filter("id % 3 > 0"), mail.filter("id % 3 = 0")
    tree = threads.build_threads(stored, use_subject=False).select("id", "thread_id")
    changed = threads.extended_threads(tree, stored, new, use_subject=False)
    return tree.join(changed, "id", "left_anti").unionByName(changed)


def recipient_names(spark, sf_dir):
    rows = _mail(spark, sf_dir).filter("is_sent_by_me").withColumn("email", F.element_at(entities.recipients(F.col("to_text")), 1))
    return rows.select("id", "email", entities.name_in_recipients(F.concat(F.lit("X <x@y.z>, "), F.col("to_text")), F.col("email")).alias("name"))


def institution_text(spark, sf_dir):
    said = ("我是山东大学的学生，想申请清华大学的项目", "联系北京大学计算机学院", "向中国科学院自动化研究所申请", "没有单位", "毕业于南京大学，报考浙江大学")
    line = F.element_at(F.array(*[F.lit(x) for x in said]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", entities.institution_in_text(line).alias("institution"))


#: Parts of made-up sentences: who writes, what they want, and where.
OPENERS = ("我是山东大学的学生，", "毕业于南京大学，", "", "您好，", "本人就读于复旦大学计算机学院，", "近期在浙江大学学习，了解到")
VERBS = ("想申请", "联系", "向", "报考", "给")
PLACES = ("清华大学", "中国科学院自动化研究所", "上海人工智能研究院", "北京大学计算机学院", "某实验室", "我毕业于武汉大学的母校", "东南大学和同济大学", "小学院")


def institution_varied(spark, sf_dir):
    """Sentences of every combination of opener, verb and place, with a name behind them."""
    pick = lambda words, step: F.element_at(F.array(*[F.lit(x) for x in words]), (F.floor(F.col("p_partkey") / step) % len(words) + 1).cast("int"))
    said = F.concat(pick(OPENERS, 1), pick(VERBS, len(OPENERS)), pick(PLACES, len(OPENERS) * len(VERBS)), F.lit(" "), F.col("p_name"))
    return _table(spark, sf_dir, "part").select("p_partkey", entities.institution_in_text(said).alias("institution"))


#: Parts of salutations, with and without one, and names that do not fit.
GREETINGS = ("尊敬的", "尊敬的 ", "老师们，", "", "Dear ")
NAMES = ("王伟", "欧阳锋教授的", "李", "Müller", "张三李四王五", "")
TITLES = ("教授", " 老师您好", "导师 你好", "研究员：", "博导您好", "同学")


def salutation_names(spark, sf_dir):
    """Greetings of every combination, with a text behind them."""
    pick = lambda words, step: F.element_at(F.array(*[F.lit(x) for x in words]), (F.floor(F.col("p_partkey") / step) % len(words) + 1).cast("int"))
    body = F.concat(pick(GREETINGS, 1), pick(NAMES, len(GREETINGS)), pick(TITLES, len(GREETINGS) * len(NAMES)), F.lit("，"), F.col("p_name"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.coalesce(entities.name_in_salutation(body), F.lit("")).alias("name"))


def subject_prefix(spark, sf_dir):
    mark = F.element_at(F.array(*[F.lit(x) for x in ("Re: ", "RE：", "Fwd: ", "转发: ", "回复：", "", "Re ")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", text.stripped(text.subject_prefix(F.concat(mark, "p_name"))).alias("prefix"))


def folder_lines(spark, sf_dir):
    lines = ('* LIST (\\HasNoChildren \\Sent) "/" "Sent Items"', "* LIST (\\Noselect) / INBOX", '* LIST () "." "&g0l6P3ux-"', "* LIST (\\Trash) NIL Old mail")
    line = F.element_at(F.array(*[F.lit(x) for x in lines]), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", mailbox.list_line(line).alias("x")).select("p_partkey", F.array_join("x.flags", " ").alias("flags"), "x.delimiter", F.col("x.name").alias("raw_name"))
    return mailbox.with_folder_names(rows)


def folder_states(spark, sf_dir):
    n = F.col("p_partkey").cast("string")
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("STATUS x (messages "), n, F.lit(" UIDNEXT 7)"))).otherwise(F.concat(F.lit("STATUS x (UIDVALIDITY "), n, F.lit(")")))
    return _table(spark, sf_dir, "part").select("p_partkey", mailbox.folder_status(line).alias("x")).select("p_partkey", "x.*")


def folder_roles(spark, sf_dir):
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Sent ", "INBOX/", "misc")]), (F.col("p_partkey") % 3 + 1).cast("int")), "p_brand")
    return _table(spark, sf_dir, "part").select("p_partkey", folders.is_type(name, "sent").alias("is_sent"), folders.is_type(name, "inbox").alias("is_inbox"))


def folder_totals(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 4 == 0, "trash").otherwise("inbox").alias("folder_type"), F.col("p_size").alias("message_count"))
    return folders.totals(folders.default_scan(rows))


def datetime_format(spark, sf_dir):
    when = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.format_datetime(when).alias("shown"))


def mask_everything(spark, sf_dir):
    note = F.concat(F.lit("电话13812345678\n证件11010519491231002X\n住在北京市海淀区中关村大街一号楼\n写给 long.name@mail.example.com "), F.col("p_name"))
    return _table(spark, sf_dir, "part").select("p_partkey", privacy.mask_all(note).alias("masked"), privacy.prepared(note, most=20).alias("cut"))


def merge_of_two(spark, sf_dir):
    links = _table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("email"), F.col("o_orderkey").alias("id"))
    people = links.groupBy("email").agg(F.count("*").alias("send_count"))
    return entities.merge_two(people, links, "c1", "c4")[0]


def display_table(spark, sf_dir):
    shown = merge.display_table(_analysis(spark, sf_dir).merged)
    return shown.select("序号", "导师姓名", "学校/单位", "邮箱", "发送次数", "回复状态", "回复时间", "招生意向", "我是否回复", "建议行动", "置信度", "需要复核")


def export_preview(spark, sf_dir):
    return merge.preview(_analysis(spark, sf_dir).merged, "index").select("index", "email", "send_count")


def merged_with_logs(spark, sf_dir):
    """Overrides, a model's analyses and excluded people in the merged table."""
    email = "concat('p', id, '@d', id % 8, '.edu.cn') as email"
    at = "timestamp '2024-01-01 00:00:00' as created_at"
    pick = lambda where, field, value, seq: spark.range(40).where(where).selectExpr(email, f"'{field}' as field", f"{value} as value", at, f"{seq}L as seq")
    overrides = pick("id % 3 = 0", "name", "concat('Name ', id)", 1).union(pick("id % 6 = 0", "name", "concat('Newer ', id)", 2)).union(pick("id % 5 = 0", "action_required", "'Custom'", 3)).union(pick("id % 7 = 1", "status", f"'{L.UNSURE}'", 4))
    said = "'S' as summary", "'a|b' as evidence", f"'{L.INTENTS['WELCOME_JOIN']}' as intent", f"if(id % 8 = 1, 'unknown', '{L.ACTIONS['REPLY_NOW']}') as action", "'step' as step", "'Model' as responder", "if(id % 3 = 0, 0.2D, 0.95D) as confidence"
    analyses = spark.range(40).where("id % 4 = 1").selectExpr(email, *said, at, "1L as seq")
    excluded = spark.range(40).where("id % 10 = 7").selectExpr(email)
    merged = analyze(_messages(spark, sf_dir), OPTIONS, overrides=overrides, analyses=analyses, excluded=excluded).merged
    return merged.select("index", "email", "name", "has_real_reply", "responder", "admission_intent", "action_required", "confidence", "needs_review")


def _place(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as archives of 8-bit messages, in the narrowest of two charsets, and read again."""
    rows = _messages(spark, sf_dir)
    narrow = ~F.col("body_text").rlike(r"[^\x00-\xff]")
    charset = F.when(narrow, "iso-8859-1").otherwise("utf-8")
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.substring("date", 6, 2).cast("int"))
    date = F.concat(F.substring("date", 9, 2), F.lit(" "), month, F.lit(" 2024 "), F.substring("date", 12, 8), F.lit(" +0000"))
    head = F.concat(F.lit("Message-ID: "), F.col("id").cast("string"), F.lit("\nDate: "), date, F.lit("\nContent-Type: text/plain; charset="), charset, F.lit("\nContent-Transfer-Encoding: 8bit\n\n"))
    body = F.when(narrow, F.encode("body_text", "ISO-8859-1")).otherwise(F.encode("body_text", "UTF-8"))
    place = _place(spark, "mail")
    archive.write_archive(rows.select(F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\n"), "UTF-8")).alias("content")), place, rangeBytes=1 << 18)
    return archive.read_archive(spark, place)


def archive_bodies(spark, sf_dir):
    parsed = mime.parse_messages(_archived(spark, sf_dir).select(F.concat_ws("#", "file", "uid").alias("path"), "content"))
    return parsed.select(F.col("message_id").cast("long").alias("id"), F.sha2(F.col("body_text").cast("binary"), 256).alias("body_hash"))


def archive_of_a_month(spark, sf_dir):
    """The dates choose ranges of the files."""
    rows = _archived(spark, sf_dir).filter((F.col("sent_at") >= F.lit("2024-03-01").cast("timestamp")) & (F.col("sent_at") < F.lit("2024-04-01").cast("timestamp")))
    return rows.select(F.regexp_extract(F.decode(F.substring("content", 1, 60), "ISO-8859-1"), r"Message-ID: (\d+)", 1).cast("long").alias("id"), F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss").alias("sent"))


def keyed_changes(spark, sf_dir):
    """Customers as a stored table: new and known keys, columns left alone, an update, a deletion."""
    table = KeyedTable(spark, _place(spark, "people"), "k long, name string, segment string, orders long, last date", ["k"], ranged("k", size=256))
    people, orders = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    table.upsert(people.filter("c_custkey % 3 > 0").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    table.upsert(orders.groupBy(F.col("o_custkey").cast("long").alias("k")).agg(F.count("*").alias("orders"), F.max("o_orderdate").cast("date").alias("last"), F.lit("from orders").alias("name")), only=["orders", "last"])
    table.update(people.filter("c_nationkey = 5").select(F.col("c_custkey").cast("long").alias("k")), segment=F.lower("segment"), orders=F.coalesce("orders", F.lit(0)) + 1)
    table.delete(people.filter("c_acctbal < 0").select(F.col("c_custkey").cast("long").alias("k")))
    return table.read()


def clear_account(spark, sf_dir):
    """What is left of people and their messages when the analysis of one account is cleared."""
    people = KeyedTable(spark, _place(spark, "people"), "k long, account_id long", ["k"], ranged("k", size=256))
    links = KeyedTable(spark, _place(spark, "links"), "id long, person long", ["id"], ranged("id", size=4096))
    people.upsert(_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_nationkey").cast("long").alias("account_id")))
    links.upsert(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("person")))
    clear_analysis(spark, 3, {links: (people, "person", "k")})
    return people.read().select(F.lit("person").alias("kind"), F.col("k").alias("id")).unionByName(links.read().select(F.lit("link").alias("kind"), "id"))


def sync_epochs(spark, sf_dir):
    """Events as messages of five folders that arrive in two runs; folder 2 begins a new epoch in the first of them."""
    schema = "account_id long, folder_id long, listed long, uidvalidity long, uid long, body string"
    folder, odd = F.col("user_id") % 5, F.col("event_id") % 2 == 1
    events = _table(spark, sf_dir, "events").select(F.lit(1).cast("long").alias("account_id"), folder.cast("long").alias("folder_id"), F.when(odd, 2).otherwise(1).cast("long").alias("listed"), F.when((folder == 2) & odd, 8).otherwise(7).cast("long").alias("uidvalidity"), F.col("event_id").cast("long").alias("uid"), F.col("event_type").alias("body"))
    landing, checkpoint = _place(spark, "landing"), _place(spark, "sync")
    messages, marks = state.message_table(spark, _place(spark, "messages"), schema), state.mark_table(spark, _place(spark, "marks"))
    for rows in (events.filter("uid % 3 > 0"), events):  # the second run lists all again
        rows.write.mode("append").parquet(landing)
        state.run_sync(spark.readStream.schema(schema).parquet(landing), messages, marks, checkpoint, partitions=8).awaitTermination()
    return state.current(messages, marks).select("folder_id", "uidvalidity", "uid", "body")


def json_file(spark, sf_dir):
    """The analysis as one JSON document, read back."""
    found, place = _analysis(spark, sf_dir), _place(spark, "export") + ".json"
    document.write_json_file(found.merged, found.statistics, place)
    whole = spark.read.option("multiLine", "true").json(place)
    rows = whole.select("stats.correspondent_count", F.explode("teachers").alias("t"))
    return rows.select("correspondent_count", "t.index", "t.email", "t.name", "t.emails", "t.send_count", "t.has_real_reply", "t.admission_intent", "t.action_required", "t.confidence")


def csv_file(spark, sf_dir):
    """The analysis as one CSV file, read back in its order."""
    frame, place = sinks.export_frame(_analysis(spark, sf_dir).merged, labels=False), _place(spark, "export") + ".csv"
    document.write_csv_file(frame, place, order="index")
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(place)
    return rows.select(F.col("index").cast("long").alias("index"), "emails", "name", "institution", "send_count", "has_real_reply", "admission_intent", "needs_review")


def model_answers(spark, sf_dir):
    """A model that fails on every third text, asked in two runs; the second has answers for half of the rest."""
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("email"), F.concat(F.lit("part "), F.col("p_partkey").cast("string"), F.lit(": "), F.col("p_name")).alias("bundle"))

    def model(texts):
        numbers = texts.str.extract(r"part (\d+)")[0].astype(int)
        if (numbers % 3 == 0).any():
            raise RuntimeError("no answer")
        return '{"reply_summary": "no. ' + numbers.astype(str) + '", "confidence": 0.' + (numbers % 10).astype(str) + "}"

    answers = enrich.answer_table(spark, _place(spark, "answers"))
    enrich.analyze_with_model(rows.filter("email % 2 = 0"), model, answers=answers, tries=1)
    return enrich.analyze_with_model(rows, model, answers=answers, tries=1).select("email", "summary", "confidence")


def indexed_search(spark, sf_dir):
    """Turns of conversations that say "tion a", found by posting lists."""
    rows = _table(spark, sf_dir, "conversations")
    rows = rows.select((F.col("conv_id") * 100 + F.col("turn")).cast("long").alias("id"), "role", "text")
    index = TextIndex(spark, _place(spark, "postings"), "id", ("id", "role", "text"))
    index.write(rows)
    return index.search(rows, "Tion a").select("id", "role")


def rule_summaries(spark, sf_dir):
    """Summary and evidence of bodies of every kind: with a reply, doubtful, without one, blank."""
    rows = _messages(spark, sf_dir).select("id", F.when(F.col("id") % 7 == 0, " \n").otherwise(F.col("body_text")).alias("reply_body"), F.when(F.col("id") % 5 == 0, L.NO).when(F.col("id") % 5 == 1, L.UNSURE).otherwise(L.YES).alias("status"), F.lit(L.NOT_REPLIED).alias("my_status"))
    ruled = rules.classify(rows, rules=RULES)
    return ruled.select("id", "rule_summary", F.array_join("rule_evidence", "|").alias("evidence"), "rule_next_step")


def sent_by_date(spark, sf_dir):
    return folders.mail_by_date(_mail(spark, sf_dir).select("id", "date", "is_sent_by_me", "account_id"), sent=True, account_id=1).select("place", "id", "date")


def alias_file(spark, sf_dir):
    """A list of aliases as a CSV file with a byte order mark, read back."""
    k = F.col("c_custkey").cast("string")
    rows = _table(spark, sf_dir, "customer").select(F.concat(F.col("c_name"), F.lit(', "Prof."')).alias("teacher_name"), F.concat(F.lit("p"), k, F.lit("@x.cn")).alias("email"), F.concat(F.lit("q"), k, F.lit("@y.cn")).alias("alias_email"), F.col("c_mktsegment").alias("notes"))
    place = _place(spark, "aliases") + ".csv"
    document.write_csv_file(rows, place)
    return mailbox.read_aliases(spark, place)


def merged_details(spark, sf_dir):
    """The columns of the summary table that merged_table leaves out: addresses, summary, evidence and next step."""
    return _analysis(spark, sf_dir).merged.select("index", "email", "emails", "reply_summary", "evidence", "recommended_next_step")


def display_texts(spark, sf_dir):
    """All thirteen columns on screen."""
    return merge.display_table(_analysis(spark, sf_dir).merged)


def export_texts(spark, sf_dir):
    """All nineteen columns of the export, as guarded text."""
    return sinks.export_frame(_analysis(spark, sf_dir).merged, labels=False).withColumnRenamed("index", "row")
