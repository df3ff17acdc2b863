"""Queries over the driver's tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrmail.functions import lexicon as L
from corrmail.functions import privacy, text
from corrmail.operators import contacts, entities, folders, merge, replies, rules, threads
from corrmail.plans.analysis import Analysis, Options, analyze
from corrmail.plans.oracles import ORACLES
from corrmail.sources import mime, sinks
from corrmail.sources.adapters import OWNER, conversations_as_messages
from corrmail.streaming import sync

#: Word lists for invented prose: every branch of scorer and classifier is met.
SUBJECT_WORDS = ("the", "der", "que", "les")
BODY_WORDS = ("and", "und", "para", "dans", "ing")
RULES = L.ReplyRules(
    positive=("ation", "keit", "mente", "elle"),
    uncertain=("tion", "ung", "que"),
    negative=("rere", "schsch", "rrrr", "eauxeaux"),
    positive_intents=((("thation",), "ACCEPT_WITH_QUOTA"), (("keit",), "WELCOME_JOIN"), (("mente",), "ADDED_WECHAT"), (("elleou",), "WILLING_TO_TALK")),
    uncertain_intents=((("ntion",), "QUOTA_UNCERTAIN"), (("ungen",), "WAIT_POLICY")),
    negative_intents=((("rere",), "QUOTA_FULL"), (("schsch",), "DIRECTION_MISMATCH")),
)
DOMAINS = {f"d{k}.edu.cn": f"Institute {k}" for k in range(5)}
OPTIONS = Options(SUBJECT_WORDS, BODY_WORDS, RULES, DOMAINS)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations_as_messages(_table(spark, sf_dir, "conversations"))


def _analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    return analyze(_messages(spark, sf_dir), OPTIONS)


def subject_normalize(spark, sf_dir):
    return _messages(spark, sf_dir).select("id", "subject", "subject_normalized", text.has_reply_prefix("subject").alias("is_reply"), text.has_forward_prefix("subject").alias("is_forward"))


def fullwidth_fold(spark, sf_dir):
    wide = F.concat(F.lit("Ａ１（"), F.coalesce("text", F.lit("")), F.lit("）　ｚ"))
    return _table(spark, sf_dir, "documents").select("doc_id", text.half_width(wide).alias("folded"))


def subject_similarity(spark, sf_dir):
    rows = _messages(spark, sf_dir).filter("subject_normalized != ''").select("id", "from_email", "body_text", "subject_normalized")
    a, b = text.letters_of("subject_normalized"), text.letters_of("body_text")
    return rows.select("id", F.round(text.letter_jaccard(a, b), 6).alias("jaccard"), text.subjects_similar("subject_normalized", "body_text", 0.6).alias("similar"))


def quote_split(spark, sf_dir):
    body = F.concat("body_text", F.when(F.col("id") % 3 == 0, "\n> quoted line\nafter").when(F.col("id") % 3 == 1, "\nFrom: somebody\nolder").otherwise(""))
    return _messages(spark, sf_dir).select("id", text.new_content(body).alias("new_part"), text.quoted_content(body).alias("quoted_part"))


def evidence_sentences(spark, sf_dir):
    rows = _messages(spark, sf_dir)
    return rows.select("id", F.size(text.sentences("body_text")).cast("long").alias("n_sentences"), F.array_join(text.evidence("body_text", RULES.positive), "|").alias("evidence"))


def content_hash(spark, sf_dir):
    return _messages(spark, sf_dir).select("id", text.content_hash("message_id", "subject", "body_text").alias("content_hash"))


def exact_duplicate_groups(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_hash"))
    return rows.groupBy("text_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def html_strip(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.html_text("html").alias("body"))


def html_to_text(spark, sf_dir):
    @F.pandas_udf("string")
    def convert(x):
        return x.fillna("").map(mime.html_text)

    return _table(spark, sf_dir, "pages").select("page_id", convert("html").alias("body"))


def mask_phone(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(privacy.mask_phone("text").cast("binary"), 256).alias("masked"))


def mask_id(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(privacy.mask_national_id("text").cast("binary"), 256).alias("masked"))


def mask_address(spark, sf_dir):
    long = F.concat(F.coalesce("text", F.lit("")), F.lit("\n住在北京市海淀区中关村大街一号楼\n"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(privacy.mask_address(long).cast("binary"), 256).alias("masked"))


def mask_email(spark, sf_dir):
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(" ab@x.org or Keep.Me@Example.com, long.name@mail.example.com"))
    return _table(spark, sf_dir, "documents").select("doc_id", privacy.mask_emails(body, ["keep.me@example.com"]).alias("masked"))


def privacy_warnings(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(privacy.warnings("text"), "; ").alias("found"))


def mask_truncate(spark, sf_dir):
    cut = privacy.prepared("text")
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(cut).cast("long").alias("n"), F.sha2(cut.cast("binary"), 256).alias("cut_hash"))


def formula_guard(spark, sf_dir):
    sign = F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", text.formula_guard(F.concat(sign, "p_name")).alias("guarded"), text.truncated("p_name", 10).alias("short"))


def contact_score(spark, sf_dir):
    rows = contacts.score_contacts(_messages(spark, sf_dir), SUBJECT_WORDS, BODY_WORDS)
    return rows.select("id", "is_contact", F.round("contact_confidence", 9).alias("confidence"), "contact_review", F.size("contact_reasons").cast("long").alias("n_reasons"))


def folder_classify(spark, sf_dir):
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("INBOX/", "Sent Items ", "草稿箱", "Junk-", "Deleted", "All Mail ", "Presentations ", "work")]), (F.col("page_id") % 8 + 1).cast("int")), F.col("page_id").cast("string"))
    flags = F.when(F.col("page_id") % 10 == 3, F.array(F.lit("\\HasNoChildren"), F.lit("\\Trash"))).otherwise(F.array().cast("array<string>"))
    return _table(spark, sf_dir, "pages").select("page_id", name.alias("name"), folders.folder_type(name, flags).alias("folder_type"))


def folder_buckets(spark, sf_dir):
    return folders.by_type(folder_classify(spark, sf_dir)).select("folder_type", "n_folders")


def default_folders(spark, sf_dir):
    return folders.default_scan(folder_classify(spark, sf_dir), include_spam=True)


def domain_affiliation(spark, sf_dir):
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    listed = {"example.com": "Company", "example.org": "Society", "tionsh.example.com": "Lab"}
    rows = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("x@"), host).alias("email"))
    return entities.institution_of_domain(rows, domains=listed).select("page_id", "email", "institution")


def recipient_explode(spark, sf_dir):
    to = F.when(F.col("id") % 2 == 0, F.col("to_text")).otherwise(F.concat(F.lit("One@X.org; "), F.col("from_email"), F.lit(", bad")))
    return _messages(spark, sf_dir).select("id", F.explode(entities.recipients(to)).alias("email"))


def correspondents(spark, sf_dir):
    people = _analysis(spark, sf_dir).people
    return people.select("email", "name", "institution", "first_sent_at", "last_sent_at", "send_count", "confidence", "needs_review", F.array_join("review_reasons", "; ").alias("review_reasons"))


def message_roles(spark, sf_dir):
    return _analysis(spark, sf_dir).roles


def duplicate_names(spark, sf_dir):
    people = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("email"), F.substring_index("p_name", " ", 1).alias("name"), "p_brand").withColumnRenamed("p_brand", "institution")
    return entities.duplicate_names(people).select("name", "n", "reason")


def alias_merge(spark, sf_dir):
    aliases = spark.range(0, 12).selectExpr("concat('p', id, '@d', id % 8, '.edu.cn') as email", "concat('p', id + 20, '@d', (id + 20) % 8, '.edu.cn') as alias_email")
    links = _analysis(spark, sf_dir).roles.select("email", "id")
    return entities.merge_aliases(links, aliases).groupBy("email").agg(F.countDistinct("id").alias("n_messages"))


def thread_components(spark, sf_dir):
    return threads.build_threads(_messages(spark, sf_dir), OWNER)


def thread_sizes(spark, sf_dir):
    rows = _messages(spark, sf_dir)
    return threads.thread_summary(rows, threads.build_threads(rows, use_subject=False))


def thread_places(spark, sf_dir):
    rows = _messages(spark, sf_dir)
    return threads.thread_messages(rows, threads.build_threads(rows, use_subject=False)).select("id", "thread_id", F.col("place").cast("long").alias("place"))


def reply_detect(spark, sf_dir):
    return _analysis(spark, sf_dir).replies.select("email", "id", "reason", "is_auto")


def reply_status(spark, sf_dir):
    return _analysis(spark, sf_dir).status.select("email", "status", "n_replies", "reply_id", "reply_time")


def reply_with_threads(spark, sf_dir):
    rows = _messages(spark, sf_dir)
    return analyze(rows, Options(SUBJECT_WORDS, BODY_WORDS, RULES, DOMAINS, use_threads=True, owner=OWNER)).status.select("email", "status", "n_replies")


def unanswered_replies(spark, sf_dir):
    return replies.unanswered(_analysis(spark, sf_dir).replies, _messages(spark, sf_dir))


def my_reply(spark, sf_dir):
    return _analysis(spark, sf_dir).my_status


def rule_intent(spark, sf_dir):
    rows = _messages(spark, sf_dir).select("id", F.col("body_text").alias("reply_body"), F.lit(L.YES).alias("status"), F.when(F.col("id") % 2 == 0, L.REPLIED).otherwise(L.NOT_REPLIED).alias("my_status"))
    return rules.classify(rows, rules=RULES).select("id", "rule_intent", "rule_action", "rule_confidence", "rule_next_step")


def merged_table(spark, sf_dir):
    return _analysis(spark, sf_dir).merged.select("index", "email", "name", "institution", "first_sent_at", "last_sent_at", "send_count", "correspondence", "has_real_reply", "reply_time", "responder", "admission_intent", "my_reply_status", "action_required", "confidence", "needs_review")


def stats_overview(spark, sf_dir):
    return _analysis(spark, sf_dir).statistics


def stats_long(spark, sf_dir):
    return merge.labelled_statistics(_analysis(spark, sf_dir).statistics)


def latest_analysis(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.col("user_id").alias("email"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"), "event_type", "value")
    return merge.latest_analysis(log).select(F.col("email").alias("user_id"), "seq", "event_type", "value")


def override_pivot(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.col("user_id").alias("email"), F.col("event_type").alias("field"), F.col("value").alias("value"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    fields = ("view", "click", "purchase", "signup", "error")
    newest, oldest = merge.override_pivot(log, fields), merge.override_pivot(log, fields, newest=False)
    return newest.join(oldest.select("email", *[F.col(f).alias(f"old_{f}") for f in fields]), "email").withColumnRenamed("email", "user_id")


def override_history(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    people = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return log.join(people, "user_id").select("event_id", "name", "value")


def search_filter(spark, sf_dir):
    return merge.search(_analysis(spark, sf_dir).merged, "P1", L.YES).select("email", "has_real_reply")


def review_queue(spark, sf_dir):
    return merge.review_queue(_analysis(spark, sf_dir).merged)


def reply_bundle(spark, sf_dir):
    rows = merge.reply_bundle(_analysis(spark, sf_dir).replies, _messages(spark, sf_dir))
    return rows.select("email", F.sha2(F.col("bundle").cast("binary"), 256).alias("bundle_hash"))


def changed_fields(spark, sf_dir):
    before = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    after = before.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 7 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return merge.changed_fields(before, after, ("c_name", "c_mktsegment"), "c_custkey")


def evidence_listing(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return merge.evidence_listing(a.roles, _messages(spark, sf_dir)).select("email", "id", "role", "date", "preview")


def _sync_tables(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("folder_id"), F.col("event_id").alias("uid"), "event_type").withColumn("account_id", F.lit(1).cast("long")).withColumn("uidvalidity", F.when(F.col("folder_id") == 2, 8).otherwise(7).cast("long"))
    state = events.filter("folder_id < 4").groupBy("account_id", "folder_id").agg((F.max("uid") - 500).cast("long").alias("last_sync_uid")).withColumn("uidvalidity", F.lit(7).cast("long"))
    return events, state


def incremental_sync(spark, sf_dir):
    events, state = _sync_tables(spark, sf_dir)
    return sync.new_rows(events, state).select("folder_id", "uid", "event_type")


def sync_state(spark, sf_dir):
    events, state = _sync_tables(spark, sf_dir)
    return sync.next_state(sync.new_rows(events, state), state).select("folder_id", "uidvalidity", "last_sync_uid")


def epoch_reset(spark, sf_dir):
    events, state = _sync_tables(spark, sf_dir)
    stored = events.withColumn("uidvalidity", F.lit(7).cast("long"))
    after = sync.next_state(sync.new_rows(events, state), state)
    return sync.current_rows(stored, after).groupBy("folder_id").agg(F.count("*").alias("n_rows"))


def export_frame(spark, sf_dir):
    frame = sinks.export_frame(_analysis(spark, sf_dir).merged, labels=False)
    return frame.select(F.col("index").alias("row"), "name", "send_count", "has_real_reply", "needs_review", "confidence")


def _listed(names: dict, module: str) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    skip = {"queries", "oracle_sql", "analyze", "conversations_as_messages"}
    return {k: f for k, f in names.items() if callable(f) and getattr(f, "__module__", "") == module and not k.startswith("_") and k not in skip}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corrmail.plans import mail_queries

    return _listed(globals(), __name__) | _listed(vars(mail_queries), mail_queries.__name__)


def oracle_sql() -> dict[str, str]:
    from corrmail.plans import mail_oracles

    return ORACLES | mail_oracles.ORACLES
