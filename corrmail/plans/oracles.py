"""DuckDB SQL for the queries over the driver's tables."""

from __future__ import annotations

from corrmail.functions import lexicon as L
from corrmail.functions.text import _EDGE, _FULL, _HALF

#: Fixed values, as in the text functions.
_PREFIX = "Re|RE|re|Fw|FW|fw|Fwd|FWD|fwd|回复|答复|转发"
_EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _norm(c: str) -> str:
    bare = rf"regexp_replace({_strip(c)}, '^(\s*({_PREFIX})\s*[:：]\s*)+', '')"
    return rf"lower(trim(regexp_replace(translate({bare}, {_q(_FULL)}, {_q(_HALF)}), '\s+', ' ', 'g'), {_q(_EDGE)}))"


def _letters(c: str) -> str:
    return f"list_distinct(list_filter(string_split(replace({c}, ' ', ''), ''), lambda x: x <> ''))"


def _jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0.0)"


def _any(c: str, words) -> str:
    return "(" + " or ".join(f"contains({c}, {_q(w)})" for w in words) + ")"


_MSG = f"""
conv as (select conv_id, turn, role, coalesce(text, '') as body, first_value(left(coalesce(text, ''), 40)) over (partition by conv_id order by turn) as head from conversations),
msg as (
  select conv_id * 100 + turn + 1 as id, conv_id, turn, body, '<c' || conv_id || '.t' || turn || '@x>' as message_id,
    case when turn > 0 then '<c' || conv_id || '.t' || (turn - 1) || '@x>' else '' end as in_reply_to,
    '2024-' || lpad((conv_id // 28 % 12 + 1)::varchar, 2, '0') || '-' || lpad((conv_id % 28 + 1)::varchar, 2, '0') || 'T' || lpad((turn // 60 % 24)::varchar, 2, '0') || ':' || lpad((turn % 60)::varchar, 2, '0') || ':00+00:00' as date,
    case when turn > 0 then 'Re: ' else '' end || head as subject,
    'p' || (conv_id % 40) || '@d' || (conv_id % 8) || '.edu.cn' as person, role = 'user' as own, role = 'system' as system
  from conv),
m as (select *, {_norm("subject")} as norm, case when own then 'me@local.edu' else person end as from_email, case when own then '<' || person || '>' else '<me@local.edu>' end as to_text from msg)
"""


def _with(rest: str, *ctes: str) -> str:
    return "with " + ",\n".join((_MSG, *ctes)) + "\n" + rest


_SUBJECT_WORDS, _BODY_WORDS = ("the", "der", "que", "les"), ("and", "und", "para", "dans", "ing")
_INTRO = r"我是.{0,20}(大学|学院|专业)|(本科|在读).{0,10}(学生|同学)|(成绩|绩点|GPA).{0,10}[0-9.]|自荐|自我介绍|个人简介"
_RANK = r"(专业前|排名|前)\s*[\p{Nd}.]+[%％]?|排名\s*\p{Nd}+\s*/\s*\p{Nd}+"


def _count(c: str, words) -> str:
    return " + ".join(f"contains({c}, {_q(w)})::int" for w in words)


_SCORE = f"""
parts as (select *, {_count("lower(subject)", _SUBJECT_WORDS)} as ns, {_count("lower(left(body, 1000))", _BODY_WORDS)} as nb,
    regexp_matches(left(body, 800), '{_INTRO}') as intro, regexp_matches(subject, '{_RANK}') or regexp_matches(left(body, 500), '{_RANK}') as rank from m),
summed as (select *, 0.0::double + case when ns > 0 then least(ns * 0.15::double, 0.45::double) else 0 end + case when rank then 0.1::double else 0 end
    + case when nb > 0 then least(nb * 0.08::double, 0.3::double) else 0 end + case when intro then 0.08::double else 0 end + case when own then 0.1::double else 0 end + case when own then 0.05::double else 0 end as s,
    (ns > 0)::int + rank::int + (nb > 0)::int + intro::int + 2 * own::int as n from parts),
scored as (select *, case when system then s * 0.5::double else s end as score from summed)
"""
_PEOPLE = f"""
contact as (select *, person as email from scored where own and score >= 0.2),
people as (select email, split_part(email, '@', 1) as name,
    case when regexp_extract(email, '@d([0-9]+)', 1)::int < 5 then 'Institute ' || regexp_extract(email, '@d([0-9]+)', 1) else upper(regexp_extract(email, '@(d[0-9]+)', 1)) end as institution,
    min(date) as first_sent_at, max(date) as last_sent_at, count(*) as send_count from contact group by email),
sent as (select p.email, c.* from people p join contact c using (email)),
subjects as (select distinct email, norm from contact where norm <> ''),
cand as (select p.email, r.* from people p join m r on r.from_email = p.email where not r.own),
rel as (select c.email, c.id, min(case when s.message_id is not null then 2 else 4 end) as k
    from cand c left join contact s on s.email = c.email and s.message_id = c.in_reply_to
    where s.message_id is not null or exists (select 1 from subjects x where x.email = c.email and c.norm <> '' and (x.norm = c.norm or {_jaccard(_letters("x.norm"), _letters("c.norm"))} >= 0.6)) group by all),
stat0 as (select p.email, count(r.id) as n, min_by(r.id, (r.date, r.id)) as reply_id, min_by(r.date, (r.date, r.id)) as reply_time, min_by(r.from_email, (r.date, r.id)) as responder, min_by(r.body, (r.date, r.id)) as reply_body
    from people p left join (select rel.email, m.* from rel join m using (id)) r on r.email = p.email group by p.email),
ownre as (select email, bool_or(regexp_matches({_strip("subject")}, '^(Re|RE|回复|答复)\\s*[:：]')) as own from contact group by email),
stat as (select s.*, case when n > 0 then case when trim(reply_body) = '' then '无法确认' else '是' end when o.own then '无法确认' else '否' end as status from stat0 s join ownre o using (email)),
real as (select rel.email, m.id, m.message_id, m.date, m.norm from rel join m using (id)),
answered as (select r.email, r.id from real r join m s on s.own and s.in_reply_to = r.message_id and not s.date <= r.date
    union select r.email, r.id from real r join m s on s.own and s.person = r.email and s.norm <> '' and r.norm <> '' and not s.date <= r.date and (s.norm = r.norm or {_jaccard(_letters("s.norm"), _letters("r.norm"))} >= 0.6)),
openr as (select * from real r anti join answered a on a.email = r.email and a.id = r.id),
mine as (select p.email, case when s.n = 0 then '无需回复' when o.open_id is null then '已回复' else '未回复' end as my_status, o.open_id
    from people p join stat s using (email) left join (select email, min_by(id, (date, id)) as open_id from openr group by email) o using (email))
"""

_POS, _UNC, _NEG = ("ation", "keit", "mente", "elle"), ("tion", "ung", "que"), ("rere", "schsch", "rrrr", "eauxeaux")


def _intent(t: str) -> str:
    return f"""case when {_any(t, _NEG)} then case when contains({t}, 'rere') then 'QUOTA_FULL' when contains({t}, 'schsch') then 'DIRECTION_MISMATCH' else 'REJECTED' end
      when {_any(t, _POS)} then case when contains({t}, 'thation') then 'ACCEPT_WITH_QUOTA' when contains({t}, 'keit') then 'WELCOME_JOIN' when contains({t}, 'mente') then 'ADDED_WECHAT' when contains({t}, 'elleou') then 'WILLING_TO_TALK' else 'POLITE_NO_INTENT' end
      when {_any(t, _UNC)} then case when contains({t}, 'ntion') then 'QUOTA_UNCERTAIN' when contains({t}, 'ungen') then 'WAIT_POLICY' else 'POLITE_NO_INTENT' end else 'POLITE_NO_INTENT' end"""


def _sure(t: str) -> str:
    return f"""case when {_any(t, _NEG)} then 0.7::double when {_any(t, _POS)} then case when {_any(t, ("thation", "keit", "mente", "elleou"))} then 0.7::double else 0.5::double end when {_any(t, _UNC)} then 0.5::double else 0.4::double end"""


_QUOTE = r"^(>+\s*|-{3,}\s*原始邮件|-{3,}\s*Original Message|发件人[:：]|From[:：]|在\s+\d{4}|On\s+[\p{L}\p{N}_]+,?\s+[\p{L}\p{N}_]+|\*{3}\s*|_{3,})"


def _read_part(c: str) -> str:
    """The new part of a body, or all of it where that is blank."""
    lines = f"string_split({c}, chr(10))"
    at = f"list_position(list_transform({lines}, lambda x: regexp_matches({_strip('x')}, '{_QUOTE}')), true)"
    new = f"case when coalesce({at}, 0) = 0 then {_strip(c)} else {_strip(f'array_to_string({lines}[1:{at} - 1], chr(10))')} end"
    return f"case when {new} <> '' then {new} else {c} end"


_TABLES = f"""
intents(code, label, done, todo, bucket) as (values {", ".join(f"({_q(k)}, {_q(L.INTENTS[k])}, {_q(v[0])}, {_q(v[1])}, {_q(v[2]) if v[2] else 'null'})" for k, v in L.INTENT_ACTIONS.items())}),
actions(code, label, step) as (values {", ".join(f"({_q(k)}, {_q(v)}, {_q(L.NEXT_STEPS[k])})" for k, v in L.ACTIONS.items())})
"""
_MERGED = f"""
read as (select s.*, my_status, case when status = '是' and not trim(reply_body) = '' then {_intent("t")} when status = '否' then 'NO_REPLY' else 'UNCERTAIN' end as code,
    case when status = '是' then {_sure("t")} when status = '否' then 0.9::double else 0.3::double end as sure from (select *, {_read_part('reply_body')} as t from stat) s join mine using (email)),
acted as (select r.*, i.label as intent, i.bucket, case when status = '否' then 'CONSIDER_FOLLOWUP' when status = '是' and my_status = '已回复' then i.done when status = '是' then i.todo else 'UNCERTAIN' end as act from read r join intents i on i.code = r.code),
merged as (select row_number() over (order by p.name, p.email) as "index", p.*, '发送 ' || send_count || ' 封' || case when n > 0 then '，收到 ' || n || ' 封回复' else '' end as correspondence,
    status as has_real_reply, coalesce(reply_time, '') as reply_time, coalesce(responder, '') as responder, intent as admission_intent, my_status as my_reply_status, c.label as action_required, sure as confidence, bucket, act, true as needs_review
    from people p join acted a using (email) join actions c on c.code = a.act)
"""
_STATS = """
stats as (select (select count(*) from m) as total_related_emails, (select count(*) filter (own) from m) as sent_emails, (select count(*) filter (not own) from m) as received_reply_emails, 0::bigint as auto_reply_count, 0::bigint as bounce_count,
    count(*) as correspondent_count, count(*) filter (has_real_reply = '是') as replied_count, count(*) filter (has_real_reply = '无法确认') as uncertain_count, count(*) filter (has_real_reply = '否') as no_reply_count,
    count(*) filter (bucket = 'positive_intent') as positive_intent_count, count(*) filter (bucket = 'welcome_apply') as welcome_apply_count, count(*) filter (bucket = 'suggest_camp') as suggest_camp_count, count(*) filter (bucket = 'willing_to_talk') as willing_to_talk_count,
    count(*) filter (bucket = 'quota_uncertain') as quota_uncertain_count, count(*) filter (bucket = 'polite_no_intent') as polite_no_intent_count, count(*) filter (bucket = 'negative') as negative_count,
    count(*) filter (act = 'REPLY_NOW') as need_reply_now_count, count(*) filter (act = 'CONSIDER_FOLLOWUP') as suggest_followup_count, count(*) filter (needs_review) as needs_review_count,
    round_even(count(*) filter (has_real_reply = '是') * 100.0::double / count(*), 1)::double as reply_rate, true as consistency_valid, '通过' as consistency from merged)
"""
_SYNC = """
e as (select user_id % 5 as folder_id, event_id as uid, event_type, case when user_id % 5 = 2 then 8 else 7 end as epoch from events),
st as (select folder_id, max(uid) - 500 as last from e where folder_id < 4 group by folder_id),
fresh as (select e.* from e left join st using (folder_id) where st.last is null or e.epoch <> 7 or e.uid > st.last),
nxt as (select folder_id, max(epoch) as uidvalidity, max(uid) as last_sync_uid from fresh group by folder_id union all select folder_id, 7, last from st where folder_id not in (select folder_id from fresh))
"""
_FOLDER = """
f as (select page_id, ['INBOX/', 'Sent Items ', '草稿箱', 'Junk-', 'Deleted', 'All Mail ', 'Presentations ', 'work'][page_id % 8 + 1] || page_id as name, page_id % 10 = 3 as trash from pages),
folders as (select page_id, name, case when trash then 'trash' when contains(lower(name), 'inbox') then 'inbox' when contains(lower(name), 'sent') then 'sent' when contains(name, '草稿') then 'drafts'
    when contains(lower(name), 'junk') then 'spam' when contains(lower(name), 'deleted') then 'trash' when contains(lower(name), 'all mail') then 'archive' else 'other' end as folder_type from f)
"""

_HASHED = "select doc_id, sha256(regexp_replace({text}, '{pattern}', '{mask}', 'g')) as masked from documents"
_DOC = "coalesce(text, '')"
_MERGED_COLUMNS = '"index", email, name, institution, first_sent_at, last_sent_at, send_count, correspondence, has_real_reply, reply_time, responder, admission_intent, my_reply_status, action_required, confidence, needs_review'

ORACLES: dict[str, str] = {
    "subject_normalize": _with(rf"select id, subject, norm as subject_normalized, regexp_matches({_strip('subject')}, '^(Re|RE|re|回复|答复)\s*[:：]') as is_reply, regexp_matches({_strip('subject')}, '^(Fw|FW|Fwd|FWD|转发)\s*[:：]') as is_forward from m"),
    "fullwidth_fold": f"select doc_id, translate('Ａ１（' || {_DOC} || '）　ｚ', {_q(_FULL)}, {_q(_HALF)}) as folded from documents",
    "subject_similarity": _with(f"select id, round({_jaccard(_letters('norm'), _letters('s'))}, 6) as jaccard, norm <> '' and s <> '' and (norm = s or {_jaccard(_letters('norm'), _letters('s'))} >= 0.6) as similar from (select id, norm, {_norm('body')} as s from m where norm <> '')"),
    "quote_split": _with(f"select id, case when p = 0 then {_strip('t')} else {_strip('array_to_string(l[1:p - 1], chr(10))')} end as new_part, case when p = 0 then '' else {_strip('array_to_string(l[p:], chr(10))')} end as quoted_part from (select id, t, l, coalesce(list_position(list_transform(l, lambda x: regexp_matches({_strip('x')}, '{_QUOTE}')), true), 0) as p from (select *, string_split(t, chr(10)) as l from (select id, body || case when id % 3 = 0 then chr(10) || '> quoted line' || chr(10) || 'after' when id % 3 = 1 then chr(10) || 'From: somebody' || chr(10) || 'older' else '' end as t from m)))"),
    "evidence_sentences": _with(f"select id, len(s)::bigint as n_sentences, array_to_string(list_filter(s, lambda x: length(x) >= 4 and {_any('x', _POS)})[1:5], '|') as evidence from (select id, list_filter(list_transform(regexp_split_to_array(body, '[。！？\\n;；.!?]+'), lambda x: {_strip('x')}), lambda x: x <> '') as s from m)"),
    "content_hash": _with("select id, left(sha256(message_id || '|' || subject || '|' || left(body, 500)), 16) as content_hash from m"),
    "exact_duplicate_groups": f"select sha256({_DOC}) as text_hash, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1",
    "html_strip": rf"select page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '<[^>]+>', chr(10), 'g'), chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), chr(10)) as body from pages",
    "mask_phone": _HASHED.format(text=_DOC, pattern=L.PHONE, mask=L.PHONE_MASK),
    "mask_id": _HASHED.format(text=_DOC, pattern=L.NATIONAL_ID, mask=L.NATIONAL_ID_MASK),
    "mask_address": _HASHED.format(text=f"{_DOC} || chr(10) || '住在北京市海淀区中关村大街一号楼' || chr(10)", pattern=L.ADDRESS, mask=L.ADDRESS_MASK),
    "mask_email": rf"""select doc_id, regexp_replace(regexp_replace({_DOC}, '([\p{{L}}\p{{N}}_.+-])[\p{{L}}\p{{N}}_.+-]{{2,}}@([\p{{L}}\p{{N}}_.-]+\.[\p{{L}}\p{{N}}_]+)', '\1***@\2', 'g'), '(^|[^\p{{L}}\p{{N}}_.+*-])[\p{{L}}\p{{N}}_.+-]{{1,2}}@([\p{{L}}\p{{N}}_.-]+\.[\p{{L}}\p{{N}}_]+)', '\1***@\2', 'g') || ' ***@x.org or Keep.Me@Example.com, l***@mail.example.com' as masked from documents""",
    "privacy_warnings": f"select doc_id, concat_ws('; ', case when regexp_matches({_DOC}, '{L.PHONE}') then '包含手机号码' end, case when regexp_matches({_DOC}, '{L.NATIONAL_ID}') then '包含身份证号码' end, case when len(regexp_extract_all({_DOC}, '{_EMAIL}')) > 0 then '包含 ' || len(regexp_extract_all({_DOC}, '{_EMAIL}')) || ' 个邮箱地址' end) as found from documents",
    "formula_guard": "select p_partkey, case when left(x, 1) in ('=', '+', '-', '@') then '''' || x else x end as guarded, case when length(p_name) > 10 then left(p_name, 10) || '...' else p_name end as short from (select *, ['=', '+', '-', '@', ''][p_partkey % 5 + 1] || p_name as x from part)",
    "contact_score": _with("select id, score >= 0.2 as is_contact, round(least(score, 1.0), 9)::double as confidence, score >= 0.2 and score < 0.6 as contact_review, (n + system::int + (score >= 0.2 and score < 0.4)::int)::bigint as n_reasons from scored", _SCORE),
    "folder_classify": f"with {_FOLDER} select * from folders",
    "folder_buckets": f"with {_FOLDER} select t as folder_type, count(page_id) as n_folders from (select unnest(['inbox', 'sent', 'drafts', 'spam', 'trash', 'archive', 'other']) as t) left join folders on folder_type = t group by t",
    "default_folders": f"with {_FOLDER} select * from folders where folder_type not in ('drafts', 'trash', 'archive')",
    "domain_affiliation": r"select page_id, 'x@' || h as email, case when h = 'tionsh.example.com' or h like '%.tionsh.example.com' then 'Lab' when h = 'example.com' or h like '%.example.com' then 'Company' when h = 'example.org' or h like '%.example.org' then 'Society' else '' end as institution from (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as h from pages)",
    "recipient_explode": _with("select id, case when id % 2 = 0 then case when own then person else 'me@local.edu' end else unnest end as email from (select *, unnest(case when id % 2 = 0 then ['x'] else ['one@x.org', from_email] end) as unnest from m)"),
    "correspondents": _with("select email, name, institution, first_sent_at, last_sent_at, send_count, 0.5::double as confidence, true as needs_review, '无法确认导师姓名' as review_reasons from people", _SCORE, _PEOPLE),
    "message_roles": _with("select email, id, case when row_number() over (partition by email order by date, id) = 1 then '首次套磁' when contains(lower(subject), 're:') then '我的回复' else '补发邮件' end as role from contact", _SCORE, _PEOPLE),
    "duplicate_names": "select split_part(p_name, ' ', 1) as name, count(*) as n, case when count(distinct p_brand) = 1 then '同姓名同单位，可能是同一导师使用多个邮箱' else '同姓名但不同单位，可能是不同导师' end as reason from part group by 1 having count(*) > 1",
    "alias_merge": _with("select case when k >= 20 and k < 32 then 'p' || (k - 20) || '@d' || ((k - 20) % 8) || '.edu.cn' else email end as email, count(distinct id) as n_messages from (select *, regexp_extract(email, 'p([0-9]+)', 1)::int as k from contact) group by 1", _SCORE, _PEOPLE),
    "thread_components": _with(
        "select id, min(g) over (partition by conv_id) as thread_id, case when n = 1 and cnt = 1 then '' when n = 1 then 'subject' else 'in_reply_to' end as match_method from (select m.*, k.g, count(*) over (partition by m.conv_id) as n, count(*) over (partition by m.person, m.norm) as cnt from m join grp k using (conv_id))",
        "grp as (select a.conv_id, min(b.conv_id) * 100 + 1 as g from (select distinct conv_id, person, norm from m) a join (select distinct conv_id, person, norm from m) b on a.person = b.person and (a.conv_id = b.conv_id or (a.norm = b.norm and a.norm <> '')) group by a.conv_id)",
    ),
    "thread_sizes": _with("select conv_id * 100 + 1 as thread_id, arg_min(norm, turn) as subject, count(*) as n_messages, min(date) as first_date, max(date) as last_date from m group by conv_id"),
    "thread_places": _with("select id, conv_id * 100 + 1 as thread_id, turn + 1 as place from m"),
    "reply_detect": _with("select email, id, case k when 2 then 'in_reply_to' else 'subject' end as reason, false as is_auto from rel", _SCORE, _PEOPLE),
    "reply_status": _with("select email, status, n as n_replies, reply_id, coalesce(reply_time, '') as reply_time from stat", _SCORE, _PEOPLE),
    "unanswered_replies": _with("select email, id, date from openr", _SCORE, _PEOPLE),
    "my_reply": _with("select email, my_status, open_id from mine", _SCORE, _PEOPLE),
    "rule_intent": _with(f"select id, case when trim(body) = '' then 'UNCERTAIN' else r.code end as rule_intent, a.code as rule_action, sure as rule_confidence, a.step as rule_next_step from (select id, body, {_intent('t')} as code, {_sure('t')} as sure from (select id, body, {_read_part('body')} as t from m)) r join intents i on i.code = r.code join actions a on a.code = case when id % 2 = 0 then i.done else i.todo end", _TABLES),
    "merged_table": _with(f"select {_MERGED_COLUMNS} from merged", _SCORE, _PEOPLE, _TABLES, _MERGED),
    "stats_overview": _with("select * from stats", _SCORE, _PEOPLE, _TABLES, _MERGED, _STATS),
    "stats_long": _with("select x.label, x.value from (select unnest([" + ", ".join(f"{{'label': {_q(label)}, 'value': {c}::varchar}}" for c, label in L.STAT_LABELS.items()) + "]) as x from stats)", _SCORE, _PEOPLE, _TABLES, _MERGED, _STATS),
    "latest_analysis": "select user_id, max_by(event_id, (ts, event_id)) as seq, max_by(event_type, (ts, event_id)) as event_type, max_by(value, (ts, event_id)) as value from events group by user_id",
    "override_pivot": "select user_id, " + ", ".join(f"max_by(value, (ts, event_id)) filter (event_type = '{f}') as {f}, min_by(value, (ts, event_id)) filter (event_type = '{f}') as old_{f}" for f in ("view", "click", "purchase", "signup", "error")) + " from events group by user_id",
    "override_history": "select event_id, c_name as name, value from events join customer on c_custkey = user_id",
    "search_filter": _with(f"select email, has_real_reply from merged where has_real_reply = '是' and contains(lower(concat_ws(' ', {_MERGED_COLUMNS})), 'p1')", _SCORE, _PEOPLE, _TABLES, _MERGED),
    "review_queue": _with("select email, 'flagged' as why from merged union all select email, 'low_confidence' from merged where confidence < 0.5", _SCORE, _PEOPLE, _TABLES, _MERGED),
    "reply_bundle": _with("select email, sha256(string_agg(body, chr(10) || '---' || chr(10) order by date, id)) as bundle_hash from rel join m using (id) where trim(body) <> '' group by email", _SCORE, _PEOPLE),
    "changed_fields": "select c_custkey, 'c_mktsegment' as field, c_mktsegment as old_value, 'NEW' as new_value from customer where c_custkey % 7 = 0 and c_mktsegment <> 'NEW'",
    "evidence_listing": _with("select email, id, case when row_number() over (partition by email order by date, id) = 1 then '首次套磁' when contains(lower(subject), 're:') then '我的回复' else '补发邮件' end as role, date, left(body, 500) as preview from contact", _SCORE, _PEOPLE),
    "incremental_sync": f"with {_SYNC} select folder_id, uid, event_type from fresh",
    "sync_state": f"with {_SYNC} select folder_id, uidvalidity::bigint as uidvalidity, last_sync_uid from nxt",
    "epoch_reset": f"with {_SYNC} select folder_id, count(*) as n_rows from e join nxt using (folder_id) where nxt.uidvalidity = 7 group by folder_id",
    "export_frame": _with("select \"index\"::varchar as row, name, send_count::varchar as send_count, has_real_reply, '是' as needs_review, confidence::varchar as confidence from merged", _SCORE, _PEOPLE, _TABLES, _MERGED),
}
