"""DuckDB SQL for the queries over message files and logs."""

from __future__ import annotations

from corrmail.functions import lexicon as L
from corrmail.plans.oracles import _BODY_WORDS, _MERGED, _NEG, _PEOPLE, _POS, _SCORE, _SUBJECT_WORDS, _TABLES, _UNC, _any, _count, _intent, _jaccard, _letters, _q, _read_part, _strip, _with

_PAGE = "'Hello ' || id || chr(10) || 'Bye & co'"
_MAIL = f"""
f as (select *, {_strip("subject")} as title, conv_id * 100 + turn + 1 as k, split_part(person, '@', 1) as number, split_part(person, '@', 2) as host, not own and (conv_id * 100 + turn + 1) % 13 = 0 as bounced from m),
mail as (select id, conv_id, turn, own, person, message_id, title, norm,
    case when turn > 0 and k % 2 = 0 then in_reply_to else '' end as irt,
    case when turn > 1 then '<c' || conv_id || '.t' || (turn - 2) || '@x>,' else '' end || case when turn > 0 then in_reply_to else '' end as refs,
    case when k % 9 = 0 then 'some day' else left(date, 19) || '+08:00' end as sent_at,
    case when own then 'me@local.edu' when bounced then 'mailer-daemon@' || host when system then 'noreply@' || host else person end as sender,
    case when own then 'Me' when bounced then 'Mail' when system then '' else '王 ' || number end as sender_name,
    case when own then 'Prof. ' || number || ' <' || person || '>' else '<me@local.edu>; Other <other@x.org>' end as receivers,
    case when k % 4 = 2 or (k % 4 = 1 and {_strip("body")} = '') then {_PAGE} when {_strip("body")} = '' then '' else body end as content,
    case when k % 4 in (1, 2) then {_PAGE} else '' end as page,
    k % 4 = 3 as attached, case when k % 4 = 3 then case when k % 8 = 3 then 'resume' else 'a' end || k || '.pdf' else '' end as file,
    k % 11 = 0 or ({_any(f"lower({_strip('subject')})", L.AUTO_SUBJECTS)} and length(body) < 500) as auto,
    bounced or {_any(f"lower({_strip('subject')})", L.BOUNCE_SUBJECTS)} as bounce, system and not bounced as notice
  from f)
"""
_INTRO = r"我是.{0,20}(大学|学院|专业)|(本科|在读).{0,10}(学生|同学)|(成绩|绩点|GPA).{0,10}[0-9.]|自荐|自我介绍|个人简介"
_LOGGED = f"""
n as (select *, regexp_extract(email, '^p([0-9]+)', 1)::int as k from merged where true),
forced as (select n.* exclude (needs_review), k % 7 = 1 as unsure from n where k % 10 <> 7),
ruled as (select f.*, case when unsure then '无法确认' else has_real_reply end as status2, case when unsure then 0.3::double else confidence end as sure2,
    case when unsure then {_q(L.INTENTS["UNCERTAIN"])} else admission_intent end as intent2, case when unsure then {_q(L.ACTIONS["UNCERTAIN"])} else action_required end as action2 from forced f),
better as (select *, k % 4 = 1 and case when k % 3 = 0 then 0.2::double else 0.95::double end > sure2 as b from ruled),
final as (select email, case when k % 6 = 0 then 'Newer ' || k when k % 3 = 0 then 'Name ' || k else name end as name, status2 as has_real_reply, case when b then 'Model' else responder end as responder,
    case when b then {_q(L.INTENTS["WELCOME_JOIN"])} else intent2 end as admission_intent, case when k % 5 = 0 then 'Custom' when b and k % 8 <> 1 then {_q(L.ACTIONS["REPLY_NOW"])} else action2 end as action_required,
    case when b then case when k % 3 = 0 then 0.2::double else 0.95::double end else sure2 end as confidence, true as needs_review from better)
"""


def _mail(rest: str, *more: str) -> str:
    return _with(rest, _MAIL, *more).replace("with ", "with recursive ", 1)


_POINTS = f"""
p as (select *, {" + ".join(f"(contains(lower(title), {_q(w)}) or contains(norm, {_q(w)}))::int" for w in _SUBJECT_WORDS)} as ns, {_count("lower(left(content, 1000))", _BODY_WORDS)} as nb, regexp_matches(left(content, 800), '{_INTRO}') as intro from mail),
s as (select *, case when ns > 0 then least(ns * 0.15::double, 0.45::double) else 0::double end + case when nb > 0 then least(nb * 0.08::double, 0.3::double) else 0 end + case when intro then 0.08::double else 0 end
    + case when attached then case when starts_with(file, 'resume') then 0.15::double else 0.05::double end else 0 end + case when own then 0.1::double else 0 end + case when own then 0.05::double else 0 end as s0 from p),
points as (select id, case when bounce then 0::double when auto then s0 * 0.3::double when notice then s0 * 0.5::double else s0 end as score from s)
"""
_NOTE = "'电话13812345678' || chr(10) || '证件11010519491231002X' || chr(10) || '住在北京市海淀区中关村大街一号楼' || chr(10)"
_MASKED = f"regexp_replace(regexp_replace(regexp_replace({_NOTE}, '{L.PHONE}', '{L.PHONE_MASK}', 'g'), '{L.NATIONAL_ID}', '{L.NATIONAL_ID_MASK}', 'g'), '{L.ADDRESS}', '{L.ADDRESS_MASK}', 'g')"

_LOCAL, _HOST = r"[\p{L}\p{N}_.+-]", r"[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"


def _masked_text(t: str) -> str:
    """All masks in their order."""
    for pattern, mask in ((L.PHONE, L.PHONE_MASK), (L.NATIONAL_ID, L.NATIONAL_ID_MASK), (L.ADDRESS, L.ADDRESS_MASK), (rf"({_LOCAL}){_LOCAL}{{2,}}@({_HOST})", r"\1***@\2"), (rf"(^|[^\p{{L}}\p{{N}}_.+*-]){_LOCAL}{{1,2}}@({_HOST})", r"\1***@\2")):
        t = f"regexp_replace({t}, {_q(pattern)}, {_q(mask)}, 'g')"
    return t




def _institution(t: str) -> str:
    """The first institution in a text, by the same word lists."""
    for pattern in L.INSTITUTION_SELF:
        t = f"regexp_replace({t}, {_q(pattern)}, '', 'g')"
    found = t
    for pattern in L.INSTITUTION_PATTERNS[::-1]:
        found = f"list_concat(regexp_extract_all({t}, {_q(pattern)}), {found})" if found is not t else f"regexp_extract_all({t}, {_q(pattern)})"
    bare = f"list_transform({found}, lambda x: regexp_replace(x, '^((' || {_q('|'.join(L.INSTITUTION_PREFIXES))} || ')\\s*)+', ''))"
    return f"coalesce(list_filter({bare}, lambda x: not {_any('x', L.INSTITUTION_STOP_WORDS)} and length(x) >= 4 and {_any('x', ('大学', '学院', '研究所', '研究院'))})[1], '')"


def _pick(words: tuple[str, ...], step: int) -> str:
    return f"[{', '.join(map(_q, words))}][p_partkey // {step} % {len(words)} + 1]"


_OPENERS = ("我是山东大学的学生，", "毕业于南京大学，", "", "您好，", "本人就读于复旦大学计算机学院，", "近期在浙江大学学习，了解到")
_VERBS = ("想申请", "联系", "向", "报考", "给")
_PLACES = ("清华大学", "中国科学院自动化研究所", "上海人工智能研究院", "北京大学计算机学院", "某实验室", "我毕业于武汉大学的母校", "东南大学和同济大学", "小学院")
_GREETINGS = ("尊敬的", "尊敬的 ", "老师们，", "", "Dear ")
_NAMES = ("王伟", "欧阳锋教授的", "李", "Müller", "张三李四王五", "")
_TITLES = ("教授", " 老师您好", "导师 你好", "研究员：", "博导您好", "同学")
_HONOURS = "(教授|老师|导师|研究员|博导)"


def _salutation(t: str) -> str:
    hits = [rf"regexp_extract({t}, '尊敬的\s*([\p{{L}}\p{{N}}_]{{1,4}})\s*{_HONOURS}', ['n', 't'])", rf"regexp_extract({t}, '([\p{{L}}\p{{N}}_]{{1,4}})\s*{_HONOURS}\s*(您好|你好)', ['n', 't', 'g'])"]
    return "coalesce(" + ", ".join(f"nullif({h}.n || {h}.t, '')" for h in hits) + ", '')"


#: A received message also answers if it is in one conversation with outreach.
_IN_THREADS = _PEOPLE.replace("where s.message_id is not null or exists", "where s.message_id is not null or exists (select 1 from contact t where t.email = c.email and t.conv_id = c.conv_id) or exists", 1)

def _guarded(c: str) -> str:
    """A cell that a spreadsheet would take for a formula gets an apostrophe."""
    return f"case when regexp_matches({c}, '^[=+@-]') then chr(39) || {c} else {c} end as {c}"


#: What the summary table says of each reply: its text, sentences that tell, and the next step.
_DETAILS = f"""
fixed(status, summary, step) as (values {", ".join(f"({_q(k)}, {_q(L.FIXED_RESULTS[k][0])}, {_q(L.FIXED_RESULTS[k][3])})" for k in (L.NO, L.UNSURE))}),
said as (select email, case when f.status is null then list_filter(list_transform(regexp_split_to_array(t, '[。！？\\n;；.!?]+'), lambda x: {_strip("x")}), lambda x: length(x) >= 4 and {_any("x", (*_POS, *_UNC, *_NEG))})[1:5] else [] end as proof,
    coalesce(f.summary, left(t, 300)) as summary, f.step as fixed_step from acted left join fixed f on f.status = acted.status),
full_table as (select m.*, m.email as emails, summary as reply_summary, array_to_string(proof, '; ') as evidence, coalesce(fixed_step, c.step) as recommended_next_step
    from merged m join said using (email) join actions c on c.code = m.act)
"""
_TEXTS = ("name", "institution", "emails", "first_sent_at", "last_sent_at", "correspondence", "has_real_reply", "reply_time", "responder", "reply_summary", "evidence", "admission_intent", "my_reply_status", "action_required", "recommended_next_step")


def _full(rest: str) -> str:
    return _with(rest, _SCORE, _PEOPLE, _TABLES, _MERGED, _DETAILS)


ORACLES: dict[str, str] = {
    "mail_headers": _mail("select id, message_id, irt as in_reply_to, refs, sent_at as date, title as subject, sender as from_email, sender_name as from_name, receivers as to_text, '' as cc_text from mail"),
    "mail_bodies": _mail("select id, sha256(content) as body_hash, page as body_html_text, attached as has_attachments, file as attachment_names, case when attached then 'application/pdf' else '' end as attachment_types, left(sha256(message_id || '|' || title || '|' || left(content, 500)), 16) as content_hash from mail"),
    "mail_flags": _mail("select id, own as is_sent_by_me, auto as is_auto_reply, bounce as is_bounce, notice as is_system_notification from mail"),
    "mail_contact_score": _mail("select id, score >= 0.2 as is_contact, round(least(score, 1.0), 9)::double as confidence from points", _POINTS),
    "mail_threads": _mail("select id, conv_id * 100 + 1 as thread_id from mail"),
    "thread_of_message": _mail("select message_id, conv_id * 100 + 1 as thread_id from mail where id % 10 = 3"),
    "mail_thread_replies": _mail("select distinct o.person as email, r.id, r.auto as is_auto from mail o join mail r on o.own and not r.own and not r.bounce and r.conv_id = o.conv_id"),
    "mail_reference_replies": _mail("select r.person as email, r.id, case when max((r.irt = o.message_id)::int) = 1 then 'in_reply_to' else 'references' end as reason, r.auto as is_auto from mail o join mail r on o.own and not r.own and not r.bounce and not r.notice and (r.irt = o.message_id or list_contains(string_split(r.refs, ','), o.message_id)) group by all"),
    "mail_other_addresses": _mail("select distinct o.person as email, r.sender as address from mail o join mail r on o.own and r.notice and not r.bounce and not r.auto and r.conv_id = o.conv_id"),
    "recipient_names": _mail("select id, person as email, 'Prof. ' || split_part(person, '@', 1) as name from mail where own"),
    "institution_text": "select p_partkey, ['清华大学', '北京大学', '中国科学院自动化研究所', '', '浙江大学'][p_partkey % 5 + 1] as institution from part",
    "subject_prefix": "select p_partkey, ['Re:', 'RE：', 'Fwd:', '转发:', '回复：', '', ''][p_partkey % 7 + 1] as prefix from part",
    "folder_lines": r"select p_partkey, ['\HasNoChildren \Sent', '\Noselect', '', '\Trash'][p_partkey % 4 + 1] as flags, ['/', '/', '.', 'NIL'][p_partkey % 4 + 1] as delimiter, ['Sent Items', 'INBOX', '&g0l6P3ux-', 'Old mail'][p_partkey % 4 + 1] as raw_name, ['Sent Items', 'INBOX', '草稿箱', 'Old mail'][p_partkey % 4 + 1] as name from part",
    "folder_states": "select p_partkey, case when p_partkey % 3 = 0 then p_partkey else 0 end as messages, case when p_partkey % 3 = 0 then 0 else p_partkey end as uidvalidity, case when p_partkey % 3 = 0 then 7 else 0 end::bigint as uidnext from part",
    "folder_roles": "select p_partkey, p_partkey % 3 = 0 as is_sent, p_partkey % 3 = 1 as is_inbox from part",
    "folder_totals": "select count(*) as n_folders, sum(p_size)::bigint as n_messages from part where p_partkey % 4 <> 0",
    "datetime_format": "select o_orderkey, case when o_orderkey % 5 > 0 then strftime(o_orderdate, '%Y-%m-%d %H:%M') else '' end as shown from orders",
    "mask_everything": f"select p_partkey, t as masked, left(t, 20) || {_q(L.CUT_MARK)} as cut from (select p_partkey, {_MASKED} || '写给 l***@mail.example.com ' || p_name as t from part)",
    "merge_of_two": "select 'c' || k as email, count(*) as send_count from (select case when o_custkey = 4 then 1 else o_custkey end as k from orders where o_custkey <> 4 or exists (select 1 from orders where o_custkey = 1)) group by k",
    "display_table": _with('select "index" as "序号", name as "导师姓名", institution as "学校/单位", email as "邮箱", send_count as "发送次数", has_real_reply as "回复状态", reply_time as "回复时间", admission_intent as "招生意向", my_reply_status as "我是否回复", action_required as "建议行动", confidence as "置信度", needs_review as "需要复核" from merged', _SCORE, _PEOPLE, _TABLES, _MERGED),
    "export_preview": _with('select "index", email, send_count from merged where "index" <= 10', _SCORE, _PEOPLE, _TABLES, _MERGED),
    "merged_with_logs": _with('select row_number() over (order by name, email) as "index", * from final', _SCORE, _PEOPLE, _TABLES, _MERGED, _LOGGED),
    "archive_bodies": _with(f"select id, sha256(case when {_strip('body')} = '' then '' else body || chr(10) end) as body_hash from m"),
    "archive_of_a_month": _with("select id, replace(left(date, 19), 'T', ' ') as sent from m where left(date, 7) = '2024-03'"),
    "keyed_changes": """
        with o as (select o_custkey as k, count(*) as n, max(o_orderdate)::date as last from orders group by all),
        t as (select coalesce(c.c_custkey, o.k) as k, coalesce(c_name, 'from orders') as name, c_mktsegment as segment, o.n as orders, o.last
              from (select * from customer where c_custkey % 3 > 0) c full join o on c.c_custkey = o.k)
        select k::bigint as k, name, case when c_nationkey = 5 then lower(segment) else segment end as segment,
            case when c_nationkey = 5 then coalesce(orders, 0) + 1 else orders end as orders, last
        from t left join customer on c_custkey = k where coalesce(c_acctbal >= 0, true)
    """,
    "clear_account": """
        select 'person' as kind, c_custkey::bigint as id from customer where c_nationkey <> 3 union all
        select 'link', o_orderkey::bigint from orders where not exists (select 1 from customer where c_custkey = o_custkey and c_nationkey = 3)
    """,
    "sync_epochs": "select (user_id % 5)::bigint as folder_id, case when user_id % 5 = 2 then 8 else 7 end::bigint as uidvalidity, event_id::bigint as uid, event_type as body from events where user_id % 5 <> 2 or event_id % 2 = 1",
    "mail_joined_addresses": _mail(
        """
        select email, email || coalesce('; ' || others, '') as emails, coalesce(n, 0) as n_replies from (select distinct person as email from mail where own)
        left join (select email, string_agg(address, '; ' order by first, address) as others from found where first is not null group by 1) using (email)
        left join (select email, count(distinct id) as n from (select email, id from mates where not auto union all select email, id from later where not auto) group by 1) using (email)
        """,
        f"""
        mates as (select distinct o.person as email, r.id, r.sender, r.sent_at, r.auto from mail o join mail r on o.own and not r.own and not r.bounce and r.conv_id = o.conv_id),
        found as (select email, sender as address, min((sent_at, id)) as first from mates where not auto and sender <> email group by 1, 2
            union all select distinct person, person, null from mail where own),
        later as (select a.email, r.id, r.auto from found a join mail r on r.sender = a.address and not r.own and not r.bounce and (a.first is null or (r.sent_at, r.id) > a.first)
            where exists (select 1 from mail s where s.own and s.person = a.email and (r.irt = s.message_id or list_contains(string_split(r.refs, ','), s.message_id)
                or (s.norm <> '' and r.norm <> '' and (s.norm = r.norm or {_jaccard(_letters("s.norm"), _letters("r.norm"))} >= 0.6)))))
        """,
    ),
    "mail_match_methods": _mail(
        """
        select id, coalesce(m, '') as match_method from mail left join (
            select id, arg_min(method, w) as m from (select unnest([a, b]) as id, method, w from edge where not exists (select 1 from reach where reach.w = edge.w and reach.node = edge.b)) group by 1) using (id)
        """,
        """
        cited as (select id, conv_id, sent_at, 0 as slot, irt as ref, 'in_reply_to' as method from mail where irt <> ''
            union all select id, conv_id, sent_at, i, split_part(refs, ',', i::int), 'references' from mail, unnest(range(1, 3)) as u(i) where split_part(refs, ',', i::int) <> ''),
        edge as (select c.id as a, t.id as b, c.conv_id, c.method, row_number() over (order by c.sent_at, c.id, c.slot) as w from cited c join mail t on t.message_id = c.ref where t.id <> c.id),
        reach as (select w, conv_id, a as node from edge union
            select reach.w, reach.conv_id, case when edge.a = reach.node then edge.b else edge.a end from reach join edge on edge.conv_id = reach.conv_id and edge.w < reach.w and reach.node in (edge.a, edge.b))
        """,
    ),
    "arriving_threads": _mail("select id, conv_id * 100 + 1 as thread_id from mail"),
    "json_file": _with('select count(*) over () as correspondent_count, "index", email, name, email as emails, send_count, has_real_reply, admission_intent, action_required, confidence from merged', _SCORE, _PEOPLE, _TABLES, _MERGED),
    "csv_file": _with("""select "index", email as emails, nullif(name, '') as name, nullif(institution, '') as institution, send_count::varchar as send_count, has_real_reply, admission_intent, case when needs_review then '是' else '否' end as needs_review from merged""", _SCORE, _PEOPLE, _TABLES, _MERGED),
    "model_answers": "select p_partkey::varchar as email, 'no. ' || p_partkey as summary, (p_partkey % 10) / 10.0 as confidence from part where p_partkey % 3 <> 0",
    "indexed_search": "select (conv_id * 100 + turn)::bigint as id, role from conversations where contains(lower(concat_ws(' ', conv_id * 100 + turn, role, text)), 'tion a')",
    "rule_summaries": _with(
        f"""
        select id, case when kind is not null then f.summary else left(t, 300) end as rule_summary,
            case when kind is not null then '' else array_to_string(list_filter(s, lambda x: length(x) >= 4 and {_any("x", (*_POS, *_UNC, *_NEG))})[1:5], '|') end as evidence,
            case when kind is not null then f.step else a.step end as rule_next_step
        from (select *, {_intent("t")} as code, list_filter(list_transform(regexp_split_to_array(t, '[。！？\n;；.!?]+'), lambda x: {_strip("x")}), lambda x: x <> '') as s from
            (select id, {_read_part("body")} as t, case when id % 5 = 0 then {_q(L.NO)} when id % 5 = 1 then {_q(L.UNSURE)} when id % 7 = 0 or {_strip("body")} = '' then 'blank' end as kind from m)) r
        left join (values {", ".join(f"({_q(k)}, {_q(v[0])}, {_q(v[3])})" for k, v in L.FIXED_RESULTS.items())}) as f(kind2, summary, step) on f.kind2 = kind
        join intents i on i.code = r.code join actions a on a.code = i.todo
        """,
        _TABLES,
    ),
    "mask_truncate": f"select doc_id, length(t)::bigint as n, sha256(t) as cut_hash from (select doc_id, case when length(m) > 3000 then left(m, 3000) || {_q(L.CUT_MARK)} else m end as t from (select doc_id, {_masked_text("coalesce(text, '')")} as m from documents))",
    "reply_with_threads": _with("select email, status, n as n_replies from stat", _SCORE, _IN_THREADS),
    "institution_varied": f"select p_partkey, {_institution('said')} as institution from (select p_partkey, {_pick(_OPENERS, 1)} || {_pick(_VERBS, 6)} || {_pick(_PLACES, 30)} || ' ' || p_name as said from part)",
    "salutation_names": f"select p_partkey, {_salutation('left(body, 500)')} as name from (select p_partkey, {_pick(_GREETINGS, 1)} || {_pick(_NAMES, 5)} || {_pick(_TITLES, 30)} || '，' || p_name as body from part)",
    "sent_by_date": _mail("select row_number() over (order by sent_at, id) as place, id, sent_at as date from mail where own"),
    "alias_file": """select c_name || ', "Prof."' as teacher_name, null::varchar as institution, 'p' || c_custkey || '@x.cn' as email, 'q' || c_custkey || '@y.cn' as alias_email, c_mktsegment as notes from customer""",
    "merged_details": _full('select "index", email, emails, reply_summary, evidence, recommended_next_step from full_table'),
    "display_texts": _full('select "index" as "序号", name as "导师姓名", institution as "学校/单位", emails as "邮箱", send_count as "发送次数", has_real_reply as "回复状态", reply_time as "回复时间", reply_summary as "回复摘要", admission_intent as "招生意向", my_reply_status as "我是否回复", action_required as "建议行动", confidence as "置信度", needs_review as "需要复核" from full_table'),
    "export_texts": _full(f"""select "index"::varchar as row, {", ".join(map(_guarded, _TEXTS))}, send_count::varchar as send_count, confidence::varchar as confidence, '是' as needs_review from full_table"""),
}
