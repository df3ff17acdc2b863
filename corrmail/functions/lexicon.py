"""Vocabularies, word lists, patterns and tables that results depend on.  All are defaults that callers can replace.

Everything in this module is fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Keywords of outreach mail.
SUBJECT_KEYWORDS = ("硕士保研自荐", "保研自荐", "夏令营", "预推免", "研究生自荐", "推免申请", "附简历")
BODY_KEYWORDS = ("保研", "夏令营", "预推免", "研究生", "招生", "名额", "课题组", "推荐免试", "推免", "自荐")

# Keywords of replies.
POSITIVE = ("欢迎报名", "欢迎申请", "可以报名", "有名额", "可以接收", "欢迎加入", "保持联系", "加微信", "安排面试", "线上交流", "发一下材料", "报名后联系", "参加夏令营", "参加预推免")
UNCERTAIN = ("名额未定", "还不确定", "等政策", "等通知", "后续联系", "到时候再说", "通过考核", "择优录取")
NEGATIVE = ("名额已满", "没有名额", "不招生", "方向不符", "不太匹配", "建议联系其他老师", "无法接收", "已招满")

# Automatic mail.
BOUNCE_SENDERS = ("mailer-daemon", "postmaster", "mail delivery subsystem")
BOUNCE_SUBJECTS = ("delivery status notification", "undelivered mail", "投递失败", "退信", "邮箱不存在", "mail delivery failed", "returned to sender")
AUTO_HEADERS = {"auto-submitted": ("auto-replied", "auto-generated", "auto-notified"), "precedence": ("auto_reply", "bulk", "junk"), "x-autoreply": (), "x-autorespond": ()}
AUTO_SUBJECTS = ("自动回复", "自动答复", "out of office", "automatic reply", "放假通知", "假期自动回复")
SYSTEM_SENDERS = ("noreply", "no-reply", "system", "notification", "admin@")
ACADEMIC_DOMAINS = (".edu.cn", ".edu", ".ac.cn", ".ac.", ".cas.cn", ".pku.edu.cn", ".tsinghua.edu.cn")
RESUME_WORDS = ("简历", "cv", "resume", "个人简介")

# Institutions named in text.
INSTITUTION_STOP_WORDS = ("我是", "就读", "毕业", "在读", "近期", "了解")
INSTITUTION_PREFIXES = ("我是", "就读于", "毕业于", "想申请", "在读", "在", "近期", "了解", "报考", "联系", "向", "给", "我", "是", "的", "去")
INSTITUTION_SELF = (r"我是[一-龥]{2,10}(大学|学院)", r"就读于[一-龥]{2,10}(大学|学院)", r"毕业于[一-龥]{2,10}(大学|学院)", r"在[一-龥]{2,10}(大学|学院)学习")
INSTITUTION_PATTERNS = (r"[一-龥]{2,10}大学", r"[一-龥]{2,10}研究所", r"[一-龥]{2,10}研究院", r"[一-龥]{2,15}学院")
ACADEMY = "中国科学院"
DOMAINS = {
    "pku.edu.cn": "北京大学", "tsinghua.edu.cn": "清华大学", "zju.edu.cn": "浙江大学", "sjtu.edu.cn": "上海交通大学",
    "fudan.edu.cn": "复旦大学", "ustc.edu.cn": "中国科学技术大学", "nju.edu.cn": "南京大学", "whu.edu.cn": "武汉大学",
    "hust.edu.cn": "华中科技大学", "sysu.edu.cn": "中山大学", "hit.edu.cn": "哈尔滨工业大学", "xidian.edu.cn": "西安电子科技大学",
    "seu.edu.cn": "东南大学", "scut.edu.cn": "华南理工大学", "xmu.edu.cn": "厦门大学", "uestc.edu.cn": "电子科技大学",
    "bupt.edu.cn": "北京邮电大学", "ecnu.edu.cn": "华东师范大学", "neu.edu.cn": "东北大学", "tongji.edu.cn": "同济大学",
    "nankai.edu.cn": "南开大学", "tju.edu.cn": "天津大学", "sdu.edu.cn": "山东大学", "cqu.edu.cn": "重庆大学",
    "scu.edu.cn": "四川大学", "xjtu.edu.cn": "西安交通大学", "nwpu.edu.cn": "西北工业大学", "dlut.edu.cn": "大连理工大学",
    "jlu.edu.cn": "吉林大学", "lzu.edu.cn": "兰州大学", "buaa.edu.cn": "北京航空航天大学", "bit.edu.cn": "北京理工大学",
    "ustb.edu.cn": "北京科技大学", "bjtu.edu.cn": "北京交通大学", "ncepu.edu.cn": "华北电力大学", "cumt.edu.cn": "中国矿业大学",
    "upc.edu.cn": "中国石油大学（华东）", "upb.edu.cn": "中国石油大学（北京）", "ugb.edu.cn": "中国地质大学（北京）", "cug.edu.cn": "中国地质大学（武汉）",
    "swjtu.edu.cn": "西南交通大学", "nuaa.edu.cn": "南京航空航天大学", "njust.edu.cn": "南京理工大学", "hhu.edu.cn": "河海大学",
    "jiangnan.edu.cn": "江南大学", "hebut.edu.cn": "河北工业大学", "taur.edu.cn": "太原理工大学", "imu.edu.cn": "内蒙古大学",
    "dhu.edu.cn": "东华大学", "shmtu.edu.cn": "上海海事大学", "shutcm.edu.cn": "上海中医药大学", "yzu.edu.cn": "扬州大学",
    "ujs.edu.cn": "江苏大学", "njtech.edu.cn": "南京工业大学", "huel.edu.cn": "湖北工业大学", "hbut.edu.cn": "湖北工业大学",
    "wust.edu.cn": "武汉科技大学", "whut.edu.cn": "武汉理工大学", "ccnu.edu.cn": "华中师范大学", "hzau.edu.cn": "华中农业大学",
    "zuel.edu.cn": "中南财经政法大学", "csu.edu.cn": "中南大学", "hunnu.edu.cn": "湖南师范大学", "szu.edu.cn": "深圳大学",
    "jnu.edu.cn": "暨南大学", "scau.edu.cn": "华南农业大学", "gxu.edu.cn": "广西大学", "hnu.edu.cn": "海南大学",
    "swufe.edu.cn": "西南财经大学", "sicau.edu.cn": "四川农业大学", "cdut.edu.cn": "成都理工大学", "yuntc.edu.cn": "云南大学",
    "ynu.edu.cn": "云南大学", "guet.edu.cn": "桂林电子科技大学", "gzu.edu.cn": "贵州大学", "xju.edu.cn": "新疆大学",
    "shzu.edu.cn": "石河子大学", "ime.ac.cn": "中国科学院微电子研究所", "ucas.ac.cn": "中国科学院大学", "ucas.edu.cn": "中国科学院大学",
}

# Folder types by flag and by name, in the order in which they are tried.
FOLDER_FLAGS = (("\\sent", "sent"), ("\\drafts", "drafts"), ("\\junk", "spam"), ("\\trash", "trash"), ("\\archive", "archive"), ("\\all", "archive"), ("\\inbox", "inbox"))
FOLDER_NAMES = (
    ("inbox", ("inbox", "收件箱")),
    ("sent", ("sent", "已发送", "Sent Messages", "已发邮件", "Sent Items", "已发送邮件")),
    ("drafts", ("drafts", "草稿", "草稿箱", "Draft")),
    ("spam", ("junk", "spam", "垃圾邮件", "垃圾箱")),
    ("trash", ("trash", "deleted", "已删除", "废纸篓", "Deleted Messages", "Deleted Items")),
    ("archive", ("archive", "归档", "存档", "All Mail")),
)
FOLDER_TYPES = ("inbox", "sent", "drafts", "spam", "trash", "archive", "other")

# Labels of statuses, roles, intents and actions.
YES, NO, UNSURE = "是", "否", "无法确认"
REPLIED, NOT_REPLIED, NO_NEED = "已回复", "未回复", "无需回复"
ROLES = {"first": "首次套磁", "followup": "补发邮件", "second": "第二封套磁", "supplement": "补充材料", "reply": "我的回复", "thanks": "感谢信", "received": "导师回复", "auto": "自动回复", "bounce": "退信", "other": "其他收件"}
INTENTS = {
    "ACCEPT_WITH_QUOTA": "明确愿意接收，且有招生名额",
    "WELCOME_JOIN": "明确欢迎加入或重点考虑",
    "WELCOME_APPLY_NEED_EXAM": "欢迎报名，但仍需参加考核",
    "SUGGEST_SUMMER_CAMP": "建议参加夏令营",
    "SUGGEST_PRE_ADMISSION": "建议参加预推免",
    "WILLING_TO_TALK": "愿意进一步交流或安排面试",
    "ADDED_WECHAT": "已添加微信，转入其他方式沟通",
    "NEED_MORE_MATERIAL": "需要补充材料后再判断",
    "QUOTA_UNCERTAIN": "暂时无法确定招生名额",
    "WAIT_POLICY": "需要等待学院招生政策",
    "WAIT_EXAM_RESULT": "需要等待夏令营或预推免考核结果",
    "POLITE_NO_INTENT": "礼貌回复，但未表达明确接收意向",
    "QUOTA_FULL": "名额已满",
    "DIRECTION_MISMATCH": "研究方向不匹配",
    "REJECTED": "明确拒绝",
    "NO_REPLY": "尚未回复",
    "UNCERTAIN": "无法确认",
}
ACTIONS = {
    "REPLY_NOW": "需要立即回复",
    "POLITE_REPLY": "建议礼貌回复",
    "SEND_MATERIAL": "需要补充材料",
    "ADD_WECHAT": "需要添加微信",
    "WAIT_TEACHER": "等待导师后续通知",
    "WAIT_EXAM": "等待夏令营或预推免结果",
    "CONTACT_LATER": "在指定时间再次联系",
    "ALREADY_REPLIED": "已经回复，无需重复回复",
    "NO_ACTION": "暂时无需回复",
    "CONSIDER_FOLLOWUP": "尚未回复，可考虑跟进",
    "UNCERTAIN": "无法确认",
}
#: intent: (action if the owner has replied, action otherwise, statistics bucket).
INTENT_ACTIONS = {
    "ACCEPT_WITH_QUOTA": ("ALREADY_REPLIED", "REPLY_NOW", "positive_intent"),
    "WELCOME_JOIN": ("ALREADY_REPLIED", "REPLY_NOW", "positive_intent"),
    "WELCOME_APPLY_NEED_EXAM": ("ALREADY_REPLIED", "POLITE_REPLY", "welcome_apply"),
    "SUGGEST_SUMMER_CAMP": ("WAIT_EXAM", "WAIT_EXAM", "suggest_camp"),
    "SUGGEST_PRE_ADMISSION": ("WAIT_EXAM", "WAIT_EXAM", "suggest_camp"),
    "WILLING_TO_TALK": ("ALREADY_REPLIED", "POLITE_REPLY", "willing_to_talk"),
    "ADDED_WECHAT": ("ADD_WECHAT", "ADD_WECHAT", "willing_to_talk"),
    "NEED_MORE_MATERIAL": ("SEND_MATERIAL", "SEND_MATERIAL", None),
    "QUOTA_UNCERTAIN": ("WAIT_TEACHER", "WAIT_TEACHER", "quota_uncertain"),
    "WAIT_POLICY": ("WAIT_TEACHER", "WAIT_TEACHER", "quota_uncertain"),
    "WAIT_EXAM_RESULT": ("WAIT_TEACHER", "WAIT_TEACHER", "quota_uncertain"),
    "POLITE_NO_INTENT": ("UNCERTAIN", "UNCERTAIN", "polite_no_intent"),
    "QUOTA_FULL": ("NO_ACTION", "NO_ACTION", "negative"),
    "DIRECTION_MISMATCH": ("NO_ACTION", "NO_ACTION", "negative"),
    "REJECTED": ("NO_ACTION", "NO_ACTION", "negative"),
    "NO_REPLY": ("CONSIDER_FOLLOWUP", "CONSIDER_FOLLOWUP", None),
    "UNCERTAIN": ("UNCERTAIN", "UNCERTAIN", None),
}
NEXT_STEPS = {
    "REPLY_NOW": "建议尽快回复导师，表达感谢并确认意向",
    "POLITE_REPLY": "建议礼貌回复，表达感谢和继续关注的意愿",
    "SEND_MATERIAL": "按导师要求准备并发送补充材料",
    "ADD_WECHAT": "按导师提供的微信号添加好友",
    "WAIT_TEACHER": "等待导师后续通知，期间可准备相关材料",
    "WAIT_EXAM": "关注夏令营/预推免报名通知，按时提交申请",
    "CONTACT_LATER": "在导师建议的时间再次联系",
    "ALREADY_REPLIED": "已回复，保持关注后续进展",
    "NO_ACTION": "该导师暂无可行性，可将精力转向其他导师",
    "CONSIDER_FOLLOWUP": "可以考虑再次发送邮件跟进",
    "UNCERTAIN": "建议人工查看邮件详情后决定",
}
#: status: (summary, intent, action, next step, confidence) of correspondents without a readable reply.
FIXED_RESULTS = {
    NO: ("未检索到导师本人或课题组针对套磁邮件的有效回复。", "NO_REPLY", "CONSIDER_FOLLOWUP", "可以考虑再次联系或等待", 0.9),
    UNSURE: ("仅发现相关会话或我发出的回复邮件，未读取到导师原始回复正文，因此无法确认。", "UNCERTAIN", "UNCERTAIN", "建议人工检查邮箱确认", 0.3),
    "blank": ("导师回复正文为空或无法解析", "UNCERTAIN", "UNCERTAIN", "", 0.2),
}
#: Column labels of the exported table, and labels of the statistics.
COLUMN_LABELS = {
    "index": "序号", "name": "导师姓名", "institution": "学校/研究单位", "emails": "导师邮箱", "first_sent_at": "首次发送时间",
    "last_sent_at": "最近发送时间", "send_count": "发送次数", "correspondence": "邮件往来情况", "has_real_reply": "是否收到真实回复",
    "reply_time": "导师回复时间", "responder": "实际回复人", "reply_summary": "导师回复核心内容", "evidence": "关键证据句",
    "admission_intent": "招生意向判断", "my_reply_status": "我是否已回复", "action_required": "现在是否需要回复",
    "recommended_next_step": "建议下一步行动", "confidence": "识别置信度", "needs_review": "是否需要人工复核",
}
STAT_LABELS = {
    "total_related_emails": "相关邮件总数", "sent_emails": "已发送相关邮件数", "received_reply_emails": "有效回复邮件数",
    "auto_reply_count": "自动回复数", "bounce_count": "退信数", "correspondent_count": "去重后导师总数",
    "replied_count": "已确认收到真实回复人数", "uncertain_count": "无法确认回复人数", "no_reply_count": "未回复人数",
    "reply_rate": "有效回复率(%)", "positive_intent_count": "明确积极意向人数", "welcome_apply_count": "欢迎报名但仍需考核人数",
    "suggest_camp_count": "建议参加夏令营/预推免人数", "willing_to_talk_count": "愿意进一步交流人数",
    "quota_uncertain_count": "暂时无法确定名额人数", "polite_no_intent_count": "礼貌回复态度不明确人数",
    "negative_count": "名额已满/拒绝人数", "need_reply_now_count": "需要立即回复人数", "suggest_followup_count": "建议跟进人数",
    "needs_review_count": "需要人工复核人数", "consistency": "数据一致性",
}

# Private data and what replaces it.
PHONE, PHONE_MASK = r"1[3-9]\d{9}", "***手机号***"
NATIONAL_ID, NATIONAL_ID_MASK = r"\d{17}[\dXx]", "***身份证号***"
ADDRESS, ADDRESS_MASK = r"(?:省|市|区|县|路|街|号|栋|单元|室).{5,30}", "***地址***"
CUT_MARK = "\n...(已截断)"


@dataclass(frozen=True)
class ReplyRules:
    """Lexicons of the reply classifier and, for each kind, its intents in the order of precedence."""

    positive: tuple[str, ...] = POSITIVE
    uncertain: tuple[str, ...] = UNCERTAIN
    negative: tuple[str, ...] = NEGATIVE
    # Fixed values: (any of these words, intent); the last one of a kind needs none.
    positive_intents: tuple = field(
        default=(
            (("可以接收", "有名额"), "ACCEPT_WITH_QUOTA"),
            (("欢迎加入",), "WELCOME_JOIN"),
            (("微信",), "ADDED_WECHAT"),
            (("夏令营",), "SUGGEST_SUMMER_CAMP"),
            (("预推免",), "SUGGEST_PRE_ADMISSION"),
            (("面试", "交流", "线上"), "WILLING_TO_TALK"),
            (("欢迎报名", "欢迎申请", "可以报名"), "WELCOME_APPLY_NEED_EXAM"),
            (("发一下材料", "补充材料"), "NEED_MORE_MATERIAL"),
        )
    )
    uncertain_intents: tuple = field(default=((("名额未定", "还不确定"), "QUOTA_UNCERTAIN"), (("等政策",), "WAIT_POLICY")))
    negative_intents: tuple = field(default=((("名额已满", "已招满"), "QUOTA_FULL"), (("方向不符", "不太匹配"), "DIRECTION_MISMATCH")))
