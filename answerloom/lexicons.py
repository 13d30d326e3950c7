"""Default word lists and patterns. Every operator takes them as parameters; these are the fixed default values."""

# Case marks, section marks and exception marks of structured documents.
FAQ_SECTIONS = ("faq", "常见问题", "客服问答")
MANUAL_SECTIONS = ("开通前准备", "开通方式", "操作步骤", "取消自动续费", "支付成功但会员未到账", "发票申请", "故障处理", "兑换码开通")
POLICY_SECTIONS = ("服务简介", "套餐类型", "会员权益", "生效时间", "有效期", "设备规则", "自动续费管理", "支付、订单", "退款", "取消规则")
EXCEPTION_MARKERS = ("但", "但是", "不过", "除非", "例外", "不适用", "不得", "不支持")
QUESTION_OPENINGS = ("如何", "怎么", "是否", "什么", "为什么", "哪里", "多久")

# Domain terms the bigram tokenizer emits besides the bigrams.
DOMAIN_TERMS = (
    "大会员", "连续包月", "自动续费", "订阅管理", "支付成功", "未到账", "订单号", "支付流水", "无理由退款", "重复扣费", "会员权益",
    "有效期", "兑换码", "电视端", "客户端", "版权限制", "人工核查", "账号申诉", "创作激励", "账号", "退款", "扣费", "套餐", "视频", "会员",
)

# Product names with the surfaces that count as a mention.
PRODUCT_ALIASES = {
    "大会员": ("大会员", "会员"),
    "连续包月": ("连续包月", "自动续费"),
    "年度套餐": ("年度套餐", "年度", "年费"),
    "季度套餐": ("季度套餐", "季度"),
    "单月套餐": ("单月套餐", "单月"),
    "电视端": ("电视端", "电视", "TV端"),
}

# Score bands (kind, answer line, clarify line).
SCORE_BANDS = (
    ("hybrid_rrf", 0.030, 0.0295), ("vector_cosine", 0.75, 0.60), ("bm25_okapi", 2.0, 1.0), ("rerank", 0.75, 0.50),
)
# Retrieval policies (id, version, domain, action); NULL matches everything.
POLICIES = (("membership-query-v2", 2, "membership", "query"), ("global-conservative-v2", 2, None, None))

# Claim checking.
NEGATIONS = ("不支持", "不能", "不会", "不得", "无法", "未", "没有", "不可")
PREDICATES = ("退款", "退费", "转移", "到账", "显示", "续费", "生效", "支持", "扣费", "封禁", "登录", "支付", "取消")
NUMBER_PATTERN = r"(?U)\d+(?:\.\d+)?(?:%|分钟|小时|天|元|个月|年)?"
HARD_FAILURES = ("missing_evidence_content", "numeric_fact_missing", "negation_conflict")

# Follow-up rewriting.
REWRITE_ENTITIES = ("移动", "联通", "电信")
REWRITE_TOPICS = ("大会员", "自动续费", "会员", "订单", "账号", "创作激励", "稿件", "视频", "评论", "弹幕", "直播", "客户端", "电视端")
REWRITE_ELLIPSIS = "^(?:这个|它|那)?(?:多少钱|什么价格|价格(?:呢|是多少)?|怎么收费|多久(?:生效)?|什么时候生效|能做什么|有什么用|权益(?:呢|有哪些)?|怎么取消|能退款吗|可以退款吗)[？?。！!]*$"
CONTEXT_ELLIPSIS = "^(?:这个|它|那)?(?:多少钱|什么价格|价格(?:呢|是多少)?|怎么收费|多久(?:生效)?|什么时候生效|能做什么|有什么用|权益(?:呢|有哪些)?|怎么取消|能退款吗|可以退款吗|怎么办)[？?。！!]*$"
RESET_PHRASE = r"(?U)^(?:换个问题|先不说这个|重新问|新问题)[，,:：\s]*(.*)$"
DOMAIN_LABELS = {
    "membership": "大会员", "order": "订单", "account": "账号", "creator": "创作者业务", "content": "内容", "community": "社区功能",
    "technical": "客户端问题", "human_service": "人工服务",
}
# Which question words narrow the topic to which domains, first match wins.
TOPIC_SLOTS = (
    (("多少钱", "价格", "收费"), ("membership", "order")),
    (("生效", "多久", "什么时候"), ("membership", "order", "account")),
    (("权益", "能做什么", "有什么用"), ("membership",)),
    (("取消", "退款"), ("membership", "order")),
)

# Intent rules and policies.
GREETINGS = ("你好", "您好", "嗨", "hi", "hello")
TRANSFER_REQUESTS = ("转人工", "人工客服", "联系人工客服")
PRICE_PRODUCT = "大会员"
PRICE_MARKERS = ("多少钱", "价格", "怎么收费", "费用")
ROUTES = ("supported", "out_of_domain", "chitchat", "unsafe")
RISKS = ("low", "medium", "high", "critical")
RISK_FLOORS = (
    ("membership", "refund", "medium"), ("order", "refund", "medium"), ("account", "recover", "high"),
    ("account", "appeal", "medium"), ("creator", "appeal", "medium"), ("content", "appeal", "medium"),
    ("content", "report", "medium"), ("community", "appeal", "medium"), ("community", "report", "medium"),
)
PROCESS_MARKERS = ("怎么", "如何", "在哪里", "哪儿", "入口", "流程", "教程", "步骤", "需要什么", "告诉我怎么")
EXECUTION_MARKERS = ("帮我", "替我", "给我", "请", "我要", "我想", "查一下", "申请", "提交", "退款", "取消", "举报", "修改", "换成")
ORDER_ID = r"(?iU)\b(?:BILI)?[A-Z0-9-]{8,}\b"
CONTENT_ID = r"(?iU)\b(?:BV|AV)\w{5,}\b"
CREDENTIAL_THEFT = r"(?i)(?:偷取|窃取|盗取|获取).{0,12}(?:登录凭证|密码|cookie|token|令牌)"
COVERT_SELF_HARM = (
    "(?:自残|自伤).{0,16}(?:不被发现|不会被?发现|不容易被?发现|隐蔽|偷偷)|(?:不被发现|不会被?发现|不容易被?发现|隐蔽|偷偷).{0,16}(?:自残|自伤)"
)
# Fixed values: (domain, action, entity types that satisfy it, pattern that satisfies it, question to ask).
PARAMETER_NEEDS = (
    ("order", "query", ("order_id",), ORDER_ID, "请提供需要处理的订单号。"),
    ("order", "cancel", ("order_id",), ORDER_ID, "请提供需要处理的订单号。"),
    ("order", "refund", ("order_id",), ORDER_ID, "请提供需要处理的订单号。"),
    ("membership", "refund", ("order_id", "transaction_id"), None, "请提供自动扣费的交易号或订单号。"),
    ("content", "report", ("content_id",), CONTENT_ID, "请提供需要举报的内容链接或内容 ID，并说明举报原因。"),
    ("account", "modify", ("account_id", "other"), None, "请说明需要修改的账号资料及新的信息。"),
)

# Replies published when an answer does not pass.
REPLY_INVALID = "知识回答未通过结构或引用校验，本次没有展示未经验证的模型内容。请换一种描述重试，或转人工核查。"
REPLY_UNVERIFIED = "知识校验服务未返回结果，本次已安全拦截。请稍后重试或转人工核查。"
REPLY_REST = "其余内容证据不足，建议补充信息或转人工核查。"
REPLY_DEGRADE = "当前证据或语义校验不足，无法形成可靠回答。请缩小问题范围或转人工核查。"
REPLY_REJECT = "当前生成内容存在缺少证据支持或证据冲突，本次已安全拦截。请补充信息或转人工核查。"
ASK_WEAK = "当前证据相关性有限，请补充更具体的产品、套餐或问题现象。"

# Audit codes after which a checkpoint may be retried.
RETRYABLE_CODES = ("MODEL_UNAVAILABLE", "SERVICE_NOT_READY", "INTERNAL_ERROR")

# Lines of manuals, frequently asked questions and table rows.
STEP_LINE = r"(?U)^\s*(?:(?:第\s*)?(\d+)\s*(?:步|[.、)]))[ \t]*(.+)$"
BULLET_LINE = r"(?U)^\s*[-*•]\s+(.+)$"
ROW_PREFIX = r"(?U)^第(\d+)行[：:]\s*"
QUESTION_LINE = r"(?iU)^\s*(?:问|Q)\s*[：:]\s*(.+?)\s*$"
ANSWER_LINE = r"(?iU)^\s*(?:答|A)\s*[：:]\s*(.*?)\s*$"
KEYWORD_LINE = r"(?iU)^\s*(?:关键词|关键字|keywords?)\s*[：:]\s*(.*?)\s*$"
QUESTION_LABEL = r"(?iU)^\s*(?:问|Q)[：:]\s*"
QUESTION_LABELS = ("问：", "问:", "Q:", "Q：")
QUESTION_ENDINGS = ("？", "?", "吗", "么")

# Texts asked or shown for missing entities.
SUPPLEMENT_LINE = "\n重点检索对象："
UNCOVERED_BEFORE = "当前资料尚未覆盖："
UNCOVERED_AFTER = "。请确认要重点了解哪一项？"
