"""Column functions on queries: whether to search at all, what is asked for, and more words for the keyword search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import ascii_borders, trimmed

# Texts that need no search, and those that need one however short.
SKIPPED = (
    r"(?i)^(hi|hello|hey|good\s*(morning|afternoon|evening|night)|greetings|yo|sup|howdy|what'?s up)\b",
    r"^/",
    r"(?i)^(run|build|test|ls|cd|git|npm|pip|docker|curl|cat|grep|find|make|sudo)\b",
    r"(?i)^(yes|no|yep|nope|ok|okay|sure|fine|thanks|thank you|thx|ty|got it|understood|cool|nice|great|good|perfect|awesome|👍|👎|✅|❌)\s*[.!]?$",
    r"(?i)^(go ahead|continue|proceed|do it|start|begin|next|实施|實施|开始|開始|继续|繼續|好的|可以|行)\s*[.!]?$",
    r"^[0-9#*\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{23FA}\x{24C2}\x{25AA}-\x{25FE}\x{2600}-\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}\s]+$",
    r"(?i)HEARTBEAT",
    r"(?i)^\[System",
    r"(?i)^(ping|pong|test|debug)\s*[.!?]?$",
)
FORCED = (
    r"(?i)\b(remember|recall|forgot|memory|memories)\b",
    r"(?i)\b(last time|before|previously|earlier|yesterday|ago)\b",
    r"(?i)\b(my (name|email|phone|address|birthday|preference))\b",
    r"(?i)\b(what did (i|we)|did i (tell|say|mention))\b",
    r"你记得|[你妳]記得|之前|上次|以前|还记得|還記得|提到过|提到過|说过|說過",
    r"帮我记一下|记下来|记一下|这个很重要|千万别忘了|别忘了|帮我记住",
)
HEADERS = r"(?im)^(Conversation info|Sender) \(untrusted metadata\):[\s\S]*?\n\s*\n"
CRON = r"(?i)^\[cron:[^\]]+\]\s*"
STAMP = r"^\[[A-Za-z]{3}\s\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}\s[^\]]+\]\s*"
CJK = r"[一-鿿぀-ゟ゠-ヿ가-힯]"

# What a query asks for: label, patterns, categories, depth, memory type.
INTENTS = (
    ("preference", (r"(?i)\b(prefer|preference|style|convention|like|dislike|favorite|habit)\b", r"(?i)\b(how do (i|we) usually|what('s| is) (my|our) (style|convention|approach))\b", r"偏好|喜欢|习惯|风格|惯例|常用|不喜欢|不要用|别用", r"用\S+比较好|推荐用|倾向于|比较喜欢|更喜欢|最好用|一般用"), ("preference", "decision"), "l0", "knowledge"),
    ("experience", (r"(?i)\b(last time|remember when|recall when|when we (tried|did|built|shipped|deployed))\b", r"(?i)\b(previously|earlier (we|i)|we used to|ran into|encountered)\b", r"上次|上回|之前|以前|记得|还记得|那次|那会|先前", r"当时|那一次|上次试过|曾经|试过|遇到过|碰到过|踩过坑"), ("decision", "fact"), "full", "experience"),
    ("decision", (r"(?i)\b(why did (we|i)|decision|decided|chose|rationale|trade-?off|reason for)\b", r"(?i)\b(what was the (reason|rationale|decision))\b", r"为什么选|决定|选择了|取舍|权衡|原因是|当时决定", r"最终决定|方案是|确定用|定了用|选了|为啥选|为啥用|干嘛用|干吗选"), ("decision", "fact"), "l1", "experience"),
    ("entity", (r"(?i)\b(who is|who are|tell me about|info on|details about|contact info)\b", r"(?i)\b(who('s| is) (the|our|my)|what team|which (person|team))\b", r"谁是|告诉我关于|详情|联系方式|哪个团队", r"谁负责|哪个团队在做|联系人是谁|谁在搞|谁弄的|谁写的"), ("entity", "fact"), "l1", "knowledge"),
    ("event", (r"(?i)\b(when did|what happened|timeline|incident|outage|deploy|release|shipped)\b", r"(?i)\b(last (week|month|time|sprint)|recently|yesterday|today)\b", r"什么时候|发生了什么|时间线|事件|上线|部署|发布|最近", r"出了什么问题|故障|出了个\s*bug|挂了|崩了|炸了|宕机|报错了"), ("entity", "decision"), "full", "experience"),
    ("fact", (r"(?i)\b(how (does|do|to)|what (does|do|is)|explain|documentation|spec)\b", r"(?i)\b(config|configuration|setup|install|architecture|api|endpoint)\b", r"怎么|如何|是什么|解释|文档|规范|配置|安装|架构|接口|原理|规则", r"怎么用|怎么配|什么作用|怎么实现的|啥意思|干嘛的|有什么用"), ("fact", "entity"), "l1", "knowledge"),
)
DEPTHS = ("l0", "l1", "full")

# Words that are added to a keyword search: signs contained, words matched, words added.
SYNONYMS = (
    (("挂了", "挂掉", "宕机"), ("shutdown", "crashed"), ("崩溃", "crash", "error", "报错", "宕机", "失败")),
    (("卡住", "卡死", "没反应"), ("hung", "frozen"), ("hang", "timeout", "超时", "无响应", "stuck")),
    (("炸了", "爆了"), ("oom",), ("崩溃", "crash", "OOM", "内存溢出", "error")),
    (("配置", "设置"), ("config", "configuration"), ("配置", "config", "configuration", "settings", "设置")),
    (("部署", "上线"), ("deploy", "deployment"), ("deploy", "部署", "上线", "发布", "release")),
    (("容器",), ("docker", "container"), ("Docker", "容器", "container", "docker-compose")),
    (("报错", "出错", "错误"), ("error", "exception"), ("error", "报错", "exception", "错误", "失败", "bug")),
    (("修复", "修了", "修好"), ("bugfix", "hotfix"), ("fix", "修复", "patch", "解决")),
    (("踩坑",), ("troubleshoot",), ("踩坑", "bug", "问题", "教训", "排查", "troubleshoot")),
    (("记忆", "记忆系统"), ("memory",), ("记忆", "memory", "记忆系统", "LanceDB", "索引")),
    (("搜索", "查找", "找不到"), ("search", "retrieval"), ("搜索", "search", "retrieval", "检索", "查找")),
    (("推送",), ("git push",), ("push", "推送", "git push", "commit")),
    (("日志",), ("logfile", "logging"), ("日志", "log", "logging", "输出", "打印")),
    (("权限",), ("permission", "authorization"), ("权限", "permission", "access", "授权", "认证")),
    (("向量", "嵌入"), ("embedding", "vector"), ("embedding", "vector", "向量", "嵌入", "相似度", "cosine")),
    (("提示词", "提示"), ("prompt",), ("prompt", "提示词", "指令", "system prompt", "few-shot")),
    (("模型",), ("model", "llm"), ("model", "模型", "LLM", "大模型", "推理")),
    (("知识库", "知识"), ("rag", "knowledge"), ("RAG", "知识库", "knowledge base", "检索增强", "向量数据库")),
    (("接口", "API"), ("api", "endpoint"), ("API", "接口", "endpoint", "REST", "GraphQL")),
    (("数据库",), ("database", "db"), ("数据库", "database", "DB", "SQL", "NoSQL", "查询")),
    (("测试",), ("test", "testing"), ("测试", "test", "testing", "单元测试", "集成测试", "mock")),
    (("性能", "优化"), ("performance", "optimize"), ("性能", "优化", "performance", "optimize", "瓶颈", "profiling")),
    (("问题", "缺陷", "故障"), ("bug", "issue", "defect"), ("bug", "问题", "缺陷", "故障", "issue", "修复")),
    (("重构", "重写"), ("refactor", "rewrite"), ("重构", "refactor", "重写", "优化代码", "rewrite")),
    (("审查", "代码审查"), ("review", "code review", "CR"), ("review", "审查", "代码审查", "CR", "code review")),
    (("合并", "合入"), ("merge",), ("merge", "合并", "合入", "pull request", "PR")),
    (("持续集成", "流水线"), ("CI", "CD", "pipeline"), ("CI/CD", "持续集成", "流水线", "自动部署", "pipeline")),
    (("缓存",), ("cache", "caching"), ("缓存", "cache", "Redis", "缓存策略", "cache invalidation")),
    (("并发", "多线程"), ("concurrency", "threading", "async"), ("并发", "concurrency", "多线程", "异步", "async", "锁")),
)
TAG_PREFIXES = ("proj", "env", "team", "scope")


def any_of(c: Column, patterns: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | c.rlike(ascii_borders(p))
    return hit


def plain_query(c: Column) -> Column:
    """A query without the headers, job marks and time stamps put before it."""
    for pattern in (HEADERS, CRON, STAMP):
        c = F.regexp_replace(trimmed(c), pattern, "")
    return trimmed(c)


def skips_retrieval(query: Column, least: int = 0) -> Column:
    """Whether a query needs no search; ``least`` replaces the usual least length."""
    q = plain_query(F.coalesce(query, F.lit("")))
    asks = q.contains("?") | q.contains("？")
    short = F.length(q) < (F.lit(least) if least > 0 else F.when(q.rlike(CJK), 6).otherwise(15))
    return ~any_of(q, FORCED) & ((F.length(q) < 5) | any_of(q, SKIPPED) | (short & ~asks))


def intent(query: Column) -> Column:
    """struct(label, categories, depth, memory_type, confidence) of all rules that match, in their order."""
    q = trimmed(F.coalesce(query, F.lit("")))
    rules = F.array(*(F.when(any_of(q, patterns), F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, cats)).alias("cats"), F.lit(DEPTHS.index(depth)).alias("depth"), F.lit(kind).alias("kind"))) for label, patterns, cats, depth, kind in INTENTS))
    hit = F.filter(rules, lambda r: r.isNotNull())
    none = F.size(hit) == 0
    depth = F.element_at(F.array(*map(F.lit, DEPTHS)), F.coalesce(F.array_max(F.transform(hit, lambda r: r["depth"])), F.lit(0)) + 1)
    return F.struct(
        F.when(q == "", "empty").when(none, "broad").otherwise(F.array_join(F.transform(hit, lambda r: r["label"]), "+")).alias("label"),
        F.array_distinct(F.flatten(F.transform(hit, lambda r: r["cats"]))).alias("categories"), depth.alias("depth"),
        F.when(~none, F.get(hit, F.lit(0))["kind"]).alias("memory_type"), F.when(none, "low").otherwise("high").alias("confidence"),
    )


def boosted(score: Column, asked: Column, category: Column, memory_type: Column, factor: float = 1.15) -> Column:
    """A score raised where the category, and again where the memory type is what the query asks for."""
    by_category = F.when(F.coalesce(F.array_contains(asked["categories"], category), F.lit(False)), F.least(F.lit(1.0), score * factor)).otherwise(score)
    return F.when(F.coalesce(asked["memory_type"] == memory_type, F.lit(False)), F.least(F.lit(1.0), by_category * factor)).otherwise(by_category)


def expanded(query: Column, most: int = 5) -> Column:
    """A query with up to ``most`` words added that mean the same as what it holds."""
    low = F.lower(query)
    added = []
    for signs, words, more in SYNONYMS:
        hit = F.lit(False)
        for s in signs:
            hit = hit | low.contains(s.lower())
        hit = hit | query.rlike(ascii_borders(r"(?i)\b(?:" + "|".join(words) + r")\b"))
        added.append(F.when(hit, F.filter(F.array(*map(F.lit, more)), lambda w: ~F.contains(low, F.lower(w)))).otherwise(F.array().cast("array<string>")))
    extra = F.slice(F.array_distinct(F.flatten(F.array(*added))), 1, most)
    return F.when(query.isNull() | (F.length(trimmed(query)) < 2) | (F.size(extra) == 0), query).otherwise(F.concat_ws(" ", query, F.array_join(extra, " ")))


def tags(query: Column, prefixes: tuple[str, ...] = TAG_PREFIXES) -> Column:
    """Tags such as ``proj:name`` in a query, as they stand."""
    return F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(f"(?i)(?:{'|'.join(prefixes)}):[A-Za-z0-9_-]+"), F.lit(0))


def first_sentence(c: Column, most: int = 80) -> Column:
    """Up to the first end of a sentence within ``most`` signs, else cut, at a blank where one is late enough."""
    end = F.regexp_instr(c, F.lit(r"[.!?]\s|[。！？]"))
    cut = F.substring(c, 1, most)
    blank = F.length(cut) - F.instr(F.reverse(cut), " ")  # signs before the last blank
    whole = F.when((F.instr(cut, " ") > 0) & (blank > most * 0.6), F.left(cut, blank)).otherwise(cut)
    return F.when((end > 1) & (end <= most), F.left(c, end)).when(F.length(c) <= most, c).otherwise(F.concat(whole, F.lit("...")))


def at_depth(text: Column, category: Column, scope: Column, depth: Column, score: Column, by_keyword: Column, reranked: Column) -> Column:
    """A result as a line at depth l0, l1 or full."""
    marks = F.concat(F.when(by_keyword, "vector+BM25").otherwise(""), F.when(reranked, "+reranked").otherwise(""))
    share = F.concat(F.lit(" ("), F.format_string("%d%%", F.floor(score * 100 + 0.5)), F.when(marks != "", F.concat(F.lit(", "), marks)).otherwise(""), F.lit(")"))
    named = F.concat(F.lit("- ["), category, F.lit(":"), scope, F.lit("] "))
    middle = F.when(F.length(text) > 300, F.concat(F.left(text, F.lit(297)), F.lit("..."))).otherwise(text)
    return F.when(depth == "l0", F.concat(F.lit("- ["), category, F.lit("] "), first_sentence(text), share)).when(depth == "l1", F.concat(named, middle, share)).otherwise(F.concat(named, text, share))
