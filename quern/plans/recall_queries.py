"""Registered queries of recall: whether to search, what is asked, more words, the ways to find and the stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import cleaning, recall_text
from quern.functions.metadata import active_at
from quern.operators import recall, scoring
from quern.plans.queries import ASKED, BM25, FUSED, GOOD, NOISY, ONCE, VEC, _asked, _searchable, mem, once, query, r6, said
from quern.plans.reference_sql import DECAY, NOW, with_mem
from quern.session import table

#: All searches that were ever asked, each once.
ASKED_TEXTS = "(SELECT DISTINCT query AS q FROM eval_items WHERE query IS NOT NULL UNION SELECT DISTINCT query FROM retrieval_telemetry WHERE query IS NOT NULL UNION SELECT DISTINCT trim(text) FROM memories WHERE text IS NOT NULL)"


def asked_texts(spark, d):
    items, traces = (table(spark, d, n).where("query is not null").select(F.col("query").alias("q")) for n in ("eval_items", "retrieval_telemetry"))
    return items.unionByName(traces).unionByName(table(spark, d, "memories").where("text is not null").select(F.trim("text").alias("q"))).distinct()


SKIP = r"""WITH a AS (SELECT q, trim(regexp_replace(trim(regexp_replace(trim(q), '^\[cron:[^\]]+\]\s*', '', 'i')), '^\[[A-Za-z]{3}\s\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}\s[^\]]+\]\s*', '')) AS t FROM """ + ASKED_TEXTS + r""")
SELECT q, NOT (regexp_matches(t, '(?i)\b(remember|recall|forgot|memory|memories)\b') OR regexp_matches(t, '(?i)\b(last time|before|previously|earlier|yesterday|ago)\b') OR regexp_matches(t, '(?i)\b(my (name|email|phone|address|birthday|preference))\b')
  OR regexp_matches(t, '(?i)\b(what did (i|we)|did i (tell|say|mention))\b') OR regexp_matches(t, '你记得|[你妳]記得|之前|上次|以前|还记得|還記得|提到过|提到過|说过|說過') OR regexp_matches(t, '帮我记一下|记下来|记一下|这个很重要|千万别忘了|别忘了|帮我记住'))
 AND (length(t) < 5 OR regexp_matches(t, '(?i)^(hi|hello|hey|good\s*(morning|afternoon|evening|night)|greetings|yo|sup|howdy|what''?s up)\b') OR starts_with(t, '/') OR regexp_matches(t, '(?i)^(run|build|test|ls|cd|git|npm|pip|docker|curl|cat|grep|find|make|sudo)\b')
  OR regexp_matches(t, '(?i)^(yes|no|yep|nope|ok|okay|sure|fine|thanks|thank you|thx|ty|got it|understood|cool|nice|great|good|perfect|awesome|👍|👎|✅|❌)\s*[.!]?$') OR regexp_matches(t, '(?i)^(go ahead|continue|proceed|do it|start|begin|next|实施|實施|开始|開始|继续|繼續|好的|可以|行)\s*[.!]?$')
  OR regexp_matches(t, '^[0-9#*\s\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]+$') OR regexp_matches(t, '(?i)HEARTBEAT') OR regexp_matches(t, '(?i)^\[System') OR regexp_matches(t, '(?i)^(ping|pong|test|debug)\s*[.!?]?$')
  OR (length(t) < CASE WHEN regexp_matches(t, '[一-鿿぀-ゟ゠-ヿ가-힯]') THEN 6 ELSE 15 END AND NOT contains(t, '?') AND NOT contains(t, '？'))) AS skipped FROM a"""


@query(SKIP)
def skip_retrieval(spark, d):
    return asked_texts(spark, d).select("q", recall_text.skips_retrieval(F.col("q")).alias("skipped"))


INTENT = r"""rules AS (SELECT *, list_filter([
 CASE WHEN regexp_matches(q, '(?i)\b(prefer|preference|style|convention|like|dislike|favorite|habit)\b|\b(how do (i|we) usually|what(''s| is) (my|our) (style|convention|approach))\b|偏好|喜欢|习惯|风格|惯例|常用|不喜欢|不要用|别用|用\S+比较好|推荐用|倾向于|比较喜欢|更喜欢|最好用|一般用') THEN 1 END,
 CASE WHEN regexp_matches(q, '(?i)\b(last time|remember when|recall when|when we (tried|did|built|shipped|deployed))\b|\b(previously|earlier (we|i)|we used to|ran into|encountered)\b|上次|上回|之前|以前|记得|还记得|那次|那会|先前|当时|那一次|上次试过|曾经|试过|遇到过|碰到过|踩过坑') THEN 2 END,
 CASE WHEN regexp_matches(q, '(?i)\b(why did (we|i)|decision|decided|chose|rationale|trade-?off|reason for)\b|\b(what was the (reason|rationale|decision))\b|为什么选|决定|选择了|取舍|权衡|原因是|当时决定|最终决定|方案是|确定用|定了用|选了|为啥选|为啥用|干嘛用|干吗选') THEN 3 END,
 CASE WHEN regexp_matches(q, '(?i)\b(who is|who are|tell me about|info on|details about|contact info)\b|\b(who(''s| is) (the|our|my)|what team|which (person|team))\b|谁是|告诉我关于|详情|联系方式|哪个团队|谁负责|哪个团队在做|联系人是谁|谁在搞|谁弄的|谁写的') THEN 4 END,
 CASE WHEN regexp_matches(q, '(?i)\b(when did|what happened|timeline|incident|outage|deploy|release|shipped)\b|\b(last (week|month|time|sprint)|recently|yesterday|today)\b|什么时候|发生了什么|时间线|事件|上线|部署|发布|最近|出了什么问题|故障|出了个\s*bug|挂了|崩了|炸了|宕机|报错了') THEN 5 END,
 CASE WHEN regexp_matches(q, '(?i)\b(how (does|do|to)|what (does|do|is)|explain|documentation|spec)\b|\b(config|configuration|setup|install|architecture|api|endpoint)\b|怎么|如何|是什么|解释|文档|规范|配置|安装|架构|接口|原理|规则|怎么用|怎么配|什么作用|怎么实现的|啥意思|干嘛的|有什么用') THEN 6 END],
 lambda x: x IS NOT NULL) AS hit FROM (SELECT q, trim(q) AS t FROM """ + ASKED_TEXTS + r""")),
intents AS (SELECT q, CASE WHEN t = '' THEN 'empty' WHEN len(hit) = 0 THEN 'broad' ELSE array_to_string(list_transform(hit, lambda i: ['preference', 'experience', 'decision', 'entity', 'event', 'fact'][i]), '+') END AS label,
 CASE WHEN list_has_any(hit, [2, 5]) THEN 'full' WHEN list_has_any(hit, [3, 4, 6]) THEN 'l1' ELSE 'l0' END AS depth, ['knowledge', 'experience', 'experience', 'knowledge', 'experience', 'knowledge'][hit[1]] AS memory_type, CASE WHEN len(hit) = 0 THEN 'low' ELSE 'high' END AS confidence,
 list_has_any(hit, [1]) AS preference, list_has_any(hit, [1, 2, 3, 5]) AS decision, list_has_any(hit, [2, 3, 4, 6]) AS fact, list_has_any(hit, [4, 5, 6]) AS entity FROM rules)"""


@query(f"WITH {INTENT} SELECT * FROM intents")
def intent(spark, d):
    i = F.col("i")
    has = lambda c: F.array_contains(i["categories"], c).alias(c)
    rows = asked_texts(spark, d).withColumn("i", recall_text.intent(F.col("q")))
    return rows.select("q", i["label"].alias("label"), i["depth"].alias("depth"), i["memory_type"].alias("memory_type"), i["confidence"].alias("confidence"), has("preference"), has("decision"), has("fact"), has("entity"))


@query(with_mem("SELECT q, c.category, t.memory_type, round(least(1.0::DOUBLE, 0.8::DOUBLE * CASE WHEN (c.category = 'preference' AND preference) OR (c.category = 'decision' AND decision) OR (c.category = 'fact' AND fact) OR (c.category = 'entity' AND entity) THEN 1.15::DOUBLE ELSE 1 END * CASE WHEN t.memory_type = intents.memory_type THEN 1.15::DOUBLE ELSE 1 END), 6) AS boosted FROM intents, (SELECT DISTINCT category FROM mem WHERE category IS NOT NULL) c, (VALUES ('knowledge'), ('experience')) t(memory_type)", INTENT))
def intent_boost(spark, d):
    kinds = mem(spark, d).where("category is not null").select("category").distinct().withColumn("memory_type", F.explode(F.array(F.lit("knowledge"), F.lit("experience"))))
    rows = asked_texts(spark, d).withColumn("i", recall_text.intent(F.col("q"))).crossJoin(F.broadcast(kinds))  # a row for each category in use, of a fixed list and its misspellings
    return rows.select("q", "category", "memory_type", r6(recall_text.boosted(F.lit(0.8), F.col("i"), F.col("category"), F.col("memory_type"))).alias("boosted"))


# added words, by the number of the rule; written out for the check
EXPANSIONS = (
    ("挂了|挂掉|宕机", "shutdown|crashed", "崩溃,crash,error,报错,宕机,失败"), ("卡住|卡死|没反应", "hung|frozen", "hang,timeout,超时,无响应,stuck"), ("炸了|爆了", "oom", "崩溃,crash,OOM,内存溢出,error"),
    ("配置|设置", "config|configuration", "配置,config,configuration,settings,设置"), ("部署|上线", "deploy|deployment", "deploy,部署,上线,发布,release"), ("容器", "docker|container", "Docker,容器,container,docker-compose"),
    ("报错|出错|错误", "error|exception", "error,报错,exception,错误,失败,bug"), ("修复|修了|修好", "bugfix|hotfix", "fix,修复,patch,解决"), ("踩坑", "troubleshoot", "踩坑,bug,问题,教训,排查,troubleshoot"),
    ("记忆|记忆系统", "memory", "记忆,memory,记忆系统,LanceDB,索引"),
    ("搜索|查找|找不到", "search|retrieval", "搜索,search,retrieval,检索,查找"), ("推送", "git push", "push,推送,git push,commit"), ("日志", "logfile|logging", "日志,log,logging,输出,打印"),
    ("权限", "permission|authorization", "权限,permission,access,授权,认证"), ("向量|嵌入", "embedding|vector", "embedding,vector,向量,嵌入,相似度,cosine"), ("提示词|提示", "prompt", "prompt,提示词,指令,system prompt,few-shot"),
    ("模型", "model|llm", "model,模型,LLM,大模型,推理"), ("知识库|知识", "rag|knowledge", "RAG,知识库,knowledge base,检索增强,向量数据库"), ("接口|api", "api|endpoint", "API,接口,endpoint,REST,GraphQL"),
    ("数据库", "database|db", "数据库,database,DB,SQL,NoSQL,查询"), ("测试", "test|testing", "测试,test,testing,单元测试,集成测试,mock"), ("性能|优化", "performance|optimize", "性能,优化,performance,optimize,瓶颈,profiling"),
    ("问题|缺陷|故障", "bug|issue|defect", "bug,问题,缺陷,故障,issue,修复"), ("重构|重写", "refactor|rewrite", "重构,refactor,重写,优化代码,rewrite"), ("审查|代码审查", "review|code review|CR", "review,审查,代码审查,CR,code review"),
    ("合并|合入", "merge", "merge,合并,合入,pull request,PR"), ("持续集成|流水线", "CI|CD|pipeline", "CI/CD,持续集成,流水线,自动部署,pipeline"), ("缓存", "cache|caching", "缓存,cache,Redis,缓存策略,cache invalidation"),
    ("并发|多线程", "concurrency|threading|async", "并发,concurrency,多线程,异步,async,锁"),
)
EXPAND = (
    "SELECT q, CASE WHEN length(trim(q)) < 2 OR len(extra) = 0 THEN q ELSE q || ' ' || array_to_string(extra, ' ') END AS expanded FROM (SELECT q, list_slice(list_filter(list_distinct_in_order, lambda w: true), 1, 5) AS extra FROM (SELECT q, list_reduce(list_concat([[]::VARCHAR[]], list_transform(all_words, lambda w: [w])), lambda acc, w: CASE WHEN list_contains(acc, w[1]) THEN acc ELSE list_concat(acc, w) END) AS list_distinct_in_order FROM (SELECT q, list_filter(flatten(["
    + ", ".join(f"CASE WHEN regexp_matches(lower(q), '{a}') OR regexp_matches(q, '(?i)\\b({b})\\b') THEN string_split('{c}', ',') ELSE []::VARCHAR[] END" for a, b, c in EXPANSIONS)
    + f"]), lambda w: NOT contains(lower(q), lower(w))) AS all_words FROM {ASKED_TEXTS})))"
)


@query(EXPAND)
def expand_query(spark, d):
    return asked_texts(spark, d).select("q", recall_text.expanded(F.col("q")).alias("expanded"))


SENTENCE = "CASE WHEN e > 1 AND e <= 80 THEN substr(text, 1, e) WHEN length(text) <= 80 THEN text ELSE CASE WHEN contains(c, ' ') AND length(c) - strpos(reverse(c), ' ') > 48 THEN substr(c, 1, length(c) - strpos(reverse(c), ' ')) ELSE c END || '...' END"


@query(with_mem(f"SELECT id, depth, CASE depth WHEN 'l0' THEN '- [' || category || '] ' || {SENTENCE} || ' (80%, vector+BM25)' ELSE '- [' || category || ':' || scope || '] ' || CASE WHEN depth = 'l1' AND length(text) > 300 THEN substr(text, 1, 297) || '...' ELSE text END || ' (80%, vector+BM25)' END AS line FROM (SELECT *, substr(text, 1, 80) AS c, CASE WHEN regexp_matches(text, '[.!?]\\s|[。！？]') THEN length(regexp_extract(text, '(?s)^(.*?)(?:[.!?]\\s|[。！？])', 1)) + 1 ELSE 0 END AS e FROM mem WHERE category IS NOT NULL), (VALUES ('l0'), ('l1'), ('full')) x(depth)"))
def format_at_depth(spark, d):
    rows = mem(spark, d).where("category is not null").withColumn("depth", F.explode(F.array(F.lit("l0"), F.lit("l1"), F.lit("full"))))
    return rows.select("id", "depth", recall_text.at_depth(F.col("text"), F.col("category"), F.col("scope"), F.col("depth"), F.lit(0.8), F.lit(True), F.lit(False)).alias("line"))


def scored(spark, d):
    """Usable rows with their decay, as the searches need them."""
    return scoring.decay(_searchable(mem(spark, d)), NOW)


LIVE = f"live AS (SELECT * FROM decayed WHERE valid_from <= {NOW} AND len(vector) = 64 AND len(list_filter(vector, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"
BOOST = "greatest(0.0, least(1.0, s * greatest(0.3, least(1.0, 0.3 + 0.7 * greatest(CASE tier WHEN 'core' THEN 0.9 WHEN 'working' THEN 0.7 ELSE 0.5 END, composite)))))"
NORMED = "greatest(0.0, least(1.0, score / (1 + 0.5 * log2(greatest(length(text) / 500.0, 1.0)))))"


def best(of: str) -> str:
    return f"SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT qid, id, {BOOST} AS score FROM ({of}))) WHERE rank <= 5"


@query(with_mem(best(f"SELECT qid, id, tier, composite, {NORMED} AS s FROM vec JOIN live USING (id) WHERE rank <= 20 AND NOT {NOISY('text')} AND {NORMED} >= 0.35"), ASKED, DECAY, LIVE, VEC.replace("FROM good, asked", "FROM live, asked")))
def recall_vector(spark, d):
    return recall.recall_by_vector(scored(spark, d), _asked(spark, d), NOW).select("qid", "id", r6(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


TAGGED = f"asked AS (SELECT DISTINCT entry_index AS qid, regexp_extract(text, '(?i)(?:proj|env|team|scope):[A-Za-z0-9_-]+') AS query FROM {ONCE} WHERE regexp_matches(text, '(?i)(?:proj|env|team|scope):[A-Za-z0-9_-]+'))"


@query(with_mem(best(f"SELECT qid, id, tier, composite, {NORMED} AS s FROM kw JOIN live USING (id) JOIN asked a USING (qid) WHERE rank <= 20 AND contains(lower(text), lower(a.query)) AND NOT {NOISY('text')} AND {NORMED} >= 0.35"), TAGGED, DECAY, LIVE, BM25.replace("FROM mem)", "FROM live)")))
def recall_tags(spark, d):
    """The first tag of every memory that has one, as a query."""
    first = F.regexp_extract("text", r"(?i)(?:proj|env|team|scope):[A-Za-z0-9_-]+", 0)
    asked = once(spark, d).select(F.col("entry_index").alias("qid"), first.alias("query")).where("query <> ''").distinct()
    return recall.recall_by_tags(scored(spark, d), asked, NOW).select("qid", "id", r6(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


AGAIN = f"""again AS (SELECT qid, id, tier, composite, greatest(0.0, least(1.0, CASE WHEN coalesce(bs, 0) > 0 THEN bs * 0.3 + cosine * 0.7 ELSE cosine END)) AS s
 FROM (SELECT f.qid, f.id, b.bs, CASE WHEN b.vs IS NULL THEN 0.0 ELSE 2 - 1 / b.vs END AS cosine, text, tier, composite FROM fused f JOIN both2 b ON f.qid = b.qid AND f.id = b.id JOIN live ON live.id = f.id WHERE f.score >= 0.3) WHERE NOT {NOISY('text')})"""


@query(with_mem(best("SELECT * FROM (SELECT *, max(s) OVER (PARTITION BY qid) AS top FROM again) WHERE s >= 0.35 OR top < 0.35"), ASKED, DECAY, LIVE, VEC.replace("FROM good, asked", "FROM live, asked").replace("score >= 0.3", "score >= 0.1"), BM25.replace("FROM mem)", "FROM live)"), FUSED, AGAIN))
def recall_reranked(spark, d):
    return recall.recall(scored(spark, d), _asked(spark, d), NOW).select("qid", "id", r6(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


# a judge's scores: of every even place, from the length of the text; the keyword score from the id
JUDGED = "SELECT entry_index % 50 AS qid, id, 0.2 + (entry_index % 7) / 10.0 AS score, (entry_index % 9) / 9.0 AS bs, CASE WHEN entry_index % 2 = 0 THEN (entry_index % 11) / 11.0 END AS judged FROM " + ONCE


@query(f"SELECT qid, id, round(greatest(least(1.0, score * CASE WHEN bs >= 0.75 THEN CASE WHEN judged IS NULL THEN 1.0 ELSE 0.95 END WHEN bs >= 0.6 THEN CASE WHEN judged IS NULL THEN 0.95 ELSE 0.9 END ELSE CASE WHEN judged IS NULL THEN 0.8 ELSE 0.5 END END), least(1.0, CASE WHEN judged IS NULL THEN score * 0.8 ELSE judged * 0.6 + score * 0.4 END)), 6) AS score FROM ({JUDGED})")
def rerank_blend(spark, d):
    n = F.col("entry_index")
    rows = once(spark, d).select((n % 50).alias("qid"), "id", (0.2 + (n % 7) / 10.0).alias("score"), ((n % 9) / 9.0).alias("bs"), F.when(n % 2 == 0, (n % 11) / 11.0).alias("judged"))
    return recall.reranked(rows.drop("judged"), rows.where("judged is not null").select("qid", "id", "judged")).select("qid", "id", r6(F.col("score")).alias("score"))


# ---- texts of messages without what was put around them

def wrapped(spark, d):
    """Messages with every kind of wrapper put before them, by their number."""
    t, n = F.trim(F.regexp_replace("text", r"\n+", " ")), F.col("msg_id") % 6
    put = {
        0: "[Subagent Context] You are running as a subagent of main. Results auto-announce to your requester.\n", 1: "\n[Subagent Task] Do not use any memory tools.\ndo not busy-poll for status.\n",
        2: "System: [2026-01-02 03:04:05 GMT+8] Mail[desk] delivered\n", 3: 'Sender (untrusted metadata):\n```json\n{"name": "x"}\n```\n\n', 4: "@helper ",
    }
    before = F.lit("")
    for k, v in put.items():
        before = F.when(n == k, v).otherwise(before)
    return said(spark, d).select("msg_id", t.alias("t")).where(F.col("t").rlike("^[A-Za-z]") & ~F.col("t").rlike("(?i)^(system:|results auto|do not|reply with|you are running)|untrusted|```")).select("msg_id", F.concat(before, "t").alias("w"), "t")


PLAIN = r"(SELECT msg_id, trim(regexp_replace(t, '\n+', ' ', 'g')) AS t FROM {0}) WHERE regexp_matches(t, '^[A-Za-z]') AND NOT regexp_matches(t, '(?i)^(system:|results auto|do not|reply with|you are running)|untrusted|```')"


def _plain_sql(body: str) -> str:
    from quern.plans.queries import TEXTS

    return body + PLAIN.format(TEXTS)


@query(_plain_sql("SELECT msg_id, CASE WHEN msg_id % 6 = 4 THEN '@helper ' || t ELSE t END AS cleaned FROM "))
def strip_envelope(spark, d):
    return wrapped(spark, d).select("msg_id", cleaning.without_envelope(F.col("w")).alias("cleaned"))


@query(_plain_sql(r"SELECT msg_id, CASE WHEN msg_id % 6 = 2 THEN 'System: [2026-01-02 03:04:05 GMT+8] Mail[desk] delivered' || chr(10) || t WHEN msg_id % 6 = 1 THEN 'do not busy-poll for status.' || chr(10) || t ELSE t END AS cleaned FROM "))
def capture_text(spark, d):
    return wrapped(spark, d).select("msg_id", cleaning.capture_text(F.lit("user"), F.col("w")).alias("cleaned"))


@query(with_mem(f"SELECT id FROM mem WHERE valid_from <= {NOW - 30 * 86_400_000} AND NOT {NOISY('text')}"))
def quiet_memories(spark, d):
    """Active memories of a month ago that are no noise."""
    from quern.functions.text import is_noise

    return mem(spark, d).where(active_at(NOW - 30 * 86_400_000) & ~is_noise(F.col("text"))).select("id")
