"""Rules that sort texts: value of a line, kind of memory, expiry, capture.

The patterns are fixed values; their word borders are ASCII ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import ascii_borders, trimmed

CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}]"
# What lines of a session show.
TOOL_CALL = r"(?i)\btool_use\b|\btool_result\b|\bfunction_call\b"
CORRECTION = r"(?i)^no[,.\s]|\bactually\b|\binstead\b|\bwrong\b|\bcorrect(ion)?\b|\bfix\b|不对|应该是|應該是|错了|錯了|改成|不是.*而是"
DECISION = r"(?i)\blet'?s go with\b|\bconfirmed?\b|\bapproved?\b|\bdecided?\b|\bwe'?ll use\b|\bgoing forward\b|\bfrom now on\b|\bagreed\b|决定|決定|确认|確認|选择了|選擇了|就这样|就這樣"
ACKNOWLEDGMENT = r"(?i)^(ok|okay|k|sure|fine|thanks|thank you|thx|ty|got it|understood|cool|nice|great|good|perfect|awesome|alright|yep|yup|yeah|right)\s*[.!]?$|^好的?\s*[。！]?$|^(嗯|收到|了解|明白|谢谢|感谢)\s*[。！]?$"
MEMORY_INTENT = r"(?i)\b(remember|recall|don'?t forget|note that|keep in mind)\b|记住|記住|别忘|不要忘|记一下|記一下"
# Words of time and of lasting facts.
DYNAMIC = r"(?i)\b(today|yesterday|tomorrow|recently|currently|right now|this week|this month|last week|next week|this morning|tonight|later)\b|今天|昨天|明天|最近|正在|刚才|刚刚|这周|这个月|上周|下周|目前|现在|今晚|今早|稍后|待会"
HOUR_MS = 3_600_000
EXPIRY = ((r"(?i)后天|day after tomorrow", 48), (r"(?i)明天|\btomorrow\b", 24), (r"(?i)下周|\bnext week\b", 168), (r"(?i)这周|\bthis week\b", 72), (r"(?i)下个月|\bnext month\b", 720), (r"(?i)这个月|\bthis month\b", 360), (r"(?i)今晚|\btonight\b", 12), (r"(?i)今天|\btoday\b", 18))
# What makes a message worth keeping, and what rules it out.
TRIGGERS = r"(?i)zapamatuj si|pamatuj|\b(?:please\s+)?remember\s+(?:that|this|my|our|to)\b|\b(?:don'?t forget|note that|keep in mind)\b|preferuji|radši|nechci|prefer|rozhodli jsme|budeme používat|\b(we )?decided\b|we'?ll use|we will use|switch(ed)? to|migrate(d)? to|going forward|from now on|\+\d{10,}|[\w.-]+@[\w.-]+\.\w+|můj\s+\w+\s+je|je\s+můj|my\s+\w+\s+is|is\s+my|i (like|prefer|hate|love)\b|記住|记住|記一下|记一下|別忘了|别忘了|備註|备注|偏好|喜好|喜歡|喜欢|討厭|讨厌|愛用|爱用|習慣|习惯|決定|决定|選擇了|选择了|改用|換成|换成|以後用|以后用|我的\S+是|叫我|稱呼|称呼|老是|講不聽|總是|总是|從不|从不|一直|每次都|重要|關鍵|关键|注意|千萬別|千万别|筆記|笔记|存檔|存档|存起來|存起来|存一下|重點|重点|原則|原则|底線|底线"
EXCLUDED = r"(?i)\b(delete|remove|forget|purge|cleanup|clean up|clear)\b.*\b(memory|memories|entry|entries)\b|\b(memory|memories)\b.*\b(delete|remove|forget|purge|cleanup|clean up|clear)\b|\bhow do i\b.*\b(delete|remove|forget|purge|cleanup|clear)\b|(删除|刪除|清理|清除).{0,12}(记忆|記憶|memory)|\b(?:do you|can you|could you)\s+remember\b|(?:你|妳|还|還).{0,6}(记得|記得|知道).{0,20}[吗嗎么嘛?？]"
CATEGORY_RULES = (
    ("preference", r"prefer|radši|like|love|hate|want|偏好|喜歡|喜欢|討厭|讨厌|愛好|爱用|習慣|习惯"),
    ("decision", r"rozhodli|decided|we decided|will use|we will use|we'?ll use|switch(ed)? to|migrate(d)? to|going forward|from now on|budeme|決定|决定|選擇了|选择了|改用|換成|换成|以後用|以后用|規則|流程|sop"),
    ("entity", r"\+\d{10,}|@[\w.-]+\.\w+|is called|jmenuje se|我的\S+是|叫我|稱呼|称呼"),
    ("fact", r"\b(is|are|has|have|je|má|jsou)\b|總是|总是|從不|从不|一直|每次都|老是"),
)


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(ascii_borders(pattern)), F.lit(False))


def line_reason(c: Column) -> Column:
    """What a line of a session is, by the first rule that applies."""
    t = trimmed(F.coalesce(c, F.lit("")))
    long = F.length(t) > F.when(t.rlike(CJK), 30).otherwise(80)
    return (
        F.when(F.length(t) == 0, "empty").when(matches(t, TOOL_CALL), "tool_call").when(matches(t, CORRECTION), "correction").when(matches(t, DECISION), "decision").when(matches(t, ACKNOWLEDGMENT), "acknowledgment")
        .when(long & t.rlike("^<[a-z-]+>") & t.rlike(r"</[a-z-]+>\s*$"), "system_xml").when(long, "substantive").when(F.contains(t, F.lit("?")) | F.contains(t, F.lit("？")), "short_question").otherwise("short_statement")
    )


LINE_SCORES = {"empty": 0.0, "tool_call": 1.0, "correction": 0.95, "decision": 0.85, "acknowledgment": 0.1, "system_xml": 0.3, "substantive": 0.7, "short_question": 0.5, "short_statement": 0.4}


def line_score(reason: Column) -> Column:
    out = F.lit(0.4)
    for name, value in LINE_SCORES.items():
        out = F.when(reason == name, value).otherwise(out)
    return out


def temporal_type(c: Column) -> Column:
    return F.when(matches(c, DYNAMIC), "dynamic").otherwise("static")


def expiry(c: Column, now: Column | int) -> Column:
    """When what a text says is over, from its words of time; null where it has none."""
    now = F.lit(now) if isinstance(now, int) else now
    out = F.lit(None).cast("bigint")
    for pattern, hours in reversed(EXPIRY):
        out = F.when(matches(c, pattern), now + hours * HOUR_MS).otherwise(out)
    return out


def worth_capturing(c: Column) -> Column:
    t = trimmed(F.coalesce(c, F.lit("")))
    fits = (F.length(t) >= F.when(t.rlike(CJK), 4).otherwise(10)) & (F.length(t) <= 500)
    made = F.contains(t, F.lit("<relevant-memories>")) | (t.startswith("<") & F.contains(t, F.lit("</"))) | (F.contains(t, F.lit("**")) & F.contains(t, F.lit("\n-")))
    return fits & ~made & (F.regexp_count(t, F.lit(r"[\x{1F300}-\x{1F9FF}]")) <= 3) & ~matches(t, EXCLUDED) & matches(t, TRIGGERS)


def detected_category(c: Column) -> Column:
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit("other")
    for name, pattern in reversed(CATEGORY_RULES):
        out = F.when(matches(low, pattern), name).otherwise(out)
    return out
