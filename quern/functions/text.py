"""Text column functions.

Word borders: the patterns mean ASCII borders, which Java's ``\\b`` is not, so
``BORDER`` spells them out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BORDER = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_borders(pattern: str) -> str:
    return pattern.replace(r"\b", BORDER)


# Patterns of texts that hold nothing worth keeping.
DENIAL = r"(?i)i don'?t have (any )?(information|data|memory|record)|i'?m not sure about|i don'?t recall|i don'?t remember|it looks like i don'?t|i wasn'?t able to find|no (relevant )?memories found|i don'?t have access to|我没有找到|我不确定|没有相关记忆|抱歉[，,]?我不记得|我无法确认|没有找到相关|我不太清楚"
META_QUESTION = r"(?i)\bdo you (remember|recall|know about)\b|\bcan you (remember|recall)\b|\bdid i (tell|mention|say|share)\b|\bhave i (told|mentioned|said)\b|\bwhat did i (tell|say|mention)\b|如果你知道.+只回复|如果不知道.+只回复\s*none|只回复精确代号|只回复\s*none|你还?记得|记不记得|还记得.*吗|你[知晓]道.+吗|我(?:之前|上次|以前)(?:说|提|讲).*(?:吗|呢|？|\?)"
BOILERPLATE = r"(?i)^(hi|hello|hey|good morning|good evening|greetings)|^fresh session|^new session|^HEARTBEAT"
DIAGNOSTIC = r"(?i)\bquery\s*->\s*(none|no explicit solution|unknown|not found)\b|\buser asked for\b.*\b(none|no explicit solution|unknown|not found)\b|\bno explicit solution\b"
REFLECTION_EVENT = r"(?m)^reflection-event\s*·"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")


def non_empty(c: Column) -> Column:
    t = trimmed(c)
    return F.when(t != "", t)


def is_noise(c: Column) -> Column:
    t = trimmed(F.coalesce(c, F.lit("")))
    hit = F.length(t) < 5
    for p in (DENIAL, META_QUESTION, BOILERPLATE, DIAGNOSTIC, REFLECTION_EVENT):
        hit = hit | t.rlike(ascii_borders(p))
    return hit


def search_tokens(c: Column) -> Column:
    """Distinct search tokens: words, single signs of Chinese, Japanese and Korean, and neighbouring pairs of them."""
    low = F.lower(F.coalesce(c, F.lit("")))
    sign = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}]"
    words = F.regexp_extract_all(low, F.lit(rf"{sign}+|[\p{{L}}\p{{N}}&&[^\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}\x{{3040}}-\x{{309f}}\x{{30a0}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}]]+"), F.lit(0))
    parts = F.transform(words, lambda w: F.when(w.rlike(f"^{sign}"), F.concat(F.split(w, ""), F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: w.substr(i, F.lit(2))))).otherwise(F.array(w)))
    return F.array_distinct(F.filter(F.flatten(parts), lambda t: t != ""))


def admission_tokens(c: Column) -> Column:
    """Han signs one by one, other words whole; lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))


def ngrams(c: Column, low: int = 2, high: int = 3) -> Column:
    """All character n-grams of the lower-cased text."""
    t = F.lower(c)

    def of(n: int) -> Column:  # transform would take a second parameter for the place
        made = F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: t.substr(i, F.lit(n)))
        return F.when(F.length(t) >= n, made).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of(n) for n in range(low, high + 1)))


def fact_key(category: Column, abstract: Column) -> Column:
    """Topic of a preference or entity: what stands before the first colon or arrow."""
    t = trimmed(abstract)
    colon = F.regexp_extract(t, r"^([^\n\r]{1,120}?)[：:]", 1)
    arrow = F.regexp_extract(t, r"^([^\n\r]{1,120}?)(?:\s*->|\s*=>)", 1)
    topic = F.when(colon != "", colon).when(arrow != "", arrow).otherwise(t)
    norm = trimmed(F.regexp_replace(F.regexp_replace(F.lower(topic), r"\s+", " "), r"[。.!?]+$", ""))
    return F.when(category.isin("preferences", "entities") & (norm != ""), F.concat(category, F.lit(":"), norm))


def first_sentence(c: Column, most: int) -> Column:
    t = F.regexp_extract(trimmed(c), r"^(?s)(.+?[.!?。！？\n])", 1)
    return F.substring(trimmed(F.when(t != "", t).otherwise(trimmed(c))), 1, most)


def one_line(c: Column, most: int) -> Column:
    """White space collapsed, cut with an ellipsis."""
    t = trimmed(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


# Shapes of secrets and of personal data.
SECRETS = (
    r"Bearer\s+[A-Za-z0-9\-._~+/]+=*",
    r"\bsk-[A-Za-z0-9]{20,}\b",
    r"\bsk-proj-[A-Za-z0-9\-_]{20,}\b",
    r"\bsk-ant-[A-Za-z0-9\-_]{20,}\b",
    r"\bghp_[A-Za-z0-9]{36,}\b",
    r"\bgho_[A-Za-z0-9]{36,}\b",
    r"\bghu_[A-Za-z0-9]{36,}\b",
    r"\bghs_[A-Za-z0-9]{36,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{22,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"\bAIza[0-9A-Za-z_-]{20,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bnpm_[A-Za-z0-9]{36,}\b",
    r"(?i)\b(?:token|api[_-]?key|secret|password)\s*[:=]\s*[\"']?[^\s\"',;)}\]]{6,}[\"']?\b",
    r"-----BEGIN\s+(?:RSA\s+|EC\s+|DSA\s+|OPENSSH\s+)?PRIVATE\s+KEY-----[\s\S]*?-----END\s+(?:RSA\s+|EC\s+|DSA\s+|OPENSSH\s+)?PRIVATE\s+KEY-----",
    r"(?<=://)[^@\s]+:[^@\s]+(?=@)",
)
PERSONAL = (r"/home/[^\s\"',;)}\]]+", r"/Users/[^\s\"',;)}\]]+", r"[A-Z]:\\[^\s\"',;)}\]]+", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")
REDACTED = "[REDACTED]"


def redact_secrets(c: Column) -> Column:
    """Without keys, tokens, passwords and credentials in addresses."""
    for i, pattern in enumerate(SECRETS):
        c = F.regexp_replace(c, ascii_borders(pattern), f"Bearer {REDACTED}" if i == 0 else REDACTED)
    return c


def redact_personal(c: Column) -> Column:
    """Without mail addresses and paths of home folders and drives."""
    for pattern in PERSONAL:
        c = F.regexp_replace(c, pattern, REDACTED)
    return c


def redact(c: Column, personal: bool = True) -> Column:
    return redact_personal(redact_secrets(c)) if personal else redact_secrets(c)


def governance_text(c: Column) -> Column:
    """Lower case without bullets, role prefixes, quotes and punctuation."""
    t = F.regexp_replace(F.lower(c), r"^\s*[-*+•]\s+", "")
    t = F.regexp_replace(t, r"^(user|assistant|rule|用户|规则)\s*[:：]\s*", "")
    t = F.regexp_replace(t, "[\"'“”‘’`]", "")
    return trimmed(F.regexp_replace(F.regexp_replace(t, r"[，。！？、；：,.!?;:()\[\]{}]", " "), r"\s+", " "))


def lesson_text(c: Column) -> Column:
    """Paths, hexadecimal ids and numbers masked, at most 240 characters."""
    t = F.regexp_replace(F.lower(c), r"(?:[a-z]:)?(?:/[\w.\-]+){2,}", "<path>")
    t = F.regexp_replace(t, ascii_borders(r"\b0x[0-9a-f]+\b|\b[0-9a-f]{8,}\b"), "<hex>")
    t = F.regexp_replace(t, r"\d+", "#")
    return F.substring(trimmed(F.regexp_replace(t, r"\s+", " ")), 1, 240)


def reason_key(c: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(F.lower(c), r"\d+(?:\.\d+)?", "#"), r"\s+", " "))


def message_text(content: Column) -> Column:
    """What a message says: plain text, or the text blocks of a JSON block list, one a line; nothing where the list can't be read."""
    listed = F.coalesce(content.rlike(r"^\s*\[\s*(\{|\]|$)"), F.lit(False))
    blocks = F.from_json(F.when(listed, content), "array<struct<type:string,text:string>>")
    said = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.when(listed, F.coalesce(F.array_join(said, "\n"), F.lit(""))).otherwise(content)
