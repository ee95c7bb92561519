"""Column functions on single messages and lines: what to leave out, what they signal, short forms for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.recall_text import any_of
from quern.functions.text import redact, trimmed

# Shapes of credentials, of lines that must not be shown to a model, of lines that stand for nothing, and of signals.
SENSITIVE = (
    r"\b(?:sk|rk|pk|sess|pat)_[A-Za-z0-9_-]{16,}\b",
    r"(?i)\b(?:api[_-]?key|access[_-]?token|refresh[_-]?token|secret|password)\b\s*[:=]\s*['\"]?[^\s'\"`]{8,}",
    r"-----BEGIN (?:RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----",
    r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b",
)
UNSAFE = (
    r"(?i)^\s*(?:(?:next|this)\s+run\s+)?(?:ignore|disregard|forget|override|bypass)\b[\s\S]{0,80}\b(?:instructions?|guardrails?|policy|developer|system)\b",
    r"(?i)\b(?:reveal|print|dump|show|output)\b[\s\S]{0,80}\b(?:system prompt|developer prompt|hidden prompt|hidden instructions?|full prompt|prompt verbatim|secrets?|keys?|tokens?)\b",
    r"(?i)<\s*/?\s*(?:system|assistant|user|tool|developer|inherited-rules|derived-focus)\b[^>]*>",
    r"(?i)^(?:system|assistant|user|developer|tool)\s*:",
)
PLACEHOLDER = (
    r"(?i)^\(none( captured)?\)$",
    r"(?i)^(invariants?|reflections?|derived)[:：]$",
    r"(?i)apply this session'?s (deltas|distilled changes) next run",
    r"(?i)investigate why embedded reflection generation failed",
)
LABEL = r"(?i)^(invariants?|reflections?|derived)[:：]\s*"
ERRORS = (
    r"\[error\]|error:|exception:|fatal:|traceback|syntaxerror|typeerror|referenceerror|npm err!",
    r"command not found|no such file|permission denied|non-zero|exit code",
    r"\"status\"\s*:\s*\"error\"|\"status\"\s*:\s*\"failed\"|\biserror\b",
    r"错误\s*[：:]|异常\s*[：:]|报错\s*[：:]|失败\s*[：:]",
)
DANGEROUS = (r"(?i)\b(rm\s+-rf|git\s+reset\s+--hard|git\s+clean\s+-fd|drop\s+database|truncate\s+table|kubectl\s+delete|terraform\s+destroy|npm\s+publish|vercel\s+--prod|deploy|migration|migrate)\b",)
CLOSED = (r"(?i)\b(?:fixed|resolved|working|passed|done|implemented|completed|shipped)\b", r"修好了|解决了|完成了|搞定了|通过了|已经好了|已完成|已解决")
STEP = (r"(?i)\b(?:run|check|verify|inspect|patch|update|compare|reproduce|test|store|compile|distill|prune|compact|archive|trace|review)\b", r"运行|检查|验证|排查|修复|更新|比较|复现|测试|记录|归档|蒸馏|裁剪|压缩")
DISAGREES = (r"不是我想要的|不是我要的|方向错了|这个方向不对|跑偏了", r"(?i)not what i want|wrong direction|this isn'?t what i asked|off track")
FILE = r"(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+|[A-Za-z0-9_.-]+\.(?:tsx|ts|json|js|mjs|md|py|go|rs|cs|java|yml|yaml)"
# Standing rules: topic, whether it asks for or against, patterns; the first that matches counts.
RULES = (
    ("workflow:single-agent", "avoid", (r"(?i)(?:不用|不要|别|避免).{0,8}(?:多\s*agent|多个\s*agent|multi[-\s]?agent|multiple agents|sub[-\s]?agents?)", r"(?i)(?:don't|do not|avoid).{0,18}(?:multi[-\s]?agent|multiple agents|sub[-\s]?agents?)")),
    ("workflow:single-agent", "prefer", (r"(?i)(?:use|prefer|need).{0,18}(?:multi[-\s]?agent|multiple agents|sub[-\s]?agents?)", r"(?i)(?:使用|优先|需要).{0,10}(?:多\s*agent|多个\s*agent)")),
    ("workflow:avoid-generic-advice", "avoid", (r"(?i)(?:不要|别|避免).{0,8}(?:泛泛建议|泛泛而谈|空泛建议|套话)", r"(?i)(?:don't|do not|avoid).{0,18}(?:generic advice|boilerplate advice|vague advice)")),
    ("workflow:avoid-generic-advice", "prefer", (r"(?i)(?:generic|high-level).{0,12}(?:advice).{0,12}(?:is fine|is okay|works)", r"(?i)(?:泛泛建议|高层建议).{0,8}(?:也可以|可以接受|没问题)")),
    ("workflow:constraints-first", "prefer", (r"(?i)(?:先|优先).{0,8}(?:结合|看|按).{0,8}(?:约束|限制|前提)", r"(?i)(?:constraints?|requirements?).{0,18}(?:first|before)", r"(?i)(?:ground|anchor).{0,18}(?:constraints?|requirements?)")),
    ("style:concise-direct", "prefer", (r"(?i)(?:简洁一点|简短一点|直接一点|简明|简洁回复|简洁回答)", r"(?i)(?:concise|brief|short|direct|factual).{0,16}(?:response|reply|answer)?")),
    ("workflow:avoid-reconfirm", "avoid", (r"(?i)(?:别|不要|避免).{0,10}(?:确认来确认去|反复确认|一直确认)", r"(?i)(?:don't|do not|avoid).{0,22}(?:repeated confirmations?|confirmation loops?|asking to confirm repeatedly)")),
)
MARKER = "\n…[auto-recall query truncated; keeping latest context]…\n"
TOKEN = r"[\p{L}\p{N}]{2,}"


def sensitive(c: Column) -> Column:
    return any_of(trimmed(F.coalesce(c, F.lit(""))), SENSITIVE)


def reflection_line(c: Column) -> Column:
    """A line without bold marks and its label."""
    return trimmed(F.regexp_replace(F.regexp_replace(c, r"\*\*", ""), LABEL, ""))


def placeholder(c: Column) -> Column:
    t = trimmed(F.regexp_replace(c, r"\*\*", ""))
    return (t == "") | any_of(t, PLACEHOLDER)


def unsafe(c: Column) -> Column:
    t = reflection_line(c)
    return (t == "") | any_of(t, UNSAFE)


def skipped_message(role: Column, c: Column) -> Column:
    """Blank messages, commands, and user messages that carry recalled text."""
    t = trimmed(F.coalesce(c, F.lit("")))
    return (t == "") | F.startswith(t, F.lit("/")) | ((role == "user") & (t.contains("<relevant-memories>") | t.contains("UNTRUSTED DATA")))


def error_signal(c: Column) -> Column:
    return any_of(F.lower(c), ERRORS)


def error_summary(c: Column, most: int = 220) -> Column:
    t = trimmed(F.regexp_replace(redact(F.coalesce(c, F.lit(""))), r"\s+", " "))
    return F.when(t == "", "(empty tool error)").when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(most - 3)), F.lit("...")))


def for_context(c: Column, most: int = 300) -> Column:
    """A text that may stand inside a prompt: one line, no tags, no angle brackets."""
    t = F.regexp_replace(F.regexp_replace(c, r"[\r\n]+", r"\\n"), r"</?[a-zA-Z][^>]*>", "")
    return F.left(trimmed(F.regexp_replace(F.translate(t, "<>", "＜＞"), r"\s+", " ")), F.lit(most))


def truncated_query(c: Column, most: int = 400) -> Column:
    """The first fifth and the end of a long query, with a mark between."""
    room = most - len(MARKER)
    head = min(max(8, room // 5), max(0, room - 40))
    tail = most - len(MARKER) - head
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit(MARKER), F.right(c, F.lit(tail))))


def enriched(c: Column) -> Column:
    """struct(l0, l1, l2): the first sentence, a bullet of it, the text."""
    first = F.regexp_extract(c, r"^[^.!?。！？\n]+[.!?。！？]?", 0)
    l0 = trimmed(F.left(F.when(first != "", first).otherwise(c), F.lit(100)))
    return F.struct(l0.alias("l0"), F.concat(F.lit("- "), l0).alias("l1"), c.alias("l2"))


def governance_rule(c: Column) -> Column:
    """struct(topic, polarity) of the standing rule that a text states; null where it states none."""
    rules = [F.when(any_of(c, patterns), F.struct(F.lit(topic).alias("topic"), F.lit(polarity).alias("polarity"))) for topic, polarity, patterns in RULES]
    return F.coalesce(*rules)


def conflicting(a: Column, b: Column) -> Column:
    """Whether two rules are of one topic and opposite."""
    return F.coalesce((a["topic"] == b["topic"]) & (a["polarity"] != b["polarity"]), F.lit(False))


def steps(c: Column, most: int = 3) -> Column:
    """Lines and sentences of 12 to 180 signs that say what was done, to be used again."""
    parts = F.transform(F.split(c, r"\r?\n|[。！？!?]"), lambda x: trimmed(F.regexp_replace(x, r"(?i)^\s*(?:user|assistant)\s*:\s*", "")))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: F.length(x).between(12, 180) & any_of(x, STEP))), 1, most)


def touched_files(c: Column, most: int = 20) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(FILE), F.lit(0))), 1, most)


def ignores(said: Column, injected: Column) -> Column:
    """Whether a message shares hardly a word with the texts that were put before it."""
    own = F.array_distinct(F.regexp_extract_all(F.lower(said), F.lit(TOKEN), F.lit(0)))
    other = F.array_distinct(F.regexp_extract_all(F.lower(injected), F.lit(TOKEN), F.lit(0)))
    common = F.size(F.array_intersect(own, other))
    return (F.size(own) > 0) & (F.size(other) > 0) & (common / F.greatest(F.size(own), F.lit(1)) < 0.08) & (common < 4)


def age_label(at: Column, now: int) -> Column:
    minutes = F.floor((F.lit(now) - at) / 60_000)
    return F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
