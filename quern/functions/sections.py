"""Column functions on notes in markdown and on sentences about their writer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.recall_text import any_of
from quern.functions.text import trimmed

# What lines of a rule, of a change and of an open task begin with or hold; how names and forms of address are given.
RULE = (r"(?i)^(always|never|when\b|if\b|before\b|after\b|prefer\b|avoid\b|require\b|only\b|do not\b|must\b|should\b)", r"(?i)\b(must|should|never|always|prefer|avoid|required?)\b")
CHANGE = (
    r"(?i)^(this run|next run|going forward|follow-up|re-check|retest|verify|confirm|avoid repeating|adjust|change|update|retry|keep|watch)\b",
    r"(?i)\b(this run|next run|delta|change|adjust|retry|re-check|retest|verify|confirm|avoid repeating|follow-up)\b",
)
OPEN = (r"(?i)^(investigate|verify|confirm|re-check|retest|update|add|remove|fix|avoid|keep|watch|document)\b",)
NAMES = (
    r"(?i)(?:我的名字是|我(?:现在)?叫|本名是)\s*([^\s，。,.!！?？\"'“”‘’「」『』]+)",
    r"(?i)calls?\s+themselves\s+['\"]([^'\"]+)['\"]",
    r"(?i)name\s+is\s+['\"]?([^'\".,\n]+)['\"]?",
)
ADDRESSES = (
    r"(?i)(?:以后你叫我|以后请叫我|请叫我|以后称呼我(?:为)?|称呼我(?:为)?|称呼其为|称呼他为)\s*([^\s，。,.!！?？\"'“”‘’「」『』]+)",
    r"(?i)(?:希望(?:在[^\n。]{0,20})?(?:以后)?(?:你)?(?:被)?称呼(?:我|其|他)?为)\s*([^\s，。,.!！?？\"'“”‘’「」『』]+)",
    r"(?i)(?:被称呼为|称呼偏好(?:是)?|Preferred address(?: is)?|be addressed as|addressed as)\s*['\"]?([^'\".,\n]+)['\"]?",
)
LIKES = r"(?i)\b(?:like|love|prefer|enjoy)\s+([a-z0-9'& -]{1,80}?)\s+from\s+([a-z0-9'& -]{1,40})"


def section(markdown: Column, heading: str) -> Column:
    """The lines under a heading of the second level, up to the next one."""
    lines = F.split(markdown, r"\r?\n")

    def step(acc: Column, line: Column) -> Column:
        low = F.lower(trimmed(line))
        starts = F.startswith(low, F.lit("## "))
        inside = F.when(starts, (low == f"## {heading.lower()}") & ~acc["over"]).otherwise(acc["inside"])
        kept = F.when(~starts & inside, F.concat(acc["out"], F.array(line))).otherwise(acc["out"])
        return F.struct(kept.alias("out"), inside.alias("inside"), (acc["over"] | (acc["inside"] & ~inside)).alias("over"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("inside"), F.lit(False).alias("over"))
    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def bullets(markdown: Column, heading: str) -> Column:
    """The bullets under a heading, without their marks."""
    lines = F.transform(section(markdown, heading), trimmed)
    marked = F.filter(lines, lambda x: F.startswith(x, F.lit("- ")) | F.startswith(x, F.lit("* ")))
    return F.filter(F.transform(marked, lambda x: trimmed(F.substr(x, F.lit(3)))), lambda x: x != "")


def line_kind(line: Column) -> Column:
    """invariant, derived, open or plain: what a line of a reflection is good for, the first that applies."""
    return F.when(any_of(line, RULE), "invariant").when(any_of(line, CHANGE), "derived").when(any_of(line, OPEN), "open").otherwise("plain")


def _captured(c: Column, patterns: tuple[str, ...]) -> Column:
    found = [F.regexp_replace(F.regexp_replace(F.regexp_extract(c, p, 1), r"^[\s\"'“”‘’「」『』*`_]+", ""), r"[\s\"'“”‘’「」『』*`_。！，、,.!?:：；;]+$", "") for p in patterns]
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in found))


def own_name(c: Column) -> Column:
    """The name that a sentence gives its writer; null where it gives none."""
    return _captured(c, NAMES)


def form_of_address(c: Column) -> Column:
    return _captured(c, ADDRESSES)


def liked_items(c: Column) -> Column:
    """struct(brand, items) of "like a, b and c from brand"; null where nothing is liked so."""
    token = lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"(?i)\b(?:the|a|an)\s+", ""), r"\s+", ""))
    items = F.filter(F.transform(F.split(F.regexp_extract(c, LIKES, 1), r"(?i) and | & |/"), token), lambda x: x != "")
    brand = token(F.regexp_extract(c, LIKES, 2))
    return F.when((brand != "") & (F.size(items) > 0), F.struct(brand.alias("brand"), items.alias("items")))
