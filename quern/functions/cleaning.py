"""Column functions that take out of messages what was put around them: headers, wrappers, blocks of recalled text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import ascii_borders, trimmed

# Marks of what is put around messages.
WRAPPER = r"(?i)^\[(?:Subagent Context|Subagent Task)\]\s*"
BOILERPLATE = r"(?i)^(?:Results auto-announce to your requester\.?|do not busy-poll for status\.?|Reply with a brief acknowledgment only\.?|Do not use any memory tools\.?)$"
LEADING_BOILERPLATE = r"(?i)^(?:(?:You are running as a subagent\b.*?(?:(?<=\.)\s+|$)|Results auto-announce to your requester\.?\s*|do not busy-poll for status\.?\s*|Reply with a brief acknowledgment only\.?\s*|Do not use any memory tools\.?\s*))+"
ANY_BOILERPLATE = r"(?i)(?:You are running as a subagent\b.*?(?:$|(?<=\.)\s+)|Results auto-announce to your requester\.?\s*|do not busy-poll for status\.?\s*|Reply with a brief acknowledgment only\.?\s*|Do not use any memory tools\.?\s*)"
SUBAGENT = r"(?i)^You are running as a subagent\b"
SYSTEM_LINE = r"(?m)^System:\s*\[[\d\-: +GMT]+\]\s+\S+\[.*?\].*$"
LABELLED_BLOCK = r"(?:Conversation info|Sender|Replied message)\s*\(untrusted[^)]*\):\s*```json\s*\{[\s\S]*?\}\s*```"
ENVELOPE_BLOCK = r'```json\s*(?=\{[\s\S]*?"message_id"\s*:)(?=\{[\s\S]*?"sender_id"\s*:)\{[\s\S]*?\}\s*```'
INBOUND_BLOCK = (
    r"(?:^|\n)\s*(?:Conversation info \(untrusted metadata\):|Sender \(untrusted metadata\):|Thread starter \(untrusted, for context\):|Replied message \(untrusted, for context\):"
    r"|Forwarded message context \(untrusted metadata\):|Chat history since last reply \(untrusted, for context\):)\s*\n```json[\s\S]*?\n```\s*"
)
EXEC_LINE = r"(?im)^System:\s*\[[^\n]*?\]\s*Exec\s+(?:completed|failed|started)\b.*$"
RESET = "A new session was started via /new or /reset. Execute your Session Startup sequence now"
ADDRESSED = r"^(?:<@!?[0-9]+>|@[A-Za-z0-9_.-]+)\s*"
RECALLED = r"(?i)<relevant-memories>\s*[\s\S]*?</relevant-memories>\s*"
UNTRUSTED = r"(?i)\[UNTRUSTED DATA[^\n]*\][\s\S]*?\[END UNTRUSTED DATA\]\s*"


def _gone(c: Column, pattern: str, instead: str = "") -> Column:
    return F.regexp_replace(c, ascii_borders(pattern), instead)


def _few_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def without_envelope(text: Column) -> Column:
    """A message without wrapper lines at its start, system lines, and blocks of channel metadata.

    The start is a run of blank lines, wrapper lines, what follows them as their
    content, and set phrases after the first wrapper; it ends with the first line
    of the message itself. One walk over the lines carries where it stands.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n")

    def step(acc: Column, line: Column) -> Column:
        t = trimmed(line)
        wraps = t.rlike(WRAPPER)
        inside = F.regexp_replace(_gone(_gone(t, WRAPPER), LEADING_BOILERPLATE), r"\s{2,}", " ")
        leading = acc["leading"]
        kept = (
            F.when(~leading, line).when(wraps, trimmed(inside)).when(t == "", "")
            .when(t.rlike(BOILERPLATE), F.when(acc["wrapped"], "").otherwise(line)).when(acc["wrapped"] & t.rlike(ascii_borders(SUBAGENT)), "").otherwise(line)
        )
        still = leading & (wraps | (t == "") | t.rlike(BOILERPLATE) | (acc["wrapped"] & t.rlike(ascii_borders(SUBAGENT))))
        return F.struct(F.concat(acc["out"], F.array(kept)).alias("out"), still.alias("leading"), (acc["wrapped"] | (leading & wraps)).alias("wrapped"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("leading"), F.lit(False).alias("wrapped"))
    joined = F.array_join(F.aggregate(lines, start, step, lambda acc: acc["out"]), "\n")
    for pattern in (SYSTEM_LINE, LABELLED_BLOCK, ENVELOPE_BLOCK):
        joined = _gone(joined, pattern)
    return trimmed(_few_blank_lines(joined))


def _without_inbound(c: Column, rounds: int = 3) -> Column:
    """Blocks put before a message; one may stand before another, so a few rounds."""
    for _ in range(rounds):
        c = trimmed(_few_blank_lines(_gone(_gone(c, EXEC_LINE, "\n"), INBOUND_BLOCK, "\n")))
    return c


def _without_wrappers(c: Column) -> Column:
    """Without the wrapper lines at the start; what a wrapper line says itself is its last kept line."""
    lines = F.split(trimmed(c), "\n")

    def step(acc: Column, line: Column) -> Column:
        t = trimmed(line)
        wraps = t.rlike(WRAPPER)
        said = trimmed(F.regexp_replace(_gone(_gone(t, WRAPPER), ANY_BOILERPLATE), r"\s{2,}", " "))
        kept = F.when(~acc["leading"], F.array(line)).when(t == "", F.array().cast("array<string>")).when(wraps, F.when(said != "", F.array(said)).otherwise(F.array().cast("array<string>"))).otherwise(F.array(line))
        return F.struct(F.concat(acc["out"], kept).alias("out"), (acc["leading"] & ((t == "") | (wraps & (said == "")))).alias("leading"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("leading"))
    return trimmed(F.array_join(F.aggregate(lines, start, step, lambda acc: acc["out"]), "\n"))


def _without_reset(c: Column) -> Column:
    blank = F.instr(c, "\n\n")
    after = F.when(blank > 0, F.substr(c, blank + 2)).otherwise(F.array_join(F.slice(F.split(c, "\n"), 3, 1_000_000), "\n"))
    return F.when(F.startswith(c, F.lit(RESET)), trimmed(after)).otherwise(c)


def capture_text(role: Column, text: Column) -> Column:
    """What a message says without what was put before it; null where nothing is left or the role is missing.

    Only texts of users are cleaned; others are trimmed.
    """
    t = _gone(_gone(trimmed(F.coalesce(text, F.lit(""))), RECALLED), UNTRUSTED)
    t = _without_inbound(_without_reset(trimmed(t)))
    t = _without_inbound(_without_wrappers(trimmed(_gone(t, ADDRESSED))))
    out = F.when(role == "user", trimmed(_few_blank_lines(t))).otherwise(trimmed(F.coalesce(text, F.lit(""))))
    return F.when(role.isNotNull() & (out != ""), out)
