"""Problem 5: personal data in free text, found and replaced.

Method: surrogate generation.  A detected entity is brought to one spelling and
named by a keyed hash of it; what is written between the steps is that hash and
the form (gender, script, order, case, which signs are digits or letters), never
the entity.  Surrogates follow from key, hash and form, so the same entity is the
same everywhere, in any order or case.  One pass over the distinct entities checks
that no two share a surrogate and that none is an entity of the corpus, and draws
again for those.  In ``placeholder`` style a surrogate is a placeholder of the
kind with a keyed number, in ``surrogate`` style a value that looks alike.

Names are found by a given and related family name of the lexicon, of small
general tables, or of the parts learned from the corpus (``names``), by initials
beside a family name, and behind words that introduce a name.

Defined results: null and empty texts hold nothing; of overlapping finds the one
of the earlier kind in ``KINDS`` wins; a record is named by its table and id; an
entity that no draw can keep apart gets a placeholder, never its own text.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from collections.abc import Iterable, Iterator
from copy import copy

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import names as nm
from quern.llm.conversations import content_blocks, content_text
from quern.session import cut_lineage, partitions, table

KINDS = ("email", "id_number", "phone", "address", "name")
MOST_NAMES = nm.MOST_NAMES
#: Session setting with the key of the registered queries; without it each run draws a key of its own.
KEY_SETTING = "spark.quern.surrogate.key"

# Spellings of the parts of an address that stand for a person or a place.
AT = r"(?:\s?[@＠]\s?|\s?[\[({<]\s?at\s?[\])}>]\s?|&#64;|%40|\s_at_\s?)"
DOT = r"(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\s_dot_\s?)"
EMAIL = re.compile(
    rf"(?i)(?<![a-z0-9_.+@-])[a-z0-9][a-z0-9_.+'-]*(?:\s?[\[({{<]\s?dot\s?[\])}}>]\s?[a-z0-9_+-]+)*{AT}(?:[a-z0-9-]+{DOT})+[a-z]{{2,12}}(?![a-z0-9_@])"
    r"|(?<![a-z0-9_.+@-])[a-z0-9][a-z0-9_+'-]*(?:(?:\.|\sdot\s)[a-z0-9_+-]+)*\sat\s[a-z0-9-]+(?:\sdot\s[a-z0-9-]+)+(?![a-z0-9_@])"
)
#: Of the parts that stand for @, those in letters; the pattern is tried only where a text holds one or the sign itself.
AT_IN_LETTERS = re.compile(r"[\[({<]\s?at\s?[\])}>]|\s_at_")
AT_SPOKEN = re.compile(r"\sat\s")
LOGIN = re.compile(r"(?i)\b(?:ssh|scp|sftp|rsync|mosh)\s(?:-\S+\s)*\S*$")
ID_VALUE = r"(?:\d{3}[- ]\d{2}[- ]\d{4}|\d{17}[\dXx]|\d{15}|[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-Z]|[A-Z]{1,2}\d{7,9}|\d{2} \d{6} [A-Z] \d{3}|\d{9,12}|\d{2,3}(?:[ /]\d{3}){2,3})"
ID_HINT = r"(?:social security(?: (?:number|no\.?))?|\bssn|\btax (?:id|number|no\.?)|\btin|passport(?: (?:number|no\.?))?|(?:national )?identity (?:number|card|no\.?)|national id|\bid card|身份证(?:号码?)?|护照(?:号码?)?|税号|纳税人识别号|社保号|steuer-?(?:id|nummer)|ausweis(?:nummer)?|reisepass(?:nummer)?|sozialversicherungsnummer|personalausweis(?:nummer)?)"
ID_NUMBER = re.compile(rf"(?i:{ID_HINT})(?:\s(?i:number|no\.?|nr\.?))?\s*(?:is|ist|lautet|是|为|[:：=#])?\s*({ID_VALUE})(?![\w-]*\d)", re.S)
ID_HINTS = ("social security", "ssn", "tax", "tin", "passport", "identity", "id card", "national id", "身份证", "护照", "税", "社保", "steuer", "ausweis", "reisepass", "versicherung")
ID_BARE = re.compile(r"(?<![A-Za-z0-9_./-])(9\d{2}-\d{2}-\d{4}|[1-9]\d{5}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx])(?![A-Za-z0-9_-])")
PHONE_HINT = r"(?:number is|phone(?: is)?|\btel\.?|\bcall(?: me)?(?: on| at)?|\bring(?: me)?(?: on| at)?|\btext|whatsapp|\bmobile|\bcell|\bme on|\breach me (?:on|at)|\bfax|handy(?:nummer)?|telefon(?:nummer)?|rufnummer|anruf(?:en)?|电话|手机号?|致电|拨打|打|联系电话)"
PHONE_HINTS = ("number is", "phone", "tel", "call", "ring", "text", "whatsapp", "mobile", "cell", "me on", "reach me", "fax", "handy", "rufnummer", "anruf", "电话", "手机", "致电", "打")
PHONE_VALUE = r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){6,12}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4}|1\d{2}[ -]?\d{4}[ -]?\d{4}|0\d(?:[ .]\d{2}){4}|0\d{1,4}[ /-]\d{4,9})"
PHONE_HINTED = re.compile(rf"(?i:{PHONE_HINT})\s*(?:is|ist|是|[:：=])?\s*({PHONE_VALUE}|\d{{3}}[ -]\d{{4}}|\d(?:[ .-]?\d){{6,12}})(?![\w-]*\d)")
PHONE = re.compile(r"(?<![A-Za-z0-9_.+/=-])(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){6,12}|\(\d{3}\) ?\d{3}-\d{4}|[2-9]\d{2}\.[2-9]\d{2}\.\d{4}|1[3-9]\d[ -]\d{4}[ -]\d{4}|0\d(?:[ .]\d{2}){4})(?![\w.-]*\d)")
NUMBERED = re.compile(r"(?i)(?:order|part|ticket|row|rows|version|build|commit|range|serial|invoice|timeout|sku|item|batch|ref|paid on|\bid)\W{0,3}\w{0,12}\W{0,2}$")
STREET = r"(?:street|str\.|lane|road|avenue|boulevard|way|drive|court|square|terrace|crescent|close|alley|place|parade|quay|row|hill|walk|st\.?|ave\.?|rd\.?|ln\.?|blvd\.?|dr\.?)"
NOT_STREET = r"(?!(?:the|a|an|of|on|in|at|by|to|and|or|for|from|with|percent|credits|entries|rows|minutes|hours|days|nights|times|seconds|items|is|was|are|per|this|that|its|lane|street|road|way|section|gate|more|other)\b)"
#: Strings of which an address holds one in lower case, and the pattern that is then tried.
ADDRESSES = (
    (("street", "str.", "lane", "road", "avenue", "boulevard", " way", "drive", "court", "square", "terrace", "crescent", "close", "alley", "place", "parade", "quay", " row", " hill", "walk", " st", " ave", " rd", " ln", "blvd", " dr"), re.compile(rf"(?i)(?<![a-z0-9_.,:/#-])\d{{1,5}}[a-z]?(?:[-/]\d{{1,4}})?,? (?:(?:north|south|east|west|upper|lower|old|new|saint|st\.) )?(?:{NOT_STREET}[^\W\d_][\w'’.-]* ){{1,3}}{STREET}(?![\w-])")),
    (("straße ", "strasse ", "str. ", "weg ", "gasse ", "platz ", "allee ", "damm ", "ufer ", "ring ", "chaussee ", "pfad ", "steig ", "am ", "der ", "im ", "zum ", "zur ", "alte ", "neue "), re.compile(r"(?i)(?<![a-zäöüß0-9_-])(?:[a-zäöüß][a-zäöüß-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|damm|ufer|ring|chaussee|pfad|steig)|(?:am|an der|im|zum|zur|auf der|alte|neue) [a-zäöüß][a-zäöüß-]{3,}(?:straße|strasse|weg|gasse|platz|allee|damm|ufer|ring)?)\s\d{1,4}\s?[a-z]?(?![\w-])")),
    (("号", "號", "弄"), re.compile(r"(?:[㐀-鿿]{2,6}?(?:省|市|区|县|镇|乡))*[㐀-鿿]{1,6}?(?:大道|胡同|路|街|道|巷|弄|里)\s?\d{1,5}\s?(?:号|號|弄)(?:[㐀-鿿\d]{0,4}(?:单元|栋|幢|楼|室|院|层|座)\s?\d{0,4})*")),
    (("rue ", "via ", "calle ", "avenida "), re.compile(r"(?i)(?<![a-z0-9_-])\d{1,4}(?: bis)?,? (?:rue|via|calle|avenida) (?:[^\W\d_][\w'’-]*)")),
)
LEAD = re.compile(r"[㐀-鿿]*?(?:住在|寄到|寄往|送到|发到|搬到|位于|地址是|地址)(?=[㐀-鿿])")
#: Signs of full width and odd dashes and blanks as their plain forms, one for one, so that offsets stay.
PLAIN = {0xFF01 + i: 0x21 + i for i in range(94)} | dict.fromkeys((0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2212), 0x2D) | dict.fromkeys((0x00A0, 0x2007, 0x202F, 0x3000), 0x20)
SECTION = re.compile(r"(?i)(?:section|chapter|page|line|gate|step|item|part|zoom|row)\s$")
# Behind these a name follows.
NAME_PART = r"[^\W\d_]{2,}(?:[-'’][^\W\d_]{2,})?"
CUE = r"\b(?:my name is|mein name ist|ich heiße|ich heisse|(?:mr|mrs|ms|dr|prof|herr|frau)\.?)\s+"
CUED = re.compile(rf"(?i:{CUE})((?:{NAME_PART}|[A-Z]\.?)(?:\s[A-Z]\.?)?\s{NAME_PART})")
CUES = ("name is", "name ist", "ich hei", "mr", "ms", "dr", "prof", "herr", "frau")
# A Chinese name: behind a word that introduces one, before a title, or of signs that hardly stand in other words.
_FAMILY, _GIVEN = f"[{nm.HAN_FAMILY}]", f"[{nm.HAN_FEMALE}{nm.HAN_MALE}{nm.HAN_EITHER}]"
HAN_NAMES = (
    re.compile(rf"(?:我叫|名叫|叫做|姓名[是为:：]?|联系人[是为:：]?|同事|朋友)({_FAMILY}[㐀-鿿]{{1,2}})(?![㐀-鿿])"),
    re.compile(rf"({_FAMILY}{_GIVEN}{{1,2}})(?=先生|女士|小姐|老师|医生|经理|同学)"),
    re.compile(rf"(?<![㐀-鿿])({_FAMILY}[{nm.HAN_FEMALE}{nm.HAN_MALE}]{{1,2}})(?=[昨今明]天|[说在是来去和与先已正]|[^㐀-鿿]|$)"),
)
HAN_FAMILY = re.compile(_FAMILY)
WORD = nm.WORD
# Words that stand in such places without being names.
NO_NAMES = frozenset("the a an this that these those my your his her our their its and or for with from to of in on at by as is was are be me him them us you it we they she he i not no all any some each every who whom what which when where why how if then than so but one two new old our own der die das den dem ein eine und oder mit von für im am auf ist sind mode cache checklist roster team today please again".split())


def _clear(found: list[tuple[str, int, int]], a: int, b: int) -> bool:
    return all(b <= x or a >= y for _, x, y in found)


class Detector:
    """Finds personal data; a name needs a given name or initial beside a family name."""

    def __init__(self, given: Iterable[str], family: Iterable[str]):
        self.given, self.family = frozenset(x.lower() for x in given), frozenset(x.lower() for x in family)
        #: Given names of the general tables: with a capital and beside a capitalised word.
        self.common = frozenset(nm.FEMALE + nm.MALE) - self.family
        self.known = self.given | self.family | self.common

    def among(self, words: set[str], own: Iterable[tuple[str, str]]) -> Detector:
        """The same for a text of these words, with more name parts (word, part)."""
        given, family = (frozenset(w for w, p in own if p == part) for part in ("given", "family"))
        out = copy(self)
        out.given, out.family, out.common = self.given & words | given, self.family & words | family, self.common & words - family
        out.known = out.given | out.family | out.common
        return out

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) of every entity, by start."""
        if not text:
            return []
        found: list[tuple[str, int, int]] = []
        text = text.translate(PLAIN)
        low = text.lower()
        if "@" in low or "64;" in low or "%40" in low or "at" in low and (AT_IN_LETTERS.search(low) or "dot" in low and AT_SPOKEN.search(low)):
            for m in EMAIL.finditer(text):
                if not LOGIN.search(text[max(0, m.start() - 60) : m.start()]):
                    found.append(("email", m.start(), m.end()))
        if any(c.isdigit() for c in low):
            for m in ID_NUMBER.finditer(text) if any(h in low for h in ID_HINTS) else ():
                if _clear(found, *m.span(1)):
                    found.append(("id_number", *m.span(1)))
            hinted = any(h in low for h in PHONE_HINTS)
            for kind, pattern in (("id_number", ID_BARE), ("phone", PHONE_HINTED), ("phone", PHONE)) if hinted else (("id_number", ID_BARE), ("phone", PHONE)):
                for m in pattern.finditer(text):
                    a, b = m.span(1)
                    if _clear(found, a, b) and (pattern is PHONE_HINTED or not NUMBERED.search(text[max(0, a - 30) : a])):
                        found.append((kind, a, b))
            for m in (m for hints, pattern in ADDRESSES if any(h in low for h in hints) for m in pattern.finditer(text)):
                a, b = m.span()
                lead = LEAD.match(text, a, b)  # Chinese has no blanks: the verb before is no part of the place
                a = lead.end() if lead else a
                if _clear(found, a, b) and not SECTION.search(text[max(0, a - 10) : a]):
                    found.append(("address", a, b))
        self._names(text, low, found)
        return sorted(found, key=lambda x: x[1])

    def _names(self, text: str, low: str, found: list[tuple[str, int, int]]) -> None:
        for m in CUED.finditer(text) if any(c in low for c in CUES) else ():
            a, b = m.span(1)
            words = WORD.findall(text[a:b])
            if all(w[0].isupper() for w in words) and not any(w.lower() in NO_NAMES for w in words) and _clear(found, a, b):
                found.append(("name", a, b))
        if HAN_FAMILY.search(text):
            for pattern in HAN_NAMES:
                for m in pattern.finditer(text):
                    if _clear(found, *m.span(1)):
                        found.append(("name", *m.span(1)))
        if self.known.isdisjoint(WORD.findall(low)):
            return
        words = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]
        for i, (w, a, b) in enumerate(words[:-1]):
            v, c, d = words[i + 1]
            gap = text[b:c]
            end = d
            if len(v) == 1 and gap == " " and w in self.given and i + 2 < len(words) and text[d : words[i + 2][1]] in (". ", " "):
                v, c, end = words[i + 2]  # given name, initial, family name
            elif gap not in (" ", ", ", ". ", "."):
                continue
            initial_first = len(w) == 1 and gap in (". ", ".") or len(w) == 1 and gap == " " and text[a].isupper() and w not in "ai"
            capitals = gap == " " and text[a].isupper() and text[c].isupper() and len(v) > 3 and v not in NO_NAMES and text[c:end][1:].islower() and text[a:b][1:].islower()
            pair = (
                (w in self.given and v in self.family and gap != ". " and gap != ".") or (w in self.family and v in self.given and gap in (" ", ", "))
                or (initial_first and v in self.family)
                or (w in self.family and len(v) == 1 and gap in (" ", ", ") and text[d : d + 1] == ".")
                or (capitals and (w in self.given or w in self.common) and self._unlike_word(text, a, end))
            )
            if pair and _clear(found, a, end) and text[max(0, a - 1) : a] not in ("@", ".", "+", "_", "/", "-") and text[end : end + 1] not in ("@", "＠", "+", "_", "/"):
                found.append(("name", a, end))

    def _unlike_word(self, text: str, a: int, end: int) -> bool:
        return text[max(0, a - 4) : a].lower() != "the " and not text[end : end + 1].isalnum()


def canonical(kind: str, value: str) -> str:
    """One spelling for all forms of an entity."""
    value = value.lower()
    if kind == "email":
        value = re.sub(r"\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s|\s_at_\s?|&#64;|%40|＠", "@", value)
        return re.sub(r"\s+", "", re.sub(r"\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s|\s_dot_\s?", ".", value))
    if kind in ("phone", "id_number"):
        return re.sub(r"[^0-9a-z+]", "", value)
    if kind == "name":
        return " ".join(sorted(re.findall(r"[^\W\d_]+", value)))
    return re.sub(r"[\s,]+", " ", value).strip()


def token(key: bytes, kind: str, value: str) -> str:
    """An entity's keyed name."""
    return hmac.new(key, f"{kind}\0{canonical(kind, value)}".encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest()[:32]


def _numbers(key: bytes, *seed: object) -> Iterator[int]:
    """An endless keyed stream of 16-bit numbers."""
    count = 0
    while True:
        block = hmac.new(key, "\0".join(map(str, (*seed, count))).encode(), hashlib.sha256).digest()
        yield from (int.from_bytes(block[i : i + 2], "big") for i in range(0, 32, 2))
        count += 1


# Signs of a form: a lower-case letter, a capital, a digit, a Chinese sign to be drawn.
LOWER, UPPER, DIGIT, HAN = "\x11", "\x12", "\x13", "\x14"
KEEP_WORD = re.compile(rf"(?i){STREET}$|(?:north|south|east|west|upper|lower|old|new|am|an|der|im|zum|zur|auf|rue|via|calle)$")
STREET_END = re.compile(r"(?i)(.*?)(straße|strasse|str\.|weg|gasse|platz|allee|damm|ufer|ring|chaussee|pfad|steig)$")
KEEP_HAN = "省市区县镇乡路街道巷弄里号號单元栋幢楼室院层座大胡同"
HAN_PLACE = "松柏青云白鹭月桥安澜听雨银杏石溪竹梅兰枫荷湖山泉林岭星光明和平春晓"


def _masked(text: str) -> str:
    return "".join(DIGIT if c.isdigit() else HAN if "㐀" <= c <= "鿿" else LOWER if c.islower() else UPPER if c.isupper() else c for c in text)


def form_of(kind: str, value: str, given: frozenset[str] = frozenset(), family: frozenset[str] = frozenset()) -> str:
    """What a surrogate keeps of an entity: kind of signs, order, case and gender, not the value."""
    if kind == "name":
        if "㐀" <= value[0] <= "鿿":
            return f"han|{nm.gender_of(value[1:])}|1|{len(value) - 1}"
        case = "u" if value.isupper() and len(value) > 3 else "l" if value.islower() else "t"
        words = [(m.group(), m.start(), m.end()) for m in WORD.finditer(value)]
        full = [i for i, w in enumerate(words) if len(w[0]) > 1]
        if len(full) > 1:
            first, last = words[full[0]][0].lower(), words[full[-1]][0].lower()
            back = "," in value or (first in family and first not in given) or (last in given and last not in family)
            at = {full[0]: "F" if back else "G", full[-1]: "G" if back else "F"}
            gender = nm.gender_of(last if back else first)
        else:
            at, gender = {full[0]: "F"} if full else {}, "n"
        out, end = [], 0
        for i, (_, a, b) in enumerate(words):
            out += [value[end:a], at.get(i, "I" if len(words[i][0]) == 1 else "M")]
            end = b
        return f"latin|{gender}|{case}|{''.join(out)}{value[end:]}"
    if kind == "email":
        parts = re.split(rf"({AT}|{DOT}|\sat\s|\sdot\s)", value)
        return "".join(p if i % 2 or i == len(parts) - 1 else _masked(p) for i, p in enumerate(parts))
    if kind == "phone":
        lead = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d{2}|0+", value)
        at = lead.end() if lead else 0
        return value[:at] + _masked(value[at:])
    if kind == "id_number" and re.fullmatch(r"\d{17}[\dXx]", value):
        return "resident"
    if kind == "address":
        out = []
        for word in re.split(r"(\s+|,)", value):
            end = STREET_END.match(word)
            if KEEP_WORD.match(word):
                out.append(word)
            elif end:
                out.append(_masked(end[1]) + end[2])
            else:
                out.append("".join(c if c in KEEP_HAN else _masked(c) for c in word))
        return "".join(out)
    return _masked(value)


def render(kind: str, form: str, key: bytes, entity: str, draw: int = 0, style: str = "surrogate") -> str:
    """The surrogate of an entity in a form; ``draw`` counts up after a collision."""
    draws = _numbers(key, kind, entity, draw)
    if style == "placeholder":
        return f"[{kind.upper()}_{next(draws):04x}{next(draws):04x}{next(draws):04x}]"
    if kind == "name":
        script, gender, third, fourth = form.split("|", 3)
        if script == "han":
            return nm.made_han(int(third), int(fourth), gender, next(draws), next(draws) << 16 | next(draws))
        number = next(draws)
        given = nm.made_given("mf"[next(draws) % 2] if gender == "n" else gender, number)
        last = nm.made_family(next(draws) << 16 | next(draws))
        made = {"G": given, "I": given[0], "F": last, "M": nm.made_family(next(draws))}
        out = "".join(made.get(c, c) for c in fourth)
        return out.upper() if third == "u" else out.lower() if third == "l" else out
    if form == "resident":  # region, date of birth, number and the check digit that belongs to them
        body = f"{11 + next(draws) % 50:02d}{next(draws) % 10000:04d}{1950 + next(draws) % 60}{1 + next(draws) % 12:02d}{1 + next(draws) % 28:02d}{next(draws) % 1000:03d}"
        return body + "10X98765432"[sum(int(c) * 2 ** (17 - i) for i, c in enumerate(body)) % 11]
    out = []
    for c in form:
        if c == DIGIT:
            out.append(str(next(draws) % 10))
        elif c in (LOWER, UPPER):
            out.append(chr((97 if c == LOWER else 65) + next(draws) % 26))
        elif c == HAN:
            out.append(HAN_PLACE[next(draws) % len(HAN_PLACE)])
        else:
            out.append(c)
    return "".join(out)


def lexicon_of(lexicon: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    rows = lexicon.where("name is not null").select("name", "part_of_name").distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"the name lexicon is sent to all tasks and may hold {MOST_NAMES} names")
    pick = lambda part: tuple(sorted({r[0] for r in rows if (r[1] or "").lower() == part}))
    return pick("given"), pick("family")


def records(memories: DataFrame, messages: DataFrame) -> DataFrame:
    """src, rec_id, text of both tables; unreadable block lists are taken as they stand."""
    a = memories.where("id is not null and text is not null").select(F.lit("memory").alias("src"), F.col("id").alias("rec_id"), "text")
    b = messages.where("msg_id is not null and content is not null").select(F.col("msg_id").cast("string").alias("rec_id"), "content", content_blocks(F.col("content")).alias("blocks"))
    text, unreadable = content_text(F.col("content"), F.col("blocks"))
    return a.unionByName(b.select(F.lit("message").alias("src"), "rec_id", F.when(unreadable, F.col("content")).otherwise(text).alias("text")))


#: (given names, family names) for all tasks and, where they are too many to be sent, a table of the learned parts.
Names = tuple[tuple[str, ...], tuple[str, ...]] | tuple[tuple[str, ...], tuple[str, ...], DataFrame]


def _detector(rows: DataFrame, lexicon: DataFrame) -> Names:
    """The names of the lexicon and those learned from the rows."""
    given, family = lexicon_of(lexicon)
    more = nm.learned_parts(rows, given, family)
    return (given, family, more) if isinstance(more, DataFrame) else ((*given, *more[0]), (*family, *more[1]))


def words_in(text: str) -> set[str]:
    """The words of a text in every spelling in which they are looked up."""
    plain = text.translate(PLAIN)
    return {w.lower() for t in (text, plain, plain.lower()) for w in WORD.findall(t)}


def _with_own_names(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` with own, the learned parts among each text's words.

    They come back by a hash of the text: a part that a text does not hold changes nothing.
    """

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted(words_in(t)) for t in batch.column(1).to_pylist()]
            at = [i for i, x in enumerate(lists) for _ in x]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([w for x in lists for w in x], pa.string())], names=["text_hash", "word"])

    keyed = rows.select("src", "rec_id", "text", F.xxhash64("text").alias("text_hash"))
    said = keyed.where("text is not null").select("text_hash", "text").mapInArrow(words, "text_hash bigint, word string")
    own = said.join(parts, "word").groupBy("text_hash").agg(F.collect_set(F.struct("word", "part")).alias("own"))
    return keyed.join(own, "text_hash", "left").select("src", "rec_id", "text", "own")


def spans(rows: DataFrame, names: Names, key: bytes | None = None) -> DataFrame:
    """src, rec_id, kind, start, stop and, with a key, entity and form of every find; offsets count code points."""
    given, family = names[:2]
    rows = _with_own_names(rows, names[2]) if len(names) > 2 else rows.select("src", "rec_id", "text")

    def detect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        general = Detector(given, family)
        for batch in batches:
            at, out = [], []
            own = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            for i, text in enumerate(batch.column(2).to_pylist()):
                detector = general.among(words_in(text), [(x["word"], x["part"]) for x in own[i]]) if own[i] else general
                for kind, a, b in detector.find(text):
                    at.append(i)
                    value = text[a:b]
                    out.append((kind, a, b, token(key, kind, value), form_of(kind, value, detector.given, detector.family)) if key else (kind, a, b, "", ""))
            if at:
                take = pa.array(at, pa.int64())
                kind, a, b, entity, form = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(kind), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(entity), pa.array(form)], names=["src", "rec_id", "kind", "start", "stop", "entity", "form"])

    return rows.mapInArrow(detect, "src string, rec_id string, kind string, start int, stop int, entity string, form string")


def _rendered(rows: DataFrame, key: bytes, style: str) -> DataFrame:
    """``rows`` (kind, entity, form, draw and others) with surrogate, and the keyed name it would have as an entity; draw -1 is a placeholder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, entities, forms, draws = (batch.column(n).to_pylist() for n in ("kind", "entity", "form", "draw"))
            given = [f"[{k.upper()}_{e}]" if d < 0 else render(k, f, key, e, d, style) for k, e, f, d in zip(kinds, entities, forms, draws, strict=True)]
            as_entity = [token(key, k, v) for k, v in zip(kinds, given, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(given, pa.string()), pa.array(as_entity, pa.string())], names=[*batch.schema.names, "surrogate", "as_entity"])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", surrogate string, as_entity string")


def assign_draws(found: DataFrame, key: bytes, style: str = "placeholder", most_draws: int = 40) -> DataFrame:
    """kind, entity, draw: the first draw whose surrogate no earlier entity has and that is no entity of the corpus.

    Of a collision the smallest entity keeps its surrogate, the others draw again;
    what is open after ``most_draws`` gets draw -1, a placeholder with the entity's keyed name.
    """
    entities = cut_lineage(found.groupBy("kind", "entity").agg(F.min("form").alias("form")))
    real = entities.select("kind", F.col("entity").alias("as_entity"), F.lit(True).alias("real"))
    open_ones, done = entities, None
    for number in range(most_draws):
        drawn = _rendered(open_ones.withColumn("draw", F.lit(number)), key, style).join(real, ["kind", "as_entity"], "left").withColumn("real", F.coalesce("real", F.lit(False))).drop("surrogate")
        if done is not None:
            drawn = drawn.unionByName(done)
        first = F.row_number().over(Window.partitionBy("kind", "as_entity").orderBy("draw", "entity"))
        ranked = cut_lineage(drawn.withColumn("n", first))
        done, open_ones = ranked.where("n = 1 and not real").drop("n"), ranked.where("n > 1 or real").select("kind", "entity", "form")
        if open_ones.isEmpty():
            break
    return done.select("kind", "entity", "draw").unionByName(open_ones.select("kind", "entity", F.lit(-1).alias("draw")))


def redacted(rows: DataFrame, lexicon: DataFrame, key: bytes, style: str = "placeholder") -> DataFrame:
    """src, rec_id, text with every entity replaced; only records in which one was found."""
    rows = rows.dropDuplicates(["src", "rec_id"])
    found = cut_lineage(spans(rows, _detector(rows, lexicon), key))
    given = _rendered(found.join(assign_draws(found, key, style), ["kind", "entity"], "left").withColumn("draw", F.coalesce("draw", F.lit(-1))), key, style)
    edits = given.groupBy("src", "rec_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "surrogate"))).alias("edits"))
    cut = lambda acc, e: F.struct(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, e["start"] - acc["at"]), e["surrogate"]).alias("out"), e["stop"].alias("at"))
    done = F.aggregate("edits", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), cut, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return rows.join(edits, ["src", "rec_id"]).select("src", "rec_id", done.alias("text"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = records(table(spark, sf_dir, "memories"), table(spark, sf_dir, "session_messages"))
    return rows, table(spark, sf_dir, "name_lexicon")


def _key(spark: SparkSession) -> bytes:
    """The key that the session names; else a random one, so that nobody can rebuild the mapping."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else secrets.token_bytes(32)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lexicon = _tables(spark, sf_dir)
    found = spans(rows.repartition(partitions(rows), "src", "rec_id"), _detector(rows, lexicon))
    return found.select("src", "rec_id", "kind").distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lexicon = _tables(spark, sf_dir)
    return redacted(rows, lexicon, _key(spark))


def p5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with look-alike values in place of what was found."""
    rows, lexicon = _tables(spark, sf_dir)
    return redacted(rows, lexicon, _key(spark), "surrogate")
