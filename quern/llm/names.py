"""Names of people: small general tables, parts learned from the corpus, and made names for surrogates.

A lexicon is never complete.  ``learned_names`` finds the parts it lacks: words
that stand beside a known given name (or before a known family name) in most of
their places, with several different partners, and are often written like a
name.  Counts cover all rows and are made in the executors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common given names that are not everyday words, by gender.
FEMALE = tuple("anna maria emma olivia sophia isabella mia charlotte amelia emily elizabeth sofia victoria julia laura sarah hannah katharina johanna sabine ursula ingrid monika claudia susanne priya ananya deepika fatima aisha leila yuki sakura elena natalia olga irina carmen lucia marta chloe camille juliette margaret patricia jennifer linda barbara jessica nancy karen helen deborah rachel".split())
MALE = tuple("james john robert michael william david richard joseph thomas daniel matthew anthony andrew joshua kevin brian george edward ronald timothy jason jeffrey ryan jacob hans klaus stefan andreas juergen wolfgang dieter uwe rahul arjun vikram rajesh sanjay mohammed ahmed omar yusuf hiroshi kenji dmitri sergei pavel carlos luis miguel pedro antoine pierre henri giovanni marco".split())
# Frequent Chinese family names, and signs that stand in given names much more than in other words.
HAN_FAMILY = "王李张刘陈杨黄赵周吴徐孙朱胡郭林郑梁谢宋唐许韩冯邓曹彭袁潘蒋蔡杜魏吕沈姚卢姜崔谭汪廖贾邹孟邱薛闫侯陶黎贺龚邵"
HAN_FEMALE = "芳娜静丽艳娟霞玲莉婷怡琳倩颖洁莹岚萍蓉"
HAN_MALE = "伟强磊勇涛刚鹏斌辉浩宇轩杰峰俊凯毅"
HAN_EITHER = "敏明文晓小志春秀红玉海云"

#: A word of letters; Chinese signs beside it are no part of it.
WORD = re.compile(r"[^\W\d_㐀-鿿]+(?:[-'’][^\W\d_㐀-鿿]+)*")
#: Most name parts that are sent to all tasks; more learned ones meet the texts by joins.
MOST_NAMES = 100_000
#: A learned part has at least so many places beside a known one, so many different partners, a share of its places there, and of those a share with a capital.
LEAST_PLACES, LEAST_PARTNERS, LEAST_SHARE, LEAST_CAPITALS = 2, 2, 0.3, 0.3

# Made family names: a start, a middle and an end.
_START = ("Ald", "Ber", "Bran", "Cal", "Cor", "Dal", "Edg", "El", "Fen", "Gar", "Had", "Hol", "Kel", "Lang", "Lin", "Mar", "Nor", "Os", "Pen", "Rav", "Sel", "Tor", "Ulm", "Wes")
_MIDDLE = ("a", "e", "en", "er", "in", "o", "or", "un")
_END = ("berg", "bury", "by", "dale", "feld", "ford", "ham", "hurst", "ley", "mann", "more", "stead", "stein", "ton", "wick", "worth")


def gender_of(given: str) -> str:
    """'f' or 'm'; of names in no table by their ending, which is a guess."""
    low = given.lower()
    if low in FEMALE or low in MALE:
        return "f" if low in FEMALE else "m"
    if low and "㐀" <= low[0] <= "鿿":
        return "f" if any(c in HAN_FEMALE for c in low) else "m"
    return "f" if low.endswith(("a", "e", "ie", "y")) else "m"


def made_given(gender: str, number: int) -> str:
    pool = FEMALE if gender == "f" else MALE
    return pool[number % len(pool)].capitalize()


def made_family(number: int) -> str:
    number, a = divmod(number, len(_START))
    number, b = divmod(number, len(_MIDDLE))
    number, c = divmod(number, len(_END))
    more = _MIDDLE[number % len(_MIDDLE)] + "l" if number % 3 == 0 else ""
    return _START[a] + _MIDDLE[b] + more + _END[c]


def made_han(family: int, given: int, gender: str, family_number: int, number: int) -> str:
    """A Chinese name of as many signs."""
    signs = HAN_FEMALE if gender == "f" else HAN_MALE
    out = "".join(HAN_FAMILY[(family_number + i) % len(HAN_FAMILY)] for i in range(family))
    for _ in range(given):
        number, at = divmod(number, len(signs))
        out += signs[at]
    return out


def _beside(text: str, given: frozenset[str], family: frozenset[str]) -> Iterator[tuple[str, str, bool, str]]:
    """(word, part it may be, written like a name, its known partner) of the unknown words beside known parts.

    Only the order given, family counts: a word before a comma may be a greeting.
    """
    words = [(m.group(), m.start(), m.end()) for m in WORD.finditer(text)]
    for (x, _, b), (y, c, _) in zip(words, words[1:], strict=False):
        if text[b:c] != " ":
            continue
        low, other = x.lower(), y.lower()
        if (low in given or low in family) == (other in given or other in family):
            continue
        if low in given:
            known, new, part = low, y, "family"
        elif other in family:
            known, new, part = other, x, "given"
        else:
            continue
        if len(new) > 2:
            yield new.lower(), part, new[0].isupper(), known


def learned_names(rows: DataFrame, given: Iterable[str], family: Iterable[str], text_col: str = "text") -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(given names, family names) that the lexicon lacks, in lower case."""
    found = learned_parts(rows, given, family, text_col)
    return _named((r["word"], r["part"]) for r in found.collect()) if isinstance(found, DataFrame) else found


def _named(parts: Iterable[tuple[str, str]]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    parts = sorted(parts)
    return tuple(w for w, p in parts if p == "given"), tuple(w for w, p in parts if p == "family")


def learned_parts(rows: DataFrame, given: Iterable[str], family: Iterable[str], text_col: str = "text") -> tuple[tuple[str, ...], tuple[str, ...]] | DataFrame:
    """(given names, family names) that the lexicon lacks, in lower case; of more than ``MOST_NAMES`` candidates a table of word and part.

    Those of a table are held against the counts of all words by a join, so that
    none is left out; it is computed where it is used and written nowhere.
    """
    known_given, known_family = frozenset(x.lower() for x in given), frozenset(x.lower() for x in family)
    if not known_given and not known_family:
        return (), ()
    texts = rows.where(F.col(text_col).isNotNull()).select(text_col)

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[str, str, str]] = Counter()
            capitals: Counter[tuple[str, str, str]] = Counter()
            for text in batch.column(0).to_pylist():
                words = {w.lower() for w in WORD.findall(text)}
                if known_given.isdisjoint(words) and known_family.isdisjoint(words):
                    continue
                for word, part, capital, partner in _beside(text, known_given, known_family):
                    seen[word, part, partner] += 1
                    capitals[word, part, partner] += capital
            if seen:
                word, part, partner = zip(*seen, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(part), pa.array(partner), pa.array(list(seen.values()), pa.int64()), pa.array([capitals[k] for k in seen], pa.int64())], names=["word", "part", "partner", "n", "capitals"])

    found = texts.mapInArrow(places, "word string, part string, partner string, n bigint, capitals bigint").groupBy("word", "part", "partner").agg(F.sum("n").alias("n"), F.sum("capitals").alias("capitals"))
    found = found.groupBy("word", "part").agg(F.sum("n").alias("n"), F.sum("capitals").alias("capitals"), F.count("*").alias("partners"))
    found = found.where(f"n >= {LEAST_PLACES} and partners >= {LEAST_PARTNERS} and capitals >= {LEAST_CAPITALS} * n")
    listed = found.select("word", "part", "n").limit(MOST_NAMES + 1).collect()
    if not listed:
        return (), ()
    wanted = frozenset(r["word"] for r in listed) if len(listed) <= MOST_NAMES else None

    def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(w for w in WORD.findall(text.lower()) if wanted is None or w in wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = texts.mapInArrow(totals, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("total"))
    if wanted is None:
        return found.join(counted, "word", "left").where(f"n >= {LEAST_SHARE} * coalesce(total, n)").select("word", "part")
    total = {r["word"]: r["total"] for r in counted.collect()}
    return _named((r["word"], r["part"]) for r in listed if r["n"] >= LEAST_SHARE * total.get(r["word"], r["n"]))
