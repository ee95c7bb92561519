import itertools
import random
import re

import pytest

from quern.llm import neardup as n


def brute(rows):
    sets = {}
    for src, i, text in rows:
        words = set(re.findall(r"[一-鿿]|[a-z0-9]+", (text or "").lower()))
        if i is not None and len(words) >= 8:
            sets[src, i] = words
    out = set()
    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        if a[0] == b[0] and 10 * len(x & y) >= 7 * len(x | y):
            out.add((a[0], a[1], b[1]))
    return out


def corpus(seed=1, size=160, vocabulary=60):
    r = random.Random(seed)
    rows = []
    for i in range(size):
        if rows and r.random() < 0.5:
            words = r.choice(rows)[2].split()
            for _ in range(r.randint(0, 5)):
                words[r.randrange(len(words))] = f"w{r.randrange(vocabulary)}"
            r.shuffle(words)
        else:
            words = [f"w{int(r.paretovariate(1)) % vocabulary}" if r.random() < 0.5 else f"w{r.randrange(vocabulary)}" for _ in range(r.randint(5, 40))]
        rows.append((r.choice(["memory", "candidate"]), f"id{i:04d}", " ".join(words)))
    return [*rows, ("memory", "n1", None), ("memory", "n2", ""), ("memory", None, "a b c d e f g h i"), rows[0], ("memory", "z1", "你好世界我们今天去看山水"), ("memory", "z2", "你好，世界！我们今天去看山水吧")]


@pytest.mark.parametrize("most", [8192, 12, 3])
def test_all_pairs_at_every_depth(spark, most):
    rows = corpus()
    got = [tuple(r) for r in n.similar_pairs(spark.createDataFrame(rows, "src string, id string, text string"), most_meeting=most).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_many_copies_are_linked_to_the_first(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [("memory", f"c{i:03d}", text) for i in range(30)] + [("memory", "other", text + " eleven")]
    got = {tuple(r)[1:] for r in n.similar_pairs(spark.createDataFrame(rows, "src string, id string, text string"), most_copies=10).collect()}
    assert got == {("c000", f"c{i:03d}") for i in range(1, 30)} | {("c000", "other")}


@pytest.mark.parametrize("words", [17_000, 20_000, 40_000])
def test_very_long_texts(spark, words):
    """Longer than 16 bits hold: sizes of one text and of two together."""
    text = lambda own, differing: " ".join(f"w{i}" if i >= differing else f"{own}{i}" for i in range(words))
    rows = [("memory", "a", text("x", 0)), ("memory", "b", text("y", words // 10)), ("memory", "c", text("z", words // 2)), ("memory", "d", text("q", words))]
    got = {tuple(r) for r in n.similar_pairs(spark.createDataFrame(rows, "src string, id string, text string")).collect()}
    assert got == brute(rows) == {("memory", "a", "b")}


def test_empty(spark):
    assert n.similar_pairs(spark.createDataFrame([], "src string, id string, text string")).count() == 0
