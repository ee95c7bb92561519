import random

import numpy as np
import pytest

from quern.llm import leaks, spam

NOTE = "The planner said that the harbor ledger should be audited on Friday because the old index was too slow. We will move it to the new shelf before the summer, and the tutor keeps a copy of it for the team."
PAGES = {
    "note": NOTE, "alike": "\n".join(f"Monday: the ledger of team {i} had to rotate {i * 7} rows for the tester." for i in range(12)), "note with links": NOTE + " See also https://a.example/b/c and [this](https://x.test/y).",
    "settings": NOTE + "\n\n```yaml\nlimit: 40\nname: harbor\n```\n| a | b |\n|---|---|\n| 1 | 2 |", "tagged": NOTE + "\n#harbor #ledger", "zh note": "设计师说档案要在周五之前归档，因为旧的索引太慢了。我们会把它移到新的书架上，并由会计确认。导师也留了一份给大家看。",
}
SPAM = {
    "keywords": "buy agent plugin cheap memory skill " * 20, "links": "\n".join(f"https://www.site{i}.example/page/{i}" for i in range(20)), "list": "\n".join(f'<li><a href="http://s{i}.test/x">top plugin</a></li>' for i in range(15)),
    "tags": " ".join(f"#topic{i}" for i in range(40)), "products": "\n".join(f"cheap skill | SKU {900000 + i} | {i}.99 | calm, bold" for i in range(15)), "zh": "免费日程插件 便宜日志软件 下载模型工具 " * 15, "half": NOTE[:100] + "\n" + "best memory plugin now! top agent skill sale! " * 15,
}


def test_spam(spark):
    r = random.Random(3)
    words = NOTE.split()
    rows = [(i, " ".join(r.sample(words, len(words))) + ". " + NOTE, "en") for i in range(260)]
    kinds = {}
    for n, (name, text) in enumerate([*PAGES.items(), *SPAM.items()]):
        kinds[1000 + n] = name
        rows.append((1000 + n, text, "zh" if "zh" in name else ["en", None, "EN-x", "und"][n % 4]))
    rows += [(2000, None, "en"), (2001, "  \n", "en"), (2002, "", None), rows[-1]]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS links", "'x' AS grp")
    got = sorted(x.doc_id for x in spam.spam_pages(frame).collect())
    assert sorted(kinds[i] for i in got) == sorted(SPAM)
    assert spam.spam_pages(frame.where("false")).count() == 0


def test_repetition_alone_is_no_direction_of_spam():
    centre, spread = np.zeros(5), np.ones(5)
    x = np.array([[0, 0, 30, 0, 0], [9, 0, 0, 0, 0], [0, 9, 0, 0, 0], [0, 0, 4, 3, 0], [0, 0, 4, 1, 3], [0, 0, 0, -9, 0], [0, 0, 0, 2.5, 0]], dtype=float)
    far, out = spam.outlying(x, centre, spread, np.eye(5))
    assert out.tolist() == [False, True, True, True, True, False, False] and far[0] == 900


def _words(r, n):
    return [f"{r.choice('bcdfgk')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.choice('aeiou')}{r.randrange(60)}" for _ in range(n)]


def test_leaks(spark):
    r = random.Random(1)
    items = [(i, " ".join(_words(r, 40)), "en") for i in range(6)] + [(6, "".join(chr(0x4E00 + r.randrange(2000)) for _ in range(80)), "zh"), (7, None, "en"), (8, "too short", None)]
    docs, want = [], set()
    for i in range(120):
        words = _words(r, r.randint(0, 90))
        if i % 3 == 0:
            item = r.randrange(6)
            size = r.choice([12, 13, 14, 15, 30])
            start = r.randrange(40 - size)
            part = items[item][1].split()[start : start + size]
            if i % 2:
                part = [w.upper() + r.choice([",", "​", "\n> ", " -- "]) for w in part]
            at = r.randrange(len(words) + 1)
            words[at:at] = part
            if size >= 14:
                want.add((i, item))
        docs.append((i, " ".join(words)))
    zh = items[6][1]
    docs += [(500, "前文。" + "，".join(zh[10 + k : 14 + k] for k in range(0, 28, 4)) + "后文"), (501, "前文" + zh[:25] + "后"), (502, None), (503, ""), (500, None)]
    want.add((500, 6))
    docs = [x for x in docs if x != (500, None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'w' AS kind", "'zh' AS lang")
    out = leaks.leaks(frame, spark.createDataFrame(items, "item_id bigint, passage string, lang string"))
    got = {(x.doc_id, x.item_id): x.cosine for x in out.where("run").collect()}
    assert set(got) == want
    assert min(got.values()) > leaks.NEAR
    held = spark.createDataFrame(items, "item_id bigint, passage string, lang string")
    again = leaks.leaks(frame, held, items_at_once=2)  # the items in blocks give the same
    assert {(x.doc_id, x.item_id) for x in again.where("run").collect()} == want


def test_planted_paraphrases(spark):
    """Every ninth word of a passage is another one, so there is no run; other documents hold half of the words, shuffled."""
    r = random.Random(4)
    items = [(i, " ".join(_words(r, 45)), "en") for i in range(12)]
    docs, want = [], set()
    for i in range(240):
        words = _words(r, 60)
        if i % 4 == 0:
            part = items[i % 12][1].split()[:36]
            part[(i // 12) % 9 :: 9] = _words(r, 4)
            words[10:10] = part
            want.add((i, i % 12))
        elif i % 4 == 1:
            words += r.sample(items[i % 12][1].split(), 22)
        docs.append((i, " ".join(words)))
    out = leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string, lang string")).collect()
    got = {(x.doc_id, x.item_id) for x in out}
    assert not any(x.run for x in out) and got <= want and len(got) >= 0.7 * len(want)
    assert all(x.kept >= leaks.REWORDED and x.answered for x in out)


def test_common_subsequence():
    r = random.Random(9)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = {u: sum(1 << k for k, v in enumerate(b) if v == u) for u in set(b)}
        assert leaks.common_subsequence(a, masks, len(b)) == table[-1][-1]


def test_windows_hold_every_run():
    for kind in "wc":
        for n in range(leaks.RUN[kind], 120):
            own = leaks.item_windows(n, kind)
            assert len({b - a for a, b in own}) == 1
            assert all(any(a <= at and at + leaks.RUN[kind] <= b for a, b in own) for at in range(n - leaks.RUN[kind] + 1))


@pytest.mark.parametrize("which", ["documents", "items"])
def test_no_rows(spark, which):
    docs = spark.createDataFrame([(1, "some text " * 20)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "other words " * 20, "en")], "item_id bigint, passage string, lang string")
    assert leaks.leaks(docs.where("false") if which == "documents" else docs, items.where("false") if which == "items" else items).count() == 0
