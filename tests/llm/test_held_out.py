"""Personal data in sentences written by hand, apart from the test tables: precision and recall by kind and language."""

from collections import defaultdict

import pytest

from quern.llm import personal as p

D = p.Detector(["Marta", "Jonas"], ["Halloway", "Brandt"])
# (language, text, kinds that it holds)
CASES = [
    ("en", "You can reach Marta Halloway at marta.halloway@firm.example or +44 20 7946 0958.", {"name", "email", "phone"}), ("en", "Dr. Helen Baker will see you on Tuesday.", {"name"}), ("en", "Halloway, Marta signed it first.", {"name"}),
    ("en", "Send post to 14 Elm Street, third floor.", {"address"}), ("en", "SSN: 912-33-4821, do not share.", {"id_number"}), ("en", "Contact first dot last at firm dot example.", {"email"}), ("en", "My cell is 415-555-0137, after six.", {"phone"}),
    ("en", "Passport number X1234567 expires in May.", {"id_number"}), ("en", "the parcel went to 220 Old Mill Road", {"address"}), ("en", "J. Brandt wrote the memo.", {"name"}), ("en", "text me: (212) 555-0188", {"phone"}), ("en", "michael thompson asked twice", {"name"}),
    ("en", "Version 2.14.7 of build 20251011 failed on row 5550123.", set()), ("en", "The street lights on the avenue are out.", set()), ("en", "Order 912-33-482 shipped from Java and Spark Street markets", set()), ("en", "ssh root@build-7 and check the log", set()),
    ("en", "Brandt is a good name for a product.", set()), ("en", "Ping @marta and @jonas later.", set()), ("en", "It took 14 long days on the road.", set()), ("en", "Ask Apache Kafka or Google Cloud.", set()), ("en", "Commit 9f2c1d0a fixed ticket OPS-2231.", set()),
    ("de", "Frau Katharina Vogel wohnt in der Lindenstraße 12.", {"name", "address"}), ("de", "Schreib an jonas.brandt@post.example, bitte.", {"email"}), ("de", "Telefon: 030 9018 2076", {"phone"}), ("de", "Personalausweis L01X00T47 liegt bei.", {"id_number"}), ("de", "Jonas Brandt ruft zurück.", {"name"}),
    ("de", "Steuer-ID: 12345678903", {"id_number"}), ("de", "Die Straße war 12 Stunden gesperrt.", set()), ("de", "Am Montag kommen 30 Gäste.", set()), ("de", "Zeile 12 der Tabelle ist leer.", set()),
    ("zh", "请联系李娜女士，电话：139 1234 5678。", {"name", "phone"}), ("zh", "我叫王伟，住在朝阳区建国路88号。", {"name", "address"}), ("zh", "身份证号：110101199003074530", {"id_number"}), ("zh", "邮箱是 wang_wei@mail.example", {"email"}), ("zh", "张强说会议改期。", {"name"}),
    ("zh", "预算是1391234，周三再议。", set()), ("zh", "高明的办法不多，文明城市建设。", set()), ("zh", "第12号线今天停运。", set()), ("zh", "王国的历史很长。", set()),
]


def counted():
    """(true, found, both) by kind and by language."""
    by = defaultdict(lambda: [0, 0, 0])
    for lang, text, true in CASES:
        got = {k for k, _, _ in D.find(text)}
        for kind in true | got:
            for key in (kind, lang, "all"):
                by[key][0] += kind in true
                by[key][1] += kind in got
                by[key][2] += kind in true and kind in got
    return by


@pytest.mark.parametrize("key", [*p.KINDS, "en", "de", "zh", "all"])
def test_precision_and_recall(key):
    true, found, both = counted()[key]
    assert both >= 0.7 * true and both >= 0.85 * found, (true, found, both, [(t, w, {k for k, _, _ in D.find(t)}) for _, t, w in CASES if {k for k, _, _ in D.find(t)} != w])
