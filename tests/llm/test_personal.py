import pytest

from quern.llm import personal as p

D = p.Detector(["Wenda", "Marek", "Odile"], ["Oakenshire", "Corbeault", "Tollander"])
YES = [
    ("Send it to marek.o@mailbox.example.", {"email"}), ("cc wenda+x[at]post[dot]karrow[dot]test please", {"email"}), ("Mail for odile24 at inbox dot lindmoor dot test", {"email"}), ("邮箱是a_b＠post.example，别写错。", {"email"}),
    ("Call me on 555-0185 after lunch.", {"phone"}), ("The office number is +33 1 99 00 59 30.", {"phone"}), ("电话：138 0013 8000", {"phone"}), ("WhatsApp 555－010－9999 (home)", {"phone"}), ("tel: (303) 555-0100", {"phone"}),
    ("My social security number is 927 93 3949.", {"id_number"}), ("passport no. ZQ 78 84 80 C", {"id_number"}), ("身份证号是11010519491231002X。", {"id_number"}), ("Tax ID: M11228915", {"id_number"}),
    ("I moved to 151 millrace lane in Saint Averil last spring.", {"address"}), ("Address: Brunnenstraße 23, 00859 Mirrowby", {"address"}), ("我住在白鹭县银杏路191号1单元508室，去年搬的。", {"address"}), ("我住在12 Wren Way", {"address"}),
    ("Spoke with MAREK OAKENSHIRE this morning.", {"name"}), ("Ask Oakenshire, Wenda for the key.", {"name"}), ("The contract names odile tollander as the tenant.", {"name"}), ("with O. Corbeault there", {"name"}), ("房东叫Wenda B. Corbeault。", {"name"}), ("Signed, Marek Pinderveld", {"name"}),
    ("Her colleague Priya Raman left", {"name"}), ("Dear Mrs. Anna Johnson, hello", {"name"}), ("My name is Zadie Okafor.", {"name"}), ("张伟昨天来了", {"name"}), ("我叫李小红。", {"name"}), ("请联系Wenda Corbeault。", {"name"}), ("打020 7946 0845。", {"phone"}),
]
NO = [
    "Run ssh deploy@zelongar and look at port 5961.", "ping @wenda and @marek.", "The Corbeault roster and the Odile checklist share 9927 rows.", "Marek mode is on for baza, see a/b.json.", "Read section 10 lane 19 of the itinerary.",
    "Street view of the beacon map is at zoom 26.", "Set timeout=86400000 now.", "Order paid on 2024-113-220.", "with build 2025.10.11.1234 of it", "Id horenmond-9999-99 maps to row 1592.", "Ticket RUN-75224 asks to pin it until October 14.", "", "Remind me to ask the courier about it.",
]


@pytest.mark.parametrize(("text", "kinds"), YES)
def test_found(text, kinds):
    assert {k for k, _, _ in D.find(text)} == kinds


@pytest.mark.parametrize("text", NO)
def test_left_alone(text):
    assert D.find(text) == []


BRACKETED = [f"{a}{x}{w}{x}{b}" for a, b in ("[]", "()", "{}", "<>") for x in ("", " ") for w in ("at", "AT")]
AT = ["@", " @ ", "＠", "&#64;", "%40", " _at_ ", "\t_at_", *BRACKETED, *(f" {m} " for m in BRACKETED)]


@pytest.mark.parametrize("dot", [".", "[dot]", " (dot) ", " { dot } ", " <dot> ", " _dot_ "])
@pytest.mark.parametrize("at", AT)
def test_every_spelling_of_the_pattern(at, dot):
    text = f"Write to jane{at}host{dot}org soon"
    assert p.EMAIL.search(text.translate(p.PLAIN)) and [k for k, _, _ in D.find(text)] == ["email"]


@pytest.mark.parametrize("blank", [" ", "\t", "\n"])
def test_spoken_spelling(blank):
    text = f"Write to jane{blank}at{blank}host{blank}dot{blank}org"
    assert p.EMAIL.search(text) and [k for k, _, _ in D.find(text)] == ["email"]


KEY = b"a key for tests"
GIVEN, FAMILY = frozenset(("marek", "wenda")), frozenset(("oakenshire",))


def made(kind, value, draw=0):
    return p.render(kind, p.form_of(kind, value, GIVEN, FAMILY), KEY, p.token(KEY, kind, value), draw)


def shape(text):
    return "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in text)


@pytest.mark.parametrize(("kind", "value"), [("phone", "(303) 555-0100"), ("id_number", "ZQ 78 84 80 C"), ("id_number", "927-93-3949"), ("email", "Marek.o+x@mail.example"), ("phone", "06 39 98 04 87")])
def test_surrogates_keep_the_format(kind, value):
    assert shape(made(kind, value)) == shape(value) and made(kind, value) != value and made(kind, value) == made(kind, value) != made(kind, value, 1)


def test_surrogates_of_names():
    first = made("name", "Marek Oakenshire").split()
    assert made("name", "Oakenshire, Marek") == f"{first[1]}, {first[0]}" and made("name", "oakenshire marek") == f"{first[1]} {first[0]}".lower()
    assert made("name", "MAREK OAKENSHIRE") == " ".join(first).upper() and first[0].lower() in p.nm.MALE
    assert made("name", "Wenda Oakenshire").split()[0].lower() in p.nm.FEMALE
    initial = made("name", "W. Oakenshire")
    assert shape(initial)[:4] == "A. A" and len(made("name", "王娜")) == 2 and made("name", "王娜")[1] in p.nm.HAN_FEMALE and made("name", "王娜")[0] in p.nm.HAN_FAMILY


def test_surrogates_of_places_and_residents():
    street = made("address", "12 North Wren Lane")
    assert street.split()[1] == "North" and street.endswith(" Lane") and "Wren" not in street
    assert made("address", "白鹭区银杏路191号")[2] == "区" and "路" in made("address", "白鹭区银杏路191号") and made("address", "Brunnenstraße 23").split()[0].endswith("straße")
    new = made("id_number", "11010519491231002X")
    assert len(new) == 18 and "10X98765432"[sum(int(c) * 2 ** (17 - i) for i, c in enumerate(new[:17])) % 11] == new[17]
    assert made("email", "a.b at host dot org").count(" at ") == 1
    assert p.token(KEY, "email", "A@b.example") == p.token(KEY, "email", "a[at]b[dot]example") != p.token(b"other", "email", "a@b.example")


def lexicon(spark, *rows):
    return spark.createDataFrame(rows, "name string, part_of_name string")


@pytest.mark.parametrize("style", ["placeholder", "surrogate"])
def test_redaction(spark, style):
    rows = [("memory", f"m{i}", f"Call me on 55{i}-0{100 + i} now", "x") for i in range(9)] + [("message", "1", "Signed, Marek Corbeault. 再见 wenda@a.example", "x"), ("memory", "n", None, None), ("memory", "e", "", None)]
    frame = spark.createDataFrame(rows, "src string, rec_id string, text string, kind string")
    out = {(r.src, r.rec_id): r.text for r in p.redacted(frame, lexicon(spark, ("Marek", "given"), ("Corbeault", "family"), (None, "given")), KEY, style).collect()}
    assert len(out) == 10 and "Corbeault" not in out["message", "1"] and "wenda@" not in out["message", "1"] and "再见 " in out["message", "1"] and out["memory", "m0"].endswith(" now")
    assert ("[EMAIL_" in out["message", "1"]) == (style == "placeholder")
    assert len({v for k, v in out.items() if k[0] == "memory"}) == 9


def test_collisions_and_what_stays_open(spark):
    # ten values for ten entities that are all of them: no draw is free of the corpus, so all become placeholders
    found = spark.createDataFrame([("phone", p.token(KEY, "phone", str(i)), p.DIGIT) for i in range(10)], "kind string, entity string, form string")
    assert {r.draw for r in p.assign_draws(found, KEY, "surrogate", most_draws=3).collect()} == {-1}
    # 40 of 100 values: no two agree and none is one of the corpus
    found = spark.createDataFrame([("phone", p.token(KEY, "phone", f"{i:02d}"), p.DIGIT * 2) for i in range(40)], "kind string, entity string, form string")
    given = [p.render("phone", p.DIGIT * 2, KEY, r.entity, r.draw) for r in p.assign_draws(found, KEY, "surrogate", most_draws=30).collect() if r.draw >= 0]
    assert len(given) == len(set(given)) > 30 and min(map(int, given)) >= 40


def test_names_are_learned_from_their_places(spark):
    texts = ["met Marek Halberyn", "and Wenda Halberyn there", "a Halberyn", "Marek mode is on", "Wenda mode", "the Corbeault file", "the Corbeault", "Signed, Marek", "Signed, Wenda", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert p.nm.learned_names(rows, ["Marek", "Wenda"], ["Corbeault"]) == ((), ("halberyn",))
    assert p.nm.learned_names(rows, [], []) == ((), ())


def test_more_learned_names_than_are_sent_to_all_tasks(spark, monkeypatch):
    """Not one is left out: they meet the texts by joins, with the same finds and surrogates."""
    learned = ["halberyn", "tollander", "corbeauld", "quillmere"]
    texts = [f"met {g} {f.capitalize()} there" for f in learned for g in ("Marek", "Wenda")] + [f"wrote to {g} {f}" for f in learned for g in ("wenda", "marek")] + ["Ｍarek Tollander said", "Tom Quillmere", "Halberyn, Marek", None, ""]
    rows = spark.createDataFrame([("memory", str(i), t) for i, t in enumerate(texts + texts[:3])], "src string, rec_id string, text string")
    lexicon = spark.createDataFrame([("Marek", "given"), ("Wenda", "given")], "name string, part_of_name string")
    found = lambda: sorted(tuple(r) for r in p.spans(rows, p._detector(rows, lexicon), KEY).collect())
    edited = lambda: sorted((r.rec_id, r.text) for r in p.redacted(rows, lexicon, KEY, "surrogate").collect())
    want, text = found(), edited()
    assert p.nm.learned_names(rows, ["Marek", "Wenda"], []) == ((), tuple(sorted(learned))) and {str(i) for i in range(16)} <= {x[1] for x in want}
    monkeypatch.setattr(p.nm, "MOST_NAMES", 1)
    assert p.nm.learned_names(rows, ["Marek", "Wenda"], []) == ((), tuple(sorted(learned)))
    assert found() == want and edited() == text


def test_empty(spark):
    empty = spark.createDataFrame([], "src string, rec_id string, text string")
    assert p.spans(empty, ((), ())).count() == 0
    assert p.redacted(empty, spark.createDataFrame([], "name string, part_of_name string"), KEY).count() == 0
