"""Column functions on hand-made rows."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from tarnwell.functions import html as ht
from tarnwell.functions import jsonops as js
from tarnwell.functions import phones as ph
from tarnwell.functions import text as tx
from tarnwell.functions import vectors as vx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def lit_list(*items):
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


@pytest.mark.parametrize(
    "raw, want",
    [("Wi‑Fi – Scenario 3", "Wi-Fi - Scenario 3"), ("a​b", "ab"), ("  x \t y ", "x y"), (None, "")],
)
def test_title(spark, raw, want):
    assert one(spark, tx.normalize_title(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    "number, name, want",
    [("kb 12", "x", "KB12"), (None, "KB-0420_Title.pdf", "KB0420"), ("ab1", "KB1003 Title", "KB1003"), ("KB", "none", "SRC:7"), (None, "KB-0064-x", "SRC:7")],
)
def test_doc_key(spark, number, name, want):
    assert one(spark, tx.doc_key(F.lit(number).cast("string"), F.lit(name), F.lit("7"))) == want


def test_clean_content(spark):
    body = "A  b\r\n\r\n\r\n\r\nOriginal URL: http://x Click or tap if you trust this link.\n data:image/png;base64,QUJD end " + "Q" * 250
    assert one(spark, tx.clean_content(F.lit(body))) == "A b\n\n[IMAGE_REMOVED] end [ENCODED_CONTENT_REMOVED]"


def test_phrases_keep_first_spelling_and_cap(spark):
    items = lit_list(" Outlook, ", "outlook", "--", "VPN  client", "x")
    assert one(spark, tx.clean_phrase_list(items, 2)) == ["Outlook", "VPN client"]
    assert one(spark, tx.distinct_ignoring_case(lit_list("B", "a", "b", " ", "A"))) == ["B", "a"]


@pytest.mark.parametrize("term, want", [("EndNote 21", True), ("VPN", True), ("Microsoft teams", True), ("Outlook", False), ("printer", False), ("Étude alpha", True)])
def test_looks_specific(spark, term, want):
    assert one(spark, tx.looks_specific(F.lit(term))) is want


def test_generic_terms(spark):
    assert one(spark, tx.query_generic_terms(lit_list("help", "My printer issue", "the Printer"))) == ["printer"]
    assert one(spark, tx.index_generic_terms(lit_list("Wi-Fi!", "x", "Accès réseau", "wi-fi"))) == ["wi-fi", "accès réseau"]


def test_search_phrases(spark):
    got = one(spark, tx.derive_search_phrases(F.lit("install EndNote"), lit_list("EndNote"), lit_list("setup", "license", "x"), lit_list("crash"), lit_list("install endnote")))
    assert got == ["install EndNote", "EndNote setup", "EndNote license", "crash"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.text(alphabet="aAbB -,;", max_size=6), max_size=8))
def test_phrase_list_is_an_ordered_subset(spark, items):
    got = one(spark, tx.clean_phrase_list(lit_list(*items), 4))
    cleaned = [" ".join(i.split()).strip(" ,;:-") for i in items]
    assert len(got) <= 4 and len({g.lower() for g in got}) == len(got)
    positions = [cleaned.index(g) for g in got]
    assert positions == sorted(positions)


def test_phones(spark):
    assert one(spark, ph.to_e164(F.lit(" +4670 "))) == "+4670"
    assert one(spark, ph.to_e164(F.lit("+46-70"))) is None
    assert one(spark, ph.transfer_destination(F.lit("tel:+14155550123"))) == "tel:+14155550123"
    assert one(spark, ph.image_tag(F.lit("host:5000/app"))) is None
    assert one(spark, ph.image_tag(F.lit("host:5000/app:1.2"))) == "1.2"
    assert one(spark, ph.worker_slug(F.lit("My Agent__1 "))) == "agent-worker-my-agent-1"
    assert one(spark, ph.room_call_id(F.lit("call_+1"))) == ""


@pytest.mark.parametrize("text, want", [('{"a":1}', True), ('{"a":1}}', False), ('{"a":1}]', False), ("1,2", False), ("", False), (None, False), ("[1]", True)])
def test_is_json(spark, text, want):
    assert one(spark, js.is_json(F.lit(text).cast("string"))) is want


def test_json_merge(spark):
    merge = lambda a, b: one(spark, js.json_merge(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert merge('{"a":1,"b":{"x":1}}', '{"b":{"y":2},"c":"t"}') == '{"a":1,"b":{"y":2},"c":"t"}'
    assert merge(None, '{"a":1}') == '{"a":1}' and merge('{"a":1}', None) == '{"a":1}'
    x, y, z = '{"a":1}', '{"a":2,"b":1}', '{"b":3}'
    assert merge(merge(x, y), z) == merge(x, merge(y, z))


def test_parse_items(spark):
    got = one(spark, js.parse_items(F.lit('{"items":[{"item":" Okta  SSO ","purpose":null},{"item":" "},3],"result":[{"name":"Jamf"}]}')))
    assert got["status"] == "success" and [i["item"] for i in got["items"]] == ["Okta SSO", "Jamf"]
    assert one(spark, js.parse_items(F.lit("nope")))["status"] == "invalid_json"
    assert one(spark, js.parse_items(F.lit("3")))["status"] == "invalid_schema"


def test_numeric_totals(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":[1,{"c":2.5}]},"t":true,"s":"x","n":null}'), (1, '{"a":{"b":[4]}}')], "k int, j string")
    got = {r["path"]: r["total"] for r in js.numeric_totals(df, ["k"], "j").collect()}
    assert got == {"a.b[0]": 5.0, "a.b[1].c": 2.5}


def test_confidence(spark):
    # 0.45*0.5 + 0.25*1 + 0.15*(1/1.5) + 0.15*1 + 0.08
    alone = vx.confidence_value(F.lit(1.0), F.lit(0.0), F.lit(3), F.lit(True), F.lit(True))
    assert one(spark, alone) == pytest.approx(0.225 + 0.25 + 0.1 + 0.15 + 0.08)
    assert one(spark, vx.confidence_label(F.lit(0.0))) == "none"
    nothing = vx.confidence_value(F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(False), F.lit(False))
    assert one(spark, nothing) == pytest.approx(0.0)


def test_html_text_and_images():
    page = "<html><head><title>T</title></head><body><script>x</script><h1>A &amp; b</h1><p>one<br>two<ul><li>x<li>y</ul><img src='/i.png' alt='pic'></body></html>"
    text, images = ht.read_page(page, {0: "[Image: pic]"})
    assert text == "A & b\none\ntwo\n* x\n* y\n[Image: pic]"
    assert images == [{"src": "/i.png", "alt": "pic"}]
    assert ht.resolve("/i.png", "http://h/a/b") == "http://h/i.png" and ht.resolve("i.png", None) is None


def test_best_place_is_that_of_all_ratios_with_few_of_them(monkeypatch):
    import random

    from tarnwell.functions import fuzzy

    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcde İE") for _ in range(rng.randint(0, n)))
    ratio, seen, offered = fuzzy.ratio, [], 0
    for _ in range(120):
        asked, texts = text(60), [text(250) for _ in range(rng.randint(0, 8))]
        texts += texts[:2]
        overlaps = [rng.choice([0.0, 0.1, 1 / 3]) for _ in texts]
        want = max(((0.7 * o + 0.3 * ratio(asked, t), -i) for i, (t, o) in enumerate(zip(texts, overlaps))), default=(0, None))[1]
        with monkeypatch.context() as m:
            m.setattr(fuzzy, "ratio", lambda a, b: seen.append(1) or ratio(a, b))
            assert fuzzy.best_place(asked, texts, overlaps) == (None if want is None else -want)
        offered += len(texts)
    assert len(seen) < offered * 0.7


def test_letters_are_counted_only_where_lengths_leave_a_text_open(monkeypatch):
    from tarnwell.functions import fuzzy

    counted, counter = [], fuzzy.Counter
    monkeypatch.setattr(fuzzy, "Counter", lambda text: counted.append(text) or counter(text))
    assert fuzzy.best_place("ab", ["b" * 50], [0.0]) == 0 and not counted
    assert fuzzy.best_place("abc", ["x" * 300] * 40 + ["abc"] + ["y" * 300] * 40, [0.0] * 40 + [1.0] + [0.0] * 40) == 40
    assert len(counted) <= 2


def test_alike_letters_are_those_of_difflib_and_a_text_is_placed_once(monkeypatch):
    import difflib
    import random

    from tarnwell.functions import fuzzy

    rng = random.Random(5)
    for _ in range(1500):
        letters = rng.choice(["ab", "abc ", "abcdefghij  klmnop", "etaoin shrdlu cmfwyp"])
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(6)]
        a, b = (" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 30, 60]))) for _ in range(2))
        assert fuzzy.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio(), (a, b)
    assert fuzzy.ratio("x", "y") == 0 and fuzzy.ratio("same", "same") == 1 and fuzzy.ratio("", "y") == fuzzy.ratio(None, "y") == 0
    # A passage that is compared with many questions is read once for all of them.
    fuzzy._places.cache_clear()
    for k in range(20):
        fuzzy.best_place(f"question {k}", ["one passage", "another passage"], [0.0, 0.0])
    assert fuzzy._places.cache_info().misses == 2
