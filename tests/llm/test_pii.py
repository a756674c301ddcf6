import pytest

from chronoweave.llm import pii

LEXICON = [("Amara", "given"), ("Victor", "given"), ("Jonas", "given"), ("Rusvgale", "family"), ("Okonquist", "family"), (None, "given")]
# The text and what is to be found, as (substring, kind).
CASES = [
    ("mail amara.rusvgale+git@example.com now", [("amara.rusvgale+git@example.com", "email")]),
    ("amara [at] mail dot example dot org.", [("amara [at] mail dot example dot org", "email")]),
    ("x <kelm(at)uni-tarn.example> kelm%40corvid.invalid qed&#64;example.net", [("kelm(at)uni-tarn.example", "email"), ("kelm%40corvid.invalid", "email"), ("qed&#64;example.net", "email")]),
    ("git@forge.example:weight/signal.git store://kelm:pw@db1.internal.example:5401/x ${user}@${domain} <user>@<host> tile@2x.png pin a@^1.2.3 x@{upstream}", []),
    ("call +44 (0)1632 960 461 or (770) 555-0104, 020 7946 0292, 01 99 00 71 52, 00 49 (0)30-23125-835", [("+44 (0)1632 960 461", "phone"), ("(770) 555-0104", "phone"), ("020 7946 0292", "phone"), ("01 99 00 71 52", "phone"), ("00 49 (0)30-23125-835", "phone")]),
    ("build 2024.555.7308 isbn 000-0-4938-7119-0 order number 00 314 3667 rev 21.19.41.90 mm/dd 01-14-2066 epoch 1662099076236 ms", []),
    ('ssn 666-47-9375 fails, "nino": "QQ236936C", tax id of the test account: 00 212 910 333, dni titular=12117824E', [("666-47-9375", "id_number"), ("QQ236936C", "id_number"), ("00 212 910 333", "id_number"), ("12117824E", "id_number")]),
    ("see invoice 666-45-1459, part no. 666-47-8824, sku 000-25-6902", []),
    ("Office: 426 Larkspur Street, Apt 18, Port Hallow / tel.", [("426 Larkspur Street, Apt 18, Port Hallow", "address")]),
    ("samples go to Mühlenstraße 170a, 00628 Lower Tarn", [("Mühlenstraße 170a, 00628 Lower Tarn", "address")]),
    ("to 63, rue des Tilleuls, 00181 Ashwick", [("63, rue des Tilleuls, 00181 Ashwick", "address")]),
    ("// returns go to:\n//   181 Larkspur Avenue\n//   Brindle Falls 00903\n", [("181 Larkspur Avenue\n//   Brindle Falls 00903", "address")]),
    ("// C/ Molino Viejo 410, 00868 Grimsvale", [("C/ Molino Viejo 410, 00868 Grimsvale", "address")]),
    ("see Brindle Falls 00903 in the atlas", []),
]
SPACED = [
    ("ssn of the test account: 000 45 3757\n", [("000 45 3757", "id_number")]), ("// soc. sec. number 000 03 2085", [("000 03 2085", "id_number")]), ('"social security no.": "954 23 3339"', [("954 23 3339", "id_number")]),
    ("ssn 000-45 3757, ssn 000 45-3757", []), ("sku 000 25 6902, see 000 25 6902", []),
]
ONE_CASE = [
    ("// 57 MILL POND STREET / tel.", ["57 MILL POND STREET"]), ('"ship_to": "252 LARKSPUR ROAD, LOWER TARN 00786", "label"', ["252 LARKSPUR ROAD, LOWER TARN 00786"]),
    ("381 COPPERBEECH AVE., UNIT 36, GRIMSVALE, QX 00138;", ["381 COPPERBEECH AVE., UNIT 36, GRIMSVALE, QX 00138"]), ("AT 12B BEACON HILL AVENUE\n// AUTHOR: X", ["12B BEACON HILL AVENUE"]),
    ("wohnhaft: 123 third lane\n# erreichbar unter", ["123 third lane"]), ("# 97 larkspur lane\n#  ostermoor, qx 00887\nor", ["97 larkspur lane\n#  ostermoor, qx 00887"]),
    ("at 6 old quarry court #6 / tel.", ["6 old quarry court #6"]), ("at 41 copperbeech road, apt 3, port hallow.", ["41 copperbeech road, apt 3, port hallow"]),
    ("10 items per row, 3 steps in this place, a 20 minute walk, 2 grid square sizes, hashring 9, STRING 5", []),
    ("63, RUE DES TILLEULS, 00181 ASHWICK; 63, rue des tilleuls, 00181 ashwick", ["63, RUE DES TILLEULS, 00181 ASHWICK", "63, rue des tilleuls, 00181 ashwick"]),
    ("MÜHLENSTRASSE 170A, 00628 LOWER TARN; mühlenstraße 170a", ["MÜHLENSTRASSE 170A, 00628 LOWER TARN", "mühlenstraße 170a"]), ("CALLE MOLINO VIEJO 410; calle molino viejo 410", ["CALLE MOLINO VIEJO 410", "calle molino viejo 410"]),
]
NAMES = [
    ("// Author: Amara Rusvgale", ["Amara Rusvgale"]), ("Thanks to Jonas L. von Okonquist.", ["Jonas L. von Okonquist"]), ("| Rusvgale-Okonquist, Amara | x", ["Rusvgale-Okonquist, Amara"]), ("// @author McRusvgale, Amara <x>", ["McRusvgale, Amara"]), ("AUTHOR: VICTOR O'RUSVGALE", ["VICTOR O'RUSVGALE"]),
    ("@author jonas rusvgale", ["jonas rusvgale"]), ("- A. Rusvgale (x)", ["A. Rusvgale"]), ("('Amara Rusvgale', 1)", ["Amara Rusvgale"]), ("Rusvgale & Okonquist Ltd.", []), ("press Victor Marker to go on", []), ("Dr. Rusvgale wants it", []),
    ("reported by Viggo Rusvgale", ["Viggo Rusvgale"]), ("ask Amara Zabladze", ["Amara Zabladze"]), ("merci à Viggo Zabladze", ["Viggo Zabladze"]), ("amara.rusvgale@example.com", []),
]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "part_text string, part_kind string")


def direct(text):
    """What is found of the kinds other than names, with the corpus saying nothing: self-telling forms and labelled candidates."""
    return [(text[c.start : c.end], c.kind) for c in sorted(pii.find_direct(text)) if c.kind != "number" and (c.told > 0 or c.sure and c.told == 0)]


def test_direct_finds():
    for text, want in CASES:
        assert direct(text) == want, text


def test_addresses_of_one_case():
    for text, want in ONE_CASE:
        assert [x for x, k in direct(text) if k == "address"] == want, text


def test_social_security_numbers_with_spaces():
    for text, want in SPACED:
        assert direct(text) == want, text


def test_names_by_corpus_statistics(spark, lexicon):
    noise = ["the marker moved and marker = marker.next marker marker"] * 5
    rows = [(i, t, i) for i, (t, _) in enumerate(NAMES)] + [(1000 + i, t, 0) for i, t in enumerate(noise)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start_pos int")
    got = {}
    for r in pii.found(docs, lexicon).collect():
        if r.kind == "name":
            got.setdefault(r.doc_id, []).append(r.start_pos)
    assert got == {i: [t.index(n) + 1 for n in names] for i, (t, names) in enumerate(NAMES) if names}


def test_placeholders_keep_the_rest(spark, lexicon):
    text = "🚀 Amara Rusvgale <amara@example.com>, tel. +44 20 7946 0841\r\nend́"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "plain"), (None, "Amara Rusvgale"), (5, text + " x" * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(docs, lexicon).collect()}
    assert got[1] == "🚀 [NAME] <[EMAIL]>, tel. [PHONE]\r\nend́"
    assert got[2] is None and got[3] == "" and got[4] == "plain" and got[None] == "[NAME]" and got[5].endswith(" x") and "[NAME]" in got[5]


def test_null_and_repeated_ids(spark, lexicon):
    texts = ["write to amara@example.com", "nothing stands in here at all", "write to amara@example.com", "call +44 20 7946 0841"]
    docs = spark.createDataFrame([(None, texts[0]), (1, texts[1]), (1, texts[2]), (1, texts[2]), (None, texts[3])], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text, r.n_found) for r in pii.sanitise(docs, lexicon).collect())
    assert got == [(0, "call [PHONE]", 1), (0, "write to [EMAIL]", 1), (1, texts[1], 0), (1, "write to [EMAIL]", 1), (1, "write to [EMAIL]", 1)]


OPEN = [
    ("phone: 9876543210", "9876543210", "phone"), ("tel. 03-1234-5678", "03-1234-5678", "phone"), ("Phone (02) 9876 5432", "(02) 9876 5432", "phone"), ("CPF 123.456.789-09", "123.456.789-09", "id_number"),
    ("Aadhaar 2345 6789 0123", "2345 6789 0123", "id_number"), ("NHS number 943 476 5919", "943 476 5919", "id_number"), ("abita in via Roma 12", "via Roma 12", "address"), ("via Roma 12, 00184 Tarn", "via Roma 12, 00184 Tarn", "address"), ("ul. Marszałkowska 10", "ul. Marszałkowska 10", "address"),
]


def test_open_forms_beside_labels():
    for text, value, kind in OPEN:
        assert (value, kind) in direct(text), text
    for text in ("sku 9876543210", "isbn 03-1234-5678", "sent via Port 80", "via TLS 1", "x = 9876543210", "order number: 123.456.789-09"):
        assert direct(text) == [], text


def test_corpus_decides_on_open_forms(spark, lexicon):
    """A word that self-telling phones follow discloses open numbers after it, a word that all sorts of numbers follow doesn't; so do digits known from a label."""
    rows = [f"durchwahl +44 20 7946 {1000 + i}" for i in range(25)] + [f"count {10_000_000 + i}" for i in range(25)] + ["durchwahl 9876543210", "count 9876543211", "CPF 123.456.789-09", "then 123.456.789-09 again", "then 123.456.789-10 again"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(r.doc_id, r.start_pos, r.kind) for r in pii.found(docs, lexicon).collect() if r.doc_id >= 25}
    assert got == {(50, 11, "phone"), (52, 5, "id_number"), (53, 6, "id_number")}


def test_nothing_is_cut_by_windows(spark, lexicon):
    long = "a" * 90 + "@example.com"
    assert direct(f"mail {long}") == [(long, "email")]
    street = "12 " + " ".join(["Copperbeechandlarkspurwood"] * 3) + " Street"
    assert (street, "address") in direct(f"at {street}, then")
    docs = spark.createDataFrame([(1, "Author: Amara Rusvgale-" + "Zab" + "l" * 40)], "doc_id long, text string")
    assert [(r.start_pos, r.kind) for r in pii.found(docs, lexicon).collect()] == [(9, "name")]
    assert pii.sanitise(docs, lexicon).first().text == "Author: [NAME]"


def test_empty(spark, lexicon):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.found(docs, lexicon).count() == 0 and pii.sanitise(docs, lexicon).count() == 0
    one = spark.createDataFrame([(1, "Amara Rusvgale a@example.com")] * 2, "doc_id long, text string")
    assert [r.kind for r in pii.found(one, lexicon.limit(0)).collect()] == ["email"]
