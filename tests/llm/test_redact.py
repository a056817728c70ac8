import re
import unicodedata
from datetime import date

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pagewright.llm import redact as R

FOUND = {
    "email": ["write to a.b+c@mail.example now", "x [at] lab [dot] org", "x (at) lab.org", "ｘ＠ｌａｂ．ｏｒｇ", "[m](mailto:q_r@dept.example.com)", "A@B.CO", "joe at lab dot org"],
    "phone": ["+1 (617) 555-0194", "+44 7700 900930", "(303) 555 0171", "555-0192 ext. 688", "01632 960956", "010-55554654", "100 0550 6778", "+1.303.555.0132", "900-00-76-31", "06.39.98.99.43", "01 99 00 38 73", "0049-40-66969-900", "0171/3920001", "(030) 23125 855", "+33 (0)1 99 00 65 55", "Call 5550123 now", "＋１ （２１２） ５５５－０１８３", "On-call line: (512) 555 0108"],
    "id-number": ["SSN 966-56-4142", "954-02-9737", "social security number: 993 05 1050", "tax ID 945-74-0872", "passport no. X50922008", "National Insurance no. QQ 26 30 86 C", "写着身份证号 99920219980915266X。", "（误贴：护照号码 X76432331）", "NIE X-0056518-A", "DNI 00498224X", "Personalausweis Nr. L0X821293", "Steuer-ID 00 139 102 175", "Sozialversicherungsnummer 99 208463 Z 745", "pasaporte XX2541419", "паспорта 4509 123456", "n° de sécurité sociale 3 52 99 99 489 534", "passeport n° 00XX36578"],
    "street-address": ["19 Old Quarry Lane, Apt 36, Norwick Falls 00036", "Flat 6, 25 Larkmoor Street, Easthallow", "Zwölfeichenallee 95, 00719 Neu-Brambach am See", "Am Alten Kornspeicher 231 b, 00683 Neu-Brambach am See", "157 bis chemin de la Combe Noire, 00776 Valmont-sur-Orle", "Calle del Olmo Seco, 182, 5ºC, 00168 Puerto Almena", "Avda. de las Tres Norias, 23, 1ºC, 00640 Villarrobla", "寄到宁沅市旧码头路23号875室。", "Keizersgracht 12", "ул. Садовая, д. 5"],
    "person-name": ["Reviewed by Ines Pellanek in spring.", "> — Oskelhollow, Greta", "Helene OSKELETTE wrote", "thanks to Paula de la Quarez for", "Dr. Amir M. Quistette", "Elif O'Varnell", "Ines Ström-Talvik", "Zoé Brandette", "Zoé Brandette", "感谢欧阳砚迟提供的记录", "| 澹台屿宁 |", "审阅人：王小明", "感谢Ruben Havrinette提供的记录", "本节由Marlette, Paula撰写。", "ran. Kestozari, Bruno disagreed", "Interview with Qorvan Teslimund."],
}
NOT = ["The Marble Street dataset has 74515 rows and the Iris dashboard shows 53.", "Batch sizes 1024-2048-5438, learning rate 3.5e-4.", "Ticket KB-01818, run 2078634619, shard 3 of 12.", "See doi:10.0000/kb.70807 and ISBN 000-0-8333-5335-0.", "Ask @team-search or @lint-bot.", "Restore with git checkout main@{2} -- wiki/", "Pinned to router-kit@2.20.2 since 2025-10-18.", "Latency 12.4 ms, p95 30.6 ms, 2026-03-18T06:15:00Z.", "Commit 8ba7c832fca6 at 192.0.2.165:5486.", "Gradient Descent with Momentum, Layer Norm and Mixed Precision.", "| 1 | 0.969 | 4200 |", "Anna", "", "Der Suchindex 12 zeigt 2024"]


@pytest.mark.parametrize("name", list(FOUND))
def test_found(name):
    for text in FOUND[name]:
        assert name in {n for _, _, n, _ in R.find(text)}, text


def test_not_found():
    for text in NOT:
        assert R.find(text) == [], text


def test_names_in_mail_do_not_count():
    assert {n for _, _, n, _ in R.find("mail Anna.Kestanek@lab.org")} == {"email"}


def test_lines_and_text_stay():
    text = "ok\r\ncall (303) 555 0171\rx\nmail a@b.co​\n" + "z" * 100_000
    assert [(m["line_number"], m["pattern_name"]) for m in R.matches(text, tuple(R.FINDERS), "k")] == [(2, "phone"), (4, "email")]
    out = R.redact(text, {"phone": "[P]", "email": "[E]"})
    assert out == text.replace("(303) 555 0171", "[P]").replace("a@b.co", "[E]")
    assert R.redact(None, {}) is None and R.matches("", tuple(R.FINDERS), "k") == []


@given(st.integers(1, 5000), st.data())
def test_feistel_is_a_permutation(size, data):
    v = data.draw(st.integers(0, size - 1))
    k = b"0" * 16
    w = R.feistel(v, size, k, b"t")
    assert 0 <= w < size and R.feistel(w, size, k, b"t", inverse=True) == v


def test_small_permutation_is_whole():
    assert sorted(R.feistel(v, 97, b"k" * 16, b"t") for v in range(97)) == list(range(97))


@given(st.from_regex(r"[A-Za-z0-9 ()+.\-]{1,40}", fullmatch=True))
def test_pseudonyms_keep_the_format(value):
    p, q = R.pseudonym(value, "phone", "key"), R.pseudonym(value, "person-name", "key")
    assert [c if not c.isdigit() else "0" for c in p] == [c if not c.isdigit() else "0" for c in value]
    assert [(c.isdigit(), c.isupper(), c.isalnum() or c) for c in q] == [(c.isdigit(), c.isupper(), c.isalnum() or c) for c in value]


def test_every_letter_and_digit_has_an_alphabet():
    places, alphabets = R._alphabets()
    assert min(map(len, alphabets)) >= 8 and sum(map(len, alphabets)) == len(places)
    for code in range(0x110000):
        for ch in unicodedata.normalize("NFKD", chr(code)):
            if unicodedata.category(ch)[0] in "LN" and unicodedata.category(ch) != "Co":
                assert (ch.lower() if ch.isascii() else ch) in places, hex(code)


@given(st.text(st.characters(categories=["L", "N"]), min_size=6, max_size=30))
def test_no_cleartext_in_any_script(value):
    plain = R.canonical(value, "person-name")
    hidden = R.link(value, "person-name", "key")
    assert R.restore(hidden, "person-name", "key") == plain
    places = R._alphabets()[0]
    groups = {}
    for a, b in zip(plain, hidden):
        if a in places:
            assert places[a][0] == places[b][0]
            groups.setdefault(places[a][0], []).append((a, b))
    # a long stretch of one alphabet never stays as it is
    assert all(any(a != b for a, b in g) for g in groups.values() if len(g) >= 6)


def test_cleartext_cases():
    for value, pattern in (("Иван Петров", "person-name"), ("Łukasz Øre", "person-name"), ("やまだ太郎", "person-name"), ("김철수", "person-name"), ("Νίκος Παππάς", "person-name")):
        words = set(R.canonical(value, pattern).split())
        assert not words & set(R.link(value, pattern, "k").split()) and not set(value.split()) & set(R.pseudonym(value, pattern, "k").split())
    street = R.pseudonym("ул. Ленина, д. 5 кв. 3", "street-address", "k")
    assert "Ленина" not in street and street.startswith("ул. ") and ", д. " in street and " кв. " in street
    assert re.fullmatch(r"\d{3} \d{4} ext \d\d", R.pseudonym("555 0199 ext 12", "phone", "k"))


VALID = {"cn-resident": "11010519491231002X", "es-dni": "12345678Z", "es-nie": "X1234567L", "fr-nir": "255081416802538", "br-cpf": "52998224725", "jp-number": "123456789018", "ru-snils": "11223344595", "ru-inn-10": "7707083893", "ru-inn-12": "500100732259", "de-tax": "86095742719", "luhn": "4111111111111111", "nl-bsn": "111222333"}


def test_validated_numbers_stay_valid():
    key = R._secret("k")
    for scheme, number in VALID.items():
        assert R.scheme_of(number) == scheme, scheme
        other = R.permute_valid(number, scheme, key)
        form, check = R.SCHEMES[scheme]
        assert other != number and len(other) == len(number) and any(re.fullmatch(form, other[:c]) and check(other[:c]) == other[c:] for c in (len(other) - 1, len(other) - 2))
        assert R.permute_valid(other, scheme, key, inverse=True) == number
    assert R.scheme_of("110105194912310021") is None and R.scheme_of("４１１１") is None and R.scheme_of("") is None
    p = R.pseudonym("110105 19491231 002X", "id-number", "k")
    date(int(p[7:11]), int(p[11:13]), int(p[13:15]))
    assert R._check_cn(p.replace(" ", "")[:17]) == p[-1]


def test_equal_values_stay_linked():
    digits = lambda s: "".join(c for c in s if c.isdigit())
    a, b = (R.pseudonym(v, "phone", "k") for v in ("+1 (617) 555-0194", "+1.617.555.0194"))
    assert digits(a) == digits(b) != "16175550194" and R.pseudonym("+1 (617) 555-0194", "phone", "other") != a
    assert R.permute_date(R.permute_date(date(2024, 2, 29), b"k" * 16), b"k" * 16, inverse=True) == date(2024, 2, 29)
    with pytest.raises(ValueError):
        R.link("x", "phone", "")


def test_operator(spark):
    pages = spark.createDataFrame([(1, "a@b.co and a@b.co\nx", "m"), (2, None, "m"), (3, "", "m"), (4, "plain", "m"), (4, "plain", "m")], "rev_id long, body string, m string")
    types = spark.createDataFrame([("email", "[E]"), ("email", "[E]"), ("unheard-of", "[U]"), (None, None)], "pattern_name string, placeholder string")
    assert [tuple(r) for r in R.find_personal_data(pages, types).collect()] == [(1, 1, "email")]
    records = R.personal_records(pages, types, "k").collect()
    assert [(r.rev_id, r.line_number, r.pattern_name, r.scheme) for r in records] == [(1, 1, "email", None)] * 2 and records[0].link == records[1].link != "a@b.co"
    assert {(r.rev_id, r.body) for r in R.redact_bodies(pages, types).collect()} == {(1, "[E] and [E]\nx"), (2, None), (3, ""), (4, "plain")}
    assert R.find_personal_data(pages.limit(0), types.limit(0)).count() == 0


def test_links_do_not_depend_on_the_format():
    for name, same in {
        "email": ["a.b@lab.org", "A.B@lab.org", "a.b [at] lab [dot] org", "a.b (at) lab.org", "a.b at lab dot org", "a.b{at}lab[.]org"],
        "phone": ["+1 (617) 555-0194", "+1.617.555.0194", "001 617 555 0194"],
        "id-number": ["954-02-9737", "954 02 9737", "954029737"],
        "person-name": ["Greta Oskelhollow", "Oskelhollow, Greta", "Greta  OSKELHOLLOW"],
        "street-address": ["6 Larkmoor Street, Easthallow", "6 Larkmoor Street,  Easthallow"],
    }.items():
        assert len({R.link(v, name, "k") for v in same}) == 1, name
        assert R.link(same[0], name, "k") not in (R.link(same[0] + "7", name, "k"), R.canonical(same[0], name))
    assert R.canonical("a.b at lab dot org", "email") == "a.b@lab.org" and R.canonical("dot.at@at.dot", "email") == "dot.at@at.dot"
    assert R.canonical("+33 (0)1 99 00 65 55", "phone") == "+33199006555" and R.canonical("555-0192 ext. 688", "phone") == "5550192;688"
    found = R.matches("x a.b [at] lab [dot] org\ny a.b@lab.org\nz 555-0192 ext. 688", tuple(R.FINDERS), "k")
    assert [m["pattern_name"] for m in found] == ["email", "email", "phone"] and found[0]["link"] == found[1]["link"]
    assert " [at] " in found[0]["pseudonym"] and " [dot] " in found[0]["pseudonym"] and " ext. " in found[2]["pseudonym"]
    assert found[0]["pseudonym"].replace(" [at] ", "@").replace(" [dot] ", ".") == found[1]["pseudonym"]
