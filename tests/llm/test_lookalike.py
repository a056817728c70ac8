import unicodedata

from hypothesis import given
from hypothesis import strategies as st

from pagewright.llm import lookalike as K

SAME = [("office", "oﬃce"), ("naïve", "naïve"), ("code", "ｃｏｄｅ"), ("Сοде".replace("де", "de"), "Code"), ("a b", "a b"), ("a-b", "a‑b"), ("word", "wo​rd"), ("见文", "⻅⽂"), ("pop", "рор"), ("fi", "ﬁ"), ("Å", "Å"), ("x", "x﻿"), ("a b", "a　b"), ("AB", "ꓮꓐ"), ("b", "ᖯ"), ("b", "Ь"), ("τ", "т"), ("A", "ᗅ")]
DIFFERENT = [("a", "A"), ("naive", "naïve"), ("a\nb", "a\r\nb"), ("x2", "x²"), ("1", "①"), ("a b", "ab"), ("a-b", "a—b"), ("1/2", "½"), ("l", "1")]


def test_pairs():
    for a, b in SAME:
        assert K.skeleton(a) == K.skeleton(b), (a, b)
    for a, b in DIFFERENT:
        assert K.skeleton(a) != K.skeleton(b), (a, b)


@given(st.text(max_size=60))
def test_stable(text):
    s = K.skeleton(text)
    assert K.skeleton(s) == s
    assert K.skeleton(unicodedata.normalize("NFC", text)) == K.skeleton(unicodedata.normalize("NFD", text)) == s


def rows(spark, values):
    return spark.createDataFrame([(k, t, b, "x", "y") for k, (t, b) in enumerate(values)], "rev_id long, title string, body string, look string, same string")


def test_operator(spark):
    values = [("code", None), ("ｃode", ""), ("code", "naïve"), ("Code", "naïve"), (None, "naïve"), ("", "ﬁ" + "x" * 50_000), ("", "fi" + "x" * 50_000), ("сode", None)]
    got = {tuple(r) for r in K.equal_look_pairs(rows(spark, values)).collect()}
    want = set()
    for field, at in (("title", 0), ("body", 1)):
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if i < j and a[at] and b[at] and a[at] != b[at] and K.skeleton(a[at]) == K.skeleton(b[at]):
                    want.add((i, j, field))
    assert got == want and len(want) == 6
    classes = K.look_classes(rows(spark, values)).collect()
    assert {r.rev_id for r in classes if r.field == "title"} == {0, 1, 2, 7}
    forms = {r.rev_id: r.title_form for r in K.with_skeletons(rows(spark, values)).collect()}
    assert forms[1] == "code" and forms[4] is None and forms[5] == ""
    empty = rows(spark, values).limit(0)
    assert K.equal_look_pairs(empty).count() == 0 and K.with_skeletons(empty).count() == 0


def test_hot_copies_give_no_pairs_among_themselves(spark):
    values = [("hot title", None)] * 300 + [("hοt title", None)] * 2
    assert K.equal_look_pairs(rows(spark, values)).count() == 600


def test_other_tables(spark):
    table = K.load_prototypes(["\ufeff# note", "0430 ;\t0061 ;\tMA\t# x", "006D ; 0072 006E ; MA # ASCII stays", "", "2460 ; 0031 ; MA"])
    assert table == {"а": "a", "①": "1"}
    values = [("1", None), ("①", None), ("а", None), ("a", None), ("о", None), ("o", None)]
    assert {(r.rev_id_a, r.rev_id_b) for r in K.equal_look_pairs(rows(spark, values), table).collect()} == {(0, 1), (2, 3)}
    members = {r.rev_id: (r.same_id, r.look_first_id, r.n_rows) for r in K.look_classes(rows(spark, [*values, ("a", None)]), table).collect()}
    assert members == {0: (0, 0, 2), 1: (1, 0, 2), 2: (2, 2, 3), 3: (3, 2, 3), 6: (3, 2, 3)}
