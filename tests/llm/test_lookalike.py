import unicodedata

import pytest

from tallywright.llm import lookalike as lk


def forms(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r.text: r.canonical for r in lk.canonical_texts(df).collect()}


@pytest.mark.parametrize(
    "a, b",
    [
        ("ＡＢＣ（１）", "ABC(1)"), ("Ве ѕt", "Be st"), ("café", "café"), ("q̣̇", "q̣̇"), ("期​末︎余­额", "期末余额"), ("a　b  c", "a b c"), ("1‚234․5", "1,234.5"), ("2020–21", "2020-21"),
        ("⾦⻓", "金长"), ("年", "年"), ("Ⅳ", "IV"), ("𝟷𝟸", "12"), (" x⁠ ", "x"), ("Ϊ", "Ï"),
    ],
)
def test_same_look(spark, a, b):
    f = forms(spark, a, b)
    assert f[a] == f[b]


@pytest.mark.parametrize("a, b", [("x²", "x2"), ("①", "1"), ("餘額", "余额"), ("A", "a"), ("a,b", "a;b"), ("ab", "a b"), ("é", "e"), ("½", "1/2")])
def test_other_look(spark, a, b):
    f = forms(spark, a, b)
    assert f[a] != f[b]


def test_against_plain_rebuild(spark):
    table = dict(lk.mapping_entries())
    texts = ["ẹ́x", "́", "中̈", "Å̊", "ﬁne", "à̖́" * 5, "x" * 20000 + "​", "\U0001d7d8é"]
    for t, got in forms(spark, *texts).items():
        pieces = "".join("".join(c for c, _ in table.get(ch, ((ch, 0),))) for ch in t)
        want = " ".join(x for x in unicodedata.normalize("NFC", unicodedata.normalize("NFD", pieces)).split(" ") if x)
        assert got == want


def test_nulls_hidden_and_empty(spark):
    assert forms(spark, "", "​", " ", "　") == {"": "", "​": "", " ": "", "　": ""}
    df = spark.createDataFrame([(None, 1, "c"), ("Ａ", 2, "c"), ("Ａ", 2, "c")], "text string, k1 int, ch string")
    assert sorted((r.k1, r.canonical) for r in lk.with_canonical(df).collect()) == [(1, None), (2, "A"), (2, "A")]
    assert lk.canonical_texts(spark.createDataFrame([], "text string")).count() == 0


def test_pairs_inside_their_scope(spark):
    s = "source_field string, scope string, record_id string, text string"
    data = [("f", "1", "a", "余额"), ("f", "1", "b", "余​额"), ("f", "1", "c", "余额"), ("f", "2", "d", "余额﻿"), ("g", "1", "e", "余​额"), ("f", "1", "z", None), ("f", "1", "y", "​"), ("f", "1", "x", ""), ("f", "1", "b", "余​额")]
    got = {tuple(r) for r in lk.equal_looking_pairs(spark.createDataFrame(data, s)).collect()}
    assert got == {("f", "a", "b"), ("f", "b", "c")}


def test_hot_copies_do_not_meet(spark):
    s = "source_field string, scope string, record_id string, text string"
    data = [("f", "", f"r{i:04d}", "同一标题") for i in range(3000)] + [("f", "", "s", "同一‍标题")]
    df = lk.equal_looking_pairs(spark.createDataFrame(data, s))
    assert df.count() == 3000 and df.select("record_b").distinct().count() == 1


def test_every_character_and_its_normal_forms_have_one_canonical_form(spark):
    import unicodedata

    chars = [chr(c) for c in range(0x20, 0x10000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x10000, 0x1F000)]
    texts = {f for c in chars for f in (c, unicodedata.normalize("NFD", c), unicodedata.normalize("NFC", c))}
    mixed = [a + b + c for a in "aoe각가ᄇはが" for b in "̣́ᅡᆨ゙" for c in "̧̣́ᆨz"]
    texts |= {f for m in mixed for f in (m, unicodedata.normalize("NFD", m), unicodedata.normalize("NFC", m))}
    got = {r.text: r.canonical for r in lk.canonical_texts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    wrong = [c for c in [*chars, *mixed] if len({got[c], got[unicodedata.normalize("NFD", c)], got[unicodedata.normalize("NFC", c)]}) > 1]
    assert not wrong, [hex(ord(c[0])) for c in wrong[:20]]
    assert all(unicodedata.normalize("NFC", got[m]) == got[m] for m in mixed)


def test_hangul_in_both_forms(spark):
    import unicodedata

    words = ["보험", "책임준비금", "각", "ㄱㅏ"]
    got = {r.text: r.canonical for r in lk.canonical_texts(spark.createDataFrame([(f,) for w in words for f in (w, unicodedata.normalize("NFD", w))], "text string")).collect()}
    assert all(got[unicodedata.normalize("NFD", w)] == got[w] == w for w in words)
