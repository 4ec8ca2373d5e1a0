import itertools
import random

import pytest

from tallywright.operators import units

OBS = "observation_id string, source_key string, measure string, physical_segment_id string, source_pdf string, page int, data_year string, value double, unit string, currency string"
SEG, CTX, FX = "segment_id string, unit string", "pdf_id string, page int, unit string, currency string, unit_source_text string", "currency string, rate_year string, cny_per_unit double"


@pytest.mark.parametrize(
    "text, scale, currency",
    [
        ("（百万元）", 1e6, None), ("RMB 10k", 1e4, "CNY"), ("CNY in thousands", 1e3, "CNY"), ("HK$'000", 1e3, "HKD"), ("十亿元", 1e9, None), ("萬元", 1e4, None), ("hundred million", 1e8, None), ("单位:千元", 1e3, None),
        ("Expressed in HK$ tens of thousands", 1e4, "HKD"), ("Amounts are stated in hundreds of millions", 1e8, None), ("下列各表以百万港元为计量单位，尾差因四舍五入所致", 1e6, "HKD"), ("USD 100 million", 1e8, "USD"),
        ("bps", 1e-4, None), ("％", 0.01, None), ("千分比", 1e-3, None), ("x", 1.0, None), ("RMB", 1.0, "CNY"),
    ],
)
def test_grammar(text, scale, currency):
    parsed = units.parse_unit_text(text)
    assert parsed["scale"] == pytest.approx(scale) and parsed["currency"] == currency


@pytest.mark.parametrize("text", [None, "", "—", "  ", "无", "Tables"])
def test_nothing_stated(text):
    assert units.parse_unit_text(text) is None


def test_dimension_vectors():
    assert units.parse_unit_text("kg/m^2")["dims"] == [0, 0, -2, 1, 0, 0]
    assert units.parse_unit_text("km")["scale"] == 1000 and units.parse_unit_text("°F")["offset"] == pytest.approx(255.372, abs=1e-3)


def test_precedence_and_declarations(rows):
    obs = rows(OBS, ("a", "k", "AMOUNT", "s1", "p", 5, "2020", 2.0, "元", None), ("b", "k", "AMOUNT", "s1", "p", 5, "2020", 2.0, None, None), ("c", "k", "AMOUNT", "s0", "p", 5, "2020", 2.0, "—", None),
               ("d", "k", "AMOUNT", None, "p", 1, "2020", 2.0, None, None), ("e", "k", "RATIO", None, None, None, None, 5.0, "%", None), ("f", "k", "AMOUNT", "s0", "p", 9, None, 1.0, None, "HKD"), ("g", "k", "AMOUNT", "s0", "p", 9, "2020", None, None, None))
    seg = rows(SEG, ("s1", "万元"), ("s0", ""))
    ctx = rows(CTX, ("p", 3, None, "HKD", "金额单位：千元"), ("p", 4, None, None, None), ("p", 7, "百万", None, None))
    got = {r.observation_id: r for r in units.to_common_units(obs, seg, ctx, rows(FX, ("HKD", "2020", 0.8), ("CNY", "2020", 1.0))).collect()}
    assert got["a"].scale == 1 and got["b"].scale == 1e4 and got["c"].scale == 1e3 and got["a"].currency == "HKD"
    assert got["d"].unit_status == "NO_SCALE" and got["d"].currency == "CNY"
    assert got["e"].common_value == pytest.approx(0.05)
    assert got["f"].scale == 1e6 and got["f"].unit_status == "NO_RATE" and got["g"].unit_status == "NO_VALUE"
    assert got["c"].common_value == pytest.approx(2000 * 0.8)


def test_agreement_against_brute_force(spark, rows):
    rng = random.Random(3)
    data = []
    for i in range(120):
        base, scale, cur = rng.choice([1.0, 2.0, -3.0, 0.0, 1000.0]), rng.choice([1.0, 1e4]), rng.choice(["CNY", "USD"])
        data.append((f"o{i:03d}", rng.choice(["hot", "hot", "k1", "k2"]), "AMOUNT", base, scale, cur, base * rng.choice([1, 1.0005, 0.9995, 1.0011, 1.01]), "CONVERTED"))
    data += data[:10]  # delivered twice
    schema = "observation_id string, source_key string, measure string, value double, scale double, currency string, common_value double, unit_status string"
    got = {(r.observation_a, r.observation_b) for r in units.agreeing_pairs(spark.createDataFrame(data, schema)).collect()}
    want = set()
    for a, b in itertools.combinations(sorted(set(data)), 2):
        if a[1] == b[1] and (a[4], a[5]) != (b[4], b[5]) and abs(a[6] - b[6]) <= 0.001 * max(abs(a[6]), abs(b[6])):
            want.add((a[0], b[0]))
    assert got == want and want


def test_empty_and_extra_columns(rows):
    extra = OBS + ", s_scale string, bucket string, lo int"
    empty = rows(extra)
    assert units.found_agreements(empty, rows(SEG), rows(CTX), rows(FX)).count() == 0
    two = rows(extra, ("a", "k", "RATIO", None, None, None, None, 5.0, "%", None, "x", "y", 1), ("b", "k", "RATIO", None, None, None, None, 50.0, "‰", None, "x", "y", 1), ("c", None, "RATIO", None, None, None, None, 5.0, "%", None, "x", "y", 1))
    assert [tuple(r) for r in units.found_agreements(two, rows(SEG), rows(CTX), rows(FX)).collect()] == [("a", "b")]


@pytest.mark.parametrize("text", ["无", "Tables", "foo 万元", "万元 bar", "RMB HKD", "人民币/港币万元", "^2", "m/s/h"])
def test_unit_fields_are_rejected(text):
    with pytest.raises(units.UnreadableUnit):
        units.parse_unit_expression(text)


def test_sentences():
    assert units.parse_unit_sentence("截至十二月三十一日，金额单位：元")["scale"] == 1
    assert units.parse_unit_sentence("币种：人民币；单位：万元") == {"scale": 1e4, "offset": 0.0, "currency": "CNY", "dims": [1, 0, 0, 0, 0, 0]}
    assert units.parse_unit_sentence("金额以万元列示，每股收益以元列示") is None  # two meanings
    assert units.parse_unit_sentence("人民币万元或港币") is None and units.parse_unit_sentence("nothing here") is None and units.parse_unit_sentence("RMB million, see table x")["scale"] == 1e6 and units.parse_unit_sentence("以万列示")["scale"] == 1e4


def test_dimensions_and_offsets(rows):
    obs = rows(OBS, ("kg", "k", "AMOUNT", None, None, None, "2020", 5.0, "kg", None), ("c", "k", "TEMPERATURE", None, None, None, None, 20.0, "°C", None), ("f", "k", "TEMPERATURE", None, None, None, None, 68.0, "°F", None),
               ("v", "k", "SPEED", None, None, None, None, 36.0, "km/h", None), ("r", "k", "RATIO", None, None, None, None, 5.0, "元", None), ("u", "k", "AMOUNT", None, None, None, None, 5.0, "see note", None), ("p", "k", "MASS", None, None, None, None, 2.0, "thousand kg", None),
               ("n", "k", "MASS", None, None, None, None, 2.0, None, None), ("y", "k", None, None, None, None, "2020", 2.0, "HK$ million", None))
    got = {r.observation_id: r for r in units.to_common_units(obs, rows(SEG), rows(CTX), rows(FX, ("HKD", "2020", 0.8))).collect()}
    assert got["kg"].unit_status == "WRONG_DIMENSION" and got["kg"].common_value is None and got["r"].unit_status == "WRONG_DIMENSION" and got["u"].unit_status == "UNREADABLE_UNIT"
    assert got["c"].common_value == pytest.approx(293.15) and got["f"].common_value == pytest.approx(293.15) and got["v"].common_value == pytest.approx(10.0)
    assert got["p"].common_value == 2000 and got["n"].unit_status == "NO_SCALE" and got["y"].common_value == pytest.approx(1.6e6) and got["c"].currency is None
