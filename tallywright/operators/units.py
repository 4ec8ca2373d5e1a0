"""Units: a small grammar, dimension exponent vectors, conversion to canonical units, agreement search."""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.session import Workspace

#: Base dimensions of the exponent vector, in order.
DIMENSIONS = ("money", "ratio", "length", "mass", "time", "temperature")

# Spelling -> currency code.
CURRENCIES = {
    "人民币": "CNY", "rmb": "CNY", "cny": "CNY", "yuan": "CNY", "renminbi": "CNY", "¥": "CNY",
    "港币": "HKD", "港元": "HKD", "港圆": "HKD", "hkd": "HKD", "hk$": "HKD",
    "美元": "USD", "美金": "USD", "usd": "USD", "us$": "USD",
}
# Unit word -> (dimension, scale, offset).
UNITS = {
    "元": ("money", 1.0, 0.0), "units": ("money", 1.0, 0.0), "unit": ("money", 1.0, 0.0), "角": ("money", 0.1, 0.0), "分钱": ("money", 0.01, 0.0),
    "%": ("ratio", 0.01, 0.0), "百分比": ("ratio", 0.01, 0.0), "百分点": ("ratio", 0.01, 0.0), "percent": ("ratio", 0.01, 0.0), "per cent": ("ratio", 0.01, 0.0), "pct": ("ratio", 0.01, 0.0),
    "‰": ("ratio", 0.001, 0.0), "千分比": ("ratio", 0.001, 0.0), "per mille": ("ratio", 0.001, 0.0), "permille": ("ratio", 0.001, 0.0),
    "bps": ("ratio", 0.0001, 0.0), "bp": ("ratio", 0.0001, 0.0), "基点": ("ratio", 0.0001, 0.0), "basis points": ("ratio", 0.0001, 0.0), "basis point": ("ratio", 0.0001, 0.0),
    "times": ("ratio", 1.0, 0.0), "x": ("ratio", 1.0, 0.0), "倍": ("ratio", 1.0, 0.0),
    "km": ("length", 1000.0, 0.0), "m": ("length", 1.0, 0.0), "cm": ("length", 0.01, 0.0), "mm": ("length", 0.001, 0.0), "公里": ("length", 1000.0, 0.0), "米": ("length", 1.0, 0.0),
    "kg": ("mass", 1.0, 0.0), "g": ("mass", 0.001, 0.0), "t": ("mass", 1000.0, 0.0), "吨": ("mass", 1000.0, 0.0), "公斤": ("mass", 1.0, 0.0),
    "s": ("time", 1.0, 0.0), "min": ("time", 60.0, 0.0), "h": ("time", 3600.0, 0.0), "day": ("time", 86400.0, 0.0), "小时": ("time", 3600.0, 0.0),
    "°c": ("temperature", 1.0, 273.15), "°f": ("temperature", 5.0 / 9.0, 459.67 * 5.0 / 9.0), "kelvin": ("temperature", 1.0, 0.0),
}
# Multiplier word -> factor.
MULTIPLIERS = {
    "十": 1e1, "百": 1e2, "佰": 1e2, "千": 1e3, "仟": 1e3, "万": 1e4, "亿": 1e8,
    "ten": 1e1, "tens of": 1e1, "hundred": 1e2, "hundreds of": 1e2, "thousand": 1e3, "thousands": 1e3, "'000": 1e3, "000s": 1e3, "k": 1e3,
    "million": 1e6, "millions": 1e6, "mn": 1e6, "mio": 1e6, "billion": 1e9, "billions": 1e9, "bn": 1e9, "trillion": 1e12,
}
# Characters folded before the lexicon is applied.
FOLD = str.maketrans({"萬": "万", "億": "亿", "圓": "元", "圆": "元", "’": "'", "‘": "'", "幣": "币", "單": "单", "－": "-"})
PER = ("/", "每", "per")
# Words around a unit expression that state nothing.
FILLERS = ("金额单位", "计量单位", "货币单位", "单位", "币种", "均为", "为", "in", "of", "amounts", "amount", "currency", "unit:", "expressed", "stated")
#: Signs that may stand anywhere in a unit expression.
SIGNS = re.compile(r"[\s:：()（）\[\]【】,，.。;；*·]+")


def _pattern(words) -> str:
    """Longest word first; a word of letters does not begin or end inside another."""
    return "|".join(rf"(?<![a-z]){re.escape(w)}(?![a-z])" if re.fullmatch(r"[a-z ]+", w) else re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


_TOKEN = re.compile("|".join([_pattern([*CURRENCIES, *UNITS, *MULTIPLIERS, *PER]), r"\d+(?:\.\d+)?", r"\^-?\d+"]))
_FILLER = re.compile(_pattern(FILLERS))
_BLANK = re.compile(r"\s*")


class UnreadableUnit(ValueError):
    """A text that states something, but no unit expression."""


def _expression(tokens: list[str]) -> dict | None:
    """Meaning of the tokens of one expression; None where they state nothing (numbers only).

    expression := product [PER product];  product := factor+;  factor := [number] multiplier | currency | unit [^exponent].
    Two different currencies, an exponent without a unit, or a number that multiplies nothing are no expression.
    """
    scale, offset, currency, sign, stated = 1.0, 0.0, None, 1, False
    exponents = [0] * len(DIMENSIONS)
    number, last = None, None
    for token in tokens:
        if token in PER:
            if sign < 0:
                raise UnreadableUnit(token)
            sign, last = -1, None
        elif token[0] == "^":
            if last is None:
                raise UnreadableUnit(token)
            dim, unit_scale = last
            power = int(token[1:])
            exponents[dim] += sign * (power - 1)
            scale *= unit_scale ** (sign * (power - 1))
            last = None
        elif token[0].isdigit():
            number = float(token)
        elif token in MULTIPLIERS:
            scale *= (MULTIPLIERS[token] * (1.0 if number is None else number)) ** sign
            stated, number, last = True, None, None
        elif token in CURRENCIES:
            if currency not in (None, CURRENCIES[token]):
                raise UnreadableUnit(token)
            currency, stated, last = CURRENCIES[token], True, None
        else:
            name, unit_scale, unit_offset = UNITS[token]
            dim = DIMENSIONS.index(name)
            exponents[dim] += sign
            scale *= unit_scale**sign
            offset += unit_offset
            stated, last = True, (dim, unit_scale)
    if not stated:
        return None
    if not any(exponents):  # a bare multiplier or currency counts money
        exponents[0] = 1
    if offset and (sum(map(abs, exponents)) != 1 or max(exponents) != 1):
        offset = 0.0  # a shifted scale has its zero only where it stands alone
    bare = all(t in MULTIPLIERS and not t.isascii() or t[0].isdigit() for t in tokens)
    return {"scale": scale, "offset": offset, "currency": currency, "dims": exponents, "only_currency": all(t in CURRENCIES for t in tokens), "bare": bare}


def _folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).translate(FOLD).lower()


def _result(meaning: dict | None) -> dict | None:
    return meaning and {k: meaning[k] for k in ("scale", "offset", "currency", "dims")}


def parse_unit_expression(text: str | None) -> dict | None:
    """Meaning of a unit field: the whole text must be one expression, with FILLERS and SIGNS between its parts.

    Returns scale, offset, currency and the exponent vector; None where nothing is stated (null, blank, dashes). Other text raises UnreadableUnit.
    """
    if text is None or not isinstance(text, str):
        return None
    folded, tokens, at = _folded(text), [], 0
    while at < len(folded):
        for pattern in (_TOKEN, _FILLER, SIGNS):
            m = pattern.match(folded, at)
            if m:
                if pattern is _TOKEN:
                    tokens.append(m.group())
                at = m.end()
                break
        else:
            if folded[at] not in "-—–'/\"_":
                raise UnreadableUnit(text)
            at += 1
    return _result(_expression(tokens))


def parse_unit_sentence(text: str | None) -> dict | None:
    """Meaning of a sentence that states a unit somewhere: words and expressions in any order.

    Expressions are the runs of tokens with nothing but blanks between them. One that names a currency alone and one that names a scale alone go
    together; expressions of different meaning cancel each other (None), as does an expression that is none. A numeral of ideographs alone
    (十, 万) counts only where no expression states more. None also where nothing is stated.
    """
    if text is None or not isinstance(text, str):
        return None
    folded, runs, end = _folded(text), [], -1
    for m in _TOKEN.finditer(folded):
        if runs and _BLANK.fullmatch(folded, end, m.start()):
            runs[-1].append(m.group())
        else:
            runs.append([m.group()])
        end = m.end()
    runs = [r for r in runs if not (len(r) == 1 and re.fullmatch("[a-z]", r[0]))]  # a letter alone is a word of the sentence
    try:
        found = [x for x in map(_expression, runs) if x]
    except UnreadableUnit:
        return None
    found = [x for x in found if not x["bare"]] or found
    scales = {(x["scale"], x["offset"], tuple(x["dims"])) for x in found if not x["only_currency"]}
    currencies = {x["currency"] for x in found if x["currency"]}
    if not found or len(scales) > 1 or len(currencies) > 1:
        return None
    scale, offset, dims = next(iter(scales), (1.0, 0.0, tuple(found[0]["dims"])))
    return {"scale": scale, "offset": offset, "currency": next(iter(currencies), None), "dims": list(dims)}


def _readable(text: str | None) -> dict | None:
    """parse_unit_expression, None where the text cannot be read."""
    try:
        return parse_unit_expression(text)
    except UnreadableUnit:
        return None


def parse_unit_text(text: str | None) -> dict | None:
    """Meaning of a text that is a unit expression or a sentence with one; None for other texts."""
    try:
        return parse_unit_expression(text)
    except UnreadableUnit:
        return parse_unit_sentence(text)


UNIT_TYPE = T.StructType().add("scale", "double").add("offset", "double").add("currency", "string").add("dims", T.ArrayType(T.IntegerType()))


def _column(parser):
    @F.pandas_udf(UNIT_TYPE)
    def parse(text: pd.Series) -> pd.DataFrame:
        memo = {t: parser(t) for t in text.dropna().unique()}  # each distinct text of an Arrow batch is parsed once
        empty = {"scale": None, "offset": None, "currency": None, "dims": None}
        rows = [memo.get(t) or empty for t in text.where(text.notna(), None)]
        return pd.DataFrame(rows, columns=list(empty))

    return parse


#: Column forms of the two parsers; null where nothing is stated or the text cannot be read.
parse_unit, parse_sentence = _column(_readable), _column(parse_unit_sentence)

_OWN_TYPE = T.StructType().add("scale", "double").add("offset", "double").add("currency", "string").add("dims", T.ArrayType(T.IntegerType())).add("state", "string")


@F.pandas_udf(_OWN_TYPE)
def _parse_pair(unit: pd.Series, currency: pd.Series) -> pd.DataFrame:
    """Unit and currency fields of one row, read together (currency: own field first, then the unit); state: STATED, NOT_STATED or UNREADABLE."""

    def read(t: str) -> tuple[dict | None, str]:
        try:
            meaning = parse_unit_expression(t)
        except UnreadableUnit:
            return None, "UNREADABLE"
        return meaning, "STATED" if meaning else "NOT_STATED"

    units = {t: read(t) for t in unit.dropna().unique()}
    moneys = {t: _readable(t) for t in currency.dropna().unique()}
    out = []
    for u, c in zip(unit, currency):
        p, state = units[u] if isinstance(u, str) else (None, "NOT_STATED")
        q = moneys.get(c) if isinstance(c, str) else None
        p, q = p or {}, q or {}
        out.append((p.get("scale"), p.get("offset"), q.get("currency") or p.get("currency"), p.get("dims"), state))
    return pd.DataFrame(out, columns=_OWN_TYPE.names)


#: Exponent vectors that a measure must have; other measures take any.
EXPECTED = {"AMOUNT": "money", "RATIO": "ratio"}


def _vector(name: str) -> Column:
    return F.array(*(F.lit(int(d == name)) for d in DIMENSIONS))


def declarations_in_force(contexts: DataFrame, pages: DataFrame) -> DataFrame:
    """As-of lookup: for each (pdf_id, page) of ``pages`` the last declared scale and the last declared currency.

    Scale and currency stay in force independently of each other. The lookup unions the wanted pages with the
    declaring pages and carries values forward in one window per pdf; ``pages`` is distinct, so a window holds
    pages of one document, never observations.
    """
    unit, text = parse_unit(F.col("unit")), parse_sentence(F.col("unit_source_text"))
    declared = (
        contexts.select("pdf_id", "page", unit.alias("u"), text.alias("t"), parse_unit(F.col("currency")).alias("c"))
        .select(
            "pdf_id",
            "page",
            F.coalesce(F.when(F.col("u.dims") == _vector("money"), F.col("u.scale")), F.when(F.col("t.dims") == _vector("money"), F.col("t.scale"))).alias("d_scale"),
            F.coalesce("c.currency", "u.currency", "t.currency").alias("d_currency"),
        )
        .where("pdf_id IS NOT NULL AND page IS NOT NULL AND (d_scale IS NOT NULL OR d_currency IS NOT NULL)")
        .groupBy("pdf_id", "page")
        .agg(F.max("d_scale").alias("d_scale"), F.max("d_currency").alias("d_currency"), F.lit(False).alias("wanted"))
    )
    wanted = pages.select("pdf_id", "page", F.lit(None).cast("double").alias("d_scale"), F.lit(None).cast("string").alias("d_currency"), F.lit(True).alias("wanted"))
    w = Window.partitionBy("pdf_id").orderBy("page", "wanted").rowsBetween(Window.unboundedPreceding, 0)
    carried = declared.unionByName(wanted).select(
        "pdf_id", "page", "wanted", F.last("d_scale", True).over(w).alias("d_scale"), F.last("d_currency", True).over(w).alias("d_currency")
    )
    return carried.where("wanted").drop("wanted")


def to_common_units(observations: DataFrame, segments: DataFrame, contexts: DataFrame, fx: DataFrame) -> DataFrame:
    """Value of every observation in its common unit: CNY yuan for AMOUNT, plain ratio for RATIO, the base units of its dimension for other measures.

    Scale: own unit, segment unit, declaration in force (the latter two state money only). Currency: own currency, own unit, segment unit,
    declaration, else CNY. The common value is value x scale + offset, for money x rate. It is null, and ``unit_status`` says why, where the value is null or NaN
    (NO_VALUE), the own unit cannot be read (UNREADABLE_UNIT) or is of another dimension than the measure (WRONG_DIMENSION), no scale is stated
    (NO_SCALE) or the rate is unknown (NO_RATE). No row is dropped, repeated rows stay repeated.
    Output: observation_id, source_key, measure, value, scale, currency, common_value, unit_status.
    """
    obs = observations.select(
        "observation_id", "source_key", "measure", "physical_segment_id", "source_pdf", "page",
        F.col("data_year").alias("rate_year"), F.when(~F.isnan("value"), F.col("value")).alias("value"),
        _parse_pair(F.col("unit"), F.col("currency")).alias("own"),
    )
    seg = (
        segments.where("segment_id IS NOT NULL AND unit IS NOT NULL")
        .select(F.col("segment_id").alias("physical_segment_id"), parse_unit(F.col("unit")).alias("s"))
        .where(F.col("s.dims") == _vector("money"))
        .groupBy("physical_segment_id")
        .agg(F.max("s.scale").alias("s_scale"), F.max("s.currency").alias("s_currency"))
    )
    pages = obs.where("source_pdf IS NOT NULL AND page IS NOT NULL").select(F.col("source_pdf").alias("pdf_id"), "page").distinct()
    decl = declarations_in_force(contexts, pages).withColumnRenamed("pdf_id", "source_pdf")
    rates = fx.groupBy("currency", "rate_year").agg(F.max("cny_per_unit").alias("rate"))
    joined = obs.join(seg, "physical_segment_id", "left").join(decl, ["source_pdf", "page"], "left")
    stated, readable = F.col("own.state") == "STATED", F.col("own.state") != "UNREADABLE"
    expected = F.when(F.col("measure") == "AMOUNT", _vector("money")).when(F.col("measure") == "RATIO", _vector("ratio"))
    fits = expected.isNull() | (F.col("own.dims") == expected)
    elsewhere = F.when(F.col("measure") == "AMOUNT", F.coalesce("s_scale", "d_scale"))
    is_money = F.coalesce(F.when(F.col("measure") == "AMOUNT", True).when(stated, F.col("own.dims") == _vector("money")), F.lit(False))
    staged = joined.select(
        "observation_id", "source_key", "measure", "value", "rate_year",
        F.when(stated, F.when(fits, F.col("own.scale"))).when(readable, elsewhere).alias("scale"), F.when(stated & fits, F.col("own.offset")).otherwise(0.0).alias("offset"),
        F.when(is_money, F.coalesce("own.currency", "s_currency", "d_currency", F.lit("CNY"))).alias("currency"), readable.alias("readable"), (stated & ~fits).alias("misfit"),
    )
    rated = staged.join(rates, ["currency", "rate_year"], "left")
    factor = F.when(F.col("currency").isNull() | (F.col("currency") == "CNY"), F.lit(1.0)).otherwise(F.col("rate"))
    status = (
        F.when(F.col("value").isNull(), "NO_VALUE").when(~F.col("readable"), "UNREADABLE_UNIT").when(F.col("misfit"), "WRONG_DIMENSION")
        .when(F.col("scale").isNull(), "NO_SCALE").when(factor.isNull(), "NO_RATE").otherwise("CONVERTED")
    )
    return rated.select(
        "observation_id", "source_key", "measure", "value", "scale", "currency", ((F.col("value") * F.col("scale") + F.col("offset")) * factor).alias("common_value"), status.alias("unit_status")
    )


def _bucket(value: Column, tolerance: float) -> Column:
    """Logarithmic bucket one tolerance wide, with the sign; values that agree lie in the same or the next bucket."""
    width = math.log1p(tolerance) * 1.001
    return F.when(value == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs(value)) / F.lit(width)) * 4 + F.when(value > 0, F.lit(1)).otherwise(F.lit(2)))


def agreeing_pairs(converted: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Pairs of different observations of one source_key, stated in different units, that agree within ``tolerance``.

    Equal rows are first reduced to classes (source_key, scale, currency, value); classes meet only in the same or
    neighbouring value bucket, so a source_key that holds a third of all rows is spread over its values and rows of one
    unit never meet each other. Only then classes are expanded to their members. Redelivered rows count once.
    """
    key = ["source_key", "measure", "scale", "currency_", "common_value"]
    obs = (
        converted.where("common_value IS NOT NULL AND observation_id IS NOT NULL AND source_key IS NOT NULL AND measure IS NOT NULL")
        .withColumn("currency_", F.coalesce("currency", F.lit("-")))
        .select("observation_id", *key)
        .distinct()
    )
    obs = Workspace(converted.sparkSession, "units").save(obs)  # read four times below
    classes = obs.select(*key).distinct().withColumn("bucket", _bucket(F.col("common_value"), tolerance))
    a = classes.select("source_key", "measure", "bucket", *(F.col(c).alias("a_" + c) for c in key[2:]))
    near = F.when(F.col("common_value") == 0, F.array(F.col("bucket"))).otherwise(F.array(F.col("bucket") - 4, F.col("bucket"), F.col("bucket") + 4))
    b = classes.select("source_key", "measure", F.explode(near).alias("bucket"), *(F.col(c).alias("b_" + c) for c in key[2:]))
    agree = F.abs(F.col("a_common_value") - F.col("b_common_value")) <= tolerance * F.greatest(F.abs("a_common_value"), F.abs("b_common_value"))
    order = F.struct("a_scale", "a_currency_") < F.struct("b_scale", "b_currency_")
    pairs = a.join(b, ["source_key", "measure", "bucket"]).where(order & agree).drop("bucket")
    left = obs.select("source_key", "measure", F.col("observation_id").alias("x"), *(F.col(c).alias("a_" + c) for c in key[2:]))
    right = obs.select("source_key", "measure", F.col("observation_id").alias("y"), *(F.col(c).alias("b_" + c) for c in key[2:]))
    full = pairs.join(left, ["source_key", "measure", "a_scale", "a_currency_", "a_common_value"]).join(
        right, ["source_key", "measure", "b_scale", "b_currency_", "b_common_value"]
    )
    return full.where("x <> y").select(F.least("x", "y").alias("observation_a"), F.greatest("x", "y").alias("observation_b")).distinct()


def found_agreements(observations: DataFrame, segments: DataFrame, contexts: DataFrame, fx: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """agreeing_pairs over whole tables; keys that one observation alone reports are set aside before any conversion.

    The set-aside is exact: such a key can give no pair. Its two passes read two columns and then shuffle only rows of
    keys with at least two observations; a hot key is split by the adaptive skew join.
    """
    shared = (
        observations.where("source_key IS NOT NULL AND observation_id IS NOT NULL")
        .groupBy("source_key")
        .agg(F.min("observation_id").alias("lo"), F.max("observation_id").alias("hi"))
        .where("lo < hi")
        .select("source_key")
    )
    rows = observations.where("value IS NOT NULL").join(shared, "source_key", "left_semi")
    return agreeing_pairs(to_common_units(rows, segments, contexts, fx), tolerance)
