"""Number cells, display amounts and the named tolerance policies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions.text import clean_cell

# Unit word -> factor, and how far each rounding policy reaches.
UNIT_FACTORS = {"元": 1.0, "千元": 1e3, "万元": 1e4, "百万元": 1e6, "亿元": 1e8}
CURRENCY_UNITS = {"元": "CNY", "千元": "CNY_THOUSAND", "万元": "CNY_TEN_THOUSAND", "百万元": "CNY_MILLION", "亿元": "CNY_HUNDRED_MILLION", "%": "PERCENT"}
EMPTY_CELLS = ("-", "—", "–", "－", "不适用", "N/A", "n/a")
NUMBER = r"^\s*([+-]?)\(?\s*([0-9][0-9,，]*(?:\.[0-9]+)?)\s*\)?\s*(元|千元|万元|百万元|亿元)?\s*(%)?\s*$"


def lookup(x: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(x == k, F.lit(v)).otherwise(out)
    return out


def parse_number(x: Column | str, strict_parity: bool = False) -> Column:
    """FN4: struct(value, unit, ok). Commas off; sign or parentheses negative; percent keeps percent points.

    Full-width parentheses are negative too; with ``strict_parity`` they stay positive, as the reference reads them.
    """
    s = clean_cell(x)
    folded = F.translate(s, "（）", "()")
    negative = (s if strict_parity else folded).startswith("(") & s.rlike("[)）]" if not strict_parity else r"\)")
    matched = folded.rlike(NUMBER) & ~s.isin("", *EMPTY_CELLS)
    number = F.regexp_replace(F.regexp_extract(folded, NUMBER, 2), "[,，]", "").try_cast("double")
    signed = F.when((F.regexp_extract(folded, NUMBER, 1) == "-") | negative, -number).otherwise(number)
    unit = F.when(F.regexp_extract(folded, NUMBER, 4) == "%", "%").otherwise(F.nullif(F.regexp_extract(folded, NUMBER, 3), F.lit("")))
    return F.struct(F.when(matched, signed).alias("value"), F.when(matched, unit).alias("unit"), (matched & number.isNotNull()).alias("ok"))


def is_number_like(x: Column | str) -> Column:
    """FN6."""
    return parse_number(x)["ok"]


def format_amount(x: Column) -> Column:
    """FN5: display text in 亿元, 万元 or 元 with two decimals."""
    return (
        F.when(x.isNull(), "-")
        .when(F.abs(x) >= 1e8, F.concat(F.format_number(x / 1e8, 2), F.lit(" 亿元")))
        .when(F.abs(x) >= 1e4, F.concat(F.format_number(x / 1e4, 2), F.lit(" 万元")))
        .otherwise(F.concat(F.format_number(x, 2), F.lit(" 元")))
    )


def whole_amount(x: Column | str) -> Column:
    """FN40: whole number with commas and ASCII parentheses, else null."""
    s = F.regexp_replace(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), r"[,，\s]", "")
    body = F.regexp_replace(s, r"^\((.*)\)$", "$1").try_cast("long")
    return F.when(s.rlike(r"^\(.*\)$"), -body).otherwise(body)


def join_fragments(fragments: Column | str) -> Column:
    """FN48: fragments of one number cell put together and read: struct(value, unit, ok)."""
    return parse_number(F.array_join(fragments, ""))


def currency_unit(unit: Column) -> Column:
    """PR3."""
    return lookup(unit, CURRENCY_UNITS)


# Tolerances (Q6): one function per policy, each in the scale of its values.
def same_observation(a: Column, b: Column) -> Column:
    """Two readings of one observation: max(1e-8, |b| 1e-10)."""
    return F.abs(a - b) <= F.greatest(F.lit(1e-8), F.abs(b) * 1e-10)


def audit_status(difference: Column, reported: Column) -> Column:
    """RE2: PASS_EXACT, PASS_ROUNDING or WARNING_SUM_MISMATCH."""
    return (
        F.when(F.abs(difference) <= F.greatest(F.lit(1e-8), F.abs(reported) * 1e-12), "PASS_EXACT")
        .when(F.abs(difference) <= F.greatest(F.lit(0.02), F.abs(reported) * 1e-8), "PASS_ROUNDING")
        .otherwise("WARNING_SUM_MISMATCH")
    )


def rounding_tolerance(unit: Column, children: Column, in_yuan: Column) -> Column:
    """FN38: one display unit per child and one for the total; in display scale the number of parts."""
    return F.when(in_yuan, lookup(unit, UNIT_FACTORS, 1.0) * F.greatest(F.lit(1), children + 1)).otherwise(F.greatest(F.lit(1e-8), (children + 1).cast("double")))


def values_close(a: Column, b: Column, unit: Column, children: Column, in_yuan: Column) -> Column:
    """FN39."""
    return F.abs(a - b) <= rounding_tolerance(unit, children, in_yuan)


def block_tolerance(reported: Column) -> Column:
    """RE4: max(1, 0.5 %)."""
    return F.greatest(F.lit(1.0), F.abs(reported) * 0.005)


def note_tolerance(unit: Column, value: Column) -> Column:
    """RE6: max(one display unit, |value| 1e-8)."""
    return F.greatest(lookup(unit, UNIT_FACTORS, 1.0), F.abs(value) * 1e-8)


def value_type_adjustment(kind: Column, units: Column) -> Column:
    """FN16: bonus or penalty where the units of the values fit or contradict a metric's value type."""
    money, percent = F.exists(units, lambda u: u.isin(*UNIT_FACTORS)), F.array_contains(units, "%")
    return F.when((kind == "percentage") & percent, 0.055).when((kind == "percentage") & money, -0.22).when((kind == "monetary") & percent, -0.22).when((kind == "monetary") & money, 0.025).otherwise(0.0)
