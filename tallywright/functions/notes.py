"""Note references and Chinese numerals, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = ("零〇一二三四五六七八九", "00123456789")
NUMERAL = "[零〇一二三四五六七八九十百]{1,5}"


def let(x: Column, body) -> Column:
    """Bind an expression to a variable, so that ``body`` may use it often while it is computed and compiled once."""
    return F.element_at(F.transform(F.array(x), body), 1)


def _digit(x: Column, missing: int) -> Column:
    """Value of one numeral digit; ``missing`` for anything else."""
    d = F.translate(x, *DIGITS)
    return F.when(x.rlike("^[零〇一二三四五六七八九]$"), d.try_cast("int")).otherwise(F.lit(missing))


def _below_hundred(x: Column) -> Column:
    left, right = F.substring_index(x, "十", 1), F.regexp_replace(x, "^[^十]*十", "")
    tens = F.when(left == "", 1).otherwise(_digit(left, 1))
    ones = F.when(right == "", 0).otherwise(_digit(right, 0))
    return (
        F.when(x.rlike(r"^\d+$"), x.try_cast("int"))
        .when(x.contains("十"), tens * 10 + ones)
        .when(x.rlike("^[零〇一二三四五六七八九]+$"), F.translate(x, *DIGITS).try_cast("int"))
    )


def chinese_number(x: Column | str) -> Column:
    """FN28: 0 to 999 from digits or numerals, else null."""

    def number(t: Column) -> Column:
        left = F.substring_index(t, "百", 1)
        hundreds = let(F.regexp_replace(t, "^[^百]*百", ""), lambda right: _digit(left, 1) * 100 + F.coalesce(F.when(right == "", 0).otherwise(_below_hundred(right)), F.lit(0)))
        return F.when(t.contains("百"), hundreds).otherwise(_below_hundred(t))

    return let(F.trim(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))), number)


def note_ordinal(x: Column | str) -> Column:
    """FN29: last number of the last part of a reference such as 附注八-9 or （十）, else null."""
    s = F.trim(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))
    tail = F.regexp_extract(s, "([^-—–/]*)$", 1)
    found = F.regexp_extract_all(tail, F.lit(r"(\d{1,3}|" + NUMERAL + ")"), 1)
    return chinese_number(F.try_element_at(found, F.lit(-1)))


def note_reference(x: Column | str) -> Column:
    """FN31: struct(section, ordinal); both empty where the text is no reference."""
    s = F.regexp_replace(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), r"\s+", "")
    body = F.regexp_replace(s, "^(?:附注|注)", "")
    pattern = r"^([一二三四五六七八九十\d]+)[-、.．]([一二三四五六七八九十\d]+)$"
    section = F.regexp_extract(body, pattern, 1)
    ordinal = F.when(section != "", chinese_number(F.regexp_extract(body, pattern, 2))).when(body.rlike(r"^[一二三四五六七八九十\d]+$"), chinese_number(body))
    return F.struct(section.alias("section"), ordinal.alias("ordinal"))


def peer_heading(x: Column | str) -> Column:
    """FN30: struct(ordinal, title) of a numbered heading, else null: term bands and amounts are no headings."""
    pattern = r"^[（(]?(\d{1,3}|" + NUMERAL + r")[）)]?(?:[.．、:：])?(.+?)$"

    def heading(s: Column) -> Column:
        band = s.rlike(r"^\d+(?:个)?(?:月|日|天|年)(?:至|到|以上|以内|以下|—|–|-)")
        parts = F.when(s.rlike(pattern) & ~band, F.struct(chinese_number(F.regexp_extract(s, pattern, 1)).alias("ordinal"), F.regexp_extract(s, pattern, 2).alias("title")))
        amount = lambda title: title.rlike(r"(?i)^[+\-−(（]?\d|^(?:人民币|RMB|USD)\d")
        return let(parts, lambda h: F.when(h["ordinal"].isNotNull() & h["title"].rlike(r"[A-Za-z\x{4E00}-\x{9FFF}]") & ~amount(h["title"]), h))

    return let(F.regexp_replace(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), r"\s+", ""), heading)


def compose_reference(header: Column, value: Column) -> Column:
    """FN32: full reference of a row from the section in its column header and its own number; struct(reference, status)."""
    own, head = note_reference(value), note_reference(header)
    section = F.regexp_extract(F.regexp_replace(F.coalesce(header, F.lit("")), r"\s+", ""), r"^(?:附注|注)([一二三四五六七八九十\d]+)", 1)
    return (
        F.when(own["ordinal"].isNull(), F.struct(F.lit(None).cast("string").alias("reference"), F.lit("NO_REFERENCE").alias("status")))
        .when(own["section"] != "", F.struct(F.concat(F.lit("附注"), own["section"], F.lit("-"), own["ordinal"].cast("string")).alias("reference"), F.lit("EXPLICIT").alias("status")))
        .when(section != "", F.struct(F.concat(F.lit("附注"), section, F.lit("-"), own["ordinal"].cast("string")).alias("reference"), F.lit("COMPOSED").alias("status")))
        .otherwise(F.struct(own["ordinal"].cast("string").alias("reference"), F.lit("SECTION_UNKNOWN").alias("status")))
    )


def note_reference_key(x: Column | str) -> Column:
    """FN33: struct(raw, normalized, section, item, confidence): the last two numbers of a reference are section and item; 附注八-9 and 八、9 share both.
    Without a number all but raw are empty and confidence is NONE."""
    raw = F.trim(F.translate(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), "（）－０１２３４５６７８９", "()-0123456789"))
    found = F.filter(F.transform(F.regexp_extract_all(raw, F.lit(r"([一二三四五六七八九十百]+|\d+)"), 1), chinese_number), lambda n: n.isNotNull() & (n > 0))

    def key(numbers: Column) -> Column:
        item, section = F.try_element_at(numbers, F.lit(-1)), F.try_element_at(numbers, F.lit(-2))
        shown = F.when(section.isNotNull(), F.concat(F.lit("附注"), section.cast("string"), F.lit("-"), item.cast("string"))).when(item.isNotNull(), F.concat(F.lit("附注"), item.cast("string"))).otherwise("")
        return F.struct(raw.alias("raw"), shown.alias("normalized"), section.alias("section"), item.alias("item"), F.when(item.isNotNull(), "HIGH").otherwise("NONE").alias("confidence"))

    return let(found, key)
