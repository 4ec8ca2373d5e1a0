"""One canonical form for texts that look equal but differ in their characters."""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.session import Workspace

# Letters of other alphabets -> Latin letters of the same shape.
CYRILLIC = ("АВЕКМНОРСТУХЅІЈӀԚԜԌ", "ABEKMHOPCTYXSIJIQWG")
CYRILLIC_SMALL = ("аеорсухѕіјһӏԁԛԝ", "aeopcyxsijhldqw")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονϲ", "ABEZHIKMNOPTYXCjovc")
OTHER_LETTERS = ("ɡɑօǀ", "gao|")
# Signs of the same shape.
DASHES = ("‐‑‒–—―−﹘﹣⁃˗", "-")
COMMAS = ("‚", ",")
FULL_STOPS = ("․", ".")
COLONS = ("∶꞉ː", ":")
SLASHES = ("⁄∕⧸", "/")
MIDDLE_DOTS = ("‧・∙⋅", "·")
# CJK radicals that have no compatibility mapping of their own -> ideograph of the same shape.
RADICALS = (
    "⺁⺂⺃⺄⺅⺆⺈⺉⺊⺋⺌⺎⺏⺐⺒⺓⺔⺖⺗⺘⺙⺛⺝⺞⺠⺡⺢⺣⺤⺦⺧⺨⺩⺪⺫⺬⺭⺮⺯⺰⺱⺲⺶⺹⺺⺻⺼⺽⺾⻁⻂⻃⻄⻅⻆⻈⻉⻋⻌⻏⻐⻑⻒⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲",
    "厂乛乚乙亻冂刀刂卜㔾小兀尣尢巳幺彑忄㣺扌攵旡月歺民氵氺灬爫丬牛犭王疋罒示礻竹糹纟罓罒羊耂肀聿肉臼艹虎衤覀西见角讠贝车辶邑钅長镸长门阜阝雨青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀",
)
#: Compatibility kinds that change the look of a character and therefore stay.
KEPT_KINDS = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")
#: Invisible characters that the categories Cf and Cc do not cover.
EXTRA_HIDDEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Texts made only of these need no look-up: ASCII, common ideographs, Hangul syllables.
PLAIN = r"^[ -~\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]*$"
#: Signs that may combine with the one before them or be reordered: marks, conjoining jamo, half-width sound marks.
COMBINING = r"[\p{M}\x{1100}-\x{11FF}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}\x{FF9E}\x{FF9F}]"
# Numbers of leading consonants, vowels and final consonants of Hangul (the last with the empty one), and their first characters.
HANGUL_L, HANGUL_V, HANGUL_T = 19, 21, 28
FIRST_L, FIRST_V, FIRST_T, FIRST_SYLLABLE = 0x1100, 0x1161, 0x11A7, 0xAC00


@functools.cache
def _shapes() -> dict[str, str]:
    table: dict[str, str] = {}
    for source, target in (CYRILLIC, CYRILLIC_SMALL, GREEK, OTHER_LETTERS, RADICALS):
        assert len(source) == len(target), (len(source), len(target))
        table.update(zip(source, target))
    for source, target in (DASHES, COMMAS, FULL_STOPS, COLONS, SLASHES, MIDDLE_DOTS):
        table.update(dict.fromkeys(source, target))
    return table


def _decompose(ch: str) -> str:
    """Full decomposition of one character without the kinds that change its look."""
    raw = unicodedata.decomposition(ch)
    if not raw or 0x3131 <= ord(ch) <= 0x318E:  # letters of Hangul that stand alone do not look like parts of a syllable
        return ch
    parts = raw.split()
    if parts[0].startswith("<"):
        kind, parts = parts[0], parts[1:]
        if kind in KEPT_KINDS or (parts[0] == "0020" and len(parts) > 1):  # spacing accents stay as they are
            return ch
    return "".join(_decompose(chr(int(p, 16))) for p in parts)


@functools.cache
def mapping_entries() -> tuple[tuple[str, tuple[tuple[str, int], ...]], ...]:
    """(character, ((piece, combining class), ...)) for every character that changes or combines; from the Unicode database."""
    shapes, out = _shapes(), []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0x4E00 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xF8FF or 0x20000 <= cp <= 0x2F7FF or 0x30000 <= cp <= 0xE00FF or cp >= 0xF0000:
            continue
        ch = chr(cp)
        category = unicodedata.category(ch)
        if category in ("Cf", "Cc") and cp != 0x85 or cp in EXTRA_HIDDEN:
            out.append((ch, ()))
            continue
        if category in ("Zs", "Zl", "Zp") or cp == 0x85:
            out.append((ch, ((" ", 0),)))
            continue
        pieces = "".join(shapes.get(c, c) for c in _decompose(ch))
        marks = tuple((c, unicodedata.combining(c)) for c in pieces)
        if pieces != ch or marks[0][1]:
            out.append((ch, marks))
    out += [(c, ((" ", 0),)) for c in "\t\n\r\v\f"]
    out += [(chr(c), ()) for c in [*range(0x09), *range(0x0E, 0x20), 0x7F]]
    return tuple(out)


@functools.cache
def compositions() -> dict[str, str]:
    """Two characters that compose -> the character they compose to, from the Unicode database; Hangul follows from its numbers instead."""
    out = {}
    for cp in range(0xC0, sys.maxunicode + 1):
        raw = unicodedata.decomposition(chr(cp)) if not 0xAC00 <= cp <= 0xD7A3 else ""
        if raw and not raw.startswith("<") and " " in raw:
            pair = "".join(chr(int(p, 16)) for p in raw.split())
            if unicodedata.normalize("NFC", pair) == chr(cp):  # excluded ones do not compose
                out[pair] = chr(cp)
    return out


_PIECES = T.ArrayType(T.StructType().add("ch", "string", False).add("ccc", "integer", False), False)


_SAVED: dict[str, DataFrame] = {}


def mapping_table(spark: SparkSession) -> DataFrame:
    """Decomposition and look-alike table; its size is fixed by the Unicode database (about 7,000 rows), so it may be broadcast.

    It is written to the shared folder once per application: plans then hold a path instead of the rows.
    """
    app = spark.sparkContext.applicationId
    if app not in _SAVED or not Workspace.holds(_SAVED[app]):
        _SAVED[app] = Workspace(spark, "lookalikes", lasting=True).save(_mapping_rows(spark).coalesce(1))
    return _SAVED[app]


def _mapping_rows(spark: SparkSession) -> DataFrame:
    entries = mapping_entries()
    rows = pd.DataFrame(
        {
            "ch": [c for c, _ in entries],
            "pieces": [[{"ch": a, "ccc": b} for a, b in p] for _, p in entries],
            "whole": [unicodedata.normalize("NFC", "".join(a for a, _ in p)) for _, p in entries],
        }
    )
    return spark.createDataFrame(rows, T.StructType().add("ch", "string").add("pieces", _PIECES).add("whole", "string"))


def _code(x: Column) -> Column:
    return F.ascii(x)


def _character(code: Column) -> Column:
    """The character of the basic plane with this number."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")


def _hangul(starter: Column, ch: Column) -> Column:
    """Syllable of a leading consonant and a vowel, or of a syllable without final consonant and one; else null."""
    a, b = _code(starter), _code(ch)
    lead = a.between(FIRST_L, FIRST_L + HANGUL_L - 1) & b.between(FIRST_V, FIRST_V + HANGUL_V - 1)
    tail = a.between(FIRST_SYLLABLE, FIRST_SYLLABLE + HANGUL_L * HANGUL_V * HANGUL_T - 1) & ((a - FIRST_SYLLABLE) % HANGUL_T == 0) & b.between(FIRST_T + 1, FIRST_T + HANGUL_T - 1)
    return F.when(lead, _character(((a - FIRST_L) * HANGUL_V + (b - FIRST_V)) * HANGUL_T + FIRST_SYLLABLE)).when(tail, _character(a + b - FIRST_T))


def _composed(pieces: Column, table: Column) -> Column:
    """Canonical composition of one stretch: ``pieces`` are its characters with their classes in order, ``table`` the compositions.

    A character composes with the starter unless one between them has its class or a greater one, or is a starter itself. What does not compose stays
    behind the starter; a starter that does not compose begins anew.
    """
    text = lambda s: F.concat(s["done"], s["starter"], s["rest"])

    def step(state: Column, piece: Column) -> Column:
        free = (state["rest"] == "") | ((state["ccc"] < piece["ccc"]) & (state["ccc"] > 0))
        pair = F.when(free, F.coalesce(F.try_element_at(table, F.concat(state["starter"], piece["ch"])), _hangul(state["starter"], piece["ch"])))
        new = lambda done, starter, rest, ccc: F.struct(done.alias("done"), starter.alias("starter"), rest.alias("rest"), ccc.alias("ccc"))
        return (
            F.when(pair.isNotNull(), new(state["done"], pair, state["rest"], state["ccc"]))
            .when(piece["ccc"] == 0, new(text(state), piece["ch"], F.lit(""), F.lit(0)))
            .otherwise(new(state["done"], state["starter"], F.concat(state["rest"], piece["ch"]), piece["ccc"]))
        )

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), F.lit("").alias("rest"), F.lit(0).alias("ccc"))
    return F.aggregate(pieces, start, step, text)


def canonical_texts(texts: DataFrame, column: str = "text") -> DataFrame:
    """Distinct non-null texts of ``column`` with their canonical form: (text, canonical).

    Plain texts only have their blanks squeezed. All others are exploded to positioned code points, which meet the broadcast mapping, and are rebuilt in
    position order: one shuffle by text. Texts with signs that combine are cut into stretches first: marks are ordered by combining class behind
    their starter, stretches of more than one character are recomposed with the broadcast composition table, and the text is put together again.
    Runs of blanks become one, blanks at the ends go. Empty text and text of hidden characters only give ''.
    """
    distinct = texts.select(F.col(column).alias("text")).where("text IS NOT NULL").distinct()
    plain = distinct.where(F.col("text").rlike(PLAIN)).select("text", _squeezed("text").alias("canonical"))
    return plain.unionByName(_looked_up(distinct))


def _squeezed(text: str) -> Column:
    return F.trim(F.regexp_replace(text, " +", " "))


def _looked_up(distinct: DataFrame) -> DataFrame:
    """canonical_texts of those among distinct texts that are not plain."""
    spark = distinct.sparkSession
    other = distinct.where(~F.col("text").rlike(PLAIN)).withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit("#"), "text")).withColumn("combining", F.col("text").rlike(COMBINING))
    table = F.broadcast(mapping_table(spark))

    def points(x: DataFrame) -> DataFrame:
        return x.select("k1", "k2", F.posexplode(F.split("text", "")).alias("pos", "ch")).join(table, "ch", "left")

    def rebuilt(x: DataFrame, order: str, piece: str) -> DataFrame:
        sorted_ = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(piece).alias("p"))))
        return x.groupBy("k1", "k2").agg(F.array_join(F.transform(sorted_, lambda v: v["p"]), "").alias("canonical"))

    simple = rebuilt(points(other.where("NOT combining")).withColumn("whole", F.coalesce("whole", "ch")), "pos", "whole")
    pieces = points(other.where("combining")).select("k1", "k2", "pos", F.posexplode(F.coalesce("pieces", F.array(F.struct(F.col("ch"), F.lit(0).alias("ccc"))))).alias("sub", "p"))
    by_text = Window.partitionBy("k1", "k2").orderBy("pos", "sub")
    glued = F.col("p.ch").rlike(r"^[\p{M}\x{1160}-\x{11FF}\x{D7B0}-\x{D7FF}]")  # a starter that may compose with the one before it
    placed = pieces.select("k1", "k2", "pos", "sub", "p", F.sum((F.col("p.ccc") == 0).cast("int")).over(by_text).alias("seg"), F.sum((~glued).cast("int")).over(by_text).alias("stretch"))
    stretches = placed.groupBy("k1", "k2", "stretch").agg(F.sort_array(F.collect_list(F.struct("seg", F.col("p.ccc").alias("ccc"), "pos", "sub", F.col("p.ch").alias("ch")))).alias("cs"))
    joined = stretches.join(F.broadcast(_composition_row(spark)))  # one row
    composed = joined.select("k1", "k2", "stretch", F.when(F.size("cs") > 1, _composed(F.col("cs"), F.col("compositions"))).otherwise(F.col("cs")[0]["ch"]).alias("s"))
    forms = simple.unionByName(rebuilt(composed, "stretch", "s"))
    return other.select("text", "k1", "k2").join(forms, ["k1", "k2"], "left").select("text", F.coalesce("canonical", F.lit("")).alias("canonical")).withColumn("canonical", _squeezed("canonical"))


def _composition_row(spark: SparkSession) -> DataFrame:
    """The composition table (about 1,000 pairs, fixed by the Unicode database) as one map; like the mapping it is written once per application."""
    key = spark.sparkContext.applicationId + "/compositions"
    if key not in _SAVED or not Workspace.holds(_SAVED[key]):
        one = spark.createDataFrame(pd.DataFrame({"compositions": [list(compositions().items())]}), T.StructType().add("compositions", T.ArrayType(T.StructType().add("pair", "string").add("ch", "string"))))
        _SAVED[key] = Workspace(spark, "compositions", lasting=True).save(one.select(F.map_from_entries("compositions").alias("compositions")).coalesce(1))
    return _SAVED[key]


def with_canonical(records: DataFrame, column: str = "text", out: str = "canonical") -> DataFrame:
    """``records`` with the canonical form of ``column``; null stays null. Plain texts take no part in the look-up join."""
    plain = F.col(column).isNull() | F.col(column).rlike(PLAIN)
    simple = records.where(plain).withColumn(out, _squeezed(column))
    rest = records.where(~plain)
    forms = _looked_up(rest.select(F.col(column).alias("text")).distinct()).select(F.col("text").alias("__text"), F.col("canonical").alias(out))
    return simple.unionByName(rest.join(forms, F.col(column) == F.col("__text")).drop("__text"))


def equal_looking_pairs(records: DataFrame) -> DataFrame:
    """Pairs of records that look the same but differ in characters, from (source_field, scope, record_id, text).

    Records meet inside one source_field and scope; a scope with one text only (scope '' means the whole field) is set aside before anything is
    exploded, which loses no pair. Equal texts are one class: classes of one canonical form are paired and
    only pairs of different texts expanded to their records, so copies of one text never meet each other. Null texts and
    texts without a visible sign take no part.
    """
    group = ["source_field", "scope", "canonical"]
    usable = records.where("record_id IS NOT NULL AND text IS NOT NULL").select("source_field", "scope", "record_id", "text")
    several = usable.where("scope <> ''").groupBy("source_field", "scope").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select("source_field", "scope")
    meeting = usable.where("scope <> ''").join(several, ["source_field", "scope"], "left_semi").unionByName(usable.where("scope = ''"))
    meeting = Workspace(records.sparkSession, "meeting").save(meeting)  # read several times below
    rows = Workspace(records.sparkSession, "canonical").save(with_canonical(meeting).where("canonical <> ''").select(*group, "text", "record_id").distinct())
    mixed = rows.groupBy(*group).agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select(*group)
    kept = Workspace(records.sparkSession, "equal-looking").save(rows.join(mixed, group, "left_semi"))
    classes = kept.select(*group, "text").distinct()
    pairs = classes.withColumnRenamed("text", "text_a").join(classes.withColumnRenamed("text", "text_b"), group).where("text_a < text_b")
    full = pairs.join(kept.select(*group, F.col("text").alias("text_a"), F.col("record_id").alias("x")), [*group, "text_a"]).join(
        kept.select(*group, F.col("text").alias("text_b"), F.col("record_id").alias("y")), [*group, "text_b"]
    )
    return full.where("x <> y").select("source_field", F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b")).distinct()


def comparable_records(assets: DataFrame, columns: DataFrame, tokens: DataFrame) -> DataFrame:
    """The three fields as (source_field, scope, record_id, text): titles everywhere, headings of one capture column, readings of one cell."""
    titles = assets.select(F.lit("display_name").alias("source_field"), F.lit("").alias("scope"), F.col("pdf_id").alias("record_id"), F.col("display_name").alias("text"))
    headings = columns.where("capture_id IS NOT NULL AND ordinal IS NOT NULL").select(
        F.lit("header_raw").alias("source_field"), F.concat_ws("|", "capture_id", "ordinal").alias("scope"), F.col("column_id").alias("record_id"), F.col("header_raw").alias("text")
    )
    readings = tokens.where("capture_id IS NOT NULL AND row_order IS NOT NULL AND column_ordinal IS NOT NULL").select(
        F.lit("raw_numeric_tokens").alias("source_field"),
        F.concat_ws("|", "capture_id", "row_order", "column_ordinal").alias("scope"),
        F.col("token_id").alias("record_id"),
        F.array_join("raw_numeric_tokens", "").alias("text"),
    )
    return titles.unionByName(headings).unionByName(readings)
