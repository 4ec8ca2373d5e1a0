"""Freely typed values to the entry of a reference list they mean."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.lookalike import with_canonical
from tallywright.llm.variants import deletion_variants, simplified, weighted_distance
from tallywright.session import Workspace

UNMATCHED = "UNMATCHED"
# Fixed patterns: wrappers around a typed term, after folding of width and case. Each is removed at its end, repeatedly.
LEADING = (
    r"^[\s\"'“”‘’「」『』《》<>\[\]【】*#:：,，.。、?？!！-]+",
    r"^(?:查询|查找|检索|关于|我要看|请取|提取|请问|问|看看|栏目|其中)[\s:：]*",
    r"^(?:表|附表)\s*\d+[\s:：.、-]*",
    r"^\((?:[一二三四五六七八九十]+|\d+)\)\s*",
    r"^(?:[a-z]|[一二三四五六七八九十]+|\d{1,2})[-、.]\s*",
    r"^(?:19|20)\d\d\s*(?:年\s*(?:度|末|初|\d{1,2}\s*月(?:\s*\d{1,2}\s*日)?)?)?\s*(?=\D)",
)
TRAILING = (
    r"[\s\"'“”‘’「」『』《》<>\[\]【】*#:：,，.。、?？!！%-]+$",
    r"\s*\([^()]*\)$",
    r"\s*注?[\x{2460}-\x{2473}¹²³\x{2070}-\x{2079}]+$",
    r"\s*注\s*\d+$",
    r"(?<=\D)\s*(?:19|20)\d\d(?:年度?)?$",
    r"(?:明细表|构成表|情况表|明细|一览表|汇总表)$",
)
ROUNDS = 3
#: Most reference terms whose symmetric-delete dictionary (37 keys a term at most) is broadcast.
MOST_BROADCAST = 20_000


def core(text: Column | str) -> Column:
    """Typed text without wrappers, blanks and punctuation, in lower-case simplified characters."""
    out = simplified(text)
    for _ in range(ROUNDS):
        for pattern in (*LEADING, *TRAILING):
            out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(out, r"[^\p{L}\p{Nd}]", "")


def allowed_steps(length: int) -> int:
    """Bound of the edit distance by the length of the shorter text: one step below six characters, else two."""
    return 1 if length < 6 else 2


def _may_be_near(a: str, b: str) -> Column:
    """Whether two texts can lie within the bound: a swap of neighbours is two steps of the plain edit distance, so twice the bound loses no pair."""
    return F.when(F.least(F.length(a), F.length(b)) < 6, F.levenshtein(a, b, 2) >= 0).otherwise(F.levenshtein(a, b, 4) >= 0)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys(term: pd.Series) -> pd.Series:
    return term.map(lambda t: deletion_variants(t, allowed_steps(len(t))))


@F.pandas_udf(T.DoubleType())
def _weight(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str, y: str) -> float | None:
        d = weighted_distance(x, y, allowed_steps(min(len(x), len(y))))
        return d and d[1]

    return pd.Series([0.0 if x == y else one(x, y) for x, y in zip(a, b)], dtype="object")


def reference_terms(source_field: str, entries: DataFrame, ref_id: str, name: str, aliases: str, soft: str | None = None, exclude: str | None = None) -> DataFrame:
    """One row per (source_field, term) of a reference list: ref_id, rank (0 name, 1 alias, 2 soft alias, 3 excluded).

    A term listed for several entries or ranks keeps the best rank (then the smallest id); a term that one entry excludes and
    another names therefore stays with the entry that names it.
    """
    def listed(column: str, rank: int) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x: F.struct(x.alias("t"), F.lit(rank).alias("rank")))

    lists = [F.array(F.struct(F.col(name).alias("t"), F.lit(0).alias("rank")))]
    lists += [listed(column, rank) for rank, column in enumerate((aliases, soft, exclude), start=1) if column]
    rows = entries.select(F.col(ref_id).alias("ref_id"), F.explode(F.concat(*lists)).alias("x")).select("ref_id", F.col("x.t").alias("text"), F.col("x.rank").alias("rank"))
    folded = with_canonical(rows.where("text IS NOT NULL")).select("ref_id", "rank", core("canonical").alias("term")).where("term <> ''")
    best = folded.groupBy("term").agg(F.min(F.struct("rank", "ref_id")).alias("m"))
    return best.select(F.lit(source_field).alias("source_field"), "term", F.col("m.ref_id").alias("ref_id"), F.col("m.rank").alias("rank"))


def match_cores(cores: DataFrame, terms: DataFrame) -> DataFrame:
    """Best entry for each distinct (source_field, core): candidates share a symmetric-delete key and lie within the edit bound.

    Ranked by weighted distance, then name/alias before excluded, then how often the entry's own name is typed, then id.
    ``cores`` needs (source_field, core, n). An excluded term that is strictly nearest gives UNMATCHED, as does no candidate.
    """
    frequency = terms.join(cores.withColumnRenamed("core", "term"), ["source_field", "term"]).groupBy("source_field", "ref_id").agg(F.sum("n").alias("frequency"))
    keyed = terms.join(frequency, ["source_field", "ref_id"], "left").select("source_field", "term", "ref_id", "rank", F.coalesce("frequency", F.lit(0)).alias("frequency"))
    bound = terms.agg(F.max(F.length("term")).alias("longest"), F.count("*").alias("n")).first()
    longest = (bound.longest or 0) + 2  # longer texts cannot lie within two steps of any term
    dictionary = keyed.select("*", F.explode(_keys("term")).alias("key"))
    if bound.n <= MOST_BROADCAST:  # else the two sides meet by a shuffle
        dictionary = F.broadcast(dictionary)
    probes = cores.where((F.length("core") > 0) & (F.length("core") <= longest)).select("source_field", "core", F.explode(_keys("core")).alias("key"))
    near = probes.join(dictionary, ["source_field", "key"]).where(F.abs(F.length("core") - F.length("term")) <= 2).where(_may_be_near("core", "term"))
    tasks = int(cores.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but many distances: spread by hand, not by size
    spread = near.select("source_field", "core", "term", "ref_id", "rank", "frequency").distinct().repartition(tasks, "core", "term")
    weight = _weight.asNondeterministic()  # keeps the null filter from pulling the distance below the spread, where it would run in one task
    pairs = spread.withColumn("weight", weight("core", "term")).where("weight IS NOT NULL")
    order = Window.partitionBy("source_field", "core").orderBy("weight", "rank", F.desc("frequency"), "ref_id")
    best = pairs.withColumn("place", F.row_number().over(order)).where("place = 1")
    return best.select("source_field", "core", F.when(F.col("rank") == 3, UNMATCHED).otherwise(F.col("ref_id")).alias("ref_id"), "weight", "rank")


def match_records(records: DataFrame, terms: DataFrame, names: DataFrame) -> DataFrame:
    """(source_field, record_id, text, ref_id, weight) for records whose text is not null and not itself a name of its list.

    ``records``: source_field, record_id, text. ``names``: source_field, text. Distinct texts are folded and matched once, so a
    text that fills a third of the table costs one look-up; the way back is an equi-join that adaptive execution splits.
    Empty text and text of blanks or punctuation only is UNMATCHED; repeated records stay repeated.
    """
    open_ = records.where("text IS NOT NULL").join(names.select("source_field", "text").distinct(), ["source_field", "text"], "left_anti")
    ws = Workspace(records.sparkSession, "entries")
    counts = ws.save(records.where("text IS NOT NULL").groupBy("source_field", "text").agg(F.count("*").alias("n")))
    folded = ws.save(with_canonical(counts).select("source_field", "text", "n", core("canonical").alias("core")))
    cores = folded.groupBy("source_field", "core").agg(F.sum("n").alias("n"))
    matched = ws.save(match_cores(cores, ws.save(terms)))
    by_text = folded.join(matched, ["source_field", "core"], "left").select("source_field", "text", F.coalesce("ref_id", F.lit(UNMATCHED)).alias("ref_id"), "weight")
    return open_.join(by_text, ["source_field", "text"], "left").select("source_field", "record_id", "text", "ref_id", "weight")


def typed_fields(captures: DataFrame, columns: DataFrame, metrics: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, terms, names) of the two typed fields with their reference lists."""
    records = captures.select(F.lit("table_query").alias("source_field"), F.col("capture_id").alias("record_id"), F.col("table_query").alias("text")).unionByName(
        columns.select(F.lit("header_raw").alias("source_field"), F.col("column_id").alias("record_id"), F.col("header_raw").alias("text"))
    )
    terms = reference_terms("table_query", metrics, "metric_id", "canonical_name", "aliases", "soft_aliases", "exclude").unionByName(
        reference_terms("header_raw", labels, "label_id", "canonical_label", "aliases")
    )
    names = metrics.select(F.lit("table_query").alias("source_field"), F.col("canonical_name").alias("text")).unionByName(
        labels.select(F.lit("header_raw").alias("source_field"), F.col("canonical_label").alias("text"))
    )
    return records, terms, names
