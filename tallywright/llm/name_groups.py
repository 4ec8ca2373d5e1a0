"""Spellings of organisation names grouped by organisation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.lookalike import with_canonical
from tallywright.llm.variants import simplified, weighted_distance
from tallywright.session import Workspace

# Words of a company name that say its legal form, and words that say its line of business.
LEGAL_ZH = ("集团股份有限公司", "股份有限公司", "有限责任公司", "集团有限公司", "有限公司")
LINES_ZH = {
    "人寿保险": "life", "人寿": "life", "寿险": "life", "人身": "life",
    "财产保险": "property", "财产险": "property", "财产": "property", "财险": "property", "财物": "property",
    "健康保险": "health", "健康险": "health", "健康": "health", "医护": "health",
    "养老保险": "pension", "养老险": "pension", "养老": "pension", "年金": "pension",
    "再保险": "reinsurance", "再保": "reinsurance", "分保": "reinsurance", "转分": "reinsurance",
}
LEGAL_EN = ("limited", "ltd", "public", "company", "plc", "incorporated", "inc", "co", "corp", "corporation", "holdings", "holding", "hldgs", "group", "the", "and", "sa", "ag")
LINES_EN = {
    "life": "life", "general": "general", "marine": "casualty", "casualty": "casualty", "reinsurance": "reinsurance", "re": "reinsurance", "mutual": "mutual",
    "health": "health", "pension": "pension", "property": "property", "assurance": None, "assce": None, "insurance": None, "ins": None,
}
ALIAS_MARK = "系"


def _near(text: str, word: str) -> tuple[int, int] | None:
    """Place of the closest piece of ``text`` within one step of ``word`` (two from eight characters on); a piece may be one
    character longer or shorter only where the word has six or more."""
    most, slack, best = (2 if len(word) >= 8 else 1), int(len(word) >= 6), None
    for size in range(len(word) - slack, len(word) + slack + 1):
        for i in range(len(text) - size + 1):
            d = weighted_distance(text[i : i + size], word, most)
            if d and (best is None or (d[0], abs(size - len(word))) < best[0]):
                best = ((d[0], abs(size - len(word))), (i, i + size))
    return best and best[1]


def _split_zh(name: str) -> tuple[str, str | None]:
    rest = re.sub(r"[^\w]", "", name)
    for word in LEGAL_ZH:
        if word in rest:
            rest = rest.replace(word, "|", 1)
            break
    else:
        for word in LEGAL_ZH:
            place = _near(rest, word) if len(rest) > len(word) + 1 else None
            if place:
                rest = rest[: place[0]] + "|" + rest[place[1] :]
                break
    line = None
    for word, kind in LINES_ZH.items():
        if word in rest:
            line, rest = kind, rest.replace(word, "|", 1)
            break
    else:
        for word, kind in LINES_ZH.items():
            place = _near(rest, word) if len(word) >= 4 and len(rest) > len(word) else None
            if place:
                line, rest = kind, rest[: place[0]] + "|" + rest[place[1] :]
                break
    rest = re.sub(r"保险公司|保险|公司|集团", "", rest)
    return rest.replace("|", ""), line


def _split_en(name: str) -> tuple[str, str | None]:
    root, line = [], None
    for token in re.findall(r"[a-z0-9]+", name):
        if token in LEGAL_EN:
            continue
        if token in LINES_EN:
            line = line or LINES_EN[token]
            continue
        close = [(d[0], w) for w in (*LINES_EN, *LEGAL_EN) if len(w) >= 4 and (d := weighted_distance(token, w, 2 if len(w) >= 8 else 1))] if len(token) >= 4 else []
        if close:
            line = line or LINES_EN.get(min(close)[1])
        else:
            root.append(token)
    return "".join(root), line


def split_name(name: str) -> tuple[str, str | None]:
    """(distinguishing part, line of business or None) of a folded company name; a name of generic words only keeps its letters."""
    root, line = _split_zh(name) if re.search(r"[一-鿿]", name) else _split_en(name)
    return root or re.sub(r"[\W_]", "", name), line


@F.pandas_udf(T.StructType().add("root", "string").add("line", "string"))
def _split(name: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_name(n) for n in name], columns=["root", "line"])


def ngrams(root: str) -> list[str]:
    """Characters and character pairs of ideographic names, runs of three and four letters of others, with a mark at the start."""
    marked = "^" + root
    sizes = (1, 2) if re.search(r"[一-鿿]", root) else (3, 4)
    return sorted({marked[i : i + n] for n in sizes for i in range(len(marked) - n + 1)} - {"^"})


@F.pandas_udf(T.ArrayType(T.StringType()))
def _grams(root: pd.Series) -> pd.Series:
    return root.map(ngrams)


def spellings(assets: DataFrame, captures: DataFrame) -> DataFrame:
    """Distinct non-blank spellings with their number of records: (name, n)."""
    every = assets.select(F.col("company").alias("name")).unionByName(captures.select(F.col("company").alias("name")))
    return every.where("trim(name) <> ''").groupBy("name").agg(F.count("*").alias("n"))


def shared_documents(assets: DataFrame, captures: DataFrame) -> DataFrame:
    """Ordered pairs of different spellings that name the issuer of one file: an asset with its captures, an asset with its copies."""
    owner = assets.where("company IS NOT NULL")
    on_file = captures.where("company IS NOT NULL AND pdf_id IS NOT NULL").select("pdf_id", F.col("company").alias("y")).distinct()
    by_capture = on_file.join(owner.where("pdf_id IS NOT NULL").select("pdf_id", F.col("company").alias("x")).distinct(), "pdf_id").select("x", "y")
    copies = owner.where("sha256 IS NOT NULL").select("sha256", F.col("company").alias("y")).distinct()
    by_copy = copies.join(owner.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("company").alias("x")), "sha256").select("x", "y")
    one_way = by_capture.unionByName(by_copy).where("x <> y").groupBy("x", "y").agg(F.count("*").alias("k"))
    return one_way.unionByName(one_way.select(F.col("y").alias("x"), F.col("x").alias("y"), "k")).groupBy("x", "y").agg(F.sum("k").alias("k"))


def _winner(votes: DataFrame, key: list[str], value: str) -> DataFrame:
    """Most voted value per key; ties go to the longest, then the smallest value."""
    total = votes.groupBy(*key, value).agg(F.sum("k").alias("k"))
    return total.groupBy(*key).agg(F.min(F.struct((-F.col("k")).alias("k"), (-F.length(value)).alias("l"), F.col(value).alias("v"))).alias("m")).select(*key, F.col("m.v").alias(value + "_voted"))


def name_forms(names: DataFrame, links: DataFrame, ws: Workspace) -> DataFrame:
    """Spellings with the form that is compared: (name, n, root, line).

    The form is what remains without legal words, with the line of business as its own field. Two things a spelling may lack are
    taken from spellings on the same files: the line of a bare name, and the distinguishing part behind a nickname
    (marked by its suffix), both by majority. What is still missing stays open: line '' or the nickname itself.
    """
    folded = with_canonical(names.select("name", "n", F.col("name").alias("text"))).select("name", "n", _split(simplified("canonical")).alias("s"))
    parts = ws.save(folded.select("name", "n", F.col("s.root").alias("root"), F.col("s.line").alias("line")))
    other = parts.select(F.col("name").alias("y"), F.col("root").alias("y_root"), F.col("line").alias("y_line"))
    around = ws.save(links.join(parts.select(F.col("name").alias("x"), F.col("root").alias("x_root"), F.col("line").alias("x_line")), "x").join(other, "y"))
    alias = F.col("root").endswith(ALIAS_MARK)
    real = _winner(around.where(F.col("x_root").endswith(ALIAS_MARK) & ~F.col("y_root").endswith(ALIAS_MARK)).select(F.col("x_root").alias("root"), F.col("y_root"), "k"), ["root"], "y_root")
    lines = _winner(around.where("x_line IS NULL AND y_line IS NOT NULL").select(F.col("x").alias("name"), "y_line", "k"), ["name"], "y_line")
    done = parts.join(real, "root", "left").join(lines, "name", "left").select(
        "name", "n", F.when(alias, F.coalesce("y_root_voted", "root")).otherwise(F.col("root")).alias("root"), F.coalesce("line", "y_line_voted").alias("line")
    )
    sole = done.where("line IS NOT NULL").groupBy("root").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo = hi").select("root", "lo")
    return done.join(sole, "root", "left").select("name", "n", "root", F.coalesce("line", "lo", F.lit("")).alias("line"))


def similar_forms(forms: DataFrame, least: float, ws: Workspace) -> DataFrame:
    """Pairs of forms (a < b) of one line of business with cosine of weighted n-gram vectors >= ``least``: (a, b, cosine).

    Weights are 1 + ln(N / df) over all forms. Candidates share an n-gram of both prefixes: a vector's prefix holds its rarest
    n-grams up to the point where the rest alone could not reach ``least``, which loses no pair. Partners are not capped at
    a top n, because a cap would lose links; the threshold bounds them instead.
    """
    grams = forms.select("form", "line", F.explode(_grams("root")).alias("gram"))
    total = forms.count()
    df = grams.groupBy("gram").agg(F.count("*").alias("df"))
    weighted = grams.join(df, "gram").select("form", "line", "gram", "df", (1 + F.log(F.lit(float(max(total, 1))) / F.col("df"))).alias("w"))
    norm = Window.partitionBy("form")
    rest = Window.partitionBy("form").orderBy(F.desc("df"), F.desc("gram")).rowsBetween(Window.unboundedPreceding, 0)
    unit = weighted.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(norm)))
    vectors = ws.save(unit.withColumn("rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest))))
    prefix = vectors.where(F.col("rest") >= least - 1e-9)
    left = prefix.select("line", "gram", F.col("form").alias("a"))
    pairs = left.join(prefix.select("line", "gram", F.col("form").alias("b")), ["line", "gram"]).where("a < b").select("a", "b").distinct()
    dot = (
        pairs.join(vectors.select(F.col("form").alias("a"), "gram", F.col("w").alias("wa")), "a")
        .join(vectors.select(F.col("form").alias("b"), "gram", F.col("w").alias("wb")), ["b", "gram"])
        .groupBy("a", "b")
        .agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    )
    return dot.where(F.col("cosine") >= least)


def average_linkage(nodes: DataFrame, edges: DataFrame, threshold: float, ws: Workspace) -> DataFrame:
    """Average-linkage groups of weighted nodes (id, n) under similarities (a, b, cosine); (id, cluster).

    Reciprocal nearest neighbours merge in rounds until no pair averages ``threshold``. Average linkage is reducible: merging two nearest neighbours never brings
    a third group nearer than it was to one of them, so the order of such merges does not matter except between equal averages, where the smaller id
    is taken. Pairs without an edge count as similarity 0. A round is two aggregates over the remaining edges and two joins with the few
    groups that merged; no group is ever gathered in one task. Merges are kept as links old -> new, each group has one, and pointer doubling follows
    them at the end, so the plan does not grow with the rounds.
    """
    sums = ws.save(
        edges.join(nodes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a")
        .join(nodes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
        .select("a", "b", (F.col("cosine") * F.col("na") * F.col("nb")).alias("s"), "na", "nb")
    )
    steps: list[DataFrame] = []
    while True:
        scored = sums.withColumn("avg", F.round(F.col("s") / (F.col("na") * F.col("nb")), 12)).where(F.col("avg") >= threshold)
        ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")
        best = scored.select(ends, "avg", (F.col("na") + F.col("nb")).alias("n")).groupBy("e.x").agg(F.min(F.struct((-F.col("avg")).alias("d"), F.col("e.y").alias("y"), "n")).alias("m"))
        mutual = best.groupBy(F.least("x", "m.y").alias("new"), F.greatest("x", "m.y").alias("old")).agg(F.count("*").alias("k"), F.max("m.n").alias("n")).where("k = 2")
        step = ws.save(mutual.select("old", "new", "n"))
        if step.isEmpty():
            break
        steps.append(step)
        moves = step.select(F.explode(F.array("old", "new")).alias("id"), "new", "n")
        moved = sums.join(moves.select(F.col("id").alias("a"), F.col("new").alias("a2"), F.col("n").alias("na2")), "a", "left").join(moves.select(F.col("id").alias("b"), F.col("new").alias("b2"), F.col("n").alias("nb2")), "b", "left")
        end = lambda x: F.struct(F.coalesce(x + "2", x).alias("id"), F.coalesce("n" + x + "2", "n" + x).alias("n"))
        pairs = moved.select(end("a").alias("u"), end("b").alias("v"), "s").where("u.id <> v.id").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "s")
        new = ws.save(pairs.groupBy(F.col("u.id").alias("a"), F.col("v.id").alias("b")).agg(F.sum("s").alias("s"), F.max("u.n").alias("na"), F.max("v.n").alias("nb")))
        ws.drop(sums)
        sums = new
    ws.drop(sums)
    assign = nodes.select("id", F.col("id").alias("cluster"))
    if not steps:
        return assign
    links = steps[0].select("old", "new")
    for step in steps[1:]:
        links = links.unionByName(step.select("old", "new"))
    links = ws.save(links)
    for _ in range((len(steps) - 1).bit_length()):
        longer = ws.save(links.join(links.select(F.col("old").alias("new"), F.col("new").alias("next")), "new", "left").select("old", F.coalesce("next", "new").alias("new")))
        ws.drop(links)
        links = longer
    return assign.join(links, assign["id"] == links["old"], "left").select("id", F.coalesce("new", "cluster").alias("cluster"))


def group_names(assets: DataFrame, captures: DataFrame, least: float = 0.2, threshold: float = 0.34) -> DataFrame:
    """One row per distinct spelling: (name, n, root, line, cluster).

    Spellings of one form are one node weighted by its records, so the average runs over records. Null and blank names take no part;
    names of one organisation in different lines of business never share an n-gram, because vectors live inside a line.
    """
    ws = Workspace(assets.sparkSession, "names")
    forms = ws.save(name_forms(spellings(assets, captures), shared_documents(assets, captures), ws).withColumn("form", F.concat_ws("|", "line", "root")))
    nodes = ws.save(forms.groupBy("form", "line", "root").agg(F.sum("n").alias("n")))
    edges = similar_forms(nodes.select("form", "line", "root"), least, ws)
    groups = average_linkage(nodes.select(F.col("form").alias("id"), "n"), edges, threshold, ws)
    return forms.join(groups.withColumnRenamed("id", "form"), "form").select("name", "n", "root", "line", "cluster")


def same_organisation(grouped: DataFrame) -> DataFrame:
    """Pairs of different spellings of one group: (name_a, name_b), name_a < name_b."""
    a = grouped.select("cluster", F.col("name").alias("name_a"))
    b = grouped.select("cluster", F.col("name").alias("name_b"))
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b")
