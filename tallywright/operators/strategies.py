"""Extension points: strategies of DataFrame functions, row parsers, structure predictors and a provider that chooses among given candidates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.operators import pages as pg
from tallywright.operators import resolution as rs


@dataclass
class Strategy:
    """UD1: ``discover`` makes candidates, ``rank`` orders them, ``validate`` drops what may not stand; ``supports`` decides by the request whether it applies."""

    name: str
    supports: Callable[[dict], bool]
    discover: Callable[[dict], DataFrame]
    rank: Callable[[DataFrame], DataFrame]
    validate: Callable[[DataFrame], DataFrame] = lambda ranked: ranked


class AmbiguousStrategy(ValueError):
    """None or several strategies support a request."""


@dataclass
class StrategyRegistry:
    strategies: list[Strategy] = field(default_factory=list)

    def register(self, strategy: Strategy) -> None:
        if any(s.name == strategy.name for s in self.strategies):
            raise ValueError(f"strategy {strategy.name} is registered already")
        self.strategies.append(strategy)

    def get(self, name: str) -> Strategy:
        for s in self.strategies:
            if s.name == name:
                return s
        raise KeyError(f"unknown strategy {name}")

    def choose(self, request: dict) -> Strategy:
        """UD1: the strategy that the request names (``strategy``), if it supports it; else the only one that does."""
        if request.get("strategy"):
            named = self.get(request["strategy"])
            if not named.supports(request):
                raise ValueError(f"strategy {named.name} does not support the request")
            return named
        able = [s for s in self.strategies if s.supports(request)]
        if len(able) != 1:
            raise AmbiguousStrategy(f"strategies that support the request: {[s.name for s in able]}")
        return able[0]

    def resolve(self, request: dict) -> tuple[str | None, DataFrame | None]:
        """UD1: name and ranked candidates of the chosen strategy; (None, None) is an abstention, where it finds none."""
        s = self.choose(request)
        ranked = s.validate(s.rank(s.discover(request)))
        return (None, None) if ranked.isEmpty() else (s.name, ranked)


def builtin_strategies() -> StrategyRegistry:
    """UD2: the shipped strategies, by the ``kind`` of a request: notes by reference, statement rows of listed members, sections by title, and templates by likeness.

    Requests bring their frames: ``pages`` (page_id, text), ``wanted`` (item, note), ``members``, ``patterns``, ``queries`` and ``templates``.
    """
    by = lambda column, *rest: lambda x: x.orderBy(F.desc(column), *rest)
    return StrategyRegistry(
        [
            Strategy("NOTE_BY_REFERENCE", lambda r: r.get("kind") == "note", lambda r: pg.locate_notes(r["pages"], r["wanted"]), by("confidence", "item"), lambda x: x.where("confidence > 0")),
            Strategy("STATEMENT_MEMBERS", lambda r: r.get("kind") == "statement", lambda r: pg.statement_rows(r["pages"], r["members"]), by("members", "page_id")),
            Strategy("SECTION_BY_TITLE", lambda r: r.get("kind") == "section", lambda r: pg.section_pages(r["pages"], r["patterns"]), by("by_title", "page_id")),
            Strategy("TEMPLATE_BY_LIKENESS", lambda r: r.get("kind") == "template", lambda r: rs.template_rank(r["queries"], r["templates"]), by("score", "template_id")),
        ]
    )


class RowParser(Protocol):
    """UD3: lines (page_id, line, content) to rows (page_id, line, label, amounts)."""

    def parse(self, lines: DataFrame) -> DataFrame: ...


@dataclass
class PatternRowParser:
    """UD3, RK24: row parser that one pattern describes: group 1 is the label, what follows it the amounts. Lines that do not match give no row."""

    pattern: str
    amount: str = r"(\(?-?\d[\d,]*(?:\.\d+)?\)?)"

    def parse(self, lines: DataFrame) -> DataFrame:
        rest = F.expr("substring(content, length(label) + 1)")
        numbers = F.transform(F.regexp_extract_all(rest, F.lit(self.amount), 1), lambda a: F.when(a.startswith("("), -F.regexp_replace(a, r"[(),]", "").try_cast("double")).otherwise(F.regexp_replace(a, ",", "").try_cast("double")))
        return lines.where(F.col("content").rlike(self.pattern)).withColumn("label", F.regexp_extract("content", self.pattern, 1)).select("page_id", "line", F.trim("label").alias("label"), numbers.alias("amounts"))


#: RK24: parsers by the layout of a company's statements.
ROW_PARSERS: dict[str, RowParser] = {
    "LABEL_THEN_AMOUNTS": PatternRowParser(r"^\s*([^\d(]+?)(?=\s+[(\-]?\d)"),
    "NUMBERED_LABEL": PatternRowParser(r"^\s*(\d{1,2}[.、]\s*[^\d(]+?)(?=\s+[(\-]?\d)"),
    "LABEL_WITH_NOTE": PatternRowParser(r"^\s*([^\d(]+?\s+\d{1,2})(?=\s+[(\-]?\d[\d,]{2,})"),
    "DOTTED_LABEL": PatternRowParser(r"^\s*([^\d(.…]+?[.…·]{2,})(?=\s*[(\-]?\d)"),
}


class StructurePredictor(Protocol):
    """UD4: queries and templates to (query_id, template_id, score, place)."""

    def __call__(self, queries: DataFrame, templates: DataFrame, n: int) -> DataFrame: ...


class CandidateProvider(Protocol):
    """UD5: a model that chooses among given candidates; it returns an id and a confidence, never a number of its own."""

    def select(self, question: str, candidates: Sequence[dict]) -> tuple[str | None, float]: ...


def provider_choice(open_keys: DataFrame, candidates: DataFrame, key: str, provider_factory: Callable[[], CandidateProvider] | None, least: float = 0.70, most: int = 20) -> DataFrame:
    """UD5: choices of a provider for undecided keys: (key, candidate_id, confidence, status). Off without a provider: every key is REVIEW_REQUIRED.

    Each key shows its best ``most`` candidates (key, candidate_id, label, score) to the provider, which runs where the rows are; an id that was not shown, or a confidence
    below ``least``, is no choice.
    """
    if provider_factory is None:
        return open_keys.select(key).distinct().select(key, F.lit(None).cast("string").alias("candidate_id"), F.lit(0.0).alias("confidence"), F.lit("REVIEW_REQUIRED").alias("status"))
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc("score"), "candidate_id")
    shown = candidates.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= most)
    lists = open_keys.select(key).distinct().join(shown.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__place", "candidate_id", "label", "score"))).alias("shown")), key, "left")

    def choose(batches):
        import pandas as pd

        provider = provider_factory()
        for pdf in batches:
            out = []
            for k, rows in zip(pdf[key], pdf["shown"]):
                options = [{"candidate_id": r["candidate_id"], "label": r["label"], "score": r["score"]} for r in (rows if rows is not None else [])]
                pick, confidence = provider.select(str(k), options) if options else (None, 0.0)
                good = pick in {o["candidate_id"] for o in options} and confidence >= least
                out.append((k, pick if good else None, float(confidence), "RESOLVED" if good else "REVIEW_REQUIRED"))
            yield pd.DataFrame(out, columns=[key, "candidate_id", "confidence", "status"])

    return lists.mapInPandas(choose, f"{key} string, candidate_id string, confidence double, status string")
