"""Reading level of texts: a linear pairwise ranker, calibrated to levels by isotonic regression."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.tokens import DIGIT, IDEOGRAPH, LETTER, pieces, stream

#: Buckets of the hashed vocabulary features (words or characters, and pairs of them).
VOCABULARY = 2048
#: Syntax features per text, in order; see _syntax.
SYNTAX = 7
#: Bound of the labelled documents that the ranker is fitted on; all other stages cover every document.
MAX_LABELLED = 3000
#: Pairs drawn per labelled document.
PAIRS_PER_DOCUMENT = 24
#: Fewest letters and ideographs in one line that make it a sentence.
LEAST_SENTENCE = 4

_ENDS = np.array([ord(c) for c in ".!?。！？;；\n"], dtype=np.uint32)
_COMMAS = np.array([ord(c) for c in ",，、:："], dtype=np.uint32)


def _buckets(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every token and of every pair of neighbouring tokens of one document."""
    with np.errstate(over="ignore"):
        single = (hashes % np.uint64(VOCABULARY)).astype(np.int64)
        if len(hashes) < 2:
            return single, doc
        pair = (hashes[:-1] * np.uint64(31) + hashes[1:] * np.uint64(1_000_003)) >> np.uint64(17)
        same = doc[:-1] == doc[1:]
        pairs = (pair[same] % np.uint64(VOCABULARY)).astype(np.int64)
    return np.concatenate([single, pairs]), np.concatenate([doc, doc[:-1][same]])


class Sums(NamedTuple):
    """Counts per text: columns tokens, sentences, commas, letters, words, digits, ideographs, distinct; all but the last add up over pieces of a text."""

    counts: np.ndarray
    bucket: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    token_doc: np.ndarray


def _sums(texts: list[str]) -> Sums:
    s, n = stream(texts), len(texts)
    point_doc = np.repeat(np.arange(n), np.diff(s.point_doc_start))
    is_end = np.isin(s.points, _ENDS)
    stretch = np.cumsum(is_end) - is_end
    weight = np.where(s.kinds == LETTER, s.end - s.start, np.where(s.kinds == IDEOGRAPH, 1, 0))
    token_stretch = stretch[s.start]
    size = np.bincount(token_stretch, weights=weight, minlength=1)
    first = np.flatnonzero(np.diff(np.concatenate([[-1], token_stretch]))) if len(token_stretch) else np.array([], dtype=np.int64)
    sentence = size[token_stretch[first]] >= LEAST_SENTENCE
    distinct = np.zeros(n)
    if len(s.doc):
        order = np.lexsort((s.hashes, s.doc))
        d, h = s.doc[order], s.hashes[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
        distinct = np.bincount(d[new], minlength=n)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        return np.bincount(s.doc, weights=mask.astype(float), minlength=n)

    counts = np.stack(
        [
            np.bincount(s.doc, minlength=n),
            np.bincount(s.doc[first], weights=sentence.astype(float), minlength=n),
            np.bincount(point_doc, weights=np.isin(s.points, _COMMAS).astype(float), minlength=n),
            per_doc(np.where(s.kinds == LETTER, s.end - s.start, 0)),
            per_doc(s.kinds == LETTER),
            per_doc(s.kinds == DIGIT),
            per_doc(s.kinds == IDEOGRAPH),
            distinct,
        ],
        axis=1,
    ).astype(float)
    return Sums(counts, *_buckets(s.hashes, s.doc), s.hashes, s.doc)


def _syntax(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features n x SYNTAX, has_sentence): tokens per sentence, word length, digit and ideograph share, commas per sentence,
    distinct share, number of sentences. A sentence is a stretch up to an end mark or line end with at least
    LEAST_SENTENCE letters or ideographs."""
    tokens, sentences, commas, letters, words, digits, ideographs, distinct = counts.T
    some, whole = np.maximum(sentences, 1), np.maximum(tokens, 1)
    out = np.stack(
        [np.log1p(tokens / some) / 4, np.log1p(letters / np.maximum(words, 1)) / 3, digits / whole, ideographs / whole, np.minimum(commas / some, 10) / 10, distinct / whole, np.log1p(sentences) / 10],
        axis=1,
    )
    return out, sentences > 0


def _summed(texts: list[str]):
    """Sums of bounded pieces of the texts: (number of the text for each piece, Sums). Texts are cut behind sentence ends (``pieces``); of a text in several
    pieces the distinct tokens are counted over all of them and the pair across a cut is added, so that its features are those of the whole text."""
    parts = pieces(texts)
    split = {i for (a, _), (b, _) in zip(parts, parts[1:]) for i in (a[-1],) if b[0] == i}
    seen: dict[int, np.ndarray] = {}
    last: dict[int, np.uint64] = {}
    for ids, part in parts:
        one = _sums(part)
        for k, i in enumerate(ids):
            if i not in split:
                continue
            own = one.hashes[one.token_doc == k]
            if not len(own):
                continue
            known = seen.get(i, own[:0])
            seen[i] = np.union1d(known, own)
            one.counts[k, 7] = len(seen[i]) - len(known)
            if i in last:
                bucket, _ = _buckets(np.array([last[i], own[0]], dtype=np.uint64), np.zeros(2, dtype=np.int64))
                one = one._replace(bucket=np.append(one.bucket, bucket[2]), doc=np.append(one.doc, k))
            last[i] = own[-1]
        yield np.array(ids), one


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(matrix texts x (VOCABULARY + SYNTAX), has_sentence): scaled shares of the vocabulary buckets, then syntax."""
    n = len(texts)
    counts, vocabulary = np.zeros((n, 8)), np.zeros((n, VOCABULARY))
    for ids, one in _summed(texts):
        np.add.at(counts, ids, one.counts)
        vocabulary += np.bincount(ids[one.doc] * VOCABULARY + one.bucket, minlength=n * VOCABULARY).reshape(n, VOCABULARY)
    syntax, ok = _syntax(counts)
    share = vocabulary / np.maximum(vocabulary.sum(axis=1, keepdims=True), 1)
    return np.hstack([share * 20, syntax]).astype(np.float32), ok


class Model(NamedTuple):
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray


def scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Ranker score of each text (nan without a sentence), without building the feature matrix."""
    n = len(texts)
    counts, total, number = np.zeros((n, 8)), np.zeros(n), np.zeros(n)
    for ids, one in _summed(texts):
        np.add.at(counts, ids, one.counts)
        total += np.bincount(ids[one.doc], weights=weights[one.bucket], minlength=n)
        number += np.bincount(ids[one.doc], minlength=n)
    syntax, ok = _syntax(counts)
    return np.where(ok, total / np.maximum(number, 1) * 20 + syntax @ weights[VOCABULARY:], np.nan)


def fit_ranker(x: np.ndarray, grade: np.ndarray, rounds: int = 150, decay: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights w such that documents of higher grade score higher: logistic loss over drawn pairs of different grade."""
    rng, n = np.random.default_rng(seed), len(grade)
    i, j = rng.integers(0, n, (2, n * PAIRS_PER_DOCUMENT))
    swap = grade[i] < grade[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    keep = grade[i] - grade[j] > 0.6  # graders differ by one now and then
    i, j = i[keep], j[keep]
    w = np.zeros(x.shape[1], dtype=np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    if not len(i):
        return w
    for step in range(1, rounds + 1):
        f = x @ w
        g = -1 / (1 + np.exp(np.clip(f[i] - f[j], -30, 30)))
        per_doc = np.bincount(i, weights=g, minlength=n) - np.bincount(j, weights=g, minlength=n)
        grad = (per_doc / len(i)).astype(np.float32) @ x + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= (0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def isotonic(score: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (knots, levels) of the non-decreasing step fit of grade on score."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, g in zip(score[order], grade[order]):
        blocks.append([g, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            a[0], a[1], a[3] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], b[3]
    knots, levels = [], []
    for b in blocks:
        knots += [b[2], b[3]]
        levels += [b[0], b[0]]
    return np.array(knots), np.array(levels)


def fit(x: np.ndarray, grade: np.ndarray, seed: int = 7) -> Model:
    """Ranker on two folds; calibration on the scores each fold's ranker gives the other; final weights from all rows.
    With fewer than eight rows there is nothing to rank: every text gets the mean grade."""
    grade = np.asarray(grade, dtype=float)
    if len(grade) < 8:
        return Model(np.zeros(VOCABULARY + SYNTAX), np.array([0.0]), np.array([float(np.mean(grade)) if len(grade) else 3.0]))
    half = np.random.default_rng(seed).permutation(len(grade)) % 2 == 0
    final = fit_ranker(x, grade)
    whole = x @ final
    out = np.empty(len(grade))
    for part in (half, ~half):
        w = fit_ranker(x[~part], grade[~part])
        own = x[~part] @ w
        out[part] = (x[part] @ w - own.mean()) / (own.std() or 1.0)
    knots, levels = isotonic(out * (whole.std() or 1.0) + whole.mean(), grade)
    return Model(final.astype(float), knots, levels)


def levels_of(score: np.ndarray, model: Model) -> np.ndarray:
    """Expected grade of each score by the isotonic fit, linear between its steps."""
    return np.interp(score, model.knots, model.levels)


_SPARSE = T.StructType().add("grade", "double").add("index", T.ArrayType(T.IntegerType())).add("value", T.ArrayType(T.FloatType()))
_SCORED = T.StructType().add("doc_id", "long").add("score", "double").add("expected", "double").add("level", "integer")


def fit_model(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Fit on at most ``most`` labelled documents, taken in hash order of their id; the mean of a document's grades counts.

    Features are computed on the executors; the driver gets sparse rows of at most VOCABULARY + SYNTAX numbers each.
    """
    spark = documents.sparkSession
    graded = labels.where("doc_id IS NOT NULL AND reading_level BETWEEN 1 AND 5").groupBy("doc_id").agg(F.avg("reading_level").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "grade")  # at most ``most`` rows of two numbers

    def sparse(batches):
        for pdf in batches:
            for k in range(0, len(pdf), 500):
                part = pdf.iloc[k : k + 500]
                x, ok = features(list(part["text"]))
                keep = [np.flatnonzero(r) for r in x[ok]]
                yield pd.DataFrame({"grade": part["grade"].to_numpy()[ok], "index": [i.astype(np.int32) for i in keep], "value": [r[i] for r, i in zip(x[ok], keep)]})

    got = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(sparse, _SPARSE).toPandas()
    order = sorted(range(len(got)), key=lambda k: (got["grade"][k], len(got["index"][k]), float(np.dot(got["value"][k], got["index"][k]))))  # same fit whatever the row order
    x = np.zeros((len(got), VOCABULARY + SYNTAX), dtype=np.float32)
    for r, k in enumerate(order):
        x[r, np.asarray(got["index"][k], dtype=np.int64)] = got["value"][k]
    return fit(x, got["grade"].to_numpy()[order] if len(got) else np.array([]))


def reading_levels(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, expected, level) of every document in one narrow pass over whole texts.

    Texts without a sentence (null, empty, signs and numbers only) have null score and level. Levels are the isotonic
    expectation rounded half up, 1 to 5.
    """

    def score(batches):
        for pdf in batches:
            s = scores(list(pdf["text"]), model.weights)
            e = levels_of(s, model)
            level = np.clip(np.floor(e + 0.5), 1, 5)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s, "expected": np.where(np.isnan(s), np.nan, e), "level": pd.array(np.where(np.isnan(s), np.nan, level), dtype="Int32")})

    out = documents.select("doc_id", "text").mapInPandas(score, _SCORED)
    return out.select("doc_id", F.when(~F.isnan("score"), F.col("score")).alias("score"), F.when(~F.isnan("expected"), F.col("expected")).alias("expected"), "level")
