"""Character variants and edit distance shared by the matching operators."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@functools.cache  # on the driver only
def traditional_table() -> tuple[str, str]:
    """(traditional characters, simplified characters) of the common ideographs, by the Unicode transliterator that ships with Spark."""
    spark = SparkSession.getActiveSession()
    every = "".join(map(chr, range(0x4E00, 0xA000)))
    simple = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified").transliterate(every)
    pairs = [(a, b) for a, b in zip(every, simple) if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def simplified(text: Column | str) -> Column:
    """Lower-case text with simplified characters."""
    source, target = traditional_table()
    return F.lower(F.translate(text, source, target))


def deletion_variants(term: str, edits: int, prefix: int = 8) -> list[str]:
    """The first ``prefix`` characters of a term with up to ``edits`` of them deleted (symmetric-delete keys).

    Two terms within ``edits`` Damerau-Levenshtein steps share a key: each step costs at most one deletion on either side,
    a shift at the end of the prefix included.
    """
    head = term[:prefix]
    out = {head}
    for k in range(1, min(edits, len(head)) + 1):
        out.update("".join(c for i, c in enumerate(head) if i not in gone) for gone in itertools.combinations(range(len(head)), k))
    return sorted(out)


def weighted_distance(a: str, b: str, most: int) -> tuple[int, float] | None:
    """(steps, weight) of the cheapest Damerau-Levenshtein path (adjacent transpositions), or None beyond ``most`` steps.

    Weights: substitution 1, insertion or deletion 1 (0.5 where it doubles a neighbour), transposition 0.7.
    """
    if abs(len(a) - len(b)) > most:
        return None
    rows: list[list[tuple[int, float]]] = [[(j, float(j)) for j in range(len(b) + 1)]]
    for i in range(1, len(a) + 1):
        row = [(i, float(i))]
        for j in range(1, len(b) + 1):
            if a[i - 1] == b[j - 1]:
                best = rows[i - 1][j - 1]
            else:
                s = rows[i - 1][j - 1]
                best = (s[0] + 1, s[1] + 1.0)
            d = rows[i - 1][j]
            w = 0.5 if i > 1 and a[i - 1] == a[i - 2] else 1.0
            best = min(best, (d[0] + 1, d[1] + w))
            d = row[j - 1]
            w = 0.5 if j > 1 and b[j - 1] == b[j - 2] else 1.0
            best = min(best, (d[0] + 1, d[1] + w))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = rows[i - 2][j - 2]
                best = min(best, (d[0] + 1, d[1] + 0.7))
            row.append(best)
        if min(s for s, _ in row) > most and min(s for s, _ in rows[-1]) > most:
            return None
        rows.append(row)
    steps, weight = rows[-1][-1]
    return (steps, weight) if steps <= most else None
