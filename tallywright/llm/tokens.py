"""Token streams of whole batches of texts as arrays: one token per ideograph, per run of letters, per run of digits."""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

import numpy as np

OTHER, LETTER, DIGIT, IDEOGRAPH = 0, 1, 2, 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LIMIT = 0x30000


_TABLE: dict[str, np.ndarray] = {}


def _classes() -> np.ndarray:
    """Class of every code point below _LIMIT, from its Unicode category and name range (made once per process)."""
    if "classes" not in _TABLE:
        _TABLE["classes"] = _make_classes()
    return _TABLE["classes"]


def _make_classes() -> np.ndarray:
    table = np.zeros(_LIMIT, dtype=np.uint8)
    for cp in range(0x20000):
        category = unicodedata.category(chr(cp))
        if category[0] in "LM":
            table[cp] = LETTER
        elif category == "Nd":
            table[cp] = DIGIT
    for lo, hi in ((0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x30000)):
        table[lo:hi] = IDEOGRAPH
    return table


def fold(text: str) -> str:
    """Width, compatibility forms and case folded."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


class Stream(NamedTuple):
    """Tokens of a batch in order. ``start``/``end`` are positions in ``points``, the code points of all folded texts."""

    hashes: np.ndarray
    kinds: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    points: np.ndarray
    point_doc_start: np.ndarray


def stream(texts: list[str], each_digit: bool = False) -> Stream:
    """Tokenise texts (None counts as empty); a token never crosses texts. Hashes depend on the token's characters only.
    ``each_digit``: every digit is a token, so that signs and blanks inside a number change nothing."""
    folded = [fold(t or "") for t in texts]
    lengths = np.fromiter((len(t) + 1 for t in folded), dtype=np.int64, count=len(folded))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    points = np.frombuffer("".join(t + "\n" for t in folded).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = _classes()[np.minimum(points, _LIMIT - 1)]
    previous = np.concatenate([[OTHER], kinds[:-1]]) if len(kinds) else kinds
    alone = (kinds == IDEOGRAPH) | (kinds == DIGIT) if each_digit else kinds == IDEOGRAPH
    first = (kinds != OTHER) & ((kinds != previous) | alone)
    start = np.flatnonzero(first)
    following = np.concatenate([kinds[1:], [OTHER]]) if len(kinds) else kinds
    last = (kinds != OTHER) & ((kinds != following) | alone)
    end = np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(points), _BASE, dtype=np.uint64)]))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(points), inverse, dtype=np.uint64)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(points.astype(np.uint64) * powers[:-1])])
        hashes = (sums[end] - sums[start]) * inverses[start]
        hashes ^= hashes >> np.uint64(31)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(29)
    doc = np.repeat(np.arange(len(folded)), lengths)[start] if len(folded) else start
    return Stream(hashes, kinds[start], doc, start, end, points, starts)


#: Marks behind which a long text is cut if possible: sentence and line ends.
ENDS = ".!?。！？;；\n"
#: How far back a cut looks for such a mark, and for a token boundary where there is none.
REACH = 100_000


def cut_place(text: str, start: int, at: int) -> int:
    """Place of at most ``at`` where a text that begins at ``start`` is cut: behind the last sentence or line end, else between two tokens, else ``at``.
    Base characters keep their marks, so folding a piece gives the piece of the folded text."""
    low = max(start + 1, at - REACH)

    def whole(k: int) -> bool:
        return not unicodedata.combining(text[k])

    end = max(text.rfind(c, low, at) for c in ENDS) + 1
    if end > low and whole(end):
        return end
    for k in range(at, low, -1):
        one = [min(int(_classes()[min(ord(c), _LIMIT - 1)]), IDEOGRAPH) for c in (text[k - 1], text[k])]
        if whole(k) and (one[0] != one[1] or one[0] in (OTHER, IDEOGRAPH)):
            return k
    return at


def pieces(texts: list[str], most_points: int = 1_000_000) -> list[tuple[list[int], list[str]]]:
    """Batches of (index, text) with at most ``most_points`` characters each; a longer text is cut into several pieces
    of the same index (see cut_place), so that memory stays bounded whatever the texts are. Nothing is left out."""
    out: list[tuple[list[int], list[str]]] = []
    ids: list[int] = []
    part: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        text = text or ""
        at = 0
        while True:
            end = len(text) if len(text) - at <= most_points else cut_place(text, at, at + most_points)
            if part and size + end - at > most_points:
                out.append((ids, part))
                ids, part, size = [], [], 0
            ids.append(i)
            part.append(text[at:end])
            size += end - at
            at = end
            if at >= len(text):
                break
    if part:
        out.append((ids, part))
    return out
