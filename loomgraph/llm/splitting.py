"""Splitting oversized items at natural boundaries, by recursive bisection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,words:int,cut:string>>"

# What counts as a word in mixed text.
CJK_FIRST, CJK_LAST = 0x4E00, 0x9FFF

_SENTENCE_END = np.array([ord(c) for c in ".!?…。！？"])
_CLOSING = np.array([ord(c) for c in "\"'”’»)]」』"])
_CLAUSE_END = np.array([ord(c) for c in ",;:，；：、—"])
_NAMES = {3: "paragraph", 2: "sentence", 1: "clause", 0: "word"}


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def word_starts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: each CJK character, each longest run of A-Z, a-z, 0-9."""
    latin = ((points >= 0x30) & (points <= 0x39)) | ((points >= 0x41) & (points <= 0x5A)) | ((points >= 0x61) & (points <= 0x7A))
    cjk = (points >= CJK_FIRST) & (points <= CJK_LAST)
    begin = latin.copy()
    begin[1:] &= ~latin[:-1]
    stop = latin.copy()
    stop[:-1] &= ~latin[1:]
    return np.flatnonzero(begin | cjk), np.flatnonzero(stop | cjk) + 1


def boundaries(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word but the first: the strength of the gap before it, and the character to cut at.

    3 a blank line, 2 a sentence's end followed by white space (or, in CJK
    text, by anything), 1 a clause's or line's end, 0 any other gap.
    """
    n = len(points)
    sp = (points == 0x20) | ((points >= 9) & (points <= 13)) | (points == 0x3000) | (points == 0xA0)
    nl = points == 0x0A
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    lo, hi = ends[:-1], starts[1:]
    in_gap = lambda c: c[hi] - c[lo] > 0
    ended = np.isin(points, _SENTENCE_END)
    wide = ended & (points > 0x7F) & (points != ord("…"))
    # a blank line: a line end followed, but for white space, by another
    solid = upto(~sp)
    at = np.flatnonzero(nl)
    blank = np.zeros(n, dtype=bool)
    if len(at) > 1:
        blank[at[1:][solid[at[1:]] == solid[at[:-1] + 1]]] = True
    # a sentence's end: the sign, perhaps closing signs, then white space
    closes = np.isin(points, _CLOSING)
    after = ended.copy()
    for _ in range(3):
        after[1:] |= after[:-1] & closes[1:]
    sentence = np.zeros(n, dtype=bool)
    sentence[1:] = after[:-1] & sp[1:]
    sentence |= wide
    clause = np.isin(points, _CLAUSE_END) | nl
    strength = np.zeros(len(hi), dtype=np.int8)
    strength[in_gap(upto(clause))] = 1
    strength[in_gap(upto(sentence))] = 2
    strength[in_gap(upto(blank))] = 3
    # cut after the gap's last ending sign and the white space behind it, else after its last white space
    last_of = lambda mask: np.maximum.accumulate(np.where(mask, np.arange(1, n + 1), 0))
    next_solid = np.minimum.accumulate(np.where(sp, n, np.arange(n))[::-1])[::-1]
    by_space = last_of(sp)[hi - 1]
    by_sign = last_of(after | np.isin(points, _CLAUSE_END))[hi - 1]
    by_sign = np.minimum(next_solid[np.minimum(by_sign, n - 1)], hi)
    cut = np.where(by_sign > lo, by_sign, np.where(by_space > lo, by_space, hi))
    return strength, cut


def bisect_words(n_words: int, strength: np.ndarray, most: int, least_cut: int) -> list[int]:
    """The word numbers at which to cut so that no stretch has more than ``most`` words.

    A stretch is cut at the strongest boundary in its middle half, the nearest
    to the midpoint; without a sentence or paragraph end there, at the nearest
    one anywhere in the stretch; without any, at the strongest lesser gap.
    ``strength[i]`` is that of the gap before word ``i + 1``; there is no cut
    before word ``least_cut``.
    """
    by = {s: np.flatnonzero(strength == s) + 1 for s in (3, 2, 1)}

    def nearest(s: int, a: int, b: int, mid: float) -> int | None:
        """The cut of strength ``s`` in [a, b] nearest to ``mid``."""
        c = by[s]
        i, j = np.searchsorted(c, a), np.searchsorted(c, b, "right")
        if i == j:
            return None
        k = int(np.searchsorted(c, mid))
        near = [int(c[x]) for x in (k - 1, k) if i <= x < j]
        if not near:
            near = [int(c[i]) if k <= i else int(c[j - 1])]
        return min(near, key=lambda x: (abs(x - mid), x))

    cuts: list[int] = []
    todo = [(0, n_words)]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            continue
        mid, quarter = (a + b) / 2, (b - a) // 4
        first, final = max(a + 1, least_cut), b - 1
        inner = max(first, a + quarter), min(final, b - quarter)
        tries = [(3, *inner), (2, *inner), (3, first, final), (2, first, final), (1, *inner)]
        cut = next((c for s, lo, hi in tries if lo <= hi and (c := nearest(s, lo, hi, mid)) is not None), None)
        if cut is None:
            cut = min(max(int(mid), first), final)
        if not a < cut < b:
            cut = max(a + 1, int(mid))
        cuts.append(cut)
        todo += [(a, cut), (cut, b)]
    return sorted(cuts)


def pieces_of(text: str | None, max_words: int | None, overlap: int | None) -> list[dict]:
    """The pieces of a text of more than ``max_words`` words; none for a text within the limit."""
    if not text or max_words is None or max_words != max_words:
        return []
    limit = max(1, int(max_words))
    if len(text) <= limit:
        return []
    points = _points(text)
    starts, ends = word_starts(points)
    n = len(starts)
    if n <= limit:
        return []
    shared = 0 if overlap is None or overlap != overlap else min(max(0, int(overlap)), limit - 1)
    strength, at = boundaries(points, starts, ends)
    cuts = bisect_words(n, strength, limit - shared, shared)
    edges = [0, *cuts, n]
    out = []
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        from_word = max(0, a - shared) if i else 0
        start = 0 if from_word == 0 else int(at[from_word - 1])
        end = len(points) if b == n else int(at[b - 1])
        out.append({"start": start, "end": end, "words": b - from_word, "cut": "end" if b == n else _NAMES[int(strength[b - 1])]})
    return out


def _spans(text: pd.Series, most: pd.Series, shared: pd.Series) -> pd.Series:
    return pd.Series([pieces_of(t, m, o) for t, m, o in zip(text, most, shared)])


def split_oversized(items: DataFrame, content: str, max_words: str, overlap_words: str) -> DataFrame:
    """``items`` over their limit, with ``spans``: the ordered pieces as character ranges.

    A piece has at most ``max_words`` words; the pieces cover the content, and
    a piece begins with the last ``overlap_words`` words of the one before (cut
    to ``max_words - 1`` if greater).  Null or empty content, and rows without a
    limit, give no row; repeated rows stay repeated; a text without any boundary
    is cut between words; limits below 1 count as 1.  Texts with fewer
    characters than the limit never reach Python.  No shuffle.
    """
    over = items.where((F.length(content) > F.greatest(F.col(max_words), F.lit(1))))
    spans = F.pandas_udf(_spans, SPANS)
    return over.withColumn("spans", spans(content, max_words, overlap_words)).where(F.size("spans") > 0)


def explode_pieces(split: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """One row for each piece: ``keys, piece_no, n_pieces, piece, n_words, cut``."""
    rows = split.select(*keys, content, F.size("spans").alias("n_pieces"), F.posexplode("spans").alias("piece_no", "s"))
    piece = F.expr(f"substring(`{content}`, s.start + 1, s.end - s.start)")
    return rows.select(*keys, "piece_no", "n_pieces", piece.alias("piece"), F.col("s.words").alias("n_words"), F.col("s.cut").alias("cut"))


def with_limits(source_docs: DataFrame, chunks: DataFrame, size_limits: DataFrame) -> DataFrame:
    """Documents and chunks as items (``item_kind, item_id, source_doc_id, content``) with their limits."""
    kind = lambda k: F.lit(k).alias("item_kind")
    doc_type = F.col("metadata")["doc_type"].alias("doc_type")
    docs = source_docs.select(kind("document"), F.col("id").alias("item_id"), F.col("id").alias("source_doc_id"), doc_type, "content")
    parts = chunks.select(kind("chunk"), F.col("id").alias("item_id"), "source_doc_id", doc_type, "content")
    limits = size_limits.groupBy("item_kind", "doc_type").agg(F.min_by("overlap_words", "max_words").alias("overlap_words"), F.min("max_words").alias("max_words"))
    return docs.unionByName(parts).join(limits, ["item_kind", "doc_type"])
