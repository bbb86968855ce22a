"""Oversized texts cut into overlapping pieces by agglomerative merging of segments.

A text is first cut into atomic segments at its natural boundaries. Neighbouring segments are held in a heap by the
strength of the boundary between them (blank lines are the strongest, then line ends, sentence ends, clause marks,
blanks, and none) and merged, weakest boundary first, while the merged size and the overlap fit the limit. Each piece
after the first begins with up to `overlap` characters of the piece before it, from a sentence or word start where
there is one.

Defined cases: null texts give no row; a text within the limit, empty and blank ones too, gives one piece, itself. A
text without any natural boundary is cut hard at limit - overlap. Pieces are substrings: text[start_at:end_at] is the
piece, and the parts after the overlaps put together are the text. Sizes are in code points. Repeated (field, item_id)
rows count once. Other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quirelake.session import spread

LIMIT, OVERLAP = 1200, 120
_ABBREVIATED = re.compile(r"(?:\b(?:Dr|Mr|Mrs|Ms|Prof|St|No|vs|approx|ca|bzw|z\.B|Nr|Sr|Sra|Mme|e\.g|i\.e|Inj|Tab|Cap|Syp|Apt|P\.O|ext|Tel)|\b[A-Z])\.$")
# (strength, pattern whose end is a cut)
_BOUNDARIES = (
    (5, re.compile(r"\n[^\S\n]*(?:\n\s*)+|\r\n[^\S\n]*(?:\r\n\s*)+")),
    (4, re.compile(r"\r\n|\n|\r| | ")),
    (3, re.compile(r"[.!?…。！？][\"'”’)\]]*\s+|[。！？]")),
    (2, re.compile(r"[;:,，、]\s+|\s[-–—|]\s+")),
    (1, re.compile(r"\s+")),
)


def _cuts(text: str, lo: int, hi: int, strength: int, pattern: re.Pattern) -> list[int]:
    out = []
    for m in pattern.finditer(text, lo, hi):
        if lo < m.end() < hi and not (strength == 3 and m[0][0] == "." and _ABBREVIATED.search(text, max(lo, m.start() - 12), m.start() + 1)):
            out.append(m.end())
    return out


def segments(text: str, core: int) -> list[tuple[int, int, int]]:
    """Atomic segments (start, end, strength of the boundary at the end), none over core."""
    ends = {len(text): 6}
    for strength, pattern in _BOUNDARIES[:3]:
        for c in _cuts(text, 0, len(text), strength, pattern):
            ends.setdefault(c, strength)
    out, lo = [], 0
    for hi in sorted(ends):
        todo = [(lo, hi, ends[hi], 3)]  # weaker boundaries only inside what is too long
        while todo:
            a, b, s, level = todo.pop()
            if b - a <= core:
                out.append((a, b, s))
                continue
            if level < len(_BOUNDARIES):
                strength, pattern = _BOUNDARIES[level]
                inner = [*_cuts(text, a, b, strength, pattern), b]
                parts = list(zip([a, *inner[:-1]], inner, [strength] * (len(inner) - 1) + [s]))
                todo += [(*p, level + 1) for p in reversed(parts)]
            else:
                inner = [*range(a + core, b, core), b]
                out += list(zip([a, *inner[:-1]], inner, [0] * (len(inner) - 1) + [s]))
        lo = hi
    return out


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, characters repeated) of the pieces of a text."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [(0, len(text), 0)]
    core = limit - overlap
    segs = segments(text, core)
    n = len(segs)
    start, end, strength = [s[0] for s in segs], [s[1] for s in segs], [s[2] for s in segs]
    before, after, live = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(strength[i], end[i + 1] - start[i], i, end[i], end[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, mid, stop = heapq.heappop(heap)
        j = after[i] if live[i] else n
        if j >= n or end[i] != mid or end[j] != stop or stop - start[i] != size or size > core:
            continue
        end[i], strength[i], after[i], live[j] = end[j], strength[j], after[j], False
        if after[i] < n:
            before[after[i]] = i
            heapq.heappush(heap, (strength[i], end[after[i]] - start[i], i, end[i], end[after[i]]))
        if before[i] >= 0:
            b = before[i]
            heapq.heappush(heap, (strength[b], end[i] - start[b], b, end[b], end[i]))
    out, i = [], 0
    while i < n:
        s = start[i]
        if out and overlap:
            lo = max(s - overlap, out[-1][0])
            whole = lo == 0 or lo == out[-1][0]
            starts = _cuts(text, lo, s, 3, _BOUNDARIES[2][1]) or _cuts(text, lo, s, 4, _BOUNDARIES[1][1]) or _cuts(text, lo, s, 1, _BOUNDARIES[4][1])
            s = lo if whole else (starts[0] if starts else lo)
        out.append((s, end[i], start[i] - s))
        i = after[i]
    return out


PIECES = "field string, item_id string, piece_no int, n_pieces int, start_at int, end_at int, overlap int, piece string"


def split_texts(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every (field, item_id, text)."""
    once = spread(items.select("field", "item_id", "text").where("text IS NOT NULL"), "field", "item_id").groupBy("field", "item_id").agg(F.max("text").alias("text"))

    def run(batches):
        for pdf in batches:
            out = []
            for f, i, t in zip(pdf["field"], pdf["item_id"], pdf["text"]):
                pieces = cut(t, limit, overlap)
                out += [(f, i, k, len(pieces), a, b, o, t[a:b]) for k, (a, b, o) in enumerate(pieces)]
            yield pd.DataFrame(out, columns=["field", "item_id", "piece_no", "n_pieces", "start_at", "end_at", "overlap", "piece"])

    return once.mapInPandas(run, PIECES)


def split_oversized(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the texts over the limit only; the rest never leaves the JVM."""
    return split_texts(items.where(F.length("text") > limit), limit, overlap)
