"""Problem 2: oversized items cut at natural boundaries.

Content-defined chunking.  A rolling hash over the last ``WINDOW`` characters
marks landmarks about every ``SPACING`` characters; each landmark snaps to the
nearest natural boundary (a line end, better ones after a blank line or a
closing bracket, and only in texts without line ends a boundary inside the
line).  Of the snapped landmarks between the minimum and the maximum size the
one of the best grade with the largest hash ends the piece.  As the choice is a
local maximum of the content, an edit moves only the neighbouring cuts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adherix.functions.records import latest

LIMIT = 4000
OVERLAP_LINES = 5
WINDOW = 32
SPACING = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INSIDE = re.compile(r"[;}]|[,)\]>]|\s")

PIECES = "chunk_id long, piece_no int, n_pieces int, piece string, start_line int, end_line int, overlap_chars int, boundary string"


def rolling_hash(text: str, window: int = WINDOW) -> np.ndarray:
    """Hash of the ``window`` characters that end at each position (doubling)."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    h = (h * np.uint64(0xFF51AFD7ED558CCD)) ^ (h << np.uint64(13))
    width, factor = 1, int(_BASE)
    while width < window:
        wider = h.copy()
        if width < len(h):
            wider[width:] += h[:-width] * np.uint64(factor)
        h, width, factor = wider, width * 2, factor * factor % (1 << 64)
    h ^= h >> np.uint64(33)
    return h * np.uint64(0xC4CEB9FE1A85EC53)


def boundaries(text: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which a piece may end, and their grades.

    3: a line end before a blank line or after a bracket closed at the margin,
    2: a line end after a closing bracket or a statement end, 1: any other line
    end.  Stretches of more than ``limit`` characters without a line end get the
    boundaries inside the line: grade 0 after ``;`` or ``}``, -1 after other
    closing marks, -2 after white space.
    """
    ends, grades, at = [], [], 0
    lines = text.split("\n")
    for i, line in enumerate(lines):
        stop = at + len(line) + (i < len(lines) - 1)
        if len(line) > limit // 2:
            for m in _INSIDE.finditer(text, at, stop - 1):
                ends.append(m.end())
                grades.append(0 if m[0] in ";}" else -2 if m[0].isspace() else -1)
        if stop > at:
            bare = line.rstrip()
            following = lines[i + 1].strip() if i + 1 < len(lines) else ""
            ends.append(stop)
            grades.append(3 if not bare or not following or (bare[:1] in "})]" and len(bare) < 4) else 2 if bare[-1:] in "};)]:" else 1)
        at = stop
    return np.array(ends, np.int64), np.array(grades, np.int64)


def cuts(text: str, limit: int = LIMIT, overlap_lines: int = OVERLAP_LINES) -> list[tuple[int, int, int, str]]:
    """``(begin, body_begin, end, boundary)`` of each piece; begin to body_begin is repeated text."""
    if len(text) <= limit:
        return [(0, 0, len(text), "end")]
    ends, grades = boundaries(text, limit)
    h = rolling_hash(text)
    marks = np.nonzero(h % np.uint64(SPACING) == 0)[0] + 1
    snapped = np.zeros(len(ends), bool)
    if len(marks) and len(ends):
        right = np.clip(np.searchsorted(ends, marks), 0, len(ends) - 1)
        left = np.clip(right - 1, 0, None)
        snapped[np.where(np.abs(ends[left] - marks) < np.abs(ends[right] - marks), left, right)] = True
    weight = h[np.clip(ends - 1, 0, None)] if len(ends) else h[:0]

    found, body = [], 0
    while body < len(text):
        begin = _overlap(text, found, body, limit, overlap_lines, ends, grades)
        most = begin + limit
        if most >= len(text):
            found.append((begin, body, len(text), "end"))
            break
        low = max(body + 1, begin + limit // 2)
        a, b = np.searchsorted(ends, low), np.searchsorted(ends, most, "right")
        inner = np.arange(a, b)
        whole = inner[grades[inner] > 0]
        if not len(whole):
            first = np.searchsorted(ends, body + 1)
            inner = np.arange(first, b)
            whole = inner[grades[inner] > 0]
            whole = whole[-1:]
        if len(whole):
            near = whole[snapped[whole]]
            pool = near if len(near) else whole
            pool = pool[grades[pool] == grades[pool].max()]
            end, kind = int(ends[pool[np.argmax(weight[pool])]]), "line"
        elif len(inner):
            near = inner[snapped[inner]]
            pool = near if len(near) else inner
            pool = pool[grades[pool] == grades[pool].max()]
            pool = pool[ends[pool] >= min(low, ends[pool].max())]
            end, kind = int(ends[pool[np.argmax(weight[pool])]]), "token"
        else:
            end, kind = most, "none"
        found.append((begin, body, end, kind))
        body = end
    return found


def _overlap(text: str, found: list, body: int, limit: int, overlap_lines: int, ends: np.ndarray, grades: np.ndarray) -> int:
    """Where the piece whose new text starts at ``body`` begins: up to ``overlap_lines`` last lines of the piece before."""
    if not found or not overlap_lines:
        return body
    previous = found[-1][0]
    k = np.searchsorted(ends, body + 1)
    later = ends[k:][grades[k:] > 0]
    unit = int(later[0]) - body if len(later) else len(text) - body
    room = limit - unit if unit <= limit else limit // 2
    best, at = body, body
    for _ in range(overlap_lines):
        if at <= previous:
            break
        at = max(text.rfind("\n", 0, at - 1) + 1, previous)
        if body - at > room:
            break
        best = at
    return best


def _pieces(limit: int, overlap_lines: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, start in zip(batch["chunk_id"], batch["function_code"], batch["start_line"]):
                parts = cuts(text, limit, overlap_lines)
                for n, (begin, body, end, kind) in enumerate(parts, 1):
                    first = None if pd.isna(start) else int(start) + text.count("\n", 0, begin)
                    last = None if first is None else first + text.count("\n", begin, max(begin, end - 1))
                    rows.append((key, n, len(parts), text[begin:end], first, last, body - begin, kind))
            out = pd.DataFrame(rows, columns=["chunk_id", "piece_no", "n_pieces", "piece", "start_line", "end_line", "overlap_chars", "boundary"])
            yield out.astype({"start_line": "Int32", "end_line": "Int32"})

    return run


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap_lines: int = OVERLAP_LINES) -> DataFrame:
    """Pieces of every chunk whose code has more than ``limit`` characters.

    One record per chunk_id (its last delivery).  Only oversized code leaves the
    scan; smaller, empty and null codes give no piece.  A null start_line gives
    null line numbers.  Each piece has at most ``limit`` characters, ends at a
    line end wherever its range holds one, and repeats the last
    ``overlap_lines`` lines of the piece before, fewer where the next line would
    not fit.  Extra columns of ``chunks`` are ignored; an empty table gives no rows.
    """
    if limit < 1 or overlap_lines < 0:
        raise ValueError("limit must be positive and overlap_lines not negative")
    big = F.length("function_code") > limit
    slim = chunks.select("chunk_id", "ingested_at", "start_line", F.when(big, F.col("function_code")).alias("function_code"))
    keyed = slim.where(F.col("chunk_id").isNotNull())
    # Most keys arrive once and have no oversized delivery: they are dropped before the text is shuffled.
    oversized = latest(keyed.withColumn("_big", F.col("function_code").isNotNull()), ["chunk_id"], ["ingested_at"]).where("_big")
    return oversized.select("chunk_id", "function_code", "start_line").mapInPandas(_pieces(limit, overlap_lines), PIECES)


def found(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """chunk_id of every chunk that had to be split."""
    return split_oversized(chunks, limit).where("piece_no = 1 AND n_pieces > 1").select("chunk_id")
