"""Local alignment of word sequences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

MATCH, MISMATCH, GAP = 2, -1, -1


def local_align(item: Sequence, text: Sequence, diagonal: int = 0, band: int | None = None) -> tuple[int, int, int, int]:
    """Smith-Waterman: (score, matching words, first and end position in ``text``).

    With ``band``, only cells within ``band`` of ``diagonal`` (text position
    less item position) are worked out. Equal scores: more matching words,
    then the earlier end. Nothing in common: (0, 0, 0, 0).
    """
    best = (0, 0, 0, 0)
    none = (0, 0, -1)
    above = [none] * (len(text) + 1)
    for i, word in enumerate(item):
        low, high = 0, len(text)
        if band is not None:
            low, high = max(0, i + diagonal - band), min(high, i + diagonal + band + 1)
            if low >= high:
                continue
        row = [none] * (len(text) + 1)
        left = none
        for j in range(low, high):
            score, same, start = above[j]
            if word == text[j]:
                cell = (score + MATCH, same + 1, start if score else j)
            else:
                cell = (score + MISMATCH, same, start)
            up = above[j + 1]
            if up[0] + GAP > cell[0]:
                cell = (up[0] + GAP, up[1], up[2])
            if left[0] + GAP > cell[0]:
                cell = (left[0] + GAP, left[1], left[2])
            if cell[0] <= 0:
                cell = none
            row[j + 1] = left = cell
            if cell[0] > best[0] or (cell[0] == best[0] and cell[1] > best[1]):
                best = (cell[0], cell[1], cell[2], j + 1)
        above = row
    return best


def score_bound(item: np.ndarray, text: np.ndarray) -> int:
    """No local alignment scores more: words of ``text`` that ``item`` has count as matches, all others as edits."""
    gain = np.where(np.isin(text, item), MATCH, MISMATCH)
    total = np.concatenate([[0], np.cumsum(gain)])
    return int((total - np.minimum.accumulate(total)).max())


def local_score(item: np.ndarray, text: np.ndarray) -> int:
    """The score of ``local_align`` alone, a row of the table at a time."""
    if not len(text):
        return 0
    places = np.arange(len(text) + 1) * -GAP
    above, best = np.zeros(len(text) + 1, np.int64), 0
    for word in item:
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(text == word, MATCH, MISMATCH))
        # A gap along the row costs the same for each word that it passes.
        above = np.maximum.accumulate(row + places) - places
        best = max(best, int(above.max()))
    return best
