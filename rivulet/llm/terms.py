"""Terms of many texts at once: maximal runs of chosen bytes in one UTF-8 buffer."""

from __future__ import annotations

import numpy as np

LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LETTERS_DIGITS = LETTERS.copy()
LETTERS_DIGITS[0x30:0x3A] = True


def term_runs(data: np.ndarray, offsets: np.ndarray, ink: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the runs of bytes in ``ink``, cut at row borders; first run of each row (n + 1 entries)."""
    n = len(data)
    on = ink[data]
    start, end = on.copy(), on.copy()
    if n:
        start[1:] &= ~on[:-1]
        end[:-1] &= ~on[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        start[edge] |= on[edge]
        end[edge - 1] |= on[edge - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets, "left")


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all ranges start .. start + size, one range after another."""
    to = np.cumsum(sizes)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(starts - (to - sizes), sizes)
