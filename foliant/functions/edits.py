"""Edit distance of long token sequences: by furthest-reaching diagonals where they are alike, bit-parallel where they are not."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np

#: A token's places become a mask of bits once if it has so many of them, else whenever it is met.
OFTEN = 8
#: The part of the longer sequence up to which a distance is looked for by diagonals; tokens compared at once.
ALIKE, BLOCK = 16, 64


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Insertions, deletions and substitutions from a to b, exactly. What both begin and end with is left out.

    A distance d of up to the ALIKE-th part of the longer rest takes work in the order of d * d and the tokens; a greater one the product of the
    lengths by 64.
    """
    first, last_a, last_b = 0, len(a), len(b)
    while first < min(last_a, last_b) and a[first] == b[first]:
        first += 1
    while first < min(last_a, last_b) and a[last_a - 1] == b[last_b - 1]:
        last_a, last_b = last_a - 1, last_b - 1
    short, long = sorted((a[first:last_a], b[first:last_b]), key=len)
    if not len(short):
        return len(long)
    found = by_diagonals(short, long, len(long) // ALIKE)
    return by_bits(short, long) if found is None else found


def by_diagonals(a: Sequence[Hashable], b: Sequence[Hashable], most: int) -> int | None:
    """The distance of a and b if it is at most most.

    For each number of edits and each diagonal, how far into a one gets: from the three ways to make the last edit, and then along
    what is equal, all diagonals at once.
    """
    code: dict[Hashable, int] = {}
    n, m = len(a), len(b)
    x, y = (np.array([*(code.setdefault(t, len(code)) for t in s), *[end] * BLOCK], np.int64) for s, end in ((a, -1), (b, -2)))
    step = np.arange(BLOCK)

    def along(row: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        open_ = np.flatnonzero(x[row] == y[row + diagonal])
        while len(open_):
            at = row[open_][:, None] + step
            unlike = x[np.minimum(at, n + BLOCK - 1)] != y[np.minimum(at + diagonal[open_][:, None], m + BLOCK - 1)]
            run = np.where(unlike.any(1), unlike.argmax(1), BLOCK)
            row[open_] += run
            open_ = open_[run == BLOCK]
        return row

    low, high = 0, 0  # diagonals
    row = along(np.zeros(1, np.int64), np.zeros(1, np.int64))
    for edits in range(most + 1):
        if low <= m - n <= high and row[m - n - low] == n:
            return edits
        new_low, new_high = max(low - 1, -n), min(high + 1, m)
        before = np.full(new_high - new_low + 3, -2, np.int64)
        before[low - new_low + 1 : high - new_low + 2] = row
        diagonal = np.arange(new_low, new_high + 1)
        row = np.maximum(np.maximum(before[1:-1] + 1, before[:-2]), before[2:] + 1)
        row = np.minimum(row, np.minimum(n, m - diagonal))
        row, low, high = along(row, diagonal), new_low, new_high
    return None


def by_bits(short: Sequence[Hashable], long: Sequence[Hashable]) -> int:
    """The distance of two sequences that have tokens.

    For each token of one, the differences between neighbouring rows of a column of the table (+1, 0 or -1) are the bits of two
    numbers, and a few operations on these give the next column.
    """
    places: dict[Hashable, list[int]] = {}
    for i, t in enumerate(short):
        places.setdefault(t, []).append(i)
    masks = {t: _mask(p) for t, p in places.items() if len(p) >= OFTEN}
    whole, top = (1 << len(short)) - 1, 1 << (len(short) - 1)
    up, down, score = whole, 0, len(short)  # where a row is one more, and one less, than the row above it
    for t in long:
        same = masks.get(t)
        if same is None:
            same = _mask(places.get(t, ()))
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | (whole & ~(diagonal | up)), up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = (right << 1) | 1
        up = whole & ((left << 1) | ~(diagonal | right))
        down = right & diagonal & whole
    return score


def _mask(places: Sequence[int]) -> int:
    out = 0
    for p in places:
        out |= 1 << p
    return out
