"""Shapes of summaries from error bounds or from a memory budget."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Memory tiers in KB, and the share of all weight that makes a key heavy.
TIERS_KB = (128, 256, 512, 1024, 2048, 4096, 8192)
PHI = 1e-4
#: Bytes that a memory budget grants each entry or cell.
CELL, MG_ENTRY, SS_ENTRY, LC_ENTRY, SAMPLE_ENTRY = 8, 128, 136, 136, 128
COUNT_MIN_ROWS, COUNT_SKETCH_ROWS = 5, 7


@dataclass(frozen=True)
class Grid:
    """Rows and cells of a row of a linear sketch."""

    rows: int
    width: int


def _share(x: float, name: str) -> float:
    if not 0 < x < 1:
        raise ValueError(f"{name} must lie between 0 and 1")
    return x


def count_min_grid(epsilon: float, delta: float) -> Grid:
    return Grid(max(1, math.ceil(math.log(1 / _share(delta, "delta")))), math.ceil(math.e / _share(epsilon, "epsilon")))


def count_sketch_grid(epsilon: float, delta: float) -> Grid:
    return Grid(math.ceil(2 * math.log(1 / _share(delta, "delta"))), math.ceil(16 / _share(epsilon, "epsilon") ** 2))


def ams_grid(epsilon: float, delta: float) -> Grid:
    """Rows whose median is taken, and copies whose mean is taken in each."""
    return count_sketch_grid(epsilon, delta)


def ams_confidence(rows: int) -> float:
    """1 - delta of a number of rows."""
    return 1 - math.exp(-rows / 2)


def misra_gries_capacity(epsilon: float) -> int:
    return max(1, math.ceil(1 / _share(epsilon, "epsilon")) - 1)


def space_saving_capacity(epsilon: float) -> int:
    return max(1, math.ceil(1 / _share(epsilon, "epsilon")))


def lossy_window(epsilon: float) -> int:
    return math.ceil(1 / _share(epsilon, "epsilon"))


def threshold(phi: float, total: int) -> int:
    return math.ceil(phi * total)


def count_min_for(kb: int) -> Grid:
    return Grid(COUNT_MIN_ROWS, kb * 1024 // (COUNT_MIN_ROWS * CELL))


def count_sketch_for(kb: int) -> Grid:
    return Grid(COUNT_SKETCH_ROWS, kb * 1024 // (COUNT_SKETCH_ROWS * CELL))


def misra_gries_for(kb: int) -> tuple[int, float]:
    """Capacity and epsilon."""
    capacity = kb * 1024 // MG_ENTRY
    return capacity, 1 / (capacity + 1)


def space_saving_for(kb: int) -> tuple[int, float]:
    capacity = kb * 1024 // SS_ENTRY
    return capacity, 1 / capacity


def lossy_for(kb: int) -> tuple[int, float]:
    """Window and epsilon."""
    epsilon = 1 / (kb * 1024 // LC_ENTRY)
    return math.ceil(1 / epsilon), epsilon


def sample_for(kb: int) -> int:
    return kb * 1024 // SAMPLE_ENTRY


def gated_ams_for(kb: int, strict: bool = False) -> tuple[Grid, Grid]:
    """Count-Min gate and AMS grid that share a budget: the gate gets 15 % (strict) or
    40 % of it, and the rows come from delta 0.05 or 0.20."""
    gate = kb * 1024 * (15 if strict else 40) // 100
    rows = math.ceil(2 * math.log(1 / (0.05 if strict else 0.20)))
    return Grid(COUNT_MIN_ROWS, gate // (COUNT_MIN_ROWS * CELL)), Grid(rows, (kb * 1024 - gate) // (rows * CELL))


#: Bytes of an entry beside two for each character of its key.
ENTRY_BYTES = {"misra_gries": 56, "space_saving": 80, "lossy_counting": 72, "concise": 56, "reservoir": 56}
