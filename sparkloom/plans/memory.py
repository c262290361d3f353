"""How many chunks of R a memory budget asks for."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Bytes of a row in a chunk's hash relation, and the share of the budget that goes to bookkeeping at least.
ROW_BYTES, FIXED_MB, MOST_CHUNKS = 48, 64, 1024


def lambert_w(x: float) -> float:
    """The principal branch: w with w * exp(w) = x, for x >= -1 / e, by Halley's method."""
    if x < -1 / math.e:
        raise ValueError("no real solution below -1 / e")
    w = math.log1p(x) if x > 0 else max(x, -0.99)
    for _ in range(100):
        e = math.exp(w)
        step = (w * e - x) / (e * (w + 1) - (w + 2) * (w * e - x) / (2 * w + 2)) if w != -1 else 0.0
        w -= step
        if abs(step) <= 1e-14 * (1 + abs(w)):
            break
    return w


@dataclass(frozen=True)
class MemoryPlan:
    rows: int
    budget_mb: int
    chunk_rows: int
    chunks: int


def plan(rows: int, budget_mb: int) -> MemoryPlan:
    """The largest chunk that fits what the budget leaves. A chunk of n rows takes n * (ROW_BYTES + log2(n) / 8): its rows and
    their packed radix bits; so n = exp(W(x * exp(c)) - c) with x = 8 * budget * ln 2 and c = 8 * ROW_BYTES * ln 2. Budgets that
    leave nothing are an error."""
    if budget_mb <= FIXED_MB:
        raise ValueError(f"the budget must exceed {FIXED_MB} MB")
    x, c = 8 * ((budget_mb - FIXED_MB) << 20) * math.log(2), 8 * ROW_BYTES * math.log(2)
    most = int(math.exp(lambert_w(x * math.exp(c)) - c))
    chunks = min(MOST_CHUNKS, max(1, math.ceil(rows / most)))
    return MemoryPlan(rows, budget_mb, math.ceil(rows / chunks) if rows else 0, chunks)


def plan_chunks(rows: int, budget_mb: int) -> int:
    return plan(rows, budget_mb).chunks
