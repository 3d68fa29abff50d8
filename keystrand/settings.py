"""Settings of a run and their defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

GIB = 1 << 30


@dataclass(frozen=True)
class Settings:
    """``threads``: task slots of a local session; ``memory``: bytes that a run or heap may hold when runs are asked for by budget.

    Sorting itself needs neither: Spark's sorter spills as it must. ``kway``
    tells whether inspectable merges take all runs at once or two at a time
    (the order is the same). ``scratch`` is where Spark keeps spills.
    """

    threads: int = field(default_factory=lambda: os.cpu_count() or 1)
    max_payload: int = 64
    records: int = 10_000
    memory: int = 8 * GIB
    kway: bool = False
    scratch: str = "/tmp"

    def __post_init__(self) -> None:
        if self.threads < 1 or self.memory < 1 or self.records < 0 or self.max_payload <= 8:
            raise ValueError("threads and memory must be positive, records not negative, max_payload above 8")
