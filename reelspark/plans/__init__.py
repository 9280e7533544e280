"""How ordered, as-of, interval and folding work is laid out over partitions."""
from .asof import asof_join
from .fold import Fold, fold
from .interval import interval_join
from .skew import Chunks, find_chunks
from .timeline import (
    Framed, Lag, LastKnown, Lead, NextKnown, RowNumber, RunningMax, RunningMin, RunningSum, Timeline,
)

__all__ = [
    "Chunks", "Fold", "Framed", "Lag", "LastKnown", "Lead", "NextKnown", "RowNumber", "RunningMax",
    "RunningMin", "RunningSum", "Timeline", "asof_join", "find_chunks", "fold", "interval_join",
]
