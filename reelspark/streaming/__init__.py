"""The operators on Structured Streaming, with the results of their batch forms."""
from .closing import closable, mark
from .folds import fold_stream
from .layers import pair_layers_stream
from .summaries import late_counts, play_sessions_stream, stream_event_summary
from .verdicts import read_snapshot, upsert_verdict_stream

__all__ = [
    "closable", "fold_stream", "late_counts", "mark", "pair_layers_stream", "play_sessions_stream", "read_snapshot", "stream_event_summary",
    "upsert_verdict_stream",
]
