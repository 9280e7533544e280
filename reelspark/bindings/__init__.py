"""Every operator bound to the test tables, with the SQL its result must equal."""
from . import audio, catalog, frames, metadata, packets, streams, telemetry, timing, verdicts  # noqa: F401
from .tables import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
