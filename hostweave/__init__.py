"""hostweave: multi-host activity campaigns from event telemetry, on Spark DataFrames."""

from hostweave.config import FuseConfig

__all__ = ["FuseConfig"]
