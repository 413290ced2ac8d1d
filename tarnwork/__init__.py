"""tarnwork: record linkage and event-log analytics on Spark DataFrames."""

from tarnwork.config import Config

__all__ = ["Config"]
