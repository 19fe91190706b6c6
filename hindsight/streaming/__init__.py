"""The sequences are a batch computation; streaming inputs are refused up front."""

from pyspark.sql import DataFrame


def require_batch(df: DataFrame, name: str) -> None:
    if df.isStreaming:
        raise ValueError(f"{name} is a streaming DataFrame; only batch inputs are supported")
