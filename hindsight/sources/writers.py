"""Sinks."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..streaming import require_batch


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Write Parquet partitions; those that ``df`` has rows for are replaced, the others stay.

    The mode belongs to this write alone and not to the session. Rows are committed together at the end, so a
    failed or repeated run leaves whole partitions.
    """
    if not partition_by:
        raise ValueError("partitions can be replaced only with partition_by")
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


def save_training_inputs(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = (), replace: str = "all"
) -> None:
    """Write training inputs as Parquet; ``partition_by=["dt"]`` lets readers skip other days.

    ``overwrite`` replaces all that was there; with ``replace="partitions"`` only the partitions that ``df`` has rows
    for, so a rerun of one day leaves the others.
    """
    require_batch(df, "training inputs")
    if replace not in ("all", "partitions"):
        raise ValueError(f"replace must be 'all' or 'partitions', got {replace!r}")
    if replace == "partitions":
        if mode != "overwrite":
            raise ValueError(f"replace='partitions' overwrites, got mode {mode!r}")
        replace_partitions(df, path, partition_by)
        return
    # Said for this write, as a session may have the other mode for its own.
    writer = df.write.mode(mode).option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def save_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a metrics frame (a handful of rows) as one JSON-lines file on the shared storage."""
    metrics.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path)
