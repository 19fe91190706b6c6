"""Array expressions on histories, from built-in functions; padding is dealt with first, being most of it."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonzero_count(array: Column) -> Column:
    """Entries that are neither null nor padding; null for a null array."""
    return F.when(array.isNotNull(), F.size(F.array_compact(F.array_remove(array, 0))))


def pad_right(array: Column, length: int, element_type: str) -> Column:
    """Exactly ``length`` entries of ``element_type``: cut on the right, or filled up with zeros."""
    array_type = f"array<{element_type}>"
    entries = F.slice(F.coalesce(array, F.array().cast(array_type)).cast(array_type), 1, length)
    zeros = F.array_repeat(F.lit(0).cast(element_type), F.lit(length) - F.size(entries))
    return F.concat(entries, zeros)
