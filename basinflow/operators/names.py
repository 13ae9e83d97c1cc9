"""Column names that an operator adds beside those of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(base: str, *frames: DataFrame) -> str:
    """``base``, with underscores added while a frame has such a column (names ignore case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
