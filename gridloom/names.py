"""Names for helper columns beside a user's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spare(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of ``df`` has, whatever the case."""
    used = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in used:
            stem += "_"
        used.add(stem.lower())
        out.append(stem)
    return out
