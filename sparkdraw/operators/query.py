"""Queries by entity name. Names are checked on the driver, before a plan exists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Record types by the names a query can use.
GRAPHICS = {"LIN": ("LIN",), "LINE": ("LIN",), "ARC": ("ARC",), "FIL": ("FIL",), "FILLET": ("FIL",), "BSPL": ("BSPL",), "BSPLINE": ("BSPL",), "SPLINE": ("BSPL",), "CIR": ("CIR",), "CIRCLE": ("CIR",), "TEX": ("TEX",), "TEXT": ("TEX",)}
_DIMENSIONS = ("DANG", "DCHMF", "DDIA", "DRAD", "DSGL")
ANNOTATIONS = {
    **{d: (d,) for d in _DIMENSIONS}, "DIMENSION": _DIMENSIONS, "DTV": ("DTV",), "TOLERANCE": ("DTV",), "LED": ("LED",), "LEADER": ("LED",), "HAT": ("HAT",), "HATCH": ("HAT",), "SYML": ("SYML",), "SYMBOL": ("SYML",),
}


def record_types(query: str, names: dict[str, tuple[str, ...]]) -> list[str] | None:
    """Record types that a query selects; None for all. Unknown names raise ValueError."""
    if not isinstance(query, str):
        raise TypeError("a query is a string of names")
    asked = [x for x in re.split(r"[,\s]+", query.upper()) if x]
    if not asked or "*" in asked:
        if len(asked) > 1 and any(x != "*" and x not in names for x in asked):
            raise ValueError(f"unknown entity name in {query!r}")
        return None
    if unknown := [x for x in asked if x not in names]:
        raise ValueError(f"unknown entity name {', '.join(unknown)}")
    return sorted({t for x in asked for t in names[x]})


def select(entities: DataFrame, query: str, names: dict[str, tuple[str, ...]], flag: str, part_index: int | None = None) -> DataFrame:
    """Entities of the class ``flag`` that a query names, of one part or all, in source order within each drawing."""
    types = record_types(query, names)
    out = entities.where(F.col(flag))
    if types is not None:
        out = out.where(F.col("mi_type").isin(*types))
    return out if part_index is None else out.where(F.col("part_index") == part_index)
