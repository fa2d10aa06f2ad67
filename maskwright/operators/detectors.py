"""Detectors: text to typed findings, as a column.

A finding is struct<category, start, length, confidence, severity, value_start, value_length, source, ord>. ``severity`` is
0 to 3, ``value_start`` and ``value_length`` are null unless only a part of the match is the value. ``ord`` is the detector's
number and breaks ties. Offsets are code points. What finds them is ``functions.engine``, on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import engine
from maskwright.functions.engine import CRITICAL, HIGH, LOW, MEDIUM
from maskwright.settings import Settings

FINDING = "struct<category:string,start:int,length:int,confidence:double,severity:int,value_start:int,value_length:int,source:string,ord:int>"
NONE = f"array<{FINDING}>"
NAMES = tuple(d.__name__ for d in engine.DETECTORS)
__all__ = ["CRITICAL", "FINDING", "HIGH", "LOW", "MEDIUM", "NAMES", "detect", "finding", "none"]

_FIELDS = (("category", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("confidence", pa.float64()), ("severity", pa.int32()), ("value_start", pa.int32()), ("value_length", pa.int32()), ("source", pa.string()), ("ord", pa.int32()))


def none() -> Column:
    return F.array().cast(NONE)


def finding(category: Column | str, start: Column, length: Column, confidence: Column | float, severity: Column | int, order: int, value: tuple[Column, Column] | None = None, source: str = "Regex") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    at, size = value if value else (F.lit(None), F.lit(None))
    return F.struct(
        lit(category).alias("category"), start.cast("int").alias("start"), length.cast("int").alias("length"), lit(confidence).cast("double").alias("confidence"), lit(severity).alias("severity"),
        at.cast("int").alias("value_start"), size.cast("int").alias("value_length"), F.lit(source).alias("source"), F.lit(order).alias("ord"),
    )


def structs(rows: list[tuple], fields: Iterable[tuple[str, pa.DataType]]) -> pa.StructArray:
    """An Arrow array of structs from tuples."""
    fields = list(fields)
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def lists(rows: list[list[tuple]], fields: Iterable[tuple[str, pa.DataType]]) -> pa.ListArray:
    """An Arrow array of lists of structs."""
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs([x for r in rows for x in r], fields))


def finding_lists(rows: list[list[tuple]]) -> pa.ListArray:
    return lists(rows, _FIELDS)


def detect(text: Column, settings: Settings = Settings(), only: tuple[str, ...] | None = None) -> Column:
    """All findings of a text, in detector order; null text has none."""
    if settings.bypass:
        return none()

    @F.arrow_udf(NONE)
    def found(texts: pa.Array) -> pa.Array:
        return finding_lists([engine.detect(t, settings, only) for t in texts.to_pylist()])

    return found(text)
