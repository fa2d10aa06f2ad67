"""Policy: findings to an ordered, allow-listed list, mask spans and a summary.

A classification is struct<is_sensitive, confidence, severity, primary_category, findings, plan>; a plan is
array<struct<start, length, mode>> with mode 1 (partial) or 2 (full), ordered and without touching spans.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import engine
from maskwright.functions.engine import FULL, LEAST_CONFIDENCE, PARTIAL, PRESERVE
from maskwright.operators.detectors import FINDING, finding_lists, lists
from maskwright.settings import Settings

SPAN = "struct<start:int,length:int,mode:int>"
CLASSIFICATION = f"struct<is_sensitive:boolean,confidence:double,severity:int,primary_category:string,findings:array<{FINDING}>,plan:array<{SPAN}>>"
__all__ = ["CLASSIFICATION", "FULL", "LEAST_CONFIDENCE", "PARTIAL", "PRESERVE", "SPAN", "classifications", "classify", "fenced", "finding_tuples", "merge_spans"]

_SPAN_FIELDS = tuple((n, pa.int32()) for n in ("start", "length", "mode"))


def classifications(rows: list[tuple]) -> pa.StructArray:
    """An Arrow array of classifications from the engine's tuples."""
    kinds = (("is_sensitive", pa.bool_()), ("confidence", pa.float64()), ("severity", pa.int32()), ("primary_category", pa.string()))
    plain = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)]
    return pa.StructArray.from_arrays([*plain, finding_lists([r[4] for r in rows]), lists([r[5] for r in rows], _SPAN_FIELDS)], [*(n for n, _ in kinds), "findings", "plan"])


def finding_tuples(findings: list[dict] | None) -> list[tuple]:
    return [tuple(f.values()) for f in findings or ()]


def merge_spans(spans: Column) -> Column:
    """Spans (array<SPAN>) that overlap or touch become one; it is full if any of them is."""

    @F.arrow_udf(f"array<{SPAN}>")
    def merged(rows: pa.Array) -> pa.Array:
        return lists([engine.merge_spans((s["start"], s["length"], s["mode"]) for s in r or ()) for r in rows.to_pylist()], _SPAN_FIELDS)

    return merged(spans.cast(f"array<{SPAN}>"))


def fenced(df: DataFrame, value: Column, out: str) -> DataFrame:
    """``df`` with a column that the optimizer computes once: neither filters nor projections above are merged with its expression."""
    return df.drop(out).withColumn("_fenced", value).select("*", F.explode(F.array("_fenced")).alias(out)).drop("_fenced")


def classify(df: DataFrame, text_col: str = "text", settings: Settings = Settings(), out: str = "result", extra: Column | None = None) -> DataFrame:
    """``df`` with a classification of the text, in one pass without a shuffle.

    ``extra`` adds findings from elsewhere (a model) after ordering, as a second layer does. A null text is empty.
    """

    @F.arrow_udf(CLASSIFICATION)
    def alone(texts: pa.Array) -> pa.Array:
        return classifications([engine.classify(t, settings) for t in texts.to_pylist()])

    @F.arrow_udf(CLASSIFICATION)
    def layered(texts: pa.Array, more: pa.Array) -> pa.Array:
        return classifications([engine.classify(t, settings, finding_tuples(m)) for t, m in zip(texts.to_pylist(), more.to_pylist(), strict=True)])

    return fenced(df, alone(F.col(text_col)) if extra is None else layered(F.col(text_col), extra.cast(f"array<{FINDING}>")), out)
