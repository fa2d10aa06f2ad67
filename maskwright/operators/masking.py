"""Masking: a text and its plan or findings to safe text of the same length."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import engine
from maskwright.operators.detectors import structs
from maskwright.operators.policy import CLASSIFICATION, classifications, fenced
from maskwright.settings import Settings

RESULT = "struct<success:boolean,safe_text:string,error:string,masked_chars:int,sensitive_chars:int>"
_FIELDS = (("success", pa.bool_()), ("safe_text", pa.string()), ("error", pa.string()), ("masked_chars", pa.int32()), ("sensitive_chars", pa.int32()))


def _span_tuples(plan: list[dict] | None) -> list[tuple]:
    return [(s["start"], s["length"], s["mode"]) for s in plan or ()]


def mask_plan(text: Column, result: Column) -> Column:
    """RESULT of masking by plan: null text fails, a text that is not sensitive stays, a sensitive one without a plan fails, and so does a plan whose spans overlap or leave the text."""

    @F.arrow_udf(RESULT)
    def masked(texts: pa.Array, sensitive: pa.Array, plans: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), sensitive.to_pylist(), plans.to_pylist(), strict=True)
        return structs([engine.mask_plan(t, (s, 0.0, 0, "", [], _span_tuples(p))) for t, s, p in rows], _FIELDS)

    return masked(text, result["is_sensitive"], result["plan"])


def mask_findings(text: Column, findings: Column) -> Column:
    """Preview by findings, last start first: each is masked by the partial rule and its tail comes from the raw text, so an
    outer finding that starts earlier uncovers the tail of what it encloses."""

    @F.arrow_udf("string")
    def preview(texts: pa.Array, places: pa.Array) -> pa.Array:
        return pa.array([None if t is None else engine.mask_findings(t, [(f["start"], f["length"]) for f in p or ()]) for t, p in zip(texts.to_pylist(), places.to_pylist(), strict=True)], pa.string())

    return preview(text, F.transform(findings, lambda f: F.struct(f["start"].alias("start"), f["length"].alias("length"))))


def stars(length: Column) -> Column:
    """Masked characters of a partial span: all of up to four, else three quarters rounded up."""
    return F.when(length <= 4, length).otherwise(F.floor((length * 3 + 3) / 4).cast("int"))


def preview_counts(text: Column, findings: Column) -> tuple[Column, Column]:
    """(masked characters with overlaps counted twice, summed lengths) of the preview."""
    valid = F.filter(findings, lambda f: (f["start"] >= 0) & (f["length"] > 0) & (f["start"] + f["length"] <= F.length(text)))
    return F.aggregate(valid, F.lit(0), lambda n, f: n + stars(f["length"])), F.aggregate(findings, F.lit(0), lambda n, f: n + f["length"])


def safe_preview(text: Column, result: Column) -> Column:
    """Masked by plan; where that fails and there are findings, by findings; else the text."""
    by_plan = mask_plan(text, result)
    return F.when(by_plan["success"], by_plan["safe_text"]).when(F.size(result["findings"]) > 0, mask_findings(text, result["findings"])).otherwise(text)


def mask_twice(df: DataFrame, text_col: str = "text", settings: Settings = Settings(), out: str = "masked") -> DataFrame:
    """``df`` with ``result`` and the RESULT ``out``: masked by plan, and with double-layer masking what the first pass
    left is analysed and masked again, all in one pass. If the second masking fails the first one's text stays."""

    @F.arrow_udf(f"struct<result:{CLASSIFICATION},masked:{RESULT}>")
    def protect(texts: pa.Array) -> pa.Array:
        done = [engine.protect(t, settings) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([classifications([r for r, _ in done]), structs([m for _, m in done], _FIELDS)], ["result", "masked"])

    both = fenced(df.drop("result", out), protect(F.col(text_col)), "_both")
    return both.withColumns({"result": F.col("_both.result"), out: F.col("_both.masked")}).drop("_both")


def html_text(html: Column) -> Column:
    """Text of a clipboard fragment: what lies between the fragment marks, without tags and outer blanks; without marks, the raw value."""
    inner = F.regexp_extract(html, r"(?s)<!--StartFragment-->(.*?)<!--EndFragment-->", 1)
    return F.when(html.rlike(r"(?s)<!--StartFragment-->.*?<!--EndFragment-->"), F.regexp_replace(F.regexp_replace(inner, "(?d)<.*?>", ""), r"^\s+|\s+$", "")).otherwise(html)
