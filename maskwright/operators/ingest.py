"""Ingestion of clipboard payloads into history rows; every step is a projection, the clock is an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.operators.masking import html_text, mask_findings, mask_twice
from maskwright.operators.policy import classify, fenced
from maskwright.settings import Settings

ML_LINES = 1000
TTL = "INTERVAL 15 MINUTES"


def content_type(has_bitmap: Column, has_html: Column, has_rtf: Column, has_text: Column) -> Column:
    """Bitmap over HTML over RTF over text."""
    return F.when(has_bitmap, "Image").when(has_html, "Html").when(has_rtf, "Rtf").when(has_text, "Text").otherwise("Unknown")


def payload_text(text: Column, html: Column) -> Column:
    """The captured text, else the text of the HTML fragment, else ''."""
    return F.coalesce(text, html_text(html), F.lit(""))


def is_ignored(kind: Column, text: Column) -> Column:
    return kind.isin("Text", "Unknown") & F.coalesce(text, F.lit("")).rlike(r"^\s*$")


def line_count(text: Column) -> Column:
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, 0).otherwise(F.size(F.split(text, "\n", -1)))


def route(text: Column) -> Column:
    return F.when(line_count(text) >= ML_LINES, "layered").otherwise("patterns")


def ingest(payloads: DataFrame, settings: Settings, now: Column) -> DataFrame:
    """Payloads (id, windows_id, content_type, text, write_ok) to outcome rows.

    ``outcome`` is Ignored, MaskingFailed, ReplacementFailed or Success. Sensitive text is stored masked: Protected with an
    expiry where the masked text could be written back, ReplacementFailed without one where not; other text is Normal and
    searchable. Raw text of a sensitive row never leaves this function.
    """
    rows = mask_twice(payloads.withColumn("text", F.coalesce("text", F.lit(""))), "text", settings)
    sensitive, ok = F.col("result")["is_sensitive"], F.col("masked")["success"]
    written = F.coalesce(F.col("write_ok"), F.lit(False))
    ignored = is_ignored(F.col("content_type"), F.col("text"))
    state = F.when(sensitive & written, "Protected").when(sensitive, "ReplacementFailed").otherwise("Normal")
    normal = ~sensitive
    row = F.struct(
        "id",
        F.when(normal, F.col("windows_id")).alias("windows_id"),
        now.alias("created_at"),
        "content_type",
        state.alias("protection_state"),
        F.when(sensitive, F.col("masked")["safe_text"]).otherwise(F.col("text")).alias("safe_text"),
        F.col("result")["primary_category"].alias("primary_category"),
        F.when(sensitive & written, now + F.expr(TTL)).alias("expires_at"),
        F.lit(False).alias("is_pinned"),
        F.when(normal & ~ignored, F.col("text")).otherwise("").alias("search_text"),
        F.when(ignored, "Ignored").when(sensitive & ~ok, "MaskingFailed").when(sensitive & ~written, "ReplacementFailed").otherwise("Success").alias("outcome"),
    )
    return fenced(rows, row, "_row").select("_row.*")


def stored(outcomes: DataFrame) -> DataFrame:
    """Rows that are kept: neither ignored nor failed to be masked."""
    return outcomes.filter(~F.col("outcome").isin("Ignored", "MaskingFailed")).drop("outcome")


def own_writes(events: DataFrame, registrations: DataFrame) -> DataFrame:
    """Events (text, seq) without those that the application itself wrote.

    Each registration (text, n: +1 expected, -1 cancelled) swallows one event of its text, the earliest first.
    """
    expected = registrations.groupBy("text").agg(F.greatest(F.sum("n"), F.lit(0)).alias("expected"))
    numbered = events.withColumn("k", F.row_number().over(Window.partitionBy("text").orderBy("seq")))
    return numbered.join(expected, "text", "left").filter(F.col("k") > F.coalesce("expected", F.lit(0))).drop("k", "expected")


def history_match(events: DataFrame, history: DataFrame) -> DataFrame:
    """``events`` with the id of the latest history row (history_id, text, at) of equal text, null where there is none."""
    latest = history.groupBy("text").agg(F.max_by("history_id", F.struct("at", "history_id")).alias("windows_id"))
    return events.join(latest, "text", "left")


def paste_decision(state: Column, expires_at: Column, windows_id: Column, restored: Column, now: Column) -> Column:
    """What pasting an item does: Expired, ProtectionFailure, SafeText, Restored, RestoreFailed or Unavailable."""
    return (
        F.when((state == "Expired") | (expires_at <= now), "Expired").when(state == "ReplacementFailed", "ProtectionFailure").when(state == "Protected", "SafeText")
        .when(windows_id.isNull(), "Unavailable").when(F.coalesce(restored, F.lit(False)), "Restored").otherwise("RestoreFailed")
    )


def listing(kind: Column, text: Column) -> Column:
    """What a history list shows of an entry: its text, or a placeholder for what has none."""
    return F.when(kind == "Image", "[image]").when(F.coalesce(text, F.lit("")) != "", text).when(kind == "Html", "[html]").when(kind == "Rtf", "[rich text]").otherwise("[unknown]")


def redaction_harness(texts: DataFrame, text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per non-blank line of each text, with the other columns: line_number (from 1, blank lines count), original_length,
    redacted_text (the preview by findings), finding_count and categories (distinct, in order)."""
    lines = texts.select("*", F.posexplode(F.split(F.regexp_replace(F.col(text_col), "\r\n?", "\n"), "\n", -1)).alias("_at", "_line")).drop(text_col)
    found = classify(lines.filter(~F.col("_line").rlike(r"^\s*$")), "_line", settings, "_result")
    findings = F.col("_result.findings")
    return found.select(
        *(c for c in texts.columns if c != text_col), (F.col("_at") + 1).alias("line_number"), F.length("_line").alias("original_length"), mask_findings(F.col("_line"), findings).alias("redacted_text"),
        F.size(findings).alias("finding_count"), F.array_distinct(F.transform(findings, lambda f: f["category"])).alias("categories"),
    )
